"""Token counts: rank-synchronous merging of pre-tokens held as ragged arrays.

A text is cut into pre-tokens that no piece of the vocabulary can cross. The
distinct ones of a batch lie end to end in numpy arrays, and in every round each
sequence merges the adjacent pair of lowest rank, at all its places at once. What
is left when no pair of a sequence is in the vocabulary are its tokens, and only
their number is kept.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm import vocab
from footfall.llm.text import unused_names
from footfall.ship import ship

#: The character that stands for a space in pieces (fixed by the format).
MARK = "▁"
#: Rank of a pair that makes no piece.
NEVER = np.iinfo(np.int32).max
#: Pre-tokens of more symbols are merged one by one, along a chain of places.
LONG = 512
#: Symbols merged in one set of arrays.
FLAT = 1 << 16
#: Pre-tokens of one text that are looked up at a time.
PART = 1 << 18


class MergeTable:
    """Pairs of symbols that make a piece, in hashed arrays.

    A symbol is a piece's id; a piece's rank is its place in the order in which
    pieces are made. Pieces of several spaces share a score and are left out:
    :meth:`run_tokens` counts them.
    """

    def __init__(self, path: str):
        model = vocab.piece_model(path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): i for i in ids}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces that hold a space behind another character can't be counted by pre-token")
        self.size = model.get_piece_size()
        scores = np.array([-model.get_score(i) for i in ids])
        order = np.argsort(scores, kind="stable")
        #: Pieces in the order in which they are made.
        self.piece = np.array(ids, np.int32)[order]
        rank_of = np.full(self.size, NEVER, np.int32)
        rank_of[self.piece] = np.arange(len(ids))
        self.symbols = {p: i for p, i in pieces.items() if len(p) == 1}
        if missing := {c for p in pieces for c in p} - set(self.symbols):
            raise ValueError(f"{len(missing)} characters of the vocabulary are no pieces themselves")
        found = {
            pieces[p[:cut]] * self.size + pieces[p[cut:]]: int(rank_of[i])
            for p, i in pieces.items()
            for cut in range(1, len(p))
            if p[:cut] in pieces and p[cut:] in pieces and not p.startswith(2 * MARK)
        }
        self.levels = _hash_levels(np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found)))

        #: Lengths of the pieces that are marks only, where they are made after all others.
        runs = {p: model.get_score(i) for p, i in pieces.items() if p.startswith(2 * MARK)}
        if any(p.strip(MARK) for p in runs) or set(runs.values()) - {-scores.max()}:
            raise ValueError("pieces of several spaces must hold nothing else and be made last")
        self.runs = set(map(len, runs))
        if len(set(scores)) < len(ids) - len(runs):
            raise ValueError("pieces must be made one after the other, those of several spaces excepted")
        letters = "".join(map(re.escape, sorted(set(self.symbols) - {MARK})))
        self.cut = re.compile(f"{MARK}*[{letters}]+|{MARK}+")
        self.rest = re.compile(f"[^{letters}{MARK}]+")
        #: Code point to symbol.
        self.by_code = np.zeros(max(map(ord, self.symbols)) + 1, np.int32)
        for c, i in self.symbols.items():
            self.by_code[ord(c)] = i

    @functools.lru_cache(maxsize=4096)
    def run_tokens(self, marks: int) -> int:
        """Tokens of so many marks alone: merges of equal rank go from the left."""
        done: list[int] = []
        for _ in range(marks):
            done.append(1)
            while len(done) > 1 and done[-1] + done[-2] in self.runs:
                done[-2:] = [done[-1] + done[-2]]
        return len(done)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair makes, else NEVER."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(len(keys), NEVER, np.int32)
        for factor, shift, slots, ranks in self.levels:
            at = (keys * factor) >> shift & len(slots) - 1
            out = np.where(slots[at] == keys, ranks[at], out)
        return out


def _hash_levels(keys: np.ndarray, ranks: np.ndarray) -> list[tuple]:
    """Tables of hashed keys: what finds its slot taken goes to the next, smaller one."""
    levels, factor = [], np.int64(0x1E3779B97F4A7C15)  # any odd number
    while len(keys):
        bits = max(8, int(len(keys)).bit_length() + 2)
        shift = np.int64(62 - bits)
        at = (keys * factor) >> shift & (1 << bits) - 1
        _, first = np.unique(at, return_index=True)
        slots, held = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        slots[at[first]], held[at[first]] = keys[first], ranks[first]
        levels.append((factor, shift, slots, held))
        keys, ranks, factor = np.delete(keys, first), np.delete(ranks, first), np.int64(int(factor) * 31 & 0x7FFFFFFFFFFFFFFF | 1)
    return levels


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def _without_overlaps(places: np.ndarray) -> np.ndarray:
    """Of neighbouring places, whose pairs share a symbol, every other one from the left."""
    order = np.arange(len(places))
    begin = np.maximum.accumulate(np.where(np.r_[False, np.diff(places) == 1], 0, order))
    return places[(order - begin) % 2 == 0]


def _safe_places(table: MergeTable, sym, places, owner, ends, best) -> tuple[np.ndarray, np.ndarray]:
    """The places to merge in this round, and their sequences, where some sequences have several.

    Merging all of a sequence's places at once gives what merging them one by
    one from the left gives, unless a merged symbol and a neighbour make a
    piece that isn't of higher rank. Such a sequence merges only its first.
    """
    several = np.bincount(owner, minlength=len(best))[owner] > 1
    at, of = places[several], owner[several]
    piece = table.piece[best[of]]
    new = sym.copy()
    new[at] = piece
    worst = best[of].copy()
    inside = at + 2 < ends[of]
    for right in (sym, new):
        worst[inside] = np.minimum(worst[inside], table.look_up(piece[inside], right[at[inside] + 2]) - 1)
    gone = np.zeros(len(sym) + 1, bool)
    gone[at + 1] = True
    behind = at - 1 - gone[at - 1]
    inside = behind >= np.r_[0, ends][of]
    worst[inside] = np.minimum(worst[inside], table.look_up(new[behind[inside]], piece[inside]) - 1)
    careful = np.zeros(len(best), bool)
    careful[of[worst < best[of]]] = True
    keep = ~careful[owner] | np.r_[True, owner[1:] != owner[:-1]]
    return places[keep], owner[keep]


def count_ragged(table: MergeTable, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens left of each sequence, and the first of them.

    ``sym`` holds the sequences end to end and is changed, ``sizes`` their symbols, one at
    least. In a round each sequence merges its pair of lowest rank, wherever it
    stands; finished sequences leave the arrays.
    """
    out, head = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
    ids, sizes = np.arange(len(sizes)), sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    rank = np.append(table.look_up(sym[:-1], sym[1:]), NEVER)
    rank[ends - 1] = NEVER
    while len(ids):
        best = np.minimum.reduceat(rank, ends - sizes)
        going = best != NEVER
        if not going.all():
            done = ~going
            out[ids[done]], head[ids[done]] = sizes[done], sym[(ends - sizes)[done]]
            keep = np.repeat(going, sizes)
            sym, rank, best, ids, sizes = sym[keep], rank[keep], best[going], ids[going], sizes[going]
            ends = np.cumsum(sizes)
            if not len(ids):
                break
        places = np.flatnonzero(rank == np.repeat(best, sizes))
        owner = np.arange(len(ids))
        if len(places) > len(ids):
            places = _without_overlaps(places)
            owner = np.searchsorted(ends, places, "right")
            places, owner = _safe_places(table, sym, places, owner, ends, best)
        sym[places] = table.piece[rank[places]]
        stay = np.ones(len(sym), bool)
        stay[places + 1] = False
        sym, rank = sym[stay], rank[stay]
        sizes = sizes - np.bincount(owner, minlength=len(ids))
        ends = np.cumsum(sizes)
        spots = places - np.arange(len(places))
        last = spots + 1 == ends[owner]
        rank[spots[last]] = NEVER
        inner = spots[~last]
        rank[inner] = table.look_up(sym[inner], sym[inner + 1])
        inner = spots[spots > (ends - sizes)[owner]]
        rank[inner - 1] = table.look_up(sym[inner - 1], sym[inner])
    return out, head


def count_long(table: MergeTable, sym: np.ndarray) -> tuple[int, int]:
    """Tokens left of one long sequence and the first of them, by the same rounds.

    Places are chained, and those of each rank wait in a bucket, so a round
    costs what it merges and not the sequence's length.
    """
    n = len(sym)
    sym = np.append(sym, 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    rank = np.full(n + 1, NEVER, np.int32)
    rank[: n - 1] = table.look_up(sym[: n - 1], sym[1:n])
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[rank[places] != NEVER]
        places = places[np.argsort(rank[places], kind="stable")]
        found = rank[places]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for part in np.split(places, cuts) if len(places) else ():
            r = int(rank[part[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(part)

    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ok = (left >= 0) & (right < n)
        found = np.full(len(left), NEVER, np.int32)
        found[ok] = table.look_up(sym[left[ok]], sym[right[ok]])
        return found

    wait(np.arange(n))
    left = n
    while ranks:
        r = heapq.heappop(ranks)
        places = np.unique(np.concatenate(waiting.pop(r)))
        places = places[rank[places] == r]
        if not len(places):
            continue
        order = np.arange(len(places))
        begin = np.maximum.accumulate(np.where(np.r_[False, after[places[:-1]] == places[1:]], 0, order))
        hit = places[(order - begin) % 2 == 0]
        gone, ahead, behind = after[hit], after[after[hit]], before[hit]
        old = sym[hit]
        if len(hit) > 1:
            # merged on trial: what would each place make with its neighbours?
            piece = np.full(len(hit), table.piece[r])
            inside = ahead < n
            worst = np.full(len(hit), NEVER, np.int32)
            worst[inside] = table.look_up(piece[inside], sym[ahead[inside]])
            sym[hit] = piece
            behind = np.where(np.r_[False, gone[:-1] == behind[1:]], before[behind], behind)
            worst = np.minimum(worst, np.minimum(pair(behind, hit), pair(hit, ahead)))
            if (worst <= r).any():
                sym[hit[1:]] = old[1:]
                hit, gone, ahead = hit[:1], gone[:1], ahead[:1]
                waiting[r] = [places]
                heapq.heappush(ranks, r)
        sym[hit] = table.piece[r]
        after[hit] = ahead
        before[ahead] = hit
        rank[gone] = NEVER
        left -= len(hit)
        behind = before[hit]
        behind = behind[behind >= 0]
        rank[hit] = pair(hit, after[hit])
        rank[behind] = pair(behind, after[behind])
        wait(np.unique(np.r_[hit, behind]))
    return left, int(sym[0])


class Counter:
    """Tokens of texts; pre-tokens that were counted are remembered, up to a bound."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.counts = np.zeros(0, np.int64)

    def _symbols(self, text: str) -> np.ndarray:
        return self.table.by_code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words and the first of each, in arrays of bounded size."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, heads = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        for k in np.flatnonzero(sizes > LONG).tolist():
            counts[k], heads[k] = count_long(self.table, self._symbols(words[k]))
        short = np.flatnonzero(sizes <= LONG)
        for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(sizes[short]) // FLAT)) + 1):
            if len(part):
                counts[part], heads[part] = count_ragged(self.table, self._symbols("".join([words[k] for k in part.tolist()])), sizes[part])
        return counts, heads

    def _count_new(self, new: list[str]) -> np.ndarray:
        """Tokens of pre-tokens. Of several leading marks the last goes with the word.

        The others are merged after all else, and with that last one if no
        piece of the word has taken it.
        """
        runs = [k for k, w in enumerate(new) if w.startswith(2 * MARK)]
        marks = {k: len(new[k]) - len(new[k].lstrip(MARK)) for k in runs}
        for k in runs:
            new[k] = new[k][marks[k] - 1 :]
        counts, heads = self._merge(new)
        for k, m in marks.items():
            if new[k] == MARK or heads[k] == self.table.symbols[MARK]:
                counts[k] += self.table.run_tokens(m) - 1
            else:
                counts[k] += self.table.run_tokens(m - 1)
        return counts

    def _sums(self, parts: list[list[str]]) -> list[int]:
        if len(self.index) > vocab.CACHE_ENTRIES:
            self.clear()
        known, sizes = len(self.index), list(map(len, parts))
        # a word not met before gets the next number
        ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        if len(self.index) > known:
            self.counts = np.concatenate([self.counts[:known], self._count_new(list(islice(self.index, known, None)))])
        counts = np.r_[0, np.cumsum(self.counts[ids])]
        ends = np.cumsum(sizes)
        return np.diff(counts[np.r_[0, ends]]).tolist()

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, as the vocabulary's own library gives them."""
        out = [0] * len(texts)
        parts, owner, held = [], [], 0

        def settle() -> None:
            nonlocal parts, owner, held
            for i, n in zip(owner, self._sums(parts)):
                out[i] += n
            parts, owner, held = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            marked = MARK + text.replace(" ", MARK)
            # characters outside the vocabulary fall back to their bytes
            out[i] = sum(len(s.encode()) for s in self.table.rest.findall(marked))
            if len(marked) <= PART:
                found = [self.table.cut.findall(marked)]
            else:
                words = (m.group() for m in self.table.cut.finditer(marked))
                found = iter(lambda: list(islice(words, PART)), [])
            for part in found:
                parts.append(part)
                owner.append(i)
                held += len(part)
                if held > PART:
                    settle()
        if parts:
            settle()
        return out


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text under a sentencepiece BPE model; null and empty: 0."""
    path = path or vocab.public_path("piece_bpe_32k.model")

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()), dtype="int64")

    return run(text)


def with_token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of its text.

    Null and empty texts have no bytes and no tokens. Rows are counted one by
    one, so null ids, ties and repeated rows don't matter. Columns of ``docs``
    with these names are replaced; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    (n,) = unused_names(docs, "n")
    counted = docs.select(*own, token_count(F.col("text"), path).alias(n))
    return counted.select(
        *own, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit")
    )


def op13_token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    return with_token_counts(docs.select("doc_id", "text")).drop("text")
