"""Cross-tokenizer alignment: groups of tokens of two vocabularies that end together.

Every byte of a text gets a label: no token ends here, one of A, one of B, or
both. A regular expression finds the spans up to each both-label, and the labels
counted in a span say how many tokens of each side make a group. Tokens of A and B
are linked where their bytes overlap, and each link is rated by how often its
pair of ids is linked in the whole corpus.

Texts are first cut before spaces at which both tokenizers start anew, and
the distinct stretches of a block of documents are labelled once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from footfall.llm import vocab
from footfall.llm.scratch import Scratch
from footfall.ship import ship

#: Stretches start at the first of some spaces that follow no white space and no mark of a space; a last single space starts none.
STRETCH = re.compile("(?<=[^\\s▁\x85]) (?!\\Z)")
#: Labels of a byte.
A_ENDS, B_ENDS, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
#: Characters of a text that are cut at a time, and stretches that are numbered at once.
PART, MANY = 1 << 20, 1 << 17
#: Distinct pairs of its documents, added up, that make a block full.
BLOCK_PAIRS = 1 << 20
#: A pair of ids as one number: A's times this, plus B's.
PAIR = 1 << 32


@functools.lru_cache(maxsize=2)
def _plain_json(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class Stretches:
    """Tokens, groups and links of the distinct stretches met so far.

    Ragged arrays: stretch k has its pairs of linked ids, in order, at
    ``bounds[k]`` to ``bounds[k + 1]`` of ``pairs``. ``facts`` holds the numbers
    of A's tokens, B's tokens and groups, and whether both sides' bytes are
    those of the stretch.
    """

    def __init__(self, json_path: str, ranks_path: str, pieces_path: str):
        self.json_path = json_path
        self.a = vocab.ranked_bpe(ranks_path)
        self.b = vocab.piece_model(pieces_path)
        self.needs_json = re.compile("[^\x00-ɏ]").search
        self.a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)
        self.pairs, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        json = _plain_json(self.json_path)
        a = [json.encode(f" {t}", add_special_tokens=False).ids if self.needs_json(t) else self.a.encode_ordinary(f" {t}") for t in texts]
        return a, self.b.encode(texts, num_threads=1)

    def _same_bytes(self, new: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether both sides' bytes are those of the stretch."""
        raw = [f" {t}".encode() for t in new]
        whole = b"".join(raw)
        flat = ([self.a_bytes[i] for i in chain.from_iterable(a)], [self.b_bytes[i] for i in chain.from_iterable(b)])
        if all(b"".join(x) == whole for x in flat):
            ends = np.cumsum(list(map(len, raw)))
            stops = [np.r_[0, np.cumsum(list(map(len, x)))][np.cumsum(list(map(len, side)))] for x, side in zip(flat, (a, b))]
            if all((s == ends).all() for s in stops):
                return np.ones(len(new), bool)
        joined = ([b"".join([of[i] for i in x]) for x in side] for of, side in ((self.a_bytes, a), (self.b_bytes, b)))
        return np.array([r == x == y for r, x, y in zip(raw, *joined)], bool)

    def add(self, new: list[str]) -> None:
        """Label new stretches, laid end to end, and keep their groups and pairs."""
        a, b = self._ids(new)
        good = self._same_bytes(new, a, b)
        if not good.all():
            a, b = ([x if ok else [] for x, ok in zip(side, good)] for side in (a, b))
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(new)) for side in (a, b))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        labels = np.zeros(int(a_ends[-1]) if len(a) else 0, np.uint8)
        labels[a_ends - 1] |= A_ENDS
        labels[b_ends - 1] |= B_ENDS
        spans = SPAN.findall(labels.tobytes())
        ends = np.cumsum([len(s) for s in spans])
        # tokens of a group: the labels in its span, where the both-label is one of each
        in_a = np.cumsum([s.count(A_ENDS) + 1 for s in spans]).astype(np.int64)
        in_b = np.cumsum([s.count(B_ENDS) + 1 for s in spans]).astype(np.int64)
        # a link ends with every label: with the tokens that hold its byte
        marks = labels[labels > 0]
        left, right = np.cumsum(marks & A_ENDS) - (marks & A_ENDS), np.cumsum(marks >> 1) - (marks >> 1)
        pairs = a[left] * PAIR + b[right]
        stops = np.r_[0, np.cumsum(n_a)]
        n_links = np.diff(np.r_[0, np.cumsum(np.bincount(left, minlength=len(a)))][np.r_[0, np.cumsum(n_a)]]) if len(a) else np.zeros(len(new), np.int64)
        # a link belongs to the token of A that it holds, and so to that token's stretch
        n_groups = np.diff(np.searchsorted(in_a, stops, "right"))
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_at, b_at = [0, *in_a.tolist()], [0, *in_b.tolist()]
        texts = [f"{','.join(a_text[a_at[g] : a_at[g + 1]])}|{','.join(b_text[b_at[g] : b_at[g + 1]])}" for g in range(len(ends))]
        first = np.r_[0, np.cumsum(n_groups)].tolist()
        self.groups += [";".join(texts[first[k] : first[k + 1]]) for k in range(len(new))]
        self.facts = np.concatenate([self.facts, np.c_[n_a, n_b, n_groups, good]])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(n_links)])

    def of(self, stretches: list[str]) -> np.ndarray:
        """Numbers of stretches, each without its first space; new ones are labelled."""
        known = len(self.index)
        ids = np.fromiter(map(self.index.__getitem__, stretches), np.int64, len(stretches))
        if len(self.index) > known:
            self.add(list(islice(self.index, known, None)))
        return ids

    def links(self, ids: np.ndarray) -> np.ndarray:
        """The pairs of some stretches, end to end."""
        begin, sizes = self.bounds[ids], self.bounds[ids + 1] - self.bounds[ids]
        return self.pairs[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


@functools.lru_cache(maxsize=2)
def _stretches(json_path: str, ranks_path: str, pieces_path: str) -> Stretches:
    return Stretches(json_path, ranks_path, pieces_path)


def stretches_of(text: str) -> Iterator[list[str]]:
    """The stretches of a space and the text, each without its first space, some of them at a time."""
    at = 0
    while len(text) - at > PART and (cut := STRETCH.search(text, at + PART)):
        yield STRETCH.split(text[at : cut.start()])
        at = cut.end()
    if at < len(text):
        yield STRETCH.split(text[at:])


class Aligned:
    """What is known of a document while its stretches come in."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.good, self.facts = doc_id, True, np.zeros(3, np.int64)
        self.digest, self.pairs, self.times = hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, own: Stretches, ids: np.ndarray) -> None:
        facts = own.facts[ids]
        if not facts[:, 3].all():
            self.good, self.pairs, self.times = False, self.pairs[:0], self.times[:0]
        if self.good:
            self.digest.update((";" * bool(self.facts[2]) + ";".join([own.groups[k] for k in ids.tolist()])).encode())
            self.facts += facts[:, :3].sum(axis=0)
            pairs, times = np.unique(own.links(ids), return_counts=True)
            if len(self.pairs):
                pairs, at = np.unique(np.r_[self.pairs, pairs], return_inverse=True)
                times = np.bincount(at, weights=np.r_[self.times, times]).astype(np.int64)
            self.pairs, self.times = pairs, times

    def row(self) -> dict:
        """Columns of the document; one without tokens has zeros."""
        if not self.good:
            return dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), 0) | {"doc_id": self.doc_id, "groups_sha256": ""}
        names = ("n_a", "n_b", "n_groups", "n_links")
        digest = self.digest.hexdigest() if self.facts[2] else ""
        return {"doc_id": self.doc_id, "groups_sha256": digest} | dict(zip(names, [*self.facts.tolist(), int(self.times.sum())]))


def aligned(own: Stretches, rows: Iterator[tuple[int | None, str | None]]) -> Iterator[Aligned]:
    """The documents, in order; stretches of many are numbered at once."""
    docs: list[Aligned] = []
    parts: list[tuple[Aligned, list[str]]] = []
    held = 0

    def settle() -> None:
        nonlocal parts, held
        if len(own.index) > vocab.CACHE_ENTRIES:
            own.clear()
        ids = own.of(list(chain.from_iterable(p for _, p in parts)))
        for (doc, _), own_ids in zip(parts, np.split(ids, np.cumsum([len(p) for _, p in parts])[:-1])):
            doc.take(own, own_ids)
        parts, held = [], 0

    for doc_id, text in rows:
        docs.append(Aligned(doc_id))
        for part in stretches_of(text or ""):
            parts.append((docs[-1], part))
            held += len(part)
            if held >= MANY:
                settle()
        if not parts:
            yield from docs
            docs = []
    if parts:
        settle()
    yield from docs


def align(text: str, json_path: str | None = None, ranks_path: str | None = None, pieces_path: str | None = None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: ids of A and ids of B whose bytes begin and end together."""
    own = _stretches(
        json_path or vocab.public_path("byte_bpe_50k.json"), ranks_path or vocab.public_path("byte_bpe_50k.tiktoken"), pieces_path or vocab.public_path("piece_bpe_32k.model")
    )
    ids = own.of(list(chain.from_iterable(stretches_of(text))))
    if not own.facts[ids, 3].all():
        return []
    groups = ";".join([own.groups[k] for k in ids])
    return [tuple([int(i) for i in side.split(",")] for side in g.split("|")) for g in groups.split(";")] if groups else []


#: A block's rows: one for each document, and one with the block's pairs and how often each is linked.
_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _blocks(batches: Iterator[pa.RecordBatch], paths: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Aligned documents in blocks; a document's links are places in its block's list of pairs."""
    own = _stretches(*paths)
    numbers = count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
    done: list[Aligned] = []
    size = 0

    def block() -> pa.RecordBatch:
        distinct, at = np.unique(np.concatenate([d.pairs for d in done]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([d.times for d in done]), minlength=len(distinct)).astype(np.int64)
        number, begin, rows = next(numbers), 0, []
        for d in done:
            places = at[begin : begin + len(d.pairs)]
            begin += len(d.pairs)
            rows.append(d.row() | {"block": number, "at": places.astype("<u4").tobytes(), "times": d.times.astype("<u4").tobytes()})
        rows.append({"block": number, "pairs": distinct, "counts": total})
        return pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    def rows() -> Iterator[tuple[int | None, str | None]]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield doc_id, text.as_py()

    try:
        for doc in aligned(own, rows()):
            done.append(doc)
            size += len(doc.pairs) + 16
            if size >= BLOCK_PAIRS:
                yield block()
                done, size = [], 0
        if done:
            yield block()
    finally:
        own.clear()  # an idle worker holds no text


def _rated(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with the sums of their links' counts."""
    place = pairs.column("place").to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place] = pairs.column("total").to_numpy()
    best[place] = pairs.column("best").to_numpy().astype(np.int64)
    n_best, count_sum = [], []
    for at, times in zip(docs.column("at"), docs.column("times")):
        at, times = np.frombuffer(at.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
        n_best.append(int((best[at] * times).sum()))
        count_sum.append(int((total[at] * times).sum()))
    docs = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return docs.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def token_links(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, pieces_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Aligned documents, and the counts of linked ids over all of them.

    The first table has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum
    and groups_sha256; the second a_id, b_id, total and best. Null and empty
    texts, and texts whose tokens' bytes differ from a space and the text, have
    no tokens and add nothing to the counts. Repeated rows count as often as
    they stand, null ids stay null; an empty table gives empty tables. Further
    columns of ``docs`` don't matter.

    A document's links stay with it as places in its block's list of distinct
    pairs. Only that list is shuffled to be counted, so a pair that is linked
    everywhere costs one row a block, and the totals come back to the block.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "alignment")
    paths = (
        json_path or vocab.public_path("byte_bpe_50k.json"), ranks_path or vocab.public_path("byte_bpe_50k.tiktoken"), pieces_path or vocab.public_path("piece_bpe_32k.model")
    )
    shape = """block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary,
        pairs array<long>, counts array<long>"""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = scratch.keep(texts.mapInArrow(lambda batches: _blocks(batches, paths), shape), "aligned")
    own = aligned.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("block", "place", "p.*")
    totals = scratch.keep(own.groupBy("pairs").agg(F.sum("counts").alias("total")), "totals")
    # at most one row for each id of B: as large as its vocabulary
    highest = totals.groupBy((F.col("pairs") % PAIR).alias("b_id")).agg(F.max("total").alias("most"))
    rated = totals.withColumn("b_id", F.col("pairs") % PAIR).join(F.broadcast(highest), "b_id")
    rated = rated.select("pairs", "b_id", "total", (F.col("total") == F.col("most")).alias("best"))
    back = own.join(rated.select("pairs", "total", "best"), "pairs").select(F.col("block").alias("of_block"), "place", "total", "best")
    rows = aligned.where("pairs IS NULL").drop("pairs", "counts")
    out = rows.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(
        _rated, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    counts = rated.select((F.col("pairs") / PAIR).cast("long").alias("a_id"), "b_id", "total", "best")
    return out, counts


def op12_token_alignment(docs: DataFrame) -> DataFrame:
    """One row for every document; see :func:`token_links`."""
    out, _ = token_links(docs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
