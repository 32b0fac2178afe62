"""Packing: documents fill training windows together with lexical neighbours.

Documents are tokenised once into a table. Document frequencies of hashed token
pairs are counted over all of it, into an array that grows with the corpus up to
a fixed size. Documents are then partitioned by their rarest pair, so that neighbours meet, and each
partition is packed in shards of bounded size: a shard's BM25 inverted index
returns unused neighbours of the document that began a window, and they fill it
in order of score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import vocab
from footfall.llm.scratch import Scratch
from footfall.ship import ship

#: Bits of a hashed term: at least, and at most in a large corpus.
TERM_BITS, MAX_TERM_BITS = 18, 22
TERMS = 1 << TERM_BITS
SLICES = 256
K1, B = 1.2, 0.75
#: Terms in more than one document of this many of a shard are kept as full rows,
#: in shards of at most so many entries: their product has a number for each two.
DENSE, MOST_DENSE = 8, 8192
#: Neighbours picked one at a time before the rest are sorted.
PICKED = 8
#: A posting, read at once: 8 bytes.
POSTING = np.dtype([("doc", np.int32), ("weight", np.float32)])

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def term_bits(n_tokens: int) -> int:
    """Bits for the terms of ``n_tokens`` tokens: a slot for each, up to MAX_TERM_BITS."""
    return min(MAX_TERM_BITS, max(TERM_BITS, int(n_tokens).bit_length()))


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Adjacent pairs of a document's ids, as one number each."""
    return (ids[:-1].astype(np.int64) << 16) | ids[1:]


def term_ids(ids: np.ndarray, bits: int = TERM_BITS) -> np.ndarray:
    """Hashed adjacent pairs of a document's ids."""
    return hashed(ids[:-1], ids[1:], bits)


def hashed(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The pairs of ids (a, b) in ``bits`` bits."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def tokenized(docs: DataFrame, json_path: str, ranks_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and the ids (little-endian 16-bit, ``end_id`` last) of every row."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocab.byte_bpe(json_path, ranks_path)
        end = np.array([end_id], np.uint16).tobytes()
        for texts in batches:
            yield pd.Series([bpe.encode(t or "") + end for t in texts], dtype=object)

    ids = docs.select("doc_id", encode("text").alias("ids"))
    return ids.select("doc_id", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), "ids")


def term_document_counts(tokens: DataFrame, bits: int = TERM_BITS) -> np.ndarray:
    """In how many rows of ``tokens`` each of the 2 ** ``bits`` hashed terms is, in 32 bits.

    Each task counts in one array and hands it on in slices, which are summed
    by slice, for 64 tasks at a time first: the result has the same size
    whatever the input, and so has what a group holds.
    """
    n_terms = 1 << bits
    width = n_terms // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, place = np.zeros(n_terms, np.uint32), np.zeros(n_terms, np.int32)
        for batch in batches:
            for raw in batch["ids"]:
                terms = term_ids(np.frombuffer(raw, np.uint16), bits)
                at = np.arange(len(terms), dtype=np.int32)
                place[terms] = at  # of a repeated term one place is left
                total[terms[place[terms] == at]] += 1
        del place
        for k in range(0, SLICES, 16):  # 16 slices are 2 MB at most
            parts = [total[i * width : (i + 1) * width].astype(np.int64).tobytes() for i in range(k, k + 16)]
            yield pd.DataFrame({"slice": range(k, k + 16), "counts": parts})

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for raw in group["counts"]:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    schema = "slice int, counts binary"
    partial = tokens.select("ids").mapInPandas(count, schema)
    partial = partial.withColumn("part", F.floor(F.spark_partition_id() / 64).cast("int"))
    some = partial.groupBy("slice", "part").applyInPandas(add, schema)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(counts=[np.frombuffer(raw, np.int64).astype(np.float32).tobytes() for raw in batch["counts"]])

    # the driver gets 16 MB at most
    rows = some.groupBy("slice").applyInPandas(add, schema).mapInPandas(narrow, schema).collect()
    out = np.zeros(n_terms, np.float32)
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.float32)
    return out


def with_route(tokens: DataFrame, shared_counts: Broadcast, most: int, wanted: int) -> DataFrame:
    """``tokens`` with ``route``: the rarest term that another document has too, and ``part``.

    A route that more than ``most`` documents may have, as its count bounds them,
    is dealt over so many parts that each gets about that many; documents
    without terms over ``wanted``.
    """

    @F.pandas_udf("route long, parts long")
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = shared_counts.value
        bits = len(counts).bit_length() - 1
        for raws in batches:
            routes, parts = [], []
            for raw in raws:
                terms = term_ids(np.frombuffer(raw, np.uint16), bits)
                rarity = counts[terms]
                rarity[rarity < 2] = np.inf
                k = int(np.argmin(rarity)) if len(terms) else -1
                routes.append(int(terms[k]) if len(terms) else -1)
                parts.append(1 + int(counts[terms[k]]) // most if len(terms) else wanted)
            yield pd.DataFrame({"route": np.array(routes, np.int64), "parts": np.array(parts, np.int64)})

    routed = tokens.withColumn("found", route("ids"))
    part = F.pmod(F.xxhash64("doc_id", "ids"), F.col("found.parts"))
    return routed.select("doc_id", "ids", F.col("found.route").alias("route"), part.alias("part"))


class ShardIndex:
    """BM25 postings of one shard's documents.

    Terms are the pairs themselves; only their document counts are of hashed
    terms. Exact copies are one entry. A term that no other entry of the shard
    holds scores nothing but the copies of its own entry.
    """

    def __init__(self, docs: list[np.ndarray], counts: np.ndarray, n_docs: int, mean_length: float):
        self.n = len(docs)
        entries: dict[bytes, int] = {}
        self.entry = np.array([entries.setdefault(d.tobytes(), len(entries)) for d in docs], np.int64)
        texts = [np.frombuffer(raw, np.uint16) for raw in entries]
        self.m = len(texts)
        bits = len(counts).bit_length() - 1
        shared = counts > 1
        keys, shift = [np.zeros(0, np.int64)], self.m.bit_length()
        for k, d in enumerate(texts):
            keys.append(pairs_of(d)[shared[term_ids(d, bits)]] << shift | k)
        ranked = np.concatenate(keys)
        ranked.sort()
        at = np.flatnonzero(np.diff(ranked, prepend=-1))
        tf = np.diff(np.r_[at, len(ranked)])
        ranked = ranked[at]
        pairs, owner = ranked >> shift, ranked & (1 << shift) - 1
        begins = np.flatnonzero(np.diff(pairs, prepend=-1))
        sizes = np.diff(np.r_[begins, len(pairs)])
        df = counts[hashed(pairs[begins] >> 16, pairs[begins] & 0xFFFF, bits)].astype(float)
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        lengths = np.array([len(d) for d in texts])
        norm = K1 * (1 - B + B * lengths / mean_length)
        weight = np.repeat(idf, sizes) * tf * (K1 + 1) / (tf + norm[owner])
        postings = np.empty(len(owner), POSTING)
        postings["doc"], postings["weight"] = owner, weight
        self.postings = postings.view(np.int64)
        held = np.repeat(sizes, sizes)
        self.own = np.bincount(owner, weight * (held == 1), self.m) if self.m < self.n else np.zeros(self.m)
        # terms in many entries: what each entry gets of another's, by one product of full rows
        dense = np.flatnonzero(sizes > (max(1, self.m // DENSE) if self.m <= MOST_DENSE else self.m))
        row_of = np.full(len(sizes), -1)
        row_of[dense] = np.arange(len(dense))
        row = np.repeat(row_of, sizes)
        full = np.flatnonzero(row >= 0)
        rows = np.zeros((len(dense), self.m), np.float32)
        rows[row[full], owner[full]] = weight[full]
        self.common = (rows > 0).astype(np.float32).T @ rows
        # the other terms of each entry that another one holds, by entry
        few = np.flatnonzero((row < 0) & (held > 1))
        small = owner[few].astype(np.uint16 if self.m <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
        few = few[np.argsort(small, kind="stable")]
        self.left, self.size = np.repeat(begins, sizes)[few], held[few]
        self.first = np.r_[0, np.cumsum(np.bincount(small, minlength=self.m))]

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Scores of all documents, 0 for those in use or without a term of ``seed``."""
        e = self.entry[seed]
        left, sizes = (x[self.first[e] : self.first[e + 1]] for x in (self.left, self.size))
        at = np.repeat(left - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        found = self.postings.take(at).view(POSTING)
        score = np.bincount(found["doc"], found["weight"], self.m).astype(float)
        score[e] += self.own[e]
        score += self.common[e]
        if self.m < self.n:
            score = score[self.entry]
        score[~unused] = 0
        return score

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with ``seed``, best first."""
        return best_first(self.scores(seed, unused))

    def each_neighbour(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The same one by one: a window mostly takes so few that sorting them all costs more."""
        score = self.scores(seed, unused)
        for _ in range(PICKED):
            best = int(score.argmax())
            if not score[best]:
                return
            yield best
            score[best] = 0
        yield from best_first(score).tolist()


def best_first(score: np.ndarray) -> np.ndarray:
    found = np.flatnonzero(score)
    return found[np.lexsort((found, -score[found]))]


def pack_shard(docs: list[np.ndarray], index: ShardIndex, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard.

    The tail that fills no window is cut at powers of two, so nothing is padded.
    """
    unused = np.ones(len(docs), bool)
    total = sum(map(len, docs))
    ends, at = [], 0
    while total - at >= window:
        at += window
        ends.append(at)
    for bit in reversed(range(max(1, (total - at).bit_length()))):
        if (total - at) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    out: list[tuple[int, int, int, int, int]] = []
    seq, begin, pos, next_doc = 0, 0, 0, 0
    seed, queue = None, iter(())
    for _ in range(len(docs)):
        doc = next((d for d in queue if unused[d]), None)
        if doc is None and seed is not None:
            queue, seed = index.each_neighbour(seed, unused), None
            doc = next(queue, None)
        if doc is None:
            while not unused[next_doc]:
                next_doc += 1
            doc = seed = next_doc
        unused[doc] = False
        start, size = 0, len(docs[doc])
        while start < size:
            take = min(size - start, ends[seq] - pos)
            out.append((doc, start, take, seq, pos - begin))
            start += take
            pos += take
            if pos == ends[seq]:
                seq, begin = seq + 1, pos
                seed, queue = (doc if start < size else None), iter(())
    return out


def pack(
    docs: DataFrame,
    window: int = 1024,
    shard_tokens: int = 1 << 20,
    shard_docs: int = 4096,
    partition_tokens: int = 1 << 23,
    json_path: str | None = None,
    ranks_path: str | None = None,
    end_id: int = 0,
) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text) into sequences of ``window`` tokens.

    Returns one row per piece (PIECES). A document is the ids of its whole text
    and ``end_id``; null and empty texts are ``end_id`` alone. Documents are cut
    where a window ends. Every row of ``docs`` is a document of its own, so a
    repeated doc_id has pieces for each of its rows, and null doc_ids stay null.
    A shard holds at most ``shard_tokens`` tokens and ``shard_docs`` documents
    (one document if that is longer). Other columns are not read. An empty
    table gives no pieces.
    """
    json_path = json_path or vocab.public_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocab.public_path("byte_bpe_50k.tiktoken")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.keep(tokenized(docs.select("doc_id", "text"), json_path, ranks_path, end_id), "tokens")
    facts = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    # 16 MB at most, one copy in each Python worker
    shared_counts = docs.sparkSession.sparkContext.broadcast(term_document_counts(tokens, term_bits(facts["t"])))
    n_docs, mean_length = facts["n"], max(1.0, facts["t"] / max(1, facts["n"]))
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts["t"] // partition_tokens))
    # by hash, not by range: a range's bounds would have every route found twice
    dealt = (
        with_route(tokens, shared_counts, max(1, n_docs // (4 * wanted)), wanted)
        .repartition(wanted, "route", "part")
        .sortWithinPartitions("route", "doc_id", F.xxhash64("ids"))
        .select("doc_id", "ids")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, counts = TaskContext.get().partitionId() << 32, shared_counts.value
        ids: list[np.ndarray] = []
        names: list = []
        held = used = 0

        def flush() -> pd.DataFrame:
            nonlocal used, held
            pieces = pack_shard(ids, ShardIndex(ids, counts, n_docs, mean_length), window)
            crc = [zlib.crc32(ids[d][s : s + k].astype("<u4").tobytes()) for d, s, k, _, _ in pieces]
            cols = np.array(pieces, np.int64).reshape(-1, 5)
            out = pd.DataFrame(
                {
                    "doc_id": pd.array([names[d] for d in cols[:, 0]], dtype="Int64"),
                    "start": cols[:, 1],
                    "length": cols[:, 2],
                    "ids_crc32": np.array(crc, np.int64),
                    "doc_tokens": np.array([len(ids[d]) for d in cols[:, 0]], np.int64),
                    "sequence_id": cols[:, 3] + (base + used),
                    "offset": cols[:, 4],
                }
            )
            used += int(cols[-1, 3]) + 1
            ids.clear()
            names.clear()
            held = 0
            return out

        for batch in batches:
            for name, raw in zip(batch["doc_id"].astype("Int64"), batch["ids"]):
                own = np.frombuffer(raw, np.uint16)
                if ids and (held + len(own) > shard_tokens or len(ids) >= shard_docs):
                    yield flush()
                ids.append(own)
                names.append(name)
                held += len(own)
        if ids:
            yield flush()

    return dealt.mapInPandas(run, PIECES)


def op1_lexical_packing(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return pack(docs)
