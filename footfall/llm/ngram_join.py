"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap enough.

1. Every task hashes its documents' shingles and sends them to hash buckets,
   packed in arrays. A bucket counts in how many different sets each shingle is
   and answers with those that are in two or more. What no other set holds
   can't link anything, and its rank (first of all) needs no name. Shingles that
   very many sets hold are known beforehand and answered in salted groups.
2. Each set now knows its shared shingles and, from its size, how many unshared
   ones come before them in rare-first order. If those fill its prefix it links
   with nothing. The others are written with their prefix.
3. Sets that follow each other under a prefix shingle, by size, are compared
   first: two pairs a set at most, which join large groups of near copies.
   Sets outside a shingle's largest component then try its most typical member.
   After that only pairs across the components found are left to compare, under
   every prefix shingle they share; pairs inside a component can't change it,
   and a shingle that one component alone holds is left out of later rounds.
4. Length, positional and suffix filters prune pairs before sets are fetched;
   each pair is verified once, on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.components import components, merged
from footfall.llm.scratch import Scratch, tidy
from footfall.llm.spread import each_part, parts_seen, spread_of
from footfall.llm.text import unused_names
from footfall.ship import ship

WORDS = 5
#: Shingles that a bucket counts at once, and that a task gathers before it sends.
BUCKET_SHINGLES = 1 << 21
FLUSH_SHINGLES = 1 << 18
#: One set in so many shows which shingles are hot, and most hot shingles that are sent to tasks.
SAMPLED, MAX_HOT = 32, 1 << 22
#: Buckets of hot shingles have their salt above this bit.
HOT_BIT = 40
SIGNATURE = 128
#: Up to so many pairs, only the sets that they name are shuffled to verify them.
BROADCAST_PAIRS = 200_000
#: Up to so many shingles in the sets of all pairs, both filters are one step (32 MB a side).
ONE_STEP_SHINGLES = 1 << 22
#: Rounds that join sets to typical members of large groups.
STAR_ROUNDS = 3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_SEGMENT = 1 << 18
#: Hash bits that the sample of hot shingles leaves out.
_KEPT = np.uint64(4)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_K), -1, 1 << 64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _K)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _segments(raw: bytes) -> Iterator[bytes]:
    """A text in parts of some 256 kB that end between words."""
    at = 0
    while len(raw) - at > _SEGMENT:
        cut = at + _SEGMENT
        while cut < len(raw) and not _SPACE[raw[cut]]:
            cut += 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word: runs of other than ASCII white space, A-Z lower-cased."""
    out = []
    for part in _segments(text.encode().lower()):
        b = np.frombuffer(part, np.uint8)
        blank = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        up, down = _POWERS.upto(len(b))
        run = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
        total = run[ends - 1] - np.where(starts > 0, run[starts - 1], np.uint64(0))
        out.append(_mix(total * down[starts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words.

    A text with fewer words has its whole sequence as one shingle, one without
    words has none.
    """
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = h * _K + w[i : n + i]
    h = np.sort(_mix(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def set_id(shingles: np.ndarray) -> int:
    """A 63-bit name of a set; equal sets have equal names. 0 is the empty set's."""
    if not len(shingles):
        return 0
    total = np.add.reduce(shingles, keepdims=True)
    folded = np.bitwise_xor.reduce(_mix(shingles + _K), keepdims=True)
    name = _mix(total * _MIX2 + folded + np.uint64(len(shingles)))[0]
    return int(name >> np.uint64(1)) or 1


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def needed(n, percent: int):
    """Least overlap with any set that a set of n shingles can link with."""
    return (n * percent + 99) // 100


def least_overlap(n, m, percent: int):
    """Least overlap of linked sets of n and m shingles."""
    return ((n + m) * percent + 99 + percent) // (100 + percent)


def described(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles and set_id of every row, and of one set in SAMPLED its shingles."""

    @F.pandas_udf("n_shingles long, set_id long, sample array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t, words)
            name = set_id(s)
            rows.append((len(s), name, (s >> _KEPT).astype(np.int64) if name and name % SAMPLED == 0 else None))
        return pd.DataFrame(rows, columns=["n_shingles", "set_id", "sample"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), describe("text").alias("d")).select(
        "doc_id", "text_hash", "d.*"
    )


def hot_shingles(own: DataFrame) -> np.ndarray:
    """Shingles that very many sets hold, most frequent first, as :func:`described`'s sample shows.

    They need no exact count: any order that all sets agree on serves, and these
    come last in it. Their entries are answered in salted groups. A shingle is
    one of them from a share of the sampled sets that makes its group larger
    than a bucket should be; at most MAX_HOT are sent out.
    """
    sampled = own.where(F.col("sample").isNotNull()).groupBy("set_id").agg(F.first("sample").alias("sample"))
    facts = sampled.agg(F.count(F.lit(1)).alias("n")).first()
    least = max(8, min(facts["n"] // 256, BUCKET_SHINGLES // SAMPLED))
    counts = sampled.select(F.explode("sample").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    rows = counts.where(F.col("k") >= least).orderBy(F.desc("k"), "h").limit(MAX_HOT).select("h").toPandas()
    return rows["h"].to_numpy(np.int64).astype(np.uint64)


def shared_shingles(
    docs: DataFrame, total: int, percent: int, words: int = WORDS, hot: np.ndarray | None = None, salts: int = 1
) -> DataFrame:
    """The sets whose prefix holds shingles of other sets.

    Columns: set_id, n, unshared, shared (bytes of sorted 64-bit hashes), prefix
    (an array of the shared hashes of the prefix, rare first) and signature (how many shared
    hashes fall in each of SIGNATURE ranges). Entries of ``hot`` shingles (their
    upper 60 bits) go to ``salts`` groups a bucket.
    """
    bits = max(4, int(np.ceil(np.log2(max(1, total / BUCKET_SHINGLES)))))
    width = 48 + min(bits, 12)  # hash bits that are kept
    low_bits = np.uint64((1 << (width - bits)) - 1)
    block_bits = bits
    hot_sorted = np.unique((np.zeros(0, np.uint64) if hot is None else hot) >> np.uint64(60 - width))

    def is_hot(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(hot_sorted, s), len(hot_sorted) - 1)
        return hot_sorted[at] == s

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: list[np.ndarray] = []
        names: list[int] = []
        seen: set[int] = set()
        held = 0

        def flush() -> pd.DataFrame:
            sizes = np.array([len(s) for s in sets], np.int64)
            ids = np.array(names, np.int64)
            h = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            bucket = (h >> np.uint64(width - bits)).astype(np.int64)
            if len(hot_sorted):
                bucket = np.where(is_hot(h), bucket + (1 + ids[owner] % salts << HOT_BIT), bucket)
            order = np.lexsort((owner, bucket))
            h, owner, bucket = h[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(h)]):
                own = owner[lo:hi]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                who = own[first]
                counts = np.diff(np.r_[first, len(own)]).astype(np.uint32)
                rows.append(
                    (int(bucket[lo]), ids[who].tobytes(), sizes[who].astype(np.uint32).tobytes(), counts.tobytes(), _pack48(h[lo:hi]))
                )
            return pd.DataFrame(rows, columns=["bucket", "sets", "sizes", "counts", "hashes"])

        for batch in batches:
            for text in batch["text"]:
                s = shingle_set(text, words)
                name = set_id(s)
                if not name or name in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(name)
                s = s >> np.uint64(64 - width)
                if len(s) > 1:
                    s = s[np.r_[True, s[1:] != s[:-1]]] if (s[1:] == s[:-1]).any() else s
                sets.append(s)
                names.append(name)
                held += len(s)
                if held >= FLUSH_SHINGLES:
                    yield flush()
                    sets, names, held = [], [], 0
        if sets:
            yield flush()

    def answer(key, group: pd.DataFrame) -> pd.DataFrame:
        salted, bucket = key[0] >> HOT_BIT, key[0] & (1 << HOT_BIT) - 1
        high = np.uint64(bucket) << np.uint64(width - bits)
        ids = np.frombuffer(b"".join(group["sets"]), np.int64)
        sizes = np.frombuffer(b"".join(group["sizes"]), np.uint32)
        counts = np.frombuffer(b"".join(group["counts"]), np.uint32)
        h = (_unpack48(b"".join(group["hashes"])) & low_bits) | high
        which = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        if not salted:  # drop what is there once, before anything is sorted by set
            order = np.argsort(h, kind="stable")
            h, which = h[order], which[order]
            same = h[1:] == h[:-1]
            twice = np.r_[False, same] | np.r_[same, False] if len(h) else np.zeros(0, bool)
            h, which = h[twice], which[twice]
        # the same set may have come from several tasks
        name = ids[which]
        order = np.lexsort((name, h))
        h, which, name = h[order], which[order], name[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (name[1:] != name[:-1])] if len(h) else np.zeros(0, bool)
        h, which, name = h[new], which[new], name[new]
        if salted:
            rarity = np.full(len(h), 255, np.uint8)
        else:
            group_no = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.zeros(0, np.int64)
            held_by = np.bincount(group_no)[group_no] if len(h) else group_no
            more = held_by > 1
            h, which, name, held_by = h[more], which[more], name[more], held_by[more]
            rarity = np.minimum(254, np.round(8 * np.log2(np.maximum(1, held_by)))).astype(np.uint8)
        block = name >> (63 - block_bits)
        order = np.lexsort((h, name))
        h, which, name, rarity, block = (x[order] for x in (h, which, name, rarity, block))
        rows = []
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(h) else []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(h)]):
            own = name[lo:hi]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            k = np.diff(np.r_[first, len(own)]).astype(np.uint32)
            rows.append(
                (int(block[lo]), bucket, own[first].tobytes(), sizes[which[lo:hi][first]].tobytes(), k.tobytes(), _pack48(h[lo:hi]), rarity[lo:hi].tobytes())
            )
        return pd.DataFrame(rows, columns=["block", "bucket", "sets", "sizes", "counts", "hashes", "rarity"])

    def assemble(key, group: pd.DataFrame) -> pd.DataFrame:
        high = np.concatenate(
            [np.full(len(r), np.uint64(b) << np.uint64(width - bits)) for b, r in zip(group["bucket"], group["rarity"])]
        )
        ids = np.frombuffer(b"".join(group["sets"]), np.int64)
        sizes = np.frombuffer(b"".join(group["sizes"]), np.uint32).astype(np.int64)
        counts = np.frombuffer(b"".join(group["counts"]), np.uint32)
        h = (_unpack48(b"".join(group["hashes"])) & low_bits) | high
        rarity = np.frombuffer(b"".join(group["rarity"]), np.uint8)
        which = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((h, rarity, ids[which]))
        h, which = h[order], which[order]
        name = ids[which]
        cuts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(h) else []
        rows = []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(h)]):
            n = int(sizes[which[lo]])
            unshared = n - int(hi - lo)
            prefix = n - needed(n, percent) + 1 - unshared
            if prefix <= 0:
                continue
            shared = np.sort(h[lo:hi])
            part = (shared >> np.uint64(width - 7)).astype(np.int64)
            signature = np.minimum(255, np.bincount(part, minlength=SIGNATURE)).astype(np.uint8)
            rows.append((int(name[lo]), n, unshared, shared.tobytes(), h[lo : min(hi, lo + prefix)].astype(np.int64), signature.tobytes()))
        return pd.DataFrame(rows, columns=["set_id", "n", "unshared", "shared", "prefix", "signature"])

    asked = docs.select("text").mapInPandas(send, "bucket long, sets binary, sizes binary, counts binary, hashes binary")
    answered = asked.groupBy("bucket").applyInPandas(
        answer,
        "block long, bucket long, sets binary, sizes binary, counts binary, hashes binary, rarity binary",
    )
    return answered.groupBy("block").applyInPandas(
        assemble, "set_id long, n long, unshared long, shared binary, prefix array<long>, signature binary"
    )


def prefix_entries(sets: DataFrame) -> DataFrame:
    """h, set_id, n, unshared and pos (place in rare-first order) of every prefix shingle.

    component is the set's own name and hub null until :func:`contested` knows them.
    """

    each = sets.select("set_id", "n", "unshared", F.posexplode("prefix").alias("at", "h"))
    return each.select(
        "h", "set_id", "n", "unshared", (F.col("unshared") + F.col("at")).alias("pos"),
        F.col("set_id").alias("component"), F.lit(None).cast("long").alias("hub"),
    )


def may_link(n, n2, pos, pos2, percent: int):
    """Length and positional filters for sets that share a shingle at these places."""
    least, most = F.least(n, n2), F.greatest(n, n2)
    room = F.least(n - pos, n2 - pos2)
    return (least * 100 >= most * percent) & (room * (100 + percent) >= (n + n2) * percent)


def neighbour_pairs(entries: DataFrame, percent: int, most: int = 2) -> DataFrame:
    """Pairs that follow each other under a shingle in order of size.

    Of its predecessors under all of its prefix shingles a set keeps the
    ``most`` that come up most often, so there are as many pairs as sets,
    however large a group is. What that leaves out is left to
    :func:`cross_pairs`, which is complete.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if batch.empty:
                continue
            if last is not None:
                batch = pd.concat([last, batch])
            last = batch.iloc[-1:]
            h, s, n, p = (batch[c].to_numpy() for c in ("h", "set_id", "n", "pos"))
            room = np.minimum(n[:-1] - p[:-1], n[1:] - p[1:])
            ok = (
                (h[1:] == h[:-1])
                & (s[1:] != s[:-1])
                & (n[:-1] * 100 >= n[1:] * percent)
                & (room * (100 + percent) >= (n[:-1] + n[1:]) * percent)
            )
            pairs = pd.DataFrame({"x": s[:-1][ok], "y": s[1:][ok]})
            yield pairs.groupby(["x", "y"], sort=False).size().rename("times").reset_index()

    keys = ("h", "n", "set_id")
    ranged = entries.select(*keys, "pos").repartitionByRange(*keys).sortWithinPartitions(*keys)
    met = ranged.mapInPandas(run, "x long, y long, times long")
    return most_met(met, most)


def most_met(met: DataFrame, most: int) -> DataFrame:
    """Of (x, y, times), the ``most`` x of every y that come up most often, as pairs (a, b)."""
    often = Window.partitionBy("y").orderBy(F.desc("times"), "x")
    best = met.groupBy("x", "y").agg(F.sum("times").alias("times")).withColumn("place", F.row_number().over(often))
    return best.where(F.col("place") <= most).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def hubs_of(own: DataFrame) -> DataFrame:
    """h and hub, the component with most sets, of shingles that several components share."""
    sizes = own.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k"))
    return (
        sizes.groupBy("h")
        .agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1")
        .select("h", F.col("top.component").alias("hub"))
    )


def contested(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``entries`` under shingles that several components hold, with the set's component and the shingle's hub.

    A set without a link is its own component. Components only grow, so the
    other shingles can name no further pair, and later rounds don't shuffle them.
    """
    named = groups.select(F.col("node").alias("set_id"), "component")
    held = entries.drop("component", "hub").join(named, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    return held.join(hubs_of(held), "h").select(entries.columns)


def star_pairs(own: DataFrame, percent: int, most: int = 3) -> DataFrame:
    """Pairs of a set and the hub's most typical members under its shingles.

    Copies of one text differ from it by shingles of their own, so the member
    with fewest unshared shingles is nearest to all others: a group whose
    members are too far from each other, though near to their origin, is
    joined by it. ``own`` comes from :func:`contested`.
    """
    typical = (
        own.where("component = hub")
        .groupBy("h")
        .agg(F.min(F.struct("unshared", "set_id", "n", "pos")).alias("t"))
        .select("h", F.col("t.set_id").alias("x"), F.col("t.n").alias("nx"), F.col("t.pos").alias("px"))
    )
    met = (
        own.where("component <> hub")
        .join(typical, "h")
        .where(may_link(F.col("n"), F.col("nx"), F.col("pos"), F.col("px"), percent))
        .groupBy("x", F.col("set_id").alias("y"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return most_met(met, most)


def cross_pairs(own: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a prefix shingle.

    Under a shingle, the component with most sets is the hub. Every pair of two
    components has a member outside the hub, so only those are held against
    all others: a large group of near copies, joined before, costs its size.
    ``own`` comes from :func:`contested`.
    """
    # sizes of linked sets differ by one band at most
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.001 * 100 / percent))).cast("int")
    mixed = own.drop("unshared").withColumn("band", band)
    outer = mixed.where("component <> hub").select(
        "h", F.col("set_id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("px"),
        F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
    )
    met = outer.join(mixed, ["h", "band"]).where(
        (F.col("cx") != F.col("component"))
        & ((F.col("component") == F.col("hub")) | (F.col("x") < F.col("set_id")))
        & may_link(F.col("nx"), F.col("n"), F.col("px"), F.col("pos"), percent)
    )
    return met.select(F.least("x", "set_id").alias("a"), F.greatest("x", "set_id").alias("b")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of a written table that link: suffix filter on signatures, then whole sets.

    Up to BROADCAST_PAIRS pairs of sets that are not too long, both are done in
    one step on the sets that they name. Else what the filter leaves is written,
    so whole sets are fetched only for that, and no task runs both Python parts
    at once.
    """

    def allowed(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> np.ndarray:
        if not len(sa):
            return np.zeros(0, bool)
        x = np.frombuffer(b"".join(sa), np.uint8).reshape(-1, SIGNATURE)
        y = np.frombuffer(b"".join(sb), np.uint8).reshape(-1, SIGNATURE)
        most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        full = ((x == 255) & (y == 255)).any(axis=1)  # counts end at 255
        return full | (most >= least_overlap(na.to_numpy(), nb.to_numpy(), percent))

    def linked(a: bytes, b: bytes, n: int, m: int) -> bool:
        both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]), kind="stable")
        return int((both[1:] == both[:-1]).sum()) >= least_overlap(n, m, percent)

    @F.pandas_udf("boolean")
    def suffixes_allow(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series(allowed(sa, sb, na, nb))

    @F.pandas_udf("boolean")
    def links(xa: pd.Series, xb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([linked(*row) for row in zip(xa, xb, na, nb)], dtype=bool)

    @F.pandas_udf("boolean")
    def allow_and_link(xa: pd.Series, xb: pd.Series, na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        rows = zip(allowed(sa, sb, na, nb), xa, xb, na, nb)
        return pd.Series([bool(ok) and linked(*row) for ok, *row in rows], dtype=bool)

    n_pairs = pairs.count()
    if n_pairs <= BROADCAST_PAIRS:  # a counted bound; spares the shuffle of all sets
        held = sets.agg(F.avg(F.col("n") - F.col("unshared")).alias("mean")).first()["mean"] or 0
        if n_pairs * held <= ONE_STEP_SHINGLES:
            named, whole = F.broadcast(pairs.select("a", "b")), sets.select("set_id", "shared", "n", "signature")
            both = named.join(whole.toDF("a", "xa", "na", "sa"), "a").join(
                named.join(whole.toDF("b", "xb", "nb", "sb"), "b"), ["a", "b"]
            )
            return both.where(allow_and_link("xa", "xb", "na", "nb", "sa", "sb")).select("a", "b")
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b"))
        sets = sets.join(F.broadcast(ids), "set_id", "left_semi")
    small = sets.select("set_id", "n", "signature")
    near = pairs.join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b")
    near = scratch.keep(near.where(suffixes_allow("sa", "sb", "na", "nb")).select("a", "b", "na", "nb"), f"near-{name}")
    whole = sets.select("set_id", "shared")
    both = near.join(whole.toDF("a", "xa"), "a").join(whole.toDF("b", "xb"), "b")
    return both.where(links("xa", "xb", "na", "nb")).select("a", "b")


def near_documents(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two documents link when their shingle sets have a Jaccard similarity of at
    least ``percent`` / 100; component_id is the smallest doc_id that links
    reach, ``kept`` says whether it is the row's own. Null and empty texts, and
    texts of white space, have no shingles, link with nothing and are kept.
    Repeated rows are copies of each other. A null doc_id links like any other
    but names a component only where no member has an id. Other columns aren't
    read. An empty table gives no rows.
    """
    out = linked_rows(docs, percent, words).select("doc_id", "n_shingles", "component_id")
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked_rows(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and head of every row.

    ``head`` says whether the row's doc_id and text are those that stand for its
    component: the smallest doc_id, a null one last, and of its texts one by
    hash. It is null for rows without shingles.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ngrams")
    own = scratch.keep(described(docs, words), "documents")
    facts = own.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    salts = 1 + (facts["n"] >> 18)
    sets = scratch.keep(shared_shingles(docs, facts["total"], percent, words, hot_shingles(own), salts), "sets")
    tidy(spark)  # the shuffles of all shingles are the largest by far
    entries = scratch.keep(prefix_entries(sets), "entries")
    tried = scratch.keep(neighbour_pairs(entries, percent), "pairs-0")
    links = scratch.keep(verify(tried, sets, percent, scratch, "0"), "links-0")
    groups = scratch.keep(components(links, scratch, "first"), "groups-0")
    entries, held = scratch.keep(contested(entries, groups), "entries-0"), "entries-0"
    scratch.drop("entries")
    for k in range(1, STAR_ROUNDS + 1):
        stars = scratch.keep(star_pairs(entries, percent).join(tried, ["a", "b"], "left_anti"), f"pairs-{k}")
        found = scratch.keep(verify(stars, sets, percent, scratch, str(k)), f"links-{k}")
        tried = tried.union(stars)
        if found.isEmpty():
            break
        groups = merged(groups, found, scratch, f"star-{k}")
        entries = scratch.keep(contested(entries, groups), f"entries-{k}")
        scratch.drop(held)
        held = f"entries-{k}"
    rest = scratch.keep(cross_pairs(entries, percent).join(tried, ["a", "b"], "left_anti"), "crossing")
    more = scratch.keep(verify(rest, sets, percent, scratch, "rest"), "more")
    if not more.isEmpty():
        groups = merged(groups, more, scratch, "all")
    for name in ("sets", held, "crossing", "more"):
        scratch.drop(name)
    named = groups.select(F.col("node").alias("set_id"), "component")
    filled = own.where("n_shingles > 0").drop("sample").join(named, "set_id", "left")
    filled = filled.select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component", "set_id").alias("component"),
        spread_of("doc_id", "text_hash").alias("spread"),
    )
    filled = scratch.keep(filled, "filled")
    heads = filled.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("least"),
        parts_seen(F.col("spread")).alias("seen"),
    )
    heads = heads.select("component", "least", each_part("seen").alias("spread"))
    out = filled.join(heads, ["component", "spread"]).select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("head"),
    )
    none = F.lit(None).cast("boolean")
    empty = own.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), none)
    return out.union(empty)


def keep_one(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """``docs`` without the documents that another of their group stands for.

    Of a group one row stays: that of its smallest doc_id, a null one last, and
    where that has several texts or rows, one of them. Rows without shingles all
    stay. Columns of any name pass through.
    """
    own, name, rows = unused_names(docs, "own_id", "text_hash", "rows")
    kept = linked_rows(docs, percent, words).where(F.coalesce("head", F.lit(True)))
    # how many rows of a kept doc_id and text are copies of each other; none of those without shingles
    kept = kept.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(name)).agg(F.count("head").alias(rows))
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept[own]) & (F.xxhash64(docs["text"]) == kept[name]))
    repeated = joined.where(F.col(rows) > 1).dropDuplicates(["doc_id", "text"])
    return joined.where(F.col(rows) <= 1).union(repeated).select(*docs.columns)


def op7_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """Components of documents at a shingle similarity of 0.75 or more."""
    return near_documents(docs).select("doc_id", "n_shingles", "component_id")


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
    ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY ALL) c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM w JOIN reach ON reach.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
