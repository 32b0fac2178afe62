import functools
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from footfall.llm import packing, vocab


@functools.cache
def plain_tokenizer():
    return Tokenizer.from_file(vocab.public_path("byte_bpe_50k.json"))


def reference_ids(text):
    return np.array([*plain_tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check_pieces(pieces, texts, window):
    """Every id in one piece, sequences gapless, and all but powers of two full."""
    have, want, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for doc, text in texts:
        want[doc].append(reference_ids(text))
    for p in pieces:
        have[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(have) == set(want)
    for doc, ids in want.items():
        crcs = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in have[doc])
        if len(ids) == 1:
            at = 0
            for start, length, crc, total in crcs:
                assert start == at and total == len(ids[0])
                assert crc == zlib.crc32(ids[0][start : start + length].tobytes())
                at += length
            assert at == len(ids[0])
        else:
            assert sum(c[1] for c in crcs) == sum(map(len, ids))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0


def test_all_documents_are_packed(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for window, shard in ((1024, 1 << 20), (16, 64)):
        out = packing.pack(odd_docs, window=window, shard_tokens=shard).collect()
        check_pieces([r.asDict() for r in out], rows, window)


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_both_vocabulary_files_agree(sf_dir, spark):
    bpe = vocab.byte_bpe(vocab.public_path("byte_bpe_50k.json"), vocab.public_path("byte_bpe_50k.tiktoken"))
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for t in [*texts, "a  b\n\n c\t", "<|endoftext|>", "it's 12 o'clock", "naïve Ünïcode", "日本語 text", ""]:
        assert np.frombuffer(bpe.encode(t or ""), np.uint16).tolist() == reference_ids(t)[:-1].tolist()
    assert reference_ids("a<|endoftext|>b").tolist() == [64, 50256, 65, 0]
    rng = random.Random(3)
    parts = [*"ab1'.,-é \x85\x1c　你", " ", "  ", "\n", "\t", "\n ", "don't", "<|endoftext|>", " the", " 's"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert np.frombuffer(bpe.encode(t), np.uint16).tolist() == reference_ids(t)[:-1].tolist(), t


def test_neighbours_fill_the_window_of_their_seed():
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 50_000, 30) for _ in range(20)]
    docs = [np.append(t[rng.permutation(30)[:3]].repeat(1), np.r_[t, 0]).astype(np.uint16) for t in topics for _ in range(4)]
    order = rng.permutation(len(docs))
    docs = [docs[i] for i in order]
    counts = np.zeros(packing.TERMS, np.int64)
    for d in docs:
        counts[np.unique(packing.term_ids(d))] += 1
    index = packing.ShardIndex(docs, counts, len(docs), float(np.mean([len(d) for d in docs])))
    unused = np.ones(len(docs), bool)
    unused[0] = False
    best = index.neighbours(0, unused)
    assert {order[i] // 4 for i in best[:3]} == {order[0] // 4}


def test_bm25_scores_against_brute_force():
    docs = [np.array(d, np.uint16) for d in ([1, 2, 3, 4, 0], [1, 2, 9, 0], [7, 8, 0], [1, 2, 3, 0])]
    counts = np.zeros(packing.TERMS, np.int64)
    for d in docs:
        counts[np.unique(packing.term_ids(d))] += 1
    index = packing.ShardIndex(docs, counts, 4, 4.0)
    score = {}
    for j in (1, 2, 3):
        s = 0.0
        for t in set(packing.term_ids(docs[0]).tolist()):
            tf = (packing.term_ids(docs[j]) == t).sum()
            if tf and counts[t] > 1:
                idf = np.log1p((4 - counts[t] + 0.5) / (counts[t] + 0.5))
                norm = packing.K1 * (1 - packing.B + packing.B * len(docs[j]) / 4.0)
                s += idf * tf * (packing.K1 + 1) / (tf + norm)
        score[j] = s
    want = [j for j in sorted(score, key=lambda j: (-score[j], j)) if score[j] > 0]
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == want


def test_copies_in_a_third_of_all_documents_are_neighbours():
    rng = np.random.default_rng(6)
    base = rng.integers(1, 50_000, 20)
    docs = [np.append(base if k % 3 == 0 else rng.integers(1, 50_000, 20), 0).astype(np.uint16) for k in range(60)]
    counts = np.zeros(packing.TERMS, np.int64)
    for d in docs:
        counts[np.unique(packing.term_ids(d))] += 1
    index = packing.ShardIndex(docs, counts, len(docs), 21.0)
    unused = np.arange(60) > 0
    assert index.neighbours(0, unused)[:19].tolist() == list(range(3, 60, 3))


def full_bm25(docs, seed, counts, n_docs, mean_length):
    """Scores of all documents for every term of ``seed``."""
    pairs = [list(zip(d[:-1].tolist(), d[1:].tolist())) for d in docs]
    slot = dict(zip(pairs[seed], packing.term_ids(docs[seed]).tolist()))
    score = np.zeros(len(docs))
    for pair, k in slot.items():
        idf = np.log1p((n_docs - counts[k] + 0.5) / (counts[k] + 0.5))
        for j, own in enumerate(pairs):
            tf = own.count(pair)
            norm = packing.K1 * (1 - packing.B + packing.B * len(docs[j]) / mean_length)
            score[j] += idf * tf * (packing.K1 + 1) / (tf + norm) if counts[k] > 1 else 0
    return score


def check_neighbours(docs, seeds):
    counts = np.zeros(packing.TERMS, np.int64)
    for d in docs:
        counts[np.unique(packing.term_ids(d))] += 1
    mean = float(np.mean([len(d) for d in docs]))
    index = packing.ShardIndex(docs, counts, len(docs), mean)
    for seed in seeds:
        unused = np.ones(len(docs), bool)
        unused[seed] = False
        score = full_bm25(docs, seed, counts, len(docs), mean)
        got = index.neighbours(seed, unused)
        assert set(got.tolist()) == set(np.flatnonzero((score > 0) & unused).tolist())
        assert (np.diff(score[got]) <= 1e-9).all()


def test_long_seeds_score_all_their_terms():
    rng = np.random.default_rng(2)
    words = (60 * rng.random((40, 400)) ** 3).astype(np.uint16) + 1
    check_neighbours([np.append(w, 0).astype(np.uint16) for w in words], (0, 7, 39))


def test_members_of_a_large_group_of_copies_are_neighbours():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 50_000, 60)
    docs = []
    for k in range(60):
        d = base.copy() if k % 3 == 0 else rng.integers(1, 50_000, 60)
        if k % 6 == 0:
            d[k // 6] = k
        docs.append(np.append(d, 0).astype(np.uint16))
    check_neighbours(docs, (0, 3, 6, 1))


def test_terms_widen_with_the_corpus():
    assert packing.term_bits(1000) == 18 < packing.term_bits(1 << 20) < packing.term_bits(1 << 40)


def test_ascii_texts_are_not_searched_for_wide_characters():
    bpe = vocab.ByteBPE(vocab.public_path("byte_bpe_50k.json"), vocab.public_path("byte_bpe_50k.tiktoken"))
    assert [bpe.needs_json(t) for t in ("", "plain", "Grüße ɏ", "ɐ", "a 你", "é <|endoftext|>", "<|endoftext|>")] == [False] * 3 + [True] * 4
    bpe.is_wide = None
    assert not bpe.needs_json("plain words only") and bpe.encode("plain words")


def test_document_counts_reach_the_driver_in_32_bits(spark):
    docs = [np.array(d, np.uint16) for d in ([1, 2, 3, 1, 2, 0], [1, 2, 9, 0], [7, 8, 0], [0])]
    want = np.zeros(packing.TERMS, np.int64)
    for d in docs:
        want[np.unique(packing.term_ids(d))] += 1
    tokens = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "ids binary")
    got = packing.term_document_counts(tokens)
    assert got.dtype == np.float32 and (got == want).all()


def test_white_space_runs_need_no_lookahead():
    """Texts are cut in runs of white space, so the pattern is one that plain automata find."""
    bpe = vocab.byte_bpe(vocab.public_path("byte_bpe_50k.json"), vocab.public_path("byte_bpe_50k.tiktoken"))
    assert not any(x in bpe.ranks._pat_str for x in ("(?!", "++"))
    rng = random.Random(4)
    parts = [*" \n\t\r\x0b\x0c\x85\xa0\x1c\x1f", "  ", "\n\n", "a", "1", ".", "'s", "é", "the end"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(bpe.encode(t), np.uint16).tolist() == reference_ids(t)[:-1].tolist(), repr(t)


def test_neighbours_one_by_one_are_those_sorted():
    rng = np.random.default_rng(8)
    docs = [np.append((40 * rng.random(60) ** 2).astype(np.uint16) + 1, 0).astype(np.uint16) for _ in range(50)]
    docs[30:40] = docs[:10]
    counts = np.zeros(packing.TERMS, np.int64)
    for d in docs:
        counts[np.unique(packing.term_ids(d))] += 1
    for most in (packing.MOST_DENSE, 10):  # with and without full rows
        packing.MOST_DENSE, kept = most, packing.MOST_DENSE
        index = packing.ShardIndex(docs, counts, 50, 61.0)
        packing.MOST_DENSE = kept
        for seed in (0, 5, 35, 49):
            unused = rng.random(50) < 0.8
            unused[seed] = False
            assert list(index.each_neighbour(seed, unused)) == index.neighbours(seed, unused).tolist()
            score = full_bm25(docs, seed, counts, 50, 61.0)
            assert np.allclose(index.scores(seed, unused), np.where(unused, score, 0), rtol=1e-5)


def test_routes_are_found_once_and_large_groups_are_dealt(spark):
    docs = spark.createDataFrame([(k, "the same text in many documents" if k < 90 else f"word {k} of {k * k}") for k in range(100)], "doc_id long, text string")
    plan = packing.pack(docs)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()
    paths = [vocab.public_path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")]
    tokens = packing.tokenized(docs, *paths, 0)
    counts = spark.sparkContext.broadcast(packing.term_document_counts(tokens))
    routed = packing.with_route(tokens, counts, 10, 4).collect()
    assert len({r["route"] for r in routed if r["doc_id"] < 90}) == 1
    parts = [r["part"] for r in routed if r["doc_id"] < 90]
    assert max(map(parts.count, parts)) < 30 and max(parts) < 10
