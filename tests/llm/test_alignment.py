import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.llm import alignment, vocab

JSON = alignment.Tokenizer.from_file(vocab.public_path("byte_bpe_50k.json"))
JSON.encode_special_tokens = True
PIECES = vocab.piece_model(vocab.public_path("piece_bpe_32k.model"))


def byte_table():
    """Byte-level decoding: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


BYTES = byte_table()


def brute_groups(text):
    """Groups, and links as pairs of ids, of one whole text."""
    if not text:
        return [], []
    a, b = JSON.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    a_raw = [bytes(BYTES[c] for c in JSON.id_to_token(i)) for i in a]
    b_raw = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p := PIECES.id_to_piece(i)) else p.replace("▁", " ").encode() for i in b]
    if not b"".join(a_raw) == (" " + text).encode() == b"".join(b_raw):
        return [], []

    def ranges(raw):
        at, out = 0, []
        for r in raw:
            out.append((at, at + len(r)))
            at += len(r)
        return out

    ra, rb = ranges(a_raw), ranges(b_raw)
    ends = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, at = [], 0
    for e in ends:
        groups.append(([i for i, r in zip(a, ra) if at < r[1] <= e], [i for i, r in zip(b, rb) if at < r[1] <= e]))
        at = e
    links = [(i, j) for i, x in zip(a, ra) for j, y in zip(b, rb) if x[0] < y[1] and y[0] < x[1]]
    return groups, links


def brute(rows):
    found = [(i, *brute_groups(t)) for i, t in rows]
    times = Counter(p for _, _, links in found for p in links)
    most = {}
    for (_, b), n in times.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append(
            (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(times[p] == most[p[1]] for p in links),
             sum(times[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")
        )
    return sorted(out, key=str), times


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab thenr's  \n\t\x1c\x85é你😀<|endoftext|>09-▁ 　"), max_size=30))
def test_groups_of_stretches_are_those_of_the_text(text):
    assert alignment.align(text) == brute_groups(text)[0]


@pytest.mark.parametrize("text", ["", " ", "   x", "x   ", "it's  1234 <|endoftext|></s> ok", "a▁b c", "na" * 300 + " é" * 40, "\n\n a\n", "x\x00y z"])
def test_odd_texts(text):
    assert alignment.align(text) == brute_groups(text)[0]


def test_rows_counts_and_blocks(spark, odd_docs, no_docs, monkeypatch):
    extra = [(i, f"the {w} is {w}ing <s> {'x▁y' if i % 5 == 0 else ''}\n{w * 3}") for i, w in enumerate(["alpha", "Größe", "你好", "zzz", "qu"] * 4, 100)]
    short = [(r["doc_id"], r["text"] if r["doc_id"] != 6 else r["text"][:300]) for r in odd_docs.select("doc_id", "text").collect()]
    rows = short + extra
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block long").repartition(3)
    out, counts = alignment.token_links(df)
    want, times = brute(rows)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([tuple(r) for r in out.select(cols).collect()], key=str) == want
    assert {(r["a_id"], r["b_id"]): r["total"] for r in counts.collect()} == dict(times)
    assert alignment.op12_token_alignment(odd_docs).count() == 10
    assert alignment.op12_token_alignment(no_docs).columns == cols and alignment.op12_token_alignment(no_docs).count() == 0


def test_blocks_of_any_size_and_forgotten_stretches(monkeypatch):
    paths = tuple(vocab.public_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    batch = alignment.pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"word{i} other{i % 7} the end" for i in range(40)]})
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(alignment, "MANY", 9)
    monkeypatch.setattr(alignment, "PART", 12)
    monkeypatch.setattr(vocab, "CACHE_ENTRIES", 10)
    rows = [r for b in alignment._blocks(iter([batch]), paths) for r in b.to_pylist()]
    assert len([r for r in rows if r["pairs"] is not None]) > 5
    assert sum(n for r in rows for n in r["counts"] or ()) == sum(r["n_links"] or 0 for r in rows)
    docs = [r for r in rows if r["pairs"] is None]
    assert [r["doc_id"] for r in docs] == list(range(40))
    want, _ = brute(list(zip(*batch.to_pydict().values())))
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    assert sorted([tuple(r[c] for c in cols) for r in docs], key=str) == sorted([(*w[:5], w[7]) for w in want], key=str)
