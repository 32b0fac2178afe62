import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.llm import token_counts, vocab

PATH = vocab.public_path("piece_bpe_32k.model")
COUNTER = token_counts.Counter(PATH)
MODEL = vocab.piece_model(PATH)


def library(texts):
    return [len(x) for x in MODEL.encode([t or "" for t in texts], num_threads=1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab thenr▁  =-\n\té你😀<s>x0"), max_size=40), max_size=8))
def test_counts_equal_the_library(texts):
    assert COUNTER.count(texts) == library(texts)


def test_any_pieces_side_by_side():
    rng = random.Random(5)
    pieces = [MODEL.id_to_piece(i) for i in range(259, MODEL.get_piece_size())]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += ["".join(rng.choices(pieces, k=600)).replace("▁", "") for _ in range(5)]
    assert COUNTER.count(texts) == library(texts)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 1500, "=" * 1501, " " * 3001, " " * 100 + "x", "x" + "▁ " * 400 + "ing", "\x00" * 700, "na" * 300 + "é" * 600])
def test_long_words_and_runs(text):
    assert COUNTER.count([text, text[:15]]) == library([text, text[:15]])


def test_long_path_equals_short_path():
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choices(rng.choice(["ab", "thein", "=-#", "abcdefghijklmnopqrst"]), k=rng.randint(2, 300)))
        sym = COUNTER._symbols(word)
        short, head = token_counts.count_ragged(COUNTER.table, sym.copy(), token_counts.np.array([len(sym)]))
        assert (int(short[0]), int(head[0])) == token_counts.count_long(COUNTER.table, sym)


def test_text_longer_than_a_part_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(token_counts, "PART", 50)
    monkeypatch.setattr(vocab, "CACHE_ENTRIES", 20)
    texts = [" ".join(f"word{i}  x{i * i}\n" for i in range(k)) for k in (3, 200, 7)]
    assert token_counts.Counter(PATH).count(texts) == library(texts)


def test_rows_of_any_kind(spark, odd_docs, no_docs):
    out = token_counts.with_token_counts(odd_docs.withColumn("n", token_counts.F.lit(1))).collect()
    assert len(out) == 10 and "n" in out[0] and "kept" in out[0]
    for r, n in zip(out, library([r["text"] for r in out])):
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 4096)
    assert {r["doc_id"] for r in out if r["over_limit"]} == {6}
    assert token_counts.with_token_counts(no_docs).count() == 0
    assert token_counts.op13_token_counts(no_docs).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
