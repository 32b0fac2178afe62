import math
import random
import re
from collections import Counter

import pytest

from footfall.llm import fertility, vocab


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed)


def test_base_measures_and_odd_rows(spark, odd_docs):
    extra = [(20, "a b c a b c d\nx\nx\n \n \nx # $%", "en", "a", 1), (21, "z " * 60, "en", "a", 1)]
    df = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "kept").union(
        spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1")
    )
    out = fertility.with_fertility(df).collect()
    assert len(out) == 12
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])
        assert not (r["base_failed"] and r["kept"])


def test_repeated_words_with_many_distinct():
    import numpy as np

    rng = np.random.default_rng(0)
    for high in (3, 1 << 22):
        ids = rng.integers(0, high, 400)
        ids[350:380] = ids[10:40]
        assert fertility.repeated_words(ids) == brute(" ".join(map(str, ids)))[4]


def test_metrics_against_whole_words():
    costs = fertility.WordCosts(vocab.public_path("byte_bpe_50k.tiktoken"), vocab.public_path("piece_bpe_32k.model"))
    text = "the cat sat on the mat ☃ " * 3
    m = dict(zip(fertility.METRICS.names, fertility.measure(text, "en", costs, fertility.BANDS)))
    tokens = [t for w in text.split() for t in costs.bpe.encode_ordinary(" " + w)]
    pieces = [p for w in text.split() for p in costs.pieces.encode(w)]
    assert m["chars_per_token"] == pytest.approx(m["word_chars"] / len(tokens))
    assert m["byte_share"] == pytest.approx(sum(costs.pieces.is_byte(p) for p in pieces) / len(pieces))
    c = Counter(tokens)
    assert m["token_entropy"] == pytest.approx(-sum(k / len(tokens) * math.log2(k / len(tokens)) for k in c.values()))


def test_bands_reject_what_the_vocabulary_does_not_fit(spark):
    clean = (
        "People who live near the old harbour often walk along its quiet shore in spring, when boats return with their "
        "first catch and small shops open their doors again. Children gather shells while parents talk about weather, "
        "work and prices. Later everyone meets for coffee in a narrow street behind the church, where music can be heard."
    )
    noise = " ".join(f"{chr(0x1200 + i)}{chr(0x1300 + i)}{chr(0x1400 + i)}" for i in range(80))
    df = spark.createDataFrame([(1, clean, "en"), (2, noise, "en")], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in fertility.with_fertility(df).collect()}
    assert kept == {1: True, 2: False}
    assert fertility.reject_unfit(df).columns == df.columns


def test_scripts_and_empty_table(no_docs):
    assert [fertility.script_of(t) for t in ("hello", "привет", "你好世界", "αβγδ", "123")] == ["latin", "cyrillic", "han", "greek", "other"]
    assert fertility.with_fertility(no_docs).count() == 0
    assert fertility.reject_unfit(no_docs).columns == no_docs.columns


def test_script_is_counted_over_the_whole_text():
    assert fertility.script_of("ab " * 4000) == fertility.script_of("ab") != "other"
    assert fertility.script_of(" abcdefghi" * 400) == fertility.script_of("ab")
    assert fertility.script_of("1 2 " * 400) == "other"


def test_texts_encoded_at_once_have_the_tokens_of_their_words():
    costs = fertility.WordCosts(vocab.public_path("byte_bpe_50k.tiktoken"), vocab.public_path("piece_bpe_32k.model"))
    rng = random.Random(7)
    parts = [*" \n\t\x0b\x85\xa0\u3000\u2028\x1c\x1fé☃Ĉ▁", "  ", "word", "the ", "'s", "don't", "12", "#", "你好", "<s>", "<|endoftext|>", "e\u0301"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 30)))
        words = re.findall("[^\x20\x09-\x0d]+", text)
        if not words:
            continue
        m = dict(zip(fertility.METRICS.names, fertility.measure(text, "en", costs, fertility.BANDS)))
        c = Counter(t for w in words for t in costs.bpe.encode_ordinary(" " + w))
        pieces = [p for w in words for p in costs.pieces.encode(w)]
        assert m["word_chars"] == sum(map(len, words))
        assert m["chars_per_token"] == pytest.approx(m["word_chars"] / c.total()), repr(text)
        assert m["token_entropy"] == pytest.approx(-sum(k / c.total() * math.log2(k / c.total()) for k in c.values()), abs=1e-9), repr(text)
        assert m["byte_share"] == pytest.approx(sum(costs.pieces.is_byte(p) for p in pieces) / len(pieces)), repr(text)
    assert not costs.pieces.is_byte(costs.pieces.encode("é")[-1]) and costs.pieces.is_byte(costs.pieces.encode("Ĉ")[-1])


def test_texts_of_known_characters_are_not_encoded_in_pieces():
    costs = fertility.WordCosts(vocab.public_path("byte_bpe_50k.tiktoken"), vocab.public_path("piece_bpe_32k.model"))
    costs.pieces = None
    m = dict(zip(fertility.METRICS.names, fertility.measure("Grüße aus Köln, привет " * 9, "de", costs, fertility.BANDS)))
    assert m["byte_share"] == 0 and not costs.index
