"""Quality rules: how well public vocabularies fit a text.

Each word is encoded on its own by two public vocabularies. Their characters
per token, the share of tokens that fall back to single bytes and the entropy
of the tokens are held against bands of the text's language or script.

The first vocabulary's pieces begin at spaces, so the words of a text are encoded
in one call, with one space before each. The second falls back to bytes only for
characters that it doesn't hold, so texts without any aren't encoded by it.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm import vocab
from footfall.llm.text import unused_names
from footfall.ship import ship

SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: White space of the first vocabulary inside words, where its pieces could cross from word to word.
BLANK = re.compile(r"[^\S \t\n\x0b\x0c\r\x1c-\x1f]")

#: Bands by language, else by script, else of "other": least and most characters
#: per token, most byte-fallback share, least token entropy relative to what the
#: text's length allows (log2 of its tokens, at most 7 bits).
BANDS: dict[str, tuple[float, float, float, float]] = {
    "en": (1.6, 9.0, 0.02, 0.7),
    "de": (1.5, 9.0, 0.03, 0.7),
    "fr": (1.4, 9.0, 0.03, 0.7),
    "es": (1.4, 9.0, 0.03, 0.7),
    "latin": (1.3, 12.0, 0.05, 0.6),
    "cyrillic": (0.4, 6.0, 0.2, 0.5),
    "greek": (0.4, 6.0, 0.3, 0.5),
    "han": (0.25, 4.0, 0.9, 0.4),
    "other": (0.2, 12.0, 1.0, 0.4),
}

#: Characters that are counted by script at a time.
SCRIPT_PART = 1 << 16
#: First and last code point of the blocks that name a script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("han", 0x3040, 0x9FFF),
]

METRICS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("chars_per_token", T.DoubleType()),
        T.StructField("byte_share", T.DoubleType()),
        T.StructField("token_entropy", T.DoubleType()),
        T.StructField("band", T.StringType()),
    ]
)


def known_characters(pieces: sentencepiece.SentencePieceProcessor) -> set[str]:
    """Characters that never fall back to bytes: none for models that change texts first or don't merge characters."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # without protobuf all texts are encoded
        return set()
    model = sentencepiece_model_pb2.ModelProto.FromString(pieces.serialized_model_proto())
    if model.normalizer_spec.precompiled_charsmap or model.trainer_spec.model_type != model.trainer_spec.BPE:
        return set()
    return {p.piece for p in model.pieces if len(p.piece) == 1 and p.type == p.NORMAL}


class WordCosts:
    """Tokens of a text's words; pieces of words met are remembered and forgotten when they are many."""

    def __init__(self, ranks_path: str, pieces_path: str):
        self.bpe = vocab.ranked_bpe(ranks_path)
        self.cut_bpe = vocab.ranked_bpe(ranks_path, vocab.CUT_PIECES)
        self.pieces = vocab.piece_model(pieces_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known = known_characters(self.pieces)
        self.known_ascii = "".join(c for c in self.known if c.isascii()).encode()
        self.clear()

    def clear(self) -> None:
        #: Per word: its pieces, and from bit 32 on those that are bytes.
        self.index: dict[bytes, int] = {}

    def tokens(self, words: list[bytes], joined: str) -> np.ndarray:
        """Tokens of all words, each with a space before it, as ``joined`` holds them."""
        if joined.isascii() or not BLANK.search(joined):
            return self.cut_bpe.encode_to_numpy(joined, disallowed_special=())
        texts = [" " + w.decode() for w in words]
        plain = "".join(t for t in texts if not BLANK.search(t))
        odd = [self.bpe.encode_ordinary(t) for t in texts if BLANK.search(t)]
        odd = np.fromiter(chain.from_iterable(odd), np.uint32)
        return np.concatenate([self.cut_bpe.encode_to_numpy(plain, disallowed_special=()), odd])

    def byte_share(self, words: list[bytes], times: np.ndarray, rest: bytes) -> float:
        """Share of bytes in the pieces of distinct words by how many ``times`` they occur; ``rest`` holds all unknown characters."""
        if self.known.issuperset(rest.decode()):
            return 0.0
        found = list(map(self.index.get, words))
        if None in found:
            new = [w for w, f in zip(words, found) if f is None]
            pieces = self.pieces.encode([w.decode() for w in new], num_threads=1)
            sizes = np.fromiter(map(len, pieces), np.int64, len(new))
            bytes_up_to = np.r_[0, np.cumsum(self.is_byte[list(chain.from_iterable(pieces))])]
            ends = np.cumsum(sizes)
            n_bytes = bytes_up_to[ends] - bytes_up_to[ends - sizes]
            self.index.update(zip(new, (n_bytes << 32 | sizes).tolist()))
            found = map(self.index.__getitem__, words)
        both = np.fromiter(found, np.int64, len(words))
        n_pieces, n_bytes = both & 0xFFFFFFFF, both >> 32
        return float((n_bytes * times).sum() / max(1, (n_pieces * times).sum()))


@functools.lru_cache(maxsize=2)
def _costs(ranks_path: str, pieces_path: str) -> WordCosts:
    return WordCosts(ranks_path, pieces_path)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    u = int(ids.max()) + 1
    if u >= 1 << 21:
        distinct, ids = np.unique(ids, return_inverse=True)
        u = len(distinct)
    pairs = ids[:-1] * u + ids[1:]
    if u >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * u + ids[2:]
    ranked = np.sort(keys)
    if (ranked[1:] != ranked[:-1]).all():
        return 0
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def script_of(text: str) -> str:
    """The script of most letters of the whole text."""
    seen = dict.fromkeys((s for s, _, _ in SCRIPTS), 0)
    for at in range(0, len(text), SCRIPT_PART):
        codes, times = np.unique(np.frombuffer(text[at : at + SCRIPT_PART].encode("utf-32-le"), np.uint32), return_counts=True)
        for k, n in zip(codes.tolist(), times.tolist()):
            for s, lo, hi in SCRIPTS:
                if lo <= k <= hi and chr(k).isalpha():
                    seen[s] += n
    best = max(seen, key=seen.get)
    return best if seen[best] else "other"


def entropy(tokens: np.ndarray) -> float:
    """Bits per token of a list of token ids."""
    tokens = np.sort(tokens)
    edge = np.ones(len(tokens) + 1, bool)
    np.not_equal(tokens[1:], tokens[:-1], out=edge[1:-1])
    mass = np.diff(np.flatnonzero(edge)).astype(float)
    return float(math.log2(len(tokens)) - (mass * np.log2(mass)).sum() / len(tokens))


def measure(text: str | None, lang: str | None, costs: WordCosts, bands: Mapping) -> tuple:
    """The METRICS of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            n_dup += line in seen
            seen.add(line)
    if not n:
        return (0, 0, n_symbols, n_dup, 0, True, False, 0.0, 0.0, 0.0, None)
    spaced = b" " + b" ".join(words)
    joined = spaced.decode()
    word_chars = len(joined) - n
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    n_repeat = repeated_words(ids)
    failed = n < 50 or 100 * n_repeat > 50 * n
    tokens = costs.tokens(words, joined)
    n_tokens = len(tokens)
    cpt = word_chars / n_tokens
    rest = spaced.translate(None, b" " + costs.known_ascii)
    share = costs.byte_share(list(first), np.unique(ids, return_counts=True)[1], rest) if rest else 0.0
    bits = entropy(tokens)
    band = lang if lang in bands else script_of(text)
    lo, hi, most_bytes, least = bands.get(band) or bands["other"]
    room = min(7.0, math.log2(max(2.0, n_tokens)))
    kept = not failed and lo <= cpt <= hi and share <= most_bytes and bits >= least * room
    return (n, word_chars, n_symbols, n_dup, n_repeat, failed, bool(kept), cpt, share, bits, band)


def fertility(ranks_path: str | None = None, pieces_path: str | None = None, bands: Mapping = BANDS):
    """Column function (text, lang) -> METRICS struct."""
    ranks_path = ranks_path or vocab.public_path("byte_bpe_50k.tiktoken")
    pieces_path = pieces_path or vocab.public_path("piece_bpe_32k.model")
    bands = dict(bands)

    @F.pandas_udf(METRICS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        costs = _costs(ranks_path, pieces_path)
        try:
            for texts, langs in batches:
                rows = []
                for text, lang in zip(texts, langs):
                    if len(costs.index) > vocab.CACHE_ENTRIES:
                        costs.clear()
                    rows.append(measure(text, lang, costs, bands))
                yield pd.DataFrame(rows, columns=METRICS.names)
        finally:
            costs.clear()  # an idle worker holds no words

    return run


def with_fertility(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the METRICS of its text in added columns.

    Words are runs of characters other than ASCII white space. ``base_failed``
    holds for fewer than 50 words or more than half of all words in repeated
    3-word windows; ``kept`` is false then, and else says whether all measures
    lie within the bands of the language in ``lang``, of the script where that
    is null or has none. Null or empty text has no words, so it fails. Rows are
    judged one by one: repeated rows and null ids don't matter. Columns of
    ``docs`` named as a measure are replaced.
    """
    ship(docs.sparkSession)
    extra = [c for c in docs.columns if c not in METRICS.names]
    (measures,) = unused_names(docs, "measures")
    judged = docs.select(*extra, fertility(**options)("text", "lang").alias(measures))
    return judged.select(*extra, f"{measures}.*")


def reject_unfit(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they had."""
    ship(docs.sparkSession)
    (measures,) = unused_names(docs, "measures")
    judged = docs.withColumn(measures, fertility(**options)("text", "lang"))
    return judged.where(f"{measures}.kept").select(*docs.columns)


def op2_tokenizer_fertility(docs: DataFrame) -> DataFrame:
    """doc_id and the METRICS of every document."""
    return with_fertility(docs.select("doc_id", "text", "lang")).drop("text", "lang")
