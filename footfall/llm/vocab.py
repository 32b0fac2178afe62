"""Public tokenizers, loaded once per Python worker from files given by path."""

from __future__ import annotations

import base64
import functools
import json
import re
from array import array

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

#: Words remembered before a cache starts anew: some 20 MB.
CACHE_ENTRIES = 100_000
#: PATTERN of public_tokenizers with possessive repeats: the same pieces, found faster.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Without lookahead, which plain automata can't do: the same pieces in texts that
#: are cut before the last of several white spaces in front of a word.
CUT_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: White space as the vocabulary sees it: without the separators that Python counts too.
_BLANK = r"[^\S\x1c-\x1f]"
SPACES = re.compile(rf"{_BLANK}{_BLANK}")
CUTS = re.compile(rf"{_BLANK}+(?={_BLANK}(?:\S|[\x1c-\x1f]))")


def public_path(name: str) -> str:
    """Path of a vocabulary file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def ranked_bpe(path: str, pieces: str = PIECES) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # encode_to_numpy() looks for special tokens, at every place if there is none; it is never allowed
    special = {"<|endoftext|>": max(ranks.values()) + 1} if pieces == CUT_PIECES else {}
    return tiktoken.Encoding("public", pat_str=pieces, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def piece_model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def json_bpe(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class ByteBPE:
    """Ids of ``byte_bpe_50k`` by whichever of its two files is sure and faster.

    The ranks file gives the same ids several times as fast. Texts with
    characters from U+0250 on still go to the JSON tokenizer, as its character
    classes decide there, and so do texts that hold a special token's string,
    which it makes one id.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.json_path = json_path
        self.ranks = ranked_bpe(ranks_path, CUT_PIECES)
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.is_wide = re.compile("[^\x00-\u024f]").search

    def needs_json(self, text: str) -> bool:
        return any(s in text for s in self.special) or not text.isascii() and self.is_wide(text) is not None

    def encode(self, text: str) -> bytes:
        """Ids of a text, 16 bits each in the machine's order."""
        if self.needs_json(text):
            return array("H", json_bpe(self.json_path).encode(text, add_special_tokens=False).ids).tobytes()
        if not SPACES.search(text):
            return self._plain(text)
        cuts = [0, *(m.end() for m in CUTS.finditer(text)), len(text)]
        return b"".join(self._plain(text[a:b]) for a, b in zip(cuts, cuts[1:]))

    def _plain(self, text: str) -> bytes:
        # an array spares a Python number for each id
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.uint16).tobytes()


@functools.lru_cache(maxsize=2)
def byte_bpe(json_path: str, ranks_path: str) -> ByteBPE:
    return ByteBPE(json_path, ranks_path)
