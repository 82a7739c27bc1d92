"""Token ids of whole texts, by public tokenizer files, with a bounded cache of word pieces."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

#: White space by Unicode's property, as the tokenizer's own splitter has it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Byte-level BPE never merges across these pieces: a word with one space before it, or white space.
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space of any kind but the blank.
_ODD_SPACE = re.compile(r"[^\S ]")
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_CACHED = 300_000


def _ranks(told: dict) -> dict[bytes, int] | None:
    """A tokenizer file's vocabulary as bytes and ranks, if it is byte-level BPE whose ids follow the order of its merges."""
    model = told["model"]
    if model.get("type") != "BPE" or told.get("normalizer") or told["pre_tokenizer"].get("type") != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space"):
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    at = [model["vocab"][m] for m in merged]
    if at != sorted(set(at)):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    special = {t["content"] for t in told["added_tokens"]}
    return {b: i for b, i in ranks.items() if len(b) == 1 or b.decode("utf-8", "replace") not in special}


class Ids(dict):
    """many(texts) -> little-endian uint32 ids of each whole text, equal to the tokenizer's; a dict of the pieces met so far."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.encode, self.opens = self._encode, None
        if ranks := _ranks(told):
            import tiktoken

            # the same merges, several times as fast on single words
            self.encode = tiktoken.Encoding("pieces", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            self.opens = np.zeros(max(ranks.values()) + 1, bool)  # ids of tokens that begin with a space
            self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    @functools.cached_property
    def tokenizer(self):
        """Read only where the merges alone don't do: its vocabulary is large."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        ids = self[piece] = array("I", self.encode(piece)).tobytes()
        return ids

    def one(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # a special token's string may join or part pieces
            return array("I", self._encode(text)).tobytes()
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words without ASCII white space, each encoded behind a space, and how many ids each has.

        Merges never cross the space before a word, and only a word's first token
        begins with one: so all are encoded as one text, and parted there.
        """
        odd = set()
        joined = "".join(f" {w}" for w in words)
        if self.opens is None:
            odd = set(range(len(words)))
        elif any(s in joined for s in self.special) or _ODD_SPACE.search(joined):
            odd = {i for i, w in enumerate(words) if any(s in w for s in self.special) or _ODD_SPACE.search(w)}
        if odd:
            joined = "".join(f" {w}" for i, w in enumerate(words) if i not in odd)
        plain = np.array(self.encode(joined) if joined else [], np.uint32)
        if not odd:
            return plain, np.diff(np.flatnonzero(self.opens[plain]), append=len(plain))
        starts = np.flatnonzero(self.opens[plain]) if len(plain) else np.zeros(0, np.int64)
        parts, at = iter(np.split(plain, starts[1:]) if len(plain) else ()), []
        for i, w in enumerate(words):
            at.append(np.frombuffer(self.one(" " + w), "<u4") if i in odd else next(parts))
        return np.concatenate(at) if at else plain, np.array(list(map(len, at)), np.int64)

    def many(self, texts: list[str]) -> list[bytes]:
        return list(map(self.one, texts))


@functools.cache
def ids_of(path: str) -> Ids:
    """One per Python worker and file."""
    return Ids(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
