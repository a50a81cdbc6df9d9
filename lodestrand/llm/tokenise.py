"""Exact tokenisation at speed: the tokenizers library's model behind a cache of words.

A byte-pair model encodes each pre-token alone, so the ids of a text are the ids of its pre-tokens,
end to end. Words repeat; the library is asked once for each, and a bounded cache answers the rest.
Texts or vocabularies that this cannot cut safely go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Entries of each cache before it is emptied; about 150 MB a worker.
CACHE_ENTRIES = 800_000

_ODD_BLANK = re.compile(r"[^\S \n\t\r]")
_BLANK_BEFORE_SPACE = re.compile(r"[ \n\t\r] ")
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: How the byte-level pre-tokenizer cuts a text (fixed value of the public vocabulary's format).
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself, or the next free one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as encode(add_special_tokens=False) does.

    A special token that is spelled out in a text gets its own id, as the library has it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind, self.pattern = self._family(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    @staticmethod
    def _family(spec: dict) -> tuple[str, object]:
        pre = spec.get("pre_tokenizer") or {}
        # Only tokens that are found in the text as it stands can be looked for in it.
        if any(t.get("normalized") or not t.get("special") for t in spec.get("added_tokens", [])):
            return "whole", None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "bytes", _BYTE_LEVEL
        parts = pre.get("pretokenizers") or []
        kinds = [p.get("type") for p in parts]
        if kinds == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and not parts[1].get("use_regex", True):
            steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
            if steps == ["NFC", "Replace", "Lowercase"]:
                return "words", regex.compile(parts[0]["pattern"]["Regex"])
        return "whole", None

    def _ids(self, token: str) -> bytes:
        """The library's ids of one pre-token."""
        if token.isascii() and token.isprintable():
            spelled = token.replace(" ", "\u0120")
        else:
            spelled = token.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, token: str) -> bytes:
        got = self.words.get(token)
        if got is None:
            if len(self.words) >= CACHE_ENTRIES // 4:
                self.words.clear()
            got = self.words[token] = self._ids(token)
        return got

    def _normal(self, piece: str) -> str:
        if self.kind != "words":
            return piece
        if piece.isascii() or ("\u03a3" not in piece and unicodedata.is_normalized("NFC", piece)):
            return piece.lower()
        return self.library.normalizer.normalize_str(piece)  # a final sigma is not special there

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._word, self.pattern.findall(self._normal(piece))))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or _ODD_BLANK.search(text) or any(t in text for t in self.special):
            return self._whole(text)
        if self.kind == "words":
            # White space only separates here, so every blank is a safe place to cut.
            chunks = text.replace("\n", " ").split(" ")
            return self._joined(chunks, self.spaced, "")
        if _BLANK_BEFORE_SPACE.search(text):
            return b"".join(map(self._piece, _PIECE.findall(text)))
        # A space after a non-blank always starts a pre-token, so the text can be cut before it.
        chunks = text.split(" ")
        head = self._joined(chunks[:1], self.first, "")
        return head + self._joined(chunks[1:], self.spaced, " ")

    def _chunk(self, chunk: str, cache: dict[str, bytes], lead: str) -> bytes:
        """Ids of a run without inner spaces; a word, or one before a mark, needs no pattern."""
        normal = self._normal(chunk)
        if normal.isalpha():
            return self._ids(lead + normal)
        body, mark = chunk[:-1], chunk[-1:]
        if mark and mark in ".,;:!?" and self._normal(body).isalpha():
            return self._cached(body, cache, lead) + self._word(mark)
        body, line, rest = chunk.partition("\n")
        if body and rest.isalpha():
            return self._cached(body, cache, lead) + self._word(line) + self._cached(rest, self.first, "")
        return self._piece(lead + chunk)

    def _cached(self, chunk: str, cache: dict[str, bytes], lead: str) -> bytes:
        got = cache.get(chunk)
        if got is None:
            got = cache[chunk] = self._chunk(chunk, cache, lead)
        return got

    def _joined(self, chunks: list[str], cache: dict[str, bytes], lead: str) -> bytes:
        missing = set(chunks).difference(cache)
        if missing:
            if len(cache) + 2 * len(missing) >= CACHE_ENTRIES:
                cache.clear()
                missing = set(chunks)
            for chunk in missing:
                cache[chunk] = self._chunk(chunk, cache, lead)
        return b"".join(map(cache.__getitem__, chunks))


_encoders: dict[str, WordCachedEncoder] = {}


def encoder(path: str) -> WordCachedEncoder:
    """The worker's encoder for a vocabulary file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordCachedEncoder(path)
    return _encoders[path]
