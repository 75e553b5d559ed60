"""Token ids by the tokenizers library, with a memory of units that recur.

The tokenizers cut text into units (words, numbers, marks) before any merge, so a text's ids are those of its units. Plain
texts are cut here, many at once, and each distinct unit meets the library's model once. Texts in which the library's
rules say more than that (white space in a row, apostrophes, letters beyond Latin, special tokens of the vocabulary) are
cut at plain spaces only, or not at all, and go through the whole library.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

from .runs import distinct, hashes

#: Where a space touches other white space, the pre-tokenizer decides by the whole run; such texts are not cut.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_OTHER_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: White space to Python, but not to the tokenizers.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Texts of Latin letters (those that lower-case to one letter), digits, marks except the apostrophe, spaces and line ends.
_PLAIN = re.compile("[A-Za-z0-9 \n!-&(-/:-@\\[-`{-~\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*").fullmatch
#: Kinds of bytes: 0 between texts, 1 letters, 2 digits, 3 marks, 4 spaces, 5 line ends.
_KIND = np.array([0 if b == 0 else 5 if b == 10 else 4 if b == 32 else 2 if 48 <= b < 58 else 1 if b >= 128 or chr(b).isalpha() else 3 for b in range(256)], np.uint8)


def _other_space(text: str) -> bool:
    return any(c in text for c in _OTHER_ASCII_SPACE) if text.isascii() else _OTHER_SPACE.search(text) is not None


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, others from 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes.

    cut: "space" for byte-level vocabularies that keep white space, "word" for those that drop it, "none" to encode whole
    texts. keep: units remembered, in each of two generations: when one is full, the older goes, and what is met again
    passes into the newer. It bounds memory and changes no result. Units of the texts encoded together are told apart by
    64-bit hashes.
    """

    def __init__(self, path: str, cut: str, keep: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.keep = cut, keep
        self.units, self.older_units, self.known, self.older = {}, {}, {}, {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _is_plain(self, text: str) -> bool:
        if self.cut == "none" or not _PLAIN(text) or any(s in text for s in self.special):
            return False
        return self.cut == "word" or not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in (" ", "\n"))

    def _ids_of_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, by the model; it takes bytes as letters."""
        if len(self.units) > self.keep:
            self.units, self.older_units = {}, self.units
        found = list(map(self.units.get, units))
        new = [i for i, x in enumerate(found) if x is None]
        letters = b"\0".join([units[i] for i in new]).decode("latin-1").translate(_LETTERS).split(_LETTERS[0])
        tokens, older = self.tokenizer.model.tokenize, self.older_units
        for i, x in zip(new, letters):
            unit = units[i]
            ids = older.get(unit) or array("I", [t.id for t in tokens(x)]).tobytes()
            found[i] = self.units[unit] = ids
        return found

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        joined = "\0".join([*texts, ""])
        data = (joined.lower() if self.cut == "word" else joined).encode("utf-8")
        text = np.frombuffer(data, np.uint8)
        kind = _KIND[text]
        first = np.empty(len(text), bool)
        first[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == 0
        if self.cut == "word":
            first |= kind == 2
        start = np.flatnonzero(first)
        own = kind[start]
        stop = np.r_[start[1:], len(text)]
        doc = np.cumsum(own == 0, dtype=np.int32)
        if self.cut == "word":
            take = (own >= 1) & (own <= 3)
        else:
            take = (own != 0) & (own != 4)
            start = start - np.r_[False, own[:-1] == 4]  # a space belongs to what follows it
        start, stop, doc = start[take], stop[take], doc[take]
        if not len(start):
            return [b""] * len(texts)
        one, number = distinct(hashes(text, start, stop))
        ids = self._ids_of_units([data[a:b] for a, b in zip(start[one].tolist(), stop[one].tolist())])
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begin = np.cumsum(size) - size
        n = size[number]
        ends = np.cumsum(n)
        at = np.repeat(begin[number] - (ends - n), n)
        at += np.arange(len(at))
        out = pool[at].tobytes()
        edge = np.r_[0, np.cumsum(np.bincount(doc, n, len(texts)).astype(np.int64)) * 4].tolist()
        return [out[a:b] for a, b in zip(edge[:-1], edge[1:])]

    def _pieces(self, text: str) -> list[str] | None:
        """What plain spaces part, each with its space; None if the text can't be cut there."""
        if any(s in text for s in self.special):
            return None
        if self.cut == "word":
            return None if any(c in text for c in _SEPARATORS) else text.split()
        if self.cut != "space" or "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or _other_space(text):
            return None
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)]

    def _encode_by_pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep // 4:
            self.known, self.older = {}, self.known
        parts = [self._pieces(x) for x in texts]
        known, older = self.known, self.older
        missing = list({piece for p in parts if p is not None for piece in p if piece not in known})
        again = [p for p in missing if p in older]
        known.update((p, older[p]) for p in again)
        new = [p for p in missing if p not in older]
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[piece] = array("I", found.ids).tobytes()
        return [self._whole(text) if p is None else b"".join([known[piece] for piece in p]) for text, p in zip(texts, parts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._is_plain(t) for t in texts]
        quick = iter(self._encode_plain([t for t, p in zip(texts, plain) if p]))
        slow = iter(self._encode_by_pieces([t for t, p in zip(texts, plain) if not p]))
        return [next(quick if p else slow) for p in plain]


@lru_cache(maxsize=4)
def encoder(path: str, cut: str) -> PieceEncoder:
    """One encoder for each vocabulary in a Python worker."""
    return PieceEncoder(path, cut)


def cut_of(path: str) -> str:
    """How texts may be cut for a vocabulary file, read from its own pre-tokenizer."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "space"
    steps = pre.get("pretokenizers", [])
    if steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and "\\s" in str(steps[0].get("pattern")):
        return "word"
    return "none"
