"""Token ids of whole texts, by the tokenizers library with a cache of what stands between spaces."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Where a piece between spaces can't be encoded apart: white space on both sides of a space, or before a last one.
_UNSAFE = re.compile(r" (?<=\s )(?=\s|\Z)")
#: White space next to a line feed, where a line's first word doesn't stand alone.
_CROWDED = re.compile(r"\n(?:(?<=\s\n)|(?=\s))")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How the byte-level pre-tokenizer spells bytes: printable ones as they are, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_SPACE = _SPELLED[32]
_STOPS = frozenset(".,;:!?")


class IdEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers in bytes.

    The byte-level vocabulary never merges across a pre-token, and a single space before a
    character that is no white space always begins one. So each piece between spaces has the same ids
    alone as in its text; so has what stands between its line feeds, and what stands before a stop that follows a letter. The library
    encodes each such part once, and its ids are kept. Texts where this doesn't hold (white space
    around a space, strings of special tokens) are encoded as a whole. Parts and pieces of at most 64 characters are kept in
    two generations: once the younger is full, the elder goes, and what is used again comes over. Together they hold about
    1.5 times ``capacity`` at most.
    """

    def __init__(self, path: str, capacity: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.byte_level = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space
        self.spell = self.tokenizer.model.tokenize
        self.capacity = capacity
        self.old_parts: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # without a space before them, by text
        self.pieces: dict[str, bytes] = {}  # pieces, and parts with a space before them, by text without it

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _part(self, part: str) -> bytes:
        """Letters, with a space before or none, are one pre-token, which the library's model takes as it is; the rest is encoded as text."""
        kept, old, key = (self.pieces, self.old_pieces, part[1:]) if part[0] == " " and part[1:2] != "\n" else (self.parts, self.old_parts, part)
        ids = kept.get(key)
        if ids is None and (ids := old.get(key)) is not None:
            kept[key] = ids
        if ids is None:
            if self.byte_level and (part[1:] if part[0] == " " else part).isalpha():
                spelled = _SPACE + part[1:] if part[0] == " " else part
                if not part.isascii():
                    spelled = part.encode().decode("latin-1").translate(_SPELLED)
                ids = array("I", [t.id for t in self.spell(spelled)]).tobytes()
            else:
                ids = self._whole([part])[0]
            if len(part) <= 64:
                kept[key] = ids
        return ids

    def _bare(self, text: str) -> bytes:
        """The ids of what stands between spaces, by its parts."""
        if "\n" in text:
            lines = text.split("\n")
            if not all(x and not x[0].isspace() and not x[-1].isspace() for x in (lines[0].removeprefix(" "), *lines[1:])):
                return self._whole([text])[0]
            return self._part("\n").join([self._bare(x) for x in lines])
        if len(text) > 2 and text[-1] in _STOPS and text[-2].isalpha():
            return self._part(text[:-1]) + self._part(text[-1])
        return self._part(text)

    def _piece(self, key: str) -> bytes:
        """A piece by its key: the space before it is left out, and a line's first word has its line feed."""
        if (ids := self.old_pieces.get(key)) is not None:
            pass
        elif key[:1] != "\n":
            ids = self._bare(" " + key)
        elif len(key) > 1 and not key[1].isspace():
            ids = self._part("\n") + self._bare(key[1:])
        else:
            ids = self._whole([key])[0]
        if len(key) <= 64:
            self.pieces[key] = ids
        return ids

    def forget(self) -> None:
        """Drops the kept parts; at 1,000,000 they are some 200 MB."""
        self.parts, self.old_parts, self.pieces, self.old_pieces = {}, {}, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > self.capacity // 4:
            self.parts, self.old_parts = {}, self.parts
        if len(self.pieces) > self.capacity // 2:
            self.pieces, self.old_pieces = {}, self.pieces
        get, out, whole = self.pieces.get, [], []
        for i, text in enumerate(texts):
            crowded = "\n" in text and _CROWDED.search(text)
            if not text or _UNSAFE.search(text) or crowded and " \n" in text or any(s in text for s in self.special):
                out.append(b"")
                whole.append(i)
                continue
            if not crowded:
                text = text.replace("\n", " \n")  # a line's first word, with its line feed, is a piece
            split = text.split(" ")
            ids = list(map(get, split))
            if None in ids:
                for k in [k for k, x in enumerate(ids) if x is None]:
                    ids[k] = self._piece(split[k])
            ids[0] = self._bare(split[0]) if split[0] else b""
            out.append(b"".join(ids))
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str, capacity: int = 1_000_000) -> IdEncoder:
    """One encoder for each Python worker."""
    return IdEncoder(path, capacity)
