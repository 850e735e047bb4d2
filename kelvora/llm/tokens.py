"""Token ids by the public tokenizers, with a bounded cache of pieces.

A byte-level BPE splits a text into pre-tokens before it merges. No pre-token reaches across a space that follows
a character other than white space, across either side of a lone line feed, or from a letter into a mark, so a text cut
there has the ids of its parts one after another. Parts repeat, and each is encoded by the library once per worker while
the cache has room. ``Encoder`` takes a text, ``ColumnEncoder`` the texts of a column at once.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kelvora.llm.shingles import slices

#: Parts kept per worker, in two generations: a part that is used again moves to the younger, and when that is half of all,
#: the elder goes. Longer parts aren't kept.
CACHE_PARTS = 200_000
LONGEST_PART = 24
#: Texts that a column cuts at once: up to so many bytes, or one longer text. Work space is some 12 bytes a byte.
COLUMN_BYTES = 1 << 24
MARKS = frozenset(".,;:!?")
_SPACED = re.compile(r"\s\s")
#: The same in Arrow's expressions, whose \s is ASCII without vertical tabs and separators.
_SPACED_ARROW = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_CUT = re.compile(r"(?<=\S)(?= )")

#: Byte-level vocabularies write a byte that prints in Latin-1 as itself, and the others, in order, as characters from 256 on.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_OTHERS = [b for b in range(256) if b not in _PRINTS]
_AS_CHAR = {b: chr(b) for b in _PRINTS} | {b: chr(256 + k) for k, b in enumerate(_OTHERS)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Parts(dict):
    """Little-endian 32-bit ids of prefix + part, as bytes."""

    def __init__(self, tokenizer, prefix: str, most: int):
        super().__init__()
        self.half, self.elder = max(1, most // 2), {}
        self.tokenizer, self.model, self.prefix = tokenizer, tokenizer.model, prefix
        self.marks = {c: self.ids(c) for c in (*MARKS, "\n")}

    def __missing__(self, part: str) -> bytes:
        mark = self.marks.get(part[-1:])
        if mark is not None and part[-2:-1].isalpha():
            known = self.get(part[:-1])
            if known is None:  # a word that is new with its mark is kept without it
                return self[part[:-1]] + mark
            out = known + mark
        else:
            out = self.elder.get(part)
            if out is None:
                out = self.ids(self.prefix + part)
        if len(part) <= LONGEST_PART:
            if len(self) >= self.half:
                self.elder = dict(self)
                self.clear()
            self[part] = out
        return out

    def ids(self, text: str) -> bytes:
        """Letters alone, with a space before them or not, are one pre-token: the library's model takes it as it is."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            if body.isascii():
                own = body if body is text else _AS_CHAR[32] + body
            else:
                own = "".join([_AS_CHAR[b] for b in text.encode()])
            return _packed([t.id for t in self.model.tokenize(own)])
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


class Encoder:
    """For byte-level BPE files; ``path`` is such a file of the tokenizers library."""

    def __init__(self, path: str, parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.first, self.later = _Parts(tokenizer, "", parts), _Parts(tokenizer, " ", parts)

    def __call__(self, text: str | None) -> bytes:
        """The ids of a whole text (null: none), as little-endian 32-bit numbers."""
        if not text:
            return b""
        if _SPACED.search(text):
            return b"".join(map(self.first.__getitem__, _CUT.split(text)))
        out, feed, first, later = [], self.first.marks["\n"], self.first, self.later.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append((first[head] if head else b"") + b"".join(map(later, rest)))
        return feed.join(out)


#: Bytes by what they do to a part: white space (1) begins one, as does a mark (2) that follows a letter. A letter is one of
#: ASCII, or one of Latin-1 by its two bytes, the first of which is 0xC3.
_KIND = np.zeros(256, np.uint8)
_KIND[[10, 32]], _KIND[[ord(c) for c in (*MARKS, *"#$%&*")]] = 1, 2
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_LATIN = np.array([128 <= b < 192 and chr(b + 64).isalpha() for b in range(256)])


class ColumnEncoder:
    """As Encoder, for string columns. The parts of many texts are cut at once, as a string array over the column's own bytes,
    and looked up by Arrow in a table of known parts; only parts that the table lacks are encoded one by one. Once more than
    ``parts`` are known, those go that the texts at hand don't have."""

    def __init__(self, path: str, parts: int = CACHE_PARTS):
        self.one, self.most = Encoder(path, parts=1024), parts
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text, as Encoder has them."""
        texts = texts.fill_null("")
        spaced = pc.match_substring_regex(texts, _SPACED_ARROW)
        plain = self._plain(texts.filter(pc.invert(spaced)) if pc.any(spaced).as_py() else texts)
        for k, alone in enumerate(spaced.to_pylist()):
            yield self.one(texts[k].as_py()) if alone else next(plain)

    def _plain(self, texts: pa.Array) -> Iterator[bytes]:
        """Of texts without two characters of white space in a row."""
        for _, _, data, offsets in slices(texts, COLUMN_BYTES, COLUMN_BYTES):
            kind = _KIND[data]
            begins = kind == 1
            marks = np.flatnonzero(kind == 2)
            before = data[marks - 1]
            begins[marks[_LETTER[before] | _LATIN[before] & (data[marks - 2] == 0xC3)]] = True
            for after in (np.flatnonzero(data == 10) + 1, offsets):
                begins[after[after < len(data)]] = True
            cuts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
            del kind, begins, marks, before, after
            ids = self._parts(pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)))
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(cuts)][np.searchsorted(cuts, offsets)].tolist()
            out = memoryview(ids.buffers()[2] or b"")
            for a, b in zip(ends, ends[1:], strict=False):
                yield bytes(out[a:b])

    def _parts(self, parts: pa.Array) -> pa.Array:
        at = pc.index_in(parts, value_set=self.known)
        lacks = pc.is_null(at)
        new = parts.filter(lacks).dictionary_encode()
        ids = pa.concat_arrays([self.ids, pa.array(map(self.one.first.ids, new.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary())])
        at = pc.replace_with_mask(at, lacks, pc.add(new.indices, pa.scalar(len(self.known), pa.int32())))
        known = pa.concat_arrays([self.known, new.dictionary])
        keep = np.full(len(known), len(known) <= self.most)
        keep[at.to_numpy()] = True
        keep[len(self.known) :] &= pc.binary_length(new.dictionary).to_numpy() <= LONGEST_PART
        self.known, self.ids = known.filter(pa.array(keep)), ids.filter(pa.array(keep))
        return ids.take(at)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, parts: int = CACHE_PARTS) -> Encoder:
    """One per worker, file and size of cache."""
    if (path, parts) not in _ENCODERS:
        _ENCODERS[path, parts] = Encoder(path, parts)
    return _ENCODERS[path, parts]


_COLUMNS: dict[tuple[str, int], ColumnEncoder] = {}


def column_encoder(path: str, parts: int = CACHE_PARTS) -> ColumnEncoder:
    """One per worker, file and size of cache."""
    if (path, parts) not in _COLUMNS:
        _COLUMNS[path, parts] = ColumnEncoder(path, parts)
    return _COLUMNS[path, parts]
