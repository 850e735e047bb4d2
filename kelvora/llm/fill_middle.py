"""Fill-in-the-middle: a text is cut at two of its units' boundaries and its parts are put in another order.

Units are runs of letters A-Z, and every other code point by itself. Where unit k begins is told by a learned rank index:
straight segments are fitted to the boundary offsets so that none is off by more than ``ERROR``; a cut is predicted
from its segment and put right by the residual that is kept for each boundary, one byte. An index is a few segments and
a byte a unit, and cuts any number of times without another pass over the text.

Which cuts and which form is drawn by the SHA-256 of the seed and the document's id, so a rerun draws the same.

Defined results: a null or empty text, or one that holds a sentinel, stays plain; a null doc_id is drawn as an empty one;
rows that repeat are cut alike; a text of any length is cut whole, its boundaries found a slice at a time; a table without
rows gives none; columns of docs are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import table, unused
from kelvora.llm.shingles import trimmed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of a hundred documents so many keep their order, and of a hundred others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: A prediction is off by so much at most; with its rounding a residual fits a byte.
ERROR = 126
#: Code points that are looked at together, and bytes of text that make a batch of results.
SLICE, OUT_BYTES = 1 << 20, 1 << 22
_HEAD = struct.Struct("<QQ")


def boundaries(text: str) -> np.ndarray:
    """The offset at which each unit begins, and the end of the text."""
    found, before = [], False
    for a in range(0, len(text), SLICE):
        points = np.frombuffer(text[a : a + SLICE].encode("utf-32-le"), "<u4") | 32
        letter = (points >= 97) & (points <= 122)
        inner = np.empty(len(letter), bool)
        inner[0] = letter[0] and before
        np.logical_and(letter[1:], letter[:-1], out=inner[1:])
        found.append(np.flatnonzero(~inner) + a)
        before = bool(letter[-1])
    return np.concatenate([*found, [len(text)]])


class RankIndex:
    """From a unit's rank to the offset at which it begins; the last rank is the end of the text."""

    def __init__(self, rank: np.ndarray, offset: np.ndarray, slope: np.ndarray, residual: np.ndarray):
        self.rank, self.offset, self.slope, self.residual = rank, offset, slope, residual

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """A segment goes through its first boundary and on as long as some slope keeps within the error of all of them."""
        begun, slopes, s, width = [], [], 0, 256
        while s < len(offsets):
            low, high, at = -np.inf, np.inf, s + 1
            while at < len(offsets):
                run = np.arange(at - s, min(len(offsets), at + width) - s)
                rise = offsets[at : at + width] - offsets[s]
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                off = int(np.argmax(lows > highs))
                if lows[off] > highs[off]:
                    if off:
                        low, high = lows[off - 1], highs[off - 1]
                    at += off
                    break
                low, high, at, width = lows[-1], highs[-1], at + len(run), min(2 * width, SLICE)
            begun.append(s)
            slopes.append((low + high) / 2 if at > s + 1 else 0.0)
            width, s = max(256, at - s), at
        rank = np.array(begun)
        out = cls(rank, offsets[rank], np.array(slopes), np.zeros(0, np.int8))
        out.residual = np.concatenate([(offsets[a : a + SLICE] - out.predict(np.arange(a, min(len(offsets), a + SLICE)))).astype(np.int8) for a in range(0, len(offsets), SLICE)])
        return out

    @property
    def units(self) -> int:
        return len(self.residual) - 1

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        own = np.searchsorted(self.rank, ranks, side="right") - 1
        return np.floor(self.offset[own] + self.slope[own] * (ranks - self.rank[own])).astype(np.int64)

    def offsets(self, ranks: Sequence[int]) -> np.ndarray:
        ranks = np.asarray(ranks, np.int64)
        return self.predict(ranks) + self.residual[ranks]

    def pack(self) -> bytes:
        parts = (self.rank.astype("<i8"), self.offset.astype("<i8"), self.slope.astype("<f8"), self.residual)
        return _HEAD.pack(len(self.rank), len(self.residual)) + b"".join(x.tobytes() for x in parts)

    @classmethod
    def unpack(cls, data: bytes) -> RankIndex:
        k, n = _HEAD.unpack_from(data)
        rank, offset, slope = (np.frombuffer(data, t, k, _HEAD.size + i * 8 * k) for i, t in enumerate(("<i8", "<i8", "<f8")))
        return cls(rank, offset, slope, np.frombuffer(data, np.int8, n, _HEAD.size + 24 * k))


def drawn(doc_id, seed: str = SEED) -> tuple[int, int, int, int]:
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(told[i : i + 8], 16) for i in range(0, 32, 8))


def rearranged(text: str, draw: Sequence[int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle in code points, output)."""
    h1, h2, h3, h4 = draw
    offsets = boundaries(text)
    n = len(offsets) - 1
    if not n or h3 % 100 >= 100 - PLAIN or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = RankIndex.fit(offsets).offsets(sorted((h1 % (n + 1), h2 % (n + 1)))).tolist()
    head, mid, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}"
    return n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}"


NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())


def transform(docs: DataFrame, seed: str = SEED, names: Sequence[str] = NAMES) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output, under these names. No row is moved."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            begun, rows, held = 0, [], 0
            for i in range(batch.num_rows):
                rows.append(rearranged(texts[i].as_py() or "", drawn(ids[i].as_py(), seed)))
                held += len(rows[-1][-1])
                if held >= OUT_BYTES or i == batch.num_rows - 1:
                    own = batch.slice(begun, len(rows))
                    made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *made], [*batch.schema.names, *names])
                    begun, rows, held = i + 1, [], 0

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{c}` {t}" for c, t in zip(names, ("bigint", "string", "bigint", "bigint", "string"), strict=True)])
    return docs.mapInArrow(trimmed(make), fields)


def restored(output: Column, form: Column) -> Column:
    """The text, from what became of it and its form: no part holds a sentinel, so the first of each is the one put there."""
    part = lambda x, mark, k: F.element_at(F.split(x, mark, 2), k)
    rest = F.substring(output, len(PREFIX) + 1, F.length(output))
    mark = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first, after = part(rest, mark, 1), part(rest, mark, 2)
    second, middle = part(after, F.lit(MIDDLE), 1), part(after, F.lit(MIDDLE), 2)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def apply(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Documents with their text rearranged, and no other change."""
    names = [unused(docs, f"middle_{c}") for c in NAMES]
    return transform(docs, seed, names).withColumn("text", F.col(names[-1])).drop(*names)


def indexes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, segments, index): each text's rank index, as ``RankIndex.unpack`` reads it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                own = [RankIndex.fit(boundaries(t.as_py() or "")) for t in batch.column(1)[a : a + 64]]
                arrays = [batch.column(0)[a : a + 64], pa.array([x.units for x in own], pa.int64()), pa.array([len(x.rank) for x in own], pa.int64()), pa.array([x.pack() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "segments", "index"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(make), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, segments bigint, index binary")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{SEED}:' || doc_id) AS hx FROM documents
), h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || hx[1:8])::BIGINT AS h1, ('0x' || hx[9:16])::BIGINT AS h2, ('0x' || hx[17:24])::BIGINT AS h3, ('0x' || hx[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM h
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""


def query(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
