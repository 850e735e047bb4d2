"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents, in ascending doc_id order, as one bit-plane per bit of an id, highest
first. Each plane is ordered by the bits above it (zeros first), with the number of ones before every block, so that
access, counting and occurrence lookup take one step per plane and never decode the shard. The planes are compressed
each for itself: a lookup opens a shard and the planes it walks, from that one file. A shard file is a cell of a Parquet
table that Spark writes and reads, so it lives in whatever store the cluster shares. ``access``, ``counts`` and
``occurrences`` answer for the whole table by global place: where an id stands among those of all documents.

File: magic ``WVM1``, then little-endian: n (u64), bits (u32), and per plane its zeros (u64) and the sizes of its two
zstd frames (u32, u32: packed bits, least significant first; ones before each 512-bit block as u32); then the frames.

Defined results: a null text is only its end id; null doc_ids come first; rows that repeat are stored each; a document of
any length is in one shard; a table without rows gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table
from kelvora.llm.shingles import trimmed
from kelvora.llm.tokens import COLUMN_BYTES, column_encoder, default_path

END_ID = 2
#: A shard is closed at the first document that brings it to so many ids.
SHARD_IDS = 1 << 20
BLOCK = 512
#: Token parts that a worker keeps, some 40 bytes each.
PARTS = 1_500_000
_HEAD, _PLANE = struct.Struct("<4sQI"), struct.Struct("<QII")


def write_shard(ids: np.ndarray, bits: int) -> bytes:
    pack, n, heads, frames = zstandard.ZstdCompressor(level=1), len(ids), [], []
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        bit = (now >> level & 1).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-max(n, 1) // BLOCK) * (BLOCK // 8), np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
        both = [pack.compress(plane.tobytes()), pack.compress(rank.tobytes())]
        now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        heads.append(_PLANE.pack(n - int(ones.sum()), *map(len, both)))
        frames += both
    return b"".join([_HEAD.pack(b"WVM1", n, bits), *heads, *frames])


class Shard:
    """Reads a shard; planes are opened when they are first walked."""

    def __init__(self, data: bytes):
        magic, self.n, self.bits = _HEAD.unpack_from(data)
        if magic != b"WVM1":
            raise ValueError("not a wavelet-matrix shard")
        self.data = data
        self.heads = [_PLANE.unpack_from(data, _HEAD.size + k * _PLANE.size) for k in range(self.bits)]
        at = np.cumsum([_HEAD.size + self.bits * _PLANE.size, *(x for _, a, b in self.heads for x in (a, b))])
        self.at = [(int(at[2 * k]), int(at[2 * k + 1]), int(at[2 * k + 2])) for k in range(self.bits)]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._planes:
            (a, b, c), unpack = self.at[k], zstandard.ZstdDecompressor()
            self._planes[k] = np.frombuffer(unpack.decompress(self.data[a:b]), np.uint8), np.frombuffer(unpack.decompress(self.data[b:c]), "<u4")
        return self._planes[k]

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        plane, rank = self.plane(k)
        if i <= 0:
            return 0
        block = (i - 1) // BLOCK
        own = np.unpackbits(plane[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(rank[block]) + int(own.sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (zeros, _, _) in enumerate(self.heads):
            bit = self.plane(k)[0][i // 8] >> (i % 8) & 1
            ones = self._ones(k, i)
            i = zeros + ones if bit else i - ones
            out = out << 1 | int(bit)
        return out

    def rank(self, token: int, i: int) -> int:
        """How often token stands among the first i ids."""
        a, b = 0, min(i, self.n)
        if token >> self.bits:
            return 0
        for k, (zeros, _, _) in enumerate(self.heads):
            oa, ob = self._ones(k, a), self._ones(k, b)
            a, b = (zeros + oa, zeros + ob) if token >> (self.bits - 1 - k) & 1 else (a - oa, b - ob)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The place of token's occurrence j (from 0): down once for the run of the token, and back up."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        a = 0
        for k, (zeros, _, _) in enumerate(self.heads):
            ones = self._ones(k, a)
            a = zeros + ones if token >> (self.bits - 1 - k) & 1 else a - ones
        i = a + j
        for k in range(self.bits - 1, -1, -1):
            zeros, bit = self.heads[k][0], token >> (self.bits - 1 - k) & 1
            i = self._find(k, i - zeros if bit else i, bit)
        return i

    def _find(self, k: int, j: int, bit: int) -> int:
        """The place of the bit's occurrence j in plane k: by blocks, then within one."""
        plane, rank = self.plane(k)
        before = rank.astype(np.int64) if bit else np.arange(len(rank), dtype=np.int64) * BLOCK - rank
        block = int(np.searchsorted(before, j, side="right")) - 1
        own = np.unpackbits(plane[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(own == bit)[j - int(before[block])])

    def places(self, token: int) -> np.ndarray:
        """All places of a token, ascending: down for the run of the token, and the run back up plane by plane."""
        a, b = 0, self.n
        if token >> self.bits:
            return np.zeros(0, np.int64)
        for k, (zeros, _, _) in enumerate(self.heads):
            oa, ob = self._ones(k, a), self._ones(k, b)
            a, b = (zeros + oa, zeros + ob) if token >> (self.bits - 1 - k) & 1 else (a - oa, b - ob)
        at = np.arange(a, b)
        for k in range(self.bits - 1, -1, -1) if len(at) else ():
            zeros, bit = self.heads[k][0], token >> (self.bits - 1 - k) & 1
            own = np.flatnonzero(np.unpackbits(self.plane(k)[0], count=self.n, bitorder="little") == bit)
            at = own[at - zeros if bit else at]
        return at

    @cached_property
    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.plane(k)[0], count=self.n, bitorder="little").view(bool)
            zeros, up = self.heads[k][0], np.empty_like(now)
            up[np.flatnonzero(~bit)], up[np.flatnonzero(bit)] = now[:zeros], now[zeros:]
            up |= bit.astype(now.dtype) << (self.bits - 1 - k)
            now = up
        return now.astype(np.uint32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, as a look into the table of known parts costs the same for few texts as for many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.nbytes > COLUMN_BYTES and not held:
            yield batch
            continue
        if held and sum(b.nbytes for b in held) + batch.nbytes > COLUMN_BYTES:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, bits: int = 16) -> DataFrame:
    """The shards' table: (part, shard, doc_ids, n_tokens, total, data), written; part and shard are in doc_id order."""
    schema = "part int, shard int, doc_ids array<bigint>, n_tokens array<bigint>, total bigint, data binary"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, k = column_encoder(path, PARTS), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            row = {"part": part, "shard": k, "doc_ids": doc_ids, "n_tokens": lengths, "total": total, "data": write_shard(ids, bits)}
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row.values(), kinds, strict=True)], list(row))

        for batch in _gathered(batches):
            for doc_id, own in zip(batch.column(0), encode(batch.column(1)), strict=True):
                ids = own + end
                doc_ids.append(doc_id.as_py())
                lengths.append(len(ids) // 4)
                held.append(ids)
                total += len(ids) // 4
                if total >= shard_ids:
                    yield close()
                    k, doc_ids, lengths, held, total = k + 1, [], [], [], 0
        if doc_ids:
            yield close()

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = max(1, own.rdd.getNumPartitions())
    ordered = own.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(trimmed(shards), schema), "tokens")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files."""
    schema = "part int, shard int, doc_id bigint, own bigint, n_tokens bigint, ids_crc32 bigint"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, shard, doc_ids, lengths, data = (batch.column(c)[k] for c in range(5))
                lengths, ids = np.array(lengths.as_py(), np.int64), Shard(data.as_buffer().to_pybytes()).ids.astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), doc_ids.values, pa.array(at[:-1]), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    told = shards.select("part", "shard", "doc_ids", "n_tokens", "data").mapInArrow(trimmed(rows), schema)
    return told.join(starts(shards), ["part", "shard"]).select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def starts(shards: DataFrame) -> DataFrame:
    """(part, shard, before): ids of all shards before one. Shards are summed within the part of the writer that made them;
    only a row per part, as many as the writer had tasks, meets in one task."""
    parts = shards.groupBy("part").agg(F.sum("total").alias("whole")).select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("first"))
    within = shards.select("part", "shard", (F.sum("total").over(Window.partitionBy("part").orderBy("shard")) - F.col("total")).alias("own"))
    return within.join(parts, "part").select("part", "shard", (F.col("first") + F.col("own")).alias("before"))


#: Places that one call of a shard answers.
ASKED = 1 << 16


def access(shards: DataFrame, places: DataFrame) -> DataFrame:
    """(place, token) of global places (place); places that no id has are left out. A shard that is asked very often answers
    in several tasks."""
    span = 1 << 20
    held = shards.select("part", "shard", "total").join(starts(shards), ["part", "shard"]).where("total > 0")
    held = held.select("part", "shard", "before", "total", F.explode(F.sequence(F.floor(F.col("before") / span), F.floor((F.col("before") + F.col("total") - 1) / span))).alias("span"))
    asked = places.select(F.col("place").cast("bigint").alias("place")).where("place >= 0").distinct().withColumn("span", F.floor(F.col("place") / span))
    own = asked.join(held, "span").where("place >= before and place < before + total").select("part", "shard", "place", (F.col("place") - F.col("before")).cast("int").alias("at"))
    sizes = own.groupBy("part", "shard").agg(F.ceil(F.count("*") / ASKED).alias("calls"))
    dealt = own.join(sizes, ["part", "shard"]).withColumn("call", F.pmod(F.xxhash64("place"), F.col("calls")))
    calls = dealt.groupBy("part", "shard", "call").agg(F.collect_list(F.struct("place", "at")).alias("asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, asked in zip(*batch.columns, strict=True):
                shard = Shard(data.as_buffer().to_pybytes())
                tokens = [shard.access(i) for i in asked.values.field("at").to_pylist()]
                yield pa.RecordBatch.from_arrays([asked.values.field("place"), pa.array(tokens, pa.int64())], ["place", "token"])

    return calls.join(shards.select("part", "shard", "data"), ["part", "shard"]).select("data", "asked").mapInArrow(trimmed(answer), "place bigint, token bigint")


def counts(shards: DataFrame, tokens: DataFrame, most_bits: int = 32) -> DataFrame:
    """(token, n) of tokens (token): how often each stands in all shards. Different tokens are at most the vocabulary."""
    asked = [r[0] for r in tokens.select(F.col("token").cast("bigint")).where(F.col("token").between(0, (1 << most_bits) - 1)).distinct().collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([shard.count(t) for t in asked], pa.int64())], ["token", "n"])

    return shards.select("data").mapInArrow(trimmed(count), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(place): every global place of a token."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(*batch.columns, strict=True):
                at = Shard(data.as_buffer().to_pybytes()).places(token)
                yield pa.RecordBatch.from_arrays([pa.array(at + before.as_py(), pa.int64())], ["place"])

    return shards.join(starts(shards), ["part", "shard"]).select("before", "data").mapInArrow(trimmed(find), "place bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), default_path()))
