"""Best-fit packing planned on a histogram of lengths.

Documents are cut into pieces of at most ``size`` tokens; only counts per length (``size`` numbers at most) come to
the driver. Best fit runs over those counts: equal bins are one group, and a line of the plan says which ranks of a
length take which place in which run of sequences. Pieces then take their slots by their rank within their length.
Ranks are counted in hashed blocks of bounded size, so that a length which a third of all pieces share isn't one task.

Defined results: a null text is empty and packs as its end token; rows that repeat are packed once each; pieces of one
length are alike, so which takes which slot follows a hash of doc_id; a document of any length is cut into as many pieces
as it needs; a table without rows gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table
from kelvora.llm.shingles import trimmed
from kelvora.llm.tokens import CACHE_PARTS, default_path, encoder

SIZE = 2048
END_ID = 0
BLOCK_ROWS = 4096
#: Token parts that a worker keeps where it does nothing else, some 150 bytes each.
PARTS = 600_000


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """The plan: (length, first rank, ranks, first sequence, offset). Longest first, into the fullest sequences that
    still have room; sequences of equal content are handled as one run."""
    plan, runs, free, opened = [], defaultdict(list), [], 0  # free: the sorted spaces that runs have

    def put_back(space: int, first: int, n: int) -> None:
        if space:
            if not runs[space]:
                bisect.insort(free, space)
            runs[space].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = runs[space].pop()
                if not runs[space]:
                    free.pop(at)
                take = min(n, left)
                plan.append((length, rank, take, first, size - space))
                put_back(space - length, first, take)
                if take < n:
                    put_back(space, first + take, n - take)
                rank, left = rank + take, left - take
            else:
                deep = size // length
                for n, height in ((left // deep, deep), (1, left % deep)):
                    if n and height:
                        for k in range(height):
                            plan.append((length, rank, n, opened, k * length))
                            rank += n
                        put_back(size - height * length, opened, n)
                        opened += n
                left = 0
    return plan


def narrow(ids: bytes) -> bytes:
    """Little-endian 32-bit ids as 16-bit ones where all of them fit: half of what is written and moved."""
    own = np.frombuffer(ids, "<u4")
    return own.astype("<u2").tobytes() if len(own) and int(own.max()) < 1 << 16 else ids


def wide(ids: pa.Array, lengths: np.ndarray) -> pa.Array:
    """What narrow was given."""
    return pa.array([b if len(b) == 4 * n else np.frombuffer(b, "<u2").astype("<u4").tobytes() for b, n in zip(ids.to_pylist(), lengths.tolist(), strict=True)], pa.binary())


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, parts: int = CACHE_PARTS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): whole texts, encoded where they are read. ids are as ``narrow`` has
    them, which is what is stored and moved; ``slots`` gives them back as 32-bit numbers."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, parts), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                at = [0, *range(n % size or size, n, size), n]
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc_id.as_py(), k, a, b - a, zlib.crc32(own), narrow(own) if with_ids else None)[: len(names)])
                if len(rows) >= 20_000:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(cut), schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"piece": pa.int32(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.int64())) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)


def ranked(cut: DataFrame, n_rows: int) -> DataFrame:
    """cut with rank, from 0 within each length and gapless: a rank in its block, plus the rows of the blocks before."""
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")))
    before = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n")
    return own.join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("block", "own", "before")


def slots(df: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """df (with length and rank, and ids if it has them) and its sequence_id and offset. The plan's size hangs on ``size``,
    not on the data."""
    lines = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lines[:, 0] << 44 | lines[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            added = {"sequence_id": lines[k, 3] + rank - lines[k, 1], "offset": lines[k, 4]}
            kept = [i for i, x in enumerate(batch.schema.names) if x != "rank"]
            for at in range(0, batch.num_rows, 2000):
                part = slice(at, at + 2000)
                own = [batch.column(i).slice(at, 2000) for i in kept]
                own = [wide(x, length[part]) if batch.schema.names[i] == "ids" else x for i, x in zip(kept, own, strict=True)]
                yield pa.RecordBatch.from_arrays(own + [pa.array(x[part], pa.int64()) for x in added.values()], [batch.schema.names[i] for i in kept] + list(added))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "rank")
    return df.mapInArrow(trimmed(take), f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, parts: int = CACHE_PARTS) -> DataFrame:
    """A row per piece with its sequence and place; with_ids also carries its ids."""
    cut = materialise(pieces(docs, path or default_path(), size, end_id, with_ids, parts), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return slots(ranked(cut, sum(counts.values())), best_fit(counts, size))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), parts=PARTS).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
