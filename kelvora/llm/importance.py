"""Resampling towards a target distribution: documents are drawn by how much likelier their hashed n-grams are among
target texts than among all documents.

Texts of a batch are joined with separators, so that one pass of a regular expression finds the words of all; a search in
the documents' offsets tells whose a word is, and n-grams over an end are masked before they are counted by bucket.
Counts are exact sums over all documents and all target texts. Drawing takes the highest of weight and Gumbel noise,
where the noise is keyed by the document's id, so a rerun draws the same.

Only tables of a fixed size pass through the driver: a row per bucket, and a row per ``BIN`` points of score, whose range
is bounded by the logarithm of a count. Ranks are taken in two levels over the drawn rows alone.

Defined results: a null text has no features, weight 0, and is below the least number of words; a null doc_id is hashed
as an empty one and comes after others of its score; rows that repeat score alike and have ranks of their own; a text of
any length is counted whole, so many words at a time; no documents give no rows, and no target texts only shift all gains;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table
from kelvora.llm.shingles import trimmed

GRAMS, BUCKETS, SEED = 1, 10_000, "2024"
PERCENT, LEAST_WORDS = 10, 20
#: Texts are joined up to so many bytes; words are held, so many at a time, and buckets of words remembered, so many.
JOINED, AT_ONCE, KNOWN = 1 << 20, 1 << 16, 200_000
#: Scores are counted in bins of so many points.
BIN = 64
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(texts: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS, known: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket, document) of every run of 1 to grams words, and how many of them are words; a document's words may come in
    several parts. Only A-Z is lower-cased."""
    known = {} if known is None else known
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    found, words, docs = _WORD.finditer(b"\0".join(texts).lower()), [], np.zeros(0, np.int64)
    while new := list(islice(found, AT_ONCE)):
        kept = len(words)
        words += [m.group() for m in new]
        docs = np.concatenate([docs, np.searchsorted(begins, np.fromiter((m.start() for m in new), np.int64, len(new)), side="right") - 1])
        out, of = [], []
        for n in range(1, grams + 1):
            # Runs that end in the new words and in the document that they begin in.
            first = max(0, kept - n + 1)
            end = max(first, len(docs) - n + 1)
            inside = np.flatnonzero(docs[first:end] == docs[first + n - 1 : end + n - 1]) + first
            if n == 1:
                if len(known) > KNOWN:
                    known.clear()
                for w in {*words[kept:]} - known.keys():
                    known[w] = zlib.crc32(w) % buckets
                out.append(np.fromiter((known[w] for w in words[kept:]), np.int64, len(new)))
            else:
                out.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) % buckets for i in inside), np.int64, len(inside)))
            of.append(docs[inside])
        yield np.concatenate(out), np.concatenate(of), len(new)
        words, docs = words[len(words) - grams + 1 :] if grams > 1 else [], docs[len(docs) - grams + 1 :] if grams > 1 else docs[:0]


def _joined(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of rows that are joined together."""
    begun, held, size = 0, [], 0
    for i, text in enumerate(column):
        held.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        size += len(held[-1])
        if size >= JOINED:
            yield begun, held
            begun, held, size = i + 1, [], 0
    if held:
        yield begun, held


def counts(texts: DataFrame, column: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in all texts. A task sends a row a bucket at most."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), {}
        for batch in batches:
            for _, own in _joined(batch.column(0)):
                for bucket, _, _ in features(own, grams, buckets, known):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(column).mapInArrow(trimmed(make), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """By bucket, in thousandths of a natural logarithm, floored."""
    n = len(of_docs)
    whole, target = float(of_docs.sum()) + n, float(of_target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * target))) for s, t in zip(of_docs.tolist(), of_target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            n, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for begun, own in _joined(batch.column(1)):
                here = slice(begun, begun + len(own))
                for bucket, doc, new in features(own, grams, len(gain), known):
                    n[here] += np.bincount(doc, minlength=len(own))
                    words[here] += np.bincount(doc[:new], minlength=len(own))
                    total[here] += np.bincount(doc, gain[bucket], len(own)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(make), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all documents; rank is null for what isn't drawn."""
    gain = gains(counts(docs, "text", grams, buckets), counts(target, "text", grams, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(float(2**32)))))
    # Written, so that rows that are equal in all else keep their numbers when a task is run again.
    scored = materialise(weighed(docs, gain, grams).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    bins = sorted(scored.where(fit).groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect(), reverse=True)
    most = percent * sum(r["count"] for r in bins) // 100
    least, seen = None, 0
    for r in bins:
        if seen >= most:
            break
        least, seen = r["bin"] * BIN, seen + r["count"]
    high = fit & (F.col("score") >= least) if least is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("row")]
    parts = materialise(scored.where(high).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "drawn")
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    placed = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(before, "part")
    rank = (F.col("before") + F.col("at")).cast("bigint")
    keep = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*keep, F.when(rank <= most, rank).alias("rank")).union(scored.where(~high).select(*keep, F.lit(None).cast("bigint")))


def sample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, with the columns of docs."""
    told = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("importance_id"))
    return docs.join(told, F.col("doc_id").eqNullSafe(F.col("importance_id")), "left_semi")


#: CRC-32 by its table of 256, made by rule; over distinct words only.
ORACLE = rf"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), dw AS (
  SELECT doc_id, unnest(ws) AS w FROM d
), bw AS (
  SELECT unnest(ws) AS w FROM b
), v AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), crc AS (
  SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::UBIGINT)),
    lambda c, y: xor(c >> 8, tab.t[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % {BUCKETS})::BIGINT AS bucket FROM v, tab
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket
), g AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), per AS (
  SELECT doc_id, sum(gain)::BIGINT AS total FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY doc_id
), o AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (total - (total % len(ws) + len(ws)) % len(ws)) // len(ws) END::BIGINT AS weight,
    ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN per USING (doc_id)
), sc AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM o
), rk AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM rk) THEN rank END::BIGINT AS rank FROM sc LEFT JOIN rk USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target).drop("n_words")
