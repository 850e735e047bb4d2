"""Quality rules with cross-document line frequency, as DataFrame expressions only.

Base rules look at one text. The corpus rule hashes each normalised line, counts in how many distinct
documents of the same host (``source``) it stands, takes lines above the limit out, and rejects a document of
which too little is left. Copies are documents like others: a text that a host has more often than the limit
says nothing of its own, and all its copies go, near or exact.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; rows
that repeat are judged alike and stay repeated, and count as one document where their doc_id is the same; all
rows without a doc_id count as one; very long texts are judged whole; a table without rows gives none; extra
columns are ignored by ``judge`` and kept by ``apply``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table, unused, words_of

#: A line may stand in so many documents of its host, or in that share of them if this is more, but not in more than
#: the last: on a host of any size, what that many documents have in common is not their own.
LINE_DOCS = 20
LINE_SHARE = 0.05
LINE_MOST = 1000
#: At least this share of a document's line characters has to be left.
LEAST_LEFT = 0.3
MIN_WORDS = 50


def _windows(words: Column) -> Column:
    """A hash of each window of three words."""
    return F.when(
        F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words within the windows that are found twice or more. Windows are sorted by hash, so equals are neighbours."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.sort_array(
        F.flatten(
            F.transform(
                F.array(ordered),
                lambda s: F.transform(
                    F.filter(
                        F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                ),
            )
        )
    )
    return F.aggregate(
        at,
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def measures(docs: DataFrame) -> DataFrame:
    """One pass over the texts: base measures, and the hash and length of each line that has a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.col("source").alias("host"), F.col("text"), F.xxhash64(text).alias("text_hash"), words_of("text").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    hashed = split.withColumn("h3", _windows(F.col("w")))
    return hashed.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h3")) < F.size("h3"), _covered(F.col("h3"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("l", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.length(x).alias("n"))).alias("lines"),
    )


def frequent_lines(measured: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST) -> DataFrame:
    """(host, h) of lines above their host's limit. A document counts once; every count combines on the map side."""
    docs = measured.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    limits = docs.select(F.col("host").alias("host_"), F.greatest(F.lit(float(line_docs)), F.least(F.lit(float(line_most)), F.lit(line_share) * F.col("docs"))).alias("most"))
    once = measured.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    counts = once.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    return counts.join(limits, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("n") > F.col("most")).select("host", "h")


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST, least_left: float = LEAST_LEFT) -> DataFrame:
    """Measures and verdicts, a row per document: the base measures, n_lines_removed, share_left, base_failed, kept,
    and frequent (the hashes of its lines above the limit)."""
    measured = materialise(measures(docs), "quality")
    above = frequent_lines(measured, line_docs, line_share, line_most).withColumnRenamed("host", "host_").withColumnRenamed("h", "h_")
    lines = measured.select("doc_id", "host", "text_hash", F.explode("lines").alias("x")).select("doc_id", "host", "text_hash", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    # Inner: documents that have no such line never take part in the second shuffle.
    lost = (
        lines.join(above, F.col("host").eqNullSafe(F.col("host_")) & (F.col("h") == F.col("h_")))
        .groupBy(F.col("doc_id").alias("doc_"), F.col("text_hash").alias("text_"), F.col("host").alias("host__"))
        .agg(F.collect_set("h").alias("frequent"))
    )
    joined = measured.join(lost, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("text_hash") == F.col("text_")) & F.col("host").eqNullSafe(F.col("host__")), "left")
    hit = lambda x: F.array_contains("frequent", x["h"])
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    gone = F.when(F.col("frequent").isNull(), F.array().cast("array<struct<h:bigint,n:int>>")).otherwise(F.filter("lines", hit))
    out = joined.withColumn("gone", gone).withColumn("all_chars", chars(F.col("lines"))).withColumn("gone_chars", chars(F.col("gone")))
    share = F.when(F.col("all_chars") > 0, 1 - F.col("gone_chars") / F.col("all_chars")).otherwise(F.lit(1.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (share >= least_left)).alias("kept"),
        F.size("gone").cast("long").alias("n_lines_removed"),
        share.alias("share_left"),
        "frequent",
    )


def apply(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that judge keeps, without their lines above the limit; n_chars follows the text where it is a column."""
    own = {c: unused(docs, f"quality_{c}") for c in ("doc_id", "text_hash", "host", "frequent", "hash")}
    told = judge(docs, **limits).where("kept").select(*[F.col(c).alias(own[c]) for c in ("doc_id", "text_hash", "host", "frequent")]).dropDuplicates([own[c] for c in ("doc_id", "text_hash", "host")])
    hashed = docs.withColumn(own["hash"], F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = hashed.join(told, F.col("doc_id").eqNullSafe(F.col(own["doc_id"])) & (F.col(own["hash"]) == F.col(own["text_hash"])) & F.col("source").eqNullSafe(F.col(own["host"])))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(own["frequent"], F.xxhash64(normalised(x)))), "\n")
    changed = kept.withColumn("text", F.when(F.col(own["frequent"]).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for the contract's columns.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), win AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS p FROM twice, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY rid
), ln AS (
  SELECT rid, doc_id, host, length(x) AS n, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k
  FROM (SELECT rid, doc_id, host, text, unnest(l) AS x FROM w)
), lim AS (
  SELECT host, greatest({LINE_DOCS}, least({LINE_MOST}, {LINE_SHARE} * (count(DISTINCT doc_id) + max((doc_id IS NULL)::INT)))) AS most FROM d GROUP BY host
), freq AS (
  SELECT c.host, c.k FROM (SELECT host, k, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS n FROM ln GROUP BY host, k) c
  JOIN lim ON c.host IS NOT DISTINCT FROM lim.host WHERE n > most
), left_ AS (
  SELECT rid, sum(CASE WHEN f.k IS NULL THEN 0 ELSE ln.n END) AS gone, sum(ln.n) AS chars
  FROM ln LEFT JOIN freq f ON ln.host IS NOT DISTINCT FROM f.host AND ln.k = f.k GROUP BY rid
), b AS (
  SELECT w.doc_id, len(w) AS n_words,
    length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    CASE WHEN chars > 0 THEN 1 - gone / chars ELSE 1 END AS share
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN left_ USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND share >= {LEAST_LEFT} AS kept
FROM b
"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
