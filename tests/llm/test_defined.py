"""Defined results: columns whose names clash, tables without rows, and very long texts, for every operator and stage."""

from __future__ import annotations

import random

import brute
import brute_pii
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
NAMES = """_copies _copy _k _kept _m _p _size _source _target _text a at b bands begin block blocks candidates component_id copies count crowd d data doc_ doc_ids e edge
first found frequent gram h h_ hash held hit host host_ hull hulls ids key kept kept_id kept_null kept_text keys label last left length lines link member mixed_copies mixed_copy mixed_size
mixed_source mixed_target most n n_shingles n_tokens n_words names node offset own part path pii_found pii_kinds pii_made piece plan pos quality_doc_id quality_frequent quality_hash quality_host
quality_text_hash r rank ranges rep rest right rows rule ruled runs score sequence_id set shard size source_size start stop target taken text_ text_hash th url_ v verdict w words x y z""".split()


def _ops():
    import corpus_pipeline as cp
    from kelvora.llm import mixing, near_dup, packing, pii, quality_rules, suffix_dedup, token_files
    from kelvora.llm.tokens import default_path

    out = {
        "op1": lambda s, d: suffix_dedup.apply(d), "op3": lambda s, d: mixing.mix(d), "op4": lambda s, d: pii.apply(d), "op5": lambda s, d: packing.pack(d).drop("sequence_id", "offset"),
        "op6": lambda s, d: token_files.read(token_files.write(d, default_path())), "op8": lambda s, d: quality_rules.judge(d), "op8_apply": lambda s, d: quality_rules.apply(d), "op9": lambda s, d: near_dup.classify(d), "op9_apply": lambda s, d: near_dup.apply(d),
    }
    return out | {f"stage_{n}": lambda s, d, f=f: f(s, d, SF) for n, f in cp.STAGES[:4]} | {f"stage_{n}": lambda s, d, f=f: f(s, d, SF).drop("sequence_id", "offset") for n, f in cp.STAGES[4:]}


OPS = ["op1", "op3", "op4", "op5", "op6", "op8", "op8_apply", "op9", "op9_apply", "stage_quality_rules", "stage_near_duplicates", "stage_pii", "stage_mixing", "stage_packing"]


@pytest.mark.parametrize("name", OPS)
def test_clashing_columns_and_no_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0")
    run = _ops()[name]
    plain = run(spark, docs)
    wide = run(spark, docs.select("*", *[F.lit(f"? {n}").alias(n) for n in NAMES if n not in docs.columns]))
    cols = plain.columns
    assert sorted(map(str, wide.select(*[F.col(f"`{c}`") for c in cols]).collect())) == sorted(map(str, plain.collect()))
    if wide.columns != cols:  # documents in, documents out
        kept = wide.limit(5).collect()
        assert set(NAMES) <= set(wide.columns) and all(r[n] == f"? {n}" for r in kept for n in NAMES)
    assert run(spark, docs.limit(0)).count() == 0


def test_clashing_columns_of_the_others(spark):
    from kelvora.llm import topk, url_filter, warc

    pages, vectors = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/embeddings.parquet")
    extra = lambda df: df.select("*", *[F.lit("?").alias(n) for n in [*NAMES, "sha", "archive", "record", "chunk", "refers_to", "blocked_p"] if n not in df.columns])
    for run in (lambda d: url_filter.judge(d), lambda d: warc.read(warc.write(d))):
        assert sorted(map(str, run(extra(pages)).collect())) == sorted(map(str, run(pages).collect()))
        assert run(pages.limit(0)).count() == 0
    search = lambda d: topk.search(topk.quantised(d).where("vec_id % 100 = 0"), topk.quantised(d))
    assert sorted(search(extra(vectors)).collect()) == sorted(search(vectors).collect())
    assert search(vectors.limit(0)).count() == 0


def test_very_long_texts(spark):
    """A text of 150,000 words, one word of a million characters, and short ones, by plain versions."""
    from kelvora.llm import mixing, near_dup, pii, quality_rules, suffix_dedup, warc

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    long_ = " ".join(rng.choice(words) for _ in range(150_000))
    near = long_.split(" ")
    near[500:700] = ["other"] * 200
    rows = [(1, long_, None, "s", 1), (2, " ".join(near), None, "s", 1), (3, "z" * 1_000_000, None, "s", 1), (4, "a few words", None, "s", 1), (5, None, None, "s", 1)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    text = [(d, t) for d, t, *_ in rows]
    assert sorted(tuple(r) for r in near_dup.classify(df).collect()) == sorted(brute.near_components(text))
    assert sorted(r.doc_id for r in near_dup.apply(df).collect()) == [1, 3, 4, 5]
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert {d: r.n_words for d, r in got.items()} == {d: len(brute.WORD.findall(t or "")) for d, t in text}
    assert got[3].word_chars == 1_000_000 and got[1].kept
    assert {r.doc_id: r.text for r in pii.apply(df).collect()} == {d: brute_pii.pseudonyms(t) for d, t in text}
    assert {r.doc_id: r.size for r in mixing.plan(df).collect()} == {d: len(brute.WORD.findall(t or "")) for d, t in text}
    cut = [(d, t[:30_000] if t else t) for d, t in text]  # as far as the plain count of strings gets
    assert sorted(tuple(r) for r in suffix_dedup.apply(spark.createDataFrame(cut, "doc_id long, text string")).drop("kept").collect()) == sorted(brute.long_repeats(cut))
    whole = {r.doc_id: r for r in suffix_dedup.apply(df).collect()}
    assert whole[3].n_removed == 1_000_000 and whole[1].n_removed > 0.99 * len(long_) and whole[4].n_removed == 0
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r.page_id: r.payload_bytes for r in warc.read(warc.write(pages)).collect()} == {d: len(t or "") for d, t in text}


def test_token_table_lookups(spark):
    from kelvora.llm import token_files
    from kelvora.llm.tokens import default_path, encoder

    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    encode, end = encoder(default_path()), np.array([2], "<u4").tobytes()
    ids = np.frombuffer(b"".join(encode(t) + end for _, t in rows), "<u4")
    shards = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), default_path(), shard_ids=4000)
    places = [0, 1, 17, 4000, 4001, 30_000, len(ids) - 1, len(ids), -1, 17]
    got = {r.place: r.token for r in token_files.access(shards, spark.createDataFrame([(p,) for p in places], "place long")).collect()}
    assert got == {p: int(ids[p]) for p in places if 0 <= p < len(ids)}
    tokens = [2, int(ids[5]), int(ids[99]), 49_999, 70_000]
    count = {r.token: r.n for r in token_files.counts(shards, spark.createDataFrame([(t,) for t in tokens], "token long")).collect()}
    assert count == {t: int((ids == t).sum()) for t in tokens}
    for t in tokens[:2]:
        assert sorted(r.place for r in token_files.occurrences(shards, t).collect()) == np.flatnonzero(ids == t).tolist()


def test_scores_are_exact_whatever_their_size(spark):
    from kelvora.llm import topk

    rows = [(100, [3.0e6, 1.0]), (1, [1.0, 1.0]), (2, [1e12, 1e12]), (3, [-1e12, 1e12]), (4, [1e300, 0.0])]
    whole = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: r.score for r in topk.search(whole.where("vec_id = 100"), whole).collect()}
    q = [int(3e6 * 1024), 1024]
    exact = {i: sum(a * int(1024 * x) for a, x in zip(q, v, strict=True)) for i, v in rows if i != 100}
    assert got == {i: max(-(2**63), min(2**63 - 1, x)) for i, x in exact.items()} and got[1] == 3145729048576


def test_copies_are_documents(spark):
    """A line in more documents of a host than the limit goes, whether they are copies or not, and however it is spaced."""
    from kelvora.llm import quality_rules

    body = "\n".join(" ".join(f"w{i}{j}" for j in range(10)) for i in range(20))
    rows = [(i, f"{body}\nA  common\tline{chr(13) if i % 2 else ''}", None, "h", 1) for i in range(40)]
    rows += [(100 + i, "\n".join(" ".join(f"u{i}{k}{j}" for j in range(10)) for k in range(20)) + "\na common LINE", None, "h", 1) for i in range(10)] + [(200, body, None, "g", 1)]
    told = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert all(told[i].n_lines_removed == 21 and not told[i].kept for i in range(40))
    assert all(told[100 + i].n_lines_removed == 1 and told[100 + i].kept for i in range(10)) and told[200].kept


def test_sketches_lose_no_link():
    """Pairs at the threshold, sets of any size: none is below the floor."""
    from kelvora.llm import near_dup
    from kelvora.llm.shingles import mix64

    rng = np.random.default_rng(11)
    for union in (8, 60, 300, 2000, 6000):
        both, lost = -(-union * 3 // 4), 0
        for _ in range(2000 if union < 2000 else 200):
            own = rng.integers(0, 2**64, union, dtype=np.uint64)
            alone = rng.integers(0, union - both + 1)
            sets, parts = (np.sort(own[: both + alone]), np.sort(np.concatenate([own[:both], own[both + alone :]]))), []
            for x in sets:
                slot = x >> np.uint64(64 - (near_dup.SAMPLES - 1).bit_length())
                least = x[np.append(True, slot[1:] != slot[:-1])]
                parts.append((np.bincount((mix64(least + np.uint64(3)) % np.uint64(near_dup.SKETCH_BITS)).astype(int), minlength=near_dup.SKETCH_BITS) & 1, len(least)))
            odd = int((parts[0][0] ^ parts[1][0]).sum())
            lost += not near_dup.likely(np.array([odd]), np.array([parts[0][1] + parts[1][1]]), np.array([len(sets[0]) + len(sets[1])]))[0][0]
        assert lost == 0, union


def test_trees_on_pages():
    """Held-out accuracy on pages: labels are the rules' own, from urls that the trees have not seen."""
    import re

    from kelvora.llm import url_filter

    urls = [u for (u,) in duckdb.sql("select url from '/root/testdata/sf0.1/pages.parquet' where url is not null order by page_id").fetchall()]
    made = []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        fits = [(r, v) for r, v in url_filter.RULES if m and (m[1] == r.split("/")[0] or m[1].endswith("." + r.split("/")[0])) and m[2].startswith(r[r.index("/") :])]
        if fits:
            made.append((u, int(max(fits, key=lambda x: len(x[0]))[1] == "block")))
    random.Random(1).shuffle(made)
    cut = len(made) * 4 // 5
    p = url_filter.UrlTrees().fit(*zip(*made[:cut], strict=True)).probability([u for u, _ in made[cut:]])
    right = np.mean((p >= 0.5) == np.array([y for _, y in made[cut:]]))
    print("held-out", len(made) - cut, right)
    assert right > 0.9
