"""Repeats, near-duplicates, quality rules, mixing and the pipeline against plain versions."""

from __future__ import annotations

import random

import brute
import brute_pii
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(300).split(), say(90)
    out = [None, "", " \n\t", "one", "two words", "Two  WORDS", "a a a a", "a" * 900, "ab" * 700, "x" * 399, "x" * 400, "é" * 450, passage, passage[:400], passage[1:401]]
    out += [f"{say(rng.randint(0, 40))} {passage} {say(rng.randint(0, 40))}" for _ in range(30)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 14)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    out += [" ".join(base)] * 4 + [" ".join(base[:60]), " ".join(base[:70]), " ".join(base[:75]), " ".join(base[:80])]
    rows = [(5000 + i, t, None, None if i % 3 else "s", None) for i, t in enumerate(out)]
    return [*rows, rows[-1], rows[20]]


@pytest.mark.parametrize(("batch_rows", "group"), [(3, 1000), (2, 12), (32, 2)])
def test_long_repeats(spark, documents, odd, batch_rows, group):
    """Families of many levels, grams that are split, and splits down to single strings; workers see these sizes."""
    from kelvora.llm import suffix_dedup

    rows = documents[:60] + odd
    got = sorted(tuple(r) for r in suffix_dedup.apply(spark.createDataFrame(rows, DOC), batch_rows, group).drop("kept").collect())
    assert got == sorted(brute.long_repeats([r[:2] for r in rows]))


def test_split_of_a_hot_passage(spark, monkeypatch):
    """One passage in every document, between words of their own: groups are split until none is above the bound, and what
    the last split leaves is settled by counting."""
    from kelvora.llm import suffix_dedup as sd

    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, ends = say(520), [say(40) for _ in range(3)]
    rows = [(i, say(rng.randint(0, 300)) + rng.choice(ends)[rng.randint(0, 40) :] + passage[rng.randint(0, 5) :] + say(rng.randint(0, 300))) for i in range(80)]
    sizes, put = [], sd._split

    def watched(contexts, group):
        out, done = put(contexts, group)
        sizes.extend(r["count"] for r in out.groupBy("key").count().collect())
        return out, done

    monkeypatch.setattr(sd, "_split", watched)
    got = sorted(tuple(r) for r in sd.apply(spark.createDataFrame(rows, "doc_id long, text string"), 4, 8).drop("kept").collect())
    assert got == sorted(brute.long_repeats(rows))
    assert sizes and max(sizes) <= 8


def test_index_of_batches(spark, documents, odd):
    """What three batches say, together, is what all documents say at once."""
    from collections import defaultdict

    from kelvora.llm import suffix_dedup

    rows = documents[:40] + odd
    index, spans = suffix_dedup.Index(spark), defaultdict(list)
    index.LEVEL_ROWS = 64
    for k in range(3):
        batch = rows[k::3]
        df = spark.createDataFrame(batch, DOC)
        hashes = {(r.doc_id, r.text): r.h for r in suffix_dedup._keyed(df).collect()}
        for r in index.add(df).collect():
            spans[r.doc_id, r.h] += [(x.a, x.b) for x in r.ranges]
        so_far = [x for j in range(k + 1) for x in rows[j::3]]
        hashes |= {(r.doc_id, r.text): r.h for r in suffix_dedup._keyed(spark.createDataFrame(so_far, DOC)).collect()}
        want = brute.long_repeats([x[:2] for x in so_far])
        for (d, t, *_), w in zip(so_far, want, strict=True):
            own = suffix_dedup._spans(spans[d, hashes[d, t or ""]])
            assert (sum(b - a for a, b in own), len(own)) == w[2:4], (k, d)
    assert 0 < len(index.levels) <= 3
    again = suffix_dedup.Index(spark, index.levels)
    assert again.add(spark.createDataFrame([(1, "nothing of this is old", None, None, None)], DOC)).count() == 0


def test_family_of_many_batches():
    import numpy as np
    from kelvora.llm import suffix_dedup as sd

    rng = random.Random(8)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    docs = [text[a : a + rng.randint(450, 900)] + bytes(rng.choice(b"xyz") for _ in range(200)) for a in (rng.randint(0, 2000) for _ in range(40))]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    row, pos, begin, stop, *_ = sd.anchors_of(data, offsets)
    family, batch = sd.Family(), 16
    for a in range(0, len(row), batch):
        cut = range(a, min(len(row), a + batch))
        right, left = np.zeros((len(cut), sd.LENGTH), np.uint8), np.zeros((len(cut), sd.REACH), np.uint8)
        for k, i in enumerate(cut):
            d = np.frombuffer(docs[row[i]], np.uint8)
            right[k, : stop[i] - pos[i]], left[k, : pos[i] - begin[i]] = d[pos[i] : stop[i]], d[begin[i] : pos[i]][::-1]
        own = np.array(list(cut))
        family.add(sd.Level(right, left, (stop - pos)[own], (pos - begin)[own], np.stack([own, own], 1), np.zeros((len(own), sd.REACH + 1), bool)))
    assert len(family.levels) <= 8 and all(k <= 8 for k in family.levels)
    gone = [bytearray(len(d)) for d in docs]
    for level in family.levels.values():
        assert (np.diff(level.right[level.suffixes].view(f"S{sd.LENGTH}").ravel().argsort(kind="stable")) == 1).all()
        for (name, _), marks in zip(level.names, level.marks, strict=True):
            for d in np.flatnonzero(marks):
                gone[row[name]][pos[name] - d : pos[name] - d + sd.LENGTH] = b"\1" * sd.LENGTH
    want = brute.long_repeats([(i, d.decode()) for i, d in enumerate(docs)])
    assert [sum(g) for g in gone] == [w[2] for w in want]


def test_near_duplicates(spark, documents, odd):
    from kelvora.llm import near_dup

    rows = documents + odd
    near_dup.BLOCK, was = 3, near_dup.BLOCK
    df = spark.createDataFrame(rows, DOC)
    got = sorted(tuple(r) for r in near_dup.classify(df).drop("node").collect())
    near_dup.BLOCK = was
    want = sorted(brute.near_components([r[:2] for r in rows]))
    assert got == want
    kept = [r.doc_id for r in near_dup.apply(df).collect()]
    assert sorted(kept) == sorted({w[0] for w in want if w[3]})
    assert near_dup.apply(df).columns == df.columns


def test_second_search_finds_what_the_first_misses(spark):
    """A chain: neighbours are links, its ends are far from the bucket's first class."""
    from kelvora.llm import near_dup

    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(34)]
    got = sorted(tuple(r) for r in near_dup.classify(spark.createDataFrame(rows, "doc_id long, text string")).drop("node").collect())
    assert got == sorted(brute.near_components(rows))


def test_components(spark):
    from kelvora.llm.components import components

    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 150)}


def test_quality_rules_are_the_plain_ones(spark, documents, odd):
    from kelvora.llm import quality_rules

    rows = documents + odd
    want = brute.quality([(d, t, s) for d, t, _, s, _ in rows])
    got = quality_rules.judge(spark.createDataFrame(rows, DOC)).drop("text_hash", "n_lines_removed", "share_left", "frequent", "host").collect()
    assert sorted(tuple(r) for r in got) == sorted((d, *want[d, t, s][:7]) for d, t, _, s, _ in rows)


def test_quality_rules_handle_odd_rows(spark, odd):
    from kelvora.llm import quality_rules

    boiler = [(8000 + i, "Subscribe to our newsletter now\n" * 2 + "w%d" % i, None, "h", 1) for i in range(30)]
    long_ = [(9000, "\n".join(" ".join(f"w{i}{j}" for j in range(10)) for i in range(60)) + "\nSubscribe to  our newsletter NOW", None, "h", 1)]
    df = spark.createDataFrame(odd + boiler + long_, DOC)
    told = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert quality_rules.judge(df).count() == len(odd + boiler + long_)
    assert all(told[8000 + i].n_lines_removed == 2 and not told[8000 + i].kept for i in range(30))
    assert told[9000].kept and told[9000].n_lines_removed == 1
    assert told[5000].n_words == 0 and told[5000].base_failed
    kept = {r.doc_id: r.text for r in quality_rules.apply(df).collect()}
    assert "newsletter" not in kept[9000] and 5000 not in kept and quality_rules.apply(df).columns == df.columns
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_mixing_handles_odd_rows(spark, odd):
    from kelvora.llm import mixing
    from pyspark.sql import functions as F

    rows = odd + [(9000 + i, "one two three", None, f"s{i % 4}", 3) for i in range(2000)]
    df = spark.createDataFrame(rows, DOC)
    plan = mixing.plan(df)
    assert plan.count() == len(rows)
    per = plan.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("got")).collect()
    total = sum(r.n for r in per)
    assert sum(r.t for r in per) == pytest.approx(1.5 * total) and all(r.t <= 2 * r.n + 1e-9 for r in per)
    assert all(abs(r.got - r.t) < 0.15 * r.t + 300 for r in per)
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == mixing.mix(df).count()
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline(spark, documents):
    from collections import Counter

    import corpus_pipeline
    from kelvora.llm import mixing
    from kelvora.llm.tokens import default_path, encoder

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != "packing":
            assert out.columns == docs.columns
            seen[name] = out.collect()
    told = brute.quality([(d, t, s) for d, t, _, s, _ in documents])
    assert sorted((r.doc_id, r.text) for r in seen["quality_rules"]) == sorted((k[0], v[7]) for k, v in told.items() if v[6])
    rows = [tuple(r)[:2] for r in seen["quality_rules"]]
    want = [x[0] for x in brute.near_components(rows) if x[3]]
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(want)
    assert sorted((r.doc_id, r.text) for r in seen["pii"]) == sorted((r.doc_id, brute_pii.pseudonyms(r.text)) for r in seen["near_duplicates"])
    assert {r.doc_id for r in seen["mixing"]} <= set(want)
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen["mixing"]}
    encode, copies, held = encoder(default_path()), Counter((r.doc_id, r.text) for r in seen["mixing"]), Counter()
    size = {k: len(brute.WORD.findall(k[1] or "")) for k in copies}
    rates = {(r.doc_id, r.text): r for r in mixing.plan(docs.sparkSession.createDataFrame(seen["pii"], docs.schema)).collect()}
    assert {k: r.copies for k, r in rates.items() if r.copies} == dict(copies) and all(rates[k].size == n for k, n in size.items())
    for r in pieces:
        held[r.doc_id] += r.length
    assert held == sum((Counter({d: k * (len(encode(t)) // 4 + 1)}) for (d, t), k in copies.items()), Counter())
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(pieces)


@pytest.mark.parametrize("name", ["op3_mixing", "op7_topk", "op8_quality_rules", "op10_warc"])
def test_sql(spark, name):
    from kelvora.llm import queries as q

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = q.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))
