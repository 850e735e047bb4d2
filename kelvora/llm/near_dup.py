"""MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of five words. Documents of equal sets are one class. Every class has MinHash
samples, banded for candidates, and an odd sketch: the least shingle of each of SAMPLES ranges of hashes flips a bit of a
bitmap, so that the XOR of two bitmaps counts the samples in which the sets differ, most precisely where similarity is
high. Candidates whose sketches are far from the threshold go; the others are confirmed on their full sets, so a link is
never taken from a sketch.

No bucket is expanded into its pairs. In two rounds every class is held against one hub: of the classes that lead its
buckets and belong to another component, the one whose bands are the most crowded, which in a group of copies is the text
they were made from. That is a pair a class at most. Only buckets that then still hold several components are searched
on, block against block. Blocks of one component are never held against each other; sketches tell which classes of two
blocks may be linked, those get their full sets, and a block pair confirms its candidates by itself, likeliest first and
only until their components are joined. So it emits links, at most one fewer than it holds components, and never pairs.

BANDS bands of ROWS samples miss a pair of similarity 0.75 with a probability of (1 - 0.75**3)**28, or 2e-7; a sketch's
floor is SIGMAS standard deviations of its estimate below the threshold, at every size of set.

Defined results: null or empty texts and texts without words have an empty set, are linked with nothing and are their
own component; rows that repeat are one class and all have the smallest doc_id; null doc_ids come last and are a
component only where all ids of it are null; a table without rows gives none; a very long text is one set like others.
Extra columns are ignored by ``classify`` and kept by ``apply``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table, unused
from kelvora.llm.components import components
from kelvora.llm.shingles import mix64, shingle_sets, slices, trimmed

SHARE = (75, 100)
BANDS, ROWS = 28, 3
SAMPLES, SKETCH_BITS = 2048, 2048
SIGMAS = 7
#: Samples that a pair may have lost to others of their range, besides.
SLACK = 2
#: Classes of a bucket that are compared as one block, and the bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Pairs whose sets are held at a time.
VERIFIED_ROWS = 512
HUB_ROUNDS = 2
_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_SIGNATURE = "doc_id bigint, th bigint, n_shingles bigint, node binary, bands array<bigint>, samples int, sketch binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in slices(batch.column(2)):
            sets, first = shingle_sets(data, offsets)
            n = np.diff(first)
            some = np.flatnonzero(n)
            samples = np.zeros((len(some), BANDS * ROWS), np.uint64)
            nodes = np.zeros((len(n), 2), np.uint64)
            if len(some):
                begin = first[:-1][some]
                for k in range(BANDS * ROWS):
                    samples[:, k] = np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], begin)
                nodes[some, 0] = np.add.reduceat(mix64(sets + np.uint64(1)), begin)
                nodes[some, 1] = np.bitwise_xor.reduceat(mix64(sets + np.uint64(2)), begin) + n[some].astype(np.uint64)
            mixed = mix64(samples ^ _ADD)
            keys = np.zeros((len(some), BANDS), np.uint64)
            for k in range(BANDS):
                a, b, c = (mixed[:, k * ROWS + j] for j in range(ROWS))
                keys[:, k] = mix64(a * np.uint64(3) + b * np.uint64(5) + c * np.uint64(7) + np.uint64(k))
            row_of = np.repeat(np.arange(len(n)), n)
            slot = row_of * SAMPLES + (sets >> np.uint64(64 - (SAMPLES - 1).bit_length())).astype(np.int64)
            least = np.ones(len(sets), bool)
            least[1:] = slot[1:] != slot[:-1]  # sets are in order, so the first of a range is its least
            sample_row = row_of[least]
            bits = np.bincount(sample_row * SKETCH_BITS + (mix64(sets[least] + np.uint64(3)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=len(n) * SKETCH_BITS) & 1
            sketch = np.packbits(bits.astype(bool).reshape(len(n), SKETCH_BITS), axis=1)
            listed = lambda x, w: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, w, 0))]).astype(np.int32)), pa.array(x.view(np.int64).ravel()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[row:end], batch.column(1)[row:end], pa.array(n, pa.int64()), pa.array([x.tobytes() for x in nodes], pa.binary()), listed(keys, BANDS), pa.array(np.bincount(sample_row, minlength=len(n)), pa.int32()), pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["doc_id", "th", "n_shingles", "node", "bands", "samples", "sketch"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells rows of one doc_id apart, and the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """A row per document: the size and 128-bit hash of its set, the bands' keys and the odd sketch."""
    return _keyed(docs).mapInArrow(trimmed(_signatures), _SIGNATURE)


def likely(odd: np.ndarray, samples: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a pair may be a link, its estimated similarity) from the odd bits of its sketches' XOR and the sums of its
    samples and sizes. Samples in common are half of what remains of the sum without the difference. At the threshold the
    union has sizes / 1.75 shingles and fills ``whole`` ranges; the common samples spread as that many draws, and the
    difference as a count of odd bits does."""
    m, share = SKETCH_BITS, SHARE[0] / SHARE[1]
    both = (samples + m / 2 * np.log(np.maximum(1e-9, 1 - 2 * odd / m))) / 2
    whole = SAMPLES * (1 - (1 - 1 / SAMPLES) ** (sizes / (1 + share)))
    differ = np.maximum(0, samples - 2 * share * whole)
    spread = np.sqrt(share * (1 - share) * whole + np.maximum(0, m / 4 * np.expm1(4 * differ / m) - differ) / 4)
    return both + SLACK >= share * whole - SIGMAS * spread, both / np.maximum(whole, 1)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and len(b) > 0 and SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(x)).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for x in ("ka", "kb"))
        na, nb, sa, sb = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("na", "nb", "sa", "sb"))
        fine = likely(np.bitwise_count(a ^ b).sum(1, dtype=np.int64), sa + sb, na + nb)[0] & (SHARE[1] * np.minimum(na, nb) >= SHARE[0] * np.maximum(na, nb))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)) for x in ("a", "b")], ["a", "b"]).filter(pa.array(fine))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, VERIFIED_ROWS) for b in batches for at in range(0, b.num_rows, VERIFIED_ROWS)):
        sides = [batch.column(batch.schema.get_field_index(x)) for x in ("set_a", "set_b")]
        linked = [_linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in both)) for both in zip(*sides, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are links by their full sets. sets: (node, set), one row per node."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(trimmed(_verified), "a binary, b binary")


_SIDE = ("node", "label", "n", "samples", "sketch", "bands")


def _side(rows: pa.Array) -> tuple[np.ndarray, ...]:
    """(nodes, labels, sizes, samples, sketches, bands) of a block."""
    node, label = (np.array(rows.field(x).to_pylist(), object) for x in ("node", "label"))
    sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint64).reshape(len(rows), -1)
    return node, label, rows.field("n").to_numpy(), rows.field("samples").to_numpy(), sketch, rows.field("bands").flatten().to_numpy().reshape(len(rows), -1)


def _candidates(one: tuple, two: tuple, same: bool, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in one, place in two, estimate) of pairs of different components that may be links. A pair is told in the first
    band that its classes share."""
    (_, la, sa, ma, ka, ba), (_, lb, sb, mb, kb, bb) = one, two
    found: list[tuple[np.ndarray, ...]] = []
    for j in range(len(la)):
        hit = (lb != la[j]) & (SHARE[1] * np.minimum(sb, sa[j]) >= SHARE[0] * np.maximum(sb, sa[j])) & ~(bb[:, :band] == ba[j, :band]).any(1)
        if same:
            hit[: j + 1] = False
        at = np.flatnonzero(hit)
        fine, share = likely(np.bitwise_count(kb[at] ^ ka[j]).sum(1, dtype=np.int64), mb[at] + ma[j], sb[at] + sa[j])
        if fine.any():
            found.append((np.full(int(fine.sum()), j), at[fine], share[fine]))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


_CELL = "key bigint, x string, y string"


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of a cell, a block of a bucket against a block, that have a candidate in it."""
    for batch in batches:
        for i in range(batch.num_rows):
            key, x, y, band = (batch.column(k)[i].as_py() for k in (0, 1, 2, 5))
            one, two = (_side(batch.column(k)[i].values) for k in (3, 4))
            a, b, _ = _candidates(one, two, x == y, band)
            nodes = [(n, 0) for n in one[0][np.unique(a)]] + [(n, 1) for n in two[0][np.unique(b)]]
            if nodes:
                n = len(nodes)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([x] * n), pa.array([y] * n), pa.array([band] * n, pa.int32()), pa.array([s for _, s in nodes], pa.int32()), pa.array([m for m, _ in nodes], pa.binary())], ["key", "x", "y", "band", "side", "node"])


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the components of a cell: candidates by estimate, each on its full sets, until their components are one."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, band = batch.column(0)[i].values, batch.column(1)[i].as_py()
            side = rows.field("side").to_numpy()
            parts = [rows.filter(pa.array(side == k)) for k in (0, 1)]
            if not all(map(len, parts)):
                continue
            one, two = map(_side, parts)
            sets = [[np.frombuffer(s.as_buffer(), np.uint64) for s in p.field("set")] for p in parts]
            up: dict = {}

            def root(x, up=up):
                while up.get(x, x) != x:
                    x = up[x]
                return x

            a, b, share = _candidates(one, two, False, band)
            links = []
            for k in np.argsort(-share, kind="stable"):
                ra, rb = root(one[1][a[k]]), root(two[1][b[k]])
                if ra != rb and _linked(sets[0][a[k]], sets[1][b[k]]):
                    up[ra] = rb
                    links.append((one[0][a[k]], two[0][b[k]]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], ["a", "b"])


def _blocks(members: DataFrame) -> DataFrame:
    """(key, x, band, whole, rows) of members (key, band, _SIDE): a component of BLOCK classes in a bucket has blocks of its
    own (whole: its label), the others share theirs; classes are dealt by hash, so a block is about BLOCK classes."""
    per = members.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("words"))
    per = per.withColumn("whole", F.when(F.col("c") >= BLOCK, F.hex("label")).otherwise(F.lit("")))
    sizes = per.groupBy("key", "whole").agg(F.greatest(F.ceil(F.sum("c") / F.lit(BLOCK)), F.ceil(F.sum("words") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    dealt = members.join(per.select("key", "label", "whole"), ["key", "label"]).join(sizes, ["key", "whole"])
    x = F.concat_ws("/", "whole", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("string"))
    return dealt.withColumn("x", x).groupBy("key", "x").agg(F.first("whole").alias("whole"), F.first("band").alias("band"), F.collect_list(F.struct(*_SIDE)).alias("rows"))


def _cells(blocks: DataFrame) -> DataFrame:
    """(key, x, y, one, two, band), a row per pair of blocks of a bucket that isn't of one component."""
    names = blocks.groupBy("key").agg(F.collect_list(F.struct("x", "whole")).alias("others"))
    own = blocks.join(names, "key").select("key", "x", "whole", "band", "rows", F.explode("others").alias("o")).where((F.col("o.whole") != F.col("whole")) | (F.col("whole") == ""))
    one = own.where("x <= o.x").select("key", "x", F.col("o.x").alias("y"), "band", F.col("rows").alias("one"))
    two = own.where("o.x <= x").select("key", F.col("o.x").alias("x"), F.col("x").alias("y"), F.col("rows").alias("two"))
    return one.join(two, ["key", "x", "y"]).select("key", "x", "y", "one", "two", "band")


def _relabelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label, crowd, held) of the classes that share a bucket."""
    if labels is None:
        return buckets.select("node", F.col("node").alias("label"), "crowd", "held")
    return buckets.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "crowd", "held")


def _hub_pairs(told: DataFrame, seen: DataFrame | None) -> DataFrame:
    """(a hub, b class): for each class the most crowded leader of its buckets that is of another component and new to it."""
    keyed = told.select("node", "label", "crowd", F.explode("held").alias("h")).select("node", "label", "crowd", F.col("h.key").alias("key"))
    leads = keyed.groupBy("key").agg(F.max(F.struct("crowd", "node", "label")).alias("hub"))
    met = keyed.join(leads, "key").where("label != hub.label").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.crowd").alias("crowd"))
    if seen is not None:
        met = met.join(seen, ["a", "b"], "left_anti")
    return met.groupBy("b").agg(F.max(F.struct("crowd", "a"))["a"].alias("a")).select("a", "b")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, label, component_id, kept), a row per document; label tells its component."""
    signed = materialise(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("rep")
    classes = materialise(
        signed.where("n_shingles > 0").groupBy("node").agg(first, *[F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("bands", "bands"), ("samples", "samples"), ("sketch", "sketch"))])
        .select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("rep_th"), "n", "bands", "samples", "sketch"),
        "classes",
    )
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    crowds = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = materialise(keys.join(crowds, "key").groupBy("node").agg(F.round(F.sum(F.log2("m")), 6).alias("crowd"), F.collect_list(F.struct("key", "band")).alias("held")), "buckets")
    # Only texts of classes that stand in a shared bucket go on: one document's for each, told by its own set.
    wanted = buckets.select("node").join(classes.select("node", "rep", "rep_th"), "node").select(F.col("rep"), F.col("rep_th").alias("th")).distinct()
    held = _semi(_keyed(docs), wanted)
    sets = materialise(_own_sets(held).groupBy("node").agg(F.first("set").alias("set")), "sets")
    sized = classes.select("node", "n", "samples", "sketch")
    links = labels = seen = None
    for _ in range(HUB_ROUNDS):
        pairs = materialise(_hub_pairs(_relabelled(buckets, labels), seen), "hubs")
        both = pairs.join(sized.toDF("a", "na", "sa", "ka"), "a").join(sized.toDF("b", "nb", "sb", "kb"), "b")
        late = materialise(verified(both.mapInArrow(_likely, "a binary, b binary"), sets), "links")
        links, seen = (late, pairs) if links is None else (links.union(late), seen.union(pairs))
        labels = components(links)
    # What is left to see: candidates of one bucket in different components.
    told = _relabelled(buckets, labels).select("node", "label", F.explode("held").alias("h")).select("node", "label", "h.key", "h.band")
    mixed = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    members = told.join(mixed, "key").join(classes.select("node", "n", "samples", "sketch", "bands"), "node").select("key", "band", *_SIDE)
    cells = _cells(materialise(_blocks(members), "blocks")).select("key", "x", "y", "one", "two", "band")
    some = materialise(cells.mapInArrow(trimmed(_may_link), f"{_CELL}, band int, side int, node binary"), "candidates")
    full = some.join(classes.select("node", "n", "samples", "sketch", "bands"), "node").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")).join(sets, "node")
    grouped = full.groupBy("key", "x", "y").agg(F.collect_list(F.struct(*_SIDE, "side", "set")).alias("rows"), F.first("band").alias("band"))
    late = materialise(grouped.select("rows", "band").mapInArrow(trimmed(_joining), "a binary, b binary"), "links")
    if late.limit(1).count():
        labels = components(links.union(late))
    found = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_node = found.join(found.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("node", "label", "component_id")
    # Copies may be a third of all rows; one row per class on the other side lets Spark split them.
    own = signed.where("n_shingles > 0").select("doc_id", "th", "n_shingles", "node").join(by_node, "node").select("doc_id", "th", "n_shingles", "label", "component_id")
    none = signed.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("component_id"))
    return own.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _semi(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (doc_id, th, ..) whose id and hash are in wanted (rep, th)."""
    other = wanted.toDF("rep", "rep_th")
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th")), "left_semi")


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per document."""
    return _rows(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _own_sets(docs: DataFrame) -> DataFrame:
    """(node, set) of documents (.., text): a set is its shingles' hashes in ascending order, 8 bytes each."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets, first = shingle_sets(data, offsets)
                nodes, own_sets = [], []
                for a, b in zip(first, first[1:], strict=False):
                    own = sets[a:b]
                    x = np.array([np.add.reduce(mix64(own + np.uint64(1))), np.bitwise_xor.reduce(mix64(own + np.uint64(2))) + np.uint64(len(own))], np.uint64) if len(own) else np.zeros(2, np.uint64)
                    nodes.append(x.tobytes())
                    own_sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(own_sets, pa.binary())], ["node", "set"])

    return docs.select("text").mapInArrow(trimmed(tell), "node binary, set binary")


def apply(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with the columns of docs. Of rows that repeat one
    stays; documents without words stay."""
    told = _rows(docs).where("kept").groupBy("doc_id", F.coalesce("label", F.unhex(F.hex("th"))).alias("label")).agg(F.min("th").alias("th"))
    keys = [unused(docs, x) for x in ("kept_id", "kept_null", "kept_text")]
    of = lambda: (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.col("doc_id").isNull())
    names = told.select(*[c.alias(k) for c, k in zip((*of(), F.col("th")), keys, strict=True)]).distinct()
    marked = docs.select("*", *[c.alias(k) for c, k in zip((*of(), F.xxhash64(F.coalesce("text", F.lit("")))), keys, strict=True)])
    # Both steps are by the same keys, so documents move once.
    return marked.join(names, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
