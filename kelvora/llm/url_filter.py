"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

The trees are trained on labelled urls (1: block): at most ``TRAIN_ROWS`` of them, those with the smallest hashes, so a
rerun draws the same. Without labels to train on, pages' own rules label the urls they fit. Features are lengths,
depth, digit ratio, entropy, parameter counts and how often urls with the same suffixes were blocked.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees
like any text; rows that repeat are judged alike; without any label the trees allow all; a url of any length is read whole;
a table without rows gives none; extra columns are ignored, whatever their names. Labels can come from any table
(``labelled``: url, blocked).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, FOLDS = 40, 3, 0.2, 32, 5
FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "query_length", "hyphens", "fragment", "labels", "host_digits", "tld_blocked", "domain_blocked", "first_blocked", "last_blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """urls with host, path, rule and its verdict, null where none fits. Rules are parameters, a few; longest first."""
    host, path = host_and_path(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, told in sorted(rules, key=lambda r: len(r[0])):
        of, slash, under = text.partition("/")
        fits = ((F.col("host") == of) | F.col("host").endswith("." + of)) & F.col("path").startswith(slash + under)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(told)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


_PARTS = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$")


def _suffixes(host: str, path: str) -> tuple[str, str, str, str]:
    labels, steps = host.split("."), [s for s in path.split("/") if s]
    last = steps[-1] if steps else ""
    return labels[-1], ".".join(labels[-2:]), steps[0] if steps else "", last.rpartition(".")[2] if "." in last else ("/" if path.endswith("/") else "")


def _lexical(url: str | None) -> tuple[list[float], tuple[str, str, str, str]]:
    url = url or ""
    host, path, query, fragment = (m.groups() if (m := _PARTS.match(url)) else (url, "", None, None))
    query = query or ""
    n = max(1, len(url))
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    plain = [len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / n, entropy, query.count("=") + query.count("&"), len(query), url.count("-"), float(bool(fragment)), host.count(".") + 1, sum(c.isdigit() for c in host)]
    return plain, _suffixes(host.lower(), path)


class UrlTrees:
    """Boosted trees for a yes or no, on binned features; trained on the driver on a bounded sample."""

    def __init__(self) -> None:
        self.rates: list[dict[str, float]] = [{} for _ in range(4)]
        self.base, self.trees, self.edges = -1e9, [], np.zeros((len(FEATURES), 0))

    def features(self, urls: Sequence[str | None]) -> np.ndarray:
        out = np.zeros((len(urls), len(FEATURES)))
        for i, url in enumerate(urls):
            plain, keys = _lexical(url)
            out[i] = plain + [own.get(k, self.mean) for own, k in zip(self.rates, keys, strict=True)]
        return out

    mean = 0.0

    def fit(self, urls: Sequence[str | None], blocked: Sequence[int]) -> UrlTrees:
        y = np.asarray(blocked, float)
        if not len(y) or y.min() == y.max():
            self.base = -1e9 if not len(y) or y[0] == 0 else 1e9
            return self
        self.mean = float(y.mean())
        sums: list[dict] = [defaultdict(lambda: [0.0, 0]) for _ in range(4)]
        for url, label in zip(urls, y, strict=True):
            for own, k in zip(sums, _lexical(url)[1], strict=True):
                own[k][0] += label
                own[k][1] += 1
        drawn = lambda s, n: (s + 10 * self.mean) / (n + 10)  # noqa: E731  to the mean
        self.rates = [{k: drawn(*x) for k, x in own.items()} for own in sums]
        x = self.features(urls)
        # A url learns from rates of the other folds only, or its own label would be among its features.
        fold = np.arange(len(y)) % FOLDS
        for f in range(FOLDS):
            inside: list[dict] = [defaultdict(lambda: [0.0, 0]) for _ in range(4)]
            for i in np.flatnonzero(fold == f):
                for own, k in zip(inside, _lexical(urls[i])[1], strict=True):
                    own[k][0] += y[i]
                    own[k][1] += 1
            for i in np.flatnonzero(fold == f):
                for j, k in enumerate(_lexical(urls[i])[1]):
                    x[i, len(FEATURES) - 4 + j] = drawn(sums[j][k][0] - inside[j][k][0], sums[j][k][1] - inside[j][k][1])
        self.edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
        binned = self._bins(x)
        self.base = math.log(self.mean / (1 - self.mean))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, binned)
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if self.edges.shape[1] else np.zeros(x.shape, int)

    @staticmethod
    def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> dict[int, tuple[int, int] | float]:
        """Nodes by number, children 2n+1 and 2n+2; a split is (feature, bin), a leaf its step."""
        tree: dict[int, tuple[int, int] | float] = {}
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, -1)
            if depth < DEPTH and len(rows) >= 20:
                for f in range(x.shape[1]):
                    left_g, left_h = (np.cumsum(np.bincount(x[rows, f], w[rows], BINS)) for w in (g, h))
                    gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                    gain[(left_h < 1e-3) | (hs - left_h < 1e-3)] = 0
                    if gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                tree[node] = float(RATE * gs / (hs + 1))
                continue
            tree[node] = best[1:]
            goes = x[rows, best[1]] <= best[2]
            todo += [(2 * node + 1, rows[goes], depth + 1), (2 * node + 2, rows[~goes], depth + 1)]
        return tree

    @staticmethod
    def _walk(tree: dict, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            for node in np.unique(at):
                if isinstance(split := tree[int(node)], tuple):
                    own = np.flatnonzero(at == node)
                    at[own] = 2 * node + 1 + (x[own, split[0]] > split[1])
        return np.array([tree[n] for n in range(2 ** (DEPTH + 1)) if not isinstance(tree.get(n, ()), tuple)])[np.searchsorted([n for n in sorted(tree) if not isinstance(tree[n], tuple)], at)]

    def probability(self, urls: Sequence[str | None]) -> np.ndarray:
        if not self.trees:
            return np.full(len(urls), float(self.base > 0))
        x = self._bins(self.features(urls))
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._walk(tree, x)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> UrlTrees:
    """From (url, blocked 0/1): at most ``rows`` of them, those with the smallest hashes. Hashes that can't be among the
    smallest are left where they are read, so that what tasks send grows with the sample and not with the table."""
    own = labelled.where(F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("int").alias("blocked"), F.xxhash64("url").alias("hash"))
    least = lambda df: df.orderBy("hash", "url", "blocked").limit(rows).collect()
    n = own.count()
    near = 2 * rows / max(1, n)
    sample = least(own.where(F.col("hash") < int(-(2**63) + 2**64 * near))) if near < 1 else least(own)
    if len(sample) < min(rows, n):  # urls that repeat very often have large hashes
        sample = least(own)
    return UrlTrees().fit([r["url"] for r in sample], [r["blocked"] for r in sample])


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """(the id column first, host, path, rule, verdict, blocked_p) from (id, url)."""
    told = ruled(urls, rules)
    if labelled is None:
        labelled = told.where(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "block").cast("int").alias("blocked"))
    trees = train(labelled, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.probability(batch.column(batch.schema.get_field_index("url")).to_pylist())
            names = batch.schema.names
            verdict = [r if r is not None else "block" if x >= 0.5 else "allow" for r, x in zip(batch.column(names.index("ruled")).to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(names.index(n)) for n in ("host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(p, pa.float64())], [names[0], "host", "path", "rule", "verdict", "blocked_p"])

    key = urls.columns[0]
    fields = f"`{key}` {urls.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, blocked_p double"
    return told.select(key, "url", "host", "path", "rule", "ruled").mapInArrow(score, fields)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
