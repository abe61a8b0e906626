"""URL filters: host and path rules first, gradient-boosted trees for the rest.

URLs that a rule decides are the labelled ones.  The trees learn from lexical
features (length, depth, digit ratio, entropy, parameter counts, statistics of
the host's suffixes) of a bounded sample of them and judge what no rule fits.
How many URLs were blocked below each suffix is counted over all of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, discard, hashed_sample, materialise

MAX_TRAINING_ROWS = 20_000
SALTS = 64
SUFFIXES = 3  # the last one, two and three labels of a host

# Rules of the query (fixed values): verdict and rule, a host and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    has = url.isNotNull() & (at > 0)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def with_rules(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """Adds ``host, path, rule, rule_verdict``; the longest rule that fits wins (ties: the first listed)."""
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def suffixes(host: Column) -> Column:
    """``array<string>``: the host's last labels, one up to ``SUFFIXES`` of them."""
    labels = F.split(host, r"\.")
    count = F.least(F.size(labels), F.lit(SUFFIXES))
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))


def suffix_statistics(ruled: DataFrame) -> DataFrame:
    """``suffix, bad, seen``: blocked and all distinct URLs that a rule decided, over every host that ends so."""
    decided = ruled.where("rule_verdict is not null").select("url", "host", (F.col("rule_verdict") == "block").cast("long").alias("y")).distinct()
    return decided.select(F.explode(suffixes(F.col("host"))).alias("suffix"), "y").groupBy("suffix").agg(F.sum("y").alias("bad"), F.count("*").alias("seen"))


def host_statistics(hosts: DataFrame, statistics: DataFrame) -> DataFrame:
    """``host, stats array<bigint>``: for each distinct host the bad and seen of its suffixes in turn, 0 where unknown."""
    parts = hosts.select("host").distinct().select("host", F.posexplode(suffixes(F.col("host"))).alias("at", "suffix"))
    known = parts.join(statistics, "suffix", "left")
    value = lambda k, name: F.coalesce(F.max(F.when(F.col("at") == k, F.col(name))), F.lit(0).cast("bigint"))
    pairs = known.groupBy("host").agg(*(value(k, name).alias(f"{name}{k}") for k in range(SUFFIXES) for name in ("bad", "seen")))
    return pairs.select("host", F.array(*(f"{name}{k}" for k in range(SUFFIXES) for name in ("bad", "seen"))).alias("stats"))


def lexical_features(url: str, host: str, path: str, stats: list[int], prior: float, own: int | None = None) -> list[float]:
    """``stats``: blocked and seen URLs of the host's suffixes.  ``own``: the row's own label (1 block), taken out of them while training."""
    n = max(1, len(url))
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    query = url.partition("?")[2].partition("#")[0]
    parameters = [p for p in query.split("&") if p]
    rates = []
    for bad, seen in zip(stats[::2], stats[1::2], strict=True):
        if own is not None and seen:
            bad, seen = bad - own, seen - 1
        rates += [(bad + 4 * prior) / (seen + 4), math.log1p(seen)]
    digits = sum(c.isdigit() for c in url)
    segments = [s for s in path.split("/") if s]
    return [
        math.log1p(len(url)), float(len(segments)), digits / n, entropy, float(len(parameters)), float(len(query)),
        float(host.count(".")), float(host.count("-")), float(len(host)), float("#" in url), float(path.endswith("/")),
        float(url.startswith("https")), sum(c.isdigit() for c in host) / max(1, len(host)), float(max(map(len, segments), default=0)), *rates,
    ]


@dataclass
class Trees:
    """Boosted trees of depth ``depth`` over quantile bins; each is arrays of feature, threshold and leaf values."""

    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss.  Without rows, or with one class, the prior alone judges."""
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(float(np.log(mean / (1 - mean))), [], depth)
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.prior)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(len(y), np.int64)
        for n in range(inner):
            here = np.flatnonzero(node == n)
            best = 1e-9
            if len(here) > 1:
                whole = g[here].sum() ** 2 / (h[here].sum() + penalty)
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.bincount(binned[here, k], g[here], len(c) + 1).cumsum()
                    hs = np.bincount(binned[here, k], h[here], len(c) + 1).cumsum()
                    gain = gs[:-1] ** 2 / (hs[:-1] + penalty) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + penalty) - whole
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, feature[n], threshold[n], cut[n] = float(gain[at]), k, c[at], at
            node[here] = 2 * n + 1 + (binned[here, feature[n]] > cut[n])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        model.trees.append((feature, threshold, value))
        margin += value[leaf]
    return model


@dataclass
class UrlModel:
    trees: Trees
    statistics: DataFrame  # suffix, bad, seen
    prior: float

    def block(self, rows: list[tuple[str, str, str, list[int]]]) -> np.ndarray:
        return blocks(self.trees, self.prior, rows)


def blocks(trees: Trees, prior: float, rows: list[tuple[str, str, str, list[int]]]) -> np.ndarray:
    """Whether to block each ``url, host, path, stats``."""
    if not rows:
        return np.zeros(0, bool)
    return trees.margin(np.array([lexical_features(*row, prior) for row in rows])) > 0


def fit_urls(ruled: DataFrame, url_col: str = "url", max_rows: int = MAX_TRAINING_ROWS) -> UrlModel:
    """Trees from at most ``max_rows`` distinct URLs that a rule decided, those of smallest hash; suffixes are counted over all."""
    ruled = ruled.withColumn("url", F.col(url_col))
    statistics = materialise(suffix_statistics(ruled), "url-suffixes")
    decided = ruled.where("rule_verdict is not null").select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("y")).distinct()
    chosen = materialise(hashed_sample(decided, "url", max_rows), "url-sample")
    sample = chosen.join(host_statistics(chosen, statistics), "host").toPandas().sort_values("url")
    discard(chosen)
    y = sample["y"].to_numpy(np.float64)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    x = [lexical_features(r.url, r.host, r.path, list(r.stats), prior, int(r.y)) for r in sample.itertuples()]
    return UrlModel(fit_trees(np.array(x).reshape(len(y), -1 if len(y) else 1), y), statistics, prior)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for each row.

    A null URL, or one without ``://``, has an empty host and path, fits no rule
    and is judged by the trees on what text there is.  Repeated rows repeat; with
    no labelled URLs at all everything without a rule is allowed.
    """
    ruled = with_rules(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules)
    model = fit_urls(ruled, "url", max_rows)
    trees, prior = model.trees, model.prior
    left = ruled.where("rule_verdict is null").select("id", "url", "host", "path")
    # a host of many pages is dealt to as many tasks; each has the host's one row
    salted = left.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    hosts = host_statistics(left, model.statistics).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = salted.join(hosts, ["host", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, host, path, stats = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            bad = blocks(trees, prior, [(u or "", h, p, s) for u, h, p, s in zip(url, host, path, stats, strict=True)])
            verdict = pa.array(np.where(bad, "block", "allow").tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.nulls(batch.num_rows, pa.string()), verdict], names=["id", "host", "path", "rule", "verdict"])

    kind = ruled.schema["id"].dataType.simpleString()
    judged = left.select("id", "url", "host", "path", "stats").mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    decided = ruled.where("rule_verdict is not null").select("id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"))
    return decided.unionByName(judged).withColumnRenamed("id", id_col)
