"""URL filters: policy rules, and boosted trees on lexical features for the URLs that no rule fits (operator 4).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#``
or the end; null or no ``://``: both empty. A rule (host, path) fits its host and all subdomains if the URL's
path starts with the rule's; the longest wins.

Labelled URLs are rows (url, blocked). A table without labels, as the query's, gets weak ones: a URL is labelled blocked
if a word of its host (between dots and hyphens) is one of SEEDS, the words that public blocklists of advertising,
gambling, pharmacy and adult sites have most, and allowed if none is. The rules' own verdicts are policy and no labels.
Training takes different URLs of at most MAX_URL characters, at most SAMPLE of them (by hash of the URL). Features are
lexical: lengths, depth, digit ratio, entropy, parameter counts, and statistics of suffixes (smoothed shares of blocked
URLs by top-level domain, by the path's first segment, by the file ending, and the largest by a word of the host, from
the labelled URLs of other folds). Trees are grown by second-order gradient boosting on quantile bins, on the driver
from bounded rows, and scored in numpy over Arrow batches; a URL is blocked at a probability of THRESHOLD or more.

Defined cases: a null or empty URL has the features of an empty one. URLs of any length are judged whole. Of rules of
equal length that fit, the last in RULES wins; a URL labelled both ways trains both ways. Without labelled URLs of both
verdicts the method gives the labelled verdict, or allow. Repeated rows are judged alike; an empty table gives no rows.
Other columns than page_id and url are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az
from .ngrams import sigmoid

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SAMPLE, MAX_URL, THRESHOLD, TREES, DEPTH, RATE, BINS = 20_000, 4096, 0.5, 40, 3, 0.2, 32
SEEDS = ("ad", "ads", "adserver", "adult", "banner", "bet", "bets", "betting", "casino", "click", "gambling", "lottery", "pharma", "pharmacy", "phish", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx")


def host_of(url: Column) -> Column:
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _suffixes(url: str) -> list[str]:
    """Top-level domain, the path's first segment, file ending; then the words of the host."""
    rest = url.partition("://")[2].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host, segments = host.lower(), path.split("/")
    ending = segments[-1].rpartition(".")[2] if "." in segments[-1] else ""
    words = {f"word {w}" for label in host.split(".") for w in label.split("-")}
    return ["tld " + host.rpartition(".")[2], "dir " + (segments[0] if len(segments) > 1 else ""), "end " + ending, *sorted(words)]


def _statistics(suffixes: list[str], stats: dict[str, float], share: float) -> list[float]:
    found = [stats.get(s, share) for s in suffixes]
    return [*found[:3], max(found[3:])]


def lexical(url: str) -> list[float]:
    """Lengths, depth, digit ratio, entropy and counts of a URL."""
    scheme, _, rest = url.partition("://")
    no_fragment, _, fragment = rest.partition("#")
    location, _, query = no_fragment.partition("?")
    host, _, path = location.partition("/")
    counts = np.unique(np.frombuffer(url.encode(), np.uint8), return_counts=True)[1]
    share = counts / max(1, counts.sum())
    labels = host.split(".")
    return [
        len(url), len(host), len(path), path.count("/"), len(labels), sum(c.isdigit() for c in url) / max(1, len(url)),
        float(-(share * np.log2(share)).sum()) if len(counts) else 0.0, query.count("=") if query else 0, query.count("&") if query else 0,
        len(fragment), host.count("-"), sum(c.isdigit() for c in host), max(map(len, labels)), float(scheme == "https"), float(host.startswith("www.")),
    ]


@dataclass
class Trees:
    """Boosted regression trees on binned features; a tree is arrays of (feature, cut) by node, then leaf values."""

    prior: float = 0.0
    share: float = 0.0
    stats: dict[str, float] = field(default_factory=dict)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def features(self, urls: list[str]) -> np.ndarray:
        if not urls:
            return np.empty((0, 19))
        return np.array([[*lexical(u), *_statistics(_suffixes(u), self.stats, self.share)] for u in urls], float)

    def probability(self, urls: list[str]) -> np.ndarray:
        """That each URL is to be blocked."""
        if not self.trees:
            return np.full(len(urls), sigmoid(self.prior))
        x = self.features(urls)
        return sigmoid(self.prior + sum(apply_tree(t, x) for t in self.trees))


def apply_tree(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    feature, cut, leaf = tree
    node = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
    return leaf[node - (2**DEPTH - 1)]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree of DEPTH levels by the gain of second-order boosting; a node without gain sends all left."""
    inner = 2**DEPTH - 1
    feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
    for at in range(inner):
        rows, best = np.flatnonzero(node == at), 1e-6
        if len(rows):
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, points in enumerate(cuts):
                if not len(points):
                    continue
                bin_of = np.searchsorted(points, x[rows, f])  # rows in bins 0..k pass x <= points[k]
                left_g = np.cumsum(np.bincount(bin_of, g[rows], len(points) + 1))[:-1]
                left_h = np.cumsum(np.bincount(bin_of, h[rows], len(points) + 1))[:-1]
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                k = int(gain.argmax())
                if gain[k] > best + 1e-12:
                    best, feature[at], cut[at] = gain[k], f, points[k]
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
    leaf = np.zeros(inner + 1)
    for k in range(inner + 1):
        rows = node == inner + k
        leaf[k] = -RATE * g[rows].sum() / (h[rows].sum() + ridge)
    return feature, cut, leaf


def fit(urls: list[str], blocked: np.ndarray) -> Trees:
    """Trees from labelled URLs; a training row's suffix statistics come from the other folds."""
    model = Trees()
    if not len(urls) or blocked.min() == blocked.max():
        model.prior = 20.0 if len(urls) and blocked[0] else -20.0
        return model
    model.share = float(blocked.mean())
    model.prior = float(np.log(model.share / (1 - model.share)))
    suffixes = [_suffixes(u) for u in urls]

    def shares(rows: Iterable[int]) -> dict[str, float]:
        sums: dict[str, list[float]] = {}
        for i in rows:
            for s in suffixes[i]:
                c = sums.setdefault(s, [0.0, 0.0])
                c[0] += blocked[i]
                c[1] += 1
        return {s: (y + 5 * model.share) / (n + 5) for s, (y, n) in sums.items()}

    model.stats = shares(range(len(urls)))
    x, part = model.features(urls), np.arange(len(urls)) % 5
    for k in range(5):
        others = shares(np.flatnonzero(part != k))
        for i in np.flatnonzero(part == k):
            x[i, -4:] = _statistics(suffixes[i], others, model.share)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    logit = np.full(len(x), model.prior)
    for _ in range(TREES):
        p = sigmoid(logit)
        model.trees.append(_grow(x, p - blocked, p * (1 - p), cuts))
        logit += apply_tree(model.trees[-1], x)
    return model


def weak_labels(urls: DataFrame, seeds=SEEDS) -> DataFrame:
    """url and blocked of rows (url, host): by the words of the host."""
    return urls.select("url", F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, seeds))).alias("blocked"))


def train(labelled: DataFrame, most: int = SAMPLE) -> Trees:
    """A model from rows (url, blocked): of the different ones those with the least hash of the URL, at most so many."""
    rows = labelled.where(F.col("blocked").isNotNull() & (F.length("url") <= MAX_URL)).select("url", F.col("blocked").cast("int").alias("y")).distinct()
    got = rows.orderBy(F.xxhash64("url"), "url", "y").limit(most).collect()
    return fit([r.url for r in got], np.array([r.y for r in got], float))


def url_verdicts(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block: a row for every row of pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    model = train(weak_labels(judged) if labelled is None else labelled)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability([u or "" for u in batch.column("url").to_pylist()])
            yield batch.drop_columns(["url"]).append_column("p_block", pa.array(p, pa.float64()))

    flat = judged.select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "path", F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("verdict"))
    out = flat.mapInArrow(of, "page_id long, host string, path string, rule string, verdict string, p_block double")
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") >= THRESHOLD, "block").otherwise("allow")))
