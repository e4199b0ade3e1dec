"""Soft-membership mixing of sources to target weights (operator 6). DataFrame and SQL functions only.

Domains come from a labelled table: ``toxic``, else ``low`` (quality 0), else ``clean``. A naive Bayes classifier
on hashed words and a few marks of form gives every document posteriors of the domains. Mixing then seeks a
nonnegative rate for each document, so that the expected tokens of each domain, the sum over documents of
rate * tokens * posterior, meet targets: the domain with the largest target weight keeps the tokens it has, and
the others get theirs in proportion to the weights.

Of all rates that meet the targets those are sought with the least squared changes from 1, counted by tokens, and none
below 0. They have the form max(0, 1 - sum over domains of weight * posterior), the projection of a step along the
gradients of the domains' totals, so the search is over three weights by projected gradient steps: the gradient by a
weight is the domain's miss, and a step is scaled by the curvature, H = the sum over documents of a rate above 0 of
tokens * posterior * posterior (a matrix of the domains), so that it would settle the misses if no rate met 0. Of the
FRACTIONS of each step that one is taken which leaves the least misses. Misses and H are sums over all documents, some
numbers a step. Steps end when no miss exceeds TOLERANCE of what a domain has, or no fraction of a step is of use; if
STEPS do not suffice, or are of no use, a warning names the miss that is left.

Training is on at most SAMPLE labelled rows (the least hashes of doc_id). The model has a weight for every bucket
that is surely more frequent in a domain than in those before it: by SURE standard errors, which is far, as copies and a
language's common words make rows alike, and in SUPPORT of its sampled rows or more, below which that error says
nothing. However many buckets pass, all are kept. Scoring reads whole texts once, without a
shuffle. Defined cases: null text counts as empty, has no tokens, the priors as posteriors, and a rate
as any other. Texts of any length are read whole, as one array of words. A domain without labels, or without any such
bucket, has posterior 0 and no target. Without labels all is clean and every rate is 1. Ties among targets are broken by name. Repeated rows get
the same rate and the same draw. An empty table gives no rows. Extra columns are carried by ``mix_sources``, whatever
their names.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, stored

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.92, "low": 0.05, "toxic": 0.03}
BUCKETS, SAMPLE, SURE, SUPPORT, EVIDENCE, ABSENT = 1 << 18, 4000, 8.0, 5, 8.0, -3.0
STEPS, FRACTIONS, TOLERANCE, SEED = 25, (1.0, 0.5, 0.2, 0.05), 1e-3, 11
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _tenth(part: Column, whole: Column) -> Column:
    return F.floor(10 * part / F.greatest(whole, F.lit(1))).cast("string")


def marks_of(text: Column, words: Column, distinct: Column) -> Column:
    """Words that can't occur, one for each tenth of: distinct words, capitals, symbols."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    return F.array(
        F.concat(F.lit("\n distinct "), _tenth(F.size(distinct), F.size(words))),
        F.concat(F.lit("\n capitals "), _tenth(F.regexp_count(text, F.lit("[A-Z]")), n)),
        F.concat(F.lit("\n symbols "), _tenth(F.regexp_count(text, F.lit("[#*$%&|<>!]")), n)),
    )


@dataclass(frozen=True)
class Names:
    """Names of the columns that scoring adds, which none of the columns of docs has."""

    n: str
    p: dict[str, str]
    buckets: str

    @classmethod
    def beside(cls, columns: list[str]) -> Names:
        n, buckets, *p = fresh(columns, "n", "buckets", *[f"p_{d}" for d in DOMAINS])
        return cls(n, dict(zip(DOMAINS, p, strict=True)), buckets)


def with_buckets(docs: DataFrame, names: Names) -> DataFrame:
    """docs with the number of words and the hashed distinct words and marks."""
    words, distinct = fresh([*docs.columns, names.n, names.buckets], "words", "distinct")
    out = docs.withColumn(words, words_of(F.col("text"))).withColumn(distinct, F.array_distinct(words))
    features = F.concat(distinct, marks_of(F.col("text"), F.col(words), F.col(distinct)))
    bucket = F.transform(features, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int") + 1)
    return out.withColumn(names.n, F.size(words).cast("long")).withColumn(names.buckets, bucket).drop(words, distinct)


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")


@dataclass(frozen=True)
class Domains:
    """Log odds against ``clean`` of a text without any of the buckets (None: no labels), and what each bucket adds."""

    priors: dict[str, float | None]
    buckets: list[int]
    ratios: dict[str, list[float]]


def _features(rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Of every bucket in rows (domain, b) and each domain but the first: z, how surely it is more frequent there, w,
    what it adds to the log odds, a, what all texts without it have, and n, its rows; then the domains' numbers of rows."""
    count = lambda d: F.count_if(F.col("domain") == d)
    n = rows.agg(*[count(d).alias(d) for d in DOMAINS]).first().asDict()
    seen = rows.select("domain", F.explode("b").alias("b")).groupBy("b").agg(*[count(d).alias(d) for d in DOMAINS])
    out = []
    for d in DOMAINS[1:]:
        others = DOMAINS[: DOMAINS.index(d)]  # toxic texts may be of low quality too
        rest, n_rest = sum(F.col(o) for o in others), sum(n[o] for o in others)
        p, q = (F.col(d) + 0.5) / (n[d] + 1), (rest + 0.5) / (n_rest + 1)
        both = (F.col(d) + rest + 1) / (n[d] + n_rest + 2)
        z = (p - q) / F.sqrt(both * (1 - both) * (1 / (n[d] + 1) + 1 / (n_rest + 1)))
        absent = F.log((1 - p) / (1 - q))
        out += [z.alias(f"z_{d}"), (F.log(p / q) - absent).alias(f"w_{d}"), absent.alias(f"a_{d}"), F.col(d).alias(f"n_{d}")]
    return seen.select("b", *out), n


def _prior(n: dict[str, int], d: str, absent: float | None) -> float:
    return math.log((n[d] + 0.5) / (n["clean"] + 0.5)) + max(ABSENT, absent or 0.0)


def classifier(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Domains:
    """Naive Bayes on the presence and absence of buckets: those that most surely stand more often in a
    domain than in ``clean``. (What clean texts of one language have in common says nothing of other languages.)"""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    known = known.select(F.col("doc_id").alias("id"), domain_of().alias("domain")).orderBy(F.xxhash64("id"), "id", "domain").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", "text", "domain")
    rows = rows.orderBy(F.xxhash64("id"), "id", "domain", "text").limit(most)  # a doc_id may have several rows
    rows = stored(with_buckets(rows, Names("n", {}, "b")).select("id", "domain", F.array_sort(F.array_distinct("b")).alias("b")), "sample")
    features, n = _features(rows)
    keep = {d: (F.col(f"z_{d}") >= SURE) & (F.col(f"n_{d}") >= SUPPORT) for d in DOMAINS[1:]}
    chosen = features.select("b", *[F.when(k, F.col(f"{c}_{d}")).otherwise(0.0).alias(f"{c}_{d}") for d, k in keep.items() for c in "wa"])
    chosen = sorted(chosen.where(sum((F.col(f"w_{d}") != 0).cast("int") for d in keep) > 0).collect())  # BUCKETS rows at most
    priors = {d: _prior(n, d, sum(r[f"a_{d}"] for r in chosen)) if any(r[f"w_{d}"] for r in chosen) else None for d in keep}
    return Domains(priors, [r.b for r in chosen], {d: [r[f"w_{d}"] for r in chosen] for d in keep})


def _array(values: list, kind: str) -> Column:
    """A constant array, which the optimizer folds, in one expression however long it is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _evidence(hits: str, buckets: list[int], weights: list[float]) -> Column:
    at, w = _array(buckets, "int"), _array(weights, "double")
    return F.aggregate(hits, F.lit(0.0), lambda total, b: total + F.element_at(w, F.array_position(at, b).cast("int")))


def with_posteriors(docs: DataFrame, model: Domains) -> tuple[DataFrame, Names]:
    """docs with the number of words and the posteriors, in columns of the names returned."""
    names = Names.beside(docs.columns)
    out, odds = with_buckets(docs, names), {}
    known = [d for d, prior in model.priors.items() if prior is not None]
    if model.buckets:
        out = out.withColumn(names.buckets, F.array_intersect(names.buckets, _array(model.buckets, "int")))
    for d in known:
        total = _evidence(names.buckets, model.buckets, model.ratios[d]) if model.buckets else F.lit(0.0)
        odds[d] = F.exp(F.least(F.greatest(F.lit(model.priors[d]) + total, F.lit(-EVIDENCE)), F.lit(EVIDENCE)))
    raw = fresh(out.columns, *[f"odds_{d}" for d in known])
    out = out.select(*quoted(docs.columns), names.n, *[odds[d].alias(c) for d, c in zip(known, raw, strict=True)])
    whole = 1 + sum((F.col(c) for c in raw), F.lit(0.0))
    share = {"clean": 1 / whole} | {d: F.col(c) / whole for d, c in zip(known, raw, strict=True)}
    return out.select(*quoted(docs.columns), names.n, *[share.get(d, F.lit(0.0)).alias(names.p[d]) for d in DOMAINS]), names


def rate(weights: dict[str, float], p: dict[str, str]) -> Column:
    """The rate under these weights, as an expression of the posteriors (columns p)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum(F.lit(w) * F.col(p[d]) for d, w in weights.items()))


def _scaled(curvature: dict[tuple[str, str], float], miss: dict[str, float]) -> dict[str, float]:
    """The steps that settle the misses under this curvature; 0 for a domain that no document has."""
    known = [d for d in DOMAINS if curvature[d, d] > 0]
    rows = [[curvature[min(a, b), max(a, b)] * (1 + 1e-9 * (a == b)) for b in known] + [miss[a]] for a in known]
    for i in range(len(rows)):  # elimination; the matrix is positive and has at most three rows
        pivot = max(range(i, len(rows)), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows = [r if k == i else [x - r[i] / rows[i][i] * y for x, y in zip(r, rows[i], strict=True)] for k, r in enumerate(rows)]
    return {d: 0.0 for d in DOMAINS} | {d: r[-1] / r[i] for i, (d, r) in enumerate(zip(known, rows, strict=True))}


def fit_rates(members: DataFrame, names: Names, targets: dict[str, float] = TARGETS, most: int = STEPS, tolerance: float = TOLERANCE) -> dict[str, float]:
    """The weights under which the rates of members meet the targets. Warns if they are still missed at the end."""
    pairs = [(a, b) for a in DOMAINS for b in DOMAINS if a <= b]
    width = len(DOMAINS) + len(pairs)

    def sums(tried: list[dict[str, float]]) -> list[tuple[dict[str, float], dict[tuple[str, str], float]]]:
        """Of each weights tried the domains' totals and curvature, in one pass."""
        n, p = F.col(names.n), {d: F.col(c) for d, c in names.p.items()}
        rows = members.select(n.alias("n"), *[p[d].alias(d) for d in DOMAINS], *[rate(w, names.p).alias(f"r{i}") for i, w in enumerate(tried)])
        asked = []
        for i in range(len(tried)):
            r = F.col(f"r{i}")
            free = F.when(r > 0, F.col("n")).otherwise(0)
            asked += [F.sum(r * F.col("n") * F.col(d)) for d in DOMAINS] + [F.sum(free * F.col(a) * F.col(b)) for a, b in pairs]
        got = [x or 0.0 for x in rows.agg(*asked).first()]
        parts = [got[i : i + width] for i in range(0, len(got), width)]
        return [(dict(zip(DOMAINS, x, strict=False)), dict(zip(pairs, x[len(DOMAINS) :], strict=True))) for x in parts]

    weights = {d: 0.0 for d in DOMAINS}
    [(have, curvature)] = sums([weights])
    reference = max(targets, key=lambda d: (targets[d], d))
    if not have[reference]:
        return weights
    goal = {d: targets.get(d, 0.0) * have[reference] / targets[reference] for d in DOMAINS}
    missed = lambda now: {d: now[d] - goal[d] if have[d] > 0 else 0.0 for d in DOMAINS}
    worst = lambda now: max(abs(m) / have[d] for d, m in missed(now).items() if have[d] > 0)
    now = have
    for _ in range(most):
        if worst(now) <= tolerance:
            return weights
        step = _scaled(curvature, missed(now))
        tried = [{d: weights[d] + f * step[d] for d in DOMAINS} for f in FRACTIONS]
        best, after = min(zip(tried, sums(tried), strict=True), key=lambda x: worst(x[1][0]))
        if worst(after[0]) >= worst(now):
            break  # no fraction of the step is of use
        weights, (now, curvature) = best, after
    if worst(now) > tolerance:
        warnings.warn(f"the expected tokens of the domains still miss their targets by {missed(now)}", RuntimeWarning, stacklevel=2)
    return weights


def _draw() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) / float(1 << 52)


def copies_of(rate: Column) -> Column:
    """The rate rounded up or down at random by doc_id."""
    return (F.floor(rate) + (_draw() < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate, and copies (the rate rounded up or down at random by doc_id)."""
    members, names = with_posteriors(docs.select("doc_id", "text"), classifier(docs, labels))
    members = stored(members.drop("text"), "members")
    out = members.withColumn("rate", rate(fit_rates(members, names, targets), names.p))
    return out.select("doc_id", F.col(names.n).alias("n_tokens"), *[F.col(names.p[d]).alias(f"p_{d}") for d in DOMAINS], "rate", copies_of(F.col("rate")).alias("copies"))


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, each as often as its copies in mixing_report, with the columns of docs. The posteriors are
    computed once and kept beside the rows in the shared folder; fitting reads them alone, and no text is shuffled."""
    members, names = with_posteriors(docs, classifier(docs, labels))
    members = stored(members, "members")
    found = rate(fit_rates(members, names, targets), names.p)
    return _copied(members, docs.columns, copies_of(found))


def _copied(members: DataFrame, columns: list[str], copies: Column) -> DataFrame:
    number, copy = fresh(columns, "copies", "copy")
    rows = members.withColumn(number, copies.cast("int")).where(F.col(number) > 0)
    return rows.select(*quoted(columns), F.explode(F.array_repeat(F.lit(0), F.col(number))).alias(copy)).drop(copy)
