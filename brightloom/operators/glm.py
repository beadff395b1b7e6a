"""Generalised linear models by iterated weighted sums, with sandwich errors, and false-discovery control.

The data never leave Spark: an iteration is one aggregation, whose sums for all models of a call come back as one row of
k * (k + 1) / 2 + k numbers for each model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.operators import joins
from brightloom.operators.filters import ContractError
from brightloom.operators.ranks import step_up

Z95 = NormalDist().inv_cdf(0.975)

#: Models whose sums are taken in one pass.
TOGETHER = 64
#: Levels that a text or boolean term may have.
LEVELS = 64
#: Below this a feature's greatest absolute value or its population variance can't carry a model.
ALL_ZERO, NEAR_CONSTANT = 1e-8, 1e-10


@dataclass
class Model:
    """A response and its terms; an intercept comes first of itself. alpha: the negative binomial's dispersion; name: what
    tells the model from others of the same response."""

    response: str
    terms: list[str]
    family: str = "gaussian"
    offset: str | None = None
    alpha: float = 1.0
    name: str | None = None
    beta: list[float] = field(default_factory=list)
    converged: bool = False

    def columns(self) -> list[Column]:
        return [F.lit(1.0), *[F.col(f"`{t}`").cast("double") for t in self.terms]]

    def usable(self) -> Column:
        ok = F.col(self.response).isNotNull()
        for c in [*self.terms, *([self.offset] if self.offset else [])]:
            ok = ok & F.col(f"`{c}`").isNotNull()
        return ok

    def shift(self) -> Column:
        return F.col(self.offset).cast("double") if self.offset else F.lit(0.0)

    def mu(self) -> Column:
        eta = sum((c * F.lit(b) for c, b in zip(self.columns(), self.beta, strict=True)), self.shift())
        if self.family == "gaussian":
            return eta
        return 1 / (1 + F.exp(-eta)) if self.family == "binomial" else F.exp(eta)

    def weight(self, mu: Column) -> Column:
        """Expected information of the linear predictor."""
        return {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu, "nb": mu / (1 + self.alpha * mu)}[self.family]

    def residual(self, mu: Column) -> Column:
        """The score of the linear predictor."""
        r = F.col(self.response).cast("double") - mu
        return r / (1 + self.alpha * mu) if self.family == "nb" else r

    def deviance(self, mu: Column) -> Column:
        y = F.col(self.response).cast("double")
        log = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
        if self.family == "gaussian":
            return (y - mu) ** 2
        if self.family == "poisson":
            return 2 * (log(y, mu) - (y - mu))
        if self.family == "binomial":
            return 2 * (log(y, mu) + log(1 - y, 1 - mu))
        return 2 * (log(y, mu) - (y + 1 / self.alpha) * F.ln((1 + self.alpha * y) / (1 + self.alpha * mu)))

    def variance(self, mu: Column) -> Column:
        return {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu, "nb": mu + self.alpha * mu * mu}[self.family]


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _matrix(row, name: str, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i, j in _upper(k):
        m[i, j] = m[j, i] = row[f"{name}_{i}_{j}"] or 0.0
    return m


def dummies(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """Indicators (column[level]) of all levels but the first in their order, null where the column is. The levels come
    to the driver; more than LEVELS of them are an error."""
    of = F.col(f"`{column}`")
    levels = sorted(r[0] for r in df.select(of.alias("v")).where("v is not null").distinct().limit(LEVELS + 1).collect())
    if len(levels) > LEVELS:
        raise ContractError(f"{column} has more than {LEVELS} levels")
    names = {f"{column}[{v}]": v for v in levels[1:]}
    return df.withColumns({n: F.when(of.isNotNull(), (of == v).cast("double")) for n, v in names.items()}), list(names)


def _expanded(df: DataFrame, models: list[Model]) -> tuple[DataFrame, list[Model]]:
    """Text and boolean terms give way to indicators of their levels."""
    kinds, levels = dict(df.dtypes), {}
    for t in dict.fromkeys(t for m in models for t in m.terms if kinds.get(t) in ("string", "boolean")):
        df, levels[t] = dummies(df, t)
    return df, [replace(m, terms=[n for t in m.terms for n in levels.get(t, [t])]) for m in models] if levels else models


def fit(df: DataFrame, models: list[Model], cluster: str | None = None, small_sample: bool = True, rounds: int = 50, tolerance: float = 1e-10, guard: bool = False) -> DataFrame:
    """A row for each term of each model: model, target, term, coef, se, p, ci_lo, ci_hi, exp_coef, exp_ci_lo, exp_ci_hi,
    effect, effect_lo, effect_hi (ratios, but for the gaussian family), family, nobs, deviance, pearson_chi2, converged.

    A term of text or truth values stands for indicators of its levels but the first (see `dummies`). Errors are robust, without a factor for few rows, which is how the usual libraries treat general linear models; or
    clustered if a cluster column is named (with the factor G/(G-1) * (n-1)/(n-k) unless small_sample is off). Rows with
    a null that a model needs, or without a cluster, don't take part in it; a model that can't be solved is left out, and with guard also one
    whose response or a term is all about zero or next to constant over its rows.
    """
    if cluster:
        df = df.where(F.col(f"`{cluster}`").isNotNull())
    df, models = _expanded(df, models)
    if len(models) > TOGETHER:
        return reduce(DataFrame.unionByName, [fit(df, models[i : i + TOGETHER], cluster, small_sample, rounds, tolerance, guard) for i in range(0, len(models), TOGETHER)])
    needed = {c for m in models for c in (m.response, *m.terms, *([m.offset] if m.offset else []))} | ({cluster} if cluster else set())
    # Read once for each iteration; what is lost is made again.
    df = df.select(*[f"`{c}`" for c in sorted(needed)]).persist()
    try:
        return _fitted(df, models, cluster, small_sample, rounds, tolerance, guard)
    finally:
        df.unpersist()


def _carries(df: DataFrame, models: list[Model]) -> list[Model]:
    """The models none of whose columns is degenerate over the rows that it uses; one pass for all."""
    columns = [(i, c) for i, m in enumerate(models) for c in (m.response, *m.terms)]
    of = lambda i, c: F.when(models[i].usable(), F.col(f"`{c}`").cast("double"))
    row = df.agg(*[f(of(i, c)).alias(f"{n}{k}") for k, (i, c) in enumerate(columns) for n, f in (("m", lambda x: F.max(F.abs(x))), ("v", F.var_pop))]).first()
    bad = {i for k, (i, _) in enumerate(columns) if row[f"m{k}"] is None or row[f"m{k}"] <= ALL_ZERO or row[f"v{k}"] < NEAR_CONSTANT}
    return [m for i, m in enumerate(models) if i not in bad]


def _fitted(df: DataFrame, models: list[Model], cluster: str | None, small_sample: bool, rounds: int, tolerance: float, guard: bool) -> DataFrame:
    if guard:
        models = _carries(df, models) if models else models
    starts = None if not models else df.agg(*[f for i, m in enumerate(models) for f in (F.sum(F.when(m.usable(), F.col(m.response).cast("double"))).alias(f"y{i}"), F.sum(F.when(m.usable(), F.exp(m.shift()))).alias(f"e{i}"), F.count_if(m.usable()).alias(f"n{i}"))]).first()
    live = []
    for i, m in enumerate(models):
        y, e, n = starts[f"y{i}"], starts[f"e{i}"], starts[f"n{i}"]
        if not n or (m.family != "gaussian" and not y):
            continue
        first = {"gaussian": 0.0, "binomial": math.log(max(y, 1e-9) / max(n - y, 1e-9)) if m.family == "binomial" else 0.0}.get(m.family, math.log(max(y, 1e-9) / e) if m.family != "gaussian" else 0.0)
        m.beta, m.converged = [first, *[0.0] * len(m.terms)], False
        live.append(m)
    todo = list(live)
    for _ in range(rounds):
        if not todo:
            break
        sums = []
        for i, m in enumerate(todo):
            x, mu, ok = m.columns(), m.mu(), m.usable()
            w, r = m.weight(mu), m.residual(mu)
            sums += [F.sum(F.when(ok, w * x[a] * x[b])).alias(f"h{i}_{a}_{b}") for a, b in _upper(len(x))] + [F.sum(F.when(ok, r * x[a])).alias(f"g{i}_{a}") for a in range(len(x))]
        row, left = df.agg(*sums).first(), []
        for i, m in enumerate(todo):
            k = len(m.beta)
            try:
                step = np.linalg.solve(_matrix(row, f"h{i}", k), np.array([row[f"g{i}_{a}"] for a in range(k)], float))
            except np.linalg.LinAlgError:
                live.remove(m)
                continue
            if not np.isfinite(step).all():
                live.remove(m)
                continue
            m.beta = [float(b + s) for b, s in zip(m.beta, step, strict=True)]
            m.converged = bool(np.abs(step).max() <= tolerance * (1 + max(map(abs, m.beta))))
            if not m.converged:
                left.append(m)
        todo = left
    rows = []
    if live:
        sums, scores = [], []
        for i, m in enumerate(live):
            x, mu, ok = m.columns(), m.mu(), m.usable()
            w, r = m.weight(mu), m.residual(mu)
            sums += [F.sum(F.when(ok, w * x[a] * x[b])).alias(f"h{i}_{a}_{b}") for a, b in _upper(len(x))]
            sums += [F.sum(F.when(ok, m.deviance(mu))).alias(f"d{i}"), F.sum(F.when(ok, (F.col(m.response) - mu) ** 2 / m.variance(mu))).alias(f"c{i}"), F.count_if(ok).alias(f"n{i}")]
            scores += [F.when(ok, r * x[a]).alias(f"s{i}_{a}") for a in range(len(x))]
            if not cluster:
                sums += [F.sum(F.when(ok, r * r * x[a] * x[b])).alias(f"m{i}_{a}_{b}") for a, b in _upper(len(x))]
        row = df.agg(*sums).first()
        meat, groups = row, None
        if cluster:
            by = df.select(cluster, *scores).groupBy(cluster).agg(*[F.sum(f"s{i}_{a}").alias(f"s{i}_{a}") for i, m in enumerate(live) for a in range(len(m.beta))])
            meat = by.agg(*[F.sum(F.col(f"s{i}_{a}") * F.col(f"s{i}_{b}")).alias(f"m{i}_{a}_{b}") for i, m in enumerate(live) for a, b in _upper(len(m.beta))], *[F.count(f"s{i}_0").alias(f"k{i}") for i in range(len(live))]).first()
            groups = [meat[f"k{i}"] for i in range(len(live))]
        for i, m in enumerate(live):
            k, n = len(m.beta), row[f"n{i}"]
            bread = np.linalg.pinv(_matrix(row, f"h{i}", k))
            cov = bread @ _matrix(meat, f"m{i}", k) @ bread
            if cluster and small_sample and groups[i] > 1 and n > k:
                cov *= groups[i] / (groups[i] - 1) * (n - 1) / (n - k)
            for term, b, se in zip(["Intercept", *m.terms], m.beta, np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), strict=True):
                p = math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else None
                ends = (b, b - Z95 * se, b + Z95 * se)
                ratios = tuple(math.exp(x) if m.family != "gaussian" and x < 700 else None for x in ends)
                rows.append((m.name or m.response, m.response, term, b, se, p, *ends[1:], *ratios, *(ends if m.family == "gaussian" else ratios), m.family, int(n), float(row[f"d{i}"]), float(row[f"c{i}"]), m.converged))
    doubles = lambda *names: [T.StructField(x, T.DoubleType()) for x in names]
    schema = T.StructType([*[T.StructField(x, T.StringType()) for x in ("model", "target", "term")], *doubles("coef", "se", "p", "ci_lo", "ci_hi", "exp_coef", "exp_ci_lo", "exp_ci_hi", "effect", "effect_lo", "effect_hi"), T.StructField("family", T.StringType()), T.StructField("nobs", T.LongType()), *doubles("deviance", "pearson_chi2"), T.StructField("converged", T.BooleanType())])
    return df.sparkSession.createDataFrame(rows, schema)


def false_discovery(df: DataFrame, p: str = "p", by: list[str] = (), key: list[str] = (), level: float = 0.05) -> DataFrame:
    """Adds q (Benjamini and Hochberg) and significant, within each group of `by`; p-values that are null or NaN keep a null
    q. Columns of these names give way. Groups may be of any size (see `ranks.step_up`)."""
    rows = df.drop("q", "significant")
    value = F.col(f"`{p}`").cast("double")
    known = value.isNotNull() & ~F.isnan(value)
    tested = step_up(rows.where(known), value, [F.col(f"`{c}`") for c in by], [F.col(f"`{c}`") for c in key])
    out = tested.unionByName(rows.where(~F.coalesce(known, F.lit(False))), allowMissingColumns=True)
    return out.withColumn("significant", F.coalesce(F.col("q") <= level, F.lit(False)))


def _tested(effects: DataFrame, family: dict[str, list[str]], by: list[str] = ()) -> DataFrame:
    """Adds q and significant, for each family of terms by itself (within each group of `by`); terms of no family keep a
    null q. A column for each family says what is in it."""
    effects = effects.withColumns({name: F.col("term").isin(*terms) if terms else F.lit(False) for name, terms in family.items()})
    kind = F.coalesce(*[F.when(F.col(name), name) for name in family])
    known = effects.withColumn("__kind", kind)
    tested = false_discovery(known.where("__kind is not null"), by=["__kind", *by], key=["model", "term"])
    return tested.unionByName(known.where("__kind is null"), allowMissingColumns=True).withColumn("significant", F.coalesce("significant", F.lit(False))).drop("__kind")


def feature_association(df: DataFrame, targets: list[str], features: list[str], cluster: str, families: dict[str, str] | None = None, covariates: list[str] = ()) -> DataFrame:
    """A model for each target and feature, with covariates beside it, all of them in common passes; q over all pairs'
    features. Pairs that can't carry a model are left out. A target's family is gaussian unless it is named."""
    pairs = [Model(t, [f, *covariates], (families or {}).get(t, "gaussian"), name=f"{t}~{f}") for t in targets for f in features]
    effects = fit(df, pairs, cluster, guard=True).where(F.col("term") != "Intercept")
    # A pair whose feature has no error is left out whole.
    sound = effects.where(F.col("term").isin(*features) & F.col("p").isNotNull()).select("model") if features else effects.select("model")
    return _tested(effects.join(sound, "model", "left_semi"), {"is_feature": list(features)})


def bag_association(design: DataFrame, outcomes: DataFrame, bag: str, targets: list[str], covariates: list[str] = (), use_global: bool = True, use_community: bool = False, families: dict[str, str] | None = None) -> DataFrame:
    """For each target one model on all of a bag's means, overall (xg_*) and of its communities (xk*), with covariates;
    robust errors. q is for each target over the overall means and, apart from those, over the communities'. A target's
    family is gaussian unless it is named. Bags are one-to-one in both tables."""
    rows = joins.one_to_one(design, outcomes.select(bag, *targets, *covariates), bag)
    means = [c for c in design.columns if use_global and c.startswith("xg_")]
    parts = [c for c in design.columns if use_community and c.startswith("xk")]
    models = [Model(t, [*means, *parts, *covariates], (families or {}).get(t, "gaussian")) for t in targets]
    return _tested(fit(rows, models).where(F.col("term") != "Intercept"), {"is_global": means, "is_community": parts}, by=["target"])


def membership_association(df: DataFrame, target: str, cluster: str, memberships: list[str] | None = None, covariates: list[str] = (), family: str = "binomial", drop_reference: bool = True) -> DataFrame:
    """One model of a target on memberships (m_1, m_2, ... in the order of their numbers unless they are named), the last
    of which is the reference, with covariates; clustered errors; q over the memberships."""
    if memberships is None:
        memberships = sorted((c for c in df.columns if c.startswith("m_") and c[2:].isdigit()), key=lambda c: int(c[2:]))
    used = memberships[:-1] if drop_reference and len(memberships) > 1 else list(memberships)
    effects = fit(df, [Model(target, [*used, *covariates], family)], cluster).where(F.col("term") != "Intercept")
    return _tested(effects, {"is_membership": list(memberships)})


def community_abundance(bags: DataFrame, counts: list[str], terms: list[str], size: str = "n") -> DataFrame:
    """Negative-binomial models of each community's count with the bag's size as offset; q for each term over the
    communities."""
    rows = bags.withColumn("__log_n", F.ln(size))
    effects = fit(rows, [Model(c, terms, "nb", "__log_n") for c in counts])
    return false_discovery(effects.withColumn("community", F.col("target")), by=["term"], key=["community"])
