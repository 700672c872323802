"""Learning from data: frequencies, agreement patterns and EM, thresholds, profiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_frequencies(df: DataFrame, fields: list[str], top: int = 100) -> DataFrame:
    """(field, value, count, relative_frequency): each field's commonest non-empty values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*").where("value <> ''")
    n = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    total = n.groupBy("field").agg(F.sum("count").alias("total"))
    w = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).join(F.broadcast(total), "field").select("field", "value", "count", (F.col("count") / F.col("total")).alias("relative_frequency"))  # one row a field


def gamma(sim: Column, over: float = 0.85) -> Column:
    """Agreement 1, disagreement 0, null for no evidence."""
    return F.when(sim.isNotNull(), (sim >= over).cast("int"))


def gamma_level(sim: Column, least: list[float]) -> Column:
    """0 for the best level; len(least) for none of them."""
    out = F.lit(len(least))
    for n in range(len(least) - 1, -1, -1):
        out = F.when(sim >= least[n], n).otherwise(out)
    return F.when(sim.isNotNull(), out)


def patterns(compared: DataFrame, gammas: list[str]) -> DataFrame:
    """Distinct agreement patterns with their number: EM needs no more, however many pairs there are."""
    return compared.groupBy(*gammas).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class EM:
    m: np.ndarray
    u: np.ndarray
    prior: float
    rounds: int
    converged: bool


def em_binary(g: np.ndarray, weights: np.ndarray | None = None, fixed_u: np.ndarray | None = None, rounds: int = 50, tolerance: float = 1e-5, m0: float = 0.9, u0: float = 0.1, prior0: float = 0.1) -> EM:
    """m, u and the share of matches from patterns (rows; NaN: no evidence) with weights."""
    g = np.asarray(g, float)
    w = np.ones(len(g)) if weights is None else np.asarray(weights, float)
    seen, value = ~np.isnan(g), np.nan_to_num(g)
    m, u, prior = np.full(g.shape[1], m0), np.full(g.shape[1], u0) if fixed_u is None else np.asarray(fixed_u, float), prior0
    n, done = 0, False
    for n in range(1, rounds + 1):
        c = lambda p: np.clip(p, 1e-6, 1 - 1e-6)
        like = lambda p: np.where(seen, value * np.log(c(p)) + (1 - value) * np.log(1 - c(p)), 0).sum(axis=1)
        a, b = math.log(c(prior)) + like(m), math.log(1 - c(prior)) + like(u)
        top = np.maximum(a, b)
        post = np.exp(a - top) / (np.exp(a - top) + np.exp(b - top))
        old = (m.copy(), u.copy(), prior)
        for target, share in ((m, post * w), (u, (1 - post) * w)):
            if target is u and fixed_u is not None:
                continue
            mass = (share[:, None] * seen).sum(axis=0)
            rate = (share[:, None] * value * seen).sum(axis=0)
            target[:] = np.where(mass > 1e-6, rate / np.maximum(mass, 1e-12), target)
        prior = float((post * w).sum() / max(w.sum(), 1e-12))
        if max(np.abs(m - old[0]).max(), np.abs(u - old[1]).max(), abs(prior - old[2])) < tolerance:
            done = True
            break
    if fixed_u is None and m.mean() < u.mean():
        m, u, prior = u, m, 1 - prior
    return EM(m, u, prior, n, done)


def em_categorical(g: np.ndarray, levels: list[int], weights: np.ndarray | None = None, rounds: int = 50, tolerance: float = 1e-5, prior: float = 0.1) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """The same for levels: g holds level numbers, best 0. m starts on the top level, u on the last."""
    g = np.asarray(g, float)
    w = np.ones(len(g)) if weights is None else np.asarray(weights, float)
    start = lambda k, at: np.array([0.8 if i == at else 0.2 / max(1, k - 1) for i in range(k)])
    m, u = [start(k, 0) for k in levels], [start(k, k - 1) for k in levels]
    hot = [np.stack([g[:, f] == v for v in range(k)], axis=1) for f, k in enumerate(levels)]
    for _ in range(rounds):
        score = lambda p: sum(h @ np.log(np.clip(x, 1e-6, 1)) for h, x in zip(hot, p, strict=True))
        a, b = math.log(max(prior, 1e-6)) + score(m), math.log(max(1 - prior, 1e-6)) + score(u)
        top = np.maximum(a, b)
        post = np.exp(a - top) / (np.exp(a - top) + np.exp(b - top))
        old = np.concatenate([*m, *u, [prior]])
        for f, h in enumerate(hot):
            for p, share in ((m, post * w), (u, (1 - post) * w)):
                mass = share @ h
                p[f] = mass / mass.sum() if mass.sum() > 1e-6 else p[f]
        prior = float((post * w).sum() / max(w.sum(), 1e-12))
        if np.abs(np.concatenate([*m, *u, [prior]]) - old).max() < tolerance:
            break
    return m, u, prior


def random_agreement(df: DataFrame, key: str, fields: dict[str, Column], n: int = 2000, seed: int = 42) -> DataFrame:
    """(field, n, u): how often random pairs agree, floored at 1 / (n + 1). Pairs are neighbours in the order of a seeded digest of
    n records' keys."""
    one = df.select(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))).alias("h"), F.col(key).cast("string").alias("k"), *[c.cast("string").alias(f) for f, c in fields.items()]).orderBy("h", "k").limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy("h", "k")  # at most n rows
    met = one.select(*[F.when(F.col(f).isNotNull() & F.lead(f).over(w).isNotNull(), (F.col(f) == F.lead(f).over(w)).cast("int")).alias(f) for f in fields])
    return met.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("g")) for f in fields])).alias("x")).groupBy("x.field").agg(F.count("x.g").alias("n"), F.greatest(F.avg("x.g"), 1 / (F.count("x.g") + 1)).alias("u"))


def latest_model(models: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    w = Window.partitionBy(name).orderBy(F.desc(version))
    return models.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def threshold_sweep(scored: DataFrame, steps: int = 99) -> DataFrame:
    """scored (score, is_match) at thresholds i / (steps + 1): tp, fp, fn, precision, recall, f1. Rows are binned first; the sweep is over bins."""
    unit = 1.0 / (steps + 1)
    bins = scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(F.col("score") / unit + 1e-9))).alias("bin")).agg(F.sum(F.col("is_match").cast("long")).alias("p"), F.sum((~F.col("is_match")).cast("long")).alias("q"))
    grid = scored.sparkSession.range(1, steps + 1).select(F.col("id").alias("step"))
    total = bins.agg(F.sum("p").alias("all_p"))
    # at most steps + 1 bins
    at = grid.join(F.broadcast(bins), F.col("bin") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("q"), F.lit(0)).alias("fp"))
    all_p = total.first()[0] or 0
    at = at.withColumn("fn", F.lit(all_p) - F.col("tp"))
    return measures(at.select((F.col("step") * unit).alias("threshold"), "tp", "fp", "fn"))


def measures(df: DataFrame) -> DataFrame:
    """df (tp, fp, fn) with precision, recall and f1; 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def best_threshold(sweep: DataFrame, objective: str = "f1", least_precision: float = 0.0, least_recall: float = 0.0) -> DataFrame:
    return sweep.where((F.col("precision") >= least_precision) & (F.col("recall") >= least_recall)).orderBy(F.desc(objective), "threshold").limit(1)


def score_bins(scores: DataFrame, column: str = "score", bins: int | None = None) -> tuple[np.ndarray, float, float]:
    """Histogram over [least, greatest]; bins by default 16 to 256, from the root of the number."""
    low, high, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or high <= low:
        return np.array([n or 0]), low or 0.0, high or 0.0
    k = bins or max(16, min(256, 2 * int(math.isqrt(n))))
    out = np.zeros(k, np.int64)
    for r in scores.groupBy(F.least(F.lit(k - 1), F.floor((F.col(column) - low) / (high - low) * k)).alias("b")).count().collect():
        if r["b"] is not None:
            out[r["b"]] = r["count"]
    return out, low, high


def otsu(hist: np.ndarray, low: float, high: float) -> float | None:
    """The cut with the greatest between-class variance."""
    if len(hist) < 2:
        return None
    width, hist = (high - low) / len(hist), np.asarray(hist, np.int64)
    mid = 2 * np.arange(len(hist)) + 1  # in halves of a bin: sums are exact, and cuts with nothing between them tie
    w0 = np.cumsum(hist)[:-1]
    w1 = hist.sum() - w0
    s0 = np.cumsum(hist * mid)[:-1]
    s1 = (hist * mid).sum() - s0
    ok = (w0 > 0) & (w1 > 0)
    apart = s0 / np.maximum(w0, 1) - s1 / np.maximum(w1, 1)
    variance = np.where(ok, w0 * w1.astype(float) * apart * apart, -1.0)
    return None if not ok.any() else float(low + (int(variance.argmax()) + 1) * width)


def _smooth(hist: np.ndarray) -> np.ndarray:
    """Each bin and its neighbours together: whole numbers, so that equal ones compare equal."""
    return np.convolve(hist, np.ones(3, np.int64), mode="same")


def valley_depth(hist: np.ndarray, low: float, high: float, cut: float) -> float:
    """How deep the smoothed histogram is at the cut, against the lower of the peaks on either side; 0 for none."""
    smooth = _smooth(hist)
    at = min(len(hist) - 1, max(0, int((cut - low) / max(high - low, 1e-12) * len(hist))))
    peak = min(smooth[: at + 1].max(initial=0), smooth[at:].max(initial=0))
    return 0.0 if peak <= 0 else max(0.0, float(1 - smooth[at] / peak))


def auto_threshold(scores: DataFrame, column: str = "score", fallback: float = 0.8, least_depth: float = 0.15) -> tuple[float, float, bool]:
    """(threshold, depth, accepted): Otsu's cut where the valley is deep enough, else the fallback."""
    hist, low, high = score_bins(scores, column)
    cut = otsu(hist, low, high)
    depth = valley_depth(hist, low, high, cut) if cut is not None else 0.0
    return (cut, depth, True) if cut is not None and depth >= least_depth else (fallback, depth, False)


def comparison_bands(hist: np.ndarray, low: float, high: float, most: int = 3, mass: float = 0.05) -> list[float]:
    """Up to most - 1 cuts at troughs, deepest first, with enough mass on either side and apart from each other; sorted downwards."""
    smooth, n, total = _smooth(hist), len(hist), hist.sum()
    found = []
    for i in range(1, n - 1):
        if smooth[i] <= smooth[i - 1] and smooth[i] <= smooth[i + 1]:
            left, right = hist[:i].sum(), hist[i + 1 :].sum()
            peak = min(smooth[:i].max(), smooth[i + 1 :].max())
            if total and min(left, right) >= mass * total and peak > 0:
                found.append((1 - smooth[i] / peak, i))
    chosen: list[int] = []
    for depth, i in sorted(found, reverse=True):
        if depth > 0 and all(abs(i - j) >= max(2, 0.2 * n) for j in chosen) and len(chosen) < most - 1:
            chosen.append(i)
    return sorted((float(low + (i + 0.5) * (high - low) / n) for i in chosen), reverse=True)


def score_diagnostics(scores: DataFrame, column: str = "score") -> DataFrame:
    q = lambda p: F.percentile(column, F.lit(p))
    return scores.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("stdev"), F.min(column).alias("least"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.95).alias("p95"), F.max(column).alias("greatest"))


def profile(df: DataFrame, fields: list[str], top: int = 5) -> DataFrame:
    """(field, rows, null_rate, distinct_values, entropy, heavy): entropy over the shares of the commonest values, normalised."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    n = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("field").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct_values"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    best = n.where("value is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    share = Window.partitionBy("field")
    p = F.col("n") / F.sum("n").over(share)
    heavy = best.withColumn("_h", -p * F.log2(p)).groupBy("field").agg(F.sum("_h").alias("h"), F.count(F.lit(1)).alias("k"), F.max("n").alias("top_count"))
    return total.join(heavy, "field", "left").select("field", "rows", (F.col("nulls") / F.col("rows")).alias("null_rate"), "distinct_values", F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0).alias("entropy"), F.coalesce("top_count", F.lit(0)).alias("top_count"))


def data_quality(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, rows, missing, distinct_values, completeness)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("value")) for f in fields])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count("value")).alias("missing"), F.count_distinct("value").alias("distinct_values"), (F.count("value") / F.count(F.lit(1))).alias("completeness"))


def pairwise_signals(df: DataFrame, fields: list[str]) -> DataFrame:
    """Duplicate rate and hub risk of the signature of some fields."""
    sig = F.concat_ws("|", *[F.lower(F.trim(F.col(f).cast("string"))) for f in fields])
    n = df.groupBy(sig.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("signatures"), (1 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_rate"), (F.max("n") / F.sum("n")).alias("hub_risk"))


def feature_weights(compared: DataFrame, features: list[str], label: str = "is_match") -> DataFrame:
    """(feature, match_mean, non_match_mean, separation, weight): how far apart means are in pooled deviations, normalised to 1."""
    long = compared.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("x")).select(label, "x.*")
    yes, no = F.when(F.col(label), F.col("v")), F.when(~F.col(label), F.col("v"))
    s = long.groupBy("feature").agg(F.avg(yes).alias("match_mean"), F.avg(no).alias("non_match_mean"), F.var_pop(yes).alias("v1"), F.var_pop(no).alias("v0"))
    sep = F.greatest(F.lit(0.0), (F.col("match_mean") - F.col("non_match_mean")) / F.sqrt((F.col("v1") + F.col("v0")) / 2 + 1e-9))
    s = s.withColumn("separation", F.coalesce(sep, F.lit(0.0)))
    total = F.sum("separation").over(Window.partitionBy(F.lit(0)))
    return s.select("feature", "match_mean", "non_match_mean", "separation", F.when(total > 0, F.col("separation") / total).otherwise(0.0).alias("weight"))
