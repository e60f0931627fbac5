"""Composite scores: Beneish M, Altman Z'', weighted and fixed-weight scores, triage points, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import CATEGORY_WEIGHT, SCORE_WEIGHTS, SEVERITY_MULTIPLIER
from ..functions.expr import first_of, js_round, rank_of, safe_div

# The coefficients of the two models.
BENEISH = {"DSRI": 0.92, "GMI": 0.528, "AQI": 0.404, "SGI": 0.892, "DEPI": 0.115, "SGAI": -0.172, "TATA": 4.679, "LVGI": -0.327}
BENEISH_CONSTANT, BENEISH_LIMIT = -4.84, -1.78
ALTMAN = {"x1": 6.56, "x2": 3.26, "x3": 6.72, "x4": 1.05}
ALTMAN_DISTRESS, ALTMAN_SAFE = 1.1, 2.6
ANNUAL = ("revenue", "grossProfit", "accountsReceivable", "totalAssets", "currentAssets", "ppeNet", "depreciationAmortization", "sga", "currentLiabilities", "longTermDebt", "incomeContinuingOps", "cfo", "retainedEarnings", "operatingIncome", "equity", "totalLiabilities")


def _with(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in names if c not in df.columns})


def beneish(annual: DataFrame, by: list[str], fy: str) -> DataFrame:
    """The latest year of each key against the year before it (two rows needed).

    An index that cannot be computed is neutral (1; accruals 0) and is counted in
    n_missing. dominant: the index that adds most, if it adds anything.
    """
    w = Window.partitionBy(*by).orderBy(fy)
    df = _with(annual, ANNUAL)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(fy).desc()))
    df = df.withColumns({f"p_{c}": F.lag(c).over(w) for c in ANNUAL} | {"__prior": F.lag(F.lit(1)).over(w), "__rn": rn}).where("__rn = 1 and __prior = 1")

    def both(make) -> tuple[Column, Column]:
        return make(""), make("p_")

    def per_revenue(c: str):
        return both(lambda p: safe_div(f"{p}{c}", f"{p}revenue"))

    ar, gm, sga = per_revenue("accountsReceivable"), per_revenue("grossProfit"), per_revenue("sga")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    soft = both(lambda p: 1 - safe_div(zero(f"{p}currentAssets") + zero(f"{p}ppeNet"), f"{p}totalAssets"))
    dep = both(lambda p: safe_div(f"{p}depreciationAmortization", F.col(f"{p}depreciationAmortization") + F.col(f"{p}ppeNet")))
    lev = both(lambda p: safe_div(zero(f"{p}currentLiabilities") + zero(f"{p}longTermDebt"), f"{p}totalAssets"))
    raw = {
        "DSRI": safe_div(*ar),
        "GMI": safe_div(gm[1], gm[0]),
        "AQI": safe_div(*soft),
        "SGI": safe_div("revenue", "p_revenue"),
        "DEPI": safe_div(dep[1], dep[0]),
        "SGAI": safe_div(*sga),
        "LVGI": safe_div(*lev),
        "TATA": safe_div(F.col("incomeContinuingOps") - F.col("cfo"), "totalAssets"),
    }
    df = df.withColumns({f"raw_{k}": v for k, v in raw.items()})
    neutral = {k: 0.0 if k == "TATA" else 1.0 for k in BENEISH}
    df = df.withColumns({k: F.coalesce(F.col(f"raw_{k}"), F.lit(neutral[k])) for k in BENEISH})
    score = F.lit(BENEISH_CONSTANT)
    for k, weight in BENEISH.items():
        score = score + weight * F.col(k)
    added = [F.struct((weight * (F.col(k) - neutral[k])).alias("added"), F.lit(-i).alias("order"), F.lit(k).alias("name")) for i, (k, weight) in enumerate(BENEISH.items())]
    top = F.array_max(F.array(*added))
    n_missing = sum((F.col(f"raw_{k}").isNull().cast("int") for k in BENEISH), F.lit(0))
    df = df.withColumns({"__m": score, "dominant": F.when(top["added"] > 0, top["name"]), "n_missing": n_missing})
    return df.select(*by, fy, *BENEISH, F.round("__m", 3).alias("m_score"), (F.col("__m") > BENEISH_LIMIT).alias("flagged"), "dominant", "n_missing")


def altman(annual: DataFrame) -> DataFrame:
    """Each row's Z'' and zone; unknown where a part is missing."""
    df = _with(annual, ANNUAL)
    x = {
        "x1": safe_div(F.col("currentAssets") - F.col("currentLiabilities"), "totalAssets"),
        "x2": safe_div("retainedEarnings", "totalAssets"),
        "x3": safe_div("operatingIncome", "totalAssets"),
        "x4": safe_div("equity", "totalLiabilities"),
    }
    df = df.withColumns(x)
    z = ALTMAN["x1"] * F.col("x1") + ALTMAN["x2"] * F.col("x2") + ALTMAN["x3"] * F.col("x3") + ALTMAN["x4"] * F.col("x4")
    zone = first_of((z < ALTMAN_DISTRESS, "distress"), (z > ALTMAN_SAFE, "safe"), (z.isNotNull(), "grey"), otherwise="unknown")
    return df.withColumns({"z_score": F.round(z, 2), "zone": zone})


def uncertainty(spread: Column) -> Column:
    """Of a range of samples: tight up to 0.5, moderate up to 1.5 or unknown, else high."""
    return first_of((spread.isNull(), "moderate"), (spread <= 0.5, "tight"), (spread <= 1.5, "moderate"), otherwise="high")


def sample_spread(samples: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """Median, range and the sample closest to the median (the first of equals); samples without a number only count."""
    g = samples.groupBy(*by).agg(F.median(score).alias("median"), (F.max(score) - F.min(score)).alias("spread"), F.count(score).cast("bigint").alias("n_scored"), F.count(F.lit(1)).cast("bigint").alias("n_samples"))
    near = samples.where(F.col(score).isNotNull()).join(g.select(*by, "median"), by).groupBy(*by).agg(F.min_by(order, F.struct(F.abs(F.col(score) - F.col("median")), F.col(order))).alias("representative"))
    return g.join(near, by, "left")


def weighted(dimensions: DataFrame, by: list[str], score: str, weight: str, uncertainty_: str, stretched: str | None = None) -> DataFrame:
    """Sum of score times weight over weights, high uncertainty at 0.7 of its weight, missing scores at none; 5.5 where nothing counts; and the verdict.

    Insufficient: no score at all. Pass: a dimension below 4 that is not of high
    uncertainty, or less than 6 in all. Strong: 8 or more, no high uncertainty and
    not stretched. Else Watchlist.
    """
    s, w = F.col(score), F.when(F.col(uncertainty_) == "high", F.col(weight) * 0.7).otherwise(F.col(weight))
    g = dimensions.groupBy(*by).agg(
        F.sum(F.when(s.isNotNull(), s * w)).alias("num"),
        F.sum(F.when(s.isNotNull(), w)).alias("den"),
        F.count(score).cast("bigint").alias("n_scored"),
        F.coalesce(F.bool_or((s < 4.0) & (F.col(uncertainty_) != "high")), F.lit(False)).alias("weak"),
        F.coalesce(F.bool_or(F.col(uncertainty_) == "high"), F.lit(False)).alias("unsure"),
        (F.coalesce(F.bool_or(F.col(stretched)), F.lit(False)) if stretched else F.lit(False)).alias("stretched"),
    )
    total = F.round(F.coalesce(safe_div("num", "den"), F.lit(5.5)), 9)  # so that no order of adding decides a verdict
    g = g.withColumn("score", total)
    verdict = first_of((F.col("n_scored") == 0, "Insufficient"), (F.col("weak") | (F.col("score") < 6.0), "Pass"), ((F.col("score") >= 8.0) & ~F.col("unsure") & ~F.col("stretched"), "Strong"), otherwise="Watchlist")
    return g.withColumn("verdict", verdict).drop("num", "den")


def fixed_weight(df: DataFrame, scores: list[str], weights: tuple[float, ...] = SCORE_WEIGHTS) -> DataFrame:
    """Weighted sum to one place; a missing score adds nothing and its weight is not spread over the rest."""
    total = F.lit(0.0)
    for s, w in zip(scores, weights, strict=True):
        total = total + F.coalesce(F.col(s) * w, F.lit(0.0))
    total = js_round(total, 1)
    return df.withColumns({"total": total, "verdict": first_of((total >= 8.0, "Strong"), (total >= 6.0, "Watchlist"), otherwise="Pass")})


def weight_of(category: str) -> Column:
    return F.coalesce(rank_of(category, CATEGORY_WEIGHT), F.lit(1))


def triage(flags: DataFrame, by: list[str], threshold: float = 12.0) -> DataFrame:
    """Points of a filing, and whether it deserves a deep look.

    flags: a row for each finding with source (item, flag, trend, recurrence,
    beneish, altman, chunks), category, severity and n (occurrences; for chunks the
    failed share). Critical items count 100 and escalate whatever else; three or
    more distinct categories above low (flags and trends) add 2 each; a share of
    failed chunks above 0.3 holds a filing unless a trend is high.
    """
    src, sev, n = F.col("source"), F.col("severity"), F.col("n")
    base = weight_of("category") * rank_of("severity", SEVERITY_MULTIPLIER, 0)
    points = first_of(
        ((src == "item") & (sev == "critical"), F.lit(100.0)),
        ((src == "item") & (sev == "high"), F.lit(8.0)),
        (src == "flag", base * (1 + F.log2(F.greatest(n.cast("double"), F.lit(1.0))) / 2)),
        (src == "trend", base * 2.0),
        (src == "recurrence", base * 1.5),
        ((src == "beneish") & (n > 0), F.lit(5.0)),
        ((src == "altman") & (n > 0), F.lit(6.0)),
        otherwise=0.0,
    )
    telling = src.isin("flag", "trend") & (sev != "low")
    g = flags.groupBy(*by).agg(
        F.sum(F.round(points, 6).cast("decimal(18,6)")).cast("double").alias("points"),
        F.count_distinct(F.when(telling, F.col("category"))).cast("bigint").alias("n_categories"),
        F.coalesce(F.bool_or((src == "item") & (sev == "critical")), F.lit(False)).alias("unconditional"),
        F.coalesce(F.bool_or((src == "trend") & (sev == "high")), F.lit(False)).alias("strong"),
        F.coalesce(F.max(F.when(src == "chunks", n.cast("double"))), F.lit(0.0)).alias("failed"),
    )
    g = g.withColumn("points", F.col("points") + F.when(F.col("n_categories") >= 3, F.col("n_categories") * 2).otherwise(0))
    g = g.withColumn("hold", ~F.col("strong") & (F.col("failed") > 0.3))
    return g.withColumns({"score": js_round("points", 1), "escalate": F.col("unconditional") | ((F.col("points") >= threshold) & ~F.col("hold"))})


def majority(votes: DataFrame, by: list[str], vote: str, size: str, confidence: str, order: str) -> DataFrame:
    """Vote of a few samples: the most frequent direction (ties: neutral, weakens, strengthens), the median size of those that agree, their modal confidence (ties: lower; low without a majority), and the sample closest to the median (the first of equals)."""
    pref = rank_of(vote, {"neutral": 0, "weakens": 1, "strengthens": 2}, 3)
    conf = rank_of(confidence, {"low": 0, "medium": 1, "high": 2}, 3)
    n = votes.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("__n"))
    total = Window.partitionBy(*by)
    won = n.withColumns({"__all": F.sum("__n").over(total), "__rn": F.row_number().over(total.orderBy(F.col("__n").desc(), pref))}).where("__rn = 1").drop("__rn")
    agree = votes.join(won, [*by, vote])
    median = agree.groupBy(*by).agg(F.median(size).alias("magnitude"))
    mode = agree.withColumn("__c", conf).groupBy(*by, "__c", confidence).agg(F.count(F.lit(1)).alias("__k"))
    mode = mode.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__k").desc(), "__c"))).where("__rn = 1").select(*by, F.col(confidence).alias("__mode"))
    near = agree.join(median, by).groupBy(*by).agg(F.min_by(order, F.struct(F.abs(F.col(size) - F.col("magnitude")), F.col(order))).alias("representative"))
    out = won.join(median, by).join(mode, by).join(near, by)
    return out.select(*by, F.col(vote).alias("vote"), F.col("__n").cast("bigint").alias("n_agree"), "magnitude", F.when(F.col("__n") * 2 > F.col("__all"), F.col("__mode")).otherwise("low").alias("confidence"), "representative")


def item_health(signals: DataFrame, by: list[str], direction: str, adverse: str, magnitude: str) -> DataFrame:
    """Neutral or weak (below 0.2) signals say nothing; adverse ones of 0.5 or more are red and tripped, other adverse ones amber, the rest green."""
    level = first_of(((F.col(direction) == "neutral") | (F.col(magnitude) < 0.2), 0), (F.col(adverse) & (F.col(magnitude) >= 0.5), 2), (F.col(adverse), 1), otherwise=0)
    g = signals.groupBy(*by).agg(F.max(level).alias("level"))
    return g.select(*by, first_of((F.col("level") == 2, "red"), (F.col("level") == 1, "amber"), otherwise="green").alias("health"), (F.col("level") == 2).alias("tripped"))
