"""Queries on series, trends, inflections and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import js_round, safe_div
from ..operators import facts, inflections, scores, solver, universe
from ..operators import series as S
from ..operators import trends as T
from .base import AS_OF, COSTS, SERIES, YEARLY, costs, query, series, table, yearly



def _order():
    return [F.col("fy"), F.col("fq")]


def _latest():
    return [F.col("fy").desc(), F.col("fq").desc()]


def _trend_sql(pairs: str, detectors: tuple) -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{w}', '{u}', {n}, {float(x)!r}::DOUBLE)" for a, b, c, w, u, n, x in detectors)
    return f"""WITH {pairs}, det(id, metric, category, worse_when, unit, min_run, min_change) AS (VALUES {rows}),
j AS (SELECT * FROM pairs JOIN det USING (metric)),
k AS (SELECT *, min(CASE WHEN (worse_when = 'higher' AND value > prior_value) OR (worse_when = 'lower' AND value < prior_value) THEN 1 ELSE 0 END)
 OVER (PARTITION BY entity, id ORDER BY fy DESC, fq DESC ROWS UNBOUNDED PRECEDING) AS ok, row_number() OVER (PARTITION BY entity, id ORDER BY fy DESC, fq DESC) AS rn FROM j),
g AS (SELECT entity, id, CAST(sum(ok) AS INTEGER) AS run, max(metric) AS metric, max(unit) AS unit, max(category) AS category, max(min_run) AS min_run, max(min_change) AS min_change,
 max(CASE WHEN rn = 1 THEN value END) AS value, max(CASE WHEN rn = 1 THEN prior_value END) AS prior_value, max(n_periods) AS n_periods, count(*) AS n_pairs FROM k GROUP BY 1, 2),
c AS (SELECT *, CASE unit WHEN 'bps' THEN (value - prior_value) * 10000 WHEN 'percent' THEN CASE WHEN prior_value = 0 THEN 0 ELSE (value - prior_value) / abs(prior_value) END ELSE value - prior_value END AS change
 FROM g WHERE n_periods >= 5 AND n_pairs >= min_run AND run >= min_run)
SELECT entity, id, metric, category, run, round(value, 6) AS value, round(prior_value, 6) AS prior_value, round(change, 6) AS change,
 CASE WHEN run >= 5 OR (run >= 4 AND abs(change) / nullif(abs(min_change), 0) >= 2) THEN 'high' WHEN run >= 4 OR abs(change) / nullif(abs(min_change), 0) >= 2 THEN 'medium' ELSE 'low' END AS severity
FROM c WHERE abs(change) >= min_change"""


def _trend_out(found):
    return found.select("entity", "id", "metric", "category", "run", *(F.round(c, 6).alias(c) for c in ("value", "prior_value", "change")), "severity")


_RUN = (("revenue-declining", "revenue", "guidance", "lower", "percent", 1, 0.01),)
_PAIRS = f"""{SERIES}, counted AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n_periods FROM series),
pairs AS (SELECT a.entity, a.fy, a.fq, a.n_periods, 'revenue' AS metric, a.revenue AS value, b.revenue AS prior_value FROM counted a JOIN series b ON a.entity = b.entity AND a.fq = b.fq AND a.fy = b.fy + 1)"""


def _counted(df):
    from pyspark.sql import Window

    return df.withColumn("n_periods", F.count(F.lit(1)).over(Window.partitionBy("entity")))


@query(_trend_sql(_PAIRS, _RUN))
def q_trend_run(spark, d):
    pairs = S.yoy_pairs(_counted(series(spark, d)), ["entity"], "fy", "fq", ["revenue"])
    long = pairs.select("entity", "fy", "fq", "n_periods", F.lit("revenue").alias("metric"), F.col("revenue").alias("value"), F.col("prior_revenue").alias("prior_value"))
    return _trend_out(T.ordered(T.detect(long, T.detector_table(spark, _RUN), ["entity"], _latest()), "entity", "id"))


_MANY = (
    ("revenue-declining", "revenue", "guidance", "lower", "percent", 1, 0.01),
    ("share-count-growing", "shares", "dilution", "higher", "percent", 1, 0.01),
    ("ticket-shrinking", "ticket", "margin", "lower", "ratio", 1, 10.0),
    ("discount-rising", "discount", "margin", "higher", "bps", 1, 5.0),
    ("volume-days", "volume", "inventory", "higher", "days", 1, 1.0),
)
_WIDE = f"""{SERIES}, {COSTS}, wide AS (SELECT s.entity, s.fy, s.fq, count(*) OVER (PARTITION BY s.entity) AS n_periods, s.revenue, CAST(s.shares AS DOUBLE) AS shares, s.revenue / nullif(s.n, 0) AS ticket, 1 - c.cost / nullif(c.listed, 0) AS discount, c.quantity / nullif(s.n, 0) AS volume
 FROM series s LEFT JOIN costs c ON s.entity = c.entity AND s.fy = c.fy AND s.fq = c.fq),
long AS (UNPIVOT wide ON revenue, shares, ticket, discount, volume INTO NAME metric VALUE value),
pairs AS (SELECT a.entity, a.fy, a.fq, a.n_periods, a.metric, a.value, b.value AS prior_value FROM long a JOIN long b ON a.entity = b.entity AND a.fq = b.fq AND a.metric = b.metric AND a.fy = b.fy + 1)"""


@query(_trend_sql(_WIDE, _MANY))
def q_trend_detectors(spark, d):
    j = series(spark, d).join(costs(spark, d), ["entity", "fy", "fq"], "left")
    wide = _counted(j).select("entity", "fy", "fq", "n_periods", "revenue", F.col("shares").cast("double").alias("shares"), safe_div("revenue", "n").alias("ticket"), (1 - safe_div("cost", "listed")).alias("discount"), safe_div("quantity", "n").alias("volume"))
    long = S.long(wide, ["entity", "fy", "fq", "n_periods"], ["revenue", "shares", "ticket", "discount", "volume"])
    pairs = S.yoy_pairs(long, ["entity", "metric"], "fy", "fq", ["value"])
    return _trend_out(T.detect(pairs, T.detector_table(spark, _MANY), ["entity"], _latest()))


@query(f"""WITH {_WIDE}, d(id, metric) AS (VALUES ('revenue-declining', 'revenue'), ('share-count-growing', 'shares')), r AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY fy DESC, fq DESC) AS rn FROM pairs),
o AS (SELECT entity, id, metric, rn, CASE WHEN id = 'revenue-declining' THEN value < prior_value ELSE value > prior_value END AS worse, value, prior_value FROM r JOIN d USING (metric)),
n AS (SELECT entity, id, metric, coalesce(min(rn) FILTER (NOT coalesce(worse, false)), count(*) + 1) - 1 AS run, max(abs(value - prior_value) / abs(prior_value)) FILTER (rn = 1) AS change FROM o GROUP BY 1, 2, 3)
SELECT n.entity, n.id, CAST(count(*) AS INTEGER) AS n_shown, round(arg_min(r.value, (r.fy, r.fq)), 2) AS oldest, round(arg_max(r.value, (r.fy, r.fq)), 2) AS latest FROM n JOIN r ON r.entity = n.entity AND r.metric = n.metric AND r.rn <= greatest(n.run, 6) WHERE n.run >= 1 AND n.change >= 0.01 GROUP BY 1, 2""")
def q_trend_series(spark, d):
    wide = _counted(series(spark, d)).select("entity", "fy", "fq", "n_periods", "revenue", F.col("shares").cast("double").alias("shares"))
    pairs = S.yoy_pairs(S.long(wide, ["entity", "fy", "fq", "n_periods"], ["revenue", "shares"]), ["entity", "metric"], "fy", "fq", ["value"])
    found = T.detect(pairs, T.detector_table(spark, _MANY[:2]), ["entity"], _latest())
    out = T.with_series(found, pairs, ["entity"], ["fy", "fq"])
    at = lambda i: F.round(F.element_at("series", i)["value"], 2)
    return out.select("entity", "id", F.size("series").alias("n_shown"), at(1).alias("oldest"), at(-1).alias("latest"))


@query(f"WITH {SERIES} SELECT a.entity, a.fy, a.fq, a.revenue, b.revenue AS prior_revenue, round(a.revenue / nullif(b.revenue, 0) - 1, 6) AS growth FROM series a JOIN series b ON a.entity = b.entity AND a.fq = b.fq AND a.fy = b.fy + 1")
def q_yoy_pairs(spark, d):
    p = S.yoy_pairs(series(spark, d), ["entity"], "fy", "fq", ["revenue"])
    return p.select("entity", "fy", "fq", "revenue", "prior_revenue", F.round(safe_div("revenue", "prior_revenue") - 1, 6).alias("growth"))


@query(f"""WITH {SERIES}, {COSTS}, w AS (SELECT s.entity, s.fy, s.fq, s.revenue, c.cost AS costOfRevenue, c.listed AS totalAssets, c.quantity AS inventory, s.n * 1000.0 AS accountsReceivable, s.shares * 500.0 AS accountsPayable
 FROM series s LEFT JOIN costs c ON s.entity = c.entity AND s.fy = c.fy AND s.fq = c.fq),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy DESC, fq DESC) AS rn FROM w WHERE revenue IS NOT NULL)
SELECT entity, fy, fq, round(accountsReceivable / nullif(revenue, 0) * 91.25, 6) AS dso, round(inventory / nullif(costOfRevenue, 0) * 91.25, 6) AS dio, round(accountsPayable / nullif(costOfRevenue, 0) * 91.25, 6) AS dpo,
 round(accountsReceivable / nullif(revenue, 0) * 91.25 + inventory / nullif(costOfRevenue, 0) * 91.25 - accountsPayable / nullif(costOfRevenue, 0) * 91.25, 6) AS ccc, round((revenue - costOfRevenue) / nullif(revenue, 0), 6) AS gross_margin FROM r WHERE rn <= 13""")
def q_ratio_pivot(spark, d):
    j = series(spark, d).join(costs(spark, d), ["entity", "fy", "fq"], "left")
    wide = j.select("entity", "fy", "fq", "revenue", F.col("cost").alias("costOfRevenue"), F.col("listed").alias("totalAssets"), F.col("quantity").alias("inventory"), (F.col("n") * 1000.0).alias("accountsReceivable"), (F.col("shares") * 500.0).alias("accountsPayable"))
    names = ["revenue", "costOfRevenue", "totalAssets", "inventory", "accountsReceivable", "accountsPayable"]
    long = S.long(wide, ["entity", "fy", "fq"], names)  # as facts come: one row for each concept
    back = S.wide(long, ["entity", "fy", "fq"], "metric", "value", names, "revenue")
    out = S.recent(S.ratios(back), ["entity"], _latest(), 13)
    return out.select("entity", "fy", "fq", *(F.round(a, 6).alias(b) for a, b in (("dso", "dso"), ("dio", "dio"), ("dpo", "dpo"), ("ccc", "ccc"), ("grossMargin", "gross_margin"))))


@query(f"""WITH {SERIES}, e AS (SELECT *, last_day(make_date(fy, fq * 3, 1)) AS period_end FROM series)
SELECT entity, fy, fq, period_end, revenue FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS rn FROM e WHERE period_end <= DATE '{AS_OF}') WHERE rn <= 13""")
def q_recent_n(spark, d):
    e = series(spark, d).withColumn("period_end", F.last_day(F.make_date("fy", F.col("fq") * 3, F.lit(1))))
    return S.recent(S.as_of(e, "period_end", AS_OF), ["entity"], [F.col("period_end").desc()], 13).select("entity", "fy", "fq", "period_end", "revenue")


_PROFIT = f"""WITH {SERIES}, m AS (SELECT *, revenue - avg(revenue) OVER (PARTITION BY entity ORDER BY fy, fq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM series),
c AS (SELECT entity, fy, fq, revenue, round(x, 2) AS profit FROM m)"""


def _turn_sql(head: str, value: str, least: float, run: int) -> str:
    return f"""{head}, t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy DESC, fq DESC) AS rn FROM c WHERE {value} IS NOT NULL),
k AS (SELECT *, min(CASE WHEN rn = 1 THEN CASE WHEN {value} > 0 THEN 1 ELSE 0 END WHEN {value} <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY rn ROWS UNBOUNDED PRECEDING) AS ok FROM t WHERE rn <= 9),
g AS (SELECT entity, CAST(sum(ok) - 1 AS INTEGER) AS run, max(CASE WHEN rn = 1 THEN {value} END) AS latest, max(CASE WHEN rn = 1 THEN revenue END) AS base FROM k GROUP BY 1)
SELECT entity, run, round(latest, 6) AS latest, CASE WHEN run >= 4 THEN 'critical' ELSE 'high' END AS severity FROM g WHERE latest > 0 AND run >= {run} AND base >= {least}"""


@query(_turn_sql(_PROFIT, "profit", 1e5, 1))
def q_loss_run_turn(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("fy", "fq").rowsBetween(-3, 0)
    c = series(spark, d).withColumn("profit", F.round(F.col("revenue") - F.avg("revenue").over(w), 2))
    out = inflections.turn(c, ["entity"], _latest(), "profit", "revenue", least_base=1e5, least_run=1)
    return out.select("entity", "run", F.round("latest_profit", 6).alias("latest"), "severity")


@query(_turn_sql(f"WITH {SERIES}, {COSTS}, c AS (SELECT s.entity, s.fy, s.fq, s.revenue, s.revenue * 1.1 - coalesce(abs(c.cost), 0) AS fcf FROM series s LEFT JOIN costs c ON s.entity = c.entity AND s.fy = c.fy AND s.fq = c.fq)", "fcf", 1e5, 1))
def q_fcf_turn(spark, d):
    j = series(spark, d).join(costs(spark, d), ["entity", "fy", "fq"], "left")
    c = j.withColumn("fcf", F.col("revenue") * 1.1 - F.coalesce(F.abs("cost"), F.lit(0.0)))
    out = inflections.turn(c, ["entity"], _latest(), "fcf", "revenue", least_base=1e5, least_run=1)
    return out.select("entity", "run", F.round("latest_fcf", 6).alias("latest"), "severity")


def _back_sql(head: str, value: str, back: tuple[int, ...]) -> str:
    lags = ", ".join(f"lag({value}, {k}) OVER w AS b{k}" for k in back)
    return f"""{head}, l AS (SELECT *, {lags}, row_number() OVER (PARTITION BY entity ORDER BY fy DESC, fq DESC) AS rn FROM x WINDOW w AS (PARTITION BY entity ORDER BY fy, fq))"""


_X = f"WITH {SERIES}, x AS (SELECT entity, fy, fq, CAST(n AS DOUBLE) AS v FROM series)"


@query(_back_sql(f"WITH {SERIES}, x AS (SELECT entity, fy, fq, revenue AS v FROM series)", "v", (1, 4, 5)) + """, g AS (SELECT entity, v / nullif(b4, 0) - 1 AS g0, b1 / nullif(b5, 0) - 1 AS g1 FROM l WHERE rn = 1 AND b5 IS NOT NULL AND b4 > 0 AND b5 > 0 AND b4 >= 1000)
SELECT entity, round(g0, 6) AS g0, round(g1, 6) AS g1, CASE WHEN g0 >= 0.5 AND g0 - g1 >= 0.2 THEN 'critical' ELSE 'high' END AS severity FROM g WHERE (g0 >= 0.5 AND g0 - g1 >= 0.2) OR (g0 >= 0.25 AND g0 - g1 >= 0.1)""")
def q_acceleration(spark, d):
    out = inflections.acceleration(series(spark, d), ["entity"], _order(), "revenue", least_base=1000)
    return out.select("entity", F.round("g0", 6).alias("g0"), F.round("g1", 6).alias("g1"), "severity")


_QY = ", g AS (SELECT entity, CASE WHEN b1 > 0 THEN v / b1 - 1 END AS qoq, CASE WHEN b4 > 0 THEN v / b4 - 1 END AS yoy FROM l WHERE rn = 1)"


def _counts(spark, d):
    return series(spark, d).select("entity", "fy", "fq", F.col("n").cast("double").alias("v"))


@query(_back_sql(_X, "v", (1, 4)) + _QY + """ SELECT entity, round(qoq, 6) AS qoq, round(yoy, 6) AS yoy, CASE WHEN qoq >= 0.25 THEN 'critical' WHEN qoq >= 0.10 THEN 'high' WHEN yoy >= 0.5 THEN 'high' WHEN yoy >= 0.25 THEN 'medium' END AS severity
FROM g WHERE NOT coalesce(qoq > 20, false) AND (qoq >= 0.10 OR yoy >= 0.25)""")
def q_dilution(spark, d):
    out = inflections.dilution(_counts(spark, d), ["entity"], _order(), "v")
    return out.select("entity", F.round("qoq", 6).alias("qoq"), F.round("yoy", 6).alias("yoy"), "severity")


@query(_back_sql(_X, "v", (1, 4)) + _QY + """ SELECT entity, round(qoq, 6) AS qoq, round(yoy, 6) AS yoy, CASE WHEN qoq <= -0.05 OR yoy <= -0.10 THEN 'critical' WHEN qoq <= -0.02 OR yoy <= -0.05 THEN 'high' ELSE 'medium' END AS severity
FROM g WHERE NOT coalesce(qoq <= -0.30 OR yoy <= -0.40, false) AND (qoq <= -0.02 OR yoy <= -0.02)""")
def q_buyback(spark, d):
    out = inflections.buyback(_counts(spark, d), ["entity"], _order(), "v")
    return out.select("entity", F.round("qoq", 6).alias("qoq"), F.round("yoy", 6).alias("yoy"), "severity")


@query(f"""WITH {SERIES}, {COSTS}, x AS (SELECT s.entity, s.fy, s.fq, CAST(s.revenue AS DOUBLE) AS cash, s.revenue * 0.5 - c.cost AS fcf FROM series s JOIN costs c ON s.entity = c.entity AND s.fy = c.fy AND s.fq = c.fq),
l AS (SELECT *, CAST(sum(CAST(fcf AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total, count(fcf) OVER w AS k, row_number() OVER (PARTITION BY entity ORDER BY fy DESC, fq DESC) AS rn FROM x WINDOW w AS (PARTITION BY entity ORDER BY fy, fq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
g AS (SELECT entity, cash / (-total / k) AS quarters FROM l WHERE rn = 1 AND k >= 3 AND total < 0 AND cash > 0)
SELECT entity, round(quarters, 6) AS quarters, CASE WHEN quarters < 2 THEN 'critical' WHEN quarters < 4 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE quarters < 6""")
def q_runway(spark, d):
    j = series(spark, d).join(costs(spark, d), ["entity", "fy", "fq"])
    x = j.select("entity", "fy", "fq", F.col("revenue").alias("cash"), (F.col("revenue") * 0.5 - F.col("cost")).alias("fcf"))
    return inflections.runway(x, ["entity"], _order(), "cash", "fcf").select("entity", F.round("quarters", 6).alias("quarters"), "severity")


@query(f"""WITH {YEARLY}, x AS (SELECT *, first_value(shares) OVER w AS f, count(*) OVER w - 1 AS years, row_number() OVER (PARTITION BY entity ORDER BY fy DESC) AS rn FROM yearly WINDOW w AS (PARTITION BY entity ORDER BY fy ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
g AS (SELECT entity, CAST(years AS INTEGER) AS years, CASE WHEN years >= 1 AND f > 0 AND shares > 0 THEN pow(shares / f, 1.0 / years) - 1 END AS cagr FROM x WHERE rn = 1)
SELECT entity, years, round(cagr, 6) AS cagr, CASE WHEN cagr > 0.02 THEN 'growing' WHEN cagr < -0.01 THEN 'shrinking' WHEN cagr IS NOT NULL THEN 'flat' END AS label FROM g""")
def q_share_trend(spark, d):
    out = inflections.share_trend(yearly(spark, d), ["entity"], [F.col("fy")], "shares")
    return out.select("entity", "years", F.round("cagr", 6).alias("cagr"), "label")


@query(f"""WITH {YEARLY}, z AS (SELECT entity, fy, CASE WHEN revenue / nullif(n, 0) < 248000 THEN 'distress' WHEN revenue / nullif(n, 0) > 254000 THEN 'safe' ELSE 'grey' END AS zone, CASE WHEN entity % 2 = 0 THEN 'small' ELSE 'mid-plus' END AS tier FROM yearly)
SELECT entity, fy, zone, lag(zone) OVER (PARTITION BY entity ORDER BY fy) AS prior_zone, coalesce(zone = 'distress' AND lag(zone) OVER (PARTITION BY entity ORDER BY fy) IN ('safe', 'grey') AND tier IN ('nano', 'micro', 'small'), false) AS is_news FROM z""")
def q_transition(spark, d):
    ticket = safe_div("revenue", "n")
    z = yearly(spark, d).select("entity", "fy", F.when(ticket < 248000, "distress").when(ticket > 254000, "safe").otherwise("grey").alias("zone"), F.when(F.col("entity") % 2 == 0, "small").otherwise("mid-plus").alias("tier"))
    return inflections.zone_news(z, ["entity"], [F.col("fy")], "zone", "tier").select("entity", "fy", "zone", "prior_zone", F.coalesce("is_news", F.lit(False)).alias("is_news"))


_ANNUAL = f"""{YEARLY}, a AS (SELECT entity, fy, revenue, listed - cost AS "grossProfit", n * 900.0 AS "accountsReceivable", listed * 2 AS "totalAssets", revenue * 0.4 AS "currentAssets", cost * 0.3 AS "ppeNet", quantity * 10 AS "depreciationAmortization",
 shares * 3000.0 AS sga, cost * 0.2 AS "currentLiabilities", quantity * 55 AS "longTermDebt", revenue * 0.08 AS "incomeContinuingOps", revenue * 0.05 AS cfo, revenue * 0.3 - n * 100 AS "retainedEarnings", revenue * 0.1 AS "operatingIncome", listed * 0.9 AS equity, listed * 1.1 AS "totalLiabilities" FROM yearly)"""


def _annual(spark, d):
    y = yearly(spark, d)
    c = F.col
    return y.select(
        "entity", "fy", "revenue", (c("listed") - c("cost")).alias("grossProfit"), (c("n") * 900.0).alias("accountsReceivable"), (c("listed") * 2).alias("totalAssets"), (c("revenue") * 0.4).alias("currentAssets"),
        (c("cost") * 0.3).alias("ppeNet"), (c("quantity") * 10).alias("depreciationAmortization"), (c("shares") * 3000.0).alias("sga"), (c("cost") * 0.2).alias("currentLiabilities"), (c("quantity") * 55).alias("longTermDebt"),
        (c("revenue") * 0.08).alias("incomeContinuingOps"), (c("revenue") * 0.05).alias("cfo"), (c("revenue") * 0.3 - c("n") * 100).alias("retainedEarnings"), (c("revenue") * 0.1).alias("operatingIncome"), (c("listed") * 0.9).alias("equity"), (c("listed") * 1.1).alias("totalLiabilities"),
    )


@query(f"""WITH {_ANNUAL}, p AS (SELECT t.*, p.revenue AS p_revenue, p."grossProfit" AS p_gp, p."accountsReceivable" AS p_ar, p."totalAssets" AS p_ta, p."currentAssets" AS p_ca, p."ppeNet" AS p_ppe, p."depreciationAmortization" AS p_da, p.sga AS p_sga, p."currentLiabilities" AS p_cl, p."longTermDebt" AS p_ltd
 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy DESC) AS rn FROM a) t JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy DESC) AS rn FROM a) p ON t.entity = p.entity AND t.rn = 1 AND p.rn = 2),
i AS (SELECT entity, fy, ("accountsReceivable" / nullif(revenue, 0)) / nullif(p_ar / nullif(p_revenue, 0), 0) AS dsri, (p_gp / nullif(p_revenue, 0)) / nullif("grossProfit" / nullif(revenue, 0), 0) AS gmi,
 (1 - ("currentAssets" + "ppeNet") / nullif("totalAssets", 0)) / nullif(1 - (p_ca + p_ppe) / nullif(p_ta, 0), 0) AS aqi, revenue / nullif(p_revenue, 0) AS sgi,
 (p_da / nullif(p_da + p_ppe, 0)) / nullif("depreciationAmortization" / nullif("depreciationAmortization" + "ppeNet", 0), 0) AS depi, (sga / nullif(revenue, 0)) / nullif(p_sga / nullif(p_revenue, 0), 0) AS sgai,
 (("currentLiabilities" + "longTermDebt") / nullif("totalAssets", 0)) / nullif((p_cl + p_ltd) / nullif(p_ta, 0), 0) AS lvgi, ("incomeContinuingOps" - cfo) / nullif("totalAssets", 0) AS tata FROM p),
f AS (SELECT entity, fy, coalesce(dsri, 1) AS dsri, coalesce(gmi, 1) AS gmi, coalesce(aqi, 1) AS aqi, coalesce(sgi, 1) AS sgi, coalesce(depi, 1) AS depi, coalesce(sgai, 1) AS sgai, coalesce(lvgi, 1) AS lvgi, coalesce(tata, 0) AS tata FROM i),
m AS (SELECT *, -4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi AS m FROM f)
SELECT entity, fy, round(m, 3) AS m_score, m > -1.78 AS flagged, round(dsri, 6) AS dsri, round(aqi, 6) AS aqi,
 (SELECT CASE WHEN x > 0 THEN name END FROM (VALUES (0.92 * (dsri - 1), 0, 'DSRI'), (0.528 * (gmi - 1), 1, 'GMI'), (0.404 * (aqi - 1), 2, 'AQI'), (0.892 * (sgi - 1), 3, 'SGI'), (0.115 * (depi - 1), 4, 'DEPI'), (-0.172 * (sgai - 1), 5, 'SGAI'), (4.679 * tata, 6, 'TATA'), (-0.327 * (lvgi - 1), 7, 'LVGI')) v(x, o, name) ORDER BY x DESC, o LIMIT 1) AS dominant FROM m""")
def q_beneish(spark, d):
    out = scores.beneish(_annual(spark, d), ["entity"], "fy")
    return out.select("entity", "fy", "m_score", "flagged", F.round("DSRI", 6).alias("dsri"), F.round("AQI", 6).alias("aqi"), "dominant")


@query(f"""WITH {_ANNUAL}, x AS (SELECT entity, fy, 6.56 * (("currentAssets" - "currentLiabilities") / nullif("totalAssets", 0)) + 3.26 * ("retainedEarnings" / nullif("totalAssets", 0)) + 6.72 * ("operatingIncome" / nullif("totalAssets", 0)) + 1.05 * (equity / nullif("totalLiabilities", 0)) AS z FROM a)
SELECT entity, fy, round(z, 2) AS z_score, CASE WHEN z < 1.1 THEN 'distress' WHEN z > 2.6 THEN 'safe' WHEN z IS NOT NULL THEN 'grey' ELSE 'unknown' END AS zone FROM x""")
def q_altman(spark, d):
    return scores.altman(_annual(spark, d)).select("entity", "fy", "z_score", "zone")


def _dcf_input(spark, d):
    return yearly(spark, d).select("entity", "fy", (F.col("revenue") * 0.05).alias("fcf"), (F.col("revenue") * (1.0 + (F.col("entity") % 5) * 0.25)).alias("price"))


_PV = "list_sum(list_transform(range(1, 11), lambda t: fcf * pow(1 + {g}, t) / pow(1 + discount, t))) + fcf * pow(1 + {g}, 10) * multiple / pow(1 + discount, 10)"


@query(f"""WITH RECURSIVE {YEARLY}, x AS (SELECT entity, fy, revenue * 0.05 AS fcf, revenue * (1.0 + (entity % 5) * 0.25) AS price FROM yearly),
cells AS (SELECT * FROM x, (VALUES (0.08::DOUBLE), (0.10), (0.12)) a(discount), (VALUES (15.0::DOUBLE), (20.0), (25.0)) b(multiple)),
s AS (SELECT *, 0 AS i, -0.10::DOUBLE AS lo, 0.50::DOUBLE AS hi, NULL::DOUBLE AS g FROM cells
 UNION ALL SELECT entity, fy, fcf, price, discount, multiple, i + 1, CASE WHEN pv < price THEN mid ELSE lo END, CASE WHEN pv < price THEN hi ELSE mid END, CASE WHEN abs(pv - price) / price < 0.001 THEN mid END
 FROM (SELECT *, {_PV.format(g='mid')} AS pv FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE g IS NULL AND i < 60))),
r AS (SELECT entity, fy, discount, multiple, any_value(fcf) AS fcf, any_value(price) AS price, coalesce(max(g), max((lo + hi) / 2) FILTER (i = 60)) AS g FROM s GROUP BY 1, 2, 3, 4)
SELECT entity, fy, discount, multiple, CASE WHEN fcf > 0 AND price > 0 AND {_PV.format(g='(-0.10::DOUBLE)')} <= price AND {_PV.format(g='0.50::DOUBLE')} >= price THEN round(g, 9) END AS implied_growth FROM r""")
def q_reverse_dcf(spark, d):
    out = solver.reverse_dcf(_dcf_input(spark, d), "fcf", "price")
    return out.select("entity", "fy", "discount", "multiple", F.round("implied_growth", 9).alias("implied_growth"))


@query(f"""WITH {YEARLY}, m AS (SELECT entity, (n * 40000.0) / nullif(revenue * 0.05, 0) AS pe FROM yearly)
SELECT entity, CASE WHEN count(*) FILTER (pe > 0 AND pe < 200) >= 5 THEN round(median(CASE WHEN pe > 0 AND pe < 200 THEN pe END), 6) END AS median_pe, count(*) FILTER (pe > 0 AND pe < 200) AS n FROM m GROUP BY 1""")
def q_hist_multiples(spark, d):
    x = yearly(spark, d).select("entity", (F.col("n") * 40000.0).alias("price"), (F.col("revenue") * 0.05).alias("earnings"))
    return universe.historical_multiple(x, ["entity"], "price", "earnings", 200.0).select("entity", F.round("median", 6).alias("median_pe"), "n")


# --- facts: entity = supplier, tag = return flag (priority A, N, R), period = quarter of shipping, filed = order date


def _facts(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice")
    j = line.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    priority = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return j.select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("tag"), priority.alias("priority"), F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("fq"), F.col("o_orderdate").cast("date").alias("filed"), F.col("l_orderkey").alias("accn"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("val"))


_FACTS = """facts AS (SELECT l_suppkey AS entity, l_returnflag AS tag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS priority, CAST(year(l_shipdate) AS INTEGER) AS fy, CAST(quarter(l_shipdate) AS INTEGER) AS fq,
 CAST(o_orderdate AS DATE) AS filed, l_orderkey AS accn, l_linenumber AS line, l_extendedprice AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"WITH {_FACTS}, b AS (SELECT *, min(priority) OVER (PARTITION BY entity, fy, fq) AS best FROM facts) SELECT entity, fy, fq, min(tag) AS tag, count(*) AS n, CAST(sum(CAST(val AS DECIMAL(18,2))) AS DOUBLE) AS total FROM b WHERE priority = best GROUP BY 1, 2, 3")
def q_claim_priority(spark, d):
    best = facts.claim(_facts(spark, d), ["entity", "fy", "fq"])
    return best.groupBy("entity", "fy", "fq").agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("n"), F.sum(F.col("val").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"""WITH {_FACTS}, v AS (SELECT entity, accn, line, CASE WHEN accn % 97 = 0 THEN val * 1e-6 ELSE val END AS val FROM facts), e AS (SELECT *, CASE WHEN val <> 0 THEN CAST(floor(log10(abs(val)) + 0.5) AS INTEGER) END AS e FROM v),
m AS (SELECT *, CAST(floor(quantile_cont(e, 0.5) OVER (PARTITION BY entity) + 0.5) AS INTEGER) AS m, count(e) OVER (PARTITION BY entity) AS k FROM e)
SELECT entity, count(*) FILTER (k >= 4 AND abs(m - e) >= 3) AS n_repaired, count(*) AS n, round(max(CASE WHEN k >= 4 AND abs(m - e) >= 3 THEN val * pow(10.0, m - e) ELSE val END), 2) AS largest FROM m GROUP BY 1""")
def q_scale_repair(spark, d):
    v = _facts(spark, d).withColumn("val", F.when(F.col("accn") % 97 == 0, F.col("val") * 1e-6).otherwise(F.col("val")))
    r = facts.repair_scale(v, ["entity"], "val")
    return r.groupBy("entity").agg(F.count_if("repaired").alias("n_repaired"), F.count(F.lit(1)).alias("n"), F.round(F.max("val"), 2).alias("largest"))


@query(f"""WITH RECURSIVE {_FACTS}, o AS (SELECT *, row_number() OVER (PARTITION BY entity, fy, fq ORDER BY filed, accn, line, val) AS rn FROM facts),
f AS (SELECT entity, fy, fq, rn, val AS now, CAST(NULL AS DOUBLE) AS was FROM o WHERE rn = 1
 UNION ALL SELECT f.entity, f.fy, f.fq, o.rn, CASE WHEN abs(f.now - o.val) > 0.005 * greatest(abs(f.now), abs(o.val), 1.0) THEN o.val ELSE f.now END,
  CASE WHEN abs(f.now - o.val) > 0.005 * greatest(abs(f.now), abs(o.val), 1.0) THEN coalesce(f.was, f.now) ELSE f.was END FROM f JOIN o ON o.entity = f.entity AND o.fy = f.fy AND o.fq = f.fq AND o.rn = f.rn + 1)
SELECT entity, fy, fq, now AS value, was AS restated_from, CAST(rn AS INTEGER) AS n_reports FROM f
 QUALIFY row_number() OVER (PARTITION BY entity, fy, fq ORDER BY rn DESC) = 1""")
def q_collapse_reports(spark, d):
    return facts.collapse(_facts(spark, d), ["entity", "fy", "fq"], "filed", "val", ["accn", "line"])


@query(f"""WITH {SERIES}, q AS (SELECT entity, fy, max(revenue) FILTER (fq = 1) AS q1, max(revenue) FILTER (fq = 2) AS q2, max(revenue) FILTER (fq = 3) AS q3, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS y, max(revenue) FILTER (fq = 4) AS q4 FROM series GROUP BY 1, 2)
SELECT entity, fy, 'Q4' AS fp, round(y - (q1 + q2 + q3), 2) AS value, true AS derived FROM q WHERE q4 IS NOT NULL AND fy % 2 = 0 AND q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL
UNION ALL SELECT entity, fy, 'Q' || fq, round(revenue, 2), false FROM series WHERE fq < 4 OR fy % 2 = 1""")
def q_residual_q4(spark, d):
    s = series(spark, d)
    quarters = s.where("fq < 4 or fy % 2 = 1").select("entity", "fy", F.concat(F.lit("Q"), F.col("fq").cast("string")).alias("fp"), F.col("revenue").alias("value"))
    years = s.groupBy("entity", "fy").agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("value"), F.max("fq").alias("last")).where("last = 4").select("entity", "fy", F.lit("FY").alias("fp"), "value")
    out = facts.residual_quarter(quarters.unionByName(years), ["entity"], "fy", "fp", "value")
    return out.withColumn("value", F.round("value", 2))


@query("""WITH f AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(o_orderdate AS DATE) AS period_end, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS rank, o_orderkey, o_totalprice FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY entity, fy, period_end ORDER BY rank DESC, o_orderkey) AS rn FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY entity, fy ORDER BY period_end DESC) AS rk FROM a WHERE rn = 1)
SELECT entity, fy, period_end, o_orderkey, o_totalprice FROM b WHERE rk = 1""")
def q_annual_dedupe(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy"), F.col("o_orderdate").cast("date").alias("period_end"), "o_orderpriority", "o_orderkey", "o_totalprice")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    return facts.annual(f, ["entity"], "fy", "period_end", rank, [F.col("o_orderkey")]).select("entity", "fy", "period_end", "o_orderkey", "o_totalprice")


@query(f"""WITH {YEARLY}, l AS (SELECT entity, fy, revenue, lag(revenue) OVER (PARTITION BY entity ORDER BY fy) AS prior FROM yearly) SELECT entity, fy, round(greatest(revenue, prior) / least(revenue, prior), 6) AS ratio FROM l WHERE prior > 0 AND revenue > 0 AND greatest(revenue, prior) / least(revenue, prior) > 1.05""")
def q_discontinuity(spark, d):
    return facts.discontinuities(yearly(spark, d), ["entity"], "fy", "revenue", 1.05).select("entity", "fy", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {YEARLY}, g AS (SELECT entity, fy, revenue / nullif(lag(revenue) OVER (PARTITION BY entity ORDER BY fy), 0) - 1 AS implied, shares / nullif(lag(shares) OVER (PARTITION BY entity ORDER BY fy), 0) - 1 AS actual FROM yearly)
SELECT entity, fy, coalesce(abs(implied - actual) * 100 > 2, false) AS flagged, CASE WHEN abs(implied - actual) * 100 > 2 THEN CASE WHEN implied < actual THEN 'below' ELSE 'above' END END AS direction FROM g""")
def q_val_gap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("fy")
    g = yearly(spark, d).select("entity", "fy", (safe_div(F.col("revenue"), F.lag("revenue").over(w)) - 1).alias("implied"), (safe_div(F.col("shares"), F.lag("shares").over(w)) - 1).alias("actual"))
    flag, way = universe.valuation_gap(F.col("implied"), F.col("actual"), 2.0)
    return g.select("entity", "fy", F.coalesce(flag, F.lit(False)).alias("flagged"), way.alias("direction"))


@query(f"""WITH {YEARLY} SELECT entity, CAST(max(CASE WHEN fy = 1998 THEN floor(revenue / 1e6 + 0.5) END) AS BIGINT) AS y1998, CAST(max(CASE WHEN fy = 1999 THEN floor(revenue / 1e6 + 0.5) END) AS BIGINT) AS y1999, CAST(max(CASE WHEN fy = 2000 THEN floor(revenue / 1e6 + 0.5) END) AS BIGINT) AS y2000 FROM yearly GROUP BY 1""")
def q_year_pivot(spark, d):
    p = yearly(spark, d).groupBy("entity").pivot("fy", [1998, 1999, 2000]).agg(F.first(js_round(F.col("revenue") / 1e6)))
    return p.select("entity", *(F.col(str(y)).cast("bigint").alias(f"y{y}") for y in (1998, 1999, 2000)))


@query(f"""WITH {SERIES}, n AS (SELECT entity, count(*) AS n_periods, max(fy * 10 + fq) AS latest FROM series GROUP BY 1) SELECT entity, n_periods, CAST(latest AS INTEGER) AS latest, n_periods < 5 AS too_few FROM n""")
def q_series_coverage(spark, d):
    g = series(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n_periods"), F.max(F.col("fy") * 10 + F.col("fq")).cast("int").alias("latest"))
    return g.withColumn("too_few", F.col("n_periods") < 5)
