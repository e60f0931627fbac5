"""Point-in-time series: as-of bounds, year-over-year pairs, wide pivots, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import columns_of, safe_div


def as_of(df: DataFrame, end: str, bound: str | Column, filed: str | None = None) -> DataFrame:
    """Rows whose period had ended by the bound; with filed, whose report was also filed by then."""
    b = F.lit(bound).cast("date") if isinstance(bound, str) else bound
    df = df.where(F.col(end) <= b)
    return df.where(F.col(filed) <= b) if filed else df


def recent(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; order: latest first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def yoy_pairs(df: DataFrame, by: list[str], fy: str, fp: str, values: list[str]) -> DataFrame:
    """Each period beside the same fiscal period a year before (a gap drops a pair, it never shifts one).

    Pairs need both values; with several value columns a pair stays while any has both.
    One shuffle on (by, fp): both sides are hashed alike.
    """
    prior = df.select(*by, F.col(fp), (F.col(fy) + 1).alias(fy), *(F.col(v).alias(f"prior_{v}") for v in values))
    out = df.join(prior, [*by, fp, fy])
    real = [F.col(v).isNotNull() & F.col(f"prior_{v}").isNotNull() & ~F.isnan(F.col(v).cast("double")) & ~F.isnan(F.col(f"prior_{v}").cast("double")) for v in values]
    keep = real[0]
    for r in real[1:]:
        keep = keep | r
    return out.where(keep)


def wide(df: DataFrame, by: list[str], name: str, value: str, names: list[str], needs: str | None = None) -> DataFrame:
    """Long facts to a column for each name, in one aggregation; rows without `needs` are no period."""
    out = columns_of(df, by, name, value, {n: n for n in names})
    return out.where(F.col(needs).isNotNull()) if needs else out


def long(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """A row for each named column."""
    return df.unpivot(by, names, "metric", "value")


def ratios(df: DataFrame, days: float = 91.25) -> DataFrame:
    """Quarterly ratios of a wide frame of concepts; a concept that df lacks is null.

    A ratio whose parts are missing or whose denominator is 0 is null. Net debt is
    null without any debt concept; a missing side of it counts as 0.
    """

    def c(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    revenue, cost = c("revenue"), c("costOfRevenue")
    gross = F.coalesce(c("grossProfit"), revenue - cost)
    dso, dio, dpo = (safe_div(c(a), b) * days for a, b in (("accountsReceivable", revenue), ("inventory", cost), ("accountsPayable", cost)))
    debt = F.when(c("longTermDebt").isNotNull() | c("shortTermDebt").isNotNull(), F.coalesce(c("longTermDebt"), F.lit(0.0)) + F.coalesce(c("shortTermDebt"), F.lit(0.0)))
    net_debt = debt - F.coalesce(c("cash"), F.lit(0.0))
    return df.withColumns(
        {
            "dso": dso,
            "dio": dio,
            "dpo": dpo,
            "ccc": dso + dio - dpo,
            "grossMargin": safe_div(gross, revenue),
            "operatingMargin": safe_div(c("operatingIncome"), revenue),
            "netMargin": safe_div(c("netIncome"), revenue),
            "cfoToNetIncome": F.when(c("netIncome") > 0, safe_div(c("cfo"), c("netIncome"))),
            "accrualRatio": safe_div(c("netIncome") - c("cfo"), c("totalAssets")),
            "sgaToRevenue": safe_div(c("sga"), revenue),
            "capexToDepreciation": safe_div(F.abs(c("capex")), c("depreciationAmortization")),
            "netDebt": net_debt,
            "netDebtToAssets": safe_div(net_debt, c("totalAssets")),
            "inventoryToRevenue": safe_div(c("inventory"), revenue),
        }
    )
