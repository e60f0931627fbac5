"""Column expressions used all over: guarded arithmetic, rounding, text normal forms, run lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Name, b: Name) -> Column:
    """a / b in doubles; null where b is 0 or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def js_round(x: Name, places: int = 0) -> Column:
    """Half up, towards plus infinity."""
    scale = 10.0**places
    return F.floor(col(x) * scale + 0.5) / scale if places else F.floor(col(x) + 0.5)


def money_sum(x: Name) -> Column:
    """An exact sum of amounts with cents, as a double; it does not depend on the order of rows."""
    return F.sum(col(x).cast("decimal(18,2)")).cast("double")


def ladder(x: Column, *steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, value in reversed(steps):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def first_of(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    return ladder(F.lit(None), *steps, otherwise=otherwise)


def trailing_run(flag: Name, by: list[str], order_desc: list[Column]) -> tuple[WindowSpec, Column]:
    """How many of the latest rows in a row have the flag: over the returned window, sum the returned column."""
    w = Window.partitionBy(*by).orderBy(*order_desc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return w, F.min(F.coalesce(col(flag).cast("int"), F.lit(0))).over(w)


def columns_of(df: DataFrame, by: list[str], name: Name, value: str, names: dict[str, object]) -> DataFrame:
    """Long rows to a column for each of the named values (column to value): one aggregation, combined before its shuffle."""
    return df.groupBy(*by).agg(*(F.first(F.when(col(name) == v, F.col(value)), ignorenulls=True).alias(c) for c, v in names.items()))


def rank_of(x: Name, ranks: dict[str, int], otherwise: int | None = None) -> Column:
    """A word's rank in a fixed order."""
    return first_of(*((col(x) == k, v) for k, v in ranks.items()), otherwise=otherwise)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def norm_space(x: Name) -> Column:
    """White space (no-break space too) folded to one space and trimmed."""
    return F.trim(F.regexp_replace(F.translate(col(x), " ", " "), r"\s+", " "))


def norm_punct(x: Name) -> Column:
    """Curly quotes and dashes made plain, then white space folded."""
    plain = F.translate(col(x), "‘’‚‛“”„‟–—−", "''''\"\"\"\"---")
    return norm_space(plain)


def norm_table(x: Name) -> Column:
    """norm_punct, lower-cased, without cell rules, bullets, dollar signs and white space (which need not be folded first)."""
    return F.regexp_replace(F.lower(F.translate(col(x), "\u00a0‘’‚‛“”„‟–—−", " ''''\"\"\"\"---")), r"[|•$\s]", "")


def alnum_key(x: Name) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]", "")


def token_estimate(x: Name) -> Column:
    """Tokens a text will take: letters / 3.6 + digits / 2 + symbols * 0.8, rounded up.

    Spaces and tabs are free; a newline is a symbol; whatever is beyond ASCII is a letter.
    """
    c = col(x)
    letters = F.length(F.regexp_replace(c, r"[\x00-\x40\x5B-\x60\x7B-\x7F]", ""))
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    free = F.length(F.regexp_replace(c, r"[^ \t]", ""))
    symbols = F.length(c) - letters - digits - free
    return F.ceil(letters / 3.6 + digits / 2.0 + symbols * 0.8).cast("bigint")
