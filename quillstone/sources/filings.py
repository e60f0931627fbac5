"""Filing sources: daily indexes, company facts, filing lists, ownership forms, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACT_SCHEMA = "cik long, entityName string, facts map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string>>>>>>"
FORM4_SCHEMA = "issuer struct<issuerTradingSymbol: string>, reportingOwner struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string, officerTitle: string>>, nonDerivativeTable struct<nonDerivativeTransaction: array<struct<transactionDate: struct<value: string>, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: struct<value: string>, transactionPricePerShare: struct<value: string>, transactionAcquiredDisposedCode: struct<value: string>>>>>"


def master_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a pipe-delimited daily index: cik (ten digits), company, form, filing_date, accession; whatever is no such row is dropped."""
    p = F.split(F.col(line), r"\|")
    date = F.coalesce(F.try_to_timestamp(p[3], F.lit("yyyyMMdd")), F.try_to_timestamp(p[3], F.lit("yyyy-MM-dd"))).cast("date")
    out = lines.where(F.col(line).rlike("^[0-9]") & (F.size(p) >= 5)).select(F.lpad(p[0], 10, "0").alias("cik"), p[1].alias("company"), p[2].alias("form"), date.alias("filing_date"), F.regexp_extract(p[4], r"([0-9]{10}-[0-9]{2}-[0-9]{6})", 1).alias("accession"))
    return out.where(F.col("filing_date").isNotNull() & (F.col("accession") != "") & F.col("cik").rlike("^[0-9]{10}$"))


def read_master_index(spark: SparkSession, path: str) -> DataFrame:
    return master_index(spark.read.text(path))


def _nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """weekday: 1 Sunday .. 7 Saturday."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1))


def _last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.dayofweek(last) - weekday, F.lit(7)))


def _observed(year: Column, month: int, day: int) -> Column:
    d = F.make_date(year, F.lit(month), F.lit(day))
    return F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Federal holidays (date, name): fixed dates move off a weekend, others are the nth or last weekday of a month."""
    y = F.col("year")
    days = {
        "New Year": _observed(y, 1, 1), "Martin Luther King": _nth_weekday(y, 1, 2, 3), "Presidents": _nth_weekday(y, 2, 2, 3), "Memorial": _last_weekday(y, 5, 2),
        "Juneteenth": _observed(y, 6, 19), "Independence": _observed(y, 7, 4), "Labor": _nth_weekday(y, 9, 2, 1), "Columbus": _nth_weekday(y, 10, 2, 2),
        "Veterans": _observed(y, 11, 11), "Thanksgiving": _nth_weekday(y, 11, 5, 4), "Christmas": _observed(y, 12, 25),
    }
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.select(F.explode(F.array(*(F.struct(d.alias("date"), F.lit(n).alias("name")) for n, d in days.items()))).alias("h")).select("h.*")


def business_days(spark: SparkSession, since: str, until: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("date")).where(~F.dayofweek("date").isin(1, 7))
    return days.join(F.broadcast(holidays(spark, int(since[:4]), int(until[:4]) + 1)), "date", "left_anti")


def sweep(index: DataFrame, days: DataFrame, ciks: DataFrame, forms: list[str], form: str = "form", date: str = "filing_date", cik: str = "cik") -> DataFrame:
    """Entries of those days, companies and forms (amendments too). Semi-joins only, so nothing is copied."""
    wanted = F.substring_index(F.upper(form), "/", 1).isin(*[f.upper() for f in forms]) | F.upper(form).isin(*[f.upper() for f in forms])
    return index.where(wanted).join(F.broadcast(days.select(F.col("date").alias(date))), date, "left_semi").join(ciks.select(cik), cik, "left_semi")


def missed_days(index: DataFrame, days: DataFrame, date: str = "filing_date") -> DataFrame:
    """Days of the sweep that gave nothing."""
    return days.join(index.select(F.col(date).alias("date")).distinct(), "date", "left_anti")


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Long facts (cik, tag, unit, start, end, val, fy, fp, form, filed, accn) of company-facts JSON files."""
    return explode_facts(spark.read.schema(FACT_SCHEMA).option("multiLine", True).json(path))


def explode_facts(df: DataFrame) -> DataFrame:
    tags = df.select("cik", F.explode("facts").alias("taxonomy", "tags")).select("cik", F.explode("tags").alias("tag", "t"))
    each = tags.select("cik", "tag", F.explode("t.units").alias("unit", "values")).select("cik", "tag", "unit", F.explode("values").alias("v"))
    return each.select("cik", "tag", "unit", F.to_date("v.start").alias("start"), F.to_date("v.end").alias("end"), "v.val", "v.fy", "v.fp", "v.form", F.to_date("v.filed").alias("filed"), "v.accn")


def list_filings(df: DataFrame, by: list[str], arrays: list[str], forms: list[str], form: str, date: str, since: str | None = None, limit: int = 100) -> DataFrame:
    """Filings held as parallel arrays: form (amendments too) and date filters, newest first, up to a limit for each key."""
    z = df.select(*by, F.explode(F.arrays_zip(*arrays)).alias("z")).select(*by, "z.*")
    z = z.where(F.substring_index(F.upper(form), "/", 1).isin(*[f.upper() for f in forms]))
    z = z.where(F.col(date) >= since) if since else z
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(date).desc(), *[c for c in arrays if c != date]))
    return z.withColumn("rn", rn).where(F.col("rn") <= limit)


def exhibits(files: DataFrame, by: list[str], name: str, n: int = 3) -> DataFrame:
    """The first three exhibits 99 by file name."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(name))
    return files.where(F.col(name).rlike(r"(?i)ex-?(hibit)?-?99")).withColumn("rn", rn).where(F.col("rn") <= n)


def current_report(filings: DataFrame, exhibits_: DataFrame, key: str, items: str, body: str, text: str) -> DataFrame:
    """Body, and the exhibits' texts where item 9.01 or 2.02 is present."""
    e = exhibits_.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text))), lambda x: x[text]), "\n\n").alias("__e"))
    has = F.col(items).rlike(r"(^|,)\s*(9\.01|2\.02)\s*(,|$)")
    return filings.join(e, key, "left").withColumn(body, F.when(has & F.col("__e").isNotNull(), F.concat_ws("\n\n", body, "__e")).otherwise(F.col(body))).drop("__e")


def may_purchase(xml: Column) -> Column:
    """False only where no transactionCode can be P: each ends in another letter or digit. Space, references, comments, CDATA and other marks before an end tag leave it open. Names count in either case, as from_xml takes them."""
    return xml.rlike("</(?i:transactioncode)(?<![0-9A-OQ-Za-oq-z]</.{15})")


def form4_purchases(forms: DataFrame, xml: str = "xml") -> DataFrame:
    """Open-market purchases of ownership forms (columns cik, accession, filing_date, xml): code P, acquired or unsaid, shares above 0; a price of 0 or none gives no value.

    Forms that cannot hold one are not parsed; the test stands in the parse's column,
    not in a filter, which Spark would push below xml and so make xml twice.
    """
    x = F.when(may_purchase(F.col(xml)), F.from_xml(F.col(xml), FORM4_SCHEMA, {"rowTag": "ownershipDocument"}))
    t = forms.withColumn("x", x).select("cik", "accession", "filing_date", "x", F.explode("x.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    amount = lambda c: F.try_to_number(F.regexp_replace(F.trim(F.col(f"t.transactionAmounts.{c}.value")), ",", ""), F.lit("999999999999.9999")).cast("double")
    flag = lambda c: F.lower(F.trim(F.col(f"x.reportingOwner.reportingOwnerRelationship.{c}"))).isin("1", "true")
    owner = F.trim("x.reportingOwner.reportingOwnerId.rptOwnerCik")
    day = F.coalesce(F.nullif(F.trim("t.transactionDate.value"), F.lit("")), F.col("filing_date").cast("string"))
    how = F.upper(F.trim(F.coalesce("t.transactionAmounts.transactionAcquiredDisposedCode.value", F.lit(""))))
    out = t.where((F.upper(F.trim("t.transactionCoding.transactionCode")) == "P") & how.isin("", "A")).withColumns({"shares": amount("transactionShares"), "price0": amount("transactionPricePerShare")})
    out = out.where(F.col("shares") > 0).withColumn("price", F.when(F.col("price0") > 0, F.col("price0")))
    return out.select(
        F.concat_ws(":", "accession", owner, day, F.format_string("%.0f", "shares")).alias("key"),
        F.lpad("cik", 10, "0").alias("cik"), F.upper(F.trim("x.issuer.issuerTradingSymbol")).alias("ticker"), "accession", "filing_date", F.to_date(day).alias("transaction_date"),
        owner.alias("owner_cik"), F.trim("x.reportingOwner.reportingOwnerId.rptOwnerName").alias("owner_name"), F.trim("x.reportingOwner.reportingOwnerRelationship.officerTitle").alias("title"),
        flag("isOfficer").alias("is_officer"), flag("isDirector").alias("is_director"), flag("isTenPercentOwner").alias("is_ten_percent"), "shares", "price", (F.col("shares") * F.col("price")).alias("value"),
    )
