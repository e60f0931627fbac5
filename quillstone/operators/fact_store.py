"""A bitemporal table of facts that takes reports in batches, late ones too.

Tables of a Store, both cut by the period: reports (each once, as they came) and
points (what collapse() makes of the reports of the best tag, and the state that it
left off in). A batch touches its own periods only:

* a period whose new reports all follow its last one goes on from its state, without
  a look at its reports; a better tag starts anew, from the batch alone;
* a period that gets a report out of order is folded again from all its reports.

So any split of the reports into batches, in any order, with repeats, ends in the
same points as one collapse of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.sinks import Store
from .facts import fold


class FactStore:
    """by: the columns of a period; ties: what orders reports of one day; both as DDL. labels: columns whose value comes from the earliest report that counts."""

    def __init__(self, spark: SparkSession, path: str, by: str, ties: str, labels: str = "", buckets: int = 16):
        names = lambda ddl: [c.split()[0] for c in ddl.split(",") if c.strip()]
        self.by, self.ties, self.labels = names(by), names(ties), names(labels)
        more = f", {labels}" if labels else ""
        reports = f"{by}, filed date, {ties}, value double, priority int{more}"
        last = f"last struct<filed: date, {', '.join(': '.join(c.split()) for c in ties.split(','))}, value: double>"
        points = f"{by}, value double, restated_from double, n_reports int, priority int, {last}{more}"
        self.store = Store(spark, path, {"reports": (reports, self.by), "points": (points, self.by)}, buckets)

    def _periods(self, reports: DataFrame, name: str, had: bool) -> DataFrame:
        """A row for each period: the array of its reports. A report is o, by which it is ordered and known; whether it was there; its priority, value and labels."""
        report = F.struct(F.struct("filed", *self.ties, "value").alias("o"), F.lit(had).alias("had"), F.col("priority").alias("p"), F.col("value").alias("v"), *self.labels)
        return reports.groupBy(*self.by).agg(F.collect_list(report).alias(name))

    def add(self, reports: DataFrame) -> None:
        """by, filed, ties, value, priority (least is best) and labels. Reports without a value or with a null in the period have no place; a report that is there already counts once.

        The batch is shuffled by period once; from there on a period is a row, and so
        are the reports of a late one, which are the only ones read. Tasks write what
        they hold into every bucket, so no bucket's rows pass through one task.
        """
        store, change = self.store, self.store.transaction()
        state = change.old
        whole = F.col("value").isNotNull()
        for c in self.by:
            whole = whole & F.col(c).isNotNull()
        typed = reports.select(*(F.col(f.name).cast(f.dataType) for f in store.read("reports", {}).schema)).where(whole)
        batch = written(self._periods(typed, "__r", False).withColumn("__r", F.sort_array("__r")), "batch")
        before = store.read("points", state, store.buckets_of("points", batch))
        before = before.select(*self.by, F.struct(*(c for c in before.columns if c not in self.by)).alias("__s"))
        late = F.coalesce(F.get("__r", F.lit(0))["o"] <= F.col("__s.last"), F.lit(False))
        met = written(batch.join(before, self.by, "left").withColumn("__late", late), "met")
        behind = met.where("__late").select(*self.by)
        old = self._periods(store.read("reports", state, store.buckets_of("reports", behind)).join(behind, self.by, "left_semi"), "__o", True)
        fresh = written(self._points(met.join(old, self.by, "left")), "fresh").where(F.size("__added") > 0)  # not before it is written: Spark would make the arrays once more for the test
        added = fresh.select(*self.by, F.explode("__added").alias("__x"))
        change.append("reports", added.select(*self.by, "__x.o.*", F.col("__x.p").alias("priority"), *(f"__x.{c}" for c in self.labels)), files=0)
        change.replace("points", fresh.select(*store.read("points", {}).columns), files=0)
        change.commit()

    def _points(self, met: DataFrame) -> DataFrame:
        """The points of periods that get a report, and __added, the reports that are new.

        A late period starts anew from all its reports, __o and __r; another goes on
        from its state __s. Of equal reports the one that was there counts: it is the last of them.
        """
        g = met.withColumn("__a", F.when(F.col("__o").isNotNull(), F.sort_array(F.concat("__o", "__r"))).otherwise(F.col("__r")))
        after = F.slice("__a", 2, F.greatest(F.size("__a") - 1, F.lit(0)))
        g = g.withColumn("__a", F.filter(F.zip_with("__a", after, lambda x, y: F.when(y.isNull() | (x["o"] != y["o"]), x)), lambda x: x.isNotNull()))
        g = g.withColumn("__added", F.filter("__a", lambda x: ~x["had"])).withColumn("__s", F.when(~F.col("__late"), F.col("__s")))
        g = g.withColumn("__best", F.least(F.array_min(F.transform("__a", lambda x: x["p"])), F.col("__s.priority")))
        g = g.withColumn("__c", F.filter("__a", lambda x: x["p"] == F.col("__best")))
        goes_on = F.coalesce(F.col("__s.priority") == F.col("__best"), F.lit(False))
        rest = F.when(goes_on, F.col("__c")).otherwise(F.slice("__c", 2, F.greatest(F.size("__c") - 1, F.lit(0))))
        point = fold(rest, F.when(goes_on, F.col("__s.value")).otherwise(F.get("__c", F.lit(0))["v"]), F.when(goes_on, F.col("__s.restated_from")))
        n = F.size("__c") + F.when(goes_on, F.col("__s.n_reports")).otherwise(0)
        labels = [F.when(goes_on, F.col(f"__s.{c}")).otherwise(F.get("__c", F.lit(0))[c]).alias(c) for c in self.labels]
        last = F.element_at("__a", -1)["o"].alias("last")  # a report that follows the last one is new
        return g.withColumn("__p", point).select(*self.by, "__p.value", "__p.restated_from", n.cast("int").alias("n_reports"), F.col("__best").alias("priority"), last, *labels, "__added")

    def points(self) -> DataFrame:
        """by, value, restated_from, n_reports and labels of each period."""
        return self.store.read("points").select(*self.by, "value", "restated_from", "n_reports", *self.labels)
