"""Day features that use only the day itself and valid days before it, and the risk dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlane.operators.ranking import rank_column

DAY = ["subject_id", "day"]
FAR = 1_000_000_000


def event_distance(days: DataFrame, events: DataFrame) -> DataFrame:
    """Days to the nearest event of the subject, before or after; FAR where it has none.

    Distinct event dates meet the subject's days, so repeated events don't multiply rows."""
    e = events.select("subject_id", "event_date").distinct()
    return days.join(e, "subject_id", "left").groupBy(*DAY).agg(F.coalesce(F.min(F.abs(F.datediff("day", "event_date"))), F.lit(FAR)).cast("int").alias("distance"))


def next_day_label(days: DataFrame, events: DataFrame) -> DataFrame:
    """label 1 where the subject has an event on the day after."""
    e = events.select("subject_id", F.date_sub("event_date", 1).alias("day")).distinct().withColumn("_on", F.lit(1))
    return days.join(e, DAY, "left").select(*DAY, F.coalesce("_on", F.lit(0)).alias("label"))


def day_values(points: DataFrame, half: int, group: list[str], order: str) -> DataFrame:
    """Per day: mean, range, population std, share, and mean and range of each half.

    points: (group, order, point_idx, value) with values in -1..1; half: first point of the second half."""
    first, second = (F.when(c, F.col("value")) for c in (F.col("point_idx") < half, F.col("point_idx") >= half))
    span = lambda c: F.max(c) - F.min(c)
    return points.groupBy(*group, order).agg(
        F.avg("value").alias("mean"), span(F.col("value")).alias("range"), F.stddev_pop("value").alias("std"), ((F.avg("value") + 1) / 2).alias("share"),
        F.avg(first).alias("mean_first"), F.avg(second).alias("mean_second"), span(first).alias("range_first"), span(second).alias("range_second"))


def rolling(values: DataFrame, group: list[str], order: str) -> DataFrame:
    """Means over the last two and three valid days, the current one included."""
    w = Window.partitionBy(*group).orderBy(order)
    return values.select("*", *[F.avg(c).over(w.rowsBetween(-k + 1, 0)).alias(f"{c}_{24 * k}h") for c in ("mean", "range", "std") for k in (2, 3)])


def trend3(values: DataFrame, group: list[str], order: str) -> DataFrame:
    """Least-squares slope over the last three valid days at 0, 1, 2; over two their difference; null for one."""
    w = Window.partitionBy(*group).orderBy(order)

    def slope(c: str):
        one, two = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
        return F.when(two.isNotNull(), (F.col(c) - two) / 2).otherwise(F.col(c) - one)

    return values.select("*", *[slope(c).alias(f"trend_{c}") for c in ("mean", "range", "std")])


def delta1(values: DataFrame, group: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order)
    return values.select("*", *[(F.col(c) - F.lag(c, 1).over(w)).alias(f"delta_{c}") for c in ("mean", "range", "std")])


def ratio_prev3(values: DataFrame, group: list[str], order: str) -> DataFrame:
    """The day's mean over that of up to three valid days before it; null without one or if it is 0."""
    before = F.avg("mean").over(Window.partitionBy(*group).orderBy(order).rowsBetween(-3, -1))
    return values.withColumn("ratio_prev3", F.col("mean") / F.nullif(before, F.lit(0.0)))


def shape_lag1(points: DataFrame, group: list[str], order: str) -> DataFrame:
    """L1 and L2 distance of each day's points to those of the valid day before; null for the first."""
    was = F.lag("value").over(Window.partitionBy(*group, "point_idx").orderBy(order))
    at = points.withColumn("_d", F.col("value") - was)
    return at.groupBy(*group, order).agg(F.sum(F.abs("_d")).alias("l1"), F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("l2"))


def _lags(points: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*group, "point_idx").orderBy(order)
    return points.select("*", *[F.lag("value", k).over(w).alias(f"_v{k}") for k in range(1, n + 1)])


def pairwise(points: DataFrame, group: list[str], order: str) -> DataFrame:
    """Mean L1 and L2 distance over pairs of the last three valid days; null with one day."""
    at = _lags(points, group, order, 2)
    pairs = [("value", "_v1"), ("value", "_v2"), ("_v1", "_v2")]
    sums = at.groupBy(*group, order).agg(*[F.sum(F.abs(F.col(a) - F.col(b))).alias(f"a{i}") for i, (a, b) in enumerate(pairs)], *[F.sqrt(F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))).alias(f"b{i}") for i, (a, b) in enumerate(pairs)])
    n = sum((F.col(f"a{i}").isNotNull().cast("int") for i in range(3)), F.lit(0))
    mean = lambda x: sum((F.coalesce(f"{x}{i}", F.lit(0.0)) for i in range(3)), F.lit(0.0)) / F.nullif(n, F.lit(0))
    return sums.select(*group, order, mean("a").alias("pair_l1"), mean("b").alias("pair_l2"))


def anomaly(points: DataFrame, group: list[str], order: str) -> DataFrame:
    """L1 and L2 distance of a day to the pointwise median of up to three valid days before it."""
    at = _lags(points, group, order, 3)
    known = F.array_sort(F.array_compact(F.array("_v1", "_v2", "_v3")))
    n = F.size(known)
    median = F.when(n == 3, F.get(known, F.lit(1))).when(n == 2, (F.get(known, F.lit(0)) + F.get(known, F.lit(1))) / 2).when(n == 1, F.get(known, F.lit(0)))
    at = at.withColumn("_d", F.col("value") - median)
    return at.groupBy(*group, order).agg(F.sum(F.abs("_d")).alias("anomaly_l1"), F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("anomaly_l2"))


def quiet_controls(rows: DataFrame, events: DataFrame, quiet_days: int, ratio: float, else_any: bool = True) -> DataFrame:
    """Negatives that serve as controls: (subject_id, day).

    rows: subject_id, day, label. Candidates are negatives more than quiet_days from any event,
    or, with else_any, all negatives if none is. Those of a positive's subject and month come first, in the
    order of the first such positive, then the rest by subject and day; ceil(ratio * positives)
    are taken, by rank, so no task holds them all. The cap is a feature of the sampling."""
    far = event_distance(rows.select(*DAY), events)
    neg = rows.where("label = 0").join(far, DAY).withColumn("quiet", F.col("distance") > quiet_days)
    any_quiet = neg.agg(F.max("quiet").alias("any_quiet"), F.lit(1).alias("one"))
    neg = neg.withColumn("one", F.lit(1)).join(F.broadcast(any_quiet), "one").where(F.col("quiet") | (F.lit(else_any) & ~F.col("any_quiet"))).withColumn("month", F.trunc("day", "month"))
    pos = rows.where("label = 1").groupBy("subject_id", F.trunc("day", "month").alias("month")).agg(F.min("day").alias("first_pos"))
    cap = int(-(-rows.where("label = 1").count() * ratio // 1))
    at = neg.join(pos, ["subject_id", "month"], "left")
    ranked = rank_column(at, [F.col("first_pos").isNull(), F.col("first_pos"), F.col("subject_id"), F.col("day")], "_rank")
    return ranked.where(F.col("_rank") <= cap).select(*DAY)
