"""How two stage codings of the same epochs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(ref: DataFrame, auto: DataFrame, keys: list[str], ref_offset: int, auto_offset: int) -> DataFrame:
    """(keys, epoch_idx, y_true, y_pred) over the epochs both have, counted from each one's offset."""
    a = ref.select(*keys, (F.col("epoch_idx") - ref_offset).alias("epoch_idx"), F.col("stage").alias("y_true")).where("epoch_idx >= 0")
    b = auto.select(*keys, (F.col("epoch_idx") - auto_offset).alias("epoch_idx"), F.col("stage").alias("y_pred")).where("epoch_idx >= 0")
    return a.join(b, [*keys, "epoch_idx"])


def with_next(stages: DataFrame, ref_offset: int, auto_offset: int) -> DataFrame:
    """(pair, day, epoch_idx, y_true, y_pred): each subject's stages aligned with the next subject's of the same day.

    The last subject meets the first, so every subject counts on either side. pair: "S0-S1"."""
    w = Window.partitionBy(F.lit(0)).orderBy("subject_id")  # a row a subject
    names = stages.select("subject_id").distinct()
    other = names.select("subject_id", F.coalesce(F.lead("subject_id").over(w), F.min("subject_id").over(Window.partitionBy(F.lit(0)))).alias("_other")).withColumn("pair", F.concat("subject_id", F.lit("-"), "_other"))
    ref = stages.join(other, "subject_id").select("pair", "day", "epoch_idx", "stage")
    auto = stages.join(other.select("pair", F.col("_other").alias("subject_id")), "subject_id").select("pair", "day", "epoch_idx", "stage")
    return align(ref, auto, ["pair", "day"], ref_offset, auto_offset)


def confusion(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(keys or []), "y_true", "y_pred").agg(F.count("*").alias("n"))


def kappa(counts: DataFrame, classes: int = 3) -> DataFrame:
    """accuracy, kappa and quadratic-weighted kappa from (y_true, y_pred, n): one pass over at most classes^2 rows."""
    rows = counts.groupBy("y_true").agg(F.sum("n").alias("a"))
    cols = counts.groupBy("y_pred").agg(F.sum("n").alias("b"))
    total = F.sum("n").alias("t")
    w = (F.col("y_true") - F.col("y_pred")) * (F.col("y_true") - F.col("y_pred")) / float((classes - 1) ** 2)
    seen = counts.agg(total, F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.col("n") * w).alias("wo")).withColumn("one", F.lit(1))
    chance = rows.withColumn("one", F.lit(1)).join(cols.withColumn("one", F.lit(1)), "one")  # at most classes^2 rows
    chance = chance.groupBy("one").agg(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("a") * F.col("b")).otherwise(0)).alias("pe"), F.sum(F.col("a") * F.col("b") * w).alias("we"))
    po, pe = F.col("same") / F.col("t"), F.col("pe") / F.col("t") / F.col("t")
    return seen.join(chance, "one").select(po.alias("accuracy"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), F.when(F.col("we") > 0, 1 - F.col("wo") / (F.col("we") / F.col("t"))).alias("kappa_quadratic"))


def per_class(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of every class that occurs in y_true."""
    t = counts.groupBy(F.col("y_true").alias("stage")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = counts.groupBy(F.col("y_pred").alias("stage")).agg(F.sum("n").alias("predicted"))
    out = t.join(p, "stage", "left")
    prec, rec = F.coalesce(F.col("tp") / F.col("predicted"), F.lit(0.0)), F.col("tp") / F.col("support")
    return out.select("stage", prec.alias("precision"), rec.alias("recall"), F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"), "support")
