"""Splits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("benign", "spam", "phishing", "bec", "impersonation")
#: What a class's detector must reach: precision, recall, F1, area under ROC and under precision-recall (0 where there is no gate).
GATES = {"phishing": (0.93, 0.85, 0.88, 0.93, 0.90), "spam": (0.90, 0.85, 0.87, 0.91, 0.0), "bec": (0.95, 0.80, 0.87, 0.92, 0.0), "impersonation": (0.92, 0.80, 0.85, 0.90, 0.0)}


def cleaned(rows: DataFrame, label: str = "label") -> DataFrame:
    """Distinct rows with a label, lower-cased and trimmed; ham is benign."""
    text = F.lower(F.trim(F.col(label)))
    return rows.dropDuplicates().withColumn(label, F.when(text == "ham", "benign").otherwise(text)).filter(F.coalesce(label, F.lit("")) != "")


def stratified_split(rows: DataFrame, key: str, label: str, shares=(0.70, 0.15, 0.15)) -> DataFrame:
    """Column ``split``; within a label by rank of the key's MD5.

    The rank comes from counts by the first digits of the MD5 and a rank within
    those, so a large label isn't ordered in one task.
    """
    ranked = rows.withColumn("h", F.md5(F.col(key).cast("string"))).withColumn("bin", F.substring("h", 1, 3))
    bins = ranked.groupBy(label, "bin").agg(F.count("*").alias("n"))
    by_label = Window.partitionBy(label)
    bins = bins.select(label, "bin", (F.sum("n").over(by_label.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(by_label).alias("total"))
    ranked = ranked.join(bins, [label, "bin"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(label, "bin").orderBy("h", key)))
    first, second = F.floor(F.col("total") * shares[0]), F.floor(F.col("total") * (shares[0] + shares[1]))
    return ranked.withColumn("split", F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "validation").otherwise("test")).drop("h", "bin", "before", "total", "rank")


def temporal_split(rows: DataFrame, ts: str, key: str, shares=(0.70, 0.15)) -> DataFrame:
    """Column ``split`` by time (then key): the first whole share of rows is for training, the next for validation.

    Places come from counts by hour and a rank within the hour, so no task
    orders the whole table.
    """
    hour = F.date_trunc("hour", F.col(ts))
    marked = rows.withColumn("hour", hour)
    hours = marked.groupBy("hour").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("hour").asc_nulls_first())) - F.col("n")  # over distinct hours only
    hours = hours.select(F.col("hour").alias("h"), before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = marked.join(hours, F.col("hour").eqNullSafe(F.col("h"))).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("hour").orderBy(ts, key)))
    first = F.floor(F.col("total") * shares[0])
    second = first + F.floor(F.col("total") * shares[1])
    return placed.withColumn("split", F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "validation").otherwise("test")).drop("hour", "h", "before", "total", "place")


def tasks(label: Column) -> dict[str, Column]:
    """Labels of the four tasks."""
    index = F.array_position(F.array(*map(F.lit, CLASSES)), label) - 1
    return {"threat": (label != "benign").cast("int"), "multiclass": F.when(index >= 0, index).cast("int"), "bec": (label == "bec").cast("int"), "impersonation": (label == "impersonation").cast("int")}


def threat_probability(benign: Column, threshold: float = 0.5) -> Column:
    """I8: struct(p, flag)."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - benign))
    return F.struct(p.alias("p"), (p >= threshold).alias("flag"))


def _curve(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score, descending: counts there and so far; the running sums are over distinct scores only."""
    points = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    down = Window.orderBy(F.desc("score"))
    return points.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})


def binary_metrics(scored: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1, accuracy, ROC-AUC and average precision; scores are rounded to 6 digits for the curves."""
    rounded = scored.withColumn("s", F.round(score, 6))
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    counts = rounded.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    curve = _curve(rounded, y, "s")
    total = curve.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.join(total).select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"), ratio(F.col("area"), F.col("np") * F.col("nn")).alias("roc_auc"), ratio(F.col("ap"), F.col("np")).alias("pr_auc"))
    return out


def best_threshold(scored: DataFrame, precision: float, y: str = "y", score: str = "score") -> DataFrame:
    """The smallest score (so the largest recall) whose precision is at least ``precision``; null if there is none."""
    curve = _curve(scored.withColumn("s", F.round(score, 6)), y, "s")
    return curve.filter(F.col("tp") / (F.col("tp") + F.col("fp")) >= precision).agg(F.min("score").alias("threshold"), F.max("tp").alias("tp"))


def multiclass_metrics(predicted: DataFrame, label: str = "label", guess: str = "guess") -> DataFrame:
    """Per class precision, recall, F1 and support, from the confusion counts."""
    confusion = predicted.groupBy(label, guess).agg(F.count("*").alias("n"))
    told = confusion.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("predicted"))
    real = confusion.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(guess), F.col("n")).otherwise(0)).alias("hits"))
    out = real.join(told, "class", "full").fillna(0, ["predicted", "support", "hits"])
    p, r = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return out.select("class", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def averages(per_class: DataFrame) -> DataFrame:
    """Macro and weighted F1, and accuracy."""
    n = F.sum("support")
    return per_class.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"))


def one_vs_rest_auc(scored: DataFrame, label: str, classes, prefix: str = "p_") -> DataFrame:
    """Per class the area under the ROC and the precision-recall curve of its probability ``p_<class>`` against all others."""
    each = scored.select(label, F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"{prefix}{c}").alias("p")) for c in classes))).alias("x"))
    points = each.groupBy(F.col("x.class").alias("class"), F.round("x.p", 6).alias("score")).agg(F.count_if(F.col(label) == F.col("x.class")).alias("p"), F.count_if(F.coalesce(F.col(label) != F.col("x.class"), F.lit(True))).alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("score"))  # distinct scores of 6 digits: at most a million and one a class
    curve = points.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    total = curve.groupBy("class").agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return total.select("class", ratio(F.col("area"), F.col("np") * F.col("nn")).alias("roc_auc"), ratio(F.col("ap"), F.col("np")).alias("pr_auc"))


def gates(per_class: DataFrame) -> DataFrame:
    """Per gated class whether it passes; the areas (``one_vs_rest_auc``) are asked for if ``per_class`` has them."""
    spark = per_class.sparkSession
    need = spark.createDataFrame([(k, *v) for k, v in GATES.items()], "class string, min_precision double, min_recall double, min_f1 double, min_roc_auc double, min_pr_auc double")
    ok = F.lit(True)
    for c in ("precision", "recall", "f1", "roc_auc", "pr_auc"):
        ok = ok & (F.col(c) >= F.col(f"min_{c}")) if c in per_class.columns else ok
    return per_class.join(F.broadcast(need), "class").select("class", ok.alias("passed"))
