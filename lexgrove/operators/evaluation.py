"""Precision, recall, F and accuracy by group and class; sense evaluation; score summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_LABEL = ("", "-")


def _labelled(label: Column) -> Column:
    return label.isNotNull() & ~label.isin(*NO_LABEL)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def with_prf(counts: DataFrame) -> DataFrame:
    """precision, recall and f of rows with gold, assigned and truepos; 0 where undefined."""
    precision, recall = _ratio(F.col("truepos"), F.col("assigned")), _ratio(F.col("truepos"), F.col("gold"))
    return counts.withColumn("prec", precision).withColumn("rec", recall).withColumn("f", _ratio(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))


def class_counts(rows: DataFrame, group: str = "grp", gold: str = "gold_label", assigned: str = "assigned_label") -> DataFrame:
    """(group, class, gold, assigned, truepos): one pass, each row giving its gold and its assigned class.

    Missing labels (null, empty, dash) count for neither; classes of groups without gold stay out.
    """
    same = F.coalesce(F.col(gold) == F.col(assigned), F.lit(False))
    pair = F.array(
        F.struct(F.col(gold).alias("class"), F.lit(1).alias("g"), F.lit(0).alias("a"), same.cast("int").alias("t")),
        F.struct(F.col(assigned).alias("class"), F.lit(0).alias("g"), F.lit(1).alias("a"), F.lit(0).alias("t")),
    )
    long = rows.select(F.col(group).alias("grp"), F.explode(pair).alias("x")).select("grp", "x.*").where(_labelled(F.col("class")))
    counts = long.groupBy("grp", "class").agg(F.sum("g").alias("gold"), F.sum("a").alias("assigned"), F.sum("t").alias("truepos"))
    with_gold = rows.where(_labelled(F.col(gold))).select(F.col(group).alias("grp")).distinct()
    return counts.join(with_gold, "grp", "left_semi")


def group_class_prf(rows: DataFrame, **names: str) -> DataFrame:
    return with_prf(class_counts(rows, **names))


def _hit(gold: str, assigned: str) -> Column:
    """Equal labels, also where both are missing."""
    return F.col(gold).eqNullSafe(F.col(assigned)).cast("long")


def group_accuracy(rows: DataFrame, group: str = "grp", gold: str = "gold_label", assigned: str = "assigned_label") -> DataFrame:
    """(group, instances, truepos, accuracy), of groups that have a gold label."""
    counts = rows.groupBy(F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).alias("instances"), F.sum(_hit(gold, assigned)).alias("truepos"), F.count_if(_labelled(F.col(gold))).alias("_gold")
    )
    return counts.where("_gold > 0").drop("_gold").withColumn("accuracy", _ratio(F.col("truepos"), F.col("instances")))


def single_class(rows: DataFrame, wanted: str, **names: str) -> DataFrame:
    return group_class_prf(rows, **names).where(F.col("class") == wanted)


def overall(rows: DataFrame, gold: str = "gold_label", assigned: str = "assigned_label") -> DataFrame:
    """Accuracy over all instances, whether or not their group has gold."""
    total = rows.agg(F.count(F.lit(1)).alias("instances"), F.coalesce(F.sum(_hit(gold, assigned)), F.lit(0)).alias("truepos"))
    return total.withColumn("accuracy", _ratio(F.col("truepos"), F.col("instances")))


def overall_single_class(rows: DataFrame, wanted: str, **names: str) -> DataFrame:
    counts = class_counts(rows, **names).where(F.col("class") == wanted)
    return with_prf(counts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("gold", "assigned", "truepos")]))


def with_injected_gold(counts: DataFrame, failed: DataFrame, parts: int = 1) -> DataFrame:
    """Counts with the gold of unparsed sentences added: failed is (group, class), a row each.

    A group that is evaluated in several parts takes an equal, rounded share.
    """
    missed = failed.groupBy("grp", "class").agg(F.round(F.count(F.lit(1)) / parts).cast("long").alias("missed"))
    joined = counts.join(missed, ["grp", "class"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return with_prf(joined.select("grp", "class", (zero("gold") + zero("missed")).alias("gold"), zero("assigned").alias("assigned"), zero("truepos").alias("truepos")))


def step_labels(rows: DataFrame, step: str, noval: str = "NONE") -> DataFrame:
    """gold_label and assigned_label for a role step; rows have gold, argrec, arglab, prune."""
    recognized = lambda c: F.when(F.col(c) == noval, noval).otherwise("FE")
    assigned = {
        "argrec": recognized("argrec"),
        "arglab": F.col("arglab"),
        "onestep": F.col("arglab"),
        "prune": F.when(F.col("prune") == 1, "FE").otherwise(noval),
        "all": F.when(F.col("argrec") == noval, F.col("argrec")).otherwise(F.col("arglab")),
    }[step]
    gold = recognized("gold") if step in ("argrec", "prune") else F.col("gold")
    return rows.withColumn("gold_label", gold).withColumn("assigned_label", assigned)


# -- senses ---------------------------------------------------------------------------------------


def lenient(instances: DataFrame, answers: DataFrame) -> DataFrame:
    """Each instance's best label and whether it is one of the gold senses.

    instances: (lemma, instance_id, gold array); answers: (instance_id, sense, confidence).
    An instance that comes several times counts once; one without answers doesn't count.
    """
    once = instances.dropDuplicates(["instance_id"])
    best = answers.groupBy("instance_id").agg(F.max_by(F.col("sense"), F.struct("confidence", _descending("sense"))).alias("best"))
    return once.join(best, "instance_id").withColumn("correct", F.array_contains("gold", F.col("best")))


def _descending(column: str) -> Column:
    """Orders texts from the last to the first in a maximum: ties go to the first."""
    return F.transform(F.split(F.col(column), ""), lambda c: -F.coalesce(F.ascii(c), F.lit(0)))


def lenient_accuracy(instances: DataFrame, answers: DataFrame) -> DataFrame:
    return lenient(instances, answers).groupBy("lemma").agg(F.count(F.lit(1)).alias("instances"), F.count_if("correct").alias("truepos")).withColumn(
        "accuracy", _ratio(F.col("truepos"), F.col("instances"))
    )


def thresholded(instances: DataFrame, answers: DataFrame, inventory: DataFrame, least: float) -> DataFrame:
    """(lemma, instance_id, sense, gold_label, assigned_label) as true or false for each known sense."""
    once = instances.dropDuplicates(["instance_id"])
    top = answers.groupBy("instance_id", "sense").agg(F.max("confidence").alias("confidence"))
    rows = once.join(inventory, "lemma").join(top, ["instance_id", "sense"], "left")
    return rows.select(
        "lemma",
        "instance_id",
        "sense",
        F.array_contains("gold", F.col("sense")).cast("string").alias("gold_label"),
        F.coalesce(F.col("confidence") >= least, F.lit(False)).cast("string").alias("assigned_label"),
    )


def most_frequent(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Each group's most frequent label; ties go to the first by name."""
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(group).agg(F.max("n").alias("n"))
    return counts.join(top, [group, "n"]).groupBy(group, "n").agg(F.min(label).alias(label))


def baseline(train: DataFrame, test: DataFrame, group: str, label: str, unseen: str = "NONE") -> DataFrame:
    """test with the baseline's label; groups that weren't trained get the mark for unseen ones."""
    found = most_frequent(train, group, label).select(F.col(group).alias("_group"), F.col(label).alias("predicted"))
    return test.join(found, test[group] == found["_group"], "left").drop("_group").withColumn("predicted", F.coalesce("predicted", F.lit(unseen)))


# -- numeric summaries ------------------------------------------------------------------------------


def binned_average(rows: DataFrame, x: str, y: str, least: float, size: float) -> DataFrame:
    return rows.groupBy(F.floor((F.col(x) - least) / size).cast("long").alias("bin")).agg(F.avg(y).alias("average"), F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Counts over equal bins from the least to the largest value; the last bin has its upper bound."""
    ends = rows.agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    place = F.least(F.floor((F.col(x) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return rows.where(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kendall_tau(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of each group's (x, y); groups are lists of scores, of moderate size."""

    def run(key, pdf):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        balance = ties_a = ties_b = 0
        for i in range(len(a)):
            da, db = np.sign(a[i + 1 :] - a[i]), np.sign(b[i + 1 :] - b[i])
            balance += int((da * db).sum())
            ties_a += int((da == 0).sum())
            ties_b += int((db == 0).sum())
        pairs = len(a) * (len(a) - 1) // 2
        rest = ((pairs - ties_a) * (pairs - ties_b)) ** 0.5
        return pd.DataFrame({group: [key[0]], "tau": [balance / rest if rest else float("nan")]})

    kind = dict(rows.dtypes)[group]
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, tau double")
