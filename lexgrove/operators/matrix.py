"""Feature vocabularies, matrices, label transforms and value purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.sources.shared import cut

COUNTINGS = ("keep", "repeat", "bin")


def vocabulary(features: DataFrame, group: str = "lemma") -> DataFrame:
    """(group, feature, most): the largest count that a feature has in one instance.

    features: (group, instance_id, feature), a row for each occurrence.
    """
    return _largest(counts(features, group), group)


def _largest(counted: DataFrame, group: str) -> DataFrame:
    return counted.groupBy(group, "feature").agg(F.max("n").alias("most"))


def counts(features: DataFrame, group: str = "lemma") -> DataFrame:
    return features.groupBy(group, "instance_id", "feature").agg(F.count(F.lit(1)).alias("n"))


def matrix(features: DataFrame, vocab: DataFrame, counting: str, group: str = "lemma", strict_parity: bool = True) -> DataFrame:
    """(group, instance_id, column, value) where the value isn't 0, by a vocabulary of training.

    keep: the count. repeat: columns ``f k/most``, 1 if the count exceeds k. bin: columns ``f
    k/ceil(most/10)``, 1 if the count modulo 10 exceeds 10 k; with strict_parity off, if the
    count itself exceeds 10 k.
    """
    return _cells(counts(features, group), vocab, counting, group, strict_parity)


def fitted_matrix(features: DataFrame, counting: str, group: str = "lemma", strict_parity: bool = True) -> DataFrame:
    """matrix by the vocabulary of the rows themselves, which are counted once, into a table."""
    counted = cut(counts(features, group))
    return _cells(counted, _largest(counted, group), counting, group, strict_parity)


def _cells(counted: DataFrame, vocab: DataFrame, counting: str, group: str, strict_parity: bool) -> DataFrame:
    known = counted.join(vocab, [group, "feature"])
    if counting == "keep":
        return known.select(group, "instance_id", F.col("feature").alias("column"), F.col("n").alias("value"))
    if counting not in COUNTINGS:
        raise ValueError(f"counting is one of {COUNTINGS}")
    width = F.col("most") if counting == "repeat" else F.ceil(F.col("most") / 10)
    cells = known.withColumn("width", width.cast("long")).withColumn("k", F.explode(F.expr("sequence(0L, width - 1)")))
    binned = F.col("n") % 10 if strict_parity else F.col("n")
    hit = F.col("n") > F.col("k") if counting == "repeat" else binned > 10 * F.col("k")
    name = F.concat_ws(" ", "feature", F.concat_ws("/", F.col("k").cast("string"), F.col("width").cast("string")))
    return cells.where(hit).select(group, "instance_id", name.alias("column"), F.lit(1).cast("long").alias("value"))


def columns(vocab: DataFrame, counting: str, group: str = "lemma") -> DataFrame:
    """(group, column, place): all columns of the matrix in their order."""
    if counting == "keep":
        return vocab.select(group, F.col("feature").alias("column"), F.lit(0).cast("long").alias("place"))
    width = F.col("most") if counting == "repeat" else F.ceil(F.col("most") / 10)
    cells = vocab.withColumn("width", width.cast("long")).withColumn("place", F.explode(F.expr("sequence(0L, width - 1)")))
    name = F.concat_ws(" ", "feature", F.concat_ws("/", F.col("place").cast("string"), F.col("width").cast("string")))
    return cells.select(group, name.alias("column"), "place")


def joined_labels(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One label for each instance: its labels in order, joined by ++."""
    return labels.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(label)), "++").alias(label))


def repeated_labels(instances: DataFrame, labels: str) -> DataFrame:
    """An instance for each of its labels (an array)."""
    return instances.withColumn(labels, F.explode(F.array_distinct(labels)))


def binarized(instances: DataFrame, group: str, labels: str, negative: str = "NONE") -> DataFrame:
    """(…, sense, target): each instance once for each label of its group: the label or the negative mark.

    Every instance meets every label of its group, whenever the label first occurs.
    """
    inventory = instances.select(group, F.explode(labels).alias("sense")).distinct()
    return instances.join(inventory, group).withColumn("target", F.when(F.array_contains(labels, F.col("sense")), F.col("sense")).otherwise(negative))


def pure_values(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, value, label) of values that occur with exactly one label."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features])
    long = rows.select(F.explode(pairs).alias("x"), F.col(label).alias("_label")).select("x.*", "_label").where("value is not null")
    found = long.groupBy("feature", "value").agg(F.min("_label").alias(label), F.max("_label").alias("_most"))
    return found.where(F.col(label) == F.col("_most")).drop("_most")


def apply_purity(rows: DataFrame, features: list[str], label: str, pure: DataFrame) -> DataFrame:
    """Values that name one label, replaced by f<i>_<label>."""
    for i, feature in enumerate(features):
        own = pure.where(F.col("feature") == feature).select(F.col("value").alias("_value"), F.col(label).alias("_label"))
        joined = rows.join(own, rows[feature].cast("string") == own["_value"], "left")
        rows = joined.withColumn(feature, F.when(F.col("_label").isNotNull(), F.concat(F.lit(f"f{i}_"), F.col("_label").cast("string"))).otherwise(F.col(feature).cast("string"))).drop("_value", "_label")
    return rows
