"""Mix sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share, by weight, of ``budget`` times all words, at most
``most_epochs`` times its own words; what a source can't take is shared again by weight
(water-filling, in closed form over the sources sorted by cap / weight). A source with a
target of r times its size is taken floor(r) times whole; the rest is sampled without
replacement: a document's key is an exponential variate over its quality weight, documents
are taken in the order of their keys while the sum of their words fits, and up to CLOSERS
more whole documents, each of the size nearest to the gap that is left, close it as far as
that brings the sum nearer to the target.

Keys are hashes of doc_id, so reruns agree. No source is sorted as a whole: keys are cut
into slots of about SLOT documents, word sums are taken by slot, and only the slot in which
the budget ends is ranked row by row. JVM-side throughout.

Defined results: a null text has 0 words; a null source is a source, after all others; rows
that repeat a doc_id are documents of their own; a quality that is null, not finite or not
positive weighs 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut, folded, unfolded

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST_EPOCHS = 2
SLOT = 4096
CLOSERS = 4
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, docs) to the same with target double; one row a source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # level: what a unit of weight gets if exactly the sources before this one are capped; it is
    # largest where those are just the sources that the level caps
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("level", (F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("target", F.least(F.col("cap"), F.max("level").over(every) * F.col("weight")))
        .select("source", "source_size", "docs", "target")
    )


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """In (0, 1), from 48 bits of an md5 of the id; null counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    quality: str | None = None,
    most: int = MOST_EPOCHS,
    slot: int = SLOT,
) -> DataFrame:
    """docs with the columns size, source_size, target, taken and _copies added.

    quality: a column of positive weights. Columns of those four names are replaced.
    """
    return mixed(docs.withColumn("size", word_count("text")), weights, budget, quality, most, slot)


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORDS)), F.lit(0)).cast("long")


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    quality: str | None = None,
    most: int = MOST_EPOCHS,
    slot: int = SLOT,
) -> DataFrame:
    """As mix, over rows that have their size; rows stay as slim as the given ones."""
    w = F.col(quality).cast("double") if quality else F.lit(1.0)
    w = F.when(w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf")), 1.0).otherwise(w)
    slim = docs.withColumn("_v", 1 - F.exp(F.log(uniform(F.col("doc_id"))) / w)).withColumn("_tie", F.xxhash64(*[F.col(c) for c in ("doc_id", "size")]))
    per_source = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, budget, most)
    per_source = per_source.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).alias("_epochs"),
        F.ceil(F.col("docs") / slot).alias("_slots"),
    ).withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size"))
    keyed = (
        slim.drop("source_size", "target", "taken")
        .join(per_source, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_slot", F.floor(F.col("_v") * F.col("_slots")))
    )
    # what comes before each slot; the slot in which the budget ends has _before <= _left < _before + its sum
    sums = keyed.groupBy("source", "_slot").agg(F.sum("size").alias("_sum"), F.first("_left").alias("_left"))
    running = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        .where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_sum")))
        .select(F.col("source").alias("_source"), F.col("_slot").alias("_end"), "_before")
    )
    placed = keyed.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    in_end = F.col("_slot") == F.col("_end")
    order = Window.partitionBy("source", "_slot", "_end").orderBy("_v", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = placed.where(in_end).withColumn("_sum", F.col("_before") + F.sum("size").over(order))
    tail = tail.withColumn("_in", F.col("_sum") <= F.col("_left")).drop("_sum")
    slot_rows = Window.partitionBy("source", "_slot")
    for _ in range(CLOSERS):
        tail = tail.withColumn("_gap", F.col("_left") - F.col("_before") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0)).over(slot_rows))
        off = F.abs(F.col("size") - F.col("_gap"))
        tail = tail.withColumn("_off", F.when(~F.col("_in") & (off < F.abs("_gap")), off))
        nearest = F.row_number().over(slot_rows.orderBy(F.col("_off").asc_nulls_last(), "_v", "_tie"))
        tail = tail.withColumn("_in", F.col("_in") | ((nearest == 1) & F.col("_off").isNotNull()))
    tail = tail.drop("_gap", "_off")
    whole = placed.where(~F.coalesce(in_end, F.lit(False))).withColumn("_in", F.coalesce(F.col("_slot") < F.col("_end"), F.col("_left") >= F.col("source_size")))
    both = whole.unionByName(tail).withColumn("taken", F.col("size") * (F.col("_epochs") + F.col("_in").cast("long")))
    return both.select(*[c for c in docs.columns if c not in ("source_size", "target", "taken")], "source_size", "target", "taken", (F.col("_epochs") + F.col("_in").cast("long")).alias("_copies"))


def mixed_documents(docs: DataFrame, weights_of: DataFrame | None = None, **parameters) -> DataFrame:  # noqa: ANN003
    """The mix itself: docs, all columns, each row as often as it is taken.

    weights_of: (_id, quality), a quality weight for each doc_id at most.
    """
    rows = folded(docs, "doc_id", "source", "text").withColumn("_key", F.xxhash64("doc_id", "source", "text"))
    slim = cut(rows.select("_key", "doc_id", "source", word_count("text").alias("size")))
    if weights_of is not None:
        slim = slim.join(weights_of, F.col("doc_id") == F.col("_id"), "left").drop("_id")
        parameters["quality"] = "quality"
    # texts meet only the number of their copies; equal rows share theirs out
    taken = cut(mixed(slim, **parameters).groupBy("_key").agg(F.sum("_copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0"))
    some = rows.join(taken, "_key")
    if not taken.where("_rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
        shared = some.where("_rows > 1").withColumn("_all", F.floor(F.col("_all") / F.col("_rows")) + (place <= F.col("_all") % F.col("_rows")).cast("long"))
        some = some.where("_rows = 1").unionByName(shared.where("_all > 0"))
    copies = some.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_all").cast("int"))))
    return unfolded(copies, docs.columns, "doc_id", "source", "text")
