"""Grammatical functions learnt from annotated paths, and subcategorization frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 5
#: Names of functions whose paths are kept however rare.
KEPT_NAMES = "Head|Appositive|Quant|Protagonist"


def divide(rows: DataFrame, divisor: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of rows that come with every row of the divisor."""
    wanted = divisor.distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("_all"))
    hits = rows.select(*keys, *divisor.columns).distinct().join(wanted, divisor.columns, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    return hits.join(F.broadcast(total), F.col("_hits") == F.col("_all")).select(*keys)


def path_frequencies(observed: DataFrame, least: int = LEAST) -> DataFrame:
    """(pos, gf, prep, path, freq) of paths often enough seen, or of functions that are always kept.

    observed: (pos, gf, prep, path) with path an array of steps, printed.
    """
    counts = observed.groupBy("pos", "gf", "prep", "path").agg(F.count(F.lit(1)).alias("freq"))
    return counts.where((F.col("freq") >= least) | F.col("gf").rlike(KEPT_NAMES))


def trie(paths: DataFrame) -> DataFrame:
    """Paths of which one is the beginning of another of the same function: the more frequent stays."""
    longer = paths.select("pos", "gf", "prep", F.col("path").alias("_long"), F.col("freq").alias("_freq"))
    shorter = paths.select("pos", "gf", "prep", "path", "freq")
    nested = shorter.join(longer, ["pos", "gf", "prep"]).where((F.size("_long") > F.size("path")) & (F.slice("_long", 1, F.size("path")) == F.col("path")))
    lost_short = nested.where("_freq > freq").select("pos", "gf", "prep", "path")
    lost_long = nested.where("_freq <= freq").select("pos", "gf", "prep", F.col("_long").alias("path"))
    return paths.join(lost_short.unionAll(lost_long).distinct(), ["pos", "gf", "prep", "path"], "left_anti")


def restricted(paths: DataFrame, only_down: bool = False, longest: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    rows = paths.where(F.forall("path", lambda s: s.startswith("D"))) if only_down else paths
    rows = rows.where(F.size("path") <= longest) if longest is not None else rows
    return rows.where(~F.col("gf").isin(*without)) if without else rows


def potential_functions(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Each node's best learnt function: found is (sent_id, start, node_id, pos, prep, path)."""
    met = found.join(paths.withColumnRenamed("prep", "_prep"), ["pos", "path"]).where(F.col("prep").eqNullSafe(F.col("_prep")))
    order = Window.partitionBy("sent_id", "start", "node_id").orderBy(F.desc("freq"), "gf")
    return met.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("sent_id", "start", "node_id", "gf", "prep", "freq")


def subcat_frames(observed: DataFrame) -> DataFrame:
    """(lemma, pos, frame, slots, freq): slots are the sorted (gf, prep, fe, one or many) of an instance.

    observed: (lemma, pos, frame, instance_id, gf, prep, fe), a row for each filler.
    """
    slots = observed.groupBy("lemma", "pos", "frame", "instance_id", "gf", "prep", "fe").agg(F.when(F.count(F.lit(1)) > 1, "many").otherwise("one").alias("number"))
    each = slots.groupBy("lemma", "pos", "frame", "instance_id").agg(F.array_sort(F.collect_list(F.struct("gf", "prep", "fe", "number"))).alias("slots"))
    return each.groupBy("lemma", "pos", "frame", "slots").agg(F.count(F.lit(1)).alias("freq"))


def match_frames(fillers: DataFrame, frames: DataFrame, strict: bool = False) -> DataFrame:
    """(start, frame, slots, freq, rank): frames whose slots the fillers (start, lemma, pos, gf, prep) supply.

    strict: with no filler left over. Best frequency first.
    """
    needs = frames.select("lemma", "pos", "frame", "slots", "freq", F.size("slots").alias("_size"), F.explode("slots").alias("s"))
    have = fillers.groupBy("start", "lemma", "pos", "gf", "prep").agg(F.count(F.lit(1)).alias("n"))
    kinds = have.groupBy("start").agg(F.count(F.lit(1)).alias("_kinds"))
    needs = needs.select("lemma", "pos", "frame", "slots", "freq", "_size", F.col("s.gf").alias("gf"), F.col("s.prep").alias("prep"), F.col("s.number").alias("number"))
    met = have.join(needs.withColumnRenamed("prep", "_prep"), ["lemma", "pos", "gf"]).where(F.col("prep").eqNullSafe(F.col("_prep")) & ((F.col("number") == "many") | (F.col("n") == 1)))
    full = met.groupBy("start", "frame", "slots", "freq", "_size").agg(F.count(F.lit(1)).alias("_met")).where("_met = _size").join(kinds, "start")
    full = full.where("_kinds = _size") if strict else full
    order = Window.partitionBy("start").orderBy(F.desc("freq"), "frame", F.col("slots").cast("string"))
    return full.withColumn("rank", F.row_number().over(order)).select("start", "frame", "slots", "freq", "rank")
