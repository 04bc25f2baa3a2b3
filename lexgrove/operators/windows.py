"""Ordered sequences: contexts around targets, islands, spans, nearest rows, siblings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUNCTUATION = r"^[^\p{L}\p{N}]+$"


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_punctuation: bool = True, also: Sequence[str] = ()) -> DataFrame:
    """(key, also, pos, word): words between single spaces, lower-cased, numbered within their row."""
    parts = docs.select(key, *also, F.posexplode(F.split(F.lower(text), " ")).alias("pos", "word")).where("word <> ''")
    return parts.where(~F.col("word").rlike(PUNCTUATION)) if drop_punctuation else parts


def symmetric_context(rows: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, size: int) -> DataFrame:
    """rows with left and right: the size values before and after, in order; fewer at the edges."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("left", F.collect_list(value).over(window.rowsBetween(-size, -1))).withColumn("right", F.collect_list(value).over(window.rowsBetween(1, size)))


def chunked_context(rows: DataFrame, index: str, value: str, size: int, chunk: int = 100_000) -> DataFrame:
    """symmetric_context over one long sequence: chunks by a gapless index, each with halos of its neighbours.

    No partition grows beyond a chunk and its two halos, whatever the length of the sequence.
    """
    home = F.floor(F.col(index) / chunk)
    spread = rows.withColumn("_home", home).withColumn(
        "_chunk",
        F.explode(
            F.array_distinct(
                F.array(home, F.floor((F.col(index) + size) / chunk), F.greatest(F.floor((F.col(index) - size) / chunk), F.lit(0)))
            )
        ),
    )
    found = symmetric_context(spread, ["_chunk"], [index], value, size)
    return found.where("_home = _chunk").drop("_home", "_chunk")


def context_slots(rows: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, size: int) -> DataFrame:
    """As symmetric_context, but every slot is kept: null beyond the edges."""
    window = Window.partitionBy(*partition).orderBy(*order)
    before = F.array(*[F.lag(value, k).over(window) for k in range(size, 0, -1)])
    after = F.array(*[F.lead(value, k).over(window) for k in range(1, size + 1)])
    return rows.withColumn("left", before).withColumn("right", after)


def ngrams_around(left: Column, right: Column) -> dict[str, Column]:
    """Bigram and trigram texts around a target, from compacted contexts: the word after it comes first."""
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    return {
        "bigram": F.concat_ws("_", at(left, -1), at(right, 1)),
        "trigram": F.concat_ws("_", at(left, -2), at(left, -1), at(right, 1)),
    }


def islands(rows: DataFrame, partition: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """rows with island: the number of the run of equal values on end, from 1."""
    window = Window.partitionBy(*partition).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(window))) | F.lag(F.lit(1)).over(window).isNull()
    return rows.withColumn("_new", new.cast("long")).withColumn("island", F.sum("_new").over(window)).drop("_new")


def sentences(rows: DataFrame, partition: Sequence[str], order: Sequence[str], blank: Column) -> DataFrame:
    """Rows that aren't blank, with sentence: the number of blank rows before."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_blank", blank).withColumn("sentence", F.sum(F.col("_blank").cast("long")).over(window)).where("not _blank").drop("_blank")


def decode_spans(rows: DataFrame, partition: Sequence[str], order: str, tag: str) -> DataFrame:
    """(partition, label, first, last) of spans tagged B-x, ..., E-x; one word: B-x:E-x.

    A begin meets the nearest end of its label with no other begin of that label between; a
    begin or an end without its counterpart is left out (see broken_spans).
    """
    marks = rows.select(*partition, order, F.explode(F.split(tag, ":")).alias("mark")).where("mark rlike '^[BE]-'")
    marks = marks.select(*partition, order, F.substring("mark", 1, 1).alias("side"), F.expr("substring(mark, 3)").alias("label"))
    window = Window.partitionBy(*partition, "label").orderBy(order, "side")
    paired = marks.withColumn("next_side", F.lead("side").over(window)).withColumn("last", F.lead(order).over(window))
    return paired.where("side = 'B' and next_side = 'E'").select(*partition, "label", F.col(order).alias("first"), "last")


def broken_spans(rows: DataFrame, partition: Sequence[str], order: str, tag: str) -> DataFrame:
    """Marks without counterpart: (partition, label, side, place)."""
    marks = rows.select(*partition, order, F.explode(F.split(tag, ":")).alias("mark")).where("mark rlike '^[BE]-'")
    marks = marks.select(*partition, order, F.substring("mark", 1, 1).alias("side"), F.expr("substring(mark, 3)").alias("label"))
    window = Window.partitionBy(*partition, "label").orderBy(order, "side")
    seen = marks.withColumn("_next", F.lead("side").over(window)).withColumn("_last", F.lag("side").over(window))
    lost = ((F.col("side") == "B") & (F.coalesce("_next", F.lit("")) != "E")) | ((F.col("side") == "E") & (F.coalesce("_last", F.lit("")) != "B"))
    return seen.where(lost).select(*partition, "label", "side", F.col(order).alias("place"))


def nearest_flags(rows: DataFrame, partition: Sequence[str], value: str, distance: str, name: str, noval: str = "NONE") -> DataFrame:
    """1 on rows whose distance is least among rows of the partition with the same value, else 0."""
    least = F.min(distance).over(Window.partitionBy(*partition, value))
    hit = (F.col(value) != noval) & (F.col(distance) == least)
    return rows.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int"))


def siblings(rows: DataFrame, parent: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """rows with left_sibling and right_sibling: the neighbours' values under the same parent."""
    window = Window.partitionBy(*parent).orderBy(*order)
    return rows.withColumn("left_sibling", F.lag(value).over(window)).withColumn("right_sibling", F.lead(value).over(window))


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str) -> DataFrame:
    """Positions of two sequences side by side: (keys, left, right, matches); a missing side is null."""
    a = left.select(*keys, F.col(left_value).alias("left"))
    b = right.select(*keys, F.col(right_value).alias("right"))
    return a.join(b, list(keys), "full").withColumn("matches", F.col("left").eqNullSafe(F.col("right")))


def aligned(zipped_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether all positions match, for each key."""
    return zipped_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("positions"), F.count_if("matches").alias("matching"), F.bool_and("matches").alias("aligned"))


def snap_spans(spans: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans (keys, span_id, start, stop) of characters moved to the bounds of the words they touch.

    words: (keys, w_start, w_stop). A span that touches no word is dropped.
    """
    touching = spans.join(words, list(keys)).where("w_start <= stop and w_stop >= start")
    return touching.groupBy(*keys, "span_id").agg(F.min("w_start").alias("start"), F.max("w_stop").alias("stop"))


def without_overlaps(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of a layer, (keys, span_id, start, stop), without overlaps.

    If a later label starts inside an earlier one it goes; else, if it ends inside, the earlier goes.
    """
    other = spans.select(*keys, F.col("span_id").alias("o_id"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
    pairs = spans.join(other, list(keys)).where("span_id <> o_id")
    later = pairs.where("o_id < span_id and start between o_start and o_stop")
    earlier = pairs.where("o_id > span_id and not (o_start between start and stop) and o_stop between start and stop")
    gone = later.select(*keys, "span_id").unionAll(earlier.select(*keys, "span_id")).distinct()
    return spans.join(gone, [*keys, "span_id"], "left_anti")
