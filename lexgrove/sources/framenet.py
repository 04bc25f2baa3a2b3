"""FrameNet XML: lexical units and full texts, layers of labels, and word tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.operators import windows

_LABELS = "labels: struct<label: array<struct<_ID: string, _name: string, _start: int, _end: int, _itype: string>>>"
_LAYERS = f"layers: struct<layer: array<struct<_name: string, _rank: int, {_LABELS}>>>"
_SET = f"struct<_ID: string, _frameName: string, _luName: string, {_LAYERS}>"
UNIT_SCHEMA = (
    "_ID string, _name string, _frame string, _pos string, subcorpus array<struct<_name: string, "
    f"annotationSet: array<struct<_ID: string, {_LAYERS}, sentence: struct<_ID: string, text: string>>>>>"
)
TEXT_SCHEMA = f"_ID string, text string, annotationSets struct<annotationSet: array<{_SET}>>, annotationSet array<{_SET}>"
TAGGED = ("FE", "GF", "PT", "Target")


def _layer_rows(rows: DataFrame, *keys: str) -> DataFrame:
    layers = rows.select(*keys, F.explode("layers.layer").alias("y"))
    labels = layers.select(*keys, F.col("y._name").alias("layer"), F.coalesce("y._rank", F.lit(1)).alias("rank"), F.posexplode("y.labels.label").alias("span_id", "b"))
    return labels.select(*keys, "layer", "rank", "span_id", F.col("b._name").alias("label"), F.col("b._start").alias("start"), F.col("b._end").alias("stop"), F.col("b._itype").alias("itype"))


def read_units(spark: SparkSession, path: str, file_pattern: str | None = None) -> DataFrame:
    """(lemma, pos, frame, set_id, sent_id, text, layer, rank, span_id, label, start, stop, itype) of lexical units.

    lemma and pos come from the unit's name, cut at its last dot. file_pattern filters files.
    """
    raw = spark.read.format("xml").option("rowTag", "lexunit-annotation").schema(UNIT_SCHEMA).load(path).withColumn("file", F.input_file_name())
    raw = raw if file_pattern is None else raw.where(F.col("file").rlike(file_pattern))
    unit = [F.regexp_replace("_name", r"\.[^.]*$", "").alias("lemma"), F.substring_index("_name", ".", -1).alias("pos"), F.col("_frame").alias("frame")]
    sets = raw.select(*unit, F.explode("subcorpus").alias("c")).select("lemma", "pos", "frame", F.explode("c.annotationSet").alias("a"))
    flat = sets.select("lemma", "pos", "frame", F.col("a._ID").alias("set_id"), F.col("a.sentence._ID").alias("sent_id"), F.col("a.sentence.text").alias("text"), F.col("a.layers").alias("layers"))
    return _layer_rows(flat, "lemma", "pos", "frame", "set_id", "sent_id", "text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """As read_units, of the sentences of full texts: one annotation set for each frame."""
    raw = spark.read.format("xml").option("rowTag", "sentence").schema(TEXT_SCHEMA).load(path)
    every = F.concat(F.coalesce("annotationSets.annotationSet", F.array().cast(f"array<{_SET}>")), F.coalesce("annotationSet", F.array().cast(f"array<{_SET}>")))
    sets = raw.select(F.col("_ID").alias("sent_id"), "text", F.explode(every).alias("a"))
    name = F.col("a._luName")
    flat = sets.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("lemma"), F.substring_index(name, ".", -1).alias("pos"), F.col("a._frameName").alias("frame"), F.col("a._ID").alias("set_id"), "sent_id", "text", F.col("a.layers").alias("layers")
    )
    return _layer_rows(flat, "lemma", "pos", "frame", "set_id", "sent_id", "text")


def by_frame(units: DataFrame, frames: list[str] | None = None, lemmas: list[str] | None = None) -> DataFrame:
    rows = units if frames is None else units.where(F.col("frame").isin(frames))
    return rows if lemmas is None else rows.where(F.col("lemma").isin(lemmas))


def usable_labels(labels: DataFrame) -> DataFrame:
    """Labels that mark text: no null instantiations, no second rank of FEs, no overlaps within a layer."""
    real = labels.where("itype is null and start is not null and stop is not null and not (layer = 'FE' and rank > 1)")
    kept = windows.without_overlaps(real.withColumn("layer_", F.col("layer")), ["set_id", "layer_", "rank"])
    return kept.drop("layer_")


def words(texts: DataFrame) -> DataFrame:
    """(sent_id, pos, word, w_start, w_stop) of texts cut at spaces; bounds are inclusive characters."""
    parts = texts.select("sent_id", "text").distinct().select("sent_id", F.posexplode(F.split("text", " ")).alias("n", "word"))
    before = F.coalesce(F.sum(F.length("word") + 1).over(Window.partitionBy("sent_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("w_start", before.cast("int")).withColumn("w_stop", (before + F.length("word") - 1).cast("int")).where("word <> ''")
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("sent_id").orderBy("n")) - 1).drop("n")


def word_tags(labels: DataFrame, sentence_words: DataFrame) -> DataFrame:
    """(sent_id, set_id, layer, pos, tag): B-x at the first word of a label, E-x at the last; one word has both."""
    spans = usable_labels(labels).select("sent_id", "set_id", "layer", "label", "start", "stop").withColumn("span_id", F.struct("layer", "label", "start"))
    touched = spans.join(sentence_words, "sent_id").where("w_start <= stop and w_stop >= start")
    ends = touched.groupBy("sent_id", "set_id", "layer", "label", "span_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    marks = F.when(F.col("first") == F.col("last"), F.array(F.struct(F.col("first").alias("pos"), F.concat(F.lit("B-"), "label", F.lit(":E-"), "label").alias("tag")))).otherwise(
        F.array(F.struct(F.col("first").alias("pos"), F.concat(F.lit("B-"), "label").alias("tag")), F.struct(F.col("last").alias("pos"), F.concat(F.lit("E-"), "label").alias("tag")))
    )
    long = ends.select("sent_id", "set_id", "layer", F.explode(marks).alias("m")).select("sent_id", "set_id", "layer", "m.*")
    return long.groupBy("sent_id", "set_id", "layer", "pos").agg(F.array_join(F.array_sort(F.collect_list("tag")), ":").alias("tag"))


def wide_lines(labels: DataFrame) -> DataFrame:
    """(sent_id, pos, line): tab lines with one group (pt, gf, role, target, frame, stuff) for each annotation set."""
    tokens = words(labels)
    tags = word_tags(labels, tokens)
    sets = labels.select("sent_id", "set_id", "frame", "lemma").distinct()
    layer = lambda name: F.coalesce(F.max(F.when(F.col("layer") == name, F.col("tag"))), F.lit("-"))
    cells = tokens.join(sets, "sent_id").join(tags, ["sent_id", "set_id", "pos"], "left").groupBy("sent_id", "pos", "word", "set_id", "frame", "lemma").agg(layer("PT").alias("pt"), layer("GF").alias("gf"), layer("FE").alias("role"), layer("Target").alias("t"))
    target = F.when(F.col("t") == "-", "-").otherwise(F.col("lemma"))
    group = F.concat_ws("\t", "pt", "gf", "role", target, F.when(F.col("t") == "-", "-").otherwise(F.col("frame")), F.lit("-"))
    lines = cells.groupBy("sent_id", "pos", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("set_id", group.alias("g")))), lambda x: x["g"]), "\t").alias("groups"))
    return lines.select("sent_id", "pos", F.concat_ws("\t", "word", "groups", F.lit("-"), "sent_id").alias("line"))
