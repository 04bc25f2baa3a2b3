"""Annotated instances on their way to learners: senses, sparse annotation, refeaturizing, encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import lemma_pos, letters_checksum
from lexgrove.operators import matrix as mx
from lexgrove.operators import relational as rel
from lexgrove.operators.windows import chunked_context, symmetric_context


def _values(order: str, value: str) -> Column:
    """The values of a group in order; of equal places the smaller first."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


# -- senses -----------------------------------------------------------------------------------------


def grouped_senses(senses: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lemma, pos, sid, senses): the senses given to one target, repeats included, in order.

    senses: (keys, lex, pos, sid, sense, order). Spaces within values become underscores, null an empty text.
    """
    plain = lambda name: F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"\s", "_")
    rows = senses.select(*keys, plain("lex").alias("lemma"), plain("pos").alias("pos"), plain("sid").alias("sid"), plain("sense").alias("_sense"), F.col(order).alias("_order"))
    return rows.groupBy(*keys, "lemma", "pos", "sid").agg(_values("_order", "_sense").alias("senses"))


def sense_inventory(targets: DataFrame, order: str) -> DataFrame:
    """(lemma, senses): the distinct senses of each lemma and part of speech, first seen first; null is no sense."""
    named = targets.where("sense is not null").select(lemma_pos(F.col("lemma"), F.col("pos")).alias("lemma"), "sense", F.col(order).alias("_order"))
    firsts = named.groupBy("lemma", "sense").agg(F.min("_order").alias("_first"))
    return firsts.groupBy("lemma").agg(_values("_first", "sense").alias("senses"))


# -- contexts of sparse annotation ------------------------------------------------------------------


def _letters(tokens: DataFrame) -> DataFrame:
    text = F.array_join(_values("pos", "word"), " ")
    sums = tokens.groupBy("sent_id").agg(letters_checksum(text).alias("_letters"))
    return sums.where(F.col("_letters") != F.md5(F.lit("")))


def sparse_contexts(corpus: DataFrame, own: DataFrame, targets: DataFrame, value: str, size: int, chunk: int = 100_000) -> DataFrame:
    """(instance_id, corpus_sent_id, left, right): contexts from the larger corpus that annotated sentences come from.

    corpus: (place, sent_id, pos, word, value), place a gapless number of its tokens; own: (sent_id, pos,
    word, value) of the annotated sentences; targets: (instance_id, sent_id, pos). Sentences are one if
    their letters a-z are; those without letters match nothing. Each place where a sentence occurs in the
    corpus gives a row. Targets without a match, and those whose position the corpus sentence lacks, take
    the context of their own sentence, with a null corpus_sent_id.
    """
    same = _letters(own).join(_letters(corpus).withColumnRenamed("sent_id", "corpus_sent_id"), "_letters").drop("_letters")
    around = chunked_context(corpus.select("place", "sent_id", "pos", value), "place", value, size, chunk)
    around = around.select(F.col("sent_id").alias("corpus_sent_id"), "pos", "left", "right")
    wanted = targets.select("instance_id", "sent_id", "pos")
    columns = ["instance_id", "corpus_sent_id", "left", "right"]
    matched = wanted.join(same, "sent_id").join(around, ["corpus_sent_id", "pos"]).select(*columns)
    alone = wanted.join(matched.select("instance_id").distinct(), "instance_id", "left_anti")
    inside = symmetric_context(own.select("sent_id", "pos", value), ["sent_id"], ["pos"], value, size)
    rest = alone.join(inside, ["sent_id", "pos"]).withColumn("corpus_sent_id", F.lit(None).cast(dict(corpus.dtypes)["sent_id"]))
    return matched.unionByName(rest.select(*columns))


# -- failed parses ----------------------------------------------------------------------------------


def failed_parses(frames: DataFrame, elements: DataFrame, parsed: DataFrame) -> DataFrame:
    """(sent_id, frame, target, target_pos, elements) of frames whose sentence has no parse.

    frames: (sent_id, frame_id, frame, target, target_pos); elements: (sent_id, frame_id, name); parsed: (sent_id).
    """
    failed = frames.join(parsed.select("sent_id").distinct(), "sent_id", "left_anti")
    names = elements.groupBy("sent_id", "frame_id").agg(F.array_sort(F.collect_list("name")).alias("elements"))
    found = failed.join(names, ["sent_id", "frame_id"], "left")
    return found.select("sent_id", "frame", "target", "target_pos", F.coalesce("elements", F.array().cast("array<string>")).alias("elements"))


def split_failed(failed: DataFrame, percent: int = 90, seed: str = "split") -> DataFrame:
    """failed with dataset, by sentence: all frames of a sentence fall into one part."""
    return rel.split(failed, "sent_id", percent, seed)


# -- features and lines for learners ----------------------------------------------------------------


def refeaturized(meta: DataFrame, counting: str, kinds: Sequence[str] | None = None, vocab: DataFrame | None = None, group: str = "lemma", strict_parity: bool = True) -> DataFrame:
    """The matrix anew from stored meta-features (group, instance_id, kind, feature), of some kinds or all.

    vocab: the vocabulary of training for rows of a test set; without it that of the rows themselves.
    """
    features = meta_features(meta, kinds, group)
    if vocab is None:
        return mx.fitted_matrix(features, counting, group, strict_parity)
    return mx.matrix(features, vocab, counting, group, strict_parity)


def meta_features(meta: DataFrame, kinds: Sequence[str] | None = None, group: str = "lemma") -> DataFrame:
    """(group, instance_id, feature): each stored feature under the name of its kind."""
    chosen = meta if kinds is None else meta.where(F.col("kind").isin(*kinds))
    return chosen.select(group, "instance_id", F.concat("kind", "feature").alias("feature"))


def _fields(line: Column) -> tuple[Column, Column]:
    parts = F.split(line, ",")
    return F.slice(parts, F.lit(1), F.size(parts) - 1), F.regexp_replace(F.element_at(parts, -1), r"\.$", "")


def indicator_line(line: Column) -> Column:
    """``0=a 1=b label`` from ``a,b,label``; a full stop after the label goes, null stays."""
    values, label = _fields(line)
    return F.when(line.isNotNull(), F.concat_ws(" ", F.transform(values, lambda v, i: F.concat(i.cast("string"), F.lit("="), v)), label))


def numbered_line(line: Column, number: Column) -> Column:
    """``number label a b`` from ``a,b,label``; a full stop after the label goes, null stays."""
    values, label = _fields(line)
    return F.concat(number.cast("string"), F.lit(" "), label, F.lit(" "), F.array_join(values, " "))


def numbered_lines(instances: DataFrame, order: Sequence[str], line: str = "instance", name: str = "numbered") -> DataFrame:
    """instances with their numbered line; lines are numbered from 1 by the order."""
    placed = rel.with_index(instances, order, "_line")
    return placed.withColumn(name, numbered_line(F.col(line), F.col("_line") + 1)).drop("_line")
