"""Sense features: a row for each target occurrence, from contexts, n-grams and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.operators import windows

EMPTY = "#####"


def entries(tokens: DataFrame) -> DataFrame:
    """tokens with entry: word#lemma#pos#ne, word and lemma lower-cased, an unknown lemma empty."""
    lemma = F.when(F.col("lemma") == "<unknown>", None).otherwise(F.lower("lemma"))
    return tokens.withColumn("entry", F.concat_ws("#", *[F.coalesce(c, F.lit("")) for c in (F.lower("word"), lemma, F.col("pos"), F.col("ne"))]))


def contexts(tokens: DataFrame, sizes: tuple[int, ...], partition: list[str], order: list[str]) -> DataFrame:
    """tokens with cx_<n>: entries of n words on either side without punctuation, in order."""
    rows = entries(tokens.where("not is_punct"))
    for n in sizes:
        rows = windows.symmetric_context(rows, partition, order, "entry", n).withColumn(f"cx_{n}", F.concat("left", "right")).drop("left", "right")
    return rows


def _fields(context: Column, prefix: str, field: int) -> Column:
    used = F.filter(context, lambda e: e != EMPTY)
    return F.transform(used, lambda e: F.concat(F.lit(prefix), F.element_at(F.split(e, "#"), field + 1)))


def context_features(context: Column, size: int, field: int = 2) -> Column:
    """CX<n> and a field of each entry; field 2 is the part of speech, 1 the lemma."""
    return _fields(context, f"CX{size}", field)


def context_pos_features(context: Column, size: int) -> Column:
    return _fields(context, f"POSCX{size}", 2)


def ngram_features(context: Column, size: int) -> Column:
    """Bigrams and trigrams of lemmas and parts of speech before and after the target.

    Places count from a full left context, so they shift near the edges of a text.
    """
    at = lambda i, field: F.element_at(F.split(F.try_element_at(context, F.lit(i)), "#"), field + 1)
    out = []
    for name, field in (("LEM", 1), ("POS", 2)):
        out.append(F.concat(F.lit(f"B{name}"), F.concat_ws("_", at(size, field), at(size + 1, field))))
        out.append(F.concat(F.lit(f"T{name}"), F.concat_ws("_", at(size - 1, field), at(size, field), at(size + 1, field))))
    return F.array(*out)


def syntax_features(dependencies: DataFrame, entry_of: DataFrame) -> DataFrame:
    """(sent_id, node_id, feature): relations to children, parents and siblings, alone and with the entry.

    dependencies: (sent_id, head_id, relation, dependent_id); entry_of: (sent_id, node_id, entry).
    """
    child = dependencies.select("sent_id", F.col("head_id").alias("node_id"), F.lit("CH").alias("kind"), "relation", F.col("dependent_id").alias("other"))
    parent = dependencies.select("sent_id", F.col("dependent_id").alias("node_id"), F.lit("PA").alias("kind"), "relation", F.col("head_id").alias("other"))
    own = dependencies.select("sent_id", "head_id", F.col("dependent_id").alias("node_id"))
    sibling = own.join(dependencies, ["sent_id", "head_id"]).where("node_id <> dependent_id").select("sent_id", "node_id", F.lit("SI").alias("kind"), "relation", F.col("dependent_id").alias("other"))
    every = child.unionAll(parent).unionAll(sibling).join(entry_of.withColumnRenamed("node_id", "other"), ["sent_id", "other"])
    both = F.array(F.concat("kind", "relation"), F.concat("kind", F.lit("SEM"), F.concat_ws("#", "relation", "entry")))
    return every.select("sent_id", "node_id", F.explode(both).alias("feature"))
