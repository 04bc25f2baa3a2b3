"""Feature files, table dumps, answer keys, meta-features, reports and annotators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import escape_field


def nary_lines(instances: DataFrame, features: list[str], labels: str, keep: bool = False) -> DataFrame:
    """instances with line: values, then the label; with keep, after a semicolon all labels (an array)."""
    values = [escape_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in features]
    if keep:
        line = F.concat(F.concat_ws(",", *values), F.lit(";"), F.array_join(F.transform(labels, escape_field), ","))
    else:
        line = F.concat_ws(",", *values, escape_field(F.col(labels)))
    return instances.withColumn("line", line)


def write_feature_files(lines: DataFrame, path: str, *groups: str) -> None:
    """Lines as text files, a folder for each group; read back by partition discovery."""
    lines.select(*groups, F.col("line").alias("value")).write.partitionBy(*groups).mode("overwrite").text(path)


def read_feature_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def dump(table: DataFrame, path: str) -> None:
    """The table as CSV with a header, and its schema as JSON in a folder beside."""
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/rows")
    table.sparkSession.createDataFrame([(table.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def load(spark: SparkSession, path: str, result_columns: list[str] | None = None, noval: str = "NONE") -> DataFrame:
    """A dumped table with its types; missing result columns are added."""
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(f"{path}/rows")
    missing = [c for c in result_columns or [] if c not in rows.columns]
    return rows.select("*", *[F.lit(noval).alias(c) for c in missing])


def answer_keys(instances: DataFrame, join: str = "++") -> DataFrame:
    """(lemma, pos, ids, sid, senses, senses_used): one row a target, senses joined for multilabel use."""
    return instances.select("lemma", "pos", "ids", "sid", "senses", F.array_join(F.array_sort("senses"), join).alias("senses_used"))


def meta_features(contexts: DataFrame) -> DataFrame:
    """(key columns, features map): each kind of meta-feature with its list; to be kept as Parquet."""
    keys = [c for c in contexts.columns if c not in ("kind", "values")]
    return contexts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "values")))).alias("features"))


def report(metrics: DataFrame, title: str) -> str:
    """A small table as text, sorted by its first columns."""
    rows = metrics.orderBy(*metrics.columns[:2]).toPandas()
    return f"{title}\n{rows.to_string(index=False)}\n"


def annotated(tokens: DataFrame, annotate: Callable[[list[str]], list[dict[str, str]]], columns: str) -> DataFrame:
    """tokens (sent_id, pos, word) with columns that a tool gives for each sentence's words.

    annotate takes a sentence's words and returns a dict for each; it stands for taggers,
    lemmatizers and the like. Sentences are small groups by nature.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [annotate(list(w)) for w in batch["words"]]
            flat = [(s, i, w, *(d.get(n) for n in names)) for s, words, ds in zip(batch["sent_id"], batch["words"], found, strict=True) for i, (w, d) in enumerate(zip(words, ds, strict=True))]
            yield pd.DataFrame(flat, columns=["sent_id", "pos", "word", *names])

    sentences = tokens.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return sentences.mapInPandas(run, f"sent_id string, pos int, word string, {columns}")
