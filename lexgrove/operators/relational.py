"""Views, tables and their bookkeeping: selection, joins, keyed updates, catalog, runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import safe_value

NOVAL = "NONE"
INDEX = "row_id"
RUN_PREFIX = "result"


@dataclass(frozen=True)
class Where:
    """column = value, or column <> value."""

    column: str
    value: object
    equal: bool = True

    def expression(self, frame: DataFrame) -> Column:
        column = frame[self.column]
        return column == self.value if self.equal else column != self.value


def view(table: DataFrame, columns: Sequence[str] | str = "*", where: Sequence[Where] = (), distinct: bool = False, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Columns of the rows that meet all restrictions; a limit needs an order to be repeatable."""
    if not columns:
        raise ValueError("no columns are selected")
    rows = reduce(lambda frame, w: frame.where(w.expression(frame)), where, table)
    rows = rows if columns == "*" else rows.select(*columns)
    rows = rows.distinct() if distinct else rows
    if limit is not None:
        rows = rows.orderBy(*(order or rows.columns)).limit(limit)
    return rows


def join_view(main: DataFrame, split: DataFrame, main_key: str, split_key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of main that the split names; a bare column name means main's if both have it."""
    other = split.select(*[c for c in split.columns if c == split_key or c not in main.columns]).withColumnRenamed(split_key, "_key")
    return main.join(other, main[main_key] == other["_key"]).select(*columns)


def product_view(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows, as a view of two tables without a restriction gives; for small tables."""
    return left.crossJoin(right)


def unmatched(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def gold_last(table: DataFrame, features: Sequence[str], gold: str, name: str = "instance") -> DataFrame:
    """Each row as one text: feature values, then the label, commas spelled out."""
    fields = [safe_value(F.coalesce(F.col(c).cast("string"), F.lit(NOVAL))) for c in (*features, gold)]
    return table.withColumn(name, F.concat_ws(",", *fields))


def binary_gold(label: Column, noval: str = NOVAL, mapped: str = "FE") -> Column:
    return F.when(label == noval, noval).otherwise(mapped)


def groups(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.select(*columns).distinct()


def at_boundary(value: Column, noval: str = NOVAL) -> Column:
    """A text for the feature table: null or empty becomes the no-value mark."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(noval))


def too_long(table: DataFrame, column: str, most: int) -> DataFrame:
    return table.where(F.length(column) > most)


def with_index(table: DataFrame, order: Sequence[str], name: str = INDEX) -> DataFrame:
    """A gapless number from 0 by the order, from counts of sorted ranges: no task sees all rows."""
    spark = table.sparkSession
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id())
    ranged = ranged.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_task").cast("long"), 33))
    ranged = ranged.persist()
    sizes = sorted((r["_task"], r["count"]) for r in ranged.groupBy("_task").count().collect())  # a row a task
    base, before = [], 0
    for task, n in sizes:
        base.append((task, before))
        before += n
    bases = spark.createDataFrame(base, "_task int, _base long")
    return ranged.join(F.broadcast(bases), "_task").withColumn(name, F.col("_base") + F.col("_place")).drop("_task", "_place", "_base")


def updated(table: DataFrame, key: str, values: DataFrame, column: str) -> DataFrame:
    """table with column taken from values (key, column) where a row has one; keyed, never by position."""
    new = values.select(F.col(key).alias("_key"), F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    joined = table.join(new, table[key] == new["_key"], "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_key", "_new", "_hit")


def with_results(table: DataFrame, columns: Sequence[str], noval: str = NOVAL) -> DataFrame:
    """table with empty result columns added; those it has stay."""
    return table.select("*", *[F.lit(noval).alias(c) for c in columns if c not in table.columns])


def check_columns(table: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The table, if its columns are the expected ones apart from index and result columns."""
    own = {c for c in table.columns if c != INDEX and not c.startswith(f"{RUN_PREFIX}_")}
    if own != set(expected):
        raise ValueError(f"columns differ: {sorted(own ^ set(expected))}")
    return table


class Catalog:
    """Named tables of a database: create, open, append, drop and inspect."""

    def __init__(self, spark: SparkSession, database: str = "default") -> None:
        self.spark, self.database = spark, database

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def create(self, table: str, rows: DataFrame, index_columns: Sequence[str] = ()) -> DataFrame:
        if INDEX in index_columns or not set(index_columns) <= set(rows.columns):
            raise ValueError("index columns must be columns of the table")
        rows.write.mode("overwrite").saveAsTable(self._name(table))
        return self.open(table)

    def open(self, table: str, expected: Sequence[str] | None = None) -> DataFrame:
        rows = self.spark.table(self._name(table))
        return rows if expected is None else check_columns(rows, expected)

    def insert(self, table: str, rows: DataFrame) -> None:
        rows.select(*self.open(table).columns).write.mode("append").saveAsTable(self._name(table))

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")

    def drop_column(self, table: str, column: str) -> DataFrame:
        """The table without a column, written anew; its index and missing columns raise."""
        rows = self.open(table)
        if column == INDEX or column not in rows.columns:
            raise ValueError(f"{table} has no column {column} that can go")
        spare = f"{table}_without_{column}"
        rows.drop(column).write.mode("overwrite").saveAsTable(self._name(spare))
        self.drop(table)
        self.spark.sql(f"ALTER TABLE {self._name(spare)} RENAME TO {self._name(table)}")
        return self.open(table)

    def make_temporary(self, table: str, rows: DataFrame) -> DataFrame:
        """A named view that lasts as long as the session."""
        rows.createOrReplaceTempView(table)
        return self.spark.table(table)

    def drop_temporary(self, table: str) -> bool:
        return self.spark.catalog.dropTempView(table)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def drop_all(self, force: bool = False) -> None:
        if not force:
            raise ValueError("force=True drops all tables")
        for table in self.tables():
            self.drop(table)

    def columns(self, table: str) -> list[tuple[str, str]]:
        return self.open(table).dtypes

    def count(self, table: str) -> int:
        return self.open(table).count()

    def contents(self, table: str, most: int | None = None) -> DataFrame:
        rows = self.open(table)
        return rows if most is None else view(rows, limit=most)


# -- splits ---------------------------------------------------------------------------------------


def in_training(key: Column, percent: int, seed: str = "split") -> Column:
    """Whether a key falls in the training part: percent of an md5's range, alike in every run."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent


def split(table: DataFrame, key: str, percent: int = 90, seed: str = "split") -> DataFrame:
    """table with dataset: train or test, by the key."""
    if not 0 <= percent <= 100:
        raise ValueError("percent is between 0 and 100")
    return table.withColumn("dataset", F.when(in_training(F.col(key), percent, seed), "train").otherwise("test"))


def split_ambiguous(instances: DataFrame, key: str, group: str, label: str, percent: int = 90, seed: str = "split") -> DataFrame:
    """split, without the groups that have a single label."""
    labels = instances.groupBy(group).agg(F.count_distinct(label).alias("_n")).where("_n > 1").select(group)
    return split(instances.join(labels, group, "left_semi"), key, percent, seed)


# -- runs -----------------------------------------------------------------------------------------

RUN_SCHEMA = "run_id int, table_id string, step string, learners array<string>, model_features array<string>, xwise array<string>, okay boolean"


def find_run(runs: DataFrame, table_id: str, step: str, learners: Sequence[str], features: Sequence[str], xwise: Sequence[str]) -> DataFrame:
    """The confirmed run with these settings, if any; features and learners count as sets."""
    as_set = lambda values: F.array_sort(F.array(*[F.lit(v) for v in values]).cast("array<string>"))
    return runs.where(
        F.col("okay")
        & (F.col("table_id") == table_id)
        & (F.col("step") == step)
        & (F.array_sort("learners") == as_set(learners))
        & (F.array_sort("model_features") == as_set(features))
        & (F.array_sort("xwise") == as_set(xwise))
    )


def next_run_id(runs: DataFrame) -> DataFrame:
    """The number after the largest, for each table."""
    return runs.groupBy("table_id").agg((F.max("run_id") + 1).alias("run_id"))


def confirm_run(runs: DataFrame, table_id: str, run_id: int) -> DataFrame:
    return runs.withColumn("okay", F.col("okay") | ((F.col("table_id") == table_id) & (F.col("run_id") == run_id)))


def latest_run(runs: DataFrame) -> DataFrame:
    """The confirmed run of each table and step with the largest number."""
    order = Window.partitionBy("table_id", "step").orderBy(F.desc("run_id"))
    return runs.where("okay").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
