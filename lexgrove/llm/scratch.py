"""Session helpers shared by the operators: cuts of lineage, Arrow batch bounds,
and a broadcast bitmap of fixed size that prunes rows before a join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the bitmap that ``maybe_in`` broadcasts; each row holds 64 bits.
BITMAP_WORDS = 1 << 16
#: Rows of one Arrow batch; with Spark's byte bound this keeps long texts from piling up.
ARROW_ROWS = "2000"
ARROW_BYTES = str(16 << 20)


def session_for(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches bounded and a checkpoint folder known."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    except Exception as error:  # a Spark without this setting keeps the row bound
        if "CANNOT_MODIFY" not in str(error):
            raise
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where all runs on one machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="lexgrove-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute the frame once, into a table in the shared folder; neither order nor partitions are kept.

    A checkpoint would run the last stage twice and pass on estimated sizes, which the joins of
    a loop multiply to numbers of unbounded length; a table's size is known.
    """
    spark = session_for(df)
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_in_order(df: DataFrame) -> DataFrame:
    """Compute the frame once, by a reliable checkpoint, with its partitions and their order."""
    session_for(df)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


REST = "lexgrove_rest"


def folded(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*rest).alias(REST)] if rest else []))


def unfolded(rows: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns that folded took, in their order."""
    return rows.select(*[F.col(c) if c in needed else F.col(REST).getField(c).alias(c) for c in columns])


def _probed(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    bit = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(BITMAP_WORDS * 64))
    bitmap = (
        ids.where(F.col(id_col).isNotNull())
        .select(bit.alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bits"))
    )
    probe = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(BITMAP_WORDS * 64))
    joined = rows.withColumn("_probe", probe).withColumn("_word", F.shiftright("_probe", 6)).join(F.broadcast(bitmap), "_word", "left")
    hit = F.col(key).isNotNull() & F.expr("coalesce(getbit(_bits, cast(_probe & 63 as int)), 0) = 1")
    return joined.withColumn("_hit", hit).drop("_probe", "_word", "_bits")


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key may be among ids, by a bitmap of BITMAP_WORDS * 64 hashed bits.

    No row whose key is in ids is lost; some others stay, so an exact join has to follow.
    The bitmap has BITMAP_WORDS rows at most whatever the size of ids, so it is broadcast.
    Null keys match nothing.
    """
    return _probed(rows, key, ids, id_col).where("_hit").drop("_hit")


def never_in(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The other rows: those that maybe_in leaves out, null keys too. None of their keys is in ids."""
    return _probed(rows, key, ids, id_col).where("not _hit").drop("_hit")


def without(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key is not in ids, null keys too; only those that the bitmap hits are shuffled."""
    probed = _probed(rows, key, ids, id_col)
    rest = probed.where("_hit").drop("_hit")
    gone = ids.select(F.col(id_col).alias("_gone"))
    return probed.where("not _hit").drop("_hit").unionByName(rest.join(gone, rest[key] == gone["_gone"], "left_anti"))
