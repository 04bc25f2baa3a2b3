"""Lines that many documents share, found by a range-partitioned sort of line hashes.

Each line's key (stripped, A-Z lower-cased) becomes a 128-bit hash. Rows (hash, doc_id,
line number) are dealt out by ranges of (hash, doc_id descending), so that even a line of
every document is spread over many tasks, and sorted by document and position within.
Each task streams over its rows: the first document of a hash, the one with the largest
id, keeps its lines; those of the others go once enough documents have been seen. A hash
that may go on in a neighbouring task is left open, with a summary; there are two
summaries a task, so joining them back needs no shuffle. What comes out is a compressed
bitmap of kept lines for each document that loses any; texts are never sorted or shipped
with the lines.

Defined results: a null or empty text is one empty line. Rows with a null doc_id keep all
their lines and count for no other row. Rows that repeat a doc_id count as one document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut_in_order, folded, session_for, shuffle_partitions, unfolded

MIN_CHARS = 20
MIN_DOCS = 3
WHITE = b" \t\n\x0b\x0c\r"

_LINES = "h1 long, h2 long, doc_id long, print long, line int"
_SWEPT = "kind int, h1 long, h2 long, doc_id long, print long, line int, docs long"
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
            digests, docs, marks, numbers = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                for n, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(ids[i])
                        marks.append(prints[i])
                        numbers.append(n)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(numbers, pa.int32())],
                ["h1", "h2", "doc_id", "print", "line"],
            )

    return run


def _sweep(min_docs: int):
    """Stream one task's sorted rows; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top, last, docs = None, None, None, 0
        first_key, waiting = None, []
        out: list[tuple] = []

        def close(ended: bool) -> None:
            """The group is over: at the end of the task or with another hash."""
            if key is None:
                return
            if key == first_key or ended:
                out.append((_SUMMARY, *key, top, None, None, docs))
            if key == first_key or (ended and docs < min_docs):
                out.extend((_OPEN, *key, *row, None) for row in waiting)
            waiting.clear()

        for batch in batches:
            for *found, doc, mark, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (now := tuple(found)) != key:
                    close(False)
                    first_key = first_key or now
                    key, top, last, docs = now, doc, None, 0
                if doc != last:
                    last, docs = doc, docs + 1
                if key == first_key:  # it may have begun in the task before
                    out.append((_OPEN, *key, doc, mark, line, None))
                elif docs < min_docs:
                    waiting.append((doc, mark, line))
                else:
                    out.extend((_DROP, None, None, *row, None) for row in waiting if row[0] != top)
                    waiting.clear()
                    out.append((_DROP, None, None, doc, mark, line, None))
            if len(out) > 50_000:
                yield _rows(out)
                out.clear()
        close(True)
        yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "h1", "h2", "doc_id", "print", "line", "docs"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for lines in batch.column("lines"):
            gone = np.array(lines.as_py())
            keep = np.ones((gone.max() + 8) // 8 * 8, bool)  # whole bytes
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("print"), pa.array(maps, pa.binary())], ["doc_id", "print", "keep"])


def _prints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("print"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, print, keep) of each document that loses lines; print is xxhash64(text).

    keep: zlib of the bits of the lines from the first on, 1 for a kept line, up to the
    last line that goes; lines beyond stay.
    """
    spark = session_for(docs)
    lines = cut_in_order(_prints(docs).where("doc_id is not null").mapInArrow(_hash_lines(min_chars), _LINES))
    swept = cut_in_order(
        lines.repartitionByRange(shuffle_partitions(spark), F.col("h1"), F.col("h2"), F.col("doc_id").desc())
        .sortWithinPartitions(F.col("h1"), F.col("h2"), F.col("doc_id").desc(), "line")
        .mapInArrow(_sweep(min_docs), _SWEPT)
    )
    whole = swept.where(F.col("kind") == _SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc_id").alias("top"))
    decided = swept.where(F.col("kind") == _DROP).select("doc_id", "print", "line")
    opened = (
        swept.where(F.col("kind") == _OPEN)
        .join(F.broadcast(whole), ["h1", "h2"])  # two rows a task at most
        .where((F.col("all_docs") >= min_docs) & (F.col("doc_id") != F.col("top")))
        .select("doc_id", "print", "line")
    )
    gone = decided.unionAll(opened).groupBy("doc_id", "print").agg(F.collect_set("line").alias("lines"))
    return gone.mapInArrow(_bitmaps, "doc_id long, print long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns and rows of docs, and _keep (null: all lines stay)."""
    side = bitmaps.select(F.col("doc_id").alias("_id"), F.col("print").alias("_of"), F.col("keep").alias("_keep"))
    marked = docs.withColumn("_print", F.xxhash64("text"))
    return marked.join(side, (F.col("doc_id") == F.col("_id")) & (F.col("_print") == F.col("_of")), "left").drop("_id", "_of", "_print")


def _apply(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The kept lines on end, the number of lines, and of lines that went."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    kept = [x for x, stays in zip(lines, bits, strict=False) if stays] + lines[len(bits) :]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_apply(t.as_py() or b"", k.as_py()) for t, k in zip(batch.column("text").cast(pa.binary()), batch.column("_keep"), strict=True)]
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array([n for _, n, _ in done], pa.int64()),
                pa.array([n for _, _, n in done], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x, _, _ in done], pa.string()),
            ],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    session_for(docs)
    rows = docs.select("doc_id", "text")
    joined = with_bitmaps(rows, keep_bitmaps(rows, min_chars, min_docs))
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    return text.combine(keep, lambda t, k: _apply(t.encode(), k)[0].decode() if isinstance(t, str) and k is not None else t)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, all columns, with the text that stays; a null text stays null."""
    session_for(docs)
    rows = folded(docs, "doc_id", "text")
    joined = with_bitmaps(rows, keep_bitmaps(rows, min_chars, min_docs))
    kept_text = F.pandas_udf(_kept_text, "string")
    return unfolded(joined.withColumn("text", kept_text("text", "_keep")), docs.columns, "doc_id", "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
shared AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE top IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE top IS NULL OR doc_id = top), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (k)
GROUP BY doc_id
"""
