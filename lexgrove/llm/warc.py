"""WARC archives of pages: written by the text sink, read by boundary-chain verification.

Writing: one record a page. Of pages with equal payloads of at least MIN_BYTES bytes the one
with the largest page_id is a response, the others are revisits that name it and have no
payload; smaller pages are all responses. A record ends in CRLF CRLF, which is the sink's line
separator, so archives are plain WARC/1.1 files on any file system that Spark writes to.

Reading: archives are split anywhere and each task cuts its split at the magic ``WARC/1.1``
CRLF. A cut whose header parses is a candidate record, with an offset and the offset of its
successor by Content-Length; magic inside a payload makes candidates too. Each task follows
successors through its own split, so that a candidate points at the offset where its chain
leaves the split; pointers from the file's start are then doubled over splits, and only
records that the chain reaches are real. A payload that runs on into other splits is put
together from them.

Defined results: a null html is an empty payload; a null url leaves out the target header;
control characters in a url are dropped. A null page_id is always a response, with a null
page_id when read. Rows equal in page_id and payload are all responses or all revisits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut, session_for, without

MIN_BYTES = 1000
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.IGNORECASE)
_FIELD = re.compile(rb"(?:^|\r\n)(warc-type|x-page-id|x-refers-to-page|warc-payload-digest|x-payload-length):[ \t]*([^\r\n]*)", re.IGNORECASE)


def _uuid(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), digest))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) into files of the folder."""
    session_for(pages)
    base = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("bytes", F.octet_length("html"))
    keyed = base.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    slim = cut(keyed.select("page_id", "url", "bytes", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.sha2("html", 256).alias("same")))
    groups = slim.groupBy("same").agg(F.max("page_id").alias("top"), F.min("page_id").alias("least")).where("top > least").select("same", "top")
    revisits = cut(slim.join(groups, "same").where("page_id < top"))
    # a page_id may come again with another payload: the pair is the key
    pair = F.xxhash64("page_id", F.sha2("html", 256))
    responses = without(base.withColumn("_pair", F.when(F.col("bytes") >= min_bytes, pair)), "_pair", revisits.select(F.xxhash64("page_id", "same").alias("_id")).distinct(), "_id")
    crlf = "\r\n"
    named = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(crlf))).otherwise("")
    bare_url = F.nullif(F.regexp_replace("url", r"[\p{Cntrl}\s]", ""), F.lit(""))

    def record(kind: str, digest: Column, body: Column, extra: Column) -> Column:
        http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
        return F.concat(
            F.lit(f"{MAGIC}WARC-Type: {kind}{crlf}WARC-Date: {DATE}{crlf}WARC-Record-ID: <urn:uuid:"),
            _uuid(F.col("page_id"), digest),
            F.lit(f">{crlf}"),
            named("WARC-Target-URI", bare_url),
            named("X-Page-Id", F.col("page_id")),
            F.lit("WARC-Payload-Digest: sha1:"),
            digest,
            F.lit(f"{crlf}X-Payload-Length: "),
            F.col("bytes").cast("string"),
            F.lit(crlf),
            extra,
            F.lit(f"Content-Type: application/http; msgtype=response{crlf}Content-Length: "),
            (F.octet_length(http) + F.octet_length(body)).cast("string"),
            F.lit(END),
            http,
            body,
        )

    profile = F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}")
    refers = F.concat(profile, F.lit("WARC-Refers-To: <urn:uuid:"), _uuid(F.col("top"), F.col("digest")), F.lit(f">{crlf}X-Refers-To-Page: "), F.col("top").cast("string"), F.lit(crlf))
    first = responses.select(record("response", F.sha1(F.encode("html", "UTF-8")), F.col("html"), F.lit("")).alias("value"))
    again = revisits.select(record("revisit", F.col("digest"), F.lit(""), refers).alias("value"))
    first.unionAll(again).write.option("lineSep", END).text(folder)


_FOUND = (
    "file string, block long, at long, next long, total long, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload_at long, payload_to long"
)
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]
_KINDS = [pa.string(), *[pa.int64()] * 5, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3]


class _Split:
    """The candidates of one split, with offsets from the split's first byte."""

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block, self.total = file, block, 0
        self.rows: list[list] = []
        self.open: list[tuple[int, int, int, object]] = []  # row, payload from, to, running digest

    def add(self, chunk: bytes, first: bool) -> None:
        magic = b"" if first else MAGIC.encode()
        start = self.total
        at = start + len(magic)
        self.total = at
        self.total += len(chunk)
        for row, low, high, digest in self.open:  # payloads that hold this magic
            if high > start:
                digest.update(magic[max(0, low - start) : high - start])
                digest.update(chunk[max(0, low - at) : max(0, high - at)])
        self.open = [x for x in self.open if x[2] > self.total]
        if first:
            return
        head = chunk.find(b"\r\n\r\n")
        length = _LENGTH.search(chunk, 0, head + 2) if head >= 0 else None
        if not length:
            return
        fields = {k.lower(): v for k, v in _FIELD.findall(chunk[: head + 2])}
        body = head + 4
        http = chunk.find(b"\r\n\r\n", body)
        end = body + int(length[1])
        low = http + 4 if 0 <= http and http + 4 <= end else end
        number = lambda name: int(fields[name]) if re.fullmatch(rb"-?\d{1,18}", fields.get(name, b"")) else None
        kind = fields.get(b"warc-type", b"").decode(errors="replace")
        row = [self.file, self.block, start, at + end + len(END), None, number(b"x-page-id"), end - low, None, kind, number(b"x-refers-to-page"), at + low, at + end]
        if kind == "revisit":
            row[6] = number(b"x-payload-length")
            row[7] = fields.get(b"warc-payload-digest", b"").decode(errors="replace").removeprefix("sha1:")
        else:
            row[7] = hashlib.sha1(chunk[low:end])  # noqa: S324
            if end > len(chunk):
                self.open.append((len(self.rows), at + low, at + end, row[7]))
        self.rows.append(row)

    def close(self) -> pa.RecordBatch:
        waiting = {row for row, _, high, _ in self.open if high > self.total}
        for i, row in enumerate(self.rows):
            row[4] = self.total
            if not isinstance(row[7], str):
                row[7] = None if i in waiting else row[7].hexdigest()
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_KINDS)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, first = None, False
    for batch in batches:
        for file, block, chunk in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").cast(pa.binary()), strict=True):
            if split is None or (file, block) != (split.file, split.block):
                if split is not None:
                    yield split.close()
                    yield _empty_split(split)
                split, first = _Split(file, block), block == 0
            split.add(chunk.as_py(), first)
            first = False
    if split is not None:
        yield split.close()
        yield _empty_split(split)


def _empty_split(split: _Split) -> pa.RecordBatch:
    """A row that says how long the split is, whether or not it has candidates."""
    row = [split.file, split.block, None, None, split.total, *[None] * 7]
    return pa.record_batch([pa.array([v], t) for v, t in zip(row, _KINDS, strict=True)], _NAMES)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate of a split: where its chain leaves the split; -1 where it breaks."""
    table = pa.Table.from_batches(list(batches)).sort_by("at")
    at, after, total = (table.column(c).to_pylist() for c in ("at", "next", "total"))
    leaves: dict[int, int] = {}
    for low, to, end in reversed(list(zip(at, after, total, strict=True))):
        leaves[low] = to if to >= end else leaves.get(to, -1)
    yield pa.record_batch(
        [*(table.column(c).combine_chunks() for c in ("file", "block", "at")), pa.array([leaves[x] for x in at], pa.int64())],
        ["file", "block", "at", "leaves"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of a split that its entries reach."""
    table = pa.Table.from_batches(list(batches)).sort_by("at")
    reached: set[int] = set()
    keep = []
    for low, to, entry in zip(table.column("at").to_pylist(), table.column("next").to_pylist(), table.column("entry").to_pylist(), strict=True):
        real = entry or low in reached
        keep.append(real)
        if real:
            reached.add(to)
    yield from table.filter(pa.array(keep, pa.bool_())).to_batches()


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each real record."""
    chunks = _chunks(spark, folder)
    session_for(chunks)
    found = cut(chunks.mapInArrow(_candidates, _FOUND))
    sizes = found.where("at is null").select("file", "block", "total")
    base = sizes.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = cut(base.select("file", "block", "base"))
    records = found.where("at is not null")
    leaves = records.select("file", "block", "at", "next", "total").groupBy("file", "block").applyInArrow(_exits, "file string, block long, at long, leaves long")
    jumps = cut(
        leaves.join(base, ["file", "block"])
        .select("file", (F.col("at") + F.col("base")).alias("from"), F.when(F.col("leaves") >= 0, F.col("leaves") + F.col("base")).alias("to"))
    )
    # only offsets at which some chain enters a split matter: as many as splits, or little more
    entered = jumps.where("to is not null").select("file", F.col("to").alias("from")).unionAll(base.select("file", F.lit(0).cast("long").alias("from"))).distinct()
    pointers = cut(jumps.join(entered, ["file", "from"]))
    reached = cut(base.select("file", F.lit(0).cast("long").alias("from")).distinct())
    while True:
        more = cut(pointers.join(reached, ["file", "from"], "left_semi").select("file", F.col("to").alias("from")).where("from is not null").distinct().join(reached, ["file", "from"], "left_anti"))
        if more.isEmpty():
            break
        reached = cut(reached.unionAll(more))
        ahead = pointers.select("file", F.col("from").alias("to"), F.col("to").alias("ahead"))
        pointers = cut(pointers.join(ahead, ["file", "to"], "left").select("file", "from", F.col("ahead").alias("to")))
    entries = reached.join(base, "file").where("from >= base")
    entries = entries.groupBy("file", "from").agg(F.max_by("block", "base").alias("block"), F.max("base").alias("base"))
    entries = entries.select("file", "block", (F.col("from") - F.col("base")).alias("at"), F.lit(True).alias("entry"))
    marked = records.join(entries, ["file", "block", "at"], "left")
    real = cut(marked.groupBy("file", "block").applyInArrow(_walk, f"{_FOUND}, entry boolean"))
    wanted = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    cut_off = real.where("payload_digest is null")
    if cut_off.isEmpty():
        return real.select(*wanted)
    return real.where("payload_digest is not null").select(*wanted).unionAll(_joined(chunks, cut_off, base).select(*wanted))


_PARTS = "file string, block long, at long, bytes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their magic and offset in the split."""
    key, total = None, 0
    for batch in batches:
        at = []
        values = []
        for file, block, chunk in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").cast(pa.binary()), strict=True):
            value = chunk.as_py()
            if key != (file, block):
                key, total = (file, block), 0
                value = value if block == 0 else MAGIC.encode() + value
            else:
                value = MAGIC.encode() + value
            at.append(total)
            values.append(value)
            total += len(value)
        yield pa.record_batch([batch.column("file"), batch.column("block"), pa.array(at, pa.int64()), pa.array(values, pa.binary())], ["file", "block", "at", "bytes"])


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).sort_by("from")
    one = table.slice(0, 1)
    digest = hashlib.sha1()  # noqa: S324
    low, high = one.column("low")[0].as_py(), one.column("high")[0].as_py()
    for at, part in zip(table.column("from").to_pylist(), table.column("bytes"), strict=True):
        digest.update(part.as_py()[max(0, low - at) : max(0, high - at)])
    columns = [*(one.column(c).combine_chunks() for c in ("page_id", "payload_bytes")), pa.array([digest.hexdigest()]), *(one.column(c).combine_chunks() for c in ("record_type", "refers_to"))]
    yield pa.record_batch(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _joined(chunks: DataFrame, records: DataFrame, base: DataFrame) -> DataFrame:
    """Records whose payload other splits hold on: digests over the chunks that they overlap."""
    spans = records.join(base, ["file", "block"]).select(
        "file", (F.col("payload_at") + F.col("base")).alias("low"), (F.col("payload_to") + F.col("base")).alias("high"), "page_id", "payload_bytes", "record_type", "refers_to"
    )
    parts = chunks.mapInArrow(_pieces, _PARTS).join(base, ["file", "block"]).select("file", (F.col("at") + F.col("base")).alias("from"), "bytes")
    over = parts.join(spans, "file").where((F.col("from") < F.col("high")) & (F.col("from") + F.length("bytes") > F.col("low")))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return over.groupBy("file", "low").applyInArrow(_digest_parts, schema)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
top AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to
FROM p LEFT JOIN top ON p.html = top.html AND n >= 1000
"""
