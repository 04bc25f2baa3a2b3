"""Near-duplicate documents by SetSketch registers over five-word shingles.

1. Each document's shingle set becomes a SetSketch: register i holds the exponentially
   spaced level of the least of the set's exponential variates under hash i, cut off at 0 and
   at the top level. Registers merge by their maximum and agree with a probability that grows
   with the Jaccard similarity. Equal sets share a digest; one document, the smallest id,
   stands for each class from here on.
2. Bands of registers are hashed to buckets. Each bucket's smallest id leads it, and pairs
   (leader, member) are candidates: as many as rows, never all pairs of a bucket.
3. Both sketches of a pair give the maximum-likelihood estimate of its Jaccard similarity,
   jointly from the counts of larger, smaller and equal registers and the exact set sizes.
   Pairs far below the threshold go.
4. Each member's best pair is confirmed on both full sets, and components are formed by
   pointer jumping and contraction.
5. Rest: in buckets that still hold several components, every pair of members of different
   components is verified, the members outside the largest component against all, in blocks
   of bounded size, each pair in the first bucket that it shares: on full sets, by postings of
   a block's shingles. A link found joins its components in the block at once, so a block
   gives fewer links than it has rows, however many pairs are alike. Sets of more than LONG
   shingles stay out of blocks; there the sketch, and a finer one of FINE registers, find the
   pairs that are then confirmed by joins, as are the candidates of buckets of two. So no
   pair that shares a bucket is lost, and pairs within a component are not looked at.

Defined results: a document without words (or a null text) has an empty set, is linked with
nothing and kept. A null doc_id is linked with nothing; its component is null and it is
kept. Rows that repeat a doc_id are one node. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut, folded, maybe_in, session_for, unfolded, without
from lexgrove.llm.textcols import U, mix, shingles, slices, text_bytes

REGISTERS = 128
BASE = 1.001
RATE = 20.0
TOP = 65534
BANDS = 25
ROWS = 5
#: Registers of a band below a threshold of 85 percent; there are as many bands as fit.
LOW_ROWS = 4
#: Estimates this far below the threshold are not verified: five standard errors at 0.85 (more at lower ones, see limits).
MARGIN = 0.16
#: Registers and margin (over four standard errors) of the finer sketches.
FINE = 1024
FINE_MARGIN = 0.047
#: Members of a bucket that meet as many others in one group.
BLOCK = 1024
#: Shingles of a set that blocks hold in full.
LONG = 4096


def limits(percent: int) -> tuple[int, float, float]:
    """Registers of a band, and the least estimates by sketches and by finer ones, for a threshold.

    A pair at the threshold shares no band once in 2 million at 85 percent, once in 20 million at 80.
    """
    j = percent / 100
    error = (j * (1 - j)) ** 0.5
    return ROWS if percent >= 85 else LOW_ROWS, j - max(MARGIN, 5 * error / REGISTERS**0.5), j - max(FINE_MARGIN, 4.1 * error / FINE**0.5)


_rng = np.random.default_rng(1618)
_MULTIPLY = _rng.integers(1, 2**63, FINE, dtype=np.uint64) << U(1) | U(1)
_ADD = _rng.integers(1, 2**63, FINE, dtype=np.uint64)


def registers(sets: list[np.ndarray], number: int = REGISTERS) -> np.ndarray:
    """SetSketch registers, one row of uint16 for each non-empty set of 64-bit hashes."""
    if not sets:
        return np.zeros((0, number), np.uint16)
    out = np.empty((len(sets), number), np.uint16)
    starts = np.cumsum([0, *map(len, sets)])
    every = np.concatenate(sets)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):  # runs that stay in the processor's cache
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + 32_768, "right")) - 1)
            part, bounds = every[starts[at] : starts[to]], starts[at:to] - starts[at]
            hashed = np.empty_like(part)
            for i in range(number):
                np.multiply(part, _MULTIPLY[i], out=hashed)
                np.add(hashed, _ADD[i], out=hashed)
                least = (np.minimum.reduceat(hashed, bounds).astype(np.float64) + 0.5) * 2.0**-64
                level = np.floor(1 - np.log(-np.log1p(-least) / RATE) / np.log(BASE))
                out[at:to, i] = np.clip(level, 0, TOP + 1)
            at = to
    return out


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(one, two)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of paired sketches with known set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    high = np.minimum(u / v, v / u)
    low = np.zeros_like(high)

    def apart(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = apart(u - v * j), apart(v - u * j)
        tiny = 1e-300
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    golden = (5**0.5 - 1) / 2
    for _ in range(28):  # the likelihood has one peak
        c, d = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(c) > likelihood(d)
        high, low = np.where(left, d, high), np.where(left, low, c)
    return (high + low) / 2


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingles(*text_bytes(part.column("text")))
            size = np.array([len(x) for x in sets], np.int64)
            some = np.flatnonzero(size)
            sketch = np.zeros((len(sets), REGISTERS), np.uint16)
            sketch[some] = registers([sets[i] for i in some])
            digest = np.zeros((len(sets), 2), np.uint64)
            with np.errstate(over="ignore"):
                for i in some:
                    one = mix(sets[i])
                    digest[i] = one.sum(dtype=np.uint64), mix(one + U(12345)).sum(dtype=np.uint64)
            packed = [sketch[i].tobytes() if size[i] else None for i in range(len(sets))]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(size), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.array(packed, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "sketch"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch): set size, digest of the set, registers as bytes."""
    session_for(docs)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, _SIGNED)


def _unpack(column: pa.Array, number: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, number)


def _keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket of each band."""
    bands = REGISTERS // rows
    levels = sketch[:, : bands * rows].astype(np.uint64).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << U(40), levels.shape[:2]).copy()
    for k in range(rows):
        key = mix(key + levels[:, :, k])
    return key.view(np.int64)


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(_unpack(batch.column("sketch")), rows)
            node = np.repeat(batch.column("node").to_numpy(), key.shape[1])
            yield pa.record_batch([pa.array(key.ravel()), pa.array(node)], ["bucket", "node"])

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each document, or the finer sketch of a long one."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingles(*text_bytes(part.column("text")))
            some = [i for i, x in enumerate(sets) if len(x)]
            packed = [(sets[i] if len(sets[i]) <= LONG else registers([sets[i]], FINE)).tobytes() for i in some]
            yield pa.record_batch([part.column("doc_id").take(pa.array(some, pa.int64())), pa.array(packed, pa.binary())], ["node", "fine"])


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = [batch.column(c).to_numpy().astype(float) for c in ("size_a", "size_b")]
                found = estimate(_unpack(batch.column("sketch_a")), _unpack(batch.column("sketch_b")), *size)
                keep = pa.array(found >= least)
                yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(found), batch.column("members")], ["a", "b", "likely", "members"]).filter(keep)

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingles(*text_bytes(part.column("text")))
            yield pa.record_batch([part.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "items"])


def _near(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    short, long = (one, two) if len(one) < len(two) else (two, one)
    if 100 * len(short) < percent * len(long) or not len(short):
        return False
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            for a, one, two in zip(batch.column("a").to_pylist(), batch.column("items_a"), batch.column("items_b"), strict=True):
                if a != last:
                    last, left = a, np.frombuffer(one.as_py(), np.uint64)
                keep.append(_near(left, np.frombuffer(two.as_py(), np.uint64), percent))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = maybe_in(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", ids, "id")
    sets = rows.join(ids, rows["doc_id"] == ids["id"], "left_semi").select("doc_id", "text").mapInArrow(_full_sets, "node long, items binary")
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    return two.select("a", "b", "items_a", "items_b").mapInArrow(_confirm(percent), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the smallest node it reaches.

    Each node points at its smallest neighbour, pointers are doubled until they rest, and
    links are contracted to the nodes pointed at; each round at least halves the nodes that
    have links left.
    """
    links = cut(links.select("a", "b").where("a <> b"))
    named = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
        while True:
            ahead = points.select(F.col("node").alias("component"), F.col("component").alias("ahead"))
            points = cut(points.join(ahead, "component").select("node", F.col("ahead").alias("component"), (F.col("ahead") != F.col("component")).alias("moved")))
            if points.where("moved").isEmpty():
                break
            points = points.drop("moved")
        points = points.select("node", "component")
        named = points if named is None else _onto(named, "component", points).unionAll(points.join(named, "node", "left_anti"))
        named = cut(named.select("node", "component"))
        links = cut(_onto(_onto(links, "a", points), "b", points).where("a <> b").distinct())
    return named if named is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _onto(rows: DataFrame, column: str, points: DataFrame) -> DataFrame:
    to = points.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    joined = rows.join(to, rows[column] == to["_node"], "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def _merged(known: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) with more links (a, b) between their nodes or new ones."""
    contracted = cut(_onto(_onto(more.select("a", "b"), "a", known), "b", known).where("a <> b").distinct())
    if contracted.isEmpty():
        return known
    moved = components(contracted)
    return cut(_onto(known, "component", moved).select("node", "component").unionAll(moved.join(known, "node", "left_anti")))


def _across(percent: int):
    """Links of different components in one block of a bucket: outsiders against residents.

    A pair is looked at only in the first bucket that its two members share. Links that full
    sets confirm are sure; a pair of which one is long is only likely.
    """
    rows, least, finer = limits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("node")
        node, label, size, bucket = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles", "bucket"))
        label = label.copy()
        outside, resident, asked = (table.column(c).to_numpy() for c in ("outsider", "resident", "asked"))
        sketch = _unpack(table.column("sketch").combine_chunks())
        packed = table.column("fine").to_pylist()
        keys = _keys(sketch, rows)
        band = int((keys[0] == bucket[0]).argmax())
        there = np.flatnonzero(resident)
        found: list[tuple[int, int, bool]] = []

        def items(i: int, kind: type = np.uint64) -> np.ndarray:
            return np.frombuffer(packed[i], kind)

        def fine(i: int) -> np.ndarray:
            return items(i, np.uint16)[None] if size[i] > LONG else registers([items(i)], FINE)

        # postings of the short residents' shingles: an outsider's intersections with all of them at once
        short = there[size[there] <= LONG]
        every, owner = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(items, short)]), return_inverse=True)
        holder = np.repeat(np.arange(len(short)), size[short])[np.argsort(owner, kind="stable")]
        many = np.bincount(owner, minlength=len(every))
        starts = np.cumsum(many) - many
        for i in np.flatnonzero(asked):
            near = np.zeros(0, np.int64)
            if size[i] <= LONG and len(every):
                own = items(i)
                at = np.minimum(np.searchsorted(every, own), len(every) - 1)
                at = at[every[at] == own]
                n = many[at]
                both = np.bincount(holder[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(short))
                near = short[100 * both >= percent * (size[short] + size[i] - both)]
            maybe = there[(size[there] > LONG) | (size[i] > LONG)]
            maybe = maybe[100 * np.minimum(size[maybe], size[i]) >= percent * np.maximum(size[maybe], size[i])]
            if len(maybe):
                likely = estimate(np.broadcast_to(sketch[i], (len(maybe), REGISTERS)), sketch[maybe], np.full(len(maybe), float(size[i])), size[maybe].astype(float))
                maybe = maybe[likely >= least]
            for j in (*near.tolist(), *maybe.tolist()):
                seen = not (node[j] > node[i] or not outside[j]) or (keys[j, :band] == keys[i, :band]).any()
                if label[j] == label[i] or seen:
                    continue
                pair = min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))
                if max(size[i], size[j]) <= LONG:
                    found.append((*pair, True))
                    label[label == label[j]] = label[i]
                elif estimate(fine(i), fine(j), size[i : i + 1].astype(float), size[j : j + 1].astype(float))[0] >= finer:
                    found.append((*pair, False))
        yield pa.record_batch([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "sure"])

    return run


def links(docs: DataFrame, nodes: DataFrame, percent: int = 85, blocks: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between nodes (node, n_shingles, sketch), and the components."""
    rows, least, _ = limits(percent)
    buckets = cut(nodes.select("node", "sketch").mapInArrow(_bands(rows), "bucket long, node long"))
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = cut(buckets.join(leaders, "bucket").select("bucket", "a", F.col("node").alias("b"), "members"))
    side = nodes.select("node", "n_shingles", "sketch")
    left, right = (side.select(F.col("node").alias(c), F.col("n_shingles").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    pairs = shared.where("a <> b").groupBy("a", "b").agg(F.min("members").alias("members"))
    candidates = cut(pairs.join(right, "b").join(left, "a").mapInArrow(_likely(least), "a long, b long, likely double, members long"))
    best = candidates.groupBy("b").agg(F.max_by("a", F.struct("likely", -F.col("a"))).alias("a")).select("a", "b")
    best = cut(best)
    sure = cut(confirmed(docs, best, percent))
    first = components(sure)

    # what may still join two components
    label = first.select(F.col("node").alias("b"), "component")
    members = shared.where("members > 2").join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    by_component = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_component.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.max("n").alias("most"))
    number = lambda n: F.ceil(n / blocks).cast("int")
    mixed = mixed.where("kinds > 1").select("bucket", "largest", number(F.col("all")).alias("blocks"), number(F.col("all") - F.col("most")).alias("turns"))
    open_rows = members.select("bucket", F.col("b").alias("node"), "component").join(mixed, "bucket")
    hashed = F.xxhash64("node")
    open_rows = open_rows.withColumn("outsider", F.col("component") != F.col("largest")).withColumn("home", F.pmod(hashed, F.col("blocks")).cast("int")).withColumn("own", F.pmod(hashed, F.col("turns")).cast("int"))
    # groups of blocks x turns: a member is resident in all of its home block's, an outsider asks in all of its own turn's
    number_of = lambda n: F.sequence(F.lit(0), n - 1)
    here = F.transform(number_of(F.col("turns")), lambda t: F.struct(F.col("home").alias("block"), t.alias("turn")))
    asks = F.transform(number_of(F.col("blocks")), lambda k: F.struct(k.alias("block"), F.col("own").alias("turn")))
    dealt = open_rows.withColumn("to", F.explode(F.when(F.col("outsider"), F.array_union(here, asks)).otherwise(here)))
    at_home, in_turn = F.col("to.block") == F.col("home"), F.col("outsider") & (F.col("to.turn") == F.col("own"))
    dealt = cut(dealt.select("bucket", F.col("to.block").alias("block"), F.col("to.turn").alias("turn"), "node", "component", "outsider", at_home.alias("resident"), in_turn.alias("asked")))
    ids = dealt.select("node").distinct()
    texts = maybe_in(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", ids, "node")
    finer = texts.join(ids, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text").mapInArrow(_fine, "node long, fine binary").dropDuplicates(["node"])
    dealt = dealt.join(side.join(finer, "node"), "node")
    dealt = dealt.select("bucket", "block", "turn", "node", "component", "n_shingles", "outsider", "resident", "asked", "sketch", "fine")
    across = cut(dealt.groupBy("bucket", "block", "turn").applyInArrow(_across(percent), "a long, b long, sure boolean"))
    known = _merged(first, across.where("sure"))
    sure = sure.unionAll(across.where("sure").select("a", "b"))
    rest = candidates.where("members = 2").select("a", "b").unionAll(across.where("not sure").select("a", "b")).distinct().withColumn("x", F.col("a")).withColumn("y", F.col("b"))
    rest = _onto(_onto(rest, "x", known), "y", known)
    rest = cut(rest.where("x <> y").select("a", "b").join(best, ["a", "b"], "left_anti"))
    more = cut(confirmed(docs, rest, percent))
    return sure.unionAll(more), _merged(known, more)


def near_duplicates(docs: DataFrame, percent: int = 85, blocks: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    session_for(docs)
    signed = cut(sketches(docs))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))
    of = classes.select(F.col("node").alias("doc_id"), "d1", "d2")
    nodes = cut(usable.join(of, ["doc_id", "d1", "d2"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "sketch").dropDuplicates(["node"]))
    _, found = links(docs, nodes, percent, blocks)
    named = _onto(classes.withColumn("component", F.col("node")), "component", found).select("d1", "d2", F.col("component").alias("_component"))
    joined = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents, all columns, that near_duplicates keeps; of rows equal in all columns one."""
    found = cut(near_duplicates(docs, percent))
    rows = folded(docs, "doc_id", "text")
    kept = without(rows, "doc_id", found.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "_id")
    again = cut(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    if not again.isEmpty():
        more = maybe_in(kept, "doc_id", again, "_id").join(again, F.col("doc_id") == F.col("_id"), "left_semi")
        kept = without(kept, "doc_id", again, "_id").unionByName(more.dropDuplicates())
    return unfolded(kept, docs.columns, "doc_id", "text")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
