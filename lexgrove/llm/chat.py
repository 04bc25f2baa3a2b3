"""Roles of transcript turns by a hidden Markov model, and their canonical rendering.

A turn's lines give its features: a speaker marker at its start ("User:", "### Assistant", "Q."
and the like), its number of lines, its length, a question, and its place at the start of the
conversation. Hidden states are the roles; the model is trained from rows with known roles, by
counts over all of them with add-one smoothing. Viterbi then recovers the roles of each
conversation from the features alone.

Turns are sorted over ranges of (conv_id, turn), so a conversation of any length spreads over
many tasks; texts are shuffled this once. Best-path scores compose: each task reduces its part of a conversation to a
matrix of best scores between the states before and at its end; the matrices of a conversation
that several tasks share, one a task, are chained, and each task then traces its own part
between the states so fixed. The result equals one Viterbi pass over the whole conversation.
parsed does the same for whole transcripts in one text, with lines as steps: a turn begins where
the role changes or a marker stands.

Defined results: a null or empty text has the features of an empty turn; turns with a null turn
number come first; a null conv_id is a conversation of its own; equal turn numbers are ordered by
text. Rows whose role is null or empty don't train. Without any known role the output has a null role.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut_in_order, session_for, shuffle_partitions

#: Markers of speakers, by the role that they usually stand for.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "prompt", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "model", "agent"),
}
_NAMES = {name: i + 1 for i, names in enumerate(MARKERS.values()) for name in names}
_MARK = re.compile(r"\s*(?:<\|(?:im_start\|>)?|\[|#+\s*|\*\*)?\s*(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\s*(?:\|>|\]|\*\*)?\s*(?:[:.>]|\n)\s*", re.IGNORECASE)
FEATURES = ("marker", "lines", "length", "question", "start")


def features(text: str | None, first: bool) -> tuple[int, ...]:
    text = text or ""
    found = _MARK.match(text)
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        _NAMES[found[1].lower()] if found else 0,
        min(len(lines), 6),
        min(len(text).bit_length(), 16),
        int(text.rstrip().endswith("?")) + 2 * int("?" in text),
        int(first),
    )


def canonical(text: str | None, role: str | None) -> str:
    """The turn without its marker, between fixed marks."""
    text = text or ""
    found = _MARK.match(text)
    body = text[found.end() :] if found else text
    return f"<|{role or 'unknown'}|>\n{body.strip()}\n<|end|>\n"


_COLUMNS = "conv_id long, turn long, role string, text string"


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All features but the place at the start, which needs the rows in order."""
    for rows in batches:
        found = [features(t if isinstance(t, str) else None, False)[:-1] for t in rows["text"]]
        yield rows.assign(features=[" ".join(map(str, x)) for x in found])


class Chain:
    """Log scores: start and step by role, and of each feature's values by role."""

    def __init__(self, roles: list[str], start: dict, step: dict, seen: dict) -> None:
        self.roles = roles
        n = len(roles)
        place = {r: i for i, r in enumerate(roles)}
        self.start, self.step = np.ones(n), np.ones((n, n))
        for role, k in start.items():
            self.start[place[role]] += k
        for (a, b), k in step.items():
            self.step[place[a], place[b]] += k
        self.start = np.log(self.start / self.start.sum())
        self.step = np.log(self.step / self.step.sum(1, keepdims=True))
        values = [{0} | {int(f.split()[i]) for _, f in seen} for i in range(len(FEATURES))]
        self.emit = [{v: np.ones(n) for v in own} for own in values]
        for (role, f), k in seen.items():
            for own, v in zip(self.emit, map(int, f.split()), strict=True):
                own[v][place[role]] += k
        for own in self.emit:
            total = sum(own.values())
            for v in own:
                own[v] = np.log(own[v] / total)

    def score(self, text: str) -> np.ndarray:
        flat = np.zeros(len(self.roles))
        return sum((own.get(int(v), flat) for own, v in zip(self.emit, text.split(), strict=True)), flat)


def fit(rows: DataFrame) -> Chain | None:
    """Counts over all rows (conv_id, turn, role, features) that have a role."""
    known = rows.where("role is not null and role <> ''")
    seen = {(r[0], r[1]): r[2] for r in known.groupBy("role", "features").count().collect()}
    if not seen:
        return None
    ahead = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = known.select("conv_id", "turn", "role").join(ahead, ["conv_id", "turn"])
    step = {(r[0], r[1]): r[2] for r in pairs.groupBy("role", "next").count().collect()}
    start = {r[0]: r[1] for r in known.where(F.col("features").endswith("1")).groupBy("role").count().collect()}
    return Chain(sorted({r for r, _ in seen}), start, step, seen)


def _segments(batches: Iterator[pa.RecordBatch], least: dict, other: str = "text") -> Iterator[tuple[object, list]]:
    """Runs of one conversation in a task: its id and rows (turn, other, features), with the place at the start.

    least: the smallest turn of each conversation that several tasks share.
    """

    def filled(conv: object, rows: list) -> list:
        low = least[conv] if conv in least else min((t for t, _, _ in rows if t is not None), default=None)
        return [(turn, value, f"{found} {int(turn is None or turn == low)}") for turn, value, found in rows]

    key, rows, begun = None, [], False
    for batch in batches:
        for conv, turn, value, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", other, "features")), strict=True):
            if begun and conv != key:
                yield key, filled(key, rows)
                rows = []
            key, begun = conv, True
            rows.append((turn, value, found))
    if begun:
        yield key, filled(key, rows)


def _trainable(least: dict):
    """(conv_id, turn, role, features) without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in _segments(batches, least, "role"):
            turn, role, found = zip(*rows, strict=True)
            yield pa.record_batch([pa.array([conv] * len(rows), pa.int64()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(found, pa.string())], ["conv_id", "turn", "role", "features"])

    return run


def _reduce(chain, least: dict):  # noqa: ANN001
    """The matrices of a task's first and last conversation; only those may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last = [], None, None

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and not task:
                    task.append(batch.column("task")[0].as_py())
                yield batch

        for conv, rows in _segments(watched(), least):
            one = (conv, _matrix(chain.value, [f for _, _, f in rows]))
            first, last = first or one, one
        ends = [x for x in (first, last) if x is not None]
        ends = ends[:1] if len(ends) == 2 and ends[0] is ends[1] else ends
        yield pa.record_batch([pa.array([c for c, _ in ends], pa.int64()), pa.array(task * len(ends), pa.int32()), pa.array([m.tobytes() for _, m in ends], pa.binary())], ["conv_id", "task", "matrix"])

    return run


def _matrix(chain: Chain, found: list[str]) -> np.ndarray:
    """Best scores (1 + roles, roles): row 0 from the start of a conversation, the others from each state before."""
    best = np.vstack((chain.start, chain.step)) + chain.score(found[0])
    for f in found[1:]:
        best = (best[:, :, None] + chain.step[None]).max(1) + chain.score(f)
    return best


def _chained(count: int):
    """Entry and exit state of each task's part of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("task")
        matrices = [np.frombuffer(m.as_py()).reshape(-1, count) for m in table.column("matrix")]
        best, back = matrices[0][0], []
        for m in matrices[1:]:
            through = best[:, None] + m[1:]
            back.append(through.argmax(0))
            best = through.max(0)
        exits = [int(best.argmax())]
        for b in reversed(back):
            exits.append(int(b[exits[-1]]))
        exits.reverse()
        yield pa.record_batch([table.column("conv_id").combine_chunks(), table.column("task").combine_chunks(), pa.array([-1, *exits[:-1]], pa.int32()), pa.array(exits, pa.int32())], ["conv_id", "task", "entry", "exit"])

    return run


def _trace(chain: Chain, found: list[str], entry: int, out: int | None) -> list[int]:
    best = (chain.start if entry < 0 else chain.step[entry]) + chain.score(found[0])
    back = []
    for f in found[1:]:
        through = best[:, None] + chain.step
        back.append(through.argmax(0))
        best = through.max(0) + chain.score(f)
    states = [int(best.argmax()) if out is None else out]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _decode(chain, least: dict, fixed: dict):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and not task:
                    task.append(batch.column("task")[0].as_py())
                yield batch

        out: list[tuple] = []
        for conv, rows in _segments(watched(), least):
            entry, end = fixed.get((task[0], conv), (-1, None))
            states = _trace(chain.value, [f for _, _, f in rows], entry, end)
            out += [(conv, turn, role := chain.value.roles[s], canonical(text, role)) for (turn, text, _), s in zip(rows, states, strict=True)]
            if len(out) > 5000:
                yield _turns(out)
                out = []
        yield _turns(out)

    return run


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["conv_id", "turn", "role", "rendered"])


def roles(turns: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, role, rendered) of each row of turns (conv_id, turn, text); role as recovered.

    train: rows with roles to learn from; turns itself if it has roles and none is given.
    """
    spark = session_for(turns)
    rows, least = _arranged(turns)
    known = (rows, least) if train is None else _arranged(train)
    chain = fit(known[0].select("conv_id", "turn", "role", "features").mapInArrow(_trainable(known[1]), "conv_id long, turn long, role string, features string"))
    if chain is None:
        return rows.select("conv_id", "turn", "text").mapInPandas(_without_roles, _TURNS)
    shared = spark.sparkContext.broadcast(chain)
    ends = rows.mapInArrow(_reduce(shared, least), "conv_id long, task int, matrix binary")
    # two rows a task at most
    fixed: dict = {}
    for r in ends.groupBy("conv_id").applyInArrow(_chained(len(chain.roles)), "conv_id long, task int, entry int, exit int").collect():
        fixed[r["task"], r["conv_id"]] = r["entry"], r["exit"]
    return rows.mapInArrow(_decode(shared, least, fixed), _TURNS)


_TURNS = "conv_id long, turn long, role string, rendered string"


def _arranged(turns: DataFrame) -> tuple[DataFrame, dict]:
    """Turns with features, sorted over ranges, and the smallest turn of conversations that tasks share."""
    spark = session_for(turns)
    role = F.col("role") if "role" in turns.columns else F.lit(None).cast("string")
    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.col("text"))
    rows = cut_in_order(
        slim.mapInPandas(_featured, f"{_COLUMNS}, features string")
        .repartitionByRange(shuffle_partitions(spark), "conv_id", "turn", "text")
        .sortWithinPartitions("conv_id", "turn", "text")
        .withColumn("task", F.spark_partition_id())
    )
    shared = rows.groupBy("conv_id").agg(F.min("turn").alias("least"), F.min("task").alias("a"), F.max("task").alias("b")).where("a < b")
    # fewer rows than tasks, as ranges are sorted
    return rows, {r["conv_id"]: r["least"] for r in shared.collect()}


def _without_roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.assign(role=None, rendered=[canonical(t if isinstance(t, str) else None, None) for t in rows["text"]])[["conv_id", "turn", "role", "rendered"]]


# -- whole transcripts ------------------------------------------------------------------------------


def _line_features(text: str) -> list[str]:
    """Lines don't tell the start of a transcript: the model's first state does."""
    return [" ".join(map(str, features(line + "\n", False))) for line in text.split("\n")]


def _line_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(role, features, n, inside): counts of a batch's lines, and of steps from line to line of one turn."""
    for rows in batches:
        seen: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        for role, text in zip(rows["role"], rows["text"], strict=True):
            for i, found in enumerate(_line_features(text if isinstance(text, str) else "")):
                own = seen[role, found]
                own[0] += 1
                own[1] += bool(i)
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["role", "features", "n", "inside"])


def fit_lines(train: DataFrame) -> Chain | None:
    """The model of lines from turns (conv_id, turn, role, text) with known roles."""
    known = train.where("role is not null and role <> ''").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    least = known.groupBy("conv_id").agg(F.min("turn").alias("_least")).select(F.col("conv_id").alias("_conv"), "_least")
    slim = known.select("conv_id", "turn", "role")
    first = slim.join(least, F.col("conv_id") == F.col("_conv")).where("turn = _least").groupBy("role").count()
    lines = known.select("role", "text").mapInPandas(_line_counts, "role string, features string, n long, inside long")
    counted = lines.groupBy("role", "features").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).collect()
    if not counted:
        return None
    seen = {(r["role"], r["features"]): r["n"] for r in counted}
    step: dict[tuple[str, str], int] = defaultdict(int)
    for r in counted:
        step[r["role"], r["role"]] += r["inside"]
    ahead = slim.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    for a, b, n in slim.join(ahead, ["conv_id", "turn"]).groupBy("role", "next").count().collect():
        step[a, b] += n
    return Chain(sorted({r for r, _ in seen}), {r[0]: r[1] for r in first.collect()}, step, seen)


def turns_of(chain: Chain, text: str) -> list[tuple[str, str]]:
    """Roles and texts of a transcript's turns."""
    lines, found = text.split("\n"), _line_features(text)
    out: list[tuple[str, list[str]]] = []
    for line, mark, state in zip(lines, found, _trace(chain, found, -1, None), strict=True):
        role = chain.roles[state]
        if not out or out[-1][0] != role or not mark.startswith("0 "):
            out.append((role, []))
        out[-1][1].append(line)
    return [(role, "\n".join(own)) for role, own in out]


def parsed(transcripts: DataFrame, train: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered) of the turns in each transcript (conv_id, text), numbered from 0.

    train: turns with known roles (conv_id, turn, role, text). A null or empty text has no turns;
    rows that repeat a conv_id are transcripts each. Without any known role a transcript is one turn.
    """
    spark = session_for(transcripts)
    shared = spark.sparkContext.broadcast(fit_lines(train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    own = turns_of(shared.value, text) if shared.value else [(None, text)]
                    yield _turns([(conv, i, role, canonical(part, role)) for i, (role, part) in enumerate(own)])

    return transcripts.select(F.col("conv_id").cast("long"), "text").mapInArrow(run, _TURNS)
