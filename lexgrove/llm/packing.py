"""Pack documents into sequences of at most 2048 tokens by bulk-synchronous best fit.

A document is its token ids and one end id. One that is longer than a sequence is cut into
full pieces; only its first piece may be shorter. Pieces are sorted by length over ranges
of (length, doc_id, piece), so a length that many pieces have is spread over many tasks; a
piece's rank within its length is the count of its task's earlier rows and of the tasks
before. Best fit then runs in rounds, from the longest length down: in a round each open
gap that is the smallest to hold the length (its successor in the sorted gaps) takes one
piece, pieces and gaps of equal size meet by rank, and the gaps shrink and are sorted in
again; pieces that found no gap open sequences. Pieces of one length are alike, as are gaps
of one size, so a round handles each as one run of ranks; there are at most 2048 lengths,
whatever the input. The runs are sent to the tasks, which look up each piece by its rank.

Defined results: a null text is empty and packs as its end id alone; rows that repeat a
doc_id are packed each. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut, cut_in_order, session_for, shuffle_partitions
from lexgrove.llm.textcols import slices

LENGTH = 2048
END_ID = 0

#: Letters, digits and marks whose Unicode classes have not changed, and the public
#: pre-tokenization pattern of byte-level BPE vocabularies.
_MARKS = "!-~¡-ɏ"
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these alone are cut to pre-tokens alike by both encoders.
_PLAIN = re.compile(rf"[ \n{_MARKS}]*")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; equal to the tokenizer's own.

    If the tokenizer is plain byte-level BPE with ids in the order of merges, texts of common
    marks go to a faster encoder of the same vocabulary; all others to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast, self.special = None, ()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, merges = spec["pre_tokenizer"] or {}, spec["model"].get("merges", [])
        vocabulary = spec["model"].get("vocab", {})
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        if spec["normalizer"] is None and before == before | {"type": "ByteLevel", "add_prefix_space": False} and before.get("use_regex", True):
            pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
            if all(vocabulary[m] == 256 + i for i, m in enumerate(pairs)):
                self._make_fast({k: v for k, v in vocabulary.items() if k not in self.special})

    def _make_fast(self, vocabulary: dict[str, int]) -> None:
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _direct(self, text: str) -> bool:
        return self.fast is not None and _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = [np.array(self.fast.encode_ordinary(t), "<u4").tobytes() if self._direct(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for a worker process, whatever number of tasks it runs."""
    return Encoder(path)


def _cut_pieces(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    for piece in range(-(-n // length)):
                        to = n - (-(-n // length) - 1 - piece) * length
                        rows.append((doc, piece, at, to - at, zlib.crc32(ids[at * 4 : to * 4])))
                        at = to
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_runs(counts: dict[int, int], length: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece length its runs: first rank, first sequence of the run, offset there.

    The k-th piece of a run goes to the k-th sequence of the run.
    """
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # size -> runs of sequences [first, number]
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequences = 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fit = next((g for g in range(size, length) if gaps.get(g)), None)
            if fit is None:
                fit = length
                # a sequence takes all the equal pieces that best fit would put there, one a round
                new = -(-left // (length // size))
                gaps[length].append([sequences, new])
                sequences += new
            own = gaps[fit]
            first, number = own.pop()
            taken = min(number, left)
            if taken < number:
                own.append([first + taken, number - taken])
            runs[size].append((rank, first, length - fit))
            gaps[fit - size].append([first, taken])
            rank, left = rank + taken, left - taken
        gaps.pop(0, None)
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}  # type: ignore[misc]


def _place(base: dict[tuple[int, int], int], runs):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            lengths, tasks = batch.column("length").to_numpy(), batch.column("task").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            edges = [0, *(np.flatnonzero((np.diff(lengths) != 0) | (np.diff(tasks) != 0)) + 1).tolist(), len(lengths)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b == a:
                    continue
                key = int(tasks[a]), int(lengths[a])
                rank = np.arange(b - a) + base[key] + seen.get(key, 0)
                seen[key] = seen.get(key, 0) + b - a
                first, to, at = runs.value[key[1]]
                i = np.searchsorted(first, rank, "right") - 1
                sequence[a:b], offset[a:b] = to[i] + rank - first[i], at[i]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    tokenizer: path of a tokenizers file of the byte-level BPE family.
    """
    spark = session_for(docs)
    pieces = cut(docs.select("doc_id", "text").mapInArrow(_cut_pieces(tokenizer, length, end_id), _PIECES))
    ranged = cut_in_order(
        pieces.repartitionByRange(shuffle_partitions(spark), "length", "doc_id", "piece", "ids_crc32")
        .sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
        .withColumn("task", F.spark_partition_id())
    )
    # ranges of lengths: at most as many rows as there are tasks and lengths
    base: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = defaultdict(int)
    for task, size, n in sorted(map(tuple, ranged.groupBy("task", "length").count().collect())):
        base[task, size] = counts[size]
        counts[size] += n
    runs = spark.sparkContext.broadcast(best_fit_runs(counts, length))
    return ranged.mapInArrow(_place(base, runs), f"{_PIECES}, sequence_id long, offset long")
