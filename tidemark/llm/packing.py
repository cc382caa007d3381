"""Best-fit packing of token pieces into sequences of one length, in bulk-synchronous steps over ranked groups."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import WordBPE, codec
from tidemark.llm.common import id_text, map_arrow, staged, texts

#: Tokens of a sequence.
SEQUENCE = 2048
#: Id that ends every document.
END = 0


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces; task and rank: its place among the task's pieces of that length."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task, seen = codec(WordBPE, path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, many in texts(batch):
                rows = []
                for k, x in enumerate(c.encode_texts(many)):
                    x = np.append(x, np.uint32(END)).astype("<u4")
                    for p, at in enumerate(range(0, len(x), size)):
                        part = x[at : at + size]
                        rows.append((ids[i + k], p, at, len(part), zlib.crc32(part.tobytes()), task, int(seen[len(part)])))
                        seen[len(part)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], [x.split()[0] for x in kind.split(", ")])

    return id_text(docs).transform(map_arrow, run, kind)


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over groups: (length, first rank, end rank, first sequence, offset, pieces in a row) for each move.

    Pieces of one length are one group, longest first; sequences with one gap are one group of runs. In each step the
    group's ranks go to the smallest gap that holds them (its successor among the sorted gaps), the lowest ranks to the
    lowest sequences; gaps are updated, and the rest takes the next gap or opens sequences. The work and the result grow
    with size, never with the number of pieces.
    """
    moves, gaps, runs, next_id = [], [], {}, 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end and (at := bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            first, n = runs[gap].pop()
            row = min(gap // length, -(-(end - rank) // n) if end - rank > n else 1)
            take = min(n, (end - rank) // row)
            moves.append((length, rank, rank + take * row, first, size - gap, row))
            if not runs[gap]:
                gaps.pop(at)
                del runs[gap]
            put(gap, first + take, n - take)
            put(gap - row * length, first, take)
            rank += take * row
        if rank < end:
            row = size // length
            full, rest = divmod(end - rank, row)
            for n, r in ((full, row), (1 if rest else 0, rest)):
                if n:
                    moves.append((length, rank, rank + n * r, next_id, 0, r))
                    put(size - r * length, next_id, n)
                    rank, next_id = rank + n * r, next_id + n
    return moves


def pack(found: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to staged pieces: ranks become global by counts of (length, task), then moves place them."""
    spark = found.sparkSession
    by_task = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    moves = spark.createDataFrame(plan(counts, size), "length long, low long, high long, first long, at long, row long")
    ranked = found.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(moves), (ranked["length"] == moves["length"]) & (ranked["rank"] >= moves["low"]) & (ranked["rank"] < moves["high"]))
    step = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.floor(step / F.col("row"))).cast("long").alias("sequence_id"), (F.col("at") + step % F.col("row") * ranked["length"]).alias("offset"))


def best_fit(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """Pack all documents: one row a piece with its sequence and offset.

    Null and empty texts are one piece of the end id alone. Only longer documents are cut. Equal texts and repeated rows
    are packed each; equal lengths are ranked by task and place. Other columns are dropped; an empty table gives an empty
    result. The driver holds one count a length and the moves, both bounded by size; a length that a third of all pieces
    have is counted within each task before the shuffle.
    """
    return pack(staged(pieces(docs, path, size), "pieces"), size)
