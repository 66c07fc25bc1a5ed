"""Best-fit packing (operator 7): best-two-fit on a histogram of lengths.

No piece is longer than a sequence, so a table of counts by length is bounded whatever the corpus. On it the driver
fills sequences: the longest piece first, then always the longest that still fits. When nothing fits, it takes out the
sequence's smallest piece if two unpacked ones fill the expanded gap more tightly, and tries again. A filled pattern
of lengths repeats as often as the counts allow; each one uses some length up, so the patterns are few.
Pieces are then dealt to the places of their length by rank. Ranks come from counters that tasks keep for themselves,
and prefix sums over (length, task), so no task sees all pieces of a length.

A null or empty text is one piece, the end id alone. An empty table gives no rows; repeated rows are packed each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lean, stored, text_slices, tidy
from tessera.llm.tokens import encoder

_RANK = 40  # bits of a rank below the length in a place's key


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, their lengths) from counts by length (index 0 to capacity)."""
    if capacity < 1:
        raise ValueError("a sequence must hold a token at least")
    counts, out, lengths = histogram.astype(np.int64).copy(), [], np.arange(capacity + 1)
    counts[0] = 0
    while counts.any():
        free = counts.copy()

        def longest() -> np.ndarray:
            return np.maximum.accumulate(np.where(free > 0, lengths, 0))

        row, gap = [], capacity
        while True:
            below = longest()
            while gap and (x := int(below[gap])):
                row.append(x)
                free[x] -= 1
                gap -= x
                if not free[x]:
                    below = longest()
            if not gap or len(row) < 2:
                break
            small = min(row)
            room = gap + small
            ones = np.flatnonzero(free[: room + 1])
            ones = ones[ones * 2 <= room]  # the shorter of the two
            if not len(ones):
                break
            twos = below[room - ones]
            sums = np.where((twos > ones) | (twos == ones) & (free[ones] > 1), ones + twos, 0)
            k = int(np.argmax(sums))
            if sums[k] <= small:
                break
            row.remove(small)
            free[small] += 1
            for x in (int(twos[k]), int(ones[k])):
                row.append(x)
                free[x] -= 1
            gap = room - int(sums[k])
        used = np.bincount(row, minlength=capacity + 1)
        own = np.flatnonzero(used)
        times = int((counts[own] // used[own]).min())
        counts[own] -= times * used[own]
        out.append((times, sorted(row, reverse=True)))
    return out


def places(patterns: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with each run's first sequence and offset."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for times, row in patterns:
        offset = 0
        for x in row:
            rows.append(((x << _RANK) + int(taken[x]), base, offset))
            taken[x] += times
            offset += x
        base += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document, with the task that made them and their rank among its pieces of that length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * keep_ids

    def run(batches):
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, borders = encode(part.column("text"))
                full = np.insert(ids, borders[1:], end_id).astype("<u4")
                ends = borders + np.arange(len(borders))
                size = np.diff(ends)
                n = -(-size // capacity)
                of = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[of] - start)
                a = ends[:-1][of] + start
                crc = [zlib.crc32(full[i:j]) for i, j in zip(a.tolist(), (a + length).tolist())]
                order = np.argsort(length, kind="stable")
                found, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(of), np.int64)
                rank[order] = np.arange(len(of)) - np.repeat(first, many) + seen[length[order]]
                seen[found] += many
                cols = [part.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(of), task, np.int32)), pa.array(rank)]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * keep_ids
    return tidy(docs, "doc_id", "text").mapInArrow(lean(run), kinds)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    if capacity < 1:
        raise ValueError("a sequence must hold a token at least")
    spark = docs.sparkSession
    made = stored(pieces(docs, path, capacity, end_id, keep_ids), "pieces")  # ranks count only if they stay
    each = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in each.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches):
        keys, first, offsets = table.value
        for batch in batches:
            want = (batch.column("length").to_numpy() << _RANK) + batch.column("at").to_numpy()
            k = np.searchsorted(keys, want, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(first[k] + want - keys[k]), pa.array(offsets[k])], [*names, "sequence_id", "offset"])

    ranked = made.join(base, ["length", "task"]).select(*names, (F.col("rank") + F.col("before")).alias("at"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pack(keep_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
