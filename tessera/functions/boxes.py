"""Boxes: closed ranges over dimensions, as column expressions and as long tables (box_id, dim, lo, hi)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = dict[str, tuple[float, float]]


def inside(box: Box, of=F.col) -> Column:
    return reduce(Column.__and__, (of(d).between(lo, hi) for d, (lo, hi) in box.items()), F.lit(True))


def counts(df: DataFrame, boxes: list[Box]) -> DataFrame:
    """box_id, n: exact counts of all boxes in one pass."""
    one = df.agg(*(F.count_if(inside(b)).alias(f"n{i}") for i, b in enumerate(boxes)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("box_id"), F.col(f"n{i}").alias("n")) for i in range(len(boxes))))).alias("r")).select("r.*")


def uniform_count(q_lo: Column, q_hi: Column, lo: Column, hi: Column) -> Column:
    """A dimension's factor of the estimate that rows are spread evenly; the box isn't clipped."""
    return (q_hi - q_lo) / (hi - lo)


def overlap_class(q_lo: Column, q_hi: Column, lo: Column, hi: Column) -> Column:
    """Of one dimension: 0 apart, 1 overlapping, 2 the query inside; touching counts as overlap."""
    return F.when((q_lo > hi) | (q_hi < lo), 0).when((q_lo >= lo) & (q_hi <= hi), 2).otherwise(1)


def clip(q_lo: Column, q_hi: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    return F.greatest(q_lo, lo), F.least(q_hi, hi)


def bounding(boxes: DataFrame, *by: str) -> DataFrame:
    """The smallest box around boxes, for each group and dimension."""
    return boxes.groupBy(*by, "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def side_of_cut(lo: Column, hi: Column, v: Column) -> Column:
    return F.when(lo >= v, "R").when(hi <= v, "L").otherwise("M")


def merge_open(boxes: list[Box]) -> list[Box]:
    """Bounding boxes of sets of boxes that overlap openly, merged until none do."""
    out = [dict(b) for b in boxes]
    i = 0
    while i < len(out):
        for j in range(i + 1, len(out)):
            if all(out[i][d][0] < out[j][d][1] and out[j][d][0] < out[i][d][1] for d in out[i]):
                other = out.pop(j)
                out[i] = {d: (min(lo, other[d][0]), max(hi, other[d][1])) for d, (lo, hi) in out[i].items()}
                i = -1
                break
        i += 1
    return out


def extend_chebyshev(df: DataFrame, box: Box, b: int) -> float:
    """Scale about the box's centre by which it holds b + 1 rows (or all)."""
    far = F.greatest(*(F.abs(F.col(d) - (lo + hi) / 2) / ((hi - lo) / 2) for d, (lo, hi) in box.items() if hi > lo), F.lit(0.0))
    rows = df.select(far.alias("far")).orderBy("far").limit(b + 1).agg(F.max("far").alias("far")).first()
    return rows.far


def extend_sides(df: DataFrame, box: Box, domain: Box, b: int) -> tuple[Box, int]:
    """The box, and how many rows it then holds, moved out to the domain's ends side by side, in the order of dimensions
    and lower before upper, until it holds b rows; the side that gets there stops at the least move that suffices.

    A job for each side that isn't enough, and one to find the order statistic on the last.
    """
    n = df.where(inside(box)).count()
    if n >= b:
        return box, n
    for d in box:
        for k in (0, 1):
            wide = box | {d: (domain[d][0], box[d][1]) if k == 0 else (box[d][0], domain[d][1])}
            size = df.where(inside(wide)).count()
            if size >= b:
                added = df.where(inside(wide) & ~inside(box)).select(d).orderBy(F.col(d).desc() if k == 0 else F.col(d).asc()).limit(b - n)
                edge = added.agg((F.min if k == 0 else F.max)(d).alias("x")).first().x
                out = box | {d: (float(edge), box[d][1]) if k == 0 else (box[d][0], float(edge))}
                return out, df.where(inside(out)).count()
            box, n = wide, size
    return box, n
