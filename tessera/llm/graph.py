"""Distributed connected components: links jump to the least neighbour of their smaller end, and are then hooked, in turn.

A jump (large-star) takes a link (a, b) to (a, least neighbour of b). Hooking (small-star) deals links by a, in salted
parts at first, and leaves of each task's links a star for each of its components. What a node is linked to is gathered
before it is shuffled, and returns to links part by part, so a node with very many links is dealt over SALTS tasks. Each
turn is one table in the shared folder, and the one before it is deleted. Neither links nor components pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import discard, each_part, lean, parts, salt, stored, tidy, written

#: Links of a task that are made stars at once, about.
HELD = 1 << 20


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each an index, the smallest of its set) once a[i] and b[i] belong together."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if len(a):
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while (labels != (up := labels[labels])).any():
                labels = up
    return labels


def _stars(batches):
    """Of the links of a task, a star for each of its components: every node but the least is linked to the least."""
    ends, kind, size, last = [], None, 0, 0

    def joined():
        nodes, at = np.unique(np.concatenate([x for pair in zip(*ends) for x in pair]), return_inverse=True)
        labels = merge_labels(np.arange(len(nodes)), at[: len(at) // 2], at[len(at) // 2 :])
        out = np.flatnonzero(labels != np.arange(len(nodes)))
        return nodes[out], nodes[labels[out]]

    for batch in batches:
        ends.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in "ab"))
        kind, size = batch.column("a").type, size + batch.num_rows
        if size > max(HELD, 2 * last):
            ends = [joined()]
            size = last = len(ends[0][0])
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in joined()], ["a", "b"])


def hooked(links: DataFrame, *keys) -> DataFrame:
    """Links that join what the given ones (a > b) join: the stars of each of the tasks that the keys deal them over."""
    return tidy(links.repartition(*keys), "a", "b").mapInArrow(lean(_stars), links.select("a", "b").schema)


def gathered(links: DataFrame) -> DataFrame:
    """a, to: each larger end of links and its b's; bits: in which parts it is the smaller end of others."""
    none = F.lit(None)
    ends = F.array(F.struct("a", "b", none.cast("int").alias("part")), F.struct(F.col("b").alias("a"), none.cast(links.schema["b"].dataType).alias("b"), salt(F.col("a")).alias("part")))
    each = links.select(F.explode(ends).alias("end")).select("end.*").groupBy("a")
    return each.agg(F.collect_set("b").alias("to"), F.coalesce(parts(F.col("part")), F.lit(0)).alias("bits")).filter(F.size("to") > 0)


def jumped(ends: DataFrame) -> DataFrame:
    """The links that gathered() has gathered, each with the least neighbour of its b for b."""
    links = ends.select("a", F.explode("to").alias("b")).withColumn("part", salt(F.col("a")))
    up = each_part(ends.filter("bits <> 0").select(F.col("a").alias("b"), F.array_min("to").alias("least"), "bits"), "bits", "part")
    return links.join(up, ["b", "part"], "left").select("a", F.coalesce("least", "b").alias("b"))


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """a, b: each linked node that isn't the smallest of its component, and that smallest node.

    links: columns a and b of one ordered type. Nulls, loops and repeated links do nothing; no links, no rows.
    """

    def kept(links):
        """The links as a table of gathered(), and how many nodes don't have the least node of their component alone yet."""
        seen = Observation()
        left = F.count_if((F.col("bits") != 0) | (F.size("to") > 1)).alias("left")
        return stored(gathered(links).observe(seen, left), name), seen.get["left"]

    spark = links.sparkSession
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Each task then names a node once, so no node has more b's than there are tasks, here and in what follows.
    now, left = kept(hooked(hooked(ends, "a", salt(F.col("b"))), "a"))
    while left:
        since = written(spark) - 1
        now, left = kept(hooked(jumped(now), "a"))
        discard(spark, now, since)
    return now.select("a", F.col("to")[0].alias("b"))
