"""Embedding near-dedup (operator 3): random-hyperplane signs in several tables, exact cosines, connected components.

Vectors that are equal in every component form one class with a weight. Every class has a code of `bits` hyperplane
signs in each of `tables` tables; classes that share a code are compared exactly, in double precision. A pair that
shares codes in several tables counts in the first of them alone, which the codes themselves tell, so counts add up
without a list of pairs. A bucket gives one count for each member and a spanning forest, never all pairs. A bucket of
more than BLOCK members is dealt over tasks as pairs of blocks, so none of its pairs is left out.

`bits` grows with the logarithm of the number of classes, and `tables` with it, so that a pair at the threshold is
missed with a chance of at most `miss`; where that would take over TABLES tables, `bits` stays lower and buckets grow
instead. Vectors of one length are compared with each other. Vectors that are null, zero, empty, or that hold null or
non-finite components link with nothing; they are their own components. Vectors of a null vec_id count and link like
others, but a component is named by a vec_id as long as it holds one. Rows of one vec_id with different vectors are
different vectors. A null vec_id stays null. Repeated rows are vectors of one class. An empty table gives an empty
result. Columns other than vec_id and embedding aren't touched, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import each_part, parts, salt, stored
from tessera.llm.graph import components, merge_labels

SEED = 20_240_601
#: Classes that one task compares with as many others at once.
BLOCK = 2048
#: Tables at most.
TABLES = 400


def shape(n: int, threshold: float, miss: float = 0.01, bucket: int = 64) -> tuple[int, int]:
    """(bits, tables) for n classes: buckets of about `bucket` unrelated classes, a miss of at most `miss`."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / bucket))))
    while bits > 1 and math.log(miss) / math.log1p(-(agree**bits)) > TABLES:
        bits -= 1
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key of its class or null, part) of each row, and (key, id, embedding, weight, bits) of each class."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(vectors["vec_id"], vectors["embedding"].alias("embedding")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.select("vec_id", F.when(F.col("fine"), e).alias("embedding"), salt(F.col("vec_id")).alias("part"))
    key = F.when(F.col("embedding").isNotNull(), F.md5(F.array_join(F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string")), ",").cast("binary")))
    rows = rows.withColumn("key", key)
    each = rows.filter("key is not null").groupBy("key", "part").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    each = each.groupBy("key").agg(F.sum("weight").alias("weight"), F.min("least").alias("least"), F.first("embedding").alias("embedding"), parts(F.col("part")).alias("bits"))
    # A class is named by its least vec_id, as digits that sort like it, and its key; those without vec_id come last.
    least = F.coalesce(F.lpad(F.hex(F.col("least").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("-" * 16).cast("string"))
    return rows.select("vec_id", "key", "part"), each.withColumn("id", F.concat(F.when(F.col("least").isNull(), "z").otherwise("a"), least, "key"))


def _vec_id(name):
    """The vec_id in a class's name, or null."""
    return F.when(F.substring(name, 1, 1) == "a", F.conv(F.substring(name, 2, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63))))


@functools.lru_cache(4)
def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, bits * tables))


def _codes(v: np.ndarray, p: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (v @ p > 0).reshape(len(v), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1, scaled first so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def compare(links_of: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """a, b, n: for each member of each bucket its weighted count of partners (b null), and links (n null)."""

    def spread(batches):
        for batch in batches:
            size = np.array([len(x) for x in batch.column("embedding")], np.int64)
            for dim in np.unique(size).tolist():
                own = batch.filter(pa.array(size == dim))
                v = np.array(own.column("embedding").flatten().to_numpy()).reshape(-1, dim)
                codes = _codes(_unit(v), planes(dim, bits, tables), bits, tables)
                raw = pa.array([x.tobytes() for x in v], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), dim, np.int32)), pa.array(np.full(len(v), t, np.int32)), pa.array(codes[:, t]), own.column("id"), own.column("weight"), raw], ["dim", "t", "code", "id", "weight", "raw"])

    spread_rows = links_of.select("id", "weight", "embedding").mapInArrow(spread, "dim int, t int, code long, id string, weight long, raw binary")
    sizes = stored(spread_rows.groupBy("dim", "t", "code").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    rows = spread_rows.join(sizes, ["dim", "t", "code"])
    # Blocks of a bucket: a row of block i goes to the tasks (i, 0..i) and (i+1.., i).
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "t", "code", F.greatest("mine", "other").alias("hi"), F.least("mine", "other").alias("lo"), "mine", "id", "weight", "raw")
    keys = ["dim", "t", "code", "hi", "lo"]

    def bucket(dim, t, hi, lo, mine, ids, weight, raw):
        v = _unit(np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim))
        codes = _codes(v, planes(dim, bits, tables)[:, : bits * t], bits, t) if t else np.zeros((len(v), 0), np.int64)
        count, labels = np.zeros(len(v), np.int64), np.arange(len(v))
        for i in range(0, len(v), BLOCK):
            for j in range(0, len(v), BLOCK):
                x, y = np.nonzero(v[i : i + BLOCK] @ v[j : j + BLOCK].T >= threshold - 1e-9)
                x, y = x + i, y + j
                ok = (x != y) if hi == lo else (mine[x] != mine[y])
                x, y = x[ok], y[ok]
                # Ties at the threshold: the plain sum decides.
                ok = np.einsum("ij,ij->i", v[x], v[y]) >= threshold
                for c in range(t):
                    ok &= codes[x, c] != codes[y, c]
                x, y = x[ok], y[ok]
                np.add.at(count, x, weight[y])
                labels = merge_labels(labels, x, y)
        k, m = np.flatnonzero(count), np.flatnonzero(labels != np.arange(len(v)))
        a = ids.take(pa.array(np.concatenate([k, m])))
        b = pa.concat_arrays([pa.nulls(len(k), pa.string()), ids.take(pa.array(labels[m]))])
        n = pa.concat_arrays([pa.array(count[k]), pa.nulls(len(m), pa.int64())])
        return pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"])

    def run(batches):
        held, now = [], None
        def flush():
            dim, t, _, hi, lo = now
            cols = [pa.concat_arrays([h.column(n) for h in held]) for n in ("mine", "id", "weight", "raw")]
            return bucket(dim, t, hi, lo, cols[0].to_numpy(), cols[1], cols[2].to_numpy(), cols[3].to_pylist())

        for batch in batches:
            k = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in keys])
            cut = [0, *(np.flatnonzero((np.diff(k, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                key = tuple(k[:, a].tolist())
                if held and key != now:
                    yield flush()
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a string, b string, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, miss: float = 0.01) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    own, each = classes(vectors)
    own, each = stored(own, "vectors"), stored(each, "classes")
    bits, tables = shape(each.count(), threshold, miss)
    found = stored(compare(each, bits, tables, threshold), "compared")
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    tree = components(found.filter("b is not null").select("a", "b")).withColumnsRenamed({"a": "id", "b": "top"})
    known = each.join(counts, "id", "left").join(tree, "id", "left").select("key", "bits", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), _vec_id(F.coalesce("top", "id")).alias("component_id"))
    # Rows of one class get its verdict part by part.
    out = own.join(each_part(known, "bits", "part"), ["key", "part"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
