"""SQL of operators 3 and 6 against the operators, where there is something to find."""

import duckdb
import numpy as np
import pytest

from tessera.llm import embeddings, queries, suffixes


def both(name, result, **tables):
    con = duckdb.connect()
    for t, frame in tables.items():
        con.register("given", frame)
        con.sql(f"create table {t} as select * from given")
    want = con.sql(queries.ORACLE_SQL[name])
    return sorted(map(tuple, result.select(*want.columns).collect())), sorted(want.fetchall())


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    vectors = [b + rng.normal(size=24) * s for b in base for s in (0, 0, 0.2, 0.4, 0.5)]
    vectors = [v.astype(np.float32).tolist() for v in vectors]
    vectors += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [float("inf")], [None] + [1.0] * 23]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got, want = both("op3_embedding_dedup", embeddings.near_duplicates(df, threshold=0.9), embeddings=df.toArrow())
    assert got == want
    assert sum(r[1] for r in got) > 100


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_suffixes(spark, sf, size):
    df = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/{size}/documents.parquet")
    got, want = both("op6_suffix_dedup", suffixes.report(df), documents=df.toArrow())
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_suffixes_of_odd_texts(spark):
    a, b = "ä" * 70 + "xyz" * 50, "".join(map(chr, range(200, 400)))
    texts = [None, "", "kurz", a, b, b[3:] + a[5:], b, a + a, "z" * 99, "z" * 100, "z" * 301]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = both("op6_suffix_dedup", suffixes.report(df), documents=df.toArrow())
    assert got == want
