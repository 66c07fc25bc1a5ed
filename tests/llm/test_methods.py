"""Operators held against plain statements of their methods."""

import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import embeddings, graph, language, packing, queries, sharding


def words_of(text):
    """Lower-case runs of letters; a letter whose lower case is several characters stays."""
    out, word = [], ""
    for c in text:
        if unicodedata.category(c)[0] == "L":
            word += c.lower() if len(c.lower()) == 1 else c
        else:
            out.append(word)
            word = ""
    return [w for w in [*out, word] if w]


def number(gram):
    """The operator's code of an n-gram, which decides between equal counts."""
    p = [0] * (3 - len(gram)) + [ord(c) for c in gram]
    if len(gram) < 3:
        return p[1] << 21 | p[2]
    return (p[0] << 41 ^ (p[1] << 21 | p[2])) | 1 << 62


def profile(texts):
    counts = Counter()
    for text in texts:
        for w in words_of(text):
            for n in (1, 2, 3):
                padded = w if n == 1 else f" {w} "
                counts.update(g for i in range(len(padded) - n + 1) if len((g := padded[i : i + n]).strip()) > (n == 3))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[: language.RANKS]


def test_out_of_place_distance(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").limit(80).collect()
    known = language.fit(docs, sample=10**9)
    by = {}
    for r in docs.collect():
        by.setdefault(r.lang, []).append(r.text)
    profiles = {k: profile(v) for k, v in by.items()}
    for r in rows:
        own = profile([r.text])
        far = {}
        for name, ranks in profiles.items():
            place = {g: i for i, g in enumerate(ranks)}
            far[name] = sum(abs(place[g] - i) if g in place else language.RANKS for i, g in enumerate(own))
        best = min(sorted(far), key=far.get)
        got = known.judge(r.text)
        assert got[0] == best and got[1] == pytest.approx(1 - far[best] / (language.RANKS * len(own)))


def test_language_stage_rejects(spark):
    rng = np.random.default_rng(1)
    noise = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(200))
    english = "the cat sat on the mat and looked at the dog that was there in the house of the man"
    german = "der Hund lief durch den Wald und die Katze sah ihm von dem Dach des Hauses aus zu"
    rows = [(1, english, "en"), (2, german, "de"), (3, noise, None), (4, "42 !", "en"), (5, None, "de"), (6, "the dog and the cat", None), (7, "Это текст", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in language.accepted(docs).collect()}
    assert kept == {1: "en", 2: "de", 6: "en", 7: "und"}
    assert {r.doc_id for r in language.accepted(docs, languages={"en"}).collect()} == {1, 6}
    one = spark.createDataFrame([(1, english, "en"), (2, german, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(one, language.fit(one)).collect()} == {"en"}


def test_shards_against_plain_turns(spark, sf, tmp_path):
    for names, slots in ((["a"], 5), ([f"n{i}" for i in range(5)], 31), ([f"s{i}" for i in range(40)], 101)):
        perms = [[(sharding._number(f"offset {s}") + k * (sharding._number(f"skip {s}") % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
        table = {}
        while len(table) < slots:
            for i, perm in enumerate(perms):
                if free := [x for x in perm if x not in table]:
                    table[free[0]] = i
        assert sharding.fill(names, slots) == [table[i] for i in range(slots)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, "doc_id", ["x", "y", "z"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.text, r.shard) for r in sharding.place(docs, "doc_id", ["x", "y", "z"]).collect()}
    assert {(r.doc_id, r.text, r.shard) for r in back.select("doc_id", "text", "shard").collect()} == want and back.count() == docs.count()
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"shard=x", "shard=y", "shard=z"}


def test_shards_in_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op2_sharding"])
    got = queries.op2_sharding(spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain_plan(lengths, capacity):
    """Best-two-fit, one sequence after another, on a plain list of lengths."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        free, row = list(left), []
        while True:
            gap = capacity - sum(row)
            while fits := [x for x in free if x <= gap]:
                row.append(fits[0])
                free.remove(fits[0])
                gap -= fits[0]
            if not gap or len(row) < 2:
                break
            small = min(row)
            pairs = [(a + b, a, b) for i, a in enumerate(free) for b in free[i + 1 :] if a + b <= gap + small]
            if not pairs or max(pairs)[0] <= small:
                break
            # Of pairs that fill the gap equally, that with the smallest piece.
            _, a, b = min((p for p in pairs if p[0] == max(pairs)[0]), key=lambda p: p[2])
            row.remove(small)
            free = sorted([*free, small], reverse=True)
            for x in (a, b):
                free.remove(x)
                row.append(x)
        for x in row:
            left.remove(x)
        out.append(sorted(row, reverse=True))
    return out


def test_plan_against_plain_packing():
    rng = np.random.default_rng(6)
    for _ in range(60):
        capacity = int(rng.integers(2, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 60))
        got = [row for times, row in packing.plan(np.bincount(lengths, minlength=capacity + 1), capacity) for _ in range(times)]
        assert sorted(x for row in got for x in row) == sorted(lengths.tolist()) and max(map(sum, got)) <= capacity
        assert sorted(got) == sorted(plain_plan(lengths.tolist(), capacity))
    single = np.zeros(31, np.int64)
    single[[20, 9, 7, 4, 3]] = 1
    assert [row for _, row in packing.plan(single, 30)] == plain_plan([20, 9, 7, 4, 3], 30)
    assert packing.plan(np.zeros(3, np.int64), 2) == []
    with pytest.raises(ValueError):
        packing.plan(np.zeros(1, np.int64), 0)


def linked(rows, threshold):
    v = np.array([e for _, e in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("n, dim, threshold", [(300, 32, 0.9), (1500, 64, 0.9), (900, 16, 0.8), (4000, 64, 0.95)])
def test_recall_at_several_sizes(spark, n, dim, threshold):
    """Pairs just above the threshold, the hardest to find: at least 0.97 of them are linked, and nothing else is."""
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n // 2, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((n // 2, dim))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(threshold - 0.02, threshold + 0.02, (n // 2, 1))
    rows = [(i, x) for i, x in enumerate(np.concatenate([base, c * base + np.sqrt(1 - c**2) * other]).tolist())]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold).collect()}
    near = linked(rows, threshold)
    count = near.sum(axis=1)
    assert near.sum() > 0.3 * n and sum(got[i].n_links for i in got) >= 0.97 * near.sum() and all(got[i].n_links <= count[i] for i in got)


def test_vectors_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    one, two = rng.standard_normal((2, 8)), rng.standard_normal(5)
    hot = one[0] + rng.standard_normal((100, 8)) * 0.01  # one bucket of far more than BLOCK
    rows = [(10 + i, x) for i, x in enumerate(hot.tolist())] + [(500, two.tolist()), (501, (two * 3).tolist()), (501, one[1].tolist()), (None, one[1].tolist()), (None, (2 * one[1]).tolist()), (None, None), (7, (two * -1).tolist())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, key long, id string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(df).collect())
    want = [(10 + i, 99, 10, i == 0) for i in range(100)] + [(500, 1, 500, True), (501, 1, 500, False), (501, 2, 501, True), (0, 2, 501, False), (0, 2, 501, False), (0, 0, 0, True), (7, 0, 7, True)]
    assert got == sorted(want)


def test_shape_keeps_its_promise():
    import math

    for n in (2, 10**4, 10**9, 10**12):
        for threshold in (0.5, 0.7, 0.9, 0.99):
            bits, tables = embeddings.shape(n, threshold)
            assert tables <= embeddings.TABLES and (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** tables <= 0.01


def test_star_of_many_links(spark):
    links = [(1, 100 + i) for i in range(3000)] + [(50, 60), (60, 70), (70, 3099)]
    got = {r.a: r.b for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {100 + i: 1 for i in range(3000)} | {50: 1, 60: 1, 70: 1}
