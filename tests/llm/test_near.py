"""Near dedup of the pipeline against exact Jaccard similarities of five-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import graph, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted(rng, n, target):
    """Two texts of n and more shingles whose similarity is just above or below the target: the ends differ."""
    own = [f"w{x}" for x in rng.integers(0, 10**12, 2 * n + 8)]
    shared = round(2 * n * target / (1 + target))
    return " ".join(own[: n + 4]), " ".join(own[n - shared : 2 * n - shared + 4])


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(11)
    out = [planted(rng, n, t) for n in (30, 90, 400) for t in np.linspace(0.7, 0.95, 26) for _ in range(4)]
    return [(2 * i + k, p[k]) for i, p in enumerate(out) for k in (0, 1)]


def brute(rows):
    """Smallest id of each row's component, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links = {(i, j) for at in where.values() for i in at for j in at if i < j and jaccard(sets[i], sets[j]) >= 0.8}
    a, b = (np.array(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    ids = np.array([d for d, _ in rows])
    return {int(ids[i]): int(ids[t]) for i, t in enumerate(graph.merge_labels(np.arange(len(rows)), a, b))}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string").repartition(5)


def test_planted_pairs(spark, sf, pairs):
    kept = corpus_pipeline.near_dedup(spark, frame(spark, pairs), sf)
    want = brute(pairs)
    assert 150 < sum(d != t for d, t in want.items()) < 250
    assert {r.doc_id for r in kept.collect()} == {d for d, t in want.items() if d == t}


def test_templated_texts_stay(spark, sf):
    rng = np.random.default_rng(12)
    for n in (93, 120):  # shared shingles of n + 20: a Jaccard of 0.70 and 0.75, which makes no link
        form = " ".join(f"form{i}" for i in range(n + 4))
        rows = [(i, form + " " + " ".join(f"x{x}" for x in rng.integers(0, 10**12, 20))) for i in range(60)]
        assert all(i == t for i, t in brute(rows).items())
        assert corpus_pipeline.near_dedup(spark, frame(spark, rows), sf).count() == 60


def test_groups_dealt_over_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(simhash, "DEALT", 7)
    monkeypatch.setattr(simhash, "SPEAKERS", 2)
    monkeypatch.setattr(simhash, "COLUMNS", 13)
    rng = np.random.default_rng(13)
    base = [f"b{i}" for i in range(64)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"n{rng.integers(10**9)}" for w in base)) for i in range(120)]
    rows += [(900 + i, t) for i, t in enumerate([None, "", " \n ", "one", "ONE ", "one two", "a b c d e", "A  b c D e"])]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want and 5 < len(set(want.values())) < 100
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f"), (4, "x y"), (9, "x  y"), (None, "z")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.component_id or 0) for r in simhash.similar_components(odd).collect())) == [(0, 0), (0, 4), (0, 4), (4, 4), (4, 4), (9, 4)]
    assert simhash.kept_rows(odd).count() == 5 and simhash.kept_rows(odd.limit(0)).count() == 0


def test_passages_found_everywhere(spark, monkeypatch):
    """Neither the list of frequent shingles, nor keys kept out of runs, nor the pivots of long runs change what is linked."""
    rng = np.random.default_rng(14)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"x{x}" for x in rng.integers(0, 10**12, 60 if i % 3 else 4))) for i in range(700)]
    rows += [(1000 + i, rows[3 * i][1] + " more") for i in range(50)] + [(2000, passage), (2001, None)]
    want = brute(rows)
    monkeypatch.setattr(simhash, "OFTEN", 100)
    monkeypatch.setattr(simhash, "SHARE", 1.0)
    df = frame(spark, rows)
    listed, counts = simhash.frequent(df, 5)
    assert len(listed) == 36 and set(counts.tolist()) == {len(rows) - 1}
    assert {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(simhash, "RUN", 200)
        m.setattr(simhash, "DEALT", 50)
        assert {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()} == want
    monkeypatch.setattr(simhash, "OFTEN", 10**9)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "PIVOTS", 3)
    assert {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()} == want


def test_shortest_similar_texts(spark, sf):
    """Eight and nine words: four of five shingles, the pairs whose fingerprints differ most."""
    rng = np.random.default_rng(13)
    texts = [[f"w{x}" for x in rng.integers(0, 10**12, 9)] for _ in range(4000)]
    rows = [(2 * i + k, " ".join(t[: 8 + k])) for i, t in enumerate(texts) for k in (0, 1)]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), sf)
    assert {r.doc_id for r in kept.collect()} == set(range(0, 8000, 2))


def test_apart(spark):
    rows = spark.createDataFrame([(k, i, 0) for k, ids in ((5, range(10, 40)), (-3, (7, 12, 7)), (8, (1, 2))) for i in ids], "key long, id long, kind int")
    rest, links = simhash.apart(rows, np.array([5, -3], np.int64).view(np.uint64))
    assert {(r.key, r.id) for r in rest.collect()} == {(8, 1), (8, 2)}
    assert sorted(map(tuple, links.collect())) == sorted([(i, 10) for i in range(11, 40)] + [(12, 7)])
    assert simhash.apart(rows, np.array([], np.uint64))[1] is None


def candidates(monkeypatch, df):
    """Groups of candidates that the near-dedup stage compares: id and least id of those that aren't the least."""
    seen = {}
    real = simhash.similar_links

    def spy(docs, groups, *rest):
        seen.update((r.id, r.top) for r in groups.collect())
        return real(docs, groups, *rest)

    with monkeypatch.context() as m:
        m.setattr(simhash, "similar_links", spy)
        simhash.similar_components(df).collect()
    return seen


def test_candidates_come_from_deletion_variants(spark, monkeypatch):
    """The stage meets pairs under variants of max_bits // 2 + 1 segments; of no segments, nobody meets."""
    rng = np.random.default_rng(15)
    rows = [(2 * i + k, t) for i in range(40) for k, t in enumerate(planted(rng, 90, 0.85))]
    df, real, asked = frame(spark, rows), simhash.cuts, []
    monkeypatch.setattr(simhash, "cuts", lambda *a: asked.append(a) or real(*a))
    assert candidates(monkeypatch, df) == {i + 1: i for i in range(0, 80, 2)} and asked == [(256, 43, 84)]
    monkeypatch.setattr(simhash, "cuts", lambda *a: [(w, 0, 64, False) for w in range(4)])
    assert candidates(monkeypatch, df) == {}


def test_fingerprints_decide_on_shared_passages(spark, monkeypatch):
    """Texts that lead with a shingle of over RUN documents are candidates only if their fingerprints are close."""
    rng = np.random.default_rng(16)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(common + [f"x{x}" for x in rng.integers(0, 10**12, 4)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)]
    monkeypatch.setattr(simhash, "OFTEN", 1)
    monkeypatch.setattr(simhash, "SHARE", 1.0)
    monkeypatch.setattr(simhash, "RUN", 60)
    df = frame(spark, rows)
    fps = {r.doc_id: np.array([r.f0, r.f1, r.f2, r.f3], np.int64).view(np.uint64) for r in simhash.sketches(df, 5, 256, 0.8, np.zeros(0, np.uint64)).collect()}
    ids = np.array(sorted(fps))
    x = np.stack([fps[i] for i in ids])
    near = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2) <= 84
    top = ids[graph.merge_labels(np.arange(len(ids)), *np.nonzero(near))]
    close = {int(i): int(t) for i, t in zip(ids, top)}
    got = candidates(monkeypatch, df)
    assert all(close[i] == close[t] for i, t in got.items())
    assert {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()} == brute(rows)


def test_dealt(spark):
    rows = spark.createDataFrame([(0, k, i) for k, n in ((5, 200), (8, 3)) for i in range(n)], "kind int, key long, id long")
    got = {}
    for r in simhash.dealt(rows.repartition(3), np.array([5], np.uint64), np.array([100 * simhash.RUN])).collect():
        got.setdefault(r.key, set()).add(r.id)
    assert got.pop(8) == {0, 1, 2} and max(map(len, got.values())) < 20
    met = {(i, j) for at in got.values() for i in at for j in at if i < j}
    assert len(met) == 200 * 199 // 2


@pytest.mark.parametrize("long", [10, 10**9])
def test_variant_forest(monkeypatch, long):
    """All pairs within the radius are joined, and no others, whichever way a run is indexed."""
    monkeypatch.setattr(simhash, "LONG", long)
    monkeypatch.setattr(simhash, "LISTS", 70)
    rng = np.random.default_rng(17)
    bits = rng.integers(0, 2, (60, 256))[rng.integers(0, 60, 400)] ^ (rng.random((400, 256)) < rng.uniform(0.05, 0.25, 400)[:, None])
    fp = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").astype(np.uint64)
    key = np.sort(rng.choice(np.array([1, 1, 1, 2, 2, 3, *range(10, 60)]), 400))
    a, b = simhash.variant_forest(0, key, np.arange(400), fp, simhash.cuts(256, 43, 84), 84)
    near = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= 84) & (key[:, None] == key[None])
    want = graph.merge_labels(np.arange(400), *np.nonzero(near))
    assert (graph.merge_labels(np.arange(400), a, b) == want).all() and 10 < len(np.unique(want)) < 390
    some = [(0, 0, 5, True)]
    shared = simhash.sharing(fp, fp, some)
    assert (shared == (np.bitwise_count((fp[:, 0][:, None] ^ fp[:, 0]) & np.uint64(31)) <= 1)).all()
