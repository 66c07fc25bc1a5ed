"""The training-data operators against brute force, on small fixtures with every odd case."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import chat, embeddings, exact, graph, language, packing, queries, rans, sharding, simhash, suffixes, tokens

KINDS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, spans string, length long, key string, shard string"
COPY = "the quick brown fox jumps over a lazy dog while seven old sailors sing about distant harbours and cold rain "
LONG = " ".join(f"word{i % 977}x{i}" for i in range(6000))
TEXTS = [(1, "Hello world, this is it."), (2, None), (3, ""), (4, "Hello world, this is it."), (5, COPY * 3), (6, "é" * 130 + " " + COPY * 2), (7, COPY * 2 + "end"), (8, LONG), (9, "a" * 400), (10, "12345 !!! ???"), (11, "日本語 <|endoftext|> it's x"), (12, " \t\n "), (12, " \t\n "), (None, "null id"), (13, LONG.replace("word5x5 ", "word5 ")), (14, "Hello World, this is it.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en" if d and d % 2 else "de", "s", len(t or ""), 7, 8, "x", 9, "k", "q") for d, t in TEXTS], KINDS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_bpe(docs, none, library):
    t = Tokenizer.from_file(queries.vocabulary())
    want = sorted((d or -1, len(i := library(x)), hashlib.sha256(np.array(i, "<u4")).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, x in TEXTS)
    assert sorted((r[0] or -1, *r[1:]) for r in tokens.round_trip(docs, queries.vocabulary()).collect()) == want
    assert tokens.round_trip(none, queries.vocabulary()).count() == 0
    ids = tokens.encode(docs, queries.vocabulary())
    assert {r.doc_id: r.text for r in tokens.decode(ids, queries.vocabulary()).collect()}[1] == t.decode(library(TEXTS[0][1]), skip_special_tokens=False)


def test_backtracking_is_exact(spark, sf, library):
    enc = tokens.BacktrackingEncoder(queries.vocabulary())
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in r.text.split()}
    assert all(enc.piece(w) == library(w) for w in sorted(words)[:3000])
    assert enc.piece("aaaa" * 3000) == library("aaaa" * 3000)


def test_blocks(docs, none, library):
    rows = rans.write_and_read(docs, queries.vocabulary(), 2).collect()
    assert len(rows) == len(TEXTS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: zlib.crc32(np.array([*library(x), 2], "<u4"))
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in rows) == sorted((d or -1, crc(x)) for d, x in TEXTS)
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert rans.write_and_read(none, queries.vocabulary(), 2).count() == 0


def test_coder():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 700_000), 5000).astype(np.uint32)
    code = rans.Coder(rans.quantise(np.bincount(ids, minlength=5001)))
    block = code.encode(np.array([5]), np.array([len(ids)]), ids)
    assert (code.decode(block)[2] == ids).all() and len(block) < 2 * len(ids)
    step = rans.CHECKPOINT_STEPS * rans.LANES
    assert (code.decode(block, range(1, 2))[2] == ids[step : 2 * step]).all()
    broken = bytearray(block)
    broken[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        code.decode(bytes(broken))


def test_packing(docs, none, library):
    rows = packing.pack(docs, queries.vocabulary(), 512, 1).collect()
    by, seen = defaultdict(list), defaultdict(int)
    whole = {d: [*library(x), 1] for d, x in TEXTS}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4")) and r.start == 512 * r.piece
        by[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(seen.values()) == sum(len(library(x)) + 1 for _, x in TEXTS) and len(by) <= -(-sum(seen.values()) // 512) + 1
    assert packing.pack(none, queries.vocabulary()).count() == 0
    made = packing.sequences(packing.pack(docs, queries.vocabulary(), 512, 1, keep_ids=True)).collect()
    assert max(len(r.ids) for r in made) <= 512 and sum(len(r.ids) for r in made) == sum(seen.values())


def test_plan():
    counts = np.zeros(101, np.int64)
    counts[[60, 50, 30, 21, 20, 19, 10, 9]] = [40, 30, 25, 20, 20, 20, 7, 3]
    plan, used = packing.plan(counts, 100), np.zeros(101, np.int64)
    for times, row in plan:
        assert sum(row) <= 100
        np.add.at(used, row, times)
    assert (used == counts).all() and sum(t for t, _ in plan) <= np.ceil((counts * np.arange(101)).sum() / 100) + 2


def test_exact(docs, none):
    rows = exact.dedup(docs).collect()
    groups = defaultdict(list)
    for d, t in TEXTS:
        groups[t or ""].append(d)
    want = [(d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in TEXTS]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=key) == sorted(want, key=key)
    kept = exact.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and exact.dedup(none).count() == exact.kept_rows(none).count() == 0
    assert {(r.doc_id, r.text) for r in kept.collect()} >= {(4, TEXTS[0][1]), (3, ""), (None, "null id")}


def brute_simhash(rows, words, bits):
    fp = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fp[d] = sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64)) if h else 0
    top = {d: d for d in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= bits:
                    top[a] = top[b] = min(top[a], top[b])
    return fp, top


def test_simhash(docs, none):
    rows = [r for r in TEXTS if r[0] is not None]
    fp, top = brute_simhash(rows, 3, 2)
    got = {r.doc_id: r for r in simhash.components_of(docs, 3, 2).collect()}
    assert all((got[d].fingerprint, got[d].component_id) == (f"{fp[d]:016x}", top[d]) for d in fp) and None in got
    assert simhash.components_of(none, 3, 2).count() == 0
    kept = simhash.kept_rows(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {8, 1, None} <= ids and not {13, 4, 14} & ids


@pytest.mark.parametrize("bits", [2, 3, 5])
def test_links_lose_nothing(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << k for k in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())) for b in base for _ in range(25)]
    fps += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]  # one long run
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(i, int(np.int64(x.view(np.int64)))) for i, x in enumerate(fps)], "id long, f0 long")
    got = {r.a: r.b for r in graph.components(simhash.links(df, 64, bits // 2 + 1, bits)).collect()}
    labels = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits)
        labels = graph.merge_labels(labels, np.full(len(near), i), near)
    assert [got.get(i, i) for i in range(len(fps))] == labels.tolist()


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)] + [(1000 + i, 1000) for i in range(1, 50)]
    got = {r.a: r.b for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500} | {1000 + i: 1000 for i in range(1, 50)}


def brute_spans(rows, width):
    seen, out = set(), {}
    for d, t in sorted((d if d is not None else -1, t or "") for d, t in rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(b[i : i + width])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(docs, none, spark, sf):
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").distinct().collect()]
        want = brute_spans(rows, suffixes.WIDTH)
        got = suffixes.report(df).collect()
        assert len(got) == df.count() and all(tuple(r[1:]) == want[r.doc_id if r.doc_id is not None else -1] for r in got)
    clean = suffixes.clean(docs)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and texts[2] is None and texts[5] != COPY * 3 and texts[1] == TEXTS[0][1]
    assert suffixes.report(none).count() == suffixes.clean(none).count() == 0


def test_suffixes_with_frequent_phrases(spark, sf, monkeypatch):
    monkeypatch.setattr(suffixes, "STOP", 3)
    monkeypatch.setattr(suffixes, "SHARE", 1.0)
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    phrase, long = noise(60), noise(240)
    rows = [(i, noise(80) + (phrase if i % 3 else long) + noise(80) + (phrase + COPY if i % 7 == 0 else "")) for i in range(60)]
    rows += [(100 + i, rows[i][1][30:220] + noise(9)) for i in range(20)] + [(200, phrase * 9), (201, long[:150]), (202, None)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    listed, size = suffixes.frequent(df.selectExpr("cast(coalesce(text, '') as binary) as text"), suffixes.WIDTH, suffixes.draw_bases())
    assert len(listed) > 30 and size == sum(len((t or "").encode()) for _, t in rows)
    want = brute_spans(rows, suffixes.WIDTH)
    assert {r.doc_id: tuple(r[1:]) for r in suffixes.report(df).collect()} == want
    # Groups of an anchor's contexts that are smaller than what one has, and pieces that cut texts and contexts.
    for name, value in (("STOP", 1 << 40), ("GROUP", 7), ("TAKE", 50), ("SLICE", 3000), ("ROW", 1000), ("PIECE", 700)):
        monkeypatch.setattr(suffixes, name, value)
    suffixes._powers.cache_clear()
    assert {r.doc_id: tuple(r[1:]) for r in suffixes.report(df).collect()} == want
    suffixes._powers.cache_clear()


def test_built_collision_removes_nothing(spark):
    """Two texts that share no 100-byte string, though polynomial hashes modulo 2^64 over a known base would say so."""
    a = "ffejojdxtdiiiqleuxwluwudxwugkcbphgqbdmdrllinbhunnmfsihglcftgxugciprvuyihefkukggrdiieijeywgiubojndhbpdtdxoigtljhdhtefejtumuqtdrnsilofgxnbueqlwtroumgwblgxpeemodiqvkqgdowe"
    b = "feeiokewtcjijqlfuyvkuvtdxwuhkcaoigrbdldskkjmbgtonnesjifmdgsfyvfciqquuyihefkukggrdiieijeywgiubojndhbpcsewoihukiieiudgfjsvmvruerorimoegwmcufplwsspulhvcmhwpfelpdhpvkqgcoxd"
    rows = [(1, a), (2, b), (3, a)]
    got = {r.doc_id: tuple(r[1:]) for r in suffixes.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows, suffixes.WIDTH) and got[2][1] == 0 and got[3][1] == 168


def test_repeated_documents(spark, monkeypatch):
    """Rows that repeat a document aren't held against each other, even if there are more than a group of them."""
    monkeypatch.setattr(suffixes, "GROUP", 5)
    rng = np.random.default_rng(4)
    text, other = ("".join(map(chr, rng.integers(97, 123, 400))) for _ in range(2))
    rows = [(3, text)] * 40 + [(5, other + text[50:250])] + [(None, other)] * 30 + [(4, None)]
    got = {r.doc_id: tuple(r[1:]) for r in suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = brute_spans(sorted(set(rows), key=str), suffixes.WIDTH)
    assert {d if d is not None else -1: v for d, v in got.items()} == want and got[3][1] == 0 and got[5][1] == 600


def test_very_long_text(spark):
    """A text of several rows of text; a passage over the border of two of them stands in another document as well."""
    rng = np.random.default_rng(1)
    one, noise = (rng.integers(97, 123, n).astype(np.uint8).tobytes().decode() for n in (suffixes.ROW + (1 << 20), 1 << 19))
    a = suffixes.ROW - 100_000
    two = noise + one[a : a + 200_000] + noise[::-1]
    got = {r.doc_id: r for r in suffixes.report(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()}
    assert (got[1].n_bytes, got[1].n_removed) == (len(one), 0) and (got[2].n_removed, got[2].n_spans) == (200_000, 1)
    assert got[2].kept_sha256 == hashlib.sha256((noise + noise[::-1]).encode()).hexdigest()


def test_suffix_sort():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at, raw = np.arange(2800), data.tobytes()
    for base in (*suffixes.draw_bases(), 500):
        got = suffixes.sort_suffixes(data, at, np.zeros(2800, np.int64), np.full(2800, 150), base)
        assert got.tolist() == sorted(range(2800), key=lambda i: (raw[i : i + 150], i))
    sign = suffixes.compare(data, at[:-1], at[1:], np.full(2799, 150), 100)
    assert all((raw[i : i + 150] > raw[i + 1 : i + 151]) - (raw[i : i + 150] < raw[i + 1 : i + 151]) == s for i, s in enumerate(sign))


def test_sorts_survive_colliding_hashes(monkeypatch):
    """A base of 1 makes every arrangement of the same bytes collide: the neighbours' bytes tell, and another base serves."""
    rng = np.random.default_rng(9)
    parts = [rng.permutation(np.arange(100) % 7 + 97).astype(np.uint8) for _ in range(40)]
    data = np.concatenate([parts[i] for i in rng.integers(0, 40, 200)])
    at, size = np.arange(200) * 100, np.full(200, 100)
    first = {}
    want = [first.setdefault(data[a : a + 100].tobytes(), i) != i for i, a in enumerate(at.tolist())]
    for bases in ([1, 12345], [12345, 1], [1, 1, 54321]):
        assert suffixes.repeats(data, at, np.zeros(200, np.int64), size, 100, bases).tolist() == want
    with pytest.raises(ValueError):
        suffixes.repeats(data, at, np.zeros(200, np.int64), size, 100, [1])


def test_language(docs, none, spark, sf):
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (2, 3, 10, 12)) and rows[1].lang_pred in ("en", "de")
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items() if d is not None)
    assert language.identify(none).count() == 0 and language.accepted(none).count() == 0
    assert language.accepted(docs).columns == docs.columns and {2, 3, 10, 12}.isdisjoint(r.doc_id for r in language.accepted(docs).collect())
    real = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    whole = language.grams("Äpfel und Birnen " * 50)
    cut = language.grams("Äpfel und Birnen " * 50, block=37)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 64))
    v = [*(b + rng.standard_normal(64) * 0.15 for b in base for _ in range(6)), *base, base[0], base[0], *(rng.standard_normal((200, 64)))]
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, 2.0]), (904, [None] + [1.0] * 63), (None, [float(x) for x in base[1]])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    m = np.array([e for _, e in rows] + [odd[-1][1]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T >= 0.9
    np.fill_diagonal(c, False)
    n = c.sum(axis=1)
    assert sum(got[i].n_links for i in range(len(rows))) >= 0.98 * n[:-1].sum() and all(got[i].n_links <= n[i] for i in range(len(rows)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905)) and None in got
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharding(docs, none):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill(names, 101)
    assert np.ptp(np.bincount(table)) <= 1
    moved = sum(a != b for a, b in zip(table, sharding.fill(names[:-1], 101)))
    assert moved < 50  # a seventh must move, and few others do
    out = sharding.place(docs, "doc_id", names, 101)
    assert sorted(out.columns) == sorted(docs.columns) and sharding.place(none, "doc_id", names, 101).count() == 0
    for r in out.collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == names[table[int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 101]]
    with pytest.raises(ValueError):
        sharding.fill(names, 100)


def test_chat(spark, sf):
    from pyspark.sql import functions as F

    sf = sf.replace("0.001", "0.01")
    raw = chat.transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    held = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0
    model = chat.fit(raw.filter(~held))
    want = {(r.conv_id, r.seq): (r.role, r.text) for r in raw.filter(held).join(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", F.col("turn").alias("seq"), "text"), ["conv_id", "seq"]).collect()}
    got = {(r.conv_id, r.seq): (r.role, r.text) for r in chat.parse(raw.filter(held).drop("role"), model).collect() if r.part == 0}
    assert sum(got[k][0] == want[k][0] for k in want if k in got) >= 0.97 * len(want)
    assert sum(got[k][1] == (want[k][1] or "").strip() for k in want if k in got) >= 0.96 * len(want)
    odd = spark.createDataFrame([(1, 0, None), (1, 1, "User: hi"), (2, 0, ""), (None, None, "Bot: x\nmore"), (3, 0, "### System:\nbe kind\n\nHuman: ok?\nAI: yes")], "conv_id long, seq long, raw string")
    rows = sorted(((r.conv_id or 0, r.role, r.text) for r in chat.parse(odd, model).collect()))
    assert (1, "user", "hi") in rows and (3, "user", "ok?") in rows and (3, "assistant", "yes") in rows and any(r[0] == 0 for r in rows)
    assert chat.parse(spark.createDataFrame([], "conv_id long, seq long, raw string"), model).count() == 0


def states(first, move):
    """A model whose lines show nothing but their marker, with given chances."""
    show = [np.zeros((chat.STATES, n)) for n in chat.SIZES]
    for s in range(chat.STATES):
        show[0][s, s // 2 + 1 if s % 2 == 0 else 0] = 50
    return chat.Model(np.array(first, float), np.array(move, float), show)


def test_text_stays_as_written(spark):
    later = np.full((6, 6), 1.0)
    for s in range(6):
        later[s, s // 2 * 2 + 1] = 1000  # a turn goes on, whatever its lines look like
    model = states([1, 0, 1, 0, 1, 0], later)
    raw = "Assistant: First step.\nA: keep this letter\n\n  indented code\n\n"
    df = spark.createDataFrame([(1, 0, raw), (1, 1, "\n  tail")], "conv_id long, seq long, raw string")
    rows = chat.parse(df, model).collect()
    text = "First step.\nA: keep this letter\n\n  indented code\n\n\n\n  tail"
    assert [(r.role, r.text, r.rendered) for r in rows] == [("assistant", text, f"<|assistant|>\n{text}\n<|end|>\n")]


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    model = chat.Model(rng.random(6) * 9, rng.random((6, 6)) * 9, [rng.random((6, n)) * 9 for n in chat.SIZES])
    for n in (1, 2, 4):
        lines = [tuple(int(rng.integers(k)) for k in chat.SIZES) for _ in range(n)]
        s = model.scores(lines)
        cost = lambda p: model.start[p[0]] + s[0, p[0]] + sum(model.move[a, b] + s[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))  # noqa: E731, B023
        best = max(product(range(6), repeat=n), key=cost)
        assert model.decode(s) == list(best)
        across = model.across(s)
        for a, b in product(range(6), repeat=2):
            ends = [p for p in product(range(6), repeat=n) if p[-1] == b]
            assert across[a, b] == pytest.approx(max(model.move[a, p[0]] + s[0, p[0]] + sum(model.move[x, y] + s[i + 1, y] for i, (x, y) in enumerate(zip(p, p[1:]))) for p in ends))


def test_chunks_change_nothing(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    raw = chat.transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    model = chat.fit(raw)
    # Blank lines at the ends of rows, rows of blank lines alone, and turns over many rows; then rows of one number.
    wild = F.concat("raw", F.when(F.col("seq") % 3 == 0, "\n\n").when(F.col("seq") % 5 == 0, "\n  more\n").otherwise(""))
    one = raw.select(F.lit(7).cast("long").alias("conv_id"), (F.col("conv_id") * 10 + F.col("seq")).alias("seq"), F.when(F.col("conv_id") % 4 == 0, "\n \n").when(F.col("conv_id") % 4 == 1, "plain words go on").otherwise(wild).alias("raw"))
    same = one.select(F.lit(None).cast("long").alias("conv_id"), F.when(F.col("seq") % 2 == 0, 5).cast("long").alias("seq"), F.concat("raw", F.col("seq").cast("string")).alias("raw"))
    for rows, cuts in ((one, (64, 3)), (same, (16,))):
        monkeypatch.setattr(chat, "CHUNK", 10**9)
        key = lambda r: (str(r.seq), r.role, r.text, r.rendered)
        whole = sorted(map(key, chat.parse(rows, model).collect()))
        for cut in cuts:
            monkeypatch.setattr(chat, "CHUNK", cut)
            assert sorted(map(key, chat.parse(rows, model).collect())) == whole


def test_pipeline(spark, sf, docs):
    from tessera.llm.common import stored

    now, real = docs, docs
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        now = real = df
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stored(stage(spark, now, sf), "t")
            if name != "best-fit packing":
                assert now.columns == real.columns
        assert now.select("doc_id").distinct().count() == before.select("doc_id").distinct().count() > 0
