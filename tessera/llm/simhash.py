"""SimHash near-dedup (operator 1) with deletion-variant signatures.

A fingerprint is cut into segments. With max_bits // 2 + 1 of them, two fingerprints that differ in at most max_bits
bits have a segment that differs in one bit at most; with fewer, this holds for most pairs and not for all. Each
segment is indexed once for each of its bits, with that bit as a wildcard; where the count of segments leaves no bit
for the last one, its plain value is enough. Fingerprints that share a key meet in one sorted run and are verified
by their number of differing bits. A pair counts only under the first key that it shares, so it is found once.

Only different fingerprints are indexed (copies are one entry), a run yields at most one link for each member (a
spanning forest), and components come from tessera.llm.graph. Long runs are compared block by block, whole.

Words and shingles as in shingle_hashes(). A null text is an empty one; texts without words have fingerprint 0.
Rows of a null doc_id get the component of the rows they equal, or null. Repeated rows are rows of one component. An
empty table gives an empty result.

kept_rows() serves the pipeline, where near copies are documents whose sets of shingles reach a Jaccard similarity.
Pairs found by deletion variants are candidates there, and exact similarities decide; see similar_components().
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import each_part, lean, parts, salt, stored, tidy
from tessera.llm.graph import components, merge_labels

WORD = 64
SEED = 42
#: Members of a run that are compared with each other at once.
BLOCK = 2048
#: Members of a long run that are compared with all others first.
PIVOTS = 32
#: Longer runs of documents of a leading shingle are indexed block by block, and so many members of them at once.
LONG = 64
LISTS = 1024


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text (A-Z in lower case, words between ASCII white space), in arrays of bounded size."""
    parts = text.lower().split()
    if not parts:
        return
    line = b" ".join(parts)
    if len(parts) <= words:
        yield np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
        return
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    a, b = (ends - sizes)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(a), 65_536):
        yield np.array([digest(line[i:j], seed) for i, j in zip(a[k : k + 65_536], b[k : k + 65_536])], np.uint64)


def _more(h: np.ndarray, word: int) -> np.ndarray:
    """Further bits of a hash: the hash itself for word 0."""
    for _ in range(word):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def fingerprint(text: bytes, words: int, bits: int = WORD, seed: int = SEED) -> list[int]:
    """Bit k is 1 if it is set in over half of the shingles' hashes; 64 bits to a number."""
    ones, n = np.zeros((bits // WORD, WORD), np.int64), 0
    for h in shingle_hashes(text, words, seed):
        for w in range(len(ones)):
            ones[w] += np.unpackbits(_more(h, w).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist() if n else [0] * len(ones)


def names(bits: int) -> list[str]:
    return [f"f{w}" for w in range(bits // WORD)]


def fingerprints(docs: DataFrame, words: int = 5, bits: int = WORD, seed: int = SEED) -> DataFrame:
    """doc_id, f0, f1, ...: the fingerprint's bits as signed longs."""

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
            fps = np.array([fingerprint(t.as_py(), words, bits, seed) for t in texts], np.uint64).reshape(-1, bits // WORD).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(fps[:, w].copy()) for w in range(bits // WORD))], ["doc_id", *names(bits)])

    return tidy(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long" + "".join(f", {f} long" for f in names(bits)))


def cuts(bits: int, segments: int, max_bits: int) -> list[tuple[int, int, int, bool]]:
    """(word, lowest bit, size, whether variants are needed) of each segment; none lies in two words."""
    per = -(-segments // (bits // WORD))
    out = []
    for w in range(bits // WORD):
        at = [WORD * i // per for i in range(per + 1)]
        out += [(w, a, b - a, True) for a, b in zip(at, at[1:])]
    if 2 * (len(out) - 1) >= max_bits:
        out[-1] = (*out[-1][:3], False)
    return out


def index(fps: DataFrame, segments: list[tuple[int, int, int, bool]], words: list[str]) -> DataFrame:
    """kind (which segment and wildcard), key, id and fingerprint of each variant of each fingerprint."""
    variants = []
    for word, low, size, wild in segments:
        segment = F.shiftrightunsigned(f"f{word}", low).bitwiseAND(F.lit((1 << size) - 1))
        for i in range(size if wild else 1):
            value = segment.bitwiseAND(F.lit(((1 << size) - 1) ^ (1 << i))) if wild else segment
            variants.append(F.struct(F.lit(len(variants)).alias("kind"), value.alias("key")))
    return fps.select("id", *words, F.explode(F.array(*variants)).alias("v")).select("v.kind", "v.key", "id", *words)


class Verify:
    """Whether a pair is close enough and belongs to the key under which it was met."""

    def __init__(self, segments: list[tuple[int, int, int, bool]], max_bits: int):
        self.max_bits, self.own, self.before, self.wild, self.first = max_bits, [], [], [], []
        seen: list[tuple[int, np.uint64]] = []
        for word, low, size, w in segments:
            mask = np.uint64(((1 << size) - 1) << low)
            for i in range(size if w else 1):
                self.own.append((word, mask))
                self.before.append(list(seen))
                self.wild.append(np.uint64((1 << low + i) if w else 0))
                self.first.append(i == 0)
            seen.append((word, mask))

    def __call__(self, kind: int, x: list[np.ndarray]) -> np.ndarray:
        """x: differing bits, an array for each word."""
        ok = sum(np.bitwise_count(w).astype(np.int16) for w in x) <= self.max_bits
        word, mask = self.own[kind]
        part = x[word] & mask
        ok &= (part == self.wild[kind]) | (part == 0) if self.first[kind] else part == self.wild[kind]
        for word, mask in self.before[kind]:
            if not ok.any():
                break
            ok &= np.bitwise_count(x[word] & mask) > 1
        return ok


def within(max_bits: int, x: list[np.ndarray]) -> np.ndarray:
    """Whether a pair is close enough, whatever key it was met under."""
    return sum(np.bitwise_count(w).astype(np.int16) for w in x) <= max_bits


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and how long it is."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def one_label(labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether all of a run have one label, for each run."""
    return np.maximum.reduceat(labels, starts) == np.minimum.reduceat(labels, starts)


def spanned(labels: np.ndarray, member: np.ndarray, key: np.ndarray, fp: np.ndarray, close: Callable) -> np.ndarray:
    """The labels once the close pairs of each run of equal keys belong together.

    member: which label and fingerprint each key is of. Runs that are one component already are passed over.
    """
    starts, size = runs(key)
    done = one_label(labels[member], starts)
    left = np.repeat(starts + size, size) - np.arange(len(key))  # members from here to the run's end
    short = np.repeat(~done & (size <= 256), size)
    at, k = np.flatnonzero(short & (left > 1)), 1
    while len(at):
        p, q = member[at], member[at + k]
        ok = close([fp[p, w] ^ fp[q, w] for w in range(fp.shape[1])])
        labels = merge_labels(labels, p[ok], q[ok])
        k += 1
        at = at[left[at] > k]
    long = ~done & (size > 256)
    for s, n in zip(starts[long].tolist(), size[long].tolist()):
        # Members that nothing has joined yet are compared with all, so that a group of copies soon is one component;
        # then blocks of members are, unless all of both belong together.
        run, tried = member[s : s + n], 0
        for _ in range(PIVOTS):
            while tried < n and labels[run[tried]] != run[tried]:
                tried += 1
            if tried == n:
                break
            x = run[close([fp[run, w] ^ fp[run[tried], w] for w in range(fp.shape[1])])]
            labels = merge_labels(labels, x, np.full(len(x), run[tried]))
            tried += 1
        run = run[np.argsort(labels[run], kind="stable")]
        for i in range(0, n, BLOCK):
            for j in range(i, n, BLOCK):
                p, q = run[i : i + BLOCK], run[j : j + BLOCK]
                if (labels[p] == labels[p[0]]).all() and (labels[q] == labels[p[0]]).all():
                    continue
                x, y = np.nonzero(close([fp[p, w][:, None] ^ fp[q, w][None, :] for w in range(fp.shape[1])]))
                labels = merge_labels(labels, p[x], q[y])
    return labels


def forest(kind: int, key: np.ndarray, ids: np.ndarray, fp: np.ndarray, verify: Verify) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the close pairs of whole runs of equal keys, of one kind."""
    labels = spanned(np.arange(len(key)), np.arange(len(key)), key, fp, functools.partial(verify, kind))
    out = np.flatnonzero(labels != np.arange(len(key)))
    return ids[out], ids[labels[out]]


def sharing(fp: np.ndarray, other: np.ndarray, segments: list[tuple[int, int, int, bool]]) -> np.ndarray:
    """Whether each of fp and each of the others share a deletion variant of one of the segments, which are short.

    The others are listed under each of their variants, as bits; each of fp takes the lists of its own.
    """
    out = np.zeros((len(fp), -(-len(other) // 8)), np.uint8)
    for word, low, width, wild in segments:
        mask, values = np.uint64((1 << width) - 1), np.arange(1 << width)
        plain = np.packbits((other[:, word] >> np.uint64(low) & mask) == values[:, None].astype(np.uint64), axis=1)
        lists = plain.copy()
        for i in range(width if wild else 0):  # without bit i, a value and the one that differs there are one variant
            lists |= plain[values ^ (1 << i)]
        out |= lists[(fp[:, word] >> np.uint64(low) & mask).astype(np.intp)]
    return np.unpackbits(out, axis=1, count=len(other)).astype(bool)


def variant_forest(kind: int, key: np.ndarray, ids: np.ndarray, fp: np.ndarray, segments: list[tuple[int, int, int, bool]], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the pairs of whole runs of equal keys that share a deletion variant and are close enough.

    Each run has an index of its own. Members of short runs meet under equal variants, of one segment and wildcard after
    the other; those of long runs, block by block, by lists of each variant's members, so that a pair is verified once.
    """
    starts, size = runs(key)
    several = np.repeat(size > 1, size)
    key, ids, fp = key[several], ids[several], fp[several]
    if not len(key):
        return ids, ids
    starts, size = runs(key)
    run = np.repeat(np.arange(len(starts)), size)
    labels = np.arange(len(key))
    long = (size > LONG) & (max(width for _, _, width, _ in segments) <= 8)
    for s, n in zip(starts[long].tolist(), size[long].tolist()):
        for i in range(s, s + n, LISTS):
            for j in range(i, s + n, LISTS):
                p, q = slice(i, min(i + LISTS, s + n)), slice(j, min(j + LISTS, s + n))
                if (labels[p] == labels[i]).all() and (labels[q] == labels[i]).all():
                    continue
                bits = np.zeros((p.stop - i, q.stop - j), np.int16)
                for w in range(fp.shape[1]):
                    bits += np.bitwise_count(fp[p, w][:, None] ^ fp[q, w][None, :])
                x, y = np.nonzero((bits <= max_bits) & sharing(fp[p], fp[q], segments))
                labels = merge_labels(labels, i + x, j + y)
    for word, low, width, wild in segments:
        at = np.flatnonzero(~(long | one_label(labels, starts))[run])
        if not len(at):
            break
        segment = fp[at, word] >> np.uint64(low) & np.uint64((1 << width) - 1)
        for i in range(width if wild else 1):
            value = segment & ~np.uint64(1 << i) if wild else segment
            if width > 32:
                value = np.unique(value, return_inverse=True)[1]
            variant = run[at] << min(width, 32) | value.astype(np.int64)
            order = np.argsort(variant, kind="stable")
            labels = spanned(labels, at[order], variant[order], fp, functools.partial(within, max_bits))
    out = np.flatnonzero(labels != np.arange(len(key)))
    return ids[out], ids[labels[out]]


def links(fps: DataFrame, bits: int, segments: int, max_bits: int) -> DataFrame:
    """a, b: ids whose fingerprints (id, f0, ...: all different) differ in at most max_bits bits, as spanning forests."""
    words = names(bits)
    parts = cuts(bits, segments, max_bits)
    return met(index(fps, parts, words), words, functools.partial(forest, verify=Verify(parts, max_bits)))


def met(rows: DataFrame, words: list[str], join: Callable, least: int = 1) -> DataFrame:
    """a, b: the links that `join` finds (as forest() does) over rows (kind, key, id, fingerprint) of equal keys.

    It is given whole runs of one kind: at least so many rows at a time, but for the last ones of a kind.
    """

    def run(batches):
        held: list[tuple] = []

        def flush():
            key, ids, fp = (np.concatenate(x) for x in zip(*(h[1:] for h in held)))
            a, b = join(held[0][0], key, ids, fp)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            kinds, key, ids = (batch.column(n).to_numpy() for n in ("kind", "key", "id"))
            fp = np.stack([batch.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                kind = int(kinds[a])
                # A run may go on in the next batch: only what precedes the last key is complete.
                many = sum(len(h[1]) for h in held) >= least
                if held and (held[-1][0] != kind or many and held[-1][1][-1] != key[a]):
                    yield flush()
                    held = []
                other = np.flatnonzero(key[a:b] != key[b - 1])
                c = a + (int(other[-1]) + 1 if len(other) else 0)
                if c > a:
                    held.append((kind, key[a:c], ids[a:c], fp[a:c]))
                    if sum(len(h[1]) for h in held) >= least:
                        yield flush()
                        held = []
                held.append((kind, key[c:b], ids[c:b], fp[c:b]))
        if held:
            yield flush()

    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(lean(run), "a long, b long")


def components_of(docs: DataFrame, words: int = 5, max_bits: int = 2, bits: int = WORD, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (hex digits), component_id: the smallest doc_id that links lead to."""
    fs = names(bits)
    own = stored(fingerprints(docs, words, bits), "fingerprints").withColumn("part", salt(F.col("doc_id")))
    # Rows of one fingerprint meet in parts first, and the component returns to them part by part.
    each = own.groupBy(*fs, "part").agg(F.min("doc_id").alias("id")).groupBy(*fs).agg(F.min("id").alias("id"), parts(F.col("part")).alias("bits"))
    each = stored(each, "different")
    tree = components(links(each.filter("id is not null"), bits, segments or max_bits // 2 + 1, max_bits))
    named = each.join(tree.withColumnsRenamed({"a": "id", "b": "top"}), "id", "left").select(*fs, "bits", F.coalesce("top", "id").alias("component_id"))
    digits = F.lower(F.concat(*(F.lpad(F.hex(f), 16, "0") for f in reversed(fs))))
    return own.join(each_part(named, "bits", "part"), [*fs, "part"]).select("doc_id", digits.alias("fingerprint"), "component_id")


#: Documents of a group of candidates that one task compares with each other, or with as many others.
DEALT = 256
#: Of a block, documents that speak for it: so many of each of its two largest components.
SPEAKERS = 4
#: Shingles of more documents than OFTEN, as estimated from a SHARE of the rows, come last in the order of shingles.
OFTEN = 4096
SHARE = 1 / 64
#: Shingles listed as such at most, the most frequent first: 8 bytes each.
LISTED = 1 << 18
#: Documents, by the same estimate, that are indexed at once at most because they share a leading shingle.
RUN = 1 << 16
#: Rows of leading shingles that are indexed by deletion variants at once, about.
HELD = 1 << 18
#: Columns of the 0/1 matrix of documents and shingles that are multiplied at once.
COLUMNS = 4096


def shingle_set(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The different shingle hashes of a text, ascending; that of nothing where there are no words."""
    found = [np.unique(h) for h in shingle_hashes(text, words, seed)]
    return np.unique(np.concatenate(found)) if found else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)


def majority(hashes: np.ndarray, bits: int) -> list[int]:
    """The fingerprint of a set of shingle hashes."""
    ones = np.zeros((bits // WORD, WORD), np.int64)
    for k in range(0, len(hashes), 65_536):
        for w in range(len(ones)):
            ones[w] += np.unpackbits(_more(hashes[k : k + 65_536], w).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def similar(shared, total, least: float):
    """Whether `shared` of `total` different shingles reach the similarity; 0.8 of 5 is 4, whatever floats say."""
    return shared >= least * total - 1e-9 * total


def leading(n: int, least: float) -> int:
    """How many of n shingles, in any order that all sets follow, must hold one that a similar set's leading ones hold."""
    return n - math.ceil(least * n - 1e-9 * n) + 1


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of very many documents, ascending, and of how many, as a sample of the rows tells."""

    def run(batches):
        held, size = [], 0

        def counted():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for t in pc.fill_null(batch.column("text").cast(pa.binary()), b""):
                held.append(shingle_set(t.as_py(), words))
                size += len(held[-1])
                if size > 1 << 20:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = tidy(docs, "text").sample(SHARE, seed=1).mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= max(2, OFTEN * SHARE)).orderBy(F.desc("n"), "h").limit(LISTED).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order] / SHARE


def sketches(docs: DataFrame, words: int, bits: int, least: float, listed: np.ndarray) -> DataFrame:
    """doc_id, digest of the shingle set, fingerprint of the set, leading shingles.

    Shingles are ordered by hash, but those listed, of very many documents, come last. The order is one for all documents, and
    any order will do; this one keeps a passage found everywhere from leading, and so from tying its documents together.
    """

    def in_order(h):
        if not len(listed):
            return h
        often = listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h
        return np.concatenate([h[~often], h[often]])

    def run(batches):
        for batch in batches:
            rows = []
            for t in pc.fill_null(batch.column("text").cast(pa.binary()), b""):
                h = shingle_set(t.as_py(), words)
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), majority(h, bits), in_order(h)[: leading(len(h), least)].view(np.int64)))
            fps = np.array([r[1] for r in rows], np.uint64).reshape(-1, bits // WORD).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.binary()), *(pa.array(fps[:, w].copy()) for w in range(bits // WORD)), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["doc_id", "digest", *names(bits), "lead"])

    return tidy(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, digest binary" + "".join(f", {f} long" for f in names(bits)) + ", lead array<long>")


def exact_forest(sets: list[np.ndarray], half: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the pairs of similar sets; with halves, only pairs across them count."""
    size = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(sets)), size), times[column] > 1
    row, column = row[often], (np.cumsum(times > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (np.arange(len(sets)),) * 2 if half is None else (np.flatnonzero(~half), np.flatnonzero(half))
    shared = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - c)), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        shared += (m[left] @ m[right].T).astype(np.int64)
    x, y = np.nonzero(similar(shared, size[left][:, None] + size[right][None] - shared, least))
    labels = merge_labels(np.arange(len(sets)), left[x], right[y])
    out = np.flatnonzero(labels != np.arange(len(sets)))
    return out, labels[out]


def _forests(rows: DataFrame, least: float) -> DataFrame:
    """a, b: links that span the similar pairs of each task (top, x, y) of rows (.., own, id, set).

    own: null to compare all with each other; else only pairs of different `own` count.
    """
    keys = ["top", "x", "y"]

    def run(batches):
        held, now = [], None

        def flush():
            ids = np.concatenate([h.column("id").to_numpy() for h in held])
            own = pa.concat_arrays([h.column("own") for h in held])
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for h in held for x in h.column("set")]
            half = None if own.null_count else own.to_numpy(zero_copy_only=False).astype(bool)
            if half is not None and (half.all() or not half.any()):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            a, b = exact_forest(sets, half, least)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

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

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a long, b long")


def _within_blocks(sets: DataFrame, least: float) -> DataFrame:
    """Links of documents (top, n, id, set) of one block of a group, n being the group's size."""
    return _forests(sets.select("top", _block().alias("x"), F.lit(0).alias("y"), F.lit(None).cast("boolean").alias("own"), "id", "set"), least)


def _block():
    return F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / DEALT)).cast("int")


def similar_links(docs: DataFrame, groups: DataFrame, words: int, least: float) -> DataFrame:
    """a, b: links that join what similar pairs of documents of one group (id, top) join.

    Documents of a block of a group are compared with each other. In a group of several blocks, a few documents of each
    block's largest components are compared next, in blocks again until one is left. Groups of near copies are mostly
    one component by then. All documents outside of a group's largest component are compared with all of the group, so
    no similar pair that would join anything is left out.
    """
    members = stored(groups.select("id", "top").unionByName(groups.select(F.col("top").alias("id"), "top").distinct()), "members")
    counts = stored(members.groupBy("top").agg(F.count("*").alias("n")), "groups")
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text")).join(members, "id").join(counts, "top").select("id", "text", "top", "n")

    def to_sets(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("top"), batch.column("n"), pa.array([shingle_set(t.as_py(), words).tobytes() for t in texts], pa.binary())], ["id", "top", "n", "set"])

    kinds = "id long, top long, n long, set binary"
    near = _within_blocks(texts.mapInArrow(lean(to_sets), kinds), least)
    if counts.filter(F.col("n") > DEALT).isEmpty():
        return near
    whole = stored(texts.filter(F.col("n") > DEALT).mapInArrow(lean(to_sets), kinds), "sets")
    speakers, found = whole, components(near)
    for _ in range(16):  # each turn leaves a small part; what it leaves undone, the last step does
        named = speakers.join(found.withColumnsRenamed({"a": "id", "b": "label"}), "id", "left").withColumns({"label": F.coalesce("label", "id"), "block": _block()})
        own = Window.partitionBy("top", "block", "label")
        sized = named.withColumn("size", F.count("*").over(own)).withColumn("turn", F.row_number().over(own.orderBy("id")))
        best = F.dense_rank().over(Window.partitionBy("top", "block").orderBy(F.desc("size"), "label"))
        chosen = stored(sized.withColumn("best", best).filter((F.col("best") <= 2) & (F.col("turn") <= SPEAKERS)).select("id", "top", "set"), "speakers")
        several = stored(chosen.groupBy("top").agg(F.count("*").alias("n")), "groups")
        speakers = chosen.join(several, "top").select("id", "top", "n", "set")
        found = components(found.unionByName(_within_blocks(speakers, least)))
        if several.filter(F.col("n") > DEALT).isEmpty():
            break
    labels = found.withColumnsRenamed({"a": "id", "b": "label"})
    named = stored(whole.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "named")
    sizes = named.groupBy("top", "label").agg(F.count("*").alias("k"))
    main = stored(sizes.groupBy("top").agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("others")).filter("others > 0"), "main")
    every = named.join(main, "top").withColumns({"blocks": F.ceil(F.col("others") / DEALT).cast("int"), "chunks": F.ceil(F.col("n") / DEALT).cast("int")})
    deal = lambda seed, by: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(by)).cast("int")
    all_of = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    rest = every.filter(F.col("label") != F.col("main")).select("top", deal(1, "blocks").alias("x"), all_of("chunks").alias("y"), F.lit(True).alias("own"), "id", "set")
    against = every.select("top", all_of("blocks").alias("x"), deal(2, "chunks").alias("y"), F.lit(False).alias("own"), "id", "set")
    return found.unionByName(_forests(rest.unionByName(against), least))


def apart(rows: DataFrame, hot: np.ndarray) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, id, ...) of other keys than the hot ones, and links (a, b) of all that share a hot key to the least id.

    Hot keys are LISTED at most, so they and their least ids are broadcast, and no task ever holds the rows of one.
    """
    if not len(hot):
        return rows, None
    keys = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot.view(np.int64).tolist()], "key long"))
    shared = rows.join(keys, "key").select("key", "id")
    least = shared.groupBy("key").agg(F.min("id").alias("b"))
    links = shared.join(F.broadcast(least), "key").select(F.col("id").alias("a"), "b").filter("a <> b").distinct()
    return rows.join(keys, "key", "left_anti"), links


def dealt(rows: DataFrame, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Rows (kind, key, id, ...) with those of hot keys dealt over new keys: any two of one hot key share a new one.

    counts: rows of each hot key, about or at most. They are cut in blocks of about RUN / 2, and every two blocks have a key.
    """
    rest, _ = apart(rows, hot)
    if not len(hot):
        return rest
    blocks = 2 * np.ceil(counts / RUN).astype(int)
    keys = rows.sparkSession.createDataFrame(list(zip(hot.view(np.int64).tolist(), blocks.tolist())), "key long, blocks int")
    own = rows.join(F.broadcast(keys), "key").withColumn("x", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    pairs = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("x <> y")
    return rest.unionByName(pairs.withColumn("key", F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y"))).select(rest.columns))


def similar_components(docs: DataFrame, words: int = 5, least: float = 0.8, bits: int = 256, max_bits: int = 84) -> DataFrame:
    """doc_id, component_id: components of the pairs whose sets of shingles reach the similarity (Jaccard) `least`.

    Candidates are pairs of fingerprints that share a deletion variant of one of max_bits // 2 + 1 segments and differ
    in at most max_bits bits; so many segments lose no such pair. At this radius a segment is 5 or 6 bits long, so a key
    is a variant and a leading shingle: similar sets share one of those (the first of theirs in the order of
    sketches()), so this loses no pair either. Groups of candidates are then compared shingle by shingle, all pairs, and
    only these pairs become links. A leading shingle of over RUN documents is dealt over several tasks, by pairs of
    blocks.
    """
    fs = names(bits)
    listed, counts = frequent(docs, words)
    own = stored(sketches(docs, words, bits, least, listed), "sketches")
    each = own.groupBy("digest").agg(F.min("doc_id").alias("id"), *(F.first(f).alias(f) for f in fs), F.first("lead").alias("lead"))
    rows = each.filter("id is not null").select(F.lit(0).alias("kind"), F.explode("lead").alias("key"), "id", *fs)
    rows = dealt(rows, listed[counts > RUN], counts[counts > RUN])
    segments = cuts(bits, max_bits // 2 + 1, max_bits)
    pairs = met(rows, fs, functools.partial(variant_forest, segments=segments, max_bits=max_bits), HELD)
    groups = components(pairs).withColumnsRenamed({"a": "id", "b": "top"})
    tree = components(similar_links(docs, groups, words, least)).withColumnsRenamed({"a": "id", "b": "top"})
    named = each.select("digest", "id").join(tree, "id", "left").select("digest", F.coalesce("top", "id").alias("component_id"))
    return own.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def kept_rows(docs: DataFrame, words: int = 5, least: float = 0.8, bits: int = 256, max_bits: int = 84) -> DataFrame:
    """The rows of docs, all columns, that are the smallest doc_id of their component of similar_components().

    Rows without doc_id stay.
    """
    near = similar_components(docs, words, least, bits, max_bits)
    gone = near.filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
