"""Suffix-array dedup (operator 6): hash-compared suffix sorting of the suffixes that can repeat.

A byte goes if a WIDTH-byte string over it also starts earlier (smaller doc_id, or earlier in the same document).
All suffixes of a large corpus can't be sorted in the room there is, so those that can't matter are ruled out first:

1. In each WIDTH-byte window the GRAM-byte string of least hash is the window's anchor (leftmost of equals). Grams
   that stand in very many different surroundings are passed over where the window has another. So the anchor follows
   from the window's bytes alone, and equal windows have equal anchors at equal places. Windows with one anchor are
   neighbours; their bytes together are the anchor's context.
2. Contexts of one anchor are sorted as suffixes. Two suffixes are compared by binary search for their common
   extension with prefix hashes, a logarithmic number of steps, in a mergesort of all groups at once. Of equal contexts
   all but the earliest go whole. This is done first in every slice of texts, so a passage in any number of documents
   reaches the next step once for each slice, and again where the slices' contexts of an anchor meet.
3. Where different contexts of an anchor are left, the suffixes of all their windows are sorted the same way, for each
   place of the anchor. Suffixes equal over WIDTH bytes lie side by side, earliest first; all but the first go.

Hashes only guide the sort: polynomials modulo a prime, over bases drawn at random for each run. What a sort yields
is read off its neighbours' bytes, which must be in order; if hashes ever collide, it starts anew with another base.
Anchors meet by hash too, but an anchor alone removes nothing.

Anchors of a bucket meet as a stream that holds one row for each different anchor. An anchor with more than GROUP
contexts is sorted in groups of that size first and the groups' survivors afterwards, so a passage in a large share of
all documents never meets in one task as a whole. Buckets follow the bytes of all texts, as a sample estimates them.

The list of grams to pass over is drawn from a sample, holds STOPS entries at most and is the same for all tasks. It
spreads a phrase found everywhere over the anchors around it, so no task sorts all of its contexts; windows without
any other gram lie within the phrase, where their contexts are equal. Any list, an empty one too, gives equal results.

A null text counts as empty. Texts shorter than WIDTH keep all bytes. A document is its doc_id and text: rows that
repeat both get one and the same result and aren't held against each other; of rows that repeat only the doc_id the
order is that of a hash of the text. A null doc_id comes before all others. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import secrets

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, short_batches, spans, stored

WIDTH = 100
GRAM = 32
#: Window starts that are handled at once; the place in a piece takes 22 bits beside a hash.
PIECE = 1 << 18
#: Bytes of texts whose contexts are sorted together before they are dealt out.
SLICE = 8 << 20
#: Bytes of a text that are sent as one row.
ROW = 16 << 20
#: Bytes of text for each bucket of anchors.
BUCKET = 4 << 20
#: Contexts of one anchor that meet at once.
GROUP = 8192
#: Rows of a bucket of anchors that are taken up at once.
TAKE = 1 << 18
#: A gram with more surroundings than STOP, as estimated from a SHARE of the rows, is an anchor only for want of others.
STOP = 8192
SHARE = 1 / 64
#: Grams listed as such at most, the most frequent first: 8 bytes each.
STOPS = 1 << 18
#: Bases that a run draws; the first two make anchors, all serve sorts in turn.
BASES = 8
_P = (1 << 31) - 1
_LAST = 128  # set beside an anchor's place in the last context of an anchor's first group

_ANCHOR = np.dtype([("id", "<i8"), ("mark", "<i8"), ("gram", "<u8"), ("a", "<i4"), ("off", "u1"), ("more", "u1")])
_WANT = np.dtype([*_ANCHOR.descr, ("part", "<u4")])
_GONE = np.dtype([("id", "<i8"), ("mark", "<i8"), ("lo", "<i8"), ("hi", "<i8")])
_SPAN = "doc_id long, mark long, lo long, hi long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number that is x modulo 2^31 - 1."""
    return (x & np.uint64(_P)) + (x >> np.uint64(31))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for any 64-bit x."""
    x = _fold(_fold(x))
    return np.minimum(x, x - np.uint64(_P))  # what is below zero wraps to a large number


def draw_bases() -> list[int]:
    return [secrets.randbelow(_P - 1000) + 500 for _ in range(BASES)]


@functools.lru_cache(12)
def _powers(base: int) -> np.ndarray:
    out = np.ones(PIECE + 1, np.uint64)
    n = 1
    while n <= PIECE:
        k = min(n, PIECE + 1 - n)
        out[n : n + k] = _mod(out[:k] * np.uint64(pow(base, n, _P)))
        n += k
    return out


class Prefixes:
    """Prefix polynomial hashes modulo a prime of a byte array."""

    def __init__(self, data: np.ndarray, base: int):
        self.base, self.h = base, np.zeros(len(data) + 1, np.uint32)
        up, down = _powers(base), _powers(pow(base, -1, _P))
        for a in range(0, len(data), PIECE):
            part = data[a : a + PIECE]
            total = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * down[1 : len(part) + 1])
            self.h[a + 1 : a + 1 + len(part)] = _mod(up[1 : len(part) + 1] * (_fold(total) + np.uint64(self.h[a])))

    def all(self, size: int) -> np.ndarray:
        """Hashes of the strings of this size at every place."""
        return _mod(self.h[size:] + np.uint64(4 * _P) - _fold(self.h[: len(self.h) - size] * np.uint64(pow(self.base, size, _P))))

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the strings of these places and sizes (PIECE at most)."""
        return _mod(self.h[at + size] + np.uint64(4 * _P) - _fold(self.h[at] * _powers(self.base)[size]))

    def equal(self, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        """Whether the strings of this size at i and j have one hash."""
        end = self.h[i + size].astype(np.int64) - self.h[j + size]
        start = self.h[i].astype(np.int64) - self.h[j]
        return (end - start * pow(self.base, size, _P)) % _P == 0


def _grams(part: np.ndarray, bases: list[int]) -> np.ndarray:
    """Hashes (62 bits, mixed) of the grams of a piece of text."""
    return _mix(Prefixes(part, bases[0]).all(GRAM) << np.uint64(31) | Prefixes(part, bases[1]).all(GRAM))


class Stops:
    """Which grams, given by their hashes, are on a list."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.unique(grams)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.grams >> np.uint64(44)] = True

    def find(self, g: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(g >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        return at[self.grams[place] == g[at]]


def anchors(part: np.ndarray, width: int, stops: Stops, bases: list[int], doc: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor of a run of bytes: its hash, first window start, the anchor's distance from it, windows - 1.

    doc: the document of each window start; whole: whether the window lies within it.
    """
    reach = width - GRAM + 1
    g = _grams(part, bases)
    low = np.uint64(22)
    m, s = (g >> low + np.uint64(1) << low) | np.arange(len(g), dtype=np.uint64), 1
    m[stops.find(g)] |= np.uint64(1 << 63)
    while 2 * s <= reach:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < reach:
        m = np.minimum(m[: len(m) - (reach - s)], m[reach - s :])
    place = (m & np.uint64((1 << 22) - 1)).astype(np.int64)
    a = np.concatenate([[0], np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0) | (whole[1:] != whole[:-1])) + 1])
    more = np.diff(a, append=len(place)) - 1
    a, more = a[whole[a]], more[whole[a]]
    p = place[a]
    return g[p], a, p - a, more


def _surroundings(width: int, bases: list[int]):
    """text -> (gram, n): grams that stand in n > 1 different surroundings (all windows over them) of a run of texts.

    A row without gram tells the bytes of a task's texts.
    """

    def count(held):
        gram, around = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((around, gram))
        gram, around = gram[order], around[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])])
        gram, n = np.unique(gram[new], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["gram", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                size += len(data)
                for c in range(0, len(data) - width + 1, PIECE):
                    part = data[c : c + PIECE]
                    if len(part) < width:
                        continue
                    at = np.arange(len(part) - GRAM + 1)
                    lo = np.maximum(at - (width - GRAM), 0)
                    held.append((_grams(part, bases), Prefixes(part, bases[2]).of(lo, np.minimum(at + width, len(part)) - lo)))
                    if sum(len(g) for g, _ in held) > PIECE:
                        yield count(held)
                        held = []
        if held:
            yield count(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([size])], ["gram", "n"])

    return run


def frequent(short: DataFrame, width: int, bases: list[int]) -> tuple[np.ndarray, int]:
    """From a sample of the rows: the grams to pass over, at most STOPS, and about how many bytes all texts have."""
    counts = short.select("text").sample(SHARE, seed=6).mapInArrow(lean(_surroundings(width, bases)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("gram").isNull() | (F.col("n") >= max(2, STOP * SHARE))).orderBy(F.col("gram").isNull().desc(), F.desc("n"), "gram").limit(STOPS + 1).collect()
    size = sum(r.n for r in rows if r.gram is None) / SHARE
    return np.array([r.gram for r in rows if r.gram is not None], np.int64).view(np.uint64), int(size)


def common_extension(h: Prefixes, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length, size at most, over which the suffixes at i and j are equal, by binary search over hashes."""
    out = np.zeros(len(i), np.int64)
    step = 1 << (int(size.max(initial=1)).bit_length() - 1)
    while step:
        can = np.flatnonzero(out + step <= size)
        at = out[can]
        out[can[h.equal(i[can] + at, j[can] + at, step)]] += step
        step >>= 1
    return out


def sort_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """Order of the suffixes at[..] by (group, first `size` bytes, place in the list): a bottom-up mergesort of all
    groups at once. In a group all sizes are one."""
    h = Prefixes(data, base)

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        common = common_extension(h, at[i], at[j], size[i])
        x, y = np.minimum(at[i] + common, len(data) - 1), np.minimum(at[j] + common, len(data) - 1)
        return np.where(common < size[i], data[x] < data[y], i < j)

    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    count = np.repeat(sizes, sizes)
    run = 1
    while len(sizes) and run < sizes.max():
        own = np.arange(len(order)) - first
        k = np.flatnonzero(count > run)
        mine = own[k] // run
        lo = np.minimum((mine ^ 1) * run, count[k])
        hi = np.minimum(lo + run, count[k])
        pair = first[k] + (mine & ~1) * run
        begin, lo, hi = first[k] + lo, first[k] + lo, first[k] + hi
        # How many of the neighbouring run come before each suffix.
        todo = np.arange(len(k))
        while len(todo := todo[lo[todo] < hi[todo]]):
            mid = (lo[todo] + hi[todo]) // 2
            before = less(order[mid], order[k[todo]])
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
        merged = order.copy()
        merged[pair + own[k] % run + lo - begin] = order[k]
        order, run = merged, run * 2
    return order


def compare(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Sign of the comparison of the strings at x and y, byte by byte; sizes are width to 2 * width."""
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    out = np.zeros(len(x), np.int8)
    for c in range(0, len(x), 20_000):
        for tail in (False, True):  # the first width bytes, then the last
            k = np.arange(c, min(c + 20_000, len(x)))
            if tail:
                k = k[(out[k] == 0) & (size[k] > width)]
            skip = size[k] - width if tail else 0
            a, b = view[x[k] + skip], view[y[k] + skip]
            other = a != b
            at = other.argmax(axis=1)
            row = np.flatnonzero(other[np.arange(len(k)), at]) if len(k) else k
            out[k[row]] = np.where(a[row, at[row]] < b[row, at[row]], -1, 1)
    return out


def repeats(data: np.ndarray, at: np.ndarray, group: np.ndarray, size: np.ndarray, width: int, bases: list[int]) -> np.ndarray:
    """Which of the strings (place, size) have an equal one before them in the list, in their group: sorted as
    suffixes, and read off neighbours by their bytes."""
    out = np.zeros(len(at), bool)
    # A string whose hash is alone in its group equals no other: only the rest is sorted.
    _, group = np.unique(group, return_inverse=True)
    same = group.astype(np.uint64) << np.uint64(31) | Prefixes(data, bases[-1]).of(at, size)
    _, same, times = np.unique(same, return_inverse=True, return_counts=True)
    k = np.flatnonzero(times[same] > 1)
    if not len(k):
        return out
    at, size = at[k], size[k]
    _, group = np.unique(group[k], return_inverse=True)
    for base in bases:
        order = sort_suffixes(data, at, group, size, base)
        x, y = order[:-1], order[1:]
        side = group[x] == group[y]
        x, y = x[side], y[side]
        sign = compare(data, at[x], at[y], size[x], width)
        if (sign <= 0).all():
            out[k[y[sign == 0]]] = True
            return out
    raise ValueError("hashes collide under every base")


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, lo, hi) of the unions of spans that touch; doc: small whole numbers."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    far = np.maximum.accumulate((doc.astype(np.int64) << 32) + hi)
    new = np.concatenate([[True], (doc[1:].astype(np.int64) << 32) + lo[1:] > far[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], lo[new], far[last] - (doc[new].astype(np.int64) << 32)


def _dealt(rows: np.ndarray, key: np.ndarray, kind: int) -> pa.RecordBatch:
    """(key, kind, blob): the rows of each key as one blob."""
    order = np.argsort(key, kind="stable")
    key, raw = key[order], rows[order].tobytes()
    cut = np.flatnonzero(np.diff(key)) + 1
    ends = np.concatenate([[0], cut, [len(key)]]).astype(np.int32) * rows.dtype.itemsize
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(key[np.concatenate([[0], cut])].astype(np.int32)), pa.array(np.full(len(ends) - 1, kind, np.int32)), blobs], ["key", "kind", "blob"])


_BLOB = "key int, kind int, blob binary"
_SETTLED, _OPEN = 0, 1  # kinds of blobs: spans that go, and anchors


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers or a few more, equally many of which Spark's hash deals to each partition of a shuffle."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each, size = -(-n // parts), 4 * n + 64 * parts
    while True:
        key = F.col("id").cast("int")
        rows = spark.range(size).select(key.alias("key"), F.pmod(F.hash(key), F.lit(parts)).alias("part")).toArrow()
        key, part = rows["key"].to_numpy(), rows["part"].to_numpy()
        order = np.lexsort((key, part))
        rank = np.arange(size) - np.searchsorted(part[order], part[order])
        if (rank < each).sum() == each * parts:
            return np.sort(key[order[rank < each]]).astype(np.int32)
        size *= 2


def _bucket(gram: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return ((gram >> np.uint64(20)) % np.uint64(len(buckets))).astype(np.int64)


def _home(ids: np.ndarray, marks: np.ndarray, piece: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The key under which a row of text meets what is wanted of it."""
    return buckets[(_mix(_mix(ids.view(np.uint64)) ^ marks.view(np.uint64) + piece.astype(np.uint64)) % np.uint64(len(buckets))).astype(np.int64)]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array without nulls, and where its texts start (and the last ends)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    starts = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)), starts.astype(np.int64)


def _scan(width: int, buckets: np.ndarray, listed: np.ndarray, bases: list[int]):
    """documents (doc_id, mark, text) -> blobs of spans that go and of the anchors that are left of each slice."""

    def flush(data, starts, ids, marks, rank, held):
        doc, at, gram, off, more = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(rank[doc], kind="stable")  # by documents and places, so of equal contexts the earliest comes first
        doc, at, gram, off, more = (x[order] for x in (doc, at, gram, off, more))
        a, size = at - starts[doc], more + width
        order = np.lexsort((off << 8 | more, gram))
        new = np.concatenate([[True], (np.diff(gram[order]) != 0) | (np.diff((off << 8 | more)[order]) != 0)])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        k = np.flatnonzero(np.bincount(group)[group] > 1)
        gone = np.zeros(len(doc), bool)
        if len(k):
            small = data[spans(at[k], size[k])]
            gone[k] = repeats(small, np.cumsum(size[k]) - size[k], group[k], size[k], width, bases)
        if gone.any():
            r, lo, hi = merged(rank[doc[gone]], a[gone], a[gone] + size[gone])
            d = np.argsort(rank)[r]
            out = np.empty(len(d), _GONE)
            out["id"], out["mark"], out["lo"], out["hi"] = ids[d], marks[d], lo, hi
            yield _dealt(out, np.full(len(d), buckets[int(gram[0]) % len(buckets)]), _SETTLED)
        left = ~gone
        out = np.empty(int(left.sum()), _ANCHOR)
        out["id"], out["mark"], out["gram"], out["a"], out["off"], out["more"] = ids[doc[left]], marks[doc[left]], gram[left], a[left], off[left], more[left]
        yield _dealt(out, buckets[_bucket(out["gram"], buckets)], _OPEN)

    def run(batches):
        stops = Stops(listed)
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            data, starts = _texts(batch.column("text"))
            order = np.lexsort((marks, ids))
            rank = np.argsort(order)
            # Rows that repeat a document count once.
            same = (np.diff(ids[order]) == 0) & (np.diff(marks[order]) == 0)
            again = np.zeros(len(ids), bool)
            again[order[1:][same]] = True
            held, size = [], 0
            for c in range(int(starts[0]), int(starts[-1]) - width + 1, PIECE):
                at = np.arange(c, min(c + PIECE, starts[-1] - width + 1))
                first = np.searchsorted(starts, c, "right") - 1
                last = np.searchsorted(starts, at[-1], "right") - 1
                doc = np.repeat(np.arange(first, last + 1), np.diff(np.concatenate([[c], starts[first + 1 : last + 1], [at[-1] + 1]])))
                whole = (at + width <= starts[doc + 1]) & ~again[doc]
                if whole.any():
                    gram, a, off, more = anchors(data[c : at[-1] + width], width, stops, bases, doc, whole)
                    held.append((doc[a], a + c, gram, off, more))
                    size += len(at)
                if size > SLICE:
                    yield from flush(data, starts, ids, marks, rank, held)
                    held, size = [], 0
            if held:
                yield from flush(data, starts, ids, marks, rank, held)

    return run


def _by_key(batches, columns: list[str]):
    """(key, rows of `columns` as lists) of each run of equal keys in sorted batches; a run may come in parts."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cut, cut[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                yield int(keys[a]), [part.column(c) for c in columns]


def _meet(buckets: np.ndarray):
    """Blobs of each bucket in turn -> the spans as they are, and the anchors seen more than once, dealt by document."""

    class Seen:
        def __init__(self):
            self.gram, self.n, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, _ANCHOR)

        def take(self, rows: np.ndarray) -> np.ndarray:
            """What is known by now to be wanted: rows whose anchor came before or comes again among them."""
            rows = rows[np.argsort(rows["gram"], kind="stable")]
            gram, first, n = np.unique(rows["gram"], return_index=True, return_counts=True)
            place = np.minimum(np.searchsorted(self.gram, gram), max(len(self.gram) - 1, 0))
            known = self.gram[place] == gram if len(self.gram) else np.zeros(len(gram), bool)
            before = np.where(known, self.n[place], 0) if len(self.gram) else np.zeros(len(gram), np.int64)
            rank = np.arange(len(rows)) - np.repeat(first, n) + np.repeat(before, n)
            chosen = np.repeat(before + n > 1, n)
            late = place[before == 1] if len(self.gram) else np.zeros(0, np.int64)
            out = np.zeros(int(chosen.sum()) + len(late), _WANT)
            for c in _ANCHOR.names:
                out[c] = np.concatenate([rows[c][chosen], self.first[c][late]])
            rank = np.concatenate([rank[chosen], np.zeros(len(late), np.int64)])
            out["part"] = rank // GROUP
            out["off"] |= np.where(rank == GROUP - 1, _LAST, 0).astype(np.uint8)
            if len(self.gram):
                self.n[place[known]] += n[known]
            both = np.concatenate([self.gram, gram[~known]])
            order = np.argsort(both, kind="stable")
            self.gram, self.n = both[order], np.concatenate([self.n, n[~known]])[order]
            self.first = np.concatenate([self.first, rows[first[~known]]])[order]
            return out

    def run(batches):
        now, seen, held = None, Seen(), []

        def taken():
            out = seen.take(np.concatenate(held))
            if len(out):
                yield _dealt(out, _home(out["id"].copy(), out["mark"].copy(), out["a"] // ROW, buckets), _OPEN)

        for key, (kinds, blobs) in _by_key(batches, ["kind", "blob"]):
            if key != now:
                if held:
                    yield from taken()
                now, seen, held = key, Seen(), []
            gone = kinds.to_numpy() == _SETTLED
            if gone.any():
                n = int(gone.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key, np.int32)), pa.array(np.zeros(n, np.int32)), blobs.filter(pa.array(gone))], ["key", "kind", "blob"])
            held += [np.frombuffer(b.as_buffer(), _ANCHOR) for b, g in zip(blobs, gone) if not g]
            if sum(map(len, held)) > TAKE:
                yield from taken()
                held = []
        if held:
            yield from taken()

    return run


def _fetch(width: int, buckets: np.ndarray):
    """What is wanted and rows of text, by key -> (key, team, blob): contexts with their bytes, by bucket and group."""

    def flush(held):
        rows, size, data = (np.concatenate(x) for x in zip(*held))
        start = np.cumsum(size) - size
        team = _bucket(rows["gram"], buckets) << 32 | rows["part"].astype(np.int64)
        order = np.argsort(team, kind="stable")
        rows, size, start, team = rows[order], size[order], start[order], team[order]
        cut = [0, *(np.flatnonzero(np.diff(team)) + 1).tolist(), len(rows)]
        squeeze = zstandard.ZstdCompressor(1).compress
        blobs = [squeeze(np.int32(b - a).tobytes() + rows[a:b].tobytes() + data[spans(start[a:b], size[a:b])].tobytes()) for a, b in zip(cut, cut[1:])]
        team = team[cut[:-1]]
        key = buckets[((team >> 32) + 7919 * (team & 0xFFFFFFFF)) % len(buckets)]  # further groups of an anchor lie elsewhere
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(team), pa.array(blobs, pa.binary())], ["key", "team", "blob"])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        now, wanted, place, held, size = None, [], None, [], 0
        for key, (blobs, ids, marks, pieces, packed) in _by_key(batches, ["blob", "doc_id", "mark", "piece", "packed"]):
            if key != now:
                now, wanted, place = key, [], None
            for i in range(len(blobs)):
                if blobs[i].is_valid:
                    wanted.append(np.frombuffer(blobs[i].as_buffer(), _WANT))
                    continue
                if place is None:
                    place = {}
                    if wanted:
                        rows = np.concatenate(wanted)
                        # A repeated document has come several times: its first rows stand for all.
                        order = np.lexsort((rows["part"], ~(rows["off"] & _LAST), rows["a"], rows["mark"], rows["id"]))
                        rows = rows[order]
                        same = (np.diff(rows["id"]) == 0) & (np.diff(rows["mark"]) == 0) & (np.diff(rows["a"]) == 0)
                        rows = rows[np.concatenate([[True], ~same])]
                        piece = rows["a"] // ROW
                        cut = [0, *(np.flatnonzero((np.diff(rows["id"]) != 0) | (np.diff(rows["mark"]) != 0) | (np.diff(piece) != 0)) + 1).tolist(), len(rows)]
                        place = {(int(rows["id"][a]), int(rows["mark"][a]), int(piece[a])): rows[a:b] for a, b in zip(cut, cut[1:])}
                which = ids[i].as_py(), marks[i].as_py(), pieces[i].as_py()
                own = place.pop(which, None)
                if own is None:
                    continue
                text = np.frombuffer(unpack(packed[i].as_py()), np.uint8)
                n = own["more"].astype(np.int64) + width
                held.append((own, n, text[spans(own["a"].astype(np.int64) - which[2] * ROW, n)]))
                size += len(held[-1][2])
                if size > SLICE:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


_SORTED = f"{_SPAN}, team long, blob binary"


def _sort(width: int, bases: list[int], last: bool):
    """(key, team, blob) in order -> spans that go, and blobs of what is left of anchors with several groups."""

    def spans_of(rows, lo, hi):
        other = (np.diff(rows["id"]) != 0) | (np.diff(rows["mark"]) != 0)  # the rows lie in order of documents
        one = np.concatenate([[0], np.flatnonzero(other) + 1])
        d, lo, hi = merged(np.concatenate([[0], np.cumsum(other)]), lo, hi)
        n = len(d)
        return pa.RecordBatch.from_arrays([pa.array(rows["id"][one[d]]), pa.array(rows["mark"][one[d]]), pa.array(lo), pa.array(hi), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["doc_id", "mark", "lo", "hi", "team", "blob"])

    def settle(team, blobs):
        unpack = zstandard.ZstdDecompressor().decompress
        rows, data = [], []
        for b in blobs:
            raw = unpack(b)
            n = int(np.frombuffer(raw, np.int32, 1)[0])
            rows.append(np.frombuffer(raw, _WANT, n, 4))
            data.append(np.frombuffer(raw, np.uint8, offset=4 + n * _WANT.itemsize))
        rows, data = np.concatenate(rows), np.concatenate(data)
        size = rows["more"].astype(np.int64) + width
        start = np.cumsum(size) - size
        order = np.lexsort((rows["a"], rows["mark"], rows["id"]))
        rows, size, start = rows[order], size[order], start[order]
        off = (rows["off"] & ~np.uint8(_LAST)).astype(np.int64)
        _, gram = np.unique(rows["gram"], return_inverse=True)
        gone = repeats(data, start, (gram << 16) + (off << 8) + rows["more"], size, width, bases)
        if gone.any():
            a = rows["a"][gone].astype(np.int64)
            yield spans_of(rows[gone], a, a + size[gone])
        left = ~gone
        if not last:
            # Anchors with other groups go on to meet them; their windows are sorted there.
            open_ = np.bincount(gram, (rows["off"] & _LAST) > 0)[gram] > 0 if not team & 0xFFFFFFFF else np.ones(len(rows), bool)
            k = np.flatnonzero(open_ & left)
            if len(k):
                blob = zstandard.ZstdCompressor(1).compress(np.int32(len(k)).tobytes() + rows[k].tobytes() + data[spans(start[k], size[k])].tobytes())
                one = [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*one, pa.array([team >> 32 << 32], pa.int64()), pa.array([blob], pa.binary())], ["doc_id", "mark", "lo", "hi", "team", "blob"])
            left &= ~open_
        left &= np.bincount(gram[left], minlength=gram.max(initial=0) + 1)[gram] > 1
        k = np.flatnonzero(left)
        if not len(k):
            return
        # All windows of the contexts; equal ones have their anchor at an equal distance.
        of = np.repeat(k, rows["more"][k].astype(np.int64) + 1)
        step = spans(np.zeros(len(k), np.int64), rows["more"][k].astype(np.int64) + 1)
        gone = repeats(data, start[of] + step, (gram[of] << 8) + off[of] - step, np.full(len(of), width), width, bases)
        if gone.any():
            lo = rows["a"][of[gone]] + step[gone]
            yield spans_of(rows[of[gone]], lo, lo + width)

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for team, blob in zip(batch.column("team").to_pylist(), batch.column("blob")):
                if team != now:
                    if blobs:
                        yield from settle(now, blobs)
                    now, blobs = team, []
                blobs.append(blob.as_buffer())
        if blobs:
            yield from settle(now, blobs)

    return run


def _marked(docs: DataFrame) -> DataFrame:
    """The rows with __id and __mark, which together tell documents apart."""
    short_batches(docs.sparkSession)
    return docs.withColumns({"__id": F.coalesce(docs["doc_id"], F.lit(-(2**63))), "__mark": F.xxhash64(F.coalesce(docs["text"], F.lit("")))})


def _expand(batches):
    """Blobs of spans -> a row for each span."""
    for batch in batches:
        for blob in batch.column("blob"):
            rows = np.frombuffer(blob.as_buffer(), _GONE)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].copy()) for c in _GONE.names], ["doc_id", "mark", "lo", "hi"])


def _rows_of_text(width: int, buckets: np.ndarray):
    """(doc_id, mark, text) -> rows of at most ROW bytes and what follows of a context, compressed, with their bucket."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            data, starts = _texts(batch.column("text"))
            at = [(i, p) for i in range(len(ids)) for p in range(-(-max(0, starts[i + 1] - starts[i] - width + 1) // ROW))]
            if not at:
                continue
            i, p = (np.array(x, np.int64) for x in zip(*at))
            lo = starts[i] + p * ROW
            hi = np.minimum(lo + ROW + 2 * width, starts[i + 1])
            packed = pa.array([squeeze(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_home(ids[i], marks[i], p, buckets)), pa.array(ids[i]), pa.array(marks[i]), pa.array(p), packed], ["key", "doc_id", "mark", "piece", "packed"])

    return run


def spans_to_remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark and the sorted spans (lo, hi) of bytes that go, for each document with any."""
    spark = docs.sparkSession
    short = _marked(docs).select(F.col("__id").alias("doc_id"), F.col("__mark").alias("mark"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bases = draw_bases()
    listed, size = frequent(short, width, bases)
    buckets = even_keys(spark, size // BUCKET + 1)
    found = short.mapInArrow(lean(_scan(width, buckets, listed, bases)), _BLOB)
    met = stored(found.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_meet(buckets)), _BLOB), "anchors")
    wanted = met.filter(F.col("kind") == _OPEN).select("key", "blob")
    texts = short.mapInArrow(lean(_rows_of_text(width, buckets)), "key int, doc_id long, mark long, piece long, packed binary")
    # What is wanted of a bucket's documents comes before their texts.
    both = wanted.unionByName(texts, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", F.col("blob").isNull(), "doc_id")
    contexts = both.mapInArrow(lean(_fetch(width, buckets)), "key int, team long, blob binary").repartition("key").sortWithinPartitions("team")
    first = stored(contexts.mapInArrow(lean(_sort(width, bases, False)), _SORTED), "sorted")
    rest = first.filter("blob is not null").select("team", "blob").repartition("team").sortWithinPartitions("team")
    second = rest.mapInArrow(lean(_sort(width, bases, True)), _SORTED).select("doc_id", "mark", "lo", "hi")
    settled = met.filter(F.col("kind") == _SETTLED).select("blob").mapInArrow(lean(_expand), _SPAN)
    every = settled.unionByName(first.filter("blob is null").select("doc_id", "mark", "lo", "hi")).unionByName(second)
    return every.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def _merged(found: pa.StructArray | None) -> list[tuple[int, int]]:
    if found is None or not len(found):
        return []
    lo, hi = found.field("lo").to_numpy(), np.maximum.accumulate(found.field("hi").to_numpy())
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return list(zip(lo[new].tolist(), hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])].tolist()))


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    short = _marked(docs).select(docs["doc_id"].alias("own"), F.col("__id").alias("doc_id"), F.col("__mark").alias("mark"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sizes = short.select("own", "doc_id", "mark", "text")

    def squeeze_rows(batches):
        squeeze = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("own", "doc_id", "mark")] + [pa.array([squeeze(t.as_buffer()) for t in batch.column("text")], pa.binary())], ["own", "doc_id", "mark", "packed"])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = unpack(batch.column("packed")[i].as_py())
                cuts = _merged(batch.column("spans")[i].values)
                digest, at = hashlib.sha256(), 0
                for lo, hi in cuts:
                    digest.update(text[at:lo])
                    at = hi
                digest.update(text[at:])
                out.append((len(text), sum(hi - lo for lo, hi in cuts), len(cuts), digest.hexdigest()))
            n, gone, count, sha = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = sizes.mapInArrow(lean(squeeze_rows), "own long, doc_id long, mark long, packed binary")
    return rows.join(spans_to_remove(docs, width), ["doc_id", "mark"], "left").select("own", "packed", "spans").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs with shortened texts, all columns: of a span only whole characters go. Null texts stay null."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                value = batch.column("__text")[i]
                if not value.is_valid or not len(cuts := _merged(batch.column("__spans")[i].values)):
                    out.append(value.as_py())
                    continue
                text, parts, at = value.as_py().encode(), [], 0
                for lo, hi in cuts:
                    while lo < hi and text[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
                        hi -= 1
                    parts.append(text[at:lo])
                    at = hi
                out.append(b"".join([*parts, text[at:]]).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__c{i}") for i in range(n_cols)), pa.array(out, pa.string())], [*(f"__c{i}" for i in range(n_cols)), "__text"])

    others = [c for c in docs.columns if c != "text"]
    n_cols = len(others)
    rows = _marked(docs).select(*(docs[c].alias(f"__c{i}") for i, c in enumerate(others)), docs["text"].alias("__text"), F.col("__id").alias("doc_id"), F.col("__mark").alias("mark"))
    joined = rows.join(spans_to_remove(docs, width).withColumnRenamed("spans", "__spans"), ["doc_id", "mark"], "left").drop("doc_id", "mark")
    kinds = joined.drop("__spans").select(*(f"__c{i}" for i in range(n_cols)), "__text").schema
    out = joined.mapInArrow(lean(run), kinds)
    return out.select(*((F.col("__text") if c == "text" else F.col(f"__c{others.index(c)}")).alias(c) for c in docs.columns))
