"""Language ID (operator 8): rank-order profiles.

A profile lists a language's letter n-grams (1 to 3 characters, words padded by one space, triples of two letters at
least) by falling frequency. A document's most frequent n-grams are ranked likewise, and the sum of the distances
between both ranks, an n-gram that the profile lacks counting as the profile's size, tells how far the document is from
a language. The nearest language wins, ties going to the name that sorts first.

Profiles are fitted on at most SAMPLE documents of each language (the bound is a parameter): those of least hash in
each of CLASSES classes by hash, an equal number from each. Every document is judged by its whole text. Characters
that aren't letters end words. Texts that are null or hold no letter give `und` with score 0. Rows whose lang is null
teach nothing. If no row can teach, all are `und`. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lean, stored, tidy

#: Documents of each language that a fit takes at most.
SAMPLE = 2000
#: Classes of doc_ids by hash; each gives an equal part of a language's sample.
CLASSES = 50
#: n-grams that a profile and a document's ranking hold.
RANKS = 400
#: Score below which a text that shares n-grams with a profile is of no language: random letters reach 0.24.
LEAST = 0.25
_CODE = 21  # bits of a character


class Letters:
    """Class of each code point, found once: its lower case if it is a letter, else 32."""

    def __init__(self):
        self.low = np.zeros(0x110000, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.low[points]
        if not out.all():
            for p in np.unique(points[out == 0]).tolist():
                c = chr(p)
                low = c.lower()
                self.low[p] = (ord(low) if len(low) == 1 else p) if unicodedata.category(c)[0] == "L" else 32
            out = self.low[points]
        return out


_letters = Letters()


def grams(text: str, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams, and their counts; whole text, in blocks that overlap by two characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(points), block):
        c = _letters(points[max(0, a - 2) : a + block]).astype(np.int64)
        skip = min(a, 2)
        lead = 2 - skip
        c = np.concatenate([np.full(lead, 32), c, np.full(1 if a + block >= len(points) else 0, 32)])
        one, two = c[2:], (c[1:-1] << _CODE) | c[2:]
        three = (c[:-2] << 2 * _CODE - 1) ^ two  # the first character's top bit is never set
        word = c != 32
        parts = (one[word[2:]], two[word[1:-1] | word[2:]], three[word[1:-1] & (word[:-2] | word[2:])] | np.int64(1 << 62))
        found.append(np.unique(np.concatenate([parts[0], parts[1], parts[2]]), return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = RANKS) -> np.ndarray:
    """Most frequent first; of equal counts the smaller code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))[:size]]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


class Profiles:
    """Out-of-place distances to all languages at once."""

    def __init__(self, table: dict[str, np.ndarray], size: int = RANKS):
        self.names, self.size = sorted(table), size
        self.codes = np.unique(np.concatenate([table[n] for n in self.names])) if table else np.zeros(0, np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, table[name]), j] = np.arange(len(table[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the share of the greatest distance that the nearest language saves."""
        if not has_letter(text) or not self.names:
            return "und", 0.0
        own = ranked(*grams(text), self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = len(self.codes) - 1
        at = np.where(self.codes[at] == own, at, len(self.codes))
        there = self.rank[at]
        far = np.where(there < 0, self.size, np.minimum(np.abs(there - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.size * len(own)))


def fold(doc_id):
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(labelled: DataFrame, sample: int = SAMPLE, size: int = RANKS) -> Profiles:
    """Profiles from text and lang, of at most `sample` documents of each language."""
    # Hash classes share the bound between them, so no task sees more than a class of a language and none a language.
    classes = max(1, min(CLASSES, sample))
    h = F.xxhash64("doc_id")
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang", h.alias("h"), F.pmod(h, F.lit(classes)).cast("int").alias("class"))
    least = Window.partitionBy("lang", "class").orderBy("h")
    bound = rows.select("lang", "class", "h").withColumn("r", F.row_number().over(least)).filter(F.col("r") <= sample // classes).groupBy("lang", "class").agg(F.max("h").alias("most"))
    chosen = rows.join(F.broadcast(bound), ["lang", "class"]).filter(F.col("h") <= F.col("most"))

    def run(batches):
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([f[1] for f in found]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    counts = chosen.select("text", "lang").mapInArrow(lean(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= size)
    table: dict[str, list] = {}
    for row in top.orderBy("lang", "r").collect():  # at most `size` rows of each language
        table.setdefault(row.lang, []).append(row.code)
    return Profiles({k: np.array(v, np.int64) for k, v in table.items()}, size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        judge = shared.value.judge
        for batch in batches:
            lang, score = zip(*(judge(t.as_py()) for t in batch.column("text"))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return tidy(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows of the held-out fold teach nothing."""
    out = F.coalesce(fold(F.col("doc_id")) == held_out, F.lit(False))
    profiles = fit(tidy(docs, "doc_id", "text", "lang").filter(~out))
    return predict(docs, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = LEAST, languages: set[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text is of a language, with `lang` as predicted (if there is such a column).

    Rejected are texts that are null or hold no letter, texts that share n-grams with the profiles and yet score below
    `least`, and texts of other languages than `languages` (None: all that were learned). A text that shares no n-gram
    with any profile is in a script that none of them knows: nothing speaks against it, it stays as `und` unless
    languages are named. Where no row can teach, all texts with a letter stay as `und`.
    """
    profiles = docs.sparkSession.sparkContext.broadcast(fit(tidy(docs, "doc_id", "text", "lang")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def verdict(known: Profiles, value: str | None) -> str | None:
        if not has_letter(value):
            return None
        found, score = known.judge(value)
        if not score:
            found = "und"
        elif score < least:
            return None
        return found if languages is None or found in languages else None

    def run(batches):
        known = profiles.value
        for batch in batches:
            found = [verdict(known, t) for t in batch.column(text).to_pylist()]
            cols = [pa.array([x or "" for x in found], batch.schema.field(i).type) if i == lang else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array([x is not None for x in found], pa.bool_()))

    return docs.toDF(*names).mapInArrow(lean(run), docs.toDF(*names).schema).toDF(*docs.columns)
