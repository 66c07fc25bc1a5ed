"""Exact dedup (operator 9): skew-safe combining, by DataFrame functions alone.

Rows meet in three steps, and every step groups by digest and by the whole text, so texts that differ never merge:
each task merges its own rows before the shuffle, rows of one digest are then merged in SALTS salted groups, and the
salts' winners are merged at last. A group of any size therefore reaches the last step as SALTS rows at most.
Verdicts return to the rows the same way, to each salted group by digest and salt, so a group of any size is dealt
over SALTS tasks there as well; should two texts ever share a digest, their rows are joined by the text too.

Null texts count as empty. Of equal texts the largest doc_id stays (a null doc_id is the smallest). Rows that repeat
text and doc_id are one document: each of them bears kept = true in dedup(), and kept_rows() returns one of them.
An empty table gives an empty result. Columns other than doc_id and text aren't touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import each_part, parts, salt, stored


def _text(docs: DataFrame, normalise):
    text = F.coalesce(docs["text"], F.lit(""))
    return normalise(text) if normalise else text


def _digest(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _prepared(docs: DataFrame, normalise) -> DataFrame:
    return docs.select(docs["doc_id"], _text(docs, normalise).alias("text")).select("doc_id", "text", _digest(F.col("text")).alias("digest"))


def winners(docs: DataFrame, normalise=None) -> DataFrame:
    """digest, text, keep_id, group_size and salts (bits) for each different text."""
    salted = _prepared(docs, normalise).groupBy("digest", salt(F.col("doc_id")).alias("salt"), "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), parts(F.col("salt")).alias("salts"))


def dedup(docs: DataFrame, normalise=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; normalise: a Column to Column function or None."""

    def out(df):
        return df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    rows, best = _prepared(docs, normalise).withColumn("salt", salt(F.col("doc_id"))), winners(docs, normalise)
    verdicts = stored(best.drop("text"), "winners")
    clash = verdicts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    keys = ["digest", "salt"]
    if clash.isEmpty():
        return out(rows.drop("text").join(each_part(verdicts, "salts", "salt"), keys))
    # Different texts of one digest: all of their rows are told apart by the text itself.
    plain = rows.drop("text").join(each_part(verdicts.join(clash, "digest", "left_anti"), "salts", "salt"), keys)
    rest = each_part(best.join(clash, "digest"), "salts", "salt")
    return out(plain).unionByName(out(rows.join(rest, [*keys, "text"])))


def kept_rows(docs: DataFrame, normalise=None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    others = F.struct(F.lit(0).alias("none"), *(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text" or normalise), docs["text"].isNull().alias("null"))
    rows = docs.select(others.alias("row"), F.coalesce(docs["doc_id"], F.lit(-(2**63))).alias("id"), _text(docs, normalise).alias("text"))

    def best(df, *keys):
        return df.groupBy(*keys).agg(F.max_by("row", "id").alias("row"), F.max("id").alias("id"))

    salted = best(rows, _digest(F.col("text")).alias("digest"), salt(F.col("id")).alias("salt"), "text")
    last = best(salted, "digest", "text")
    text = F.when(~F.col("row")["null"], F.col("text"))
    return last.select(*((text if c == "text" and not normalise else F.col("row")[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)))
