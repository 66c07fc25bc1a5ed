"""Token-ID / binary output (operator 5): a static range asymmetric numeral system.

Token counts of the whole corpus give one shared frequency table (of at most as many rows as the vocabulary has
ids). Documents lie in ascending doc_id order; runs of whole documents make independent blocks. A block's tokens are
dealt over lanes, each with a state of its own; all lanes write 32-bit words to one stream, so one array operation
codes a token of every lane. Every CHECKPOINT_STEPS steps a block holds all states and the place in the stream: a
reader can start there. Each block carries the frequency table's checksum, a checksum of its bytes and one of its ids.

Block bytes, little-endian: header (see _HEADER), doc_ids int64[n_docs], lengths int64[n_docs], checkpoints
(place uint64, states uint64[lanes]) * n_checkpoints, stream uint32[n_words].

A table of blocks is a Parquet folder with the rows (shard, block, start_in_shard, n_docs, n_tokens, payload); the
frequency table lies beside it. A null text is an empty one and holds the end id alone; null doc_ids come first; repeated doc_ids
stay separate rows; an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, stored, tidy
from tessera.llm.tokens import encode_batches

SCALE = 20
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 128
_LOW = np.uint64(1 << 31)
_HEADER = struct.Struct("<4sHHIIQIIIII")  # magic, version, scale, lanes, n_docs, n_tokens, steps, n_checkpoints, n_words, table crc, ids crc
_MAGIC = b"TRNS"
_NULL = -(2**63)  # stands for a null doc_id
BLOCKS = "shard int, block int, start_in_shard long, n_docs int, n_tokens long, payload binary"


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 for every id that occurs."""
    total = int(counts.sum())
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    if np.count_nonzero(counts) > 1 << SCALE:
        raise ValueError("more ids than the scale can hold")
    used = counts > 0
    exact = counts[used].astype(np.float64) * ((1 << SCALE) / total)
    part = np.maximum(1, np.floor(exact)).astype(np.int64)
    rest = (1 << SCALE) - int(part.sum())
    order = np.argsort(-part, kind="stable")
    while rest:
        if rest > 0:
            part[order[0]] += rest
            rest = 0
        else:
            for i in order:
                take = min(-rest, int(part[i]) // 2)
                part[i] -= take
                rest += take
                if not rest:
                    break
    freq[used] = part
    return freq


class Coder:
    """Block coder for one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.limit = (np.uint64(_LOW >> np.uint64(SCALE)) << np.uint64(32)) * self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<i8"))

    def encode(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
        n = len(ids)
        if n and not self.freq[ids].all():
            raise ValueError("an id has no frequency")
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        shift, scale = np.uint64(32), np.uint64(SCALE)
        words, marks, written = [], [], 0
        for t in range(steps - 1, -1, -1):
            sym = ids[t * lanes : (t + 1) * lanes]
            x, f = state[: len(sym)], self.freq[sym]
            if (out := np.flatnonzero(x >= self.limit[sym])).size:
                words.append(x[out].astype("<u4"))
                written += out.size
                x[out] >>= shift
            q = x // f
            x[:] = (q << scale) + (x - q * f) + self.start[sym]
            if t % CHECKPOINT_STEPS == 0:
                marks.append((written, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        head = _HEADER.pack(_MAGIC, 1, SCALE, lanes, len(doc_ids), n, steps, len(marks), written, self.crc, zlib.crc32(ids.astype("<u4")))
        body = b"".join([doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), *(struct.pack("<Q", written - w) + s.astype("<u8").tobytes() for w, s in marks[::-1]), stream.tobytes()])
        return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body

    def decode(self, payload: bytes, parts: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, lengths and ids of a block; parts: only the tokens between these checkpoints."""
        magic, version, scale, lanes, n_docs, n, steps, n_marks, n_words, table, check = _HEADER.unpack_from(payload)
        at = _HEADER.size + 4
        if magic != _MAGIC or version != 1 or scale != SCALE or table != self.crc:
            raise ValueError("not a block of this frequency table")
        if struct.unpack_from("<I", payload, _HEADER.size)[0] != zlib.crc32(memoryview(payload)[at:], zlib.crc32(payload[: _HEADER.size])):
            raise ValueError("a block's bytes are damaged")
        doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        lengths = np.frombuffer(payload, "<i8", n_docs, at + 8 * n_docs)
        at += 16 * n_docs
        size = 8 + 8 * lanes
        stream = np.frombuffer(payload, "<u4", n_words, at + size * n_marks).astype(np.uint64)
        chosen = range(n_marks) if parts is None else parts
        out = np.empty(n, np.uint32)
        mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for k in chosen:
            place = struct.unpack_from("<Q", payload, at + size * k)[0]
            state = np.frombuffer(payload, "<u8", lanes, at + size * k + 8).copy()
            for t in range(k * CHECKPOINT_STEPS, min(steps, (k + 1) * CHECKPOINT_STEPS)):
                a, b = t * lanes, min(n, (t + 1) * lanes)
                x = state[: b - a]
                slot = x & mask
                sym = self.symbol[slot]
                out[a:b] = sym
                x[:] = self.freq[sym] * (x >> scale) + slot - self.start[sym]
                if (need := np.flatnonzero(x < _LOW)).size:
                    x[need] = (x[need] << shift) | stream[place : place + need.size]
                    place += need.size
        if parts is not None:
            out = out[chosen.start * CHECKPOINT_STEPS * lanes : chosen.stop * CHECKPOINT_STEPS * lanes]
        elif zlib.crc32(out.astype("<u4")) != check:
            raise ValueError("a block's ids are damaged")
        return doc_ids, lengths, out


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (16-bit or 32-bit little-endian) with the end id, for every document."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"

    def make(ids, borders, part):
        n = len(borders) - 1
        full = np.insert(ids, borders[1:], end_id).astype(kind)
        ends = borders + np.arange(n + 1)
        raw, size = full.tobytes(), full.itemsize
        rows = [raw[a * size : b * size] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    df = tidy(docs, "doc_id", "text").mapInArrow(encode_batches(path, make), "doc_id long, ids binary")
    return df.withMetadata("ids", {"kind": kind})


def _unpack(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x.as_buffer()) for x in column], np.int64) // int(kind[2])
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).astype(np.uint32), lengths


def frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Counts of every id over all rows: each task sends one row per id that it saw."""
    kind = tokens.schema["ids"].metadata["kind"]

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_unpack(batch.column("ids"), kind)[0], minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def write(docs: DataFrame, path: str, end_id: int, place: str) -> None:
    """Encode documents with the tokenizers library and write blocks and frequency table below place."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    coded = token_rows(docs, path, end_id)
    kind = coded.schema["ids"].metadata["kind"]
    tokens = stored(coded, "tokens").withMetadata("ids", {"kind": kind})
    freq = quantise(frequencies(tokens, max(end_id + 1, Tokenizer.from_file(path).get_vocab_size())))
    spark.createDataFrame([(bytearray(freq.astype("<i8").tobytes()),)], "freq binary").write.mode("overwrite").parquet(f"{place}/table")
    coder = spark.sparkContext.broadcast(freq)

    def run(batches):
        code, shard = Coder(coder.value), TaskContext.get().partitionId()
        docs_, sizes, parts, held, block, start = [], [], [], 0, 0, 0

        def flush():
            nonlocal docs_, sizes, parts, held, block, start
            payload = code.encode(np.concatenate(docs_), np.concatenate(sizes), np.concatenate(parts))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "start_in_shard": [start], "n_docs": pa.array([sum(map(len, docs_))], pa.int32()), "n_tokens": [held], "payload": pa.array([payload], pa.binary())})
            block, start, docs_, sizes, parts, held = block + 1, start + held, [], [], [], 0
            return row

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, lengths = _unpack(part.column("ids"), kind)
                docs_.append(part.column("doc_id").to_numpy())
                sizes.append(lengths)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if docs_:
            yield flush()

    ordered = tokens.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL))).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{place}/blocks")


def read(spark: SparkSession, place: str) -> tuple[DataFrame, np.ndarray]:
    """Rows of blocks, and the frequency table."""
    freq = np.frombuffer(spark.read.parquet(f"{place}/table").first().freq, "<i8")
    return spark.read.schema(BLOCKS).parquet(f"{place}/blocks"), freq


def _starts(blocks: DataFrame) -> DataFrame:
    """shard, base: tokens before each shard. There are at most as many shards as shuffle partitions."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, place: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document, or the crc32 of its ids (digest), decoded block by block."""
    blocks, freq = read(spark, place)
    shared = spark.sparkContext.broadcast(np.array(freq))

    def run(batches):
        code = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, ids = code.decode(batch.column("payload")[i].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                if digest:
                    raw = ids.astype("<u4")
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), batch.column("shard")[i].as_py(), np.int32)), pa.array(doc_ids), pa.array(starts + batch.column("start_in_shard")[i].as_py()), pa.array(lengths), last], ["shard", "doc_id", "own", "n_tokens", "last"])

    kind = "long" if digest else "array<int>"
    rows = blocks.select("shard", "start_in_shard", "payload").mapInArrow(run, f"shard int, doc_id long, own long, n_tokens long, last {kind}")
    return rows.join(_starts(blocks), "shard").select(F.nullif("doc_id", F.lit(_NULL)).alias("doc_id"), (F.col("base") + F.col("own")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def write_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write docs in the block format below the shared folder and return what reading them back gives."""
    place = f"{shared_dir(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    write(docs, path, end_id, place)
    return read_documents(docs.sparkSession, place, digest=True)
