"""Chat formatting (operator 10): transcripts to canonical turns with a hidden Markov model.

A transcript is a sequence of lines. The states are (role, first line of a turn or a later one). A line shows a
speaker marker or none, whether a blank line precedes it, a length class and how it ends; these features are
independent given the state. Start, transition and feature chances are counted, and smoothed, from at most SAMPLE
labelled conversations (a parameter), of each its rows before sequence number CHUNK. Viterbi finds the likeliest
states; every first-line state opens a turn. Its marker goes; all else of a turn stays as written, indentation, blank
lines within it and what looks like a marker on a later line too. Blank lines around a turn go.

A conversation may hold a large share of all rows. It is cut into chunks of CHUNK sequence numbers, and where these
hold over 4 * CHUNK rows, into single sequence numbers and slices of them by hash of the text. Each chunk gives the best
score from any state to any state, once for a blank line before it and once for none; these small tables are chained
per conversation, each chunk is decoded between the states so found, and a turn that runs over borders is put together
again: the result is that of one pass over the whole conversation.

Null texts are empty lines. Rows of one conversation lie in order of sequence number (null first), hash of the text and
text; rows that repeat all three lie in one chunk. A conversation without any line gives no turn; an empty table gives
no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

ROLES = ("system", "user", "assistant")
SAMPLE = 2000
CHUNK = 1024
# Names by which transcripts call speakers.
MARKERS = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "q", "customer"), "assistant": ("assistant", "ai", "bot", "a")}
_ROLE = {name: i for i, role in enumerate(ROLES) for name in MARKERS[role]}
_MARK = re.compile(r"\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(" + "|".join(sorted(_ROLE, key=len, reverse=True)) + r")(?:\*\*)?\s*(?::|\|?>|\]|—|$)(?:\*\*)?\s*", re.I)
SIZES = (4, 2, 8, 4)  # marker, blank line before, length, end
STATES = 2 * len(ROLES)


def features(line: str, blank: bool) -> tuple[tuple[int, int, int, int], str]:
    """Features of a line, and the line without its marker."""
    m = _MARK.match(line)
    rest = line[m.end() :] if m else line
    end = rest.rstrip()[-1:]
    return (_ROLE[m[1].lower()] + 1 if m else 0, int(blank), min(7, len(rest).bit_length() // 2), "?:.".find(end) + 1 if end else 0), rest


def read(raw: str | None, blank: int):
    """(features, line, line without marker, blank lines before it) of each line that isn't blank, and how many blank
    lines came last."""
    out = []
    for line in (raw or "").split("\n"):
        if line.strip():
            seen, rest = features(line, blank > 0)
            out.append((seen, line, rest, blank))
            blank = 0
        else:
            blank += 1
    return out, blank


def trimmed(text: str) -> str:
    """A turn without the blank lines around it and blanks at its end."""
    lines = text.split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    return "\n".join(lines).rstrip()


class Model:
    """Log chances. A state shows a value as often as it was seen to, mixed with how often any state shows it, so a
    value that was never seen speaks for no state; a role's own marker counts as seen once."""

    def __init__(self, start: np.ndarray, move: np.ndarray, show: list[np.ndarray], mix: float = 0.05):
        norm = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
        self.start, self.move, self.show = norm(start), norm(move), []
        for i, seen in enumerate(show):
            seen = seen.astype(np.float64)
            if i == 0:
                seen[2 * np.arange(len(ROLES)), np.arange(len(ROLES)) + 1] += 1
            every = (seen.sum(axis=0) + 1) / (seen.sum() + seen.shape[1])
            own = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
            self.show.append(np.log((1 - mix) * own + mix * every))

    def scores(self, lines: list[tuple[int, ...]]) -> np.ndarray:
        f = np.array(lines, np.int64).reshape(-1, len(SIZES))
        return sum(s[:, f[:, i]].T for i, s in enumerate(self.show))

    def across(self, scores: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state of the last line."""
        best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for s in scores:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + s
        return best

    def decode(self, scores: np.ndarray, before: int = -1, last: int = -1) -> list[int]:
        """Likeliest states: after the state before (-1: a conversation begins), up to the state last (-1: any)."""
        if not len(scores):
            return []
        best = (self.start if before < 0 else self.move[before]) + scores[0]
        back = []
        for s in scores[1:]:
            each = best[:, None] + self.move
            back.append(each.argmax(axis=0))
            best = each.max(axis=0) + s
        path = [last if last >= 0 else int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _runs(batches, keys: list[str]):
    """(key, rows) of each run of equal keys in sorted batches."""
    now, held = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols)) if cols else []
        a = 0
        while a < len(rows):
            b = a
            while b < len(rows) and rows[b] == rows[a]:
                b += 1
            if held and rows[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = rows[a]
            held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield now, pa.Table.from_batches(held)


def _order() -> list[Column]:
    return [F.col("seq"), F.xxhash64("raw"), F.col("raw")]


def _chunked(rows: DataFrame) -> DataFrame:
    """conv_id, seq, raw, and the chunk of each row as its first sequence number and slice."""
    start = F.coalesce(F.floor(F.col("seq") / CHUNK) * CHUNK, F.lit(-(2**63))).cast("long")
    short = rows.select("conv_id", start.alias("chunk"), F.lit(0).alias("slice"), "seq", "raw")
    large = stored(short.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * CHUNK), "large")
    if large.isEmpty():
        return short
    found = short.drop("slice").join(large.withColumnsRenamed({"conv_id": "c", "chunk": "k"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left")
    # The hash's upper half, as a share of all values from the least to the greatest, tells the slice.
    share = (F.shiftright(F.xxhash64("raw"), 32) + 2**31) / 2.0**32
    part = F.floor(share * F.ceil(F.col("n") / CHUNK)).cast("int")
    return found.select("conv_id", F.when(F.col("n").isNotNull(), F.coalesce("seq", "chunk")).otherwise(F.col("chunk")).alias("chunk"), F.coalesce(part, F.lit(0)).alias("slice"), "seq", "raw")


_CHUNK = ["conv_id", "chunk", "slice"]


def _in_order(chunks: DataFrame) -> DataFrame:
    return chunks.repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, *_order())


def fit(turns: DataFrame, sample: int = SAMPLE) -> Model:
    """From labelled turns (conv_id, seq, role, raw), each row one turn, of `sample` conversations at most; of a long
    one, the rows before sequence number CHUNK."""
    labelled = turns.filter(F.col("role").isin(*ROLES) & (F.coalesce("seq", F.lit(0)) < CHUNK))
    chosen = labelled.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)

    def run(batches):
        start, move = np.zeros(STATES), np.zeros((STATES, STATES))
        show = [np.zeros((STATES, n)) for n in SIZES]
        for _, t in _runs(batches, ["conv_id"]):
            before, blank = -1, 0
            for role, raw in zip(t.column("role").to_pylist(), t.column("raw").to_pylist()):
                lines, blank = read(raw, blank)
                for k, (f, *_) in enumerate(lines):
                    s = 2 * ROLES.index(role) + (k > 0)
                    if before < 0:
                        start[s] += 1
                    else:
                        move[before, s] += 1
                    for i, v in enumerate(f):
                        show[i][s, v] += 1
                    before = s
        flat = np.concatenate([start, move.ravel(), *(x.ravel() for x in show)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "n"])

    rows = labelled.join(chosen, "conv_id", "left_semi").select("conv_id", "seq", "role", "raw").repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    flat = np.zeros(STATES + STATES**2 + STATES * sum(SIZES))
    for r in rows.mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each number of the model
        flat[r.i] = r.n
    at, show = STATES + STATES**2, []
    for n in SIZES:
        show.append(flat[at : at + STATES * n].reshape(STATES, n))
        at += STATES * n
    return Model(flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), show)


def _lines(t: pa.Table, blank: int):
    """Features, line, rest, blank lines before and row number of a chunk's lines, and how many blank lines came last."""
    out = []
    for i, raw in enumerate(t.column("raw").to_pylist()):
        lines, blank = read(raw, blank)
        out += [(*x, i) for x in lines]
    return out, blank


_TURN = "conv_id long, chunk long, slice int, seq long, part int, role string, text string, continued boolean, last boolean, opened long, split boolean"


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, seq, part, role, text, rendered: the turns found in transcripts (conv_id, seq, raw), a row each.

    seq is that of the row on which the turn's first line stands, and part counts the turns of rows of that number.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    chunks = _chunked(rows)

    def forward(batches):
        for (conv, chunk, piece), t in _runs(batches, _CHUNK):
            m, first, across = shared.value, [], []
            lines, after = _lines(t, 0)
            for blank in (False, True):
                shown = [x[0] for x in lines]
                if lines:
                    shown[0] = (shown[0][0], int(blank or lines[0][3] > 0), *shown[0][2:])
                s = m.scores(shown)
                best = m.start + s[0] if len(lines) else np.full(STATES, -np.inf)
                for x in s[1:]:
                    best = (best[:, None] + m.move).max(axis=0) + x
                first.append(best)
                across.append(m.across(s))
            cols = {"conv_id": pa.array([conv], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "slice": pa.array([piece], pa.int32()), "n": pa.array([len(lines)], pa.int64()), "after": pa.array([after], pa.int64())}
            yield pa.RecordBatch.from_pydict(cols | {k: pa.array([np.concatenate([x.ravel() for x in v]).tolist()], pa.list_(pa.float64())) for k, v in (("first", first), ("across", across))})

    def chain(batches):
        for (conv,), t in _runs(batches, ["conv_id"]):
            n, after = t.column("n").to_pylist(), t.column("after").to_pylist()
            first = np.array(t.column("first").to_pylist()).reshape(-1, 2, STATES)
            across = np.array(t.column("across").to_pylist()).reshape(-1, 2, STATES, STATES)
            live, blanks, best, back, blank = [], [], None, [], 0
            for i in range(len(n)):
                if n[i]:
                    live.append(i)
                    blanks.append(blank)
                    if best is None:
                        best = first[i, int(blank > 0)]
                    else:
                        each = best[:, None] + across[i, int(blank > 0)]
                        back.append(each.argmax(axis=0))
                        best = each.max(axis=0)
                blank = after[i] if n[i] else blank + after[i]
            ends = [int(best.argmax())] if live else []
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends = ends[::-1]
            own = t.take(pa.array(live, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(live), pa.int64()), own.column("chunk").combine_chunks(), own.column("slice").combine_chunks(), pa.array([-1, *ends[:-1]] if live else [], pa.int32()), pa.array(ends, pa.int32()), pa.array(blanks, pa.int64())], ["conv_id", "chunk", "slice", "before", "last", "blank"])

    def decode(batches):
        for (conv, chunk, piece), t in _runs(batches, _CHUNK):
            m = shared.value
            before, last, blank = (t.column(c)[0].as_py() for c in ("before", "last", "blank"))
            lines, after = _lines(t, blank or 0)
            if not lines:
                continue
            path = m.decode(m.scores([x[0] for x in lines]), -1 if before is None else before, -1 if last is None else last)
            seqs, turns = t.column("seq").to_pylist(), []
            for state, (_, line, rest, gap, i) in zip(path, lines):
                inner = not turns and state % 2 == 1 and before is not None and before >= 0 and before // 2 == state // 2
                if state % 2 == 0 or not turns and not inner or turns and turns[-1][1] != state // 2:
                    turns.append((i, state // 2, [rest if state % 2 == 0 else line], False))
                elif inner:
                    turns.append((i, state // 2, [""] * gap + [line], True))
                else:
                    turns[-1][2].extend([""] * gap + [line])
            part, out = {}, []
            for i, role, texts, cont in turns:
                seq = seqs[i]
                if not cont:
                    part[seq] = part.get(seq, -1) + 1
                out.append((seq, -1 if cont else part[seq], ROLES[role], "\n".join(texts), cont, False))
            out[-1] = (*out[-1][:-1], True)
            c, n = list(zip(*out)), len(out)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            head = [pa.array([conv] * n, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array([piece] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(x, k) for x, k in zip(c, kinds)), pa.array([sum(not x[3] for x in turns)] * n, pa.int64()), pa.array([before is not None] * n, pa.bool_())], ["conv_id", "chunk", "slice", "seq", "part", "role", "text", "continued", "last", "opened", "split"])

    def counted(batches):
        """How many turns a conversation opens before each chunk."""
        for (conv,), t in _runs(batches, ["conv_id"]):
            n = np.array(t.column("n").to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(n), pa.int64()), t.column("chunk").combine_chunks(), t.column("slice").combine_chunks(), pa.array(np.cumsum(n) - n)], ["c", "k", "s", "base"])

    def finished(batches):
        for batch in batches:
            text = [trimmed(x) for x in batch.column("text").to_pylist()]
            rendered = [f"<|{r}|>\n{x}\n<|end|>\n" for r, x in zip(batch.column("role").to_pylist(), text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "seq", "part", "role")), pa.array(text, pa.string()), pa.array(rendered, pa.string())], ["conv_id", "seq", "part", "role", "text", "rendered"])

    shown = "conv_id long, seq long, part int, role string, text string, rendered string"
    # Most conversations are one chunk; only the others need the chain.
    several = chunks.groupBy(*_CHUNK).agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")
    many = chunks.join(several.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    tables = stored(_in_order(many).mapInArrow(forward, "conv_id long, chunk long, slice int, n long, after long, first array<double>, across array<double>"), "chunks")
    ends = stored(tables.repartition("conv_id").sortWithinPartitions(*_CHUNK).mapInArrow(chain, "conv_id long, chunk long, slice int, before int, last int, blank long"), "ends")
    if ends.isEmpty():
        none = chunks.withColumns({c: F.lit(None).cast(k) for c, k in (("before", "int"), ("last", "int"), ("blank", "long"))})
        return _in_order(none).mapInArrow(decode, _TURN).mapInArrow(finished, shown)
    told = ends.withColumnsRenamed({"conv_id": "c", "chunk": "k", "slice": "s"})
    whole = chunks.join(told, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")) & (F.col("slice") == F.col("s")), "left").drop("c", "k", "s")
    turns = stored(_in_order(whole).mapInArrow(decode, _TURN), "turns")
    # What runs on over a border goes to the last turn that began before it: turns are numbered through a conversation.
    at_border = F.col("split") & (F.col("continued") | F.col("last"))
    opened = turns.filter("split").groupBy(*_CHUNK).agg(F.count_if(~F.col("continued")).alias("n"))
    base = opened.repartition("conv_id").sortWithinPartitions(*_CHUNK).mapInArrow(counted, "c long, k long, s int, base long")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")) & (F.col("slice") == F.col("s"))
    border = turns.filter(at_border).join(base, on).withColumn("turn", F.col("base") + F.when(F.col("continued"), -1).otherwise(F.col("opened") - 1))
    texts = F.array_sort(F.collect_list(F.struct("chunk", "slice", "text")))
    head = F.min(F.struct("chunk", "slice", "seq", "part", "role"))
    joined = border.groupBy("conv_id", "turn").agg(head.alias("h"), F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"))
    joined = joined.select("conv_id", "h.seq", "h.part", "h.role", "text")
    return turns.filter(~at_border).select(*joined.columns).unionByName(joined).mapInArrow(finished, shown)


def transcripts(turns: DataFrame, bare: int = 4) -> DataFrame:
    """conv_id, seq, role, raw: turns laid out as a transcript, by rule.

    Each conversation calls its speakers in a style of its own; one turn in `bare`, by hash, bears no marker and only
    follows a blank line. The role serves fit() and scoring; parse() doesn't read it.
    """
    own = turns.select("conv_id", F.col("turn").cast("long").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    names = [F.create_map(*(F.lit(x) for role in ROLES for x in (role, MARKERS[role][min(i, len(MARKERS[role]) - 1)].capitalize()))) for i in range(4)]
    name = F.coalesce(*(F.when(style == i, F.try_element_at(names[i], F.col("role"))) for i in range(4)))
    bare_turn = (F.pmod(F.xxhash64("conv_id", "seq"), F.lit(bare)) == 0) | name.isNull()
    return own.select("conv_id", "seq", "role", F.when(bare_turn, F.concat(F.lit("\n"), "text")).otherwise(F.concat(name, F.lit(": "), "text")).alias("raw"))
