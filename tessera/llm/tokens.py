"""BPE encoding and decoding (operator 4), and the encoding that packing and token output use.

Texts are cut at ASCII white space, which never lies inside a token of the vocabularies served here. Each distinct
piece is encoded once and kept in a bounded cache; documents are then put together from the pieces by array lookups,
so the work of merging follows the number of distinct pieces, not of words.

`BacktrackingEncoder` gives exact merges: one Aho-Corasick pass lists the tokens that begin at each place, the
longest is tried first, and a token is taken only if merging could leave it beside the one before it (a table of
token pairs, filled when asked). If none fits, the token before is taken back. Every place is left at most once per
token that begins there, so time is linear in the text's length.

A null text counts as an empty one; an empty text has no ids and decodes to an empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import lean, spans, text_slices, tidy

#: Entries that a worker's cache of encoded pieces holds before it starts anew.
CACHE_PIECES = 600_000
#: Stands for the end of a word inside the automaton.
_END = ""
_PLAIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")
_TAIL = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([.,])")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies show for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class LibraryEncoder:
    """Pieces by the tokenizers library: its model for plain words, its whole pipeline for all else."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    def word(self, low: str) -> list[int]:
        return [t.id for t in self.model.tokenize("".join([self.letters[b] for b in low.encode()]))]

    def piece(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids


class BacktrackingEncoder:
    """Exact BPE merges of one pre-token by backtracking over longest matches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix, self.letters = suffix, byte_letters()
        inner = (lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t)
        # Ranks: single characters, the word's end, characters joined to it, and then the merges in their order.
        base = [t for t in model["vocab"] if len(t) == 1]
        ended = [t for t in model["vocab"] if suffix and len(t) == len(suffix) + 1 and t.endswith(suffix)]
        names = [*base, _END, *(inner(t) for t in ended)]
        rank = {t: i for i, t in enumerate(names)}
        ids = [*(model["vocab"][t] for t in base), -1, *(model["vocab"][t] for t in ended)]
        split = [(i, i) for i in range(len(base) + 1)] + [(rank[t[0]], len(base)) for t in ended]
        pair = {split[rank[inner(t)]]: rank[inner(t)] for t in ended}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = rank[inner(a)], rank[inner(b)]
            made = inner(a) + inner(b)
            rank[made] = pair[left, right] = len(names)
            names.append(made)
            ids.append(model["vocab"][a + b])
            split.append((left, right))
        self.ids, self.split, self.pair, self.ok = ids, split, pair, {}
        reachable = [True] * len(names)
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            left, right = split[i]
            if left != i:
                reachable[i] = reachable[left] and reachable[right] and self._apart(left, right, i)
            if reachable[i] and ids[i] >= 0:
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        tok = Tokenizer.from_file(path)
        self.normalizer, self.pre = tok.normalizer, tok.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")

    def _apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether merging leaves the border between two tokens: no merge over it comes before those that build them."""
        split, pair = self.split, self.pair
        while True:
            if pair.get((left, right), limit) < limit:
                return False
            # Undo the later of the two merges beside the border; of equal ranks the left one was merged first.
            if left > right and split[left][0] != left or split[right][0] == right:
                if split[left][0] == left:
                    return True
                limit, left = left, split[left][1]
            else:
                limit, right = right + 1, split[right][0]

    def merge(self, word: str) -> list[int]:
        """ids of one pre-token, given in the vocabulary's letters."""
        if not word:
            return []
        text = word + _END if self.suffix else word
        begins: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, (token, size) in self.automaton.iter(text):
            begins[end - size + 1].append((token, end + 1))
        n, at, taken, ok = len(text), 0, [], self.ok
        dead = bytearray(n + 1)
        turn = [len(b) - 1 for b in begins]  # the longest match of each place comes last
        while at < n:
            before = taken[-1][0] if taken else -1
            k = turn[at]
            while k >= 0:
                token, end = begins[at][k]
                if not dead[end]:
                    if before < 0:
                        break
                    fits = ok.get((before, token))
                    if fits is None:
                        if len(ok) > 2_000_000:
                            ok.clear()
                        fits = ok[before, token] = self._apart(before, token)
                    if fits:
                        break
                k -= 1
            if k >= 0:
                turn[at] = k - 1
                taken.append((token, at))
                at = end
                if at < n:
                    turn[at] = len(begins[at]) - 1
            else:
                dead[at] = 1
                if not taken:
                    raise ValueError("the vocabulary lacks a character of the text")
                _, at = taken.pop()
        return [self.ids[t] for t, _ in taken]

    def word(self, low: str) -> list[int]:
        return self.merge("".join([self.letters[b] for b in low.encode()]))

    def _ordinary(self, text: str) -> list[int]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [i for word, _ in self.pre.pre_tokenize_str(text) for i in self.merge(word)]

    def piece(self, piece: str) -> list[int]:
        out, at = [], 0
        for m in self.cut.finditer(piece):
            out += self._ordinary(piece[at : m.start()]) + [self.special[m[0]]]
            at = m.end()
        return out + self._ordinary(piece[at:]) if at < len(piece) else out


class Encoder:
    """Whole texts to ids, through the cache of pieces."""

    def __init__(self, path: str, backtrack: bool = False):
        self.of = (BacktrackingEncoder if backtrack else LibraryEncoder)(path)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Only such a pipeline treats plain words as assumed below.
        self.fast = spec["pre_tokenizer"] is not None and "Lowercase" in json.dumps(spec["normalizer"]) and "\\p{L}]+" in json.dumps(spec["pre_tokenizer"])

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if (out := self.words.get(low)) is None:
            out = self.words[low] = np.array(self.of.word(low), "<u4").tobytes()
        return out

    def _piece(self, piece: str) -> bytes:
        if self.fast:
            if _PLAIN.fullmatch(piece):
                return self._word(piece)
            if m := _TAIL.fullmatch(piece):
                return self._word(m[1]) + self._word_of_mark(m[2])
        return np.array(self.of.piece(piece), "<u4").tobytes()

    def _word_of_mark(self, mark: str) -> bytes:
        if (out := self.words.get(mark)) is None:
            out = self.words[mark] = np.array(self.of.piece(mark), "<u4").tobytes()
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and the n + 1 places where texts begin and end."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        firsts = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        if len(self.words) > CACHE_PIECES:
            self.words.clear()
        known, encoded = self.pieces, []
        for piece in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            if (ids := known.get(piece)) is None:
                ids = self._piece(piece)
                if len(piece) <= 64:
                    known[piece] = ids
            encoded.append(ids)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), "<u4")
        index = coded.indices.to_numpy()
        each = lengths[index]
        ids = flat[spans((np.cumsum(lengths) - lengths)[index], each)]
        return ids, np.concatenate([[0], np.cumsum(each)])[firsts - firsts[0]]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, backtrack: bool = False) -> Encoder:
    """One encoder and cache for each Python worker."""
    key = (path, backtrack)
    if key not in _encoders:
        _encoders[key] = Encoder(path, backtrack)
    return _encoders[key]


class Decoder:
    """Decoding by an offset table: all tokens' bytes lie in one buffer, and a token is a slice of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if tok.decoder is not None:
            raise ValueError("vocabularies with a decoder of their own aren't served")
        names = [(tok.id_to_token(i) or "").encode() for i in range(tok.get_vocab_size(with_added_tokens=True))]
        # A decoder that the vocabulary leaves out joins tokens by one space.
        self.buffer = np.frombuffer(b"".join(n + b" " for n in names), np.uint8)
        self.size = np.array([len(n) + 1 for n in names], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), 250_000):  # bounds the index arrays, also for very long texts
            part = ids[a : a + 250_000]
            out.append(self.buffer[spans(self.start[part], self.size[part])].tobytes())
        return b"".join(out)[:-1]


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode_batches(path: str, make: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], pa.RecordBatch], backtrack: bool = False):
    """A function for mapInArrow over batches with a column text: make() gets ids, borders and the rows of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, backtrack)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, borders = encode(part.column("text"))
                yield make(ids, borders, part)

    return run


def encode(docs: DataFrame, path: str, backtrack: bool = True) -> DataFrame:
    """doc_id, ids (array of int) of each document; null texts give an empty array."""

    def make(ids, borders, part):
        lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return tidy(docs, "doc_id", "text").mapInArrow(lean(encode_batches(path, make, backtrack)), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null or empty ids give an empty text."""

    def run(batches):
        dec = decoder(path)
        for batch in batches:
            texts = [dec(np.array(ids if ids is not None else [], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tidy(coded, "doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode each whole text, decode the ids, digest both."""

    def make(ids, borders, part):
        dec = decoder(path)
        ids32 = ids.astype("<u4")
        rows = list(zip(borders[:-1].tolist(), borders[1:].tolist()))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(borders)), pa.array([sha(ids32[a:b]) for a, b in rows], pa.string()), pa.array([sha(dec(ids[a:b])) for a, b in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tidy(docs, "doc_id", "text").mapInArrow(lean(encode_batches(path, make, backtrack=True)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
