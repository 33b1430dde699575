"""Encoding and decoding by a SentencePiece vocabulary of pair merges, in vectorised rounds over flat arrays."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: Characters that a task encodes at once, and words whose pieces it remembers.
SLICE_CHARS, REMEMBERED = 1 << 20, 1 << 18
#: A word is all up to the next blank that follows something else: no piece reaches over that place.
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = np.iinfo(np.int32).max


def default_model() -> str:
    """The file of the vocabulary on the machine that asks."""
    return public_tokenizers.path("piece_bpe_32k.model")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs ``start .. start + length - 1``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """What a model file says, as arrays: pieces by character, pairs that merge, and the bytes of each piece.

    Only models of pair merges with byte fallback, a blank put in front and texts taken as they are can be read; others are
    refused, as is a vocabulary with a piece that holds a blank after another character.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if not plain or trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only pair merges with byte fallback over texts as they are can be read")
        kinds = np.array([p.type for p in model.pieces])
        if set(kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces of users and unused pieces cannot be read")
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError("a piece holds a blank after another character")
        self.begin, self.end = trained.bos_id, trained.eos_id
        self.first_byte = int(np.flatnonzero(kinds == BYTE)[0])
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self._index(*np.array(pairs, np.int64).T)
        #: Pieces of equal score have equal ranks; the best is 0.
        self.rank = np.unique([-p.score for p in model.pieces], return_inverse=True)[1].astype(np.int32)
        blobs = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        self.is_byte, self.opens = kinds == BYTE, np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.unknown = np.flatnonzero(kinds == UNKNOWN)
        blobs = [" ⁇ ".encode() if i in self.unknown else b for i, b in enumerate(blobs)]
        self.lengths = np.array([len(b) for b in blobs], np.int64)
        self.starts, self.blob = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(blobs), np.uint8)

    def _index(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        """A hash table of the pairs with open places: about one in sixteen is taken."""
        keys = left << 32 | right
        self.bits = int(len(keys) * 16).bit_length()
        self.pair, self.piece = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        place, rest = self._place(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.pair[place[rest]] < 0]
            self.pair[place[free]], self.piece[place[free]] = keys[free], merged[free]
            rest = rest[self.pair[place[rest]] != keys[rest]]
            place[rest] = (place[rest] + 1) % len(self.pair)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; a pair that does not merge has the rank NEVER."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        place = self._place(keys)
        held = self.pair[place]
        piece = np.where(held == keys, self.piece[place], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            place[rest] = (place[rest] + 1) % len(self.pair)
            held = self.pair[place[rest]]
            piece[rest] = np.where(held == keys[rest], self.piece[place[rest]], -1)
            rest = rest[(held != keys[rest]) & (held >= 0)]
        return np.where(piece >= 0, self.rank[piece], NEVER), piece

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has.

        All words are one array of symbols. In a round each word looks for the least rank of its adjacent pairs and merges,
        from the left, all pairs of that rank that do not overlap. It stops after a merge whose new pair ranks no
        worse, as that one comes next; so the outcome is that of one merge at a time. Symbols that are gone, and words
        in which no pair remains, are left out of later rounds.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.of_char[chars]
        #: An unknown character is the complement of its code point, which merges with nothing.
        symbol = np.where(symbol >= 0, symbol, ~chars.astype(np.int32))
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        rank, piece = np.full(len(symbol), NEVER, np.int32), np.full(len(symbol), -1, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], piece[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        while len(symbol):
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.r_[begins, len(word)])
            if (least == NEVER).any():
                ended = np.repeat(least == NEVER, lengths)
                done_symbols.append(symbol[ended])
                done_words.append(word[ended])
                symbol, word, rank, piece = (x[~ended] for x in (symbol, word, rank, piece))
                continue
            at = self._taken(symbol, word, rank, piece, np.repeat(least, lengths))
            symbol[at] = piece[at]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            stale = np.zeros(len(symbol), bool)
            stale[at] = True
            before = at[at > 0] - 1
            stale[before[~gone[before]]] = True
            stale[before[gone[before]] - 1] = True
            symbol, word, rank, piece, stale = (x[~gone] for x in (symbol, word, rank, piece, stale))
            stale = np.flatnonzero(stale)
            rank[stale], piece[stale] = NEVER, -1
            stale = stale[stale + 1 < len(symbol)]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale], piece[stale] = self.ranks(symbol[stale], symbol[stale + 1])
        symbols, of = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_symbols, done_words))
        order = np.argsort(of, kind="stable")
        return self._with_bytes(symbols[order], of[order], len(words))

    def _taken(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, piece: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of the pairs to merge in this round."""
        at = np.flatnonzero(rank == least)
        # Of runs of overlapping pairs, every other one from the left.
        run = np.cumsum(np.r_[True, np.diff(at) != 1])
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
        # New pairs: to the left, with the piece that a pair just before has become, and to the right.
        own, worst = piece[at], len(symbol) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, worst)
        joined = np.r_[False, at[1:] - at[:-1] == 2]
        left = np.where(joined, np.r_[-1, own[:-1]], symbol[before])
        left = self.ranks(np.where((at > 0) & (word[before] == word[at]), left, -1), own)[0]
        right = self.ranks(own, np.where((at + 2 <= worst) & (word[after] == word[at]), symbol[after], -1))[0]
        stops = np.minimum(left, right) <= least[at]
        if not stops.any():
            return at
        # In each word, up to the first merge that stops.
        earlier = np.cumsum(stops) - stops
        opening = np.flatnonzero(np.r_[True, word[at][1:] != word[at][:-1]])
        base = np.repeat(earlier[opening], np.diff(np.r_[opening, len(at)]))
        return at[earlier == base]

    def _with_bytes(self, symbols: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, unknown characters as the ids of their bytes."""
        unknown = np.flatnonzero(symbols < 0)
        if len(unknown):
            blobs = [chr(~c).encode() for c in symbols[unknown].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[unknown] = [len(b) for b in blobs]
            starts = np.cumsum(sizes) - sizes
            symbols, of, small = np.repeat(symbols, sizes), np.repeat(of, sizes), sizes[unknown]
            symbols[_ranges(starts[unknown], small)] = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64) + self.first_byte
        return symbols.astype(np.uint32), np.bincount(of, minlength=n)

    def text(self, ids: np.ndarray) -> bytes:
        """``decode``, of many ids in stretches between which no bytes stand side by side."""
        out, at, opening = [], 0, True
        while at < len(ids):
            to = min(at + SLICE_CHARS // 4, len(ids))
            while to < len(ids) and self.is_byte[ids[to]]:
                to += 1
            out.append(self.decode(ids[at:to], opening))
            opening = opening and not self.lengths[ids[at:to]].any()
            at = to
        return b"".join(out)

    def decode(self, ids: np.ndarray, opening: bool = True) -> bytes:
        """The text of ids in UTF-8; without the blank put in front if they are a text's ``opening``. A byte that belongs to
        no character becomes U+FFFD, as in the library."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.lengths[ids]
        text = self.blob[_ranges(self.starts[ids], sizes)].tobytes()
        if opening:
            real = np.flatnonzero(sizes)
            if len(real) and self.opens[ids[real[0]]]:
                text = text[1:]
        if self.is_byte[ids].any():
            try:
                if (sizes[1:-1] == 0).any():  # parts a run of bytes
                    return self._mended(ids, opening)
                text.decode()
            except UnicodeDecodeError:
                return self._mended(ids, opening)
        return text

    def _mended(self, ids: np.ndarray, opening: bool) -> bytes:
        """``decode`` where runs of bytes are not all characters: each byte that begins none stands for itself."""
        out, edges = [], np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        for run in np.split(ids, edges):
            if not self.is_byte[run[0]]:
                out.append(self.decode(run, opening and not out))
                continue
            raw, at = (run - self.first_byte).astype(np.uint8).tobytes(), 0
            while at < len(raw):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + size].decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�".encode())
                at += size
        return b"".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Texts to ids, with the words that were met lately remembered."""

    def __init__(self, found: Vocabulary) -> None:
        self.of = found
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each of several stretches of words."""
        if len(self.known) > REMEMBERED:
            self._forget()
        met = len(self.known)
        places = [np.array(list(map(self.known.__getitem__, WORDS.findall(c))), np.int64) for c in chunks]
        if len(self.known) > met:
            ids, sizes = self.of.encode_words(list(islice(self.known, met, None)))
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
            self.ids, self.sizes = np.r_[self.ids, ids], np.r_[self.sizes, sizes]
        return [self.ids[_ranges(self.starts[p], self.sizes[p])] for p in places]


def stretches(text: str) -> Iterator[str]:
    """A text as it is encoded, with a blank in front and blanks as signs, in stretches of whole words of SLICE_CHARS or so."""
    if not text:
        return
    text = BLANK + text.replace(" ", BLANK)
    at, edge = 0, re.compile(f"(?<!{BLANK}){BLANK}")
    while len(text) - at > SLICE_CHARS:
        cut = edge.search(text, at + SLICE_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _slices(texts: pa.Array) -> Iterator[list[tuple[int, str, bool]]]:
    """Stretches of texts, SLICE_CHARS or so at a time, as ``(row, stretch, whether the text ends with it)``."""
    held, size = [], 0
    for row in range(len(texts)):
        before = ""
        for stretch in stretches(texts[row].as_py() or ""):
            if before:
                held.append((row, before, False))
                size += len(before)
                if size >= SLICE_CHARS:
                    yield held
                    held, size = [], 0
            before = stretch
        held.append((row, before, True))
        size += len(before)
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text, with those of begin and end, as little-endian unsigned numbers of 32
    bits; exactly those of the library. ``model`` is a vocabulary's file on every machine (by default ``default_model()``).

    A null text is read as an empty one, which has the ids of begin and end alone. Repeated rows and ids give a row each; an
    empty table gives none; other columns are not read. Nothing is shuffled. A task holds SLICE_CHARS characters and the ids
    of the text at hand, and REMEMBERED words or so; a longer text is encoded in stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(model or default_model())
        encoder = Encoder(found)
        begin, end = np.array([found.begin], "<u4").tobytes(), np.array([found.end], "<u4").tobytes()
        for batch in batches:
            id, parts, at = batch.column("doc_id"), [begin], 0
            for held in _slices(batch.column("text")):
                out = []
                for (_, _, last), ids in zip(held, encoder.encode([h[1] for h in held]), strict=True):
                    parts.append(ids.astype("<u4").tobytes())
                    if last:
                        out.append(b"".join([*parts, end]))
                        parts = [begin]
                if out:
                    yield pa.RecordBatch.from_arrays([id.slice(at, len(out)), pa.array(out, pa.binary())], ["doc_id", "ids"])
                    at += len(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` with ``text`` in place of ``ids`` (as from ``encode``): exactly what the library decodes. Null ids give a null text;
    an id that the vocabulary lacks is an error."""
    kept = [c for c in rows.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(model or default_model())
        for batch in batches:
            ids = batch.column("ids")
            texts = [None if x is None else found.text(np.frombuffer(x, "<u4")) for x in (ids[i].as_py() for i in range(len(ids)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.binary()).cast(pa.string())], [*kept, "text"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "text string"])
    return rows.select(*(F.col(f"`{c}`") for c in kept), "ids").mapInArrow(run, schema)
