"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is escaped as the model says and parted where no piece can cross (before white space marks). Distinct parts
of equal length advance together: at every end position the hashes of all substrings up to the longest piece probe
the sorted piece keys, and a vectorised maximum over the lengths stores the back pointers.

For unigram models the maximum is of summed piece scores. For byte-pair models it is of admissibility: the encoding
of a prefix ends in the one piece that, together with the last piece of the prefix before it, encodes to just these
two. This pair test, which decides such models' merges exactly, is remembered per pair: lately met pairs in an array by slot, others in a table.

Characters without a piece become byte pieces where the model has them, else the unknown id. Models with a
character map are refused: a normaliser is not part of this operator.

Edge cases: null and empty texts have no ids; rows may repeat; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeproof.llm.workers import kept, serving

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PRIME = np.uint64(0x100000001B3)
_SLOT = np.uint64(0x9E3779B97F4A7C15)
#: Codes are piece ids, or ``-1 - code point`` for characters without a piece.
_NONE, _SHIFT = np.iinfo(np.int64).min, 0x110000 + 1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0], at + n
        yield tag >> 3, value


class _Remembered:
    """A table of two generations: what is not asked for again while one fills up is forgotten."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def renew(self, most: int) -> None:
        if len(self.young) > most:
            self.old, self.young = self.young, {}

    def recall(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found


@dataclass
class PieceModel:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = True
    #: Parts and pairs in the young generation of what is remembered, about, at most.
    memory: int = 40_000
    #: Characters from which on a part is cut at its seams.
    long: int = 48
    _parts: _Remembered = field(default_factory=_Remembered, repr=False)
    _pairs: _Remembered = field(default_factory=_Remembered, repr=False)

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, scores, kinds, options = [], [], [], {"model": UNIGRAM}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(own.get(2, 0.0))
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                options["model"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map are not supported")
                options |= {"dummy_prefix": bool(own.get(3, 1)), "squeeze": bool(own.get(4, 1))}
        return cls(pieces, np.array(scores), np.array(kinds), **options)

    def __post_init__(self) -> None:
        if self.model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        if (self.kinds == USER).any() or self.model == BPE and (self.kinds == UNUSED).any():
            raise ValueError("user-defined pieces, and unused ones of byte-pair models, are not supported")
        own = np.flatnonzero(self.kinds == NORMAL)
        self.ids = {self.pieces[i]: int(i) for i in own}
        self.longest = max(map(len, self.ids), default=1)
        texts = list(self.ids)
        keys = np.array([_key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        if len(keys) > 1 and (np.diff(keys[order]) == 0).any():
            raise ValueError("piece keys collide")
        self.keys = keys[order]
        self.key_ids = np.array([self.ids[t] for t in texts], np.int64)[order]
        self.sizes = np.array([len(t) for t in texts], np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece and fail here
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.recent, self.recent_good = np.zeros(1 << 20, np.int64), np.zeros(1 << 20, bool)
        self.bytes = {int(self.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(self.kinds == BYTE)}
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else 0
        self.surfaces = ["" if k == CONTROL else t.replace(MARK, " ") for t, k in zip(self.pieces, self.kinds.tolist())]
        if self.unknown < len(self.surfaces):
            self.surfaces[self.unknown] = " ⁇ "
        for b, i in self.bytes.items():  # bytes meet as escapes and are read as UTF-8 together
            self.surfaces[i] = bytes([b]).decode("utf-8", "surrogateescape")
        self.floor = float(self.scores[own].min(initial=0.0)) - 10.0
        crossing = any(MARK in t.lstrip(MARK) for t in texts)
        self.parts = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+" if not crossing else r"(?s).+")

        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        #: Neighbouring characters inside pieces; no piece crosses any other pair.
        self.inner = np.unique(points[:-1] << 21 | points[1:])

    def seamed(self, part: str) -> list[str]:
        """A long part cut where no piece can cross, which changes no encoding: time follows its length, and what is cut off is remembered."""
        if len(part) <= self.long or not self.bytes:  # without byte pieces unknown neighbours become one
            return [part]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.inner, pairs), len(self.inner) - 1)
        cuts = [0, *(np.flatnonzero(self.inner[at] != pairs) + 1).tolist(), len(part)]
        return [part[a:b] for a, b in zip(cuts, cuts[1:])]

    def escaped(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges one at a time: the highest score first, the leftmost among equals."""
        own = list(text)
        while len(own) > 1:
            best, where = None, -1
            for i in range(len(own) - 1):
                at = self.ids.get(own[i] + own[i + 1])
                if at is not None and (best is None or self.scores[at] > best):
                    best, where = self.scores[at], i
            if where < 0:
                break
            own[where : where + 2] = [own[where] + own[where + 1]]
        return own

    def admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right code may follow its left one, which is ``_NONE`` at a part's start."""
        first = np.where(left == _NONE, 0, left + _SHIFT + 1)
        codes = first << np.int64(32) | (right + _SHIFT)
        slots = ((codes.view(np.uint64) * _SLOT) >> np.uint64(44)).astype(np.int64)
        good, fresh = self.recent_good[slots], np.flatnonzero(self.recent[slots] != codes)
        if len(fresh):
            new, at, where = np.unique(codes[fresh], return_index=True, return_inverse=True)
            found = np.array([self._pair(code) for code in new.tolist()], bool)
            own = slots[fresh][at]
            self.recent[own] = new
            self.recent_good[own] = found
            # two codes of one slot: only the last is remembered
            good[fresh] = found[where]
        return good

    def _pair(self, code: int) -> bool:
        known = self._pairs.recall(code)
        if known is None:
            self._pairs.renew(self.memory)
            pair = [self._text((code & 0xFFFFFFFF) - _SHIFT)]
            if code >> 32:
                pair.insert(0, self._text((code >> 32) - _SHIFT - 1))
            known = self._pairs.young[code] = self.merged("".join(pair)) == pair
        return known

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as 32-bit numbers."""
        n, size = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros((n, size + 1), np.uint64)
            for j in range(size):
                sums[:, j + 1] = sums[:, j] * _PRIME + points[:, j] + np.uint64(1)
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, _PRIME, np.uint64)]))
        score = np.full((n, size + 1), -np.inf)
        score[:, 0] = 0
        back = np.zeros((n, size + 1), np.int32)
        last = np.full((n, size + 1), _NONE, np.int64)
        every, piece = np.arange(n), np.empty(n, np.int64)
        for end in range(1, size + 1):
            lengths = range(1, min(self.longest, end) + 1)
            for length in reversed(lengths):
                live = np.flatnonzero(np.isneginf(score[:, end])) if self.model == BPE else every
                if not len(live):
                    break
                with np.errstate(over="ignore"):
                    key = sums[live, end] - sums[live, end - length] * powers[length]
                rows = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                hit = (self.keys[at] == key[rows]) & (self.sizes[at] == length)
                rows, ids = live[rows[hit]], self.key_ids[at[hit]]
                if length == 1:
                    piece[:] = -1 - points[:, end - 1].astype(np.int64)
                    piece[rows] = ids
                    rows = live
                else:
                    piece[rows] = ids
                if not len(rows):
                    continue
                if self.model == BPE:
                    rows = rows[self.admissible(last[rows, end - length], piece[rows])]
                    value = np.zeros(len(rows))
                else:
                    value = score[rows, end - length] + np.where(piece[rows] >= 0, self.scores[np.maximum(piece[rows], 0)], self.floor)
                    better = value > score[rows, end]
                    rows, value = rows[better], value[better]
                score[rows, end], back[rows, end], last[rows, end] = value, end - length, piece[rows]
        rows, at, held, taken = np.arange(n), np.full(n, size), np.zeros((n, size), np.int32), np.zeros((n, size), bool)
        while len(rows):  # back from the ends, one piece at a time
            held[rows, at - 1], taken[rows, at - 1] = last[rows, at], True
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        flat, ends = held[taken].tobytes(), (4 * np.cumsum(taken.sum(1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(((held < 0) & taken).any(1)).tolist():
            out[i] = self._final(np.frombuffer(out[i], np.int32).tolist())
        return out

    def _text(self, code: int) -> str:
        return self.pieces[code] if code >= 0 else chr(-1 - code)

    def _final(self, codes: list[int]) -> bytes:
        """Codes of characters without a piece as bytes or as the unknown piece."""
        out: list[int] = []
        for c in codes:
            if c >= 0:
                out.append(c)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids as 32-bit numbers. Parts are remembered as bytes, which the collector of cycles has not to walk."""
        split = [[x for part in self.parts.findall(self.escaped(t)) for x in (self.seamed(part) if len(part) > self.long else (part,))] for t in texts]
        fresh: dict[int, set[str]] = {}
        self._parts.renew(self.memory)
        for own in split:
            for w in set(own).difference(self._parts.young):
                if self._parts.recall(w) is None:
                    fresh.setdefault(len(w), set()).add(w)
        for group in fresh.values():
            words = list(group)
            step = max(1, 1_000_000 // len(words[0]))
            for i in range(0, len(words), step):
                self._parts.young.update(zip(words[i : i + step], self._viterbi(words[i : i + step])))
        held = self._parts.young.__getitem__
        return [b"".join(map(held, own)) for own in split]

    def forget(self) -> None:
        """Drop what is remembered: a worker that waits for its next task holds the model alone."""
        self._parts, self._pairs = _Remembered(), _Remembered()

    def decode(self, ids: list[int]) -> str:
        surfaces = self.surfaces
        text = "".join([surfaces[i] for i in ids]).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _key(text: str) -> int:
    out = 0
    for c in text:
        out = (out * int(_PRIME) + ord(c) + 1) & (2**64 - 1)
    return out


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> PieceModel:
    return PieceModel.parse(data)


kept(_loaded.cache_clear)


def read_model(path: str) -> bytes:
    """A model file's bytes (half a megabyte for 32,000 pieces), to be sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(model: bytes, rest: int, slice_rows: int = 1_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(model)
        for whole in batches:
            for batch in (whole.slice(i, slice_rows) for i in range(0, whole.num_rows, slice_rows)):
                texts = [t or "" for t in batch.column(rest).to_pylist()]
                ids = own.packed(texts)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                digests = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [own.decode(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:rest], pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(digests, pa.string()), pa.array(back, pa.bool_())], names=[*batch.schema.names[:rest], "n_tokens", "ids", "ids_sha256", "round_trip"])
        own.forget()

    return run


def _decoder(model: bytes, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:rest], pa.array([own.decode(x or []) for x in batch.column(rest).to_pylist()], pa.string())], names=[*batch.schema.names[:rest], "text"])

    return run


def _schema(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The other columns with ``n_tokens, ids, ids_sha256`` (of little-endian 32-bit ids) and ``round_trip``."""
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids", "ids_sha256", "round_trip")]
    return docs.select(*rest, text_col).mapInArrow(serving("pieces", _encoder(model, len(rest))), f"{_schema(docs, rest)}n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean")


def decode_documents(rows: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """The other columns with ``text``."""
    rest = [c for c in rows.columns if c not in (ids_col, "text")]
    return rows.select(*rest, ids_col).mapInArrow(serving("pieces", _decoder(model, len(rest))), f"{_schema(rows, rest)}text string")
