"""SentencePiece encoding of merge-type (BPE) vocabularies by a score-ordered agenda, and decoding.

A text is normalised by the library, then cut before every run of word-start marks.  No piece of such a vocabulary holds
a mark after another character (looked up when the model is opened; otherwise texts stay whole), so a merge never spans
a cut and each distinct unit is encoded once for a task.

A unit starts as its characters.  The agenda holds each pair of adjacent symbols whose concatenation is a piece, ordered
by score, then from the left.  The first pair is merged, its neighbours enter with the new symbol, and entries that no
longer describe their pair are passed over when they come up.  A long unit has a heap for its agenda; short units, which
are most, keep theirs side by side in arrays, and each round takes the first entry of every one.  Characters outside the
vocabulary become byte pieces.

Every Arrow batch is checked against the sentencepiece library: all units new to the task and one whole text.  A
difference (another model type, user-defined pieces) is an error, never a silent other result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MARK = "▁"
#: Units kept by a task, and the characters they may hold together; both only bound the table, not the results.
MAX_UNITS = 400_000
MAX_UNIT_CHARS = 8_000_000
#: Units of more characters have an agenda of their own.
SHORT_UNIT = 48
WHOLE_TEXT_CHECK = 50_000
_NONE = 1 << 30


class PieceModel:
    """A merge-type vocabulary opened from a model file."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        # equal scores share a place in the order; the leftmost of such pairs goes first
        place = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.place = {p: place[sp.get_score(i)] for p, i in self.ids.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = re.compile(r"(?s).+" if whole else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}
        # for the agendas side by side: symbols by number (characters outside the vocabulary lie beyond its size) and,
        # for every two pieces that make a third, their numbers, its place and its number
        self.size = size
        self.number = np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.number[ord(p)] = i
        number = self.ids
        rules = [(self._symbol(p[:k], number) * (size + 0x110000) + self._symbol(p[k:], number), self.place[p], i)
                 for p, i in self.ids.items() for k in range(1, len(p))
                 if (k == 1 or p[:k] in number) and (len(p) - k == 1 or p[k:] in number)]
        self.rules = np.array(sorted(rules), np.int64).reshape(-1, 3)

    def _symbol(self, text: str, number: dict[str, int]) -> int:
        return number[text] if text in number else self.size + ord(text)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of symbols the line of its rule, -1 if they make no piece."""
        keys = a * (self.size + 0x110000) + b
        at = np.minimum(np.searchsorted(self.rules[:, 0], keys), len(self.rules) - 1)
        return np.where(self.rules[at, 0] == keys, at, -1)

    def merged_side_by_side(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units end to end and how many each unit has, when all agendas are empty."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        done = np.zeros(len(units), np.int64)
        results: list[tuple[np.ndarray, np.ndarray]] = []
        symbols = self.number[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        of = np.repeat(np.arange(len(units)), lengths)
        rule = np.full(len(symbols), -1)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rule[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        places = np.append(self.rules[:, 1], _NONE)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            first = np.minimum.reduceat(places[rule] << 32 | np.arange(len(symbols)), starts)
            busy = (first >> 32) < _NONE
            sizes = np.diff(np.append(starts, len(symbols)))
            idle = np.repeat(~busy, sizes)
            done[of[starts[~busy]]] = sizes[~busy]
            results.append((of[idle], symbols[idle]))
            at = first[busy] & 0xFFFFFFFF
            symbols[at] = self.rules[rule[at], 2]
            keep = ~idle
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            symbols, of, rule = symbols[keep], of[keep], rule[keep]
            # the pairs that the new symbol makes with its neighbours enter the agenda in place of the old ones
            for left in (at, at[at > 0] - 1):
                rule[left] = -1
                left = left[left + 1 < len(of)]
                left = left[of[left] == of[left + 1]]
                rule[left] = self._pairs(symbols[left], symbols[left + 1])
        if not results:
            return symbols, done
        order = np.argsort(np.concatenate([r[0] for r in results]), kind="stable")
        return np.concatenate([r[1] for r in results])[order], done

    def merged(self, unit: str) -> list[str]:
        """The symbols that are left when the agenda is empty."""
        symbols, n, place = list(unit), len(unit), self.place.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        wanted = [-1] * n  # of each pair, by its left symbol: its place in the order, -1 if it is no piece
        agenda = []
        for i in range(n - 1):
            p = place(symbols[i] + symbols[i + 1])
            if p is not None:
                wanted[i] = p
                agenda.append(p << 40 | i)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & 0xFFFFFFFFFF
            if wanted[i] != entry >> 40:
                continue
            j = right[i]
            k = right[j]
            symbols[i] = here = symbols[i] + symbols[j]
            symbols[j] = ""
            wanted[i] = wanted[j] = -1
            right[i] = k
            if k < n:
                left[k] = i
                p = place(here + symbols[k])
                if p is not None:
                    wanted[i] = p
                    heappush(agenda, p << 40 | i)
            h = left[i]
            if h >= 0:
                p = place(symbols[h] + here)
                wanted[h] = -1 if p is None else p
                if p is not None:
                    heappush(agenda, p << 40 | h)
        return [s for s in symbols if s]

    def unit_ids(self, unit: str) -> list[int]:
        out = []
        for symbol in self.merged(unit):
            i = self.ids.get(symbol)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return out

    def _expanded(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as their byte pieces, or the unknown piece."""
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd) == 0:
            return symbols, counts
        spelt = [[self.bytes[b] for b in chr(c).encode()] if self.bytes else [self.unknown] for c in (symbols[odd] - self.size).tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = [len(x) for x in spelt]
        out = np.repeat(symbols, sizes)
        out[np.repeat(symbols >= self.size, sizes)] = np.concatenate(spelt)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return out, np.diff(ends[bounds])

    def _learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= SHORT_UNIT]
        ids, counts = self._expanded(*self.merged_side_by_side(short))
        units = short + [u for u in units if len(u) > SHORT_UNIT]
        spelt = [self.unit_ids(u) for u in units[len(short):]]
        ids = np.concatenate([ids, *spelt]).astype(self.dtype)
        counts = np.concatenate((counts, [len(x) for x in spelt])).astype(np.int64)
        self._check(units, ids, counts)
        raw, ends = ids.tobytes(), (np.cumsum(counts) * self.dtype.itemsize).tolist()
        coded = [raw[i:j] for i, j in zip([0, *ends], ends)]
        self.known.update(zip(units, coded))

    def _check(self, units: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """All units against the library, which puts a mark before a text: a unit's own first mark is left to it."""
        asked = np.fromiter((u[0] == MARK for u in units), bool, len(units))
        probes = [u[1:].replace(MARK, " ") for u in units if u[0] == MARK]
        wanted = self.library.encode(probes, num_threads=1) if probes else []
        sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
        if (sizes == counts[asked]).all() and (np.fromiter(chain.from_iterable(wanted), self.dtype) == ids[np.repeat(asked, counts)]).all():
            return
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for unit, part, want in zip([u for u in units if u[0] == MARK], [p for p, a in zip(parts, asked) if a], wanted):
            # a normaliser that strips or folds may turn the probe into another unit
            if part.tolist() != want and self.library.normalize(unit[1:].replace(MARK, " ")) == unit:
                raise ValueError(f"the library encodes {unit!r} as {want}, the agenda as {part.tolist()}")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin or end ids."""
        if len(self.known) > MAX_UNITS or sum(map(len, self.known)) > MAX_UNIT_CHARS:
            self.known.clear()
        cut = [self.cut.findall(t) for t in self.library.normalize(texts)] if texts else []
        new = set().union(*cut).difference(self.known)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, units)), self.dtype) for units in cut]
        probe = min((k for k, t in enumerate(texts) if 0 < len(t) <= WHOLE_TEXT_CHECK), key=lambda k: -len(texts[k]), default=None)
        if probe is not None and out[probe].tolist() != self.library.encode(texts[probe], num_threads=1):
            raise ValueError(f"the library and the agenda differ on the text {texts[probe][:200]!r}...")
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1) if ids else []


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in small_batches(batches, "text", 1 << 20):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            ids = model.encode(texts)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                 pa.array(model.decode(ids), pa.string())], names=["id", "ids", "decoded"])
    return run


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``ids`` (array of int) and ``decoded``, the text that the ids decode to.

    ``path`` names the model file on every executor.  A null or empty text has no ids and decodes to an empty text; null
    and repeated ids are carried as they are, each row on its own.  Other columns of ``docs`` are not looked at.  Texts
    are encoded whole; a text of more than 2**31 ids or bytes does not fit an Arrow batch.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])
    return rows.mapInArrow(_coder(path), schema).withColumnRenamed("id", id_col)
