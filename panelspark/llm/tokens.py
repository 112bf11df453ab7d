"""Token ids of whole texts by a ``tokenizers`` vocabulary, with each distinct piece encoded once for a worker.

A text is cut at single spaces whose neighbours are not white space; no tokenizer of the supplied kinds looks across such
a cut, so the ids of a text are those of its units (the space leading each unit but the first).  Units are found by
vectorised hashing, looked up in a sorted table, and only those never seen go through the tokenizer.  Texts with white
space next to white space are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array

import numpy as np
import regex

from .common import group_starts, ranges, span_hashes

_WHITE_RUN = re.compile(r"\s\s")
_LATIN = re.compile(r"[\x00-ɏ]*")
_WHITE, _WIDE = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(0x1C, 0x21)]] = True
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # bytes that begin every white space character beyond ASCII
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SEP = "\x00"
# How the two kinds of public vocabulary cut a text before merging, with units set apart by _SEP.
_PIECES = {
    "ByteLevel": r"""\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?![^\s\x00])|\s+""",
    "Sequence": r"""\x00|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\x00]+""",
}
# the letters that stand for bytes: printable ones for themselves, the others from 256 on (_SEP stays)
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
_LETTERS = np.arange(256, dtype="<u2")
_LETTERS[_OTHERS] = np.arange(256, 256 + len(_OTHERS))
_LETTERS[0] = 0
_MAX_UNITS = 600_000
_MAX_PIECES = 200_000


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Spans in order, set apart by _SEP."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.insert(data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)], np.cumsum(ends - starts)[:-1], 0).tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts; ``ids`` are uint16 or uint32 by the size of the vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        kind = type(self.tok.pre_tokenizer).__name__
        self.lower = type(self.tok.normalizer).__name__ == "Sequence"
        if kind not in _PIECES:
            raise ValueError(f"pre-tokenizer {kind} is not supported")
        self.pieces = regex.compile(_PIECES[kind])
        self.spaced = kind == "ByteLevel"
        self.model = self.tok.model
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)   # sorted
        self.slots = np.empty(0, np.int64)     # of each hash: its place in begin and length
        self.begin = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.pool = np.empty(0, self.dtype)

    def encode_text(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encode_pieces(self, pieces: list[str]) -> None:
        """Merges of pieces never seen, by the tokenizer's own model."""
        tokenize, known, code = self.model.tokenize, self.known, "H" if self.dtype == np.uint16 else "I"
        letters = _LETTERS[np.frombuffer(_SEP.join(pieces).encode(), np.uint8)].tobytes().decode("utf-16-le").split(_SEP)
        ids, ends = array(code), []
        gc.disable()  # a million short-lived token objects, none in a cycle
        for spelt in letters if pieces else ():
            ids.extend([t.id for t in tokenize(spelt)])
            ends.append(len(ids) * ids.itemsize)
        gc.enable()
        raw = ids.tobytes()
        known.update(zip(pieces, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def _coded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as bytes."""
        distinct = set(pieces)
        if len(self.known) > _MAX_PIECES:
            self.known = {p: self.known[p] for p in distinct if p in self.known}
        self.known[_SEP] = b""
        self._encode_pieces([p for p in distinct if p not in self.known])
        return list(map(self.known.__getitem__, pieces))

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Units of ASCII letters after a space or none: each is one piece."""
        if not len(starts):
            return np.empty(0, np.int64), b""
        joined = _joined(data, starts, ends)
        if self.lower:
            joined = joined.lower()
        coded = self._coded((joined if self.spaced else joined.replace(" ", "")).split(_SEP))
        return np.fromiter(map(len, coded), np.int64, len(coded)) // np.dtype(self.dtype).itemsize, b"".join(coded)

    def _encode_units(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Number of ids and ids of units never seen, in text order; only their distinct pieces reach the model."""
        if not len(starts):
            return np.empty(0, np.int64), b""
        joined = _joined(data, starts, ends)
        odd = []
        if _LATIN.fullmatch(joined) is None or joined.count(_SEP) != len(starts) - 1 or (self.added and self.added.search(joined)):
            units = [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts.tolist(), ends.tolist())]
            odd = [k for k, u in enumerate(units) if _SEP in u or not _LATIN.fullmatch(u) or (self.added and self.added.search(u))]
            whole = {k: self.encode_text(units[k]) for k in odd}
            for k in odd:
                units[k] = ""
            joined = _SEP.join(units)
        if self.lower:
            joined = unicodedata.normalize("NFC", joined).lower()
        pieces = self.pieces.findall(joined)
        coded = self._coded(pieces)
        cuts = np.flatnonzero(np.fromiter(map(_SEP.__eq__, pieces), bool, len(pieces)))
        sums = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))))) // np.dtype(self.dtype).itemsize
        lengths = np.diff(np.concatenate(([0], sums[cuts], [sums[-1]])))
        ids = b"".join(coded)
        if odd:
            flat, ends = np.frombuffer(ids, self.dtype), np.cumsum(lengths)
            parts = [whole[k] if k in whole else flat[ends[k] - lengths[k]: ends[k]] for k in range(len(starts))]
            return np.array([len(x) for x in parts], np.int64), np.concatenate(parts).tobytes()
        return lengths, ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and the n+1 offsets of each text's ids."""
        n = len(offsets) - 1
        raw = data.tobytes()
        whole = self._whole_texts(raw, data, offsets)
        # units: a space begins one, unless it is the first byte of a text (the tokenizer sees it there as well)
        cut = data == 0x20
        starts_here = np.zeros(len(data) + 1, bool)
        starts_here[offsets[:-1]] = True
        starts_here = starts_here[:-1]
        starts = np.flatnonzero(cut | starts_here)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = span_hashes(data, starts, ends)
        by_hash = np.argsort(hashes)
        first = np.zeros(len(hashes), bool)
        first[group_starts(hashes[by_hash])] = True
        at = by_hash[first]
        unique, inverse = hashes[at], np.empty(len(hashes), np.int64)
        inverse[by_hash] = np.cumsum(first) - 1
        place = np.searchsorted(self.hashes, unique)
        found = place < len(self.hashes)
        found[found] = self.hashes[place[found]] == unique[found]
        if not found.all():
            new = np.flatnonzero(~found)
            new = new[np.argsort(at[new])]
            s, e = starts[at[new]], ends[at[new]]
            plain = np.concatenate(([0], np.cumsum(~_LETTER[data])))
            led = data[s] == 0x20
            plain = (plain[e] - plain[s] == led) & (e - s > led)
            new, parts = np.concatenate((new[plain], new[~plain])), (self._encode_words(data, s[plain], e[plain]),
                                                                     self._encode_units(raw, data, s[~plain], e[~plain]))
            sizes, ids = np.concatenate([x for x, _ in parts]), b"".join(x for _, x in parts)
            if len(self.hashes) + len(new) > _MAX_UNITS:
                old = unique[found]
                keep = self.slots[place[found]]
                lengths, pool = self.length[keep], self.pool[ranges(self.begin[keep], self.length[keep])]
                self._forget()
                self._add(old, lengths, pool)
            self._add(unique[new], sizes, np.frombuffer(ids, self.dtype))
            place = np.searchsorted(self.hashes, unique)
        slot = self.slots[place][inverse] if len(unique) else np.empty(0, np.int64)
        lengths = self.length[slot]
        flat = self.pool[ranges(self.begin[slot], lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        bounds = sums[np.searchsorted(starts, offsets)]
        if not whole:
            return flat, bounds
        parts = [whole[i] if i in whole else flat[bounds[i]: bounds[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.slots = np.insert(self.slots, place, order + len(self.begin))
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths))
        self.pool = np.concatenate((self.pool, ids))

    def _whole_texts(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Texts with white space beside white space, encoded as they are."""
        if not (_WHITE[data[1:]] & _WHITE[data[:-1]]).any() and not _WIDE[data].any():
            return {}
        out = {}
        for i in range(len(offsets) - 1):
            one = raw[offsets[i]: offsets[i + 1]].decode("utf-8", "replace")
            if _WHITE_RUN.search(one):
                out[i] = self.encode_text(one)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its table of units outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
