"""Token ids of byte-level BPE vocabularies, as the ``tokenizers`` library gives them, for whole Arrow batches.

The library splits a text into pieces with a fixed pattern and encodes each piece by itself.  Pieces repeat, so this
module finds the borders of all pieces of a batch with array operations, hashes the pieces, and asks the library only for
pieces that this worker has not met.  The store of known pieces is bounded (``KNOWN``); it is emptied when full.

Texts with a special token's string, or with a character whose class may differ between Unicode versions, are encoded
by the library as they are.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np

from .kernel import _U, HashIndex, mix, powers

#: Known pieces held by a worker at most.
KNOWN = 1_500_000
_OTHER, _LETTER, _DIGIT, _SPACE, _BORDER, _ASK = range(6)


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(0x110000, _ASK, np.uint8)
    # Blocks without newly assigned characters since long before any Unicode version in use.
    stable = [(0x20, 0x7F), (0xA1, 0x378), (0x388, 0x3FF), (0x400, 0x527), (0x2010, 0x2027), (0x2030, 0x205E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    for lo, hi in stable:
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))
            if kind != "Cn":
                out[c] = {"L": _LETTER, "N": _DIGIT, "Z": _ASK}.get(kind[0], _OTHER)
    out[[0x20, *range(9, 14)]] = _SPACE
    out[0] = _BORDER
    return out


class BatchBPE:
    """Encoder for the tokenizer file at ``path`` (a ``.json`` of the tokenizers library with a ByteLevel splitter)."""

    _made: dict[str, BatchBPE] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kind = _classes()
        self.forget()

    @classmethod
    def get(cls, path: str) -> BatchBPE:
        """One encoder per worker and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.index = HashIndex(np.zeros(0, np.uint64))

    def _pieces(self, cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Flags of the characters that start a piece."""
        n = len(cp)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = _BORDER, kind[:-1]
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = _BORDER, kind[1:]
        gap = kind == _SPACE
        start = kind != before
        # A run of white space before other text gives up its last character ...
        start |= gap & (after != _SPACE) & (after != _BORDER)
        # ... which, if it is a plain space, belongs to the piece that follows.
        blank = np.empty(n, bool)
        blank[0], blank[1:] = False, cp[:-1] == 0x20
        start &= ~(blank & ~gap & (kind != _BORDER))
        quote = np.flatnonzero((cp == 0x27) & start & (after == _LETTER))
        if len(quote):
            far = np.append(cp, [0, 0, 0])
            one, two = far[quote + 1], far[quote + 2]
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))), 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            rest = quote + size
            rest = rest[rest < n]
            start[rest] |= kind[rest] == _LETTER
        return start

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and offsets of each text's ids; no begin, end or added tokens."""
        n = len(texts)
        lengths = np.zeros(n, np.int64)
        direct: dict[int, np.ndarray] = {}
        if self.plain:
            joined = "\0".join(texts) + "\0"
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = self.kind[cp]
            size = np.fromiter(map(len, texts), np.int64, n)
            stop = np.cumsum(size + 1) - 1
            odd = kind == _ASK
            marks = np.searchsorted(stop, np.flatnonzero(odd), "left")
            ask = set(np.unique(marks).tolist())
            if int((cp == 0).sum()) != n:
                ask |= {i for i, t in enumerate(texts) if "\0" in t}
            for s in self.special:
                if s in joined:
                    ask |= {i for i, t in enumerate(texts) if s in t}
        else:
            ask = set(range(n))
        for i in sorted(ask):
            direct[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        if self.plain and len(ask) < n:
            ids, sizes, which = self._fast(joined, cp, kind, stop)
            if ask:
                keep = ~np.isin(which, np.fromiter(ask, np.int64, len(ask)))
                ids, sizes, which = ids[keep], sizes[keep], which[keep]
            np.add.at(lengths, which, sizes)
            flat = self._gather(ids, sizes)
        else:
            flat = np.zeros(0, np.uint32)
        for i, x in direct.items():
            lengths[i] = len(x)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not direct:
            return flat, offsets
        out, rest = np.empty(offsets[-1], np.uint32), np.ones(offsets[-1], bool)
        for i, x in direct.items():
            out[offsets[i] : offsets[i + 1]] = x
            rest[offsets[i] : offsets[i + 1]] = False
        out[rest] = flat
        return out, offsets

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        return np.diff(self.encode(texts)[1])

    def _gather(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(sizes)
        shift = np.repeat(self.begin[at] - (ends - sizes), sizes)
        return self.ids[shift + np.arange(total)]

    def _fast(self, joined: str, cp: np.ndarray, kind: np.ndarray, stop: np.ndarray):
        start = np.flatnonzero(self._pieces(cp, kind))
        start = start[kind[start] != _BORDER]
        # A piece ends where the next starts, or at its text's border.
        which = np.searchsorted(stop, start, "left")
        end = np.minimum(np.append(start[1:], len(cp)), stop[which])
        p, inv = powers(len(cp) + 1)
        value = cp.astype(np.uint64)
        value += _U(1)
        value *= _U(0xA24BAED4963EE407)
        value ^= value >> _U(29)
        value *= p[: len(cp)]
        total = np.empty(len(cp) + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        key = mix((total[end] - total[start]) * inv[start])
        at = self.index.find(key)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(key[missing], return_index=True)
            if len(self.index.keys) + len(new) > KNOWN and len(self.index.keys):
                self.forget()
                return self._fast(joined, cp, kind, stop)
            spot = missing[first]
            got = self.library.encode_batch_fast([joined[s:e] for s, e in zip(start[spot].tolist(), end[spot].tolist(), strict=True)], add_special_tokens=False)
            lists = [x.ids for x in got]
            size = np.fromiter(map(len, lists), np.int32, len(lists))
            ids = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size, dtype=np.int64) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
            self.index.add(new)
            at = self.index.find(key)
        return at, self.size[at].astype(np.int64), which


def version_digest(path: str) -> str:
    """What a tokenizer does is fixed by its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"ids-only\0" + f.read()).hexdigest()
