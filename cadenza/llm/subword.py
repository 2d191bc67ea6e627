"""Sampled subword segmentations of a SentencePiece vocabulary, without replacement, and decoding."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _U, HashIndex, bound_batches, mix

#: Bytes of text whose lattices are held at once.
STEP = 256 << 10
#: Branches whose log probability lies so far below that of the prefix a path began with are not opened: the chance that one
#: of them would be wanted is some exp(-NEGLIGIBLE), 1e-16.
NEGLIGIBLE = 37.0
#: Log probabilities are added as whole numbers of this part.
GRAIN = float(1 << 36)
_WORD = re.compile("▁*[^▁]+|▁+")


def _poly(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any stretch of characters follows, and powers with their inverses."""
    n = len(codes) + 1
    base = 0x9E3779B97F4A7C15
    p, inv = (np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(x), np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    total = np.zeros(n, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(1)) * p[:-1], out=total[1:])
    return total, p, inv


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)])


class Lattice:
    """Segmentation lattices over the vocabulary of the model at ``path``.

    A piece of score s has weight (2.7 - s) ** -alpha: scores of these vocabularies are ranks, so weights fall like word
    frequencies.  Scores below -1e6 count as that; below -1e8 only single characters are pieces.  A segmentation's probability is its pieces' weights' product over the sum of all segmentations'.  No piece
    crosses the start of a word, so a text's lattice is a chain of its words'.  A character without a piece is its bytes.
    """

    _made: dict[tuple, Lattice] = {}

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[str, tuple[int, float]] = {}
        self.byte = np.full(256, self.model.unk_id(), np.int32)
        for i in range(self.model.get_piece_size()):
            piece, score = self.model.id_to_piece(i), self.model.get_score(i)
            if self.model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)) and (score > -1e8 or len(piece) == 1):
                pieces[piece] = (i, -alpha * math.log(2.7 - max(score, -1e6)))
        self.longest = max(map(len, pieces))
        self.crossing = any("▁" in p.lstrip("▁") for p in pieces)
        self.rare = -alpha * math.log(2.7 + len(pieces))
        flat, edge = _codes(list(pieces))
        total, _, inv = _poly(flat)
        self.index = HashIndex(mix((total[edge[1:]] - total[edge[:-1]]) * inv[edge[:-1]] + np.diff(edge).astype(np.uint64)))
        self.piece_id = np.array([i for i, _ in pieces.values()], np.int32)
        self.piece_weight = np.array([w for _, w in pieces.values()])
        self.piece_codes, self.piece_edge = flat, edge

    @classmethod
    def get(cls, path: str, alpha: float = 1.0) -> Lattice:
        if (path, alpha) not in cls._made:
            cls._made[path, alpha] = cls(path, alpha)
        return cls._made[path, alpha]

    def words(self, text: str) -> list[str]:
        shown = self.model.normalize(text)
        return [shown] if self.crossing and shown else _WORD.findall(shown)

    def sample(self, text: str, k: int, seed: bytes) -> list[tuple[list[int], float, float]]:
        return [(ids.tolist(), lp, inclusion) for _, ids, lp, inclusion in Charts(self, [text]).sample(k, [seed])]


class Charts:
    """Lattices of some texts' words as flat arrays: a node for each place in a distinct word, edges sorted by their node.

    ``step`` is the log probability of taking an edge at its node; ``upto`` has the running sums of a node's probabilities."""

    def __init__(self, lattice: Lattice, texts: Sequence[str]):
        number: dict[str, int] = {}
        self.texts = [np.array([number.setdefault(w, len(number)) for w in lattice.words(t)], np.int64) for t in texts]
        flat, edge = _codes(list(number))
        n_words = len(number)
        # A word's nodes are its characters; places are counted with one more for each word's end.
        word = np.repeat(np.arange(n_words), np.diff(edge))
        node = np.arange(len(flat)) + word
        left = edge[1:][word] - np.arange(len(flat))
        total, _, inv = _poly(flat)
        begin, end, piece = [], [], []
        for size in range(1, min(lattice.longest, int(left.max(initial=0))) + 1):
            at = np.flatnonzero(left >= size)
            got = lattice.index.find(mix((total[at + size] - total[at]) * inv[at] + _U(size)))
            hit = got >= 0
            at, got = at[hit], got[hit].astype(np.int64)
            same = np.diff(lattice.piece_edge)[got] == size  # a piece is what it is by its characters, not its hash
            for k in range(size):
                same &= flat[np.minimum(at + k, len(flat) - 1)] == lattice.piece_codes[np.minimum(lattice.piece_edge[got] + k, len(lattice.piece_codes) - 1)]
            begin.append(at[same]), end.append(at[same] + size), piece.append(got[same])
        begin, end, piece = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begin, end, piece))
        alone = np.ones(len(flat), bool)
        alone[begin[end == begin + 1]] = False
        alone = np.flatnonzero(alone)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in flat[alone].tolist()]
        n_ids = np.concatenate([np.ones(len(begin), np.int64), np.fromiter(map(len, raw), np.int64, len(raw))])
        ids = np.concatenate([lattice.piece_id[piece], lattice.byte[np.frombuffer(b"".join(raw), np.uint8)]])
        weight = np.concatenate([lattice.piece_weight[piece], lattice.rare * n_ids[len(begin) :]])
        begin, end = np.concatenate([begin, alone]), np.concatenate([end, alone + 1])
        order = np.lexsort((end, begin))
        first_id = np.cumsum(n_ids) - n_ids
        self.ids, self.n_ids, self.first_id = ids, n_ids[order], first_id[order]
        begin, end, weight = begin[order], end[order], weight[order]
        # Sums over all ways to the end, from the last place of each word to its first.
        self.dest, self.weight = end + word[begin], weight
        n_nodes = len(flat) + n_words
        self.first = np.searchsorted(begin, np.arange(len(flat) + 1))
        ways, value = np.zeros(n_nodes), np.zeros(len(begin))
        rows = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[rows], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = rows[a:b]
            count = self.first[at + 1] - self.first[at]
            of = _ragged(self.first[at], count)
            v = weight[of] + ways[self.dest[of]]
            starts = np.cumsum(count) - count
            top = np.maximum.reduceat(v, starts)
            ways[node[at]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), starts))
            value[of] = v
        self.step = value - ways[node[begin]]
        # Shares of a node's edges, summed within the node alone, so that they don't depend on what else is held.
        place = np.arange(len(begin)) - self.first[begin]
        self.upto = np.zeros((len(flat), int(place.max(initial=0)) + 1))
        self.upto[begin, place] = np.exp(self.step)
        self.upto = np.cumsum(self.upto, axis=1)
        # By node, ends of words included: edges of its character.
        self.begin, self.char = begin, np.full(n_nodes, -1)
        self.char[node] = np.arange(len(flat))
        self.word_node = edge[:-1] + np.arange(n_words)

    def finish(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the best child, which is sampling by probability, from nodes to the ends of their words: (edges, of all
        starts one after the other, count of each).  A step's draw is a hash of the start's seed and the step."""
        at, steps = start.copy(), []
        live, count = np.flatnonzero(self.char[at] >= 0), np.zeros(len(start), np.int64)
        while len(live):
            c = self.char[at[live]]
            draw = _uniform(seed[live] + _odd(len(steps) + 1))
            edge = np.minimum(self.first[c] + (self.upto[c] <= draw[:, None]).sum(1), self.first[c + 1] - 1)
            steps.append((live, edge))
            count[live] += 1
            at[live] = self.dest[edge]
            live = live[self.char[at[live]] >= 0]
        out, first = np.zeros(int(count.sum()), np.int64), np.cumsum(count) - count
        for n, (rows, edge) in enumerate(steps):
            out[first[rows] + n] = edge
        return out, count

    def sample(self, k: int, seeds: Sequence[bytes]) -> list[tuple[int, np.ndarray, float, float]]:
        """For each text up to k segmentations: (text, ids, log probability, inclusion score), by falling perturbed value.

        A* over prefixes.  The bound of a prefix is the largest Gumbel-perturbed log probability among its completions, drawn
        top down; here as v = exp(-bound), the first arrival of an exponential race at the rate of the prefix's probability.  The
        best child inherits its parent's bound whatever that is, so a popped prefix is followed to the end by ``finish``.
        The other children along that path lose to it: their v are the parent's plus an exponential draw each.  Of them
        only as many as can still be wanted stay open.  All texts take their first paths together, then their second ones.

        The perturbed value of the segmentation after the k-th is the threshold from which inclusion scores follow; with k
        or fewer segmentations in all, every score is 1."""
        n = len(self.texts)
        base = np.array([int.from_bytes(hashlib.sha256(s).digest()[:8], "little") for s in seeds], np.uint64)
        race = -np.log1p(-_uniform(base))
        # v, log probability, edges so far, node in the word (-1: its first), number of the word
        open_: list[list[tuple]] = [[(float(v), 0.0, np.zeros(0, np.int64), -1, 0)] for v in race]
        out: list[list[tuple]] = [[] for _ in range(n)]
        for turn in range(k):
            rows = [r for r in range(n) if open_[r]]
            if not rows:
                break
            popped = [open_[r].pop(0) for r in rows]
            starts, sizes = [], []
            for r, (_, _, _, at, w) in zip(rows, popped, strict=True):
                nodes = self.word_node[self.texts[r][w:]]
                if at >= 0:
                    nodes[0] = at
                starts.append(nodes)
                sizes.append(len(nodes))
            size = np.array(sizes)
            row = np.repeat(np.arange(len(rows)), size)
            word = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat([p[4] for p in popped], size)
            own = base[rows] + _odd(2 * turn + 1)
            edges, count = self.finish(np.concatenate(starts).astype(np.int64), mix(own[row] ^ mix(word.astype(np.uint64) + np.uint64(1))))
            # Every edge taken: its path and word, and the log probability before it, counted from the popped prefix.
            path, word = np.repeat(row, count), np.repeat(word, count)
            length = np.bincount(path, minlength=len(rows))
            first = np.cumsum(length) - length
            # Sums of whole numbers, which are the same in any company.
            run = np.concatenate([[0], np.cumsum(np.rint(self.step[edges] * GRAIN).astype(np.int64))])
            before = (run[:-1] - run[first][path]) / GRAIN
            whole = (run[first + length] - run[first]) / GRAIN
            place = np.arange(len(edges)) - first[path]
            # Their siblings.
            c = self.begin[edges]
            some = np.flatnonzero((before > -NEGLIGIBLE) & (self.first[c + 1] - self.first[c] > 1))
            n_sib = (self.first[c + 1] - self.first[c])[some]
            sib, of = _ragged(self.first[c[some]], n_sib), np.repeat(some, n_sib)
            keep = sib != edges[of]
            sib, of = sib[keep], of[keep]
            start_lp, start_v = np.array([p[1] for p in popped]), np.array([p[0] for p in popped])
            lp = start_lp[path[of]] + before[of] + self.step[sib]
            number = (np.arange(len(sib)) - np.searchsorted(path[of], path[of])).astype(np.uint64)
            draw = -np.log1p(-_uniform(mix(own[path[of]] + _odd(1)) ^ mix(number + np.uint64(1 << 40))))
            v = start_v[path[of]] + draw * np.exp(np.minimum(-lp, 700.0))
            order = np.lexsort((v, path[of]))
            rank = np.arange(len(order)) - np.searchsorted(path[of][order], path[of][order])
            order = order[rank < k - turn]
            taken = np.searchsorted(path[of][order], np.arange(len(rows) + 1))
            for i, r in enumerate(rows):
                v0, lp0, prefix, _, _ = popped[i]
                new = edges[first[i] : first[i] + length[i]]
                out[r].append((v0, lp0 + float(whole[i]), np.concatenate([prefix, new])))
                for x in order[taken[i] : taken[i + 1]].tolist():
                    if len(open_[r]) < k - turn or v[x] < open_[r][-1][0]:
                        e = int(of[x])
                        insort(open_[r], (float(v[x]), float(lp[x]), np.concatenate([prefix, new[: place[e]], sib[x : x + 1]]), int(self.dest[sib[x]]), int(word[e])), key=_value)
                        del open_[r][k - turn :]
                    else:
                        break
        result = []
        for r in range(n):
            limit = open_[r][0][0] if open_[r] else None
            for _, lp, path in out[r]:
                n_ids = self.n_ids[path]
                ids = self.ids[self.first_id[path]] if (n_ids == 1).all() else self.ids[_ragged(self.first_id[path], n_ids)]
                result.append((r, ids, lp, 1.0 if limit is None else -math.expm1(-limit * math.exp(max(lp, -700.0)))))
        return result


def _value(entry: tuple) -> float:
    return entry[0]


def _odd(n: int) -> np.uint64:
    return _U(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to below 1 by hash."""
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then those of the next."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _encode(path: str, k: int, alpha: float, seed: int, n_keys: int, summary: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.get(path, alpha)

        def record(batch: pa.RecordBatch, rows: list[int], keys: list[str], texts: list[str]) -> pa.RecordBatch:
            got = Charts(lattice, texts).sample(k, [hashlib.sha256(f"{seed}\0{name}".encode("utf-8", "surrogatepass")).digest() for name in keys])
            of = np.array([g[0] for g in got], np.int64)
            number = np.arange(len(of)) - np.searchsorted(of, of) + 1
            at = pa.array(np.array(rows, np.int64)[of])
            lp, inclusion = (pa.array([g[c] for g in got], pa.float64()) for c in (2, 3))
            head = [*(batch.column(c).take(at) for c in range(n_keys)), pa.array(number, pa.int32())]
            if summary:
                digest = pa.array([hashlib.sha256(g[1].astype("<u4").tobytes()).hexdigest() for g in got])
                same = pa.array([lattice.model.decode(g[1].tolist()) == texts[g[0]] for g in got])
                rest = [pa.array([len(g[1]) for g in got], pa.int32()), lp, inclusion, digest, same]
            else:
                offsets = np.concatenate([[0], np.cumsum([len(g[1]) for g in got])]).astype(np.int32)
                ids = np.concatenate([np.zeros(0, np.int32), *(g[1] for g in got)]).astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), lp, inclusion]
            names = [f"k{i}" for i in range(n_keys)] + [f.split()[0] for f in (_SUMMARY if summary else _WHOLE).split(", ")]
            return pa.record_batch([*head, *rest], names)

        for batch in batches:
            rows, keys, texts, size = [], [], [], 0
            for r, (name, text) in enumerate(zip(batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist(), strict=True)):
                rows.append(r), keys.append(name), texts.append(text or "")
                size += len(text or "")
                if size >= STEP:
                    yield record(batch, rows, keys, texts)
                    rows, keys, texts, size = [], [], [], 0
            if rows:
                yield record(batch, rows, keys, texts)

    return run


_WHOLE = "sample int, ids array<int>, log_prob double, inclusion double"
_SUMMARY = "sample int, n_pieces int, log_prob double, inclusion double, ids_sha256 string, round_trip boolean"


def _segmented(rows: DataFrame, model_path: str, k: int, key_cols: list[str], text_col: str, alpha: float, seed: int, summary: bool) -> DataFrame:
    bound_batches(rows.sparkSession)
    clash = {f.split()[0] for f in f"{_WHOLE}, {_SUMMARY}".split(", ")} & set(key_cols)
    if clash:
        raise ValueError(f"rename key columns {sorted(clash)}: results have columns of these names")
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(key_cols)]
    frame = rows.select(*keys, F.to_json(F.struct(*key_cols), {"ignoreNullFields": "false"}).alias("row_key"), F.col(text_col).alias("text_to_cut"))
    kinds = [frame.schema[i].dataType.simpleString() for i in range(len(key_cols))]
    schema = ", ".join([*[f"k{i} {t}" for i, t in enumerate(kinds)], _SUMMARY if summary else _WHOLE])
    out = frame.mapInArrow(_encode(model_path, k, alpha, seed, len(key_cols), summary), schema)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(key_cols)})


def sample_segmentations(rows: DataFrame, model_path: str, k: int = 4, *, key_cols: list[str], text_col: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Up to ``k`` distinct segmentations of every whole text, seeded by the row's key (and ``seed``): the same key and text
    give the same rows on any cluster.

    Lattices of ``STEP`` bytes of text are held at once; a text is worked through whole, however long.  Ties between
    perturbed values have probability 0.  Null and empty texts have one empty segmentation.  Repeated rows give repeated
    results; null keys are keys; a key column with the name of a result column is refused.  Other columns are ignored; an empty
    table gives an empty result; no shuffle.  Returns key columns, sample (from 1), ids, log_prob, inclusion."""
    return _segmented(rows, model_path, k, key_cols, text_col, alpha, seed, False)


def summarise_segmentations(rows: DataFrame, model_path: str, k: int = 4, *, key_cols: list[str], text_col: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """``sample_segmentations`` with, in place of the ids, their number, the SHA-256 of them (little-endian 32-bit) and whether
    they decode to the text: taken where the ids are made, as they are many times the text's size."""
    return _segmented(rows, model_path, k, key_cols, text_col, alpha, seed, True)


def decode_segmentations(rows: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for; null ids give null.  A column named ``out_col`` is replaced."""
    rows = rows.drop(out_col) if out_col in rows.columns else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice.get(model_path).model
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    from pyspark.sql.types import StringType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(out_col, StringType()))
