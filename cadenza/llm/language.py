"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import bound_batches, chunks, strings, tidy

#: Labelled rows of each language that the driver gets about, characters of each at most, and languages at most.
ROWS_PER_LABEL, SAMPLE_CHARS, MOST_LABELS = 600, 512, 1000
#: Bytes in a window; a text is cut into windows from its start to its end.
WINDOW = 128
WIDTHS, FILTERS, EMBED = (2, 3, 4), 24, 8
UNKNOWN = "und"


class NoLabels(ValueError):
    """There is nothing to learn from."""


@dataclass
class ByteConvNet:
    """Embedding of bytes, filters of several widths, maximum over a window, ReLU, softmax.

    Byte 0 pads; it is no text byte's value (0 in a text is read as a space)."""

    labels: list[str]
    embed: np.ndarray  # 256, EMBED
    filters: list[np.ndarray]  # width, EMBED, FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 11) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        return cls(labels, f(256, EMBED, scale=0.5), [f(w, EMBED, FILTERS, scale=1 / np.sqrt(w * EMBED)) for w in WIDTHS], np.zeros(n, np.float32), f(n, len(labels), scale=1 / np.sqrt(n)), np.zeros(len(labels), np.float32))

    def train(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 3, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam on cross-entropy; x: windows (n, WINDOW) of bytes, y: label numbers."""
        params = [self.embed, *self.filters, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                grads = self._gradients(x[rows], y[rows])
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        e = self.embed[x]
        pooled, at, spans = [], [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            span = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, length - w + 1, w * EMBED)
            z = span @ f.reshape(w * EMBED, FILTERS)
            best = z.argmax(1)
            at.append(best)
            spans.append(span)
            pooled.append(np.take_along_axis(z, best[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1) + self.bias
        a = np.maximum(h, 0)
        p = _softmax(a @ self.out + self.out_bias)
        d = p.copy()
        d[np.arange(n), y] -= 1
        d /= n
        dh = (d @ self.out.T) * (h > 0)
        de = np.zeros_like(e)
        filters = []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = np.take_along_axis(spans[i], at[i][:, :, None], 1)
            filters.append(np.einsum("nfk,nf->kf", chosen, g).reshape(w, EMBED, FILTERS).astype(np.float32))
            back = (g[:, :, None] * f.reshape(w * EMBED, FILTERS).T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(de, (np.arange(n)[:, None], at[i] + j), back[:, :, j])
        embed = np.zeros_like(self.embed)
        np.add.at(embed, x, de)
        return [embed, *filters, dh.sum(0), a.T @ d, d.sum(0)]

    def tables(self) -> list[list[np.ndarray]]:
        """A filter's response is a sum over its positions of a value that the byte there fixes: for each width, tables by
        pairs of bytes (65536 rows) and, for odd widths, by the last byte."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            each = [self.embed @ f[j] for j in range(w)]
            parts = [(each[j][None, :, :] + each[j + 1][:, None, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            out.append([*parts, each[-1]] if w % 2 else parts)
        return out

    def log_odds(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Log probabilities (n, labels) of windows (n, WINDOW)."""
        n, length = x.shape
        pair = x[:, :-1].astype(np.int32) | (x[:, 1:].astype(np.int32) << 8)
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            z, m = None, length - w + 1
            for i, t in enumerate(parts):
                at = 2 * i
                got = t[pair[:, at : at + m]] if len(t) == 65536 else t[x[:, at : at + m]]
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(1))
        a = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        z = a @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[0, *range(9, 14)]] = 32
_FOLD[48:58] = 48


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, WINDOW) over whole texts, their document and their number of text bytes; the last one of a text is padded."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    begin = offsets[:-1][doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    used = np.minimum(WINDOW, offsets[1:][doc] - begin)
    padded = np.concatenate([_FOLD[data], np.zeros(WINDOW, np.uint8)])
    x = padded[begin[:, None] + np.arange(WINDOW)]
    x[np.arange(WINDOW) >= used[:, None]] = 0
    return x, doc, used


def fit(docs: DataFrame, *, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows_per_label: int = ROWS_PER_LABEL, sample_chars: int = SAMPLE_CHARS, most_labels: int = MOST_LABELS) -> ByteConvNet:
    """Train on labelled rows (non-null label and text).

    The training set is bounded: about ``rows_per_label`` rows of each label, drawn by a hash of id and label, and of each at
    most ``sample_chars`` characters, from a place that the hash picks.  Everything else is fixed by seeds.  More than
    ``most_labels`` labels are refused, as the driver holds rows of each."""
    known = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().limit(most_labels + 1).collect()}
    if not counts:
        raise NoLabels("no labelled text to learn from")
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels: raise most_labels")
    labels = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in labels for v in (k, float(min(1.0, rows_per_label / counts[k])))])
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(label_col))
    drawn = known.filter(F.pmod(h, F.lit(1 << 30)) < share[F.col(label_col)] * (1 << 30))
    length = F.greatest(F.length(text_col) - sample_chars, F.lit(0))
    spot = F.pmod(F.xxhash64(F.lit("spot"), F.col(id_col).cast("string")), length + 1).cast("int") + 1
    rows = drawn.select(label_col, F.col(text_col).substr(spot, F.lit(sample_chars)).alias("part"), h.alias("h")).orderBy("h").toPandas()
    data, offsets = strings(pa.array(rows["part"], pa.string()))
    x, doc, used = windows(data, offsets)
    y = np.array([labels.index(v) for v in rows[label_col]])[doc]
    enough = used >= min(WINDOW // 2, int(used.max(initial=1)))
    extra = x[enough].copy()  # short texts are seen as well: the same windows cut to a few bytes
    cut = np.random.default_rng(3).integers(12, WINDOW, len(extra))
    extra[np.arange(WINDOW) >= cut[:, None]] = 0
    net = ByteConvNet.fresh(labels)
    net.train(np.concatenate([x, extra]), np.concatenate([y, y[enough]]))
    return net


def _apply(net: ByteConvNet, n_keys: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        names = pa.array([*net.labels, UNKNOWN])
        for batch in batches:
            texts = batch.column(n_keys)
            letter = pa.compute.fill_null(pa.compute.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, offsets = strings(texts)
            n = batch.num_rows
            total, weight = np.zeros((n, len(net.labels))), np.zeros(n)
            for i, j in chunks(offsets, 1 << 20):
                # A very long document is worked through in parts that end at window borders.
                for a in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), 8 << 20 if j - i == 1 else 1 << 62):
                    b = min(int(offsets[j]), a + (8 << 20)) if j - i == 1 else int(offsets[j])
                    offs = np.array([0, b - a]) if j - i == 1 else offsets[i : j + 1] - offsets[i]
                    x, doc, used = windows(data[a:b], offs)
                    for s in range(0, len(x), 64):
                        odds = net.log_odds(x[s : s + 64], tables) * used[s : s + 64, None]
                        np.add.at(total, i + doc[s : s + 64], odds)
                        np.add.at(weight, i + doc[s : s + 64], used[s : s + 64])
            mean = total / np.maximum(weight, 1)[:, None]
            p = _softmax(mean * np.minimum(4, np.maximum(1, weight / WINDOW))[:, None])
            best = np.where(letter, p.argmax(1), len(net.labels))
            score = np.where(letter, p.max(1), 0.0)
            yield pa.record_batch([*batch.columns[:n_keys], names.take(pa.array(best)), pa.array(score)], [*[f"k{i}" for i in range(n_keys)], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteConvNet, keys: list[Column], *, text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text: (keys..., lang_pred, score).

    Every byte of a text lies in one window, so a pattern across a border is not seen; a very long text is worked through in
    parts of whole windows.  Windows' log probabilities are averaged, weighted by their bytes, and sharpened
    by up to four windows' evidence.  ``und`` with score 0 for a null text or one without a letter.  Rows keep their own
    result each, repeated ones too; an empty table gives an empty result.  No shuffle.
    """
    bound_batches(docs.sparkSession)
    frame = docs.select(*keys, F.col(text_col).alias("text_to_identify"))
    kinds = [(f.name, f.dataType.simpleString()) for f in frame.schema.fields[:-1]]
    named = ", ".join(f"k{i} {t}" for i, (_, t) in enumerate(kinds))
    out = frame.mapInArrow(_apply(net, len(kinds)), f"{named}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(n) for i, (n, _) in enumerate(kinds)], "lang_pred", "score")


def held_out(id_col: str, modulus: int, remainder: int = 2) -> Column:
    """Whether CRC-32 of the id's text leaves the remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def predict_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4) -> DataFrame:
    """Learn from rows of all folds but the held-out one, then predict all rows: id, held_out, lang_pred, score.

    With no labelled text, every row is ``und``."""
    keys = [F.col(id_col), held_out(id_col, folds).alias("held_out")]
    try:
        net = fit(docs.filter(~held_out(id_col, folds)), label_col=label_col, id_col=id_col, text_col=text_col)
    except NoLabels:
        return docs.select(*keys, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return identify(docs, net, keys, text_col=text_col)
