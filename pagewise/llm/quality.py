"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, model_rows, text_steps

#: Bytes of a chunk, and from one chunk's start to the next one's: chunks overlap by a filter's width.
CHUNK, HOP = 512, 504
#: Width and step of a filter in bytes, size of a byte's vector, filters, hidden units.
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 32, 16
#: Labelled texts of a fit at most, and characters up to which each of them is whole however large the others are.
TRAIN_TEXTS, WHOLE_CHARS = 4000, 8192
#: Times that a fit sees each chunk, chunks of a step, the rate, and steps at least and at most (the most sees each chunk of the largest sample at least once).
EPOCHS, BATCH, RATE, STEPS = 3, 64, 0.004, (400, 4500)
THRESHOLD = 0.3


def chunk_counts(offsets: np.ndarray) -> np.ndarray:
    """The number of chunks of each text; an empty text has one."""
    return np.maximum(1, -(-(np.diff(offsets) - CHUNK) // HOP) + 1)


def chunked(data: np.ndarray, offsets: np.ndarray, first: int, end: int) -> np.ndarray:
    """Chunks first to end of all texts' chunks in a row, filled up with zero bytes."""
    counts = chunk_counts(offsets)
    before = np.concatenate([[0], np.cumsum(counts)])
    which = np.arange(first, end)
    owner = np.searchsorted(before, which, "right") - 1
    starts, ends = offsets[owner] + (which - before[owner]) * HOP, offsets[owner + 1]
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)


@dataclass
class ConvNet:
    """Byte vectors, filters, a max over the chunk, a hidden layer, a logit for each chunk; a text's logit is their mean."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    prior: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 11) -> ConvNet:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(0.5, 256, EMBED), draw((WIDTH * EMBED) ** -0.5, WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32), draw(FILTERS**-0.5, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN**-0.5, HIDDEN), np.zeros(1, np.float32))

    def _responses(self, chunks: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each phase, (byte of its first window, responses (chunk, window, filter)); windows of a phase don't overlap, so no copy is made."""
        vectors = self.embed[chunks]
        out = []
        for first in range(0, WIDTH, STRIDE):
            n = (CHUNK - first) // WIDTH
            windows = vectors[:, first : first + n * WIDTH].reshape(len(chunks), n, WIDTH * EMBED)
            out.append((first, windows @ self.filters))
        return out

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        best = None
        for _, r in self._responses(chunks):
            own = r.max(1)
            best = own if best is None else np.maximum(best, own)
        return np.maximum(best + self.bias, 0)

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(chunks) @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text; for an empty one, that of the labelled texts."""
        counts = chunk_counts(offsets)
        total = int(counts.sum())
        logits = np.concatenate([self.logits(chunked(data, offsets, i, min(i + 256, total))) for i in range(0, total, 256)]) if total else np.zeros(0)
        sums = np.add.reduceat(logits.astype(np.float64), np.cumsum(counts) - counts) if len(counts) else np.zeros(0)
        out = 1 / (1 + np.exp(-np.clip(sums / counts, -30, 30)))
        out[np.diff(offsets) == 0] = self.prior
        return out

    def _step(self, chunks: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss."""
        parts = self._responses(chunks)
        tops = [r.argmax(1) for _, r in parts]
        values = np.stack([np.take_along_axis(r, t[:, None], 1)[:, 0] for (_, r), t in zip(parts, tops)])
        phase = values.argmax(0)
        z = np.take_along_axis(values, phase[None], 0)[0] + self.bias
        start = np.stack([f + t * WIDTH for (f, _), t in zip(parts, tops)])
        start = np.take_along_axis(start, phase[None], 0)[0]
        pooled = np.maximum(z, 0)
        pre = pooled @ self.hidden + self.hidden_bias
        act = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.out_bias[0], -30, 30)))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        d_out, d_out_bias = act.T @ g, g.sum(keepdims=True)
        d_pre = np.outer(g, self.out) * (pre > 0)
        d_hidden, d_hidden_bias = pooled.T @ d_pre, d_pre.sum(0)
        d_z = (d_pre @ self.hidden.T) * (z > 0)
        at = start[:, :, None] + np.arange(WIDTH)
        seen = chunks[np.arange(len(chunks))[:, None, None], at]
        windows = self.embed[seen].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        d_filters = np.einsum("cfk,cf->kf", windows, d_z, optimize=True)
        d_windows = d_z[:, :, None] * self.filters.T[None]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, seen.reshape(-1), d_windows.reshape(-1, EMBED))
        return [d_embed, d_filters, d_z.sum(0), d_hidden, d_hidden_bias, d_out, d_out_bias.astype(np.float32)]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], seed: int = 11) -> ConvNet:
        """rows: text and label. Every chunk of every text learns its text's label, a text's chunks together counting as much as another's; Adam.

        Without rows, or with one label alone, there is nothing to learn: every text gets the prior.
        """
        net, r = cls.fresh(seed), np.random.default_rng(seed)
        labels = np.array([y for _, y in rows], np.float32)
        net.prior = float((labels.sum() + 1) / (len(labels) + 2))
        if not rows or labels.min() == labels.max():
            net.out[:] = 0
            net.out_bias[:] = np.log(net.prior / (1 - net.prior))
            return net
        raw = [t.encode() for t, _ in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        counts = chunk_counts(offsets)
        owner = np.repeat(np.arange(len(rows)), counts)
        chunks = chunked(np.frombuffer(b"".join(raw), np.uint8), offsets, 0, len(owner))
        y = labels[owner]
        weight = (1 / counts[owner]).astype(np.float32)
        weight /= weight.mean()
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
        step, steps = 0, min(max(STEPS[0], EPOCHS * len(owner) // BATCH), STEPS[1])
        while step < steps:
            order = r.permutation(len(owner))
            for i in range(0, len(order), BATCH):
                step += 1
                rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
                own = order[i : i + BATCH]
                for p, g, (m, v) in zip(net.parameters(), net._step(chunks[own], y[own], weight[own]), moments):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + (1e-3 * p if p.ndim == 2 else 0))
                if step >= steps:
                    break
        return net


def learn(docs: DataFrame, labels: DataFrame) -> ConvNet:
    """A net from labels.quality of rows with crc32(doc_id as text) % 5 <> 0; TRAIN_TEXTS of them at most."""
    return ConvNet.fit(model_rows(docs.sparkSession, docs, labels, "quality", 5, 0, TRAIN_TEXTS, WHOLE_CHARS))


def score_quality(docs: DataFrame, net: ConvNet, text: str = "text", score: str = "score") -> DataFrame:
    """Every row of docs with a score from 0 to 1, higher where label 1 is likelier.

    The whole text counts, whatever its length. Null and empty texts get the share of label 1 among
    the texts of the fit, and so does every text where nothing, or one label alone, was labelled (0.5
    without any). A chunk that the text doesn't fill ends in zero bytes, which are pooled with it.
    Repeated rows stay; a column named like the score is replaced.
    """
    docs = docs.drop(score)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [net.scores(data, offsets) for _, _, data, offsets in text_steps(batch.column(names.index(text)), 1 << 18)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else [], pa.float64())], names=[*names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learned from labels.quality."""
    net = learn(docs, labels)
    got = score_quality(docs.select("doc_id", "text"), net)
    return got.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
