"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are embedded and cut into overlapping chunks that cover all
of it. Learned filters run over each chunk, their responses are max-pooled by
chunk, and the mean and the maximum over chunks make one probability. The
network is trained on the driver from a bounded sample of labelled documents;
scoring runs in the tasks that read the texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from qualityspark.llm.common import texts

#: Bytes of half a chunk (a chunk is two neighbouring halves), of a filter's step, and a filter's width in steps.
HALF, STEP, WIDTH = 256, 4, 2
EMBED, FILTERS = 8, 24
#: Labelled rows of either class to learn from; texts scored at once, in bytes.
SAMPLE, SLAB = 1500, 1 << 22
THRESHOLD = 0.3


def halves(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as rows of ``HALF`` bytes, and each text's first row; every text ends in at least one empty step."""
    rows = np.array([(len(t) + STEP) // HALF + 1 for t in texts_], np.int64)
    first = np.concatenate([[0], np.cumsum(rows)[:-1]]).astype(np.int64)
    out = np.zeros((int(rows.sum()), HALF), np.uint8)
    flat = out.reshape(-1)
    for start, text in zip(first * HALF, texts_, strict=True):
        flat[start : start + len(text)] = np.frombuffer(text, np.uint8)
    return out, first


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED, the empty byte's row is 0
    filters: np.ndarray  # STEP * EMBED x WIDTH * FILTERS
    bias: np.ndarray
    weights: np.ndarray  # mean over chunks, then maximum over chunks
    offset: np.ndarray

    @classmethod
    def start(cls, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (256, EMBED))
        embed[0] = 0
        filters = rng.normal(0, (STEP * WIDTH * EMBED) ** -0.5, (STEP * EMBED, WIDTH * FILTERS))
        zeros = [np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
        return cls(*(a.astype(np.float32) for a in (embed, filters, *zeros)))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.offset]

    def respond(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embedded steps, and every filter's response at every step."""
        steps = self.embed[rows].reshape(-1, STEP * EMBED)
        both = steps @ self.filters
        out = both[:, :FILTERS]
        ends = first[1:] * (HALF // STEP) - 1  # a text's last step sees no other text
        after = both[1:, FILTERS:]
        after[ends] = 0
        out[:-1] += after
        return steps, out.reshape(len(rows), HALF // STEP, FILTERS)

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks from their halves, then features by document: chunks, features, chunks' first rows and counts."""
        pooled = np.maximum(pooled + self.bias, 0)
        size = np.diff(np.append(first, len(pooled)))
        chunk = pooled.copy()
        chunk[:-1] = np.maximum(chunk[:-1], pooled[1:])
        last = first + size - 1
        chunk[last[size == 1]] = pooled[last[size == 1]]
        # The last half begins no chunk of its own, unless it is the whole text.
        chunk[last[size > 1]] = 0
        count = np.maximum(size - 1, 1)
        mean = np.add.reduceat(chunk, first, axis=0) / count[:, None]
        most = np.maximum.reduceat(chunk, first, axis=0)
        return pooled, chunk, np.concatenate([mean, most], axis=1), count

    def score(self, texts_: list[bytes]) -> np.ndarray:
        if not texts_:
            return np.zeros(0)
        rows, first = halves(texts_)
        # Pooling needs one slab of rows at a time, so a very long text does not need its responses at once.
        pooled = np.empty((len(rows), FILTERS), self.bias.dtype)
        width = max(1, SLAB // HALF // 8)
        for at in range(0, len(rows), width):
            more = rows[at : at + width + 1]
            inner = first[(first > at) & (first < at + len(more))] - at
            _, out = self.respond(more, np.concatenate([[0], inner]).astype(np.int64))
            pooled[at : at + width] = out.max(axis=1)[:width]
        _, _, features, _ = self.combine(pooled, first)
        return 1 / (1 + np.exp(-(features @ self.weights + self.offset[0]).astype(np.float64)))

    def gradients(self, texts_: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        rows, first = halves(texts_)
        steps, out = self.respond(rows, first)
        at = out.argmax(axis=1)
        raw = np.take_along_axis(out, at[:, None, :], axis=1)[:, 0]
        pooled, chunk, features, count = self.combine(raw, first)
        p = 1 / (1 + np.exp(-(features @ self.weights + self.offset[0])))
        error = ((p - labels) / len(labels)).astype(np.float32)
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        push = error[:, None] * self.weights
        on_chunk = (push[:, :FILTERS] / count[:, None])[doc]
        top = chunk == features[doc, FILTERS:]
        on_chunk = on_chunk + push[doc, FILTERS:] * top / np.maximum(np.add.reduceat(top, first, axis=0), 1)[doc]
        last = np.append(first[1:], len(rows)) - 1
        multi = last[last != first]
        on_chunk[multi] = 0
        on_half = np.where(pooled >= chunk, on_chunk, 0)
        behind = np.zeros_like(on_half)
        behind[1:] = np.where(pooled[1:] >= chunk[:-1], on_chunk[:-1], 0) * (pooled[:-1] < pooled[1:])
        behind[first] = 0
        g = (on_half + behind) * (pooled > 0)
        # Only the step that won each pool learns.
        where = np.arange(len(rows))[:, None] * (HALF // STEP) + at
        nxt = np.minimum(where + 1, len(steps) - 1)
        closing = np.zeros((len(rows), 1), bool)
        closing[last] = True
        inside = ~(closing & (at == HALF // STEP - 1))
        d_filters = np.concatenate(
            [np.einsum("hfk,hf->kf", steps[where], g), np.einsum("hfk,hf->kf", steps[nxt], g * inside)], axis=1
        )
        d_embed = np.zeros_like(self.embed)
        by_step = rows.reshape(-1, STEP)
        for index, part, k in ((where, g, 0), (nxt, g * inside, 1)):
            pull = part[:, :, None] * self.filters[:, k * FILTERS : (k + 1) * FILTERS].T
            which = by_step[index].reshape(-1)
            for e, column in enumerate(pull.reshape(-1, EMBED).T):
                d_embed[:, e] += np.bincount(which, column, 256)
        d_embed[0] = 0
        return [d_embed, d_filters, g.sum(0), features.T @ error, error.sum(keepdims=True)]


def train(texts_: list[bytes], labels: np.ndarray, steps: int = 750, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam over shuffled batches. Without rows of both classes the score is the label there is, or one half."""
    net, rng = Net.start(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        net.weights[:] = 0
        net.offset[:] = 0 if not len(labels) else 4 * (2 * labels[0] - 1)
        return net
    first, second = ([np.zeros_like(a) for a in net.parts()] for _ in range(2))
    left = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(left) < min(batch, len(labels)):
            left = rng.permutation(len(labels))
        chosen, left = left[:batch], left[batch:]
        now = rate * (1 - step / (steps + 1))
        slopes = net.gradients([texts_[i] for i in chosen], labels[chosen])
        for a, m, v, g in zip(net.parts(), first, second, slopes, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Net:
    """Train on at most ``sample`` labelled rows of either class that are not held out, chosen by a hash of their id.

    Labels that are null or not 0 or 1, and ids without a document, are left out.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).filter(~held_out())
    # At most two samples of id and label: small enough for every task by its bound.
    chosen = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    found = sorted(((r["doc_id"], r["label"], r["text"].encode()) for r in rows.toLocalIterator()), key=lambda r: r[:2])
    return train([r[2] for r in found], np.array([r[1] for r in found], np.float32))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(*shared.value)
        for batch in batches:
            found, slab, size = [], [], 0
            for text in batch["text"].cast(pa.binary()).to_pylist():
                slab.append(text)
                size += len(text)
                if size >= SLAB:
                    found.append(net.score(slab))
                    slab, size = [], 0
            found.append(net.score(slab))
            score = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def classify(docs: DataFrame, net: Net, threshold: float = THRESHOLD, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: ``doc_id, held_out, score, predicted`` and the columns named in ``keep``.

    One row per row; a null or empty text is one empty chunk and has a score
    too; a text of any length is gone through chunk by chunk. ``text`` among
    ``keep`` is returned as it was, null included.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*(docs[c] for c in keep)).alias("kept")) if keep else texts(docs, id_col, text_col)
    spark = docs.sparkSession
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(net.parts())), StructType([*rows.schema, StructField("score", DoubleType())]))
    kept = [F.col("kept")[c].alias(c) for c in keep if c != "doc_id"]
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *kept)
