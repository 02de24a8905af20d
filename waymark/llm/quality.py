"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of word characters and runs of signs as they are written, letter case included. Each of many hashed
token buckets has a sparse ternary index vector from a fixed seed. A bucket's vector is the sum of the index vectors of
the tokens up to two places before and after it over the whole corpus, turned by one place more for each position, so
that a vector tells what stands where around a token. The number of buckets is fixed, so the table that tasks receive
has one size at any input. A document is the mean of its tokens' unit vectors, frequent tokens weighing less, their
spread around that mean and the mean product of successive vectors. The network's outputs become probabilities at a temperature fitted on held-back rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.hashing import SpanHashes, text_ends
from waymark.llm.shared import id_and_text, sampled, text_slices

BUCKET_BITS = 15
DIMENSIONS = 48
NONZERO = 6
POOLINGS = 3
PART = 4096
SLICE_BYTES = 1 << 18
OFFSETS = (-2, -1, 1, 2)
COMMON = 1e-3
SAMPLE_ROWS = 12_000
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.3

_KIND = np.full(256, 2, np.uint8)  # white space 0, word characters (all beyond ASCII among them) 1, signs 2
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def index_vectors() -> np.ndarray:
    """The ternary vectors of all buckets."""
    rng = np.random.default_rng(17)
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.int8)
    at = rng.random(out.shape, np.float32).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, at[:, : NONZERO // 2], 1, axis=1)
    np.put_along_axis(out, at[:, NONZERO // 2 :], -1, axis=1)
    return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every token, and each text's number of tokens."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    kind = _KIND[buf]
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    begins = kind[edge[:-1]] > 0 if len(edge) else np.zeros(0, bool)
    starts, ends = edge[:-1][begins], edge[1:][begins]
    counts = np.diff(np.searchsorted(starts, text_ends(texts)), prepend=0)
    return (SpanHashes(buf).of(starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16), counts


def context_sums(batches: Iterator[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs, and the sums of the turned index vectors around it."""
    index = index_vectors()
    turned = {d: np.roll(index, d, axis=1) for d in OFFSETS}
    out, seen = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.int32), np.zeros(1 << BUCKET_BITS, np.int64)
    for texts in batches:
        words, counts = tokens(texts)
        if not len(words):
            continue
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        around = np.zeros((len(words), DIMENSIONS), np.int8)
        for d in OFFSETS:  # nothing stands around a token across documents
            if abs(d) >= len(words):
                continue
            mine, other = (slice(None, -d), slice(d, None)) if d > 0 else (slice(-d, None), slice(None, d))
            near = turned[d][words[other]]
            near[doc[mine] != doc[other]] = 0
            around[mine] += near
        order = np.argsort(words, kind="stable")
        kept = words[order]
        at = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
        out[kept[at]] += np.add.reduceat(around[order], at, axis=0, dtype=np.int32)
        seen += np.bincount(words, minlength=1 << BUCKET_BITS)
    return seen, out


def word_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all buckets, and their weights in a document, from every whole text of ``docs``.

    A task sends a row for each bucket it met, so ``1 << BUCKET_BITS`` at most; so many come to the driver.
    """
    names = [f"v{k}" for k in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = context_sums(texts for _, texts in text_slices(batches, SLICE_BYTES))
        met = np.flatnonzero(seen)
        columns = [pa.array(met.astype(np.int32)), pa.array(seen[met]), *(pa.array(sums[met, k].astype(np.int64)) for k in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "seen", *names])

    rows = id_and_text(docs, id_col, text_col).mapInArrow(run, "bucket int, seen long, " + ", ".join(f"{n} long" for n in names))
    vectors, seen = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32), np.zeros(1 << BUCKET_BITS)
    found = rows.groupBy("bucket").agg(F.sum("seen").alias("seen"), *(F.sum(n).alias(n) for n in names)).toPandas()
    if len(found):
        at = found["bucket"].to_numpy()
        vectors[at], seen[at] = found[names].to_numpy(np.float32), found["seen"].to_numpy()
    share = seen / max(1.0, seen.sum())
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors, (COMMON / (COMMON + share)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Three poolings of each text's word vectors, by dimension: their weighted mean, their standard deviation from it,
    and the mean product of successive vectors; zeros without tokens. A text goes through in parts that stay in the
    cache, so that its pooling depends on nothing beside it."""
    words, counts = tokens(texts)
    out = np.zeros((len(texts), POOLINGS * DIMENSIONS), np.float32)
    ends = np.cumsum(counts)
    for k, n in enumerate(counts.tolist()):
        if not n:
            continue
        sums, total, begin = np.zeros((POOLINGS, DIMENSIONS)), 0.0, int(ends[k]) - n
        for at in range(begin, begin + n, PART):
            own = words[max(begin, at - 1) : min(at + PART, begin + n)]  # with the token before, which the first one follows
            held, weight, after = vectors[own], weights[own], int(at > begin)
            total += float(weight[after:].sum())
            sums[0] += weight[after:] @ held[after:]
            sums[1] += weight[after:] @ np.square(held[after:])
            sums[2] += (held[1:] * held[:-1]).sum(axis=0)
        mean = sums[0] / total
        out[k] = np.concatenate([mean, np.sqrt(np.maximum(sums[1] / total - mean * mean, 0)), sums[2] / max(n - 1, 1)])
    return out


@dataclass
class QualityModel:
    """Word vectors and weights, a network of two layers and its temperature."""

    vectors: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = (features - self.mean) / self.scale
        return (np.tanh(x @ w1 + b1) @ w2 + b2)[:, 0]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.logits(pooled(texts, self.vectors, self.weights)).astype(np.float64) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, weights: np.ndarray, seed: int = 5) -> QualityModel:
    """A network by Adam on the logistic loss; every sixth row is held back for the temperature."""
    rng = np.random.default_rng(seed)
    n, d = features.shape
    held = np.arange(n) % 6 == 5
    mean = features.mean(axis=0) if n else np.zeros(d, np.float32)
    scale = features.std(axis=0) + 1e-3 if n else np.ones(d, np.float32)
    layers = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    model = QualityModel(vectors, weights, mean, scale, [w.astype(np.float32) for w in layers])
    x, y = ((features - mean) / scale)[~held].astype(np.float32), labels[~held].astype(np.float32)
    if not len(x) or y.min() == y.max():
        model.layers[2][:] = 0
        share = labels.mean() if n else 0.5
        model.layers[3][:] = np.log((share * n + 1) / ((1 - share) * n + 1))
        return model
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.layers]
    step, batch = 0, 256
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(x)), 0.01 * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(x), batch):
            rows, step = order[at : at + batch], step + 1
            w1, b1, w2, b2 = model.layers
            h = np.tanh(x[rows] @ w1 + b1)
            error = (_sigmoid((h @ w2 + b2)[:, 0]) - y[rows])[:, None].astype(np.float32) / len(rows)
            back = error @ w2.T * (1 - h * h)
            slopes = [x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ error + 1e-4 * w2, error.sum(axis=0)]
            for w, g, (m, v) in zip(model.layers, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if held.any():
        z, t = model.logits(features[held]).astype(np.float64), labels[held]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.logaddexp(0, np.where(t == 1, -z, z) / k).mean() for k in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Word vectors from all of ``docs``; the network from ``labels`` (id, 0 or 1), of which about ``sample_rows`` are
    used, by a hash of the id. Rows without id, label or text don't count; of an id's contradicting labels the larger
    counts, of its texts the one whose features come first; without labels of both kinds the model gives one constant."""
    vectors, weights = word_vectors(docs, id_col, text_col)
    picked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    picked = sampled(picked.filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")), F.col("id"), sample_rows)
    rows = id_and_text(docs, id_col, text_col).filter("text is not null").join(F.broadcast(picked), "id")  # about sample_rows
    rows = rows.select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_slices([batch]):
                found = pooled(texts, vectors, weights)
                labelled = batch.column(2).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, labelled, pa.array(list(found), pa.list_(pa.float32()))], names=["id", "y", "features"]
                )

    found = rows.mapInArrow(run, "id long, y double, features array<float>").groupBy("id").agg(F.min("y").alias("y"), F.min("features").alias("features"))
    found = found.toPandas().sort_values("id", kind="stable")
    features = np.array(found["features"].tolist(), np.float32).reshape(-1, POOLINGS * DIMENSIONS)
    return train(features, found["y"].to_numpy(np.float64), vectors, weights)


def scored(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id, score, predicted)`` for every row from its whole text; null and empty texts are scored like each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            score = model.probabilities(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, score double, predicted int")


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns as they are. Rows pass through one by one,
    so that null ids and repeated rows are judged each; a null text is judged as an empty one; a score equal to
    ``threshold`` is accepted."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["id", "text"])
            start = 0
            for _, part in text_slices(iter([texts])):
                keep = model.probabilities(part) >= threshold
                yield batch.slice(start, len(part)).filter(pa.array(keep))
                start += len(part)

    return docs.mapInArrow(run, docs.schema)
