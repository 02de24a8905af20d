"""Toxicity by non-negative positive-unlabelled learning.

Linear numpy classifiers over hashed words and word beginnings are trained on confirmed toxic texts and on all
texts as unlabelled, in full passes. The risk of the negative class is that of the unlabelled texts less the part that the class
prior gives to toxic ones; where that difference would fall below zero, the step undoes the overfit instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.hashing import SpanHashes, spans, text_ends
from waymark.llm.shared import discard, id_and_text, sampled, staged, text_slices

BUCKET_BITS = 18
BEGINNINGS = (4, 5, 6)
FEATURES = 1024
POSITIVE_ROWS = 20_000
LEAST_LIFT = 2.5
LEAST_OVER = 3.0
CLASSIFIERS = 3
ROUNDS = 60
DECAY = 2e-5
UNIT = 1 << 20
THRESHOLD = 0.5
SLICE_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of all words and word beginnings, repeats included. A beginning that is a word elsewhere
    has that word's bucket."""
    buf = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    starts, ends = spans(_WORD[buf])
    doc = np.searchsorted(text_ends(texts), starts, "right")
    hashes = SpanHashes(buf)
    docs, found = [doc], [hashes.of(starts, ends)]
    for k in BEGINNINGS:
        longer = ends - starts > k
        docs.append(doc[longer])
        found.append(hashes.of(starts[longer], starts[longer] + k))
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature that a text has, once each and in order."""
    docs, buckets = occurrences(texts)
    flat = np.unique(docs << BUCKET_BITS | buckets)
    return flat >> BUCKET_BITS, flat & ((1 << BUCKET_BITS) - 1)


@dataclass
class ToxicityModel:
    """Slots of the chosen buckets (-1: none), and the classifiers' weights and offsets."""

    slots: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def present(self, texts: list[bytes]) -> np.ndarray:
        """Text number and slot of every chosen feature that a text has, once each."""
        docs, buckets = occurrences(texts)
        slots = self.slots[buckets]
        hit = slots >= 0
        return np.unique(docs[hit] * len(self.weights) + slots[hit])

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        pairs = self.present(texts)
        z = np.tile(self.offsets.astype(np.float64), (len(texts), 1))
        np.add.at(z, pairs // len(self.weights), self.weights[pairs % len(self.weights)])
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).mean(axis=1)


def risk_sums(slots: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What documents add to each classifier's risk and its slope, as whole numbers of ``1 / UNIT``.

    ``slots`` holds the features of one document after the other, ``sizes`` of each. Row k of a classifier's sums is
    feature k; after the features come the documents' probabilities, their losses as negatives and their number. The
    first result sums the unlabelled, that is all documents, the second the positive ones. A classifier leaves out the
    documents whose hash falls to it.
    """
    features, classifiers = weights.shape
    out = np.zeros((2, classifiers, features + 3), np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for c in range(classifiers):
        z = np.clip(np.bincount(doc, weights[slots, c], len(sizes)) + offsets[c], -40, 40)
        chance, loss = np.rint(UNIT / (1 + np.exp(-z))), np.rint(UNIT * np.logaddexp(0, z))
        own = hashes % classifiers != c if classifiers > 1 else np.ones(len(sizes), bool)
        for k, part in enumerate((own, own & kinds)):
            chances = np.where(part, chance, 0.0)
            out[k, c, :features] = np.bincount(slots, chances[doc], features)
            out[k, c, features:] = chances.sum(), np.where(part, loss, 0.0).sum(), part.sum() * UNIT
    return out[0], out[1]


class Trainer:
    """Adam on the non-negative risk, a step for each pass over all documents."""

    def __init__(self, positive_means: np.ndarray, prior: float) -> None:
        """``positive_means``: for each classifier the share of its positive documents that have each feature."""
        self.means, self.prior, self.step = positive_means, prior, 0
        classifiers, features = positive_means.shape
        self.weights, self.offsets = np.zeros((features, classifiers)), np.full(classifiers, -2.0)
        self.first, self.second = np.zeros((classifiers, features + 1)), np.zeros((classifiers, features + 1))

    def move(self, unlabelled: np.ndarray, positive: np.ndarray, rounds: int) -> None:
        """One step from the sums that ``risk_sums`` gives over all documents.

        The slope is that of the positives' loss and of the corrected negative risk. Where the correction exceeds the
        unlabelled documents' loss, the model has overfitted, and the step goes up that difference instead.
        """
        self.step += 1
        rate = 0.4 * (1 - 0.9 * self.step / rounds)
        for c in range(len(self.means)):
            nu, np_ = max(unlabelled[c, -1], 1), max(positive[c, -1], 1)
            slope_u, slope_p = unlabelled[c, :-2] / nu, positive[c, :-2] / np_
            negative = unlabelled[c, -2] / nu - self.prior * positive[c, -2] / np_
            slope = slope_u - self.prior * np.append(self.means[c], 1.0) if negative >= 0 else self.prior * slope_p - slope_u
            slope[:-1] += DECAY * self.weights[:, c]
            self.first[c] += 0.2 * (slope - self.first[c])
            self.second[c] += 0.02 * (slope * slope - self.second[c])
            move = rate * self.first[c] / (1 - 0.8**self.step) / (np.sqrt(self.second[c] / (1 - 0.98**self.step)) + 1e-8)
            self.weights[:, c] -= move[:-1]
            self.offsets[c] -= move[-1]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and offset of one classifier from dense 0/1 rows, by the same sums and steps as ``fit``."""
    trainer = Trainer(positive.mean(axis=0, keepdims=True), prior)
    cells = np.concatenate([unlabelled, positive]).astype(bool)
    args = (np.nonzero(cells)[1], cells.sum(axis=1), np.arange(len(cells)) >= len(unlabelled), np.zeros(len(cells), np.int64))
    for _ in range(rounds):
        both, pos = risk_sums(*args, trainer.weights, trainer.offsets)
        trainer.move(both - pos, pos, rounds)
    return trainer.weights[:, 0], float(trainer.offsets[0])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a binary column's rows, one after the other, and each row's number."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False) // 2
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64), lengths


def fit(
    docs: DataFrame,
    positives: DataFrame,
    prior: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    positive_rows: int = POSITIVE_ROWS,
    rounds: int = ROUNDS,
) -> ToxicityModel:
    """Classifiers from the texts of ``positives`` (ids) and from all of ``docs`` as unlabelled, ``prior`` the toxic share.

    About ``positive_rows`` of the positive ids are used, by a hash; unlabelled are all documents with a text, the
    positive ones among them. Feature counts and every training step go over all of them; what a task sends is a row
    for each feature. Sums are whole numbers, so that a model doesn't depend on their order. Null ids are unlabelled,
    repeated rows count each. Without texts, positives or a prior over 0 the score is the prior.
    """
    ids = positives.select(F.col(f"`{id_col}`").cast("long").alias("id")).filter("id is not null").distinct()
    picked = sampled(ids, F.col("id"), positive_rows).select("id", F.lit(True).alias("p"))  # about positive_rows
    rows = id_and_text(docs, id_col, text_col).filter("text is not null").join(F.broadcast(picked), "id", "left")
    rows = rows.select("id", "text", F.coalesce("p", F.lit(False)).alias("p"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
        for texts, kinds in _parts(batches):
            of, bucket = features_of(texts)
            sums[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
            sums[1] += np.bincount(bucket[kinds[of]], minlength=1 << BUCKET_BITS)
            n += len(texts), kinds.sum()
        met = np.flatnonzero(sums[0])
        columns = [np.r_[-1, met], np.r_[n[1], sums[1, met]], np.r_[n[0], sums[0, met]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "p", "u"])

    counts = rows.mapInArrow(count, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = staged(counts, "toxicity-counts")  # 1 << BUCKET_BITS rows at most
    totals = counts.filter("bucket = -1").first()
    if totals is None or not totals.p or not totals.u or prior <= 0:
        base = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return ToxicityModel(np.full(1 << BUCKET_BITS, -1, np.int64), np.zeros((1, 1)), np.full(1, base))
    tp, tu = float(totals.p), float(totals.u)
    # Times the share among all that the share among toxic texts is at least, allowing for chance; and how far it
    # is over it in standard deviations.
    lift = ((F.col("p") - 2 * F.sqrt("p")) / tp) / ((F.col("u") + 2) / tu)
    over = (F.col("p") / tp - F.col("u") / tu) / F.sqrt((F.col("p") + 1) / tp / tp + (F.col("u") + 1) / tu / tu)
    chosen = [r.bucket for r in counts.filter("bucket >= 0").filter((lift >= LEAST_LIFT) & (over >= LEAST_OVER)).orderBy(over.desc(), "bucket").limit(FEATURES).collect()]
    slots = np.full(1 << BUCKET_BITS, -1, np.int64)
    slots[chosen] = np.arange(len(chosen))
    features = max(1, len(chosen))
    known = ToxicityModel(slots, np.zeros((features, 1)), np.zeros(1))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, kinds in _parts(batches):
            pairs = known.present(texts)
            cuts = np.searchsorted(pairs, np.arange(len(texts) + 1) * features)
            own = (pairs % features).astype(np.uint16)
            bits = [own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            hashes = [zlib.crc32(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(bits, pa.binary()), pa.array(hashes, pa.int64())], names=["p", "slots", "h"])

    marks = staged(rows.mapInArrow(mark, "p boolean, slots binary, h long"), "toxicity-marks")

    def summed(weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            u, p = (np.zeros((weights.shape[1], features + 3), np.int64) for _ in range(2))
            for batch in batches:
                flat, sizes = _flat(batch.column(1))
                kinds, hashes = np.array(batch.column(0), dtype=bool), batch.column(2).to_numpy()
                more = risk_sums(flat, sizes, kinds, hashes, weights, offsets)
                u, p = u + more[0], p + more[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(u.size)), pa.array(u.reshape(-1)), pa.array(p.reshape(-1))], names=["k", "u", "p"])

        found = marks.mapInArrow(run, "k long, u long, p long").groupBy("k").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
        found = found.toPandas().sort_values("k")  # a row for each weight
        return tuple(found[c].to_numpy().reshape(weights.shape[1], -1) for c in ("u", "p"))

    # At large weights every probability of a positive document is one: what is summed then are the features themselves.
    _, have = summed(np.zeros((features, CLASSIFIERS)), np.full(CLASSIFIERS, 40.0))
    trainer = Trainer(have[:, :features] / np.maximum(have[:, -1:], 1), prior)
    for _ in range(rounds):
        trainer.move(*summed(trainer.weights, trainer.offsets), rounds)
    discard(counts, marks)
    return ToxicityModel(slots, trainer.weights, trainer.offsets)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Slices of texts with the flags of the third column."""
    for batch in batches:
        at = 0
        for _, texts in text_slices([batch], SLICE_BYTES):
            yield texts, np.array(batch.column(2).slice(at, len(texts)), dtype=bool)
            at += len(texts)


def scored(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id, score, predicted)`` for every row from its whole text; null, empty and other texts without known features get
    the base score; a score equal to ``threshold`` is predicted 1; repeated rows are scored alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, SLICE_BYTES):
            score = model.probabilities(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, score double, predicted int")
