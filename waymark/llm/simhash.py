"""SimHash near-duplicates with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two bits differ in at most one bit of one of their two
32-bit halves. Each half is indexed under its 32 one-wildcard variants, so such a pair meets under one equal key
at least; candidates that meet are verified on all 64 bits. Keys that many different fingerprints share are
taken apart again by the same rule on the half not yet used, then by two-wildcard keys, under which at most
four fingerprints can meet. So nothing is capped and no group is compared pairwise beyond ``pairwise`` members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import connected_components
from waymark.llm.shared import discard, id_and_text, staged, text_slices

SEED = 42
BITS = 2
SHINGLE = 3
PAIRWISE = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text: words between ASCII white space, A-Z lower-cased, word shingles with
    repeats; a bit is set if it is set in over half the XXH64 hashes. No words: 0. Fewer words than a shingle:
    the whole sequence is the only one."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False)
        hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, len(part) - shingle + 1)
        ones += _bit_counts(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    cells = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(cells) < 512:
        return np.unpackbits(cells, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(cells[:, k], minlength=256) @ _OF_BYTE for k in range(8)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` for every row; null and wordless texts have fingerprint 0. Reads whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], names=["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, pairwise: int = PAIRWISE
) -> DataFrame:
    """``(id, fp, component)``: the smallest id reachable over links of at most two differing bits.

    One row per input row, whatever its other columns are. Rows with a null id link as others do but have no id to
    give; a group of such rows alone has a null component. Repeated rows share id, fingerprint and component.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "prints")
    return with_components(prints, pairwise)


def with_components(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """``prints(id, fp)`` with its component. Texts are not needed; exact copies are one row from here on.

    Fingerprints are linked, not ids: rows without an id tie groups too, and different texts under one id tie none.
    """
    reps = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "reps")
    links = staged(linked(reps.select("fp", F.col("fp").alias("rep")), pairwise), "links")
    groups = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    named = staged(reps.join(groups, "fp", "left").select("fp", "least", F.coalesce("group", "fp").alias("group")), "groups")
    discard(reps, links)
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    return prints.join(named.join(least, "group").select("fp", "component"), "fp").select("id", "fp", "component")


def linked(reps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """``reps(fp, rep)``, distinct fingerprints, to ``(a, b)``: reps tied to the smallest rep of the linked ones
    that share a key. These edges connect exactly what links of at most two bits connect."""
    half = lambda k: F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    wild = lambda k: F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda p: F.shiftleft((p + 32 * k).cast("long"), 32).bitwiseOR(
            half(k).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), p)))
        ),
    )
    keyed = reps.select(F.explode(F.concat(wild(0), wild(1))).alias("key"), "fp", "rep")
    met = staged(_meet(keyed, pairwise), "met")
    out = met.filter("b is not null").select("a", "b")
    crowded = met.filter("b is null").select("key", "fp", F.col("a").alias("rep"))
    if crowded.isEmpty():
        return out.distinct()
    again = staged(_meet(crowded.mapInArrow(_rekey_halves, "key long, fp long, rep long"), pairwise), "met-again")
    out = out.union(again.filter("b is not null").select("a", "b"))
    crowded = again.filter("b is null").select("key", "fp", F.col("a").alias("rep"))
    if not crowded.isEmpty():
        last = crowded.select("fp", "rep").distinct().mapInArrow(_rekey_pairs, "key long, fp long, rep long")
        out = out.union(_meet(last, 1 << 30).filter("b is not null").select("a", "b"))
    return out.distinct()


def _meet(keyed: DataFrame, pairwise: int) -> DataFrame:
    """Rows with equal keys, verified: ``(a, b)`` for what is linked; rows of a crowded key come back with a null b.

    A task streams over its sorted keys and holds ``pairwise`` members of one key at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        passing: int | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            cut = np.searchsorted(cols[0], cols[0][-1])  # the last key may go on in the next batch
            done, held = [c[:cut] for c in cols], [c[cut:] for c in cols]
            out, passing = _runs(done, pairwise, passing)
            yield from out
            if passing == held[0][0] or len(held[0]) > pairwise:
                passing = held[0][0]
                yield _rows(held[0], held[1], held[2], None)
                held = [c[:0] for c in held]
        out, _ = _runs(held, pairwise, passing)
        yield from out

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, fp long, a long, b long")


def _rows(key: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    last = pa.nulls(len(key), pa.int64()) if b is None else pa.array(b)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(a), last], names=["key", "fp", "a", "b"])


def _runs(cols: list[np.ndarray], pairwise: int, passing: int | None) -> tuple[list[pa.RecordBatch], int | None]:
    key, fp, rep = cols
    out: list[pa.RecordBatch] = []
    if not len(key):
        return out, passing
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    twos = starts[sizes == 2]
    if passing is not None:
        twos = twos[key[twos] != passing]
    near = np.bitwise_count((fp[twos] ^ fp[twos + 1]).view(np.uint64)) <= BITS
    found = [(rep[twos[near]], rep[twos[near] + 1])]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        part = slice(s, s + n)
        if n > pairwise or key[s] == passing:
            out.append(_rows(key[part], fp[part], rep[part], None))
            continue
        roots = _roots(fp[part].view(np.uint64), rep[part])
        found.append((rep[part], roots))
    for s in starts[(sizes <= 2) & (key[starts] == passing)].tolist() if passing is not None else ():
        part = slice(s, s + int(sizes[np.searchsorted(starts, s)]))
        out.append(_rows(key[part], fp[part], rep[part], None))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if (keep := a != b).any():
        a, b = np.unique(np.stack([np.maximum(a, b)[keep], np.minimum(a, b)[keep]]), axis=1)
        out.append(_rows(np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a, b))
    return out, passing


def _roots(fp: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest rep that each member reaches over links inside the group."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= BITS
    root = rep
    while True:
        after = np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (after == root).all():
            return root
        root = after


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit key of several; pairs that meet are verified, so that equal keys of different parts do no harm."""
    h = np.full(np.broadcast(*parts).shape, 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for at in range(0, len(cols[0]), most):
            yield [c[at : at + most] for c in cols]


def _rekey_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One-wildcard variants of the two 16-bit parts of the half that the key does not hold."""
    masks = ~(np.uint64(1) << np.arange(16, dtype=np.uint64)) & np.uint64(0xFFFF)
    for key, fp, rep in _slices(batches, 4096):
        first = ((key >> 32) & 63) >= 32
        other = np.where(first, fp.view(np.uint64) & np.uint64(0xFFFFFFFF), fp.view(np.uint64) >> np.uint64(32))
        parts = np.stack([other & np.uint64(0xFFFF), other >> np.uint64(16)], axis=1)
        keys = _mixed(key[:, None, None], np.arange(32, dtype=np.uint64).reshape(1, 2, 16), parts[:, :, None] & masks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1)), pa.array(np.repeat(fp, 32)), pa.array(np.repeat(rep, 32))],
            names=["key", "fp", "rep"],
        )


def _rekey_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All two-wildcard variants of the whole fingerprint: under one of them at most four can meet."""
    bits = np.array(list(combinations(range(64), 2)), dtype=np.uint64)
    masks = ~((np.uint64(1) << bits[:, 0]) | (np.uint64(1) << bits[:, 1]))
    for fp, rep in _slices(batches, 256):
        keys = _mixed(np.arange(len(masks), dtype=np.uint64)[None, :], fp.view(np.uint64)[:, None] & masks[None, :])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1)), pa.array(np.repeat(fp, len(masks))), pa.array(np.repeat(rep, len(masks)))],
            names=["key", "fp", "rep"],
        )
