"""Near copies by word shingles: SimHash fingerprints and one-wildcard segment variants, verified on exact shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Such texts
differ in about ten of 64 fingerprint bits, more than segments of bits can index: with 14 bits allowed a key would
hold seven. So the scheme of ``simhash`` stays, with another content of the segments. A text's least values under
``SEGMENTS * WIDTH`` hash functions are cut into segments; similar texts differ in at most one value of some segment
(all miss with a chance of 0.002 at 0.8). Segments are indexed whole first, which joins most of a group at little
cost, then under their one-wildcard variants. Fingerprints choose what is tried first, and exact shingles decide.

Under each key one member is the centre, and of every other component the member with the nearest fingerprint is
verified against it, so that pairs grow with the members and not with their square. What is similar joins components.
So ``WHOLE_ROUNDS`` rounds with several centres join most under whole segments, at little cost. They settle nothing by
themselves: at the end all pairs of different components are compared under every key that holds several (the
one-wildcard keys, which hold what whole segments hold too), whatever their fingerprints. Members of a key come in parts
of up to ``PART`` members and about ``PART_BYTES``, each two parts are a row, and only links leave the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import connected_components
from waymark.llm.hashing import SpanHashes, spans, text_ends
from waymark.llm.shared import discard, numbered, staged, text_slices
from waymark.llm.simhash import fingerprint

SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS = 6
WIDTH = 6
MOST_BITS = 22
WHOLE_ROUNDS = 3
PART, PART_BYTES = 512, 1 << 21
_COLUMNS = 1 << 12  # shingles of a matrix at once

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.default_rng(29).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The distinct word shingles: words between ASCII white space, A-Z lower-cased; fewer words are one, none is none."""
    words = text.lower().split()
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(shingle)), strict=False))


def similar(a: bytes, b: bytes, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of both shingle sets is at least ``similarity``; two wordless texts are alike."""
    x, y = shingles(a, shingle), shingles(b, shingle)
    common = len(x & y)
    return common >= similarity * (len(x) + len(y) - common)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def segment_keys(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """For each text a key of every segment of least values, and a row of ``SEGMENTS * WIDTH`` variants: every segment
    with each value in turn left out."""
    buf = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    starts, ends = spans(~_SPACE[buf])
    counts = np.diff(np.searchsorted(starts, text_ends(texts)), prepend=0)
    words = SpanHashes(buf).of(starts, ends)
    found, sizes, at = [], np.maximum(1, counts - shingle + 1), 0
    grams = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for k in range(shingle):
        grams += words[k : k + len(grams)] * _FACTORS[k]
    grams = _mix(grams)
    for text, n in zip(texts, counts.tolist(), strict=True):
        if n >= shingle:
            found.append(grams[at : at + n - shingle + 1])
        else:
            found.append(np.array([xxhash.xxh64_intdigest(b" ".join(text.lower().split()))], np.uint64))
        at += n
    hashes, first = np.concatenate(found), np.cumsum(sizes) - sizes
    whole, out = np.empty((len(texts), SEGMENTS), np.uint64), np.empty((len(texts), SEGMENTS, WIDTH), np.uint64)
    place = np.arange(WIDTH, dtype=np.uint64)[:, None]
    for s in range(SEGMENTS):
        least = [np.minimum.reduceat(_mix(hashes * _FACTORS[8 + s * WIDTH + k] + np.uint64(s * WIDTH + k)), first) for k in range(WIDTH)]
        parts = _mix(np.stack(least) * _FACTORS[5] + place)
        total = parts.sum(axis=0) + np.full(1, s + 1, np.uint64) * _FACTORS[6]
        whole[:, s] = _mix(total * _FACTORS[7])
        out[:, s] = _mix((total - parts) * _FACTORS[7] + place + np.uint64(1)).T
    return whole.view(np.int64), out.reshape(len(texts), -1).view(np.int64)


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows(row, text)`` to ``(row, digest, fp, whole, wild)``; the digest is of the words, so that copies have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            digests = [blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts]
            prints = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            lists = []
            for keys in segment_keys(texts, shingle):
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1])
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(prints), *lists], names=["row", "digest", "fp", "whole", "wild"])

    return rows.mapInArrow(run, "row long, digest binary, fp long, whole array<long>, wild array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts are similar. Texts meet their pairs by equi-joins that AQE splits where a
    member is in many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(k).cast(pa.large_binary()) for k in (2, 3))
            near = [similar(x.as_py() or b"", y.as_py() or b"", shingle, similarity) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])

    side = lambda name: texts.select(F.col("row").alias(name), F.col("text").alias(f"{name}_text"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return met.mapInArrow(run, "a long, b long")


def _mixed(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """``keyed(key, rep, fp)`` with its ``group``, of those keys only that hold several groups."""
    named = keyed.join(groups, "rep", "left").select("key", "rep", "fp", F.coalesce("group", "rep").alias("group"))
    several = named.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b").select("key")
    return named.join(several, "key")


def _linked(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``groups(rep, group)`` after the links ``found(a, b)``."""
    label = lambda c: F.coalesce(F.col(f"of_{c}"), F.col(c)).alias(c)
    of = lambda c: groups.select(F.col("rep").alias(c), F.col("group").alias(f"of_{c}"))
    ties = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(label("a"), label("b"))
    moved = connected_components(ties).select(F.col("node").alias("group"), F.col("component").alias("to"))
    kept = groups.join(moved, "group", "left").select("rep", F.coalesce("to", "group").alias("group"))
    fresh = moved.select(F.col("group").alias("rep"), F.col("to").alias("group")).join(groups, "rep", "left_anti")
    return staged(kept.union(fresh), "copy-groups")


def _joined(keyed: DataFrame, groups: DataFrame, rows: DataFrame, rounds: int, shingle: int, similarity: float) -> DataFrame:
    """``groups(rep, group)`` after at most ``rounds`` rounds over ``keyed(key, rep, fp)``, the last being one that finds no link."""
    now = staged(_mixed(keyed, groups), "copy-keys")
    texts = staged(rows.join(now.select(F.col("rep").alias("row")).distinct(), "row", "left_semi"), "copy-texts")
    tested = []
    for turn in range(rounds):
        # A member of one group is the key's centre: the smallest at first, then by a hash that differs by key and turn.
        # The fingerprint nearest to the centre's is tried first, later give or take some bits.
        order = F.struct(F.xxhash64("group", "key", F.lit(turn)), F.xxhash64("rep", "key", F.lit(turn))) if turn else F.col("rep")
        centre = now.groupBy("key").agg(F.min_by(F.struct("group", "rep", "fp"), order).alias("c"))
        bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp")))
        loose = F.pmod(F.xxhash64("rep", "key", F.lit(turn)), F.lit(4 * max(0, turn - 1) + 1))
        met = now.join(centre, "key").filter("group <> c.group").filter(bits <= MOST_BITS)
        met = met.select("key", "group", F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"), (bits + loose).alias("bits"))
        if tested:
            met = met.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        each = ["group", "key"] if turn else ["group"]  # at first a pair for each member, then one under each key
        best = met.groupBy(*each).agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("p"))
        tested.append(staged(best.select("p.a", "p.b").distinct(), "copy-pairs"))
        found = staged(_verified(tested[-1], texts, shingle, similarity), "copy-links")
        if found.isEmpty() and turn:
            break
        groups = _linked(groups, found)
        before, now = now, staged(_mixed(now.select("key", "rep", "fp"), groups), "copy-keys")
        discard(before, found)
    discard(now, texts, *tested)
    return groups


def _common(sets: list[set], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many shingles each of ``rows`` shares with each of ``columns``, both indexes of ``sets``."""
    if len(rows) * len(columns) <= 64:
        return np.array([[len(sets[i] & sets[j]) for j in columns] for i in rows], np.int64).reshape(len(rows), len(columns))
    numbers: dict = {}
    ids = [np.array([numbers.setdefault(g, len(numbers)) for g in s], np.int64) for s in sets]
    seen = np.bincount(np.concatenate([*ids, np.zeros(0, np.int64)]), minlength=len(numbers))
    place = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)  # a shingle of one text is common to no two
    ids = [np.sort(place[x][place[x] >= 0]) for x in ids]
    out = np.zeros((len(rows), len(columns)), np.float32)  # whole numbers up to 2^24
    for at in range(0, int((seen > 1).sum()), _COLUMNS):
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        for k, x in enumerate(ids):
            held[k, x[np.searchsorted(x, at) : np.searchsorted(x, at + _COLUMNS)] - at] = 1
        out += held[rows] @ held[columns].T
    return out.astype(np.int64)


def _links(parts: list[int], reps: list[int], groups: list[int], texts: list[bytes], shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join the groups of which members in different parts, or in one where there is but one, are similar."""
    sets = [shingles(t, shingle) for t in texts]
    sizes, of, group = np.array([len(x) for x in sets]), np.array(parts), np.array(groups)
    one = np.flatnonzero(of == of.min())
    other = one if of.min() == of.max() else np.flatnonzero(of == of.max())
    common = _common(sets, one, other)
    near = (common >= similarity * (sizes[one][:, None] + sizes[other][None, :] - common)) & (group[one][:, None] != group[other][None, :])
    root = {g: g for g in groups}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        i, j = int(one[i]), int(other[j])
        a, b = top(groups[i]), top(groups[j])
        if a != b:
            root[a] = b
            out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return out


def _settled(keyed: DataFrame, groups: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``groups(rep, group)`` after all pairs of different groups under each key of ``keyed(key, rep, fp)`` are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column(0)[k].values
                parts, reps, of, texts = (members.field(c).to_pylist() for c in ("part", "rep", "group", "text"))
                found = _links(parts, reps, of, [t or b"" for t in texts], shingle, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    now = staged(_mixed(keyed, groups), "copy-keys")
    wanted = now.select(F.col("rep").alias("row")).distinct()
    texts = staged(rows.join(wanted, "row", "left_semi").select(F.col("row").alias("rep"), F.col("text").cast("binary").alias("text")), "copy-texts")
    sized = now.join(texts.select("rep", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), "rep")
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"mark_{k}") for k in (0, 1)]
    keys = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *marks)
    keys = keys.groupBy("n", "size", "mark_0", "mark_1").agg(F.min("key").alias("key"))  # keys with the same members are one
    keys = keys.select("key", F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("size") / PART_BYTES), F.lit(1)).cast("int").alias("parts"))
    dealt = now.join(keys, "key").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "rep", "group")
    units = dealt.join(texts, "rep").groupBy("key", "i", "j").agg(F.collect_list(F.struct("part", "rep", "group", "text")).alias("members"))
    units = units.filter("i = j or exists(members, m -> m.part = i) and exists(members, m -> m.part = j)").select("members")
    found = staged(units.mapInArrow(run, "a long, b long").distinct(), "copy-links")
    groups = _linked(groups, found)
    discard(now, texts, found)
    return groups


def grouped(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``rows(row, text)``, of unique longs, to ``(row, digest, group)``: the smallest row reachable over near copies."""
    sketches = staged(_sketches(rows, shingle), "sketches")
    least = sketches.groupBy("digest").agg(F.min("row").alias("rep"))  # copies are one row from here on
    reps = staged(sketches.join(least.select(F.col("rep").alias("row")), "row", "left_semi").withColumnRenamed("row", "rep"), "copy-reps")
    groups = reps.select("rep", F.col("rep").alias("group")).limit(0)
    keyed = lambda keys: reps.select(F.explode(keys).alias("key"), "rep", "fp")
    groups = _joined(keyed("whole"), groups, rows, WHOLE_ROUNDS, shingle, similarity)
    groups = _settled(keyed("wild"), groups, rows, shingle, similarity)
    named = reps.select("digest", "rep").join(groups, "rep", "left").select("digest", F.coalesce("group", "rep").alias("group"))
    return sketches.select("row", "digest").join(named, "digest")


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row of ``docs`` for each group of near copies; columns stay as they are.

    The smallest id stays, null ids last; among rows of one id the smallest text digest. Rows are judged each, so that
    rows of unequal texts under one id, or without an id, go only where they are near copies. Null and wordless texts
    are copies of each other. Of exactly repeated rows one stays.
    """
    held, row = numbered(docs, "near-rows")
    named = staged(grouped(held.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), shingle, similarity), "near-groups")
    ids = held.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_col}`").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "digest", "row")
    stays = named.join(ids, "row").groupBy("group").agg(F.min_by("row", order).alias("row"))
    gone = staged(named.select("row").join(stays.select("row"), "row", "left_anti").withColumnRenamed("row", row), "near-gone")
    return held.join(gone, row, "left_anti").drop(row).select(*(F.col(f"`{c}`") for c in docs.columns))
