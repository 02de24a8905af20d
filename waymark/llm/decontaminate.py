"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a segment holds the postings of some MB of whole texts, each term with its
sorted positions in the segment. A gap of one position lies between documents, so that no phrase spans two.
Building needs no shuffle; an index row is a segment. Searching looks up each test window's terms in a segment,
drops windows of which a term is absent, and intersects the offset-adjusted lists of the others from the rarest
term on. Test items come in blocks of bounded size, so that what tasks receive doesn't grow with the test set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import discard, id_and_text, numbered, staged, text_slices

WINDOW = 13
ITEM_BLOCK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[0x80:] = _WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True

INDEX_SCHEMA = "segment string, n_docs int, doc_ids binary, has_id binary, bases binary, n_words binary, term_offsets binary, terms binary, list_offsets binary, lists binary"
FOUND_SCHEMA = "segment string, k int, id long, n_words long, matches array<struct<item: string, start: long, end: long>>"


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, as one array, and each text's number of them."""
    buf = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = _WORD[buf]
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])]
    )
    upto = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return words, np.diff(np.searchsorted(starts, upto), prepend=0)


def varint(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ascending positions (run k from ``starts[k]``) as 7-bit groups of their differences: bytes, run offsets."""
    gaps = np.diff(values, prepend=0)
    gaps[starts] = values[starts]
    size = 1 + sum((gaps >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    for k in range(5):
        more = size > k
        out[at[more] + k] = (gaps[more] >> (7 * k) & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, np.r_[at[starts], len(out)] if len(at) else np.zeros(1, np.int64)


def unvarint(data: np.ndarray) -> np.ndarray:
    """One run of positions back."""
    last = data < 128
    ends = np.flatnonzero(last)
    begin = np.r_[0, ends[:-1] + 1]
    shift = 7 * (np.arange(len(data)) - np.repeat(begin, ends - begin + 1))
    return np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << shift, begin))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of whole texts, one row per segment. Null and wordless texts are in it, without postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            words, counts = words_of(texts)
            bases = np.cumsum(counts + 1) - counts - 1
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            positions = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(texts)), counts)
            order = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary)))
            lists, list_offsets = varint(positions[order], starts)
            terms = coded.dictionary
            there = np.array(ids.is_valid())
            row = [
                uuid.uuid4().hex, len(texts), ids.fill_null(0).to_numpy().tobytes(), there.tobytes(), bases.tobytes(),
                counts.astype(np.int64).tobytes(), *_term_bytes(terms), list_offsets.astype(np.int64).tobytes(), lists.tobytes(),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[0]]), pa.array([row[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[2:])],
                names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, INDEX_SCHEMA)


def _term_bytes(terms: pa.Array) -> tuple[bytes, bytes]:
    _, offsets, data = terms.buffers()
    held = np.frombuffer(offsets, np.int64, len(terms) + 1, terms.offset * 8)
    return (held - held[0]).tobytes(), bytes(data[held[0] : held[-1]]) if len(terms) else b""


class Windows:
    """The windows of a block of items: term numbers, lengths and items. An item of fewer words is one window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        words, counts = words_of([t for _, t in items])
        coded = words.dictionary_encode()
        codes, self.terms = coded.indices.to_numpy(), coded.dictionary
        rows, self.items, self.lengths, at = [], [], [], 0
        for (item, _), n in zip(items, counts.tolist(), strict=True):
            for s in range(at, at + max(1, n - window + 1) if n else at):
                size = min(n, window)
                row = np.full(window, -1, np.int64)
                row[:size] = codes[s : s + size]
                rows.append(row)
                self.items.append(item)
                self.lengths.append(size)
            at += n
        self.rows = np.array(rows, np.int64).reshape(-1, window)


class Segment:
    """One index row, opened."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
        self.ids, self.there, self.bases, self.n_words = read("doc_ids"), read("has_id", bool), read("bases"), read("n_words")
        offsets = row["term_offsets"]
        self.terms = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) // 8 - 1, [None, pa.py_buffer(offsets), pa.py_buffer(row["terms"])]
        )
        self.list_offsets, self.lists = read("list_offsets"), read("lists", np.uint8)
        self.held: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        if term not in self.held:
            self.held[term] = unvarint(self.lists[self.list_offsets[term] : self.list_offsets[term + 1]])
        return self.held[term]

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The segment's number of each term, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)

    def find(self, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window number, start position and document of every occurrence; with ``slop``, every term may stand that many
        words off its place, measured from the rarest term, inside the rarest term's document."""
        empty = np.zeros(0, np.int64)
        if not len(windows.rows):
            return empty, empty, empty
        mine = np.append(self.numbers(windows.terms), -2)[windows.rows]  # -1, the padding, reads the added -2
        which, starts, docs = [empty], [empty], [empty]
        sizes = np.diff(self.list_offsets)
        for w in np.flatnonzero((mine != -1).all(axis=1)).tolist():
            terms = mine[w, : windows.lengths[w]]
            order = np.argsort(sizes[terms], kind="stable").tolist()
            at = self.positions(terms[order[0]])
            own = np.searchsorted(self.bases, at, "right") - 1
            for j in order[1:]:
                if not len(at):
                    break
                other, place = self.positions(terms[j]), at - order[0] + j
                least = np.maximum(place - slop, self.bases[own])
                most = np.minimum(place + slop, self.bases[own] + self.n_words[own] - 1)
                k = np.searchsorted(other, least)  # the first that isn't too early
                there = (k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= most)
                at, own = at[there], own[there]
            which.append(np.full(len(at), w))
            starts.append(at - order[0])
            docs.append(own)
        return np.concatenate(which), np.concatenate(starts), np.concatenate(docs)

    def matches(self, windows: Windows, slop: int = 0) -> list[list[dict]]:
        """For each document the word intervals of each item's occurrences, joined where they touch."""
        out: list[list[dict]] = [[] for _ in range(len(self.ids))]
        which, starts, docs = self.find(windows, slop)
        if not len(which):
            return out
        starts = starts - self.bases[docs]
        ends = np.minimum(starts + np.array(windows.lengths)[which], self.n_words[docs])
        starts = np.maximum(starts, 0)  # a shifted window may begin before its document or end behind it
        names, items = np.unique(np.array(windows.items, dtype=object).astype(str), return_inverse=True)
        items = items[which]
        last = None
        for o in np.lexsort((starts, items, docs)).tolist():
            key = (docs[o], items[o])
            if last == key and starts[o] <= out[key[0]][-1]["end"]:
                out[key[0]][-1]["end"] = max(out[key[0]][-1]["end"], int(ends[o]))
                continue
            out[key[0]].append({"item": str(names[key[1]]), "start": int(starts[o]), "end": int(ends[o])})
            last = key
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items with an id and a text, in blocks of about ``block_bytes``; each item is in one block."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.filter("item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r.item, r.text.encode()) for r in part.orderBy("item", "text").toLocalIterator()]


def search(
    index: DataFrame,
    items: DataFrame,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """Every indexed document with the word intervals that test windows hit: ``(segment, k, id, n_words, matches)``.

    ``slop`` 0 gives exact phrases, more gives proximity matches, always within one document. Items without words, id or
    text match nothing; documents without words, id or text have no matches but a row each; repeated rows have one each.
    """
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]

    def of(windows: Windows) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
                    held = Segment(row)
                    n = len(held.ids)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["segment"]] * n), pa.array(np.arange(n, dtype=np.int32)),
                            pa.array(held.ids, mask=~held.there), pa.array(held.n_words), pa.array(held.matches(windows, slop), kind),
                        ],
                        names=["segment", "k", "id", "n_words", "matches"],
                    )

        return index.mapInArrow(run, FOUND_SCHEMA)

    parts = [of(Windows(block, window)) for block in item_blocks(items, item_id_col, item_text_col, block_bytes)]
    if not parts:
        return of(Windows([], window))
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    joined = F.flatten(F.collect_list("matches")).alias("matches")
    return out.groupBy("segment", "k").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), joined)


def report(found: DataFrame, share: int = 20) -> DataFrame:
    """``search`` rows to hit counts: words hit, items found and the verdict: at least one word in ``share`` is hit."""
    covered = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, m: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), m["e"] - F.greatest(m["s"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], m["e"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    hits = F.when(F.size("matches") > 0, covered).otherwise(F.lit(0).cast("long"))
    counted = found.select("id", "n_words", hits.alias("n_hit"), items.alias("items"), "matches")
    return counted.select(
        "id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "matches",
    )


def contamination(docs: DataFrame, items: DataFrame, **how: int) -> DataFrame:
    """Index ``docs`` and report every document's exact benchmark hits. One row per input row; a null text has no
    words; repeated rows are reported each; a null id stays null. Repeated items count once."""
    return report(search(staged(build_index(docs), "postings"), items, **how))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, columns as they are. Rows are judged each: a null or repeated id
    saves no contaminated row and costs no clean one. Null and empty texts stay. ``id_col`` need not be unique, as it
    decides nothing."""
    if id_col not in docs.columns:
        raise ValueError(f"no column {id_col}")
    held, row = numbered(docs, "rows")
    index = staged(build_index(held, row, text_col), "postings")
    found = search(index, items, **how)
    bad = staged(report(found).filter("contaminated").select(F.col("id").alias(row)), "contaminated")
    discard(index)
    return held.join(bad, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
