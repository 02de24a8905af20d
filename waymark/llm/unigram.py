"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public model file. Where it holds merge ranks, not log probabilities, these are put in place by
Zipf's law, as a fixed rule. Text gets a marker for each space and one in front. No piece joins a marker to what
stands before it, so that text is cut in front of runs of markers and each distinct part is segmented once.
Characters that no piece covers become byte pieces.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import id_and_text, text_slices, tokenizer_path
from waymark.llm.token_files import PieceEncoder

MARKER = "▁".encode()
UNKNOWN_PENALTY = 10.0
LONG_PART = 512
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces, scores and types of a SentencePiece model file."""
    pieces, scores, kinds = [], [], []
    with open(path, "rb") as source:
        for field, value in _fields(source.read()):
            if field == 1:
                held = dict(_fields(value))
                pieces.append(held.get(1, b""))
                scores.append(struct.unpack("<f", held[2])[0] if 2 in held else 0.0)
                kinds.append(held.get(3, NORMAL))
    return pieces, np.array(scores), np.array(kinds)


def zipf_scores(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities for scores that are negative ranks."""
    weight = 1 / (1 - np.minimum(ranks, 0))
    return np.log(weight / weight.sum())


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is ``base[s] + b + 1`` if ``check`` there is s."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys:
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][byte]
            values[node] = value
        size = 2 * len(children) + 4096
        base, check, value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
        used = np.zeros(size, bool)
        used[0] = True
        place, free = {0: 0}, 1
        for node, below in enumerate(children):  # parents have smaller numbers than their children
            state = place.pop(node)
            value[state] = values[node]
            if not below:
                continue
            codes = np.array(sorted(below)) + 1
            free += int(np.argmin(used[free:]))
            at = max(1, free - int(codes[0]))
            while True:
                window = np.arange(at, at + 2048)
                if window[-1] + 257 >= size:
                    base, check, value = (np.r_[x, np.full(size, fill, np.int32)] for x, fill in ((base, 0), (check, -1), (value, -1)))
                    used, size = np.r_[used, np.zeros(size, bool)], 2 * size
                fits = ~used[window[:, None] + codes].any(axis=1)
                if fits.any():
                    at += int(np.argmax(fits))
                    break
                at += 2048
            base[state] = at
            used[at + codes] = True
            check[at + codes] = state
            for byte, child in below.items():
                place[child] = at + byte + 1
        self.base, self.check, self.value = base, check, value
        self.longest = max((len(k) for k, _ in keys), default=0)

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """Ends and values of the keys that begin at ``at``."""
        state = 0
        for k in range(at, min(len(data), at + self.longest)):
            child = self.base[state] + data[k] + 1
            if self.check[child] != state:
                return
            state = child
            if self.value[state] >= 0:
                yield k + 1, int(self.value[state])


class UnigramModel:
    """Pieces with log scores, their trie, and both directions."""

    key = ""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, kinds: np.ndarray, zipf: bool = True) -> None:
        self.pieces, self.kinds = pieces, kinds
        normal = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
        for k in normal:
            if pieces[k].replace(MARKER, b" ").lstrip(b" ").find(b" ") >= 0:
                raise ValueError("a piece joins a marker to what stands before it")
        self.scores = np.zeros(len(pieces))
        self.scores[normal] = zipf_scores(scores[normal]) if zipf else scores[normal]
        self.unknown_score = float(self.scores[normal].min()) - UNKNOWN_PENALTY
        self.unknown_id = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.bytes = np.full(256, self.unknown_id, np.int64)
        for k in np.flatnonzero(kinds == BYTE):
            self.bytes[int(pieces[k][1:-1], 16)] = k
        self.byte_fallback = bool((kinds == BYTE).any())
        self.trie = DoubleArray(sorted((pieces[k].replace(MARKER, b" "), int(k)) for k in normal))
        self.plain = [
            p.replace(MARKER, b" ") if t in (NORMAL, USER) else bytes([int(p[1:-1], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b""
            for p, t in zip(pieces, kinds.tolist(), strict=True)
        ]

    @classmethod
    def load(cls, path: str, zipf: bool = True) -> UnigramModel:
        return cls(*read_pieces(path), zipf=zipf)

    def segment_one(self, part: bytes) -> list[int]:
        """Viterbi over one part. At a tie the piece that ends the path is the longest."""
        n = len(part)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        at = 0
        while at < n:
            size = _char_size(part, at)
            single = False
            for end, piece in self.trie.prefixes(part, at):
                single |= end == at + size
                score = best[at] + self.scores[piece]
                if score > best[end]:
                    best[end], back[end] = score, (at, piece)
            if not single and best[at] + self.unknown_score > best[at + size]:
                best[at + size], back[at + size] = best[at] + self.unknown_score, (at, -1)
            at += size
        out: list[int] = []
        while n:
            start, piece = back[n]
            out += [piece] if piece >= 0 else self._of_bytes(part[start:n])[::-1]
            n = start
        return out[::-1]

    def _of_bytes(self, char: bytes) -> list[int]:
        return self.bytes[list(char)].tolist() if self.byte_fallback else [self.unknown_id]

    def segment(self, parts: list[bytes]) -> list[list[int]]:
        """Viterbi over many parts at once; very long ones one by one."""
        short = [k for k, p in enumerate(parts) if len(p) <= LONG_PART]
        out: list[list[int]] = [[]] * len(parts)
        for k, p in enumerate(parts):
            if len(p) > LONG_PART:
                out[k] = self.segment_one(p)
        for at in range(0, len(short), 1 << 14):
            some = short[at : at + (1 << 14)]
            for k, ids in zip(some, self._segment_short([parts[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _segment_short(self, parts: list[bytes]) -> list[list[int]]:
        buf = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(parts)), sizes)
        limit = ends[owner]
        starts = np.flatnonzero((buf & 0xC0) != 0x80)
        char_end = np.r_[starts[1:], len(buf)]  # a part begins with a character
        trie = self.trie
        # Every piece at every character: the states of all places move on together.
        place, state, edges = starts, np.zeros(len(starts), np.int64), []
        for depth in range(trie.longest):
            at = place + depth
            inside = at < limit[place]
            place, state, at = place[inside], state[inside], at[inside]
            child = trie.base[state] + buf[at].astype(np.int64) + 1
            on = trie.check[child] == state
            place, state = place[on], child[on]
            if not len(place):
                break
            value = trie.value[state]
            hit = value >= 0
            edges.append((place[hit], place[hit] + depth + 1, value[hit].astype(np.int64)))
        begin, end, piece = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 3
        alone = np.ones(len(buf), bool)
        size_of = np.zeros(len(buf), np.int64)
        size_of[starts] = char_end - starts
        alone[begin[end - begin == size_of[begin]]] = False
        lost = starts[alone[starts]]
        begin, end = np.r_[begin, lost], np.r_[end, lost + size_of[lost]]
        piece = np.r_[piece, np.full(len(lost), -1)]
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # Ends in order of their distance from the part's begin: what they build on is settled before.
        first = ends[owner[begin]] - sizes[owner[begin]]
        order = np.lexsort((begin, end, end - first))
        begin, end, piece, score = begin[order], end[order], piece[order], score[order]
        distance = (end - first[order]).astype(np.int64)
        # best and back are kept by end; a part's begin has place "end of the part before", so ends are shifted by part.
        slot = lambda at, of: at + of
        total = np.full(len(buf) + len(parts), -np.inf)
        back = np.zeros(len(buf) + len(parts), np.int64)
        total[slot(ends - sizes, np.arange(len(parts)))] = 0.0
        part = owner[begin]
        from_, to = slot(begin, part), slot(end, part)
        cuts = np.flatnonzero(np.r_[True, distance[1:] != distance[:-1]]) if len(distance) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(distance)], strict=True):
            reached = total[from_[a:b]] + score[a:b]
            here = to[a:b]
            group = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            top = np.maximum.reduceat(reached, group)
            which = np.flatnonzero(reached == np.repeat(top, np.diff(np.r_[group, b - a])))
            target, one = np.unique(here[which], return_index=True)  # the first: the smallest begin
            total[target] = top
            back[target] = a + which[one]
        found: list[list[int]] = [[] for _ in parts]
        live = np.arange(len(parts))[sizes > 0]
        at = slot(ends, np.arange(len(parts)))[live]
        zero = slot(ends - sizes, np.arange(len(parts)))
        steps = []
        while len(live):
            edge = back[at]
            steps.append((live, edge))
            at = from_[edge]
            on = at != zero[live]
            live, at = live[on], at[on]
        for some, edge in reversed(steps):
            for k, p, s, e in zip(some.tolist(), piece[edge].tolist(), begin[edge].tolist(), end[edge].tolist(), strict=True):
                if p >= 0:
                    found[k].append(p)
                else:
                    found[k] += self._of_bytes(buf[s:e].tobytes())
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: markers to spaces, byte pieces to bytes, without the space that encoding puts in front."""
        data = b"".join(map(self.plain.__getitem__, ids.tolist()))
        return data[1:] if data[:1] == b" " else data


def _char_size(data: bytes, at: int) -> int:
    end = at + 1
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return end - at


def parts_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Texts with a space in front, cut before every run of spaces, and each text's number of parts. A marker in a
    text counts as the space that it decodes to."""
    held = [b" " + t.replace(MARKER, b" ") if t else b"" for t in texts]
    buf = np.frombuffer(b"".join(held), np.uint8)
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    ends = np.cumsum(sizes)
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = (buf[1:] == 32) & (buf[:-1] != 32)
    cut[ends - sizes] = True
    cut[-1] = True
    at = np.flatnonzero(cut)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf)])
    upto = np.searchsorted(at, ends)
    return parts, np.diff(upto, prepend=0)


class UnigramEncoder(PieceEncoder):
    """Batches of texts to ids."""

    def __init__(self, model: UnigramModel, most_kept: int = 300_000) -> None:
        super().__init__(most_kept)
        self.model = model

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        return parts_of(texts)

    def encode_parts(self, parts: list[bytes]) -> list[list[int]]:
        return self.model.segment(parts)


_ENCODERS: dict[str, UnigramEncoder] = {}


@functools.cache
def loaded(path: str) -> UnigramModel:
    """A model by file, its trie built once on the driver; tasks receive it with their function."""
    model = UnigramModel.load(path)
    model.key = path
    return model


def encoder(model: UnigramModel) -> UnigramEncoder:
    """One encoder for each worker and file, so that what it has kept lasts from task to task."""
    if model.key not in _ENCODERS:
        _ENCODERS[model.key] = UnigramEncoder(model)
    return _ENCODERS[model.key]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``(id, text, ids)`` for every row from its whole text; a null or empty text has no ids. Repeated rows and null
    ids stay."""
    held = loaded(tokenizer_path(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_slices(iter([batch])):
                found = encoder(held).encode(texts)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(at, len(texts)), lists], names=["id", "text", "ids"])
                at += len(texts)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, text string, ids array<int>")


def decoded(tokens: DataFrame, ids_col: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``tokens`` with the ``decoded`` text of its ids and the ``ids_crc32`` over them as little-endian 32-bit numbers.
    Null ids decode to null; columns of those names give way."""
    held = loaded(tokenizer_path(model))
    tokens = tokens.drop(*(c for c in tokens.columns if c.lower() in ("decoded", "ids_crc32") and c != ids_col))
    names = tokens.columns
    out = tokens.select("*", F.lit(None).cast("string").alias("decoded"), F.lit(None).cast("long").alias("ids_crc32"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(ids_col))
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts: list[str | None] = []
            crcs: list[int | None] = []
            for k, there in enumerate(column.is_valid().to_pylist()):
                ids = flat[offsets[k] : offsets[k + 1]]
                texts.append(encoder(held).model.decode(ids).decode("utf-8", "replace") if there else None)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()) if there else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), pa.array(texts, pa.string()), pa.array(crcs, pa.int64())],
                names=[*names, "decoded", "ids_crc32"],
            )

    return tokens.mapInArrow(run, out.schema)


def tokenised(
    docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", model: str = "piece_bpe_32k.model", crc_col: str | None = None
) -> DataFrame:
    """``docs`` with the ids of its texts in ``ids_col`` and, as its text, what they decode to. A null text stays null
    and has no ids. ``crc_col`` adds the crc32 of the ids as little-endian 32-bit numbers. One pass does both ways, so
    that an executor has one Python worker for each task. Columns of ``docs`` that have a new column's name, in whatever
    letter case, give way to it."""
    new = [ids_col, *([crc_col] if crc_col else [])]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {n.lower() for n in new} and c != text_col))
    held, names = loaded(tokenizer_path(model)), docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["id", "text"])
            start = 0
            for _, texts in text_slices(iter([rows])):
                part = batch.slice(start, len(texts))
                start += len(texts)
                found = encoder(held).encode(texts)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                there = part.column(at).is_valid().to_pylist()
                back = [held.decode(ids).decode("utf-8", "replace") if ok else None for ids, ok in zip(found, there, strict=True)]
                columns = [pa.array(back, pa.string()) if k == at else c for k, c in enumerate(part.columns)]
                added = [lists, *([pa.array([zlib.crc32(ids.tobytes()) for ids in found], pa.int64())] if crc_col else [])]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*names, *new])

    kinds = [F.lit(None).cast(kind).alias(c) for c, kind in zip(new, ("array<int>", "long"), strict=False)]
    schema = docs.select("*", *kinds).schema
    return docs.mapInArrow(run, schema)
