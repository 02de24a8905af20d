"""Token-id files with fixed-width bit packing.

File layout, little-endian throughout::

    payload   blocks of ``block`` ids, each id in ``bits`` bits, lowest bit first; a block is whole bytes,
              the last one is padded with zero bits
    docs      int64 id of each document, uint8 "has an id", int64 local start of each and of the end
    offsets   uint64 byte offset of each block and of the payload's end
    trailer   magic, version, bits, block, number of documents, of ids, of blocks

``bits`` is the least that holds every id of the vocabulary. A reader fetches the trailer and tables, then any
range of ids by the blocks that hold it, unpacked with numpy.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.shared import id_and_text, staged, staged_path, text_slices, tokenizer_path

MAGIC = b"WMTOKIDS"
TRAILER = struct.Struct("<8sIIIqqq")
BLOCK = 4096


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, padded to a whole byte."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    cells = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(cells.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of ``data``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    cells = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = cells
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenFileWriter:
    """Streams documents into one file; holds one block of ids and a few numbers per document."""

    def __init__(self, sink: object, vocab_size: int, block: int = BLOCK) -> None:
        if block % 8:
            raise ValueError("a block must be a multiple of 8 ids")
        self.sink, self.bits, self.block = sink, bits_for(vocab_size), block
        self.rest = np.zeros(0, "<u4")
        self.ids: list[int | None] = []
        self.starts, self.offsets = [0], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest = np.concatenate([self.rest, ids])
        if whole := len(self.rest) // self.block * self.block:
            data, each = pack(self.rest[:whole], self.bits), self.block * self.bits // 8
            self.sink.write(data)
            self.offsets += range(self.offsets[-1] + each, self.offsets[-1] + len(data) + 1, each)
            self.rest = self.rest[whole:]

    def finish(self) -> None:
        if len(self.rest):
            data = pack(self.rest, self.bits)
            self.sink.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.sink.write(np.array([i or 0 for i in self.ids], "<i8").tobytes())
        self.sink.write(np.array([i is not None for i in self.ids], np.uint8).tobytes())
        self.sink.write(np.array(self.starts, "<i8").tobytes())
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(
            TRAILER.pack(MAGIC, 1, self.bits, self.block, len(self.ids), self.starts[-1], len(self.offsets) - 1)
        )


class TokenFile:
    """Random access to one file, opened by ``pyarrow.fs``."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, size = source, source.size()
        source.seek(size - TRAILER.size)
        magic, version, self.bits, self.block, docs, self.n_ids, blocks = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file of version 1")
        tables = docs * 9 + (docs + 1) * 8 + (blocks + 1) * 8
        source.seek(size - TRAILER.size - tables)
        data, at = source.read(tables), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, there = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(i) if ok else None for i, ok in zip(ids, there, strict=True)]
        self.starts, self.offsets = take("<i8", docs + 1), take("<u8", blocks + 1)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end``, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        return unpack(data, min(self.n_ids - first * self.block, (last + 1 - first) * self.block), self.bits)[
            start - first * self.block : end - first * self.block
        ]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, most_ids: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document in order, read in runs of about ``most_ids`` ids."""
        k = 0
        while k < len(self.doc_ids):
            upto = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most_ids, "right")) - 1)
            base = int(self.starts[k])
            ids = self.read(base, int(self.starts[upto]))
            for i in range(k, upto):
                yield i, ids[self.starts[i] - base : self.starts[i + 1] - base]
            k = upto


_NONSPACE = np.zeros(256, bool)
_NONSPACE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = _NONSPACE & ~_LETTER
_SIGN[48:58] = False
_SIGN[ord("|")] = _SIGN[ord("<")] = _SIGN[ord(">")] = False  # of names of special tokens
_AFTER_SPACE = _NONSPACE.copy()
_AFTER_SPACE[0xC3:] = True  # lead bytes of characters that can't be white space
_AFTER_SPACE[[0xE1, 0xE2, 0xE3]] = False


def pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The texts cut where a byte-level pre-tokenizer begins a token in any case, and each text's number of pieces.

    It does so at a space before something visible, at a sign behind a letter, at a line break behind something
    visible, and behind such a line break if something visible follows; so pieces can be encoded one by one.
    """
    joined = b"\0".join([*texts, b""])
    buf = np.frombuffer(joined, np.uint8)
    n = len(buf)
    starts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    starts = np.r_[0, starts]
    cut = np.zeros(n + 1, bool)
    shown = _NONSPACE[buf]
    cut[: n - 1] |= (buf[:-1] == 32) & _AFTER_SPACE[buf[1:]]
    cut[1:n] |= _LETTER[buf[:-1]] & _SIGN[buf[1:]]
    ends_line = (buf[1:] == 10) & shown[:-1]
    cut[1:n] |= ends_line
    cut[2:n] |= ends_line[:-1] & shown[2:]
    cut[starts] = True
    inside = np.ones(n, bool)
    inside[starts[1:] - 1] = False  # the separators
    at = np.flatnonzero(cut)
    doc = np.searchsorted(starts, at, "right") - 1
    begin = at - doc
    begin[-1] = n - len(texts)
    real = np.flatnonzero(np.diff(begin) > 0)
    offsets = np.ascontiguousarray(np.append(begin[real], begin[-1]))
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(real), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])]
    )
    return found, np.bincount(doc[real], minlength=len(texts))


class PieceEncoder:
    """Batches of texts to ids, part by part. Distinct parts are encoded once and kept, up to a bound."""

    def __init__(self, most_kept: int = 500_000) -> None:
        self.most_kept = most_kept
        self.kept: dict[bytes, bytes] = {}

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts and each text's number of them."""
        raise NotImplementedError

    def encode_parts(self, parts: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found, counts = self.cut(texts)
        coded = found.dictionary_encode()
        names, kept = coded.dictionary.to_pylist(), self.kept
        if missing := [x for x in names if x not in kept]:
            if len(kept) + len(missing) > self.most_kept:
                kept.clear()
                missing = names
            for at in range(0, len(missing), 1 << 14):
                part = missing[at : at + (1 << 14)]
                for x, ids in zip(part, self.encode_parts(part), strict=True):
                    kept[x] = array("I", ids).tobytes()
        each = [kept[x] for x in names]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32).astype("<u4", copy=False)
        codes = coded.indices.to_numpy()
        used = sizes[codes]
        ends = np.cumsum(used)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - used), used) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.r_[0, ends][np.cumsum(counts)]
        return np.split(ids, upto[:-1]) if len(texts) else []


class Encoder(PieceEncoder):
    """Texts to ids with the tokenizers library. Files with another pre-tokenizer than the byte-level one that ``pieces``
    is right for, with a normaliser, or with an added token that a piece could cut, are refused."""

    def __init__(self, path: str, most_kept: int = 500_000) -> None:
        super().__init__(most_kept)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before, added = told["pre_tokenizer"] or {}, [t["content"] for t in told["added_tokens"]]
        if told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level files without a normaliser are cut rightly")
        if any(len(pieces([t.encode()])[0]) != 1 for t in added):
            raise ValueError(f"{path}: an added token would be cut: {added}")
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        return pieces(texts)

    def encode_parts(self, parts: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(parts), 1000):
            words = [x.decode("utf-8", "replace") for x in parts[at : at + 1000]]
            out += [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    block: int = BLOCK,
    folder: str | None = None,
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write one file per range of ids, in ascending id order.

    Returns the manifest ``(shard, path, n_docs, n_ids)``, already written. Null texts count as empty; rows with a
    null id come first; rows that repeat an id stay, ordered by a hash of their text. Every attempt of a task
    writes a file of its own and the manifest names the one that counts, so that retries do no harm.
    """
    spark = docs.sparkSession
    path, vocab_size = tokenizer_path(tokenizer), encoder(tokenizer_path(tokenizer)).vocab_size
    folder = folder or staged_path(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, files = TaskContext.get().partitionId(), None
        for ids, texts in text_slices(batches):
            if files is None:
                files, at = pafs.FileSystem.from_uri(folder)
                files.create_dir(at, recursive=True)
                at = f"{at}/{shard:06d}-{uuid.uuid4().hex}.ids"
                sink = files.open_output_stream(at)
                writer = TokenFileWriter(sink, vocab_size, block)
            found = encoder(path).encode(texts)
            for doc_id, tokens in zip(ids.to_pylist(), found, strict=True):
                writer.add(doc_id, np.append(tokens, np.array([end_id], "<u4")))
        if files is not None:
            writer.finish()
            sink.close()
            name = f"{folder}/{at.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": name, "n_docs": len(writer.ids), "n_ids": writer.starts[-1]}],
                schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    rows = id_and_text(docs, id_col, text_col).repartitionByRange("id")
    rows = rows.sortWithinPartitions("id", F.xxhash64("text"))
    return staged(rows.mapInArrow(run, "shard int, path string, n_docs long, n_ids long"), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the files that the manifest names.

    The manifest has a row for each file; it alone comes to the driver, to add up the files' sizes.
    """
    start, rows = 0, []
    for shard in manifest.orderBy("shard").collect():
        rows.append((shard.shard, shard.path, start))
        start += shard.n_ids
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("start", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, at = pafs.FileSystem.from_uri(row["path"])
                with files.open_input_file(at) as source:
                    held = TokenFile(source)
                    crcs = [zlib.crc32(ids.tobytes()) for _, ids in held.documents()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.doc_ids, pa.int64()),
                        pa.array(held.starts[:-1] + row["start"]),
                        pa.array(np.diff(held.starts)),
                        pa.array(np.array(crcs, np.int64)),
                    ],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    shards = spark.createDataFrame(rows, schema)
    if rows:
        shards = shards.repartition(len(rows), "shard")
    return shards.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
