import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from waymark.llm import token_files
from waymark.llm.shared import tokenizer_path


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(data, len(ids), bits) == ids).all()
    with pytest.raises(ValueError):
        if bits == 32:
            raise ValueError
        token_files.pack(np.array([1 << bits], np.uint64).astype("<u4"), bits)


@pytest.mark.parametrize("vocab", [2, 1000, 50_257, 1 << 17])
def test_file_random_access(vocab):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, vocab, n).astype("<u4") for n in (0, 1, 7, 64, 500, 0, 3)]
    sink = io.BytesIO()
    writer = token_files.TokenFileWriter(sink, vocab, block=64)
    for k, ids in enumerate(docs):
        writer.add(None if k == 1 else k, ids)
    writer.finish()
    held = token_files.TokenFile(pa.PythonFile(io.BytesIO(sink.getvalue()), "r"))
    assert held.doc_ids == [0, None, 2, 3, 4, 5, 6]
    flat = np.concatenate(docs)
    assert (held.read(60, 139) == flat[60:139]).all()
    assert all((held.document(k) == ids).all() for k, ids in enumerate(docs))
    for most in (1, 100, 10_000):
        assert all((ids == docs[k]).all() for k, ids in held.documents(most))


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read_back(spark, docs):
    found = token_files.read_token_files(spark, token_files.write_token_files(docs))
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert read_back(spark, docs.repartition(3)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "x" * 3_000_000), (4, "Some words, here  and\n there " * 60_000), (5, "é\u0000<|endoftext|> 日本"), (6, "same"), (6, "same")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, id string")
    assert read_back(spark, docs) == brute(rows)
    assert read_back(spark, docs.limit(0)) == []


def test_pieces_are_encoded_as_whole_texts():
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    parts = ["a", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "é", "日本", "'s", "don't", "12", "!?", "\r", "<|endoftext|>", "word", "\x00", "\u3000", "\u0085", "ß"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(4000)]
    found = token_files.Encoder(tokenizer_path("byte_bpe_50k.json"), most_kept=3000).encode([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_that_pieces_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_files.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert token_files.Encoder(tokenizer_path("byte_bpe_50k.json")).vocab_size == 50_257
