"""Registered queries without SQL against plain versions of what they return."""

import hashlib
import zlib

import numpy as np
import zstandard

from tests.llm.test_neighbours import brute as brute_neighbours
from tests.llm.test_token_files import brute as brute_tokens
from waymark.llm import language, queries, unigram
from waymark.llm.shared import tokenizer_path


def run(spark, sf_dir, name):
    return [tuple(r) for r in queries.queries()[name](spark, sf_dir).collect()]


def test_op3_against_single_segments(spark, sf_dir):
    model = unigram.UnigramModel.load(tokenizer_path("piece_bpe_32k.model"))
    got = {r[0]: r[1:] for r in run(spark, sf_dir, "op3_sentencepiece")}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        parts, _ = unigram.parts_of([(text or "").encode()])
        ids = [x for p in parts.to_pylist() for x in model.segment_one(p)]
        back = None if text is None else text.replace("▁", " ")
        sha = None if back is None else hashlib.sha256(back.encode()).hexdigest()
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), sha, True)


def test_op5_against_plain_compression(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = language.fit(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    assert set(model.dictionaries) == {r.lang for r in docs.collect() if r.lang and r.text and not held(r.doc_id)}
    coders = []
    for data in model.dictionaries.values():
        kept = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders.append(zstandard.ZstdCompressor(dict_data=kept, level=9, write_content_size=False, write_checksum=False, write_dict_id=False))
    texts, got = {r.doc_id: r.text for r in docs.collect()}, {r[0]: r for r in run(spark, path, "op5_language")}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        data = f" {' '.join(words)} ".encode()
        sizes = [sum(len(c.compress(data[k : k + 4096])) for k in range(0, len(data), 4096)) for c in coders]
        assert got[i][1] == held(i)
        if not words:
            assert got[i][2:4] == ("und", 0.0)
            continue
        best = min(range(len(sizes)), key=lambda k: sizes[k])
        margin = min(s for k, s in enumerate(sizes) if k != best) / sizes[best] - 1
        assert got[i][2] == list(model.dictionaries)[best] and abs(got[i][3] - (1 - 0.5 * np.exp(-20 * margin))) < 1e-12


def test_op7_against_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute_neighbours(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    got = {}
    for q, rank, i, score in sorted(run(spark, sf_dir, "op7_neighbours")):
        got.setdefault(q, []).append((rank, i, score))
    assert got.keys() == want.keys() and all([r for r, _, _ in found] == [1, 2, 3, 4, 5] for found in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.99 * 5 * len(want)
    assert all(abs(s - dict(want[q])[i]) < 1e-12 for q in want for _, i, s in got[q] if i in dict(want[q]))


def test_op9_against_the_library(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(run(spark, sf_dir, "op9_token_files"), key=lambda r: r[1]) == brute_tokens(rows)
