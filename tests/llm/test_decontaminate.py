import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        mine, hit, found = words(text), set(), set()
        for item, item_text in items:
            theirs = words(item_text)
            size = min(13, len(theirs))
            for k in range(len(theirs) - size + 1) if size else ():
                for s in range(len(mine) - size + 1):
                    if mine[s] == theirs[k] and mine[s : s + size] == theirs[k : k + size]:
                        hit |= set(range(s, s + size))
                        found.add(str(item))
        n = len(hit)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(mine), n, len(found), sha, n > 0 and 20 * n >= len(mine)))
    return sorted(out, key=str)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r)[:6] for r in dc.contamination(d, b, **how).collect()), key=str)


def test_documents_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert any(r[5] for r in want)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, block_bytes=1500) == want


def test_odd_rows(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    items = [(1, passage), (2, "Zwei Wörter"), (3, None), (4, ""), (None, "lost item"), (10, passage), (10, passage), (5, "a a a")]
    docs = [
        (1, None), (2, ""), (3, passage.upper() + " tail"), (4, "x " * 300 + passage + " y" * 300), (4, "x " * 300 + passage),
        (5, "zwei--WÖRTER"), (6, "zwei--Wörter!"), (7, "a a a a a"), (None, passage), (8, "lost item"), (9, "k " * 50_000 + passage),
        (10, " ".join(f"w{k}" for k in range(12))), (11, " ".join(f"w{k}" for k in range(10)) + " gap " + passage[30:]),
    ]
    assert got(spark, docs, items) == brute(docs, [i for i in items if i[0] is not None])
    assert got(spark, [], items) == []
    assert got(spark, docs, []) == brute(docs, [])


def test_proximity(spark):
    def starts(text, item, slop):
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        b = spark.createDataFrame([(1, item)], "item_id long, text string")
        return [(m.start, m.end) for m in dc.search(dc.build_index(d), b, slop=slop).first().matches]

    assert starts("a b c d e f", "b c d", 0) == [(1, 4)]
    assert starts("a b x c d e f", "b c d", 0) == []
    assert starts("a b x c d e f", "b c d", 1) == [(1, 4)]
    assert starts("c b a", "a b c", 1) == []
    assert starts("c b a", "a b c", 4) != []


def test_proximity_stays_inside_a_document(spark):
    def hits(texts, item, slop):
        d = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1)
        b = spark.createDataFrame([(1, item)], "item_id long, text string")
        return {r.id: [(m.start, m.end) for m in r.matches] for r in dc.search(dc.build_index(d), b, slop=slop).collect()}

    assert hits(["a b", "c z"], "a b c", 1) == {1: [], 2: []}
    assert hits(["b a a", "z z z"], "a b", 2) == {1: [(0, 1)], 2: []}
    rng = random.Random(4)
    for _ in range(12):
        texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(7))) for _ in range(5)]
        item, slop = " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4))), rng.randrange(4)
        found = hits(texts, item, slop)
        for i, text in enumerate(texts, 1):
            mine, theirs = text.split(), item.split()
            near = any(all(any(s - slop <= k - j <= s + slop and x == y for k, x in enumerate(mine)) for j, y in enumerate(theirs)) for s in range(-3, 9))
            assert not found[i] or near, (texts, item, slop)
            exact = any(mine[s : s + len(theirs)] == theirs for s in range(len(mine)))
            assert found[i] or not exact, (texts, item, slop)
            assert all(0 <= a < b <= len(mine) for a, b in found[i])


@pytest.mark.parametrize("top", [100, 20_000, 1 << 33])
def test_varint_round_trip(top):
    rng = np.random.default_rng(top)
    runs = [np.unique(rng.integers(0, top, n)) for n in (1, 5, 400)]
    starts = np.cumsum([0, *(len(r) for r in runs[:-1])])
    data, offsets = dc.varint(np.concatenate(runs), starts)
    for k, run in enumerate(runs):
        assert (dc.unvarint(data[offsets[k] : offsets[k + 1]]) == run).all()


def test_words_of_matches_the_pattern():
    texts = ["", "Ab c9-D", "  ", "ÄÖ x\x7fy", "日本 z", "tail"]
    found, counts = dc.words_of([t.encode() for t in texts])
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert [w.decode() for w in found.cast(pa.binary()).to_pylist()] == [w for t in texts for w in words(t)]
