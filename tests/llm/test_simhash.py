import random

import xxhash

from waymark.llm import queries, simhash

SCHEMA = "doc_id long, text string, id string, fp string, component string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    """key -> smallest key over the links of all pairs."""
    ids = sorted(keys)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_components(prints):
    """id -> smallest id over links of at most two bits."""
    return components(prints, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    want = brute_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(prints)
    for r in got:
        assert r.fp & (2**64 - 1) == prints[r.id]
        assert r.component == want[r.id]


def test_crowded_keys_are_exact(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = {}
    while len(prints) < 700:
        fp = rng.choice(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            fp ^= 1 << rng.randrange(64 if rng.random() < 0.3 else 20)
        if fp not in prints.values():
            prints[len(prints) + 1] = fp
    want = brute_components(prints)
    rows = [(i, fp - 2**64 if fp >> 63 else fp) for i, fp in prints.items()]
    for pairwise in (2, 8, 256):
        got = simhash.with_components(spark.createDataFrame(rows, "id long, fp long"), pairwise).collect()
        assert {r.id: r.component for r in got} == want


def test_nulls_empty_repeats_and_clashing_columns(spark):
    long_text = "Alpha beta gamma delta " * 40_000
    rows = [
        (5, None), (3, ""), (4, " \n\t"), (9, "one two"), (8, "ONE  two"), (7, "eins zwei drei vier"), (7, "eins zwei drei vier"),
        (None, "eins zwei drei vier"), (11, long_text), (10, long_text.upper()), (12, "ÄÖ Ü"), (13, "äö ü"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = [(5, 3), (3, 3), (4, 3), (9, 8), (8, 8), (7, 7), (7, 7), (None, 7), (11, 10), (10, 10), (12, 12), (13, 13)]
    assert got == sorted(want, key=str)


def test_rows_without_an_id_tie_others(spark):
    rows = [(1, 0), (None, 0b11), (2, 0b1111), (None, 1 << 40), (9, 0b111 << 50), (None, 0b111 << 50)]
    got = simhash.with_components(spark.createDataFrame(rows, "id long, fp long")).collect()
    assert sorted(((r.id, r.component) for r in got), key=str) == sorted([(1, 1), (None, 1), (2, 1), (None, 1), (9, 9), (None, 9)], key=str)


def test_query_against_brute_force(spark, sf_dir):
    got = queries.queries()["op8_simhash"](spark, sf_dir).collect()
    prints = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_components(prints)
    assert sorted(tuple(r) for r in got) == sorted((i, f"{prints[i]:016x}", want[i]) for i in prints)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
