import random

import numpy as np

from tests.llm.brute import similar_groups
from waymark.llm import near_copies

SCHEMA = "row long, text string"


def found(spark, texts):
    df = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3)
    return {r.row: r.group for r in near_copies.grouped(df).collect()}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.random()}" for w in words)


def test_groups_against_all_pairs(spark, sf_dir):
    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 3000").collect()}
    for k, (_, text) in enumerate(list(texts.items())[:40]):
        for share in (0.005, 0.01, 0.02, 0.03, 0.04):
            texts[10_000 + 10 * k + int(share * 1000)] = edited(rng, (text or "").split(), share)
    assert found(spark, texts) == similar_groups(texts)


def test_chains_and_dense_groups(spark):
    """Copies of copies, of which distant ones are not similar; and many copies of one text under the same keys."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = {}
    for k in range(12):
        texts[k] = " ".join(words)
        words[9 * k] = f"changed{k}"
    base = [f"b{rng.randrange(300)}" for _ in range(200)]
    texts |= {100 + k: edited(rng, base, 0.01) for k in range(150)}
    want = similar_groups(texts)
    assert len({want[k] for k in range(12)}) == 1
    assert found(spark, texts) == want


def test_recall_at_the_threshold():
    """Pairs just over 0.8: at least one key is shared in 99.5 of 100."""
    rng, missed = random.Random(9), 0
    for _ in range(400):
        words = [f"w{rng.random()}" for _ in range(160)]
        other = list(words)
        for at in rng.sample(range(0, 155, 6), 3):
            other[at + 2] = "x"
        a, b = " ".join(words).encode(), " ".join(other).encode()
        assert near_copies.similar(a, b) and not near_copies.similar(a, " ".join(other[:110]).encode())
        _, (x, y) = near_copies.segment_keys([a, b])
        missed += not (x == y).any()
    assert missed <= 3


def test_keys_depend_on_the_text_alone():
    texts = [b"", b"one two", b"A b C d e f g h", "ÄÖ Ü ß x y z\tq\nr".encode(), b" \n"]
    for k in (0, 1):
        alone = np.concatenate([near_copies.segment_keys([t])[k] for t in texts])
        assert (near_copies.segment_keys(texts)[k] == alone).all()
        assert (near_copies.segment_keys([b"a  B c\nD e F G h"])[k][0] == alone[2]).all()


def test_odd_rows(spark):
    long = "alpha beta gamma delta " * 60_000
    rows = [
        (5, None), (3, ""), (4, " \n\t"), (9, "one two"), (8, "ONE  two"), (7, "eins zwei drei vier"), (7, "eins zwei drei vier"), (None, "eins zwei drei vier"),
        (11, long), (10, long.upper()), (None, "no other has this text"), (12, "ÄÖ Ü"), (13, "äö ü"),
    ]
    df = spark.createDataFrame([(i, t, 1, "y", 2) for i, t in rows], "doc_id long, text string, __row int, group string, digest int")
    kept = near_copies.representatives(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "8", "7", "10", "None", "12", "13"])
    assert near_copies.representatives(df.limit(0)).count() == 0


def test_pairs_beyond_the_rounds_are_found(spark, monkeypatch):
    """Texts that share keys with many that are not similar; no round joins any, keys come in several parts."""
    monkeypatch.setattr(near_copies, "WHOLE_ROUNDS", 0)
    monkeypatch.setattr(near_copies, "PART", 7)
    rng = random.Random(11)
    words = lambda n, name: [f"{name}{rng.randrange(10**6)}" for _ in range(n)]
    shared, texts = words(130, "s"), {}
    for k in range(40):
        own = shared + words(50, "o")
        texts[2 * k], texts[2 * k + 1] = " ".join(own), " ".join([*own[:-3], *words(3, "e")])
    want = similar_groups(texts)
    assert found(spark, texts) == want and len(set(want.values())) == 40


def test_common_shingles_by_matrices(monkeypatch):
    monkeypatch.setattr(near_copies, "_COLUMNS", 5)
    rng = random.Random(12)
    sets = [{(b"%d" % rng.randrange(60),) for _ in range(rng.randrange(40))} for _ in range(30)] + [set(), set()]
    rows, columns = np.arange(0, 20), np.arange(5, 32)
    assert near_copies._common(sets, rows, columns).tolist() == [[len(sets[i] & sets[j]) for j in columns] for i in rows]
