import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from waymark.llm import language, quality, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, id string, score double"


def held_out(spark, name, label, folder="sf0.1"):
    path = f"/root/testdata/{folder}"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", label)
    found = queries.queries()[name](spark, path)
    assert found.count() == spark.read.parquet(f"{path}/documents.parquet").count()
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    return [(r.score, r.predicted, r[label]) for r in rows]


def auc(rows):
    good, bad = [s for s, _, y in rows if y == 1], [s for s, _, y in rows if y == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_held_out(spark):
    rows = held_out(spark, "op1_quality", "quality")
    assert auc(rows) > 0.99 and np.mean([p == y for _, p, y in rows]) > 0.98


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op2_toxicity", "toxic")
    assert auc(rows) > 0.93 and np.mean([p == y for _, p, y in rows]) > 0.94


def test_language_held_out(spark):
    path = "/root/testdata/sf0.1"
    found = queries.queries()["op5_language"](spark, path)
    rows = found.filter("held_out").join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert rows.filter("lang = lang_pred").count() / rows.count() > 0.99


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "some words"), (4, "12 34 !!"), (5, "same text here"), (5, "same text here"), (6, "word " * 300_000), (7, "日本語 テキスト")]
    return spark.createDataFrame([(i, t, "en" if i in (5, 6) else None, "x", 0.5) for i, t in rows], SCHEMA)


def test_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (5, 1), (None, 1), (1, None), (99, 0)], "doc_id long, quality int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        rows = quality.scored(docs, model).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in rows)
        assert len({r.score for r in rows if r.id in (1, 2, 3)}) == 1
        assert quality.accepted(docs, model).columns == docs.columns
    positives = labels.filter("quality = 1")
    for model in (toxicity.fit(docs, positives, 0.1), toxicity.fit(docs, positives.limit(0), 0.1), toxicity.fit(docs.limit(0), positives, 0.0)):
        rows = toxicity.scored(docs, model).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    model = language.fit(docs)
    got = {r.id: (r.lang, r.rejected) for r in language.identified(docs, model).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ("und", True) and got[5][0] == got[7][0] == "en"
    assert {r.lang for r in language.identified(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert quality.scored(docs.limit(0), quality.fit(docs, labels)).count() == 0


def plain_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text)


def bucket(token):
    return int(quality.tokens([token])[0][0])


def some_texts(seed, n=40):
    rng = random.Random(seed)
    words = ["The", "cat", "SAT", "on!!", "9", "|", "cat", "über", "a-b", "%%%", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))).encode() for _ in range(n)]


def test_tokens_against_a_pattern():
    texts = some_texts(1) + [b"", b" ", b"!a!!b", "日本語 テキスト".encode()]
    found, counts = quality.tokens(texts)
    assert counts.tolist() == [len(plain_tokens(t)) for t in texts]
    assert found.tolist() == [bucket(w) for t in texts for w in plain_tokens(t)]


def plain_sums(texts):
    index = quality.index_vectors().astype(int)
    seen, sums = Counter(), defaultdict(lambda: np.zeros(quality.DIMENSIONS, int))
    for text in texts:
        words = [bucket(w) for w in plain_tokens(text)]
        for k, w in enumerate(words):
            seen[w] += 1
            for d in (-2, -1, 1, 2):
                if 0 <= k + d < len(words):
                    sums[w] = sums[w] + np.roll(index[words[k + d]], d)
    return seen, sums


def test_context_sums_against_brute_force():
    texts = some_texts(2)
    seen, sums = quality.context_sums(iter([texts[:15], texts[15:], [b""], [b"x"]]))
    want_seen, want = plain_sums([*texts, b"x"])
    assert {k: int(seen[k]) for k in np.flatnonzero(seen)} == dict(want_seen)
    assert all((sums[k] == want[k]).all() for k in want_seen) and not sums[[k for k in range(len(sums)) if k not in want]].any()


def test_quality_query_against_a_plain_forward_pass(spark, sf_dir):
    """Scores of the fitted model, from word vectors made and pooled one token at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    model = quality.fit(docs, labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    got = {r.doc_id: r for r in queries.queries()["op1_quality"](spark, sf_dir).collect()}
    seen, sums = plain_sums(texts.values())
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sums.items()}
    weight = {k: 1e-3 / (1e-3 + n / sum(seen.values())) for k, n in seen.items()}
    w1, b1, w2, b2 = (x.astype(float) for x in model.layers)
    assert got.keys() == texts.keys()
    for i, text in list(texts.items())[:60]:
        words = [bucket(w) for w in plain_tokens(text)]
        zero = np.zeros(quality.DIMENSIONS)
        of, total = [unit.get(w, zero) for w in words], max(sum(weight[w] for w in words), 1e-9)
        mean = sum((weight[w] * v for w, v in zip(words, of, strict=True)), zero) / total
        spread = np.sqrt(np.maximum(sum((weight[w] * v * v for w, v in zip(words, of, strict=True)), zero) / total - mean * mean, 0))
        product = sum((x * y for x, y in zip(of, of[1:], strict=False)), zero) / max(len(of) - 1, 1)
        x = (np.concatenate([mean, spread, product]) - model.mean) / model.scale
        z = (np.tanh(x @ w1 + b1) @ w2 + b2)[0] / model.temperature
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3)
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (rng.random(3000) < p).astype(float)
    model = quality.train(x, y, np.zeros((1, 1)), np.zeros(1))
    got = 1 / (1 + np.exp(-model.logits(x) / model.temperature))
    assert np.mean((got > 0.5) == (p > 0.5)) > 0.85 and abs(got.mean() - y.mean()) < 0.05 and 0.2 < model.temperature < 13


@pytest.mark.parametrize("prior", [0.1, 0.3])
def test_risk_is_corrected_by_the_prior(prior):
    """Unlabelled texts hold toxic ones too; they must not be learned as negative."""
    rng = np.random.default_rng(1)

    def texts(n, toxic):
        x = (rng.random((n, 20)) < 0.2).astype(np.float32)
        x[:, 0] = toxic
        return x

    unlabelled = np.concatenate([texts(int(4000 * prior), 1), texts(int(4000 * (1 - prior)), 0)])
    w, b = toxicity.train(texts(500, 1), unlabelled, prior)
    score = 1 / (1 + np.exp(-(unlabelled @ w + b)))
    assert score[unlabelled[:, 0] == 1].min() > 0.5 > score[unlabelled[:, 0] == 0].max()


def plain_features(text):
    """Words, and beginnings of four to six bytes of longer words."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    return set(words) | {w[:k] for w in words for k in (4, 5, 6) if len(w) > k}


def test_features_against_a_plain_version():
    texts = ["", "Stupid stupidity, über-all 12345678 x", "ÄÖ äö", "  a b\nstup"]
    of, buckets = toxicity.features_of([t.encode() for t in texts])
    for k, text in enumerate(texts):
        own = {int(b) for b in buckets[of == k]}
        assert len(own) == len(plain_features(text.encode()))
        assert own == {int(b) for b in toxicity.features_of([text.encode()])[1]}


@pytest.mark.parametrize("overfit", [False, True])
def test_risk_sums_against_plain_arithmetic(overfit):
    rng = np.random.default_rng(3)
    cells, kinds, hashes = rng.random((60, 9)) < 0.3, rng.random(60) < 0.4, rng.integers(0, 99, 60)
    weights, offsets = rng.normal(0, 1, (9, 3)), rng.normal(0, 1, 3)
    u, p = toxicity.risk_sums(np.nonzero(cells)[1], cells.sum(axis=1), kinds, hashes, weights, offsets)
    trainer = toxicity.Trainer(np.array([(cells[kinds & (hashes % 3 != c)]).mean(axis=0) for c in range(3)]), 1.6 if overfit else 0.05)
    trainer.weights, trainer.offsets = weights.copy(), offsets.copy()
    trainer.move(u, p, 60)
    for c in range(3):
        def risk(w, b):
            z, own = cells @ w + b, hashes % 3 != c
            pos = z[own & kinds]
            negative = np.logaddexp(0, z[own]).mean() - trainer.prior * np.logaddexp(0, pos).mean()
            if negative < 0:
                return -negative, negative
            return trainer.prior * np.logaddexp(0, -pos).mean() + negative, negative

        assert (risk(weights[:, c], offsets[c])[1] < 0) == overfit
        for k in range(9):  # the slope by differences has the sign of the step, which Adam's first step keeps
            up, down = weights[:, c].copy(), weights[:, c].copy()
            up[k] += 1e-4
            down[k] -= 1e-4
            slope = (risk(up, offsets[c])[0] - risk(down, offsets[c])[0]) / 2e-4 + toxicity.DECAY * weights[k, c]
            assert abs(slope) < 1e-5 or np.sign(weights[k, c] - trainer.weights[k, c]) == np.sign(slope)


def test_toxicity_query_against_a_plain_version(spark):
    """Feature counts, training on all unlabelled texts, and scores, with dictionaries and dense rows."""
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").collect(), spark.read.parquet(f"{path}/labels.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = {r.doc_id: r.toxic for r in labels if not held(r.doc_id) and r.toxic in (0, 1)}
    prior = sum(known.values()) / len(known)
    of = lambda t: {int(b) for b in toxicity.features_of([(t or "").encode()])[1]}
    own = {r.doc_id: of(r.text) for r in docs}
    unlabelled = [r.doc_id for r in docs if r.text is not None and not held(r.doc_id)]
    positive = [i for i in unlabelled if known.get(i) == 1]
    u, p = Counter(b for i in unlabelled for b in own[i]), Counter(b for i in positive for b in own[i])
    tp, tu = len(positive), len(unlabelled)
    lift = {b: ((n - 2 * n**0.5) / tp) / ((u[b] + 2) / tu) for b, n in p.items()}
    over = {b: (n / tp - u[b] / tu) / ((n + 1) / tp / tp + (u[b] + 1) / tu / tu) ** 0.5 for b, n in p.items()}
    chosen = sorted((b for b in p if lift[b] >= 2.5 and over[b] >= 3), key=lambda b: (-over[b], b))[:1024]
    cells = np.array([[b in own[i] for b in chosen] for i in unlabelled], float)
    texts = {r.doc_id: (r.text or "").encode() for r in docs}
    want = 0
    for c in range(3):
        keep = np.array([zlib.crc32(texts[i]) % 3 != c for i in unlabelled])
        pos = np.array([i in positive for i in unlabelled]) & keep
        trainer = toxicity.Trainer(cells[pos].mean(axis=0, keepdims=True), prior)
        for _ in range(toxicity.ROUNDS):
            z = cells @ trainer.weights[:, 0] + trainer.offsets[0]
            sums = [np.r_[(1 / (1 + np.exp(-z[m]))) @ cells[m], (1 / (1 + np.exp(-z[m]))).sum(), np.logaddexp(0, z[m]).sum(), m.sum()] for m in (keep, pos)]
            trainer.move(sums[0][None], sums[1][None], toxicity.ROUNDS)
        rows = np.array([[b in own[i] for b in chosen] for i in texts], float)
        want = want + 1 / (1 + np.exp(-(rows @ trainer.weights[:, 0] + trainer.offsets[0]))) / 3
    got = {r.doc_id: r for r in queries.queries()["op2_toxicity"](spark, path).collect()}
    assert len(chosen) > 5 and got.keys() == texts.keys()
    assert np.allclose([got[i].score for i in texts], want, atol=0.02)
    assert all(r.held_out == held(i) and r.predicted == (r.score >= 0.5) for i, r in got.items())


def test_language_learns_from_the_end_of_long_texts(spark):
    head = "eins zwei drei vier " * 3_000
    rows = [(i, head + "quixotic zephyr vocabulary " * 40, "aa") for i in range(4)] + [(9, "kurz", "aa")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"zephyr" in model.dictionaries["aa"] and b"drei" in model.dictionaries["aa"] and b"kurz" in model.dictionaries["aa"]
