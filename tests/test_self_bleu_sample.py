"""Self-BLEU of the reference's size, drawn from the whole table."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from waymark.plans import registry


def test_self_bleu_of_500_by_200_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    order = docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(42)).alias("h")).orderBy("h", "doc_id").limit(700).collect()
    tokens = [(r.doc_id, re.findall("[a-z0-9']+", (r.text or "").lower())) for r in order]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hyps, refs = tokens[:500], [w for _, w in tokens[500:]]
    clip = {n: Counter() for n in (1, 2, 3, 4)}
    for n, most in clip.items():
        for w in refs:
            most |= grams(w, n)
    want = {}
    for key, w in hyps:
        parts = [(sum(min(c, clip[n][g]) for g, c in grams(w, n).items()), max(len(w) - n + 1, 0)) for n in (1, 2, 3, 4)]
        near = min((abs(len(r) - len(w)), len(r)) for r in refs)[1]
        short = 1.0 if len(w) >= near else math.exp(1 - near / max(len(w), 1))
        want[key] = short * math.exp(sum(math.log(a / b) for a, b in parts) / 4) if all(a for a, _ in parts) else 0.0
    got = {r.key: r.bleu for r in registry.queries()["self_bleu_sample"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 500 and got.keys() == want.keys() and max(got) > 700
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)
