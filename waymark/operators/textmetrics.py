"""Token, diversity and overlap measures of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.stats import with_scalars


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))


def characters(text: Column) -> Column:
    """Characters without white space."""
    return F.filter(F.split(F.regexp_replace(text, r"\s", ""), ""), lambda c: c != "")


def bigrams_of_characters(text: Column) -> Column:
    return ngrams(characters(text), 2)


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", ""))


def ngrams(tokens: Column, n: int) -> Column:
    """Successive groups of ``n`` tokens, joined by a control character that no token has."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), "\x01"))


def all_ngrams(tokens: Column, most: int) -> Column:
    """Structs ``(n, g)`` of all groups of one to ``most`` tokens."""

    def of(n: int) -> Column:
        return F.transform(ngrams(tokens, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))

    return F.concat(*(of(n) for n in range(1, most + 1)))


def masked(text: Column, name: Column, mark: str = "某") -> Column:
    """A text with a place's name replaced by one mark."""
    held = F.trim(F.coalesce(name, F.lit("")))
    return F.when(held != "", F.replace(text, held, F.lit(mark))).otherwise(text)


def has_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]"))


def diversity(df: DataFrame, tokens: Column, group: str) -> DataFrame:
    """By group: tokens, types, their ratio, entropy in bits, normalised entropy, perplexity."""
    counts = df.select(group, F.explode(tokens).alias("t")).groupBy(group, "t").agg(F.count("*").alias("c"))
    totals = counts.groupBy(group).agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    h = F.log2(F.col("tokens").cast("double")) - F.col("s") / F.col("tokens")
    return totals.select(
        group, "tokens", "types", (F.col("types") / F.col("tokens")).alias("ttr"), h.alias("entropy"),
        F.coalesce(F.try_divide(h, F.log2(F.when(F.col("types") > 1, F.col("types").cast("double")))), F.lit(0.0)).alias("entropy_norm"), F.pow(F.lit(2.0), h).alias("perplexity"),
    )


def distinct_n(df: DataFrame, tokens: Column, n: int, group: str) -> DataFrame:
    """By group: the share of different n-grams among all."""
    counts = df.select(group, F.explode(ngrams(tokens, n)).alias("g")).groupBy(group, "g").agg(F.count("*").alias("c"))
    return counts.groupBy(group).agg(F.count("*").alias("different"), F.sum("c").alias("total")).withColumn(f"distinct_{n}", F.col("different") / F.col("total"))


def _overlap(pairs: DataFrame, most: int) -> DataFrame:
    """``pairs(key, hyp, ref)`` of token arrays to clipped and total n-gram counts by key and n."""

    def counted(side: str, out: str) -> DataFrame:
        each = all_ngrams(F.col(side), most)
        return pairs.select("key", F.explode(each).alias("e")).groupBy("key", "e.n", "e.g").agg(F.count("*").alias(out))

    both = counted("hyp", "h").join(counted("ref", "r"), ["key", "n", "g"], "left")
    return both.groupBy("key", "n").agg(F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("clipped"), F.sum("h").alias("total"))


def _scored(grams: DataFrame, lengths: DataFrame, most: int) -> DataFrame:
    """BLEU by key from n-gram counts and ``lengths(key, c, r)``; 0 if any order has no match."""
    log_p = F.sum(F.when(F.col("clipped") > 0, F.log(F.col("clipped") / F.col("total")))) / most
    full = F.count_if(F.col("clipped") > 0) == most
    held = grams.groupBy("key").agg(log_p.alias("log_p"), full.alias("full"))
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    bleu = F.when(F.coalesce("full", F.lit(False)), brevity * F.exp("log_p")).otherwise(0.0)
    return lengths.join(held, "key", "left").select("key", bleu.alias("bleu"))


def sentence_bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """``(key, bleu)`` of ``pairs(key, hyp, ref)``, token arrays."""
    lengths = pairs.select("key", F.size("hyp").alias("c"), F.size("ref").alias("r"))
    return _scored(_overlap(pairs, most), lengths, most)


def self_bleu(texts: DataFrame, hypotheses: int = 500, references: int = 200, most: int = 4, order: list | None = None, seed: int = 42) -> DataFrame:
    """``(key, bleu)`` of sampled ``texts(key, tokens)`` against a pool of other sampled ones: the most frequent use of
    an n-gram in the pool clips it, the closest length (the shorter at a tie) is the reference length.

    The sample is by ``order``, else by a seeded hash; its sizes are the measure's own parameters.
    """
    ordering = order or [F.xxhash64("key", F.lit(seed)), F.col("key")]
    picked = texts.orderBy(*ordering).limit(hypotheses + references)
    from pyspark.sql import Window

    ranked = picked.withColumn("_n", F.row_number().over(Window.orderBy(*ordering)))  # a sample of fixed size
    hyps, refs = ranked.filter(F.col("_n") <= hypotheses), ranked.filter(F.col("_n") > hypotheses)

    def grams(df: DataFrame, out: str) -> DataFrame:
        each = all_ngrams(F.col("tokens"), most)
        return df.select("key", F.explode(each).alias("e")).groupBy("key", "e.n", "e.g").agg(F.count("*").alias(out))

    clip = grams(refs, "r").groupBy("n", "g").agg(F.max("r").alias("r"))
    met = grams(hyps, "h").join(clip, ["n", "g"], "left")
    counted = met.groupBy("key", "n").agg(F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("clipped"), F.sum("h").alias("total"))
    lengths = refs.agg(F.collect_set(F.size("tokens")).alias("sizes"))  # at most as many as references
    own = with_scalars(hyps.select("key", F.size("tokens").alias("c")), lengths)
    closest = F.array_min(F.transform("sizes", lambda s: F.struct(F.abs(s - F.col("c")).alias("off"), s.alias("size"))))["size"]
    return _scored(counted, own.select("key", "c", F.coalesce(closest, F.lit(0)).alias("r")), most)


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a whole row of the table at once as bits of a number."""
    places: dict = {}
    for k, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        met = row & places.get(token, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """``(key, precision, recall, f1)`` of ``pairs(key, hyp, ref)`` by longest common subsequences."""

    @F.pandas_udf("int")
    def lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hyp, ref in batches:
            yield pd.Series([lcs_length(list(a), list(b)) for a, b in zip(hyp, ref, strict=True)], dtype="int32")

    held = pairs.withColumns({"l": lcs("hyp", "ref"), "c": F.size("hyp"), "r": F.size("ref")})
    p, r = F.coalesce(F.try_divide("l", "c"), F.lit(0.0)), F.coalesce(F.try_divide("l", "r"), F.lit(0.0))
    return held.select("key", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
