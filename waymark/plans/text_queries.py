"""Queries on token measures, generated descriptions and their evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import refine, stats, textgen, textmetrics
from waymark.operators import relations as rel
from waymark.plans import base
from waymark.plans.relation_queries import _kept
from waymark.sources import tables

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
_COUNTS = f"""c AS (SELECT lang, t, count(*) AS c FROM (SELECT lang, unnest({_WORDS}) AS t FROM documents) GROUP BY ALL)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents")


@query(f"""WITH {_COUNTS}, s AS (SELECT lang, sum(c)::BIGINT AS tokens, count(*) AS types, -sum(c / n * log2(c / n)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY lang)::DOUBLE AS n FROM c) GROUP BY lang)
  SELECT lang, tokens, types, round(types / tokens, 6) AS ttr, round(h, 6) AS entropy, round(h / log2(types), 6) AS entropy_norm, round(pow(2, h), 3) AS perplexity FROM s""")
def token_diversity(spark, sf):
    """X17, X19, X20."""
    found = textmetrics.diversity(_docs(spark, sf), textmetrics.words(F.col("text")), "lang")
    return found.select("lang", "tokens", "types", *(F.round(c, d).alias(c) for c, d in (("ttr", 6), ("entropy", 6), ("entropy_norm", 6), ("perplexity", 3))))


@query(f"""WITH w AS (SELECT lang, {_WORDS} AS w FROM documents), g AS (SELECT lang, unnest([w[i] || chr(1) || w[i + 1] for i in range(1, len(w))]) AS g FROM w)
  SELECT lang, count(DISTINCT g) AS different, count(*) AS total, round(count(DISTINCT g) / count(*), 6) AS distinct_2 FROM g GROUP BY lang""")
def distinct_bigrams(spark, sf):
    """X21."""
    found = textmetrics.distinct_n(_docs(spark, sf), textmetrics.words(F.col("text")), 2, "lang")
    return found.withColumn("distinct_2", F.round("distinct_2", 6))


_CHARS = "list_filter(string_split(regexp_replace(text, '\\s', '', 'g'), ''), lambda x: x <> '')"


@query(f"""SELECT lang, count(*) AS n, round(avg(len({_CHARS})), 6) AS mean_chars, round(median(len({_CHARS}))::DOUBLE, 6) AS median_chars, round(avg(len({_WORDS})), 6) AS mean_words,
  round(median(len({_WORDS}))::DOUBLE, 6) AS median_words, round((quantile_cont(len({_WORDS}), 0.75) - quantile_cont(len({_WORDS}), 0.25))::DOUBLE, 6) AS iqr_words,
  round(stddev_pop(len({_WORDS})), 6) AS sd_words FROM documents GROUP BY lang""")
def language_table(spark, sf):
    """X18, X23."""
    rows = _docs(spark, sf).select("lang", textmetrics.visible_length(F.col("text")).alias("c"), F.size(textmetrics.words(F.col("text"))).alias("w"))
    made = {
        "mean_chars": F.avg("c"), "median_chars": F.median("c"), "mean_words": F.avg("w"), "median_words": F.median("w"),
        "iqr_words": F.percentile("w", 0.75) - F.percentile("w", 0.25), "sd_words": F.stddev_pop("w"),
    }
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *(F.round(c, 6).alias(k) for k, c in made.items()))


_MASKED = "replace(text, source, '某')"


@query(f"""WITH m AS (SELECT 'raw' AS kind, text FROM documents UNION ALL SELECT 'masked', replace(text, 'the', '某') FROM documents),
  w AS (SELECT kind, {_WORDS} AS w FROM m), l AS (SELECT kind, round(avg(len(w)), 6) AS mean, round(median(len(w))::DOUBLE, 6) AS median, round(stddev_pop(len(w)), 6) AS sd FROM w GROUP BY 1),
  t AS (SELECT kind, count(*) AS tokens, count(DISTINCT t) AS types FROM (SELECT kind, unnest(w) AS t FROM w) GROUP BY 1)
  SELECT kind, mean, median, sd, round(types / tokens, 6) AS ttr FROM l JOIN t USING (kind)""")
def masked_statistics(spark, sf):
    """A name masked in all texts."""
    docs = _docs(spark, sf).select("text")
    rows = docs.withColumn("kind", F.lit("raw")).union(docs.select(textmetrics.masked(F.col("text"), F.lit("the")), F.lit("masked")))
    words = textmetrics.words(F.col("text"))
    sizes = rows.groupBy("kind").agg(F.round(F.avg(F.size(words)), 6).alias("mean"), F.round(F.median(F.size(words)), 6).alias("median"), F.round(F.stddev_pop(F.size(words)), 6).alias("sd"))
    return sizes.join(textmetrics.diversity(rows, words, "kind").select("kind", F.round("ttr", 6).alias("ttr")), "kind")


_TURNS = f"""pairs AS (SELECT a.conv_id * 1000 + a.turn AS key, {_WORDS.replace("text", "b.text")} AS hyp, {_WORDS.replace("text", "a.text")} AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = tables.table(spark, sf, "conversations")
    a = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), textmetrics.words(F.col("text")).alias("ref"))
    b = turns.filter("role = 'assistant'").select("conv_id", "turn", textmetrics.words(F.col("text")).alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("key"), "hyp", "ref")


def _grams(side: str, source: str = "pairs") -> str:
    parts = " UNION ALL ".join(
        f"SELECT key, {n} AS n, unnest([array_to_string({side}[i:i + {n - 1}], chr(1)) for i in range(1, len({side}) - {n - 2})]) AS g FROM {source}" for n in (1, 2, 3, 4)
    )
    return f"SELECT key, n, g, count(*) AS c FROM ({parts}) GROUP BY ALL"


_BLEU = """s AS (SELECT key, count(*) FILTER (k > 0) AS orders, sum(ln(k / t)) FILTER (k > 0) / 4 AS lp FROM o GROUP BY key)
  SELECT l.key, round(CASE WHEN coalesce(orders, 0) = 4 THEN (CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / c) END) * exp(lp) ELSE 0 END, 6) AS bleu FROM l LEFT JOIN s ON l.key = s.key"""


@query(f"""WITH {_TURNS}, h AS ({_grams("hyp")}), r AS ({_grams("ref")}), l AS (SELECT key, len(hyp)::DOUBLE AS c, len(ref)::DOUBLE AS r FROM pairs),
  o AS (SELECT h.key, h.n, sum(least(h.c, coalesce(r.c, 0)))::DOUBLE AS k, sum(h.c)::DOUBLE AS t FROM h LEFT JOIN r ON h.key = r.key AND h.n = r.n AND h.g = r.g GROUP BY ALL), {_BLEU}""")
def sentence_bleu(spark, sf):
    """X26."""
    return textmetrics.sentence_bleu(_pairs(spark, sf)).select("key", F.round("bleu", 6).alias("bleu"))


@query(f"""WITH texts AS (SELECT doc_id AS key, {_WORDS} AS w FROM documents ORDER BY doc_id LIMIT 70), hyps AS (SELECT * FROM texts ORDER BY key LIMIT 50), refs AS (SELECT * FROM texts ORDER BY key OFFSET 50),
  h AS ({_grams("w", "hyps")}), q AS (SELECT n, g, max(c) AS c FROM ({_grams("w", "refs")}) GROUP BY ALL),
  l AS (SELECT key, len(w)::DOUBLE AS c, (SELECT arg_min(len(x.w), (abs(len(x.w) - len(hyps.w)), len(x.w))) FROM refs x)::DOUBLE AS r FROM hyps),
  o AS (SELECT h.key, h.n, sum(least(h.c, coalesce(q.c, 0)))::DOUBLE AS k, sum(h.c)::DOUBLE AS t FROM h LEFT JOIN q ON h.n = q.n AND h.g = q.g GROUP BY ALL), {_BLEU}""")
def self_bleu(spark, sf):
    """With an order that SQL can follow."""
    texts = _docs(spark, sf).select(F.col("doc_id").alias("key"), textmetrics.words(F.col("text")).alias("tokens"))
    return textmetrics.self_bleu(texts, 50, 20, order=[F.col("key")]).select("key", F.round("bleu", 6).alias("bleu"))


def self_bleu_sample(spark, sf):
    """The whole measure, 500 hypotheses by 200 references of a seeded sample; tested against brute force."""
    texts = _docs(spark, sf).select(F.col("doc_id").alias("key"), textmetrics.words(F.col("text")).alias("tokens"))
    return textmetrics.self_bleu(texts)


QUERIES["self_bleu_sample"] = (self_bleu_sample, None)


@query(f"""WITH RECURSIVE {_TURNS}, lcs(key, i, hyp, ref, best) AS (SELECT key, 0, hyp, ref, list_transform(ref, lambda t: 0) FROM pairs
  UNION ALL SELECT key, i + 1, hyp, ref, list_transform(range(1, len(ref) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m:
    greatest(best[m], CASE WHEN ref[m] = hyp[i + 1] THEN 1 + CASE WHEN m > 1 THEN best[m - 1] ELSE 0 END ELSE 0 END)))) FROM lcs WHERE i < len(hyp)),
  m AS (SELECT key, len(hyp) AS c, len(ref) AS r, coalesce(best[-1], 0)::DOUBLE AS l FROM lcs WHERE i = len(hyp)),
  p AS (SELECT key, CASE WHEN c > 0 THEN l / c ELSE 0.0 END AS precision, CASE WHEN r > 0 THEN l / r ELSE 0.0 END AS recall FROM m)
  SELECT key, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1 FROM p""")
def rouge_l(spark, sf):
    """By longest common subsequences."""
    found = textmetrics.rouge_l(_pairs(spark, sf))
    return found.select("key", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT name, regexp_matches(name, '[一-鿿]') AS has_cjk FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name || '国' ELSE n_name END AS name FROM nation)""")
def cjk_detection(spark, sf):
    """X14."""
    name = F.expr("if(n_nationkey % 2 = 0, concat(n_name, '国'), n_name)").alias("name")
    return tables.table(spark, sf, "nation").select(name).withColumn("has_cjk", textmetrics.has_cjk(F.col("name")))


# Descriptions with a roll that SQL can follow.
_MOD, _SALT = 9973, 12347


def _roll_of(variant: Column) -> textgen.Roll:
    return lambda salt: F.pmod(F.col("landmark_id") * 7919 + F.col("target_id") * 104729 + variant * 31 + salt * _SALT, F.lit(_MOD)) / float(_MOD)


def _u(salt: int) -> str:
    return f"(((landmark_id * 7919 + target_id * 104729 + variant * 31 + {salt * _SALT}) % {_MOD}) / {_MOD}e0)"


def _pick(pool, salt: int) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"'{p}'" for p in pool) + f"][floor({_u(salt)} * {len(pool)})::INT + 1]"


def _pick_of(pools, salt: int) -> str:  # noqa: ANN001
    return "CASE dist_level " + " ".join(f"WHEN '{k}' THEN {_pick(v, salt)}" for k, v in pools.items()) + f" ELSE {_pick(pools['Close'], salt)} END"


def _weighted(weights, salt: int) -> str:  # noqa: ANN001
    total, out = 0.0, "CASE"
    for name, w in weights:
        total += w
        out += f" WHEN {_u(salt)} <= {round(total, 9)} THEN '{name}'"
    return out + f" ELSE '{weights[-1][0]}' END"


_ROOT = "CASE direction_8 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in textgen.ROOTS.items()) + " END"
_BLURRED = "coalesce(ambiguity_level, '') <> 'EXACT'"
_DIR = f"""CASE WHEN root IS NULL THEN '{textgen.NEARBY}' WHEN dg = 'functional' AND coalesce(trim(road_name), '') <> '' THEN trim(road_name) || {_pick(textgen.SUFFIXES, 4)}
  WHEN dg = 'precise' THEN CASE WHEN deviation <= 3 THEN '正' || root ELSE root || '偏' END
  WHEN {_BLURRED} THEN CASE WHEN {_u(2)} < 0.3 OR {_u(2)} < 0.8 THEN adv || '偏' || root ELSE adv || root END WHEN adv = '' THEN root
  ELSE adv || root || CASE WHEN {_u(2)} < 0.3 THEN {_pick(textgen.SIDES, 3)} ELSE '' END END"""
_ADV = f"""CASE WHEN {_BLURRED} THEN CASE WHEN ambiguity_level = 'MODERATE' THEN {_pick(textgen.ADVERBS["MODERATE"], 1)} ELSE {_pick(textgen.ADVERBS["SLIGHT"], 1)} END
  ELSE {_pick(textgen.ADVERBS["EXACT"], 1)} END"""
_ULTRA = f"(CASE WHEN {_u(12)} < 0.5 THEN {_pick(textgen.PARTICLES, 13)} ELSE '' END || {_pick_of(textgen.ULTRA, 11)})"
_MIN = f"(CASE WHEN distance > 3000 OR {_u(14)} >= 0.5 THEN distance / 400 ELSE distance / 80 END)"
_MODE = f"(CASE WHEN distance > 3000 OR {_u(14)} >= 0.5 THEN '开车' ELSE '步行' END)"
_PRECISE = """CASE WHEN distance = 0 THEN '0米（就在此处）' WHEN distance >= 1000 THEN '约' || CASE WHEN round_even(distance / 1000, 1) = floor(round_even(distance / 1000, 1))
  THEN floor(round_even(distance / 1000, 1))::INT::VARCHAR ELSE printf('%.1f', round_even(distance / 1000, 1)) END || '公里' ELSE '约' || greatest(10, (round_even(distance / 10, 0) * 10)::INT) || '米' END"""
_DIST = f"""CASE tg WHEN 'precise' THEN {_PRECISE} WHEN 'functional' THEN CASE WHEN distance = 0 THEN '就在此处' WHEN {_MIN} < 1 THEN {_MODE} || '不到1分钟' WHEN round_even({_MIN}, 0) > 60 THEN {_ULTRA}
  ELSE {_MODE} || {_pick(textgen.ABOUT, 15)} || round_even({_MIN}, 0)::INT || '分钟' END WHEN 'ultra_vague' THEN {_ULTRA} ELSE {_pick_of(textgen.VAGUE, 11)} END"""
_FAMILIES = ", ".join(f"('{k}', [{', '.join(f"'{t}'" for t in v)}])" for k, v in textgen.DEFAULT_TEMPLATES.items())
_DESCRIBED = f"""{base.RELATIONS}, families(family, templates) AS (VALUES {_FAMILIES}),
  named AS (SELECT k.*, l.name AS landmark_name, t.name AS target_name, t.type_3 AS target_type_3 FROM kept k JOIN pois l ON l.id = k.landmark_id JOIN pois t ON t.id = k.target_id),
  looked AS (SELECT n.*, coalesce(a.family, b.family, c.family, 'FALLBACK_GENERIC') AS family FROM named n LEFT JOIN families a ON a.family = template_key
    LEFT JOIN families b ON b.family = array_to_string(string_split(template_key, '_')[1:2], '_') LEFT JOIN families c ON c.family = string_split(template_key, '_')[1]),
  varied AS (SELECT *, unnest([1, 2]) AS variant FROM looked),
  rolled AS (SELECT *, {_ROOT} AS root, {_ADV} AS adv, CASE WHEN {_BLURRED} THEN {_weighted(textgen.DIRECTION_WEIGHTS[True], 0)} ELSE {_weighted(textgen.DIRECTION_WEIGHTS[False], 0)} END AS dg,
    {_weighted(textgen.DISTANCE_WEIGHTS, 10)} AS tg FROM varied),
  phrased AS (SELECT r.*, {_DIR} AS dir_text, {_DIST} AS dist_text, f.templates[floor({_u(20)} * len(f.templates))::INT + 1] AS template FROM rolled r JOIN families f USING (family)),
  described AS (SELECT *, replace(replace(replace(replace(replace(replace(template, '{{landmark}}', landmark_name), '{{target}}', target_name), '{{target_type}}', target_type_3), '{{road}}', coalesce(road_name, '路')),
    '{{dir_text}}', dir_text), '{{dist_text}}', dist_text) AS description_raw FROM phrased)"""


def _described(spark: SparkSession, sf: str) -> DataFrame:
    rows = rel.with_attributes(_kept(spark, sf), tables.pois(spark, sf))
    return textgen.descriptions(rows, 2, roll_of=_roll_of)


@query(f"{_DESCRIBED} SELECT landmark_id, target_id, variant, family, dir_text, dist_text, description_raw FROM described")
def descriptions(spark, sf):
    """J23, X1-X4, X6, X7."""
    return _described(spark, sf).select("landmark_id", "target_id", "variant", "family", "dir_text", "dist_text", "description_raw")


def _hashed(variant: Column) -> textgen.Roll:
    return lambda salt: F.conv(F.substring(F.md5(F.concat_ws("-", "landmark_id", "target_id", variant, F.lit(salt))), 1, 6), 16, 10).cast("double") / float(1 << 24)


_HASHED = re.sub(
    r"\(\(\(landmark_id \* 7919 \+ target_id \* 104729 \+ variant \* 31 \+ (\d+)\) % 9973\) / 9973e0\)",
    lambda m: f"(('0x' || substr(md5(landmark_id || '-' || target_id || '-' || variant || '-{int(m[1]) // _SALT}'), 1, 6))::BIGINT / {1 << 24}e0)", _DESCRIBED,
)


@query(f"{_HASHED} SELECT landmark_id, target_id, variant, description_raw FROM described")
def descriptions_hash_choice(spark, sf):
    """The same with rolls by a hash, one that SQL has."""
    rows = rel.with_attributes(_kept(spark, sf), tables.pois(spark, sf))
    return textgen.descriptions(rows, 2, roll_of=_hashed).select("landmark_id", "target_id", "variant", "description_raw")


_READ_DIR = "CASE " + " ".join(f"WHEN contains(description_raw, '{w}') THEN '{c}'" for w, c in textgen.DIRECTION_WORDS) + " END"
_READ_TOPO = "CASE " + " ".join(f"WHEN contains(description_raw, '{w}') THEN '{c}'" for w, c in textgen.TOPOLOGY_WORDS) + " END"
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)\s*(千米|公里|km|KM|米|m|M)"
_READ_DIST = f"""(TRY_CAST(regexp_extract(description_raw, '{_NUMBER}', 1) AS DOUBLE) * CASE WHEN regexp_extract(description_raw, '{_NUMBER}', 2) IN ('千米', '公里', 'km', 'KM') THEN 1000 ELSE 1 END)"""
_CODES = dict(zip(geo.DIRECTIONS_8, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"), strict=True))
_CODE = "CASE direction_8 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items()) + " END"


@query(f"""{_DESCRIBED}, r AS (SELECT *, {_READ_DIR} AS dir, {_READ_DIST} AS m, {_READ_TOPO} AS topo, {_CODE} AS code FROM described)
  SELECT count(*) AS n, count(*) FILTER (dir IS NOT NULL AND code IS NOT NULL) AS direction_n, round(avg((dir = code)::INT) FILTER (dir IS NOT NULL AND code IS NOT NULL), 6) AS direction_rate,
  count(*) FILTER (m IS NOT NULL AND distance > 0) AS distance_n, round(avg((abs(m - distance) / distance <= 0.15)::INT) FILTER (m IS NOT NULL AND distance > 0), 6) AS distance_rate,
  count(*) FILTER (topo IS NOT NULL) AS topology_n, round(avg((topo = topology)::INT) FILTER (topo IS NOT NULL), 6) AS topology_rate FROM r""")
def description_consistency(spark, sf):
    """What texts tell against what is stored."""
    text, d = F.col("description_raw"), F.col("distance")
    code = F.element_at(F.create_map(*(F.lit(x) for kv in _CODES.items() for x in kv)), F.col("direction_8"))
    rows = _described(spark, sf).withColumns({"dir": textgen.first_word(text, textgen.DIRECTION_WORDS), "m": textgen.parsed_distance(text), "topo": textgen.first_word(text, textgen.TOPOLOGY_WORDS), "code": code})
    rate = lambda ok, known: F.round(F.avg(F.when(known, ok.cast("int"))), 6)
    both, far = F.col("dir").isNotNull() & F.col("code").isNotNull(), F.col("m").isNotNull() & (d > 0)
    return rows.agg(
        F.count("*").alias("n"), F.count_if(both).alias("direction_n"), rate(F.col("dir") == F.col("code"), both).alias("direction_rate"),
        F.count_if(far).alias("distance_n"), rate(F.abs(F.col("m") - d) / F.when(d > 0, d) <= 0.15, far).alias("distance_rate"),
        F.count_if(F.col("topo").isNotNull()).alias("topology_n"), rate(F.col("topo") == F.col("topology"), F.col("topo").isNotNull()).alias("topology_rate"),
    )


_GEO = """g AS (SELECT id, 116 + x / 100000 AS lon, 39.5 + y / 100000 AS lat, x, y FROM pois)"""
_ANGLE = "radians(list_position([" + ", ".join(f"'{d}'" for d in geo.DIRECTIONS_8) + "], direction_8) * 45.0 - 45)"


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    half = lambda a, b: f"sin((radians({b}) - radians({a})) / 2)"
    return f"(2 * 6371000 * asin(sqrt(least(1.0, {half(lat1, lat2)} * {half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)} * {half(lon1, lon2)}))))"


@query(f"""{base.RELATIONS}, {_GEO}, p AS (SELECT k.target_id, t.lon AS tlon, t.lat AS tlat, l.lon + distance * sin({_ANGLE}) / (111320 * cos(radians(l.lat))) AS lon,
    l.lat + distance * cos({_ANGLE}) / 111320 AS lat FROM kept k JOIN g l ON l.id = k.landmark_id JOIN g t ON t.id = k.target_id WHERE direction_8 IS NOT NULL),
  e AS (SELECT *, {_hav("lon", "lat", "tlon", "tlat")} AS err FROM p), c AS (SELECT target_id, avg(lon) AS clon, avg(lat) AS clat, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 2),
  r AS (SELECT target_id, avg({_hav("lon", "lat", "clon", "clat")}) AS radius FROM e JOIN c USING (target_id) GROUP BY 1)
  SELECT (SELECT count(*) FROM e) AS n, (SELECT round(median(err), 4) FROM e) AS median_m, (SELECT round(quantile_cont(err, 0.9), 4) FROM e) AS p90_m, (SELECT round(avg(radius), 4) FROM r) AS radius_m,
  (SELECT count(*) FROM r) AS groups""")
def inverse_geocoding(spark, sf):
    """Places told by direction and distance against true ones, and how several tellings converge."""
    pois = tables.pois(spark, sf).select("id", (116 + F.col("x") / 100000).alias("lon"), (39.5 + F.col("y") / 100000).alias("lat"))
    kept = _kept(spark, sf).filter("direction_8 is not null")
    kept = kept.join(pois.selectExpr("id landmark_id", "lon llon", "lat llat"), "landmark_id").join(pois.selectExpr("id target_id", "lon tlon", "lat tlat"), "target_id")
    lon, lat = geo.moved(F.col("llon"), F.col("llat"), F.col("direction_8"), F.col("distance"))
    told = kept.select("target_id", "tlon", "tlat", lon.alias("lon"), lat.alias("lat"))
    told = told.withColumn("err", geo.haversine(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat")))
    centres = told.groupBy("target_id").agg(F.avg("lon").alias("clon"), F.avg("lat").alias("clat"), F.count("*").alias("n")).filter("n >= 2")
    off = geo.haversine(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))
    radii = told.join(centres, "target_id").groupBy("target_id").agg(F.avg(off).alias("radius"))
    a = told.agg(F.count("*").alias("n"), F.round(F.median("err"), 4).alias("median_m"), F.round(F.percentile("err", 0.9), 4).alias("p90_m"))
    return stats.beside(a, radii.agg(F.round(F.avg("radius"), 4).alias("radius_m"), F.count("*").alias("groups")))


@query(f"""{_DESCRIBED} SELECT count(*) AS n, count(DISTINCT landmark_id) AS landmarks, round(100.0 * avg((description_raw IS NULL)::INT), 6) AS null_percent,
  round(100.0 * avg((length(description_raw) < 25)::INT), 6) AS short_percent, round(100.0 * avg((length(description_raw) > 60)::INT), 6) AS long_percent,
  round(100.0 * avg((rx BETWEEN 0 AND 2500 AND ry BETWEEN 0 AND 2500)::INT), 6) AS inside_percent, min(rx) AS min_x, max(rx) AS max_x, min(ry) AS min_y, max(ry) AS max_y FROM described""")
def dataset_report(spark, sf):
    """A31, A32."""
    share = lambda c: F.round(100.0 * F.avg(c.cast("int")), 6)
    size = F.length("description_raw")
    return _described(spark, sf).agg(
        F.count("*").alias("n"), F.count_distinct("landmark_id").alias("landmarks"), share(F.col("description_raw").isNull()).alias("null_percent"),
        share(size < 25).alias("short_percent"), share(size > 60).alias("long_percent"), share(geo.in_box(F.col("rx"), F.col("ry"), 0, 2500, 0, 2500)).alias("inside_percent"),
        F.min("rx").alias("min_x"), F.max("rx").alias("max_x"), F.min("ry").alias("min_y"), F.max("ry").alias("max_y"),
    )


_TEXT = "description_raw || '  在路边在' || coalesce(road_name, '') || coalesce(road_name, '')"
_ONCE = f"""CASE WHEN length(coalesce(road_name, '')) > 1 AND contains(t, road_name) THEN substr(t, 1, strpos(t, road_name) + length(road_name) - 1)
  || replace(substr(t, strpos(t, road_name) + length(road_name)), road_name, '马路') ELSE t END"""


@query(f"""{_DESCRIBED}, x AS (SELECT *, {_TEXT} AS t FROM described), c AS (SELECT *, trim(regexp_replace(regexp_replace({_ONCE}, '在(.*?)在', '在\\1，', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM x)
  SELECT landmark_id, target_id, variant, cleaned, coalesce(contains(template_key, 'Intersection') OR ambiguity_level = 'MODERATE' OR (dist_level = 'Far' AND distance > 800)
    OR (length(cleaned) > 40 AND length(cleaned) - length(translate(cleaned, '，。；', '')) >= 2), false) AS needs FROM c""")
def redundancy_and_triggers(spark, sf):
    """X8, X9."""
    text = F.concat("description_raw", F.lit("  在路边在"), F.coalesce("road_name", F.lit("")), F.coalesce("road_name", F.lit("")))
    rows = _described(spark, sf).withColumn("cleaned", textgen.without_redundancy(text, F.col("road_name")))
    needs = textgen.needs_refining(F.col("template_key"), F.col("ambiguity_level"), F.col("dist_level"), F.col("distance"), F.col("cleaned"))
    return rows.select("landmark_id", "target_id", "variant", "cleaned", needs.alias("needs"))


def _service(texts):  # noqa: ANN001, ANN202
    """A stand-in service whose answers tell nothing of batches: it drops directions from half of the texts, ends others
    with a mark, returns one answer too few for batches that hold some texts, and fails for others."""
    import hashlib

    kinds = [hashlib.md5(t.encode()).hexdigest()[0] for t in texts]
    if "f" in kinds:
        raise ValueError("no answer")
    out = [t.translate({ord(c): None for c in "东南西北"}) if k in "01234567" else f"{t}。" for t, k in zip(texts, kinds, strict=True)]
    return out[1:] if "e" in kinds and len(out) > 1 else out


_KIND = "substr(md5(description_raw), 1, 1)"
_CARDINAL = "CASE direction_8 " + " ".join(f"WHEN '{n}' THEN '{textgen.ROOTS[n]}'" for n in ("North", "South", "East", "West")) + " END"


@query(f"""{_DESCRIBED}, x AS (SELECT *, coalesce(contains(template_key, 'Intersection') OR ambiguity_level = 'MODERATE' OR (dist_level = 'Far' AND distance > 800)
    OR (length(description_raw) > 40 AND length(description_raw) - length(translate(description_raw, '，。；', '')) >= 2), false) AS needs FROM described),
  y AS (SELECT *, CASE WHEN NOT needs OR {_KIND} = 'f' THEN description_raw WHEN {_KIND} < '8' THEN translate(description_raw, '东南西北', '') ELSE description_raw || '。' END AS answer,
    {_CARDINAL} AS cardinal FROM x)
  SELECT landmark_id, target_id, variant, CASE WHEN coalesce(direction_8, '') <> '' AND NOT contains(answer, '方向') AND ((regexp_matches(description_raw, '[东南西北]') AND NOT regexp_matches(answer, '[东南西北]'))
    OR (cardinal IS NOT NULL AND NOT contains(answer, cardinal) AND NOT contains(answer, '那边'))) THEN description_raw ELSE answer END AS description FROM y""")
def refined_descriptions(spark, sf):
    """Through a stand-in service that fails, miscounts and drops directions, checked afterwards."""
    rows = _described(spark, sf)
    needs = textgen.needs_refining(F.col("template_key"), F.col("ambiguity_level"), F.col("dist_level"), F.col("distance"), F.col("description_raw"))
    rows = rows.select("landmark_id", "target_id", "variant", "direction_8", "description_raw", needs.alias("needs"))
    rows = refine.refined(rows, "description_raw", "answer", client=_service, when="needs")
    ok = textgen.keeps_direction(F.col("description_raw"), F.col("answer"), F.col("direction_8"))
    return rows.select("landmark_id", "target_id", "variant", F.when(ok, F.col("answer")).otherwise(F.col("description_raw")).alias("description"))


@query("""SELECT c_custkey AS k, CASE WHEN substr(md5(c_name), 1, 1) = 'f' THEN NULL WHEN substr(md5(c_name), 1, 1) < '8' THEN translate(c_name, '东南西北', '') ELSE c_name || '。' END AS translated FROM customer""")
def translated_names(spark, sf):
    """Batches of 20, one by one where a batch fails or is miscounted, null where a single text fails."""
    rows = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return refine.refined(rows, "c_name", "translated", client=_service, size=20, fallback=False).drop("c_name")


_ODD_TEMPLATES = ("往东走到{target}", "{landmark}{odd}", "{landmark}前面就是{target}", "{landmark}左转{dist_text}", "{Landmark}{dir_text}", "{landmark}{下方}", "{landmark}往{dir_text}")


@query(f"""WITH t(family, template) AS (SELECT family, unnest(templates) FROM (VALUES {_FAMILIES}) f(family, templates) UNION ALL VALUES {", ".join(f"('X', '{t}')" for t in _ODD_TEMPLATES)}),
  u AS (SELECT *, regexp_extract_all(template, '\\{{(\\w+)\\}}', 1) AS slots, regexp_matches(regexp_replace(template, '\\{{[^}}]*\\}}', '', 'g'), '[东南西北左右前后上下]') AS hard FROM t)
  SELECT family, template, len(list_distinct(slots)) AS slots, contains(template, '{{landmark}}') AND NOT hard AND len(list_filter(slots, lambda s: s NOT IN ('landmark', 'target', 'road', 'dir_text', 'dist_text'))) = 0 AS good,
  contains(template, '{{landmark}}') AND NOT hard AS good_unlisted FROM u""")
def template_quality(spark, sf):
    """X16, U4, SRC14: with a list of valid slots, and without."""
    from waymark.sources import lexicons

    rows = lexicons.template_table(spark, {**textgen.DEFAULT_TEMPLATES, "X": _ODD_TEMPLATES}).drop("idx")
    t = F.col("template")
    good = [textgen.good_template(t, valid, ["landmark"]).alias(name) for name, valid in (("good", ["landmark", "target", "road", "dir_text", "dist_text"]), ("good_unlisted", []))]
    return rows.select("family", "template", F.size(textgen.placeholders(t)).alias("slots"), *good)


@query(f"""WITH made(template) AS (VALUES {", ".join(f"('{t}')" for t in (*_ODD_TEMPLATES, *textgen.DEFAULT_TEMPLATES["SCENE-C"]))}),
  held AS (SELECT 'SCENE-C' AS family, template FROM (VALUES {", ".join(f"('{t}')" for t in textgen.DEFAULT_TEMPLATES["SCENE-C"])}) h(template))
  SELECT * FROM held UNION ALL SELECT 'SCENE-C', template FROM made WHERE contains(template, '{{landmark}}') AND NOT regexp_matches(regexp_replace(template, '\\{{[^}}]*\\}}', '', 'g'), '[东南西北左右前后上下]')
  AND len(list_filter(regexp_extract_all(template, '\\{{(\\w+)\\}}', 1), lambda s: s NOT IN ('landmark', 'target', 'dir_text', 'dist_text'))) = 0 AND template NOT IN (SELECT template FROM held)""")
def merged_templates(spark, sf):
    """Good new templates join their family."""
    from waymark.sources import lexicons

    of = lambda templates: lexicons.template_table(spark, {"SCENE-C": templates}).drop("idx")
    held = textgen.DEFAULT_TEMPLATES["SCENE-C"]
    return textgen.merged_templates(of(held), of((*_ODD_TEMPLATES, *held)), ["landmark", "target", "dir_text", "dist_text"], ["landmark"])


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN ['a' || n_nationkey, 'b'] ELSE ['first ' || n_nationkey, 'second'] END AS texts FROM nation""")
def answer_extraction(spark, sf):
    """X12."""
    answer = F.expr("""if(n_nationkey % 2 = 0, concat('Sure:\n```json\n["a', n_nationkey, '", "b"]\n``` done'), concat('1. first ', n_nationkey, '\n\n- second'))""")
    return tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), textgen.json_texts(answer).alias("texts"))
