"""Queries through sources, sinks and lists: what is written is read back from the shared folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.staging import shared_dir
from waymark.sources import lexicons, readers, sinks, tables
from waymark.streaming import pending

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}"


@query("""SELECT p_partkey, concat('a "b", ', p_name, chr(10), p_type) AS text, p_retailprice, true AS has_file FROM part""")
def csv_files(spark, sf):
    """SNK1, SRC6: delimited text with quotes and line breaks, read back with the file that each row is from."""
    rows = tables.table(spark, sf, "part").select("p_partkey", F.concat(F.lit('a "b", '), "p_name", F.lit("\n"), "p_type").alias("text"), "p_retailprice")
    path = _folder(spark, "csv")
    sinks.csv(rows, path)
    held = readers.csv(spark, path, "p_partkey long, text string, p_retailprice double", lineage=True)
    return held.withColumn("has_file", F.endswith("source_file", F.lit(".csv"))).drop("source_file")


def _pages(code: str, page: int) -> Sequence[str]:
    """A source of 60 rows a code, 25 a page; code 000007 fails from its second page on."""
    if code == "000007" and page > 1:
        raise OSError("down")
    return [json.dumps({"id": f"{code}-{k}", "location": f"{k},{page}"}) for k in range(25 * (page - 1), min(60, 25 * page))]


@query("""SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS code, CASE WHEN n_nationkey = 7 THEN 25 ELSE 60 END AS n, CASE WHEN n_nationkey = 7 THEN 24.0 ELSE 59.0 END AS most,
  CASE WHEN n_nationkey = 7 THEN 'page 2 and after: OSError down' END AS error FROM nation""")
def paged_rows(spark, sf):
    """SRC1, SRC2: a paged source, a code in each task; what keeps failing is told."""
    codes = [r.n_nationkey for r in tables.table(spark, sf, "nation").select("n_nationkey").collect()]  # a list of codes is configuration
    spark.dataSource.register(readers.paged_source(_pages, codes, "waymark_query_pages", wait=0.0))
    rows = spark.read.format("waymark_query_pages").load()
    at = F.get_json_object("json", "$.location")
    return rows.groupBy("code").agg(F.count("json").alias("n"), F.max(F.split(at, ",")[0].cast("double")).alias("most"), F.max("error").alias("error"))


@query("""SELECT o_orderkey, concat(o_orderstatus, '!') AS done FROM orders""")
def pending_stream(spark, sf):
    """SRC10: the queue of pending rows as a stream; files that bring rows again don't bring them twice."""
    rows = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    source, sink, log = (_folder(spark, name) for name in ("queue", "finished", "log"))
    rows.write.mode("append").parquet(source)
    work = lambda df: df.select("o_orderkey", F.concat("o_orderstatus", F.lit("!")).alias("done"))
    for again in (False, True):
        if again:
            rows.filter("o_orderkey % 2 = 0").write.mode("append").parquet(source)
        pending.refine_stream(spark, source, rows.schema, sink, log, "o_orderkey", work).awaitTermination()
    return spark.read.parquet(sink)


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderpriority AS part FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderkey % 2 = 0)""")
def replaced_partitions(spark, sf):
    """SNK5, SNK6: a rerun replaces the partitions that it has rows of and leaves the others."""
    rows = tables.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("part"))
    path = _folder(spark, "partitions")
    sinks.replace_partitions(rows, path, "part")
    changed = rows.filter("part like '1%' and o_orderkey % 2 <> 0").withColumn("price", F.col("price") + 1)
    for _ in range(2):
        sinks.replace_partitions(changed, path, "part")
    return spark.read.parquet(path).select("o_orderkey", "price", "part")


@query("""SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation""")
def bundled_tables(spark, sf):
    """SNK3, SNK8: several tables in a folder each."""
    path = _folder(spark, "bundle")
    names = ("region", "nation")
    sinks.bundle({n: tables.table(spark, sf, n) for n in names}, path)
    one, other = (spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names)
    return one.union(other)


@query("""SELECT n_regionkey AS k, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1""")
def json_report(spark, sf):
    """SNK4: a small table as JSON, and back."""
    found = tables.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"), F.max("n_name").alias("last"))
    text = spark.createDataFrame([(sinks.report(found),)], "json string")
    return text.select(F.inline(F.from_json("json", found.schema.simpleString().replace("struct", "array<struct", 1) + ">")))


@query("""SELECT DISTINCT trim(part) AS code FROM (SELECT unnest(string_split(concat(n_nationkey % 7, ' ; ', n_regionkey), ';')) AS part FROM nation)""")
def delete_codes(spark, sf):
    """SRC15: a list of codes by the first of some column names."""
    parts = F.explode(F.split(F.expr("concat(n_nationkey % 7, ' ; ', n_regionkey)"), ";")).alias("NEW_TYPE")
    return lexicons.code_list(tables.table(spark, sf, "nation").select("n_name", parts), ["typecode", "NEW_TYPE"])


_LEXICON = {
    "stopwords": ["Great ", "Old "],
    "suffixes": [{"level_1": ["Shop"], "level_2": ["Corner Shop"]}, {"level_3": ["Shop", "Hall"]}],
    "categories": [{"subcategories": [{"keywords": [{"word": "Palace", "weight": 0.5}]}], "keywords": ["gate", "stairs"], "penalty": "high"}],
    "penalty_levels": {"high": {"factor": 0.2}},
}


@query("""SELECT * FROM (VALUES ('facility', 'gate', 0.2::DOUBLE), ('facility', 'stairs', 0.2), ('noun', 'Palace', 0.5), ('prefix', 'Great ', NULL), ('prefix', 'Old ', NULL), ('suffix', 'Corner Shop', NULL), ('suffix', 'Hall', NULL), ('suffix', 'Shop', NULL)) t(kind, word, weight)""")
def lexicon_lists(spark, sf):
    """SRC13: word lists flattened."""
    rows: list[tuple[str, str, float | None]] = [("prefix", w, None) for w in lexicons.prefixes(_LEXICON)] + [("suffix", w, None) for w in lexicons.suffixes(_LEXICON)]
    rows += [("noun", w, x) for w, x in lexicons.proper_nouns(_LEXICON).items()] + [("facility", w, x) for w, x in lexicons.facilities(_LEXICON)]
    return spark.createDataFrame(rows, "kind string, word string, weight double")


@query("""SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN '110101' WHEN 1 THEN '110102' ELSE '110000' END AS adcode FROM customer""")
def mapped_codes(spark, sf):
    """SRC16: a map of a few codes, with a default."""
    rows: DataFrame = tables.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("D"), F.col("c_nationkey") % 5).alias("district"))
    return lexicons.with_mapped(rows, "district", {"D0": "110101", "D1": "110102"}, "adcode", "110000").drop("district")


@query("""SELECT key, x, y FROM (SELECT concat('L', l_suppkey) AS key, l_extendedprice AS x, l_quantity AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1""")
def landmark_coordinates(spark, sf):
    """SRC17: of rows that repeat a landmark the last counts."""
    rows = tables.table(spark, sf, "lineitem").withColumn("place", F.struct("l_orderkey", "l_linenumber"))
    return readers.coordinates(rows, F.concat(F.lit("L"), F.col("l_suppkey")), "l_extendedprice", "l_quantity", "place")
