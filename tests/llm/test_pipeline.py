"""Each stage on its own input against brute force over the rows that the stage before kept."""

import corpus_pipeline as pipeline
from tests.llm.brute import brute_lines, similar_groups
from tests.llm.test_decontaminate import brute as brute_hits
from waymark.llm import quality, unigram
from waymark.llm.shared import tokenizer_path


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns + ["token_ids"] * (len(held) == len(pipeline.STAGES) - 1)
        held.append({r.doc_id: r for r in docs.collect()})
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts = [{i: r.text for i, r in rows.items()} for rows in held]

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(labels[i], i in held[0]) for i in source if i in labels]
    assert sum(y == p for y, p in judged) >= 0.9 * len(judged)
    assert all(held[0][i] == source[i] for i in held[0])

    assert texts[1] == brute_lines(texts[0])
    groups = similar_groups(texts[1])
    assert texts[2] == {i: t for i, t in texts[1].items() if groups[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_hits(list(texts[2].items()), items) if r[5]}
    assert bad and texts[3] == {i: t for i, t in texts[2].items() if i not in bad}
    assert texts[4] == texts[3]
    model = unigram.UnigramModel.load(tokenizer_path("piece_bpe_32k.model"))
    for i, row in list(held[4].items())[:20]:
        parts, _ = unigram.parts_of([texts[3][i].encode()])
        assert row.token_ids == [x for p in parts.to_pylist() for x in model.segment_one(p)]


def test_odd_rows_pass_every_stage(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, h long"
    line = "some words here and there\nmore words stand in this line\nand a third one"
    rows = [(1, None), (2, ""), (None, None), (3, line), (3, line), (4, line + "\nother"), (5, "x " * 20_000), (6, "word " * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", 1, 2) for i, t in rows], schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() <= frame.count(), name


def test_run_against_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    out = pipeline.run(spark, sf_dir)
    assert out.columns[-1] == "token_ids" and out.filter("size(token_ids) = 0 and text <> ''").count() == 0
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 5"
    model = quality.fit(docs, labels.filter(f"{fold} <> 0"))
    rows = quality.scored(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").withColumnRenamed("id", "doc_id").filter(f"{fold} = 0")
    good = rows.filter("quality = predicted").count() / rows.count()
    assert good > 0.97
