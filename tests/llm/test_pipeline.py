import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from earshot.llm import common, mixing, packing, queries

rng = np.random.default_rng(3)
VOCABULARY = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(800)]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY, n))


def corpus():
    rows = []
    for i in range(160):
        good = i % 4 > 0
        text = sentence(60) if good else " ".join(["###"] + [str(rng.choice(VOCABULARY))] * 60)
        if i % 16 == 5:
            text += " password = abcdef" + str(i)
        rows.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
    copies = [(200 + i, rows[5][1], "en", "b", rows[5][4]) for i in range(6)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(160)]
    return rows + copies, labels


@pytest.fixture
def tables(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_stages_take_effect_one_after_the_other(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    kept = spark.createDataFrame(stages[0](spark, docs, folder).collect(), docs.schema)
    good = {r[0] for r in rows if r[0] % 4 or r[0] >= 200}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == columns
    single = spark.createDataFrame(stages[1](spark, kept, folder).collect(), docs.schema)
    assert {r.doc_id for r in single.collect()} == {i for i in good if i < 200}
    clean = spark.createDataFrame(stages[2](spark, single, folder).collect(), docs.schema)
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert "password" not in r.text and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or (r.text.endswith("[SECRET]") and before[r.doc_id].startswith(r.text[: -len("[SECRET]")]))
    mix = spark.createDataFrame(stages[3](spark, clean, folder).collect(), docs.schema)
    assert mix.columns == columns
    words = {r.source: r.n for r in mix.groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    targets = {r.source: r.target for r in mixing.mix(clean).collect()}
    assert all(abs(words[s] - t) <= 0.02 * t for s, t in targets.items())
    out = stages[4](spark, mix, folder).collect()
    assert sum(r.length for r in out) == sum(r.length for r in packing.pieces(mix).collect())


def test_run(spark, tables):
    folder, rows = tables
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < fill <= packing.CAPACITY and {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


def test_stages_take_edges(spark, edges, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    wide = edges.withColumns({"score": F.lit(1), "size": F.lit("x"), "spans": F.lit(2.0)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == wide.columns
        assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op3_chat", "op4_topk", "op11_codes", "op12_negatives", "op13_urls"}))
def test_queries_take_edges(spark, edges, tmp_path, name):
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 0, None), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) >= edges.count()
    per_document = {str(r.doc_id) for r in rows}
    assert per_document == {str(r.doc_id) for r in edges.collect()}


def test_queries_of_vectors_and_pages_take_edges(spark, tmp_path):
    nan = float("nan")
    vectors = [(0, [1.0, 0.5, 0.2, 0.1], 1), (0, [1.0, 0.5, 0.2, 0.1], 1), (100, [0.5, 0.5, 0.1, 0.3], 1), (200, None, 1), (7, [1.0, None, 0.0, 0.0], 2), (8, [nan, 0.0, 0.0, 0.0], 2), (None, [1.0, 0.2, 0.1, 0.0], None), (3, [0.7, 0.2, 0.1, 0.1], 2), (20, [], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    pages = [(1, "http://a.com/x", None), (1, "http://a.com/x", "h"), (None, None, None), (2, "", ""), (3, "http://b.net/fr/" + "x" * 100_000, "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {name: queries.QUERIES[name](spark, str(tmp_path)).collect() for name in ("op4_topk", "op11_codes", "op12_negatives", "op13_urls")}
    assert {r.query_id for r in found["op4_topk"]} == {0, 20, 100}
    assert sorted(str(r.vec_id) for r in found["op11_codes"]) == ["0", "0", "100", "20", "3", "None"]
    assert {(r.anchor_id, r.positive_id, r.negative_id) for r in found["op12_negatives"]} <= {(0, 100, 3), (100, 0, 3)}
    assert sorted((str(r.page_id), r.host, r.verdict) for r in found["op13_urls"]) == [("1", "a.com", "allow"), ("1", "a.com", "allow"), ("2", "", "allow"), ("3", "b.net", "block"), ("None", "", "allow")]


def test_small_batches_are_handed_to_python_workers(spark, tables):
    folder, _ = tables
    corpus_pipeline.mixed(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    wide = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), F.lit(4000)).alias("t"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows * 4000])], names=["n"])

    got = [r.n for r in wide.mapInArrow(size, "n long").collect()]
    assert sum(got) == 36_000_000 and max(got) <= 2 * corpus_pipeline.BATCH_BYTES


def test_small_tables_start_no_python_workers(spark):
    counts = spark.createDataFrame([(b"a", 5000), (b"b", 3)], "k binary, n long")
    for some in (counts, counts.select(F.col("k").cast("string").alias("k"), "n"), counts.select(F.length("k").alias("k"), "n")):
        made = common.hot_among(some, "k")
        assert made.schema["k"].dataType == some.schema["k"].dataType and made.schema["_parts"].dataType.simpleString() == "int"
        assert [(r.k, r._parts) for r in made.collect()] == [(some.first().k, 10)]
        assert "ExistingRDD" not in made._jdf.queryExecution().toString()
    nulls = common.hot_among(counts.select(F.lit(None).cast("long").alias("k"), "n"), "k")
    assert nulls.schema["k"].dataType.simpleString() == "bigint" and nulls.first().k is None
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    assert "ExistingRDD[name" not in mixing.mix(docs)._jdf.queryExecution().toString()
