"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node int, k int, n string, row string, t string, y int, size string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def documents(spark, rows=True):
    texts = [None, "", "   \n\t", "one", "one", "two words here", LONG, LONG + " x", "mail a.b@c.org +1 (202) 555-0143", "a 😀 é " * 40]
    data = [(None if i == 4 else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", 1, 2, None, "r", "t", 5, "z") for i, t in enumerate(texts)]
    data.append(data[6])
    return spark.createDataFrame(data if rows else [], SCHEMA)


@pytest.fixture()
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, None), (3, ""), (4, "TWO words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [True, False])
def test_document_operators(spark, rows, sf_dir):
    from pyspark.sql import functions as F

    from talweg.llm import decontam, mixing, ngram_join, passages, pii, quality, toxicity

    docs = documents(spark, rows)
    n = docs.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    with pytest.raises(ValueError, match="already"):
        mixing.mix(docs, name="node")
    with pytest.raises(ValueError, match="already"):
        mixing.emitted(mixing.mix(docs), copy="node")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_"] and mixed.count() == n
    out = pii.pseudonymised(docs.withColumn("changes_", F.lit(7)).withColumn("pii_", F.lit(8)), key="k")
    assert out.columns == [*docs.columns, "changes_", "pii_"] and out.where("changes_ <> 7 OR pii_ <> 8").isEmpty()
    with pytest.raises(ValueError, match="already"):
        pii.pseudonymised(docs, key="k", changes="node")
    assert out.where("text IS NULL").count() == (1 if rows else 0)
    found = {r["id"]: r for r in decontam.scan(docs, items).collect()}
    assert decontam.decontaminated(docs, items).columns == docs.columns
    near = ngram_join.near_duplicates(docs).collect()
    spans = passages.repeated_passages(docs).collect()
    net = quality.fitted(docs, labels, allowed=~quality.held_out(F.col("doc_id")))
    scores = quality.scored(docs, net).collect()
    assert quality.kept(docs, net).columns == docs.columns
    model = toxicity.fitted(docs, labels)
    toxic = toxicity.scored(docs, model).collect()
    assert len(scores) == len(toxic) == n and all(0 <= r["score"] <= 1 for r in [*scores, *toxic])
    if not rows:
        assert not found and not near and not spans
        return
    assert found[0]["n_words"] == 0 and found[6]["n_hit"] == 11 and found[5]["n_hit"] == 2 and found[5]["items"] == ["4"]
    by = {r["doc_id"]: r for r in near}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[3]["n_shingles"] == 1 and by[6]["component_id"] == by[7]["component_id"] == 6 and None not in by
    assert len(near) == n - 1
    assert {r["doc_id"] for r in spans} == {6, 7} and {r["n_words"] for r in spans} == {30_000, 30_001}
    sizes = {r["doc_id"]: r["mix_"]["size"] for r in mixed.collect()}
    assert sizes[0] == sizes[1] == 0 and sizes[5] == 3


@pytest.mark.parametrize("rows", [True, False])
def test_stages(spark, rows, sf_dir):
    import corpus_pipeline

    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "id", "node")
    for name in ("mix_", "copy", "changes_", "text_", "pii_"):
        docs = docs.withColumn(name, docs["node"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns and out.schema.names == docs.schema.names
        assert out.count() <= 3 * docs.count()


@pytest.mark.parametrize("rows", [True, False])
def test_other_tables(spark, rows):
    from talweg.llm import ann, chat, html_text

    turns = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (None, None, None, None, None), (2, 0, "tool", "<|im_end|>", "y")]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(turns if rows else [], "conv_id long, turn long, role string, text string, turns string")))
    got = {r["conv_id"]: r for r in out.collect()}
    if rows:
        assert got[1]["n_turns"] == 3 and not got[1]["valid"] and got[None]["n_turns"] == 1
        assert [t["text"] for t in got[2]["turns"]] == ["<|im_end|>"]
    pages = [(1, None, None, "a"), (2, "http://h/x", "", "b"), (2, "::::", "<p>a<p>b<div", "c"), (None, "http://h/", "<p>x", "d")]
    got = html_text.main_text(spark.createDataFrame(pages if rows else [], "page_id long, url string, html string, host string")).collect()
    assert sorted(r["text"] for r in got) == (["", "", "a b", "x"] if rows else [])
    vectors = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (None, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (7, [1.0, 2.0, 3.0], 1)]
    large = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 1e-201]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(large, large.where("vec_id = 0")).orderBy("rank").collect()] if rows else []
    assert [v for v, _ in got] == ([1, 2, 3] if rows else []) and all(abs(s - x) < 1e-12 for (_, s), x in zip(got, [1.01**-0.5] * 2 + [-1.0], strict=False))
    df = spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, id int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == ([(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)] if rows else [])
