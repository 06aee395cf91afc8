"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import chat, class_lm, embedding_dedup, language_id, minhash_dedup, mixing, packing, quality, sharding, warc
from corpuslens.plans.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while nobody in the small old town was looking at them".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * (7 + seed) + i // 3 + seed * i * i) % len(WORDS)] for i in range(n))


LONG = prose(120_000, 3)
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "hi", "en", "a", 2), (5, prose(80), "en", "a", 400),
    (6, prose(80), "en", "a", 400), (7, prose(90, 1), "en", None, 400), (8, LONG, None, "b", len(LONG)), (9, prose(60, 2), "en", "b", 300), (9, prose(60, 2), "en", "b", 300), (None, prose(70, 4), "en", "b", 300),
]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, SCHEMA)
    clash = {c: F.lit("clash") for c in ("kept", "id", "weight", "n_words", "score", "shard", "__m", "bucket", "component", "key", "text_lang", "host", "n_tokens", "size", "k")}
    return out.withColumns(clash)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 1, None), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(docs, empty, labels):
    rows = quality.judge(docs, labels).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and [by[i]["n_words"] for i in (1, 2, 3, 4, 8)] == [0, 0, 0, 1, 120_000]
    assert by[1]["base_failed"] and not by[1]["kept"] and by[1]["score"] == 0.0 and by[5]["score"] == by[6]["score"]
    assert quality.judge(empty, labels).count() == 0
    untrusted = quality.judge(docs, labels.limit(0)).collect()
    assert all(r["score"] == 0 and r["threshold"] == 0 and r["kept"] is (not r["base_failed"]) for r in untrusted)


def test_minhash(docs, empty):
    rows = minhash_dedup.near_duplicate_classes(docs).collect()
    classes = [(r["doc_id"], r["class_id"], r["kept"]) for r in rows]
    assert len(rows) == len(ROWS) and (6, 5, False) in classes and (5, 5, True) in classes and classes.count((9, 9, True)) == 2
    assert all((i, i, True) in classes for i in (1, 2, 3, 4, 7, 8)) and (None, None, True) in classes
    assert minhash_dedup.near_duplicate_classes(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.kd_tree_shards(docs, n_shards=3).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["size"] for r in rows}[1] == 8 and {r["doc_id"]: r["text_crc32"] for r in rows}[8] == zlib.crc32(LONG.encode())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.kd_tree_shards(empty, n_shards=3).count() == 0 and sharding.kd_tree_shards(docs, target_bytes=10**9).agg(F.max("shard")).first()[0] == 0
    with pytest.raises(ValueError):
        sharding.kd_tree_shards(docs)


def test_mixing(docs, empty):
    clashing = docs.withColumns({"topic": F.lit("clash"), "probability": F.lit("clash")})
    rows = mixing.mix(clashing).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["topic"] for r in rows}[1] == "empty" and all(0 <= r["probability"] <= 1 for r in rows)
    assert len({r["kept"] for r in rows if r["doc_id"] == 9}) == 1
    assert len({r["topic"] for r in rows}) > 1 and {r["topic"] for r in mixing.mix(clashing, topic=F.col("topic")).collect()} == {"clash"}
    assert mixing.mix(empty).count() == 0
    forced = mixing.mix(docs, targets={"source": {"a": 1.0}}).collect()
    assert all(r["probability"] == 0 for r in forced if r["source"] in (None, "b") and r["n_tokens"])


def test_language(docs, empty):
    rows = language_id.identify(language_id.document_evidence(docs)).collect()
    by = {r["id"]: r for r in rows}
    assert len(rows) == len(ROWS) and all(by[i]["lang_id"] == "und" and not by[i]["kept"] for i in (1, 2, 4)) and by[5]["lang_id"] == by[8]["lang_id"] == "en" and by[8]["kept"]
    assert language_id.identify(language_id.document_evidence(empty)).count() == 0
    unknown = language_id.identify(language_id.document_evidence(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r["lang_id"] for r in unknown} == {"und"}


def test_class_lm(docs, empty):
    rows = class_lm.score_texts(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[8]["n_tokens"] == 120_001 and all(r["score"] < 0 for r in rows)
    assert sum(r["doc_id"] == 9 for r in rows) == 2 and class_lm.score_texts(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, token_budget=100).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and by[1]["n_tokens"] == 0 and by[8]["slot"] == 0 and by[8]["bucket_width"] == 120_000 and min(r["padding"] for r in rows) == 0
    assert packing.pack(empty).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, score string, node string"
    rows = [(1, 0, "user", "a", "x", "y"), (1, 0, "user", "a", "x", "y"), (1, None, None, None, None, None), (None, 1, "assistant", "", None, None), (2, 0, "assistant", LONG + "<|im_end|>\\", None, None)]
    out = chat.format_trees(chat.linear_tree(spark.createDataFrame(rows, schema)))
    found = {r["conv_id"]: r for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["t"]] == [("", ""), ("user", "a"), ("user", "a")] and found[1]["l"] == ""
    assert found[2]["l"] == LONG + "<|im_end|>\\" and found[None]["l"] == ""
    assert chat.format_trees(chat.linear_tree(spark.createDataFrame([], schema))).count() == 0


def test_warc(spark):
    warc.register(spark)
    scratch = Scratch(spark, "edge")
    schema = "page_id long, url string, html string, record_type string, offset int"
    rows = [(1, "http://a/", None, "x", 1), (2, None, "", "x", 1), (3, "http://b/\nX: y", LONG, "x", 1), (4, "u", LONG, "x", 1), (4, "u", LONG, "x", 1), (None, "u", LONG, None, None)]
    for data, wanted in ((rows, {(1, "revisit"), (2, "response"), (3, "revisit"), (4, "response"), (None, "response")}), ([], set())):
        path = scratch.path("w")
        warc.mark_revisits(spark.createDataFrame(data, schema), scratch).write.format("warc").mode("append").save(path)
        got = spark.read.format("warc").option("payload", "digest").load(path).filter("record_type <> 'warcinfo'").collect()
        assert {(int(i) if (i := r["record_id"].rpartition(":")[2]) else None, r["record_type"]) for r in got} == wanted and len(got) == len(data)
        assert all(r["payload_bytes"] in (0, len(LONG)) for r in got)


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.9, (1 - 0.81) ** 0.5])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("z") for c in ("id", "n", "key", "v", "list")})
    found = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(data).collect()]
    assert len(found) == len(rows) and all((i, 0, i) in found for i in (1, 2, 3, 4, 5, 6, 10, None))
    links = {i: n for i, n, _ in found}
    assert links[7] in (3, 4) and links[8] == links[7] and {c for i, _, c in found if i in (7, 8, 9)} == {7}
    assert embedding_dedup.near_duplicate_vectors(data.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, empty):
        before = Scratch(spark, "stage").save(rows.select("doc_id", "text", "lang", "source", "n_chars").withColumn("extra", F.lit(1)))
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, str(tmp_path))
            if name != "packing":
                assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            assert after.count() <= before.count()
            if name == "near_dedup" and rows is docs:
                assert {r["doc_id"] for r in after.collect()} >= {1, 2, 5} and 6 not in {r["doc_id"] for r in after.collect()}
