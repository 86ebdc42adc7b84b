"""The five stages over a small corpus, against what each operator's brute force says."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_llm import plain_hits, plain_near
from trackstream.llm import queries


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[1:-1])
    after_toxic = {r.doc_id: r.text for r in seen[1].collect()}
    assert ids[2] == {i for i, _ in plain_near(list(after_toxic.items()))}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i in ids[2]:
        n, hit, _ = plain_hits(after_toxic[i], bench)
        clean |= {i} if not (hit and 20 * hit >= n) else set()
    assert ids[3] == clean and ids[4] == ids[3] and ids[5] == ids[4]
    redacted = {r.doc_id: r for r in seen[4].collect()}
    assert all(len(r.text) == r.n_chars for r in redacted.values()) and not any("@mail" in r.text for r in redacted.values())
    for r in seen[5].collect():
        assert r.decoded_sha256 == hashlib.sha256(redacted[r.doc_id].text.encode()).hexdigest() and r.n_tokens == len(r.token_ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids[5]


def test_stages_take_odd_rows(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    odd = [
        (1, None, None, None, None), (1, None, None, None, None), (None, "x", "en", "s", 1), (3, "", "en", "s", 0), (4, "long " * 5000, "en", "s", 25000), (5, benchmark, "en", "s", 1),
        (6, "mail a.b@mail.example.com now", None, None, None), (6, "mail a.b@mail.example.com now", None, None, None), (6, "another text of six", "en", "s", 1),
    ]
    docs = spark.createDataFrame(odd, spark.read.parquet(f"{SF}/documents.parquet").schema).withColumn("_toxicity", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    tables = [docs]
    for name in stages:
        tables.append(stages[name](spark, tables[-1], SF).cache())
        assert name == "tokens" or tables[-1].columns == docs.columns
    toxic, near, clean, safe, tokens = [sorted(((r.doc_id, r.text) if "text" in r else r.doc_id for r in t.collect()), key=str) for t in tables[1:]]
    assert toxic == sorted(((i, t) for i, t, *_ in odd), key=str)  # nothing toxic in them
    assert near == sorted([(1, None), (None, "x"), (4, "long " * 5000), (5, benchmark), odd[6][:2], odd[8][:2]], key=str)  # 3 is a copy of 1
    assert clean == sorted(set(near) - {(5, benchmark)}, key=str)
    assert safe == sorted([(i, t.replace("a.b@mail.example.com", "[EMAIL]") if t else t) for i, t in clean], key=str)
    assert tokens == sorted((i for i, _ in safe), key=str) and tables[-1].where("doc_id = 1").first().n_tokens == 0
    start = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        start = stage(spark, start, SF).cache()
        assert start.count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_cover_their_tables(spark, name):
    got = queries.queries()[name](spark, SF)
    key = "page_id" if name == "op2_urls" else "doc_id"
    if key in got.columns:
        table = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
        assert got.select(F.count("*"), F.count_distinct(key)).first() == table.select(F.count("*"), F.count_distinct(key)).first()
    assert name in __spark_entry__.queries()
