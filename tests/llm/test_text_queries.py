"""Registered text queries: SQL counterparts, columns of the contracts, and the pipeline."""

from __future__ import annotations

import os

import corpus_pipeline
import duckdb
import pytest

from rungwise.llm import parity, pii, registry, toxicity
from rungwise.llm.common import components, stored, table

COLUMNS = {
    "op1_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op3_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_vector_forest": ["vec_id", "n_links", "component_id", "kept"],
    "op6_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_parity_join": ["doc_id", "n_shingles", "component_id"],
    "op8_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_edit_counts": ["doc_id", "n_tokens_before", "n_tokens", "encoded_chars", "n_chars"],
    "op11_ranked": ["item_id", "rank", "doc_id", "score"],
    "op12_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}
#: Queries that do not return one row per row of a table.
OTHER_ROWS = {"op11_ranked", "op12_variants", "op13_packing"}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, small_dir, name):
    got = registry.QUERIES[name][0](spark, small_dir)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    source = {"op2_warc": "pages", "op5_vector_forest": "embeddings"}.get(name, "documents")
    assert name in OTHER_ROWS or got.count() == table(spark, small_dir, source).count()


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if sql])
def test_query_equals_sql(spark, small_dir, name):
    con = duckdb.connect()
    for file in os.listdir(small_dir):
        con.execute(f"create view {file[:-8]} as select * from '{small_dir}/{file}'")
    query, sql = registry.QUERIES[name]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    got = query(spark, small_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(result.fetchall(), key=str)


def test_pipeline_stages(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, small_dir), name)
        steps[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == before.columns
    before, after = steps["toxicity"]
    bad = {r.doc_id for r in toxicity.score(before, table(spark, small_dir, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = steps["near_duplicates"]
    want = {r.doc_id for r in parity.classes(before).where("doc_id = component_id").collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    before, after = steps["personal_data"]
    assert {r.doc_id for r in after.collect()} == want
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not pii.base_spans(r.text)
        assert r.text == old[r.doc_id] or r.n_chars == len(r.text)
    before, after = steps["mix"]
    assert {r.doc_id for r in after.collect()} <= want
    before, after = steps["tokens"]
    assert after.count() == before.count()


def test_components_of_random_graphs(spark):
    import random

    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(None, 3), (5, 5)]
    group = {i: i for i in range(400)}
    for a, b in edges:
        if a is not None:
            x, y = sorted((group[a], group[b]))
            group = {k: x if v == y else v for k, v in group.items()}
    nodes = spark.range(400)
    got = {r.id: r.component_id for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == group
