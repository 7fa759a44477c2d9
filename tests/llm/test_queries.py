"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from tests.llm.helpers import no_docs, odd_docs
from tests.llm.test_operators import ITEMS, plain_contamination, plain_fingerprint
from voxdesk.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, duck, key):
    df = queries.QUERIES[key](spark, SF)
    result = duck.execute(queries.ORACLE[key])
    names = [d[0] for d in result.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in result.fetchall())
    assert got == want


def test_all_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    names = list(stages)
    seen = {}
    for name in names:
        docs = stages[name](spark, docs, SF)
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    kept = {r["doc_id"]: r["text"] for r in seen["quality_rules"]}
    unique = [r["doc_id"] for r in seen["simhash_near_dedup"]]
    prints = {d: plain_fingerprint(t) for d, t in kept.items()}
    group = {d: d for d in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert sorted(unique) == sorted(set(group.values()))
    dirty = plain_contamination([(d, kept[d]) for d in unique], items)
    clean = sorted(row[0] for row in dirty if not row[-1])
    assert sorted(r["doc_id"] for r in seen["benchmark_decontamination"]) == clean
    assert {r["doc_id"] for r in seen["mixing"]} <= set(clean)
    assert len(seen["sharding"]) == len(seen["mixing"])
    assert {r["shard"] for r in seen["sharding"]} == set(range(8))


def test_stages_bear_odd_and_no_rows(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    for make in (odd_docs, no_docs):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.collect()
            if name != "sharding":
                assert out.columns == docs.columns
