"""In how many files tables are saved and results come."""

import os

import pytest

from foliospark.llm import fingerprints, near_dedup
from foliospark.operators import components
from foliospark.sources.shared import FILE_ROWS, few_files


@pytest.fixture
def many(spark):
    """The session with 211 shuffle partitions that adaptive execution leaves as they are; gives its cores."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark.sparkContext.defaultParallelism
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_few_files(spark, many):
    parts = lambda rows: few_files(spark.range(0, 1000, 1, 211), rows).rdd.getNumPartitions()
    assert [parts(x) for x in (None, 0, 1000, 5 * FILE_ROWS, 10**12)] == [211 // 8, many, many, 5, 211 // 8]


def test_small_steps_in_a_file_a_core(spark, many, monkeypatch):
    """Steps of a small graph are saved in one file a core at most; its components are whole."""
    seen, deleted = [], components._deleted

    def counted(df):
        seen.append(sum(f.startswith("part-") for f in os.listdir(df._foliospark_path.removeprefix("file://"))))
        deleted(df)

    monkeypatch.setattr(components, "_deleted", counted)
    edges = [(k, k + 1) for k in range(0, 3000) if k % 10 != 9]
    got = {(x.node, x.root) for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, k // 10 * 10) for k in range(0, 3000)}
    assert len(seen) > 1 and max(seen[1:]) <= many


@pytest.mark.parametrize("query", [fingerprints.op1_merkle_fingerprints, near_dedup.op8_minhash_near_dedup])
def test_results_in_few_files(spark, many, tmp_path, query):
    rows = [(k, f"text {k % 40} of some words that are written here. And more {k % 40}.") for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = query(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() <= max(4 * many, 211 // 8)
    assert sorted(x.doc_id for x in out.select("doc_id").collect()) == list(range(120))
