"""Joins whose keys a third of all rows share are split by Spark."""

import contextlib

import pytest

from veilframe import runtime
from veilframe.llm import counts, jaccard

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "16k",
    "spark.sql.files.openCostInBytes": "1k",
}


@contextlib.contextmanager
def settings(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark, tmp_path):
    spark.range(9000).selectExpr("case when id % 3 = 0 then 7L else id end as k", "id as v", "repeat('x', 20) as w").repartition(12).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def test_aggregates_are_dealt_anew(spark, rows):
    with settings(spark):
        shared = rows.groupBy("k").count()
        assert "skew=true" not in plan(rows.join(shared, "k"))
        assert "skew=true" in plan(rows.join(runtime.dealt_anew(shared, "k"), "k"))


def test_hot_digest_of_the_counts(spark, rows, tmp_path):
    docs = rows.selectExpr("v as doc_id", "cast(k as string) as text")
    import public_tokenizers

    runtime.ship(spark)
    with settings(spark):
        assert "skew=true" in plan(counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")))


def test_hot_tokens_of_the_join(spark, rows, monkeypatch):
    seen, table = [], runtime.Scratch.table
    monkeypatch.setattr(runtime.Scratch, "table", lambda self, df, name, by=(): (seen.append((name, plan(df))), table(self, df, name, by))[1])
    docs = rows.where("v < 3000").selectExpr("v as doc_id", "concat_ws(' ', 'a b c d e', if(v % 3 = 0, 'one and the same line', ''), array_join(transform(sequence(0, 12), i -> md5(string(v div 2 * 13 + i + 50 * (v % 2) * int(i = 12)))), ' ')) as text")
    runtime.ship(spark)
    with settings(spark):
        found = jaccard.near_duplicates(docs, jaccard.Rule(width=3, percent=50))
        assert found.select("component_id").distinct().count() == 1500
    assert "wanted" in {name for name, p in seen if "skew=true" in p}
