"""Queries on odd and larger tables, against their SQL or plain Python."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexgrove.llm import neighbours
from lexgrove.operators import learners, trees
from lexgrove.plans import feature_queries, role_features
from lexgrove.plans import queries as plans
from tests.test_queries import plain


def compared(spark, name, folder, *tables):
    """Rows of the query and of its SQL, sorted."""
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    frame, relation = plans.QUERIES[name](spark, str(folder)), con.sql(plans.SQL[name])
    ours = sorted((tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()), key=str)
    place = [relation.columns.index(c) for c in sorted(relation.columns)]
    return ours, sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=str)


def test_majority_equals_sql_in_nations_of_several(spark, tmp_path):
    rows = [(1, "a", 7, 10.0), (2, "b", 7, 5000.0), (3, "c", 7, None), (4, "d", 8, 1.0), (5, "e", None, 1.0), (6, "f", 9, 1.0), (6, "g", 7, 1.0), (1, "h", 7, 2.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    ours, theirs = compared(spark, "learner_majority", tmp_path, "supplier")
    assert ours == theirs and len(ours) == 5


def test_round_trip_of_sentences_in_more_partitions_than_a_file_has(spark, tmp_path):
    talk = spark.range(400).selectExpr("id AS conv_id", "id % 3 AS turn", "'user' AS role", "concat('word & ', id, ' \"x\" <y>\\n  it''s ', repeat('w ', IF(id = 7, 520, 1))) AS text")
    talk.write.parquet(str(tmp_path / "conversations.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ours, theirs = compared(spark, "sentence_xml_round_trip", tmp_path, "conversations")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ours == theirs and len(ours) > 3000


@pytest.mark.parametrize("kind", learners.KINDS)
def test_rows_that_repeat_train_the_same_model_as_their_counts(kind):
    rng = np.random.default_rng(5)
    values = pd.DataFrame({"a": rng.integers(3, size=12), "b": rng.integers(2, size=12).astype(str)})
    labels, times = pd.Series(rng.choice(["x", "y", "z"], 12)), rng.integers(1, 9, 12)
    at = np.repeat(np.arange(12), times)
    whole, counted = learners.train_one(values.iloc[at], labels.iloc[at], kind), learners.train_one(values, labels, kind, times)
    assert whole.keys() == counted.keys() and whole["counts"] == counted["counts"]
    assert kind != "maxent" or np.allclose(whole["weights"], counted["weights"], atol=1e-4)
    found = learners.apply_one(counted, values.iloc[at], kind)
    assert found == [learners.apply_one(counted, values.iloc[[i]], kind)[0] for i in at]


def test_role_features_shuffle_no_path_arrays(spark, monkeypatch):
    """Tables that role features are joined on hold paths as texts, not as arrays of steps."""
    kept = []
    cut = role_features.cut
    monkeypatch.setattr(role_features, "cut", lambda df: kept.append(df.columns) or cut(df))
    folder = "/root/testdata/sf0.001"
    rows = role_features.build(feature_queries._treebank(spark, folder), height=8)
    assert not any({"p", "gp"} & set(columns) for columns in kept)
    assert [c for c in kept if "parent" in c and "frame_id" not in c], "node features are joined without frames"
    assert {"gf", "ismaxproj", "relpos", "worddistance"} <= set(rows.columns)


def test_queries_of_a_search_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbours.Hashing, "__init__", lambda *a, **k: pytest.fail("fitted on the driver"))
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 8)))]
    frame = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3)
    assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == 30


def test_sentence_tables_are_never_broadcast(spark, monkeypatch, tmp_path):
    """Files of a table are far smaller than its rows, so a table that looks small could fill the driver."""
    plans_seen = []

    def watched(df):
        df.collect()
        plans_seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = role_features.cut
    spark.range(3).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "'m' AS c_mktsegment", "id * 10000.0 - 5000 AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    t = {name: cut(rows) for name, rows in feature_queries._treebank(spark, str(tmp_path)).items()}
    t = {name: spark.read.parquet(*rows.inputFiles()) for name, rows in t.items()}
    monkeypatch.setattr(role_features, "cut", watched)
    monkeypatch.setattr(trees, "cut", watched)
    rows = role_features.build(t, height=8)
    assert len(rows.collect()) == 36
    plans_seen.append(rows._jdf.queryExecution().executedPlan().toString())
    assert len(plans_seen) > 10 and not any("Broadcast" in plan for plan in plans_seen)
