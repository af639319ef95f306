"""Orphan references: every case, ties, nulls, hot keys, empty tables."""

from datetime import datetime

import pytest

from quire.operators import references as R

T1, T2, T3, T4, T5 = (datetime(2024, m, 1) for m in range(1, 6))
REF = "ref_id string, ref_field string, key string, at timestamp_ntz"
PARENT = "key string, since timestamp_ntz, extra string, status string"
GONE = "key string, gone_at timestamp_ntz"


def statuses(df):
    return {(r["ref_id"], r["status"]) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    refs = [("a", "f", "k1", T2), ("b", "f", "k1", None), ("c", "f", " k1 ", T1), ("d", "f", "nope", T2), ("e", "f", "gone", T2), ("f", "f", "back", T3), ("g", "f", "back", T5), ("h", "f", None, T2), ("i", "f", "  ", T2), ("j", "f", "K1", T2), ("k", "f", "k1", T2)]
    parents = [("k1", T2, "x", "y"), ("k1", T4, "x", "y"), ("back", T1, None, None), ("back", T4, None, None), (None, T1, None, None)]
    gone = [("gone", T1), ("back", T2), ("never", None)]
    return spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), spark.createDataFrame(gone, GONE)


@pytest.mark.parametrize("salted", [True, False])
def test_statuses(tables, salted):
    want = {("a", "valid"), ("b", "valid"), ("c", "late"), ("d", "missing"), ("e", "deleted"), ("f", "gap"), ("g", "valid"), ("j", "missing"), ("k", "valid")}
    assert statuses(R.resolve(*tables, salted=salted)) == want


def test_without_deletions_a_deleted_key_is_missing(tables):
    refs, parents, _ = tables
    assert ("e", "missing") in statuses(R.resolve(refs, parents))


def test_report(tables):
    got = {(r["month"], r["status"]): r["n_refs"] for r in R.report(R.resolve(*tables)).collect()}
    assert got[("unknown", "valid")] == 1 and got[("2024-02", "missing")] == 2 and sum(got.values()) == 9


def test_hot_keys_are_spread(spark):
    refs = spark.range(9000).selectExpr("cast(id as string) ref_id", "'f' ref_field", "if(id % 3 = 0, 'hot', concat('k', id)) key", "timestamp_ntz'2024-03-01' at")
    parents = spark.createDataFrame([("hot", T1, None, None)], PARENT)
    left, right = R._salted(R.resolve(refs, parents).select("ref_id", "ref_field", "key", "at"), R.validity(parents, None))
    assert left.filter("key = 'hot'").select("salt").distinct().count() == R.SALTS == right.count()
    counts = {r["status"]: r["count"] for r in R.resolve(refs, parents).groupBy("status").count().collect()}
    assert counts == {"valid": 3000, "missing": 6000}


def test_empty_tables(spark, tables):
    refs, parents, gone = tables
    none = spark.createDataFrame([], REF)
    assert R.resolve(none, parents, gone).count() == 0
    assert {s for _, s in statuses(R.resolve(refs, parents.limit(0), gone.limit(0)))} == {"missing"}


def test_plan_merges_sorted_streams(tables):
    plan = R.resolve(*tables)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
