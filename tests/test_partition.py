"""Ranks, quotas and partition schemes against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silovalue.functions import ranking
from silovalue.operators import partition as D, prep as P
from silovalue.sources import tables as T

LABELS = "abcde"


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.RandomState(0)
    data = [(i, str(random.choice(list(LABELS), p=[0.4, 0.3, 0.15, 0.1, 0.05])), "test" if i % 4 == 0 else "train") for i in range(600)]
    return spark.createDataFrame(data, "row_id bigint, label string, split string").cache()


def md5(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_hash_rank_is_the_sorted_position(rows):
    found = {r.row_id: (r.label, r["rank"]) for r in ranking.hash_rank(rows, ["label"], "row_id", 5, digits=2).collect()}
    for label in LABELS:
        ids = sorted((md5(5, i), i) for i, (l, _) in found.items() if l == label)
        assert [found[i][1] for _, i in ids] == list(range(len(ids)))


def test_cumulative_counts_with_a_value_that_fills_a_third(spark):
    values = [5.0] * 100 + [float(v) for v in np.random.RandomState(1).randint(0, 50, 200)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    found = {r.value: (r.n, r.upto) for r in ranking.cumulative_counts(df, ["g"], "value").collect()}
    ordered = sorted(values)
    assert all(found[v] == (ordered.count(v), sum(o <= v for o in ordered)) for v in set(values))


def test_quotas_are_drawn_without_overlap(rows):
    counts = D.label_counts(rows)
    for quota in (D.quota_maverick_full(counts, 6), D.quota_maverick_balanced(counts, 6), D.quota_disjoint_labels(counts, 3),
                  D.quota_hellinger_trap(counts, 6, 1), D.dirichlet_quota(counts, [20, 30, 50], 1.0, 3)):
        wanted = {(r.client_id, r.label, r.split): r.n for r in quota.collect() if r.n > 0}
        drawn = D.sample_by_quota(rows, quota, 7).collect()
        assert len({r.row_id for r in drawn}) == len(drawn)
        got = {}
        for r in drawn:
            got[r.client_id, r.label, r.split] = got.get((r.client_id, r.label, r.split), 0) + 1
        assert got == wanted


def test_a_quota_above_the_supply_takes_what_is_left(spark, rows):
    quota = spark.createDataFrame([(0, "e", "train", 10), (1, "e", "train", 10_000)], D.QUOTA_SCHEMA)
    supply = rows.where("label = 'e' and split = 'train'").count()
    drawn = D.sample_by_quota(rows, quota, 1).groupBy("client_id").count().collect()
    assert {r.client_id: r["count"] for r in drawn} == {0: 10, 1: supply - 10}


def test_dirichlet_totals(rows):
    counts = D.label_counts(rows)
    quota = D.dirichlet_quota(counts, [10, 20, 30, 40], 0.5, 9).collect()
    n = {s: rows.where(F.col("split") == s).count() for s in ("train", "test")}
    given = [sum(r.n for r in quota if r.client_id == c and r.split == "train") for c in range(4)]
    # The one-per-class step may go over a target by fewer rows than there are classes; the last silo gets what is left.
    for client, share in enumerate((10, 20, 30)):
        assert 0 <= given[client] - int(share / 100 * n["train"]) < len(LABELS)
    assert sum(given) == n["train"]
    have = {(r.split, r.label): r.n for r in counts.collect()}
    for (split, label), total in have.items():
        assert sum(r.n for r in quota if r.split == split and r.label == label) <= total


def test_large_alpha_keeps_the_class_mix(rows):
    quota = D.dirichlet_quota(D.label_counts(rows), [50, 50], 1e7, 1).collect()
    first = {r.label: r.n for r in quota if r.client_id == 0 and r.split == "train"}
    second = {r.label: r.n for r in quota if r.client_id == 1 and r.split == "train"}
    assert all(abs(first[l] - second[l]) <= 8 for l in LABELS)


def test_slices_split_like_nearly_equal_parts(rows):
    found = D.partition_feature_slices(rows, [F.col("label") == "a", F.col("label").isin("b", "c")], 4).groupBy(
        "split", "client_id").count().collect()
    for split in ("train", "test"):
        for s, labels in enumerate((["a"], ["b", "c"])):
            n = rows.where((F.col("split") == split) & F.col("label").isin(labels)).count()
            sizes = [r["count"] for r in sorted(found, key=lambda r: r.client_id) if r.split == split and r.client_id // 4 == s]
            assert sizes == [len(p) for p in np.array_split(np.arange(n), 4)]


def test_more_parts_than_rows(spark):
    few = spark.createDataFrame([(i, "x") for i in range(3)], "row_id bigint, label string")
    found = D.partition_feature_slices(few, [F.lit(True)], 5).collect()
    assert sorted(r.client_id for r in found) == [0, 1, 2]


def test_target_bands_leave_the_cuts_out(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (9.0,), (None,)], "y double")
    assert sorted((r.y, r.client_id) for r in D.partition_target_range(df, [1.0, 2.0]).collect()) == [(0.5, 0), (1.5, 1), (9.0, 2)]


def test_maverick_category_takes_missing_values_as_others(spark):
    df = spark.createDataFrame([(i, "m" if i % 5 == 0 else (None if i % 5 == 1 else "o")) for i in range(50)], "row_id bigint, c string")
    found = D.partition_maverick_category(df, "c", "m", 4).collect()
    assert len(found) == 50 and all(r.client_id == 3 for r in found if r.c == "m")


def test_clusters_cover_all_rows(spark):
    random = np.random.RandomState(0)
    data = [(i, i % 2, [float(v) for v in random.normal(size=2) + 8 * (i // 2 % 3)]) for i in range(120)]
    df = spark.createDataFrame(data, "row_id bigint, label int, features array<double>")
    found = D.partition_feature_clusters(df, 3).collect()
    assert len(found) == 120
    for label in (0, 1):
        groups = {}
        for r in found:
            if r.label == label:
                groups.setdefault(r.row_id // 2 % 3, set()).add(r.client_id)
        assert sorted(len(g) for g in groups.values()) == [1, 1, 1]


def test_an_existing_scheme_is_kept(spark, rows, tmp_path):
    path = str(tmp_path / "scheme")
    first = D.partition_dirichlet(rows, [50, 50], 1.0, 1, path).count()
    D.partition_dirichlet(rows.limit(10), [100], 1.0, 2, path)
    assert T.scan_partition(spark, path).count() == first
    plan = T.scan_partition(spark, path, 1, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(client_id" in plan


def test_strict_encoding_refuses_an_unknown_category(spark):
    known = spark.createDataFrame([("a",), ("b",)], "c string")
    seen = spark.createDataFrame([("z",)], "c string")
    with pytest.raises(Exception, match="unknown category z"):
        P.onehot_encode(seen, known, ["c"], strict=True).collect()
    assert P.onehot_encode(seen, known, ["c"]).first().c_onehot == [0.0, 0.0]


def test_narrowing_refuses_what_does_not_fit(spark):
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        P.downcast_types(spark.createDataFrame([(70_000,)], "a int")).collect()


def test_modes_break_ties_by_the_smallest_value(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 4), (None, 5)], "c string, row_id int")
    assert P.impute_mode(df, df, ["c"]).where("row_id = 5").first().c == "a"


def test_nan_does_not_spoil_the_bounds(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "x double")
    found = [r.x for r in P.fill_zero(P.minmax_scale(df, df, ["x"])).collect()]
    assert found == [0.0, 1.0, 0.0]


def test_display_names(spark):
    df = spark.createDataFrame([("Activity_LAYING",), ("plain",), ("Activity_UP_STAIRS",), ("a_b_c",)], "l string")
    assert [r[0] for r in df.select(P.display_label("l", "Activity")).collect()] == ["LAYING", "plain", "UP_STAIRS", "a_b_c"]


def test_ranks_keep_rows_without_a_key_or_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", None if i == 3 else float("nan") if i == 4 else float(i)) for i in range(10)],
                               "row_id int, g string, v double")
    ranked = ranking.hash_rank(df, ["g"], "row_id", 1).collect()
    assert sorted((r.g or "", r["rank"]) for r in ranked) == [(g, i) for g in ("", "a") for i in range(5)]
    by_value = {r.row_id: r["rank"] for r in ranking.ordered_rank(df, [], "v").collect()}
    assert [i for i, _ in sorted(by_value.items(), key=lambda x: x[1])] == [3, 0, 1, 2, 5, 6, 7, 8, 9, 4]
    assert sorted(by_value.values()) == list(range(10))
    upto = ranking.cumulative_counts(df, ["g"], "v").groupBy("g").agg({"upto": "max", "n": "sum"}).collect()
    assert [(r["max(upto)"], r["sum(n)"]) for r in upto] == [(5, 5), (5, 5)]


def test_row_ids_of_null_keys(spark):
    train = spark.createDataFrame([(3,), (None,), (1,)], "k int")
    test = spark.createDataFrame([(2,)], "k int")
    found = {(r.k, r.split): r.row_id for r in P.assign_row_ids(train, test, "k").collect()}
    assert found == {(None, "train"): 0, (1, "train"): 1, (3, "train"): 2, (2, "test"): 3}


def test_empty_measure_is_not_written(spark):
    empty = spark.createDataFrame([], "measure string, src string, tgt string, value double")
    assert T.sink_distances(empty, "hellinger") is None
