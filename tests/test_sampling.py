"""Samples and splits: sizes, rounding, nulls, skew."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import sampling, splitting


def hours(spark, sizes):
    rows, n = [], 0
    for hour, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n, f"2024-01-01 {hour:02d}:10:00" if size > 0 else None))
            n += 1
    return spark.createDataFrame(rows, "id int, t string").withColumn(
        "t", F.col("t").cast("timestamp")
    )


def test_half_even(spark, size):
    df = hours(spark, [5, 3])
    sample = sampling.sample_by_time(df, "t", 4, "id")
    counts = {r.h: r.n for r in sample.groupBy(F.hour("t").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 2, 1: 2}


def test_null_times_count_but_are_not_taken(spark, size):
    df = hours(spark, [10]).unionByName(
        spark.createDataFrame([(100 + i, None) for i in range(10)], "id int, t timestamp")
    )
    assert sampling.sample_by_time(df, "t", 10, "id").count() == 5


def test_fewer_rows_than_strata(spark, size):
    df = spark.createDataFrame([(i, str(i)) for i in range(10)], "id int, s string")
    assert sampling.sample_by_strata(df, "s", 5, "id").count() == 0


def test_null_stratum_counts_but_gives_nothing(spark, size):
    rows = [(i, "a" if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, s string")
    sample = sampling.sample_by_strata(df, "s", 10, "id").collect()
    assert len(sample) == 5 and {r.s for r in sample} == {"a"}


@pytest.fixture(params=[0, 100_000], ids=["cutoff", "limit"])
def size(request, monkeypatch):
    """Both ways to find k rows: by a cutoff, and by an ordered limit."""
    monkeypatch.setattr(sampling, "LIMIT_ROWS", request.param)


def test_both_ways_agree(spark, monkeypatch):
    """Also where keys repeat, are null, and rows are alike in every column."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 13 > 0, F.col("id") % 50).alias("id"),
        F.timestamp_seconds(F.col("id") % 40 * 97 * 30).alias("t"),
        F.when(F.col("id") % 11 > 0, (F.col("id") % 4).cast("string")).alias("s"),
    )
    ways = [
        lambda: sampling.sample_by_time(df, "t", 100, "id"),
        lambda: sampling.sample_by_strata(df, "s", 103, "id"),
        lambda: sampling.sample_by_time_and_strata(df, "t", "s", 9, "id", "D"),
        lambda: sampling.reservoir_sample(df, 77, "id"),
    ]
    small = [sorted(map(str, way().collect())) for way in ways]
    monkeypatch.setattr(sampling, "LIMIT_ROWS", 0)
    assert [sorted(map(str, way().collect())) for way in ways] == small
    # a stratum that is null gives nothing, so its share stays free
    assert [len(rows) for rows in small] == [88, 80, 8, 77]


def test_sizes_where_keys_repeat(spark, size):
    rows = [(i % 10 if i % 4 else None, "ab"[i % 2], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s string, v int")
    for k in (1, 6, 39, 40, 50):
        assert sampling.reservoir_sample(df, k, "id").count() == min(k, 40)
    assert sampling.sample_by_strata(df, "s", 6, "id", cut=False).count() == 6
    same = spark.range(1000).select(F.lit(1).alias("id"))
    assert sampling.reservoir_sample(same, 7, "id").count() == 7


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [0, 1, 100, 1000, 2000])
def test_reservoir(spark, size, k, seed):
    df = spark.range(1000)
    ids = [r.id for r in sampling.reservoir_sample(df, k, "id", seed).collect()]
    assert len(ids) == len(set(ids)) == min(k, 1000)


def test_one_hot_bucket(spark, size):
    """A bucket with most rows: its candidates are a small part of it."""
    df = spark.range(60000).withColumn(
        "t", F.when(F.col("id") % 3 > 0, F.lit("2024-01-01 00:00:00")).otherwise(
            F.concat(F.lit("2024-01-02 "), F.lpad(F.pmod("id", F.lit(24)).cast("string"), 2, "0"), F.lit(":00:00"))
        ).cast("timestamp"),
    )
    sample = sampling.sample_by_time(df, "t", 600, "id")
    per = {r.d: r.n for r in sample.groupBy(F.to_date("t").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert sum(per.values()) <= 600 and abs(max(per.values()) - 400) <= 1


def split_counts(df):
    return {r.split_id: r.n for r in df.groupBy("split_id").agg(F.count("*").alias("n")).collect()}


def test_remainder(spark):
    df = spark.range(10).withColumn("s", F.lit("a"))
    assert split_counts(splitting.stratified_split(df, "s", "id", size=3)) == {0: 3, 1: 3, 2: 3, 3: 1}
    assert split_counts(splitting.plain_split(df, "id", size=3)) == {0: 3, 1: 3, 2: 3}


def test_arguments(spark):
    df = spark.range(10).withColumn("s", F.lit("a"))
    for bad in ({}, {"fraction": 0.1, "size": 2}, {"size": 0}, {"fraction": 0.01}):
        with pytest.raises(ValueError):
            splitting.plain_split(df, "id", **bad)
    with pytest.raises(ValueError):
        splitting.stratified_split(df, "nope", "id", size=2)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("strata", [[900, 90, 9, 1], [10] * 100, [500] + [1] * 500])
def test_split_is_complete_and_proportional(spark, strata, seed):
    rows, n = [], 0
    for s, size in enumerate(strata):
        for _ in range(size):
            rows.append((n, None if s == 1 else str(s)))
            n += 1
    df = spark.createDataFrame(rows, "id int, s string")
    split = splitting.stratified_split(df, "s", "id", size=100, seed=seed)
    got = split.collect()
    assert sorted(r.id for r in got) == list(range(n))
    counts = split_counts(split)
    assert all(counts[i] == 100 for i in range(n // 100))
    largest = max(strata)
    share = largest * 100 / n
    names = str(strata.index(largest))
    own = [sum(1 for r in got if r.split_id == i and r.s == names) for i in range(n // 100)]
    # strata of one row each fall where their hash puts them
    slack = 2 if len(strata) < 10 else 10
    assert all(abs(o - share) <= slack for o in own)


@pytest.mark.parametrize("keys", [["k"], ["k", "v"]])
def test_every_row_is_placed_once(spark, keys):
    """Null keys, repeated keys, rows alike in every column: exact sizes, no row lost."""
    rows = [(None if i % 7 == 0 else i % 5, "x" if i % 3 else None, i // 4) for i in range(40)] * 2
    df = spark.createDataFrame(rows, "k int, s string, v int")
    plain = splitting.plain_split(df, keys, size=5)
    assert split_counts(plain) == {n: 5 for n in range(16)}
    split = splitting.stratified_split(df, "s", keys, size=7)
    assert split_counts(split) == {**{n: 7 for n in range(11)}, 11: 3}
    for parts in (plain, split):
        assert sorted(map(str, parts.drop("split_id").collect())) == sorted(map(str, df.collect()))
    nulls = {r.split_id: r.n for r in split.filter("s IS NULL").groupBy("split_id").agg(F.count("*").alias("n")).collect()}
    assert all(1 <= nulls.get(n, 0) <= 4 for n in range(11))


def test_one_row_most_of_the_table(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("id"))
    split = splitting.plain_split(df, "id", size=1000)
    assert split_counts(split) == {n: 1000 for n in range(30)}
    assert sorted(r.id for r in split.collect()) == sorted(r.id for r in df.collect())
