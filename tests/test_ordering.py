import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwatch.operators import ordering
from millwatch.operators.ordering import (
    with_global_row_number, with_positions, with_previous, with_rank_by_group, with_trailing_rows,
)
from millwatch.operators.split import check_splits, chronological_split, split_sizes
from tests.frames import SCHEMA, readings, values


@pytest.fixture(scope="module")
def skewed(spark):
    """One machine with most rows, some of them within one second."""
    df = readings(spark, {"hot": 400, "a": 5, "b": 1, "c": 60})
    same_second = F.when(F.col("sample_id").between(100, 250), F.lit("2026-01-01 01:01:40")).cast("timestamp_ntz")
    return df.withColumn("timestamp", F.coalesce(same_second, F.col("timestamp"))).repartition(7).cache()


@pytest.mark.parametrize("limit", [1000, 200, 50, 7])
def test_positions_are_the_same_with_any_cells(spark, skewed, limit):
    got = with_positions(skewed, "machine_id", "timestamp", "sample_id", limit)
    table = skewed.toPandas().sort_values(["machine_id", "timestamp", "sample_id"])
    group = table.groupby("machine_id")["sample_id"]
    table["position"], table["size"] = group.cumcount() + 1, group.transform("size")
    want = sorted(table[["sample_id", "position", "size"]].itertuples(index=False, name=None))
    assert values(got, "sample_id", "position", "group_size") == want


def test_no_window_group_exceeds_the_limit(spark, skewed):
    cells, counts = ordering.choose_cells(skewed, "machine_id", "timestamp", "sample_id", 50)
    marked = skewed.withColumns({"c": cells[0], "p": cells[1]})
    assert ordering.largest_group(marked, "machine_id", "c", "p") <= 50
    assert counts.agg(F.sum("_rows")).first()[0] == skewed.count()
    assert ordering.choose_cells(skewed, "machine_id", "timestamp", "sample_id", 400)[0] is None


def test_cell_sums_across_blocks(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordering, "_CELLS_PER_BLOCK", 3)
    small = with_positions(skewed, "machine_id", "timestamp", "sample_id", 20)
    whole = with_positions(skewed, "machine_id", "timestamp", "sample_id")
    columns = ("sample_id", "position", "group_size")
    assert values(small, *columns) == values(whole, *columns)


@pytest.mark.parametrize("limit", [1000, 50, 9])
def test_trailing_rows_and_previous(spark, skewed, limit):
    placed = with_positions(skewed, "machine_id", "timestamp", "sample_id")
    got = with_trailing_rows(
        placed, ["machine_id"], "position", F.col("sample_id"), 8, "seen", limit
    )
    table = skewed.toPandas().sort_values(["machine_id", "timestamp", "sample_id"])
    want = {}
    for _, ids in table.groupby("machine_id")["sample_id"]:
        ids = ids.tolist()
        for i, ident in enumerate(ids):
            want[ident] = ids[max(0, i - 7) : i + 1]
    assert {r.sample_id: r.seen for r in got.collect()} == want
    last = with_previous(skewed, "machine_id", "timestamp", "sample_id", "sample_id", "last", limit)
    assert {r.sample_id: r["last"] for r in last.collect()} == {
        ident: (ids[-2] if len(ids) > 1 else None) for ident, ids in want.items()
    }


def test_global_row_number(spark):
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"x": rng.integers(0, 50, 3000), "id": rng.permutation(3000)})
    df = spark.createDataFrame(table).repartition(11)
    got = with_global_row_number(df, [F.col("x").desc(), "id"], "n").toPandas().sort_values("n")
    want = table.sort_values(["x", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["n"].tolist() == list(range(1, 3001))
    free = with_global_row_number(spark.range(1000).repartition(5), None, "n")
    assert values(free, "n") == [(i,) for i in range(1, 1001)]


def test_rank_by_group(spark):
    rng = np.random.default_rng(6)
    table = pd.DataFrame(
        {"model": rng.choice(["a", "b"], 2000), "score": rng.choice([0.0, 0.0, 0.5, 1.0], 2000), "id": range(2000)}
    )
    got = with_rank_by_group(spark.createDataFrame(table), "model", [F.col("score").desc(), "id"], "rank").toPandas()
    want = table.sort_values(["score", "id"], ascending=[False, True])
    want["rank"] = want.groupby("model").cumcount() + 1
    merged = got.merge(want, on="id", suffixes=("", "_want"))
    assert (merged["rank"] == merged["rank_want"]).all() and len(merged) == 2000


EXPECTED = {1: (1, 0, 1), 2: (1, 0, 1), 3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 10: (6, 2, 2)}


def test_split_edges(spark):
    sizes = {f"m{n}": n for n in range(1, 31)}
    sizes[None] = 3
    df = readings(spark, sizes)
    got = chronological_split(df).groupBy("machine_id").pivot(
        "split", ["train", "validation", "test"]
    ).count().fillna(0)
    counts = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert None not in counts
    for n in range(1, 31):
        train = max(1, int(n * 0.6))
        upper = max(train + 1, int(n * (0.6 + 0.2)))
        upper = n - 1 if upper >= n else upper
        train = max(1, upper - 1) if train >= upper else train
        rows = list(range(n))
        assert counts[f"m{n}"] == (len(rows[:train]), len(rows[train:upper]), len(rows[upper:])), n
        assert n not in EXPECTED or counts[f"m{n}"] == EXPECTED[n]
    alone = chronological_split(df, allow_overlap=False).where("machine_id = 'm1'").collect()
    assert [r.split for r in alone] == ["train"]


def test_split_positions_restart_and_cells_agree(spark, skewed):
    columns = ("sample_id", "split", "split_position")
    whole = values(chronological_split(skewed), *columns)
    assert whole == values(chronological_split(skewed, group_rows=30), *columns)
    starts = chronological_split(skewed).groupBy("machine_id", "split").agg(
        F.min("split_position"), F.max("split_position") - F.count("*")
    )
    assert {tuple(r)[2:] for r in starts.collect()} == {(1, 0)}


def test_empty_split_is_an_error(spark):
    short = chronological_split(readings(spark, {"a": 2, "b": 1}))
    assert {r.split: r.rows for r in split_sizes(short).collect()} == {"train": 2, "test": 2}
    with pytest.raises(ValueError, match="validation"):
        check_splits(short)


def test_input_order_does_not_matter(spark):
    df = readings(spark, {"a": 40, "b": 25})
    shuffled = spark.createDataFrame(df.orderBy(F.rand(1)).collect(), SCHEMA)
    columns = ("sample_id", "split", "split_position")
    assert values(chronological_split(df), *columns) == values(chronological_split(shuffled), *columns)


@pytest.mark.parametrize("limit", [1000, 50, 7])
def test_group_limit_changes_nothing_for_nulls_and_fractions(spark, limit):
    """Null keys, null times, equal times, times inside one second and scattered ids."""
    rows = []
    for i in range(100):
        key = None if i % 10 == 3 else "a"
        ident = (i * 7919) % 100_003
        second = None if i % 25 == 4 else f"2026-01-01 00:00:00.{(99 - i) // 2:06d}"
        rows.append((key, second, ident, float(i)))
    frame = spark.createDataFrame(rows, "key string, time string, ident long, value double").withColumn(
        "time", F.col("time").cast("timestamp_ntz")
    )
    got = {r.ident: r for r in with_previous(frame, "key", "time", "ident", "value", "before", limit).collect()}
    assert len(got) == 100
    placed = {r.ident: r.position for r in with_positions(frame, "key", "time", "ident", limit).collect()}
    ordered = sorted((r for r in rows if r[0]), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
    before = None
    for place, (_, _, ident, value) in enumerate(ordered, 1):
        assert placed[ident] == place and got[ident].before == before
        before = value
    assert all(got[r[2]].before is None for r in rows if r[0] is None)


def test_ranks_are_not_shuffled_by_group(spark, skewed):
    """A group may hold a quarter of all rows, so rows never travel by it."""
    ranked = with_rank_by_group(skewed, "machine_id", ["timestamp", "sample_id"], "rank")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(machine_id" not in plan and "Broadcast" in plan
