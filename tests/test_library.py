"""The dataset API against plain Python lists, and batch against streaming."""

import asyncio

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow import Collectors as C
from rillflow import Dataset, DependencyMissingError, Option, ParallelExecutionError, Result, StreamEmptyError, curry, pipe, retry
from rillflow.exceptions import task_errors
from rillflow.plans import queries as plans
from rillflow.sources import files
from rillflow.sources.pages import read_paginated
from rillflow.streaming import aio, streams


def ints(spark, *xs):
    return Dataset.of(spark, *xs, schema="bigint")


def test_row_steps(spark):
    d = ints(spark, 1, 2, 3, 4, 5)
    assert d.filter(lambda r: r.value % 2 == 0).map(lambda r: r.value * 10).to_list() == [20, 40]
    lists = Dataset.of(spark, [1, 2], [3, 4], schema="array<int>")
    assert lists.flat_map("value").to_list() == [1, 2, 3, 4] and lists.pick(1).to_list() == [2, 4] and lists.pick(-1).to_list() == [None, None]
    users = Dataset.from_rows(spark, [{"id": 1, "name": "Alice"}, {"id": 2, "name": "Bob"}, {"id": 3}])
    assert users.pick("name").to_list() == ["Alice", "Bob", None] and users.filter_none("name").count() == 2
    assert d.any_match(lambda r: r.value > 4) and d.none_match(lambda r: r.value > 5) and not d.all_match(lambda r: r.value > 1)
    assert ints(spark).all_match(lambda r: r.value > 1) and not ints(spark).any_match(lambda r: r.value > 1)


def test_terminals(spark):
    d, none = ints(spark, 10, 1, 5), ints(spark)
    assert (d.min().value, d.max().value, d.sum(), d.count(), none.sum()) == (1, 10, 16, 3, 0)
    assert not none.min() and not none.find_first() and none.describe() == {} and none.reduce(0, lambda a, b: a + b) == 0
    assert d.describe() == pytest.approx({"count": 3, "sum": 16, "min": 1, "max": 10, "mean": 16 / 3, "std": 4.50925})
    assert Dataset.of(spark, "a", None, True and "b").join("-") == "a-None-b"
    assert not ints(spark, None, 1).find_first()
    with pytest.raises(StreamEmptyError):
        none.reduce(lambda a, b: a + b)
    assert ints(spark, 1, 2, 3).reduce(lambda a, b: a * 10 + b) == 123 and d.to_set() == {1, 5, 10}


def test_order_steps(spark):
    d = ints(spark, 1, 2, 3, 10, 4, 5)
    assert d.take_while(lambda r: r.value < 10).to_list() == [1, 2, 3] and d.drop_while(lambda r: r.value < 10).to_list() == [10, 4, 5]
    assert d.zip(ints(spark, 7, 8)).df.orderBy("pos").collect()[1][1:] == (2, 8)
    assert [r[1:] for r in ints(spark, 1, None).zip_longest(ints(spark, 1, 2, 3), -1).df.orderBy("pos").collect()] == [(1, 1), (None, 2), (-1, 3)]
    rows = Dataset.from_rows(spark, [{"k": k, "n": n} for n, k in enumerate("babab")])
    assert [r["n"] for r in rows.sorted("k").df.orderBy("_sorted").collect()] == [1, 3, 0, 2, 4]
    assert [r["n"] for r in rows.sorted("k", reverse=True).df.orderBy("_sorted").collect()] == [0, 2, 4, 1, 3]
    assert [r["n"] for r in rows.distinct_by("k").df.orderBy("ord").collect()] == [0, 1]
    assert ints(spark, 1, 2, 3, 4).scan("sum", 0).to_list() == [0, 1, 3, 6, 10]
    assert Dataset.iterate(spark, 10000, lambda v: v + 10, 5).to_list() == [10000, 10010, 10020, 10030, 10040]
    assert Dataset.chain(ints(spark, 1, 2), ints(spark, 3)).to_list() == [1, 2, 3]
    with pytest.raises(ValueError):
        d.limit(-1)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.integers(-9, 9), max_size=25), n=st.integers(0, 30), size=st.integers(1, 6), step=st.integers(1, 7))
def test_lists_are_the_model(spark, xs, n, size, step):
    d = ints(spark, *xs)
    for parts in (1, 5):
        e = Dataset(d.df.repartition(parts), "ord")
        assert e.limit(n).to_list() == xs[:n] and e.skip(n).to_list() == xs[n:]
        assert e.distinct().to_list() == list(dict.fromkeys(xs))
        assert e.batch(size).to_list() == [xs[i : i + size] for i in range(0, len(xs), size)]
        assert e.window(size, step).to_list() == [xs[i : i + size] for i in range(0, len(xs) - size + 1, step)]


def test_collectors(spark):
    d = Dataset.from_rows(spark, [{"cat": "A", "val": 10}, {"cat": "B", "val": 20}, {"cat": "A", "val": None}])
    got = {r["key"]: r["value"] for r in d.collect(C.grouping_by("cat", C.mapping("val", C.to_list()))).collect()}
    assert got == {"A": [10, None], "B": [20]}
    assert {r["key"]: r["value"] for r in d.collect(C.to_dict("cat", "val")).collect()} == {"A": None, "B": 20}
    assert {r["key"]: r["value"] for r in d.collect(C.partitioning_by(F.col("val") > 100, C.counting())).collect()} == {True: 0, False: 3}
    assert d.filter(lambda r: r.val > 100).collect(C.mapping("val", C.summarizing())).first()["value"].asDict() == {"count": 0, "sum": 0.0, "min": 0.0, "max": 0.0, "average": 0.0}
    assert d.collect(C.mapping("val", C.averaging())).first()[0] == 15.0
    assert d.collect(C.to_columns()).first()["value"]["val"] == [10, 20, None]


def test_time_windows_take_rows_in_order(spark):
    rows = [{"k": 1, "t": t} for t in (100, 101, 106, 104, 120, 90)]
    d = Dataset.from_rows(spark, rows).window_by_time("t", 5, ["k"]).df.orderBy("ord").collect()
    assert [r["window_id"] for r in d] == [0, 0, 1, 1, 2, 2]
    burst = Dataset.from_rows(spark, [{"x": 1, "ms": 0}, {"x": 2, "ms": 0}, {"x": 3, "ms": 150}])
    assert [r["x"] for r in burst.debounce("ms", 100).df.orderBy("ord").collect()] == [1, 3]


def test_option_and_result(spark):
    with pytest.raises(ValueError):
        Option.of(None)
    assert Option.of(0).map(lambda x: x + 1).or_else(9) == 1 and Option.empty().or_else(9) == 9 and not Option.of(1).filter(lambda x: x > 1)
    raw = Dataset.of(spark, "1", "x", None, "3").df.withColumn("r", Result.attempt(F.col("value").try_cast("int"), F.col("value"), "int").c)
    r = Result(F.col("r"))
    assert [x[0] for x in raw.orderBy("ord").select(r.get_or_else(F.lit(-1))).collect()] == [1, -1, None, 3]
    good, bad = Dataset(raw, "ord", "r").partition_results()
    assert good.to_list() == [1, None, 3] and [e["message"] for e in bad.to_list()] == ["not convertible"]
    with pytest.raises(Exception, match="not convertible"):
        raw.select(r.get_or_throw()).collect()


def test_helpers():
    assert pipe(2, lambda x: x + 1, str) == "3" and curry(lambda a, b, c=1: a + b + c)(1)(2) == 4
    calls = []

    @retry(attempts=3, first=0.001, jitter=False)
    async def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    assert asyncio.run(flaky()) == "up" and len(calls) == 3


def test_files_and_pages(spark, tmp_path):
    d = Dataset.from_rows(spark, [{"a": 1, "b": "é"}, {"a": None, "b": "z"}])
    files.write_csv(d, f"{tmp_path}/c", ["b", "a"], one_file=True)
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("part*")) == "b,a\né,1\nz,\n"
    files.write_json(d, f"{tmp_path}/j")
    assert files.read(spark, f"{tmp_path}/j", "b", "json").count() == 2
    files.write_lines(Dataset.of(spark, "hello", "world"), f"{tmp_path}/t")
    assert sorted(files.read_lines(spark, f"{tmp_path}/t").map(value=F.upper("value")).to_list()) == ["HELLO", "WORLD"]
    got = read_paginated(spark, "value long", lambda start: 0, lambda page: page + 1, lambda page: [page * 2, page * 2 + 1], lambda page: page < 2)
    assert got.to_list() == [0, 1, 2, 3, 4, 5]


def test_async_stage(spark):
    async def call(x):
        await asyncio.sleep(0.5 if x == 3 else 0)
        if x == 2:
            raise ValueError("two")
        return int(x) * 2

    got = aio.map_async(spark.range(5), "id", call, "bigint", concurrency=2, timeout=0.1).orderBy("id").collect()
    assert [r["result"]["value"] for r in got] == [0, 2, None, None, 8]
    assert [r["result"]["error"] and r["result"]["error"]["type"] for r in got] == [None, None, "ValueError", "TimeoutError", None]


def test_async_query_takes_all_events(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id * 2 AS value")
    got = plans.QUERIES["map_async"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 10000


def test_streaming_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    source = streams.tables(spark, f"{tmp_path}/in", e.schema)
    seconds = F.col("ts").cast("double")
    streams.drain(streams.throttle(source, ["user_id"], seconds, 86400, ["event_id"]), f"{tmp_path}/out", f"{tmp_path}/state")
    batch = Dataset(e, "event_id").debounce(seconds, 86400, ["user_id"]).df
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("event_id").collect()} == {r[0] for r in batch.select("event_id").collect()}


def test_rows_without_a_time_join_the_open_window(spark):
    d = Dataset(spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 14.0), (5, 15.0), (6, None)], "id long, t double"), "id")
    assert [(r["id"], r["window_id"], r["window_start"]) for r in d.window_by_time("t", 10).df.orderBy("id").collect()] == [(1, 0, None), (2, 0, 5.0), (3, 0, 5.0), (4, 0, 5.0), (5, 1, 15.0), (6, 1, 15.0)]
    assert [r["id"] for r in d.debounce("t", 10).df.orderBy("id").collect()] == [1, 5]


def test_groupings_nest_to_any_depth(spark):
    rows = [(i, "ab"[i % 2], None if i % 3 == 0 else f"x{i % 3}", i % 4) for i in range(24)]
    d = Dataset(spark.createDataFrame(rows, "id long, a string, b string, c int"), "id")
    got = d.collect(C.grouping_by("a", C.grouping_by("b", C.grouping_by("c", C.mapping("id", C.summing()))))).collect()
    found = {(r["key"], s["key"], t["key"]): t["value"] for r in got for s in r["value"] for t in s["value"]}
    want = {}
    for i, a, b, c in rows:
        want[a, b, c] = want.get((a, b, c), 0) + i
    assert found == want


def test_combine_and_scan_keep_the_order(spark):
    d = Dataset.from_rows(spark, [f"{i}," for i in range(200)], "string")
    assert d.combine(lambda a, b: a + b).value == "".join(f"{i}," for i in range(200))
    assert Dataset.from_rows(spark, [], "string").combine(lambda a, b: a + b).is_empty()
    assert [r["value"] for r in Dataset.from_rows(spark, [1, 2, 3], "long").scan(lambda a, x: a * 10 + x, 0).df.orderBy("index").collect()] == [0, 1, 12, 123]


def test_running_folds_in_chunks(spark):
    for n in (0, 1, 2, 5, 100):
        assert Dataset.iterate(spark, 3, lambda v: v * 5 % 1009, n).to_list() == [3 * 5**i % 1009 for i in range(n)]
    rows = [(i, "ab"[i % 3 == 0], i) for i in range(100)] + [(100, "c", 7)]
    got = Dataset(spark.createDataFrame(rows, "id long, k string, x long"), "id").scan_by(["k"], F.lit(1).cast("bigint"), lambda a, x: (a * 31 + x) % 1009, "x").collect()
    for k in "abc":
        want = [1]
        for _, j, x in rows:
            if j == k:
                want.append((want[-1] * 31 + x) % 1009)
        assert [r["value"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["index"])] == want


def test_positions_of_columns_with_awkward_names_and_types(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "id long, a string")
    clashing = df.select("id", "a", F.lit(5).alias("c0"), F.lit("b c").alias("b;c"))
    assert [r["pos"] for r in Dataset(clashing, "id").with_position().orderBy("id").collect()] == [0, 1, 2]
    assert Dataset(df.withColumn("nothing", F.lit(None)), "id", "a").skip(1).to_list() == ["z", "x"]


def test_async_sources_are_read_and_closed(spark):
    closed = []

    async def counting():
        i = 0
        try:
            while i < 100:
                yield i
                i += 1
        finally:
            closed.append(True)

    assert Dataset.from_aiterable(spark, counting(), "int", n=3).to_list() == [0, 1, 2] and closed == [True]
    assert Dataset.from_aiterable(spark, counting(), "int").count() == 100

    async def page(number):
        await asyncio.sleep(0)
        return number

    got = read_paginated(spark, "value long", lambda start: page(0), lambda p: page(p + 1), lambda p: [p * 2, p * 2 + 1], lambda p: p < 2)
    assert got.to_list() == [0, 1, 2, 3, 4, 5]


def test_streams_stop_with_their_block(spark):
    start = lambda name: streams.interval(spark, 10).writeStream.format("memory").queryName(name).start()
    with pytest.raises(ValueError), streams.Running(start("plain")) as query:
        assert query.isActive
        raise ValueError("stop")
    assert not query.isActive

    async def run():
        async with streams.Running(start("waiting")) as query:
            assert query.isActive
        return query

    assert not asyncio.run(run()).isActive


def test_chains_and_flat_maps_nest(spark):
    of = lambda *x: Dataset.of(spark, *x)
    two = Dataset.chain(of(1, 2), of(3, 4))
    assert Dataset.chain(two, of(5)).to_list() == [1, 2, 3, 4, 5]
    assert Dataset.chain(of(0, 9), two, two).to_list() == [0, 9, 1, 2, 3, 4, 1, 2, 3, 4]
    assert Dataset.chain(Dataset.chain(two, two), of(5)).batch(5).to_list() == [[1, 2, 3, 4, 1], [2, 3, 4, 5]]
    assert Dataset.chain(of([7]), of(1, 2, 3).batch(2)).to_list() == [[7], [1, 2], [3]]
    by_id = Dataset(spark.createDataFrame([(2, 20), (1, 10)], "id int, value long"), "id")
    assert Dataset.chain(of(2, 1), by_id).to_list() == [2, 1, 10, 20]
    with pytest.raises(ValueError, match="ord"):
        Dataset.chain(of(1), Dataset(spark.createDataFrame([(1, 2, 3)], "id int, ord int, x int"), "id"))
    deep = of([[[1], [2]], [[3, 4]]], [[[5]]])
    for _ in range(3):
        deep = deep.flat_map(lambda r: r.value)
    assert deep.to_list() == [1, 2, 3, 4, 5]
    assert deep.window(2).to_list() == [[1, 2], [2, 3], [3, 4], [4, 5]]


def test_errors_of_tasks(spark):
    failing = ints(spark, 2, 1, 0).map(lambda r: F.udf(lambda x: 2 // x, "bigint")(r.value))
    for call in (failing.to_list, failing.to_set, failing.sum, failing.max, failing.to_df, lambda: failing.for_each(print)):
        with pytest.raises(ParallelExecutionError, match="ZeroDivisionError"):
            call()
    with pytest.raises(DependencyMissingError, match="nowhere"), task_errors():
        import nowhere  # noqa: F401
    with pytest.raises(KeyError), task_errors():  # other errors pass
        {}["a"]


def test_fields_of_json_text(spark):
    texts = Dataset.of(spark, '{"a": 1, "b.c": {"d": 2}, "e f": "x"}', "{}", "no json")
    assert texts.pick("a").to_list() == ["1", None, None]
    assert texts.pick("b.c").to_list() == ['{"d":2}', None, None]
    assert texts.pick("e f").to_list() == ["x", None, None]
