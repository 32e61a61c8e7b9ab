"""The registry: a query for each operation over the driver's tables, and its SQL.

Money has two decimals, so sums go through decimals and don't depend on the order of
addition; means are rounded. Lists are shown as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.dataset import Dataset
from rillflow.functions.functional import curry, pipe, retry
from rillflow.functions.option import Option
from rillflow.functions.result import Result
from rillflow.operators import collectors as C
from rillflow.sources.pages import read_paginated
from rillflow.streaming import aio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, order: str | list[str]) -> Dataset:
    return Dataset(spark.read.parquet(f"{sf_dir}/{name}.parquet"), order)


def events(spark, sf_dir) -> Dataset:
    return table(spark, sf_dir, "events", "event_id")


def orders(spark, sf_dir) -> Dataset:
    return table(spark, sf_dir, "orders", "o_orderkey")


def money(c):
    return F.col(c).cast("decimal(18,2)")


def shown(items, separator: str = ","):
    return F.array_join(items, separator)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, round(avg(l_quantity), 6) AS avg_qty
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def group_summarizing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]).filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    d = lines.collect(C.grouping_by({"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, {"s": C.mapping("l_quantity", C.summarizing()), "t": C.mapping(money("l_quantity"), C.summing())}))
    return d.select("l_returnflag", "l_linestatus", F.col("s.count").alias("n"), F.col("t").cast("double").alias("sum_qty"), F.col("s.min").alias("min_qty"), F.col("s.max").alias("max_qty"), F.round("s.average", 6).alias("avg_qty"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_quantity > 25")
def filter_map(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    return lines.filter(lambda r: r.l_quantity > 25).map(l_partkey="l_partkey", revenue=lambda r: F.round(r.l_extendedprice * (1 - r.l_discount), 4)).df


@query("SELECT doc_id, i - 1 AS item, w AS value FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)")
def flat_map_words(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id").flat_map(lambda r: F.split(r.text, " ", -1)).df.withColumn("item", F.col("item").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def pick_json(spark, sf_dir):
    return events(spark, sf_dir).map(props="props").pick("k").df


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def filter_none_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id")
    return Dataset(docs.df.join(labels.df, "doc_id", "left"), "doc_id").filter_none("quality").df.select("doc_id", "quality")


@query("""SELECT event_type, coalesce(bool_or(value > 90), false) AS any_big, coalesce(bool_and(value > 0), true) AS all_positive,
  NOT coalesce(bool_or(value < 0), false) AS none_negative FROM events GROUP BY event_type""")
def any_all_none(spark, sf_dir):
    e, v = events(spark, sf_dir).df, F.col("value")
    hit = lambda p: F.coalesce(F.bool_or(p), F.lit(False))
    return e.groupBy("event_type").agg(hit(v > 90).alias("any_big"), F.coalesce(F.bool_and(v > 0), F.lit(True)).alias("all_positive"), (~hit(v < 0)).alias("none_negative"))


def _tried(spark, sf_dir) -> Dataset:
    raw = F.concat(F.when(F.col("event_id") % 3 == 0, "x").otherwise(""), F.col("user_id").cast("string"))
    result = Result.attempt(raw.try_cast("bigint"), raw, "bigint")
    return events(spark, sf_dir).map(value=result.c)


@query("SELECT event_id, user_id AS value FROM events WHERE event_id % 3 <> 0")
def flat_map_result(spark, sf_dir):
    return _tried(spark, sf_dir).flat_map_result().df


@query("SELECT event_id % 3 <> 0 AS ok, count(*) AS n FROM events GROUP BY 1")
def partition_results(spark, sf_dir):
    good, bad = _tried(spark, sf_dir).partition_results()
    count = lambda d, ok: d.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(ok).alias("ok"), "n")
    return count(good, True).unionByName(count(bad, False))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS value FROM events")
def result_get_or_else(spark, sf_dir):
    d = _tried(spark, sf_dir)
    return d.map(value=Result(F.col("value")).get_or_else(F.lit(-1))).df


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'could not: not convertible' END AS message, CASE WHEN event_id % 3 <> 0 THEN user_id * 2 END AS value FROM events")
def result_map_error(spark, sf_dir):
    r = Result(F.col("value")).map(lambda v: v * 2, "bigint").map_error(lambda m: F.concat(F.lit("could not: "), m))
    return _tried(spark, sf_dir).df.select("event_id", r.error()["message"].alias("message"), r.c["value"].alias("value"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN quality = 1 THEN 'good' ELSE 'other' END AS kind FROM documents LEFT JOIN labels USING (doc_id)")
def option_or_else(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id").df.join(table(spark, sf_dir, "labels", "doc_id").df, "doc_id", "left")
    q = Option.of_nullable(F.col("quality"))
    return d.select("doc_id", q.or_else(-1).alias("quality"), q.filter(lambda c: c == 1).map(lambda c: F.lit("good")).or_else("other").alias("kind"))


_NUMBERED = "SELECT row_number() OVER (ORDER BY {k}) - 1 AS pos, {v} AS v FROM {t}"
_PAIR = "SELECT pos, a.v AS \"left\", b.v AS \"right\" FROM (" + _NUMBERED.format(k="c_custkey", v="c_name", t="customer") + ") a {} JOIN (" + _NUMBERED.format(k="s_suppkey", v="s_name", t="supplier") + ") b USING (pos)"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "customer", "c_custkey").map(name="c_name"), table(spark, sf_dir, "supplier", "s_suppkey").map(name="s_name")


@query(_PAIR.format(""))
def zip_inner(spark, sf_dir):
    a, b = _names(spark, sf_dir)
    return a.zip(b).df


@query(_PAIR.format("FULL").replace('b.v AS "right"', "coalesce(b.v, '-') AS \"right\""))
def zip_longest(spark, sf_dir):
    a, b = _names(spark, sf_dir)
    return a.zip_longest(b, "-").df


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS index FROM orders")
def zip_with_index(spark, sf_dir):
    return orders(spark, sf_dir).zip_with_index(1).df.select("o_orderkey", "index")


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def count_sum_min_max(spark, sf_dir):
    return orders(spark, sf_dir).aggregate(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(money("o_totalprice")), F.lit(0)).cast("double").alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT * FROM (SELECT 'min' AS which, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'max', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")
def argmin_argmax(spark, sf_dir):
    d = orders(spark, sf_dir).filter_none("o_totalprice").df
    low, high = F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return d.agg(F.array(F.struct(F.lit("min").alias("which"), low.alias("o_orderkey")), F.struct(F.lit("max").alias("which"), high.alias("o_orderkey"))).alias("x")).select(F.inline("x"))


_EVENTS = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


@query(f"""WITH RECURSIVE {_EVENTS}, f AS (
  SELECT user_id, rn, (7 * 31 + event_id) % 1000003 AS v FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, (f.v * 31 + e.event_id) % 1000003 FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
  SELECT user_id, v AS value FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""")
def reduce_fold(spark, sf_dir):
    return events(spark, sf_dir).fold_by(["user_id"], F.lit(7).cast("bigint"), lambda a, x: (a * 31 + x) % 1000003, "event_id")


@query("SELECT user_id AS key, string_agg(event_type, '-' ORDER BY event_id) AS value FROM events GROUP BY user_id")
def join_string(spark, sf_dir):
    return events(spark, sf_dir).collect(C.grouping_by("user_id", C.mapping("event_type", C.joining("-"))))


@query("SELECT user_id, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def find_first(spark, sf_dir):
    return events(spark, sf_dir).filter(lambda r: r.event_type == "purchase").distinct_by("user_id").df.select("user_id", "event_id")


@query("SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events")
def describe(spark, sf_dir):
    return events(spark, sf_dir).aggregate(F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("double").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query("SELECT o_orderpriority AS key, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def group_counting_summing_averaging(spark, sf_dir):
    d = orders(spark, sf_dir).collect(C.grouping_by("o_orderpriority", {"n": C.counting(), "total": C.summing(money("o_totalprice")), "mean": C.mapping("o_totalprice", C.averaging())}))
    return d.select("key", "n", F.col("total").cast("double").alias("total"), F.round("mean", 4).alias("mean"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_nested(spark, sf_dir):
    return orders(spark, sf_dir).collect(C.grouping_by({"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}, {"n": C.counting()}))


@query("SELECT user_id AS key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def group_to_list_to_set(spark, sf_dir):
    d = events(spark, sf_dir).collect(C.grouping_by("user_id", {"ids": C.mapping("event_id", C.to_list()), "kinds": C.mapping("event_type", C.to_set())}))
    return d.select("key", shown(F.col("ids").cast("array<string>")).alias("ids"), shown(F.sort_array("kinds")).alias("kinds"))


@query("SELECT user_id AS key, event_type AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def to_dict_last(spark, sf_dir):
    return events(spark, sf_dir).collect(C.to_dict("user_id", "event_type"))


@query("SELECT k AS key, count(o_orderkey) AS value FROM (VALUES (true), (false)) t(k) LEFT JOIN orders ON (o_totalprice > 100000000) = k GROUP BY k")
def partitioning_by(spark, sf_dir):
    return orders(spark, sf_dir).collect(C.partitioning_by(F.col("o_totalprice") > 100_000_000, C.counting()))


@query("SELECT string_agg(CAST(r_regionkey AS VARCHAR), ',' ORDER BY r_regionkey) AS keys, string_agg(r_name, ',' ORDER BY r_regionkey) AS names FROM region")
def to_columns(spark, sf_dir):
    d = table(spark, sf_dir, "region", "r_regionkey").collect(C.to_columns())
    return d.select(shown(F.col("value.r_regionkey").cast("array<string>")).alias("keys"), shown("value.r_name").alias("names"))


_POS = "p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)"


@query(f"WITH {_POS} SELECT pos // 7 AS batch, string_agg(event_type, ',' ORDER BY pos) AS items FROM p GROUP BY 1")
def batch(spark, sf_dir):
    return events(spark, sf_dir).map(value="event_type").batch(7).df.select("batch", shown("items").alias("items"))


_WINDOW = "WITH {pos}, w AS (SELECT a.pos // {step} AS \"window\", string_agg(b.event_type, ',' ORDER BY b.pos) AS items, count(*) AS n FROM p a JOIN p b ON b.pos BETWEEN a.pos AND a.pos + {last} WHERE a.pos % {step} = 0 GROUP BY 1) SELECT \"window\", items FROM w WHERE n = {last} + 1"


@query(_WINDOW.format(pos=_POS, step=1, last=4))
def window(spark, sf_dir):
    return events(spark, sf_dir).map(value="event_type").window(5).df.select("window", shown("items").alias("items"))


@query(_WINDOW.format(pos=_POS, step=5, last=1))
def window_step(spark, sf_dir):
    return events(spark, sf_dir).map(value="event_type").window(2, 5).df.select("window", shown("items").alias("items"))


_ANCHORED = f"""WITH RECURSIVE {_EVENTS}, f AS (
  SELECT user_id, rn, event_id, epoch(ts) AS t, CAST(0 AS BIGINT) AS window_id, epoch(ts) AS s FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.event_id, epoch(e.ts), CASE WHEN epoch(e.ts) >= f.s + 86400 THEN f.window_id + 1 ELSE f.window_id END,
    CASE WHEN epoch(e.ts) >= f.s + 86400 THEN epoch(e.ts) ELSE f.s END
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)"""


@query(_ANCHORED + " SELECT event_id, user_id, window_id FROM f")
def window_by_time(spark, sf_dir):
    d = events(spark, sf_dir).map(user_id="user_id", ts=F.col("ts").cast("timestamp"))
    return d.window_by_time(F.col("ts").cast("double"), 86400, ["user_id"]).df.select("event_id", "user_id", "window_id")


@query(_ANCHORED + " SELECT min(event_id) AS event_id, user_id FROM f GROUP BY user_id, window_id")
def debounce(spark, sf_dir):
    d = events(spark, sf_dir).map(user_id="user_id", ts=F.col("ts").cast("timestamp"))
    return d.debounce(F.col("ts").cast("double"), 86400, ["user_id"]).df.select("event_id", "user_id")


@query("SELECT CAST(-1 AS BIGINT) AS index, CAST(0 AS BIGINT) AS value UNION ALL SELECT row_number() OVER (ORDER BY o_orderkey) - 1, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) FROM orders")
def scan_sum(spark, sf_dir):
    return orders(spark, sf_dir).scan("sum", 0, "o_custkey").df


@query("""SELECT o_custkey, -1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey NULLS FIRST) AS index,
  CAST(coalesce(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey NULLS FIRST), 0) AS BIGINT) AS value
  FROM (SELECT o_custkey, o_orderkey FROM orders UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders)""")
def scan_by_key(spark, sf_dir):
    d = orders(spark, sf_dir).scan_by(["o_custkey"], F.lit(0).cast("bigint"), lambda a, x: a + x, "o_orderkey")
    return d.withColumn("index", F.col("index").cast("long"))


_CUT = "(SELECT min(event_id) FROM events WHERE NOT coalesce(event_id < 300 OR value < 50, false))"


@query(f"SELECT event_id FROM events WHERE coalesce(event_id < {_CUT}, true)")
def take_while(spark, sf_dir):
    return events(spark, sf_dir).take_while(lambda r: (r.event_id < 300) | (r.value < 50)).df.select("event_id")


@query(f"SELECT event_id FROM events WHERE event_id >= {_CUT}")
def drop_while(spark, sf_dir):
    return events(spark, sf_dir).drop_while(lambda r: (r.event_id < 300) | (r.value < 50)).df.select("event_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS place FROM orders")
def sorted_stable(spark, sf_dir):
    return orders(spark, sf_dir).sorted("o_orderpriority", reverse=True).df.select("o_orderkey", F.col("_sorted").alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def limit(spark, sf_dir):
    return orders(spark, sf_dir).limit(100).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def skip(spark, sf_dir):
    return orders(spark, sf_dir).skip(100).df.select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf_dir):
    return orders(spark, sf_dir).top(10, "o_totalprice").df.select("o_orderkey", "o_totalprice")


@query("SELECT min(event_id) AS event_id, event_type FROM events GROUP BY event_type")
def distinct(spark, sf_dir):
    return events(spark, sf_dir).map(event_type="event_type").distinct().df


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_by(spark, sf_dir):
    return events(spark, sf_dir).distinct_by("user_id").df.select("user_id", "event_id", "event_type")


@query("SELECT 0 AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier")
def chain(spark, sf_dir):
    a = Dataset(table(spark, sf_dir, "customer", "c_custkey").df.selectExpr("c_custkey as id", "c_name as name"), "id")
    b = Dataset(table(spark, sf_dir, "supplier", "s_suppkey").df.selectExpr("s_suppkey as id", "s_name as name"), "id")
    return Dataset.chain(a, b).df.select(F.col("_source").alias("source"), "id", "name")


@query("WITH RECURSIVE i AS (SELECT CAST(0 AS INTEGER) AS ord, CAST(7 AS BIGINT) AS value UNION ALL SELECT ord + 1, (value * 6364 + 1442) % 1000003 FROM i WHERE ord < 49) SELECT ord, value FROM i")
def iterate(spark, sf_dir):
    return Dataset.iterate(spark, 7, lambda v: (v * 6364 + 1442) % 1000003, 50).df


@query("SELECT event_id, user_id * 2 AS value FROM events")
def map_async(spark, sf_dir):
    async def double(x):
        return int(x) * 2

    d = events(spark, sf_dir).df.select("event_id", "user_id")
    return aio.map_async(d, "user_id", double, "bigint", concurrency=32).select("event_id", "result.value")


# --- terminals: what the methods return, as one row -----------------------------------------

def _row(spark, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


@query("SELECT coalesce(bool_or(value > 99), false) AS any_big, coalesce(bool_and(value > 0), true) AS all_positive, NOT coalesce(bool_or(value < 0), false) AS none_negative FROM events")
def matches(spark, sf_dir):
    e = events(spark, sf_dir)
    return _row(spark, "any_big boolean, all_positive boolean, none_negative boolean", e.any_match(lambda r: r.value > 99), e.all_match(lambda r: r.value > 0), e.none_match(lambda r: r.value < 0))


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def count_sum(spark, sf_dir):
    d = orders(spark, sf_dir)
    return _row(spark, "n long, total double", d.count(), float(d.sum(money("o_totalprice"))))


@query("SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS low, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS high, (SELECT min(o_totalprice) FROM orders) AS least, (SELECT max(o_totalprice) FROM orders) AS most")
def min_max(spark, sf_dir):
    d = Dataset(orders(spark, sf_dir).df.select("o_orderkey", F.col("o_orderkey").alias("key"), "o_totalprice"), "o_orderkey", "key")
    price = orders(spark, sf_dir).map(price="o_totalprice")
    return _row(spark, "low long, high long, least double, most double", d.min("o_totalprice").value, d.max("o_totalprice").value, price.min().value, price.max().value)


@query("""WITH RECURSIVE s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier),
  f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(7 AS BIGINT) AS v UNION ALL SELECT s.rn, (f.v * 31 + s.s_suppkey) % 1000003 FROM f JOIN s ON s.rn = f.rn + 1)
  SELECT (SELECT v FROM f ORDER BY rn DESC LIMIT 1) AS folded, (SELECT max(s_suppkey) FROM supplier) AS most, (SELECT string_agg(s_name, '' ORDER BY s_suppkey) FROM supplier) AS names""")
def reduce_terminal(spark, sf_dir):
    keys = Dataset(table(spark, sf_dir, "supplier", "s_suppkey").df.select("s_suppkey", F.col("s_suppkey").cast("long").alias("key")), "s_suppkey")
    names = table(spark, sf_dir, "supplier", "s_suppkey").map(name="s_name")
    return _row(spark, "folded long, most long, names string", keys.reduce(7, lambda a, x: (a * 31 + x) % 1000003), keys.reduce(max), names.combine(lambda a, b: a + b).value)


@query("SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation")
def join_terminal(spark, sf_dir):
    return _row(spark, "names string", table(spark, sf_dir, "nation", "n_nationkey").map(name="n_name").join(", "))


@query("SELECT (SELECT event_type FROM events WHERE user_id > 5 ORDER BY event_id LIMIT 1) AS found, 'none' AS missing")
def find_first_terminal(spark, sf_dir):
    kinds = events(spark, sf_dir)
    return _row(spark, "found string, missing string", kinds.filter(lambda r: r.user_id > 5).map(kind="event_type").find_first().value, kinds.filter(lambda r: r.event_id < 0).map(kind="event_type").find_first().or_else("none"))


@query("SELECT count(*) AS count, round(sum(o_custkey), 4) AS sum, round(avg(o_custkey), 4) AS mean, round(stddev_samp(o_custkey), 4) AS std, min(o_custkey) AS min, max(o_custkey) AS max FROM orders")
def describe_terminal(spark, sf_dir):
    d = orders(spark, sf_dir).describe("o_custkey")
    return _row(spark, "count long, sum double, mean double, std double, min long, max long", d["count"], float(d["sum"]), round(d["mean"], 4), round(d["std"], 4), d["min"], d["max"])


@query("SELECT i AS ord, v AS value FROM (SELECT unnest([10, 20, 30]) AS v, generate_subscripts([10, 20, 30], 1) - 1 AS i)")
def of(spark, sf_dir):
    return Dataset.of(spark, 10, 20, 30, schema="int").df


@query("SELECT i AS ord, i * i AS value FROM range(20) t(i)")
def generate(spark, sf_dir):
    numbers = iter(range(20))
    return Dataset.generate(spark, lambda: next(numbers) ** 2, 20, "bigint").df


@query("SELECT i AS ord, i * 7 AS value FROM range(12) t(i)")
def from_aiterable(spark, sf_dir):
    async def sevens():
        i = 0
        while True:
            yield 7 * i
            i += 1

    return Dataset.from_aiterable(spark, sevens(), "bigint", n=12).df


@query("SELECT r_regionkey AS ord, r_name AS value FROM region")
def from_paginated(spark, sf_dir):
    names = table(spark, sf_dir, "region", "r_regionkey").map(name="r_name").to_list()

    async def page(at):
        return at, names[at : at + 2]

    return read_paginated(spark, "value string", lambda start: page(0), lambda p: page(p[0] + 2), lambda p: p[1], lambda p: p[0] + 2 < len(names)).df


@query("SELECT i AS ord, 3 AS value FROM range(50) t(i)")
def generate_column(spark, sf_dir):
    return Dataset.generate(spark, F.lit(3), 50).df


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def parallel(spark, sf_dir):
    return orders(spark, sf_dir).parallel(6).map(twice=lambda r: r.o_totalprice * 2).df


@query("SELECT r_name AS name, row_number() OVER (ORDER BY r_regionkey) - 1 AS place FROM region")
def to_list(spark, sf_dir):
    return spark.createDataFrame([(x, i) for i, x in enumerate(table(spark, sf_dir, "region", "r_regionkey").map(name="r_name").to_list())], "name string, place long")


@query("SELECT DISTINCT event_type AS kind FROM events")
def to_set(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in events(spark, sf_dir).map(kind="event_type").to_set()], "kind string")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def iterated(spark, sf_dir):
    names = table(spark, sf_dir, "nation", "n_nationkey").map(name="n_name")
    return spark.createDataFrame(list(enumerate(names)), "key long, name string")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def to_df_to_np(spark, sf_dir):
    d = Dataset(table(spark, sf_dir, "nation", "n_nationkey").df.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    frame, array = d.to_df(["name", "region"]), d.to_np()
    return spark.createDataFrame([(a, int(y)) for a, (_, y) in zip(frame["name"], array, strict=True)], "name string, region int")


@query("SELECT count(*) AS n, max(event_id) AS last FROM events")
def peek(spark, sf_dir):
    from pyspark.sql import Observation

    seen = Observation()
    events(spark, sf_dir).peek(seen, F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).df.write.format("noop").mode("overwrite").save()
    return _row(spark, "n long, last long", seen.get["n"], seen.get["last"])


@query("SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events")
def for_each(spark, sf_dir):
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def action(r):
        n.add(1)
        total.add(r["user_id"])

    events(spark, sf_dir).for_each(action)
    return _row(spark, "n long, total long", n.value, total.value)


@query("""SELECT doc_id, quality IS NOT NULL AS present, quality IS NULL AS empty, quality * 10 AS tens, coalesce(quality, 5) AS got, coalesce(quality, 0) AS thrown
  FROM documents LEFT JOIN labels USING (doc_id)""")
def option_methods(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id").df.join(table(spark, sf_dir, "labels", "doc_id").df, "doc_id", "left")
    q = Option.of_nullable(F.col("quality"))
    some = Option.of(F.coalesce("quality", F.lit(0)))
    return d.select("doc_id", q.is_present().alias("present"), q.is_empty().alias("empty"), q.flat_map(lambda c: Option.of_nullable(c * 10)).value.alias("tens"), q.or_else_get(lambda: F.lit(5)).alias("got"), some.or_else_throw().alias("thrown"))


@query("SELECT 'seen 4' AS present, 'Option(4)' AS shown, 'Option.empty()' AS nothing, 'no value' AS error")
def option_values(spark, sf_dir):
    seen: list[str] = []
    Option.of(4).if_present(lambda x: seen.append(f"seen {x}"))
    Option.empty().if_present(lambda x: seen.append("never"))
    try:
        Option.empty().or_else_throw()
    except Exception as e:
        error = str(e)
    return _row(spark, "present string, shown string, nothing string, error string", *seen, repr(Option.of(4)), repr(Option.empty()), error)


@query("SELECT event_id, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 3 <> 0 AND user_id % 2 = 0 THEN user_id // 2 END AS half FROM events")
def result_flat_map(spark, sf_dir):
    half = lambda v: Result(F.when(v % 2 == 0, Result.success((v / 2).cast("bigint")).c).otherwise(Result.failure("odd", "bigint").c))
    r = Result(F.col("value"))
    return _tried(spark, sf_dir).df.select("event_id", r.is_success().alias("ok"), r.flat_map(half, "bigint").c["value"].alias("half"))


@query("SELECT count(*) FILTER (WHERE event_id % 3 <> 0) AS successes, count(*) FILTER (WHERE event_id % 3 = 0) AS failures FROM events")
def result_on_success_on_failure(spark, sf_dir):
    r = Result(F.col("value"))
    return _tried(spark, sf_dir).df.agg(r.on_success(), r.on_failure())


@query("SELECT event_id, user_id AS value FROM events WHERE event_id % 3 <> 0")
def result_get_or_throw(spark, sf_dir):
    d = _tried(spark, sf_dir)
    return d.filter(Result(F.col("value")).is_success()).map(value=Result(F.col("value")).get_or_throw()).df


@query("SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN 100 // (user_id % 4) END AS value, CASE WHEN user_id % 4 = 0 THEN 'ZeroDivisionError' END AS error FROM events")
def result_of(spark, sf_dir):
    r = Result.of(lambda x: 100 // (x % 4), F.col("user_id"), "bigint")
    return events(spark, sf_dir).df.select("event_id", r.c.alias("r")).select("event_id", "r.value", F.col("r.error.type").alias("error"))


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS value FROM customer WHERE c_acctbal > 0")
def piped(spark, sf_dir):
    scaled = curry(lambda by, plus, d: d.map(value=lambda r: r.c_acctbal * by + plus))
    return pipe(table(spark, sf_dir, "customer", "c_custkey"), lambda d: d.filter(lambda r: r.c_acctbal > 0), scaled(2)(1)).df


@query("SELECT s_suppkey, s_suppkey + 1 AS value FROM supplier")
def retried(spark, sf_dir):
    failed: set[int] = set()

    @retry(attempts=3, first=0.0, jitter=False)
    async def call(x):
        if x % 2 and x not in failed:
            failed.add(x)
            raise OSError("busy")
        return int(x) + 1

    d = table(spark, sf_dir, "supplier", "s_suppkey").df.select("s_suppkey")
    return aio.map_async(d, "s_suppkey", call, "bigint", concurrency=32).select("s_suppkey", "result.value")


@query("SELECT event_id, user_id + 3 AS value FROM events")
def map_async_unordered(spark, sf_dir):
    async def add(x):
        return int(x) + 3

    d = Dataset(events(spark, sf_dir).df.select("event_id", "user_id"), "event_id")
    return d.to_async("user_id", add, "bigint", concurrency=32, ordered=False).df.select("event_id", "result.value")


@query("SELECT c_custkey, length(c_name) * 7 AS value FROM customer")
def map_udf(spark, sf_dir):
    weigh = F.udf(lambda s: len(s) * 7, "long", useArrow=True)
    return table(spark, sf_dir, "customer", "c_custkey").map(value=lambda r: weigh(r.c_name)).df


@query("""WITH RECURSIVE s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier),
  f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(1 AS BIGINT) AS v UNION ALL SELECT s.rn, (f.v * 17 + s.s_suppkey) % 10007 FROM f JOIN s ON s.rn = f.rn + 1)
  SELECT rn - 1 AS index, v AS value FROM f""")
def scan_with(spark, sf_dir):
    return table(spark, sf_dir, "supplier", "s_suppkey").scan(lambda a, x: (a * 17 + x) % 10007, 1, "s_suppkey").df


@query("SELECT status, string_agg(o_orderpriority || '=' || n, ';' ORDER BY o_orderpriority) AS items, CAST(sum(n) AS BIGINT) AS total FROM (SELECT o_orderstatus AS status, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY status")
def group_in_group(spark, sf_dir):
    d = orders(spark, sf_dir).collect(C.grouping_by({"status": "o_orderstatus"}, {"groups": C.grouping_by("o_orderpriority", C.counting()), "total": C.counting()}))
    return d.select("status", shown(F.transform("groups", lambda g: F.concat(g["key"], F.lit("="), g["value"].cast("string"))), ";").alias("items"), "total")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_composition(spark, sf_dir):
    """What users build from to_dict and map: a join; Spark picks the broadcast by the sizes it knows."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
