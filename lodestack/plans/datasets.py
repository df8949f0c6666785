"""Queries over key-value tables, bags and pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import bags, kv, pairs
from lodestack.sources.staging import new_path
from lodestack.sources.tables import read, stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _orders_kv(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    return kv.rows_of(orders, F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "o_orderstatus", "o_orderpriority")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return kv.rows_of(read(spark, d, "customer"), F.col("c_name"), "c_mktsegment", "c_nationkey")


@query("""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS row_key, o_orderstatus AS status, o_orderpriority AS priority FROM orders
WHERE lpad(CAST(o_orderkey AS VARCHAR), 12, '0') >= '000000000100' AND lpad(CAST(o_orderkey AS VARCHAR), 12, '0') < '000000010000'
""")
def kv_scan_range(spark, d):
    found = kv.scan(_orders_kv(spark, d), "000000000100", "000000010000")
    return found.select("row_key", F.try_element_at("cols", F.lit("o_orderstatus")).alias("status"), F.try_element_at("cols", F.lit("o_orderpriority")).alias("priority"))


@query("""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS row_key, o_orderstatus AS status FROM orders WHERE lpad(CAST(o_orderkey AS VARCHAR), 12, '0') < '000000000500'
""")
def kv_scan_path(spark, d):
    found = kv.scan_path({"orders": _orders_kv(spark, d)}, "/data/orders//000000000500")
    return found.select("row_key", F.try_element_at("cols", F.lit("o_orderstatus")).alias("status"))


@query("SELECT c_name AS row_key, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def kv_get_row(spark, d):
    table = _customers(spark, d)
    key = table.agg(F.min("row_key").alias("k")).first().k
    return kv.get_row(table, key).select("row_key", F.try_element_at("cols", F.lit("c_mktsegment")).alias("segment"), F.try_element_at("cols", F.lit("c_nationkey")).alias("nation"))


@query("SELECT c_mktsegment AS value FROM customer WHERE c_name = (SELECT min(c_name) FROM customer) UNION ALL SELECT NULL FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM customer)")
def kv_get_cell(spark, d):
    table = _customers(spark, d)
    key = table.agg(F.min("row_key").alias("k")).first().k
    return kv.get_cell(table, key, "c_mktsegment").unionByName(kv.get_cell(table, key, "no such column"))


@query("""
SELECT row_key, row_key IN (SELECT c_name FROM customer) AS found FROM
  (SELECT c_name AS row_key FROM customer UNION ALL SELECT s_name FROM supplier)
""")
def kv_exists(spark, d):
    table = _customers(spark, d)
    return kv.exists(table, table.select("row_key").unionByName(read(spark, d, "supplier").select(F.col("s_name").alias("row_key"))))


@query("SELECT count(*) AS n FROM orders")
def kv_count(spark, d):
    return kv.count(_orders_kv(spark, d))


@query("""
SELECT 'customer' AS table_name, count(DISTINCT c_custkey) AS n_keys FROM customer UNION ALL SELECT 'nation', count(DISTINCT n_nationkey) FROM nation
UNION ALL SELECT 'lineitem', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'events', count(DISTINCT user_id) FROM events
""")
def kv_table_list(spark, d):
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "lineitem": "l_orderkey", "events": "user_id"}
    return kv.table_list({t: (read(spark, d, t), F.col(k)) for t, k in keys.items()})


@query("SELECT CAST(user_id AS VARCHAR) AS row_key, event_type AS col, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def kv_put_cell_latest(spark, d):
    return kv.latest_cells(read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("row_key"), F.col("event_type").alias("col"), "value"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def kv_put_row_latest(spark, d):
    return kv.latest_rows(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "event_id", "user_id")


@query("""
WITH log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS row_key, event_type, CAST(event_id AS VARCHAR) AS v, event_id % 10 = 0 AS whole FROM events
), live AS (
  SELECT log.* FROM log JOIN (SELECT row_key, max(event_id) FILTER (whole) AS f FROM log GROUP BY row_key) b USING (row_key) WHERE f IS NULL OR event_id >= f
)
SELECT row_key, event_type AS col, arg_max(v, event_id) AS value FROM live GROUP BY ALL
""")
def kv_log_replay(spark, d):
    log = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 0, "row").otherwise("cell").alias("op"), F.col("user_id").cast("string").alias("row_key"), F.create_map("event_type", F.col("event_id").cast("string")).alias("cols"))
    path = new_path(spark, "log")
    kv.append(log.where("seq % 2 = 0"), path)
    kv.append(log.where("seq % 2 = 1"), path)
    return kv.current(spark.read.parquet(path)).select("row_key", F.explode("cols").alias("col", "value"))


@query("SELECT CAST(user_id AS VARCHAR) AS row_key, event_type AS col, arg_max(CAST(event_id AS VARCHAR), event_id) AS value FROM events GROUP BY ALL")
def kv_log_stream(spark, d):
    """A log that a stream writes, replayed."""
    events = stream(spark, d, "events")
    cols = F.create_map("event_type", F.col("event_id").cast("string")).alias("cols")
    log = events.select(F.col("event_id").alias("seq"), F.lit("cell").alias("op"), F.col("user_id").cast("string").alias("row_key"), cols)
    path, checkpoint = new_path(spark, "log"), new_path(spark, "checkpoint")
    kv.append_stream(log, path, checkpoint, every=None).awaitTermination()
    return kv.current(spark.read.schema(kv.LOG).parquet(path)).select("row_key", F.explode("cols").alias("col", "value"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def kv_rename_roundtrip(spark, d):
    old, new = new_path(spark, "table"), new_path(spark, "table")
    kv.save_as(read(spark, d, "nation"), old)
    kv.rename(spark, old, new)
    return spark.read.parquet(new)


@query("""
WITH n AS (SELECT count(*) AS n FROM part)
SELECT p_partkey, p_name, n - 20 > 10 AS has_next FROM part, n ORDER BY p_partkey LIMIT 10 OFFSET 20
""")
def kv_page_view(spark, d):
    return kv.page(read(spark, d, "part").select("p_partkey", "p_name"), 20, key="p_partkey")


@query("SELECT c_name || '|' || c_mktsegment AS value FROM customer WHERE c_acctbal > 0")
def bag_from_table(spark, d):
    return bags.from_table(read(spark, d, "customer"), F.when(F.col("c_acctbal") > 0, F.concat_ws("|", "c_name", "c_mktsegment")))


_DOCS = r"SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents"


def _words():
    return F.filter(F.split(F.coalesce("value", F.lit("")), r"\s+"), lambda x: x != "")


def _texts(spark, d):
    return bags.from_table(read(spark, d, "documents"), F.col("text"))


@query(f"SELECT w AS value, count(*) AS n FROM (SELECT unnest(ws) AS w FROM ({_DOCS})) GROUP BY ALL")
def bag_flat_map(spark, d):
    return bags.flat_map(_texts(spark, d), _words()).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders")
def bag_map_to_pair(spark, d):
    bag = bags.from_table(read(spark, d, "orders"), F.concat_ws(",", "o_custkey", "o_orderstatus"))
    return bags.map_to_pair(bag, F.substring_index("value", ",", 1), F.substring_index("value", ",", -1))


@query(f"SELECT w AS key, count(*) AS value FROM (SELECT unnest(ws) AS w FROM ({_DOCS})) GROUP BY ALL")
def bag_flat_map_to_pair(spark, d):
    made = bags.flat_map_to_pair(_texts(spark, d), F.transform(_words(), lambda w: F.struct(w.alias("key"), F.lit(1).alias("value"))))
    return pairs.fold_by_key(made).select("key", F.col("result").alias("value"))


@query("SELECT o_orderpriority AS value FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'")
def bag_filter(spark, d):
    return bags.keep(bags.from_table(read(spark, d, "orders"), F.col("o_orderpriority")), F.col("value").rlike("^[12]"))


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def bag_distinct(spark, d):
    return bags.distinct(bags.from_table(read(spark, d, "orders"), F.col("o_orderpriority")))


@query("SELECT count(o_orderpriority) AS n FROM orders")
def bag_count(spark, d):
    return bags.count(bags.from_table(read(spark, d, "orders"), F.col("o_orderpriority")))


@query("SELECT n_name AS value FROM nation ORDER BY n_name LIMIT 5")
def bag_take(spark, d):
    return bags.take(bags.from_table(read(spark, d, "nation"), F.col("n_name")).orderBy("value"), 5)


@query("SELECT (SELECT string_agg(n_name || chr(10), '' ORDER BY n_name) FROM nation) AS said, 'No Output.' AS nothing")
def job_output(spark, d):
    lines = [f"{r.value}\n" for r in bags.from_table(read(spark, d, "nation"), F.col("n_name")).orderBy("value").collect()]  # what a job says, 25 lines
    return spark.createDataFrame([(bags.output(lines), bags.output([]))], "said string, nothing string")


@query("SELECT n_name AS value FROM nation")
def bag_collect_parallelize(spark, d):
    names = [r.value for r in bags.from_table(read(spark, d, "nation"), F.col("n_name")).collect()]  # 25 rows: the round trip is the operator
    return bags.parallelize(spark, names)


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) + 10 AS BIGINT) AS result FROM lineitem")
def bag_fold_sum(spark, d):
    return bags.fold_sum(bags.from_table(read(spark, d, "lineitem"), F.col("l_quantity").cast("long").cast("string")), 10)


@query("SELECT '^' || string_agg(n_name || ';', '' ORDER BY n_name) AS result FROM nation")
def bag_fold_ordered(spark, d):
    return bags.fold_ordered(bags.from_table(read(spark, d, "nation"), F.col("n_name")), "^", lambda acc, x: F.concat(acc, x, F.lit(";")))


@query("SELECT n_name[1] AS key, string_agg(n_name, ',' ORDER BY n_name) AS \"values\" FROM nation GROUP BY 1")
def bag_group_by(spark, d):
    return bags.group_by(bags.from_table(read(spark, d, "nation"), F.col("n_name")), F.substring("value", 1, 1))


@query("SELECT upper(p_name) || '!' AS value FROM part")
def bag_map_partitions(spark, d):
    def shout(batches):
        for batch in batches:
            yield pd.DataFrame({"value": batch["value"].str.upper() + "!"})

    return bags.map_partitions(bags.from_table(read(spark, d, "part"), F.col("p_name")), shout)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS value FROM customer INTERSECT SELECT CAST(s_nationkey AS VARCHAR) FROM supplier")
def bag_intersection(spark, d):
    left = bags.from_table(read(spark, d, "customer"), F.col("c_nationkey").cast("string"))
    return bags.intersection(left, bags.from_table(read(spark, d, "supplier"), F.col("s_nationkey").cast("string")))


@query(f"SELECT o_orderkey FROM orders WHERE md5(CAST(o_orderkey AS VARCHAR))[:8] < '{int(0.1 * 2**32):08x}'")
def bag_sample(spark, d):
    return bags.sample_hashed(read(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), 0.1)


@query("SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) AS n, true AS is_subset FROM orders")
def bag_sample_exact(spark, d):
    keys = read(spark, d, "orders").select("o_orderkey")
    got = bags.sample_exact(keys, 0.1, seed=7)
    return got.join(keys.distinct().withColumn("held", F.lit(True)), "o_orderkey", "left").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce("held", F.lit(False))), F.lit(True)).alias("is_subset"))


@query("SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) AS n FROM orders")
def bag_sample_exact_with_replacement(spark, d):
    return bags.count(bags.sample_exact(read(spark, d, "orders").select("o_orderkey"), 0.1, seed=7, replace=True))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, round(sum(o_totalprice), 2) AS result FROM orders GROUP BY 1")
def pair_fold_by_key(spark, d):
    made = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_totalprice").alias("value"))
    return pairs.fold_by_key(made).select("key", F.round("result", 2).alias("result"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, '>' || string_agg(n_name || ';', '' ORDER BY n_name) AS result FROM nation GROUP BY 1")
def pair_fold_by_key_ordered(spark, d):
    made = read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    return pairs.fold_by_key_ordered(made, F.lit(">"), lambda acc, x: F.concat(acc, x, F.lit(";")))


def _order_pairs(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))


@query("SELECT value, count(*) AS n FROM (SELECT CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderpriority FROM orders) GROUP BY ALL")
def pair_flat_map(spark, d):
    return pairs.flat_map(_order_pairs(spark, d), F.array("key", "value")).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderpriority[1], CAST(o_custkey AS VARCHAR) FROM orders")
def pair_flat_map_to_pair(spark, d):
    both = F.array(F.struct(F.col("value").alias("key"), F.col("key").alias("value")), F.struct(F.substring("value", 1, 1).alias("key"), F.col("key").alias("value")))
    return pairs.flat_map_to_pair(_order_pairs(spark, d), both)


def _by_nation(spark, d):
    a = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_custkey").cast("string").alias("value"))
    return a, read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("key"), F.col("s_suppkey").cast("string").alias("value"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key, c_custkey || ',' || s_suppkey AS value FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def pair_join(spark, d):
    return pairs.join(*_by_nation(spark, d))


@query("""
WITH a AS (SELECT c_nationkey AS k, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS v FROM customer GROUP BY 1),
     b AS (SELECT s_nationkey AS k, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS v FROM supplier GROUP BY 1)
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS key, '[' || coalesce(a.v, '') || '],[' || coalesce(b.v, '') || ']' AS value FROM a FULL JOIN b ON a.k = b.k
""")
def pair_cogroup(spark, d):
    return pairs.cogroup(*_by_nation(spark, d))


@query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer ORDER BY 1, 2")
def pair_collect(spark, d):
    return pairs.ordered(read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value")).distinct())
