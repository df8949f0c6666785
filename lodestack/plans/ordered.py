"""Queries that depend on order or time: range and as-of joins, sessions of skewed keys, streams that wait and meet, folds, pages; sketches, and what users call from outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack import command
from lodestack.functions import tables
from lodestack.operators import crawl, folds, kv, ranges, sketches
from lodestack.sources import rowlog, web
from lodestack.sources.staging import new_path
from lodestack.sources.tables import read, stream
from lodestack.streaming import deferral, joins, sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""
SELECT c_custkey, c_nationkey, c_acctbal, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 250
""")
def range_join(spark, d):
    """Customers whose balance is at most 250 above that of a supplier of their nation."""
    customers = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    bands = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 250).alias("high"), "s_suppkey")
    return ranges.range_join(customers, bands, "nation", "c_acctbal", "low", "high").select("c_custkey", F.col("nation").alias("c_nationkey"), "c_acctbal", "s_suppkey")


@query("""
SELECT l.event_id, l.user_id, l.ts, r.ts AS ts_right, r.event_id AS view_id, r.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def as_of_join(spark, d):
    """Each purchase with what its user viewed last."""
    events = read(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return ranges.as_of_join(bought, views, ["user_id"], "ts", tie=["view_id"])


@query("""
SELECT l.sale_id, l.client_id, l.sold_at AS ts, CASE WHEN r.ts - l.sold_at <= INTERVAL 2 HOUR THEN r.ts END AS ts_right, CASE WHEN r.ts - l.sold_at <= INTERVAL 2 HOUR THEN r.click_id END AS click_id FROM sales l
ASOF LEFT JOIN (SELECT client_id, ts, max(click_id) AS click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL) r ON l.client_id = r.client_id AND l.sold_at < r.ts
""")
def as_of_join_forward(spark, d):
    """Each sale with its client's next click, if that comes within two hours."""
    sold = read(spark, d, "sales").select("sale_id", "client_id", F.col("sold_at").alias("ts"))
    clicks = read(spark, d, "clicks").select("client_id", "ts", "click_id")
    return ranges.as_of_join(sold, clicks, ["client_id"], "ts", tie=["click_id"], forward=True, strict=True, within=F.expr("INTERVAL 2 HOURS"))


@query("""
WITH log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS row_key, event_type, CAST(event_id AS VARCHAR) AS v, event_id % 10 = 0 AS whole FROM events
), asked AS (
  SELECT DISTINCT row_key, event_id AS "at" FROM log WHERE event_id % 4 = 1
), since AS (
  SELECT asked.row_key, "at", max(event_id) FILTER (whole) AS f FROM asked JOIN log ON log.row_key = asked.row_key AND event_id <= "at" GROUP BY ALL
)
SELECT since.row_key, "at", event_type AS col, arg_max(v, event_id) AS value FROM since JOIN log ON log.row_key = since.row_key AND event_id <= "at" AND (f IS NULL OR event_id >= f) GROUP BY ALL
""")
def kv_rows_as_of(spark, d):
    """A log read at many times: every fourth mutation asks how its row stands then."""
    cols = F.create_map("event_type", F.col("event_id").cast("string")).alias("cols")
    log = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 0, "row").otherwise("cell").alias("op"), F.col("user_id").cast("string").alias("row_key"), cols)
    asked = log.where("seq % 4 = 1").select("row_key", F.col("seq").alias("at"))
    return kv.rows_as_of(log, asked).select("row_key", "at", F.explode("cols").alias("col", "value"))


@query("""
WITH m AS (
  SELECT client_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY client_id ORDER BY ts) > 1800000000 THEN 1 ELSE 0 END AS new FROM clicks WHERE ts IS NOT NULL
), s AS (
  SELECT client_id, ts, sum(new) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m
)
SELECT client_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_hits FROM s GROUP BY client_id, s
""")
def sessions_of_clients(spark, d):
    """Sessions of half an hour in ``clicks``, where a client may have a third of all rows."""
    return sessions.sessions(read(spark, d, "clicks"), key="client_id", idle=1800)


_PAUSE = 6 * 3600 * 1000
_ASKED = "SELECT CAST(user_id AS VARCHAR) AS host, CAST(event_id AS VARCHAR) AS url, epoch_us(ts) // 1000 AS asked, ts FROM events"
_GRANTS = f"""
WITH n AS (SELECT *, (row_number() OVER (PARTITION BY host ORDER BY ts, url) - 1) * {_PAUSE} AS shift FROM ({_ASKED}))
SELECT host, url, asked, max(asked - shift) OVER (PARTITION BY host ORDER BY ts, url ROWS UNBOUNDED PRECEDING) + shift AS granted FROM n
"""


def _attempts(events):
    return events.select(F.col("user_id").cast("string").alias("host"), F.col("event_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("ts"))


@query(_GRANTS)
def deferred(spark, d):
    """Each attempt with the time its user's pause lets it through."""
    return deferral.deferred(_attempts(read(spark, d, "events")), _PAUSE).select("host", "url", F.unix_millis("asked").alias("asked"), F.unix_millis("granted").alias("granted"))


@query(_GRANTS)
def deferred_stream(spark, d):
    """The same by a stream that queues attempts and sends them on by timers. A last row, later than any grant can be, lets the last timers go off."""
    for k, v in deferral.STORE.items():
        spark.conf.set(k, v)
    events = _attempts(read(spark, d, "events"))
    source, sink, checkpoint = new_path(spark, "arrivals"), new_path(spark, "deferred"), new_path(spark, "checkpoint")
    events.write.parquet(source)
    hosts = events.where("host is not null and ts is not null").groupBy("host").agg((F.unix_millis(F.max("ts")) + F.count("*") * _PAUSE).alias("last"))
    end = F.timestamp_millis(F.lit((hosts.agg(F.max("last")).first()[0] or 0) + 61 * 24 * 3600 * 1000))
    spark.range(1).select(F.lit("end").alias("host"), F.lit("end").alias("url"), end.alias("ts")).write.mode("append").parquet(source)
    arrivals = spark.readStream.schema(events.schema).parquet(source).withWatermark("ts", "60 days").where(F.col("ts") < end)  # the last row only moves the watermark
    done = deferral.deferred_stream(arrivals, _PAUSE, late=None).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
    done.awaitTermination()
    return spark.read.schema(deferral.GRANTED).parquet(sink).select("host", "url", F.unix_millis("asked").alias("asked"), F.unix_millis("granted").alias("granted"))


@query("""
SELECT l.event_id, l.user_id, l.ts, r.ts AS ping_ts, r.event_id AS view_id FROM events l JOIN events r ON l.user_id = r.user_id AND l.ts >= r.ts AND l.ts <= r.ts + INTERVAL 6 HOURS
WHERE l.event_type = 'purchase' AND r.event_type = 'view'
""")
def stream_stream_join(spark, d):
    """Purchases with the views of the six hours before, as two streams."""
    at = F.col("ts").cast("timestamp").alias("ts")
    bought = stream(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", at)
    views = stream(spark, d, "events").where("event_type = 'view'").select("user_id", at, F.col("event_id").alias("view_id"))
    met = joins.within_time(bought, views, within="6 hours", late="60 days")
    sink, checkpoint = new_path(spark, "met"), new_path(spark, "checkpoint")
    met.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    kinds = {c: F.col(c).cast("timestamp_ntz") for c in ("ts", "ping_ts")}
    return spark.read.schema(met.schema).parquet(sink).withColumns(kinds)


_STREAK = """
SELECT {key}sum(n) :: BIGINT AS n, max(n) :: BIGINT AS longest FROM (
  SELECT {key}{value}, count(*) AS n FROM (
    SELECT *, row_number() OVER ({part} ORDER BY {order}) - row_number() OVER (PARTITION BY {key}{value} ORDER BY {order}) AS island FROM {table}
  ) GROUP BY {key}{value}, island
) {group}
"""


@query(_STREAK.format(key="", value="l_returnflag", part="", order="l_orderkey, l_linenumber, l_returnflag", table="lineitem", group=""))
def bag_fold_tree(spark, d):
    """The longest run of one flag over all lines in order: a fold that is associative and does not commute."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return folds.Streak("l_returnflag").of(lines, ["l_orderkey", "l_linenumber", "l_returnflag"])


@query(_STREAK.format(key="client_id, ", value="status", part="PARTITION BY client_id", order="sold_at NULLS FIRST, sale_id, status NULLS FIRST", table="sales", group="GROUP BY client_id"))
def pair_fold_tree(spark, d):
    """The longest run of one status among each client's sales; a client may have a third of them."""
    return folds.Streak("status").of(read(spark, d, "sales").select("client_id", "sold_at", "sale_id", "status"), ["sold_at", "sale_id", "status"], ["client_id"])


@query("""
WITH n AS (SELECT count(*) AS n FROM lineitem), s AS (SELECT CASE WHEN n > 50000 THEN 45000 ELSE n // 2 END AS s FROM n),
     r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem)
SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '.' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS row_key, n - s > 25 AS has_next FROM r, n, s WHERE i >= s AND i < s + 25
""")
def kv_page_deep(spark, d):
    """A page from the middle of a table that is stored by ranges of its key."""
    lines = read(spark, d, "lineitem").select(F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("."), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("row_key"))
    n, path = lines.count(), new_path(spark, "ranked")
    kv.save_ranked(lines, path)
    return kv.page_ranked(spark, path, 45_000 if n > 50_000 else n // 2, 25)


@query("SELECT event_type, count(*) AS n, true AS items_close, true AS quantiles_close, true AS shared_close FROM events GROUP BY event_type")
def sketches_of_events(spark, d):
    """Sketches of each type and day, stored, merged to types, and held against exact figures: the errors are within four standard errors."""
    events = read(spark, d, "events")
    path, at = new_path(spark, "sketches"), [0.1, 0.5, 0.9]
    sketches.sketched(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], F.col("user_id"), F.col("value")).write.parquet(path)
    stored = spark.read.parquet(path)
    made = sketches.estimates(sketches.merged(stored, ["event_type"]), at)
    early, late = (sketches.merged(stored.where(f"day {op} date'2024-01-15'"), ["event_type"]) for op in ("<", ">="))
    made = made.join(sketches.shared_items(early, late, "event_type"), "event_type")
    seen = events.groupBy("event_type", "user_id").agg(F.bool_or(F.to_date("ts") < F.lit("2024-01-15")).alias("early"), F.bool_or(F.to_date("ts") >= F.lit("2024-01-15")).alias("late"))
    exact = seen.groupBy("event_type").agg(F.count("user_id").alias("users"), F.count_if(F.col("early") & F.col("late") & F.col("user_id").isNotNull()).alias("both"))
    below = events.join(made.select("event_type", "quantiles"), "event_type").groupBy("event_type").agg(*[F.avg((F.col("value") <= F.col("quantiles")[k]).cast("double")).alias(f"r{k}") for k in range(len(at))])
    close = lambda a, b, most: F.abs(a - b) <= most
    ranks = F.forall(F.array(*[close(F.col(f"r{k}"), F.lit(q), 0.02) for k, q in enumerate(at)]), lambda ok: ok)
    out = made.join(exact, "event_type").join(below, "event_type")
    return out.select("event_type", "n", close(F.col("n_items"), F.col("users"), 4 * 0.017 * F.col("users") + 1).alias("items_close"), ranks.alias("quantiles_close"), close(F.col("n_shared"), F.col("both"), 4 * 0.017 * F.col("users") + 1).alias("shared_close"))


@query(r"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, i) AS n, CAST(row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY i) AS INTEGER) AS pos, w AS piece FROM (
  SELECT conv_id, turn, text, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM conversations)
)
""")
def table_function(spark, d):
    """A one-to-many parser as a table function: the words of each conversation, numbered through its turns."""
    tables.register(spark)
    said = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return spark.sql(r"SELECT conv_id, turn, n, pos, piece FROM pieces(TABLE({said}) PARTITION BY conv_id ORDER BY (turn, text), 'text', '[ \\t\\n\\x0B\\f\\r]+')", said=said)


@query("""
SELECT '{"row_key":"' || c_name || '","cols":{"nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}}' AS line FROM customer WHERE c_name >= 'Customer#000000050' AND c_name < 'Customer#000000070'
UNION ALL SELECT c_mktsegment FROM customer WHERE c_name = 'Customer#000000007'
""")
def kv_command(spark, d):
    """The command line over a log of all customers: renamed, then scanned by range, then one cell asked for. What it says goes through the driver."""
    folder, said = new_path(spark, "tables"), []
    cols = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    kv.append(read(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.lit("row").alias("op"), F.col("c_name").alias("row_key"), cols.alias("cols")), f"{folder}/first")
    for words in (["rename", "first", "customers"], ["scan", "customers", "Customer#000000050", "Customer#000000070"], ["get", "customers", "Customer#000000007", "segment"]):
        command.run(spark, folder, words, said.append)
    return spark.createDataFrame([(line,) for line in said], "line string")


@query("""
SELECT DISTINCT CASE WHEN k = 0 THEN u ELSE u || '.missing' END AS url, CASE WHEN k = 0 THEN true END AS answered, CASE WHEN k = 0 THEN strlen(html) END AS content_length, CASE WHEN k = 0 THEN md5(html) END AS digest
FROM (SELECT regexp_replace(url, '#.*$', '') AS u, html FROM pages QUALIFY count(*) OVER (PARTITION BY regexp_replace(url, '#.*$', '')) = 1), (VALUES (0), (1)) v(k)
""")
def fetch_stored(spark, d):
    """A frontier of all pages that have an address of their own, and as many that nobody has, fetched from the stored web."""
    pages = read(spark, d, "pages").select(F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    own = pages.groupBy("url").agg(F.count("*").alias("n"), F.first("html").alias("html")).where("n = 1")
    frontier = own.select(F.explode(F.array("url", F.concat("url", F.lit(".missing")))).alias("url"))
    answers = crawl.stored(web.from_pages(own.select("url", "html")))(frontier)
    told = answers.select("url", (F.col("status") == 200).alias("answered"), "content_length", F.md5(F.col("page").cast("binary")).alias("digest"))
    return frontier.join(told, "url", "left")


@query("""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS row_key, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS status FROM orders
WHERE lpad(CAST(o_orderkey AS VARCHAR), 12, '0') >= '000000000100' AND lpad(CAST(o_orderkey AS VARCHAR), 12, '0') < '000000010000'
""")
def kv_row_log(spark, d):
    """All orders written as a log of rows, a third of them once more; read by a range of keys, the last row of each key counts."""
    rowlog.register(spark)
    orders, path = read(spark, d, "orders"), new_path(spark, "rowlog")
    row = lambda status: (F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("row_key"), F.create_map(F.lit("status"), status.cast("binary")).alias("cols"), F.lit(0).cast("long").alias("seq"))
    orders.select(*row(F.col("o_orderstatus"))).repartitionByRange("row_key").write.format("rowlog").mode("append").save(path)
    orders.where("o_orderkey % 3 = 0").select(*row(F.lit("again"))).write.format("rowlog").mode("append").save(path)
    log = spark.read.format("rowlog").load(path)
    return kv.latest_rows(kv.scan(log, "000000000100", "000000010000")).select("row_key", F.col("cols")["status"].cast("string").alias("status"))
