"""Charts, slots, snapshots, the job ledger and the query log over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import charts, snapshots
from tablewright.operators.guard import run_sql
from tablewright.operators.ledger import job_states, sweep_stale
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.slots import chart_points, evaluate_slots, slot_values
from tablewright.plans.registry import TABLES, Tables, register
from tablewright.session import work_folder
from tablewright.sources.connections import register_tables
from tablewright.sources.query_log import query_log_stats, read_query_log
from tablewright.streaming.feeds import log_windows, run_available


@register(
    "chart_series",
    """
SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS x, round(sum(o_totalprice), 2) AS y
FROM orders GROUP BY 1""",
)
def chart_series(tables: Tables) -> DataFrame:
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int")
    monthly = tables.orders.groupBy(month.alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return charts.series(monthly, "month", "revenue")


@register(
    "multi_series",
    """
WITH m AS (
  SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS x, sum(l_quantity) AS quantity,
         round(sum(l_extendedprice), 2) AS price, CAST(count(*) AS DOUBLE) AS items
  FROM lineitem GROUP BY 1)
SELECT x, 'quantity' AS series, quantity AS y FROM m
UNION ALL SELECT x, 'price', price FROM m
UNION ALL SELECT x, 'items', items FROM m""",
)
def multi_series(tables: Tables) -> DataFrame:
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int")
    monthly = tables.lineitem.groupBy(month.alias("month")).agg(
        F.sum("l_quantity").alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.count("*").alias("items"),
    )
    return charts.multi_series(monthly, "month", ["quantity", "price", "items"])


@register(
    "pie_share",
    """
SELECT c_mktsegment AS name, round(sum(c_acctbal), 2) AS total,
       round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 6) AS share
FROM customer GROUP BY c_mktsegment""",
)
def pie_share(tables: Tables) -> DataFrame:
    parts = charts.pie(tables.customer, "c_mktsegment", "c_acctbal")
    return parts.select("name", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


def _bin_sql(column: str, bins: int) -> str:
    return (
        f"CAST(least(floor((CAST({column} AS DOUBLE) - lo_{column}) / ((hi_{column} - lo_{column}) / {bins})) + 1, "
        f"{bins}) AS BIGINT)"
    )


@register(
    "histogram",
    f"""
SELECT bin, round(lo + (bin - 1) * w, 6) AS low, round(lo + bin * w, 6) AS high, n AS "rows" FROM (
  SELECT {_bin_sql("l_extendedprice", 20)} AS bin, any_value(lo_l_extendedprice) AS lo,
         any_value((hi_l_extendedprice - lo_l_extendedprice) / 20) AS w, count(*) AS n
  FROM lineitem, (SELECT min(l_extendedprice) AS lo_l_extendedprice, max(l_extendedprice) AS hi_l_extendedprice
                  FROM lineitem) r
  GROUP BY 1) b""",
)
def histogram(tables: Tables) -> DataFrame:
    bars = charts.histogram(tables.lineitem, "l_extendedprice", 20)
    return bars.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "rows")


@register("histogram_of_text", 'SELECT event_type AS bin, count(*) AS "rows" FROM events GROUP BY event_type')
def histogram_of_text(tables: Tables) -> DataFrame:
    return charts.histogram(tables.events, "event_type")


@register(
    "heatmap2d",
    f"""
SELECT {_bin_sql("l_quantity", 10)} AS x_bin, {_bin_sql("l_extendedprice", 10)} AS y_bin, count(*) AS "rows"
FROM lineitem, (SELECT min(l_quantity) AS lo_l_quantity, max(l_quantity) AS hi_l_quantity,
                       min(l_extendedprice) AS lo_l_extendedprice, max(l_extendedprice) AS hi_l_extendedprice
                FROM lineitem) r
GROUP BY 1, 2""",
)
def heatmap2d(tables: Tables) -> DataFrame:
    return charts.heatmap(tables.lineitem, "l_quantity", "l_extendedprice", 10)


@register(
    "box_stats",
    """
WITH q AS (
  SELECT l_returnflag AS x, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
         quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY 1)
SELECT x, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(l_extendedprice) FILTER (inside) AS whisker_low, max(l_extendedprice) FILTER (inside) AS whisker_high,
       count(*) FILTER (NOT inside) AS outliers
FROM (SELECT q.*, l_extendedprice,
             l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM lineitem JOIN q ON l_returnflag = x) j
GROUP BY x, n, q1, median, q3""",
)
def box_stats(tables: Tables) -> DataFrame:
    marks = charts.box(tables.lineitem, "l_returnflag", "l_extendedprice")
    return marks.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@register(
    "box_stats_with_outliers",
    """
WITH v AS (SELECT event_type, value * value * value AS cubed FROM events),
q AS (
  SELECT event_type AS x, count(*) AS n, quantile_cont(cubed, 0.25) AS q1,
         quantile_cont(cubed, 0.5) AS median, quantile_cont(cubed, 0.75) AS q3
  FROM v GROUP BY 1)
SELECT x, n, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3,
       round(min(cubed) FILTER (inside), 8) AS whisker_low, round(max(cubed) FILTER (inside), 8) AS whisker_high,
       count(*) FILTER (NOT inside) AS outliers
FROM (SELECT q.*, cubed, cubed BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM v JOIN q ON event_type = x) j
GROUP BY x, n, q1, median, q3""",
)
def box_outliers(tables: Tables) -> DataFrame:
    cubed = tables.events.select("event_type", (F.col("value") * F.col("value") * F.col("value")).alias("cubed"))
    marks = charts.box(cubed, "event_type", "cubed")
    return marks.withColumns({c: F.round(c, 8) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@register(
    "exact_quantiles",
    """
SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.01), 7) AS p01,
       round(quantile_cont(o_totalprice, 0.5), 7) AS p50, round(quantile_cont(o_totalprice, 0.999), 7) AS p999
FROM orders GROUP BY o_orderpriority""",
)
def quantiles(tables: Tables) -> DataFrame:
    found = exact_quantiles(tables.orders, "o_orderpriority", "o_totalprice", [0.01, 0.5, 0.999])
    return found.select(
        "o_orderpriority", "n",
        *[F.round(F.col("quantiles")[i], 7).alias(name) for i, name in enumerate(("p01", "p50", "p999"))],
    )


@register(
    "inline_chart_points",
    "SELECT o_orderstatus AS x, count(*) AS y FROM orders GROUP BY o_orderstatus",
)
def inline_points(tables: Tables) -> DataFrame:
    grouped = tables.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("unused"))
    return chart_points(grouped)


SLOTS = [
    {"slot": "revenue", "sql": "SELECT sum(o_totalprice) FROM orders"},
    {"slot": "typical", "sql": "SELECT avg(o_totalprice) FROM orders"},
    {"slot": "value", "sql": "SELECT max(value) FROM events"},
    {"slot": "orders", "sql": "SELECT count(*), 'unused' FROM orders"},
    {"slot": "status", "sql": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus ORDER BY count(*) DESC, 1"},
    {"slot": "none", "sql": "SELECT o_orderkey FROM orders WHERE o_totalprice < 0"},
    {
        "slot": "by status",
        "sql": "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus",
        "format": "chart",
    },
    {
        "slot": "segments",
        "sql": "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1",
        "format": "table",
    },
]


@register(
    "slot_scalars",
    """
SELECT 'revenue' AS slot, 'scalar' AS format, concat('$', format('{:,.1f}', sum(o_totalprice) / 1e6), 'M') AS rendered FROM orders
UNION ALL SELECT 'typical', 'scalar', format('{:,.0f}', avg(o_totalprice)) FROM orders
UNION ALL SELECT 'value', 'scalar', format('{:,.2f}', max(value)) FROM events
UNION ALL SELECT 'orders', 'scalar', CAST(count(*) AS VARCHAR) FROM orders
UNION ALL (SELECT 'status', 'scalar', o_orderstatus FROM orders GROUP BY 3 ORDER BY count(*) DESC, 3 LIMIT 1)
UNION ALL SELECT 'none', 'scalar', '—'
UNION ALL SELECT 'by status', 'chart', concat('{"x":["', string_agg(o_orderstatus, '","' ORDER BY o_orderstatus), '"],"y":[',
  string_agg(CAST(n AS VARCHAR), ',' ORDER BY o_orderstatus), '],"type":"bar","name":"by status"}')
  FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) t
UNION ALL SELECT 'segments', 'table', concat('[', string_agg(concat('{"segment":"', c_mktsegment, '","n":', n, '}'), ',' ORDER BY c_mktsegment), ']')
  FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) t""",
)
def slots(tables: Tables) -> DataFrame:
    register_tables({name: getattr(tables, name) for name in TABLES if name in ("orders", "events", "customer")})
    return slot_values(tables.spark, SLOTS)


@register("snapshot_restore", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def snapshot_restore(tables: Tables) -> DataFrame:
    """Orders are saved, then a changed copy is saved later; the first is restored by name."""
    root, spark, orders = work_folder(tables.spark), tables.spark, tables.orders
    snapshots.checkpoint(spark, root, "before pivot", {"orders": orders}, datetime(2024, 1, 1))
    snapshots.checkpoint(spark, root, "after", {"orders": orders.where("o_orderstatus = 'F'")}, datetime(2024, 1, 2))
    restored = snapshots.rollback(spark, root, "before pivot")
    return restored["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("snapshot_newest", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def snapshot_newest(tables: Tables) -> DataFrame:
    root, spark, orders = work_folder(tables.spark), tables.spark, tables.orders
    for day, status in ((1, "F"), (3, "P"), (2, "P"), (4, "O")):
        part = {"orders": orders.where(F.col("o_orderstatus") == status)}
        snapshots.checkpoint(spark, root, "same" if day == 4 else f"s{day}", part, datetime(2024, 1, day))
    return snapshots.rollback(spark, root)["orders"].select("o_orderkey", "o_orderstatus")


@register(
    "snapshots_listed",
    """SELECT DISTINCT concat('orders_', o_orderstatus) AS name, '2024-01-03' AS created FROM orders
    UNION ALL SELECT 'all_orders', '2024-01-01' FROM (SELECT 1) t""",
)
def snapshots_listed(tables: Tables) -> DataFrame:
    """Snapshots of all orders and of each status, one of them taken twice; names are made safe."""
    root, spark, orders = work_folder(tables.spark), tables.spark, tables.orders
    snapshots.checkpoint(spark, root, "all orders", {"orders": orders}, datetime(2024, 1, 1))
    for day in (2, 3):
        for status in ("F", "O", "P"):
            part = {"orders": orders.where(F.col("o_orderstatus") == status)}
            snapshots.checkpoint(spark, root, f"orders {status}", part, datetime(2024, 1, day))
    return snapshots.list_checkpoints(spark, root).select("name", F.date_format("created", "yyyy-MM-dd").alias("created"))


@register(
    "snapshot_diff",
    """
SELECT o_orderkey, o_orderstatus, 'removed' AS change FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'X', 'added' FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, 'removed' FROM orders WHERE o_orderstatus = 'F'""",
)
def snapshot_diff(tables: Tables) -> DataFrame:
    before = tables.orders.select("o_orderkey", "o_orderstatus")
    changed = F.when(F.col("o_orderstatus") == "F", "X").otherwise(F.col("o_orderstatus"))
    after = before.where("o_orderstatus <> 'P'").select("o_orderkey", changed.alias("o_orderstatus"))
    return snapshots.diff(before, after)


def job_events(tables: Tables) -> DataFrame:
    """Users stand for jobs and their events for its states."""
    status = (
        F.when(F.col("event_type") == "signup", "pending")
        .when(F.col("event_type").isin("view", "click"), "running")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("failed")
    )
    return tables.events.select(
        F.col("user_id").alias("id"), F.lit("looker").alias("source"), status.alias("status"),
        F.col("ts").alias("at"), F.col("props").alias("progress"),
    )


STATE_SQL = """
SELECT id, started, CASE WHEN status IN ('completed', 'failed') THEN last_at END AS finished, status,
       CASE WHEN status NOT IN ('completed', 'failed') THEN progress END AS progress
FROM (
  SELECT user_id AS id, min(ts) AS started, max(ts) AS last_at, arg_max(props, ts) AS progress,
         CASE arg_max(event_type, ts) WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
           WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status
  FROM events GROUP BY user_id) s"""


@register("job_latest_state", f"SELECT id, started, status, progress FROM ({STATE_SQL}) j ORDER BY started DESC, id LIMIT 50")
def job_latest(tables: Tables) -> DataFrame:
    """The newest 50 jobs; the limit is the ledger's."""
    return job_states(job_events(tables)).select("id", F.col("started_at").alias("started"), "status", "progress")


@register(
    "job_stale_sweep",
    f"""
SELECT id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status,
       CASE WHEN status IN ('pending', 'running') THEN TIMESTAMP '2024-02-01' ELSE finished END AS finished,
       CASE WHEN status IN ('pending', 'running') THEN 'Server restarted while job was running' END AS error,
       CAST(NULL AS VARCHAR) AS progress
FROM ({STATE_SQL}) j""",
)
def job_sweep(tables: Tables) -> DataFrame:
    states = job_states(job_events(tables), keep=None)
    swept = sweep_stale(states, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))
    return swept.select("id", "status", F.col("finished_at").alias("finished"), "error", "progress")


def event_log(tables: Tables) -> DataFrame:
    """Events as a query log; the event's type leads the statement."""
    return tables.events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("-- run\n"), "event_type", F.lit(" "), "props").alias("query"),
        F.col("user_id").alias("rows"),
        F.col("value").alias("elapsed_ms"),
    )


@register(
    "query_log_stats",
    """
SELECT strftime(ts, '%Y-%m-%d') AS day, upper(event_type) AS first_word, count(*) AS runs,
       CAST(sum(user_id) AS BIGINT) AS "rows", round(avg(value), 9) AS avg_ms,
       quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms
FROM events GROUP BY 1, 2""",
)
def log_stats(tables: Tables) -> DataFrame:
    stats = query_log_stats(event_log(tables))
    return stats.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "avg_ms": F.round("avg_ms", 9)})


@register(
    "query_log_windows",
    """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, upper(event_type) AS first_word,
       count(*) AS runs, CAST(sum(user_id) AS BIGINT) AS "rows", max(value) AS max_ms
FROM events GROUP BY 1, 2""",
)
def log_hours(tables: Tables) -> DataFrame:
    """The log read as a stream until nothing is left, its windows written to the shared folder."""
    folder = work_folder(tables.spark)
    event_log(tables).write.json(f"{folder}/log")
    stream = tables.spark.readStream.schema("timestamp timestamp, query string, rows bigint, elapsed_ms double")
    windows = log_windows(stream.json(f"{folder}/log"), late="40 days")
    # Complete windows come out when the watermark passes; the last ones on a closing row.
    closing = tables.spark.createDataFrame(
        [(datetime(2030, 1, 1), "", 0, 0.0)], "timestamp timestamp, query string, rows bigint, elapsed_ms double"
    )
    run_available(windows, f"{folder}/out", f"{folder}/state").awaitTermination()
    closing.write.mode("append").json(f"{folder}/log")
    run_available(windows, f"{folder}/out", f"{folder}/state").awaitTermination()
    written = tables.spark.read.parquet(f"{folder}/out")
    return written.where("first_word <> ''").select(
        F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "first_word", "runs", "rows", "max_ms"
    )


AUDITED = [
    ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", 5000),
    ("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem", 1000),
    ("SELECT * FROM events ORDER BY event_id LIMIT 7000", 10),
]


@register(
    "query_audit",
    """
SELECT 'SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey' AS query,
       least(count(DISTINCT o_custkey), 5000) AS "rows", count(DISTINCT o_custkey) > 5000 AS truncated FROM orders
UNION ALL SELECT 'SELECT DISTINCT l_partkey, l_suppkey FROM lineitem', least(count(*), 1000), count(*) > 1000
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) t
UNION ALL SELECT 'SELECT * FROM events ORDER BY event_id LIMIT 7000', least(count(*), 7000), false FROM events""",
)
def query_audit(tables: Tables) -> DataFrame:
    """Runs that are logged, read back from the log beside their truncation flags."""
    register_tables({name: getattr(tables, name) for name in ("orders", "lineitem", "events")})
    log = f"{work_folder(tables.spark)}/log"
    flags = []
    for query, limit in AUDITED:
        run = run_sql(tables.spark, query, limit, log)
        run.release()
        flags.append((query, run.truncated))
    marked = tables.spark.createDataFrame(flags, "query string, truncated boolean")
    return read_query_log(tables.spark, log).join(marked, "query").select("query", "rows", "truncated")


@register(
    "slot_over_cap",
    """SELECT 'region' AS slot, 'scalar' AS format, max(r_name) AS rendered, false AS failed FROM region
    UNION ALL SELECT 'lines', 'chart', NULL, true UNION ALL SELECT 'rows', 'table', NULL, true
    UNION ALL SELECT 'write', 'scalar', NULL, true""",
)
def slot_over_cap(tables: Tables) -> DataFrame:
    """A chart and a table of more rows than they may hold, and a refused write, fail by themselves."""
    tables.lineitem.createOrReplaceTempView("slot_lines")
    tables.region.createOrReplaceTempView("slot_regions")
    slots = [
        {"slot": "region", "sql": "SELECT max(r_name) FROM slot_regions"},
        {"slot": "lines", "sql": "SELECT l_orderkey, l_quantity FROM slot_lines", "format": "chart"},
        {"slot": "rows", "sql": "SELECT l_orderkey FROM slot_lines", "format": "table"},
        {"slot": "write", "sql": "SELECT 1 AS x) INSERT INTO slot_lines WITH g AS (SELECT 1"},
    ]
    done = evaluate_slots(tables.spark, slots)
    return done.select("slot", "format", "rendered", F.col("error").isNotNull().alias("failed"))


TIME_BIN_SQL = """least(CAST(floor((CAST(epoch_us(ts) AS DOUBLE) - lo) / ((hi - lo) / 24)) AS BIGINT) + 1, 24)"""
TIME_RANGE_SQL = "(SELECT CAST(min(epoch_us(ts)) AS DOUBLE) AS lo, CAST(max(epoch_us(ts)) AS DOUBLE) AS hi FROM events) r"


@register("histogram_of_times", f'SELECT {TIME_BIN_SQL} AS bin, count(*) AS "rows" FROM events, {TIME_RANGE_SQL} GROUP BY 1')
def histogram_of_times(tables: Tables) -> DataFrame:
    return charts.histogram(tables.events, "ts", 24).select("bin", "rows")


@register(
    "heatmap_of_times",
    f'SELECT {TIME_BIN_SQL} AS x_bin, event_type AS y_bin, count(*) AS "rows" FROM events, {TIME_RANGE_SQL} GROUP BY 1, 2',
)
def heatmap_of_times(tables: Tables) -> DataFrame:
    return charts.heatmap(tables.events, "ts", "event_type", 24)
