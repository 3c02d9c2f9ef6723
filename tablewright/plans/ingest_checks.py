"""Dashboard payloads made from the given tables, read back by the extractors and loaded.

One payload per row: nothing is gathered to make them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.ingest import charts as ch
from tablewright.ingest.load import chart_questions, chart_rows, counters, load, pattern_rows, rebuild, select_sources
from tablewright.operators.catalog import table_docs, union_all
from tablewright.operators.embed import simplify_sql
from tablewright.plans.knowledge_checks import LETTERS_SQL, NOW, THEN, at, label_batch, label_index, letter_counts
from tablewright.plans.registry import Tables, register
from tablewright.session import work_folder
from tablewright.sources.files import read_dashboards, read_dictionary, rows_from_json_texts
from tablewright.sources.patterns import (
    delete_patterns, find_pattern, pattern_records, patterns_of, rename_patterns, write_patterns,
)
from tablewright.sources.store import index_version, read_index, read_table
from tablewright.streaming.feeds import ingest_stream

TODAY = date(2024, 2, 1)
JSON_NULLS = {"ignoreNullFields": "true"}
LONG_SQL = "concat('SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = ', p_partkey)"


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), JSON_NULLS)


def _struct(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def dealt(table: DataFrame) -> DataFrame:
    """A table's rows in parts for all cores: a payload costs far more to make and to read than its row, and
    a small file, or one written as a single block, has all its rows in one part."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(2 * cores, table._jdf.rdd().getNumPartitions()))


def lakeview_payloads(tables: Tables) -> DataFrame:
    """Each part is a dashboard: a dataset in lines, one by display name, a short one; widgets
    with a known, an unknown and no reference, a filter and an untitled one. Half are broken or
    have no dataset, by part type."""
    main = F.concat(F.lit("main "), "p_brand")
    lines = F.array(F.lit("SELECT p_size, count(*)  "), F.concat(F.lit("FROM part WHERE p_partkey = "), "p_partkey", F.lit("\t")))
    nothing = F.lit(None).cast("string")
    no_lines = F.lit(None).cast("array<string>")
    datasets = F.array(
        _struct(name=main, displayName=F.lit("x"), queryLines=lines, query=nothing),
        _struct(name=nothing, displayName=F.lit("second"), queryLines=no_lines,
                query=F.concat(F.lit("SELECT min(p_retailprice) FROM part "), "p_type")),
        _struct(name=F.lit("short"), displayName=nothing, queryLines=no_lines, query=F.lit("SELECT 1 FROM part t")),
    )

    def widget(name, title, kind, *references):
        queries = F.array(*[_struct(query=_struct(datasetName=r)) for r in references])
        return _struct(widget=_struct(
            name=name, displayName=F.lit("Shown name"),
            spec=_struct(widgetType=F.lit(kind), frame=_struct(title=title)), queries=queries,
        ))

    first = _struct(layout=F.array(
        widget(F.lit("w1"), F.col("p_name"), "bar", F.lit(""), main),
        widget(F.lit("w2"), F.lit("Untitled"), "bar", main),
        widget(F.lit("w3"), F.lit("Pick one"), "filter-single", main),
    ))
    second = _struct(layout=F.array(
        widget(F.concat(F.lit("w4-"), "p_size"), F.lit(""), "line", F.lit("second")),
        widget(nothing, F.lit("No such data"), "table", F.lit("short")),
        widget(F.lit("w6"), F.lit("Total of all"), "table", nothing),
    ))
    whole = _json(datasets=datasets, pages=F.array(first, second))
    serialized = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("{broken "), "p_name"))
        .when(F.col("p_type") == "SMALL", _json(datasets=F.slice(datasets, 3, 1), pages=F.array(first)))
        .otherwise(whole)
    )
    shown_name = F.when(F.col("p_size") > 10, F.col("p_brand"))
    return dealt(tables.part).select(
        F.concat(F.lit("dash-"), "p_partkey").alias("dashboard_id"),
        shown_name.alias("display_name"),
        serialized.alias("serialized"),
    )


LAKEVIEW_SQL = """
WITH d AS (
  SELECT concat('dash-', p_partkey) AS dashboard_id,
         CASE WHEN p_size > 10 THEN p_brand ELSE concat('Dashboard ', left(concat('dash-', p_partkey), 8)) END
           AS dashboard_title,
         concat('SELECT p_size, count(*)', chr(10), 'FROM part WHERE p_partkey = ', p_partkey) AS main,
         concat('SELECT min(p_retailprice) FROM part ', p_type) AS second, p_name, p_size
  FROM part WHERE p_type NOT IN ('PROMO', 'SMALL'))
SELECT dashboard_id, dashboard_title, 'w1' AS element_id, p_name AS element_title, main AS sql FROM d
UNION ALL SELECT dashboard_id, dashboard_title, concat('w4-', p_size), 'Shown name', second FROM d
UNION ALL SELECT dashboard_id, dashboard_title, 'No such data', 'No such data', main FROM d
UNION ALL SELECT dashboard_id, dashboard_title, 'w6', 'Total of all', main FROM d"""


@register("lakeview_extract", LAKEVIEW_SQL)
def lakeview(tables: Tables) -> DataFrame:
    return ch.lakeview_charts(lakeview_payloads(tables))


USAGE_SQL = """
SELECT CAST(user_id AS VARCHAR) AS dashboard_id,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS view_count
FROM events
WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY AND user_id <> 7
GROUP BY 1
HAVING sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) >= 2000"""


def usage(tables: Tables) -> DataFrame:
    """Users stand for dashboards; user 7's are blank and so left out."""
    board = F.when(F.col("user_id") == 7, "").otherwise(F.col("user_id").cast("string"))
    history = tables.events.select(
        board.alias("dashboard_id"),
        F.get_json_object("props", "$.k").cast("int").alias("runs"),
        F.col("ts").alias("at"),
    )
    now = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    return ch.usage_counts(history, now, lookback_days=20, min_views=2000)


@register("usage_filter", USAGE_SQL)
def usage_filter(tables: Tables) -> DataFrame:
    return usage(tables)


def looker_payloads(tables: Tables) -> DataFrame:
    """Customers stand for dashboards, with their query on the element or its result maker."""
    sql = F.concat(F.lit("SELECT count(*) AS orders FROM orders WHERE o_custkey = "), "c_custkey")
    query = _struct(id=F.lit("q"), sql=sql)
    none = F.lit(None).cast(query_type := "struct<id:string,sql:string>")

    def element(name, title, own, made):
        return _struct(id=F.lit(name), title=title, query=own.cast(query_type), result_maker=_struct(query=made.cast(query_type)))

    elements = F.array(
        element("e1", F.col("c_name"), query, none),
        element("e2", F.lit("Made"), none, query),
        element("e3", F.lit("UNTITLED"), query, none),
        element("e4", F.lit("Short"), _struct(id=F.lit("s"), sql=F.lit("SELECT 1")), query),
        element("e5", F.lit("Nothing"), none, none),
    )
    title = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("")
    return tables.customer.select(
        _json(id=F.col("c_custkey").cast("string"), title=title, elements=elements).alias("payload")
    )


@register(
    "looker_extract",
    f"""
WITH used AS ({USAGE_SQL}),
d AS (
  SELECT CAST(c_custkey AS VARCHAR) AS dashboard_id, c_name, view_count,
         CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE concat('Dashboard ', c_custkey) END AS dashboard_title,
         concat('SELECT count(*) AS orders FROM orders WHERE o_custkey = ', c_custkey) AS sql
  FROM customer JOIN used ON dashboard_id = CAST(c_custkey AS VARCHAR))
SELECT dashboard_id, dashboard_title, 'e1' AS element_id, c_name AS element_title, sql, view_count FROM d
WHERE length(sql) >= 50
UNION ALL SELECT dashboard_id, dashboard_title, 'e2', 'Made', sql, view_count FROM d WHERE length(sql) >= 50""",
)
def looker(tables: Tables) -> DataFrame:
    return ch.looker_charts(looker_payloads(tables), usage(tables))


def redash_payloads(tables: Tables) -> DataFrame:
    """Orders stand for dashboards that show their customer's query, after a text widget and a
    short query; so a query is on many dashboards."""
    sql = F.concat(F.lit("SELECT sum(o_totalprice) FROM orders WHERE customer = "), "o_custkey")
    none = F.lit(None).cast("string")

    def widget(name, id_, query_name, text):
        return _struct(visualization=_struct(name=name, query=_struct(id=id_, name=query_name, query=text)))

    widgets = F.array(
        _struct(visualization=F.lit(None).cast(
            "struct<name:string,query:struct<id:string,name:string,query:string>>")),
        widget(F.lit("short"), F.lit("s"), F.lit("short"), F.lit("SELECT 1")),
        widget(F.concat(F.lit("by "), "o_orderkey"), F.col("o_custkey").cast("string"),
               F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(none), sql),
        widget(F.lit("again"), F.col("o_custkey").cast("string"), none, sql),
    )
    name = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return dealt(tables.orders).select(
        F.col("o_orderkey").alias("position"),
        _json(slug=F.concat(F.lit("s"), "o_orderkey"), name=name, widgets=widgets).alias("payload"),
    )


REDASH_SQL = """
SELECT concat('s', o_orderkey) AS dashboard_id,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE concat('Dashboard s', o_orderkey) END AS dashboard_title,
       CAST(o_custkey AS VARCHAR) AS element_id,
       CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE concat('by ', o_orderkey) END AS element_title,
       concat('SELECT sum(o_totalprice) FROM orders WHERE customer = ', o_custkey) AS sql
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"""


@register("first_seen_dedupe", REDASH_SQL)
def redash(tables: Tables) -> DataFrame:
    return ch.redash_charts(redash_payloads(tables))


@register(
    "dashboard_limit",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate IN "
    "(SELECT DISTINCT o_orderdate FROM orders ORDER BY o_orderdate LIMIT 25)",
)
def dashboard_limit(tables: Tables) -> DataFrame:
    """The first 25 listing positions, here order dates; the limit is the feature."""
    return ch.first_dashboards(tables.orders, 25, "o_orderdate").select("o_orderkey", "o_orderstatus")


EVENT_SQL = "concat('SELECT avg(value) FROM events WHERE kind = ', event_type, ' AND id = ', event_id)"


def superset_payloads(tables: Tables) -> DataFrame:
    sql = F.expr(EVENT_SQL)
    empty = F.lit("")
    params = (
        F.when(F.col("event_type") == "view", _json(sql=sql, query=F.lit("other")))
        .when(F.col("event_type") == "click", _json(sql=empty, query=sql))
        .when(F.col("event_type") == "error", F.concat(F.lit("{bad "), sql))
        .otherwise(_json(viz=F.lit("bar")))
    )
    context = F.when(F.col("event_type").isin("error", "purchase", "view"), _json(query=sql)).otherwise("not json")
    return tables.events.select(
        F.col("user_id").alias("dashboard_id"),
        F.when(F.col("value") > 20, F.col("event_type")).alias("dashboard_title"),
        F.col("event_id").alias("id"),
        F.when(F.col("value") > 2, F.concat(F.lit("Chart "), "event_type")).otherwise("").alias("slice_name"),
        params.alias("params"),
        context.alias("query_context"),
    )


@register(
    "superset_coalesce",
    f"""
SELECT CAST(user_id AS VARCHAR) AS dashboard_id,
       CASE WHEN value > 20 THEN event_type ELSE concat('Dashboard ', user_id) END AS dashboard_title,
       CAST(event_id AS VARCHAR) AS element_id, concat('Chart ', event_type) AS element_title, {EVENT_SQL} AS sql
FROM events
WHERE event_type <> 'signup' AND value > 2 AND length({EVENT_SQL}) >= 50""",
)
def superset(tables: Tables) -> DataFrame:
    return ch.superset_charts(superset_payloads(tables))


def mode_payloads(tables: Tables) -> DataFrame:
    """Each part is a report with two queries, as a bare list or wrapped, by type."""
    sql = F.expr(LONG_SQL)

    def query(token, name, text):
        return _struct(token=F.lit(token), name=name, raw_query=text)

    listed = F.array(
        query("q1", F.col("p_name"), sql),
        query("q2", F.lit(None).cast("string"), sql),
        query("q3", F.lit("Short"), F.lit("SELECT 1")),
        query("q4", F.lit("Also"), F.concat(sql, F.lit(" LIMIT 5"))),
    )
    bare = F.col("p_type").isin("ECONOMY", "SMALL")
    payload = F.when(bare, F.to_json(listed)).otherwise(_json(_embedded=_struct(queries=listed)))
    return dealt(tables.part).select(
        F.concat(F.lit("r"), "p_partkey").alias("token"),
        F.when(F.col("p_size") > 5, F.col("p_brand")).alias("name"),
        payload.alias("payload"),
    )


MODE_SQL = f"""
WITH r AS (
  SELECT concat('r', p_partkey) AS dashboard_id, p_name, {LONG_SQL} AS sql,
         CASE WHEN p_size > 5 THEN p_brand ELSE concat('Report r', p_partkey) END AS dashboard_title
  FROM part)
SELECT dashboard_id, dashboard_title, 'q1' AS element_id, p_name AS element_title, sql FROM r WHERE length(sql) >= 50
UNION ALL
SELECT dashboard_id, dashboard_title, 'q4', 'Also', concat(sql, ' LIMIT 5') FROM r"""


@register("mode_extract", MODE_SQL)
def mode(tables: Tables) -> DataFrame:
    return ch.mode_charts(mode_payloads(tables))


@register(
    "sigma_extract",
    """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS dashboard_id,
       CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE concat('Workbook ', o_custkey) END AS dashboard_title,
       o_orderstatus AS element_id, concat('Orders ', o_orderstatus) AS element_title,
       concat('SELECT * FROM orders WHERE key = ', o_custkey, ' AND status = ', o_orderstatus) AS sql
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O')
  AND length(concat('SELECT * FROM orders WHERE key = ', o_custkey, ' AND status = ', o_orderstatus)) >= 50""",
)
def sigma(tables: Tables) -> DataFrame:
    """Customers stand for workbooks; the queries found by key are those of orders they have."""

    def element(id_, name):
        return _struct(elementId=F.lit(id_), name=F.lit(name))

    listed = F.array(element("F", "Orders F"), element("O", "Orders O"), element("P", ""), element("", "No id"))
    payload = F.when(F.col("c_mktsegment") == "BUILDING", F.to_json(listed)).otherwise(_json(entries=listed))
    workbooks = dealt(tables.customer).select(
        F.col("c_custkey").cast("string").alias("workbook_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("name"),
        payload.alias("payload"),
    )
    text = F.concat(F.lit("SELECT * FROM orders WHERE key = "), "workbook_id", F.lit(" AND status = "), "element_id")
    queries = (
        tables.orders.select(F.col("o_custkey").cast("string").alias("workbook_id"), F.col("o_orderstatus").alias("element_id"))
        .distinct()
        .withColumn("sql", text)
    )
    return ch.sigma_charts(workbooks, queries)


def all_charts(tables: Tables) -> DataFrame:
    found = {
        "databricks": ch.lakeview_charts(lakeview_payloads(tables)),
        "redash": ch.redash_charts(redash_payloads(tables)),
        "mode": ch.mode_charts(mode_payloads(tables)),
    }
    return union_all(df.withColumn("source", F.lit(source)) for source, df in found.items())


ALL_CHARTS_SQL = f"""
SELECT *, 'databricks' AS source, 'dbr-' AS prefix FROM ({LAKEVIEW_SQL}) a
UNION ALL BY NAME SELECT *, 'redash' AS source, 'rds-' AS prefix FROM ({REDASH_SQL}) b
UNION ALL BY NAME SELECT *, 'mode' AS source, 'mode-' AS prefix FROM ({MODE_SQL}) c"""
ID_SQL = "concat(prefix, left(sha256(concat_ws(':', source, dashboard_id, element_id)), 16))"


@register(
    "dry_run",
    f"SELECT {ID_SQL} AS id, source, element_title, dashboard_title FROM ({ALL_CHARTS_SQL}) c",
)
def dry_run(tables: Tables) -> DataFrame:
    return chart_questions(all_charts(tables)).select("id", "source", "element_title", "dashboard_title")


def first_lines(sql: str, title: str) -> str:
    """A stand-in for a model's rewrite: fenced, blank for some titles, failing for others."""
    if title.startswith("red"):
        return "``` ```"
    if title.startswith("old"):
        raise RuntimeError("no answer")
    return f"```sql\n{sql}\n\n\n-- {title}\n```"


@register(
    "simplified_sql",
    f"""
SELECT p_partkey, CASE WHEN p_name LIKE 'red%' OR p_name LIKE 'old%' THEN {LONG_SQL}
  ELSE concat({LONG_SQL}, chr(10), chr(10), chr(10), '-- ', p_name) END AS sql
FROM part""",
)
def simplified(tables: Tables) -> DataFrame:
    raw = tables.part.select("p_partkey", F.col("p_name").alias("element_title"), F.expr(LONG_SQL).alias("sql"))
    return simplify_sql(raw, first_lines).select("p_partkey", "sql")


def picky(texts: list[str]) -> list[list[float]]:
    """Refuses one dashboard's charts, as a model refuses some inputs."""
    if any("Brand#13" in t for t in texts):
        raise ValueError("refused")
    return letter_counts(texts)


def dashboard_load(tables: Tables):
    charts = all_charts(tables)
    stored = chart_rows(charts.where("source = 'mode'")).drop("embed_text").withColumns(
        {
            "embedding": F.array(F.lit(1.0)),
            "created_at": at(THEN),
            "updated_at": at(THEN),
        }
    )
    return load(chart_rows(charts), stored, picky, at(NOW), wait=(0.0, 0.0))


LOADED_SQL = f"""
WITH charts AS ({ALL_CHARTS_SQL}),
rows_in AS (SELECT {ID_SQL} AS id, *, contains(element_title || dashboard_title || sql, 'Brand#13') AS bad FROM charts)
"""


@register(
    "dashboard_load",
    LOADED_SQL
    + """
SELECT id, source, dashboard_title AS dashboard, element_title AS description, sql,
       CASE WHEN bad THEN 1 ELSE 26 END AS size,
       CASE WHEN source = 'mode' THEN '2024-01-01' ELSE '2024-02-01' END AS created,
       CASE WHEN bad THEN '2024-01-01' ELSE '2024-02-01' END AS updated
FROM rows_in WHERE NOT bad OR source = 'mode'""",
)
def loaded(tables: Tables) -> DataFrame:
    index = dashboard_load(tables).index
    return index.select(
        "id", "source", "dashboard", "description", "sql", F.size("embedding").alias("size"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@register(
    "ingest_counters",
    LOADED_SQL
    + """
SELECT CASE WHEN grouping(source) = 0 THEN source END AS source,
       count(*) FILTER (NOT bad AND source <> 'mode') AS created,
       count(*) FILTER (NOT bad AND source = 'mode') AS updated,
       CAST(0 AS BIGINT) AS skipped,
       count(*) FILTER (bad) AS errors
FROM rows_in GROUP BY ROLLUP (source)""",
)
def load_counters(tables: Tables) -> DataFrame:
    return dashboard_load(tables).counters


@register(
    "failed_rows",
    LOADED_SQL + "SELECT id, source, 'ValueError: refused' AS error FROM rows_in WHERE bad",
)
def failed_rows(tables: Tables) -> DataFrame:
    return dashboard_load(tables).failed.select("id", "source", "error")


@register(
    "skip_existing",
    """
SELECT source, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(created) AS BIGINT) AS created FROM (
  SELECT 'loaded' AS source, CASE WHEN label < 5 THEN 1 ELSE 0 END AS skipped, CASE WHEN label < 5 THEN 0 ELSE 1 END AS created
  FROM embeddings) t
GROUP BY ROLLUP (source)""",
)
def skip_existing(tables: Tables) -> DataFrame:
    batch = label_batch(tables).where("seq = 2").select(
        "id", "question", F.lit("").alias("sql"), "source", F.lit("").alias("dashboard"),
        F.lit("").alias("description"), F.col("question").alias("embed_text"),
    )
    done = load(batch, label_index(tables), letter_counts, at(NOW), skip_existing=True)
    return done.counters.select("source", "skipped", "created")


@register(
    "outcome_counters",
    """
SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END AS source,
       count(*) FILTER (o_orderstatus = 'F') AS created, count(*) FILTER (o_orderstatus = 'O') AS updated,
       count(*) FILTER (o_orderstatus = 'P') AS skipped, CAST(0 AS BIGINT) AS errors
FROM orders GROUP BY ROLLUP (o_orderpriority)""",
)
def outcomes(tables: Tables) -> DataFrame:
    named = F.element_at(
        F.create_map(*[F.lit(v) for v in ("F", "created", "O", "updated", "P", "skipped")]), F.col("o_orderstatus")
    )
    return counters(tables.orders.select(F.col("o_orderpriority").alias("source"), named.alias("outcome")))


PATTERN_SQL = """
SELECT concat(replace(p_name, ' ', '-'), '-of-', lower(replace(p_brand, '#', '')), '.sql') AS filename,
       max_by(concat('How many ', p_type), p_partkey) AS description,
       max_by(concat('SELECT ', p_partkey), p_partkey) AS sql
FROM part GROUP BY 1"""


def saved_patterns(tables: Tables) -> DataFrame:
    rows = tables.part.select(
        F.concat(F.initcap("p_name"), F.lit("  of "), "p_brand", F.lit("?")).alias("question"),
        F.concat(F.lit("SELECT "), "p_partkey").alias("sql"),
        F.concat(F.lit("How many "), "p_type").alias("description"),
        "p_partkey",
    )
    return pattern_records(rows, TODAY, "p_partkey")


@register("pattern_records", PATTERN_SQL)
def patterns(tables: Tables) -> DataFrame:
    return saved_patterns(tables).select("filename", "description", "sql")


@register(
    "rebuild_index",
    f"SELECT filename AS id, description, sql, 'manual' AS source, 26 AS size FROM ({PATTERN_SQL}) p",
)
def rebuilt(tables: Tables) -> DataFrame:
    done = rebuild(saved_patterns(tables), shown_empty(tables), letter_counts, at(NOW))
    return done.index.select("id", "description", "sql", "source", F.size("embedding").alias("size"))


def shown_empty(tables: Tables) -> DataFrame:
    return label_index(tables).limit(0)


@register(
    "pattern_texts",
    """
SELECT filename AS id, concat(description, chr(10), sql) AS tail FROM (""" + PATTERN_SQL + ") p",
)
def pattern_texts(tables: Tables) -> DataFrame:
    rows = pattern_rows(saved_patterns(tables))
    tail = F.substring(F.col("embed_text"), F.char_length("question") + 2, F.char_length("embed_text"))
    return rows.select("id", tail.alias("tail"))


@register("landed_dashboards", LAKEVIEW_SQL)
def landed(tables: Tables) -> DataFrame:
    """The same dashboards landed as files of one payload per line in the shared folder."""
    folder = work_folder(tables.spark)
    wrapped = lakeview_payloads(tables).select(F.to_json(F.struct("dashboard_id", "display_name", "serialized")))
    wrapped.write.text(folder)
    schema = "dashboard_id string, display_name string, serialized string"
    read = read_dashboards(tables.spark, folder, whole_files=False).select(F.from_json("payload", schema).alias("d"))
    return ch.lakeview_charts(read.select("d.*"))


@register(
    "dictionary_file",
    "SELECT p_name AS keyword, max_by(concat(p_type, ' ', p_partkey), p_partkey) AS content FROM part GROUP BY p_name",
)
def dictionary_file(tables: Tables) -> DataFrame:
    """A dictionary in several files with repeated keys; the last entry of a key counts."""
    folder = work_folder(tables.spark)
    entries = tables.part.select(
        F.col("p_name").alias("keyword"), F.concat_ws(" ", "p_type", "p_partkey").alias("content"), "p_partkey"
    )
    placed = entries.withColumn("part", F.floor(F.sqrt("p_partkey") / 8).cast("int"))  # later files are larger
    for part in range(6):
        inside = F.least("part", F.lit(5)) == part
        placed.where(inside).repartition(1).sortWithinPartitions("p_partkey").select("keyword", "content").write.parquet(f"{folder}/{part}")
    return read_dictionary(tables.spark, f"{folder}/*")


ASKED_SQL = "SELECT DISTINCT concat(replace(p_name, ' ', '-'), '-of-', lower(replace(p_brand, '#', '')), '.sql') FROM part WHERE p_type = 'PROMO'"


def asked_patterns(tables: Tables) -> DataFrame:
    question = F.concat(F.upper("p_name"), F.lit(" of "), F.upper("p_brand")).alias("question")
    return tables.part.where("p_type = 'PROMO'").select(question)


@register(
    "pattern_lookup",
    f"SELECT filename, sql FROM ({PATTERN_SQL}) p WHERE filename IN ({ASKED_SQL})",
)
def pattern_lookup(tables: Tables) -> DataFrame:
    """Saved patterns found by a question written differently."""
    return find_pattern(saved_patterns(tables), asked_patterns(tables)).select("filename", "sql")


@register(
    "pattern_delete",
    f"""
SELECT 'pattern' AS kind, filename FROM ({PATTERN_SQL}) p WHERE filename NOT IN ({ASKED_SQL})
UNION ALL SELECT 'vector', filename FROM ({PATTERN_SQL}) p WHERE filename NOT IN ({ASKED_SQL})""",
)
def pattern_delete(tables: Tables) -> DataFrame:
    """A pattern and its index row go together."""
    saved = saved_patterns(tables)
    index = pattern_rows(saved).select("id", "question")
    gone = find_pattern(saved, asked_patterns(tables)).select("filename")
    patterns_left, index_left = delete_patterns(saved, index, gone)
    kept = patterns_left.select(F.lit("pattern").alias("kind"), "filename")
    return kept.unionByName(index_left.select(F.lit("vector").alias("kind"), F.col("id").alias("filename")))


STREAMED_SQL = """
WITH charts AS (
  SELECT concat('lkr-', substr(sha256(concat('looker:', p_brand, ':', p_name)), 1, 16)) AS id,
         max(concat(p_name, ' ', p_type)) AS description
  FROM part GROUP BY p_brand, p_name)
SELECT id, description, CAST(26 AS INTEGER) AS size, '2024-02-01' AS updated, CAST(3 AS BIGINT) AS versions FROM charts"""


@register("streamed_charts", STREAMED_SQL)
def streamed_charts(tables: Tables) -> DataFrame:
    """Charts landed in three files, loaded as a stream of three batches, and sent again with the
    stream's checkpoint lost: the index has three versions and no row of the second time."""
    spark, folder = tables.spark, work_folder(tables.spark)
    latest = F.max(F.concat_ws(" ", "p_name", "p_type")).alias("element_title")
    charts = tables.part.groupBy("p_brand", "p_name").agg(latest).select(
        F.col("p_brand").alias("dashboard_id"), F.col("p_brand").alias("dashboard_title"),
        F.col("p_name").alias("element_id"), "element_title",
        F.lit("SELECT 1").alias("sql"), F.lit("looker").alias("source"),
    )
    for part in range(3):
        inside = F.pmod(F.xxhash64("dashboard_id", "element_id"), F.lit(3)) == part
        charts.where(inside).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    for checkpoint, moment in (("state", NOW), ("lost", THEN)):
        stream = spark.readStream.schema(charts.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
        ingest_stream(stream, f"{folder}/index", f"{folder}/{checkpoint}", letter_counts, at(moment)).awaitTermination()
    versions = index_version(spark, f"{folder}/index").version
    return read_index(spark, f"{folder}/index").select(
        "id", "description", F.size("embedding").alias("size"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), F.lit(versions).cast("bigint").alias("versions"),
    )


@register(
    "pattern_files",
    """SELECT concat('f', p_partkey, '.sql') AS filename, CASE WHEN p_size > 5 THEN concat('What of ', p_name, '?') ELSE '' END AS question,
       CASE WHEN p_size > 5 THEN concat('SELECT ', p_partkey) ELSE concat('SELECT 0 -- ', p_name) END AS sql,
       CASE WHEN p_size > 5 THEN concat(p_brand, ',', p_type) ELSE '' END AS named,
       CASE WHEN p_size > 25 THEN 'bi' ELSE 'manual' END AS source, CASE WHEN p_size > 25 THEN '2024-01-05' END AS created
    FROM part""",
)
def pattern_files(tables: Tables) -> DataFrame:
    """Files' texts read as patterns: with all of a header, with some of it, and without."""
    part = tables.part
    some = F.format_string("---\nquestion: 'What of %s?'\ntables: ['%s', %s]\n", "p_name", "p_brand", "p_type")
    more = F.when(F.col("p_size") > 25, F.concat(some, F.lit("source: bi\ncreated: 2024-01-05\n"))).otherwise(some)
    headed = F.concat(more, F.lit("---\n\nSELECT "), "p_partkey", F.lit("\n"))
    text = F.when(F.col("p_size") > 5, headed).otherwise(F.concat(F.lit("SELECT 0 -- "), "p_name"))
    read = patterns_of(part.select(F.concat(F.lit("f"), "p_partkey", F.lit(".sql")).alias("filename"), text.alias("value")))
    return read.select("filename", "question", "sql", F.array_join("tables", ",").alias("named"), "source", F.col("created").cast("string").alias("created"))


@register(
    "patterns_saved",
    f"""
SELECT filename, CASE WHEN filename IN ({ASKED_SQL}) THEN concat(sql, ' + 1') ELSE sql END AS sql,
       CASE WHEN filename IN ({ASKED_SQL}) THEN '2024-02-02' ELSE '2024-02-01' END AS created FROM ({PATTERN_SQL}) p""",
)
def patterns_saved(tables: Tables) -> DataFrame:
    """Patterns written to a table, then some of them again under the same slugs."""
    root, saved = work_folder(tables.spark), saved_patterns(tables)
    write_patterns(saved, root, TODAY)
    again = find_pattern(saved, asked_patterns(tables)).withColumn("sql", F.concat("sql", F.lit(" + 1")))
    write_patterns(again, root, date(2024, 2, 2))
    return read_table(tables.spark, root).select("filename", "sql", F.col("created").cast("string").alias("created"))


@register(
    "patterns_renamed",
    f"""
SELECT CASE WHEN filename IN ({ASKED_SQL}) THEN concat('renamed-', filename) ELSE filename END AS filename, sql
FROM ({PATTERN_SQL}) p""",
)
def patterns_renamed(tables: Tables) -> DataFrame:
    """Edits that change a question give the pattern another file, and the old one goes."""
    root, saved = work_folder(tables.spark), saved_patterns(tables)
    write_patterns(saved, root, TODAY)
    edited = find_pattern(saved, asked_patterns(tables)).withColumn("question", F.concat(F.lit("Renamed "), "question"))
    rename_patterns(edited, root, TODAY)
    return read_table(tables.spark, root).select("filename", "sql")


@register("rows_of_json_lists", "SELECT o_orderkey, o_totalprice, o_orderstatus, o_custkey % 7 AS rest FROM orders")
def rows_of_json_lists(tables: Tables) -> DataFrame:
    """Each customer's orders as a JSON list, read back as rows; texts of another kind give none."""
    order = F.struct("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_custkey") % 7).alias("rest"))
    lists = tables.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(order)).alias("t"))
    broken = tables.part.select(F.concat(F.lit("["), "p_name").alias("t"))
    return rows_from_json_texts(lists.select(F.replace("t", F.lit(","), F.lit(",\n")).alias("t")).unionByName(broken), "t")


@register(
    "sources_selected",
    """
SELECT 'databricks' AS source, count(*) AS charts FROM part
UNION ALL SELECT 'looker', count(*) FROM part WHERE p_size > 25
UNION ALL SELECT 'warehouse', CAST(14 AS BIGINT)
UNION ALL SELECT 'again mode', count(*) FROM part WHERE p_size <= 25""",
)
def sources_selected(tables: Tables) -> DataFrame:
    """All core sources; then one by name beside names that are unknown or have no data."""
    def rows(df: DataFrame):
        return lambda: df

    readers = {
        "looker": rows(tables.part.where("p_size > 25")), "databricks": rows(tables.part),
        "mode": rows(tables.part.where("p_size <= 25")), "warehouse": lambda: table_docs(tables.spark, tables.all()),
    }
    core, one = select_sources(["all", "sigma"], readers), select_sources(["mode", "nowhere", "redash"], readers)
    named = [(n, df) for n, df in core.items()] + [(f"again {n}", df) for n, df in one.items()]
    return union_all(df.agg(F.lit(n).alias("source"), F.count("*").alias("charts")) for n, df in named)
