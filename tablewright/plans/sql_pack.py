"""SQL passed through the read guard: one query per shape, the same text in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tablewright.operators.guard import safe_sql
from tablewright.plans.registry import TABLES, Tables, register
from tablewright.sources.connections import register_tables

SHARED_SQL = {
    "sql_monthly_revenue_by_region": """
        SELECT r_name AS region,
               CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month,
               count(*) AS orders,
               round(sum(o_totalprice), 2) AS revenue
        FROM orders
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2
        ORDER BY 1, 2""",
    "sql_join": """
        SELECT p_brand, n_name, count(*) AS items,
               round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM lineitem
        JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        GROUP BY p_brand, n_name""",
    "sql_left_join": """
        SELECT c_mktsegment, count(*) AS rows_out, count(o_orderkey) AS orders,
               count(DISTINCT c_custkey) AS customers,
               round(coalesce(sum(o_totalprice), 0), 2) AS spent
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'
        GROUP BY c_mktsegment""",
    "sql_semi_join": """
        SELECT o_orderpriority, count(*) AS orders
        FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
        GROUP BY o_orderpriority""",
    "sql_anti_join": """
        SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
        FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
        GROUP BY c_mktsegment""",
    "sql_window_rank": """
        SELECT c_mktsegment, o_orderkey, o_totalprice, place
        FROM (
          SELECT c_mktsegment, o_orderkey, o_totalprice,
                 CAST(row_number() OVER (
                   PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place
          FROM orders JOIN customer ON o_custkey = c_custkey) ranked
        WHERE place <= 5""",
    "sql_window_frame": """
        SELECT l_suppkey, month, items,
               CAST(sum(items) OVER (PARTITION BY l_suppkey ORDER BY month) AS BIGINT) AS items_so_far,
               round(avg(quantity) OVER (
                 PARTITION BY l_suppkey ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)
                 AS quantity_3_months
        FROM (
          SELECT l_suppkey, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS month,
                 count(*) AS items, sum(l_quantity) AS quantity
          FROM lineitem
          GROUP BY 1, 2) monthly""",
    "sql_rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS items, round(sum(l_quantity), 2) AS quantity
        FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_cube": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(max(o_totalprice), 2) AS largest
        FROM orders
        GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_grouping_sets": """
        SELECT event_type, user_id, count(*) AS events, round(sum(value), 2) AS total
        FROM events
        GROUP BY GROUPING SETS ((event_type), (user_id), ())""",
    "sql_union": """
        SELECT source, count(*) AS n FROM (
          SELECT c_mktsegment AS source FROM customer
          UNION ALL
          SELECT p_type AS source FROM part
          UNION ALL
          SELECT event_type AS source FROM events) parts
        GROUP BY source""",
    "sql_union_distinct": """
        SELECT o_custkey AS customer FROM orders
        UNION
        SELECT c_custkey AS customer FROM customer""",
    "sql_intersect": """
        SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'
        INTERSECT
        SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'A'""",
    "sql_except": """
        SELECT o_custkey AS customer FROM orders WHERE o_totalprice > 250000
        EXCEPT
        SELECT o_custkey AS customer FROM orders WHERE o_orderstatus = 'P'""",
    "sql_case": """
        SELECT CASE WHEN o_totalprice >= 400000 THEN 'large'
                    WHEN o_totalprice >= 150000 THEN 'medium'
                    ELSE 'small' END AS size,
               count(*) AS orders,
               CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished
        FROM orders
        GROUP BY 1""",
    "sql_having": """
        SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent
        FROM orders
        GROUP BY o_custkey
        HAVING count(*) >= 12 AND sum(o_totalprice) > 1000000""",
    "sql_scalar_subquery": """
        SELECT p_brand, count(*) AS parts
        FROM part
        WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)
        GROUP BY p_brand""",
    "sql_nested_subquery": """
        SELECT o_orderstatus, count(*) AS orders
        FROM (SELECT o.o_orderstatus, o.o_totalprice, a.typical
              FROM orders o
              JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS typical FROM orders GROUP BY o_custkey) a
                ON o.o_custkey = a.k) joined
        WHERE o_totalprice > typical
        GROUP BY o_orderstatus""",
    "sql_cte": """
        WITH spent AS (
          SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
        placed AS (
          SELECT c_nationkey, total FROM customer JOIN spent ON c_custkey = o_custkey)
        SELECT n_name, count(*) AS customers, round(sum(total), 2) AS total
        FROM placed JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    "sql_null_counts": """
        SELECT lang, count(*) AS documents, count(quality) AS rated,
               count(CASE WHEN toxic IS NOT NULL AND toxic = 1 THEN 1 END) AS toxic,
               count(nullif(source, 'none')) AS sourced
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        GROUP BY lang""",
    "sql_distinct": """
        SELECT DISTINCT l_partkey, l_suppkey FROM lineitem""",
    "sql_topk": """
        SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "sql_projection_filter": """
        SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
        FROM lineitem
        WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 12 AND l_discount IN (0.0, 0.05)
          AND (l_linestatus = 'F' OR l_tax > 0.06)""",
    "sql_math": """
        SELECT event_type, CAST(floor(value) AS BIGINT) AS whole, count(*) AS events,
               round(sum(sqrt(value)), 6) AS roots, round(sum(ln(value + 1)), 6) AS logs,
               round(max(power(value, 2)), 4) AS squared, round(sum(abs(value - 50)), 2) AS distance,
               CAST(sum(sign(value - 50)) AS DOUBLE) AS side, CAST(sum(user_id % 7) AS BIGINT) AS remainders
        FROM events
        GROUP BY 1, 2""",
    "sql_strings": """
        SELECT p_partkey, upper(p_name) AS loud, replace(p_name, ' ', '_') AS joined,
               substring(p_brand, 7, 2) AS number, concat(p_type, '/', p_brand) AS path,
               CAST(length(p_name) AS INTEGER) AS letters, reverse(p_type) AS backwards,
               lpad(CAST(p_size AS VARCHAR(5)), 4, '0') AS padded, coalesce(nullif(p_type, 'PROMO'), '-') AS kind
        FROM part""",
    "sql_text_functions": """
        SELECT lang, source, CAST(sum(length(text)) AS BIGINT) AS chars,
               CAST(max(length(trim(text))) AS BIGINT) AS longest,
               count(CASE WHEN lower(text) LIKE '%the %' THEN 1 END) AS with_the
        FROM documents
        GROUP BY lang, source""",
}

TWO_FORMS = {
    "sql_dates": (
        """SELECT date_format(date_trunc('quarter', o_orderdate), 'yyyy-MM-dd') AS quarter,
                  CAST(dayofweek(o_orderdate) - 1 AS INTEGER) AS weekday, count(*) AS orders,
                  CAST(sum(datediff(o_orderdate, DATE '1992-01-01')) AS BIGINT) AS days,
                  date_format(max(o_orderdate + INTERVAL 30 DAY), 'yyyy-MM-dd') AS due
           FROM orders GROUP BY 1, 2""",
        """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter,
                  CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, count(*) AS orders,
                  CAST(sum(datediff('day', TIMESTAMP '1992-01-01', o_orderdate)) AS BIGINT) AS days,
                  strftime(max(o_orderdate + INTERVAL 30 DAY), '%Y-%m-%d') AS due
           FROM orders GROUP BY 1, 2""",
    ),
    "sql_arrays": (
        """SELECT vec_id, CAST(size(embedding) AS INTEGER) AS n, array_max(embedding) AS largest,
                  CAST(array_position(embedding, array_min(embedding)) AS BIGINT) AS lowest_at,
                  CAST(size(filter(embedding, x -> x > 0)) AS INTEGER) AS positive,
                  round(CAST(slice(embedding, 3, 2)[1] AS DOUBLE), 6) + 0.0 AS fourth
           FROM embeddings""",
        """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_max(embedding) AS largest,
                  CAST(list_position(embedding, list_min(embedding)) AS BIGINT) AS lowest_at,
                  CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive,
                  round(CAST(embedding[3:4][2] AS DOUBLE), 6) + 0.0 AS fourth
           FROM embeddings""",
    ),
    "sql_maps": (
        """SELECT event_id, array_join(map_keys(m), ',') AS names, m['k'] AS k, m['none'] AS missing
           FROM (SELECT event_id, from_json(props, 'map<string,int>') AS m FROM events) t""",
        """SELECT event_id, array_to_string(json_keys(props), ',') AS names,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS INTEGER) AS missing
           FROM events""",
    ),
    "sql_json": (
        """SELECT event_type, CAST(get_json_object(props, '$.k') AS INTEGER) AS k, count(*) AS events
           FROM events GROUP BY 1, 2""",
        """SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS events
           FROM events GROUP BY 1, 2""",
    ),
    "sql_percentiles": (
        """SELECT l_returnflag, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY items), 6) AS p90,
                  round(stddev_samp(items), 6) AS spread
           FROM (SELECT l_returnflag, l_partkey, count(*) AS items FROM lineitem GROUP BY 1, 2) t
           GROUP BY l_returnflag""",
        """SELECT l_returnflag, round(quantile_cont(items, 0.9), 6) AS p90,
                  round(stddev_samp(items), 6) AS spread
           FROM (SELECT l_returnflag, l_partkey, count(*) AS items FROM lineitem GROUP BY 1, 2) t
           GROUP BY l_returnflag""",
    ),
}


def _through_guard(query: str, limit: int | None = None):
    def build(tables: Tables) -> DataFrame:
        named = [name for name in TABLES if re.search(rf"\b{name}\b", query)]
        register_tables({name: getattr(tables, name) for name in named})
        return safe_sql(tables.spark, query, limit)

    return build


for _name, _query in SHARED_SQL.items():
    register(_name, _query)(_through_guard(_query))
for _name, (_spark, _duck) in TWO_FORMS.items():
    register(_name, _duck)(_through_guard(_spark))

# The default cap is the feature here: a query without its own LIMIT shows 5000 rows.
_CAPPED = "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey"
register("sql_row_cap", f"{_CAPPED} LIMIT 5000")(_through_guard(_CAPPED, 5000))
