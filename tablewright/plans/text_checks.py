"""Text, id and statement rules over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import text as tx
from tablewright.functions.questions import is_plural, with_question
from tablewright.functions.statements import classify_statements
from tablewright.functions.text import truncate
from tablewright.plans.registry import Tables, register

STATEMENT = """CASE o_orderstatus
    WHEN 'F' THEN concat('-- order ', o_orderkey, chr(10), '  delete from t where k = ', o_orderkey)
    WHEN 'O' THEN concat('/* ', o_orderpriority, chr(10), ' */ SELECT * FROM t Limit ', o_custkey)
    ELSE concat('INSERT INTO limits VALUES (', o_orderkey, ')') END"""

TITLE = """CASE p_type
    WHEN 'ECONOMY' THEN concat('Total ', p_name, '  ', p_size)
    WHEN 'SMALL' THEN concat('Show ', p_name, ' by size')
    WHEN 'MEDIUM' THEN concat('  Top ', p_size, ' ', p_name, 's')
    WHEN 'PROMO' THEN concat(p_name, ' rate of ', p_brand, '?')
    WHEN 'LARGE' THEN concat(p_name, 's')
    ELSE concat('Weekly', chr(9), p_name, '? ') END"""

QUESTION_SQL = f"""
WITH cleaned AS (
  SELECT p_partkey, p_brand AS board,
         trim(regexp_replace({TITLE}, '\\s+', ' ', 'g')) AS title
  FROM part),
worded AS (
  SELECT *, lower(title) AS low, lower(split_part(title, ' ', 1)) AS head,
         lower(split_part(title, ' ', -1)) AS tail FROM cleaned)
SELECT p_partkey, title,
  CASE
    WHEN title LIKE '%?' AND NOT contains(low, lower(board))
      THEN concat(left(title, length(title) - 1), ' from ', board, '?')
    WHEN title LIKE '%?' THEN title
    WHEN title LIKE '#%' OR regexp_matches(head, '^(total|count|number|avg|average|sum|min|max|mean|median)#*$')
      THEN concat('What is the ', title, ' from ', board, '?')
    WHEN regexp_matches(head, '^(show|list|display|compare|breakdown|analyze|track|find|view|explore)#*$')
      THEN concat('Can you ', lower(title[1]), title[2:], ' from ', board, '?')
    WHEN head IN ('top', 'bottom') THEN concat('What are the ', title, ' from ', board, '?')
    WHEN head IN ('daily', 'weekly', 'monthly', 'yearly', 'annual', 'quarterly', 'ytd', 'mtd', 'wtd')
      OR regexp_matches(low, 'rate|ratio|percent|pct|proportion|%|\\bby\\b')
      THEN concat('What is the ', title, ' from ', board, '?')
    WHEN tail LIKE '%s' AND (tail LIKE '%ies' OR NOT regexp_matches(tail, '(ss|us|is)$'))
      THEN concat('What are the ', title, ' from ', board, '?')
    ELSE concat('What is the ', title, ' from ', board, '?') END AS question
FROM worded"""


@register(
    "classify_statements",
    f"""
WITH s AS (SELECT o_orderkey, {STATEMENT} AS sql FROM orders),
w AS (SELECT *, upper(regexp_extract(regexp_replace(regexp_replace(sql, '--[^\\n]*', '', 'g'),
        '(?s)/\\*.*?\\*/', '', 'g'), '\\S+')) AS first_word FROM s)
SELECT o_orderkey, sql, first_word,
       first_word IN ('INSERT', 'UPDATE', 'DELETE', 'DROP', 'ALTER', 'TRUNCATE', 'CREATE', 'MERGE', 'REPLACE')
         AS is_write,
       regexp_matches(sql, '(?i)\\bLIMIT\\b') AS has_limit
FROM w""",
)
def statements(tables: Tables) -> DataFrame:
    return classify_statements(tables.orders.select("o_orderkey", F.expr(STATEMENT.replace("chr(10)", "char(10)")).alias("sql")))


@register("questions_from_titles", QUESTION_SQL)
def questions(tables: Tables) -> DataFrame:
    titled = tables.part.select("p_partkey", "p_brand", F.expr(TITLE.replace("chr(9)", "char(9)")).alias("raw"))
    asked = with_question(titled, "raw", "p_brand")
    return asked.select("p_partkey", tx.clean_title(F.col("raw")).alias("title"), "question")


@register(
    "plural_words",
    """
SELECT word, count(*) AS uses,
       word LIKE '%ies' OR (word LIKE '%s' AND NOT regexp_matches(word, '(ss|us|is)$')) AS plural
FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM conversations) t
GROUP BY word""",
)
def plural_words(tables: Tables) -> DataFrame:
    words = tables.conversations.select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("uses")).withColumn("plural", is_plural(F.col("word")))


@register(
    "stable_ids",
    """
SELECT o_orderkey,
       concat('lkr-', left(sha256(concat('looker:', o_custkey, ':', o_orderkey)), 16)) AS looker_id,
       concat('dbr-', left(sha256(concat('databricks:', o_orderpriority, ':', o_orderkey)), 16)) AS databricks_id
FROM orders""",
)
def stable_ids(tables: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return tables.orders.select(
        "o_orderkey",
        tx.stable_id("looker", F.col("o_custkey"), key).alias("looker_id"),
        tx.stable_id(F.lit("databricks"), F.col("o_orderpriority"), key).alias("databricks_id"),
    )


@register(
    "slugify_documents",
    """
SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(
         lower(strip_accents(text)), '[^\\p{L}\\p{N}_\\s\\x{00a0}-]', '', 'g'),
         '[-\\s\\x{00a0}]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'file') AS slug
FROM documents""",
)
def slugs(tables: Tables) -> DataFrame:
    return tables.documents.select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@register(
    "format_scalars",
    """
WITH v AS (
  SELECT concat('order ', o_orderkey) AS item, o_totalprice AS value FROM orders
  UNION ALL SELECT concat('event ', event_id), value FROM events
  UNION ALL SELECT concat('customer ', c_custkey), c_acctbal FROM customer
  UNION ALL SELECT concat('segment ', c_mktsegment), sum(o_totalprice)
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
SELECT item, CASE
  WHEN value >= 1e6 THEN concat('$', format('{:,.1f}', value / 1e6), 'M')
  WHEN value <= -1e6 THEN concat(format('{:,.1f}', value / 1e6), 'M')
  WHEN abs(value) >= 1e3 THEN format('{:,.0f}', value)
  ELSE format('{:,.2f}', value) END AS shown
FROM v""",
)
def formatted(tables: Tables) -> DataFrame:
    def items(df: DataFrame, lead: str, key: str, value: str) -> DataFrame:
        return df.select(F.concat(F.lit(lead), F.col(key)).alias("item"), F.col(value).alias("value"))

    orders, customer = tables.orders, tables.customer
    spent = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_mktsegment")
    values = (
        items(orders, "order ", "o_orderkey", "o_totalprice")
        .unionByName(items(tables.events, "event ", "event_id", "value"))
        .unionByName(items(customer, "customer ", "c_custkey", "c_acctbal"))
        .unionByName(items(spent.agg(F.sum("o_totalprice").alias("t")), "segment ", "c_mktsegment", "t"))
    )
    return values.select("item", tx.format_scalar(F.col("value"), T.DoubleType()).alias("shown"))


@register(
    "clean_text",
    """
SELECT doc_id,
       length(replace(text, chr(10), '')) AS chars,
       md5(regexp_replace(text, '\\n{2,}', chr(10), 'g')) AS collapsed,
       md5(array_to_string(list_transform(string_split(text, chr(10)),
           lambda x: regexp_replace(x, '[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '')), chr(10))) AS right_trimmed
FROM documents""",
)
def clean_text(tables: Tables) -> DataFrame:
    text = F.col("text")
    return tables.documents.select(
        "doc_id",
        F.char_length(F.replace(text, F.lit("\n"), F.lit(""))).cast("bigint").alias("chars"),
        F.md5(tx.collapse_newlines(text)).alias("collapsed"),
        F.md5(tx.join_lines(F.split(text, "\n"))).alias("right_trimmed"),
    )


@register(
    "comma_lists",
    """
SELECT p_partkey, array_to_string(list_filter(list_transform(
         string_split(concat(p_name, ' , ', p_type, ',,', p_brand, ', '), ','),
         lambda x: trim(x)), lambda x: x <> ''), '|') AS items
FROM part""",
)
def comma_lists(tables: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(" , "), "p_type", F.lit(",,"), "p_brand", F.lit(", "))
    return tables.part.select("p_partkey", F.array_join(tx.split_list(text), "|").alias("items"))


@register(
    "masked_settings",
    """
SELECT s_suppkey, s_name AS host,
       CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END AS api_key,
       CASE WHEN s_nationkey > 12 THEN 'false' ELSE 'true' END AS client_secret
FROM supplier""",
)
def masked(tables: Tables) -> DataFrame:
    settings = F.create_map(
        F.lit("host"), F.col("s_name"),
        F.lit("api_key"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("string")).otherwise(""),
        F.lit("Client_Secret"), F.when(F.col("s_nationkey") > 12, tx.MASKED_SECRET).otherwise("set"),
    )
    shown = tables.supplier.select("s_suppkey", tx.mask_secrets(settings).alias("m"))
    return shown.select(
        "s_suppkey",
        F.col("m")["host"].alias("host"),
        F.col("m")["api_key"].alias("api_key"),
        F.col("m")["Client_Secret"].alias("client_secret"),
    )


@register(
    "unfenced_sql",
    """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN concat('SELECT ', p_size)
         WHEN 'SMALL' THEN concat('SELECT ', p_size) ELSE concat('SELECT ', p_size, ' AS ', p_type) END AS sql
FROM part""",
)
def unfenced(tables: Tables) -> DataFrame:
    raw = F.expr("""CASE p_type WHEN 'ECONOMY' THEN concat(char(10), '```sql', char(10), 'SELECT ', p_size, char(10), '```')
        WHEN 'SMALL' THEN concat('``` SELECT ', p_size, '```  ') ELSE concat('SELECT ', p_size, ' AS ', p_type) END""")
    return tables.part.select("p_partkey", tx.strip_code_fence(raw).alias("sql"))


@register(
    "embed_texts",
    """
SELECT p_partkey, concat('Question: ', p_name, chr(10), 'SQL Pattern:', chr(10), 'SELECT ', p_size) AS chart,
       concat('Question: ', p_name, chr(10), 'Schema: ', p_type) AS schema_document,
       concat(p_name, chr(10), CASE WHEN p_size > 25 THEN concat(p_type, chr(10)) ELSE '' END, 'SELECT ', p_size) AS pattern
FROM part""",
)
def embed_texts(tables: Tables) -> DataFrame:
    sql = F.concat(F.lit("SELECT "), "p_size")
    description = F.when(F.col("p_size") > 25, F.col("p_type"))
    return tables.part.select(
        "p_partkey",
        tx.chart_text(F.col("p_name"), sql).alias("chart"),
        tx.schema_text(F.col("p_name"), F.col("p_type")).alias("schema_document"),
        tx.pattern_text(F.col("p_name"), description, sql).alias("pattern"),
    )


@register(
    "truncated_texts",
    "SELECT doc_id, length(substring(text, 1, 2000)) AS kept, md5(substring(text, 1, 2000)) AS digest FROM documents",
)
def truncated_texts(tables: Tables) -> DataFrame:
    """Texts cut to 2000 characters, many of them longer."""
    cut = truncate(F.col("text"), 2000)
    return tables.documents.select("doc_id", F.char_length(cut).cast("bigint").alias("kept"), F.md5(cut).alias("digest"))
