"""Index maintenance and search over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.vectors import cosine
from tablewright.operators import index as ix
from tablewright.operators.approx import build_tables, topk_approx
from tablewright.operators.embed import embed
from tablewright.operators.search import search
from tablewright.operators.substring import glossary_hits, keyword_hits
from tablewright.operators.topk import topk, topk_join
from tablewright.plans.registry import Tables, register
from tablewright.session import work_folder
from tablewright.sources.store import (
    compact_index, delete_from_index, import_vectors, read_index, search_index, upsert_index, vacuum, write_index,
    write_search_tables,
)
from tablewright.streaming.feeds import search_stream

THEN, NOW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


# --- Letter counts stand in for a model's vectors, so that SQL can make the same ones. -----
def letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(low.count(letter)) for letter in LETTERS] for low in map(str.lower, texts)]


def letter_vector(text: Column) -> Column:
    low = F.lower(text)

    def count(letter: str) -> Column:
        return F.char_length(low) - F.char_length(F.replace(low, F.lit(letter), F.lit("")))

    return F.array(*[count(letter).cast("double") for letter in LETTERS])


LETTERS_SQL = "[{}]".format(
    ", ".join(f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in LETTERS)
)
COSINE_SQL = """CASE WHEN list_sum(list_transform({a}, lambda x: x * x)) = 0
    OR list_sum(list_transform({b}, lambda x: x * x)) = 0 THEN 0.0
    ELSE list_cosine_similarity({a}, {b}) END"""


def at(text: str) -> Column:
    """A moment in the session's time zone."""
    return F.lit(text).cast("timestamp")


def label_index(tables: Tables) -> DataFrame:
    """The vectors as an index; the label is the source."""
    key = F.col("vec_id").cast("string")
    return tables.embeddings.select(
        F.concat(F.lit("v"), key).alias("id"),
        F.concat(F.lit("Question "), key).alias("question"),
        F.lit("SELECT 1").alias("sql"),
        F.concat(F.lit("label-"), F.col("label")).alias("source"),
        F.lit("").alias("dashboard"),
        F.lit("stored").alias("description"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        at(THEN).alias("created_at"),
        at(THEN).alias("updated_at"),
    )


def shown(index: DataFrame) -> DataFrame:
    """An index's rows with the vector's size and first value, times as text."""
    day = "yyyy-MM-dd HH:mm:ss"
    return index.select(
        "id", "question", "sql", "source", "dashboard", "description",
        F.size("embedding").alias("size"),
        (F.round(F.get("embedding", F.lit(0)), 6) + 0.0).alias("head"),
        F.date_format("created_at", day).alias("created_at"),
        F.date_format("updated_at", day).alias("updated_at"),
    )


def label_batch(tables: Tables) -> DataFrame:
    """Each vector twice: the later row replaces the stored one, or is new for labels from 5 on."""
    e = tables.embeddings
    key = F.when(F.col("label") < 5, F.concat(F.lit("v"), "vec_id")).otherwise(F.concat(F.lit("n"), "vec_id"))
    both = e.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.select(
        key.alias("id"),
        F.concat(F.lit("Asked "), "seq", F.lit(" "), "vec_id").alias("question"),
        F.lit("loaded").alias("source"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: -x).alias("embedding"),
        "seq",
    )


STORED_SQL = """SELECT concat('v', vec_id) AS id, concat('Question ', vec_id) AS question, 'SELECT 1' AS sql,
  concat('label-', label) AS source, '' AS dashboard, 'stored' AS description,
  CAST(len(embedding) AS INTEGER) AS size, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS head,
  '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at, label
  FROM embeddings"""
SHOWN_SQL = "id, question, sql, source, dashboard, description, size, head, created_at, updated_at"


@register(
    "index_upsert",
    f"""
WITH stored AS ({STORED_SQL})
SELECT {SHOWN_SQL} FROM stored WHERE label >= 5
UNION ALL
SELECT CASE WHEN label < 5 THEN id ELSE replace(id, 'v', 'n') END, replace(question, 'Question ', 'Asked 2 '),
       '', 'loaded', '', '', size, 0.0 - head, CASE WHEN label < 5 THEN created_at ELSE '2024-02-01 00:00:00' END,
       '2024-02-01 00:00:00'
FROM stored""",
)
def index_upsert(tables: Tables) -> DataFrame:
    return shown(ix.upsert(label_index(tables), label_batch(tables), at(NOW), "seq"))


@register(
    "index_edit",
    f"""
WITH stored AS ({STORED_SQL})
SELECT {SHOWN_SQL} FROM stored WHERE label >= 5
UNION ALL
SELECT CASE WHEN label < 5 THEN id ELSE replace(id, 'v', 'n') END, replace(question, 'Question ', 'Asked 2 '),
       '', 'loaded', '', '', CASE WHEN label < 5 THEN size ELSE 0 END, CASE WHEN label < 5 THEN head END,
       CASE WHEN label < 5 THEN created_at ELSE '2024-02-01 00:00:00' END, '2024-02-01 00:00:00'
FROM stored""",
)
def index_edit(tables: Tables) -> DataFrame:
    return shown(ix.edit(label_index(tables), label_batch(tables), at(NOW), "seq"))


@register(
    "index_delete",
    f"WITH stored AS ({STORED_SQL}) SELECT {SHOWN_SQL} FROM stored WHERE label >= 5",
)
def index_delete(tables: Tables) -> DataFrame:
    return shown(ix.delete(label_index(tables), label_batch(tables)))


@register("index_existing", "SELECT concat('v', vec_id) AS id FROM embeddings WHERE label < 5")
def index_existing(tables: Tables) -> DataFrame:
    return ix.existing(label_index(tables), label_batch(tables))


@register(
    "index_stats",
    """
SELECT CASE WHEN grouping(label) = 0 THEN concat('label-', label) END AS source,
       grouping(label) = 1 AS is_total, count(*) AS vectors, '2024-01-01' AS last_day
FROM embeddings GROUP BY ROLLUP (label)""",
)
def index_stats(tables: Tables) -> DataFrame:
    stats = ix.index_stats(label_index(tables))
    return stats.select("source", "is_total", "vectors", F.date_format("last_updated", "yyyy-MM-dd").alias("last_day"))


@register(
    "index_listing",
    "SELECT concat('v', vec_id) AS id, concat('Question ', vec_id) AS question, concat('label-', label) AS source "
    "FROM embeddings",
)
def index_listing(tables: Tables) -> DataFrame:
    return ix.list_all(label_index(tables)).select("id", "question", "source")


@register(
    "index_versions",
    f"WITH stored AS ({STORED_SQL}) SELECT {SHOWN_SQL} FROM stored WHERE label >= 5",
)
def index_versions(tables: Tables) -> DataFrame:
    """Two versions written in the shared folder; the second is made from the first."""
    root = work_folder(tables.spark)
    as_text = label_index(tables).withColumn("embedding", F.to_json("embedding"))
    write_index(import_vectors(as_text), root)
    delete_from_index(label_batch(tables), root)
    return shown(read_index(tables.spark, root))


@register(
    "index_log",
    f"""
WITH stored AS ({STORED_SQL}),
changed AS (
  SELECT {SHOWN_SQL}, label FROM stored WHERE label >= 5
  UNION ALL
  SELECT CASE WHEN label < 5 THEN id ELSE replace(id, 'v', 'n') END, replace(question, 'Question ', 'Asked 2 '),
         '', 'loaded', '', '', size, 0.0 - head, created_at, '2024-02-01 00:00:00', label
  FROM stored)
SELECT {SHOWN_SQL} FROM changed WHERE label <> 7""",
)
def index_log(tables: Tables) -> DataFrame:
    """Batches logged beside the base, folded into it, logged again, and the unused folders removed."""
    root = work_folder(tables.spark)
    write_index(label_index(tables), root, parts=8)
    batch, gone = label_batch(tables), tables.embeddings.where("label = 7")
    upsert_index(batch.where("seq = 1"), root, at(THEN))
    upsert_index(batch, root, at(NOW), "seq")
    compact_index(tables.spark, root, part_bytes=64 << 10)
    delete_from_index(gone.select(F.explode(F.array(F.concat(F.lit("v"), "vec_id"), F.concat(F.lit("n"), "vec_id"))).alias("id")), root)
    vacuum(tables.spark, root, keep=1, grace=-1.0)
    return shown(read_index(tables.spark, root))


@register(
    "knowledge_stats",
    """
SELECT 'patterns' AS kind, CAST(NULL AS VARCHAR) AS source, count(*) AS n FROM orders
UNION ALL SELECT 'keywords', NULL, count(*) FROM part
UNION ALL SELECT 'terms', NULL, count(*) FROM benchmark
UNION ALL SELECT 'vectors', NULL, count(*) FROM embeddings
UNION ALL SELECT 'vectors by source', concat('label-', label), count(*) FROM embeddings GROUP BY label""",
)
def knowledge_stats(tables: Tables) -> DataFrame:
    stats = ix.knowledge_stats(tables.orders, tables.part, tables.benchmark, label_index(tables))
    return stats.select("kind", "source", F.col("rows").alias("n"))


@register(
    "dictionary_put_remove",
    """
WITH base AS (SELECT p_name AS keyword, max(p_type) AS content FROM part GROUP BY p_name),
added AS (SELECT p_brand AS keyword, max_by(p_name, p_partkey) AS content FROM part GROUP BY p_brand
          UNION ALL SELECT p_name, concat('last ', max(p_partkey)) FROM part WHERE p_size > 25 GROUP BY p_name)
SELECT keyword, content FROM (
  SELECT * FROM added
  UNION ALL SELECT * FROM base WHERE keyword NOT IN (SELECT keyword FROM added)) merged
WHERE keyword NOT IN (SELECT p_brand FROM part WHERE p_type = 'PROMO' AND p_size > 48)""",
)
def dictionary(tables: Tables) -> DataFrame:
    part = tables.part
    base = part.groupBy(F.col("p_name").alias("keyword")).agg(F.max("p_type").alias("content"))
    brands = part.select(F.col("p_brand").alias("keyword"), F.col("p_name").alias("content"), "p_partkey")
    names = part.where("p_size > 25").select(
        F.col("p_name").alias("keyword"), F.concat(F.lit("last "), "p_partkey").alias("content"), "p_partkey"
    )
    merged = ix.put(base, brands.unionByName(names), "p_partkey")
    gone = part.where("p_type = 'PROMO' AND p_size > 48").select(F.col("p_brand").alias("keyword"))
    return ix.listed(ix.remove(merged, gone))


@register(
    "topk_join",
    """
WITH pairs AS (
  SELECT q.vec_id AS query_id, concat('v', i.vec_id) AS id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS sim
  FROM embeddings q CROSS JOIN embeddings i),
ranked AS (
  SELECT query_id, id, round(sim, 4) AS similarity,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 4) DESC, id) AS INTEGER) AS rank
  FROM pairs WHERE sim >= 0.3)
SELECT * FROM ranked WHERE rank <= 5""",
)
def every_vector(tables: Tables) -> DataFrame:
    queries = tables.embeddings.withColumnRenamed("vec_id", "query_id")
    return topk_join(queries, label_index(tables))


@register(
    "topk_approx_all_buckets",
    """
WITH pairs AS (
  SELECT q.vec_id AS query_id, concat('v', i.vec_id) AS id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS sim
  FROM embeddings q CROSS JOIN embeddings i),
ranked AS (
  SELECT query_id, id, round(sim, 4) AS similarity,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 4) DESC, id) AS INTEGER) AS rank
  FROM pairs WHERE sim >= 0.3)
SELECT * FROM ranked WHERE rank <= 5""",
)
def every_vector_in_buckets(tables: Tables) -> DataFrame:
    """The search tables hold every row: looking into all buckets gives the exact hits."""
    path = f"{work_folder(tables.spark)}/tables"
    build_tables(label_index(tables), path, bucket_rows=64)
    queries = tables.embeddings.withColumnRenamed("vec_id", "query_id")
    return topk_approx(queries, path, probes=1 << 30)


@register(
    "topk_approx_recall",
    """
WITH held AS (
  SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings WHERE label >= 5
  UNION ALL SELECT list_transform(embedding, lambda x: -CAST(x AS DOUBLE)) FROM embeddings),
hits AS (
  SELECT q.vec_id, least(count(*), 5) AS n FROM embeddings q
  JOIN held ON list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), w) >= 0.3 GROUP BY q.vec_id)
SELECT CAST(sum(n) AS BIGINT) AS true_hits, true AS recall_reached, CAST(0 AS BIGINT) AS wrong FROM hits""",
)
def approximate_recall(tables: Tables) -> DataFrame:
    """Every vector searched in a stored index that changed after its search tables were built.

    At least nine tenths of the exact hits are found, and each has its exact similarity.
    """
    root = f"{work_folder(tables.spark)}/index"
    write_index(label_index(tables), root)
    write_search_tables(tables.spark, root, bucket_rows=64)
    upsert_index(label_batch(tables), root, at(NOW), "seq")
    queries = tables.embeddings.withColumnRenamed("vec_id", "query_id")
    true, found = (search_index(queries, root, exact=e).drop("rank") for e in (True, False))
    near = found.select("query_id", "id", F.col("similarity").alias("found"))
    both = true.join(near, ["query_id", "id"], "left")
    wrong = F.count_if(F.abs(F.col("found") - F.col("similarity")) > 1e-9)
    return both.agg(
        F.count("*").alias("true_hits"), (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"), wrong.alias("wrong")
    )


@register(
    "topk_single",
    """
SELECT concat('v', vec_id) AS id, concat('Question ', vec_id) AS question, concat('label-', label) AS source,
       round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(1, 65), lambda i: 1.0 / i)), 4)
         AS similarity
FROM embeddings
WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(1, 65), lambda i: 1.0 / i)) >= 0.05
ORDER BY similarity DESC, id LIMIT 10""",
)
def one_vector(tables: Tables) -> DataFrame:
    found = topk(label_index(tables), [1.0 / i for i in range(1, 65)], k=10, threshold=0.05)
    return found.select("id", "question", "source", "similarity")


@register(
    "cosine_to_vector",
    """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(1, 65), lambda i: 1.0 / i)), 6) + 0.0
         AS similarity, CAST(0.0 AS DOUBLE) AS to_shorter, CAST(0.0 AS DOUBLE) AS to_zero
FROM embeddings""",
)
def cosines(tables: Tables) -> DataFrame:
    """The column form: to one vector, to one of another length, and to a zero vector."""
    own = F.col("embedding")
    return tables.embeddings.select(
        "vec_id",
        (F.round(cosine(own, F.array(*[F.lit(1.0 / i) for i in range(1, 65)])), 6) + 0.0).alias("similarity"),
        cosine(own, F.array(F.lit(1.0))).alias("to_shorter"),
        cosine(own, F.array_repeat(F.lit(0.0), 64)).alias("to_zero"),
    )


def text_words() -> Column:
    return F.explode(F.split("text", "[ \\n]"))


def word_dictionary(tables: Tables) -> DataFrame:
    """Every word of the benchmark's texts, with the first text it stands in."""
    words = tables.benchmark.select(text_words().alias("keyword"), "text").where("keyword <> ''")
    return words.groupBy("keyword").agg(F.min("text").alias("content"))


WORDS_SQL = """SELECT keyword, min(text) AS content
  FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS keyword, text FROM benchmark) t
  WHERE keyword <> '' GROUP BY 1"""


def turns(tables: Tables) -> DataFrame:
    return tables.conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text"
    )


KEYWORD_SQL = f"""
WITH words AS ({WORDS_SQL})
SELECT concat(conv_id, ':', turn) AS query_id, keyword, content,
       CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY keyword) AS INTEGER) AS position
FROM conversations JOIN words ON contains(lower(text), lower(keyword))"""


@register("keyword_match", KEYWORD_SQL)
def keywords(tables: Tables) -> DataFrame:
    return keyword_hits(turns(tables), word_dictionary(tables))


@register("keyword_match_by_join", KEYWORD_SQL)
def keywords_by_join(tables: Tables) -> DataFrame:
    """With the dictionary's grams too many to be sent to the tasks."""
    return keyword_hits(turns(tables), word_dictionary(tables), gram_bytes=0)


@register("keyword_match_by_shuffle", KEYWORD_SQL)
def keywords_by_shuffle(tables: Tables) -> DataFrame:
    """With nothing of the dictionary sent to the tasks."""
    return keyword_hits(turns(tables), word_dictionary(tables), gram_bytes=0, broadcast_bytes=0)


@register(
    "keyword_use_in_documents",
    f"""
WITH words AS ({WORDS_SQL})
SELECT keyword, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents JOIN words ON contains(lower(text), lower(keyword))
GROUP BY keyword""",
)
def keyword_use(tables: Tables) -> DataFrame:
    """Every word of the dictionary in whole documents, of up to 20,000 words."""
    texts = tables.documents.select(F.col("doc_id").alias("query_id"), "text")
    hits = keyword_hits(texts, word_dictionary(tables)).select("query_id", "keyword")
    sizes = tables.documents.select(F.col("doc_id").alias("query_id"), F.char_length("text").alias("n"))
    return hits.join(sizes, "query_id").groupBy("keyword").agg(
        F.count("*").alias("documents"), F.sum("n").alias("chars")
    )


@register(
    "glossary_match",
    """
WITH asked AS (SELECT DISTINCT word AS query_id, lower(word) AS q
  FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS word FROM conversations) t WHERE word <> ''),
terms AS (
  SELECT item_id, concat('Item ', item_id) AS term, text AS definition FROM benchmark
  UNION ALL SELECT item_id, concat('Empty ', item_id), NULL FROM benchmark)
SELECT query_id, term, definition FROM asked
JOIN terms ON contains(lower(term), q) OR contains(lower(coalesce(definition, '')), q)""",
)
def glossary(tables: Tables) -> DataFrame:
    """Every word of the conversations, asked of the benchmark's names and texts."""
    word = tables.conversations.select(text_words().alias("query_id")).where("query_id <> ''").distinct()
    asked = word.withColumn("text", F.col("query_id"))
    items = tables.benchmark
    terms = items.select(F.concat(F.lit("Item "), "item_id").alias("term"), F.col("text").alias("definition"))
    empty = items.select(
        F.concat(F.lit("Empty "), "item_id").alias("term"), F.lit(None).cast("string").alias("definition")
    )
    return glossary_hits(asked, terms.unionByName(empty))


def document_index(tables: Tables) -> DataFrame:
    rows = tables.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.concat(F.lit("Document "), "doc_id").alias("question"),
        F.lit("").alias("sql"),
        "source",
        F.col("lang").alias("dashboard"),
        F.concat_ws(" ", "lang", "n_chars").alias("description"),
        "text",
    )
    return embed(rows, "text", letter_counts).drop("text", "error")


def long_words(tables: Tables) -> DataFrame:
    word = F.regexp_extract("text", "[A-Za-z]{7,}", 0)
    named = tables.benchmark.groupBy(word.alias("keyword")).agg(F.max("text").alias("content"))
    return named.where(F.col("keyword") != "")


SEARCH_SQL = f"""
WITH words AS (
  SELECT regexp_extract(text, '[A-Za-z]{{7,}}') AS keyword, max(text) AS content FROM benchmark
  GROUP BY 1 HAVING regexp_extract(text, '[A-Za-z]{{7,}}') <> ''),
asked AS (SELECT concat(conv_id, ':', turn) AS query_id, text, {LETTERS_SQL} AS v FROM conversations),
held AS (SELECT concat('d', doc_id) AS id, concat('Document ', doc_id) AS question, source, lang AS dashboard,
                concat(lang, ' ', n_chars) AS description, {LETTERS_SQL} AS w FROM documents),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 4) DESC, id) AS place
  FROM (SELECT query_id, id, question, source, dashboard, description, {COSINE_SQL.format(a="v", b="w")} AS sim
        FROM asked CROSS JOIN held) pairs
  WHERE sim >= 0.3),
hits AS (
  SELECT query_id, '' AS question, 'keyword' AS source, '' AS dashboard, content AS description,
         1.0 AS similarity, keyword AS keyword_match, 0 AS kind,
         row_number() OVER (PARTITION BY query_id ORDER BY keyword) AS place
  FROM asked JOIN words ON contains(lower(text), lower(keyword))
  UNION ALL
  SELECT query_id, question, source, dashboard, description, round(sim, 4), NULL, 1, place
  FROM near WHERE place <= 10)
SELECT query_id, question, source, dashboard, description, CAST(similarity AS DOUBLE) AS similarity, keyword_match,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, kind, place) AS INTEGER) AS rank
FROM hits
QUALIFY rank <= 10"""


@register("unified_search", SEARCH_SQL)
def unified(tables: Tables) -> DataFrame:
    asked = turns(tables).withColumn("embedding", letter_vector(F.col("text")))
    return search(asked, long_words(tables), document_index(tables)).drop("sql")


@register("unified_search_with_model", SEARCH_SQL)
def unified_with_model(tables: Tables) -> DataFrame:
    """The same with the queries embedded on the way, by the pluggable step."""
    return search(
        turns(tables), long_words(tables), document_index(tables), lambda q: embed(q, "text", letter_counts)
    ).drop("sql")


@register("search_of_stream", SEARCH_SQL)
def stream_of_questions(tables: Tables) -> DataFrame:
    """The same with the questions read as a stream until none are left."""
    folder = work_folder(tables.spark)
    asked = turns(tables).withColumn("embedding", letter_vector(F.col("text")))
    asked.write.parquet(f"{folder}/asked")
    stream = tables.spark.readStream.schema(asked.schema).parquet(f"{folder}/asked")
    words, index, out = long_words(tables), document_index(tables), f"{folder}/hits"
    search_stream(stream, words, index, out, f"{folder}/state").awaitTermination()
    return tables.spark.read.parquet(out).drop("sql", "batch")


@register(
    "search_without_vectors",
    """
WITH words AS (
  SELECT regexp_extract(text, '[A-Za-z]{7,}') AS keyword, max(text) AS content FROM benchmark
  GROUP BY 1 HAVING regexp_extract(text, '[A-Za-z]{7,}') <> '')
SELECT concat(conv_id, ':', turn) AS query_id, keyword AS keyword_match, content AS description,
       CAST(1.0 AS DOUBLE) AS similarity,
       CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY keyword) AS INTEGER) AS rank
FROM conversations JOIN words ON contains(lower(text), lower(keyword))
QUALIFY rank <= 10""",
)
def keyword_only(tables: Tables) -> DataFrame:
    found = search(turns(tables), long_words(tables), label_index(tables))
    return found.select("query_id", "keyword_match", "description", "similarity", "rank")


@register(
    "embed_documents",
    f"""
SELECT doc_id, CAST(list_sum(v) AS DOUBLE) AS letters, v[5] AS letter_e, v[26] AS letter_z,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT doc_id, {LETTERS_SQL} AS v FROM documents) t""",
)
def embedded(tables: Tables) -> DataFrame:
    done = embed(tables.documents.select("doc_id", "text"), "text", letter_counts)
    return done.select(
        "doc_id",
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("letters"),
        F.col("embedding")[4].alias("letter_e"),
        F.col("embedding")[25].alias("letter_z"),
        "error",
    )


@register(
    "index_get",
    "SELECT concat('v', vec_id) AS id, concat('Question ', vec_id) AS question, concat('label-', label) AS source "
    "FROM embeddings WHERE vec_id = (SELECT max(vec_id) // 2 FROM embeddings)",
)
def index_get(tables: Tables) -> DataFrame:
    """One row of the index by its id, without its vector."""
    middle = tables.embeddings.agg((F.max("vec_id") / 2).cast("bigint")).first()[0]
    return ix.get(label_index(tables), f"v{middle}").select("id", "question", "source")
