"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.bpe import Vocabulary, decode, encode
from tablewright.llm.hard_negatives import hard_negatives
from tablewright.llm.line_dedup import SHORT_CHARS, line_dedup
from tablewright.llm.lm_scoring import lm_scores
from tablewright.llm.mixing import mixture
from tablewright.llm.ngram_join import similarity_classes
from tablewright.llm.packing import pack
from tablewright.llm.quality_classifier import quality_scores
from tablewright.llm.quality_rules import quality_rules, trusted_documents
from tablewright.llm.resampling import importance_ranks
from tablewright.llm.secret_scan import secret_digests, secret_spans
from tablewright.llm.toxicity import fit_severity, severity
from tablewright.llm.vector_search import neighbours

CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CORPUS_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def wrap(build):
        CORPUS_QUERIES[name] = build
        if oracle is not None:
            CORPUS_ORACLES[name] = oracle
        return build

    return wrap


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules(docs, trusted_documents(docs, table(spark, folder, "labels")))


@query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(secret_spans(table(spark, folder, "documents")))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return severity(docs, fit_severity(docs, table(spark, folder, "labels")))


@query("op10_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = Vocabulary.from_file(public_tokenizers.path("word_bpe_49k.json"))
    done = decode(encode(table(spark, folder, "documents"), vocabulary), vocabulary)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return pack(table(spark, folder, "documents"), file.read())


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_classes(table(spark, folder, "documents"))


@query("op7_line_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents"), short=SHORT_CHARS)


@query("op3_lm_scoring")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(table(spark, folder, "embeddings"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"))


# CRC by a table of its 256 byte steps, over the bytes that the text's hexadecimal form tells.
RESAMPLING_SQL = r"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
              ELSE c >> 1 END) ORDER BY i) AS step FROM range(256) r(i)),
folded AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (),
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
grams AS (
  SELECT side, row, unnest(words) AS gram FROM folded
  UNION ALL
  SELECT side, row, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM folded),
kinds AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)),
placed AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1),
             lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
         lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM kinds, steps),
counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM grams JOIN placed USING (gram)
  GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM counted) + 10000) AS DOUBLE)
                      / CAST((s + 1) * ((SELECT sum(t) FROM counted) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counted),
sums AS (
  SELECT row, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM grams JOIN placed USING (gram) JOIN gains USING (bucket)
  WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM folded LEFT JOIN sums USING (row) WHERE side = 'd'),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place
  FROM noisy)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 25 * (SELECT count(*) FROM noisy WHERE n_words >= 20) // 100 THEN place END AS rank
FROM ranked"""


@query("op11_importance_resampling", RESAMPLING_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return importance_ranks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


NEGATIVES_SQL = """
WITH held AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM held a JOIN held b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE alike
  QUALIFY place <= 5),
found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
   AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved))


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(sha256('13:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ordered AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS k FROM sources),
cuts AS (
  SELECT 0 AS k, CAST(sum(source_size) AS BIGINT) AS words, CAST(sum(weight) AS BIGINT) AS shares FROM ordered
  UNION ALL
  SELECT k, CAST((SELECT sum(source_size) FROM ordered) - sum(cap) OVER (ORDER BY k) AS BIGINT),
         CAST((SELECT sum(weight) FROM ordered) - sum(weight) OVER (ORDER BY k) AS BIGINT) FROM ordered),
cut AS (
  SELECT c.k, words, shares FROM cuts c LEFT JOIN ordered o ON o.k = c.k + 1
  WHERE o.k IS NULL OR CAST(weight * words AS DOUBLE) / shares <= cap ORDER BY c.k LIMIT 1),
aims AS (
  SELECT source, source_size, CASE WHEN o.k <= cut.k THEN CAST(cap AS DOUBLE) ELSE CAST(weight * words AS DOUBLE) / shares END AS target
  FROM ordered o, cut),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM aims),
running AS (
  SELECT source, hash, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto
  FROM sized GROUP BY source, hash),
taken AS (
  SELECT r.source, hash, source_size, target, whole, target - whole * source_size AS rest,
         CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END AS more
  FROM running r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + more) AS BIGINT) AS taken
FROM sized s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.hash = t.hash"""


@query("op13_source_mixing", MIXING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents")).drop("copies")
