"""Registered queries of the operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXACT_DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query(EXACT_DEDUP_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("_row")


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files
    from .tokens import tokenizer_path

    scratch = Scratch(spark)
    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch.path("token-files"), tokenizer_path("byte_bpe_50k.json"), end=0, scratch=scratch)
    return read_token_files(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import tokenizer_path

    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=1)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


MIXING_SQL = r"""
WITH marks AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln(greatest(('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0, pow(2.0, -33)))
      / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
placed AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS position,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM placed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
final AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY position LIMIT 1),
targets AS (SELECT source, source_size, least((SELECT level FROM final) * weight, cap) AS target FROM levels),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM targets),
ahead AS (
  SELECT doc_id, size, source_size, target, epochs, round(target - epochs * source_size)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(least(size, budget - before), 0))::BIGINT AS taken FROM ahead
"""


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality_weight``: 2 for documents labelled good, 0.5 for bad, 1 for the unlabelled; of several labels the best counts."""
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    joined = docs.join(marks, "doc_id", "left")
    return joined.withColumn("quality_weight", F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)).drop("_quality")


@query(MIXING_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, slim_documents

    slim = slim_documents(table(spark, sf_dir, "documents"))
    return mix(quality_weight(slim, table(spark, sf_dir, "labels")), F.col("quality_weight")).drop("_row")


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query(WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived_pages

    return archived_pages(spark, table(spark, sf_dir, "pages"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


@query()
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN root ON vec_id = root.a
"""


@query(EMBEDDING_SQL)
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i+34], ' ') AS phrase FROM w, unnest(range(1, len(words) - 33)) AS t(i)),
starts AS (SELECT doc_id, i FROM windows WHERE phrase IN (SELECT phrase FROM windows GROUP BY phrase HAVING count(*) > 1)),
covered AS (SELECT DISTINCT doc_id, j FROM starts, unnest(range(i, i + 35)) AS t(j)),
gone AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE [words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(js, k)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""


@query(SUBSTRING_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    cut = line_dedup(table(spark, sf_dir, "documents"), short=True)
    return cut.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")


@query()
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups, without_drawn_letter

    return spelling_groups(table(spark, sf_dir, "documents"), spelled=without_drawn_letter)


HARD_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""


@query(HARD_NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
