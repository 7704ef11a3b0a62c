"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from .bpe import bpe_round_trip
from .decontamination import contamination
from .embedding_dedup import near_duplicates
from .hard_negatives import hard_negatives
from .language_id import fit_languages, held_in, identify, is_held_out
from .line_dedup import dedup_lines
from .nearest import nearest_neighbours
from .ngram_join import ngram_components
from .quality import fit_quality, score_quality
from .secrets import joined, scan_secrets
from .sharding import shard_rows
from .spelling import spelling_variants, vocabulary
from .token_counts import count_tokens, sentencepiece_pieces, zipf_scores


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL_5 = """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
d AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, d.key IS NOT NULL AND k.doc_id <> d.keeper AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_docs(spark, sf_dir), k=3, num=90, den=100).withColumnRenamed("id", "doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(held_in("doc_id"))
    out = score_quality(docs, fit_quality(docs, labels))
    return out.select("row.doc_id", is_held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_bpe_encoding(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = bpe_round_trip(_docs(spark, sf_dir).select("doc_id", "text"), path or tokenizer_file())
    return out.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    learned = fit_languages(docs.where(held_in("doc_id")))
    out = identify(spread(docs.select("doc_id", "text")), learned)
    return out.select("row.doc_id", is_held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_docs(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    scores = zipf_scores(sentencepiece_pieces(path or tokenizer_file("piece_bpe_32k.model")))
    return count_tokens(_docs(spark, sf_dir), scores).withColumnRenamed("id", "doc_id")


def op11_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(_docs(spark, sf_dir)))


SQL_11 = """
WITH RECURSIVE bits AS (
  SELECT range AS b, range AS v, 0 AS i FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
crc AS (
  SELECT doc_id, run, x, 4294967295 AS c, 0 AS i FROM r
  UNION ALL SELECT doc_id, run, x, xor(c >> 8, (SELECT t FROM tab)[(xor(c, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) & 255) + 1]), i + 1 FROM crc WHERE 2 * i < length(x)),
h AS (SELECT r.doc_id, r.run, n, xor(c, 4294967295) AS h FROM crc JOIN r USING (doc_id, run) WHERE 2 * i = length(crc.x)),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, cast(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) t),
p AS (
  SELECT DISTINCT a.word AS word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.x = b.x AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.x = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.x = b.word),
k AS (SELECT word, count(*) AS n_near, list({'m': -m, 'w': encode(other), 'o': other} ORDER BY -m, encode(other))[1] AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * v.n THEN best.o END AS form, CASE WHEN -best.m >= 10 * v.n THEN -best.m END AS form_n FROM v LEFT JOIN k USING (word)),
root AS (SELECT word, word AS at FROM f UNION ALL SELECT root.word, f.form FROM root JOIN f ON root.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root.at AS root, f.n, f.n_near, cast(f.form_n AS BIGINT) AS form_n FROM f JOIN root USING (word) JOIN f g ON g.word = root.at WHERE g.form IS NULL
"""


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("id") % 100 == 0)


SQL_13 = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: cast(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n m ON m.doc_id = p.a JOIN n k ON k.doc_id = p.b WHERE 100 * c >= 90 * (m.n + k.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

_WORDS_4 = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
SQL_4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS_4}) AS w FROM documents),
i AS (SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_WORDS_4}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS x FROM (SELECT item, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0) t),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS k, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS x FROM d, (SELECT DISTINCT m FROM iw) t WHERE len(w) >= m),
h AS (SELECT doc_id, item, unnest(range(k, k + dw.m)) AS spot FROM dw JOIN iw ON dw.x = iw.x AND dw.m = iw.m),
g AS (SELECT doc_id, count(DISTINCT spot) AS n_hit, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN g USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_ngram_jaccard_join, op2_quality_classifier, op3_bpe_encoding, op4_benchmark_decontamination, op5_line_dedup,
        op6_embedding_near_dedup, op7_sharding, op8_language_id, op9_secret_scans, op10_token_counts,
        op11_spelling_variant_grouping, op12_nearest_neighbours, op13_hard_negatives,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": SQL_1, "op4_benchmark_decontamination": SQL_4, "op5_line_dedup": SQL_5, "op11_spelling_variant_grouping": SQL_11, "op13_hard_negatives": SQL_13}
