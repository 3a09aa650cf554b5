"""The registered corpus queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, table
from quire.llm.embeddings import embedding_groups
from quire.llm.languages import fit_languages, held_out, identify_languages
from quire.llm.latent import benchmark_hits
from quire.llm.mixing import mixing_rates
from quire.llm.pseudo import score_documents, train
from quire.llm.simhash import simhash_groups
from quire.llm.suffixes import repeated_bytes
from quire.llm.toxicity import fit_toxicity, score_toxicity
from quire.llm.windows import repeated_windows
from quire.llm.wordpieces import count_tokens, load_ranks

#: A public tokenizer's pieces; set QUIRE_VOCABULARY to use another rank file.
VOCABULARY = os.environ.get("QUIRE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_bytes(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where("doc_id is not null").where(~held_out("doc_id", 4, 2)))
    found = identify_languages(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


#: Wanted shares of tokens of the labelled kinds (q: quality, t: toxic).
TARGETS = {"q1t0": 0.85, "q0t0": 0.10, "q1t1": 0.03, "q0t1": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), TARGETS, Scratch(spark, "op3"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_ranks(VOCABULARY))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op6"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"), F.array_max("hits.similarity").alias("similarity"))


def op7_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = ~held_out("doc_id", 5, 0)
    scored = score_toxicity(docs, fit_toxicity(docs.where(learn), labels.where(learn), Scratch(spark, "op8")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_windows(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "op10")
    return score_documents(docs, train(docs, scratch), scratch)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_languages": op2_languages,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_embedding_groups": op7_embedding_groups,
    "op8_toxicity": op8_toxicity,
    "op9_repeated_windows": op9_repeated_windows,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
}

ORACLES: dict[str, str] = {
    "op1_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2198) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS base FROM d)),
s AS (
  SELECT doc_id, base + i AS j, hash(substr(part, 2 * i + 1, 200)) AS k
  FROM (SELECT doc_id, base, part, unnest(range(least(1000, length(part) // 2 - 99))) AS i FROM p)
), twice AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
v AS (SELECT s.doc_id, j, substr(part, 2 * (j - base) + 1, 200) AS w FROM s JOIN twice USING (k) JOIN p ON p.doc_id = s.doc_id AND p.base = j - j % 1000),
f AS (SELECT w, min((doc_id, j)) AS f FROM v GROUP BY w HAVING count(*) > 1),
bad AS (SELECT doc_id, j, coalesce(j > 100 + lag(j) OVER (PARTITION BY doc_id ORDER BY j), true) AS fresh FROM v JOIN f USING (w) WHERE f < (doc_id, j)),
island AS (
  SELECT doc_id, min(j) AS a, max(j) + 100 AS b
  FROM (SELECT doc_id, j, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY j) AS run FROM bad) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS before, a, b,
    CASE WHEN lead(a) OVER w IS NULL THEN substr(h, 2 * b + 1) ELSE '' END AS after
  FROM island JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), g AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, sha256(unhex(string_agg(before || after, '' ORDER BY a))) AS kept_sha256 FROM kept GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  coalesce(kept_sha256, sha256(encode(coalesce(text, '')))) AS kept_sha256
FROM d JOIN documents USING (doc_id) LEFT JOIN g USING (doc_id)
""",
    "op7_embedding_groups": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, c.c = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
""",
    "op9_repeated_windows": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM d),
s AS (SELECT doc_id, j, ws[j + 1 : j + 13] AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS j FROM d)),
f AS (SELECT k, min(doc_id) AS f FROM s GROUP BY k),
bad AS (SELECT doc_id, j, true AS bad FROM s JOIN f USING (k) WHERE f < doc_id),
c AS (
  SELECT doc_id, j, w, count(bad) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM w LEFT JOIN bad USING (doc_id, j)
), g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
  FROM c GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""",
}
