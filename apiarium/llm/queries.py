"""The registered queries of this subpackage: thin digests of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiarium.llm import common, decontamination, exact_dedup, langid, lm, mixing, ngram_join, pii, quality, sharding, toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(common.documents(spark, sf_dir)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold_of(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(common.documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, common.labels(spark, sf_dir).filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.report(common.documents(spark, sf_dir), common.benchmark(spark, sf_dir)))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(common.documents(spark, sf_dir), shards=40)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold_of(F.col("doc_id"), 5) == 1
    model, counts = lm.fit(docs.filter(~held_out))
    return lm.score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold_of(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, common.labels(spark, sf_dir).filter(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(common.documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op3_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS a FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) < 5 THEN array_to_string(a, ' ') ELSE array_to_string(a[p : p + 4], ' ') END AS g
              FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS p FROM w WHERE len(a) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
              JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
              GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op5_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark),
        m AS (SELECT item_id, a, least(10, len(a)) AS m FROM i WHERE len(a) > 0),
        k AS (SELECT DISTINCT item_id, m, array_to_string(a[p : p + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(a) - m + 2)) AS p FROM m)),
        x AS (SELECT doc_id, p, m, array_to_string(a[p : p + m - 1], ' ') AS g
              FROM (SELECT doc_id, a, m, unnest(range(1, greatest(len(a) - m, -1) + 2)) AS p FROM d, (SELECT DISTINCT m FROM m))),
        h AS (SELECT doc_id, p, x.m, item_id FROM x JOIN k ON k.m = x.m AND k.g = x.g),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(a) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
}
