"""The contract queries of the operators and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from .licenses import oracle as licenses_sql
from .quality import RULES, STOP_WORDS
from .spelling import ORACLE_SQL as SPELLING_SQL


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii

    return _digest(find_pii(table(spark, sf_dir, "documents")), KINDS, lambda x: x.getField("base"))


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import token_records

    return token_records(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"))


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.getField("kind"), x.getField("start"), x.getField("end"))), ",")


def _digest(found: DataFrame, kinds: Sequence[str], is_base: Callable[[Column], Column] | None = None) -> DataFrame:
    """Counts of the base spans by kind, their SHA-256, and all spans. Base are those of the kinds, unless `is_base` says which."""
    base = F.filter("spans", is_base or (lambda x: x.getField("kind").isin(list(kinds))))
    of_kind = lambda k: F.filter(base, lambda x: x.getField("kind") == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, find_secrets

    return _digest(find_secrets(table(spark, sf_dir, "documents")), KINDS[:3])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import find_licenses, license_digest

    return license_digest(find_licenses(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_simhash, op3_pii, op5_suffix_tree_scores, op6_toxicity, op8_quality_rules, op4_best_fit_packing, op7_token_records, op9_bpe, op10_embedding_dedup, op11_hard_negatives, op12_spelling_variants, op13_license_scan)}
#: op8 restates the counts and the threshold table over lists; op10 links pairs and follows them to a fixed point.
_STOP = "', '".join(STOP_WORDS)


def _fails(r) -> str:
    whole = r.of or "1"
    bad = [f"{r.value} > {r.most!r}::DOUBLE * {whole}"] if r.most is not None else []
    bad += [f"{r.value} < {r.least!r}::DOUBLE * {whole}"] if r.least is not None else []
    return f"({whole} > 0 AND n_words >= {r.words} AND ({' OR '.join(bad)}))"


ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, [x for x in regexp_split_to_array(text, '[ \\t-\\r]+') if x <> ''] AS ws, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^ \\t-\\r]')] AS ls FROM t),
    g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)),
    d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
    c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM d) GROUP BY 1),
    k AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks, len([x for x in ws if lower(x) in ('{_STOP}')]) AS n_stop_words FROM w LEFT JOIN c ON c.r = w.r),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM k)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(map(_fails, RULES))}) AS kept FROM b""",
    "op11_hard_negatives": NEGATIVES_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_license_scan": licenses_sql(),
    "op10_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    ok AS (SELECT vec_id, label, e FROM v WHERE len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
    SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
}
