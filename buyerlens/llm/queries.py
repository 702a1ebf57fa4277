"""The operators as named queries over whole tables, with SQL statements where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.llm import (
    byte_pairs, contamination, divergence, language_model, licenses, lines, mixing, quality, repeats, rules, simhash,
    toxicity, whitening,
)
from buyerlens.llm.text import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), kept_text=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash_near_dedup, op3_quality_classifier, op4_substring_dedup, op5_line_dedup,
        op6_quality_rules, op7_license_scan, op8_benchmark_decontamination, op9_mixing, op10_language_model,
        op11_byte_pairs, op12_source_divergence, op13_whitening,
    )
}

# Words of a text are found the same way in every statement.
_WORDS = r"""list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

ORACLE = {
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
win AS (SELECT doc_id, i, list_slice(words, i, i + {repeats.WINDOW - 1}) AS k
        FROM d, UNNEST(range(1, len(words) - {repeats.WINDOW - 2})) AS t(i)),
first AS (SELECT k, min(doc_id) AS earliest FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (k), UNNEST(range(0, {repeats.WINDOW})) AS u(j)
         WHERE earliest < doc_id),
w AS (SELECT doc_id, words[p] AS word, p FROM d, UNNEST(range(1, len(words) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, p, string_split(text, chr(10))[p] AS line
           FROM documents, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS t(p)),
tok AS (SELECT *, {_WORDS.format("line")} AS words FROM l),
cut AS (SELECT *, least(len(words), greatest({lines.DEPTH}, ceil(len(words) * {lines.SIMILARITY}::DOUBLE)::BIGINT)) AS fixed
        FROM tok),
leaf AS (SELECT doc_id, p, line, len(words) || ' ' ||
           regexp_replace(array_to_string(words[1:fixed], ' '), '[^ ]*[0-9][^ ]*', '{lines.FIELD}', 'g') AS leaf,
           len(words) >= {lines.MIN_TOKENS} AS able FROM cut),
often AS (SELECT leaf, min(doc_id) AS earliest FROM leaf WHERE able GROUP BY leaf
          HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
judged AS (SELECT leaf.*, coalesce(able AND earliest < doc_id, false) AS gone FROM leaf LEFT JOIN often USING (leaf))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS n_all FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n_all FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + ({divergence.UNIT}::HUGEINT * (coalesce(c.n, 0) + {divergence.SMOOTHING})) // (total.n_all + {divergence.SMOOTHING} * v.v) AS p,
        1 + ({divergence.UNIT}::HUGEINT * (k.n_lang + {divergence.SMOOTHING})) // (v.n_all + {divergence.SMOOTHING} * v.v) AS q
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(gap.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}""",
}
