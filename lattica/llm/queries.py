"""Registered queries of this subpackage, one per operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import collocations, decontaminate, htmltext, jaccard, licenses, packing, perplexity, pulearning, search, sharding, suffixdedup, tokencount, wavelet
from lattica.llm.tables import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        LLM_QUERIES[name] = function
        if sql is not None:
            LLM_ORACLES[name] = sql
        return function

    return keep


@query("op4_best_fit_shards")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op6_pattern_packing")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query("op8_wavelet_token_files")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_index(table(spark, sf_dir, "documents"))


@query("op5_perplexity_rules")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


@query("op3_suffix_array_decontamination")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_block_rules_html")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


@query("op2_positive_unlabelled")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearning.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_adaptive_prefix_join")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)


@query("op1_suffix_array_levels")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removal_report(table(spark, sf_dir, "documents"))


@query("op11_suffix_quicksort_phrases", r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM places),
totals AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang),
ones AS (SELECT lang, w1, count(*) AS f FROM grams GROUP BY lang, w1),
twos AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10),
threes AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
covers AS (
  SELECT lang, w1, w2, max(f) AS longest
  FROM (SELECT lang, w1, w2, f FROM threes UNION ALL SELECT lang, w2, w3, f FROM threes) GROUP BY lang, w1, w2),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
  FROM twos t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1 JOIN ones y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN covers c ON c.lang = t.lang AND c.w1 = t.w1 AND c.w2 = t.w2
  WHERE c.longest IS NULL OR 100 * c.longest < 50 * t.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
  FROM threes t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1 JOIN twos y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
  FROM threes t JOIN twos x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN ones y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000""")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_license_signature_rules")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


@query("op13_interval_ranked_search", r"""WITH words AS (
  SELECT d, doc_id, unnest(ws) AS term FROM (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)),
tfs AS (SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY d, term),
sizes AS (SELECT d, sum(tf)::BIGINT AS n FROM tfs GROUP BY d),
totals AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM sizes),
asked AS (
  SELECT i, item_id, term, count(*) AS q FROM (
    SELECT i, item_id, unnest(ws) AS term FROM (
      SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark))
  GROUP BY i, item_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * totals.N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, totals.N),
scores AS (
  SELECT a.i, a.item_id, t.d, t.doc_id, CAST(sum(a.q * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + ((75 * s.n * totals.N) // totals.L))))) AS BIGINT) AS score
  FROM asked a JOIN weights w USING (term) JOIN tfs t USING (term) JOIN sizes s USING (d), totals GROUP BY a.i, a.item_id, t.d, t.doc_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10""")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
