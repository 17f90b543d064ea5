"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm import bpe, filter_audit, fingerprints, html_text, licenses, line_quality, packing, setsketch, suffix_levels, toxicity, urls, wavelet, whitening
from exposure.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), wrapped=True)
    joined = {c: F.array_join(c, ",") for c in ("base", "labels")}
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined["base"].alias("base_labels"), joined["labels"].alias("labels"), "score")


def _license_sql() -> str:
    word, fold = _sql_text(licenses.WORD), f"translate(%s, '{urls.UPPER}', '{urls.LOWER}')"
    phrases = ", ".join(f"([{', '.join(map(_sql_text, p.split()))}], {_sql_text(label)})" for p, label in licenses.PHRASES)
    templates = ", ".join(f"([{', '.join(map(_sql_text, licenses.template_words(t)))}], {_sql_text(t.label)})" for t in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {fold % "coalesce(text, '')"} AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, {word}) AS words FROM d),
phrases(words, label) AS (VALUES {phrases}), templates(words, label) AS (VALUES {templates}),
placed AS (SELECT k, unnest(range(len(words))) AS i, words FROM w),
b AS (SELECT k, i, label FROM placed a JOIN phrases p ON a.words[i + 1] = p.words[1] AND a.words[i + 1 : i + len(p.words)] = p.words),
base AS (SELECT k, count(*) AS n, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY k),
lines AS (SELECT k, list_distinct(regexp_extract_all(line, {word})) AS words FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT k, label, len(list_intersect(l.words, t.words)) / len(t.words) AS containment FROM lines l, templates t WHERE len(list_intersect(l.words, t.words)) >= 0.8 * len(t.words)),
best AS (SELECT k, max(containment) AS score FROM m GROUP BY k),
base_labels AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY k),
labels AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM b UNION SELECT k, label FROM m) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d JOIN w USING (k) LEFT JOIN base USING (k) LEFT JOIN best USING (k) LEFT JOIN base_labels USING (k) LEFT JOIN labels USING (k)"""


ORACLES["op1_license_scan"] = _license_sql()


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.default_rules())
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("patterns", ",").alias("patterns"))


def _url_sql() -> str:
    rules = urls.default_rules()
    values = lambda kind: ", ".join(f"({_sql_text(r.name)}, {_sql_text(r.verdict)}, {_sql_text(r.regex)})" for r in rules if r.kind == kind)
    fold = f"translate(%s, '{urls.UPPER}', '{urls.LOWER}')"
    return f"""
WITH a AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
b AS (SELECT k, page_id, {fold % "regexp_extract(after, '^[^/?#]*')"} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
path_rules(rule, verdict, regex) AS (VALUES {values("path")}),
pattern_rules(rule, verdict, regex) AS (VALUES {values("pattern")}),
p AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM b JOIN path_rules ON regexp_matches(host || path, regex) GROUP BY k),
m AS (SELECT k, string_agg(rule, ',' ORDER BY rule) AS patterns, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS bad
      FROM b JOIN pattern_rules ON regexp_matches({fold % "host || path"}, regex) GROUP BY k)
SELECT page_id, host, path, p.rule, coalesce(p.verdict, CASE WHEN m.bad THEN 'block' ELSE 'allow' END) AS verdict, coalesce(m.patterns, '') AS patterns
FROM b LEFT JOIN p USING (k) LEFT JOIN m USING (k)"""


ORACLES["op2_url_rules"] = _url_sql()


@query
def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.edited_likeness(docs, fingerprints.rarity(docs))


@query
def op5_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality.judge(docs, line_quality.fit(docs, table(spark, sf_dir, "labels"))).drop("line_labels")


@query
def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query
def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.digests(table(spark, sf_dir, "documents"), length=200)


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary, pattern), vocabulary)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.postings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Distinct steps of an order are a filter and the set of those before it, so each is counted once; orders then pick theirs.
ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL),
o(filter_order, before, step, bit, prior) AS (
  SELECT '', 0, 0, 0, 0
  UNION ALL
  SELECT filter_order || chr(65 + b::INT), before + (1 << b::INT), step + 1, 1 << b::INT, before FROM o, range(5) r(b)
  WHERE before & (1 << b::INT) = 0),
whole AS (SELECT filter_order FROM o WHERE step = 5),
steps AS (SELECT w.filter_order, o.step, o.bit, o.prior FROM whole w JOIN o ON o.step > 0 AND starts_with(w.filter_order, o.filter_order)),
c AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (prior | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & prior = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & prior > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit > 0 AND mask & prior = 0) AS good_lost, sum(bad) FILTER (mask & bit > 0 AND mask & prior = 0) AS toxic_lost
  FROM g, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM c"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query
def op13_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
