"""Queries of the enrichment plans, with the deterministic model. It refuses every prompt that holds an `@`."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import enrich as N
from folioforge.operators import enrichment as E
from folioforge.plans.catalogue import SPLIT_SQL, query, stop_words_sql

TOPIC = {"type": "object", "properties": {"topic": {"type": "string"}, "n": {"type": "integer"}}, "required": ["topic"]}
BLANK_SQL = f"NOT regexp_matches(text, '[^{X.BLANK}]')"


def parts_sql(tokens: int) -> str:
    """Sections of about `tokens` tokens that hold text: (doc_id, k, of, part)."""
    return f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS k, count(*) OVER (PARTITION BY doc_id) AS of, part FROM (
 SELECT s.doc_id, s.index, substring(text, s.start + 1, s."end" - s.start) AS part FROM ({SPLIT_SQL.format(t=2 * tokens)}) s JOIN documents d ON d.doc_id = s.doc_id)
 WHERE regexp_matches(part, '[^{X.BLANK}]'))"""


def mock_sql(prompt: str) -> str:
    return f"'Mock ' || substring(sha256({prompt}), 1, 8)"


@query("documents", f"""WITH p AS (SELECT doc_id, octet_length(encode(part)) AS w, {stop_words_sql('part')} AS h FROM {parts_sql(600)} WHERE k <= 64),
 v AS (SELECT doc_id, w, list_max(h).lang AS lang, list_max(h).n / list_sum([x.n FOR x IN h]) AS c FROM p WHERE list_max(h).n > 0),
 l AS (SELECT doc_id, lang, CAST(sum(w) AS DOUBLE) AS w, sum(c * w) AS cw FROM v GROUP BY 1, 2),
 b AS (SELECT doc_id, sum(w) AS total, round(sum(cw) / sum(w), 3) AS sure, list({{'w': w, 'lang': lang}} ORDER BY w DESC, lang DESC) AS r FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(CASE WHEN r[1].w < 0.75 * total AND coalesce(r[2].w, 0) >= 0.2 * total THEN 'mul' WHEN sure < 0.3 THEN 'und' ELSE r[1].lang END, 'und') AS language, coalesce(sure, 0) AS language_confidence
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def doc_language_vote(df):
    return E.detected(df, "doc_id", "text")


@query("documents", f"""WITH s AS (SELECT doc_id, string_agg({mock_sql("'Summarise part ' || k || ' of ' || of || ', keeping facts, names and numbers:' || chr(10) || part")}, chr(10) || chr(10) ORDER BY k) AS body FROM {parts_sql(500)} GROUP BY 1)
SELECT d.doc_id, sha256(CASE WHEN ceil(length(text) / 4) <= 1000 THEN text ELSE body END) AS text_sha256, ceil(length(text) / 4) > 1000 AS summarised FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""")
def doc_reduced(df):
    made = E.reduced(df, "doc_id", "text", 1000, N.Mock())
    whole = df.select(F.col("doc_id").alias("id"), (X.tokens_by_chars(F.col("text")) > 1000).alias("summarised"))
    return made.join(whole, F.col("doc_id") == F.col("id")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "summarised")


@query("documents", f"""WITH t AS (SELECT doc_id, CASE WHEN bool_or(contains(part, '@')) THEN NULL ELSE string_agg({mock_sql("'Translate to de:' || chr(10) || part")} || chr(10), chr(10) ORDER BY k) END AS body FROM {parts_sql(256)} GROUP BY 1)
SELECT d.doc_id, body AS translated_content, CASE WHEN body IS NOT NULL THEN 'de' END AS translated_language, CASE WHEN {BLANK_SQL} THEN 'skipped' WHEN body IS NULL THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN {BLANK_SQL} THEN 'empty content' WHEN body IS NULL THEN 'refused' END AS error, CASE WHEN NOT {BLANK_SQL} AND body IS NULL THEN 'translation failed: refused' ELSE '' END AS warnings
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""")
def doc_translated(df):
    features = E.Features(title=None, summary=None, translate_to="de", max_output_tokens=512)
    state = F.col("feature_status")["translation"]
    made = E.enriched(df, "doc_id", N.Mock(refuse="@"), features, "text")
    return made.select("doc_id", "translated_content", "translated_language", state["status"].alias("status"), state["error"].alias("error"), F.array_join("warnings", "; ").alias("warnings"))


@query("documents", f"""WITH d AS (SELECT doc_id, {BLANK_SQL} AS blank, contains(text, '@') AS refused FROM documents)
SELECT doc_id, CASE WHEN blank OR refused THEN 'doc ' || doc_id ELSE 'sample' END AS title, CASE WHEN NOT blank AND NOT refused THEN 'sample' END AS summary,
 CASE WHEN blank THEN 'und' WHEN NOT refused THEN 'sample' END AS language, CASE WHEN blank THEN 0.0::DOUBLE WHEN NOT refused THEN 1.0::DOUBLE END AS language_confidence,
 CASE WHEN blank THEN 'completed local ' WHEN refused THEN 'completed local_fallback refused' ELSE 'completed llm ' END AS title_status, CASE WHEN blank THEN 'completed local_extractive ' WHEN refused THEN 'failed llm refused' ELSE 'completed llm ' END AS summary_status,
 CASE WHEN blank THEN 'completed local ' WHEN refused THEN 'failed llm refused' ELSE 'completed llm ' END AS language_status, 'disabled' AS translation_status, CASE WHEN refused AND NOT blank THEN 'enrichment failed: refused' ELSE '' END AS warnings FROM d""")
def doc_enriched(df):
    made = E.enriched(df, "doc_id", N.Mock(refuse="@"), E.Features(title="llm", summary="llm", language="llm"), "text", F.format_string("doc_%d.txt", "doc_id"))
    state = lambda f: F.concat_ws(" ", F.col("feature_status")[f]["status"], F.col("feature_status")[f]["method"], F.coalesce(F.col("feature_status")[f]["error"], F.lit(""))).alias(f"{f}_status")
    return made.select("doc_id", "title", "summary", "language", "language_confidence", state("title"), state("summary"), state("language"), F.col("feature_status")["translation"]["status"].alias("translation_status"), F.array_join("warnings", "; ").alias("warnings"))


_CUT = E.Features(schema=TOPIC, max_input_tokens=4500).extract_bytes


@query("documents", f"""WITH b AS (SELECT doc_id, text, {BLANK_SQL} AS blank, encode(text) AS raw FROM documents),
 c AS (SELECT *, contains(CAST(text AS VARCHAR)[1:{_CUT}], '@') AS any, (SELECT max(i) FROM range({_CUT} - 3, {_CUT} + 1) AS t(i) WHERE hex(raw[i + 1:i + 1]) NOT BETWEEN '80' AND 'BF') AS cut FROM b),
 n AS (SELECT *, octet_length(raw) > {_CUT} AS long, contains(hex(CASE WHEN octet_length(raw) > {_CUT} THEN raw[1:cut] ELSE raw END), '40') AND regexp_matches(hex(CASE WHEN octet_length(raw) > {_CUT} THEN raw[1:cut] ELSE raw END), '^(..)*40') AS refused FROM c)
SELECT doc_id, CASE WHEN NOT blank AND NOT refused THEN '{{"n": 1, "topic": "sample"}}' END AS extracted, CASE WHEN blank THEN 'skipped' WHEN refused THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN blank THEN 'empty content' WHEN refused THEN 'refused' END AS error, CASE WHEN NOT blank AND refused THEN 422 ELSE 200 END AS code,
 CASE WHEN NOT blank AND long THEN 'structured extraction used the first ' || cut || ' of ' || octet_length(raw) || ' bytes of content' END AS note FROM n""")
def doc_extracted(df):
    return E.extract_operation(df, "doc_id", N.Mock(refuse="@"), TOPIC, "text", 4500)
