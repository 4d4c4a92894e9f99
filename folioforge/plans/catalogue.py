"""Every query of the library by name, with the DuckDB SQL that checks it.

Test tables stand in for the document model: `documents` are source texts, `pages` HTML sources, `conversations` structured
Markdown, `events` the request log, `orders` jobs, `lineitem` their timeline and intervals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import jsonops as J
from folioforge.functions import locations as S
from folioforge.functions import markdown as M
from folioforge.functions import text as X
from folioforge.operators import convert as V
from folioforge.operators import enrich as N
from folioforge.operators import oplog as L
from folioforge.operators import ranges as R
from folioforge.sources import html as H
from folioforge.sources import sinks as K
from folioforge.streaming import jobs as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NORMAL = r"""regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\r\f]+(\n|\z)', '\1', 'g'), '\n\n\n+', chr(10)||chr(10), 'g'), '^\n+|\n+$', '', 'g')"""
LOG = """(SELECT event_id AS seq, epoch_us(ts) // 1000 AS created_at, event_type AS operation, 'u'||user_id AS requester_id, value AS duration_ms, props,
 CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS execution_status FROM events)"""


TITLE_SQL = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


def entities_sql(x: str) -> str:
    for name, value in X.ENTITIES.items():
        x = f"replace({x}, '&{name};', '{value.replace(chr(39), chr(39) * 2)}')"
    return x


def query(table: str, sql: str | None = None, name: str | None = None):
    """Register f(df) over one table, or f(spark, dir) over several where table is empty."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = (lambda spark, d: f(spark.read.parquet(f"{d}/{table}.parquet"))) if table else f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Documents: statistics, normalising, titles, chunks


@query("documents", f"SELECT doc_id, len(regexp_extract_all(text, $w${X.WORD}$w$)) AS words, length(text) AS characters, strlen(text) AS content_bytes, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(ceil(len(regexp_extract_all(text, $w${X.WORD}$w$)) / 500) AS BIGINT) AS pages FROM documents")
def doc_stats(df):
    return V.statistics(df, "text").select("doc_id", "words", "characters", "content_bytes", "tokens", "pages")


@query("documents", "SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(ceil(strlen(text) / 4)) AS BIGINT) AS tokens FROM documents")
def doc_totals(df):
    return df.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"), F.sum(X.tokens_by_bytes(F.col("text"))).alias("tokens"))


@query("documents", f"SELECT doc_id, sha256(CASE WHEN {NORMAL.format(x='text')} = '' THEN '' ELSE {NORMAL.format(x='text')} || chr(10) END) AS content_sha256 FROM documents")
def doc_normalize(df):
    return df.select("doc_id", F.sha2(M.normalized(F.col("text")), 256).alias("content_sha256"))


@query("documents", "SELECT doc_id, replace(replace(source || ' ' || doc_id, '_', ' '), '-', ' ') AS title FROM documents")
def doc_title(df):
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return df.select("doc_id", M.title_udf(F.lit(None).cast("string"), F.col("text"), name).alias("title"))


SUMMARY_SQL = r"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(string_split(text, chr(10))[i], '^\s+|\s+$', '', 'g')) AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
q AS (SELECT doc_id, i, regexp_replace(ltrim(line, '-*+'), '^\s+|\s+$', '', 'g') AS line FROM l WHERE strlen(line) >= 30 AND left(line, 1) NOT IN ('#', '|', '>')),
p AS (SELECT doc_id, i, j, regexp_replace(string_split(regexp_replace(line, '([.!?。]) ', '\1' || chr(1) || ' ', 'g'), chr(1))[j], '^\s+|\s+$', '', 'g') AS part
 FROM q, unnest(range(1, len(string_split(regexp_replace(line, '([.!?。]) ', '\1' || chr(1) || ' ', 'g'), chr(1))) + 1)) u(j)),
n AS (SELECT *, row_number() OVER w AS k, sum(strlen(part)) OVER w AS upto FROM p WHERE strlen(part) >= 20 WINDOW w AS (PARTITION BY doc_id ORDER BY i, j))
SELECT d.doc_id, 'Extractive summary: ' || string_agg(part, ' ' ORDER BY k) AS summary FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND k <= 5 AND upto + greatest(k - 2, 0) <= 600 GROUP BY 1"""


@query("documents", SUMMARY_SQL)
def doc_summary(df):
    return df.select("doc_id", M.summary_udf(F.col("text")).alias("summary"))


SPLIT_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, i AS n, string_split(text, chr(10))[i] || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
), f AS (
  SELECT doc_id, n, length(line) AS upto, length(line) AS size, CAST(0 AS BIGINT) AS chunk, ceil(length(line) / 4) >= {t} AS closed FROM l WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, f.upto + length(line), CASE WHEN f.closed THEN 0 ELSE f.size END + length(line), f.chunk + CAST(f.closed AS BIGINT),
    ceil((CASE WHEN f.closed THEN 0 ELSE f.size END + length(line)) / 4) >= {t} FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1
)
SELECT doc_id, chunk AS index, CAST(min(upto - size) FILTER (size > 0) AS BIGINT) AS start, CAST(max(upto) AS BIGINT) AS "end", CAST(ceil(max(size) / 4) AS BIGINT) AS tokens FROM f WHERE size > 0 GROUP BY doc_id, chunk"""


@query("documents", SPLIT_SQL.format(t=256))
def doc_chunks_split(df):
    made = V.chunks(df, "doc_id", "text", V.Options(chunk_size=128, chunk_overlap=0))
    return made.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("index", "start", "end", "tokens")])


@query("documents")
def doc_chunks(df):
    made = V.chunks(df.withColumn("content", M.normalized(F.col("text"))), "doc_id")
    return made.select("doc_id", F.col("index").cast("long").alias("index"), "content", F.array_join("headings", " > ").alias("headings"), F.col("tokens").cast("long").alias("tokens"), F.col("overlap").cast("long").alias("overlap"))


@query("documents")
def doc_convert(df):
    texts = df.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", F.lit("text").alias("format"))
    return V.convert(texts).select("path", "title", "summary", "words", "tokens", F.size("chunks").cast("long").alias("chunks"), F.to_json("feature_status").alias("feature_status"))


@query("documents", rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{X.BLANK}]')) AS BIGINT) AS visible, len(regexp_extract_all(text, '[^{X.BLANK}]')) < 20
 OR len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]')) / greatest(len(regexp_extract_all(text, '[^{X.BLANK}]')), 1) < 0.5 OR len(regexp_extract_all(text, '{X.GARBAGE}')) / greatest(len(regexp_extract_all(text, '[^{X.BLANK}]')), 1) >= 0.05
 OR (doc_id % 3 > 0 AND len(regexp_extract_all(text, '[^{X.BLANK}]')) < 200) AS needs_ocr FROM documents""")
def doc_quality_ocr(df):
    return df.select("doc_id", X.visible(F.col("text")).cast("long").alias("visible"), X.needs_ocr(F.col("text"), F.col("doc_id") % 3).alias("needs_ocr"))


@query("documents", "SELECT sha256(text) AS cache_key, min(doc_id) AS doc_id, count(*) AS waiting FROM documents GROUP BY text")
def doc_single_flight(df):
    return df.groupBy(F.sha2("text", 256).alias("cache_key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("waiting"))


@query("documents", "WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) SELECT CASE WHEN c.text IS NULL THEN 'miss' ELSE 'hit' END AS cache, count(*) AS n FROM documents d LEFT JOIN c ON d.text = c.text GROUP BY 1")
def doc_cache_lookup(df):
    keyed = df.withColumn("cache_key", F.sha2("text", 256))
    cache = keyed.filter("doc_id % 2 = 0").select("cache_key", F.lit(1000).alias("created_at")).distinct()
    hit, miss = V.with_cache(keyed, cache, 1500, 1000)
    return hit.select(F.lit("hit").alias("cache")).unionByName(miss.select(F.lit("miss").alias("cache"))).groupBy("cache").agg(F.count(F.lit(1)).alias("n"))


@query("documents", r"""SELECT doc_id, sha256(CASE WHEN b = '' OR ends_with(b, chr(10) || chr(10)) THEN b ELSE b || chr(10) || chr(10) END) AS body FROM (
 SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda a, x: CASE
  WHEN x = '' THEN CASE WHEN a = '' OR ends_with(a, chr(10) || chr(10)) THEN a ELSE a || chr(10) || chr(10) END
  WHEN a = '' OR ends_with(a, chr(10) || chr(10)) THEN a || x
  WHEN ends_with(a, '-') AND NOT ends_with(a, ' -') THEN a[:-2] || x ELSE a || ' ' || x END, '') AS b FROM documents)""")
def doc_paragraphs(df):
    return df.select("doc_id", F.sha2(M.paragraphs_udf(F.col("text")), 256).alias("body"))


@query("documents", "SELECT doc_id, CASE WHEN strlen(text) <= 4194304 THEN 'inline' ELSE 'conversion_required' END AS route, CASE WHEN strlen(text) <= 2000 THEN 'inline' ELSE 'conversion_required' END AS small FROM documents")
def doc_inline_cap(df):
    return df.select("doc_id", X.inline_route(F.col("text")).alias("route"), X.inline_route(F.col("text"), 2000).alias("small"))


@query("documents", """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')), ' ') AS t FROM documents)
SELECT doc_id, len(list_filter(t, lambda x: x IN ('the','of','and','to','in','is','that','it','for','was','with','on','are','be','this'))) AS en,
 len(list_filter(t, lambda x: x IN ('der','die','und','das','ist','nicht','ein','zu','den','mit','sich','auf','für','von','dem'))) AS de FROM w""")
def doc_stop_words(df):
    t = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), " ")
    return df.select("doc_id", N.stop_words_in(t, "en").cast("long").alias("en"), N.stop_words_in(t, "de").cast("long").alias("de"))


def stop_words_sql(text: str) -> str:
    """A list of (n, lang): how many stop words of each language the text holds."""
    words = f"string_split(lower(regexp_replace({text}, '[^\\p{{L}}]+', ' ', 'g')), ' ')"
    return "[" + ", ".join(f"{{'n': len([w FOR w IN {words} IF w IN ({', '.join(map(repr, N.STOP_WORDS[x]))})]), 'lang': '{x}'}}" for x in N.STOP_WORDS) + "]"


@query("documents", f"""WITH h AS (SELECT doc_id, list_max({stop_words_sql('text')}) AS best FROM documents)
SELECT doc_id, CASE WHEN best.n > 0 THEN best.lang ELSE 'und' END AS language FROM h""")
def doc_language(df):
    scores = N.stop_word_scores(F.col("text"))
    best = F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("s"), e["key"].alias("lang"))))
    return df.select("doc_id", F.when(best["s"] > 0, best["lang"]).otherwise("und").alias("language"))


# Conversations as structured Markdown

CONV = """(SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg('## ' || turn || ' ' || role || chr(10) || chr(10) || text || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"""


def conversation_markdown(df):
    part = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n\n"), "text", F.lit("\n"))
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "")
    return df.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), "turns").alias("content"))


@query("conversations", f"SELECT conv_id, sha256(content) AS content_sha256, length(content) AS characters FROM {CONV}")
def conv_markdown(df):
    return conversation_markdown(df).select("conv_id", F.sha2("content", 256).alias("content_sha256"), F.length("content").cast("long").alias("characters"))


@query("conversations")
def conv_chunks(df):
    made = V.chunks(conversation_markdown(df), "conv_id", options=V.Options(chunk_size=512))
    return made.select("conv_id", F.col("index").cast("long").alias("index"), F.array_join("headings", " > ").alias("headings"), F.col("tokens").cast("long").alias("tokens"), F.sha2("content", 256).alias("content_sha256"))


@query("conversations", f"SELECT conv_id, CAST(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} '))) AS BIGINT) AS headings, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines FROM {CONV}")
def conv_headings(df):
    lines = F.split("content", "\n", -1)
    return conversation_markdown(df).select("conv_id", F.size(F.filter(lines, lambda x: X.heading_level(x) > 0)).cast("long").alias("headings"), F.size(lines).cast("long").alias("lines"))


@query("conversations", """WITH t AS (SELECT conv_id, turn, role = 'assistant' AS mark FROM conversations)
SELECT conv_id, turn, coalesce(sum(CAST(mark AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM t""")
def conv_fence_parity(df):
    return R.parity(df.withColumn("mark", F.col("role") == "assistant"), "conv_id", "turn", "mark").select("conv_id", "turn", "inside")


@query("conversations", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal FROM conversations")
def conv_list_ordinals(df):
    return R.numbered(df, ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role", "ordinal")


@query("conversations", "SELECT conv_id, turn, text FROM (SELECT *, count(*) OVER w AS n, sum(length(text)) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE n <= 3 AND s <= 500")
def conv_running_cap(df):
    return R.running_cap(df.withColumn("size", F.length("text")), "conv_id", "turn", "size", 3, 500).select("conv_id", "turn", "text")


@query("conversations", """WITH c AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS seg_end, length(text) AS n FROM conversations),
s AS (SELECT conv_id, turn, seg_end - n AS seg_start, seg_end FROM c), k AS (SELECT conv_id, i AS chunk, i * 100 AS a, (i + 1) * 100 AS b FROM (SELECT conv_id, max(seg_end) AS total FROM c GROUP BY 1), unnest(range(0, greatest(CAST(ceil(total / 100) AS BIGINT), 1))) r(i))
SELECT k.conv_id, CAST(chunk AS BIGINT) AS chunk, min(turn) AS span_from, max(turn) AS span_to FROM k JOIN s ON k.conv_id = s.conv_id AND seg_start < b AND seg_end > a GROUP BY k.conv_id, chunk""")
def conv_span_overlap(df):
    n = F.length("text")
    end = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn"))
    spans = df.withColumn("seg_end", end).select("conv_id", (F.col("seg_end") - n).alias("seg_start"), "seg_end", F.col("turn").alias("seg_from"), F.col("turn").alias("seg_to"))
    last = F.greatest(F.ceil(F.sum(n) / 100), F.lit(1)) - 1
    parts = df.groupBy("conv_id").agg(last.alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk")).withColumn("chunk_start", F.col("chunk") * 100).withColumn("chunk_end", F.col("chunk") * 100 + 100)
    return R.overlaps(parts, spans, "conv_id", "chunk")


@query("conversations", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS segment_end FROM conversations")
def conv_segments(df):
    return R.segments(df.select("conv_id", "turn"), ["conv_id"], "turn")


# Pages: locations, sniffing, HTML


@query("pages", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(https?://)[^/?#@]*@', '\1'), '#.*$', ''), '\?.*$', '?***'), '^([a-z]+://[^/?]*)(\?|$)', '\1/\2') AS url,
 's3://b' || page_id || '/' || page_id || '.pdf' || CASE WHEN page_id % 2 = 0 THEN '?region=eu-' || page_id ELSE '' END AS s3 FROM pages""")
def page_sanitized_url(df):
    n = F.col("page_id").cast("string")
    s3 = F.concat(F.lit("s3://AK"), n, F.lit(":se%2Fcret@B"), n, F.lit("/"), n, F.lit(".pdf?session_token=t"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&region=eu-"), n)).otherwise(""))
    return df.select("page_id", S.sanitize(F.col("url")).alias("url"), S.sanitize(s3).alias("s3"))


@query("pages", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'b' || page_id END AS bucket, CASE WHEN page_id % 3 < 2 THEN 'a b/' || page_id || '.pdf' END AS key, CASE WHEN page_id % 3 = 0 THEN 'se/cret' END AS secret_key, CASE WHEN page_id % 3 = 1 THEN 'eu' END AS region, CASE WHEN page_id % 3 = 2 THEN 'unknown parameter zone' END AS error FROM pages")
def page_s3_parts(df):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 3
    head, tail = F.when(kind == 0, "s3://AK:se%2Fcret@b").otherwise("s3://b"), F.when(kind == 1, ".pdf?region=eu").when(kind == 2, ".pdf?zone=1").otherwise(".pdf")
    got = df.select("page_id", S.parse_s3(F.concat(head, n, F.lit("/a%20b/"), n, tail)).alias("s"))
    return got.select("page_id", "s.bucket", "s.key", "s.secret_key", "s.region", "s.error")


@query("pages", r"""SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z0-9]+://[^/]*', ''), '([^/]*)$', 1) AS file_name FROM pages""")
def page_file_name(df):
    return df.select("page_id", S.file_name(F.col("url")).alias("file_name"))


@query("pages", "SELECT CASE WHEN starts_with(url, 'https://') THEN 'https' END AS scheme, CASE WHEN starts_with(url, 'https://') THEN NULL ELSE 'invalid_source' END AS error, count(*) AS n FROM pages GROUP BY 1, 2")
def page_locations(df):
    return df.groupBy(S.scheme(F.col("url")).alias("scheme"), S.error(F.col("url")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("pages", "SELECT CASE WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') THEN 'html' ELSE 'text' END AS format, count(*) AS n FROM pages GROUP BY 1")
def page_format_sniff(df):
    return df.groupBy(S.text_format(F.substring("html", 1, 512), F.lit("")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("pages", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script(?:\s[^>]*)?>.*?</script[^>]*>', '', 'g'), '(?is)<style(?:\s[^>]*)?>.*?</style[^>]*>', '', 'g'), '(?s)<!--.*?(?:-->|\z)', '', 'g')) AS body FROM pages""")
def page_strip_blocks(df):
    return df.select("page_id", F.sha2(X.strip_blocks(F.col("html")), 256).alias("body"))


@query("pages", f"SELECT page_id, sha256({entities_sql('html')}) AS body FROM pages")
def page_entities(df):
    return df.select("page_id", F.sha2(X.decode_entities(F.col("html")), 256).alias("body"))


@query("pages", f"SELECT page_id, trim({entities_sql(TITLE_SQL)}) AS title FROM pages")
def page_title(df):
    return df.select("page_id", H.convert_udf(F.col("html"))["title"].alias("title"))


@query("pages")
def page_markdown(df):
    made = df.withColumn("r", H.convert_udf(F.col("html")))
    return made.select("page_id", F.col("r.content").alias("content"), F.size("r.links").cast("long").alias("links"))


@query("pages", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9 _-]', '', 'g'), ' ', '-', 'g')) AS slug FROM pages")
def page_slug(df):
    return df.select("page_id", X.slug(F.col("url")).alias("slug"))


@query("pages", r"""WITH n AS (SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z0-9]+://[^/]*', ''), '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages)
SELECT page_id, 'out/' || stem || '.md' AS md, 'out/' || stem || '.zip' AS zip, 'out/' || stem || '.docv.json' AS json FROM n""")
def page_destination(df):
    named = df.withColumn("md", K.destination(F.lit("out/"), S.file_name(F.col("url"))))
    return named.select("page_id", "md", K.sibling(F.col("md"), ".zip").alias("zip"), K.sibling(F.col("md"), ".docv.json").alias("json"))


# The request log


@query("events", f"SELECT seq, operation, requester_id FROM {LOG} WHERE operation = 'click' AND execution_status = 'completed' AND created_at >= 1704500000000 AND created_at < 1705500000000")
def log_history_list(df):
    return L.history(L.requests(df), 1704500000000, 1705500000000, operation="click", execution_status="completed").select("seq", "operation", "requester_id")


@query("events", f"SELECT seq, operation FROM {LOG} WHERE seq <= 9000 AND seq < 8000 ORDER BY seq DESC LIMIT 51")
def log_keyset_page(df):
    return L.keyset_page(L.requests(df), 50, high=9000, last=8000).select("seq", "operation")


@query("events", f"SELECT coalesce(max(seq), 0) AS high FROM {LOG}")
def log_high_water(df):
    return L.high_water(L.requests(df))


@query("events", f"""SELECT 'operation' AS dimension, operation AS value, count(*) AS n FROM {LOG} GROUP BY 2 UNION ALL SELECT 'execution_status', execution_status, count(*) FROM {LOG} GROUP BY 2
 UNION ALL SELECT 'requester_id', requester_id, count(*) FROM {LOG} GROUP BY 2""")
def log_counts(df):
    return L.counted(L.requests(df), ["operation", "execution_status", "requester_id"])


@query("events", f"SELECT requester_id, count(*) AS n FROM {LOG} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def log_top_requesters(df):
    return L.top(L.requests(df), "requester_id")


@query("events", """SELECT event_type, count(*) AS n, list_sort(list(value))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS INT) + 1] AS p50, list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS INT) + 1] AS p95, max(value) AS max FROM events GROUP BY 1""")
def log_duration_percentiles(df):
    return L.rank_value(df, "value", ["event_type"], [0.5, 0.95])


@query("events", "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in L.BOUNDS) + ", count(*) AS n, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def log_latency_histogram(df):
    return L.histogram(df, "value", ["event_type"])


@query("events", f"SELECT seq, requester_id FROM {LOG} WHERE execution_status = 'failed' ORDER BY seq DESC LIMIT 10")
def log_recent_failures(df):
    return L.recent_failures(L.requests(df)).select("seq", "requester_id")


@query("events", f"SELECT operation, count(*) AS n FROM {LOG} WHERE created_at >= (SELECT max(created_at) FROM {LOG}) - 86400000 GROUP BY 1")
def log_window_24h(df):
    return L.look_back(L.requests(df), 86_400_000).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query("events", "SELECT event_type, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS k FROM events GROUP BY 1")
def log_json_sums(df):
    return df.groupBy("event_type").agg(F.coalesce(F.sum(J.lookup(F.col("props"), "k").try_cast("long")), F.lit(0)).alias("k"))


@query("events", "SELECT hour, event_id FROM (SELECT epoch_us(ts) // 3600000000 AS hour, event_id, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def log_rate_cap(df):
    hours = df.select((L.epoch_ms(F.col("ts")) / 3600).alias("at"), "event_id")
    return L.rate_cap(hours, 5, "at", "event_id").select(F.col("second").alias("hour"), "event_id")


@query("events", "SELECT user_id, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def log_state_latest(df):
    return L.latest_state(df, "user_id", "event_type", ["ts", "event_id"])


@query("events", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def log_upsert(df):
    return L.upsert(df, "user_id", ["ts", "event_id"], ["event_type", "value"], ["event_id"])


@query("events", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'patched' END, event_type) AS event_type FROM events")
def log_partial_update(df):
    patch = df.filter("event_id % 3 = 0").select("event_id", F.lit("patched").alias("event_type"))
    return L.partial_update(df.select("event_id", "event_type"), patch, "event_id", ["event_type"])


@query("events", "SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'rejected' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 5 = 0 THEN 'accepted' ELSE 'completed' END AS outcome FROM events")
def log_outcome(df):
    request = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "rejected").otherwise("accepted")
    execution = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 5 != 0, "completed")
    return df.select("event_id", L.outcome(request, execution).alias("outcome"))


CALLS = "SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events"


@query("events", f"""WITH RECURSIVE c AS MATERIALIZED ({CALLS}), f AS (SELECT user_id, i, CASE WHEN bad THEN 4 ELSE 8 END AS l, CASE WHEN bad THEN 0 ELSE 1 END AS good FROM c WHERE i = 1
 UNION ALL SELECT c.user_id, c.i, CASE WHEN bad THEN greatest(l // 2, 1) WHEN good + 1 >= 20 THEN least(l + 1, 64) ELSE l END, CASE WHEN bad OR good + 1 >= 20 THEN 0 ELSE good + 1 END FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT user_id, CAST(max_by(l, i) AS BIGINT) AS call_limit FROM f GROUP BY 1""")
def log_aimd_fold(df):
    return L.aimd(df.withColumn("bad", F.col("event_type") == "error"), "user_id", "event_id", "bad")


@query("events", f"""WITH RECURSIVE c AS MATERIALIZED (SELECT user_id, event_id, ms, (bad OR event_id % 3 < 2) AS bad, i FROM ({CALLS})), f AS (SELECT user_id, i, event_id, 'closed' AS breaker, CAST(bad AS BIGINT) AS n, CAST(NULL AS BIGINT) AS upto FROM c WHERE i = 1
 UNION ALL SELECT c.user_id, c.i, c.event_id, CASE WHEN upto IS NULL THEN 'closed' WHEN ms < upto THEN 'open' ELSE 'half_open' END, CASE WHEN ms < upto THEN n WHEN bad THEN n + 1 ELSE 0 END,
  CASE WHEN ms < upto THEN upto WHEN bad AND n + 1 >= 5 THEN ms + 40000000 WHEN bad THEN upto END FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT user_id, event_id, breaker FROM f""")
def log_breaker(df):
    calls = df.select("user_id", "event_id", L.epoch_ms(F.col("ts")).alias("at"), ((F.col("event_type") == "error") | (F.col("event_id") % 3 < 2)).alias("bad"))
    return L.breaker(calls, "user_id", ["event_id"], "at", "bad", cooldown_ms=40_000_000)


@query("events", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 5 <> 0 THEN 'u' || user_id END AS requester_id FROM events")
def log_requester_id(df):
    e = F.col("event_id")
    raw = F.when(e % 7 == 0, "  ").when(e % 5 == 0, F.repeat(F.lit("x"), 129)).otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit("\t")))
    return df.select("event_id", X.requester_id(raw).alias("requester_id"))


@query("events", "SELECT event_type, count(*) AS n, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) // count(*) AS mean FROM events GROUP BY 1")
def log_integer_mean(df):
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(value as bigint)) div count(1)").alias("mean"))


@query("events", "SELECT event_id, least(250 * CAST(pow(2, least(event_id % 9, 6)) AS BIGINT), 30000) AS wait_ms, [0, 30, 120, 600, 1200, 1800][CAST(event_id % 6 AS INT) + 1] AS webhook_s FROM events".replace("[0, 30", "[CAST(0 AS BIGINT), 30"))
def log_backoff(df):
    return df.select("event_id", X.backoff_ms(F.col("event_id") % 9 + 1).alias("wait_ms"), X.webhook_wait_s(F.col("event_id") % 6).alias("webhook_s"))


@query("events", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def log_tumbling_day(df):
    return ST.tumbling(df, "1 day", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("events", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM events")
def log_rfc3339(df):
    return df.select("event_id", X.rfc3339(L.epoch_ms(F.col("ts"))).alias("at"))


@query("events", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS ok FROM events")
def json_schema_check(df):
    check = J.validate_udf({"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}})
    return df.select("event_id", check(F.col("props"))["ok"].alias("ok"))


@query("events", """SELECT event_id, '{"id":"$k","value":' || json_extract_string(props, '$.k') || ',"all":' || props || '}' AS body FROM events""")
def template_render(df):
    return df.select("event_id", J.template({"id": "$$k", "value": "$.k", "all": "$"}, F.col("props")).alias("body"))


@query("events", "SELECT event_id, 'evt_' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) || '_' || event_id % 3 AS id, CAST(event_id % 3 AS INT) AS index FROM events")
def webhook_event_id(df):
    made = df.select("event_id", X.event_id(F.col("event_id").cast("string"), F.col("event_id") % 3).alias("id"))
    return made.withColumn("index", X.event_index(F.col("id")))


# Jobs and their timelines


@query("", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def log_recover(spark, d):
    jobs = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.recover(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), jobs, "o_orderkey")


@query("", "SELECT o_orderkey FROM orders o WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O'))")
def log_retention(spark, d):
    held = read(spark, d, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.retention(read(spark, d, "orders"), held, "o_orderkey", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("", "SELECT o_orderkey, count(l_orderkey) AS lines, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def history_get(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("all"))
    got = read(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return got.select("o_orderkey", F.when(F.col("all").isNull(), F.lit(0)).otherwise(F.size("all")).cast("long").alias("lines"), F.coalesce(F.array_join("all", ","), F.lit("")).alias("numbers"))


@query("lineitem", "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d) SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM r GROUP BY l_orderkey, g")
def page_ranges_islands(df):
    return R.islands(df, ["l_orderkey"], "l_linenumber")


@query("lineitem", """WITH i AS (SELECT l_orderkey, CAST(epoch(l_shipdate) AS BIGINT) AS s, CAST(epoch(l_shipdate) AS BIGINT) + CAST(l_quantity AS BIGINT) * 3600 AS e FROM lineitem),
w AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i)
SELECT l_orderkey, CAST(sum(greatest(0, e - greatest(s, coalesce(b, s)))) AS BIGINT) AS wall, CAST(sum(e - s) AS BIGINT) AS plain FROM w GROUP BY 1""")
def interval_union_wall(df):
    start = F.floor(L.epoch_ms(F.col("l_shipdate")) / 1000)
    return R.union_length(df.select("l_orderkey", start.alias("s"), (start + F.col("l_quantity").cast("long") * 3600).alias("e")), ["l_orderkey"], "s", "e")


@query("events", """SELECT e.event_id AS id, (SELECT max_by(m.event_type, m.event_id) FROM events m WHERE m.user_id = e.user_id AND m.event_id % 10 = 0 AND m.event_id <= e.event_id) AS event_type FROM events e WHERE e.event_id % 10 <> 0""")
def asof_location(df):
    marks = df.filter("event_id % 10 = 0").select("user_id", "event_id", "event_type")
    return R.as_of(df.filter("event_id % 10 <> 0").select("user_id", "event_id", F.col("event_id").alias("id")), marks, "user_id", "event_id", "event_type")


@query("lineitem", "SELECT l_returnflag, count(*) AS calls, count(*) FILTER (l_linestatus <> 'O') AS failed, sum(CASE WHEN l_discount > 0 THEN CAST(l_quantity AS BIGINT) END)::BIGINT AS tokens, bool_and(l_tax IS NOT NULL) AS usage_complete FROM lineitem GROUP BY 1")
def llm_totals(df):
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("l_linestatus") != "O").alias("failed"), F.sum(F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("long"))).alias("tokens"), F.bool_and(F.col("l_tax").isNotNull()).alias("usage_complete"))


# Small functions over literal tables


@query("nation", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'xxx' ELSE 'zh' END AS tag FROM nation")
def bcp47_map(df):
    code = F.get(F.array(*map(F.lit, ("deu", "eng", "xxx", "cmn"))), F.col("n_nationkey") % 4)
    return df.select("n_nationkey", X.bcp47(code).alias("tag"))


@query("nation", "SELECT n_nationkey, list_reduce(list_transform(string_split(substr(regexp_replace(n_name, '[^A-Za-z]', '', 'g'), 1, 3), ''), lambda x: CAST(ascii(upper(x)) - 64 AS BIGINT)), lambda a, x: a * 26 + x) - 1 AS column_index FROM nation")
def column_ref_index(df):
    letters = F.substring(F.regexp_replace("n_name", "[^A-Za-z]", ""), 1, 3)
    return df.select("n_nationkey", X.column_index(F.concat(letters, F.lit("10"))).alias("column_index"))


@query("nation", "SELECT n_regionkey, '| ' || string_agg(n_name, ' | ' ORDER BY n_name) || ' |' AS line FROM nation GROUP BY 1")
def table_rows(df):
    return df.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("c")).select("n_regionkey", X.table_row(F.col("c")).alias("line"))


@query("region", "SELECT r_regionkey, CAST((r_regionkey + 1) * 60000 AS BIGINT) AS ms, CAST((r_regionkey + 1) * 1048576 AS BIGINT) AS bytes FROM region")
def durations_and_sizes(df):
    n = (F.col("r_regionkey") + 1).cast("string")
    return df.select("r_regionkey", X.duration_ms(F.concat(n, F.lit("m"))).alias("ms"), X.size_bytes(F.concat(n, F.lit("MiB"))).alias("bytes"))


@query("supplier", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'use *** now' ELSE 'use key now' END AS message FROM supplier")
def redacted(df):
    return df.select("s_suppkey", X.redact_keys(F.when(F.col("s_suppkey") % 2 == 0, "use sk-12345678 now").otherwise("use key now")).alias("message"))


@query("part", "SELECT p_partkey, length('x' || p_name) + length(CAST(length('x' || p_name) + 4 AS VARCHAR)) AS size FROM part".replace("length('x' || p_name) + length(CAST(length('x' || p_name) + 4 AS VARCHAR))", "CAST(length('x' || p_name) + length(CAST(length('x' || p_name) + length(CAST(length('x' || p_name) AS VARCHAR)) AS VARCHAR)) AS BIGINT)"))
def self_sized(df):
    return df.select("p_partkey", V.self_size(F.length(F.concat(F.lit("x"), "p_name"))).cast("long").alias("size"))


# More of the log: folds, batches, lanes, stages, deliveries, sessions


@query("events", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(sum(value * pow(0.5, CASE WHEN i = 1 THEN n - 1 ELSE n - i + 1 END)), 4) AS rate FROM r GROUP BY 1")
def log_smoothed_rate(df):
    return L.smoothed_rate(df.withColumn("value", F.col("value")), "user_id", "event_id", "value").select("user_id", F.round("rate", 4).alias("rate"))


@query("events", "SELECT event_type, batch, count(*) AS n FROM (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500 AS batch FROM events) GROUP BY 1, 2")
def log_commit_batches(df):
    return L.commit_batches(df, "event_type", "event_id").groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("events", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'view', event_id) AS place FROM events")
def log_lanes(df):
    return L.lanes(df, "user_id", F.col("event_type") == "view", "event_id").select("event_id", "user_id", "place")


@query("events", """WITH t AS (SELECT event_id, event_id % 3 AS "fetch", event_id % 5 AS extraction, event_id % 7 AS storage, event_type = 'error' AS bad FROM events),
t2 AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 4 END AS queue, "fetch", extraction, storage, bad FROM t)
SELECT event_id, 'queue' AS stage, 'completed' AS event, CAST(queue AS BIGINT) AS ms FROM t2 WHERE queue > 0 UNION ALL SELECT event_id, 'fetch', 'completed', "fetch" FROM t2 UNION ALL SELECT event_id, 'extraction', 'completed', extraction FROM t2
UNION ALL SELECT event_id, 'storage', 'completed', storage FROM t2 WHERE storage > 0 UNION ALL SELECT event_id, CASE WHEN bad THEN 'processing' ELSE 'done' END, CASE WHEN bad THEN 'failed' ELSE 'completed' END, NULL FROM t2""")
def log_stage_events(df):
    e = F.col("event_id")
    t = df.select("event_id", "event_type", F.when(e % 2 == 0, 0).otherwise(4).cast("long").alias("queue"), (e % 3).alias("fetch"), (e % 5).alias("extraction"), (e % 7).alias("storage"))
    return L.stage_events(t, "event_id", ["queue", "storage"], ["fetch", "extraction"], F.col("event_type") == "error")


@query("events", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'sent' END WHEN event_id % 7 <> 0 AND event_id % 4 = 0 THEN 'delivered' WHEN (event_id % 7 = 0 OR event_id % 4 IN (1, 2)) AND event_id % 6 + 1 < 6 THEN 'retry' ELSE 'failed' END AS outcome FROM events")
def log_delivery(df):
    e = F.col("event_id")
    status = F.get(F.array(*map(F.lit, (200, 429, 503, 404))), e % 4)
    return df.select("event_id", L.delivery(status, e % 7 == 0, e % 6 + 1, forget=e % 11 == 0).alias("outcome"))


@query("events", "WITH g AS (SELECT user_id, ts, CAST(lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR AS INT) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def log_sessions(df):
    return ST.sessions(df, "6 hours", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("events", "SELECT 'requests_total{operation=\"' || event_type || '\",status=\"' || CASE WHEN value > 50 THEN 'slow' ELSE 'fast' END || '\"} ' || count(*) AS line FROM events GROUP BY event_type, value > 50")
def metrics_lines(df):
    counts = df.groupBy("event_type", F.when(F.col("value") > 50, "slow").otherwise("fast").alias("status")).agg(F.count(F.lit(1)).alias("value"))
    return K.exposition(counts.select(F.create_map(F.lit("operation"), "event_type", F.lit("status"), "status").alias("labels"), "value"), "requests_total")


@query("events", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 10 + 5 + 2 ELSE 10 END::BIGINT AS tokens_in, CASE event_id % 3 WHEN 0 THEN 20 + 3 WHEN 1 THEN 20 END::BIGINT AS tokens_out FROM events")
def llm_usage(df):
    raw = ['{"promptTokenCount":10,"candidatesTokenCount":20,"thoughtsTokenCount":3}', '{"input_tokens":10,"cache_read_input_tokens":5,"cache_creation_input_tokens":2,"output_tokens":20}', '{"prompt_tokens":10}']
    k = F.col("event_id") % 3
    tokens_in, tokens_out = J.usage(F.get(F.array(*map(F.lit, ("gemini", "anthropic", "openai"))), k), F.get(F.array(*map(F.lit, raw)), k))
    return df.select("event_id", tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"))


@query("events", "SELECT event_id, props AS object, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_from_answer(df):
    answer = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" -- done"))
    made = df.select("event_id", J.object_in(answer).alias("object"))
    return made.withColumn("k", J.lookup(F.col("object"), "k").try_cast("long"))


@query("lineitem", "SELECT l_orderkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN 'page ' || min(l_linenumber) ELSE 'pages ' || min(l_linenumber) || '-' || max(l_linenumber) END AS label FROM lineitem GROUP BY 1")
def page_labels(df):
    spans = df.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return spans.select("l_orderkey", X.location(F.lit("page"), F.col("a"), F.col("b")).alias("label"))


@query("documents", "SELECT doc_id, CAST(strlen(text) * 4 + 262144 AS BIGINT) AS memory, 'text/plain' AS mime FROM documents")
def doc_memory(df):
    return df.select("doc_id", X.memory_estimate(F.octet_length("text"), F.lit(4)).alias("memory"), X.mime(F.lit("text")).alias("mime"))


@query("conversations", "SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY b) AS body FROM (SELECT conv_id, (turn // 3) AS b, string_agg(role, ' ' ORDER BY turn) AS part FROM conversations GROUP BY 1, 2) GROUP BY 1")
def conv_batches_joined(df):
    parts = df.groupBy("conv_id", F.expr("turn div 3").alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ").alias("part"))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "part"))), lambda x: x["part"]), "\n\n").alias("body"))


@query("conversations", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) - 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM conversations")
def conv_offset_shift(df):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") - 10).over(w), F.lit(0)).alias("shift"))


@query("pages", "SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\\[\\]]', '', 'g'), '\\s+', ' ', 'g')) AS alt FROM pages")
def page_alt(df):
    return df.select("page_id", X.clean_alt(F.concat(F.lit("["), "url", F.lit("]"))).alias("alt"))


@query("part", "SELECT p_brand, count(DISTINCT p_type) AS images, count(*) - count(DISTINCT p_type) AS repeats FROM part GROUP BY 1")
def image_dedupe(df):
    return df.groupBy("p_brand").agg(F.countDistinct("p_type").alias("images"), (F.count(F.lit(1)) - F.countDistinct("p_type")).alias("repeats"))
