"""Queries on the operational tables, registered in the catalogue: history, jobs, webhooks, model calls, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import jsonops as J
from folioforge.functions import markdown as M
from folioforge.functions import text as X
from folioforge.operators import convert as V
from folioforge.operators import oplog as L
from folioforge.operators import records as R
from folioforge.plans.catalogue import CONV, conversation_markdown, query, read
from folioforge.sources import sinks as K

STATE = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END"


def states(df):
    kind = F.col("event_type")
    return df.withColumn("execution_status", F.when(kind == "click", "queued").when(kind == "view", "running").when(kind == "error", "failed").otherwise("completed"))


@query("events", f"SELECT event_id, {STATE} AS execution_status FROM events WHERE event_type IN ('click', 'view')")
def log_in_progress(df):
    return R.in_progress(states(df)).select("event_id", "execution_status")


@query("events", """SELECT 'r' || event_id AS request_id, 'u' || user_id AS requester_id, event_type AS operation, CASE WHEN event_id % 4 <> 0 THEN event_id % 2 = 0 END AS cache_hit, CASE WHEN event_id % 4 <> 0 THEN event_id * 10 END AS md_bytes,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS created_at, CASE WHEN event_id % 4 <> 0 THEN '{"pages":' || event_id % 9 || ',"words":' || event_id || ',"format":"pdf"}' END AS statistics,
 CASE WHEN event_id % 3 = 0 THEN 'mock' END AS llm_provider, event_id % 5 = 1 AS result_available FROM events""")
def log_history_items(df):
    e = F.col("event_id")
    stored = F.format_string('{"pages":%d,"words":%d,"format":"pdf","files":{"cache_hit":%s,"md_bytes":%d}}', e % 9, e, (e % 2 == 0).cast("string"), e * 10)
    log = df.select(F.concat(F.lit("r"), e).alias("request_id"), F.concat(F.lit("u"), "user_id").alias("requester_id"), F.col("event_type").alias("operation"), L.epoch_ms(F.col("ts")).alias("created_at"),
        F.when(e % 4 != 0, stored).alias("statistics"), F.when(e % 3 == 0, '{"provider":"mock","model":"m"}').otherwise("not json").alias("usage"), F.when(e % 5 == 1, 1).when(e % 5 == 2, 0).alias("result_available"))
    return R.items(log).select("request_id", "requester_id", "operation", "cache_hit", "md_bytes", "created_at", "statistics", "llm_provider", "result_available")


@query("events", "SELECT event_id, event_type FROM events")
def log_selected_fields(df):
    return R.selected(df, ["event_type", "no such field", "event_id"])


@query("events", "SELECT event_id, event_type FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 100")
def log_detail_page(df):
    return R.detail_page(df.select("event_id", "event_type"), "event_id", 1000, 100)


@query("events", "SELECT least(count(*), 5000) AS rows, count(*) >= 5000 AS truncated FROM events")
def log_bounded_scan(df):
    return R.bounded_scan(df.select("event_id"), "event_id", 5000)[1]


@query("events", "SELECT event_id, CAST(0 AS INT) AS at, 'running' AS request_status, NULL AS execution_status FROM events UNION ALL SELECT event_id, 1, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END FROM events")
def log_text_operations(df):
    return R.text_operation(df.select("event_id", "event_type"), F.col("event_type") == "error").drop("event_type")


@query("events", "SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def log_insert(df):
    return R.inserted(df.filter("event_id % 3 = 0").select("event_id", "event_type"), df.filter("event_id % 2 = 0").select("event_id", F.lit("new").alias("event_type")), "event_id")


@query("events", "SELECT least(count(*) FILTER (value < 50), 1000) AS removed FROM events")
def log_delete_batch(df):
    return R.delete_batch(df, F.col("value") < 50, "event_id").agg(F.count(F.lit(1)).alias("removed"))


@query("events", f"SELECT event_id, CASE WHEN event_type = 'view' THEN 'failed' ELSE {STATE} END AS execution_status, CASE WHEN event_type = 'view' THEN 'interrupted' END AS error, CASE WHEN event_type = 'view' THEN 1800000000000 END AS finished_at FROM events")
def log_interrupted(df):
    return R.interrupted(states(df).select("event_id", "execution_status"), "execution_status", F.lit(1_800_000_000_000)).select("event_id", "execution_status", "error", "finished_at")


@query("events", "SELECT event_id, event_id % 7 + event_id % 11 AS total_ms, CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id * 3 END AS BIGINT) AS md_bytes FROM events")
def log_timing_sizes(df):
    e = F.col("event_id")
    sized = R.timing(df, e % 7, e % 11).select("event_id", "total_ms")
    stats = F.format_string('{"content_bytes":%d}', F.when(e % 2 == 0, e).otherwise(e * 3))
    return sized.select("event_id", "total_ms", R.markdown_bytes(F.lit(None).cast("string"), stats).alias("md_bytes"))


@query("documents", """SELECT doc_id, '{"pages":' || doc_id % 5 || ',"words":' || length(text) || ',"format":"text","files":{"md_bytes":' || strlen(text) || '}}' AS statistics, CAST(strlen(text) AS BIGINT) AS md_bytes FROM documents""")
def doc_stored_statistics(df):
    made = F.struct((F.col("doc_id") % 5).alias("pages"), F.length("text").alias("words"))
    return df.select("doc_id", R.with_files(made, F.lit("text"), F.struct(F.octet_length("text").alias("md_bytes"))).alias("statistics"), R.markdown_bytes(F.col("text"), F.lit(None).cast("string")).alias("md_bytes"))


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'partial_extraction' END AS error, doc_id % 4 <> 0 AND trim(text) <> '' AS cached FROM documents")
def doc_result_gate(df):
    d = F.col("doc_id")
    error, cached = R.result_gate(d % 4 == 0, d % 8 == 0, F.col("text"))
    return df.select("doc_id", error.alias("error"), cached.alias("cached"))


@query("pages", r"""SELECT page_id, page_id % 5 <> 0 AND CASE WHEN page_id % 3 = 0 THEN regexp_matches(lower(regexp_replace(url, '\.html', '.PDF')) || '?a=b.txt', '^[^?]*\.(pdf|png|jpe?g|webp)\?') ELSE page_id % 3 = 1 END AS model FROM pages""")
def page_needs_model(df):
    p = F.col("page_id")
    kind = F.when(p % 3 == 1, "pdf").when(p % 3 == 2, "html")
    return df.select("page_id", R.needs_model(kind, F.concat(F.regexp_replace("url", r"\.html", ".PDF"), F.lit("?a=b.txt")), F.when(p % 5 == 0, "off").otherwise("on")).alias("model"))


@query("events", f"SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 404 WHEN {STATE} <> 'completed' THEN 409 WHEN event_id % 5 = 0 THEN 410 WHEN event_id % 2 = 0 THEN 200 ELSE 202 END AS http FROM events")
def log_zip_status(df):
    e = F.col("event_id")
    state = F.when(e % 13 != 0, F.col("execution_status"))
    return states(df).select("event_id", R.zip_status(state, e % 5 != 0, F.when(e % 2 == 0, "completed").otherwise("running")).alias("http"))


@query("part", """SELECT p_brand, nullif(concat_ws('; ', CASE WHEN count(*) FILTER (p_size > 45) > 0 THEN count(*) FILTER (p_size > 45) || ' image(s) were not extracted: the per-document limit (500 images or 64 MiB) was reached' END,
 CASE WHEN count(*) FILTER (p_size = 1) > 0 THEN count(*) FILTER (p_size = 1) || ' embedded object(s) were not recognised as images and were skipped' END), '') AS warning FROM part GROUP BY 1""")
def image_warnings(df):
    counts = df.groupBy("p_brand").agg(F.count_if(F.col("p_size") > 45).alias("capped"), F.count_if(F.col("p_size") == 1).alias("strange"))
    return counts.select("p_brand", R.image_warning(F.col("capped"), F.col("strange")).alias("warning"))


@query("", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3))")
def cache_images_present(spark, d):
    images = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("images"))
    cached = read(spark, d, "orders").select("o_orderkey").join(images, "o_orderkey", "left")
    return R.images_present(cached, "o_orderkey", "images", read(spark, d, "part").filter("p_size > 3").select(F.col("p_partkey").alias("id"))).select("o_orderkey")


@query("lineitem", """WITH s AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS a FROM lineitem GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, (SELECT min(s.l_linenumber) FROM s WHERE s.l_orderkey = l.l_orderkey AND s.a <= l.l_suppkey AND s.a + 20 >= l.l_suppkey) AS place FROM lineitem l WHERE l.l_returnflag = 'R'""")
def image_page_places(df):
    spans = df.groupBy("l_orderkey", F.col("l_linenumber").alias("place")).agg(F.min("l_suppkey").alias("from")).withColumn("to", F.col("from") + 20)
    images = df.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("page"))
    return R.place_pages(images, spans, "l_orderkey").withColumnRenamed("page", "l_suppkey")


@query("conversations", "SELECT conv_id, turn, role, CASE WHEN n = 0 THEN role ELSE role || '-' || n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations)")
def conv_anchors(df):
    return R.duplicate_slugs(df.withColumn("slug", X.slug(F.col("role"))), ["conv_id"], "turn").select("conv_id", "turn", "role", "anchor")


@query("", "SELECT o_orderkey, CAST(count(l_orderkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (o_orderstatus = 'F'), '') AS numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def job_webhooks(spark, d):
    hooks = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    jobs = R.with_webhooks(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), hooks, "o_orderkey", F.col("o_orderstatus") == "F", ["l_partkey"], "l_linenumber")
    return jobs.select("o_orderkey", F.size("webhooks").cast("long").alias("n"), F.array_join(F.col("webhooks.l_linenumber").cast("array<string>"), ",").alias("numbers"))


@query("orders", "SELECT 'evt_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32) || '_' || o_orderkey % 3 AS event_id, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'first' ELSE 'second' END AS spec FROM orders WHERE o_orderkey % 3 < 2")
def webhooks_resumed(df):
    jobs = df.select("o_orderkey", F.array(F.lit("first"), F.lit("second")).alias("specs"))
    pending = df.select(X.event_id(F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3).alias("event_id"), "o_orderkey")
    return R.resumed(pending, jobs, "o_orderkey", "specs").select("event_id", "o_orderkey", "spec")


@query("events", """SELECT event_id, '{"event_id":"' || event_id || '","event":"job.finished","job_id":"j","request_id":null,"status":"' || event_type || '","src_file":null,"src_bytes":null,"dest_file":null,"md_file":null,"md_bytes":' || user_id || ',"docv_file":null,"docv_bytes":null,"images_dir":null,"zip_file":null,"zip_bytes":null,"metadata":null,"statistics":null,"llm":{"calls":1},"timing":null,"error":null}' AS body FROM events""")
def webhook_body(df):
    e = F.col("event_id")
    rows = df.select("event_id", e.cast("string").alias("id"), F.col("event_type").alias("status"), F.col("user_id").alias("md_bytes"), F.lit("j").alias("job_id"), F.struct(F.struct(F.lit(1).alias("calls")).alias("totals")).alias("llm"))
    return rows.select(F.col("event_id").alias("key"), F.col("id").alias("event_id"), "status", "md_bytes", "job_id", "llm").select(F.col("key"), R.finished_body(rows.drop("event_id").withColumnRenamed("id", "event_id")).alias("body")).withColumnRenamed("key", "event_id")


@query("events", "SELECT event_id, 'evt_' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) || '_1_' || CASE WHEN event_type = 'error' THEN 'zip-failed' ELSE 'zip-completed' END AS id FROM events")
def webhook_zip_events(df):
    e = F.col("event_id")
    name = F.when(F.col("event_type") == "error", "zip.failed").otherwise("zip.completed")
    return df.select("event_id", R.zip_event_id(e.cast("string"), F.lit(1), name).alias("id"))


@query("events", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events")
def call_attempts(df):
    return R.attempts(df, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("attempt").cast("long").alias("attempt"))


@query("events", """WITH c AS (SELECT *, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'http_error' ELSE 'ok' END AS status, CASE WHEN event_id % 10 < 8 THEN 'provider' ELSE 'missing' END AS usage_source FROM events)
SELECT user_id, count(*) AS calls, count(*) FILTER (status <> 'ok') AS failed_calls, CAST(sum(CASE WHEN event_id % 10 < 8 THEN event_id END) AS BIGINT) AS input_tokens, min_by('m' || event_type, (ts, event_id)) AS model,
 NOT bool_or(usage_source = 'missing' AND status <> 'timeout') AS usage_complete FROM c GROUP BY 1""")
def call_totals(df):
    e = F.col("event_id")
    kind = F.col("event_type")
    calls = df.withColumns({"status": F.when(kind == "error", "timeout").when(kind == "view", "http_error").otherwise("ok"), "usage_source": F.when(e % 10 < 8, "provider").otherwise("missing"), "input_tokens": F.when(e % 10 < 8, e), "output_tokens": e, "provider": F.lit("p"), "model": F.concat(F.lit("m"), kind)})
    return R.totals(calls, "user_id", ["ts", "event_id"]).select("user_id", "calls", "failed_calls", "input_tokens", "model", "usage_complete")


@query("events", """WITH c AS (SELECT event_id, ['http', 'network', 'timeout', 'protocol', 'breaker_open', 'cancelled'][CAST(event_id % 6 AS INT) + 1] AS kind, [429, 401, 500, 403][CAST(event_id // 6 % 4 AS INT) + 1] AS http FROM events)
SELECT event_id, CASE kind WHEN 'http' THEN CASE WHEN http = 429 THEN 'rate_limited' ELSE 'http_error' END WHEN 'network' THEN 'network_error' WHEN 'protocol' THEN 'protocol_error' ELSE kind END AS label,
 CASE kind WHEN 'timeout' THEN 504 WHEN 'breaker_open' THEN 503 ELSE 502 END AS status, CASE WHEN kind = 'timeout' THEN 'provider_timeout' WHEN kind = 'breaker_open' THEN 'provider_unavailable' WHEN kind = 'http' AND http IN (401, 403) THEN 'provider_auth_failed' ELSE 'provider_error' END AS code FROM c""")
def call_errors(df):
    e = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("http", "network", "timeout", "protocol", "breaker_open", "cancelled"))), e % 6)
    http = F.get(F.array(*map(F.lit, (429, 401, 500, 403))), F.floor(e / 6) % 4)
    made = R.call_error(kind, http)
    return df.select("event_id", R.call_status(kind, http).alias("label"), made["status"].alias("status"), made["code"].alias("code"))


@query("events", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'request failed' WHEN 1 THEN 'bad key *** given' ELSE repeat('a', 200) END AS message FROM events")
def call_messages(df):
    e = F.col("event_id")
    body = F.when(e % 3 == 0, "<html>oops").when(e % 3 == 1, '{"error":{"message":"bad key sk-123456789 given"}}').otherwise(F.concat(F.lit('{"error":{"message":"'), F.repeat(F.lit("a"), 300), F.lit('"}}')))
    return df.select("event_id", R.error_message(body).alias("message"))


@query("events", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id / 1000 WHEN 2 THEN event_id * 60 + 5 WHEN 3 THEN event_id * 3600 + 1.5 END::DOUBLE AS seconds FROM events")
def call_reset_seconds(df):
    e = F.col("event_id")
    n = e.cast("string")
    text = F.when(e % 5 == 0, F.concat(n, F.lit("s"))).when(e % 5 == 1, F.concat(n, F.lit("ms"))).when(e % 5 == 2, F.concat(n, F.lit("m5s"))).when(e % 5 == 3, F.concat(n, F.lit("h1.5s"))).otherwise("soon")
    return df.select("event_id", R.reset_seconds(text).alias("seconds"))


@query("part", "SELECT p_partkey, CAST(greatest(1, floor(p_size * 100 / 400.0 * 0.8)) AS BIGINT) AS per_call FROM part")
def pdf_pages_per_call(df):
    return df.select("p_partkey", R.pages_per_call(F.col("p_size") * 100, F.lit(400.0)).alias("per_call"))


@query("part", "SELECT p_partkey, b AS batch, b * 8 + 1 AS first, least((b + 1) * 8, p_size) AS last FROM part, unnest(range(0, CAST(ceil(p_size / 8) AS BIGINT))) u(b)")
def pdf_batches(df):
    return R.batches(df, "p_partkey", "p_size", F.lit(8))


@query("events", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 10 ELSE least(greatest(CAST(ceil(user_id / (event_id % 4)) AS BIGINT), 1), 300) END AS retry_after, CASE WHEN user_id <= 8 THEN 0 ELSE CAST(floor((user_id - 8) / greatest(event_id % 4, 0.1::DOUBLE) * 1000) AS BIGINT) END AS start_ms FROM events""")
def queue_estimates(df):
    e = F.col("event_id")
    rate = (e % 4).cast("double")
    return df.select("event_id", R.retry_after_s(F.col("user_id"), rate).alias("retry_after"), R.start_ms(F.col("user_id"), F.lit(8), rate).alias("start_ms"))


@query("events", "SELECT event_id, props AS secret, NULL AS forged FROM events")
def secrets_round_trip(df):
    box = R.sealed(F.col("props"), b"0123456789abcdef")
    return df.select("event_id", R.opened(box, b"0123456789abcdef").alias("secret"), R.opened(box, b"another key 1234").alias("forged"))


@query("pages", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN md5(url) WHEN 1 THEN md5('a b+c') END AS digest FROM pages")
def page_data_images(df):
    p = F.col("page_id")
    uri = F.when(p % 3 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("url").cast("binary")))).when(p % 3 == 1, "data:image/svg+xml,a%20b+c").otherwise("data:text/html,x")
    return df.select("page_id", F.md5(R.data_image(uri)).alias("digest"))


@query("conversations", "SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS pairs FROM conversations GROUP BY 1")
def conv_positional_zip(df):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    got = df.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.zip_with(F.col("t.role"), F.col("t.n"), lambda a, b: F.concat(a, F.lit(":"), b.cast("string"))).alias("z"))
    return got.select("conv_id", F.array_join("z", ",").alias("pairs"))


@query("conversations", "SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn % 2, turn) AS turns, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1")
def conv_halves_joined(df):
    half = lambda k: F.sort_array(F.collect_list(F.when(F.col("turn") % 2 == k, F.col("turn"))))
    got = df.groupBy("conv_id").agg(half(0).alias("a"), half(1).alias("b"), F.collect_list("role").alias("r"))
    return got.select("conv_id", F.array_join(F.flatten(F.array("a", "b")).cast("array<string>"), ",").alias("turns"), F.array_join(F.array_sort(F.array_union(F.array().cast("array<string>"), "r")), ",").alias("roles"))


CHUNK_SQL = """
WITH RECURSIVE l AS MATERIALIZED (SELECT conv_id, i AS n, string_split(content, chr(10))[i] || CASE WHEN i < len(string_split(content, chr(10))) THEN chr(10) ELSE '' END AS line FROM {conv}, unnest(range(1, len(string_split(content, chr(10))) + 1)) u(i)),
m AS MATERIALIZED (SELECT conv_id, n, length(line) AS size, trim(line, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank, regexp_matches(line, '^#{{1,6}} ') AS head FROM l WHERE line <> ''),
f AS (SELECT conv_id, n, CAST(0 AS BIGINT) AS chunk, size AS chars, NOT blank AND NOT head AS body, ceil(size / 4) >= {t} AND NOT blank AND NOT head AND ceil(size / 4) >= 2 * {t} AS closed FROM m WHERE n = 1
 UNION ALL SELECT m.conv_id, m.n, f.chunk + CAST(closed OR (head AND body) AS BIGINT), CASE WHEN closed OR (head AND body) THEN 0 ELSE chars END + size, (NOT (closed OR (head AND body)) AND body) OR (NOT blank AND NOT head),
  ceil((CASE WHEN closed OR (head AND body) THEN 0 ELSE chars END + size) / 4) >= {t} AND ((NOT (closed OR (head AND body)) AND body) OR (NOT blank AND NOT head)) AND (blank OR ceil((CASE WHEN closed OR (head AND body) THEN 0 ELSE chars END + size) / 4) >= 2 * {t})
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.n = f.n + 1),
c AS MATERIALIZED (SELECT conv_id, chunk, CAST(ceil(max(chars) / 4) AS BIGINT) AS tokens FROM f GROUP BY 1, 2),
g AS (SELECT conv_id, chunk, CAST(0 AS BIGINT) AS out, tokens FROM c WHERE chunk = 0
 UNION ALL SELECT c.conv_id, c.chunk, g.out + CAST(NOT ((g.tokens < {t} // 4 OR c.tokens < {t} // 4) AND g.tokens + c.tokens <= {t} + {t} // 4) AS BIGINT), c.tokens + CASE WHEN (g.tokens < {t} // 4 OR c.tokens < {t} // 4) AND g.tokens + c.tokens <= {t} + {t} // 4 THEN g.tokens ELSE 0 END
  FROM g JOIN c ON c.conv_id = g.conv_id AND c.chunk = g.chunk + 1)
SELECT conv_id, out AS index, max(tokens) AS tokens FROM g GROUP BY 1, 2"""


@query("conversations", CHUNK_SQL.format(conv=CONV, t=512))
def conv_merged_chunks(df):
    made = V.chunks(conversation_markdown(df), "conv_id", options=V.Options(chunk_size=512, chunk_overlap=0))
    return made.select("conv_id", F.col("index").cast("long").alias("index"), F.col("tokens").cast("long").alias("tokens"))


@query("conversations", CHUNK_SQL.format(conv=CONV, t=128), name="conv_merged_chunks_128")
def _(df):
    made = V.chunks(conversation_markdown(df), "conv_id", options=V.Options(chunk_size=128, chunk_overlap=0))
    return made.select("conv_id", F.col("index").cast("long").alias("index"), F.col("tokens").cast("long").alias("tokens"))


@query("events", "SELECT 'latency_bucket{le=\"' || b || '\"} ' || count(*) FILTER (value <= b) AS line FROM events, (SELECT unnest([" + ", ".join(map(str, L.BOUNDS)) + "]) AS b) GROUP BY b UNION ALL SELECT 'latency_bucket{le=\"+Inf\"} ' || count(*) FROM events UNION ALL SELECT 'latency_count{} ' || count(*) FROM events UNION ALL SELECT 'latency_sum{} ' || CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) FROM events")
def metrics_histogram(df):
    return K.histogram_lines(L.histogram(df, "value", []), "latency", L.BOUNDS)


@query("events", "SELECT event_id, json_extract_string(props, '$.k') IS NULL OR event_id % 2 = 0 AS upload FROM events")
def json_uploads(df):
    e = F.col("event_id")
    body = F.when(e % 2 == 0, F.concat(F.lit('{"a":[{"blob":'), "props", F.lit("}]}"))).otherwise(F.concat(F.lit('{"a":[{"b":'), "props", F.lit("}]}")))
    return df.select("event_id", J.upload_udf(body).isNotNull().alias("upload"))


@query("conversations", "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '```python' || chr(10) || trim(text) || chr(10) || '```' ELSE trim(text) END AS answer FROM conversations")
def conv_unwrapped(df):
    own, kind = F.trim("text"), F.when(F.col("turn") % 3 == 1, "python").when(F.col("turn") % 3 == 2, "gfm").otherwise("")
    fenced = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("Here it is:\n")).otherwise(""), F.lit("```"), kind, F.lit("\n"), own, F.lit("\n```"))
    plain = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("```python\n"), own, F.lit("\n```"))).otherwise(fenced)
    return df.select("conv_id", "turn", M.wrapper_udf(plain).alias("answer"))
