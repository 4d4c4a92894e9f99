"""Rows of the operational tables: history items, timings, results, images, webhooks, model calls, limits, configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as X

#: Statistics as they are stored; `files` holds what history shows as fields of its own.
STATISTICS = "pages bigint, words bigint, format string, files struct<cache_hit:boolean,src_bytes:bigint,md_bytes:bigint,zip_bytes:bigint,md_file:string>"


# History


def in_progress(log: DataFrame, status: str = "execution_status") -> DataFrame:
    return log.filter(F.col(status).isin("queued", "running"))


def items(log: DataFrame) -> DataFrame:
    """History items: JSON columns parsed (null where they aren't JSON), `files` lifted out of the statistics, times as text."""
    s = F.from_json("statistics", STATISTICS)
    lifted = [s["files"][k].alias(k) for k in ("cache_hit", "src_bytes", "md_bytes", "zip_bytes", "md_file")]
    rest = F.when(s.isNotNull(), F.to_json(F.struct(*[s[k].alias(k) for k in ("pages", "words", "format")])))
    usage = lambda k: F.get_json_object("usage", f"$.{k}").alias(f"llm_{k}")
    return log.select("request_id", "requester_id", "operation", *lifted, X.rfc3339(F.col("created_at")).alias("created_at"), rest.alias("statistics"), usage("provider"), usage("model"), (F.coalesce("result_available", F.lit(0)) != 0).alias("result_available"))


def selected(df: DataFrame, names: list[str]) -> DataFrame:
    """The fields asked for that exist, in the order of the table: the scan reads no others."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(names)])


def detail_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next rows above `after`, oldest first."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def bounded_scan(log: DataFrame, key: str = "seq", most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The newest rows up to a limit, and whether there may be more (one row)."""
    page = log.orderBy(F.desc(key)).limit(most)
    return page, page.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) >= most).alias("truncated"))


def text_operation(requests: DataFrame, failed: Column) -> DataFrame:
    """The two log rows of a text operation: inserted as running, then finished."""
    done = F.when(failed, "failed").otherwise("completed")
    return requests.withColumn("change", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("running").alias("request_status"), F.lit(None).cast("string").alias("execution_status")), F.struct(F.lit(1).alias("at"), done.alias("request_status"), done.alias("execution_status"))))).select(*requests.columns, "change.*")


# Changes


def inserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with the rows whose key it lacks."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def delete_batch(rows: DataFrame, expired: Column, key: str, size: int = 1000) -> DataFrame:
    """The keys that one batched deletion removes: any `size` of the expired."""
    return rows.filter(expired).select(key).limit(size)


def interrupted(jobs: DataFrame, state: str, at: Column) -> DataFrame:
    """After a restart: running jobs have failed as interrupted, queued ones stay in the queue."""
    running = F.col(state) == "running"
    return jobs.withColumns({"error": F.when(running, "interrupted"), "finished_at": F.when(running, at)}).withColumn(state, F.when(running, "failed").otherwise(F.col(state)))


def migrated(version: int, columns: list[str], steps: dict[int, list[str]]) -> tuple[int, list[str]]:
    """Version and columns after the steps beyond `version`; a second run changes nothing."""
    for k in sorted(s for s in steps if s > version):
        version, columns = k, [*columns, *(c for c in steps[k] if c not in columns)]
    return version, columns


# Results and timings


def timing(df: DataFrame, queue: Column, processing: Column) -> DataFrame:
    return df.withColumn("total_ms", queue + processing)


def with_files(statistics: Column, kind: Column, files: Column) -> Column:
    """Stored statistics: those of the result (a struct of pages, words) with the format and the files."""
    return F.to_json(F.struct(statistics["pages"].alias("pages"), statistics["words"].alias("words"), kind.alias("format"), files.alias("files")))


def markdown_bytes(content: Column, statistics: Column) -> Column:
    """The size of the body, or what the statistics say."""
    return F.coalesce(F.octet_length(content).cast("long"), F.get_json_object(statistics, "$.content_bytes").try_cast("long"))


def result_gate(partial: Column, allow_partial: Column, content: Column) -> tuple[Column, Column]:
    """The error of a partial result that wasn't allowed, and whether the result may be cached: an empty one never is."""
    error = F.when(partial & ~allow_partial, "partial_extraction")
    return error, error.isNull() & ~partial & (F.length(F.trim(content)) > 0)


def needs_model(kind: Column, source: Column, ocr: Column) -> Column:
    """Whether extraction takes a model: by format where known, else by the source's ending, unless OCR is off."""
    ending = F.regexp_replace(F.lower(source), r"(?s)\?.*$", "").rlike(r"\.(pdf|png|jpe?g|webp)$")
    return (ocr != "off") & F.coalesce(kind.isin("pdf", "png", "jpeg", "webp"), ending)


def zip_status(state: Column, stored: Column, zip_state: Column) -> Column:
    """HTTP status of a request for a job's archive: 404 unknown, 409 not finished or failed, 410 expired, 200 there, 202 being made."""
    return F.when(state.isNull(), 404).when(~state.isin("completed", "partial"), 409).when(~stored, 410).when(zip_state == "completed", 200).otherwise(202)


def image_warning(capped: Column, strange: Column, most: int = 500, mib: int = 64) -> Column:
    """Notes on images left out; null for none."""
    notes = F.concat_ws("; ", F.when(capped > 0, F.concat(capped.cast("string"), F.lit(f" image(s) were not extracted: the per-document limit ({most} images or {mib} MiB) was reached"))), F.when(strange > 0, F.concat(strange.cast("string"), F.lit(" embedded object(s) were not recognised as images and were skipped"))))
    return F.nullif(notes, F.lit(""))


def images_present(cached: DataFrame, key: str, images: str, stored: DataFrame) -> DataFrame:
    """Cached results of which every image is still stored; those without images stay."""
    lost = cached.select(key, F.explode(images).alias("id")).join(stored.select("id"), "id", "left_anti").select(key).distinct()
    return cached.join(lost, key, "left_anti")


def place_pages(images: DataFrame, segments: DataFrame, by: str) -> DataFrame:
    """images (by, page, ...) with `place`: the first segment (by, place, from, to) that has the page; null goes to the end."""
    near = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", F.col("from").alias("a"), F.col("to").alias("b")))).alias("__s"))  # the segments of one document
    held = F.get(F.filter("__s", lambda s: (s["a"] <= F.col("page")) & (s["b"] >= F.col("page"))), 0)
    return images.join(near, by, "left").withColumn("place", held["place"]).drop("__s")


def duplicate_slugs(rows: DataFrame, by: list[str], order: str, slug: str = "slug") -> DataFrame:
    """Anchors: the second heading of a slug gets -1, the next -2."""
    n = F.row_number().over(Window.partitionBy(*by, slug).orderBy(order)) - 1
    return rows.withColumn("anchor", F.when(n == 0, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), n.cast("string"))))


def swept(files: DataFrame, cutoff: Column, most: int = 1000) -> DataFrame:
    """Files (path, modificationTime) to delete in one sweep: any `most` of those no younger than the cutoff."""
    return files.filter(F.col("modificationTime") <= cutoff).select("path").limit(most)


# Webhooks


def with_webhooks(jobs: DataFrame, hooks: DataFrame, key: str, has: Column, columns: list[str], order: str) -> DataFrame:
    """jobs with the deliveries of those that have a webhook, in order; others have none."""
    lists = hooks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("webhooks"))
    asked = jobs.filter(has).join(lists, key, "left")
    none = F.array().cast(lists.schema["webhooks"].dataType)
    return asked.withColumn("webhooks", F.coalesce("webhooks", none)).unionByName(jobs.filter(~has).withColumn("webhooks", none))


def resumed(pending: DataFrame, jobs: DataFrame, key: str, specs: str) -> DataFrame:
    """Pending deliveries (event_id, key) with the endpoint that their index names in the job's list."""
    found = pending.join(jobs.select(key, specs), key).withColumn("spec", F.get(specs, X.event_index(F.col("event_id"))))
    return found.filter("spec is not null").drop(specs)


def finished_body(df: DataFrame) -> Column:
    """The body of job.finished: what the table has of its fields, with the model's totals under llm."""
    names = ["event_id", "event", "job_id", "request_id", "status", "src_file", "src_bytes", "dest_file", "md_file", "md_bytes", "docv_file", "docv_bytes", "images_dir", "zip_file", "zip_bytes", "metadata", "statistics", "llm", "timing", "error"]
    value = lambda k: F.lit("job.finished") if k == "event" else F.col("llm.totals") if k == "llm" and k in df.columns else F.col(k) if k in df.columns else F.lit(None).cast("string")
    return F.to_json(F.struct(*[value(k).alias(k) for k in names]), {"ignoreNullFields": "false"})


def zip_event_id(job: Column, index: Column, event: Column) -> Column:
    return F.concat(X.event_id(job, index), F.lit("_"), F.replace(event, F.lit("."), F.lit("-")))


# Model calls


def attempts(calls: DataFrame, by: str, order: list[str]) -> DataFrame:
    return calls.withColumn("attempt", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def totals(calls: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Of each request's attempts (status, usage_source, input_tokens, output_tokens, provider, model): counts, sums that stay
    null where nothing is known, the first provider and model, and whether every attempt that reached the provider has usage."""
    lost = (F.col("usage_source") == "missing") & ~F.col("status").isin("cancelled", "breaker_open", "network_error", "timeout")
    first = F.struct(*order)
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") != "ok").alias("failed_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.min_by("provider", first).alias("provider"), F.min_by("model", first).alias("model"), (~F.bool_or(lost)).alias("usage_complete"),
    )


def call_status(kind: Column, http: Column) -> Column:
    return F.when((kind == "http") & (http == 429), "rate_limited").when(kind == "http", "http_error").when(kind == "network", "network_error").when(kind == "protocol", "protocol_error").otherwise(kind)


def call_error(kind: Column, http: Column) -> Column:
    """struct(status, code) that a failed model call becomes for the caller."""
    pair = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("code"))
    return F.when(kind == "timeout", pair(504, "provider_timeout")).when(kind == "breaker_open", pair(503, "provider_unavailable")).when((kind == "http") & http.isin(401, 403), pair(502, "provider_auth_failed")).otherwise(pair(502, "provider_error"))


def error_message(body: Column) -> Column:
    """A provider's message without keys, 200 characters at most; other bodies are kept out."""
    said = F.get_json_object(body, "$.error.message")
    return F.coalesce(F.left(X.redact_keys(said), F.lit(200)), F.lit("request failed"))


def reset_seconds(c: Column) -> Column:
    """1s, 250ms, 6m0s, 1h as seconds; null for anything else."""
    parts = F.regexp_extract_all(c, F.lit(r"[0-9.]+(?:ms|h|m|s)"), F.lit(0))
    unit = lambda x: F.regexp_extract(x, "[a-z]+", 0)
    size = lambda x: F.when(unit(x) == "ms", 0.001).when(unit(x) == "s", 1.0).when(unit(x) == "m", 60.0).otherwise(3600.0)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.regexp_extract(x, "^[0-9.]+", 0).try_cast("double") * size(x))
    return F.when(c.rlike(r"^(?:[0-9.]+(?:ms|h|m|s))+$"), total)


# Limits


def pages_per_call(max_out: Column, per_page: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(max_out / per_page * 0.8)).cast("long")


def batches(pages: DataFrame, by: str, count: str, per: Column) -> DataFrame:
    """The page ranges (batch, first, last) of each document's model calls."""
    n = F.ceil(F.col(count) / per).cast("long")
    cut = pages.select(by, F.col(count).alias("__n"), per.alias("__per"), F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("batch"))
    return cut.select(by, "batch", (F.col("batch") * F.col("__per") + 1).alias("first"), F.least((F.col("batch") + 1) * F.col("__per"), F.col("__n")).cast("long").alias("last"))


def retry_after_s(queued: Column, rate: Column) -> Column:
    """Seconds until the queue is expected to have room; 10 before any rate is known."""
    return F.when(rate <= 0, 10).otherwise(F.least(F.greatest(F.ceil(queued / rate), F.lit(1)), F.lit(300))).cast("long")


def start_ms(place: Column, free: Column, rate: Column) -> Column:
    """When a job at this place of the queue is expected to start."""
    return F.when(place <= free, 0).otherwise(F.floor((place - free) / F.greatest(rate, F.lit(0.1)) * 1000)).cast("long")


# Secrets and configuration


def sealed(text: Column, key: bytes, nonce: Column | None = None) -> Column:
    """text encrypted and authenticated, its 12-byte nonce first."""
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), *([nonce] if nonce is not None else []))


def opened(box: Column, key: bytes) -> Column:
    return F.try_aes_decrypt(box, F.lit(key), F.lit("GCM")).cast("string")


def data_image(uri: Column) -> Column:
    """The bytes of a data: URI of an image, base64 or percent-coded; null for others."""
    head = F.regexp_extract(uri, r"^data:(image/[a-zA-Z0-9.+-]+(?:;[^,;]+)*),", 1)
    body = F.substring_index(uri, ",", -1)
    return F.when(head == "", None).when(F.lower(head).endswith(";base64"), F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))).otherwise(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary"))


@dataclass(frozen=True)
class Settings:
    """Limits that a deployment may set."""

    max_text_bytes: int = 4 << 20
    max_result_bytes: int = 256 << 20
    max_pdf_pages: int = 2000
    history_days: int = 30
    model: str = "mock"
    local_pdf: bool = True

    @classmethod
    def of(cls, variables: dict[str, str], prefix: str = "FOLIOFORGE_") -> Settings:
        """From environment-like names; unknown ones are no matter, bad values are."""
        got = {}
        for f in fields(cls):
            raw = variables.get(prefix + f.name.upper())
            if raw is None or not raw.strip():
                continue
            kind = type(f.default)
            if kind is bool and raw.strip().lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"{prefix}{f.name.upper()} must be true or false")
            got[f.name] = raw.strip().lower() in ("true", "1") if kind is bool else kind(raw.strip())
        return cls(**got)


def endpoint(provider: str, asked_url: str | None, asked_key: str | None, known: dict[str, tuple[str, str | None]]) -> tuple[str, str | None]:
    """URL and key of a model endpoint; the default key goes to the default endpoint only."""
    url, key = known.get(provider, ("", None))
    if asked_url and asked_url.rstrip("/") != url.rstrip("/"):
        return asked_url, asked_key
    return url, asked_key or key
