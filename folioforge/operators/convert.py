"""The document pipeline as plans: convert, summarize, chunk; cache keys and single flight; result records."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import markdown as M
from folioforge.functions import text as X

VERSION = "1"


@dataclass(frozen=True)
class Options:
    chunk_size: int = 512
    chunk_overlap: int | None = None
    words_per_page: int = 500
    gen_title: bool = True
    gen_summary: bool = True
    gen_chunks: bool = True
    detect_language: bool = False
    translate_to: str | None = None
    execution: str = "async"
    priority: str = "normal"
    ocr: str = "on"
    pdf_skip_local_processing: bool | None = None
    create_zip: bool = False
    zip_only: bool = False

    @property
    def size(self) -> int:
        return max(self.chunk_size, 128)

    @property
    def overlap(self) -> int:
        return self.size * 15 // 100 if self.chunk_overlap is None else self.chunk_overlap

    def validate(self) -> None:
        checks = {
            "chunk_size must be 1 to 200000": 0 < self.chunk_size <= 200_000,
            "chunk_overlap must be below chunk_size": 0 <= self.overlap < self.size,
            "words_per_page must be positive": self.words_per_page > 0,
            "execution must be sync or async": self.execution in ("sync", "async"),
            "priority must be normal or low": self.priority in ("normal", "low"),
            "low priority needs async": not (self.execution == "sync" and self.priority == "low"),
            "zip needs async": not (self.execution == "sync" and (self.create_zip or self.zip_only)),
            "ocr must be on, off or auto": self.ocr in ("on", "off", "auto"),
            "pdf_skip_local_processing needs ocr on": not (self.pdf_skip_local_processing and self.ocr != "on"),
            "translate_to must be a language tag": self.translate_to is None or (len(self.translate_to) <= 35 and all(c.isalnum() and c.isascii() or c == "-" for c in self.translate_to)),
        }
        for message, ok in checks.items():
            if not ok:
                raise ValueError(message)

    def key(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k not in ("execution", "priority", "create_zip", "zip_only")}, sort_keys=True)


def cache_key(content: Column, kind: Column, options: Options, provider: str = "", model: str = "") -> Column:
    """What the output depends on: the content, not its name; options but for those of delivery; the model."""
    return F.sha2(F.concat_ws("\0", F.sha2(content, 256), kind, F.lit(options.key()), F.lit(provider), F.lit(model), F.lit(VERSION)), 256)


def statistics(df: DataFrame, content: str = "content", per_page: int = 500) -> DataFrame:
    c = F.col(content)
    out = df.withColumn("words", X.words(c)).withColumn("characters", F.length(c).cast("long")).withColumn("content_bytes", F.octet_length(c).cast("long"))
    return out.withColumn("tokens", X.tokens_by_chars(c)).withColumn("pages", X.pages(F.col("words"), per_page))


def chunks(df: DataFrame, key: str, content: str = "content", options: Options = Options()) -> DataFrame:
    """A row per chunk."""
    options.validate()
    made = df.select(key, F.explode(M.chunk_udf(F.col(content), F.lit(options.size), F.lit(options.overlap))).alias("c"))
    return made.select(key, "c.*")


def convert(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Texts (path, text, format) to result records. Equal documents are converted once and joined back on their key.

    A title that the content doesn't give is made of each document's own file name.
    """
    options.validate()
    keyed = df.withColumn("cache_key", cache_key(F.col("text"), F.col("format"), options))
    once = keyed.dropDuplicates(["cache_key"]).withColumn("content", M.normalized(F.col("text")))
    body = statistics(once, per_page=options.words_per_page)
    nothing = F.lit(None).cast("string")
    body = body.withColumn("title", M.title_udf(nothing, F.col("content"), F.lit("")) if options.gen_title else nothing)
    body = body.withColumn("summary", M.summary_udf(F.col("content")) if options.gen_summary else nothing)
    none = F.array().cast(M.CHUNK_TYPE)
    body = body.withColumn("chunks", M.chunk_udf(F.col("content"), F.lit(options.size), F.lit(options.overlap)) if options.gen_chunks else none)
    status = lambda on, value: F.when(F.lit(not on), "disabled").when(F.length(F.trim("content")) == 0, "skipped").when(value.isNull(), "failed").otherwise("completed")
    body = body.withColumn("feature_status", F.create_map(F.lit("chunks"), status(options.gen_chunks, F.col("chunks")), F.lit("summary"), status(options.gen_summary, F.col("summary")), F.lit("title"), status(options.gen_title, F.lit(""))))
    out = keyed.select("path", "cache_key").join(body.drop("path", "text", "format"), "cache_key")
    return out.withColumn("title", F.coalesce("title", X.stem_title(F.element_at(F.split("path", "/"), -1)))) if options.gen_title else out


def with_cache(keyed: DataFrame, cache: DataFrame, now_ms: int, ttl_ms: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a fresh cached body, and those to compute."""
    fresh = cache.filter(F.col("created_at") >= now_ms - ttl_ms)
    return keyed.join(fresh, "cache_key"), keyed.join(fresh, "cache_key", "left_anti")


def result_json(df: DataFrame, columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def self_size(base: Column) -> Column:
    """The size of a record that states its own size."""
    n = base
    for _ in range(3):
        n = base + F.length(n.cast("string"))
    return n
