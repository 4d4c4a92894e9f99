"""Enrichment as plans: each model call is a row of a table of prompts, answered in one stage and joined back in order.

Sections of a long document are rows of their own, so they are answered in parallel; no task holds more than one document's
answers. Calls are paid for: answers are checkpointed in spark.checkpoint.dir, and no later action or lost executor asks again.

`key` is unique and not null. A null content counts as empty, and empty content never reaches a model.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import markdown as M
from folioforge.functions import text as X
from folioforge.functions.udf import arrow
from folioforge.operators import enrich as N

#: What one call returns for title, summary and language together.
TOGETHER = {"title": {"type": "string"}, "summary": {"type": "string"}, "language": {"type": "string"}, "language_confidence": {"type": "number"}}
STATUS = "struct<status:string,method:string,error:string>"
TOO_LARGE = "the text is still too long after the last level of summaries"

sections_udf = arrow(lambda c, target: None if c is None else M.heading_sections(c, target), "array<string>")


@dataclass(frozen=True)
class Features:
    """title, summary and language are 'local', 'llm' or None (off)."""

    title: str | None = "local"
    summary: str | None = "local"
    language: str | None = None
    translate_to: str | None = None
    schema: dict | None = None
    max_input_tokens: int = 128_000
    max_output_tokens: int = 16_000

    def asked(self) -> list[str]:
        return [f for f in ("title", "summary", "language") if getattr(self, f) == "llm"]

    @property
    def text_tokens(self) -> int:
        """What a text may hold to be sent whole."""
        return max(self.max_input_tokens * 8 // 10, 1000)

    @property
    def extract_bytes(self) -> int:
        return max(self.max_input_tokens - 4000 - len(json.dumps(self.schema, separators=(",", ":"))) // 4, 0) * 4


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        context.setCheckpointDir(base)
    return df.checkpoint()


def _stage(df: DataFrame, added: str, answer: Callable[[str], tuple]) -> DataFrame:
    """df with the columns `added`, made by answer(the last column of df). Columns pass as they came."""
    kinds = [x.split(":") for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [answer(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array([g[k] for g in got], pa.list_(pa.string()) if kind.startswith("array") else pa.string()) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(n for n, _ in kinds)])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return settled(df.mapInArrow(run, f"{plain}, {', '.join(' '.join(k) for k in kinds)}"))


def answered(prompts: DataFrame, client: N.Client, schema: dict | None = None, retries: int = 3) -> DataFrame:
    """prompts, whose last column is the prompt, with answer (unwrapped), error and the attempts' statuses."""

    def answer(prompt: str) -> tuple[str | None, str | None, list[str]]:
        text, attempts = N.call(client, prompt, schema, retries)
        return (None, attempts[-1], attempts) if text is None else (M.strip_wrapper(text), None, attempts)

    return _stage(prompts, "answer:string, error:string, attempts:array<string>", answer)


def _by_section(df: DataFrame, key: str, content: str, target: int, prompt: Callable[[Column, Column, Column], Column], client: N.Client) -> DataFrame:
    """(key, parts, error): the answers to each document's sections in order, and the first error."""
    cut = df.select(key, sections_udf(F.col(content), F.lit(target)).alias("__cut"))
    rows = cut.select(key, F.size("__cut").alias("__n"), F.posexplode("__cut").alias("__at", "__section"))
    got = answered(rows.select(key, "__at", prompt(F.col("__section"), F.col("__at") + 1, F.col("__n")).alias("prompt")), client)
    parts = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", "answer", "error"))).alias("parts"))
    wrong = F.filter("parts", lambda p: p["error"].isNotNull())
    return parts.select(key, F.transform("parts", lambda p: p["answer"]).alias("parts"), F.get(wrong, F.lit(0))["error"].alias("error"))


def reduced(df: DataFrame, key: str, content: str, budget: int, client: N.Client, levels: int = 5) -> DataFrame:
    """(key, text, error): texts of at most `budget` tokens as they are, longer ones as their sections' summaries, level by level.

    One failed section fails its document. The driver asks once a level whether any text is still too long.
    """
    left = df.select(key, F.coalesce(F.col(content), F.lit("")).alias("text"))
    fits, nothing, done = X.tokens_by_chars(F.col("text")) <= budget, F.lit(None).cast("string"), []
    size = min(max(budget // 2, 500), 100_000)
    ask = lambda s, k, n: F.concat(F.lit("Summarise part "), k.cast("string"), F.lit(" of "), n.cast("string"), F.lit(", keeping facts, names and numbers:\n"), s)
    for _ in range(levels):
        done.append(left.filter(fits).select(key, "text", nothing.alias("error")))
        left = left.filter(~fits)
        if left.isEmpty():
            break
        parts = _by_section(left, key, "text", size, ask, client)
        done.append(parts.filter(F.col("error").isNotNull()).select(key, nothing.alias("text"), "error"))
        left = parts.filter(F.col("error").isNull()).select(key, F.array_join("parts", "\n\n").alias("text"))
    else:
        done.append(left.select(key, nothing.alias("text"), F.lit(TOO_LARGE).alias("error")))
    return reduce(DataFrame.unionByName, done)


def joined_sections(parts: Column) -> Column:
    """Translated sections, stripped of line feeds at their ends, each on a line of its own with one blank line between them."""
    trim = lambda s: F.regexp_replace(s, r"\A\n+|\n+\z", "")
    gap = lambda text: F.when((text == "") | text.endswith("\n\n"), "").otherwise("\n")
    return F.aggregate(parts, F.lit(""), lambda text, s: F.concat(text, gap(text), trim(s), F.lit("\n")))


def translated(df: DataFrame, key: str, content: str, to: str, client: N.Client, max_output_tokens: int = 16_000) -> DataFrame:
    """(key, translated_content, error): all sections or nothing."""
    size = min(max(max(max_output_tokens, 512) // 3, 256), 4000)
    parts = _by_section(df, key, content, size, lambda s, k, n: F.concat(F.lit(f"Translate to {to}:\n"), s), client)
    return parts.select(key, F.when(F.col("error").isNull(), joined_sections(F.col("parts"))).alias("translated_content"), "error")


def extraction(df: DataFrame, key: str, content: str, schema: dict, client: N.Client, budget_bytes: int = 400_000) -> DataFrame:
    """(key, extracted, error, note): a JSON object that the schema allows, in two attempts; the note tells of content that was cut."""

    def answer(text: str | None) -> tuple[str | None, str | None, str | None]:
        value, error, notes = N.extract(client, text or "", schema, budget_bytes)
        return None if error else json.dumps(value, sort_keys=True), error, (notes or [None])[0]

    return _stage(df.select(key, F.col(content).alias("__content")), "extracted:string, error:string, note:string", answer).drop("__content")


def detected(df: DataFrame, key: str, content: str, target: int = 600, most: int = 64) -> DataFrame:
    """(key, language, language_confidence): a vote of the first `most` sections, weighted by their bytes.

    A section votes for the language with the most stop words in it, with their share of all stop words found as confidence.
    Two languages with a fifth or more and less than three quarters each are `mul`; below 0.3 the language is `und`.
    """
    rows = df.select(key, F.explode(F.slice(sections_udf(F.col(content), F.lit(target)), 1, most)).alias("__section"))
    words = F.split(F.lower(F.regexp_replace("__section", r"[^\p{L}]+", " ")), " ")
    hits = F.array(*[F.struct(N.stop_words_in(F.col("__words"), x).alias("n"), F.lit(x).alias("lang")) for x in N.STOP_WORDS])
    scored = rows.select(key, F.octet_length("__section").cast("double").alias("w"), words.alias("__words")).select(key, "w", hits.alias("h"))
    found = F.aggregate("h", F.lit(0), lambda a, x: a + x["n"])
    voted = scored.filter(found > 0).select(key, "w", F.array_max("h")["lang"].alias("lang"), (F.array_max("h")["n"] / found).alias("c"))
    by = voted.groupBy(key, "lang").agg(F.sum("w").alias("w"), F.sum(F.col("c") * F.col("w")).alias("cw"))
    total, ranked = F.sum("w"), F.sort_array(F.collect_list(F.struct("w", "lang")), asc=False)  # one row a language
    best = by.groupBy(key).agg(total.alias("total"), F.round(F.sum("cw") / total, 3).alias("sure"), ranked.alias("ranked"))
    first, second = F.col("ranked")[0], F.coalesce(F.get("ranked", F.lit(1))["w"], F.lit(0.0))
    code = F.when((first["w"] < 0.75 * F.col("total")) & (second >= 0.2 * F.col("total")), "mul").when(F.col("sure") < 0.3, "und").otherwise(first["lang"])
    named = best.select(key, code.alias("language"), F.col("sure").alias("language_confidence"))
    return df.select(key).join(named, key, "left").select(key, F.coalesce("language", F.lit("und")).alias("language"), F.coalesce("language_confidence", F.lit(0.0)).alias("language_confidence"))


def _object(answer: Column) -> Column:
    """The JSON object in an answer that may say more; null if there is none."""
    return F.get_json_object(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "$")


def together(df: DataFrame, key: str, content: str, asked: list[str], client: N.Client, budget: int) -> DataFrame:
    """(key, title, summary, language, language_confidence, error): what is asked, of one call on the reduced text."""
    names = [n for n in TOGETHER if n in asked or n == "language_confidence" and "language" in asked]
    schema = {"type": "object", "properties": {n: TOGETHER[n] for n in names}, "required": names}
    texts = reduced(df, key, content, budget, client)
    prompt = F.concat(F.lit(f"Return a JSON object with {', '.join(names)} of this document:\n"), "text")
    got = answered(texts.filter(F.col("error").isNull()).select(key, prompt.alias("prompt")), client, schema)
    value = F.from_json(_object(F.col("answer")), "title string, summary string, language string, language_confidence double")
    error = F.coalesce("error", F.when(_object(F.col("answer")).isNull(), "the answer was not valid JSON"))
    own = got.select(key, value.alias("v"), error.alias("error")).select(key, "v.*", "error")
    return own.unionByName(texts.filter(F.col("error").isNotNull()).select(key, "error"), allowMissingColumns=True)


def _status(status: str, method: str | None = None, error: Column | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(method).alias("method"), (F.lit(None) if error is None else error).alias("error")).cast(STATUS)


def enriched(df: DataFrame, key: str, client: N.Client, features: Features, content: str = "content", name: Column | None = None, hint: Column | None = None) -> DataFrame:
    """df with title, summary, language, language_confidence, translated_content, translated_language, extracted (JSON),
    feature_status (a map from feature to status, method and error) and warnings.

    A feature that a model was to give and didn't has failed, but for the title, which falls back to the local one.
    """
    nothing = F.lit(None).cast("string")
    name, hint = nothing if name is None else name, nothing if hint is None else hint
    blank = F.coalesce(~F.col(content).rlike(f"[^{X.BLANK}]"), F.lit(True))
    full, asked = df.filter(~blank).select(key, content), features.asked()
    out, status, warnings = df, {}, []
    put = lambda table, prefix: out.join(table.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in table.columns if c != key]), key, "left")

    if asked:
        out = put(together(full, key, content, asked, client, features.text_tokens), "__m_")
        warnings.append(F.when(F.col("__m_error").isNotNull(), F.concat(F.lit("enrichment failed: "), F.col("__m_error"))))
    trimmed = lambda c: F.nullif(F.regexp_replace(F.col(c), f"^[{X.BLANK}]+|[{X.BLANK}]+$", ""), F.lit(""))
    failed = F.col("__m_error") if asked else nothing

    if features.title == "llm":
        given = trimmed("__m_title")
        title = F.coalesce(given, M.title_udf(hint, F.when(given.isNull(), F.col(content)), name))
        why = F.coalesce(failed, F.lit("the model gave no title"))
        status["title"] = F.when(blank, _status("completed", "local")).when(given.isNotNull(), _status("completed", "llm")).otherwise(_status("completed", "local_fallback", why))
    else:
        title = M.title_udf(hint, F.col(content), name) if features.title else nothing
        status["title"] = _status("completed", "local") if features.title else _status("disabled")
    if features.summary == "llm":
        summary = trimmed("__m_summary")
        status["summary"] = F.when(blank, _status("completed", "local_extractive")).when(failed.isNull(), _status("completed", "llm")).otherwise(_status("failed", "llm", failed))
    else:
        summary = M.summary_udf(F.col(content)) if features.summary else nothing
        status["summary"] = _status("completed", "local_extractive") if features.summary else _status("disabled")
    language, sure = nothing, F.lit(None).cast("double")
    if features.language == "llm":
        well = ~blank & failed.isNull()
        language = F.when(blank, "und").when(well, F.coalesce("__m_language", F.lit("und")))
        sure = F.when(blank, 0.0).when(well, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("__m_language_confidence", F.lit(0.0)))))
        status["language"] = F.when(blank, _status("completed", "local")).when(well, _status("completed", "llm")).otherwise(_status("failed", "llm", failed))
    elif features.language:
        out = put(detected(df.select(key, content), key, content), "__d_")
        language, sure = F.col("__d_language"), F.col("__d_language_confidence")
        status["language"] = _status("completed", "local")
    else:
        status["language"] = _status("disabled")

    extracted, empty = nothing, _status("skipped", "llm", F.lit("empty content"))
    if features.schema is not None:
        out = put(extraction(full, key, content, features.schema, client, features.extract_bytes), "__x_")
        extracted, wrong = F.col("__x_extracted"), F.col("__x_error")
        status["extraction"] = F.when(blank, empty).when(wrong.isNull(), _status("completed", "llm")).otherwise(_status("failed", "llm", wrong))
        warnings += [F.col("__x_note"), F.when(wrong.isNotNull(), F.concat(F.lit("structured extraction failed: "), wrong))]
    else:
        status["extraction"] = _status("disabled")
    text = nothing
    if features.translate_to is not None:
        out = put(translated(full, key, content, features.translate_to, client, features.max_output_tokens), "__t_")
        text, wrong = F.col("__t_translated_content"), F.col("__t_error")
        status["translation"] = F.when(blank, empty).when(wrong.isNull(), _status("completed", "llm")).otherwise(_status("failed", "llm", wrong))
        warnings.append(F.when(wrong.isNotNull(), F.concat(F.lit("translation failed: "), wrong)))
    else:
        status["translation"] = _status("disabled")

    states = F.create_map(*[x for f in sorted(status) for x in (F.lit(f), status[f])])
    made = {
        "title": title, "summary": summary, "language": language, "language_confidence": sure, "translated_content": text,
        "translated_language": F.when(text.isNotNull(), F.lit(features.translate_to)), "extracted": extracted, "feature_status": states,
        "warnings": F.filter(F.array(*warnings), lambda w: w.isNotNull()) if warnings else F.array().cast("array<string>"),
    }
    own = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return out.select(*own, *[c.alias(n) for n, c in made.items()])


def extract_operation(df: DataFrame, key: str, client: N.Client, schema: dict[str, Any] | None, content: str = "content", max_input_tokens: int = 128_000) -> DataFrame:
    """(key, extracted, status, error, code): the operation that needs a schema; blank content is skipped (200), a failure is 422."""
    if schema is None:
        raise ValueError("an extraction needs a schema")
    features = Features(schema=schema, max_input_tokens=max_input_tokens)
    got = extraction(df.select(key, content), key, content, schema, client, features.extract_bytes)
    skipped = F.col("error") == "skipped"
    state = F.when(F.col("error").isNull(), "completed").when(skipped, "skipped").otherwise("failed")
    return got.select(key, "extracted", state.alias("status"), F.when(skipped, "empty content").otherwise(F.col("error")).alias("error"), F.when(state == "failed", 422).otherwise(200).alias("code"), F.col("note"))

