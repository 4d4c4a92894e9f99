"""JSON: schema subset validation, strict schemas, path lookups, templates compiled to columns, lenient parsing, usage totals."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.udf import arrow

UPLOAD_KEYS = ("data", "base64", "content_base64", "bytes", "file_data", "upload", "blob")
DROPPED = ("minLength", "maxLength", "minimum", "maximum", "multipleOf", "pattern", "format", "minItems", "maxItems")


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    known = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "number": number, "integer": number and float(value).is_integer()}
    return known.get(kind, True)


def violation(value: Any, schema: dict, path: str = "$") -> str | None:
    """The first thing in value that schema forbids, with its path; None if nothing."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else [k for k in kinds or [] if isinstance(k, str)]
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{path} should be {' or '.join(kinds)}"
    if isinstance(schema.get("enum"), list) and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        return f"{path} is not one of the allowed values"
    below: list[tuple[Any, dict, str]] = []
    if isinstance(value, dict):
        for key in schema.get("required") or []:
            if key not in value:
                return f"{path}.{key} is required"
        below += [(value[k], sub, f"{path}.{k}") for k, sub in sorted((schema.get("properties") or {}).items()) if k in value]
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        below += [(x, schema["items"], f"{path}[{k}]") for k, x in enumerate(value)]
    return next((m for m in (violation(*x) for x in below) if m), None)


def check_schema(text: str, most_bytes: int = 16 << 10, most_depth: int = 32) -> dict:
    """A usable schema of an object, or ValueError."""
    if len(text.encode()) > most_bytes:
        raise ValueError("schema is too long")
    schema = json.loads(text)
    if not isinstance(schema, dict) or schema.get("type") != "object":
        raise ValueError("schema must describe an object")
    level, depth = [schema], 0
    while level:
        depth += 1
        level = [v for x in level for v in (x.values() if isinstance(x, dict) else x) if isinstance(v, (dict, list))]
    if depth > most_depth:
        raise ValueError("schema is too deep")
    return schema


def strict(schema: Any, named: bool = False) -> Any:
    """Objects closed, keywords that strict providers refuse removed; names of properties and definitions stay."""
    if isinstance(schema, list):
        return [strict(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    if named:
        return {k: strict(v) for k, v in schema.items()}
    out = {k: strict(v, k in ("properties", "$defs", "definitions")) for k, v in schema.items() if k not in DROPPED}
    return out | {"additionalProperties": False} if out.get("type") == "object" else out


def validate_udf(schema: dict):
    """Column of JSON text -> struct(ok, error); text that is not JSON is an error."""

    def check(text: str | None) -> tuple[bool, str | None] | None:
        if text is None:
            return None
        try:
            found = violation(json.loads(text), schema)
        except ValueError:
            found = "$ is not JSON"
        return found is None, found

    return F.udf(check, "struct<ok:boolean,error:string>", useArrow=True)


def find_upload(value: Any) -> str | None:
    """The first inline upload at any depth: a data: string, or a key that names one."""
    if isinstance(value, str):
        return "data:" if value.startswith("data:") else None
    if isinstance(value, dict):
        for k, v in value.items():
            if k in UPLOAD_KEYS:
                return k
            if found := find_upload(v):
                return found
    if isinstance(value, list):
        return next((f for f in map(find_upload, value) if f), None)
    return None


def _upload_in(text: str | None) -> str | None:
    try:
        return None if text is None else find_upload(json.loads(text))
    except ValueError:
        return None


#: The first inline upload of JSON text, or null.
upload_udf = arrow(_upload_in, "string")


def json_path(path: str) -> str:
    """a.b, a.0, a[0] as a JSON path."""
    steps = re.findall(r"[^.\[\]]+", path)
    return "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in steps)


def lookup(c: Column, path: str) -> Column:
    return F.get_json_object(c, json_path(path))


def template(shape: Any, body: Column) -> Column:
    """A template compiled to one column of JSON text: "$" is the body, "$.a.b" a value in it, "$$x" the text "$x"."""

    def build(x: Any) -> Column:
        if isinstance(x, dict):
            parts: list[Column] = []
            for n, (k, v) in enumerate(x.items()):
                parts += [F.lit(("," if n else "") + json.dumps(k) + ":"), build(v)]
            return F.concat(F.lit("{"), *parts, F.lit("}"))
        if isinstance(x, list):
            parts = []
            for n, v in enumerate(x):
                parts += [F.lit("," if n else ""), build(v)]
            return F.concat(F.lit("["), *parts, F.lit("]"))
        if x == "$":
            return body
        if isinstance(x, str) and x.startswith("$."):
            return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(body), json_path(x[2:]), "variant")), F.lit("null"))
        if isinstance(x, str) and x.startswith("$$"):
            x = x[1:]
        return F.lit(json.dumps(x, ensure_ascii=False))

    return build(shape)


def object_in(c: Column) -> Column:
    """From the first { to the last } of a model's answer."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def usage(provider: Column, raw: Column) -> tuple[Column, Column]:
    """Input and output tokens of a provider's usage JSON; missing stays null."""
    n = lambda p: F.get_json_object(raw, p).try_cast("long")
    zero = lambda p: F.coalesce(n(p), F.lit(0).cast("long"))
    gemini_out = n("$.candidatesTokenCount") + zero("$.thoughtsTokenCount")
    anthropic_in = n("$.input_tokens") + zero("$.cache_read_input_tokens") + zero("$.cache_creation_input_tokens")
    tokens_in = F.when(provider == "gemini", n("$.promptTokenCount")).when(provider == "anthropic", anthropic_in).otherwise(F.coalesce(n("$.input_tokens"), n("$.prompt_tokens")))
    tokens_out = F.when(provider == "gemini", gemini_out).when(provider == "anthropic", n("$.output_tokens")).otherwise(F.coalesce(n("$.output_tokens"), n("$.completion_tokens")))
    return tokens_in, tokens_out
