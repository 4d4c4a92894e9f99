"""Model clients, one call with retries, structured data of one text, and the scores of the local language detection; plans are in enrichment."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import jsonops

# Frequent words by which the local scorer tells languages apart.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on", "are", "be", "this"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu", "den", "mit", "sich", "auf", "für", "von", "dem"],
    "fr": ["le", "la", "les", "de", "et", "des", "un", "une", "est", "que", "pour", "dans", "qui", "sur", "pas"],
    "es": ["el", "la", "los", "de", "y", "que", "en", "un", "una", "por", "con", "para", "se", "del", "las"],
}


class ModelError(Exception):
    def __init__(self, status: str, retryable: bool) -> None:
        super().__init__(status)
        self.status, self.retryable = status, retryable


class Client(Protocol):
    def complete(self, prompt: str, schema: dict | None = None) -> str: ...


@dataclass
class Mock:
    """A deterministic model; `fail` makes that many first calls fail, `refuse` all calls whose prompt holds that text."""

    fail: int = 0
    refuse: str = ""
    calls: list[str] = field(default_factory=list)

    def complete(self, prompt: str, schema: dict | None = None) -> str:
        self.calls.append(prompt)
        if len(self.calls) <= self.fail:
            raise ModelError("rate_limited", True)
        if self.refuse and self.refuse in prompt:
            raise ModelError("refused", False)
        if schema:
            return json.dumps(self._sample(schema))
        return "Mock " + hashlib.sha256(prompt.encode()).hexdigest()[:8]

    def transcribe(self, data: bytes, first: int, last: int) -> tuple[str, bool]:
        return f"Mock pages {first} to {last}", False

    def _sample(self, schema: dict) -> Any:
        kind = schema.get("type")
        kind = kind[0] if isinstance(kind, list) else kind
        if "enum" in schema:
            return schema["enum"][0]
        if kind == "object":
            return {k: self._sample(v) for k, v in schema.get("properties", {}).items()}
        if kind == "array":
            return [self._sample(schema.get("items", {}))]
        return {"number": 1.5, "integer": 1, "boolean": True, "null": None}.get(kind, "sample")


def call(client: Client, prompt: str, schema: dict | None = None, retries: int = 3) -> tuple[str | None, list[str]]:
    """The answer, and the status of each attempt; waits are the caller's."""
    attempts: list[str] = []
    for _ in range(retries + 1):
        try:
            answer = client.complete(prompt, schema)
            return answer, [*attempts, "ok"]
        except ModelError as e:
            attempts.append(e.status)
            if not e.retryable:
                break
    return None, attempts


def extract(client: Client, content: str, schema: dict, budget_bytes: int = 400_000) -> tuple[Any, str | None, list[str]]:
    """Structured data in two attempts, the second told what was wrong with the first."""
    if not content.strip():
        return None, "skipped", []
    raw = content.encode()
    text, notes, feedback, wrong = content, [], "", None
    if len(raw) > budget_bytes:
        text = raw[:budget_bytes].decode("utf-8", "ignore")
        notes = [f"structured extraction used the first {len(text.encode())} of {len(raw)} bytes of content"]
    for _ in range(2):
        answer, attempts = call(client, f"{feedback}{text}", jsonops.strict(schema))
        if answer is None:
            return None, attempts[-1], notes
        found = re.search(r"\{.*\}", answer, re.S)
        try:
            value = json.loads(found[0] if found else answer)
            wrong = jsonops.violation(value, schema)
        except ValueError:
            wrong = "the answer was not valid JSON"
        if not wrong:
            return value, None, notes
        feedback = f"The previous answer was wrong: {wrong}\n"
    return None, f"model output does not match extract_schema: {wrong}", notes


def stop_word_scores(text: Column) -> Column:
    """Map from language to its stop words' share of the words."""
    tokens = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " ")
    n = F.greatest(F.size(tokens), F.lit(1))
    pairs = [x for lang in STOP_WORDS for x in (F.lit(lang), stop_words_in(tokens, lang) / n)]
    return F.create_map(*pairs)


def stop_words_in(tokens: Column, lang: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(STOP_WORDS[lang])))
