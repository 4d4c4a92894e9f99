"""PDFs and images: native text where it is good enough, transcriptions of a model client elsewhere, images placed after their pages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from folioforge.functions import markdown as M
from folioforge.sources import packages as P
from folioforge.sources import pdf

RESULT = P.RESULT + ", partial boolean, images array<struct<id:string,ext:string,bytes:binary,alt:string>>"


class Reader(Protocol):
    def transcribe(self, data: bytes, first: int, last: int) -> tuple[str, bool]:
        """The Markdown of pages first to last of a file, and whether it was cut off."""


@dataclass(frozen=True)
class Rules:
    """ocr: 'on' has every page transcribed, 'auto' those whose own text is poor, 'off' none."""

    ocr: str = "auto"
    allow_partial: bool = False
    images: bool = False
    most_pages: int = 2000
    most_pixels: int = 100_000_000
    max_output_tokens: int = 16_000
    tokens_per_page: int = 800

    @property
    def pages_per_call(self) -> int:
        return max(1, int(self.max_output_tokens / self.tokens_per_page * 0.8))


def ranges_of(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        out[-1:] = [(out[-1][0], n)] if out and out[-1][1] == n - 1 else [*out[-1:], (n, n)]
    return out


def transcribed(reader: Reader, data: bytes, ranges: list[tuple[int, int]], per_call: int) -> list[tuple[int, int, str, bool]]:
    """(first, last, Markdown, cut off) of ranges, `per_call` pages a call; a call of several pages that was cut off is halved."""
    todo = [(a, min(a + per_call - 1, last)) for first, last in reversed(ranges) for a in reversed(range(first, last + 1, per_call))]
    out = []
    while todo:
        first, last = todo.pop()
        text, short = reader.transcribe(data, first, last)
        if short and last > first:
            middle = (first + last) // 2
            todo += [(middle + 1, last), (first, middle)]
        else:
            out.append((first, last, M.strip_wrapper(text), short))
    return out


def _with_images(content: str, segments: list[tuple], found: list[tuple[int, bytes]]) -> tuple[str, list[tuple], dict[str, bytes]]:
    """content with a placeholder for each image after the segment of its page, or at the end."""
    if not found:
        return content, segments, {}
    files = {f"#{k}": data for k, (_, data) in enumerate(found)}
    after: dict[int, list[str]] = {}
    for k, (page, _) in enumerate(found):
        at = next((i for i, s in enumerate(segments) if s[2] <= page <= s[3]), len(segments))
        after.setdefault(at, []).append(f"{P.OPEN}#{k}{P.CLOSE}")
    bounds = [s[0] for s in segments] + [len(content)] if segments else [0, len(content)]
    text, moved = content[: bounds[0]], []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        moved += [(len(text), *segments[i][1:])] if segments else []
        text += "\n\n".join([content[a:b].rstrip(), *(after.get(i, []) if segments else [])]) + "\n\n"
    return text + "".join(x + "\n\n" for x in after.get(len(segments), [])), moved, files


def read_pdf(data: bytes, rules: Rules, reader: Reader | None) -> dict:
    counted = P.pdf_pages(data)
    if counted is None:
        raise P.Refused("corrupt_document", "not a readable PDF (no page tree)")
    total, notes, parts, partial = counted[0], [], [], False
    row = {"pages": total}
    if total > rules.most_pages:
        raise P.Refused("too_many_pages", f"PDF has {total} pages; at most {rules.most_pages}")
    if rules.ocr == "on":
        if reader is None:
            raise P.Refused("provider_not_configured", "PDF transcription needs a model client")
        parts = transcribed(reader, data, [(1, total)] if total else [], rules.pages_per_call)
    else:
        pages = pdf.native_pages(pdf.Pdf(data))
        row["pages"] = len(pages)
        poor = [n for n, _, bad in pages if bad]
        model: dict[int, tuple] = {}
        if poor and rules.ocr == "auto":
            if reader is None:
                raise P.Refused("provider_not_configured", "scanned pages need a model client")
            model = {p[0]: p for p in transcribed(reader, data, ranges_of(poor), rules.pages_per_call)}
        elif poor and not rules.allow_partial:
            raise P.Refused("scanned_pages", f"{len(poor)} page(s) have no usable text and ocr=off (pages {ranges_of(poor)})")
        elif poor:
            partial, notes = True, [f"pages {ranges_of(poor)} have no usable text and were not transcribed (ocr=off)"]
        covered = 0
        for n, text, bad in pages:
            if n in model and n > covered:
                parts.append(model[n])
                covered = model[n][1]
            elif n > covered and not (bad and rules.ocr == "auto"):
                parts.append((n, n, text, None))
    content, segments = "", []
    for first, last, text, short in parts:
        segments.append((len(content), "page", first, last))
        content += text if short is None else text.strip() + "\n\n"
        if short:
            partial = True
            notes.append(f"page {first} transcription was truncated at the model output limit")
    kept: list[dict] = []
    if rules.images:
        found, strange = pdf.page_images(pdf.Pdf(data), P.png, rules.most_pixels)
        content, segments, kept, more = P.place_images(*_with_images(content, segments, found))
        notes += more
        if strange:
            notes.append(f"{strange} PDF image(s) use an encoding that is not extracted")
    return row | {"content": content, "segments": segments, "warnings": notes, "partial": partial, "images": [{k: x[k] for k in ("id", "ext", "bytes", "alt")} for x in kept]}


def read_image(data: bytes, rules: Rules, reader: Reader | None) -> dict:
    """The transcription of one image, which counts as one page."""
    if rules.ocr == "off":
        raise P.Refused("ocr_required", "image-only content needs ocr=on or ocr=auto")
    P.pixels_allowed(data, rules.most_pixels)
    if reader is None:
        raise P.Refused("provider_not_configured", "image transcription needs a model client")
    text, short = reader.transcribe(data, 1, 1)
    content = M.strip_wrapper(text)
    notes = ["transcription was truncated at the model output limit"] if short else []
    notes += [] if content.strip() else ["the model returned no content for this image"]
    return {"content": content, "pages": 1, "partial": short, "warnings": notes}


def extract(data: bytes, name: str = "", rules: Rules = Rules(), reader: Reader | None = None) -> dict:
    """What packages.extract gives, with partial and images; PDFs and images are read too. Never raises for what a document holds."""
    row = {"partial": False, "images": []} | P.extract(data, name, rules.images)
    if row["format"] not in ("pdf", "png", "jpeg", "webp"):
        return row
    row |= {"error": None, "content": None}
    try:
        row |= read_pdf(data, rules, reader) if row["format"] == "pdf" else read_image(data, rules, reader)
    except P.Refused as e:
        row["error"] = e.row
    except (ValueError, KeyError, TypeError, AttributeError, zlib.error) as e:
        row["error"] = ("corrupt_document", str(e)[:200], "extraction")
    return row


def extracted(files: DataFrame, rules: Rules = Rules(), reader: Reader | None = None) -> DataFrame:
    """Files as spark.read.format("binaryFile") gives them; model calls run in the task that holds the file."""
    names = [x.split()[0] for x in P.RESULT.split(", ")[:5]] + ["segments", "warnings", "error", "partial", "images"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([extract(bytes(c), p, rules, reader) for p, c in zip(part["path"], part["content"], strict=True)], columns=names)

    P.few_files(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, RESULT)
