"""Markdown cores on plain values (normalise, chunk, title, summary, wrappers) and their Arrow UDFs.

Offsets are characters. Chunk closing depends on the previous close, so chunking is a fold per document; everything before
and after it is built-in expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.udf import arrow

GENERIC = ("Slide ", "Page ")
CHUNK_TYPE = "array<struct<index:int,content:string,headings:array<string>,tokens:int,start:int,end:int,overlap:int,span_kind:string,span_from:int,span_to:int>>"


@dataclass(frozen=True)
class Chunk:
    start: int
    end: int
    headings: tuple[str, ...]
    tokens: int
    overlap: int = 0


def is_fence(line: str) -> bool:
    return line.lstrip(" ").startswith(("```", "~~~"))


def heading(line: str) -> tuple[int, str] | None:
    m = re.match(r"(#{1,6}) (.*)", line, re.S)
    return (len(m[1]), m[2].strip()) if m else None


def tokens_of(chars: int) -> int:
    return -(-chars // 4)


def normalize(text: str, starts: list[int] | None = None) -> tuple[str, list[int]]:
    """One final newline, at most one blank line in a row and none at the start, no trailing blanks outside fences.

    starts: character offsets into text; they are carried over to the result.
    """
    out: list[str] = []
    at, size, inside, marks = 0, 0, False, []
    todo = sorted(range(len(starts or [])), key=lambda k: starts[k])
    moved = [0] * len(todo)
    for raw in re.split(r"(?<=\n)", text):
        if not raw:
            continue
        while todo and starts[todo[0]] < at + len(raw):
            moved[todo.pop(0)] = size
        at += len(raw)
        line = raw[:-1] if raw.endswith("\n") else raw
        line = line[:-1] if line.endswith("\r") else line
        fence = is_fence(line)
        if not inside or fence:
            line = line.rstrip(" \t\r\f")
        if not inside and not fence and not line and (not out or out[-1] == ""):
            continue
        inside ^= fence
        out.append(line)
        size += len(line) + 1
        marks.append(size)
    while out and not out[-1]:
        out.pop()
    for k in todo:
        moved[k] = size
    body = "\n".join(out) + "\n" if out else ""
    return body, [min(m, len(body)) for m in moved]


def split(content: str, target: int) -> list[Chunk]:
    """Chunks that close before a heading that follows text, and after a line once they are long enough."""
    target = max(target, 16)
    done: list[Chunk] = []
    stack: list[tuple[int, str]] = []
    path: tuple[str, ...] = ()
    begin = at = 0
    inside = body = False
    for line in re.split(r"(?<=\n)", content):
        if not line:
            continue
        bare = line.lstrip()
        fence = bare.startswith(("```", "~~~"))
        found = None if inside else heading(line.rstrip("\n"))
        if found:
            while stack and stack[-1][0] >= found[0]:
                stack.pop()
            stack.append(found)
            if body:
                done.append(Chunk(begin, at, path, tokens_of(at - begin)))
                begin, body = at, False
            path = tuple(t for _, t in stack)
        inside ^= fence
        at += len(line)
        n, blank = tokens_of(at - begin), not line.strip()
        body |= not blank and not found
        if n >= target and body and (blank or inside or bare.startswith("|") or n >= 2 * target):
            done.append(Chunk(begin, at, path, n))
            begin, body = at, False
    if at > begin:
        done.append(Chunk(begin, at, path, tokens_of(at - begin)))
    return done


def merge_small(content: str, chunks: list[Chunk], target: int) -> list[Chunk]:
    target = max(target, 16)
    out: list[Chunk] = []
    for c in chunks:
        blank = not content[c.start : c.end].strip()
        if out:
            p = out[-1]
            small = p.tokens < target // 4 or c.tokens < target // 4 or blank or not content[p.start : p.end].strip()
            if small and (p.tokens + c.tokens <= target + target // 4 or blank):
                lines = [x for x in content[p.start : p.end].split("\n") if x.strip()]
                if all(heading(x) for x in lines):
                    path = c.headings
                else:
                    same = 0
                    while same < min(len(p.headings), len(c.headings)) and p.headings[same] == c.headings[same]:
                        same += 1
                    path = p.headings[:same]
                out[-1] = replace(p, end=c.end, headings=path, tokens=p.tokens + c.tokens)
                continue
        out.append(c)
    return out


def overlap(content: str, chunks: list[Chunk], want: int) -> list[Chunk]:
    """Each chunk after the first reaches back up to 4 * want characters, to a line or word start, never past its predecessor's."""
    out = chunks[:1]
    for p, c in zip(chunks, chunks[1:], strict=False):
        low = max(p.start, c.start - 4 * want)
        if low != p.start and content[low - 1] != "\n":
            line = content.find("\n", low, c.start)
            space = next((k for k in range(low, c.start) if content[k].isspace()), -1)
            low = line + 1 if 0 <= line and line + 1 < c.start else space + 1 if space >= 0 else c.start
        out.append(replace(c, overlap=c.start - low, tokens=tokens_of(c.end - low)))
    return out


def span_of(segments: list[tuple[int, str, int, int]], start: int, end: int) -> tuple[str, int, int] | None:
    """Kind and range of the segments (start, kind, from, to) that overlap [start, end)."""
    if not segments:
        return None
    nexts = [s[0] for s in segments[1:]] + [1 << 62]
    hit = [s for s, n in zip(segments, nexts, strict=True) if s[0] < end and n > start]
    return (hit[0][1], min(s[2] for s in hit), max(s[3] for s in hit)) if hit else None


def chunk(content: str, target: int, want: int, segments: list[tuple[int, str, int, int]] = ()) -> list[dict]:
    parts = merge_small(content, split(content, target), target)
    parts = overlap(content, parts, want) if want > 0 else parts
    rows = []
    for k, c in enumerate(parts):
        span = span_of(list(segments), c.start - c.overlap, c.end) or (None, None, None)
        rows.append(dict(index=k, content=content[c.start - c.overlap : c.end].strip("\n"), headings=list(c.headings), tokens=c.tokens, start=c.start, end=c.end, overlap=c.overlap, span_kind=span[0], span_from=span[1], span_to=span[2]))
    return rows


def heading_sections(content: str, target: int) -> list[str]:
    return [content[c.start : c.end] for c in split(content, target) if content[c.start : c.end].strip()]


#: Info strings of a fence that may wrap a whole answer.
WRAPPER_INFO = ("", "markdown", "md", "gfm", "commonmark")


def _wrapper(line: str) -> str | None:
    """The marks of a fence that may open a wrapper."""
    m = re.fullmatch(r"(`{3,}|~{3,})([^\r\n]*)", line.strip())
    return m[1] if m and m[2].strip().lower() in WRAPPER_INFO else None


def strip_wrapper(text: str) -> str:
    """The inside of a fence that wraps a whole model answer, after at most one preamble line of 120 bytes ending in a colon.

    The wrapper ends at the first bare fence outside inner blocks that has its mark and at least its length; an answer
    that was cut off has none. Text after that fence makes it a code block of the document, which stays.
    """
    whole = re.sub(r"^[\s\ufeff]+|[\s\ufeff]+$", "", text)
    lines = [x.removesuffix("\r") for x in whole.split("\n")]
    preamble = lines[0].strip()
    if len(lines) > 1 and _wrapper(lines[1]) and preamble.endswith(":") and len(preamble.encode()) <= 120 and not preamble.startswith("#"):
        del lines[0]
    mark = _wrapper(lines[0])
    if mark is None:
        return whole
    inside, end = False, len(lines)
    for k, line in enumerate(map(str.strip, lines[1:]), 1):
        bare = len(line) >= 3 and line[0] in "`~" and not line.strip(line[0])
        if inside:
            inside = not bare
        elif bare and line.startswith(mark):
            end = k
            break
        elif line.startswith(("```", "~~~")):
            inside = True
    if any(x.strip() for x in lines[end + 1 :]):
        return whole
    return "\n".join(lines[1:end]).strip("\n")


def local_title(hint: str | None, content: str, file_name: str) -> str | None:
    if hint and hint.strip():
        return hint.strip()[:200]
    inside = False
    for line in content.split("\n"):
        bare = line.lstrip()
        inside ^= bare.startswith(("```", "~~~"))
        found = None if inside else re.match(r"#{1,6} (.*)", bare)
        name = found[1].strip().strip("*").strip() if found else ""
        if name and not name.startswith(GENERIC):
            return name[:200]
    stem = (file_name.rpartition(".")[0] if "." in file_name else file_name).strip()
    return stem.replace("_", " ").replace("-", " ") or None


def local_summary(content: str) -> str | None:
    """Leading prose sentences: five of 20 bytes or more at most, 600 bytes in all."""
    taken: list[str] = []
    inside = False
    for line in content.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            inside = not inside
            continue
        if inside or len(bare.encode()) < 30 or bare[0] in "#|>":
            continue
        for part in re.split(r"(?<=[.!?。])(?= )", bare.lstrip("-*+").strip()):
            part = part.strip()
            if len(part.encode()) < 20:
                continue
            if len(" ".join(taken).encode()) + len(part.encode()) > 600:
                return "Extractive summary: " + " ".join(taken) if taken else None
            taken.append(part)
            if len(taken) == 5:
                return "Extractive summary: " + " ".join(taken)
    return "Extractive summary: " + " ".join(taken) if taken else None


def paragraphs(text: str) -> str:
    """Wrapped lines joined to paragraphs; a hyphen at a line's end joins its word."""
    out, own = [], ""
    for line in [*text.split("\n"), ""]:
        bare = line.strip()
        if not bare:
            out += [own + "\n\n"] if own else []
            own = ""
        elif own.endswith("-") and not own.endswith(" -"):
            own = own[:-1] + bare
        else:
            own += (" " if own else "") + bare
    return "".join(out)


chunk_udf = arrow(lambda c, target, want: None if c is None else [tuple(r.values()) for r in chunk(c, target, want)], CHUNK_TYPE)
normalize_udf = arrow(lambda c: None if c is None else normalize(c)[0], "string")
title_udf = arrow(lambda h, c, f: local_title(h, c or "", f or ""), "string")
summary_udf = arrow(lambda c: None if c is None else local_summary(c), "string")
paragraphs_udf = arrow(lambda c: None if c is None else paragraphs(c), "string")
wrapper_udf = arrow(lambda c: None if c is None else strip_wrapper(c), "string")


def normalize_plain(c: Column) -> Column:
    """normalize for text without fences, in built-in expressions."""
    c = F.regexp_replace(c, r"[ \t\r\f]+(\n|\z)", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"\A\n+", "")
    c = F.regexp_replace(c, r"\n+\z", "")
    return F.when(c == "", c).otherwise(F.concat(c, F.lit("\n")))


def normalized(c: Column) -> Column:
    """Built-in expressions where no fence can be; the Arrow UDF gets the other texts only, and null for these."""
    fenced = c.rlike(r"(?m)^ *(```|~~~)")
    return F.coalesce(normalize_udf(F.when(fenced, c)), normalize_plain(c))
