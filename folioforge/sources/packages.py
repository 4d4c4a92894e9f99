"""Office, OpenDocument and EPUB packages, images and PDF structure, from bytes, within an expansion budget."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folioforge.sources import html

RESULT = "path string, format string, content string, title string, pages int, segments array<struct<start:int,kind:string,from:int,to:int>>, warnings array<string>, error struct<code:string,message:string,stage:string>"


class Refused(Exception):
    def __init__(self, code: str, message: str, stage: str = "extraction") -> None:
        super().__init__(message)
        self.row = (code, message, stage)


class Package:
    """Lazy ZIP entries whose expansion shares one budget."""

    def __init__(self, data: bytes, ratio: int = 100, most: int = 1 << 30) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise Refused("corrupt_document", "unreadable ZIP container", "sniff") from e
        self.left = min(most, max(len(data) * ratio, 1 << 20))
        self.names = self.zip.namelist()

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as f:
            data = f.read(self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise Refused("archive_limit_exceeded", "package expands beyond its budget")
        return data

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.read(name)) if name in self.names else None

    def rels(self, part: str) -> dict[str, str]:
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        return {r.get("Id"): r.get("Target") if r.get("TargetMode") == "External" else resolve(folder, r.get("Target") or "") for r in (root if root is not None else [])}


def resolve(base: str, target: str) -> str:
    return posixpath.normpath(target if target.startswith("/") else posixpath.join("/", base, target)).lstrip("/")


def sniff(data: bytes, name: str = "") -> str:
    head = data[:512]
    for magic, kind in ((b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg")):
        if head.startswith(magic):
            return kind
    if head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        raise Refused("unsupported_format", "legacy binary Office formats are not supported", "sniff")
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    if head.startswith(b"PK\x03\x04"):
        package = Package(data)
        for part, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")):
            if part in package.names:
                return kind
        mime = package.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in package.names else ""
        kinds = {"application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp", "application/epub+zip": "epub"}
        if mime in kinds:
            return kinds[mime]
        raise Refused("unsupported_format", "unsupported ZIP-based format", "sniff")
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data":
            raise Refused("unsupported_format", "unsupported binary format", "sniff") from e
        text = head[: e.start].decode("utf-8")
    if "\0" in text:
        raise Refused("unsupported_format", "unsupported binary format", "sniff")
    t = text.lstrip("﻿").lstrip().lower()
    if t.startswith(("<!doctype html", "<html")) or t.startswith("<") and ("<body" in t or "<head" in t) or t.startswith("<?xml") and "<html" in t:
        return "html"
    low = name.lower()
    return "markdown" if low.endswith((".md", ".markdown")) else "html" if low.endswith((".html", ".htm")) else "text"


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _get(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all(e: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (x for x in (e.iter() if e is not None else ()) if _tag(x) == name)


def table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(re.sub(r"\r?\n", "<br>", c.strip().replace("|", "\\|")) for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if lines else ""


#: Marks around the key and the alternative text of an image that is still to be placed.
OPEN, ALT, CLOSE = "\ue000", "\ue001", "\ue002"


def marker(key: str, alt: str | None = None) -> str:
    """The placeholder of the image `key`, an entry of the package."""
    return OPEN + key + (ALT + re.sub(f"[{OPEN}{ALT}{CLOSE}]", "", alt) if alt else "") + CLOSE


def drawn(e: ET.Element, rels: dict[str, str]) -> str:
    """Placeholders of the pictures that a drawing embeds."""
    alt = next((x.get("descr") for x in e.iter() if _tag(x) in ("docPr", "cNvPr") and x.get("descr")), None)
    keys = [rels.get(_get(x, "embed") or _get(x, "id") or "") for x in e.iter() if _tag(x) in ("blip", "imagedata")]
    return "".join(marker(k, alt) for k in keys if k)


def docx(data: bytes, images: bool = False) -> tuple[str, list, list]:
    p = Package(data)
    levels: dict[str, int] = {}
    for s in _all(p.xml("word/styles.xml"), "style"):
        name = (_get(next(_all(s, "name"), s), "val") or "").lower()
        outline = next((_get(o, "val") for o in _all(s, "outlineLvl")), None)
        m = re.fullmatch(r"heading (\d)", name)
        level = 1 if name == "title" else int(m[1]) if m else int(outline) + 1 if outline and outline.isdigit() else 0
        if level:
            levels[_get(s, "styleId") or ""] = min(level, 6)
    numbering = p.xml("word/numbering.xml")
    abstract = {_get(a, "abstractNumId"): {_get(x, "ilvl"): next((_get(f, "val") for f in _all(x, "numFmt")), "bullet") for x in _all(a, "lvl")} for a in _all(numbering, "abstractNum")}
    formats = {_get(n, "numId"): abstract.get(next((_get(x, "val") for x in _all(n, "abstractNumId")), None), {}) for n in _all(numbering, "num")}
    rels, counters = p.rels("word/document.xml"), {}

    def runs(e: ET.Element) -> str:
        out = ""
        for child in e:
            kind = _tag(child)
            if kind == "r":
                text = "".join(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "\n" if _tag(x) == "br" else drawn(x, rels) if images and _tag(x) in ("drawing", "pict") else "" for x in child)
                on = lambda n: any((_get(x, "val") or "1") not in ("0", "false") for x in _all(next(_all(child, "rPr"), None), n))  # noqa: B023, E731
                mark = "*" * (2 * on("b") + on("i"))
                body = text.strip()
                out += text.replace(body, mark + body + mark, 1) if mark and body else text
            elif kind == "hyperlink":
                label, to = runs(child), rels.get(_get(child, "id") or "")
                out += f"[{label}]({to})" if to and label else label
            elif kind in ("ins", "smartTag", "sdt", "sdtContent"):
                out += runs(child)
        return out

    blocks: list[str] = []
    body = next(_all(p.xml("word/document.xml"), "body"), [])
    for e in body:
        if _tag(e) == "tbl":
            rows = [[" / ".join(x for x in (runs(q).strip() for q in _all(c, "p")) if x) for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"]
            blocks.append(table(rows))
        elif _tag(e) == "p":
            text = runs(e).strip()
            pr = next(_all(e, "pPr"), None)
            outline = next((_get(o, "val") for o in _all(pr, "outlineLvl")), None)
            level = min(int(outline) + 1, 6) if outline and outline.isdigit() else levels.get(next((_get(s, "val") for s in _all(pr, "pStyle")), "") or "", 0)
            num, lvl = next((_get(x, "val") for x in _all(pr, "numId")), None), next((_get(x, "val") for x in _all(pr, "ilvl")), "0")
            if not text:
                continue
            if level:
                text = "#" * level + " " + text
            elif num and num != "0":
                counters[num, lvl] = counters.get((num, lvl), 0) + 1
                ordered = formats.get(num, {}).get(lvl, "bullet") != "bullet"
                text = "   " * int(lvl or 0) + (f"{counters[num, lvl]}. " if ordered else "- ") + text
            blocks.append(text)
    return "\n\n".join(blocks), [], []


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(data: bytes, images: bool = False) -> tuple[str, list, list]:
    p = Package(data)
    shared = []
    for s in _all(p.xml("xl/sharedStrings.xml"), "si"):
        phonetic = {id(x) for ph in _all(s, "rPh") for x in ph.iter()}
        shared.append("".join(t.text or "" for t in _all(s, "t") if id(t) not in phonetic))
    rels, blocks, segments, warnings, at = p.rels("xl/workbook.xml"), [], [], [], 0
    for n, sheet in enumerate(_all(p.xml("xl/workbook.xml"), "sheet"), 1):
        rows: list[list[str]] = []
        for r in _all(p.xml(rels.get(_get(sheet, "id") or "", "")), "row"):
            row: list[str] = []
            for c in (x for x in r if _tag(x) == "c"):
                value = next((v.text or "" for v in c if _tag(v) == "v"), None)
                kind = c.get("t")
                if value is None and any(_tag(x) == "f" for x in c):
                    warnings.append(f"{_get(sheet, 'name')}!{c.get('r')}: formula without a cached value")
                text = "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else value or ""
                if kind == "s" and text.isdigit():
                    text = shared[int(text)] if int(text) < len(shared) else ""
                text = {"0": "FALSE", "1": "TRUE"}.get(text, text) if kind == "b" else text
                k = column_number(c.get("r") or "") if c.get("r") else len(row)
                if k < 16_384:
                    row += [""] * (k + 1 - len(row))
                    row[k] = text
            while row and not row[-1]:
                row.pop()
            rows += [row] if row else []
        block = f"## {_get(sheet, 'name')}\n\n" + (table(rows) if rows else "_(empty sheet)_")
        part = rels.get(_get(sheet, "id") or "", "")
        for drawing in (to for to in p.rels(part).values() if images and "/drawings/" in to and to in p.names):
            block += "".join("\n\n" + drawn(x, p.rels(drawing)) for x in _all(p.xml(drawing), "pic"))
        segments.append((at, "sheet", n, n))
        blocks.append(block)
        at += len(block) + 2
    return "\n\n".join(blocks), segments, warnings


def pptx(data: bytes, images: bool = False) -> tuple[str, list, list]:
    p = Package(data)
    rels, blocks, segments, at = p.rels("ppt/presentation.xml"), [], [], 0
    for n, ident in enumerate(_all(p.xml("ppt/presentation.xml"), "sldId"), 1):
        rid = next((v for k, v in ident.attrib.items() if k.endswith("}id")), "")
        title, body = "", []
        root = p.xml(rels.get(rid, ""))
        for shape in _all(root, "sp"):
            kind = next((_get(x, "type") for x in _all(shape, "ph")), None)
            for para in _all(shape, "p"):
                text = "".join(t.text or "" for t in _all(para, "t")).strip()
                level = int(next((_get(x, "lvl") for x in _all(para, "pPr")), None) or 0)
                if text and kind in ("title", "ctrTitle"):
                    title = f"{title} {text}".strip()
                elif text:
                    body.append("  " * level + "- " + text)
        tables = [table([["".join(t.text or "" for t in _all(c, "t")) for c in _all(r, "tc")] for r in _all(t, "tr")]) for t in _all(root, "tbl")]
        pictures = [drawn(x, p.rels(rels[rid])) for x in _all(root, "pic")] if images and rid in rels else []
        block = "\n\n".join(x for x in (f"## Slide {n}" + (f": {title}" if title else ""), "\n".join(body), *tables, *pictures) if x)
        segments.append((at, "slide", n, n))
        blocks.append(block)
        at += len(block) + 2
    return "\n\n".join(blocks), segments, []


def odf(data: bytes, images: bool = False) -> tuple[str, list, list]:
    p = Package(data)
    blocks: list[str] = []
    segments: list = []

    def text(e: ET.Element) -> str:
        out = e.text or ""
        for c in e:
            kind = _tag(c)
            href = (_get(c, "href") or "").removeprefix("./")
            inner = marker(href) if images and kind == "image" and href else " " * min(int(_get(c, "c") or 1), 64) if kind == "s" else "\t" if kind == "tab" else "\n" if kind == "line-break" else text(c)
            out += (f"[{inner}]({_get(c, 'href')})" if kind == "a" and _get(c, "href") else inner) + (c.tail or "")
        return out

    def walk(e: ET.Element, depth: int) -> None:
        for c in e:
            kind = _tag(c)
            if kind == "h":
                blocks.append("#" * min(int(_get(c, "outline-level") or 1), 6) + " " + text(c).strip())
            elif kind == "p":
                own = text(c).strip()
                blocks.extend([("  " * (depth - 1) + "- " if depth else "") + own] if own else [])
            elif kind == "list":
                walk(c, depth + 1)
            elif kind == "table":
                name, rows = _get(c, "name"), []
                for r in _all(c, "table-row"):
                    row: list[str] = []
                    for x in r:
                        if _tag(x) in ("table-cell", "covered-table-cell"):
                            row += [" ".join(text(q).strip() for q in _all(x, "p"))] * min(int(_get(x, "number-columns-repeated") or 1), 256)
                    while row and not row[-1]:
                        row.pop()
                    rows += [row] * min(int(_get(r, "number-rows-repeated") or 1), 256) if row else []
                if e.tag.endswith("spreadsheet"):
                    segments.append((sum(len(b) + 2 for b in blocks), "sheet", len(segments) + 1, len(segments) + 1))
                    blocks.append(f"## {name}")
                blocks.extend([table(rows)] if rows else [])
            elif kind == "page":
                segments.append((sum(len(b) + 2 for b in blocks), "slide", len(segments) + 1, len(segments) + 1))
                blocks.append(f"## Slide {len(segments)}")
                walk(c, 0)
            else:
                walk(c, depth)

    walk(next(_all(p.xml("content.xml"), "body")), 0)
    return "\n\n".join(blocks), segments, []


def epub(data: bytes, images: bool = False) -> tuple[str, list, list]:
    p = Package(data)
    opf = next((_get(x, "full-path") for x in _all(p.xml("META-INF/container.xml"), "rootfile")), "") or ""
    root = p.xml(opf)
    items = {x.get("id"): (x.get("href") or "", x.get("media-type") or "") for x in _all(root, "item")}
    chapters = []
    for ref in _all(root, "itemref"):
        href, kind = items.get(ref.get("idref"), ("", ""))
        name = resolve(posixpath.dirname(opf), href)
        if "html" in kind and name in p.names:
            chapters.append(html.convert(p.read(name).decode("utf-8", "replace"))[0].strip())
    return "\n\n".join(c for c in chapters if c), [], []


def pdf_pages(data: bytes) -> tuple[int, bool] | None:
    """Page count, and whether the page tree gave it; object streams are inflated within 64 MiB."""
    found = [data]
    left = 64 << 20
    for m in re.finditer(rb"/Type\s*/ObjStm.*?stream\r?\n", data, re.S):
        try:
            part = zlib.decompressobj().decompress(data[m.end() :], left)
        except zlib.error:
            continue
        left -= len(part)
        found.append(part)
        if left <= 0:
            break
    counts = [int(c[1]) for part in found for m in re.finditer(rb"/Type\s*/Pages\b", part) if (c := re.search(rb"/Count\s+(\d+)", part[max(0, m.start() - 300) : m.end() + 300]))]
    if counts:
        return max(counts), True
    n = sum(len(re.findall(rb"/Type\s*/Page\b(?!s)", part)) for part in found)
    return (n, False) if n else None


# Marks of image files at an offset, and their extensions.
IMAGE_MARKS = [
    (0, b"\x89PNG", "png"), (0, b"\xff\xd8\xff", "jpg"), (0, b"GIF8", "gif"), (8, b"WEBP", "webp"), (0, b"BM", "bmp"), (0, b"II\x2a\0", "tif"),
    (0, b"MM\0\x2a", "tif"), (0, b"\xd7\xcd\xc6\x9a", "wmf"), (0, b"\0\0\0\x0cjP  ", "jp2"), (0, b"\xff\x4f\xff\x51", "jp2"), (40, b" EMF", "emf"),
]
SMALLEST, SHORT_SIDE, MOST_IMAGES, MOST_BYTES = 256, 32, 500, 64 << 20


def image_kind(data: bytes) -> str | None:
    """The extension of an image by its first bytes; null for anything else."""
    for at, mark, kind in IMAGE_MARKS:
        if data[at : at + len(mark)] == mark and (kind != "webp" or data[:4] == b"RIFF"):
            return kind
    return "svg" if b"<svg" in data[:512] else None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if mark in range(0xC0, 0xD0) and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        at += 2 + size
    return None


def _webp_size(data: bytes) -> tuple[int, int] | None:
    kind, body = data[12:16], data[20:30]
    if kind == b"VP8X":
        return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(body[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return (int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF) if kind == b"VP8 " and len(data) >= 30 else None


def image_size(data: bytes) -> tuple[str, int | None, int | None] | None:
    """Extension, width and height of an image; no size where its kind doesn't tell."""
    kind, size = image_kind(data), None
    if kind == "png" and len(data) >= 24:
        size = struct.unpack(">II", data[16:24])
    elif kind == "gif" and len(data) >= 10:
        size = struct.unpack("<HH", data[6:10])
    elif kind == "bmp" and len(data) >= 26:
        size = tuple(abs(x) for x in struct.unpack("<ii", data[18:26]))
    elif kind == "jpg":
        size = _jpeg_size(data)
    elif kind == "webp":
        size = _webp_size(data)
    return (kind, *(size or (None, None))) if kind else None


def keep_image(data: bytes) -> bool:
    size = image_size(data)
    return size is not None and len(data) >= SMALLEST and not (size[1] is not None and size[1] < SHORT_SIDE and size[2] < SHORT_SIDE)


def pixels_allowed(data: bytes, most: int = 100_000_000) -> tuple[int, int]:
    """Width and height of an image to transcribe, or a refusal."""
    size = image_size(data)
    if size is None or size[1] is None:
        raise Refused("corrupt_document", "unreadable image header")
    if size[1] * size[2] > most:
        raise Refused("image_too_large", f"image is {size[1]}x{size[2]}; at most {most} pixels")
    return size[1], size[2]


def place_images(content: str, segments: list[tuple], images: dict[str, bytes]) -> tuple[str, list[tuple], list[dict], list[str]]:
    """content with each placeholder as a Markdown reference, or nothing where the image is left out; segments moved along;
    the images kept (id, ext, bytes, alt, first segment that holds them), each once; warnings."""
    kept: dict[str, dict] = {}
    total = capped = strange = 0
    parts, shifts, at = [], [], 0
    for m in re.finditer(f"{OPEN}([^{ALT}{CLOSE}]*)(?:{ALT}([^{CLOSE}]*))?{CLOSE}", content):
        data, text = images.get(m[1]), re.sub(r"\s+", " ", re.sub(r"[\[\]\ue000-\ue002]", "", m[2] or "")).strip()
        reference = ""
        if data is not None and image_kind(data) is None:
            strange += 1
        elif data is not None and keep_image(data):
            ident, ext = hashlib.sha256(data).hexdigest()[:16], image_kind(data)
            if ident not in kept and (len(kept) >= MOST_IMAGES or total + len(data) > MOST_BYTES):
                capped += 1
            else:
                if ident not in kept:
                    total += len(data)
                    here = [s for s in segments if s[0] <= m.start()]
                    kept[ident] = {"id": ident, "ext": ext, "bytes": data, "alt": text or None, "segment": here[-1][1:] if here else None}
                reference = f"![{text or 'image'}](images/{ident}.{ext})"
        parts += [content[at : m.start()], reference]
        shifts.append((m.start(), len(reference) - len(m[0])))
        at = m.end()
    moved = [(max(0, s[0] + sum(d for p, d in shifts if p < s[0])), *s[1:]) for s in segments]
    notes = [f"{capped} image(s) were not extracted: the per-document limit ({MOST_IMAGES} images or {MOST_BYTES >> 20} MiB) was reached"] if capped else []
    notes += [f"{strange} embedded object(s) were not recognised as images and were skipped"] if strange else []
    return "".join(parts) + content[at:], moved, list(kept.values()), notes


def png(pixels: bytes, width: int, height: int, channels: int) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + pixels[k * width * channels : (k + 1) * width * channels] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def title_of(data: bytes) -> str | None:
    p = Package(data)
    for name in ("docProps/core.xml", "meta.xml"):
        for t in _all(p.xml(name), "title"):
            if (t.text or "").strip():
                return t.text.strip()
    return None


def entries(data: bytes, content: str) -> dict[str, bytes]:
    """The entries of a package that content has placeholders for, as far as they are there."""
    p = Package(data)
    return {k: p.read(k) for k in dict.fromkeys(re.findall(f"{OPEN}([^{ALT}{CLOSE}]*)", content)) if k in p.names}


def extract(data: bytes, name: str = "", images: bool = False) -> dict:
    """Format, Markdown, title, pages, segments, warnings, error of one document; never raises for what a document holds.

    images: pictures of Office and OpenDocument packages are placed in the text and kept in `images`.
    """
    row = dict(path=name, format=None, content=None, title=None, pages=None, segments=[], warnings=[], error=None)
    try:
        kind = row["format"] = sniff(data, name)
        if kind in ("text", "markdown"):
            text = data.decode("utf-8", "replace").lstrip("﻿")
            row["warnings"] = ["invalid UTF-8 replaced"] if "�" in text and b"\xef\xbf\xbd" not in data else []
            row["content"] = text
            row["title"] = next((x[2:].strip() for x in text.split("\n") if x.startswith("# ")), None) if kind == "markdown" else None
        elif kind == "html":
            row["content"], title, _ = html.convert(data.decode("utf-8", "replace"))
            row["title"] = " ".join(title.split())
        elif kind == "pdf":
            pages = pdf_pages(data)
            row["pages"] = pages[0] if pages else None
            raise Refused("ocr_required", "PDF text needs a model client")
        elif kind in ("png", "jpeg", "webp"):
            raise Refused("ocr_required", "images need a model client")
        else:
            reader = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odf, "ods": odf, "odp": odf, "epub": epub}[kind]
            row["content"], row["segments"], row["warnings"] = reader(data, images)
            if images and kind != "epub":
                row["content"], row["segments"], kept, notes = place_images(row["content"], row["segments"], entries(data, row["content"]))
                row["warnings"] = row["warnings"] + notes
                row["images"] = [{k: x[k] for k in ("id", "ext", "bytes", "alt")} for x in kept]
            row["title"] = title_of(data) if kind != "epub" else None
            row["pages"] = len(row["segments"]) or None
    except Refused as e:
        row["error"] = e.row
    except (ET.ParseError, KeyError, zipfile.BadZipFile, ValueError, zlib.error, StopIteration) as e:
        row["error"] = ("corrupt_document", str(e)[:200], "extraction")
    return row


#: Files in an Arrow batch.
FILES = 32


def few_files(spark: SparkSession) -> None:
    """Whole files: few of them in a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= FILES:
        spark.conf.set(key, str(FILES))


def extracted(files: DataFrame) -> DataFrame:
    """Files as spark.read.format("binaryFile") gives them, refused paths and sizes already filtered."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([extract(bytes(c), p) for p, c in zip(part["path"], part["content"], strict=True)], columns=[x.split()[0] for x in RESULT.split(", ")[:5]] + ["segments", "warnings", "error"])

    few_files(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, RESULT)
