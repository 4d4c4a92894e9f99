"""Scalar functions on text, numbers and encodings, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.udf import arrow

#: Words by Unicode word boundaries, for scripts with spaces; Java and RE2 accept it.
WORD = r"(?:\p{L}(?:['’.:·]\p{L})*|\p{N}(?:[.,;'’]\p{N})*|_|\p{M})+"

# Entity names and what they stand for; nbsp is a plain space.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "copy": "©", "reg": "®", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "euro": "€", "amp": "&"}

# ISO 639-3 codes and their BCP 47 tags; others stay as they are.
BCP47 = {
    "eng": "en", "fra": "fr", "deu": "de", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "rus": "ru", "ukr": "uk", "pol": "pl",
    "ces": "cs", "slk": "sk", "slv": "sl", "hrv": "hr", "srp": "sr", "bul": "bg", "ron": "ro", "hun": "hu", "fin": "fi", "swe": "sv",
    "dan": "da", "nob": "nb", "isl": "is", "est": "et", "lav": "lv", "lit": "lt", "ell": "el", "tur": "tr", "ara": "ar", "heb": "he",
    "pes": "fa", "urd": "ur", "hin": "hi", "ben": "bn", "pan": "pa", "guj": "gu", "mar": "mr", "tam": "ta", "tel": "te", "kan": "kn",
    "mal": "ml", "ori": "or", "sin": "si", "nep": "ne", "tha": "th", "vie": "vi", "ind": "id", "msa": "ms", "tgl": "tl", "jpn": "ja",
    "kor": "ko", "cmn": "zh", "zho": "zh", "khm": "km", "mya": "my", "kat": "ka", "hye": "hy", "aze": "az", "kaz": "kk", "uzb": "uz",
    "bel": "be", "mkd": "mk", "cat": "ca", "eus": "eu", "glg": "gl", "afr": "af", "swh": "sw", "zul": "zu", "xho": "xh", "yor": "yo",
    "ibo": "ig", "hau": "ha", "amh": "am", "som": "so", "epo": "eo", "lat": "la", "yid": "yi", "jav": "jv", "sna": "sn", "aka": "ak",
    "tuk": "tk", "cym": "cy", "gle": "ga", "sqi": "sq",
}


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))).cast("long")


def tokens_by_chars(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def tokens_by_bytes(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4).cast("long")


def pages(n_words: Column, per_page: int = 500) -> Column:
    return F.ceil(n_words / per_page).cast("long")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1)).cast("long")


def is_fence(line: Column) -> Column:
    return line.rlike(r"^ *(```|~~~)")


def cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(c), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def _named(c: Column) -> Column:
    for name, value in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return c


def decoded(text: str | None) -> str | None:
    """Every entity, numeric ones too, in one pass; numbers that are no character stay."""

    def value(m: re.Match) -> str:
        name = m[1]
        if not name.startswith("#"):
            return ENTITIES.get(name, m[0])
        number = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else m[0]

    return None if text is None else re.sub(r"&(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[a-z]+);", value, text)


numeric_udf = arrow(decoded, "string")


def decode_entities(c: Column) -> Column:
    """Entities, &amp; last, so that nothing is decoded twice. Unknown names stay. Only texts with numeric ones reach Python."""
    return F.coalesce(numeric_udf(F.when(F.contains(c, F.lit("&#")), c)), _named(c))


def strip_blocks(c: Column) -> Column:
    for tag in ("script", "style", "noscript", "template"):
        c = F.regexp_replace(c, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}[^>]*>", "")
    return F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")


#: White space, garbage (control, private and replacement characters): by code points, the same in Java and RE2.
BLANK = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
GARBAGE = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]"


def visible(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{BLANK}]"))


def needs_ocr(c: Column, images: Column) -> Column:
    """Whether a page's text is too little, not mostly letters and digits, garbled, or a caption of images."""
    seen, share = visible(c), F.greatest(visible(c), F.lit(1))
    usable = (seen >= 20) & (F.regexp_count(c, F.lit(r"[\p{L}\p{N}]")) / share >= 0.5) & (F.regexp_count(c, F.lit(GARBAGE)) / share < 0.05)
    return ~usable | ((images > 0) & (seen < 200))


def stem_title(name: Column) -> Column:
    """The stem of a file name with blanks for _ and -; null if nothing is left."""
    stem = F.trim(F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))
    return F.nullif(F.translate(stem, "_-", "  "), F.lit(""))


def inline_route(text: Column, most: int = 4 << 20) -> Column:
    """Inline text up to 4 MiB is taken as it is; more has to be converted."""
    return F.when(F.octet_length(text) <= most, "inline").otherwise("conversion_required")


def requester_id(c: Column) -> Column:
    """Trimmed; blank and null are unknown; null (refused) beyond 128 characters or with control characters."""
    name = F.coalesce(F.nullif(trim_unicode(c), F.lit("")), F.lit("unknown"))
    return F.when((F.length(name) <= 128) & ~name.rlike(r"\p{Cntrl}"), name)


def rfc3339(ms: Column) -> Column:
    """Milliseconds since 1970 as UTC text, whatever the session's zone."""
    at = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_id(job: Column, index: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(job, 256), 1, 32), F.lit("_"), index.cast("string"))


def event_index(event: Column) -> Column:
    """The endpoint's index in an event id."""
    return F.regexp_extract(event, r"_([0-9]+)$", 1).try_cast("int")


def bcp47(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BCP47.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def column_index(c: Column) -> Column:
    """AA10 -> 26."""
    letters = F.split(F.upper(F.regexp_extract(c, r"^([A-Za-z]+)", 1)), "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64)) - 1


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} _-]", ""), " ", "-")


def redact_keys(c: Column) -> Column:
    """Words that look like API keys, apart from marks around them, become ***."""
    core = lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    secret = lambda w: core(w).rlike(r"^(sk-|AIza|AQ\.|gsk_|xai-)") & (F.length(core(w)) >= 8)
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(secret(w), "***").otherwise(w)), " ")


def duration_ms(c: Column) -> Column:
    n, unit = F.regexp_extract(c, r"^\s*([0-9]+)\s*(ms|s|m|h|d)\s*$", 1), F.regexp_extract(c, r"^\s*([0-9]+)\s*(ms|s|m|h|d)\s*$", 2)
    size = F.when(unit == "ms", 1).when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return n.try_cast("long") * size.cast("long")


def size_bytes(c: Column) -> Column:
    n, unit = F.regexp_extract(c, r"(?i)^\s*([0-9]+)\s*(kb|kib|mb|mib|gb|gib|b)?\s*$", 1), F.lower(F.regexp_extract(c, r"(?i)^\s*([0-9]+)\s*(kb|kib|mb|mib|gb|gib|b)?\s*$", 2))
    size = F.when(unit.isin("", "b"), 1).when(unit == "kb", 10**3).when(unit == "kib", 2**10).when(unit == "mb", 10**6).when(unit == "mib", 2**20).when(unit == "gb", 10**9).when(unit == "gib", 2**30)
    return n.try_cast("long") * size.cast("long")


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(250) * F.pow(F.lit(2), F.least(attempt - 1, F.lit(6))), F.lit(30_000)).cast("long")


def webhook_wait_s(attempt: Column, base: int = 30) -> Column:
    return F.get(F.array(*[F.lit(base * k).cast("long") for k in (0, 1, 4, 20, 40, 60)]), attempt.cast("int"))


def image_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def location(kind: Column, first: Column, last: Column) -> Column:
    """slide 3, pages 1-8."""
    return F.when(first == last, F.concat(kind, F.lit(" "), first.cast("string"))).otherwise(F.concat(kind, F.lit("s "), first.cast("string"), F.lit("-"), last.cast("string")))


def clean_alt(c: Column) -> Column:
    """Alternative text on one line, without brackets and private-use marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\[\\]-]", ""), r"\s+", " "))


def memory_estimate(size: Column, multiplier: Column) -> Column:
    """Bytes to reserve for a conversion; an unknown size counts as 8 MiB."""
    return (F.coalesce(size, F.lit(8 << 20)) * multiplier + (256 << 10)).cast("long")


def mime(kind: Column) -> Column:
    table = {
        "markdown": "text/markdown", "text": "text/plain", "html": "text/html", "pdf": "application/pdf", "png": "image/png", "jpeg": "image/jpeg", "webp": "image/webp",
        "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text",
        "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation", "epub": "application/epub+zip",
    }
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), kind)
