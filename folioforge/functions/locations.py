"""Locations of sources: parsing, sanitising, file names, format sniffing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(c: Column) -> Column:
    """local, https, s3, or null where the location is refused."""
    loopback = c.rlike(r"^http://(?:[^/?#@]*@)?(localhost|127\.[0-9]+\.[0-9]+\.[0-9]+|\[::1\])(?::[0-9]+)?(?:[/?#]|$)")
    return F.when(c.startswith("data:"), F.lit(None)).when(c.startswith("/") | c.startswith("file:///"), "local").when(c.startswith("https://") | loopback, "https").when(c.startswith("s3://"), "s3")


def error(c: Column) -> Column:
    return F.when(c.startswith("data:"), "upload_not_supported").when(scheme(c).isNull(), "invalid_source")


def _bare(c: Column) -> Column:
    """A location without user and password, its host in lower case."""
    c = F.regexp_replace(c, r"^((?i:s3|https?)://)[^/?#]*@", "$1")
    head = F.regexp_extract(c, r"^[A-Za-z0-9]+://[^/?#]*", 0)
    return F.concat(F.lower(head), F.substr(c, F.length(head) + 1))


def sanitize(c: Column) -> Column:
    """Safe for logs: no credentials; of a query *** is left on the web, and the region in S3; no fragment on the web."""
    web = F.regexp_replace(F.regexp_replace(F.regexp_replace(_bare(c), r"(?s)#.*$", ""), r"(?s)\?.*$", "?***"), r"^([a-z]+://[^/?]*)(\?|$)", "$1/$2")
    region = F.regexp_extract(c, r"^[^?#]*\?(?:[^#]*&)?(region=[^&#]*)", 1)
    plain = _bare(c)
    s3 = F.concat(F.regexp_extract(plain, r"^[^?#]*", 0), F.when(region != "", F.concat(F.lit("?"), region)).otherwise(""), F.regexp_extract(plain, r"(?s)#.*$", 0))
    return F.when(c.rlike("^(?i:https?)://"), web).when(c.rlike("^(?i:s3)://"), s3).otherwise(c)


def parse_s3(c: Column) -> Column:
    """struct(bucket, key, region, access_key, secret_key, session_token, error) of an S3 location, whose parts are percent-coded."""
    rest = F.regexp_extract(c, r"(?s)^s3://(.*)$", 1)
    creds = F.when(F.contains(rest, F.lit("@")), F.substring_index(rest, "@", 1))
    path = F.when(creds.isNull(), rest).otherwise(F.substr(rest, F.length(creds) + 2))
    bucket = F.lower(F.regexp_extract(path, r"^[^/?#]*", 0))
    text = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    key = text(F.regexp_replace(F.regexp_extract(path, r"^[^/?#]*([^?#]*)", 1), "^/+", ""))
    query = F.regexp_extract(path, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    name = lambda x: F.substring_index(x, "=", 1)
    value = lambda k: F.try_url_decode(F.regexp_extract(F.element_at(F.filter(pairs, lambda x: name(x) == k), -1), "=(.*)$", 1))
    param = lambda k: F.when(F.exists(pairs, lambda x: name(x) == k), value(k))
    other = F.filter(pairs, lambda x: ~name(x).isin("region", "session_token"))
    wrong = (
        F.when(~c.startswith("s3://"), "not an S3 location")
        .when(creds.rlike("[/?#]") | (F.length(creds) - F.length(F.replace(creds, F.lit(":"), F.lit(""))) != 1), "credentials must be access-key:secret-key, percent-encoded")
        .when(bucket == "", "bucket missing")
        .when(F.coalesce(key, F.lit("")) == "", "object key missing")
        .when(F.size(other) > 0, F.concat(F.lit("unknown parameter "), name(F.get(other, 0))))
        .when(creds.startswith(":"), "access key missing")
    )
    own = lambda x: F.when(wrong.isNull(), x)
    parts = {"bucket": bucket, "key": key, "region": param("region"), "access_key": text(F.substring_index(creds, ":", 1)), "secret_key": text(F.substring_index(creds, ":", -1)), "session_token": param("session_token")}
    return F.struct(*[own(v).alias(k) for k, v in parts.items()], wrong.alias("error"))


def file_name(c: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[a-z0-9]+://[^/]*", "")
    return F.coalesce(F.try_url_decode(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit(""))


def forbidden(c: Column) -> Column:
    return c.rlike(r"^/(proc|sys|dev)(/|$)")


def text_format(head: Column, name: Column) -> Column:
    """Format of text by its first characters and its name."""
    t = F.lower(F.regexp_replace(F.regexp_replace(head, "^﻿", ""), r"^\s+", ""))
    html = t.startswith("<!doctype html") | t.startswith("<html") | (t.startswith("<") & (F.contains(t, F.lit("<body")) | F.contains(t, F.lit("<head")))) | (t.startswith("<?xml") & F.contains(t, F.lit("<html")))
    low = F.lower(name)
    return F.when(html, "html").when(low.rlike(r"\.(md|markdown)$"), "markdown").when(low.rlike(r"\.html?$"), "html").otherwise("text")
