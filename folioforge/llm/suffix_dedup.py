"""Substring dedup by suffix arrays and longest previous factors, over bytes.

1. Anchors: in every string of `length` bytes the least 32-byte gram (leftmost among equals) is its anchor, so equal
   strings have equal anchors at equal places. The strings that start at consecutive bytes and share an anchor make a
   stretch; stretches are the rows, about one per 185 bytes of text.
2. Stretches equal as a whole repeat as a whole; one of them stands for all in what follows.
3. Different stretches with one anchor may share some of their strings. Their bytes are concatenated, class after class,
   into bounded blocks; each block gets its suffix array (prefix doubling up to `length` bytes) and its
   longest-previous-factor array, from the previous and next smaller positions in suffix order, up to `length` bytes.
   Where that is `length`, the string is a later copy.
   A class of more than `largest` stretches isn't gathered; its strings are compared by fingerprint in a shuffle.

keep="first" removes later copies and keeps the earliest by (doc_id, place); keep="none" removes every copy.
Null text is empty; documents whose id is null come last; rows equal in id and text count as copies of each other. Documents
shorter than `length` keep all; of a very long one pieces of 2 MB that overlap are scanned, so no string is missed. An empty
table gives an empty result. Only the id and text columns are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C

GRAM, BLOCK, SUFFIXES, PIECE = 32, 500_000, 750_000, 2_000_000
STRETCH = "anchor long, whole long, rk long, ord long, lo int, hi int"


def _slide_min(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive keys."""
    out, k = keys.copy(), 1
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return out if k == n else np.minimum(out[: len(keys) - n + 1], out[n - k : n - k + len(keys) - n + 1])


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one buffer: the hash of each gram, and the anchor of the string at each start."""
    h, k, step = C.BYTE_VALUES[data], 1, 0
    while k < GRAM:
        h = h[:-k] * C.MULTIPLIERS[8 + step] + h[k:]
        k, step = 2 * k, step + 1
    h = C.mix(h)
    low = np.uint64((1 << 24) - 1)
    anchors = (_slide_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    return h, anchors


def stretches(docs: DataFrame, length: int) -> DataFrame:
    """All stretches of docs (rk, ord, body). Documents shorter than length have none."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)]
            data, off = C.buffers(batch.column(2))
            for a, b in C.chunks(off, BLOCK):
                # a longer document is taken in pieces that overlap, cut so that every string lies in one piece
                for s in range(int(off[a]), int(off[b]), PIECE) if b == a + 1 else [int(off[a])]:
                    e = min(int(off[b]), s + PIECE + length - 1) if b == a + 1 else int(off[b])
                    if e - s < length:
                        continue
                    part = data[s:e]
                    h, anchor = _anchors(part, length)
                    bounds = np.clip(off[a : b + 1] - s, 0, e - s)
                    doc = np.searchsorted(bounds, np.arange(len(anchor)), "right") - 1
                    ok = np.arange(len(anchor)) + length <= bounds[doc + 1]
                    new = np.ones(len(anchor), bool)
                    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                    lo = np.flatnonzero(new & ok)
                    if not len(lo):
                        continue
                    stop = np.append(np.flatnonzero(new), len(anchor))
                    hi = stop[np.searchsorted(stop, lo, "right")] - 1
                    last = bounds[doc[lo] + 1] - length
                    hi = np.minimum(hi, last)
                    view = memoryview(part)
                    whole = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(lo))
                    whole = C.mix(whole + (anchor[lo] - lo).astype(np.uint64))
                    owner = doc[lo] + a
                    shift = s - off[owner]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (h[anchor[lo]].view(np.int64), whole.view(np.int64), ids[0][owner], ids[1][owner], (lo + shift).astype(np.int32), (hi + shift).astype(np.int32))],
                        ["anchor", "whole", "rk", "ord", "lo", "hi"],
                    )

    return docs.select("rk", "ord", "body").mapInArrow(scan, STRETCH)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts in order of their first length bytes, and where in that order each set of equals begins."""
    padded = np.append(data, np.zeros(length, np.uint8))
    key = padded.astype(np.uint64)
    for k in (1, 2, 4):
        key = (key[:-k] << np.uint64(8 * k)) | key[k:]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    k = 8
    while 2 * k <= length:
        rank = np.unique((rank[:-k] << np.uint64(32)) | rank[k:], return_inverse=True)[1].astype(np.uint64)
        k *= 2
    final = (rank[starts] << np.uint64(32)) | rank[starts + (length - k)]
    order = np.argsort(final, kind="stable")
    final = final[order]
    new = np.ones(len(final), bool)
    new[1:] = final[1:] != final[:-1]
    return order, np.flatnonzero(new)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1: all places jump together, over what is known to be larger."""
    at = np.arange(len(values)) - 1
    todo = np.arange(len(values))
    while len(todo := todo[at[todo] >= 0]) and len(todo := todo[values[at[todo]] > values[todo]]):
        at[todo] = at[at[todo]]
    return at


def longest_previous_factors(order: np.ndarray, begin: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """For each suffix length, if its first `length` bytes also start at a smaller position, else 0.

    position: place of each suffix in the corpus. Of all suffixes at smaller positions, the previous and the next in suffix
    order agree with a suffix in the most bytes, so the longest previous factor is the longer of these two matches; here it
    counts up to `length` bytes, which two suffixes share if they stand in one set of equals (begin) of the order.
    """
    placed = position[order]
    same = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    before = smaller_before(placed)
    after = len(order) - 1 - smaller_before(placed[::-1])[::-1]
    hit = (before >= 0) & (same[before] == same)
    hit |= (after < len(order)) & (same[np.minimum(after, len(order) - 1)] == same)
    out = np.zeros(len(order), np.int64)
    out[order[hit]] = length
    return out


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Whole classes, as they come sorted by anchor, in blocks of about SUFFIXES bytes."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch]).select(names)
        held = pa.concat_tables([held, part]) if held is not None else part
        if held["content"].nbytes < SUFFIXES:
            continue
        anchor = held["anchor"].to_numpy()
        cut = int(np.searchsorted(-(anchor[::-1] == anchor[-1]).astype(int), 0)) if anchor[0] != anchor[-1] else len(anchor)
        if cut < len(anchor):
            yield held.slice(0, len(anchor) - cut)
            held = held.slice(len(anchor) - cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _spans(rk: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["rk", "lo", "hi"])


def _runs(flagged: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged starts joined to runs: owner, first, last."""
    at = np.flatnonzero(flagged)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(owner[at]) != 0)
    first = np.flatnonzero(new)
    return owner[at[first]], place[at[first]], place[at[np.append(first[1:], len(at)) - 1]]


def spans(docs: DataFrame, length: int = 400, keep: str = "first", largest: int = 4096) -> DataFrame:
    """(rk, lo, hi): starts lo to hi of strings to remove from docs (rk, ord, body)."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    table = C.written(stretches(docs, length), "stretches")
    same = table.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "lo", "rk", "hi")).alias("rep"))
    classes = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    first = keep == "first"
    twice = same.filter("n > 1").select("anchor", "whole", "n", "rep")
    of = (F.col("rep.ord") == F.col("ord")) & (F.col("rep.lo") == F.col("lo")) & (F.col("rep.rk") == F.col("rk"))
    whole = C.join_counted(table, twice, ["anchor", "whole"], table.count()).filter(~of if first else F.lit(True)).select("rk", "lo", "hi")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rk, body, parts in zip(batch.column(0), C.unpacked(batch.column(1)), batch.column(2), strict=True):
                own = [parts.values.field(k) for k in ("anchor", "n", "ord", "lo", "hi")]
                cut = [body[a : b + length] for a, b in zip(own[3].to_pylist(), own[4].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([rk.as_py()] * len(cut), pa.int64()), *own, pa.array(cut, pa.binary())], ["rk", "anchor", "n", "ord", "lo", "hi", "content"])

    mixed = C.written(same.join(classes.filter("kinds > 1"), "anchor").select("anchor", "kinds", "n", "rep.*"), "mixed")
    def content(part: DataFrame) -> DataFrame:
        return (
            part.groupBy("rk").agg(F.collect_list(F.struct("anchor", "n", "ord", "lo", "hi")).alias("parts"))
            .join(C.packed(docs), "rk")
            .select("rk", "body", "parts")
            .mapInArrow(slices, "rk long, anchor long, n long, ord long, lo int, hi int, content binary")
        )

    names = ["anchor", "n", "rk", "ord", "lo", "hi", "content"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, names):
            rk, lo = block["rk"].to_numpy(), block["lo"].to_numpy()
            by = np.lexsort((lo, rk))
            once = np.ones(len(by), bool)  # repeated rows bring their stretches again
            once[1:] = (rk[by][1:] != rk[by][:-1]) | (lo[by][1:] != lo[by][:-1])
            if not once.all():
                block = block.take(np.sort(by[once]))
            n, rk, order_, lo, hi = (block[k].to_numpy() for k in names[1:6])
            data, off = C.buffers(block["content"])
            counts = hi - lo + 1
            owner = np.repeat(np.arange(len(counts)), counts)
            within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            place = lo[owner] + within
            order, begin = suffix_order(data, off[owner] + within, length)
            position = np.empty(len(owner), np.int64)
            position[np.lexsort((place, rk[owner], order_[owner]))] = np.arange(len(owner))
            earlier = longest_previous_factors(order, begin, position, length) >= length
            if not first:  # a factor that a later suffix has goes too: the same from the other end
                earlier |= longest_previous_factors(order, begin, len(position) - 1 - position, length) >= length
            own, a, b = _runs(earlier if first else earlier & (n[owner] == 1), owner, place)
            if len(own):
                yield _spans(rk[own], a, b)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk, order_, lo, hi, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            for k, body in enumerate(batch.column(5)):
                view = memoryview(body.as_py())
                size = hi[k] - lo[k] + 1
                hashed = np.fromiter((xxhash.xxh3_64_intdigest(view[x : x + length]) for x in range(size)), np.uint64, size).view(np.int64)
                fill = [np.full(size, v[k]) for v in (rk, order_, n)]
                yield pa.RecordBatch.from_arrays([pa.array(hashed), *map(pa.array, fill), pa.array((lo[k] + np.arange(size)).astype(np.int32))], ["print", "rk", "ord", "n", "lo"])

    small = content(mixed.filter(F.col("kinds") <= largest)).select(*names).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, "rk long, lo int, hi int")
    found = whole.unionByName(small)
    large = mixed.filter(F.col("kinds") > largest)
    if large.isEmpty():
        return found
    big = content(large).select("rk", "ord", "lo", "hi", "n", "content").mapInArrow(prints, "print long, rk long, ord long, n long, lo int").dropDuplicates(["print", "rk", "lo"])
    seen = big.groupBy("print").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("ord", "rk", "lo")).alias("least")).filter("m > 1")
    late = F.struct("ord", "rk", "lo") > F.col("least") if first else F.col("n") == 1
    huge = big.join(seen, "print").filter(late).select("rk", "lo", F.col("lo").alias("hi"))
    return found.unionByName(huge)


def dedup(docs: DataFrame, length: int = 400, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", largest: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): each document without the bytes that repeated strings cover."""
    rows = C.keyed(docs, id_col, text_col)
    found = spans(rows, length, keep, largest).groupBy("rk").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for body, at in zip(C.unpacked(batch.column(1)), batch.column(2), strict=True):
                own = np.frombuffer(body, np.uint8)
                removed = runs_ = 0
                kept = own
                if at.is_valid and len(at.values):
                    edge = np.zeros(len(own) + 1, np.int32)
                    lo, hi = (at.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, kept = int(gone.sum()), own[~gone]
                    runs_ = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for k, v in enumerate((len(own), removed, runs_, kept.tobytes())):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = C.packed(rows).join(found, "rk", "left")
    return joined.select("doc_id", "body", "at").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 400 bytes by its digest.
ORACLE = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents
), s AS (
  SELECT doc_id, i, md5(body[i + 1:i + 400]) AS part FROM d, unnest(range(octet_length(body) - 399)) AS t(i)
), m AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 AS joined FROM s WHERE part IN (SELECT part FROM s GROUP BY part HAVING count(*) > 1)
), r AS (
  SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT doc_id, i, count(*) FILTER (NOT coalesce(joined, false)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m) GROUP BY doc_id, run
), g AS (
  SELECT doc_id, lo, hi, 1 AS gone FROM r UNION ALL SELECT doc_id, octet_length(body), octet_length(body), 0 FROM d
), k AS (
  SELECT doc_id, lo, hi, gone, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi DESC), 0) AS start FROM g
)
SELECT doc_id, any_value(octet_length(body)) AS n_bytes, CAST(sum(hi - lo) AS BIGINT) AS n_removed, CAST(sum(gone) AS BIGINT) AS n_spans,
  sha256(unhex(string_agg(hex(body[start + 1:lo]), '' ORDER BY lo, hi DESC))) AS kept_sha256
FROM k JOIN d USING (doc_id) GROUP BY doc_id
"""
