"""Substring dedup by a log-structured fingerprint index.

Every window of `words` consecutive words has a fingerprint of 56 bits, and 8 bits of another hash to verify it. Documents are read in batches; each batch leaves one
sorted, immutable run per fingerprint range. All runs of a range, and the compacted runs of earlier calls, are merge-joined
by one task; equal fingerprints are verified by the second, independent hash; the earliest document of each stays.
Runs of one range can be compacted to one run (`compact`), against which a later batch is deduplicated.

A fingerprint that occurs often is sent once per run and document at most, so no key grows beyond the number of runs.
Null and empty texts have no words; documents whose id is null come last; rows equal in id and text get equal results, and
windows that only they share stay. Groups of texts grow in number with the data, not in size; fingerprint ranges are as many
as spark.sql.shuffle.partitions, which has to be set so that a range's share of the text, 100 MB or so, fits a task. An empty
table gives an empty result. Only the id and text columns are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C

#: Windows in a run, and bytes hashed at a time.
RUN, BLOCK = 1 << 21, 1_000_000
#: Bytes of text for each group of texts, which one task holds at a time.
RANGE = 32 << 20
#: Bits of the fingerprint by which runs are sorted; eight more, of another hash, verify.
BITS = 56
RUNS = "bucket int, buckets int, header binary, width int, gaps binary, at_width int, at binary, low_width int, low binary, checks binary"
HISTORY = "bucket int, buckets int, hashes binary, checks binary, owners binary"
FLAGS = "grp int, rks binary, counts binary, at binary"


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint range of each hash; it rises with the hash."""
    return (((hashes >> np.uint64(BITS - 32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _group(rk: np.ndarray, n: int) -> np.ndarray:
    """As pmod(rk, n) in SQL."""
    return np.mod(rk, n)


def _emit(parts: list, docs: list, n: int) -> pa.RecordBatch:
    """One run per range. parts: (hashes, checks, ordinals); docs: (rk, ord, first ordinal)."""
    hashes, checks, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
    rk, order, first = (np.concatenate([d[k] for d in docs]) for k in range(3))
    by = np.argsort(hashes)
    hashes, checks, at = hashes[by], checks[by], at[by]
    owner = order[np.searchsorted(first, at, "right") - 1]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(hashes)))) if len(begin) else owner
    mixed = np.zeros(len(begin), bool)  # equal hashes with unequal checks: left to the merge
    if len(begin):
        mixed = np.maximum.reduceat(checks, begin) != np.minimum.reduceat(checks, begin)
    mixed = np.repeat(mixed, np.diff(np.append(begin, len(hashes)))) if len(begin) else mixed
    low = (owner > least) & ~mixed
    ranges = _ranges(hashes, n)
    cut = np.searchsorted(ranges, np.arange(n + 1))
    header = b"".join((np.int64(len(rk)).tobytes(), rk.tobytes(), order.tobytes(), first.astype(np.int64).tobytes()))
    rows: list[list] = [[] for _ in range(10)]
    for b in range(n):
        lo, hi = cut[b], cut[b + 1]
        if lo == hi:
            continue
        mine = low[lo:hi]
        top = hashes[lo:hi][~mine]
        gaps = top.copy()
        gaps[1:] -= top[:-1]
        head, gaps = gaps[:1], gaps[1:]
        width, raw = C.squeeze(gaps)
        at_width, at_raw = C.squeeze(at[lo:hi][~mine])
        low_width, low_raw = C.squeeze(at[lo:hi][mine])
        for k, v in enumerate((b, n, header, width, head.tobytes() + raw, at_width, at_raw, low_width, low_raw, checks[lo:hi][~mine].tobytes())):
            rows[k].append(v)
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in RUNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names)


def runs(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """The sorted runs of all windows of docs (rk, ord, body)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        owners: list = []
        n_windows, base = 0, 0
        for batch in batches:
            rk, order = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            data, off = C.buffers(batch.column(2))
            for a, b in C.chunks(off, BLOCK):
                own = off[a : b + 1] - off[a]
                part = data[off[a] : off[b]]
                starts, ends, doc_words = C.words(part, own)
                hashed = C.word_hashes(part, starts, ends)
                prints, at = C.window_hashes(hashed, doc_words, words)
                if not len(prints):
                    continue
                second, _ = C.window_hashes(C.mix(hashed ^ C.MULTIPLIERS[7]), doc_words, words)
                keep = np.diff(doc_words) >= words
                parts.append((prints >> np.uint64(64 - BITS), (second >> np.uint64(56)).astype(np.uint8), at + base))
                owners.append((rk[a:b][keep], order[a:b][keep], doc_words[:-1][keep] + base))
                base += len(starts)
                n_windows += len(prints)
                if n_windows >= RUN:
                    yield _emit(parts, owners, buckets)
                    parts, owners, n_windows, base = [], [], 0, 0
        if parts:
            yield _emit(parts, owners, buckets)

    return docs.select("rk", "ord", "body").mapInArrow(scan, RUNS)


def _load(table: pa.Table) -> tuple[np.ndarray, ...]:
    """All runs of a range: hashes, checks, documents and places; documents and places of what its own run dominates; row keys and order of the documents."""
    out: list[list] = [[] for _ in range(8)]
    base = 0
    for row in table.to_pylist():
        n = int(np.frombuffer(row["header"][:8], np.int64)[0])
        rk, order, first = np.frombuffer(row["header"][8:], np.int64).reshape(3, n)
        at = C.unsqueeze(row["at_width"], row["at"]).astype(np.int64)
        if len(row["gaps"]):
            gaps = np.concatenate([np.frombuffer(row["gaps"][:8], np.uint64), C.unsqueeze(row["width"], row["gaps"][8:])])
            out[0].append(np.cumsum(gaps, dtype=np.uint64))
            out[1].append(np.frombuffer(row["checks"], np.uint8))
        for k, places in ((2, at), (4, C.unsqueeze(row["low_width"], row["low"]).astype(np.int64))):
            doc = np.searchsorted(first, places, "right") - 1
            out[k].append((doc + base).astype(np.int32))
            out[k + 1].append((places - first[doc]).astype(np.int32))
        out[6].append(rk)
        out[7].append(order)
        base += n
    kinds = (np.uint64, np.uint8, np.int32, np.int32, np.int32, np.int32, np.int64, np.int64)
    return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(out, kinds, strict=True))


def _merged(hashes: np.ndarray, checks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge order of sorted runs, where each verified fingerprint begins in it, and the least owner of each."""
    by = np.argsort(hashes, kind="stable")  # finds the sorted runs and merges them
    h, c = hashes[by], checks[by]
    if (clash := np.flatnonzero((h[1:] == h[:-1]) & (c[1:] != c[:-1]))).size:  # unequal windows share a hash: order them by the check too
        same = np.isin(h, h[clash])
        part = by[same]
        by[same] = part[np.lexsort((checks[part], hashes[part]))]
        h, c = hashes[by], checks[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(new)
    return by, begin, np.minimum.reduceat(owner[by], begin) if len(begin) else np.zeros(0, np.int64)


def repeats(run_table: DataFrame, groups: int, history: DataFrame | None = None) -> DataFrame:
    """Windows that an earlier document also has, as places of their first words: a row for each range and group of row keys."""

    def merge(tables: list[pa.Table]) -> pa.Table:
        hashes, checks, doc, place, low_doc, low_place, rk, order = _load(tables[0])
        n, owner = len(hashes), order[doc]
        for row in tables[1].to_pylist() if len(tables) > 1 else []:
            hashes = np.concatenate([hashes, np.frombuffer(row["hashes"], np.uint64)])
            checks = np.concatenate([checks, np.frombuffer(row["checks"], np.uint8)])
            owner = np.concatenate([owner, np.frombuffer(row["owners"], np.int64)])
        by, begin, least = _merged(hashes, checks, owner)
        late = np.zeros(len(hashes), bool)
        late[by] = owner[by] > np.repeat(least, np.diff(np.append(begin, len(hashes))))
        late = late[:n]
        key, at = rk[np.concatenate([doc[late], low_doc])], np.concatenate([place[late], low_place]).astype(np.uint32)
        group = _group(key, groups)
        by = np.lexsort((key, group))
        key, at, group = key[by], at[by], group[by]
        cut = np.searchsorted(group, np.arange(groups + 1))
        rows: list[list] = [[], [], [], []]
        for g in np.flatnonzero(cut[1:] > cut[:-1]):
            own = key[cut[g] : cut[g + 1]]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for k, v in enumerate((int(g), own[first].tobytes(), np.diff(np.append(first, len(own))).astype(np.uint32).tobytes(), at[cut[g] : cut[g + 1]].tobytes())):
                rows[k].append(v)
        return pa.table([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["grp", "rks", "counts", "at"])

    if history is None:
        return run_table.groupBy("bucket").applyInArrow(lambda a: merge([a]), FLAGS)
    return run_table.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(lambda a, b: merge([a, b]), FLAGS)


def compact(run_table: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One sorted run per range with the earliest owner of every fingerprint: the history for the next batch."""

    def squash(key: tuple, tables: list[pa.Table]) -> pa.Table:
        hashes, checks, doc, *_, order = _load(tables[0])
        owner = order[doc]
        bucket = key[0].as_py()
        for row in tables[1].to_pylist() if len(tables) > 1 else []:
            hashes = np.concatenate([hashes, np.frombuffer(row["hashes"], np.uint64)])
            checks = np.concatenate([checks, np.frombuffer(row["checks"], np.uint8)])
            owner = np.concatenate([owner, np.frombuffer(row["owners"], np.int64)])
        by, begin, least = _merged(hashes, checks, owner)
        first = by[begin]
        n = next(t["buckets"][0].as_py() for t in tables if t.num_rows)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "buckets": pa.array([n], pa.int32()), "hashes": [hashes[first].tobytes()], "checks": [checks[first].tobytes()], "owners": [least.tobytes()]})

    if history is None:
        return run_table.groupBy("bucket").applyInArrow(lambda key, a: squash(key, [a]), HISTORY)
    return run_table.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(lambda key, a, b: squash(key, [a, b]), HISTORY)


def dedup(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each word covered by a window that an earlier document (or history) also has goes.

    Windows are judged on the input. Kept words are joined by one space. history comes from `compact` and says how many
    fingerprint ranges it has; buckets, where given, must agree. Without either there are as many as shuffle partitions.
    """
    rows = C.keyed(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    groups = max(C.n_partitions(docs.sparkSession), -(-size // RANGE))
    if history is not None:
        known = {r["buckets"] for r in history.select("buckets").distinct().limit(2).collect()}
        if len(known) > 1 or buckets is not None and known - {buckets}:
            raise ValueError(f"history has {sorted(known)} fingerprint ranges, not {buckets}")
        buckets = next(iter(known), buckets)
    found = repeats(runs(rows, words, buckets or C.n_partitions(docs.sparkSession)), groups, history)

    def drop(texts: pa.Table, flags: pa.Table) -> pa.Table:
        where: dict[int, list] = {}
        for row in flags.to_pylist():
            at, n = np.frombuffer(row["at"], np.uint32), 0
            for rk, m in zip(np.frombuffer(row["rks"], np.int64).tolist(), np.frombuffer(row["counts"], np.uint32).tolist(), strict=True):
                where.setdefault(rk, []).append(at[n : n + m])
                n += m
        n_words, n_removed, kept = [], [], []
        for rk, body in zip(texts["rk"].to_pylist(), C.unpacked(texts["body"]), strict=True):
            own = body.split()
            n_words.append(len(own))
            if rk in where:
                edge = np.zeros(len(own) + 1, np.int32)
                at = np.unique(np.concatenate(where[rk]))
                edge[at] += 1
                edge[at + words] -= 1
                own = [own[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            n_removed.append(n_words[-1] - len(own))
            kept.append(b" ".join(own))
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    texts = C.packed(rows).withColumn("grp", F.pmod("rk", F.lit(groups)).cast("int"))
    return texts.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(drop, "doc_id long, n_words long, n_removed long, kept binary")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 13 words, with the least doc_id that has it.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 12], 'string_agg', ' ') AS part FROM d, unnest(range(1, len(words) - 11)) AS t(i)
), f AS (
  SELECT part, min(doc_id) AS earliest FROM s GROUP BY part
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos, true AS gone FROM s JOIN f USING (part) WHERE earliest < doc_id
), w AS (
  SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM d
), k AS (
  SELECT doc_id, count(*) AS n_words, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone IS NULL) AS kept FROM w LEFT JOIN c USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
