"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are runs of characters other than white space and ASCII punctuation, A-Z lowered. Every n-gram of an item is looked
up in every document; each window of twice the item's length that holds at least `seeds` different ones of an item is a
candidate, and overlapping ones are one. Every candidate is aligned, however common its seeds are: an edited copy may keep
only those.

A document is contaminated by an item if their local alignment reaches `share` of the item's full score. Items of fewer
words than n are found only as whole runs of their words. The items are broadcast up to `bound` bytes; a longer benchmark
is taken in parts of that size, one pass each. Null texts are empty; null ids stay null and match like others. Rows equal in
id and text are one document; repeated benchmark rows are one item, and different texts of one item id are aligned each. Of several copies of an item
in a document the best counts, of equal ones the last. Very long texts are scanned whole. Empty tables, of either kind, give no
rows. Only ids and texts are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C

_PLAIN = bytes(ord(" ") if chr(k) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else k + 32 * (65 <= k <= 90) for k in range(256))
MATCH, MISMATCH, GAP = 2, -1, -1


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two arrays of word hashes, and where in the passage it ends."""
    width = len(passage)
    row = np.zeros(width + 1, np.int64)
    slope = -GAP * np.arange(width + 1)
    best, end = 0, 0
    for word in item:
        fresh = np.zeros(width + 1, np.int64)
        fresh[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(fresh, 0) + slope) - slope, 0)
        k = int(np.argmax(row))
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of these texts and the word offsets of each."""
    plain = [x.translate(_PLAIN) for x in bodies]
    data = np.frombuffer(b"".join(plain), np.uint8)
    off = np.append(0, np.cumsum([len(x) for x in plain])).astype(np.int64)
    starts, ends, doc_words = C.words(data, off)
    return C.word_hashes(data, starts, ends), doc_words


class Items:
    """The items' words and their n-grams as one sorted array, with the items of each."""

    def __init__(self, ids: list[int], texts: list[bytes], n: int) -> None:
        hashes, off = _words(texts)
        self.ids, self.n = ids, n
        self.words = [hashes[off[k] : off[k + 1]] for k in range(len(ids))]
        grams, at = C.window_hashes(hashes, off, n)
        owner = np.searchsorted(off, at, "right") - 1
        self.short: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            if 0 < len(words) < n:
                self.short.setdefault(len(words), []).append(k)
        by = np.lexsort((owner, grams))
        once = np.append(True, (grams[by][1:] != grams[by][:-1]) | (owner[by][1:] != owner[by][:-1])) if len(by) else np.zeros(0, bool)
        self.grams, self.owner = grams[by][once], owner[by][once]

    def hits(self, hashes: np.ndarray, doc_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word place, item and seed of each n-gram of the texts that an item has."""
        grams, at = C.window_hashes(hashes, doc_words, self.n)
        lo, hi = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        some = np.flatnonzero(hi > lo)
        n = hi[some] - lo[some]
        seed = np.repeat(lo[some], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at[some], n), self.owner[seed], seed


def windows(place: np.ndarray, seed: np.ndarray, least: int, span: int) -> list[tuple[int, int]]:
    """Disjoint stretches (first, last) of word places: the unions of all windows of span words with least different seeds."""
    places, own = place.tolist(), seed.tolist()
    inside: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    a = 0
    for b, s in enumerate(own):
        inside[s] = inside.get(s, 0) + 1
        while places[b] - places[a] >= span:
            inside[own[a]] -= 1
            if not inside[own[a]]:
                del inside[own[a]]
            a += 1
        if len(inside) >= least:
            if out and places[a] <= out[-1][1]:
                out[-1] = (out[-1][0], places[b])
            else:
                out.append((places[a], places[b]))
    return out


#: Bytes of passages in a batch of candidates, about.
PASSAGES = 16 << 20
CANDIDATE = "rk long, doc_id long, item_id long, lo int, passage binary"


def candidates(docs: DataFrame, items: Items, seeds: int) -> DataFrame:
    """Candidate windows of docs (rk, doc_id, body): their first word and word hashes."""
    shared = docs.sparkSession.sparkContext.broadcast((items.ids, items.words, items.grams, items.owner, items.short, items.n))

    def made(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["rk", "doc_id", "item_id", "lo", "passage"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items.__new__(Items)
        known.ids, known.words, known.grams, known.owner, known.short, known.n = shared.value
        lengths = np.array([len(w) for w in known.words])
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            held = 0
            rk, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bodies = [x.as_py() for x in batch.column(2)]
            sizes = np.append(0, np.cumsum([len(x) for x in bodies]))
            for a, b in C.chunks(sizes, 1_000_000):
                hashes, off = _words(bodies[a:b])
                place, item, seed = known.hits(hashes, off)
                doc = np.searchsorted(off, place, "right") - 1
                by = np.lexsort((place, item, doc))
                place, item, seed, doc = place[by], item[by], seed[by], doc[by]
                group = np.flatnonzero(np.append(np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
                least = np.minimum(seeds, np.maximum(lengths - known.n + 1, 1))
                for x, y in zip(group.tolist(), np.append(group[1:], len(doc)).tolist(), strict=False):
                    k = int(item[x])
                    if y - x < least[k]:
                        continue
                    d, span = int(doc[x]), 2 * int(lengths[k])
                    for first, last in windows(place[x:y], seed[x:y], int(least[k]), span):
                        lo, hi = max(int(off[d]), first - span), min(int(off[d + 1]), last + span)
                        for q, v in enumerate((rk[a + d], doc_ids[a + d], known.ids[k], lo - int(off[d]), hashes[lo:hi].tobytes())):
                            out[q].append(v)
                        held += len(out[-1][-1])
                    if held > PASSAGES:
                        yield made(out)
                        out, held = [[] for _ in range(5)], 0
                for n, which in known.short.items():
                    runs, at = C.window_hashes(hashes, off, n)
                    for k in which:
                        want = C.window_hashes(known.words[k], np.array([0, n]), n)[0][0]
                        for p in at[runs == want]:
                            d = int(np.searchsorted(off, p, "right") - 1)
                            for q, v in enumerate((rk[a + d], doc_ids[a + d], known.ids[k], int(p - off[d]), hashes[p : p + n].tobytes())):
                                out[q].append(v)
            yield made(out)

    return docs.select("rk", "doc_id", "body").mapInArrow(scan, CANDIDATE)


def _part(docs: DataFrame, rows: list, n: int, seeds: int, share: float) -> DataFrame:
    items = Items([r["item_id"] for r in rows], [(r["text"] or "").encode() for r in rows], n)
    spark = docs.sparkSession
    found = C.written(candidates(docs, items, seeds), "candidates")
    shared = spark.sparkContext.broadcast(dict(zip(items.ids, items.words, strict=True)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                item = words[row["item_id"]]
                best, end = align(np.frombuffer(row["passage"], np.uint64), item)
                if best >= share * MATCH * len(item):
                    for k, v in enumerate((row["rk"], row["doc_id"], row["item_id"], best / (MATCH * len(item)), max(0, row["lo"] + end - len(item)), row["lo"] + end)):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["rk", "doc_id", "item_id", "score", "first_word", "end_word"])

    return found.repartition(C.n_partitions(spark), "rk", "item_id").mapInArrow(score, "rk long, doc_id long, item_id long, score double, first_word int, end_word int")


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 3, seeds: int = 3, share: float = 0.5, bound: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and item it is contaminated by: rk, doc_id, item_id, score (share of the item's full score), first_word, end_word (about)."""
    rows = C.keyed(docs, id_col, text_col)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // bound))
    out = None
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect() if parts > 1 else items.collect()  # at most about `bound` bytes
        found = _part(rows, own, n, seeds, share)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("rk", "doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "end_word")).alias("m")).select("rk", "doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the contaminated ones."""
    bad = matches(docs, benchmark, id_col=id_col, text_col=text_col, **kw).select(F.col("rk").alias("__rk")).distinct()
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.withColumn("__rk", F.xxhash64(F.col(id_col).cast("long"), body)).join(bad, "__rk", "left_anti").drop("__rk")
