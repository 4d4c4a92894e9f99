"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints of B bytes that differ in d bits at most differ in d bytes at most, so at least B - d positional bytes agree: the
guaranteed least count. The positions are cut into groups, and the posting lists are those of all sets of r positions of a
group with their bytes: B - d agreeing bytes fill r places of some group, by the pigeonhole principle, so every link shares a posting list.
In a list, the agreeing positional bytes of each pair are tallied, pairs that reach the guaranteed count stay, and Hamming distance
verifies them. With 64 bits and d = 3 these are eight lists of three bytes, so a list has a share of 2^-24 of all fingerprints.

Equal fingerprints are one row before the index. Lists are compared in bounded blocks, which give spanning links only.
Null and empty texts, and texts of white space, have fingerprint zero, linked like any other. A null id is given back with
component null; repeated rows get equal results; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C
from folioforge.llm import pairs as P

SHARE = 1024


def shingle_hashes(body: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `shingle` words of A-Z-lowered text, repeats included; of all words if there are fewer."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(text[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """n_words 64-bit words; a bit is set if over half the hashes have it."""
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words):
        own = C.mix(hashes + C.MULTIPLIERS[20:21] * np.uint64(k)) if k else hashes
        counts = np.zeros(64, np.int64)
        for a in range(0, len(own), 1 << 17):
            part = np.ascontiguousarray(own[a : a + (1 << 17)])
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(own), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int, n_words: int = 1) -> DataFrame:
    """docs (doc_id, body) as (doc_id, fp): fp is the fingerprint as 8 * n_words bytes, the first word first, high byte first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(x.as_py(), shingle), n_words).astype(">u8").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["doc_id", "fp"])

    return docs.select("doc_id", "body").mapInArrow(scan, "doc_id long, fp binary")


def position_sets(n_bytes: int, distance: int, groups: int = 2) -> list[tuple[int, ...]]:
    """Sets of byte positions, of which any n_bytes - distance positions hold at least one whole."""
    least = n_bytes - distance
    if least < 1:
        raise ValueError("distance must be below the number of bytes")
    size = -(-least // groups)
    return [x for g in range(groups) for x in combinations(range(g * n_bytes // groups, (g + 1) * n_bytes // groups), size)]


def compared(dealt: DataFrame, n_bytes: int, least: int, distance: int, halves: bool = False) -> DataFrame:
    """Links (a, b) that span the classes over all pairs of a block of dealt (block, label, fp) whose labels differ, whose fp agree in `least` bytes (or half bytes) and then by Hamming distance."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in P.whole_blocks(batches, "block", 20_000):
            raw = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint8).reshape(-1, n_bytes)
            wide = np.ascontiguousarray(raw).view(np.uint64)
            names, label = np.unique(table["label"].to_numpy(), return_inverse=True)
            if halves:
                raw = np.concatenate([raw >> 4, raw & 15], axis=1)

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok, differ = np.zeros(len(i), bool), np.flatnonzero(label[i] != label[j])
                for a in range(0, len(differ), 50_000):
                    at = differ[a : a + 50_000]
                    x, y = i[at], j[at]
                    enough = (raw[x] == raw[y]).sum(axis=1) >= least  # count filter
                    x, y, at = x[enough], y[enough], at[enough]
                    ok[at[np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1) <= distance]] = True
                return ok

            i, j = P.linked(table["block"].to_numpy(), near)
            if len(i):
                root = P.forest(label[i], label[j], len(names))
                at = np.flatnonzero(root != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[root[at]])], ["a", "b"])
        C.give_back()

    return dealt.select("block", "label", "fp").repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long")


def tally(post: DataFrame, n_bytes: int, least: int, distance: int, share: int = SHARE) -> DataFrame:
    """Spanning links (a, b) over the nodes of post (node, fp, key): rows of a key, compared in blocks."""
    return compared(P.blocks(post, "key", "node", share).withColumn("label", F.col("node")), n_bytes, least, distance)


def links(prints: DataFrame, distance: int, share: int = SHARE) -> DataFrame:
    """Spanning links (a, b) over the node ids of prints (node, fp), fp all different."""
    n_bytes = len((prints.select("fp").first() or [b"\0" * 8])[0])
    ways = position_sets(n_bytes, distance)
    post = prints.select("node", "fp", F.posexplode(F.array(*[F.concat(*[F.substring("fp", k + 1, 1) for k in way]) for way in ways])).alias("way", "bytes"))
    return tally(post.select("node", "fp", F.xxhash64("way", "bytes").alias("key")), n_bytes, n_bytes - distance, distance, share)


def groups(docs: DataFrame, shingle: int = 3, distance: int = 3, n_words: int = 1, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links, the document itself included."""
    prints = C.written(fingerprints(C.keyed(docs, id_col, text_col), shingle, n_words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    found = P.components(links(nodes.filter("node is not null"), distance, share))
    named = C.written(nodes.join(found, nodes["node"] == found["id"], "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")), "components")
    return C.join_counted(prints, named, ["fp"], prints.count()).select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
