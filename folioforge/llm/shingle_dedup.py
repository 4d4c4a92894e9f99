"""Near copies by similarity: a byte-position index of SimHash fingerprints finds them, the Jaccard similarity of word shingles decides.

A document is the set of its five-word shingles (all its words where there are fewer). Its fingerprint has two bytes for each of
LISTS posting lists (SMALL_LISTS for sets of up to SMALL shingles): list k holds the positions 2k and 2k + 1 with their bytes. Fingerprints
that share a list, agree in LEAST half bytes of their first KEPT bytes (tally) and differ in DISTANCE bits there at most (Hamming) are linked.
At a similarity of 0.8 a bit differs with a probability of 0.161 at most (0.1875 for 4 of 5 shingles), so a pair shares no list with a
computed probability of 4e-7 and fails the tally or the distance with 4e-8; at 0.1515, the limit for large sets, with 2e-8. The texts of each component
are then compared: a link is a pair whose true similarity reaches the threshold.

So many lists are made only for documents that may have a near copy: of the SKETCH least shingle hashes of a document, SHARED or
more are also among those of another one. A pair at 0.8 shares 26 of 32 on average and fewer than SHARED with probability 2e-7.
A lower threshold than 0.8 needs more lists: `groups` refuses it.

Equal sets are one row before the index. Lists and components are compared in bounded blocks, which give spanning links only, in
two steps: the first FIRST lists alone, a long list or large component in shares that each hold its first row; then whatever
that left in different components meets, in all lists. Rows and links of a group whose members are near its first one grow with its size, not its square.
Texts without words are equal. A null id is given back with component null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C
from folioforge.llm import pairs as P
from folioforge.llm.simhash import compared, fingerprint, shingle_hashes

LISTS, SMALL_LISTS, SMALL = 240, 400, 5
KEPT, LEAST, DISTANCE = 32, 8, 84
SKETCH, SHARED = 32, 0.4
SHARE = 256
FIRST = 16


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (rk, doc_id, body) as (rk, doc_id, fp, low): fp is a 128-bit hash of the shingle set, low its SKETCH least hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in batch.column(2)]
            fp = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            low = pa.array([x[:SKETCH].view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, low], ["rk", "doc_id", "fp", "low"])

    return docs.select("rk", "doc_id", "body").mapInArrow(scan, "rk long, doc_id long, fp binary, low array<long>")


def sieve(nodes: DataFrame) -> DataFrame:
    """(rk) of the nodes (rk, low) that may have a near copy."""
    post = C.written(nodes.select("rk", F.size("low").cast("short").alias("size"), F.explode("low").alias("hash")), "sketches")
    common = C.written(post.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "common")
    most = max(1000, post.count() // C.HOT_KEYS)
    hot, cold = common.filter(F.col("n") > most).select("hash"), common.filter(F.col("n") <= most).select("hash")
    found = post.join(F.broadcast(hot), "hash").unionByName(post.join(F.broadcast(hot), "hash", "left_anti").join(cold, "hash"))
    return found.groupBy("rk", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED * F.col("size")).select("rk")


def wide(hashes: np.ndarray) -> bytes:
    """The fingerprint of a shingle set: two bytes for each of its posting lists."""
    return fingerprint(hashes, (LISTS if len(hashes) > SMALL else SMALL_LISTS) // 4).astype(">u8").tobytes()


def postings(own: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, keys): fp are the first KEPT bytes, keys are the posting lists in order. own (rk, doc_id, body) has packed texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide(np.unique(shingle_hashes(x, shingle))) for x in C.unpacked(batch.column(2))]
            keys = [np.frombuffer(x, ">u2").astype(np.int64) + (np.arange(len(x) // 2) << 16) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[:KEPT] for x in made], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "fp", "keys"])

    return own.select("rk", "doc_id", "body").mapInArrow(scan, "node long, fp binary, keys array<long>")


def candidates(post: DataFrame, share: int) -> DataFrame:
    """(id, component) over the nodes of post (node, fp, keys): links are pairs of a posting list that pass the tally and the distance."""
    early = post.select(F.col("node").alias("label"), "fp", F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    close = C.written(P.components(compared(P.led(early, "key", "label", share), KEPT, LEAST, DISTANCE, halves=True), P.ONE_TASK), "close")
    named = C.written(post.join(close, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("label"), "fp", "keys"), "named")
    late = named.select("node", "label", "fp", F.explode("keys").alias("key"))
    return P.merged(close, P.components(compared(P.apart(late, "key", "node", "label", share), KEPT, LEAST, DISTANCE, halves=True), P.ONE_TASK))


def spanning(sets: list[np.ndarray], threshold: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (earlier, later) that span the components over all pairs of sets of this similarity; sets of one label are linked already."""
    sizes = np.array([len(x) for x in sets])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    inside = np.zeros(int(flat.max()) + 1, np.int64)
    root, known = np.arange(len(sets)), np.zeros(len(sets), bool)
    if labels is not None:
        _, root, n = np.unique(labels, return_inverse=True, return_counts=True)
        known = root == n.argmax()  # all others are compared with these
    out: list[tuple[int, int]] = []
    for k in range(len(sets)):
        if not (root != root[0]).any():
            break
        if known[k]:
            continue
        own = flat[starts[k] : starts[k] + sizes[k]]
        inside[own] = 1
        both = np.add.reduceat(inside[flat], starts)
        inside[own] = 0
        near = both >= threshold * (sizes + sizes[k] - both) - 1e-9
        for j in np.flatnonzero(near & (root != root[k])).tolist():
            if root[j] != root[k]:
                out.append((min(k, j), max(k, j)))
                root[root == root[j]] = root[k]
    return out


def alike(rows: DataFrame, own: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Spanning links (a, b) over the labels of rows (block, node, label) whose texts in own (doc_id, body) have this similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in P.whole_blocks(batches, "block", 500):
            block, label, body = table["block"].to_numpy(), table["label"].to_numpy(), table["body"].combine_chunks()
            begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
            found: list[tuple[int, int]] = []
            for a, b in zip(begin, [*begin[1:], len(block)], strict=True):
                sets = [np.unique(shingle_hashes(x, shingle)) for x in C.unpacked(body.slice(a, b - a))]
                found += [(int(label[a + i]), int(label[a + j])) for i, j in spanning(sets, threshold, label[a:b])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
        C.give_back()

    texts = rows.join(own, F.col("node") == F.col("doc_id")).select("block", "label", "body")
    return texts.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long")


def known(nodes: DataFrame, texts: DataFrame, shingle: int, threshold: float, share: int = SHARE) -> DataFrame:
    """(id, component) over the node ids of nodes (rk, low) that have a near copy; their texts are those of texts (rk, doc_id, body)."""
    some = C.written(sieve(nodes), "sieve")  # a small table is broadcast, so the texts stay where they are
    own = texts.filter("doc_id is not null").join(some, "rk", "left_semi").select("rk", "doc_id", "body")
    own = C.written(C.packed(own).dropDuplicates(["rk"]), "texts")
    post = C.written(postings(own.repartition(C.n_partitions(own.sparkSession)), shingle), "postings")
    close = C.written(candidates(post, 4 * share).select("component", F.col("id").alias("node"), F.col("id").alias("label")), "candidates")
    first = C.written(P.components(alike(P.led(close, "component", "node", share), own, shingle, threshold), P.ONE_TASK), "alike")
    named = close.join(first.select("id", F.col("component").alias("found")), F.col("node") == F.col("id"), "left").select("component", "node", F.coalesce("found", "node").alias("label"))
    named = C.written(named, "labels")
    rest = P.apart(named, "component", "node", "label", share, hot_only=True)
    return P.merged(first, C.written(P.components(alike(rest, own, shingle, threshold), P.ONE_TASK), "rest"))


def groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, component_id): component_id is the least doc_id reachable over links, the document itself included."""
    if threshold < 0.8:
        raise ValueError("the posting lists are made for a similarity of 0.8 or more")
    texts = C.keyed(docs, id_col, text_col)
    found = C.written(prints(texts, shingle), "shingles")
    nodes = found.filter("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "rk", "low")).alias("m")).select("fp", F.col("m.doc_id").alias("node"), "m.rk", "m.low")
    near = known(nodes, texts, shingle, threshold, share)
    named = nodes.select("fp", "node").join(near, F.col("node") == F.col("id"), "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.select("doc_id", "fp").join(named, "fp", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
