"""Embedding near-dedup by collision-counting projections.

Vectors are projected on `lines` random directions. Two vectors collide on one if their values lie in one another's
query-centred window; a pair that collides on at least `least` is verified by its cosine in double precision. The window is
2.5 standard deviations of the difference that a pair at the threshold shows, and `least` is the largest count that such a
pair reaches with probability 1 - 1e-6: the calibrated recall of the filter, the same at every size.

Each block is sorted by the first projection, and for each run of queries only the stretch of rows that their windows reach is
counted on the other projections. Blocks are labels. A label of more than `rows_per_cell` different vectors is cut into cells of several
coarse projections with random offsets, as many as that label needs, in enough tables that a pair at the threshold shares a cell with
probability 1 - 1e-6 too; a pair is counted in the first table it shares. Larger blocks are dealt into bounded pairs of shares; each
returns counts and spanning links, never all pairs.

Equal vectors of a label are one row before the comparison, whatever their number, and count with it: copies cost nothing.
Vectors that are null, empty, of zero length, or that hold a null or non-finite component link with nothing, as do rows without a
label or id, and vectors of different sizes. Rows that agree in id, label and vector are one vector; rows that share an id share its answer.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C
from folioforge.llm import pairs as P


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, n))


def least_count(lines: int, p: float, miss: float = 1e-6) -> int:
    """The largest count that a binomial of `lines` and p reaches with probability 1 - miss."""
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


def _usable() -> Column:
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter(_usable())


#: Queries and rows that are compared at a time.
TILE, REACH = 256, 2048


def close_pairs(x: np.ndarray, block: np.ndarray, side: np.ndarray, alone: np.ndarray, spots: np.ndarray, window: float, need: int, threshold: float, also: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of one block whose cosine reaches the threshold, among those that collide on `need` projections.

    Rows come sorted by block and first projection; spots: a row of values for each projection.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
    for first, stop in zip(edges, [*edges[1:], len(block)], strict=True):
        for i in range(first, stop, TILE):
            e = min(i + TILE, stop)
            reach = int(np.searchsorted(spots[0, first:stop], spots[0, e - 1] + window, "right")) + first
            for j in range(i, reach, REACH):
                f = min(j + REACH, reach)
                count = np.zeros((e - i, f - j), np.int8)
                for values in spots:
                    count += np.abs(values[i:e, None] - values[None, j:f]) <= window
                p, q = np.nonzero(count >= need)
                p, q = p + i, q + j
                stay = (p < q) & (alone[p] | (side[p] != side[q]))
                p, q = p[stay], q[stay]
                for a in range(0, len(p), 100_000):
                    u, v = p[a : a + 100_000], q[a : a + 100_000]
                    ok = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                    u, v = u[ok], v[ok]
                    ok = also(u, v)
                    out.append((u[ok], v[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])


def tables_for(rows: int, rows_per_cell: int) -> tuple[int, int]:
    """How many projections make a cell, and how many tables, for a label of so many vectors.

    A pair at the threshold shares a cell of width 4 delta in one direction with probability 0.8.
    """
    if rows <= rows_per_cell:
        return 0, 1
    depth = math.ceil(math.log(rows / rows_per_cell) / math.log(1.8))
    return depth, math.ceil(math.log(1e-6) / math.log(1 - 0.8**depth))


def links(vectors: DataFrame, threshold: float, lines: int, rows_per_cell: int, share: int, seed: int) -> DataFrame:
    """vectors (vec_id, label, embedding, m, size, rows), different within a label, m: how many copies, rows: vectors of the label.

    (vec_id, n, root): copies of other vectors linked, and a vector linked to it, per block.
    """
    delta = math.sqrt(2 - 2 * threshold)
    window, need = 2.5 * delta, least_count(lines, math.erf(2.5 / math.sqrt(2)))
    cell = 4.0 * delta

    def project(x: np.ndarray, depth: int, tables: int) -> np.ndarray:
        """Cell numbers of every table."""
        if not depth:
            return np.zeros((len(x), 1), np.int64)
        spot = x @ directions(x.shape[1], tables * depth, seed + 1)
        shift = np.random.Generator(np.random.PCG64(seed + 2)).uniform(0, cell, tables * depth)
        grid = np.floor((spot + shift) / cell).astype(np.int64).reshape(len(x), tables, depth)
        out = np.zeros((len(x), tables), np.uint64)
        for k in range(depth):
            out = C.mix(out * C.MULTIPLIERS[3] + grid[:, :, k].astype(np.uint64))
        return out.view(np.int64)

    def unit(column: pa.Array, size: int) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    names = ["vec_id", "label", "m", "size", "rows", "embedding"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rows = (batch.column(k).to_numpy() for k in (3, 4))
            for size, n in sorted(set(zip(sizes.tolist(), rows.tolist(), strict=True))):
                part = batch.take(pa.array(np.flatnonzero((sizes == size) & (rows == n))))
                cells = project(unit(part.column(5), size), *tables_for(n, rows_per_cell))
                for t in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, t, np.int32)), pa.array(cells[:, t])], [*names, "way", "cell"])

    kinds = dict(vectors.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in names)
    rows = vectors.select(*names).mapInArrow(post, fields + ", way int, cell long")
    rows = rows.withColumn("key", F.xxhash64("label", "size", "way", "cell"))
    dealt = P.blocks(rows, "key", "vec_id", share).select("block", "side", "alone", "way", "vec_id", "m", "size", "rows", F.xxhash64("label").alias("label"), "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in P.whole_blocks(batches, "block", 4096):
            sizes, counts, labels = (whole[c].to_numpy() for c in ("size", "rows", "label"))
            for size, n, label in sorted(set(zip(sizes.tolist(), counts.tolist(), labels.tolist(), strict=True))):
                table = whole.take(pa.array(np.flatnonzero((sizes == size) & (counts == n) & (labels == label)))).combine_chunks()
                x = unit(table["embedding"].combine_chunks(), size)
                spots = (x @ directions(size, lines, seed)).astype(np.float32)
                by = np.lexsort((spots[:, 0], table["block"].to_numpy()))  # each block sorted by the first projection
                x, spots = x[by], np.ascontiguousarray(spots[by].T)
                block, ids, side, alone, way, m = (table[c].to_numpy()[by] for c in ("block", "vec_id", "side", "alone", "way", "m"))
                cells = project(x, *tables_for(n, rows_per_cell))
                first = lambda p, q: (cells[p] == cells[q]).argmax(axis=1) == way[p]  # noqa: B023, E731
                i, j = close_pairs(x, block, side, alone, spots, np.float32(window), need, threshold, first)
                if not len(i):
                    continue
                n_links = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
                root = P.forest(i, j, len(ids))
                at = np.flatnonzero(n_links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(n_links[at].astype(np.int64)), pa.array(ids[root[at]], pa.int64())], ["vec_id", "n", "root"])

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "vec_id long, n long, root long")


def groups(embeddings: DataFrame, threshold: float = 0.93, lines: int = 24, rows_per_cell: int = 32_768, share: int = 8192, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label)."""
    C.small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    same = ["h1", "h2"]  # 128 bits of hash of label and vector
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(7), "label", "embedding")})
    # a class of equal vectors: its least id stands for all
    classes = usable(rows).groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.countDistinct("vec_id").alias("m"), F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    classes = C.written(classes.withColumn("size", F.size("embedding")), "classes")
    per_label = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("rows"))  # a row for each label
    vectors = classes.join(per_label, ["label", "size"])
    found = C.written(links(vectors, threshold, lines, rows_per_cell, share, seed), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    named = P.components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    answers = classes.select("vec_id", "m", "n", *same).join(counts, "vec_id", "left").join(named, F.col("vec_id") == F.col("id"), "left")
    answers = C.written(answers.select(*same, "n", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "answers")
    fine = C.written(usable(rows).select("vec_id", *same), "vectors")
    linked = C.join_counted(fine, answers, same, fine.count()).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: Every pair of a label by its cosine; components by transitive closure.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS MATERIALIZED (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END
), reach AS (
  SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.vec_id WHERE reach.root < p.b
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a
)
SELECT vec_id, coalesce(any_value(n_links), 0) AS n_links, min(root) AS component_id, min(root) = vec_id AS kept FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""
