"""Pairs within groups, whole but in bounded blocks, and the components that links make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C


def blocks(rows: DataFrame, key: str, ident: str, size: int) -> DataFrame:
    """rows with columns `block`, `alone`, `side`: any two rows of one key meet in some block of about 2 * size rows at most.

    A key of more than size rows is dealt by a hash of ident to c shares; each two shares make a block, of sides 0 and 1,
    and each share one of its own, which is alone: two rows meet once if those of one side are compared only there.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select(key, F.ceil(F.col("n") / size).cast("int").alias("c"))
    dealt = rows.join(hot, key, "left")
    own = F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.col("c"))
    other = F.explode(F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1)))
    dealt = dealt.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    dealt = dealt.withColumn("alone", F.col("own") == F.col("other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    return dealt.withColumn("block", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "c")


def _few(hot: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if it is small, so that the rows joined to it are not shuffled."""
    hot = C.written(hot, "hot")
    return F.broadcast(hot) if hot.count() <= C.HOT_KEYS else hot


def led(rows: DataFrame, key: str, ident: str, size: int) -> DataFrame:
    """rows with a column `block`: a key of more than size rows is dealt to shares, each a block, and its row of least ident comes into all of them.

    Rows grow by 1 / size only. Rows of one key that no block has linked are left to `apart`.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("lead")).filter(F.col("n") > size).select(key, "lead", F.ceil(F.col("n") / size).cast("int").alias("c"))
    own = F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.col("c")).cast("int")
    shares = F.when(F.col("c").isNull(), F.array(F.lit(0))).when(F.col(ident) == F.col("lead"), F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array(own))
    dealt = rows.join(_few(hot), key, "left").withColumn("share", F.explode(shares))
    return dealt.withColumn("block", F.xxhash64(key, "share")).drop("lead", "c", "share")


def apart(rows: DataFrame, key: str, ident: str, label: str, size: int, hot_only: bool = False) -> DataFrame:
    """rows with a column `block`: any two rows of one key whose labels differ meet in a block of about 2 * size rows at most.

    In a key of more than size rows the most frequent label's rows don't meet each other: with r other rows, n rows make about
    2 * n + n * r / size, not n * n / size; of one label they go. With hot_only all smaller keys go.
    """
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high")).filter(F.col("n") > size)
    large = _few(large.select(key, "n", (F.col("low") != F.col("high")).alias("mixed")))
    sizes = rows.join(large.filter("mixed"), key).groupBy(key, label).agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    top = sizes.groupBy(key).agg(F.max(F.struct("m", F.col(label).alias("most"))).alias("top"), F.first("n").alias("n"))
    top = top.select(key, "top.most", F.ceil(F.col("top.m") / size).cast("int").alias("cm"), F.ceil((F.col("n") - F.col("top.m")) / size).cast("int").alias("cr"))
    hot = _few(large.select(key, "mixed").join(top, key, "left"))
    dealt = rows.join(hot, key, "inner" if hot_only else "left").withColumn("rest", F.col(label) != F.col("most"))
    own = F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.when(F.col("rest"), F.col("cr")).otherwise(F.col("cm"))).cast("int")
    dealt = dealt.withColumn("own", F.coalesce(own, F.lit(0)))
    place = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    of_rest = F.concat(F.transform(upto("cr"), lambda j: place(0, F.least("own", j), F.greatest("own", j))), F.transform(upto("cm"), lambda j: place(1, F.col("own"), j)))
    of_most = F.transform(upto("cr"), lambda i: place(1, i, F.col("own")))
    places = F.when(F.col("mixed").isNull(), F.array(place(0, F.lit(0), F.lit(0)))).when(F.col("mixed") & F.col("rest"), of_rest).when(F.col("mixed"), of_most)
    dealt = dealt.withColumn("at", F.explode(places)).withColumn("block", F.xxhash64(key, "at.kind", "at.x", "at.y"))
    return dealt.drop("mixed", "most", "cm", "cr", "rest", "own", "at")


def whole_blocks(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by column, as tables of about that many rows that cut no value of it apart."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, part]) if held is not None else part
        if held.num_rows < rows:
            continue
        keys = held[column].to_numpy()
        differ = np.flatnonzero(keys != keys[-1])
        if len(differ):
            cut = int(differ[-1]) + 1
            yield held.slice(0, cut)
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def linked(keys: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of equal sorted keys for which test(i, j) holds."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    end = np.repeat(np.append(begin[1:], len(keys)), np.diff(np.append(begin, len(keys))))
    at, a, b, d = np.arange(len(keys)), [], [], 1
    while len(at := at[at + d < end[at]]):
        ok = test(at, at + d)
        a.append(at[ok])
        b.append(at[ok] + d)
        d += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For 0 to n - 1, the least index reachable over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


#: Links that one task may have: 16 MB.
ONE_TASK = 1_000_000


def components(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """(id, component): the least id reachable, for every id in edges (a, b); by alternating large and small stars.

    Each round is written, so a lost executor costs one round; rounds grow with the logarithm of the longest path. Up to
    one_task links are one task's work instead.
    """
    edges = C.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if one_task and edges.count() <= one_task:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if parts:
                a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
                names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[forest(at[: len(a)], at[len(a) :], len(names))])], ["id", "component"])

        return edges.repartition(1).mapInArrow(whole, "id long, component long")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = C.written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, component) over both, where second is of links between the components of first, and ids that first doesn't have."""
    over = second.select(F.col("id").alias("component"), F.col("component").alias("over"))
    own = first.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
    return own.unionByName(second.join(first.select("id"), "id", "left_anti"))
