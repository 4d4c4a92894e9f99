"""Line dedup by a suffix array over line ids, in DataFrame functions only.

Lines between line feeds get ids; lines that occur once can't be part of a repeated run and leave at once. A run of lines
counts if it holds at least `bound` characters, its line feeds included (or, by `unit`, at least `bound` lines): a long line
is a run of its own, a short one needs neighbours. The shortest runs that count, from each line on and up to each line, are
the windows; a run that counts and that an earlier place also has is the union of its windows, and each of them is a later
copy too, so the windows decide which lines go.

Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: suffixes that agree so far share a rank, and those
whose rank is theirs alone leave, as do documents all of whose windows are decided. A rank is named by the earliest place that bears
it, so ranks need no global sort, only an aggregation, and the suffixes of one rank are one interval of the suffix array with
that longest common prefix. A window of 2^k to 2^(k+1) - 1 lines is the interval of the two ranks that cover it; all its
members but the earliest are later copies. Overlapping and touching later copies are one maximal run; its lines go.
Doubling ends when no window is open, at most log2(bound) rounds on.

Runs don't cross documents. Blank lines count. Earlier means a smaller (doc_id, line); null ids come last. Rows equal in id
and text are one document to this operator, and get equal results. A null text stays null and has no lines, an empty one has
one empty line; an empty table gives an empty result. Other columns pass; names that begin with two underscores are ours.
Of a very long text only its repeated lines reach a window function, in the one task that has the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import common as C

#: Characters of the shortest run that counts.
BOUND = 60


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    ident = F.col(id_col).cast("long")
    return F.xxhash64(ident, F.col(text_col)), F.coalesce(ident, F.lit(C.LAST_ID))


#: Rows that a single window function may hold together.
TOGETHER = 500_000


def _named(rows: DataFrame, parts: list[str], most: int | None = None) -> DataFrame:
    """rows (rk, ord, pos, ...) whose parts occur more than once, with `rank`: the earliest place with the same parts.

    most: how many rows there can be, where that is known. Up to TOGETHER of them are ranked by one window function; of more,
    the groups are aggregated before the join, which keeps very frequent parts out of any single task.
    """
    place = F.struct("ord", "pos", "rk")
    if most is not None and most <= TOGETHER:
        same = Window.partitionBy(*parts)
        return rows.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("rank", F.min(place).over(same)).filter("n > 1").drop("n")
    rows = C.written(rows, "suffixes")
    ranks = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rank")).filter("n > 1")
    return C.join_counted(rows, ranks, parts, rows.count()).drop("n")


def _late() -> Column:
    return (F.col("rank.ord") != F.col("ord")) | (F.col("rank.pos") != F.col("pos")) | (F.col("rank.rk") != F.col("rk"))


def windows(lines: DataFrame, bound: int) -> DataFrame:
    """The shortest runs that count, (rk, ord, pos, len), among the repeated lines (rk, ord, pos, w) of each document, but for single lines.

    Each line asks for the first line at which the run from it on counts, and for the last from which the run up to it does:
    the nearest mark in a sort by offset. Runs with a line in between that isn't repeated are none.
    """
    here = Window.partitionBy("rk").orderBy("pos")
    c = lines.withColumn("stop", F.sum("w").over(here)).withColumn("i", F.row_number().over(here))
    place = F.struct("pos", "i")
    row = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
    start = F.col("stop") - F.col("w")
    marks = F.array(row(0, F.col("stop")), row(2, start))
    asked = F.when(F.col("w") < bound, F.array(row(1, start + bound), row(3, F.col("stop") - bound))).otherwise(F.array().cast("array<struct<kind:int,at:bigint>>"))
    both = c.select("rk", "ord", place.alias("own"), F.explode(F.concat(marks, asked)).alias("x")).select("rk", "ord", "own", "x.*")
    near = lambda kind, order: F.last(F.when(F.col("kind") == kind, F.col("own")), ignorenulls=True).over(Window.partitionBy("rk").orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("a", near(2, F.asc("at"))).withColumn("z", near(0, F.desc("at"))).filter("kind = 1 or kind = 3")
    found = found.select("rk", "ord", F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("a")).alias("a"), F.when(F.col("kind") == 1, F.col("z")).otherwise(F.col("own")).alias("z"))
    whole = F.col("a").isNotNull() & F.col("z").isNotNull() & (F.col("z.pos") - F.col("a.pos") == F.col("z.i") - F.col("a.i"))
    return found.filter(whole).select("rk", "ord", F.col("a.pos").alias("pos"), (F.col("z.pos") - F.col("a.pos") + 1).alias("len")).distinct()


def later_windows(lines: DataFrame, bound: int) -> DataFrame:
    """(rk, pos, len): windows of lines (rk, ord, pos, w, a, b) that an earlier place also has."""
    rank = C.written(_named(lines, ["a", "b"]).select("rk", "ord", "pos", "w", "rank"), "ranks")
    late = rank.filter((F.col("w") >= bound) & _late()).select("rk", "pos", F.lit(1).alias("len"))
    wide = C.written(windows(rank, bound), "windows")
    n_wide, most = wide.agg(F.count(F.lit(1)), F.coalesce(F.max("len"), F.lit(0))).first()
    rank, size = rank.select("rk", "ord", "pos", "rank"), 1
    while 2 * size <= most:
        open_ = wide.filter(F.col("len") >= 2 * size).select("rk").distinct()
        ahead = rank.select("rk", (F.col("pos") - size).alias("pos"), F.col("rank").alias("second"))
        next_ = rank.join(open_, "rk", "left_semi").select("rk", "ord", "pos", F.col("rank").alias("first")).join(ahead, ["rk", "pos"])
        rank = C.written(_named(next_, ["first", "second"], rank.count()).select("rk", "ord", "pos", "rank"), "ranks")
        size *= 2
        now = wide.filter(F.col("len").between(size, 2 * size - 1)).join(rank.select("rk", "pos", F.col("rank").alias("first")), ["rk", "pos"])
        second = rank.select("rk", F.col("pos").alias("at"), F.col("rank").alias("second"))
        both = now.withColumn("at", F.col("pos") + F.col("len") - size).join(second, ["rk", "at"])
        late = late.unionByName(_named(both.select("rk", "ord", "pos", "len", "first", "second"), ["len", "first", "second"], n_wide).filter(_late()).select("rk", "pos", "len"))
    return late


def later_copies(docs: DataFrame, bound: int = BOUND, unit: str = "characters", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rk, lo, hi): the maximal runs of lines to remove, from line lo to line hi."""
    if unit not in ("characters", "lines"):
        raise ValueError("unit is 'characters' or 'lines'")
    rk, order = _keyed(docs, id_col, text_col)
    size = lambda x: F.length(x) + 1 if unit == "characters" else F.lit(1)
    ids = F.transform(F.split(text_col, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), size(x).cast("long").alias("w")))
    lines = docs.filter(F.col(text_col).isNotNull()).select(rk.alias("rk"), order.alias("ord"), F.posexplode(ids).alias("pos", "line"))
    late = later_windows(lines.select("rk", "ord", "pos", "line.*").dropDuplicates(["rk", "pos"]), bound)
    by = Window.partitionBy("rk").orderBy("pos")
    before = F.max(F.col("pos") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = late.withColumn("new", (F.col("pos") > F.coalesce(before, F.lit(-1))).cast("int"))
    return cut.withColumn("run", F.sum("new").over(by)).groupBy("rk", "run").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("len") - 1).alias("hi")).drop("run")


def dedup(docs: DataFrame, bound: int = BOUND, unit: str = "characters", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with text_col cleaned, and __lines, __removed (longs; 0 for null texts)."""
    rk, _ = _keyed(docs, id_col, text_col)
    runs = later_copies(docs, bound, unit, id_col, text_col)
    gap = F.col("lo") - F.coalesce(F.lag("hi").over(Window.partitionBy("rk").orderBy("lo")) + 1, F.lit(0))
    size = F.col("hi") - F.col("lo") + 1
    # a mark for each line up to the last that goes
    piece = F.concat(F.repeat(F.lit("0"), gap), F.repeat(F.lit("1"), size))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda x: x["piece"]), "").cast("binary")
    gone = runs.withColumn("piece", piece).groupBy(F.col("rk").alias("__rk")).agg(F.sum(size).alias("__removed"), marks.alias("__marks"))
    lines = F.split(text_col, "\n", -1)
    both = docs.withColumn("__rk", rk).join(gone, "__rk", "left")
    kept = F.filter(lines, lambda x, i: F.substr(F.col("__marks"), i + 1, F.lit(1)) != F.lit("1").cast("binary"))
    text = F.when(F.col("__marks").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    out = both.withColumn("__lines", F.coalesce(n, F.lit(0)).cast("long")).withColumn("__removed", F.coalesce("__removed", F.lit(0)).cast("long"))
    return out.withColumn(text_col, text).drop("__rk", "__marks")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Each line of a run of `bound` characters that an earlier place also has: runs by their shortest windows, whole texts compared.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT doc_id, pos, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS stop, length(line) + 1 AS w FROM l
), r AS (
  SELECT p.doc_id, p.pos AS a, min(e.pos) AS z FROM c p JOIN c e ON e.doc_id = p.doc_id AND e.pos >= p.pos AND e.stop >= p.stop - p.w + {BOUND} GROUP BY 1, 2
  UNION SELECT e.doc_id, max(p.pos), e.pos FROM c e JOIN c p ON e.doc_id = p.doc_id AND p.pos <= e.pos AND p.stop - p.w <= e.stop - {BOUND} GROUP BY 1, 3
), t AS (
  SELECT r.doc_id, a, z, string_agg(line, chr(10) ORDER BY pos) AS body FROM r JOIN l ON l.doc_id = r.doc_id AND pos BETWEEN a AND z GROUP BY 1, 2, 3
), f AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) > 1 AS late FROM t
), g AS (
  SELECT l.doc_id, l.pos, any_value(line) AS line, coalesce(bool_or(late), false) AS gone FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND late AND l.pos BETWEEN a AND z GROUP BY 1, 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
