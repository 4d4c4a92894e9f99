"""The operational log as tables: history with keyset pages, statistics, upserts, recovery, retention, rate caps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the latency histogram, in milliseconds.
BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000]


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def requests(events: DataFrame) -> DataFrame:
    """events as a request log."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("created_at"), F.col("event_type").alias("operation"), F.concat(F.lit("u"), F.col("user_id")).alias("requester_id"),
        F.col("value").alias("duration_ms"), "props", F.when(failed, "failed").otherwise("completed").alias("execution_status"),
    )


def history(log: DataFrame, since: int | None = None, until: int | None = None, **equal) -> DataFrame:
    """Conjunction of the filters that are given; [since, until)."""
    tests = [F.col(k) == v for k, v in equal.items() if v is not None]
    tests += [F.col("created_at") >= since] if since is not None else []
    tests += [F.col("created_at") < until] if until is not None else []
    return reduce(lambda d, t: d.filter(t), tests, log)


def keyset_page(log: DataFrame, size: int, high: int | None = None, last: int | None = None, key: str = "seq") -> DataFrame:
    """Newest first below `last` and not above `high`; one row more than size tells that there is more."""
    page = log if high is None else log.filter(F.col(key) <= high)
    page = page if last is None else page.filter(F.col(key) < last)
    return page.orderBy(F.desc(key)).limit(size + 1)


def high_water(log: DataFrame, key: str = "seq") -> DataFrame:
    return log.agg(F.coalesce(F.max(key), F.lit(0)).alias("high"))


def counted(log: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column, in one pass over the log."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return log.select(sides.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def top(log: DataFrame, column: str, k: int = 10) -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def rank_value(log: DataFrame, value: str, by: list[str], shares: list[float], slices: int = 1000) -> DataFrame:
    """For each group the value at place min(floor(n * q), n - 1) of its sorted values, exactly, and the largest.

    Values are counted in `slices` equal ranges of each group first; only the ranges that hold a place asked for are ranked,
    so no task sorts a whole group unless its values crowd in one range.
    """
    known = log.filter(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))
    width = F.greatest((F.col("max") - F.col("__lo")) / slices, F.lit(1e-300))
    at = F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(slices)).cast("int").alias("__slice")
    sliced = known.select(*by, value).join(ends.select(*by, "__lo", "max"), by).select(*by, value, at)
    counts = sliced.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__m"))
    upto = counts.withColumn("__upto", F.sum("__m").over(Window.partitionBy(*by).orderBy("__slice"))).join(ends.drop("__lo"), by)  # slices + 1 rows a group at most
    places = F.explode(F.array(*[F.struct(F.lit(f"p{int(q * 100)}").alias("name"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("place")) for q in shares]))
    asked = upto.select(*by, "__slice", "__m", "__upto", places.alias("x")).filter((F.col("x.place") < F.col("__upto")) & (F.col("x.place") >= F.col("__upto") - F.col("__m")))
    asked = asked.select(*by, "__slice", F.col("x.name").alias("__name"), (F.col("x.place") - F.col("__upto") + F.col("__m") + 1).alias("__k"))
    hit = sliced.join(asked.select(*by, "__slice").distinct(), [*by, "__slice"], "left_semi")
    hit = hit.groupBy(*by, "__slice", value).agg(F.count(F.lit(1)).alias("__c")).withColumn("__u", F.sum("__c").over(Window.partitionBy(*by, "__slice").orderBy(value)))
    found = hit.join(asked, [*by, "__slice"]).filter((F.col("__k") <= F.col("__u")) & (F.col("__k") > F.col("__u") - F.col("__c")))
    names = [f"p{int(q * 100)}" for q in shares]
    picks = found.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == p, F.col(value))).alias(p) for p in names])
    return ends.join(picks, by).select(*by, "n", *names, "max")


def histogram(log: DataFrame, value: str, by: list[str], bounds: list[int] = BOUNDS) -> DataFrame:
    return log.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds], F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("long")).alias("total"))


def recent_failures(log: DataFrame, n: int = 10) -> DataFrame:
    return log.filter(F.col("execution_status") == "failed").orderBy(F.desc("seq")).limit(n)


def look_back(log: DataFrame, ms: int, key: str = "created_at") -> DataFrame:
    latest = log.agg(F.max(key).alias("__now"))  # one row
    return log.join(F.broadcast(latest), F.col(key) >= F.col("__now") - ms).drop("__now")


def rate_cap(log: DataFrame, per_second: int = 50, key: str = "created_at", order: str = "seq") -> DataFrame:
    """At most so many rows of each second, the first ones."""
    second = F.floor(F.col(key) / 1000)
    return log.withColumn("second", second).withColumn("__n", F.row_number().over(Window.partitionBy("second").orderBy(key, order))).filter(F.col("__n") <= per_second).drop("__n")


def outcome(request_status: Column, execution_status: Column) -> Column:
    return F.when(request_status.isin("rejected", "cancelled", "interrupted"), request_status).otherwise(F.coalesce(execution_status, request_status, F.lit("unknown")))


def latest_state(changes: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    return changes.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"))


def upsert(changes: DataFrame, key: str, order: list[str], last: list[str], first: list[str] = ()) -> DataFrame:
    """One row per key: columns in `last` from its newest change, those in `first` from its oldest."""
    at = F.struct(*order)
    return changes.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in last], *[F.min_by(c, at).alias(c) for c in first])


def partial_update(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    new = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def recover(log: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    return log.join(jobs.select(key).distinct(), key, "left_semi")


def retention(rows: DataFrame, held: DataFrame, key: str, expired: Column) -> DataFrame:
    """What a deletion of the expired leaves: rows that are not expired, or that something pending holds."""
    gone = rows.filter(expired).join(held.select(key).distinct(), key, "left_anti").select(key)
    return rows.join(gone, key, "left_anti")


def folded(rows: DataFrame, by: str, order: list[str], read: list[str], schema: str, step: Callable[[dict, tuple], tuple | None], last: Callable[[dict], tuple] | None = None) -> DataFrame:
    """A fold over each key's rows in order, for states that no window expresses. Keys stream through, so none is gathered.

    step(state, values of read) may give an output row (without the key); last(state) gives one when a key ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, state, now, begun = [f.split()[0] for f in schema.split(", ")], {}, None, False
        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            out: list[tuple] = []
            for key, *values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or key != now:
                    if begun and last:
                        out.append((now, *last(state)))
                    state, now, begun = {}, key, True
                made = step(state, tuple(values))
                if made is not None:
                    out.append((key, *made))
            if out:
                yield _batch(out, kinds, names)
        if begun and last:
            yield _batch([(now, *last(state))], kinds, names)

    kind = dict(rows.dtypes)[by]
    ready = rows.repartition(by).sortWithinPartitions(by, *order).select(by, *read)
    return ready.mapInArrow(run, f"{by} {kind}, {schema}")


def _batch(rows: list[tuple], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    first, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(first, key), *map(pa.array, rest)], ["key", *names])


def aimd(calls: DataFrame, by: str, order: str, throttled: str, start: int = 8, top_limit: int = 64) -> DataFrame:
    """Limit after each key's calls: halved, rounded down, on a throttled call; one more after every 20 successes since then."""

    def step(state: dict, values: tuple) -> None:
        limit, good = state.get("limit", start), state.get("good", 0)
        if values[0]:
            limit, good = max(limit // 2, 1), 0
        elif (good := good + 1) >= 20:
            limit, good = min(limit + 1, top_limit), 0
        state.update(limit=limit, good=good)

    return folded(calls, by, [order], [throttled], "call_limit long", step, lambda state: (state["limit"],))


def breaker(calls: DataFrame, by: str, order: list[str], at: str, failed: str, threshold: int = 5, cooldown_ms: int = 30_000) -> DataFrame:
    """The breaker's state that each call meets: closed, open (the call fails at once and changes nothing), or half_open after the cooldown.

    Failures in a row up to the threshold open it; any success closes it; a failure while half open opens it again. order ends with a long id.
    """

    def step(state: dict, values: tuple) -> tuple:
        now, bad, ident = values
        until = state.get("until")
        if until is not None and now < until:
            return ident, "open"
        met = "closed" if until is None else "half_open"
        failures = state.get("failures", 0) + 1 if bad else 0
        state.update(failures=failures, until=now + cooldown_ms if failures >= threshold else (until if bad else None))
        return ident, met

    return folded(calls, by, order, [at, failed, order[-1]], f"{order[-1]} long, breaker string", step)


def smoothed_rate(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rate = value while the rate is 0, so at first; then rate / 2 + value / 2, in order. As a sum: each value counts half of the next one."""
    w = Window.partitionBy(by).orderBy(order)
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    live = rows.filter(F.col(value).isNotNull()).withColumn("__back", back)
    seen = F.count_if(F.col(value) != 0).over(w.rowsBetween(Window.unboundedPreceding, 0))
    weight = F.pow(F.lit(0.5), F.col("__back") - F.when((F.col("__seen") == 1) & (F.col(value) != 0), 1).otherwise(0))
    return live.withColumn("__seen", seen).groupBy(by).agg(F.sum(F.col(value) * weight).alias("rate"))


def commit_batches(ops: DataFrame, by: str, order: str, size: int = 500) -> DataFrame:
    """The batch of each operation of a writer: up to size in order."""
    return ops.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def lanes(jobs: DataFrame, by: str, low: Column, order: str) -> DataFrame:
    """The place of each job in its queue: the normal lane before the low one."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(low.cast("int"), order)).cast("long"))


def stage_events(timings: DataFrame, key: str, optional: list[str], always: list[str], failed: Column) -> DataFrame:
    """A row for each stage that ran (optional ones only if they took time), and a last one, done or failed."""
    steps = [F.struct(F.lit(s).alias("stage"), F.lit("completed").alias("event"), F.col(s).alias("ms"), F.lit(n).alias("at")) for n, s in enumerate([*optional[:1], *always, *optional[1:]])]
    kept = F.filter(F.array(*steps), lambda x: (x["ms"] > 0) | x["stage"].isin(*always))
    last = F.struct(F.when(failed, "processing").otherwise("done").alias("stage"), F.when(failed, "failed").otherwise("completed").alias("event"), F.lit(None).cast("long").alias("ms"), F.lit(99).alias("at"))
    return timings.select(key, F.explode(F.concat(kept, F.array(last))).alias("e")).select(key, "e.stage", "e.event", "e.ms")


def delivery(http_status: Column, network_error: Column, attempt: Column, attempts: int = 6, forget: Column | None = None) -> Column:
    """delivered, retry, failed; or sent and failed where nobody waits for an answer."""
    ok = http_status.between(200, 299) & ~network_error
    again = network_error | (http_status == 429) | (http_status >= 500)
    waited = F.when(ok, "delivered").when(again & (attempt < attempts), "retry").otherwise("failed")
    return waited if forget is None else F.when(forget, F.when(network_error, "failed").otherwise("sent")).otherwise(waited)
