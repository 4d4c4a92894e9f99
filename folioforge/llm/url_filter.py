"""URL filters: rules first, then gradient-boosted trees on lexical features of the URL.

Trees are grown on quantile bins by second-order gains of the logistic loss, from labelled URLs: at most `sample` of them,
the least by hash, so the sample is the same on every run. The driver holds that sample and the trees, nothing else.
A null URL or one without "://" has an empty host and path; the trees judge it by the same features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): the longest rule, host and path together, wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SAMPLE = 20_000


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The winning rule as host and path, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


NAMES = ["length", "host_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "params", "hyphens", "query_length", "upper", "suffix_share", "suffix_count"]


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def suffix_of(host_: str) -> str:
    return ".".join(host_.rsplit(".", 2)[-2:])


def features(urls: list[str | None], hosts: list[str], paths: list[str], suffixes: dict[str, tuple[float, int]], prior: float) -> np.ndarray:
    rows = np.empty((len(urls), len(NAMES)))
    for k, (url, h, p) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        query = url.partition("?")[2]
        share, n = suffixes.get(suffix_of(h), suffixes.get(h.rpartition(".")[2], (prior, 0)))
        digits = sum(c.isdigit() for c in url)
        rows[k] = (len(url), len(h), p.count("/"), h.count("."), digits / max(1, len(url)), _entropy(url), _entropy(h), query.count("=") + query.count("&"), url.count("-"), len(query), sum(c.isupper() for c in url), share, n)
    return rows


@dataclass
class Trees:
    """Boosted trees: each a list of nodes (feature, threshold, left, right, value); feature -1 marks a leaf."""

    base: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            f, t, left, right, value = (np.array(v) for v in zip(*nodes, strict=True))
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                go = np.flatnonzero(inner)
                own = at[go]
                at[go] = np.where(x[go, f[own]] <= t[own], left[own], right[own])
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 20) -> Trees:
    """Trees for labels y (0 or 1)."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))))
    if len(y) < 2 * least or share in (1e-3, 1 - 1e-3):
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        nodes: list = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes.append((-1, 0.0, 0, 0, float(-rate * g / (h + l2))))
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                for k, e in enumerate(edges):
                    own = binned[rows, k]
                    gs, hs, ns = (np.cumsum(np.bincount(own, w, len(e) + 1))[:-1] for w in (grad[rows], hess[rows], None))
                    if not len(gs):
                        continue
                    gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
                    gain[(ns < least) | (len(rows) - ns < least)] = 0
                    j = int(np.argmax(gain))
                    best = max(best, (float(gain[j]), k, j))
            if best[1] >= 0:
                low = binned[rows, best[1]] <= best[2]
                left, right = grow(rows[low], level + 1), grow(rows[~low], level + 1)
                nodes[at] = (best[1], float(edges[best[1]][best[2]]), left, right, 0.0)
            return at

        grow(np.arange(len(y)), 0)
        model.trees.append(nodes)
        margin += Trees(0.0, [nodes]).margin(x)
    return model


FOLDS = 5


def _fold(urls: list[str]) -> np.ndarray:
    return np.array([zlib.crc32((u or "").encode()) % FOLDS for u in urls], np.int64)


def _suffixes(hosts: list[str], y: np.ndarray) -> tuple[dict[str, tuple[float, int]], float]:
    """For each suffix its smoothed share of blocked rows and their number; and the share of all."""
    prior = float(y.mean()) if len(y) else 0.5
    sums: dict[str, list[float]] = {}
    for h, v in zip(hosts, y.tolist(), strict=True):
        for s in {suffix_of(h), h.rpartition(".")[2]}:
            sums.setdefault(s, []).append(v)
    return {s: ((sum(v) + 5 * prior) / (len(v) + 5), len(v)) for s, v in sums.items()}, prior


def fit(urls: list[str], hosts: list[str], paths: list[str], y: np.ndarray) -> tuple[Trees, dict[str, tuple[float, int]], float]:
    """Trees, suffix statistics and prior. The trees see suffix statistics of the other folds only, so no row's own label is among its features."""
    fold = _fold(urls)
    x = np.zeros((len(urls), len(NAMES)))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        of = lambda values, at: [values[j] for j in at.tolist()]
        x[own] = features(of(urls, own), of(hosts, own), of(paths, own), *_suffixes(of(hosts, rest), y[rest]))
    return boost(x, y), *_suffixes(hosts, y)


def _labelled(labelled: DataFrame, sample: int) -> tuple[list[str], list[str], list[str], np.ndarray]:
    rows = labelled.orderBy(F.xxhash64("url"), "url").limit(sample).collect()
    return *([r[c] for r in rows] for c in ("url", "host", "path")), np.array([float(r["verdict"] == "block") for r in rows])


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Trees, dict[str, tuple[float, int]], float]:
    """The model of labelled (url, host, path, verdict), of which at most sample rows are used."""
    return fit(*_labelled(labelled, sample))


def held_out_report(labelled: DataFrame, sample: int = SAMPLE, bins: int = 5) -> dict:
    """Error and calibration on the labelled rows of one fold, of a model of the others: rows, error, share blocked, and
    for each range of predicted probability the rows, their mean prediction and their share blocked."""
    urls, hosts, paths, y = _labelled(labelled, sample)
    test = _fold(urls) == 0
    of = lambda values, at: [v for v, t in zip(values, at, strict=True) if t]
    trees, suffixes, prior = fit(of(urls, ~test), of(hosts, ~test), of(paths, ~test), y[~test])
    p = 1 / (1 + np.exp(-trees.margin(features(of(urls, test), of(hosts, test), of(paths, test), suffixes, prior))))
    true, at = y[test], np.minimum((p * bins).astype(int), bins - 1)
    mean = lambda v: float(v.mean()) if len(v) else None
    return {"rows": len(true), "error": mean((p >= 0.5) != true), "blocked": mean(true), "calibration": [(int((at == k).sum()), mean(p[at == k]), mean(true[at == k])) for k in range(bins)]}


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability. The verdict is the rule's where one fits, else that of the trees.

    Null urls and urls without :// have empty host and path, no rule, and the trees' verdict; very long ones are judged whole.
    Repeated rows get equal verdicts, and each may be in the sample; of two rules that fit, the longest decides, and two of one
    length can't fit one url. Without labelled rows, or with one kind only, all get its verdict (allow at an even share). An
    empty table gives an empty result. Only the id and url columns are read, so no other column can clash.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("verdict", verdict)
    trees, suffixes, prior = train(rows.filter("verdict is not null"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, hosts, paths = (batch.column(k).to_pylist() for k in (1, 2, 3))
            p = 1 / (1 + np.exp(-trees.margin(features(urls, hosts, paths, suffixes, prior))))
            own = [v or ("block" if q >= 0.5 else "allow") for v, q in zip(batch.column(5).to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:5], pa.array(own, pa.string()), pa.array(p)], ["page_id", "host", "path", "rule", "verdict", "block_probability"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, block_probability double")
