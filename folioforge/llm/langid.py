"""Language identification by interpolated Kneser-Ney character language models.

Training counts the character n-grams of every training document, in the shuffle; lower orders are continuation counts.
A model holds, for each order, one sorted array of n-gram hashes (here: codes in base `alphabet`, free of collisions) and
beside it, for each language, the interpolated log-probability and the log back-off weight. Every letter that the training
texts hold has a code of its own (up to 55,106 at order 4, where codes fill 63 bits; rarer ones share one), so scripts of any
kind are told apart. The model holds the different n-grams of the training texts, which grow far slower than these; it is
collected and broadcast.

A document's cross-entropy is taken per character; the language of the lowest wins. It is rejected where that exceeds
what the winning language's training documents show: the `quantile` of theirs, widened by `slack`.

Null and empty texts and texts without a letter are `und`, score 0, rejected. Texts that no model tells apart get the first
language by name. Languages are compared without prior weights, so a frequent source or language gains nothing; repeated rows
are judged alike, and each teaches. Whole texts are scored, however long. Where no row teaches anything (an empty or unlabelled
table), no language is known: all are `und`, score 0, and only texts without a letter are rejected. An empty table gives an
empty result. Column names that begin with two underscores are ours.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C

#: Codes: 0 for anything that isn't a letter, 1 for letters outside the alphabet, then the alphabet.
OTHER, FIRST = 1, 2


@dataclass
class Model:
    """keys[k]: sorted n-gram codes of order k + 1; logp[k], back[k]: a row for each key, a column for each language. floor: of characters never seen."""

    languages: list[str]
    letters: np.ndarray
    alphabet: int
    order: int
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray

    def table(self) -> np.ndarray:
        return code_table(self.letters)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of all characters after the first order - 1, summed, for each language."""
        grams, counts = np.unique(ngrams(codes, self.order, self.alphabet), return_counts=True)
        return counts @ self.lookup(grams, self.order - 1)

    def lookup(self, grams: np.ndarray, k: int) -> np.ndarray:
        keys = self.keys[k]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = self.logp[k][at].astype(np.float64)
        lost = np.flatnonzero(keys[at] != grams)
        if len(lost):
            own = grams[lost]
            if k == 0:
                out[lost] = self.floor
            else:
                out[lost] = self.lookup(own % self.alphabet**k, k - 1)
                context, up = own // self.alphabet, self.keys[k - 1]
                at = np.minimum(np.searchsorted(up, context), len(up) - 1)
                hit = up[at] == context
                out[lost[hit]] += self.back[k - 1][at[hit]]
        return out


def code_table(letters: np.ndarray) -> np.ndarray:
    """The code of every code point; capitals as their small letters."""
    table = np.zeros(0x110000, np.uint16)
    low = _lower()
    table[low > 0] = OTHER
    place = np.full(0x110000, OTHER, np.uint16)
    place[letters] = np.arange(FIRST, FIRST + len(letters))
    table[low > 0] = place[low[low > 0]]
    return table


def _lower() -> np.ndarray:
    """The small letter of every letter, 0 for other code points."""
    out = np.zeros(0x110000, np.int32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            small = c.lower()
            out[k] = ord(small) if len(small) == 1 else k
    return out


def encode(text: str, table: np.ndarray, order: int) -> np.ndarray:
    """Codes of composed text with runs of non-letters as one, order - 1 of them before and one after."""
    codes = table[np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "replace"), np.uint32)]
    codes = codes[(codes != 0) | np.append(True, codes[:-1] != 0)]
    return np.concatenate([np.zeros(order - 1, np.uint16), codes[int(len(codes) and codes[0] == 0) : len(codes) - int(len(codes) > 1 and codes[-1] == 0)], np.zeros(1, np.uint16)])


def ngrams(codes: np.ndarray, order: int, alphabet: int) -> np.ndarray:
    out = codes[: len(codes) - order + 1].astype(np.int64)
    for k in range(1, order):
        out = out * alphabet + codes[k : len(codes) - order + 1 + k]
    return out


def _tally(docs: DataFrame, count, schema: str) -> DataFrame:
    """(lang, code, n): what count(text) -> codes finds in each text, summed; each batch sends a code once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, []).append(np.unique(count(text.as_py()), return_counts=True))
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x[1] for x in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])
        C.give_back()

    return docs.select("lang", "text").mapInArrow(scan, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], letters: np.ndarray, alphabet: int, order: int) -> Model:
    """counts: for each language the codes of its n-grams of the highest order, sorted, and how often each occurs."""
    languages = sorted(counts)
    per: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
    for lang in languages:
        grams, n = counts[lang]
        tables = [(grams, n)]
        for k in range(order - 1, 0, -1):  # how many different characters stand before each shorter n-gram
            tables.insert(0, np.unique(tables[0][0] % alphabet**k, return_counts=True))
        probs: list = []
        for k, (grams, n) in enumerate(tables):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2.0 * twos) if ones and twos else 0.5
            contexts, at = np.unique(grams // alphabet, return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            weight = discount * kinds / total  # of the shorter context
            if k == 0:
                lower = np.full(len(grams), 1.0 / alphabet)
            else:
                lower = probs[k - 1][1][np.searchsorted(probs[k - 1][0], grams % alphabet**k)]
            probs.append((grams, (n - discount) / total[at] + weight[at] * lower, contexts, np.log(weight)))
        per[lang] = probs
    floor = np.array([np.log(1.0 / alphabet) + per[x][0][3][0] for x in languages])
    model = Model(languages, letters, alphabet, order, [], [], [], floor)
    for k in range(order):
        keys = np.unique(np.concatenate([per[x][k][0] for x in languages]))
        if k + 1 < order:
            keys = np.unique(np.concatenate([keys, *(per[x][k + 1][2] for x in languages)]))
        model.keys.append(keys)
        back = np.zeros((len(keys), len(languages)), np.float32)
        if k + 1 < order:
            for j, lang in enumerate(languages):
                back[np.searchsorted(keys, per[lang][k + 1][2]), j] = per[lang][k + 1][3]
        model.back.append(back)
        logp = np.empty((len(keys), len(languages)), np.float32)
        for j, lang in enumerate(languages):
            own, p = per[lang][k][:2]
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            seen = own[at] == keys
            logp[seen, j] = np.log(p[at[seen]])
            lost = keys[~seen]
            if k == 0:
                logp[~seen, j] = floor[j]
            else:
                up = np.searchsorted(model.keys[k - 1], lost % alphabet**k)
                up = np.minimum(up, len(model.keys[k - 1]) - 1)
                hit = model.keys[k - 1][up] == lost % alphabet**k
                value = np.where(hit, model.logp[k - 1][up, j], floor[j])
                ctx = np.minimum(np.searchsorted(model.keys[k - 1], lost // alphabet), len(model.keys[k - 1]) - 1)
                has = model.keys[k - 1][ctx] == lost // alphabet
                logp[~seen, j] = value + np.where(has, model.back[k - 1][ctx, j], 0.0)
        model.logp.append(logp)
    return model


def most_letters(order: int) -> int:
    """How many letters leave n-gram codes of this order in 63 bits."""
    return int(2 ** (63 / order)) - 2


def train(docs: DataFrame, order: int = 4, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The models of the languages in lang_col of docs; rows with null language or text teach nothing."""
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    low = docs.sparkSession.sparkContext.broadcast(_lower())

    def letters_of(text: str) -> np.ndarray:
        found = low.value[np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "replace"), np.uint32)]
        return found[found > 0]

    schema = "lang string, code long, n long"
    seen = _tally(rows, letters_of, schema).groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(most_letters(order)).collect()  # every letter
    letters = np.array(sorted(r["code"] for r in seen), np.int64)
    alphabet = FIRST + len(letters)
    table = docs.sparkSession.sparkContext.broadcast(code_table(letters))
    found = _tally(rows, lambda text: ngrams(encode(text, table.value, order), order, alphabet), schema).toPandas()
    counts = {}
    for lang, part in found.groupby("lang"):
        by = np.argsort(part["code"].to_numpy())
        counts[lang] = (part["code"].to_numpy()[by], part["n"].to_numpy()[by].astype(np.float64))
    if not counts:
        return Model([], letters, alphabet, order, [], [], [], np.zeros(0))
    return kneser_ney(counts, letters, alphabet, order)


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs with lang_pred, score (0 to 1) and entropy (nats per character of the winner, null without a letter)."""
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vars(model), model.table()))  # the different n-grams of the training texts
    read = keep if text_col in keep else [*keep, text_col]
    at = read.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, table = shared.value
        model = Model(**fields)
        for batch in batches:
            lang, score, entropy = [], [], []
            for x in batch.column(at):
                codes = encode(x.as_py(), table, model.order) if x.is_valid else np.zeros(0, np.uint8)
                if not codes.any():
                    lang.append("und")
                    score.append(0.0)
                    entropy.append(None)
                    continue
                if not model.languages:
                    lang.append("und")
                    score.append(0.0)
                    entropy.append(0.0)
                    continue
                n = len(codes) - model.order + 1
                mean = model.score(codes) / n
                best = int(np.argmax(mean))
                lang.append(model.languages[best])
                score.append(float(1.0 / np.exp(np.minimum((mean - mean[best]) * min(n, 20), 0.0)).sum()))
                entropy.append(float(-mean[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64())], [*keep, "lang_pred", "score", "entropy"])
        C.give_back()

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, entropy double"
    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)


def identify(docs: DataFrame, training: Column, order: int = 4, quantile: float = 0.999, slack: float = 0.5, keep: list[str] | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs' keep columns with lang_pred, score, entropy, rejected. training marks rows to learn from: a boolean column expression over docs.

    A document is rejected if it has no letter, or if its entropy exceeds (1 + slack) times the quantile of the training documents of its language.
    """
    keep = keep or ["doc_id"]
    marked = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumn("__train", F.coalesce(training, F.lit(False)) & F.col(lang_col).isNotNull())
    model = train(marked.filter("__train").select(lang_col, text_col), order, lang_col, text_col)
    result = C.written(scored(marked, model, [*keep, "__train"], text_col), "languages")
    limits = result.filter("__train and entropy is not null").groupBy("lang_pred").agg(F.percentile_approx("entropy", quantile, 10_000).alias("q")).collect()  # a row for each language
    limit = F.coalesce(*[F.when(F.col("lang_pred") == r["lang_pred"], F.lit(r["q"] * (1 + slack))) for r in limits], F.lit(None).cast("double")) if limits else F.lit(None).cast("double")
    return result.withColumn("rejected", F.col("entropy").isNull() | F.coalesce(F.col("entropy") > limit, F.lit(False))).drop("__train")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
