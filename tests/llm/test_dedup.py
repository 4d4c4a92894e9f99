import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import common, embedding_neardup, line_dedup, pairs, shingle_dedup, simhash, substring_dedup, suffix_dedup

LAST = common.LAST_ID


def result(df, key="doc_id"):
    return Counter(tuple(r) for r in df.collect())


def brute_words(rows, n):
    first, out = {}, Counter()
    split = [((LAST if i is None else i), i, (t or "").encode().split()) for i, t, *_ in rows]
    for order, _, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, LAST), order)
    for order, i, w in split:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < order:
                gone |= set(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substring_dedup_equals_brute_force(docs, rows, none):
    assert result(substring_dedup.digest(substring_dedup.dedup(docs))) == brute_words(rows, 13)
    assert substring_dedup.dedup(none).count() == 0


def test_small_runs_and_unequal_windows_of_equal_hash(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN", 500)
    monkeypatch.setattr(substring_dedup, "BLOCK", 2000)
    monkeypatch.setattr(substring_dedup, "BITS", 40)
    assert result(substring_dedup.digest(substring_dedup.dedup(docs, buckets=3))) == brute_words(rows, 13)


def test_history_of_a_former_batch(spark, rows):
    old, new = [r for r in rows if r[0] is not None and r[0] < 22], [r for r in rows if r[0] is None or r[0] >= 22]
    frame = lambda part: spark.createDataFrame([r[:2] for r in part], "doc_id long, text string")
    history = substring_dedup.compact(substring_dedup.runs(common.keyed(frame(old)), 13, 4))
    got = result(substring_dedup.digest(substring_dedup.dedup(frame(new), history=history)))
    with pytest.raises(ValueError):
        substring_dedup.dedup(frame(new), history=history, buckets=5)
    for i, n_words, n_removed, _ in got:  # as if both batches had come at once
        assert (i, n_words, n_removed) in {x[:3] for x in brute_words(old + new, 13)}
    assert got <= brute_words(rows, 13) and sum(got.values()) == len(new)
    again = substring_dedup.compact(substring_dedup.runs(common.keyed(frame(new)), 13, 4), history)
    assert again.count() == 4


def brute_bytes(rows, length, keep):
    places, out = {}, Counter()
    order = sorted(range(len(rows)), key=lambda k: LAST if rows[k][0] is None else rows[k][0])
    for k in order:
        b = (rows[k][1] or "").encode()
        for s in range(len(b) - length + 1):
            places.setdefault(xxhash.xxh3_128_digest(b[s : s + length]), []).append((k, s))
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            own = places[xxhash.xxh3_128_digest(b[s : s + length])]
            if len(own) > 1 if keep == "none" else own[0] != (k, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(rows[k][0], len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("largest", [4096, 1])
def test_suffix_dedup_equals_brute_force(docs, rows, none, largest):
    assert result(suffix_dedup.digest(suffix_dedup.dedup(docs, keep="none", largest=largest))) == brute_bytes(rows, 400, "none")
    once = list({(r[0], r[1]): r for r in rows}.values())  # with keep="first" equal rows count once
    got = result(suffix_dedup.digest(suffix_dedup.dedup(docs.dropDuplicates(["doc_id", "text"]), largest=largest)))
    assert got == brute_bytes(once, 400, "first")
    assert suffix_dedup.dedup(none).count() == 0


def test_suffix_order_and_short_lengths(docs, rows):
    data = np.frombuffer(b"bananabananabanana" * 3, np.uint8)
    order, begin = suffix_dedup.suffix_order(data, np.arange(len(data) - 16 + 1), 16)
    text = data.tobytes()
    assert [text[k : k + 16] for k in order] == sorted(text[k : k + 16] for k in range(len(text) - 15))
    assert len(begin) == len({text[k : k + 16] for k in range(len(text) - 15)})
    with pytest.raises(ValueError):
        suffix_dedup.stretches(docs, 40)


def test_longest_previous_factors():
    rng = np.random.default_rng(6)
    for n in (1, 2, 50, 400):
        data = rng.integers(97, 99, n + 7).astype(np.uint8)
        text, position = data.tobytes(), rng.permutation(n)
        order, begin = suffix_dedup.suffix_order(data, np.arange(n), 8)
        got = suffix_dedup.longest_previous_factors(order, begin, position, 8)
        assert got.tolist() == [8 * any(text[j : j + 8] == text[i : i + 8] and position[j] < position[i] for j in range(n)) for i in range(n)]
        before = suffix_dedup.smaller_before(position)
        assert before.tolist() == [max((j for j in range(i) if position[j] < position[i]), default=-1) for i in range(n)]


def brute_prints(rows, shingle):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out.append((i, sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))))
    return out


@pytest.mark.parametrize("share", [1024, 3])
def test_simhash_equals_brute_force(docs, rows, none, share):
    prints = brute_prints(rows, 3)
    nodes = sorted({p for i, p in prints if i is not None})
    label = {p: min(i for i, q in prints if q == p and i is not None) for p in nodes}
    moved = True
    while moved:
        moved = False
        for a in nodes:
            for b in nodes:
                if (a ^ b).bit_count() <= 3 and label[a] > label[b]:
                    label[a], moved = label[b], True
    want = Counter((i, f"{p:016x}", label[p] if i is not None else None) for i, p in prints)
    assert result(simhash.digest(simhash.groups(docs, share=share))) == want
    assert simhash.groups(none).count() == 0


@pytest.mark.parametrize(("n_bytes", "distance"), [(8, 3), (8, 1), (8, 7), (16, 3)])
def test_position_sets_lose_nothing(n_bytes, distance):
    ways = simhash.position_sets(n_bytes, distance)
    for same in combinations(range(n_bytes), n_bytes - distance):
        assert any(set(way) <= set(same) for way in ways)
    assert len(simhash.position_sets(8, 3)) == 8


def brute_lines(rows, bound, unit):
    """Every run of lines that counts and that an earlier place also has, tried one by one."""
    size = (lambda x: len(x) + 1) if unit == "characters" else (lambda x: 1)
    order = sorted({(LAST if r[0] is None else r[0], r[1]): r for r in rows}.items(), key=lambda x: x[0][0])
    seen, done, out = set(), {}, Counter()
    for key, (i, t, *_) in order:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:z])
                if sum(map(size, run)) >= bound:
                    if run in seen:
                        gone |= set(range(a, z))
                    seen.add(run)
        done[key] = (i, len(lines), len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(lines) if k not in gone).encode()).hexdigest())
    for r in rows:
        out[done[LAST if r[0] is None else r[0], r[1]]] += 1
    return out


@pytest.fixture(scope="module")
def lined(rows):
    rng = random.Random(9)
    some = ["", "a", "bb", "a short line", "and another", "a line of forty characters, or about that", "x" * 70, "y" * 61, "", "end"]
    made = [(100 + k, "\n".join(rng.choice(some) for _ in range(rng.randint(1, 24)))) for k in range(60)]
    return [r[:2] for r in rows] + made + [made[5], (700, made[7][1]), (None, made[8][1])]


@pytest.mark.parametrize(("bound", "unit"), [(1, "lines"), (2, "lines"), (3, "lines"), (5, "lines"), (60, "characters"), (25, "characters"), (150, "characters")])
def test_line_dedup_equals_brute_force(spark, lined, none, bound, unit):
    docs = spark.createDataFrame(lined, "doc_id long, text string").withColumn("rk", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(3)
    got = line_dedup.dedup(docs, bound, unit)
    assert got.columns[:2] == ["doc_id", "text"] and {"rk", "pos"} <= set(got.columns)
    assert result(line_dedup.digest(got)) == brute_lines(lined, bound, unit)
    assert line_dedup.dedup(none, bound, unit).count() == 0


def test_very_frequent_lines_take_the_broadcast_branch(spark):
    rows = [(k, "a line that is in every document, and long enough to count\nok\n" + f"own line {k}") for k in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(line_dedup.digest(line_dedup.dedup(docs))) == brute_lines(rows, 60, "characters")


@pytest.mark.parametrize(("cell", "share"), [(400, 16), (10, 1000), (10, 16), (400, 1000)])
def test_embeddings_equal_brute_force(spark, cell, share):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    near = np.repeat(base[:4], 30, axis=0) + rng.normal(size=(120, 64)) * 0.18
    x = np.concatenate([base, near])
    rows = [(k, v.tolist(), int(k % 3 == 0)) for k, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [None] * 64, 1), (903, [float("nan")] * 64, 1), (904, x[0].tolist(), None), (None, x[0].tolist(), 0), (905, [float("inf")] + [1.0] * 63, 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1)]
    rows += [(2000 + k, x[61 + k % 3].tolist(), int((61 + k % 3) % 3 == 0)) for k in range(40)]  # copies
    df = spark.createDataFrame([*rows, rows[70]], "vec_id long, embedding array<float>, label int")
    e = {k: np.array(np.float32(v), float) for k, v, lab in rows if k is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    lab = {r[0]: r[2] for r in rows}
    links = {(a, b) for a in e for b in e if a != b and lab[a] == lab[b] and len(e[a]) == len(e[b]) and e[a] @ e[b] / np.linalg.norm(e[a]) / np.linalg.norm(e[b]) >= 0.93}
    label = {k: k for k, *_ in rows if k is not None}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = min(label[a], label[b])
    got = embedding_neardup.groups(df, rows_per_cell=cell, share=share).collect()
    assert len(got) == len(rows) + 1
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    want = {k: (sum(a == k for a, _ in links), label[k], label[k] == k) for k in label}
    wrong = [k for k in want if want[k] != found[k]]
    assert not wrong
    assert embedding_neardup.groups(df.limit(0)).count() == 0


def test_near_copies_are_those_of_true_similarity(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    docs, want, k = [], {}, 0
    while len(docs) < 1200:  # pairs at 0.8 to 0.85 and at 0.7 to 0.8
        a = words(200)
        b = a.copy()
        for p in rng.choice(200, rng.integers(3, 9), replace=False):
            b[p] = f"v{p}"
        x, y = shingles(a), shingles(b)
        score = len(x & y) / len(x | y)
        if 0.7 <= score <= 0.85:
            docs += [(k, " ".join(a)), (k + 1, " ".join(b))]
            want |= {k: k, k + 1: k if score >= 0.8 else k + 1}
            k += 2
    linked = sum(v != n for n, v in want.items())
    assert 150 < linked < 450
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingle_dedup.groups(frame).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, frame, "").collect()} == {n for n, v in want.items() if v == n}


def test_near_copies_in_shares_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in range(300)]
    docs = [(None, "no id"), (900, ""), (901, None), (902, " "), (903, "one two"), (904, "ONE  two")]
    for k in range(60):
        w = base.copy()
        for p in rng.choice(300, rng.integers(1, 12), replace=False):
            w[p] = f"v{k}"
        docs.append((k, " ".join(w)))
    sets = {k: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in docs if k is not None and k < 900}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    want = Counter(list(root.items()) + [(None, None), (900, 900), (901, 900), (902, 900), (903, 903), (904, 903)])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for share in (8, 256):
        assert result(shingle_dedup.groups(frame, share=share)) == want


def test_near_copies_share_a_posting_list_and_pass_the_tally():
    rng = np.random.default_rng(9)
    for both, one, other in [(4, 0, 1), (8, 1, 1), (12, 1, 2), (80, 0, 20), (80, 10, 10), (400, 30, 70)]:
        for _ in range(60):
            h = rng.integers(0, 1 << 64, both + one + other, np.uint64)
            x, y = (np.frombuffer(shingle_dedup.wide(k), np.uint8) for k in (h[: both + one], np.append(h[:both], h[both + one :])))
            n = min(len(x), len(y)) // 2
            assert (x.reshape(-1, 2)[:n] == y.reshape(-1, 2)[:n]).all(axis=1).any()
            x, y = x[: shingle_dedup.KEPT], y[: shingle_dedup.KEPT]
            assert (x >> 4 == y >> 4).sum() + (x & 15 == y & 15).sum() >= shingle_dedup.LEAST
            assert np.bitwise_count(x ^ y).sum() <= shingle_dedup.DISTANCE


def test_links_of_a_near_copy_group_grow_with_its_size(spark, monkeypatch):
    """Rows of the blocks and links, not their square; 24 of 200 shingles differ at most, so all are near all."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in range(200)]
    many, made = 400, Counter()
    docs = []
    for k in range(many):
        w = base.copy()
        for p in rng.choice(200, 2, replace=False):
            w[p] = f"v{k}"
        docs.append((k, " ".join(w)))
    plain, compared = pairs.components, pairs.whole_blocks
    counter = spark.sparkContext.accumulator(0)

    def components(edges, *options):
        edges = common.written(edges, "test_edges")
        made["links"] += edges.count()
        return plain(edges, *options)

    def whole_blocks(batches, column, rows):
        for table in compared(batches, column, rows):
            if "body" in table.column_names:
                counter.add(table.num_rows)
            yield table

    monkeypatch.setattr(pairs, "components", components)
    monkeypatch.setattr(pairs, "whole_blocks", whole_blocks)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(shingle_dedup.groups(frame, share=8)) == Counter((k, 0) for k in range(many))
    assert made["links"] < 40 * many  # 240 lists
    assert counter.value < 3 * many  # texts compared; each share with each made 50 * many


@pytest.mark.parametrize("labels", [1, 2, 40])
def test_rows_of_different_labels_meet(spark, labels):
    rows = [(k, 7, 1000 + k % 40 % labels if k % 5 == 0 else 1000) for k in range(200)] + [(300, 8, 1), (301, 8, 1), (302, 9, 1), (303, 9, 2)]
    frame = spark.createDataFrame(rows, "id long, key long, label long")
    met = {}
    for r in pairs.apart(frame, "key", "id", "label", 16).collect():
        met.setdefault(r.block, []).append(r)
    assert max((len(x) for x in met.values()), default=0) < 60
    together = {(x.id, y.id) for part in met.values() for x in part for y in part if x.label != y.label}
    assert together == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2]}
    large = pairs.apart(frame, "key", "id", "label", 16, hot_only=True).collect()
    assert {r.key for r in large} == ({7} if labels > 1 else set())
    one = pairs.led(frame, "key", "id", 16).collect()
    assert {r.id for r in one} == {r[0] for r in rows} and len(one) == len(rows) + 12  # 13 shares of key 7


def test_components_in_one_task_equal_those_by_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert result(pairs.components(frame, 1000)) == result(pairs.components(frame)) == result(pairs.components(frame, 10))
    assert pairs.components(frame.limit(0), 1000).count() == 0
