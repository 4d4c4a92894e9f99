import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import decontam, langid, packing, pii, url_filter

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def base(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in hit.split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15


def test_pii_base_spans_and_added_ones(spark):
    texts = ["a@b.c_x@d.e +1 (555) 123-4567 call (555) 123-4567 now 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111", None, "", "é😀 x@y.zz 10.0.0.1 mail bob [at] foo [dot] com tel. 555-123-4567", "1" * 5000 + " " + "a" * 9000 + "@b.c", "000010.0.0.255 4111-1111-1111-1112 +49 30 1234567"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[3])]
    got = pii.digest(pii.spans(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rk string"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        want = [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, t or "") if base(kind, m[0])]
        spans = [tuple(s.split(":")) for s in by[k].spans.split(",") if s]
        assert {(a, str(b), str(c)) for a, b, c in want} <= set(spans)
        assert [by[k][f"n_{kind}"] for kind in PATTERNS] == [sum(x[0] == kind for x in want) for kind in PATTERNS]
        import hashlib

        assert by[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
    assert pii.spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_adds_and_refuses_wider_spans(spark):
    rows = [(k, f"please call (555) 1{k % 90 + 10}-{1000 + k} today, or mail bob{k} [at] foo [dot] com about it") for k in range(2000)]
    rows += [(5000 + k, f"the order no. 555-1{k % 90 + 10}-{1000 + k} is late, met at 1.2.3.4, see file at work.png") for k in range(300)]
    rows += [(9000 + k, f"pay card 4111111111111111 {4000000000000000 + 10 * k} now") for k in range(50)]
    got = {r.doc_id: {(s.kind, rows_of[r.doc_id][s.start : s.end], s.base) for s in r.spans} for rows_of in [dict(rows)] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == {("phone", f"(555) 1{k % 90 + 10}-{1000 + k}", False), ("email", f"bob{k} [at] foo [dot] com", False)} for k in range(2000))
    assert all(got[5000 + k] == {("ip", "1.2.3.4", True)} for k in range(300))
    assert all({("card", "4111111111111111", False)} == {x for x in got[9000 + k] if "4111" in x[1]} for k in range(50))
    assert not any(got[9000 + k] & {("card", str(4000000000000000 + 10 * k), False)} for k in range(50) if not luhn(str(4000000000000000 + 10 * k)))


def test_pii_in_a_very_long_text(spark):
    text = " ".join(f"user{k}@mail.example 10.0.{k % 256}.1" for k in range(8000))
    got = pii.digest(pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (got.n_email, got.n_ip) == (8000, 8000)


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng, counts = random.Random(1), Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda t, f, says=1.0: int(rng.random() < (t if true else f)) if rng.random() < says else -1  # noqa: B023, E731
        counts[("email", vote(0.95, 0.03), vote(0.8, 0.3), vote(0.6, 0.5, 0.5), vote(0.9, 0.2, 0.7), vote(0.5, 0.5), vote(0.5, 0.5, 0.2))] += 1
    _, learned = pii.expectation_maximisation(counts)
    rates = learned["email"]
    assert rates[0][0] > 0.9 and rates[0][1] < 0.15 and abs(rates[2][0] - 0.6) < 0.15 and abs(rates[3][1] - 0.2) < 0.1


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(packing.tokenizer_path())
    tool.encode_special_tokens = True
    got = packing.pack(docs, size=256, block=5000).collect()
    docs_of, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs_of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(tool.encode(t or "", add_special_tokens=False).ids) + 1
    assert want == {i: sum(r.length for r in p) for i, p in docs_of.items()}
    texts = {i: t for i, t, *_ in rows}
    for i, pieces in docs_of.items():
        ids = np.array(tool.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert list(part) == r.ids and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(want.values()) > 0.95 * 256 * (len(sequences) - 3 * 8)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_assignment_fills_sequences_and_balances_cost(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 64, 100, 255, 256, 257, 900, rng.randint(1, 300)]) for _ in range(300)]
    pieces = packing.assign(lengths, 256, 1 / 256)
    assert Counter({d: sum(p[2] for p in pieces if p[0] == d) for d in range(300)}) == Counter(dict(enumerate(lengths)))
    used = Counter()
    for _, _, n, s in pieces:
        used[s] += n
    assert max(used.values()) <= 256 and len(used) == -(-sum(n % 256 for n in lengths) // 256) + sum(n // 256 for n in lengths)


def test_words_are_encoded_as_whole_texts_are():
    encoder = packing.Encoder(open(packing.tokenizer_path(), encoding="utf-8").read())
    texts = ["Don't STOP, 12 Éclairs... naïve. 'tis İstanbul ΣΊΣΥΦΟΣ 中文 a.b. x,\x1cy e\u0301t\u00e9 \u00a0 end.", "<|endoftext|> ,, .", "", "word " * 5 + "z" * 300]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [encoder.tool.encode(t, add_special_tokens=False).ids for t in texts]


SAMPLES = {"en": "the river was under the bridge and that night this house would not sleep with them", "de": "der fluss war unter der brücke und in dieser nacht wollte das haus nicht schlafen", "fr": "la rivière était sous le pont et cette nuit la maison ne voulait pas dormir avec eux"}


def test_language_models(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.sample(t.split(), 9)), lang) for k, (lang, t) in enumerate((x for _ in range(60) for x in SAMPLES.items()))]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 *** !!!", "fr"), (1003, "xq zzkj wqx vvkq xxzj qqkw", None), (None, "the river under the night", "en"), (1004, "THE RIVER " * 5000, "en")]
    df = spark.createDataFrame([*rows, *odd, rows[0]], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, ~langid.held_out()).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, _, lang in out) >= 0.95 * len(out)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (1000, 1001, 1002))
    assert got[1003].rejected and not got[1004].rejected and got[None].lang_pred == "en" and 0 <= got[1003].score <= 1


def test_language_id_without_anything_to_learn_from(spark, none):
    assert langid.identify(none, F.lit(True)).count() == 0
    rows = [(1, "some words", None), (2, None, None), (3, "", None), (4, "%% 12", None), (1, "some words", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted((r.doc_id, r.lang_pred, r.score, r.rejected) for r in got.collect()) == [(1, "und", 0.0, False), (1, "und", 0.0, False), (2, "und", 0.0, True), (3, "und", 0.0, True), (4, "und", 0.0, True)]


def test_every_script_has_letters_of_its_own(spark):
    rng = random.Random(2)
    scripts = {"latin": range(0x61, 0x7B), "greek": range(0x3B1, 0x3CA), "russian": range(0x430, 0x450), "arabic": range(0x627, 0x64B), "han": range(0x4E00, 0x5E00)}
    word = lambda lang: "".join(chr(rng.choice(scripts[lang])) for _ in range(rng.randint(2, 7)))
    rows = [(k, " ".join(word(lang) for _ in range(40)), lang) for k, lang in enumerate(sorted(scripts) * 30)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 100, keep=["doc_id", "lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got if r.doc_id >= 100)


def test_kneser_ney_is_a_distribution():
    order, alphabet = 3, 6
    rng = np.random.default_rng(2)
    grams, n = np.unique(langid.ngrams(rng.choice(5, 3000, p=[0.5, 0.25, 0.15, 0.07, 0.03]).astype(np.uint8), order, alphabet), return_counts=True)
    keep = n > 12
    model = langid.kneser_ney({"a": (grams[keep], n[keep].astype(float)), "b": (grams[~keep], n[~keep].astype(float))}, np.arange(4), alphabet, order)
    for context in range(alphabet**2):
        p = np.exp(model.lookup(context * alphabet + np.arange(alphabet), order - 1)).sum(axis=0)
        assert np.allclose(p, 1.0, atol=1e-4)


def test_decontamination_finds_edited_copies(spark, none):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.sample(words, 30))) for k in range(5)] + [(9, "lonely phrase"), (10, None), (11, "")]
    edited = items[1][1].split()
    edited[4], edited[15] = "other", "words"
    del edited[22]
    filler = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(0, filler()), (1, filler() + " " + items[0][1].upper() + ". " + filler()), (2, filler() + " " + " ".join(edited) + " " + filler()), (3, None), (4, ""), (5, "a lonely phrase here"), (None, items[2][1]), (6, "x " * 20000 + items[3][1]), (1, rows_text := "clean " + filler())]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()}
    assert found == {(1, 0), (2, 1), (5, 9), (None, 2), (6, 3)}
    assert found == {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench, bound=200).collect()}
    kept = decontam.clean(docs, bench)
    assert sorted(kept.columns) == ["doc_id", "score", "text"] and {r.doc_id for r in kept.collect()} == {0, 1, 3, 4} and rows_text in {r.text for r in kept.collect()}
    assert decontam.clean(none, bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("verbatim", [False, True])
def test_decontamination_finds_copies_with_every_fifth_word_replaced(spark, verbatim):
    item = [f"w{k}" for k in range(40)]
    edited = ["other" if k % 5 == 4 else w for k, w in enumerate(item)]
    rows = [(1, " ".join(edited))] + [(2, " ".join(item))] * verbatim
    found = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: r.score for r in found.collect()} == {1: brute_align(edited, item) / 80} | ({2: 1.0} if verbatim else {})


def test_decontamination_finds_copies_after_repeated_words_of_the_item(spark):
    item = [f"w{k}" for k in range(40)]
    edited = ["other" if k % 5 == 4 else w for k, w in enumerate(item)]
    gap = [f"x{k}" for k in range(500)]
    rows = [(1, item[:6] * 50 + gap + item), (2, item[:3] * 50 + gap + edited), (3, item[:6] * 50 + item), (4, item[:6] * 50)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    found = decontam.matches(docs, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: r.score for r in found.collect()} == {1: 1.0, 2: brute_align(edited, item) / 80, 3: 1.0}


def test_windows_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        place, seed = np.sort(rng.integers(0, 200, 30)), rng.integers(0, 8, 30)
        whole = set()
        for p in place.tolist():
            inside = (place >= p) & (place < p + 20)
            if len(set(seed[inside].tolist())) >= 3:
                whole |= set(np.flatnonzero(inside).tolist())
        got = decontam.windows(place, seed, 3, 20)
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
        assert {k for k, p in enumerate(place.tolist()) if any(a <= p <= b for a, b in got)} == whole


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 30))
        assert decontam.align(a, b)[0] == brute_align(a, b)


def test_urls(spark):
    urls = ["https://A.Example.ORG/es/1?x", "http://example.org/en/1", "https://x.com/fr/a#b", "ftp://com/de/", None, "", "no scheme", "https://host", "https://notcom/fr/", "https://a.net/q?x=1&y=2", "http://u@w.example.org:80/en/1", "https://b.example.org/en/2", "x://y://z.org/p"]
    urls += [f"https://s{k}.com/{'fr' if k % 2 else 'de'}/{k}" for k in range(200)]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = [r for r in url_filter.judge(pages).orderBy("page_id").collect()]
    for r, u in zip(got, [*urls, urls[0]], strict=True):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = re.split("[/?#]", rest)[0].lower() if rest is not None else ""
        path = re.split("[?#]", rest[len(host) :])[0] if rest is not None else ""
        fits = sorted((len(h) + len(p), k, h + p) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert (r.host, r.path, r.rule) == (host, path, fits[-1][2] if fits else None), u
        assert r.verdict == fits[-1][1] if fits else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0 and url_filter.judge(pages.filter(F.col("page_id").isin(4, 5))).count() == 2


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = url_filter.boost(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_suffix_shares_do_not_leak_labels():
    rng = random.Random(8)
    hosts = [f"h{k % 900}.s{k % 450}" for k in range(1800)]
    urls = [f"https://{h}/{rng.randint(0, 10**6)}" for h in hosts]
    y = np.array([float(rng.random() < 0.3) for _ in urls])  # no feature tells anything
    trees, suffixes, prior = url_filter.fit(urls, hosts, ["/"] * len(urls), y)
    p = 1 / (1 + np.exp(-trees.margin(url_filter.features(urls, hosts, ["/"] * len(urls), suffixes, prior))))
    assert abs(prior - 0.3) < 0.05 and abs(p.mean() - 0.3) < 0.1


def test_url_model_on_held_out_rows(spark):
    rng = random.Random(3)
    urls = [f"https://a{k}.org/{'en' if k % 2 else 'x'}/{rng.randint(0, 999)}?{'q=1&' * (6 * (k % 2))}" for k in range(3000)]
    rows = spark.createDataFrame([(u, f"a{k}.org", "/", "block" if (k % 2) != (k % 20 == 0) else "allow") for k, u in enumerate(urls)], "url string, host string, path string, verdict string")
    report = url_filter.held_out_report(rows)
    assert report["rows"] > 400 and report["error"] < 0.1
    assert all(abs(p - true) < 0.15 for n, p, true in report["calibration"] if n > 30)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    long = spark.createDataFrame([(1, "https://a.org/" + "x" * 200_000, "clash"), (1, "https://a.org/" + "x" * 200_000, "clash"), (2, None, ""), (3, "no host", "")], "page_id long, url string, rule string")
    assert [(r.page_id, r.verdict, r.host) for r in sorted(url_filter.judge(long).collect(), key=lambda r: r.page_id)] == [(1, "allow", "a.org"), (1, "allow", "a.org"), (2, "allow", ""), (3, "allow", "")]
