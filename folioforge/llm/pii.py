"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of four base patterns (e-mail, IP address, card, phone) and of wider ones: spelt-out and defanged
addresses, cards with dots, national phone numbers. Labelers vote for a candidate, against it, or abstain: the base rule (on
base patterns only), a gazetteer of domain endings, calling codes, card prefixes and private networks (against: endings of
file names, the numbers of reserved networks), a form test (checksum, octets, digit groups), cue words before the span (against:
words of versions, orders, books, laws), its borders, and the digits around it. Expectation-maximisation over the counts of vote patterns (2 * 3^6
a kind at most, whatever the input) estimates each labeler's reliability where it votes, and each pattern's
posterior; with these posteriors a naive Bayes span classifier is trained on features that labelers don't see alone. Wider
candidates that it accepts, and that the labelers' posterior doesn't refuse, are added; base spans always stay.

Positions are code points, end exclusive. Null text is empty, and empty texts have no spans; an empty table gives an empty
result. Rows equal in id and text get equal results, a null id stays null. Very long texts are matched whole, in linear time.
An added span that overlaps a base span, or an added one of a kind listed before or of the same kind that begins earlier, is dropped. Only the id
and text columns are read, so no other column can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import common as C

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, with possessive loops and run borders that change no match but keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns: spelt-out and defanged addresses, cards in groups of four and those that a base match runs together, national numbers.
_AT = r"(?:\x20?[\[({](?:at|AT|@)[\])}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({](?:dot|DOT|\.)[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
WIDER = {
    "email+": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*?{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])",
    "ip+": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[({](?:\.|dot)[\])}]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card+": r"(?<![0-9.])(?:[0-9]{4}(?:[._/][0-9]{4}){3}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{13,19})(?![0-9])",
    "phone+": r"(?<![0-9A-Za-z+.()-])(?:(?:\([0-9]{2,5}\)[\x20.-]?|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,2}|\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4})(?![0-9A-Za-z])",
}
PATTERNS = BASE | WIDER
#: Characters without which a pattern can't match; wider ones that have no such mark are tried on every text.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
#: Cue words before a span, for and against it.
CUES = {"email": r"(?i)(mail|contact|write|address|reach|send|ask)", "ip": r"(?i)(\bip|host|server|addr|login|from|ping|client)", "card": r"(?i)(card|visa|master|amex|pay|account|credit|debit)", "phone": r"(?i)(tel|phone|call|fax|mobile|cell|ring|contact|dial|number)"}
AGAINST = {"email": r"(?i)(look|meet|met|arrived?|stay|seen|stood|sat)\W*$", "ip": r"(?i)(version|release|section|chapter|v\.?)\W*$", "card": r"(?i)(serial|isbn|order|invoice|tracking|part|part no\.?)\W*$", "phone": r"(?i)(isbn|issn|order|invoice|version|section|serial|tracking|score|part|paragraph)(\W*(no|number|nr)\b)?\W*$"}
#: Endings and prefixes known for a kind, and those that speak against it.
KNOWN = {
    "email": r"(?i)(\.|dot[\])}\x20]\x20?)(com|org|net|edu|gov|mil|int|info|biz|io|dev|app|me|tv|cc|us|ca|mx|br|ar|cl|uk|ie|de|at|ch|nl|be|lu|fr|es|pt|it|gr|pl|cz|sk|hu|ro|bg|se|no|dk|fi|is|ru|ua|tr|il|in|cn|jp|kr|tw|hk|sg|au|nz|za|eu|example|test)$",
    "ip": r"^(10|127|172|192|[1-9][0-9]{0,2})[^0-9]",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(\+(1|7|20|2[0-9]{2}|3[0-469]|3[0-9]{2}|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(0?[1-9]|0[1-9]|[2-9][0-9]{2}[^0-9])",
}
UNKNOWN = {"email": r"(?i)\.(png|jpe?g|gif|svg|js|css|html?|pdf|zip|exe|txt|md|py)$", "ip": r"^0+[^0-9]", "card": r"^0", "phone": r"^(000|111|1[0-9]{2}[^0-9])"}
VOTES = ["rule", "known", "form", "cue", "border", "sparse"]
#: Chances of a vote for true and for false spans that estimation starts from, and what they weigh against all candidates of a kind.
START, WEIGHT = [(0.95, 0.05), (0.99, 0.5), (0.98, 0.4), (0.99, 0.1), (0.9, 0.4), (0.9, 0.5)], 0.25
FEATURES = ["length", "left", "right", "digits", "cue_known"]


def _choose(kind: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = back.substr(k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_rule(kind: Column, hit: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """All matches in docs (rk, text): rk, pattern, hit, start, end, before, after, base."""
    hits = F.array(*[F.struct(F.lit(k).alias("pattern"), F.when(F.contains(F.col("text"), F.lit(NEEDS.get(k, ""))), F.regexp_extract_all("text", F.lit(p), 0)).otherwise(F.array().cast("array<string>")).alias("hits")) for k, p in PATTERNS.items()])
    found = docs.select("rk", "text", F.explode(F.filter(hits, lambda x: F.size(x["hits"]) > 0)).alias("x")).select("rk", "text", "x.*")
    parts = F.split("text", _choose(F.col("pattern"), PATTERNS), -1)
    sides = F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(40)).alias("tail"), F.left(p, F.lit(12)).alias("head")))
    found = found.select("rk", "pattern", "hits", sides.alias("sides")).dropDuplicates(["rk", "pattern"])
    rows = found.select("rk", "pattern", F.posexplode(F.zip_with("hits", F.slice("sides", 1, F.size("hits")), lambda h, s: F.struct(h.alias("hit"), s["n"].alias("gap"), s["tail"].alias("before")))).alias("at", "m"), "sides")
    rows = rows.select("rk", "pattern", "at", "m.*", F.get("sides", F.col("at") + 1).getField("head").alias("after"))
    end = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("rk", "pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    return rows.withColumn("base", base_rule(F.col("pattern"), F.col("hit"))).withColumn("kind", F.regexp_replace("pattern", r"\+", ""))


def labelled(rows: DataFrame) -> DataFrame:
    """rows with the labelers' votes (1 for, 0 against, -1 abstains) and the features of the classifier."""
    kind, hit, before = F.col("kind"), F.col("hit"), F.col("before")
    wider = F.endswith("pattern", F.lit("+"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    vote = lambda yes, no: F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), 0).otherwise(-1)

    def matched(what: dict[str, Column], table: dict[str, str]) -> Column:
        out = F.lit(False)
        for k in KINDS:
            out = F.when(kind == k, what[k].rlike(table[k])).otherwise(out)
        return out

    heads = {k: digits if k == "card" else hit for k in KINDS}
    octets = F.forall(F.split(F.trim(F.regexp_replace(hit, "[^0-9]+", " ")), " "), lambda p: p.try_cast("int") <= 255)
    form = F.when(kind == "card", F.length(digits).between(13, 19) & _luhn(digits)).when(kind == "ip", octets).when(kind == "phone", F.length(digits).between(7, 15)).otherwise(F.lit(None))
    left = before.rlike(r"[\p{L}\p{N}_.-]$")
    right = F.coalesce(F.col("after"), F.lit("")).rlike(r"^[\p{L}\p{N}_-]")
    around = F.length(F.regexp_replace(F.concat(before, F.coalesce("after", F.lit(""))), "[^0-9]", ""))
    against = matched({k: before for k in KINDS}, AGAINST)
    out = rows.withColumns({
        "rule": F.when(wider, -1).otherwise(F.col("base").cast("int")),
        "known": vote(matched(heads, KNOWN) & ~matched({k: hit for k in KINDS}, UNKNOWN), matched({k: hit for k in KINDS}, UNKNOWN)),
        "form": vote(form, ~form),
        "cue": vote(matched({k: before for k in KINDS}, CUES) & ~against, against),
        "border": vote(~left & ~right, left | right),
        "sparse": vote(around <= 4, around > 12),
    })
    shape = lambda c: F.when(c.rlike(r"\p{L}$"), "letter").when(c.rlike(r"\p{N}$"), "digit").when(c.rlike(r"\s$"), "space").when(F.length(c) == 0, "edge").otherwise("mark")
    return out.withColumns({
        "length": F.concat_ws(":", "pattern", F.least(F.length("hit") / 4, F.lit(10)).cast("int")),
        "left": F.concat_ws(":", "kind", shape(F.col("before"))),
        "right": F.concat_ws(":", "kind", shape(F.coalesce(F.left("after", F.lit(1)), F.lit("")))),
        "digits": F.concat_ws(":", "pattern", F.least(F.length(digits), F.lit(20))),
        "cue_known": F.concat_ws(":", "pattern", "cue", "known", "form", "border", "sparse"),
    })


def expectation_maximisation(patterns: dict[tuple, float], rounds: int = 20, balance: float = 0.5) -> tuple[dict[tuple, float], dict[str, list[tuple[float, float]]]]:
    """patterns: (kind, votes) -> count. Returns the posterior of each, and for each kind and labeler the chance of a vote
    for true and for false spans, among the spans it votes on. START is the mean of a Beta prior, which names the classes and
    keeps the more frequent one from taking both over; balance, the share of true spans, is given for the same reason."""
    posterior, learned = {}, {}
    for kind in sorted({k for k, *_ in patterns}):
        own = {v: n for (k, *v_), n in patterns.items() if k == kind for v in [tuple(v_)]}
        rates, post, weight = list(START), {}, max(4.0, WEIGHT * sum(own.values()))
        for _ in range(rounds):
            for v in own:
                odds = math.log(balance / (1 - balance)) + sum(math.log(t / f) if x else math.log((1 - t) / (1 - f)) for x, (t, f) in zip(v, rates, strict=True) if x >= 0)
                post[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            rates = []
            for j, (t0, f0) in enumerate(START):
                t = sum(post[v] * n for v, n in own.items() if v[j] == 1), sum(post[v] * n for v, n in own.items() if v[j] >= 0)
                f = sum((1 - post[v]) * n for v, n in own.items() if v[j] == 1), sum((1 - post[v]) * n for v, n in own.items() if v[j] >= 0)
                rates.append(((t[0] + t0 * weight) / (t[1] + weight), (f[0] + f0 * weight) / (f[1] + weight)))
        posterior |= {(kind, *v): p for v, p in post.items()}
        learned[kind] = rates
    return posterior, learned


def _lookup(key: Column, table: dict[str, float]) -> Column:
    if not table:
        return F.lit(0.0)
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), key), F.lit(0.0))


def spans(docs: DataFrame, accept: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, spans (array of kind, start, end, base, by kind as listed and start)."""
    ident = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(ident, text).alias("rk"), ident.alias("doc_id"), text.alias("text"))
    found = C.written(labelled(candidates(rows.select("rk", "text"))), "candidates")
    counts = {(r["kind"], *(r[v] for v in VOTES)): float(r["n"]) for r in found.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()}  # 4 * 2 * 3 ** 6 rows at most
    posterior, _ = expectation_maximisation(counts)
    post = _lookup(F.concat_ws(":", "kind", *VOTES), {":".join(map(str, k)): p for k, p in posterior.items()})
    each = found.select("kind", post.alias("p"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x"))
    sums = each.groupBy("kind", "x.f", "x.v").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # features have a few hundred values each, whatever the input
    score = F.lit(0.0)
    for kind in KINDS:  # a classifier for each kind
        parts = []
        for f in FEATURES:
            own = [r for r in sums if r["kind"] == kind and r["f"] == f]
            yes, no = sum(r["yes"] for r in own), sum(r["no"] for r in own)
            parts.append(_lookup(F.col(f), {r["v"]: math.log((r["yes"] + 1) / (yes + len(own))) - math.log((r["no"] + 1) / (no + len(own))) for r in own}))
            prior = math.log((yes + 1) / (no + 1))
        score = F.when(F.col("kind") == kind, sum(parts, F.lit(prior))).otherwise(score)
    added = ~F.col("base") & F.endswith("pattern", F.lit("+")) & (1 / (1 + F.exp(-score)) >= accept) & (post >= 0.5)
    chosen = found.filter(F.col("base") | added).groupBy("rk").agg(F.array_sort(F.collect_list(F.struct(_choose(F.col("kind"), {k: str(n) for n, k in enumerate(KINDS)}).alias("no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "base"))).alias("all"))
    before = lambda x, y: (y["no"] < x["no"]) | ((y["no"] == x["no"]) & (y["start"] < x["start"]))
    apart = F.filter("all", lambda x: x["base"] | ~F.exists("all", lambda y: (y["base"] | before(x, y)) & (y["start"] < x["end"]) & (y["end"] > x["start"])))
    chosen = chosen.select("rk", F.transform(apart, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))).alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return rows.select("rk", "doc_id").join(chosen, "rk", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(result: DataFrame) -> DataFrame:
    def text(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return result.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
