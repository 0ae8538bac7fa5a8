"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are what the base patterns match and what wider patterns match beside them
(addresses written out, IPv6, cards in other groupings, phone numbers without +). Labelers vote on each candidate or
abstain: `form` (the validated pattern), `gazetteer` (top-level domains, calling codes,
issuer prefixes, reserved networks), `context` (cue words before it), `edges` (whether it
stands free). Expectation-maximisation over the counts of vote patterns estimates how
often each labeler is right on spans and on others, and the share of spans, per kind and breadth of pattern. Its
posteriors are the soft labels of the final classifier, a logistic regression on votes,
family and length, fitted to the same counts. Both fits read one row per pattern, a number
bounded by the labelers and not by the data.

Validated base spans always stand; of the other candidates those that the classifier
accepts are added if they overlap none of them. Of two added ones that overlap, the one of
the earlier pattern stays.

A text is read once, in one projection: matches and the pieces between them give positions
without a UDF, as each pattern runs to its end without backtracking over what it has read
(possessive quantifiers, and matches start only where a run starts or the last match ended).

Defined results: a null text is empty and has no spans. Every row of the input gives a row;
rows that repeat a doc_id are scanned each, and null ids are carried as null. A very long text is
scanned whole; positions are summed and spans compared in groups, so neither grows with the square of
its spans. Ties in likelihood fall to the threshold (accepted at exactly it). An empty table
gives an empty table. Only doc_id and text are read, so the names of other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The base patterns, in a form that never goes back over a run.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns for candidates that only the classifier can admit: kind, pattern, and what a text must match to be searched.
WIDER = {
    "email_marked": ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?[\[({{<] ?(?i:at) ?[\])}}>] ?{_LABEL}{{1,63}}+(?:(?: ?[\[({{<] ?(?i:dot) ?[\])}}>] ?|\.){_LABEL}{{2,63}}+)++", r"(?i)[\[({<] ?at ?[\])}>]"),
    "email_spoken": ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ (?i:at) {_LABEL}{{1,63}}+(?: (?i:dot) {_LABEL}{{2,63}}+)++", r"(?i) dot "),
    "ip_v6": ("ip", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]::?[0-9A-Fa-f]"),
    "card_marked": ("card", r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/])", r"[0-9]{4}[._/][0-9]{4}"),
    "phone_local": ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[ .-][0-9]{4}"),
    "phone_trunk": ("phone", r"(?<![0-9+.-])\(0[0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9.-])", r"\(0[0-9]"),
    "phone_abroad": ("phone", r"(?<![0-9+.-])00[1-9](?:[ .()-]?[0-9]){7,12}+(?![0-9.-])", r"00[1-9]"),
}
#: Gazetteers and cue words.
DOMAINS = "com org net edu gov mil int info biz io ai app dev co uk us de fr es it nl eu ch at be se no dk fi pl pt ru cn jp kr in br mx ar au ca nz za".split()
CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 6011 65 64 35 36 38 30 62 50 56 57 58 60 63".split()
CUES = {
    "email": r"(?i)(e-?mail|mail|correo|contact|kontakt|write to|@)[^\p{L}]*\p{L}*[^\p{L}]*$",
    "ip": r"(?i)(\bip\b|host|server|address|addr|adresse|node|ping|from)[^\p{L}]*\p{L}*[^\p{L}]*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|tarjeta|carte|karte|pan)[^\p{L}]*\p{L}*[^\p{L}]*$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|tél|llame|telefon|handy|whatsapp)[^\p{L}]*\p{L}*[^\p{L}]*$",
}
AGAINST = {
    "email": r"(?i)(example of|regex|pattern)[^\p{L}]*$",
    "ip": r"(?i)(version|release|\bv|section|chapter|§)[^\p{L}]*$",
    "card": r"(?i)(isbn|order|invoice|serial|ticket|tracking|doi)[^\p{L}]*$",
    "phone": r"(?i)(isbn|order|invoice|serial|figure|version)[^\p{L}]*$",
}
LABELERS = ("form", "gazetteer", "context", "edges")
#: What is assumed of each labeler before any count: its chances of a yes on spans and on others, and the weight of this in candidates.
ASSUMED = {"form": (0.9, 0.2, 10), "gazetteer": (0.9, 0.4, 10), "context": (0.98, 0.1, 10), "edges": (0.9, 0.4, 10)}
#: The least chance of a yes on spans, whatever the counts, where it is not 0.5: a counter-cue stands before at most one span in 50.
LEAST_YES = {"context": 0.98}
CHUNK = 256
GROUP = 64


def _sums(a: Column, start: Column) -> Column:
    """Sums before each element, for short arrays."""
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum"))
    return F.aggregate(a, F.struct(F.array().cast("array<bigint>").alias("out"), start.cast("bigint").alias("sum")), step)["out"]


def sums_before(a: Column) -> Column:
    """Sums before each element of an array of any length, in chunks so that the work
    doesn't grow with the square of the length."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int"))
    part = lambda c: F.slice(a, c * CHUNK + 1, F.lit(CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0).cast("bigint"), lambda s, x: s + x))
    firsts = _sums(totals, F.lit(0))
    whole = F.flatten(F.transform(firsts, lambda first, c: _sums(part(c), first)))
    return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).when(F.size(a) <= CHUNK, _sums(a, F.lit(0))).otherwise(whole)


def _step(pieces: str):  # noqa: ANN202
    return lambda m, i: (F.length(F.element_at(pieces, i + 1)) + F.length(m)).cast("bigint")


def digits(c: Column) -> Column:
    return F.translate(c, "+ ().-_/", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    return F.length(digits(m)).between(9, 15)


def _starts(c: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in prefixes)), lambda p: c.startswith(p))


def gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)[^A-Za-z0-9-]*$", 1)).isin(DOMAINS)
    if kind == "ip":
        local = F.lower(m).rlike("^(fe80|ff[0-9a-f]{2}|2001:0?db8|0*:)")
        return F.when(F.contains(m, F.lit(":")), ~local).otherwise(~(m.startswith("0.") | m.startswith("255.") | F.ltrim(m, F.lit("0")).rlike(r"^(22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")))
    if kind == "card":
        return _starts(digits(m), ISSUERS)
    return F.when(m.startswith("+"), _starts(F.ltrim(digits(m), F.lit("0")), CALLING)).when(m.startswith("00"), _starts(F.substring(digits(m), 3, 3), CALLING)).when(m.startswith("(0"), True).otherwise(~digits(m).rlike("^[01]"))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0 or -1 (abstains)."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, 0).otherwise(-1).cast("tinyint")


SPAN = "struct<kind:tinyint,rank:tinyint,start:bigint,end:bigint,base:boolean,form:tinyint,gazetteer:tinyint,context:tinyint,edges:tinyint,long:tinyint>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans (SPAN: base ones have base = true, votes as LABELERS) of each row."""
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    out = out.withColumn("numbers", F.col("text").rlike("[0-9]"))
    guards = {
        "email": F.contains("text", F.lit("@")), "ip": F.col("numbers") & F.contains("text", F.lit(".")), "card": F.col("numbers"), "phone": F.col("numbers") & F.contains("text", F.lit("+")),
    }
    guards |= {name: (F.lit(True) if kind == "email" else F.col("numbers")) & F.col("text").rlike(guard) for name, (kind, _, guard) in WIDER.items()}
    patterns = [(k, k, BASE[k]) for k in KINDS] + [(name, kind, p) for name, (kind, p, _) in WIDER.items()]
    ranks = {name: i for i, (name, _, _) in enumerate(patterns)}
    for name, _, pattern in patterns:
        out = out.withColumn(f"m_{name}", F.when(guards[name], F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        out = out.withColumn(f"p_{name}", F.when(F.size(f"m_{name}") > 0, F.split("text", pattern, -1)).otherwise(none))
    for name, _, _ in patterns:
        steps = F.transform(f"m_{name}", _step(f"p_{name}"))
        out = out.withColumn(f"s_{name}", F.when(F.size(f"m_{name}") > 0, sums_before(steps)).otherwise(F.array().cast("array<bigint>")))

    def spans(name: str, kind: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            before, after = F.element_at(f"p_{name}", i + 1), F.element_at(f"p_{name}", i + 2)
            start = F.element_at(f"s_{name}", i + 1) + F.length(before)
            cue = F.right(before, F.lit(40))
            ok = valid(kind, m) if name == kind else F.lit(False)
            return F.struct(
                F.lit(KINDS.index(kind)).cast("tinyint").alias("kind"), F.lit(ranks[name]).cast("tinyint").alias("rank"), start.alias("start"), (start + F.length(m)).alias("end"), ok.alias("base"),
                (_vote(ok) if name == kind else F.lit(-1).cast("tinyint")).alias("form"), _vote(gazetteer(kind, m)).alias("gazetteer"),
                _vote(cue.rlike(CUES[kind]), cue.rlike(AGAINST[kind])).alias("context"),
                _vote(~F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_@/+-]") & ~F.left(after, F.lit(1)).rlike(r"[\p{L}\p{N}_@/]")).alias("edges"),
                F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).otherwise(2).cast("tinyint").alias("long"),
            )

        some = F.transform(f"m_{name}", one)
        if name == "card":  # a match with fewer than 11 digits is no candidate of any kind
            some = F.filter(some, lambda s: s["base"] | (s["end"] - s["start"] >= 11))
        elif kind == "card":  # nor is one that fails its check digit
            some = F.transform(F.filter(F.arrays_zip(F.col(f"m_{name}").alias("m"), some.alias("s")), lambda z: luhn(digits(z["m"]))), lambda z: z["s"])
        return F.when(F.size(f"m_{name}") > 0, some).otherwise(F.array().cast(f"array<{SPAN}>"))

    return out.select("doc_id", F.concat(*(spans(name, kind).cast(f"array<{SPAN}>") for name, kind, _ in patterns)).alias("spans"))


Pattern = tuple[int, int, int, int, int, int]  # family, votes, long
FAMILIES = 2 * len(KINDS)


def family(s: Column) -> Column:
    """The kind, apart for candidates of base patterns and of wider ones: far fewer of the latter are spans."""
    return s["kind"].cast("int") + F.when(s["rank"] >= len(KINDS), len(KINDS)).otherwise(0)


def expectation_maximisation(counts: dict[Pattern, int], rounds: int = 100, least_yes: dict[str, float] | None = None) -> tuple[dict[Pattern, float], dict]:
    """(posterior of each pattern, reliabilities): Dawid and Skene's model with abstentions,
    per family a share of spans, per family and labeler the chances of a yes on spans and on others."""
    kinds = sorted({p[0] for p in counts})
    share = dict.fromkeys(kinds, 0.6)
    hit = {(k, j): ASSUMED[name][:2] for k in kinds for j, name in enumerate(LABELERS)}
    post: dict[Pattern, float] = {}
    for _ in range(rounds):
        for p in counts:
            log = math.log(share[p[0]]) - math.log(1 - share[p[0]])
            for j, v in enumerate(p[1:5]):
                yes, no = hit[p[0], j]
                if v >= 0:
                    log += math.log(yes / no) if v else math.log((1 - yes) / (1 - no))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
        for k in kinds:
            mine = [(p, n) for p, n in counts.items() if p[0] == k]
            spans, all_ = sum(n * post[p] for p, n in mine), sum(n for _, n in mine)
            share[k] = (spans + 3) / (all_ + 5)
            for j, name in enumerate(LABELERS):
                on_spans, on_others, weight = ASSUMED[name]
                voted = [(p, n) for p, n in mine if p[1 + j] >= 0]
                yes = sum(n * post[p] * p[1 + j] for p, n in voted) + on_spans * weight
                of = sum(n * post[p] for p, n in voted) + weight
                no = sum(n * (1 - post[p]) * p[1 + j] for p, n in voted) + on_others * weight
                of_no = sum(n * (1 - post[p]) for p, n in voted) + weight
                # a labeler is better than chance: else the two classes could change places
                hit[k, j] = (max(yes / of, (least_yes or {}).get(name, 0.5)), min(no / of_no, 0.5))
    return post, {"share": share, "hit": hit}


def _vector(p: Pattern) -> list[float]:
    votes = [x for v in p[1:5] for x in (float(v == 1), float(v == 0))]
    return [1.0, *(float(p[0] == k) for k in range(FAMILIES)), *votes, float(p[5] == 1), float(p[5] == 2)]


def classifier(counts: dict[Pattern, int], post: dict[Pattern, float], ridge: float = 1.0) -> list[float]:
    """Weights of a logistic regression on the patterns' soft labels, by Newton's method."""
    import numpy as np

    x = np.array([_vector(p) for p in counts])
    y, n = np.array([post[p] for p in counts]), np.array([counts[p] for p in counts], float)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (n * (y - q)) - ridge * beta)
        beta += step * min(1.0, 3 / max(float(np.abs(step).max()), 1e-12))
        if float(np.abs(step).max()) < 1e-9:
            break
    return [float(b) for b in beta]


def _probability(s: Column, beta: list[float]) -> Column:
    z = F.lit(beta[0])
    for k in range(FAMILIES):
        z = z + F.when(family(s) == k, beta[1 + k]).otherwise(0.0)
    at = 1 + FAMILIES
    for j, name in enumerate(LABELERS):
        z = z + F.when(s[name] == 1, beta[at + 2 * j]).when(s[name] == 0, beta[at + 2 * j + 1]).otherwise(0.0)
    return 1 / (1 + F.exp(-(z + F.when(s["long"] == 1, beta[-2]).when(s["long"] == 2, beta[-1]).otherwise(0.0))))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"].cast("int") + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _grouped(spans: Column) -> Column:
    """Spans by start, in groups with the range that each covers."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / GROUP).cast("int")), lambda c: F.slice(by_start, c * GROUP + 1, F.lit(GROUP)))
    ranged = F.transform(groups, lambda g: F.struct(F.get(g, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(g, lambda s: s["end"])).alias("hi"), g.alias("spans")))
    return F.when(F.size(spans) > 0, ranged).otherwise(F.filter(ranged, lambda g: F.lit(False)))


def _meets(groups: Column, s: Column, which: Callable[[Column], Column] | None = None) -> Column:
    """Whether a span of the groups, one that `which` holds for if given, overlaps s. Groups out of reach are
    passed over whole, so many spans in one text don't meet one by one."""
    hit = lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    if which is not None:
        return F.exists(groups, lambda g: (g["lo"] < s["end"]) & (s["start"] < g["hi"]) & F.exists(g["spans"], lambda b: hit(b) & which(b)))
    return F.exists(groups, lambda g: (g["lo"] < s["end"]) & (s["start"] < g["hi"]) & F.exists(g["spans"], hit))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end of base and
    added ones, by kind and start) and n_added of each row of docs."""
    found = common.stash(candidates(docs), even=True)
    each = found.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).groupBy(family(F.col("s")).alias("family"), *(f"s.{n}" for n in LABELERS), "s.long").count()
    counts = {tuple(int(v) for v in r[:6]): int(r["count"]) for r in each.collect()}  # 8 * 3^4 * 3 patterns at most
    beta = classifier(counts, expectation_maximisation(counts, least_yes=LEAST_YES)[0]) if counts else [0.0] * (3 + FAMILIES + 2 * len(LABELERS))
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    out = common.once(found, "base", F.filter("spans", lambda s: s["base"]))
    out = common.once(out, "likely", F.filter("spans", lambda s: ~s["base"] & (s["form"] != 0) & (_probability(s, beta) >= threshold)))
    some = common.once(out, "groups", F.when(F.size("likely") > 0, _grouped(F.col("base"))))
    some = common.once(some, "clear", F.filter("likely", lambda s: ~_meets(F.col("groups"), s)))
    some = common.once(some, "rivals", F.when(F.size("clear") > 1, _grouped(F.col("clear"))))
    out = some.withColumn("added", F.when(F.size("clear") > 1, F.filter("clear", lambda s: ~_meets(F.col("rivals"), s, lambda b: b["rank"] < s["rank"]))).otherwise(F.col("clear")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return out.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_listed(order(F.col("base"))), 256).alias("base_sha256"),
        _listed(order(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )
