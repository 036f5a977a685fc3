"""Personal data (operator 2), in DataFrame functions only on the path that scans texts.

Base spans are the matches of four patterns (email, ip, card, phone) that pass a check of their digits. They always
stay. The method adds spans: high-recall generators propose candidates in forms that the patterns miss ((at)
addresses, IPv6, card numbers with other separators, phone numbers without +), and overlapping parts of base runs that
failed their check (every run of whole digit groups with a card's digits and check sum; every leading run of groups with
a phone's digits); boosted trees score format and context features of each; a threshold for each kind, calibrated on
held-out examples, selects. Of selected spans that overlap, the best score stays, then the first, then the longer. One
that overlaps a base span of any kind, or a selected one of an earlier kind, is left out.

The trees are fitted on the driver on EXAMPLES labelled texts that are made from templates (their number is the
documented bound; none of the corpus is used), with the same native feature expressions, and become one CASE
expression. No one feature decides: personal data comes in usual forms with or without a word that speaks for it, and in
unusual ones with such a word; other numbers come in the same forms after words that speak against it. So the corpus is read once and nothing is shuffled: a span's place is the running sum of the lengths of
gaps (``split``) and matches (``regexp_extract_all``), in pieces of CHUNK so that texts with very many matches stay
cheap. All quantifiers that could backtrack or recurse over long runs are possessive or bounded.

A null text is empty and has no spans; empty tables give empty results; repeated rows are scanned one by one; other
columns are ignored unless named. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import json
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")
CHUNK = 64
CONTEXT = 32
EXAMPLES = 1600
ROUNDS, RATE, PRECISION = 24, 0.4, 0.98

#: Base patterns, equal in what they match to the plain forms; look-behinds and possessive quantifiers only save time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_AT, _DOT = r"\x20?[(\[]at[)\]]\x20?", r"(?:\.|\x20?[(\[]dot[)\]]\x20?)"
PROPOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._/-])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/-])",
    "phone": r"(?<![0-9+.()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
PROPOSE_HINT = {
    "email": lambda t: F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")),
    "ip": lambda t: F.contains(t, F.lit("::")) | t.rlike(r"(?:[0-9A-Fa-f]{1,4}:){7}"),
    "card": lambda t: t.rlike(r"[0-9]{4}[._/][0-9]{4}[._/]"),
    "phone": lambda t: t.rlike(r"[0-9][)\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}"),
}
#: Words before a candidate that speak for each kind, and words that speak against any.
CUES = {
    "email": r"mail|contact|write|reach|address",
    "ip": r"ip|addr|host|server|login|client",
    "card": r"card|visa|master|amex|credit|payment|paid",
    "phone": r"tel|phone|call|mobile|cell|fax|contact|whatsapp|sms",
}
AGAINST = r"(version|build|isbn|issue|order|invoice|part|model|serial|ratio|score|page|figure|table|ticket|no\.|nr|id|sku|lot|spec)[\s:.#=(]*$"
TOP_DOMAINS = r"(com|org|net|edu|gov|io|de|fr|es|uk|info)$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    back = F.filter(F.split(F.reverse(_digits(m)), ""), lambda d: d != "")

    def double(d, i):
        twice = d.cast("int") * (i % 2 + 1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(back, double), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(m)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


_SPAN = "array<struct<s:int,e:int,m:string,left:string,right:string>>"


def _spans(df: DataFrame, out: str, pattern: str, hint: Column) -> DataFrame:
    """Add out: every match of a pattern with its start, end, text and the CONTEXT characters beside it."""
    df = df.withColumn("_m", F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    n = F.size("_m")
    after = F.transform(F.slice("_g", 2, n), lambda g: F.left(g, F.lit(CONTEXT)))
    parts = F.zip_with(
        F.zip_with(F.slice("_g", 1, n), "_m", lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), m.alias("m"), F.right(g, F.lit(CONTEXT)).alias("left"))),
        after,
        lambda a, right: F.struct(a["gap"].alias("gap"), a["len"].alias("len"), a["m"].alias("m"), a["left"].alias("left"), right.alias("right")),
    )
    df = df.withColumn("_p", F.when(F.col("_g").isNotNull(), parts))
    none = F.array().cast(_SPAN)

    def place(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk(acc, c):
        whole = F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["len"])
        inner = F.aggregate(c, F.struct(acc["at"].alias("at"), none.alias("out")), place, lambda a: a["out"])
        return F.struct((acc["at"] + whole).alias("at"), F.concat(acc["out"], inner).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), ((F.size("_p") - 1) / CHUNK).cast("int")), lambda c: F.slice(F.col("_p"), c * CHUNK + 1, CHUNK))
    found = F.when(F.size("_p") > 0, F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), chunk, lambda a: a["out"])).otherwise(none)
    return df.withColumn(out, found).drop("_m", "_g", "_p")


def _edge(ch: Column) -> Column:
    """0: blank or nothing, 1: letter or digit, 2: another character."""
    return F.when((ch == "") | ch.rlike(r"^\s"), 0).when(ch.rlike("^[A-Za-z0-9]"), 1).otherwise(2)


def _card_parts(x: Column) -> Column:
    """The parts of a run, from group to group, that have a card's digits and check sum."""
    groups = F.split(x["m"], "[\\x20-]")
    one = F.transform(groups, lambda g: F.char_length(g))

    def parts(i):
        def windows(n):
            body = F.array_join(F.slice(groups, i, n), "")
            return F.struct(i.alias("i"), n.alias("n"), body.alias("body"))

        last = F.least(F.lit(19), F.size(groups) - i + 1)
        return F.transform(F.sequence(F.lit(1), last), windows)

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), parts))
    good = F.filter(every, lambda w: _valid("card", w["body"]))

    def placed(w):
        begin = F.aggregate(F.slice(one, 1, w["i"] - 1), F.lit(0), lambda a, b: a + b + 1)
        return _part(x, begin, F.char_length(w["body"]) + w["n"] - 1)

    return F.transform(good, placed)


def _phone_parts(x: Column) -> Column:
    """The leading parts of a run, up to the end of a group, that have a phone's digits."""
    heads = F.array(*(F.regexp_extract(x["m"], rf"^\+[0-9]++(?:[\x20().-]++[0-9]++){{{k}}}", 0) for k in range(15)))
    good = F.filter(heads, lambda m: _valid("phone", m))
    return F.transform(good, lambda m: _part(x, F.lit(0), F.char_length(m)))


def _part(x: Column, begin: Column, length: Column) -> Column:
    """A part of a span, as a span."""
    return F.struct(
        (x["s"] + begin).alias("s"), (x["s"] + begin + length).alias("e"), F.substring(x["m"], begin + 1, length).alias("m"),
        F.right(F.concat(x["left"], F.substring(x["m"], F.lit(1), begin)), F.lit(CONTEXT)).alias("left"),
        F.left(F.concat(F.substring(x["m"], begin + length + 1, F.char_length(x["m"])), x["right"]), F.lit(CONTEXT)).alias("right"),
    )


PARTS = {"card": _card_parts, "phone": _phone_parts}


FEATURES = ("kind", "cue", "against", "left_edge", "right_edge", "digits", "marks", "shape", "hex", "part")


def features(kind: str, x: Column) -> list[Column]:
    """The integer features of a candidate, in the order of FEATURES."""
    m, left = x["m"], F.lower(x["left"])
    shape = {
        "email": F.when(F.lower(m).rlike(TOP_DOMAINS), 1).otherwise(0),
        "ip": F.when(F.contains(m, F.lit("::")), 1).otherwise(0),
        "card": F.when(_luhn(m), 1).otherwise(0),
        "phone": F.when(m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]"), 1).otherwise(0),
    }[kind]
    # 0: a form that PROPOSE has, 1: a part of a run, 2: a part in the usual form of its kind
    part = {
        "card": F.when(m.rlike(r"[._/]"), 0).when(m.rlike(r"^(?:[2-6][0-9]{3}(?:[\x20-]?[0-9]{4}){3}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})$"), 2).otherwise(1),
        "phone": F.when(~m.startswith("+"), 0).when(m.rlike(r"[(\x20.-](?:19|20)[0-9]{2}$") | m.rlike(r"\([^)]*$"), 1).otherwise(2),
    }.get(kind, F.lit(0))
    return [
        F.lit(KINDS.index(kind)),
        F.when(left.rlike(CUES[kind]), 1).otherwise(0),
        F.when(left.rlike(AGAINST), 1).otherwise(0),
        _edge(F.right(x["left"], F.lit(1))),
        _edge(F.left(x["right"], F.lit(1))),
        F.char_length(_digits(m)),
        F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        shape,
        F.char_length(F.regexp_replace(m, "[^A-Fa-f]", "")),
        part,
    ]


def examples() -> list[tuple[str, str, int]]:
    """EXAMPLES labelled texts (kind, text, whether its candidate is personal data), made from templates."""
    r = random.Random(7)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    h = lambda: "".join(r.choice("0123456789abcdef") for _ in range(4))

    def card(good: bool) -> str:
        x = "4" + d(14)
        total = sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(x)))
        last = (-total) % 10 if good else (-total + r.randint(1, 9)) % 10
        x, s = x + str(last), r.choice("._/")
        return s.join(x[i : i + 4] for i in range(0, 16, 4))

    yes = {"email": ["mail me: ", "contact ", "write to ", "my address is "], "ip": ["host ", "login from ip ", "client addr ", "server "], "card": ["card ", "paid by visa ", "credit card: ", "payment "], "phone": ["call ", "tel. ", "phone: ", "my mobile is "]}
    no = ["version ", "build ", "order no. ", "part ", "isbn ", "serial: ", "ticket #", "model ", "figure "]

    def form(kind: str, usual: bool) -> str:
        if kind == "email":
            at, dot = r.choice(["(at)", " (at) ", "[at]", " [at] "]), r.choice([".", " (dot) ", "[dot]"])
            return f"{w()}.{w()}{at}{w()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}" if usual else f"{w()}{at}{w()}{dot}{w()}"
        if kind == "ip":
            return ":".join(h() for _ in range(8)) if usual else r.choice([f"{d(2)}::{d(2)}", f"{r.choice('abcdef')}a::b{d(1)}", ":".join(d(2) for _ in range(8))])
        if kind == "card":
            return card(usual)
        s = r.choice(" .-")
        first = r.choice("23456789") if usual else r.choice("01")
        middle = r.choice("23456789") if usual or r.random() < 0.5 else r.choice("01")
        return f"{first}{d(2)}{s}{middle}{d(2)}{s}{d(4)}" if r.random() < 0.6 else f"({first}{d(2)}) {middle}{d(2)}{s}{d(4)}"

    out = []
    for i in range(EXAMPLES):
        kind, good = KINDS[i % 4], i // 4 % 2 == 0
        if good:  # in its usual form with a cue or without; in another with one (a card has to have its check sum)
            usual = kind == "card" or r.random() < 0.7
            before = r.choice([*yes[kind], "", ""]) if usual else r.choice(yes[kind])
        else:  # in any form behind a word against it; in no usual one without
            against = r.random() < 0.6
            usual = against and r.random() < 0.5
            before = r.choice(no) if against else r.choice(["", w() + "="])
        out.append((kind, f"{w()} {w()} {before}{form(kind, usual)}{'' if good and r.random() < 0.5 else r.choice([' ', '.', ','])} {w()}", int(good)))
    return out


def part_examples() -> list[tuple[str, str, str]]:
    """EXAMPLES / 2 texts with runs that fail (kind, text, the part that is personal data, or nothing), made from templates."""
    r = random.Random(8)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    out = []
    while len(out) < EXAMPLES // 2:
        good = len(out) // 2 % 2 == 0
        if len(out) % 2 == 0:
            x = r.choice("23456") + d(14)
            total = sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(x)))
            x, s = x + str(-total % 10), r.choice(" -")
            body = s.join(x[i : i + 4] for i in range(0, 16, 4)) if good else " ".join(d(r.choice([1, 2, 3, 5, 6])) for _ in range(r.randint(5, 12)))
            text = f"{r.choice(['', '', d(2) + ' '])}{body} {d(r.randint(1, 4))}" if good else body
            kind, before = "card", r.choice(["card ", "paid by visa ", "", "nr "]) if good else r.choice(["order ", "table ", "", "lot "])
        else:
            body = f"+{r.randint(1, 99)} {r.choice([d(2), d(3), '(' + d(2) + ')'])} {d(r.randint(5, 7))}"
            text = f"{body} {r.choice(['(2019-2020)', '2019 - 2024', '(' + d(4) + '-' + d(4) + ')'])}" if good else f"+{d(1)}.{d(1)} {' '.join(d(1) for _ in range(16))}"
            kind, before = "phone", r.choice(["call ", "tel. ", "", "phone: "]) if good else r.choice(["score ", "ratio ", "figure ", ""])
        out.append((kind, f"so {before}{text} on", body if good else ""))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Gradient boosting with logistic loss: trees of two levels as (feature, limit, left, right), left: at most limit."""
    score, trees = np.zeros(len(y)), []
    cuts = [(f, t) for f in range(x.shape[1]) for t in np.unique(x[:, f])[:-1]]

    def leaf(of):
        p = 1 / (1 + np.exp(-score[of]))
        return rate * (y[of] - p).sum() / ((p * (1 - p)).sum() + 1.0)

    def split(of):
        g = y[of] - 1 / (1 + np.exp(-score[of]))
        best = (0.0, None)
        for f, t in cuts:
            low = x[of, f] <= t
            n = low.sum()
            if 5 <= n <= len(g) - 5:
                gain = g[low].sum() ** 2 / n + g[~low].sum() ** 2 / (len(g) - n) - g.sum() ** 2 / len(g)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, int(t)))
        return best[1]

    for _ in range(rounds):
        all_ = np.arange(len(y))
        if (top := split(all_)) is None:
            break
        f, t = top
        sides = []
        for of in (all_[x[:, f] <= t], all_[x[:, f] > t]):
            sub = split(of)
            sides.append((*sub, float(leaf(of[x[of, sub[0]] <= sub[1]])), float(leaf(of[x[of, sub[0]] > sub[1]]))) if sub else float(leaf(of)))
        trees.append((f, t, *sides))
        score = score + predict(x, [trees[-1]])
    return trees


def predict(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    def value(node):
        return node if isinstance(node, float) else np.where(x[:, node[0]] <= node[1], value(node[2]), value(node[3]))

    return sum((value(t) * np.ones(len(x)) for t in trees), np.zeros(len(x)))


def _score(values: list[Column], trees: list[tuple]) -> Column:
    def value(node):
        return F.lit(node) if isinstance(node, float) else F.when(values[node[0]] <= node[1], value(node[2])).otherwise(value(node[3]))

    return sum((value(t) for t in trees), F.lit(0.0))


def calibrated(scores: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on held-out precision is PRECISION or more; infinite if there is none."""
    best = float("inf")
    for t in sorted(set(scores), reverse=True):
        if y[scores >= t].mean() >= PRECISION:
            best = float(t)
    return best


@cache
def _fitted(_app: str, spark) -> tuple[list[tuple], dict[str, float]]:
    made = json.dumps([{"id": i, "kind": k, "text": t, "y": y} for i, (k, t, y) in enumerate(examples())])
    df = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(made), "array<struct<id:int,kind:string,text:string,y:int>>")).alias("x")).select("x.*")
    found = []
    for kind in KINDS:
        one = _spans(df.where(F.col("kind") == kind), "_c", PROPOSE[kind], F.lit(True)).select("id", "y", F.explode("_c").alias("c"))
        found += one.select("id", "y", F.array(*features(kind, F.col("c"))).alias("f")).collect()
    made = json.dumps([{"id": i, "kind": k, "text": t, "y": y} for i, (k, t, y) in enumerate(part_examples())])
    df = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(made), "array<struct<id:int,kind:string,text:string,y:string>>")).alias("x")).select("x.*")
    for kind in PARTS:
        one = _spans(df.where(F.col("kind") == kind), "_c", BASE[kind], F.lit(True)).withColumn("_c", F.flatten(F.transform(F.filter("_c", _fails(kind)), PARTS[kind])))
        one = one.select("id", "y", F.explode("_c").alias("c"))
        found += one.select("id", (F.col("c.m") == F.col("y")).cast("int").alias("y"), F.array(*features(kind, F.col("c"))).alias("f")).collect()
    x, y, ids = (np.array([r[k] for r in found]) for k in ("f", "y", "id"))
    fit = ids // 8 % 2 == 0
    trees = boost(x[fit], y[fit])
    held, labels, kinds = predict(x[~fit], trees), y[~fit], x[~fit][:, 0]
    return trees, {k: calibrated(held[kinds == n], labels[kinds == n]) for n, k in enumerate(KINDS)}


def fitted(spark):
    """The trees and each kind's threshold."""
    return _fitted(spark.sparkContext.applicationId, spark)


def _passes(kind: str):
    return lambda x: _valid(kind, x["m"])


def _fails(kind: str):
    """Whether a base run failed its check and has a part that may pass."""
    return lambda x: ~_valid(kind, x["m"]) & (F.char_length(_digits(x["m"])) > (13 if kind == "card" else 9)) & x["m"].rlike(r"[0-9][\x20().-]+[0-9]")


def _featured(kind: str):
    return lambda x: F.struct(x.alias("x"), F.array(*features(kind, x)).alias("f"))


def _scored(trees: list[tuple]):
    return lambda y: F.struct((-_score([y["f"][i] for i in range(len(FEATURES))], trees)).alias("worst"), y["x"]["s"].alias("s"), (-y["x"]["e"]).alias("back"), y["x"].alias("x"))


def _best(scored: Column, least: float) -> Column:
    """Of the spans that a threshold selects, those that no better one overlaps."""

    def step(acc, y):
        free = ~F.exists(acc, lambda b: (b["s"] < y["x"]["e"]) & (y["x"]["s"] < b["e"]))
        return F.when(free, F.concat(acc, F.array(y["x"]))).otherwise(acc)

    return F.aggregate(F.array_sort(F.filter(scored, lambda y: y["worst"] <= -least)), F.array().cast(_SPAN), step)


def _clear_of(column: str):
    """The rule that a span overlaps none of a column's."""
    return lambda y: ~F.exists(column, lambda b: (b["s"] < y["x"]["e"]) & (y["x"]["s"] < b["e"]))


def find_spans(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns named in more, and for each kind base_<kind> and added_<kind>, arrays of spans."""
    trees, least = fitted(docs.sparkSession)
    df = texts(docs, *more)
    for kind in KINDS:
        df = _spans(df, f"base_{kind}", BASE[kind], HINT[kind](F.col("text")))
        if kind in PARTS:
            df = df.withColumn(f"_parts_{kind}", F.flatten(F.transform(F.filter(f"base_{kind}", _fails(kind)), PARTS[kind])).cast(_SPAN))
        if kind != "email":
            df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", _passes(kind)))
    earlier: list[str] = []
    for kind in KINDS:
        if least[kind] == float("inf"):
            df = df.withColumn(f"added_{kind}", F.array().cast(_SPAN))
            continue
        df = _spans(df, "_c", PROPOSE[kind], PROPOSE_HINT[kind](F.col("text")))
        if kind in PARTS:
            df = df.withColumn("_c", F.concat("_c", f"_parts_{kind}")).drop(f"_parts_{kind}")
        # features once a candidate, in a column of their own: inside the trees they would be repeated at every node
        df = df.withColumn("_f", F.transform("_c", _featured(kind)))
        df = df.withColumn("_f", F.transform("_f", _scored(trees)))
        against = [f"base_{k}" for k in KINDS] + earlier
        good = F.col("_f")
        for column in against:
            good = F.filter(good, _clear_of(column))
        good = _best(good, least[kind])
        df = df.withColumn(f"added_{kind}", F.when(F.size("_c") > 0, good).otherwise(F.array().cast(_SPAN))).drop("_c", "_f")
        earlier.append(f"added_{kind}")
    return df


def _joined(columns: list[tuple[str, Column]]) -> Column:
    def told(kind):
        return lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))

    return F.array_join(F.concat(*(F.transform(c, told(kind)) for kind, c in columns)), ",")


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts, base_sha256, spans and n_added of what find_spans gives."""
    base = [(k, F.col(f"base_{k}")) for k in KINDS]
    every = [(k, F.sort_array(F.concat(f"base_{k}", f"added_{k}"))) for k in KINDS]
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base]
    added = sum((F.size(f"added_{k}") for k in KINDS[1:]), F.size(f"added_{KINDS[0]}")).cast("long")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"), added.alias("n_added"))


def redact(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named in more, n_spans, and text with every span replaced by its kind in brackets; overlapping spans become one."""
    df = find_spans(docs, *more)

    def tagged_as(kind):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("tag"))

    tagged = [F.transform(F.concat(f"base_{k}", f"added_{k}"), tagged_as(k)) for k in KINDS]
    df = df.withColumn("_all", F.sort_array(F.concat(*tagged)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        inside = x["s"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, x["tag"]))).alias("out"))

    whole = F.aggregate("_all", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    return df.select("doc_id", *more, F.size("_all").alias("n_spans"), F.when(F.size("_all") > 0, whole).otherwise(F.col("text")).alias("text"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return digest_spans(find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))
