"""Personal data: candidate spans weighed by gradient-boosted trees, in DataFrame functions alone.

Base spans (mail addresses, IPv4 addresses, payment cards, telephone numbers) are found by pattern and check, and stay.
High-recall generators propose further spans that may overlap them and each other; format and context features of each
go through boosted trees that are compiled to nested conditions, and those above their kind's calibrated threshold are
added where they touch no base span. Everything works within the row: no shuffle, no Python on the executors.

Positions come from two passes of one pattern: the matches, and the text between them (``split``), whose lengths add
up. A pattern's first part may only begin where the run of its characters begins or where the last match ended
(``\\G``), and its repeats are possessive: the same matches as the plain pattern, without recursion and in time linear
in the text. A candidate's context is read from the pieces beside it, and whether it touches a base span from ranks in
two sorted arrays, so that a text of many spans takes no time that goes with their square.

The trees learn from ``TRAIN_ROWS`` made-up lines with known personal data and look-alikes (versions, prices, order
numbers ...), which pass through the same generators and features; Spark folds them to counts of distinct feature
vectors, which the driver boosts. Some templates of each kind are held out as a whole, so that thresholds are set on
sentences and cues that the trees have not seen: the least one with precision ``PRECISION``.

Limits of the generators, beyond which nothing is proposed: numbers in groups as the patterns write them, cards of 13 to
15 digits; addresses are unbounded. Context: 30 characters before, no further back than the candidate before last.
Nulls: a null text is empty. Repeated rows are searched one by one. Ties: candidates of equal place and kind are one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, packed, table

#: Fixed values of the contract: the kinds in order. ``id`` is a kind that only the generators propose.
KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "id")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns, written to run in linear time.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: kind and pattern of what may be personal data though it is not of a base form.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{2,}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z]{2,}+)++",
    "phone": r"(?<![0-9A-Za-z+.,$-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
CUES = {
    "tel": r"(?i)\b(tel|telephone|phone|call|mobile|cell|fax|dial|ring|sms|telefon|anruf|llame)\b",
    "pay": r"(?i)\b(card|visa|credit|debit|mastercard|amex|payment|karte|tarjeta|carte)\b",
    "mail": r"(?i)\b(mail|e-mail|email|contact|write|reach|correo|courriel)\b",
    "ssn": r"(?i)\b(ssn|social security|national id|taxpayer)\b",
    "other": r"(?i)\b(order|invoice|ref|reference|version|isbn|total|page|pages|serial|model|sku|ticket|date|lot|part|case|build)\b",
}
#: Ends of host names, in any case after a dot, and those that are also words or codes, in small letters alone.
_ENDINGS, _CODES = "(?i:com|org|net|edu|gov|mil|info|biz)", "(?:io|ai|co|us|uk|eu|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|ru|cn|jp|kr|in|au|nz|ca|br|mx|ar|za)"
TRAIN_ROWS = 3000
ROUNDS, RATE, PRECISION = 12, 0.5, 0.98
BLOCK = 256
#: Characters of context on either side of a candidate.
LEFT, RIGHT = 30, 4


def _length(x: Column) -> Column:
    return F.length(x).cast("long")


def _located(df: DataFrame, text: str, name: str, pattern: str, gate: Column | None, around: bool = False) -> DataFrame:
    """Adds ``name``: an array of (start, end, value) of the pattern's matches, in code points, and with ``around`` their
    ``left`` and ``right`` context.
    """
    none = F.lit(None).cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    found = F.when(gate, found) if gate is not None else found
    m, g, sizes, blocks = (f"{name}_{x}" for x in "mgsb")
    df = df.withColumn(m, F.when(F.size(found) > 0, found) if gate is None else found)
    df = df.withColumn(m, F.when(F.size(m) > 0, F.col(m)).otherwise(none))
    df = df.withColumn(g, F.when(F.col(m).isNotNull(), F.split(text, pattern, -1)))
    df = df.withColumn(sizes, F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: _length(a) + _length(b)))
    whole = F.when(F.col(m).isNotNull(), F.sequence(F.lit(0), ((F.size(m) - 1) / BLOCK).cast("int")))
    part = lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, BLOCK), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn(blocks, F.aggregate(whole, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + part(b)))))

    def place(x, i):
        block = (i / BLOCK).cast("int")
        start = F.element_at(blocks, block + 1) + F.aggregate(F.slice(sizes, block * BLOCK + 1, i % BLOCK), F.lit(0).cast("long"), lambda a, y: a + y) + _length(F.element_at(g, i + 1))
        context = []
        if around:
            past = F.when(i > 0, F.concat(F.right(F.element_at(g, F.greatest(i, F.lit(1))), F.lit(LEFT)), F.element_at(m, F.greatest(i, F.lit(1))))).otherwise("")
            left = F.right(F.concat(past, F.element_at(g, i + 1)), F.lit(LEFT))
            after = F.concat(F.element_at(g, i + 2), F.coalesce(F.try_element_at(m, (i + 2).cast("int")), F.lit("")))
            context = [left.alias("left"), F.left(after, F.lit(RIGHT)).alias("right")]
        return F.struct(start.alias("start"), (start + _length(x)).alias("end"), x.alias("value"), *context)

    fields = "start:bigint,end:bigint,value:string" + ",left:string,right:string" * around
    return df.withColumn(name, F.coalesce(F.transform(m, place), F.array().cast(f"array<struct<{fields}>>"))).drop(m, g, sizes, blocks)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


_RANGE = r"0*+(?:[1-9]?[0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CHECKS = {
    "email": None,
    "ip": lambda s: s["value"].rlike(rf"^{_RANGE}\.{_RANGE}\.{_RANGE}\.{_RANGE}$"),
    "card": lambda s: F.length(_digits(s["value"])).between(16, 19) & F.call_function("luhn_check", _digits(s["value"])),
    "phone": lambda s: F.length(_digits(s["value"])).between(8, 15),
}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds base_email, base_ip, base_card, base_phone: arrays of (start, end, value) that pass their checks."""
    gates = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.col(text).rlike("[0-9]\\.[0-9]"), "card": F.col(text).rlike("[0-9][ -]?[0-9]")}
    for kind in KINDS:
        df = _located(df, text, f"base_{kind}", BASE[kind], gates[kind])
        if CHECKS[kind]:
            df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", CHECKS[kind]))
    return df


#: The features of a candidate, each a small whole number, from its value and the text around it.
def _features(value: Column, left: Column, right: Column) -> dict[str, Column]:
    flag = lambda c: c.cast("int")
    digits = _digits(value)
    return {
        "length": F.least(F.length(value), F.lit(40)),
        "digits": F.least(F.length(digits), F.lit(20)),
        "groups": F.least(F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))), F.lit(6)),
        "brackets": flag(value.rlike(r"[(\[{]")),
        "dots": flag(value.rlike(r"[0-9]\.[0-9]")),
        "spelled": flag(value.rlike(r"[(\[{ ]dot[)\]} ]")),
        # what stands after a written dot: 3 a known ending, 2 a small letter, 1 a known ending after a space, else 0
        "ending": F.when(value.rlike(rf"\.(?:{_ENDINGS}|{_CODES})(?![A-Za-z0-9])"), 3).when(value.rlike(r"\.[a-z]"), 2).when(value.rlike(rf"\. {_ENDINGS}(?![A-Za-z0-9])"), 1).otherwise(0),
        "luhn": flag(F.when(F.length(digits) > 0, F.call_function("luhn_check", digits)).otherwise(False)),
        "mixed": flag(value.rlike("[0-9] [0-9]") & value.rlike("[0-9]-[0-9]")),
        **{f"cue_{k}": flag(left.rlike(p)) for k, p in CUES.items()},
        "before": F.when(left.rlike("[A-Za-z0-9]$"), 2).when(left.rlike("[#$%/=_]\\s?$"), 1).otherwise(0),
        "after": F.when(right.rlike("^[A-Za-z0-9]"), 2).when(right.rlike("^\\s?[%/=_]"), 1).otherwise(0),
    }


FEATURES = ("length", "digits", "groups", "brackets", "dots", "spelled", "ending", "luhn", "mixed", *(f"cue_{k}" for k in CUES), "before", "after")


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds cand_<kind> for each generator: arrays of (start, end, value, features)."""
    spelled = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in ("(at)", "[at]", "{at}", " at ")))  # every match holds one
    gates = {k: F.col(text).rlike("[0-9]{3}") for k in GENERATORS} | {"email": spelled}
    for kind, pattern in GENERATORS.items():
        df = _located(df, text, f"cand_{kind}", pattern, gates[kind], around=True)

        def described(s):
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *(c.cast("int").alias(n) for n, c in _features(s["value"], s["left"], s["right"]).items()))

        df = df.withColumn(f"cand_{kind}", F.transform(f"cand_{kind}", described))
    return df


def made_up(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """Lines with one candidate each: id, kind, text, personal (0 or 1), held (of a held-out template). The same at every run."""
    n = lambda salt, lo, hi: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo + 1)) + lo).cast("string")
    pick = lambda salt, *of: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    name, host = pick(1, "anna.berg", "jdoe", "m.ruiz", "k_lind", "office"), pick(2, "example", "mailbox", "post", "uni-net")
    sep = pick(3, " ", "-", ".")
    parts = lambda *sizes: F.concat_ws("", *(x for k, s in enumerate(sizes) for x in ([sep] if k else []) + [n(10 + k, 10 ** (s - 1), 10**s - 1)]))
    tel, pay, mail, ssn = pick(4, "Call ", "Tel: ", "phone ", "my mobile is ", "fax "), pick(5, "card ", "Visa ", "credit card no "), pick(6, "mail ", "contact ", "write to ", ""), pick(7, "SSN ", "social security ", "SSN: ")
    other = pick(8, "order ", "invoice ", "ref ", "total ", "serial ", "part ", "build ", "ISBN ", "page ")
    plain = pick(9, "see ", "the ", "of ", "", "and ")
    made = [
        ("phone", F.concat(tel, parts(3, 3, 4)), 1), ("phone", F.concat(tel, F.lit("("), n(30, 200, 989), F.lit(") "), n(31, 200, 999), F.lit("-"), n(32, 1000, 9999)), 1),
        ("phone", F.concat(plain, F.lit("("), n(30, 200, 989), F.lit(") "), n(31, 200, 999), F.lit("-"), n(32, 1000, 9999)), 1), ("phone", F.concat(other, parts(3, 3, 4)), 0), ("phone", F.concat(plain, parts(4, 4, 4)), 0), ("phone", F.concat(plain, parts(2, 3, 3), pick(33, "", "%", "/2")), 0),
        ("email", F.concat(mail, name, F.lit(" (at) "), host, F.lit(" (dot) com")), 1), ("email", F.concat(mail, name, F.lit("[at]"), host, pick(34, "[dot]org", ".net")), 1), ("email", F.concat(mail, name, F.lit(" at "), host, F.lit(" dot com")), 1), ("email", F.concat(pick(35, "look ", "we met "), pick(36, "them", "us", "it"), F.lit(" at "), pick(37, "noon", "home", "work"), F.lit("."), pick(38, " Then", "We", " and")), 0),
        ("email", F.concat(mail, name, F.lit(" at "), host, pick(61, "(dot)com", "[dot]org", "{dot}net", " (dot) de", " [dot] fr")), 1), ("email", F.concat(mail, name, F.lit(" at "), host, pick(62, ".com", ".org", ".co.uk", ".de", ". com")), 1),
        ("email", F.concat(pick(63, mail, plain), pick(64, "stayed", "arrives", "and", "is", "look", "anna"), F.lit(" at "), pick(65, "home", "work", "and", "school", "example", "large"), pick(66, ". But", ". The", ". He", ".In", ". It", ". and")), 0), ("email", F.concat(pick(63, mail, plain), pick(67, "crash", "exception", "look", "line"), F.lit(" at "), pick(68, "java", "config", "index", "main"), pick(69, ".lang", ".py", ".html", ".util.list")), 0),
        ("id", F.concat(ssn, n(40, 100, 899), F.lit("-"), n(41, 10, 99), F.lit("-"), n(42, 1000, 9999)), 1), ("id", F.concat(other, n(40, 100, 899), F.lit("-"), n(41, 10, 99), F.lit("-"), n(42, 1000, 9999)), 0), ("id", F.concat(plain, n(40, 100, 899), F.lit("-"), n(41, 10, 99), F.lit("-"), n(42, 1000, 9999)), 0),
        ("card", F.concat(other, n(50, 10**12, 10**15 - 1)), 0), ("card", F.concat(plain, n(50, 10**12, 10**15 - 1)), 0), ("card", F.concat(pay, pick(51, "378282246310005", "371449635398431", "30569309025904", "4222222222222", "3782 822463 10005")), 1),
    ]
    ring, debit = pick(70, "ring ", "dial ", "cell ", "sms "), pick(71, "debit ", "mastercard ", "amex ")
    lot = pick(72, "lot ", "ticket ", "case ", "model ", "sku ", "version ")
    ssn_like = F.concat(n(40, 100, 899), F.lit("-"), n(41, 10, 99), F.lit("-"), n(42, 1000, 9999))
    bracketed = F.concat(F.lit("("), n(30, 200, 989), F.lit(") "), n(31, 200, 999), F.lit("-"), n(32, 1000, 9999))
    held = [
        ("phone", F.concat(ring, parts(3, 3, 4)), 1), ("phone", F.concat(pick(73, "or ", "at ", "try ", "then "), bracketed), 1), ("phone", F.concat(lot, parts(3, 3, 4)), 0), ("phone", F.concat(pick(74, "in ", "from ", ""), n(75, 10, 255), F.lit("."), n(76, 100, 255), F.lit("."), n(77, 100, 255)), 0),
        ("email", F.concat(pick(78, "reach ", "or ask ", ""), name, F.lit(" {at} "), host, pick(79, " {dot} org", " dot net", ".com")), 1), ("email", F.concat(pick(78, "reach ", "or ask ", ""), name, F.lit(" at "), host, pick(80, ".net", " dot org", ".fr")), 1), ("email", F.concat(pick(81, "waiting", "sat", "it", "start"), F.lit(" at "), pick(82, "dawn", "sea", "last", "it"), pick(83, ". Later", ". A man", ".So", ". In the")), 0), ("email", F.concat(pick(84, "error", "stopped", "fails"), F.lit(" at "), pick(85, "module", "parser", "kernel"), pick(86, ".run", ".open", ".init.call")), 0),
        ("id", F.concat(pick(87, "taxpayer ", "national id "), ssn_like), 1), ("id", F.concat(lot, ssn_like), 0),
        ("card", F.concat(debit, pick(88, "378734493671000", "3714 496353 98431", "38520000023237", "4222222222222")), 1), ("card", F.concat(lot, n(89, 10**12, 10**15 - 1)), 0), ("card", F.concat(pick(90, "by ", "or ", "is "), n(89, 10**12, 10**15 - 1)), 0),
    ]
    seen = len(made)
    made += held
    choose = (F.pmod("id", F.lit(len(made))) + 1).cast("int")
    one = lambda k: F.element_at(F.array(*(m[k] if isinstance(m[k], Column) else F.lit(m[k]) for m in made)), choose)
    return spark.range(rows).select("id", one(0).alias("kind"), F.concat(one(1), pick(60, "", ".", " now", ", and more")).alias("text"), one(2).alias("personal"), (choose > seen).alias("held"))


def boost(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS) -> list[tuple]:
    """Trees of depth two on (features, positives, negatives): Newton steps on the logistic loss.

    A tree is a leaf value, or (feature, threshold, tree where the feature is at most it, tree where it is more).
    """
    margin = [0.0] * len(rows)

    def gains(which: list[int]):
        g = {k: (rows[k][1] + rows[k][2]) / (1 + math.exp(-margin[k])) - rows[k][1] for k in which}
        h = {k: (rows[k][1] + rows[k][2]) * (p := 1 / (1 + math.exp(-margin[k]))) * (1 - p) for k in which}
        return g, h

    def grow(which: list[int], depth: int):
        g, h = gains(which)
        value = lambda ks: -sum(g[k] for k in ks) / (sum(h[k] for k in ks) + 1.0)
        worth = lambda ks: sum(g[k] for k in ks) ** 2 / (sum(h[k] for k in ks) + 1.0)
        best = None
        for f in range(len(FEATURES)) if depth else ():
            for cut_at in sorted({rows[k][0][f] for k in which})[:-1]:
                low, high = [k for k in which if rows[k][0][f] <= cut_at], [k for k in which if rows[k][0][f] > cut_at]
                gain = worth(low) + worth(high) - worth(which)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, cut_at, low, high
        if best is None or best[0] < 1e-3:
            return RATE * value(which)
        return FEATURES[best[1]], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)

    trees = []
    for _ in range(rounds):
        tree = grow(list(range(len(rows))), 2)
        trees.append(tree)
        for k, (x, _, _) in enumerate(rows):
            margin[k] += walk(tree, dict(zip(FEATURES, x, strict=True)))
    return trees


def walk(tree, x: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def compiled(trees: list, s: Column) -> Column:
    """The trees' sum as nested conditions on the fields of a candidate."""

    def one(tree):
        return F.when(s[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    return reduce(lambda a, b: a + b, map(one, trees))


def _marked(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), *(s[f].alias(f) for f in FEATURES))


def train(spark: SparkSession, rows: int = TRAIN_ROWS) -> dict[str, tuple[list, float]]:
    """For each generated kind its trees and threshold (infinite where no threshold is precise enough)."""
    lines = candidates(cut(made_up(spark, rows)), "text")
    kinds = list(GENERATORS)
    every = F.concat(*(F.transform(f"cand_{k}", _marked(k)) for k in kinds))
    flat = lines.select("kind", "held", "personal", F.explode(every).alias("s")).filter(F.col("s.kind") == F.col("kind"))
    flat = flat.select("kind", "held", "personal", *(F.col(f"s.{f}").alias(f) for f in FEATURES))
    counted = flat.groupBy("kind", "held", *FEATURES).agg(F.sum("personal").alias("pos"), F.sum(1 - F.col("personal")).alias("neg")).orderBy("kind", "held", *FEATURES).collect()  # TRAIN_ROWS at most
    model = {}
    for kind in kinds:
        mine = [(r["held"], (tuple(r[f] for f in FEATURES), float(r["pos"]), float(r["neg"]))) for r in counted if r["kind"] == kind]
        trees = boost([r for held, r in mine if not held])
        seen = sorted(((sum(walk(t, dict(zip(FEATURES, x, strict=True))) for t in trees), p, n) for held, (x, p, n) in mine if held), reverse=True)
        threshold, pos, neg = math.inf, 0.0, 0.0
        for score, p, n in seen:
            pos, neg = pos + p, neg + n
            if pos >= PRECISION * (pos + neg) and score > 0:
                threshold = score
        model[kind] = (trees, threshold)
    return model


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _ranks(found: Column, at: str, base: Column, base_at: str, first: bool) -> Column:
    """For each of the spans ``found`` (in order, disjoint), how many of the base spans' places come before its own;
    ``first``: equal places of base spans count too.
    """
    mine = F.transform(found, lambda s, j: F.struct(s[at].alias("at"), F.lit(1 if first else 0).alias("turn"), j.cast("int").alias("j")))
    theirs = F.transform(base, lambda b: F.struct(b[base_at].alias("at"), F.lit(0 if first else 1).alias("turn"), F.lit(-1).alias("j")))
    placed = F.transform(F.sort_array(F.concat(mine, theirs)), lambda x, i: F.struct(x["j"].alias("j"), (i - x["j"]).alias("n")))
    return F.transform(F.filter(placed, lambda x: x["j"] >= 0), lambda x: x["n"])


def untouched(found: Column, base: Column) -> Column:
    """Those of the spans ``found`` that overlap none of ``base``.

    The base spans that overlap a span are those that start before its end, less those that end by its start.
    """
    clear = F.zip_with(_ranks(found, "end", base, "start", False), _ranks(found, "start", base, "end", True), lambda a, b: a == b)
    kept = F.filter(F.zip_with(found, clear, lambda s, c: F.when(c, s)), lambda s: s.isNotNull())
    return F.when((F.size(found) > 0) & (F.size(base) > 0), kept).otherwise(found)


def _chosen(trees: list, threshold: float):
    """Whether a candidate's score reaches the threshold."""
    return lambda s: compiled(trees, s) >= threshold - 1e-9


def find_personal(docs: DataFrame, text_col: str = "text", model: dict | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``spans``: (kind, start, end, base), by kind and start; end exclusive, in code points.

    A column of the input called ``spans`` is replaced.
    """
    model = train(docs.sparkSession) if model is None else model
    text = "text"
    df = candidates(base_spans(packed(docs, text_col).withColumn(text, F.coalesce(text, F.lit(""))), text), text)
    named = lambda kind, base: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"))
    base_all = F.concat(*(F.transform(f"base_{k}", named(k, True)) for k in KINDS))
    df = df.withColumn("_pii_base", base_all)
    arrays = []
    for kind in ADDED:
        mine = F.filter("_pii_base", _of_kind(kind))
        if kind in GENERATORS and model[kind][1] < math.inf:
            trees, threshold = model[kind]
            df = df.withColumn(f"cand_{kind}", F.filter(f"cand_{kind}", _chosen(trees, threshold)))
            chosen = untouched(F.col(f"cand_{kind}"), F.col("_pii_base"))
            mine = F.sort_array(F.concat(mine, F.transform(chosen, named(kind, False))))  # by start, as the kind is one
        arrays.append(mine)
    kept = [c for c in docs.columns if c not in drop and c.lower() != "spans"]
    return df.select(*(F.col(f"doc.`{c}`") for c in kept), F.concat(*arrays).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans that overlap are replaced as one.

    Each span copies the text before it, so that time goes with spans times text.
    """
    found = find_personal(docs, text_col, model)
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out")))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done)).drop("spans")


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
