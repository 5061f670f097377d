"""Personal data in the notes of safety signals: pattern spans, and boosted trees over high-recall candidates.

Everything is DataFrame expressions and MLlib; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import content, fresh

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive repeats and the look-behind at a run's first character keep matching linear in the text; they
#: find what the plain patterns find, leftmost and without overlap.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidate generators: wider forms of each kind, overlapping one another and the base spans.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++[\x20]?(?:@|[(\[]at[)\]])[\x20]?[a-z0-9-]++(?:[\x20]?(?:\.|[(\[]dot[)\]])[\x20]?[a-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|[(\[]dot[)\]])[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){13,18}+(?![0-9])",
    "phone": r"(?<![0-9+])[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){8,14}+(?![0-9])",
}
#: Cheap signs without which no pattern of the kind fits.
BASE_SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
WIDE_SIGN = {"email": r"@|[(\[][Aa][Tt][)\]]", "ip": r"[0-9](?:\.|\[|\()", "card": "[0-9](?s:.){12}", "phone": "[0-9](?s:.){7}"}
BEFORE, STEP = 24, 256
FEATURES = ("length", "digits", "groups", "longest", "separators", "plus", "parens", "dots", "luhn", "octets", "at", "words",
            "glued", "cue_phone", "cue_card", "cue_ip", "cue_mail", "letters", "date")
_CUES = {"cue_phone": r"(?i)\b(tel|phone|call|mobile|fax|reach|contact)\w*\W{0,3}((me|us|on|at|is|no|nr)\W{1,3}){0,2}$",
         "cue_card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay)\w*\W{0,3}((no|nr|number|is|with)\W{1,3}){0,2}$",
         "cue_ip": r"(?i)\b(ip|address|host|server|login|from)\W{0,3}(is|at)?\W{0,3}$",
         "cue_mail": r"(?i)\b(e-?mail|mail|write|contact|reach)\w*\W{0,3}((me|us|to|at|is)\W{1,3}){0,2}$"}


def _blocks(sizes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STEP).cast("int")), lambda b: F.slice(sizes, b * STEP + 1, STEP))


def _running(blocks: str, totals: str) -> Column:
    """Sums of all entries up to each one; blocks of entries with known totals keep long arrays near linear."""
    return F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda _, i: F.aggregate(
        F.concat(F.slice(totals, 1, k), F.slice(b, 1, i + 1)), F.lit(0), lambda a, x: a + x))))


def _with_matches(df: DataFrame, text: Column, patterns: dict[str, str], signs: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Adds, per kind, array<struct<begin, end, said, before, after>> of all matches; code points, end exclusive. Returns the names.

    What matched and what stood between are columns of their own: an expression used inside a lambda would run per element.
    """
    said, gaps, sums, found = ({k: fresh(df, f"{stem}_{k}") for k in patterns} for stem in ("said", "gaps", "sums", "found"))
    none, none_found = F.array().cast("array<string>"), F.array().cast("array<struct<begin:int,end:int,said:string,before:string,after:string>>")
    df = df.withColumns({said[k]: F.when(text.rlike(signs[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    df = df.withColumns({gaps[k]: F.when(F.size(said[k]) > 0, F.split(text, p, -1)).otherwise(none) for k, p in patterns.items()})
    blocks, totals = ({k: fresh(df, f"{stem}_{k}") for k in patterns} for stem in ("blocks", "totals"))
    df = df.withColumns({sums[k]: F.flatten(F.zip_with(F.slice(gaps[k], 1, F.size(said[k])), said[k], lambda g, s: F.array(F.length(g), F.length(s)))) for k in patterns})
    df = df.withColumns({blocks[k]: F.when(F.size(said[k]) > 0, _blocks(F.col(sums[k]))) for k in patterns})
    df = df.withColumns({totals[k]: F.transform(blocks[k], lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)) for k in patterns})
    df = df.withColumns({sums[k]: _running(blocks[k], totals[k]) for k in patterns})

    def placed(k: str) -> Column:
        return F.transform(said[k], lambda s, i: F.struct(
            F.get(sums[k], i * 2).alias("begin"), F.get(sums[k], i * 2 + 1).alias("end"), s.alias("said"),
            F.right(F.get(gaps[k], i), F.lit(BEFORE)).alias("before"), F.substring(F.get(gaps[k], i + 1), 1, 1).alias("after")))

    df = df.withColumns({found[k]: F.when(F.size(said[k]) > 0, placed(k)).otherwise(none_found) for k in patterns})
    return df.drop(*said.values(), *gaps.values(), *sums.values(), *blocks.values(), *totals.values()), found


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _valid(kind: str, said: Column) -> Column:
    """The check that a base match of the kind has to pass."""
    if kind == "ip":
        # leading zeros do not change a part's value; a part of over three digits without them is too large
        return F.forall(F.split(said, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]|[0-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(said)).between(14, 19) & F.call_function("luhn_check", _digits(said))
    if kind == "phone":
        return F.length(_digits(said)).between(10, 15)
    return F.lit(True)


def features(said: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate, as doubles in the order of FEATURES."""
    digits, runs = _digits(said), F.filter(F.split(said, "[^0-9]+"), lambda r: r != "")
    number = lambda c: c.cast("double")
    made = {
        "length": F.length(said), "digits": F.length(digits), "groups": F.size(runs),
        "longest": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)),
        "separators": F.size(F.array_distinct(F.split(F.regexp_replace(said, "[0-9A-Za-z]", ""), ""))),
        "plus": said.startswith("+"), "parens": said.contains("("), "dots": F.length(said) - F.length(F.replace(said, F.lit("."), F.lit(""))),
        "luhn": F.coalesce(F.call_function("luhn_check", digits), F.lit(False)),
        "octets": F.size(F.filter(runs, lambda r: r.rlike("^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))),
        "at": said.rlike(r"(?i)@|[(\[]at[)\]]"), "words": said.rlike(r"(?i)[(\[](at|dot)[)\]]|\[\.\]"),
        "glued": before.rlike("[A-Za-z0-9_=/#]$") | after.rlike("^[A-Za-z0-9_=/]"),
        **{name: before.rlike(p) for name, p in _CUES.items()},
        "letters": F.length(F.regexp_replace(said, "[^A-Za-z]", "")), "date": said.rlike(r"^(19|20)[0-9]{2}[-./][01]?[0-9][-./][0-3]?[0-9]|^[0-3]?[0-9][-./][01]?[0-9][-./](19|20)[0-9]{2}"),
    }
    return {name: number(made[name]) for name in FEATURES}


def labelled_forms(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """Training rows (kind, said, before, after, label) in known forms, a quarter of each kind; no table labels personal data.

    Positive: e-mail addresses with spelled-out signs, bracketed ip addresses, card numbers with a check digit, phone numbers in
    groups after a cue. Negative: dates, versions, order and serial numbers, amounts, decimals, failing checks, glued numbers.
    """
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    digits = lambda n, salt: F.lpad(pick(10**n, salt).cast("string"), n, "0")
    one_of = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (pick(len(values), salt) + 1).cast("int"))
    word = lambda salt: F.substring(F.regexp_replace(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256), "[0-9]", ""), 1, 6)
    body = F.concat(F.lit("4"), digits(7, "c1"), digits(7, "c2"))
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda c: F.call_function("luhn_check", c)), 1)
    sep = one_of([".", "/", " - ", "_"], "sep")
    spaced = lambda c: F.concat_ws("", F.substring(c, 1, 4), sep, F.substring(c, 5, 4), sep, F.substring(c, 9, 4), sep, F.substring(c, 13, 4))
    octet = lambda salt: pick(256, salt).cast("string")
    dot = one_of(["[.]", "[dot]", "(dot)"], "dot")
    # every digit string stays between 10 and 15 digits, as in the base rule
    phone = F.concat(F.lit("("), digits(3, "p1"), one_of([") ", ")-", ")"], "ps"), digits(3, "p2"), one_of(["-", " ", "."], "pt"), digits(4, "p3"))
    positive = {
        "email": F.concat(word("a"), F.lit("."), digits(2, "e"), one_of([" (at) ", "[at]", "(at)", " @ "], "at"), word("b"), one_of([".", "[dot]", " (dot) "], "d2"), one_of(["com", "org", "net"], "tld")),
        "ip": F.concat(octet("i1"), dot, octet("i2"), dot, octet("i3"), dot, octet("i4")),
        "card": spaced(check), "phone": phone,
    }
    negative = {
        "email": one_of(["is @ the.end", "look @ a.b", "v@1.2", "x@y.3"], "ne"),
        "ip": F.concat(pick(3, "n1").cast("string"), F.lit("."), pick(900, "n2") + 256, F.lit("."), pick(40, "n3").cast("string"), F.lit("."), digits(3, "n4")),
        "card": F.when(pick(3, "n5") == 0, F.concat(F.lit("20"), digits(2, "y"), F.lit("-0"), pick(9, "m") + 1, F.lit("-1"), pick(9, "d"), F.lit(" "), digits(8, "t")))
        .otherwise(spaced(F.concat(body, F.pmod(F.element_at(F.split(check, ""), 16).cast("int") + 1, F.lit(10)).cast("string")))),
        "phone": F.when(pick(4, "n6") == 0, F.concat(F.lit("20"), digits(2, "y"), F.lit("-0"), pick(9, "m") + 1, F.lit("-1"), pick(9, "d"), F.lit(" "), digits(2, "h")))
        .when(pick(4, "n6") == 1, digits(12, "s")).when(pick(4, "n6") == 2, F.concat(digits(3, "v"), F.lit("."), digits(7, "w"))).otherwise(phone),
    }
    cue = {"email": ["mail me: ", "contact "], "ip": ["login from ", "ip "], "card": ["card no ", "visa "], "phone": ["call me at ", "tel. ", "phone: "]}
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("id") % 4 + 1).cast("int"))
    case = lambda values: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in values.items()])
    rows_ = spark.range(rows).withColumn("kind", kind).withColumn("label", (pick(2, "label") == 1).cast("double"))
    plain = one_of(["of ", "order ", "the ", "=", "id "], "plain")
    return rows_.select(
        "id", "kind", "label", F.when(F.col("label") == 1, case(positive)).otherwise(case(negative)).alias("said"),
        F.when(F.col("label") == 1, case({k: one_of(v, "cue") for k, v in cue.items()})).otherwise(plain).alias("before"),
        F.when((F.col("label") == 0) & (pick(5, "after") == 0), "x").otherwise(" ").alias("after"))


def fit_trees(spark: SparkSession, rows: int = 8000, trees: int = 10, depth: int = 3, precision: float = 0.99, seed: int = 7):
    """Boosted trees over `rows` labelled forms, and per kind the lowest score that keeps held-out precision.

    Three quarters train, a quarter calibrates. Returns (score, thresholds): score maps an array of FEATURES to a probability
    expression, so that trees are plain CASE expressions in the plan. All sizes are parameters and do not grow with the data.
    """
    forms = labelled_forms(spark, rows, seed).coalesce(2)
    made = features(F.col("said"), F.col("before"), F.col("after"))
    frame = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(forms.select("id", "kind", "label", *[c.alias(n) for n, c in made.items()])).cache()
    model = GBTClassifier(featuresCol="v", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(frame.where("id % 16 < 12"))

    def expression(node, values: Column) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction())
        split = node.split()
        return F.when(F.get(values, F.lit(split.featureIndex())) <= split.threshold(), expression(node.leftChild(), values)) \
            .otherwise(expression(node.rightChild(), values))

    roots = [(w, t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]

    def score(values: Column) -> Column:
        margin = sum((expression(root, values) * w for w, root in roots), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    held = frame.where("id % 16 >= 12").select("kind", "label", (F.floor(score(F.array(*FEATURES)) * 1000) / 1000).alias("p")).groupBy("kind", "p").agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    thresholds = {k: math.inf for k in KINDS}
    for kind in KINDS:                                   # at most 1001 rounded scores a kind
        y = n = 0
        for row in sorted((r for r in held.collect() if r.kind == kind), key=lambda r: -r.p):
            y, n = y + row.y, n + row.n
            if y < precision * n:
                break
            thresholds[kind] = row.p
    frame.unpersist()
    return score, thresholds


def find_private(signals: DataFrame, note: str = "note", **fit) -> DataFrame:
    """Safety signals with the personal data in their notes: `base` and `spans`, array<struct<begin, kind, end>>, both sorted.

    Base spans are the patterns' matches that pass their check. Wider candidates of the same kinds are scored by boosted trees
    on their format and context, and join `spans` when they reach their kind's threshold and overlap no base span; of
    candidates that overlap each other the better one stays (then the earlier, then the longer); one that only a dropped one overlaps stays too. `kind` is the index in KINDS.

    Every row and every column stay; columns named base or spans are replaced. NULL and empty notes have no spans. Rows are independent
    of each other, so ties, repeated rows and NULL ids need no rule. Nothing is shuffled. `fit` goes to fit_trees.
    """
    score, thresholds = fit_trees(signals.sparkSession, **fit)
    text, wide, scored = F.col(fresh(signals, "text")), fresh(signals, "wide"), fresh(signals, "scored")
    text_name = fresh(signals, "text")
    out, kept = _with_matches(signals.withColumn(text_name, content(note)), text, BASE, BASE_SIGN)

    def checked(i: int, k: str) -> Column:
        return F.transform(F.filter(kept[k], lambda m: _valid(k, m["said"])),
                           lambda m: F.struct(m["begin"].alias("begin"), F.lit(i).alias("kind"), m["end"].alias("end")))

    out = out.withColumn("base", F.array_sort(F.concat(*[checked(i, k) for i, k in enumerate(KINDS)]))).drop(*kept.values())
    out, names = _with_matches(out, text, WIDE, WIDE_SIGN)

    def candidates(i: int, k: str) -> Column:
        new = F.filter(F.col(names[k]), lambda m: ~F.exists(F.col("base"), lambda b: (b["begin"] < m["end"]) & (m["begin"] < b["end"])))
        return F.transform(new, lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), F.lit(i).alias("kind"),
                                                   F.array(*features(m["said"], m["before"], m["after"]).values()).alias("f")))

    out = out.withColumn(wide, F.concat(*[candidates(i, k) for i, k in enumerate(KINDS)]))
    limits = F.array(*[F.lit(float(thresholds[k])) for k in KINDS])
    out = out.withColumn(scored, F.filter(F.transform(wide, lambda c: F.struct(
        F.negate(score(c["f"])).alias("worse"), c["begin"].alias("begin"), F.negate(c["end"]).alias("back"), c["kind"].alias("kind"))),
        lambda c: F.negate(c["worse"]) >= F.get(limits, c["kind"])))
    best = disjoint(F.col(scored))
    added = F.transform(best, lambda c: F.struct(c["begin"].alias("begin"), c["kind"].alias("kind"), F.negate(c["back"]).alias("end")))
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base"), added))).drop(text_name, wide, scored, *names.values())


def disjoint(scored: Column) -> Column:
    """Of candidates (worse, begin, back, kind) the best one, then the best that overlaps none chosen so far, and so on."""
    none = F.filter(scored, lambda c: F.lit(False))
    meets = lambda a, b: (a["begin"] < F.negate(b["back"])) & (b["begin"] < F.negate(a["back"]))
    return F.aggregate(F.array_sort(scored), none, lambda chosen, c: F.when(F.exists(chosen, lambda o: meets(o, c)), chosen).otherwise(F.concat(chosen, F.array(c))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def spelled(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redact(signals: DataFrame, note: str = "note", spans: str = "spans") -> DataFrame:
    """Notes with every span replaced by `[kind]`; of overlapping spans the earlier one is replaced, the rest of the later one too."""
    kinds, text = F.array(*[F.lit(k) for k in KINDS]), content(note)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["begin"] >= a["at"], F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["begin"] - a["at"]), F.concat(F.lit("["), F.get(kinds, s["kind"]), F.lit("]")))))
        .otherwise(a["out"]).alias("out")), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, 2**31 - 1)))
    return signals.withColumn(note, done)
