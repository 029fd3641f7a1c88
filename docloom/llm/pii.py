"""PII by candidate gradient boosting, in DataFrame functions throughout.

Base detectors find emails, IP addresses, card numbers and phone numbers by pattern and check. Next to them
three loose generators propose spans with high recall: addresses in disguise, runs of digits and marks, and
tokens that mix letters and digits, or upper and lower case, as keys and passwords do. Proposals overlap each
other and the base spans. Boosted trees score each from its format (length, digits, groups, marks, letters, lead)
and its context (the characters on both sides, a credential's name before it); proposals that score above a calibrated
threshold and touch no base span are added, tokens as kind `secret`.

Labels are weak, and not all proposals have one. Positive are those that overlap a checked base span, and tokens
that a credential's name is assigned (`password=`, `token = "`). Negative are numbers without a base span, and, without
such a name, tokens that are short, hex digests, UUIDs, or ordinary: every part between marks has one run of digits at
most (covid19, 2004-05-06, paths, versions). Addresses in disguise and other tokens have no label: these
the trees can add, by likeness. The trees don't see an at sign. So that they learn more than the names that labels come from,
a named token is also shown without its name: as positive if it is long and no ordinary one, but a hex key's alphabet
is hidden then, for hex without a name is a digest as a rule, which is shown as negative.

Features are small integers, so all labelled proposals of the corpus collapse to a table of feature cells with
counts, which a grouped sum builds over all rows; its size is bounded by the product of the features' ranges (at
most `MOST_CELLS` rows a half), whatever the corpus. Half of the documents' cells fit the trees, the other half
calibrate the threshold: the lowest score from which on at least `PRECISION` of the proposals are positive. The
model becomes a sum of CASE expressions.

Patterns use possessive repeats, which match the same (a character that ends a run can't continue it) but
take time in proportion to the text, and no stack for long runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import table

#: Kinds in their order with patterns. A local part or a number is only tried where its run begins.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z])[0-9+(](?:[\x20().+-]{0,2}[0-9]){0,40}+(?![0-9A-Za-z])",
    "token": r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*+[0-9])|(?=[A-Za-z_+/-]{16})(?=[a-z_+/-]*+[A-Z])(?=[A-Z_+/-]*+[a-z]))[A-Za-z0-9_+/-]{8,}+",
}
#: A text without these holds no span of any kind.
HINT = r"[0-9@]|[a-z][A-Z]|[(\[]at[)\]]"
#: Names of credentials, before an assignment and anywhere; hex digests and UUIDs; ordinary tokens.
NAMED = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\x22']?\s?[:=]\s?[\x22']?$"
NEAR = r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|key|auth|credentials?|bearer)(?![a-z])"
HEX = r"^(?:[0-9a-f]++|[0-9A-F]++|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})$"
ORDINARY = r"^[A-Za-z]*+[0-9]*+[A-Za-z]*+(?:[_+/-]++[A-Za-z]*+[0-9]*+[A-Za-z]*+)*+$"
#: Characters of a token that isn't short.
LONG = 16
ROUNDS, RATE, LEAVES = 24, 0.4, 1.0
PRECISION = 0.99
FEATURES = {"loose": 3, "size": 5, "digits": 5, "groups": 5, "marks": 4, "letters": 4, "lead": 3, "before": 4, "after": 4, "near": 3}
MOST_CELLS = math.prod(FEATURES.values())
#: Matches whose places are added up in one run.
RUN = 256


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>>: the leftmost non-overlapping matches; code points, end exclusive.

    Places are running sums of the lengths of matches and of the gaps before them. They are added up in runs of RUN
    matches, then over the runs, so that a text with very many matches takes little more than its share."""
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def paired(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        return F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda t, g: F.struct(g.alias("g"), t.alias("t")))

    def summed(pairs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            e = s + F.length(x["t"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def placed(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(RUN)), lambda i: summed(F.slice(pairs, i, F.lit(RUN))))
        return let(runs, moved)

    def moved(runs: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        at = F.aggregate(runs, begin, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, at, lambda r, a: F.transform(r["out"], lambda x: F.struct((x["s"] + a).alias("s"), (x["e"] + a).alias("e"), x["t"].alias("t")))))

    # Most texts have no match: they are looked through once.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(let(paired(f), placed)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct((i % 2).alias("odd"), F.substr(back, i, F.lit(1)).cast("int").alias("v")))
    total = F.aggregate(values, F.lit(0), lambda acc, x: acc + F.when(x["odd"] == 1, x["v"]).when(x["v"] > 4, x["v"] * 2 - 9).otherwise(x["v"] * 2))
    return total % 10 == 0


def checked(kind: str, t: Column) -> Column:
    d = digits_of(t)
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)).between(0, 255) & (F.length(F.regexp_replace(p, "^0+", "")) <= 3))
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def passes(kind: str) -> Callable[[Column], Column]:
    return lambda x: checked(kind, x["t"])


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with one column of checked spans for each kind."""
    out = docs.withColumn("__hint", F.col(text).rlike(HINT))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    for kind, pattern in KINDS.items():
        may = F.col("__hint") & (F.instr(text, "@") > 0 if kind == "email" else F.instr(text, "+") > 0 if kind == "phone" else F.lit(True))
        out = out.withColumn(f"__{kind}", F.when(may, F.filter(spans_of(F.col(text), pattern), passes(kind))).otherwise(none))
    return out


def proposals(docs: DataFrame, text: str) -> DataFrame:
    """docs with __loose: array of struct<s, e, kind, label, and the features> of loose spans. The label is 1, 0 or -1 (none)."""
    columns = []

    def by(n: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), F.lit(n).alias("loose"))

    for n, pattern in enumerate(LOOSE.values()):
        may = F.col("__hint") & (F.col(text).rlike(r"@|[(\[]at[)\]]") if n == 0 else F.lit(True))
        columns.append(F.when(may, F.transform(spans_of(F.col(text), pattern), by(n))).otherwise(F.array().cast("array<struct<s:int,e:int,t:string,loose:int>>")))

    def cut(c: Column, edges: tuple) -> Column:
        out = F.lit(len(edges))
        for k, e in reversed([*enumerate(edges)]):
            out = F.when(c < e, k).otherwise(out)
        return out

    def side(c: Column) -> Column:
        """0 none or white space, 1 a letter, 2 a digit, 3 a mark."""
        return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"[\p{L}]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)

    def features(x: Column, base: Column) -> Column:
        # An address is looked at as if it stood there undisguised.
        plain = F.regexp_replace(F.regexp_replace(x["t"], r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
        return let(F.when(x["loose"] == 0, plain).otherwise(x["t"]), lambda t: let(overlaps(x, base), lambda of_base: described(x, t, of_base)))

    def overlaps(x: Column, base: Column) -> Column:
        """Whether a base span meets x. Spans of a kind don't overlap, so both ends ascend: beyond a few, they are halved until the first that ends after x begins is found."""

        def among(spans: Column) -> Column:
            def step(acc: Column, _: Column) -> Column:
                mid = F.shiftright(acc["lo"] + acc["hi"], 1)
                return F.when(F.get(spans, mid)["e"] <= x["s"], F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

            n = F.size(spans)
            first = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n.cast("long")))), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda acc: acc["lo"])
            met = let(F.get(spans, first), lambda b: F.coalesce(b["s"] < x["e"], F.lit(False)))
            return F.when(n <= 8, F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))).otherwise(met)

        return reduce(lambda a, b: a | b, (among(base[k]) for k in KINDS))

    def described(x: Column, t: Column, of_base: Column) -> Column:
        d, token = F.length(digits_of(t)), x["loose"] == 2
        kind = F.when(x["loose"] == 0, "email").when(token, "secret").when(F.size(F.split(t, r"\.")) >= 3, "ip").when(t.rlike(r"^[+(]") | (d < 14), "phone").otherwise("card")
        before = lambda n: F.substr(F.col(text), F.greatest(x["s"] - n, F.lit(0)) + 1, F.least(x["s"], F.lit(n)))
        near = F.when(~token, 0).when(before(24).rlike(NAMED), 2).when(before(48).rlike(NEAR), 1).otherwise(0)
        shape = F.when(t.rlike(ORDINARY), 2).when(t.rlike(HEX), 1).otherwise(0)
        # How often a token turns between small letters, capitals and digits, beyond its parts between marks.
        turns = F.length(F.regexp_replace(t, "[a-z]++|[A-Z]++|[0-9]++|[^a-zA-Z0-9]++", "x")) - F.size(F.split(t, "[^a-zA-Z0-9]++")) * 2

        def told(near: Column, shape: Column) -> Column:
            weak = F.when(near == 2, 1).when((shape == 2) | (F.length(t) < LONG) | (shape == 1) & (near == 0), 0).otherwise(-1)
            label = F.when(of_base, 1).when(x["loose"] == 1, 0).when(x["loose"] == 0, -1).otherwise(weak)
            lead = F.when(token, shape).when(F.startswith(t, F.lit("+")) | F.startswith(t, F.lit("(")), 0).when(t.rlike("^[0-9]"), 1).otherwise(2)
            return F.struct(
                x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), of_base.alias("of_base"), label.alias("label"), x["loose"].alias("loose"),
                cut(F.length(t), (8, 12, LONG, 24)).alias("size"), cut(d, (2, 7, 10, 14)).alias("digits"),
                F.when(token, cut(turns, (2, 4, 7, 11))).otherwise(cut(F.size(F.split(t, "[^0-9]+")), (2, 3, 4, 5))).alias("groups"),
                cut(F.length(F.regexp_replace(t, r"[\p{L}0-9\x20@]", "")), (1, 2, 4)).alias("marks"),
                F.when(~t.rlike("[A-Za-z]"), 0).when(~t.rlike("[A-Z]"), 1).when(~t.rlike("[a-z]"), 2).otherwise(3).alias("letters"), lead.alias("lead"),
                side(F.when(x["s"] > 0, F.substr(F.col(text), x["s"], F.lit(1))).otherwise(F.lit(""))).alias("before"),
                side(F.substr(F.col(text), x["e"] + 1, F.lit(1))).alias("after"), near.alias("near"),
            )

        return let(F.struct(near.alias("near"), shape.alias("shape")), lambda v: told(v["near"], v["shape"]))

    # Base spans are bound once: a column that a lambda refers to may be worked out anew for each element.
    base = F.struct(*(F.col(f"__{k}").alias(k) for k in KINDS))
    return docs.withColumn("__loose", let(base, lambda base: F.transform(F.concat(*columns), lambda x: features(x, base))))


def fit(cells: list[tuple[tuple[int, ...], float, float]]) -> list[tuple[int, int, tuple, tuple]]:
    """Boosted trees of two levels on (features, positives, count) cells, for the logistic loss.

    A tree is (feature, bound, left, right): left where the feature is at most the bound; a side is
    (feature, bound, value left, value right)."""
    if not cells:
        return []
    x, (y, n) = np.array([c[0] for c in cells]), (np.array([c[k] for c in cells], float) for k in (1, 2))
    score, trees = np.zeros(len(cells)), []

    def split(part: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best = 0.0, 0, 10**6
        total_g, total_h = g[part].sum(), h[part].sum()
        for f, size in enumerate(FEATURES.values()):
            a, b = (np.cumsum(np.bincount(x[part, f], v[part], size))[:-1] for v in (g, h))
            gain = a * a / (b + LEAVES) + (total_g - a) ** 2 / (total_h - b + LEAVES) - total_g**2 / (total_h + LEAVES)
            v = int(gain.argmax())
            if gain[v] > best[0] + 1e-12:
                best = float(gain[v]), f, v
        return best[1:]

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g, h, sides = y - n * p, n * p * (1 - p), []
        f, v = split(np.arange(len(cells)), g, h)
        for part in (np.flatnonzero(x[:, f] <= v), np.flatnonzero(x[:, f] > v)):
            f2, v2 = split(part, g, h)
            values = []
            for inner in (part[x[part, f2] <= v2], part[x[part, f2] > v2]):
                values.append(float(RATE * g[inner].sum() / (h[inner].sum() + LEAVES)))
                score[inner] += values[-1]
            sides.append((f2, v2, *values))
        trees.append((f, v, *sides))
    return trees


def value(trees: list, x: tuple[int, ...]) -> float:
    total = 0.0
    for f, v, left, right in trees:
        f2, v2, a, b = left if x[f] <= v else right
        total += a if x[f2] <= v2 else b
    return total


def calibrated(trees: list, cells: list[tuple[tuple[int, ...], float, float]]) -> float:
    """The lowest score above which at least PRECISION of held-out proposals are positive, counted from the top down."""
    best, positives, count = math.inf, 0.0, 0.0
    ranked = sorted(((value(trees, x), y, n) for x, y, n in cells), reverse=True)
    for k, (s, y, n) in enumerate(ranked):
        positives, count = positives + y, count + n
        if positives >= PRECISION * count and (k + 1 == len(ranked) or ranked[k + 1][0] < s):
            best = s
    return best


def score_column(trees: list, x: Column) -> Column:
    names, out = [*FEATURES], F.lit(0.0)
    for f, v, *sides in trees:
        left, right = (F.when(x[names[f2]] <= v2, a).otherwise(b) for f2, v2, a, b in sides)
        out = out + F.when(x[names[f]] <= v, left).otherwise(right)
    return out


def train(rows: DataFrame) -> tuple[list, float]:
    """(trees, threshold) from all labelled proposals of all rows; at most 2 x MOST_CELLS cells are collected."""
    # Not explode: the optimizer would first ask whether the array has elements, and work it out twice for it.
    x = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.explode_outer("__loose").alias("x")).select("half", "x.*").where("label >= 0")
    # A named token is shown without its name too: see the module's docstring.
    named, long = (F.col("near") == 2) & ~F.col("of_base"), F.col("size") >= 3
    shown = lambda near, lead, label: F.struct(near.alias("near"), lead.alias("lead"), label.alias("label"))
    bare = F.when(named & long & (F.col("lead") < 2), shown(F.lit(0), F.lit(0), F.lit(1)))
    digest = F.when(named & (F.col("lead") == 1), shown(F.lit(0), F.lit(1), F.lit(0)))
    views = F.array_compact(F.array(shown(F.col("near"), F.col("lead"), F.col("label")), bare, digest))
    x = x.withColumn("v", F.explode(views)).withColumns({c: F.col(f"v.{c}") for c in ("near", "lead", "label")})
    cells = x.groupBy("half", *FEATURES).agg(F.sum(F.col("label").cast("double")).alias("y"), F.count("*").cast("double").alias("n")).collect()
    cells = sorted((r.half or 0, tuple(r[f] for f in FEATURES), r.y, r.n) for r in cells)
    trees = fit([c[1:] for c in cells if c[0] == 0])
    return trees, calibrated(trees, [c[1:] for c in cells if c[0] == 1])


def personal_data(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (checked base spans), n_added, n_secret (added ones of that kind), base, found for every row.

    base and found (base and added spans) are arrays of struct<s, kind_order, e, kind> in order. Null and empty
    texts have none. Repeated rows each get their spans; a null id stays null. Added spans of one document may
    overlap each other, not a base span. Columns other than id and text are not looked at.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = proposals(base_spans(rows, "__text"), "__text")
    trees, threshold = train(rows)
    order = {k: i for i, k in enumerate((*KINDS, "secret"))}

    def struct(x: Column, kind: Column, n: Column) -> Column:
        return F.struct(x["s"].alias("s"), n.alias("kind_order"), x["e"].alias("e"), kind.alias("kind"))

    def of(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda x: struct(x, F.lit(kind), F.lit(order[kind])))

    base = F.concat(*map(of, KINDS))
    number = F.create_map(*(F.lit(v) for kv in order.items() for v in kv))
    if trees and threshold < math.inf:
        # What a check refutes is not added: bare numbers, also as tokens without a letter or a name.
        may = lambda x: (x["loose"] == 0) | (x["loose"] == 1) & (x["kind"] == "phone") & (x["lead"] == 0) | (x["loose"] == 2) & ((x["letters"] > 0) | (x["near"] == 2))
        added = F.filter("__loose", lambda x: ~x["of_base"] & may(x) & (score_column(trees, x) >= threshold))
        added = F.transform(added, lambda x: struct(x, x["kind"], number[x["kind"]]))
    else:
        added = F.filter(base, lambda x: F.lit(False))
    out = rows.withColumn("__of_base", F.array_sort(base)).withColumn("__added", added)
    return out.select("doc_id", *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.size("__added").cast("long").alias("n_added"), F.size(F.filter("__added", lambda x: x["kind"] == "secret")).cast("long").alias("n_secret"), F.col("__of_base").alias("base"), F.array_sort(F.concat("__of_base", "__added")).alias("found"))


def redacted(docs: DataFrame, found: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with every span in `found` replaced by <kind>; overlapping spans become one, of the first one's kind."""
    rows = docs.join(found.select(F.col(id).alias("__id"), "found"), F.col(id).eqNullSafe(F.col("__id")), "left")

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]
        kept = F.substr(F.col(text), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit("<"), x["kind"], F.lit(">"))).alias("out"))

    whole = F.aggregate(F.coalesce("found", F.array().cast("array<struct<s:int,kind_order:int,e:int,kind:string>>")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, F.length(text))))
    return rows.withColumn(text, F.when(F.col(text).isNotNull(), whole)).select(*docs.columns)


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_out(F.col("found")).alias("spans"), "n_added", "n_secret", F.size("found").cast("long").alias("n_spans"))


QUERIES = {"op3_pii_boosting": op3_pii_boosting}
ORACLES: dict[str, str] = {}
