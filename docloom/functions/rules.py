"""Extraction rules as data: a rule (a plain dict) becomes a column expression.

Zeros, empty strings, false and missing entries of a rule all mean "not set". Patterns are compiled once on
the driver; one that Java's regular expressions refuse is left out and reported by `bad_patterns`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, digits, if_plain, let, n_words, trimmed, trimmed_column


def _get(rule: dict | None, *path: str) -> Any:
    for key in path:
        rule = rule.get(key) if rule else None
    return rule or None


def bad_patterns(rules: dict[str, dict]) -> list[tuple[str, str]]:
    """(block type, pattern) of patterns that don't compile."""
    java = SparkSession.active()._jvm.java.util.regex.Pattern
    out = []
    for kind, rule in (rules or {}).items():
        for p in _get(rule, "patterns") or ():
            try:
                java.compile(p)
            except Exception:  # a Java PatternSyntaxException, wrapped
                out.append((kind, p))
    return out


def checked_rules(rules: dict[str, dict]) -> dict[str, dict]:
    """The rules without patterns that don't compile."""
    bad = set(bad_patterns(rules))
    return {k: r | {"patterns": [p for p in _get(r, "patterns") or () if (k, p) not in bad]} if _get(r, "patterns") else r for k, r in (rules or {}).items()}


class Reading:
    """What rules ask of a trimmed text. Columns may stand for expressions or for columns of a table in which they were worked out once."""

    def __init__(self, text: Column, length: Column, n_words: Column, digits: Column, upper: Column, lower: Column, match: Callable[[str], Column]):
        self.text, self.length, self.n_words, self.digits, self.upper, self.lower, self.match = text, length, n_words, digits, upper, lower, match

    @classmethod
    def of(cls, t: Column) -> Reading:
        return cls(t, F.length(t), n_words(t), digits(t), F.upper(t), F.lower(t), lambda p: t.rlike(f"(?i){p}"))


def rule_confidence(text: Column, rule: dict | None) -> Column:
    """How well a text fits a rule, 0 to 1; 0 for null and blank texts. Without a rule by length alone."""
    return let(trimmed(text), lambda t: confidence(Reading.of(t), rule))


def confidence(read: Reading, rule: dict | None) -> Column:
    t, length = read.text, read.length
    if not rule:
        score = F.when(length < 2, 0.1).when(length > 200, 0.3).otherwise(0.4)
        return F.when(F.coalesce(length, F.lit(0)) == 0, 0.0).otherwise(score)
    bonus = lambda name: float(_get(rule, "confidenceScoring", name) or 0)
    check = _get(rule, "validation") or {}
    total = F.lit(bonus("baseScore") or 0.5)
    patterns = _get(rule, "patterns") or ()
    matched = F.lit(False)
    for p in patterns:
        matched = matched | read.match(p)
    n_words, n_digits = read.n_words, F.length(read.digits)

    def add(value: float, when: Column) -> None:
        nonlocal total
        if value:
            total = total + F.when(when, value).otherwise(0.0)

    if patterns:
        add(bonus("patternMatchBonus"), matched)
    for name, count in (("wordCountBonus", n_words), ("digitCountBonus", n_digits)):
        table = {k: float(v) for k, v in (_get(rule, "confidenceScoring", name) or {}).items() if v}
        if table:
            found = F.lit(0.0)
            for k, v in table.items():
                found = F.when(count.cast("string") == k, v).otherwise(found)
            total = total + found
    if check.get("allowedValues"):
        add(bonus("exactMatchBonus"), read.upper.isin(*(v.upper() for v in check["allowedValues"])))
    if check.get("mustContain") is not None:
        every = F.lit(True)
        for k in check["mustContain"]:
            every = every & F.contains(read.lower, F.lit(k.lower()))
        add(bonus("keywordMatchBonus"), every)
    add(bonus("lengthBonus"), length >= (check.get("minLength") or 0))
    add(bonus("allCapsBonus"), (t == read.upper) & t.rlike("[A-Z]"))
    add(bonus("commaBonus"), F.contains(t, F.lit(",")))
    add(bonus("dateFormatBonus"), t.rlike(r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}"))
    add(bonus("formatMatchBonus"), matched)
    if check:
        ok = F.lit(True)
        for name, test in (("minWords", lambda v: n_words >= v), ("maxWords", lambda v: n_words <= v), ("minLength", lambda v: length >= v), ("maxLength", lambda v: length <= v), ("length", lambda v: n_digits == v)):
            if check.get(name):
                ok = ok & test(check[name])
        add(bonus("validationPassBonus"), ok)
    return F.when(F.coalesce(length, F.lit(0)) == 0, 0.0).otherwise(F.least(total, F.lit(1.0)))


def _groups(pattern: str) -> int:
    return int(SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount())


def _captured(t: Column, pattern: str, strategy: dict) -> Column:
    """The value that a matching pattern yields; t itself where the strategy yields none."""
    n = _groups(pattern)
    group = lambda k: F.regexp_extract(t, f"(?i){pattern}", k)
    full, kind, joint = group(0), strategy.get("type"), strategy.get("groupSeparator")
    if kind == "singleCapture":
        first = group(1) if n else F.lit("")
        out = F.when(first != "", first).otherwise(full if strategy.get("fallbackToFullMatch") else t)
        if strategy.get("cleanAlphabetic"):
            alphabetic = F.filter(F.split(out, f"{SPACE}+"), lambda w: w.rlike("^[A-Za-z]+$"))
            out = F.when(F.size(alphabetic) >= 2, F.array_join(alphabetic, " ")).otherwise(out)
        return out
    if kind != "multiCapture":
        return full
    if strategy.get("fallbackToDigitsOnly"):
        d, length = digits(t), strategy.get("formatLength")
        other = d
        if length:
            cut = lambda k: math.floor(length / 3 * k)  # noqa: E731  fractional ends are cut down
            parts = F.array(F.substring(d, 1, cut(1)), F.substring(d, cut(1) + 1, cut(2) - cut(1)), F.substring(d, cut(2) + 1, length))
            other = F.when(F.length(d) == length, F.array_join(parts, joint or " ")).otherwise(d)
    else:
        other = full if strategy.get("fallbackToFullMatch") else t
    combine = strategy.get("combineGroups")
    if combine in ("spaceDelimited", "dateFormat") and n >= 3:
        three = [group(k) for k in (1, 2, 3)]
        return F.when((three[0] != "") & (three[1] != "") & (three[2] != ""), F.concat_ws(joint or (" " if combine == "spaceDelimited" else "/"), *three)).otherwise(other)
    if combine == "concatenate" and n >= 2:
        return F.array_join(F.filter(F.array(*(group(k) for k in range(1, n + 1))), lambda g: g != ""), joint or "")
    return other


def capitalized(text: Column) -> Column:
    """Each word's first letter in upper case, the rest as it is. Only a text with a word in lower case is taken apart."""
    pieces = F.split(text, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    whole = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), "")
    return F.when(text.rlike("(?<![A-Za-z0-9_])[a-z]"), whole).otherwise(text)


def rule_extract(text: Column, rule: dict | None) -> Column:
    """The value of a text under a rule: capture by the first matching pattern, then post-processing in a fixed order. Null stays null."""
    return let(trimmed(text), lambda t: value(Reading.of(t), rule))


def value(read: Reading, rule: dict | None) -> Column:
    t = out = read.text
    if not rule:
        return t
    strategy = _get(rule, "extractionStrategy")
    if strategy:
        for p in reversed(_get(rule, "patterns") or []):
            out = F.when(read.match(p), _captured(t, p, strategy)).otherwise(out)
    for step in _steps(_get(rule, "postProcess") or {}):
        out = let(out, step)
    return F.when(t == "", t).otherwise(out)


def _single_spaces(v: Column) -> Column:
    return if_plain(v, F.regexp_replace(v, " +", " "), F.regexp_replace(v, f"{SPACE}+", " "))


def _cleaned(v: Column) -> Column:
    """Single spaces, and letters, digits and a few signs alone. Most texts are so already, and a search is far cheaper than replacements."""
    clean = let(F.regexp_replace(_single_spaces(v), r"[^A-Za-z0-9_\s.,\-/]", ""), trimmed_column)
    return F.when(v.rlike(r"^ | $|  |[^A-Za-z0-9_ .,\-/]"), clean).otherwise(v)


def _steps(post: dict) -> list[Callable[[Column], Column]]:
    """Post-processing in its fixed order."""
    steps: list[Callable[[Column], Column]] = []

    def noise(word: str) -> Callable[[Column], Column]:
        return lambda v: trimmed(F.regexp_replace(v, rf"(?i)\b{word}\b", ""))

    def normal(v: Column) -> Column:
        out = v
        for key, value in post["normalize"].items():
            if value:
                out = F.when(F.upper(v) == key, value).otherwise(out)
        return out

    def cut(v: Column, joint: str, *sizes: int) -> Column:
        ends = [sum(sizes[:k]) for k in range(len(sizes))]
        return let(digits(v), lambda d: F.when(F.length(d) == sum(sizes), F.concat_ws(joint, *(F.substring(d, e + 1, n) for e, n in zip(ends, sizes, strict=True)))).otherwise(v))

    steps += [noise(w) for w in post.get("removeNoiseWords") or ()]
    if post.get("normalize"):
        steps.append(normal)
    if post.get("standardize"):
        steps.append(lambda v: F.when(v.isNotNull(), post["standardize"]))
    if post.get("format") == "XXXX XXXX XXXX":
        steps.append(lambda v: cut(v, " ", 4, 4, 4))
    if post.get("convertEightDigits"):
        steps.append(lambda v: cut(v, "/", 2, 2, 4))
    if post.get("capitalizeEachWord"):
        steps.append(capitalized)
    if post.get("cleanText"):
        steps.append(_cleaned)
    if post.get("removeExtraSpaces"):
        steps.append(lambda v: let(_single_spaces(v), trimmed_column))
    if post.get("removeSpaces"):
        steps.append(lambda v: if_plain(v, F.replace(v, F.lit(" "), F.lit("")), F.regexp_replace(v, SPACE, "")))
    return steps
