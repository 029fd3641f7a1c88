"""Facts of texts under rules: how well a text fits each distinct rule of a set of templates, and the value it yields.

Recognised texts repeat: headers, labels, genders, dates. The facts of the commonest texts of a bounded sample are worked
out beforehand and sent to the tasks; a block meets them by its text, and the facts of any other text are worked out in
its own row by compiled code. So blocks are read once and no text is shuffled, however many distinct ones there are; the
sample decides speed alone. On streams the texts known beforehand are those of a given table (`known_facts`).

`row_facts` is the same as a column of any text.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.rules import Reading, confidence, value
from docloom.functions.text import digits, let, n_words, once, trimmed_column

#: Blocks that are looked at for common texts, and how long such a text may be.
SAMPLE, LONGEST = 200_000, 200
#: Common texts that are sent to the tasks at most, and the share of the blocks looked at from which a text is common.
SENT_TEXTS = 50_000
HOT = 1e-5
FACTS = "array<struct<score:double,value:string>>"


class RuleBook:
    """The distinct rules of some templates, numbered from 0; number 0 is "no rule"."""

    def __init__(self, templates: list[dict]):
        self.rules: list[dict | None] = [None]
        self._numbers: dict[str, int] = {}
        for t in templates:
            for rule in (t["rules"] or {}).values():
                if rule:
                    self.number(rule)

    def number(self, rule: dict | None) -> int:
        if not rule:
            return 0
        key = json.dumps(rule, sort_keys=True, default=str)
        if key not in self._numbers:
            self._numbers[key] = len(self.rules)
            self.rules.append(rule)
        return self._numbers[key]

    def patterns(self) -> list[str]:
        return list(dict.fromkeys(p for r in self.rules for p in (r or {}).get("patterns") or ()))


def _facts(read: Reading, rules: list[dict | None]) -> Column:
    return F.array(*(F.struct(confidence(read, r).alias("score"), value(read, r).alias("value")) for r in rules))


def row_facts(text: Column, book: RuleBook) -> Column:
    """The facts of a text, in rule order, worked out in its row."""
    return let(trimmed_column(text), lambda t: _facts(Reading.of(t), book.rules))


def text_facts(texts: DataFrame, book: RuleBook, given: Column | None = None) -> DataFrame:
    """texts (column text, and others) with facts. Each pattern is searched once, whatever the number of rules that have it.
    Where `given` isn't null it tells the facts, and the text isn't looked at."""
    patterns = book.patterns()
    text = F.col("text") if given is None else F.when(given.isNull(), F.col("text"))
    rows = once(texts, "__t", trimmed_column(text))
    t = F.col("__t")
    shared = {"length": F.length(t), "n_words": n_words(t), "digits": digits(t), "upper": F.upper(t), "lower": F.lower(t)}
    shared |= {f"match{k}": t.rlike(f"(?i){p}") for k, p in enumerate(patterns)}
    rows = once(rows, "__r", F.struct(*(c.alias(n) for n, c in shared.items())))
    of = lambda n: F.col(f"__r.{n}")
    read = Reading(t, *(of(n) for n in ("length", "n_words", "digits", "upper", "lower")), lambda p: of(f"match{patterns.index(p)}"))
    found = _facts(read, book.rules)
    return rows.select(*texts.columns, (found if given is None else F.when(given.isNotNull(), given).otherwise(found)).alias("facts"))


def known_facts(texts: DataFrame, book: RuleBook) -> DataFrame | None:
    """text, facts of the commonest texts among the first SAMPLE of a table, read to the driver; None if no text comes twice there."""
    seen = texts.select(F.when(F.length("text") <= LONGEST, F.col("text")).alias("text")).limit(SAMPLE).collect()
    counts = Counter(r.text for r in seen if r.text is not None).most_common(SENT_TEXTS)
    common = [(t,) for t, n in counts if n >= max(2, HOT * len(seen))]
    return text_facts(texts.sparkSession.createDataFrame(common, "text string"), book) if common else None


def with_facts(blocks: DataFrame, book: RuleBook, known: DataFrame | None = None) -> DataFrame:
    """blocks (with a column text) and their facts, in their order; a null text has facts of its own (score 0, value null). `known`: what
    known_facts has found; a table's own texts where it isn't given."""
    if known is None and not blocks.isStreaming:
        known = known_facts(blocks, book)
    if known is None:
        return text_facts(blocks, book)
    met = blocks.join(F.broadcast(known.select("text", F.col("facts").alias("__f"))), "text", "left")
    return text_facts(met, book, F.col("__f")).select(*blocks.columns, "facts")
