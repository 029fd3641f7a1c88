"""URL filters: prefix rules, then exact membership in a block list by a Bloom filter cascade.

A URL's keys are its host and every parent domain. The universe is the set of all keys in the corpus. Level
1 of the cascade encodes the listed keys of the universe; level 2 those other keys of the universe that pass
level 1; level 3 the listed keys that pass level 2, and so on until nothing passes wrongly. A key of the
universe is listed exactly if the first level that it fails has an even number. So membership is a bit test
in each row, without a join, and without an error.

All steps are DataFrame functions. A level's bits are gathered by a grouped bit_or into words of 64 bits and
become a binary literal of the expression. A level takes `BITS_A_KEY` bits a key; where one would exceed
`MOST_BITS`, the universe is split by a hash of the key into parts with a cascade each, and the rows are
tested against one part after the other, so that what is sent to a task stays bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import table, written

#: Rules as host, path and verdict; the names of a block list as pages of the corpus use them.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED = tuple(f"{name}.example.{tld}" for name in ("spam-farm", "cheap-pills", "free-bets", "casino-win", "adult-x", "ads-track") for tld in ("com", "net", "org"))
BITS_A_KEY = 12
HASHES = 4
MOST_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column) -> Column:
    """A host and its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def spots(key: Column, bits: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), F.lit(bits)) for k in range(HASHES)]


def has(key: Column, data: bytes, level: int) -> Column:
    """Whether a level's filter has a key: all its bits are set in the literal."""
    filter, ok = F.lit(data), F.lit(True)
    for p in spots(key, len(data) * 8, level):
        byte = F.conv(F.hex(F.substr(filter, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        ok = ok & (F.getbit(byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return ok


def encode(keys: DataFrame, count: int, level: int) -> bytes:
    """The filter of a level. Its words, a row each, number at most MOST_BITS / 64."""
    bits = 1 << max(7, math.ceil(math.log2(count * BITS_A_KEY)))
    words = keys.select(F.explode(F.array(*spots(F.col("key"), bits, level))).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("b"))
    out = bytearray(bits // 8)
    for w, b in words.collect():
        out[w * 8 : w * 8 + 8] = (b & (1 << 64) - 1).to_bytes(8, "little")
    return bytes(out)


def marked_keys(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """The universe of distinct keys with is_listed."""
    return written(universe.join(listed.select("key", F.lit(True).alias("is_listed")).distinct(), "key", "left").select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed")), "keys")


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))


def parts_needed(marked: DataFrame) -> int:
    """How many cascades keep every level within MOST_BITS: level 1 holds the listed keys, level 2 the share of the others that passes it wrongly; those after are smaller."""
    n = marked.agg(F.count_if("is_listed").alias("inside"), F.count_if(~F.col("is_listed")).alias("outside")).first()
    wrong = (1 - math.exp(-HASHES / BITS_A_KEY)) ** HASHES
    # Parts differ in size: a quarter of the bound is left for that.
    return max(1, math.ceil(max(n.inside, n.outside * wrong) * BITS_A_KEY / (MOST_BITS * 0.75)))


def cascade(marked: DataFrame) -> list[bytes]:
    """Levels over keys with is_listed."""
    inside, outside = marked.where("is_listed").select("key"), marked.where("NOT is_listed").select("key")
    levels: list[bytes] = []
    while n := inside.count():
        levels.append(encode(inside, n, len(levels)))
        inside, outside = outside.where(has(F.col("key"), levels[-1], len(levels) - 1)), inside
    return levels


def is_listed(key: Column, levels: list[bytes]) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels) - 1, -1, -1):
        out = F.when(~has(key, levels[level], level), F.lit(level % 2 == 1)).otherwise(out)
    return out


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, url: str = "url", id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages. `listed`: a table of keys (hosts or domains), column `key`.

    A URL that is null or has no :// has empty host and path, no keys, and is allowed. Null keys of the list
    count for nothing. Repeated rows get the same verdict each; a null id stays null. Other columns are not
    looked at. Of rules of one length at most one fits a URL, unless they are repeated with two verdicts: then
    the verdict that sorts last wins.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = rows.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    listed = listed.where("key IS NOT NULL").select("key")
    marked = marked_keys(universe, listed)
    parts, rows = parts_needed(marked), rows.withColumn("blocked", F.lit(False))
    for part in range(parts):
        mine = lambda k, part=part: part_of(k, parts) == part
        levels = cascade(marked.where(mine(F.col("key"))) if parts > 1 else marked)
        if not levels:
            continue
        met = F.exists(keys_of(F.col("host")), lambda k: mine(k) & is_listed(k, levels) if parts > 1 else is_listed(k, levels))
        rows = rows.withColumn("blocked", F.col("blocked") | met)
        if part + 1 < parts:  # a plan carries one part's levels only
            rows = written(rows, "judged")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return filter_urls(table(spark, sf_dir, "pages"), listed)


_KEYS = ", ".join(f"'{k}'" for k in LISTED)
QUERIES = {"op8_bloom_cascade": op8_bloom_cascade}
ORACLES = {
    "op8_bloom_cascade": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
), listed AS (SELECT unnest([{_KEYS}]) AS k)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN EXISTS (SELECT 1 FROM listed WHERE host = k OR ends_with(host, '.' || k)) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
}
