"""URL filter against a plain evaluation of rules and list, and the cascade's exactness."""

import re

import duckdb

from docloom.llm import urls as U

URLS = [
    None, "", "no scheme", "http://", "http://x.net", "http://NET/", "https://a.B.net/x", "http://example.net/en/1", "http://a.example.net/en/", "http://a.example.net/enx", "http://example.com/de/3?x",
    "http://q.example.com/DE/", "http://badexample.com/de/", "http://x.org/fr/a#b", "http://org/fr/", "http://x.example.org?y=/fr/", "http://u:p@x.org:80/fr/", "http://spam-farm.example.org/en/1", "ftp://www.spam-farm.example.org",
    "http://notspam-farm.example.org/", "x://cheap-pills.example.com/de/1", "http://a.net/b://c", "http://É.net/ä", "http://x.com/a\nb?c", "http://..net//", "http://a..spam-farm.example.org/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    listed = any(host == k or host.endswith("." + k) for k in U.LISTED)
    return host, path, rule, verdict or ("block" if listed else "allow")


def table(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, verdict string")


def listed(spark):
    return spark.createDataFrame([(k,) for k in (*U.LISTED, None, U.LISTED[0])], "key string")


def test_rules_and_list(spark, monkeypatch):
    rows = [*enumerate(URLS), (None, "http://x.net/"), (3, "http://x.net/")]
    want = sorted(((i, *brute(u)) for i, u in rows), key=repr)
    pages = table(spark, rows)
    assert sorted((tuple(r) for r in U.filter_urls(pages, listed(spark)).collect()), key=repr) == want
    monkeypatch.setattr(U, "MOST_BITS", 128)
    assert U.parts_needed(U.marked_keys(listed(spark).where("key IS NOT NULL").distinct(), listed(spark))) == 3
    assert sorted((tuple(r) for r in U.filter_urls(pages, listed(spark)).collect()), key=repr) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(U.ORACLES["op8_bloom_cascade"]).fetchall(), key=repr) == want


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS_A_KEY", 2)  # many false positives, so several levels
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    some = keys.where("substr(key, 2) % 7 = 0").unionByName(spark.createDataFrame([("absent",)], "key string"))
    levels = U.cascade(U.marked_keys(keys, some))
    assert len(levels) > 2
    wrong = keys.where(U.is_listed(keys.key, levels) != (keys.key.substr(2, 9).cast("int") % 7 == 0))
    assert wrong.count() == 0


def test_empty(spark):
    assert U.filter_urls(table(spark, []), listed(spark)).collect() == []
    assert U.filter_urls(table(spark, [(1, "http://a.com/")]), listed(spark).limit(0)).collect()[0].verdict == "allow"
