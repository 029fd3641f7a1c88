"""HTML extraction by a site style tree.

All pages of a host are merged into one tree of element paths (tag with class and id tokens, below each
other). For every path two entropies are measured over the host's m pages:

* presentation: how the child blocks of the element differ from page to page, -sum p log_m p;
* content: 1 - the mean entropy of its texts, where a text on n pages has entropy log n / log m; texts that stand
  in links for the most part count `LINKED` less.

A branch's importance is a mix of both, content taken over all texts in the branch. A host with few pages
says little, so its importance is shrunk towards that of the same path in the tree of all hosts, by
m / (m + `PRIOR`). Branches that are below `LEAST`, with all that is in them, are removed from
each page of the host. Markup is a prior of it: in <article> and <main> `MARKED` is added, so that near copies of an
article don't remove it, while what nearly all pages repeat goes there too; where a host's pages have these
elements, `OUTSIDE` is taken off all that stands beside them, by the share of pages that have them. A class or id that is
named for a menu, sidebar, notice, advert, comments and the like (its last word is: cookie-notice, but not notice-of-award)
takes off `NAMED`, one that only hints at it (another word, or share, related, search) `HINTED`.
What elements and roles state openly needs no statistics, because its text may differ on every page: <nav>, <footer>,
<aside>, <form>, <script> and their like, a <header> outside the article, and what is `hidden` are no article.

Pages of a host whose texts (those that are no open noise) are all equal count once, so that a copied article
doesn't look like boilerplate; in the tree of all hosts they count once over all hosts. Each page has one row,
its print and its evidence (path, kind, hash), and copies are merged before any shuffle. The evidence of distinct
pages is then summed before its shuffle, with the hash in the key, so that a host with a third of all pages is
no hot key. What comes back
to the pages is each host's list of branches to remove: sent to all tasks while it has at most `SENT` rows
(counted first), else joined by host, salted.

A path names its first `DEPTH` elements and has a hash for each of those below, which stands for an element with its
names. Elements more than `LEVELS` deep (far beyond what browsers' pages have) are told apart by one hash of all that
is between. Child sequences and long lists of names are hashed whole.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import table, written
from docloom.llm.urls import host_and_path

LEAST = 0.7
PRIOR = 100
#: Added to the importance of what stands in <article> or <main>, and taken off what stands beside them.
MARKED, OUTSIDE = 0.35, 0.35
GAMMA = 0.9
SENT = 100_000
SALT = 32
#: Taken off the content of texts in links, and off the importance of branches with a hinting or a telling name.
LINKED, HINTED, NAMED = 0.5, 0.2, 0.7
#: Levels of a path that are named, those that are told apart at all, and names of an element that are; the rest is hashed.
DEPTH, LEVELS, NAMES = 12, 128, 6

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE = frozenset("head script style noscript template title nav footer aside form iframe button select option textarea svg math canvas object embed dialog menu xmp noembed noframes".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs footer sidebar notice cookie cookies consent ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion "
    "comment comments disqus reply replies".split()
)
HINTS = frozenset("banner popup modal overlay newsletter subscribe subscription signup related recommended share sharing social widget login search pagination pager toolbar skip gdpr respond".split())
MAIN = frozenset(("article", "main"))
#: An opening tag closes these open ones.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

WORDS = re.compile("[a-z]+")
#: A quote opens a value only behind an equals sign.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]+|=)*+)(?:>|\Z)""")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*))?""")
#: In a path, an element that is named for what is no article.
TELLING = "!"


class Element:
    __slots__ = ("children", "depth", "last", "main", "noise", "path", "tag", "tail")

    def __init__(self, tag: str, up: Element | None, attributes: str):
        self.tag, self.children, self.last = tag, 0, ""
        inside = up is not None and up.main
        self.main = tag in MAIN or inside
        names, noise, telling = [], tag in NOISE or tag == "header" and not inside, False
        if attributes and tag not in ("html", "body"):
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "hidden":
                    noise = True
                elif name == "role":
                    noise |= value in NOISE_ROLES
                elif name in ("class", "id"):
                    for token in value.split():
                        words = WORDS.findall(token)
                        names += words
                        telling |= words[-1:] != [] and (words[-1] in NOISE_WORDS or words[-1] == "header" and not self.main)
        self.noise = noise or up is not None and up.noise
        self.depth = 0 if up is None else up.depth + 1
        names = sorted({*names})
        if len(names) > NAMES:
            hints = [x for x in names if x in HINTS or x in NOISE_WORDS][:1]
            names = [*names[:NAMES], f"~{zlib.crc32(' '.join(names).encode())}", *hints]
        own = ".".join([tag, *names, *([TELLING] if telling else [])])
        self.tail = 0 if self.depth < DEPTH else zlib.crc32(own.encode(), up.tail)
        if up is None:
            self.path = own
        elif self.depth < DEPTH:
            self.path = f"{up.path}/{own}"
        else:
            # The tail takes in all that is above; marks that the prior reads stay legible.
            kept = "".join(f".{x}" for x in (TELLING if telling else "", next((x for x in names if x in HINTS or x in NOISE_WORDS), "")) if x)
            level = f"{tag if tag in MAIN else ''}~{self.tail}{kept}"
            self.path = f"{up.path if self.depth < LEVELS else up.path.rsplit('/', 1)[0]}/{level}"

    def add(self, tag: str) -> None:
        """Count a child in: its tag, unless the one before has the same."""
        if tag != self.last:
            self.children, self.last = zlib.crc32(tag.encode(), self.children), tag


def blocks(page: str) -> tuple[list[tuple[Element, str, bool]], list[Element]]:
    """(element, text, whether most of it is in links) of every block that holds text, in page order, and all block elements."""
    root = Element("#", None, "")
    stack, out, elements, held = [root], [], [root], []
    inline_noise: list[str] = []  # open inline elements that hide their text

    link, in_links = False, 0

    def flush() -> None:
        nonlocal in_links
        if held:
            raw = "".join(held)
            text = " ".join(_html.unescape(raw).split())
            held.clear()
            if text:
                out.append((stack[-1], text, 2 * in_links > len(raw.strip())))
            in_links = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            if not inline_noise:
                held.append(page[at : lt if lt >= 0 else n])
                in_links += len(held[-1]) if link else 0
            if lt < 0:
                break
            at = lt
        m = TAG.match(page, at)
        if m is None:
            o = OTHER.match(page, at)
            if o is None:
                held.append("<")
                at += 1
            else:
                at = o.end()
            continue
        at = m.end()
        close, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in INLINE:
            if tag == "a":
                link = not close
            if tag == "br":
                held.append(" ")
            elif close:
                if inline_noise and tag in inline_noise:
                    del inline_noise[len(inline_noise) - 1 - inline_noise[::-1].index(tag) :]
            elif attributes and tag not in VOID and Element(tag, None, attributes).noise:
                inline_noise.append(tag)
            continue
        flush()
        inline_noise.clear()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        ends = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or stack[k].tag in ends:
                del stack[k:]
            elif not ends or stack[k].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "select"):
                break
            if len(stack) <= k:
                continue
        element = Element(tag, stack[-1], attributes)
        stack[-1].add(tag)
        elements.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
    flush()
    return out, elements


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def found_in(page: str) -> tuple[int, list[tuple[str, int, int]]]:
    """(print: hash of all texts, evidence: (path, kind, hash)) of a page. Kind 0: it has the path, 1: a child sequence, 2: a text, 3: a text
    in links; markup that is openly noise is left out."""
    texts, elements = blocks(page)
    found = set()
    for e in elements:
        if not e.noise:
            found.add((e.path, 0, 0))
            found.add((e.path, 1, e.children))
    own = [(e.path, 3 if linked else 2, _hash(t)) for e, t, linked in texts if not e.noise]
    found.update(own)
    return _hash(" ".join(str(h) for _, _, h in own)), sorted(found)


FOUND = "found array<struct<path: string, kind: int, hash: long>>"


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, print, found: one row for pages of a host with equal texts."""
    found_type = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [found_in(page or "") for page in batch.column(1).to_pylist()]
            rows = [[{"path": p, "kind": k, "hash": h} for p, k, h in found] for _, found in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in told], pa.int64()), pa.array(rows, found_type)], ["host", "print", "found"])

    found = pages.mapInArrow(run, f"host string, print long, {FOUND}")
    return found.groupBy("host", "print").agg(F.min("found").alias("found"))


def evidence(distinct: DataFrame, key: list[str]) -> DataFrame:
    """key, path, kind, hash, n (distinct pages)."""
    return distinct.select(*key, F.explode("found").alias("f")).groupBy(*key, "f.path", "f.kind", "f.hash").agg(F.count("*").alias("n"))


def branches(path: str) -> Column:
    """A path and all that lead to it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def importance(counts: DataFrame, key: list[str]) -> DataFrame:
    """key, path, m (pages), importance of each branch of each tree."""
    pages = counts.where("kind = 0").groupBy(*key, "path").agg(F.sum("n").alias("m"))
    # Most texts stand under a few paths, which would be hot keys of a shuffle join.
    pages = F.broadcast(pages) if pages.count() <= SENT else pages
    joined = counts.where("kind > 0").groupBy(*key, "path", "kind", "hash").agg(F.sum("n").alias("n")).join(pages, [*key, "path"])
    # log base m; on one page nothing can differ or repeat, which says nothing: no presentation, full content.
    base = F.log(F.greatest(F.col("m"), F.lit(2)))
    share = F.col("n") / F.col("m")
    entropy = F.when(F.col("kind") == 1, -share * F.log(share) / base)
    # A text on one page in links counts LINKED, one on all pages 1: what it holds beyond its repetition is worth less.
    repeated = F.when(F.col("kind") == 2, F.log("n") / base * F.col("n")).when(F.col("kind") == 3, (LINKED + (1 - LINKED) * F.log("n") / base) * F.col("n"))
    own = joined.groupBy(*key, "path", "m").agg(F.least(F.lit(1.0), F.coalesce(F.sum(entropy), F.lit(0.0))).alias("presentation"), F.coalesce(F.sum(repeated), F.lit(0.0)).alias("repeated"), F.coalesce(F.sum(F.when(F.col("kind") >= 2, F.col("n"))), F.lit(0)).alias("texts"))
    below = own.select(*key, F.explode(branches("path")).alias("path"), "repeated", "texts").groupBy(*key, "path").agg(F.sum("repeated").alias("repeated"), F.sum("texts").alias("texts"))
    both = own.select(*key, "path", "m", "presentation").join(below, [*key, "path"]).where("texts > 0")
    return both.select(*key, "path", "m", ((1 - GAMMA) * F.col("presentation") + GAMMA * (1 - F.col("repeated") / F.col("texts"))).alias("importance"))


def removals(pages: DataFrame) -> DataFrame:
    """host, path: branches of small importance, and of small importance all through: what wraps an article along with
    boilerplate stays. The root, html and body are no branches."""
    distinct = written(distinct_pages(pages), "distinct-pages")
    host = importance(written(evidence(distinct, ["host"]), "style-tree"), ["host"])
    once = distinct.groupBy("print").agg(F.min("found").alias("found"))
    every = importance(written(evidence(once, []), "style-tree"), []).select("path", F.col("importance").alias("overall"))
    weight = F.col("m") / (F.col("m") + PRIOR)
    # Many hosts share a path: paths are sent to all tasks while they are few, else each is there SALT times.
    every = written(every, "all-hosts")
    if every.count() <= SENT:
        joined = host.join(F.broadcast(every), "path", "left")
    else:
        salts = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = host.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALT)).cast("int")).join(salts, ["path", "salt"], "left")
    mixed = joined.withColumn("importance", weight * F.col("importance") + (1 - weight) * F.coalesce("overall", "importance"))
    main = F.exists(F.split("path", "/"), lambda t: F.regexp_extract(t, "^[^.~]*", 0).isin(*MAIN))
    # The share of a host's pages with a marked article: at most that of the commonest path to one.
    marked = host.where(F.split(F.element_at(F.split("path", "/"), -1), "[.~]")[0].isin(*MAIN)).groupBy("host").agg(F.max("m").alias("marked"))
    sizes = distinct.groupBy("host").agg(F.count("*").alias("size"))
    hosts = written(sizes.join(marked, "host").select("host", (F.col("marked") / F.col("size")).alias("share")), "hosts")
    mixed = mixed.join(F.broadcast(hosts) if hosts.count() <= SENT else hosts, "host", "left")
    words = F.split("path", r"[/.]")
    hinted, telling = F.exists(words, lambda t: t.isin(*HINTS, *NOISE_WORDS)), F.exists(words, lambda t: t == TELLING)
    prior = F.when(main, MARKED).otherwise(-OUTSIDE * F.coalesce("share", F.lit(0.0))) - F.when(telling, NAMED).when(hinted, HINTED).otherwise(0.0)
    scored = mixed.select("host", F.explode(branches("path")).alias("path"), (F.col("importance") + prior).alias("score"))
    return scored.groupBy("host", "path").agg(F.max("score").alias("score")).where((F.col("score") < LEAST) & ~F.col("path").rlike("^#(/html)?(/body)?$")).select("host", "path")


def article(page: str, removed: set[str]) -> str:
    """The texts of blocks that are no noise and in no removed branch, joined by line breaks."""
    gone: dict[str, bool] = {}

    def is_gone(path: str) -> bool:
        if path not in gone:
            at = len(path)
            while at > 0 and path[:at] not in removed:
                at = path.rfind("/", 0, at)
            gone[path] = at > 0
        return gone[path]

    return "\n".join(text for e, text, _ in blocks(page)[0] if not e.noise and not is_gone(e.path))


def extract(pages: DataFrame, html: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty pages have empty text. Pages whose URL is null or has no host form a tree of their own.
    Repeated rows each get their text; a null id stays null. Cut-off markup at the end of a page is dropped,
    cut-off text stays. Ties can't arise: branches are taken or left by a threshold. Other columns are not
    looked at.
    """
    spark = pages.sparkSession
    host, _ = host_and_path(F.col(url))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    gone = written(removals(rows.select("host", "html")), "removals")
    out = "page_id long, url string, text string, n_chars long"

    def texts(batch: pa.RecordBatch, removed: list[set[str]]) -> pa.RecordBatch:
        found = [article(h or "", r) for h, r in zip(batch.column(3).to_pylist(), removed, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if gone.count() <= SENT:
        by: dict[str, set[str]] = {}
        for r in gone.collect():  # at most SENT rows
            by.setdefault(r.host, set()).add(r.path)
        sent = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield texts(batch, [sent.value.get(h, set()) for h in batch.column(2).to_pylist()])

        return rows.mapInArrow(run, out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield texts(batch, [set(r or ()) for r in batch.column(4).to_pylist()])

    lists = gone.groupBy("host").agg(F.collect_list("path").alias("removed")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    return salted.join(lists, ["host", "salt"], "left").select("page_id", "url", "host", "html", "removed").mapInArrow(joined, out)


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_site_style_tree": op7_site_style_tree}
ORACLES: dict[str, str] = {}
