"""N-gram Jaccard join by universe partition and pigeonhole.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.8. For such
sets r, s the symmetric difference has at most (|r| + |s|) / 9 elements. Sizes fall into bands a factor of
1.25 wide, so linked sets lie in the same or in neighbouring bands; scheme k serves pairs whose larger set
is in band k. A scheme hashes the universe of shingles into m segments. With at most H differing elements
at least m - H segments hold the same subset in both sets, so the hashes of a set's segment subsets are an
exact index.

Allocation (`plan`): a segment is given one unit (its subset must be the same) or two (the subsets may
differ by one element: then the index also holds its one-deletion neighbourhood, and m needs to exceed H / 2
only). The cheaper is taken by a cost of index entries plus comparisons that weak keys cause: smaller sets
get two units, large sets one. Subsets of at most one shingle get no unit, because any passage that many
documents share makes such keys common, and the empty subset is the same for all: m is larger than H, and a
set leaves those segments out while enough others remain. Else it indexes single shingles too, and only if all
but H of its segments are empty (next to no set: below one in a thousand at 18 to 22 shingles, in 20,000 from 29
on) the empty ones.

Below `SMALL` shingles that would not be next to none. There the universe is one segment, and its deletion
neighbourhood is taken where it is small: a set of n misses at most n // 5 elements of a set that it links
with, so that of its first KEEP + EXTRA + n // 5 elements (in the order of their hashes) at least KEEP + EXTRA
are in both sets, and among the other's first ones too. The index holds the subsets of KEEP of these first ones.

Counting filter: a set with a link shares at least `need` of its keys with other sets: m - H - (segments left
out), and below SMALL the subsets of KEEP out of KEEP + EXTRA. Sets that share fewer are dropped before
anything is compared, so that chance meetings don't join families of real copies. The rest form families
(components over shared keys); each family's sets meet in blocks of a bounded size, in which all similarities
are computed exactly from the shingle hashes.

Exact copies are one class from the start: a set's fingerprint is the node, and each task sends a class
once. Index entries travel as packed arrays, one row for each bucket and batch, not as rows of their own; a
bucket holds keys of one scheme, and of a key the 32 bits that the bucket doesn't tell (keys that agree by
chance only cost a comparison).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.graph import components
from docloom.llm.shared import partitions, sent_if_few, table, with_row_ids, written

#: Sets of a family that are compared in one task; larger families are cut into blocks of this size.
BLOCK = 1500
#: What a comparison caused by a weak key costs against an index entry.
WEAK = 4
#: Segments over the number that differing elements can reach. More give the counting filter more to count.
SLACK = 1.7
#: Sets of fewer shingles are indexed by deletion neighbourhoods of their first elements. Below 4, linked sets are equal.
SMALL, LEAST, KEEP, EXTRA = 23, 4, 3, 1
#: Entries packed into one row for each bucket.
PACK = 1_000_000
#: Index entries that meet in one bucket, on average.
MEET = 8_000_000
#: Rows of a class of equal sets above which its rows don't meet in one task.
HOT = 1000
_U = np.uint64


def band_edges(most: int = 1 << 26) -> np.ndarray:
    """Lower ends of the size bands: the next begins above 1.25 times the last."""
    lo = [1]
    while lo[-1] < most:
        lo.append(lo[-1] * 5 // 4 + 1)
    return np.array(lo)


EDGES = band_edges()


def plan(k: int) -> tuple[int, int, int]:
    """(segments, units of each, largest difference) of scheme k."""
    hi = int(EDGES[k + 1]) - 1
    h = 2 * hi // 9
    best = None
    for units in (1, 2):
        m = max(1, math.ceil(SLACK * (h + 1) / units)) if h else 1
        mean = hi / m
        weak = math.exp(-mean) * (1 + mean + mean * mean / 2)
        cost = (m if units == 1 else m + hi) + WEAK * m * weak
        if best is None or cost < best[0]:
            best = cost, m, units, h
    return best[1:]


def least_equal(size: np.ndarray, k: np.ndarray, m: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Segments that surely match between a set and any set it links with in scheme k."""
    other = np.minimum(size * 5 // 4, EDGES[k + 1] - 1)
    return m - (size + other) // 9 // units


PLANS = np.array([plan(k) for k in range(len(EDGES) - 1)])
#: The scheme of small sets; those of the bands above are served by schemes of their own.
FIRST = int(np.searchsorted(EDGES, SMALL, "left")) - 1


def band(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, size, "right") - 1


def small_entries(sets: list[np.ndarray], names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, entity, kind) of small sets: subsets of KEEP of their first elements."""
    sizes = np.array([len(s) for s in sets])
    for d in np.unique(sizes // 5).tolist():
        of = np.flatnonzero((sizes // 5 == d) & (sizes >= LEAST))
        if not len(of):
            continue
        first = np.stack([sets[i][: KEEP + EXTRA + d] for i in of])
        pick = np.array([*combinations(range(first.shape[1]), KEEP)])
        key = np.full((len(of), len(pick)), _U(FIRST), _U)
        for j in range(KEEP):
            key = textkit.mix(key + first[:, pick[:, j]])
        yield key.ravel(), np.repeat(names[of], len(pick)), np.full(key.size, 3, np.uint8)


def index_entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The index entries of non-empty sets: (key, entity, kind), and of each entity (scheme, need).

    Entity 2 i is set i in the scheme of its own band, 2 i + 1 in the next one. The lowest bit of a kind
    says that the key is a whole subset, not a deletion; the next bit, that the scheme is the own band's.
    A segment left out by one side only differs by one element, so with two units subsets of two count as
    left out when the need is worked out."""
    every = np.array([len(s) for s in sets])
    found, schemes, needs = [], np.full(2 * len(sets), FIRST), np.full(2 * len(sets), math.comb(KEEP + EXTRA, KEEP))
    of = np.flatnonzero(every < SMALL)
    found += small_entries([sets[i] for i in of], 2 * of)
    low = _U((1 << 26) - 1)
    for up in (0, 1):
        name = np.flatnonzero(band(every) + up > FIRST)
        if not len(name):
            continue
        sizes, k = every[name], band(every[name]) + up
        flat = np.concatenate([sets[i] for i in name])
        m, units, _ = PLANS[k].T
        base = np.concatenate(([0], np.cumsum(m)))
        seed = textkit.mix(k.astype(_U) * _U(7919) + _U(13))
        h = textkit.mix(flat ^ np.repeat(seed, sizes))
        slot = (h >> _U(33)).astype(np.int64) % np.repeat(m, sizes) + np.repeat(base[:-1], sizes)
        n = np.bincount(slot, minlength=base[-1])
        # A subset's hash adds up two 26-bit parts of its elements' hashes: such sums are exact in doubles.
        one, two = h & low, (h >> _U(7)) & low
        one_sum, two_sum = (np.bincount(slot, x.astype(np.float64), base[-1]).astype(_U) for x in (one, two))
        owner = np.repeat(np.arange(len(name)), m)
        place = textkit.mix((np.arange(base[-1]) - np.repeat(base[:-1], m)).astype(_U) * _U(1_000_003) + np.repeat(seed, m))
        equal = least_equal(sizes, k, m, units)
        need, with_single = (equal - np.add.reduceat((n <= np.repeat(units - x, m)).astype(np.int64), base[:-1]) for x in (0, 1))
        # The fewest elements of a subset that is indexed, and of one whose deletions are.
        least = np.where(need >= 1, 2, np.where(with_single >= 1, 1, 0))
        emit = n >= least[owner]
        schemes[2 * name + up], needs[2 * name + up] = k, np.maximum(need, 1)
        whole = textkit.mix((one_sum + (two_sum << _U(32))) ^ place)
        own = 2 * (up == 0)
        entity = 2 * name + up
        found.append((whole[emit], entity[owner[emit]], np.full(int(emit.sum()), 1 + own, np.uint8)))
        pick = np.repeat(units == 2, sizes) & (n >= np.where(least == 0, 1, 2)[owner])[slot]
        if pick.any():
            s = slot[pick]
            less = (one_sum[s] - one[pick]) + ((two_sum[s] - two[pick]) << _U(32))
            found.append((textkit.mix(less ^ place[s]), entity[owner[s]], np.full(len(s), own, np.uint8)))
    key, entity, kind = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    return key, entity, kind, schemes, needs


def fingerprint(s: np.ndarray) -> int:
    """A 63-bit hash of a set."""
    x = textkit.mix(np.array([s.sum(dtype=_U) ^ (_U(len(s)) << _U(40)), np.bitwise_xor.reduce(s)], _U))
    return int(textkit.mix(x[:1] + x[1:] * _U(3))[0] >> _U(1))


def text_sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, _, buf, off in textkit.pieces(batch.column(column)):
        yield a, textkit.shingle_sets(buf, off)


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, node (the set's fingerprint; null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = [], []
            for _, sets in text_sets(batch, 1):
                n += [len(s) for s in sets]
                node += [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["doc_id", "n_shingles", "node"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, node long")


def bucket_bases(prints: DataFrame, n: int) -> np.ndarray:
    """First bucket of each scheme, and the number of all: at least n buckets, of about MEET entries, dealt out by the schemes' numbers of entries.

    A bucket has keys of one scheme only, so that a set's name is sent to few buckets, with many keys each."""
    edges = F.array(*map(F.lit, EDGES.tolist()))
    sizes = prints.where("n_shingles > 0").groupBy(F.size(F.filter(edges, lambda e: e <= F.col("n_shingles"))).alias("band")).agg(F.sum("n_shingles").alias("n")).collect()  # one row a band
    weight = np.zeros(len(PLANS) + 1)
    for k, size in ((x.band - 1, x.n) for x in sizes):
        if k <= FIRST:
            weight[FIRST] += 3 * size
        for to in {k, k + 1} - {*range(FIRST + 1)}:
            m, units, _ = PLANS[min(to, len(PLANS) - 1)]
            weight[to] += size * (m / EDGES[to] + (units == 2))
    share = np.maximum(1, np.round(max(n, weight.sum() / MEET) * weight / max(1.0, weight.sum()))).astype(np.int64)
    return np.concatenate(([0], np.cumsum(share)))


def shared_keys(docs: DataFrame, prints: DataFrame, text: str = "text") -> DataFrame:
    """gid, scheme, node, need: the index entries whose key two different sets have. `prints` is fingerprints(docs)."""
    n = partitions(docs.sparkSession)
    bases = bucket_bases(prints, n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names, held, count = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, entity, kind, scheme, need = (np.concatenate(x) for x in zip(*held, strict=True))
            node, own = np.repeat(np.array(names, np.int64), 2), np.tile((True, False), len(names))
            of = scheme[entity]
            to = bases[of] + (key % (bases[of + 1] - bases[of]).astype(_U)).astype(np.int64)
            order = np.lexsort((entity, to))
            cut = np.searchsorted(to[order], np.arange(bases[-1] + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                i = order[cut[b] : cut[b + 1]]
                who, times = np.unique(entity[i], return_counts=True)
                row = (key[i] >> _U(32)).astype("<u4"), np.packbits(kind[i] & 1), node[who].astype("<i8"), times.astype("<u4"), need[who].astype("<u4"), np.packbits(own[who])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([scheme[who[0]]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], ["bucket", "scheme", "keys", "whole", "nodes", "times", "needs", "own"])

        for batch in batches:
            for _, sets in text_sets(batch, 0):
                fresh = []
                for s in sets:
                    if len(s) and (f := fingerprint(s)) not in seen:
                        seen.add(f)
                        names.append(f)
                        fresh.append(s)
                if fresh:
                    key, entity, kind, scheme, need = index_entries(fresh)
                    held.append((key, entity + 2 * (len(names) - len(fresh)), kind, scheme, need))
                    count += len(key)
                if count > PACK:
                    yield from flush()
                    names, held, count = [], [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for b, scheme, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, scheme) != at:
                    yield from met(at, held)
                    at, held = (b, scheme), []
                held.append(row)
        yield from met(at, held)

    def met(at: tuple[int, int] | None, rows: list) -> Iterator[pa.RecordBatch]:
        """The keys of one bucket that serve."""
        if rows:
            b, scheme = at
            key, whole, node, need, own = [], [], [], [], []
            for keys, bits, nodes, times, needs, owns in rows:
                times, k = np.frombuffer(times, "<u4"), np.frombuffer(keys, "<u4")
                key.append(k)
                whole.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(k)))
                own.append(np.repeat(np.unpackbits(np.frombuffer(owns, np.uint8), count=len(times)), times))
                node.append(np.repeat(np.frombuffer(nodes, "<i8"), times))
                need.append(np.repeat(np.frombuffer(needs, "<u4"), times))
            key, whole, node, need, own = map(np.concatenate, (key, whole, node, need, own))
            order = np.lexsort((node, key))
            key, whole, node, need, own = (x[order] for x in (key, whole, node, need, own))
            same = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(same) - 1
            other = same | np.concatenate(([True], node[1:] != node[:-1]))
            # A key serves if two sets have it, one as a whole subset, and one of the two is in the scheme's own band.
            good = (np.bincount(group, other) >= 2) & (np.bincount(group, whole) > 0) & (np.bincount(group, own) > 0)
            keep = good[group] & other
            if keep.any():
                gid = textkit.mix(key[keep].astype(_U) + (_U(b) << _U(32))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(np.full(len(gid), scheme)), pa.array(node[keep].astype(np.int64)), pa.array(need[keep].astype(np.int64))], ["gid", "scheme", "node", "need"])

    packed = docs.select(F.col(text).alias("text")).mapInArrow(pack, "bucket long, scheme long, keys binary, whole binary, nodes binary, times binary, needs binary, own binary")
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "gid long, scheme long, node long, need long")


def families(entries: DataFrame) -> DataFrame:
    """node, root: sets that pass the counting filter, with the least set of their family."""
    enough = entries.groupBy("scheme", "node").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("scheme", "node")
    left = entries.join(enough, ["scheme", "node"], "left_semi")
    least = left.groupBy("gid").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("gid", "least")
    edges = left.join(least, "gid").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(edges.distinct())


def spots(x: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(3):
        yield (textkit.mix(x.astype(_U) + _U(k * 0x9E3779B9)) % _U(bits)).astype(np.int64)


def bloom(df: DataFrame, col: str, bits: int = 1 << 26) -> bytes:
    """A filter of fixed size (8 MB) over a long column, built by grouped bitmaps. It grows with nothing; where it fills up, more rows pass it and the join behind it decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*spots(x, bits)]) + 1)], ["p"])

    rows = df.select(col).mapInArrow(run, "p long").groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("w")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        w = np.frombuffer(bytes(r["w"]), np.uint8)
        at = (r["b"] - 1) * len(w)
        out[at : at + len(w)] = w
    return out.tobytes()


def in_bloom(filter: np.ndarray, x: np.ndarray, bits: int = 1 << 26) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for p in spots(x, bits):
        ok &= (filter[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return ok


def family_sets(docs: DataFrame, roots: DataFrame, text: str = "text") -> DataFrame:
    """node, root, shingles (binary of sorted uint64): the set of every node of a family, once."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bloom(roots, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.frombuffer(sent.value, np.uint8), set()
        for batch in batches:
            for _, sets in text_sets(batch, 0):
                full = [s for s in sets if len(s)]
                node = np.array([fingerprint(s) for s in full], np.int64)
                out = []
                for i in np.flatnonzero(in_bloom(wanted, node)).tolist() if full else ():
                    if (f := int(node[i])) not in seen:
                        seen.add(f)
                        out.append((f, full[i].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["node", "shingles"])

    sets = docs.select(F.col(text).alias("text")).mapInArrow(run, "node long, shingles binary")
    return sets.join(roots, "node").dropDuplicates(["node"])


def compare(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """(pairs, 2): positions of linked sets, one from rows and one from cols, by exact intersection sizes. rows and cols are the same array, or share nothing."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, 1]]) if 100 * both >= 80 * (sizes.sum() - both) else np.zeros((0, 2), np.int64)
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    value, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    use = times[column] >= 2
    number = np.cumsum(times >= 2) - 1
    column, who = number[column[use]], who[use]
    total = np.zeros((len(rows), len(cols)), np.float32)
    row_of, col_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[rows], col_of[cols] = np.arange(len(rows)), np.arange(len(cols))
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    width = 2048
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (a, a + width))
        c, w = column[i:j] - a, who[i:j]
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        left[row_of[w[row_of[w] >= 0]], c[row_of[w] >= 0]] = 1
        right[col_of[w[col_of[w] >= 0]], c[col_of[w] >= 0]] = 1
        total += left @ right.T
    union = sizes[rows][:, None] + sizes[cols][None, :] - total
    r, c = np.nonzero(100 * total.astype(np.float64) >= 80 * union.astype(np.float64))
    pairs = np.stack((rows[r], cols[c]), 1)
    return pairs[pairs[:, 0] < pairs[:, 1]] if rows is cols else pairs


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that a union-find keeps: at most n - 1, with the same components."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links(sets: DataFrame) -> DataFrame:
    """a, b: linked nodes, enough of them to join each component. Families above BLOCK sets meet in pairs of blocks."""
    spark = sets.sparkSession
    sizes = sets.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    cut = sets.join(sizes, "root").withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("node", F.lit(5)), "blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(group: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
            block, node, held = zip(*group, strict=True)
            sets, block = [np.frombuffer(s, _U) for s in held], np.array(block)
            first = np.flatnonzero(block == block.min())
            last = first if block.min() == block.max() else np.flatnonzero(block == block.max())
            pairs = compare(sets, first, last)
            return [(node[a], node[b]) for a, b in forest(len(sets), pairs)]

        key, group, out = None, [], []
        for batch in batches:
            for root, i, j, block, node, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != key:
                    if len(group) > 1:
                        out += one(group)
                    key, group = (root, i, j), []
                group.append((block, node, held))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if len(group) > 1:
            out += one(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    n = partitions(spark)
    return cut.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, and node, the class of equal sets.

    Null and empty texts, and texts without words, have no shingle and link with nothing. Rows that repeat,
    with the same id or another, are in one class. A row without an id stays, its id null, and counts for no
    minimum. Ties can't arise: ids are compared as numbers. Columns other than id and text are not looked at.
    """
    prints = written(fingerprints(docs, text, id), "fingerprints")
    roots = written(families(written(shared_keys(docs, prints, text), "keys")), "families")
    joined = components(links(family_sets(docs, roots, text)))
    classes = prints.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    in_component = joined.join(classes, "node").select("node", "root", "first")
    least = in_component.groupBy("root").agg(F.min("first").alias("least"))
    known = in_component.join(least, "root").select("node", "least")
    known = written(classes.join(known, "node", "left").where("n > 1 OR least IS NOT NULL").select("node", F.coalesce("least", "first").alias("least"), (F.col("n") > HOT).alias("hot")), "classes")
    # Rows of classes with many rows don't meet in one task: such classes are few, one for HOT rows at most.
    hot = sent_if_few(known.where("hot").drop("hot"))
    out = prints.join(hot, "node", "left")
    cold = known.where("NOT hot").select(F.col("node").alias("other"), F.col("least").alias("known"))
    spread = F.when(F.col("least").isNull() & F.col("node").isNotNull(), F.col("node")).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "n_shingles"), F.lit(1 << 20)))
    out = out.withColumn("other", spread).join(cold, "other", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "known", "doc_id").alias("component_id"), "node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest id (rows without an id come after all others)."""
    rows, key = with_row_ids(docs)
    gone = written(near_duplicates(rows, id=key).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")), "copies")
    return rows.join(sent_if_few(gone), F.col(key) == F.col("__id"), "left_anti").select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
