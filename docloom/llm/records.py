"""Token-ID / binary output: length-delimited records with masked checksums and a separate offset index.

File format of a shard (all integers little-endian):

    data file   16 bytes  magic b"DLREC1\\0\\0", bytes an id takes in a payload (2 or 4), flags (1: zstd), 6 zero bytes
                records   uint64 length of the body, uint32 masked crc32c-style checksum of these 8 bytes,
                          body, uint32 masked checksum of the body
                body      int64 doc_id, uint8 1 if doc_id is null, uint32 number of ids, payload
    index file  for every record: uint64 offset of the record, uint32 number of ids

The checksum is zlib.crc32, masked (rotated right by 15 bits and moved by a constant), so that a checksum
stored inside checked data doesn't weaken the check. With the index a reader fetches any record by one
seek, in any shuffled order.

Texts are encoded on the executors before the shuffle; what is shuffled are compressed id arrays keyed by
shard. Shards are ranges of doc_id, so that files in shard order hold ascending ids. A task that is run
again writes files under a new name; the manifest names the files of the attempts that succeeded.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import new_folder, partitions, table

MAGIC = b"DLREC1\0\0"
END = 0
#: Marks that may follow a word's letters; a run of them is a word of its own to the tokenizer.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level BPE writes a byte that has no printed Latin-1 sign as the next free one above 255.
BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Words kept with their ids in each Python worker.
CACHE = 500_000
#: Bytes of text that a shard should hold, and rows whose mean length tells how many shards that makes.
SHARD_BYTES = 1 << 28
MEAN_ROWS = 1000


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", mask(zlib.crc32(head))), body, struct.pack("<I", mask(zlib.crc32(body)))))


def parse(data: bytes, at: int) -> tuple[bytes, int]:
    """The body of the record at an offset, and where the next one begins; ValueError if a checksum fails."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != mask(zlib.crc32(head)):
        raise ValueError(f"broken record length at {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    body = data[at + 12 : end]
    if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != mask(zlib.crc32(body)):
        raise ValueError(f"broken record at {at}")
    return body, end + 4


class Known(dict):
    """Words with their ids; one that is missing is worked out when it is asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, x: str) -> bytes:
        out = self[x] = self.make(x)
        return out


class Encoder:
    """Texts to ids by the tokenizers library, each distinct word once.

    Byte-level BPE never merges across a space or a single line break that follows other text, so a text is
    the concatenation of its words, each led by its space or line break. Texts with two such characters in a
    row, where that doesn't hold, or with a special token's string, are encoded whole.
    """

    def __init__(self, path: str, width: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), {2: "<u2", 4: "<u4"}[width]
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.code, self.tails = {2: "H", 4: "I"}[width], {}
        self.first = Known(lambda x: self.word("", x))
        self.later = Known(lambda x: self.word("\n", x[1:]) if x[:1] == "\n" else self.word(" ", x))

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def word(self, lead: str, word: str) -> bytes:
        """A word after a space, a line break or nothing. Letters with marks behind them, as most words are, go
        straight to the library's BPE model, which takes a word's bytes as the alphabet of byte-level BPE."""
        stem = word.rstrip(PUNCTUATION)
        if not stem.isalpha():
            return self.ids(lead + word)
        if lead == " " and len(stem) < len(word) and stem in self.later:
            return self.later[stem] + self.tail(word[len(stem) :])
        name = ("\u0120" if lead == " " else "") + stem.encode().decode("latin-1").translate(BYTES)
        ids = [t.id for t in self.tokenizer.model.tokenize(name)]
        out = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if lead == "\n":
            out = self.tail("\n") + out
        return out + self.tail(word[len(stem) :]) if len(stem) < len(word) else out

    def tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > CACHE:
                self.tails.clear()
            self.tails[marks] = self.ids(marks)
        return self.tails[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = ("  ", " \n", "\n\n", *self.special)
        for known in (self.first, self.later):
            if len(known) > CACHE:
                known.clear()
        first, later, out = self.first.__getitem__, self.later.__getitem__, []
        for t in texts:
            if any(s in t for s in whole):
                out.append(self.ids(t))
            else:
                words = t.replace("\n", " \n").split(" ")
                out.append(first(words[0]) + b"".join(map(later, islice(words, 1, None))))
        return out


@lru_cache(1)
def encoder(path: str, width: int) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path, width)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str, width: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, payload: zstd-compressed ids with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, press, end = encoder(path, width), zstandard.ZstdCompressor(level=1), END.to_bytes(width, "little")
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = [x + end for x in coder.encode(["" if t is None else t for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "crc", "payload"])

    return docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_tokens long, crc long, payload binary")


def write_records(docs: DataFrame, folder: str, path: str | None = None, width: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Encode every text and write shards in ascending id order; returns the manifest, one row per shard.

    Rows of a null id come first, in the order of their checksum and number of ids; rows of one id are ordered by
    their number of ids and checksum, so the files are the same whenever they are written again. Null and empty
    texts are the end id alone. An empty table writes no shard. `width`: bytes of an id in a payload, 2 while the
    vocabulary has at most 65,536.

    Shards are counted so that one holds about SHARD_BYTES of text, by the number of rows and the mean length of some of
    them, and number at least the shuffle partitions; each is written by a task of its own. Rows of null ids are
    dealt to shards by ranges of their checksum.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    key = F.col(id).cast("long")
    rows = docs.agg(F.count("*").alias("all"), F.count_if(key.isNull()).alias("null")).first()
    some = [r[0] for r in docs.select(F.coalesce(F.octet_length(F.col(text)), F.lit(0))).take(MEAN_ROWS)]
    mean = sum(some) / max(1, len(some))
    shards_for = lambda count: math.ceil(count * mean / SHARD_BYTES)
    n, nulls = max(partitions(spark), shards_for(rows["all"])), max(1, shards_for(rows["null"])) if rows["null"] else 0
    # Shard edges from the id column alone: the texts are read once.
    edges = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    edges = sorted(set(edges))
    # The first edge that lies above an id, found by halving, in one expression of constant size.
    known = F.lit(edges).cast("array<long>")
    step = lambda s, _: F.when(s["lo"] < s["hi"], F.when(F.get(known, F.shiftright(s["lo"] + s["hi"], 1)) <= F.col("doc_id"), F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi")))).otherwise(s)
    place = F.aggregate(F.sequence(F.lit(0), F.lit(len(edges).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")), step)["lo"] if edges else F.lit(0)
    shard = F.when(F.col("doc_id").isNull(), F.floor(F.col("crc") * max(nulls, 1) / 2**32).cast("int")).otherwise(place + nulls)
    rows = encoded(docs, path, width, text, id).withColumn("shard", shard.cast("int"))
    null = F.col("doc_id").isNull()
    order = ("shard", F.asc_nulls_first("doc_id"), F.when(null, F.col("crc")), "n_tokens", "crc")
    rows = rows.repartitionById(nulls + len(edges) + 1, F.col("shard")).sortWithinPartitions(*order).select("shard", "doc_id", "n_tokens", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now, out, index, name, at, count, total = None, None, None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            index.close()
            return pa.RecordBatch.from_pydict({"shard": [now], "file": [name], "records": [count], "tokens": [total]})

        for batch in batches:
            for s, i, k, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if out is not None:
                        yield close()
                    now, name, at, count, total = s, f"shard-{s:06d}-{uuid.uuid4().hex}", 16, 0, 0
                    out, index = store.open_output_stream(f"{root}/{name}.rec"), store.open_output_stream(f"{root}/{name}.idx")
                    out.write(MAGIC + bytes((width, 1)) + bytes(6))
                record = frame(struct.pack("<qBI", i or 0, i is None, k) + payload)
                out.write(record)
                index.write(struct.pack("<QI", at, k))
                at, count, total = at + len(record), count + 1, total + k
        if out is not None:
            yield close()

    return rows.mapInArrow(run, "shard long, file string, records long, tokens long")


def read_records(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Every record of the shards: doc_id, start (ids before it), n_tokens, ids (uint32 little-endian).

    `manifest`: the collected rows of write_records(), one per shard."""
    base, rows = 0, []
    for m in sorted(manifest, key=lambda m: m["shard"]):
        rows.append((m["file"], m["records"], base))
        base += m["tokens"]
    schema = "file string, records long, base long"
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.createDataFrame(rows, schema).repartition(min(len(rows), 4 * partitions(spark)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, records, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}.idx") as index, store.open_input_file(f"{root}/{name}.rec") as f:
                    if index.size() != records * 12:
                        raise ValueError(f"{name}: index has {index.size() / 12} records, manifest {records}")
                    head = f.read(16)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{name} isn't a record file")
                    size, kind = f.size(), np.uint16 if head[8] == 2 else np.uint32
                    for a in range(0, records, 256):
                        # The entries of some records, and one more to know where the last of them ends.
                        index.seek(a * 12)
                        part = list(struct.iter_unpack("<QI", index.read(12 * min(257, records - a))))
                        lo, hi = part[0][0], part[256][0] if len(part) > 256 else size
                        f.seek(lo)
                        data, out = f.read(hi - lo), []
                        for offset, k in part[:256]:
                            body, _ = parse(data, offset - lo)
                            i, null, n = struct.unpack_from("<qBI", body)
                            ids = np.frombuffer(unpack.decompress(body[13:]), kind).astype("<u4")
                            if n != k or n != len(ids):
                                raise ValueError(f"{name}: record at {offset} has {len(ids)} ids, not {k}")
                            out.append((None if null else i, start, n, ids.tobytes()))
                            start += n
                        i, s, n, ids = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_records(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write documents as token-id records and read them back: doc_id, start, n_tokens, ids_crc32 of every record."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    manifest = write_records(docs, folder).collect()  # one row per shard
    back = read_records(spark, folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_token_records": op5_token_records}
ORACLES: dict[str, str] = {}
