"""Token-id shards with a minimal perfect hash index.

Layout of a store, below one folder that driver and executors share::

    ids-00000.bin    24 bytes of header (magic and width of an id of 32 bits, numbers of rows and ids of 64), then raw little-endian ids
    rows-00000.bin   the number of ids of each row, as little-endian unsigned 32-bit integers
    key-00000.mph    a minimal perfect hash over one hash bucket of the document keys, see :class:`PerfectHash`
    manifest.json    width, end id, and per shard its rows, ids and the number of ids before it

Rows are in ascending (key, text) order over the shards, which are as many as keep each near ``shard_bytes`` of text, and as
many as shuffles have partitions at least. A key's bucket follows from its hash, its place in the bucket from
the perfect hash, and there stand a fingerprint (which tells keys that were never stored), the shard, the row within it, the
offset in ids and the number of rows with that key: one look into the index and one into a shard, whatever the size.

Files are written under a name of the attempt and then renamed, so a repeated task replaces its file with the same bytes.

Defined cases: null text is empty and has the end id alone; repeated keys are rows that follow each other; a null key is
stored under the smallest 64-bit integer; an empty table gives a store without rows; other columns are ignored.
"""

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import latin
from .common import remove, stored

MAGIC = b"TQID"
HEADER = "<4sIQQ"
HEADER_SIZE = struct.calcsize(HEADER)
NULL_KEY = -(1 << 63)
#: Pieces whose ids a worker keeps, and the longest of them in characters.
CACHE, LONGEST = 1_000_000, 64
U = np.uint64


def place(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder)


def write_file(folder: str, name: str, data: bytes) -> None:
    fs, path = place(folder)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{path}/{name}")


#: The normalizer and the splitter under which pieces of a Latin-1 text can be cut before the library sees them.
NORMALIZER = ["NFC", "Replace", "Lowercase"]


class WordTokenizer:
    """Encodes texts through the ``tokenizers`` library, piece by piece, with the ids of known pieces kept as bytes.

    The vocabulary drops white space, so white-space separated pieces are independent. Where the file lower-cases and splits
    by a pattern, Latin-1 texts (which its other normalisation leaves as they are) are cut at that pattern instead: pieces
    without case and punctuation recur far more often."""

    def __init__(self, path: str, width: int) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = f"<u{width}"
        self.cache: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        known = steps == NORMALIZER and split.get("type") == "Split" and split.get("invert") and "Regex" in split["pattern"]
        self.latin = re.compile(latin(split["pattern"]["Regex"])).findall if known else None
        self.special = [x["content"] for x in spec["added_tokens"]]

    def pieces(self, text: str | None) -> list[str]:
        text = text or ""
        if self.latin and not any(x in text for x in self.special):
            try:
                text.encode("latin-1")
                return self.latin(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        split = [self.pieces(text) for text in texts]
        new = list({piece for pieces in split for piece in pieces if piece not in cache})
        long = []  # not kept: texts without spaces are one piece each
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                cache[piece] = np.asarray(found.ids, self.dtype).tobytes()
                if len(piece) > LONGEST:
                    long.append(piece)
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in split]
        for piece in long:
            del cache[piece]
        return out


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, width: int) -> WordTokenizer:
    if (path, width) not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; tasks run beside each other
        _TOKENIZERS[path, width] = WordTokenizer(path, width)
    return _TOKENIZERS[path, width]


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one mixing of 64-bit keys for each seed, so different keys never collide on all levels."""
    x = keys.view(U) ^ U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class PerfectHash:
    """Levels of bitmaps: a key that is alone at its place on a level ends there, others go on to the next level.

    Its slot is the number of set bits before its bit, over all levels."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())

    @staticmethod
    def build(keys: np.ndarray, spare: float = 1.5) -> "PerfectHash":
        levels, rest = [], keys
        while len(rest):
            size = max(8, int(len(rest) * spare))
            at = (mixed(rest, len(levels)) % U(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            rest = rest[~bits[at]]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for a key that no level holds."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mixed(keys[todo], n) % U(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<I{len(self.levels)}Q", len(self.levels), *map(len, self.levels))
        return head + b"".join(np.packbits(b, bitorder="little").tobytes() for b in self.levels)

    @staticmethod
    def from_bytes(data: bytes) -> tuple["PerfectHash", int]:
        (n,) = struct.unpack_from("<I", data)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, 4), 4 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size, bitorder="little").astype(bool))
            at += -(-size // 8)
        return PerfectHash(levels), at


#: What stands at a slot of the index.
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("row", "<u4"), ("rows", "<u4"), ("offset", "<u8")])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> U(32)).astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col="doc_id", text_col="text",
          shards: int | None = None, keys_per_bucket=100_000, shard_bytes=256_000_000) -> None:
    """Writes the store of ``docs`` to ``folder``."""
    spark = docs.sparkSession
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    make_folder(spark, folder)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The text's hash lets rows of one hot key go to several shards.
    docs = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "key", "h").sortWithinPartitions("key", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = tokenizer(tokenizer_path, width), TaskContext.get().partitionId()
        end = np.asarray([end_id], f"<u{width}").tobytes()
        fs, path = place(folder)
        name, total, n_rows, lengths = f"{path}/.ids-{shard:05d}-{uuid.uuid4().hex}", 0, 0, []
        with fs.open_output_stream(f"{name}.raw") as f:
            for batch in batches:
                texts = batch.column("text")
                for at in range(0, len(texts), 256):
                    encoded = [x + end for x in own.encode(texts[at : at + 256].to_pylist())]
                    f.write(b"".join(encoded))
                    n = np.array([len(x) // width for x in encoded], np.int64)
                    first = total + np.cumsum(n) - n
                    rows = np.arange(n_rows, n_rows + len(n))
                    total, n_rows = total + int(n.sum()), n_rows + len(n)
                    lengths.append(n.astype("<u4"))
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(np.full(len(n), shard, np.int32)), "key": batch.column("key")[at : at + 256],
                        "row": pa.array(rows), "offset": pa.array(first), "n_ids": pa.array(n),
                    })
        if not n_rows:
            fs.delete_file(f"{name}.raw")
            return
        with fs.open_output_stream(name) as f, fs.open_input_stream(f"{name}.raw") as raw:
            f.write(struct.pack(HEADER, MAGIC, width, n_rows, total))
            while part := raw.read(1 << 22):
                f.write(part)
        fs.delete_file(f"{name}.raw")
        fs.move(name, f"{path}/ids-{shard:05d}.bin")
        write_file(folder, f"rows-{shard:05d}.bin", np.concatenate(lengths).tobytes())

    entries = stored(docs.select("key", "text").mapInArrow(run, "shard int, key long, row long, offset long, n_ids long"), f"{folder}/entries")
    totals = entries.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n_ids").alias("ids")).orderBy("shard").collect()  # a row per shard
    manifest, before = [], 0
    for r in totals:
        manifest.append({"shard": r["shard"], "rows": r["rows"], "ids": r["ids"], "start": before})
        before += r["ids"]
    n_keys = sum(r["rows"] for r in totals)
    buckets = -(-n_keys // keys_per_bucket) or 1
    first = F.min(F.struct("shard", "row", "offset")).alias("at")
    keys = entries.groupBy("key").agg(first, F.count("*").alias("rows")).withColumn("bucket", bucket_of("key", buckets))

    def index(bucket: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["key"].to_numpy(np.int64)
        mph = PerfectHash.build(key)
        slots, entry = mph.slots(key), np.zeros(len(key), ENTRY)
        entry["print"][slots] = fingerprints(key)
        for name in ("shard", "row", "rows", "offset"):
            entry[name][slots] = rows[name].to_numpy()
        write_file(folder, f"key-{bucket[0]:05d}.mph", mph.to_bytes() + entry.tobytes())
        return pd.DataFrame({"bucket": [bucket[0]], "keys": [len(key)]})

    flat = keys.select("bucket", "key", "at.shard", "at.row", "rows", "at.offset")
    done = flat.groupBy("bucket").applyInPandas(index, "bucket int, keys long")
    if (done.agg(F.sum("keys")).first()[0] or 0) != keys.count():
        raise RuntimeError("the index does not hold every key")
    remove(spark, f"{folder}/entries")
    write_file(folder, "manifest.json", json.dumps({"width": width, "end_id": end_id, "buckets": buckets, "shards": manifest}).encode())


def make_folder(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_manifest(folder: str) -> dict:
    fs, path = place(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def lookup(keys: DataFrame, folder: str, key_col="key") -> DataFrame:
    """``key, shard, row, rows, offset`` of distinct keys of ``keys``, through the perfect hash; unknown keys are left out."""
    buckets = read_manifest(folder)["buckets"]
    keys = keys.select(F.coalesce(F.col(key_col).cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    keys = keys.withColumn("bucket", bucket_of("key", buckets))
    columns = ("key", "shard", "row", "rows", "offset")

    def find(bucket: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fs, path = place(folder)
        name = f"{path}/key-{bucket[0]:05d}.mph"
        if fs.get_file_info(name).type == FileType.NotFound:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
        with fs.open_input_stream(name) as f:
            data = f.read()
        mph, at = PerfectHash.from_bytes(data)
        entry = np.frombuffer(data, ENTRY, offset=at)
        key = rows["key"].to_numpy(np.int64)
        slots = mph.slots(key)
        there = slots >= 0
        there[there] = entry["print"][slots[there]] == fingerprints(key[there])
        found = entry[slots[there]]
        return pd.DataFrame({"key": key[there]} | {c: found[c].astype(np.int64) for c in columns[1:]})

    return keys.groupBy("bucket").applyInPandas(find, "key long, shard long, row long, rows long, offset long")


def read(found: DataFrame, folder: str) -> DataFrame:
    """``key, shard, row, start, n_ids, ids`` of each stored row that a lookup found, read from the shards.

    ``start`` counts the ids of all rows before; ``ids`` holds them as little-endian unsigned 32-bit integers."""
    manifest = read_manifest(folder)
    starts = {s["shard"]: s for s in manifest["shards"]}
    width = manifest["width"]
    order = [s["shard"] for s in manifest["shards"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        open_shard: dict = {}

        def shard(n: int):
            if n not in open_shard:
                open_shard.clear()  # rows come by shard, one is open at a time
                with fs.open_input_stream(f"{path}/rows-{n:05d}.bin") as f:
                    lengths = np.frombuffer(f.read(), "<u4").astype(np.int64)
                open_shard[n] = fs.open_input_file(f"{path}/ids-{n:05d}.bin"), lengths
            return open_shard[n]

        for batch in batches:
            out = []
            for key, n, row, rows, offset in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "row", "rows", "offset")), strict=True):
                while rows:  # equal keys follow each other, also into the next shards
                    file, lengths = shard(n)
                    here = min(rows, len(lengths) - row)
                    for r in range(row, row + here):
                        size = int(lengths[r])
                        raw = file.read_at(size * width, HEADER_SIZE + offset * width)
                        out.append((key, n, r, starts[n]["start"] + offset, size, np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
                        offset += size
                    rows -= here
                    if rows:
                        n, row, offset = order[order.index(n) + 1], 0, 0
                    if len(out) >= 256:
                        yield packed(out)
                        out = []
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "shard", "row", "start", "n_ids", "ids"])

    found = found.repartitionByRange("shard", "row").sortWithinPartitions("shard", "row")
    return found.mapInArrow(run, "key long, shard long, row long, start long, n_ids long, ids binary")


def checksums(rows: DataFrame) -> DataFrame:
    """``rows`` with the unsigned crc32 of its ids as ``crc``; in the JVM."""
    return rows.withColumn("crc", F.crc32("ids"))
