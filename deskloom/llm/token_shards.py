"""Binary token-id shards with a minimal perfect hash index from document key to shard offset.

``write_shards`` encodes every text, appends an end id and writes one pair of files for each key range:

* ``shard-N.ids``: the raw ids, little-endian, 16 bits wide where the vocabulary allows, in ascending key order;
* ``shard-N.idx``: a minimal perfect hash over the distinct keys (levels of bit arrays, ranks for each 512 bits), for each slot
  the key's 32-bit fingerprint, its first record and their number, and the offset of each record. Keys themselves aren't stored.

The manifest holds the least and greatest key of each shard, so a lookup opens one shard, and there goes from slot to record to
offset; the index is memory-mapped where it lies in a mounted folder. A key that was never stored is refused by the range of keys or by its fingerprint,
except with probability 2^-32. Files are written under a name of their own and renamed, and hold the same bytes whichever attempt wrote them.

Nulls: a null text is an empty one (its record holds the end id alone); rows without a key come first and are
found by scanning only. Equal keys are stored one after another in text order, in one shard; a lookup returns all of them.
An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import scratch
from .chunk_bpe import encoder

MANIFEST = "shard int, path string, width int, records long, tokens long, nulls long, lo long, hi long"
BLOCK = 64  # bytes of a bit array between ranks


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over integer keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: keys that are alone in a level's bit array stay there, the others go on to the next."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, parts, rest = [], [], keys
        while len(rest):
            m = max(8, int(len(rest) * gamma) | 1)
            at = (mix(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(alone)
            rest = rest[~alone[at]]
        bits = np.packbits(np.concatenate(parts)) if parts else np.empty(0, np.uint8)
        bits = np.pad(bits, (0, -len(bits) % BLOCK))
        return cls(np.asarray(sizes, np.int64), bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits.reshape(-1, BLOCK)).sum(axis=1, dtype=np.int64))]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        byte = at >> 3
        block = byte // BLOCK
        whole = np.bitwise_count(self.bits.reshape(-1, BLOCK)[block]).astype(np.int64)
        inside = (whole * (np.arange(BLOCK) < (byte % BLOCK)[:, None])).sum(axis=1)
        return self.ranks[block] + inside + np.bitwise_count(self.bits[byte] >> (8 - (at & 7)).astype(np.uint16)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where every level refuses it; a stored key has a slot of its own."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, m in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.starts[level] + (mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[todo[hit]] = self.rank(at[hit])
            todo = todo[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _put(path: str, write) -> None:
    """Write to a name of this attempt's own, then rename; where a store won't replace a file, the earlier attempt's equal one stays."""
    store, name = fs.FileSystem.from_uri(path)
    own = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        write(f)
    try:
        store.move(own, name)
    except OSError:
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(own)


def _index_bytes(keys: np.ndarray, null: int, lengths: np.ndarray) -> bytes:
    found, first, count = np.unique(keys[null:], return_index=True, return_counts=True)
    ph = PerfectHash.build(found)
    slot = ph.slots(found)
    prints, record, records = (np.empty(len(found), np.uint32) for _ in range(3))
    prints[slot], record[slot], records[slot] = fingerprints(found), first + null, count
    parts = [ph.sizes.astype("<i8"), ph.bits, ph.ranks.astype("<i8"), prints.astype("<u4"), record.astype("<u4"), records.astype("<u4"), np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")]
    raw = [np.asarray([null, *map(len, parts)], "<i8").tobytes(), *(x.tobytes() for x in parts)]
    return b"".join(x + bytes(-len(x) % 8) for x in raw)


class Shard:
    """One shard's files: constant-time access by key, and a scan in stored order."""

    def __init__(self, path: str, width: int):
        self.store, self.name = fs.FileSystem.from_uri(path)
        if isinstance(self.store, fs.LocalFileSystem):
            raw = np.memmap(f"{self.name}.idx", np.uint8, "r")
        else:
            with self.store.open_input_file(f"{self.name}.idx") as f:
                raw = np.frombuffer(f.read(), np.uint8)
        head, at, parts = raw[:64].view("<i8"), 64, []
        for n, kind in zip(head[1:].tolist(), ("<i8", "u1", "<i8", "<u4", "<u4", "<u4", "<i8"), strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        sizes, bits, ranks, self.prints, self.record, self.count, self.offsets = parts
        self.hash, self.null, self.dtype = PerfectHash(sizes, bits, ranks), int(head[0]), np.dtype(f"<u{width}")

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first record of each key and how many it has; 0 of them where the key's fingerprint isn't the stored one."""
        slot = self.hash.slots(keys)
        if not len(self.prints):
            return slot, np.zeros(len(keys), np.int64)
        good = (slot >= 0) & (self.prints[slot] == fingerprints(keys))
        return self.record[slot].astype(np.int64), np.where(good, self.count[slot], 0).astype(np.int64)

    def lookup(self, key: int) -> list[np.ndarray]:
        """The ids of every record of a key; reads only those bytes."""
        first, n = (int(x[0]) for x in self.records(np.asarray([key], np.int64)))
        return [np.frombuffer(raw, "<u4") for _, raw in self.read(np.arange(first, first + n))]

    def read(self, records: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
        """Each of some ascending records and its ids as 32-bit little-endian bytes; neighbours are read together, about ``step`` ids at a time."""
        w, at = self.dtype.itemsize, 0
        with self.store.open_input_file(f"{self.name}.ids") as f:
            while at < len(records):
                r, to = int(records[at]), at + 1
                while to < len(records) and records[to] == records[to - 1] + 1 and self.offsets[records[to] + 1] - self.offsets[r] <= step:
                    to += 1
                base, end = int(self.offsets[r]), int(self.offsets[records[to - 1] + 1])
                raw = np.frombuffer(f.read_at((end - base) * w, base * w), self.dtype).astype("<u4").tobytes()
                for i in records[at:to].tolist():
                    yield i, raw[4 * int(self.offsets[i] - base) : 4 * int(self.offsets[i + 1] - base)]
                at = to

    def scan(self) -> Iterator[tuple[int, bytes]]:
        """Every record in stored order."""
        return self.read(np.arange(len(self.offsets) - 1))


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None, records: int = 100_000) -> tuple[str, DataFrame]:
    """Write all of ``docs``; returns the folder and its manifest, one row for each shard.

    The key is a long. Each task holds a batch of texts and two numbers for each record of its shard. Unless their number is given there are as many
    shards as the session's shuffles have partitions, or as many more as keep them to about ``records`` records, so that a shard's index stays small whatever the table's size.
    """
    spark = docs.sparkSession
    if shards is None and (wanted := -(-docs.count() // records)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        shards = wanted
    path = path or scratch.folder(spark, "shards")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*([shards] if shards else []), F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")

    def write(batches):
        from pyspark import TaskContext

        at, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, keys, lengths, null = f"{path}/shard-{at:06d}", [], [], 0
        tail = np.asarray([end_id], enc.dtype)

        def ids(f):
            nonlocal null
            for b in _chain(first, batches):
                k = b.column("key")
                null += k.null_count
                for i in range(0, b.num_rows, 500):
                    flat, n = enc.encode(b.column("text").slice(i, 500).to_pylist())
                    keys.append(k.slice(i, 500).fill_null(0).to_numpy(zero_copy_only=False))
                    lengths.append(n + 1)
                    f.write(np.insert(flat, np.cumsum(n), tail).tobytes())

        _put(f"{name}.ids", ids)
        n = np.concatenate(lengths)
        own = np.concatenate(keys)
        blob = _index_bytes(own, null, n)
        _put(f"{name}.idx", lambda f: f.write(blob))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "path": [name], "width": pa.array([enc.dtype.itemsize], pa.int32()), "records": [len(n)], "tokens": [int(n.sum())], "nulls": [null], "lo": pa.array([int(own[null])] if null < len(own) else [None], pa.int64()), "hi": pa.array([int(own[-1])] if null < len(own) else [None], pa.int64())})

    spark_fs_mkdirs(spark, path)
    manifest = rows.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return path, open_shards(spark, path)


def _chain(first, rest):
    yield first
    yield from rest


def spark_fs_mkdirs(spark: SparkSession, path: str) -> None:
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name, recursive=True)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with ``base``, the ids in all shards before; a row for each shard is all that meets in one place."""
    rows, base = [], 0
    for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("shard").toLocalIterator():
        rows.append((*r, base))
        base += r.tokens
    return spark.createDataFrame(rows, f"{MANIFEST}, base long")


READ = "key long, start long, n_tokens long, ids_crc32 long"


def _read(shard: Shard, base: int, key: np.ndarray, record: np.ndarray, null: bool) -> pa.Table:
    order = np.argsort(record, kind="stable")
    key, record = key[order], record[order]
    crc = np.fromiter((zlib.crc32(raw) for _, raw in shard.read(record)), np.int64, len(record))
    return pa.table({"key": pa.array(key, pa.int64(), mask=np.full(len(key), null)), "start": shard.offsets[record] + base, "n_tokens": shard.offsets[record + 1] - shard.offsets[record], "ids_crc32": crc})


def fetch(manifest: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """All records of the asked keys, each found through its shard's hash: key, start (ids of all records before), n_tokens, ids_crc32.

    Keys are dealt to shards by the ranges in the manifest (a few numbers for each shard); a shard's keys are looked up together.
    """
    spark = manifest.sparkSession
    shards = manifest.where("lo IS NOT NULL").orderBy("lo").select("lo", "hi", "path", "width", "base").toArrow()
    known = spark.sparkContext.broadcast({c: shards.column(c).to_numpy(zero_copy_only=False) for c in shards.column_names})

    def route(batches):
        lo, hi = known.value["lo"], known.value["hi"]
        for b in batches:
            k = b.column(0).to_numpy()
            at = np.searchsorted(hi, k)
            good = (at < len(hi)) & (lo[np.minimum(at, len(lo) - 1)] <= k) if len(hi) else np.zeros(len(k), bool)
            yield pa.RecordBatch.from_pydict({"at": at[good].astype(np.int32), "key": k[good]})

    def look(group: pa.Table) -> pa.Table:
        at, asked = group.column("at")[0].as_py(), np.unique(group.column("key").to_numpy())
        shard = Shard(str(known.value["path"][at]), int(known.value["width"][at]))
        first, n = shard.records(asked)
        ends = np.cumsum(n)
        record = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return _read(shard, int(known.value["base"][at]), np.repeat(asked, n), record, False)

    asked = keys.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    return asked.mapInArrow(route, "at int, key long").groupBy("at").applyInArrow(look, READ)


def without_key(manifest: DataFrame) -> DataFrame:
    """All records of rows that had no key, by scanning those that come first in a shard; columns of ``fetch``."""

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["path"], row["width"])
                for i in range(0, row["nulls"], 10_000):
                    r = np.arange(i, min(row["nulls"], i + 10_000))
                    yield from _read(shard, row["base"], r, r, True).to_batches()

    return manifest.where("nulls > 0").mapInArrow(read, READ)
