"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    block*    zstd frame of entries; an entry is: bytes shared with the key before, bytes of its own (both varint),
              own key bytes, number of ids (varint), ids as little-endian unsigned 16- or 32-bit integers
    index     for each block: last key, offset, length, documents, ids
    filter    Bloom filter over all keys
    footer    offsets and lengths of index and filter, width of an id, documents, ids, magic

Keys are identifiers as 9 bytes: 1, then big-endian with the sign bit flipped, so that bytes sort as numbers do; a null key is 9
zero bytes and sorts before all others. Shards are range-partitioned, each of a bounded number of ids, and listed with
their first and last keys. A lookup opens the shards whose range holds the key, reads the footer, asks the filter, finds the
block by binary search in the sparse index and the document by binary search over the block's decoded keys.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldloom.llm.common import shared_folder, written

MAGIC = b"GLSST002"
FOOTER = struct.Struct("<QQQQBQQ8s")
BLOCK_BYTES = 1 << 18
#: A shard is closed beyond so many bytes, so a reader never holds more than that and one document.
SHARD_BYTES = 24 << 20
FILTER_BITS, FILTER_HASHES = 10, 7
SIGN = 1 << 63


def key_bytes(key: int | None) -> bytes:
    return bytes(9) if key is None else b"\1" + (key + SIGN).to_bytes(8, "big")


def key_int(raw: bytes) -> int | None:
    return int.from_bytes(raw[1:], "big") - SIGN if raw[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """A Bloom filter; the hash functions are sums of two halves of one hash."""

    def __init__(self, bits: bytearray) -> None:
        self.bits = bits

    @staticmethod
    def over(keys: list[bytes]) -> Bloom:
        f = Bloom(bytearray(max(8, len(keys) * FILTER_BITS // 8 + 1)))
        for k in keys:
            for s in f._spots(k):
                f.bits[s >> 3] |= 1 << (s & 7)
        return f

    def _spots(self, key: bytes) -> list[int]:
        h, n = xxhash.xxh3_128_intdigest(key), len(self.bits) * 8
        a, b = h & (SIGN - 1), h >> 64 | 1
        return [(a + i * b) % n for i in range(FILTER_HASHES)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[s >> 3] >> (s & 7) & 1 for s in self._spots(key))


class ShardWriter:
    """Builds one shard from (key, ids as little-endian unsigned 32-bit integers) in ascending key order."""

    def __init__(self, width: int) -> None:
        self.width, self.pack = width, zstandard.ZstdCompressor(level=1)
        self.done, self.size, self.index, self.keys = [], 0, [], []
        self.n_docs = self.n_ids = 0
        self._open()

    def _open(self) -> None:
        self.block, self.block_size, self.last, self.block_docs, self.block_ids = [], 0, b"", 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        raw = key_bytes(key)
        shared = next((i for i, (a, b) in enumerate(zip(raw, self.last)) if a != b), min(len(raw), len(self.last)))
        n = len(ids) // 4
        body = ids
        if self.width == 2:
            given = np.frombuffer(ids, "<u4")
            if n and given.max() >= 1 << 16:
                raise ValueError(f"id {given.max()} needs shards with wide ids")
            body = given.astype("<u2").tobytes()
        entry = b"".join((varint(shared), varint(len(raw) - shared), raw[shared:], varint(n), body))
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = raw
        self.keys.append(raw)
        self.block_docs += 1
        self.block_ids += n
        if self.block_size >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        data = self.pack.compress(b"".join(self.block))
        self.index.append((self.last, self.size, len(data), self.block_docs, self.block_ids))
        self.done.append(data)
        self.size += len(data)
        self.n_docs += self.block_docs
        self.n_ids += self.block_ids
        self._open()

    def finish(self) -> bytes:
        if self.block:
            self._close_block()
        index = b"".join(k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        bloom = bytes(Bloom.over(self.keys).bits)
        footer = FOOTER.pack(self.size, len(index), self.size + len(index), len(bloom), self.width, self.n_docs, self.n_ids, MAGIC)
        return b"".join((*self.done, index, bloom, footer))


class ShardReader:
    """Reads a shard through read(offset, length)."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        at, n, bloom_at, bloom_n, self.width, self.n_docs, self.n_ids, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw = read(at, n)
        self.index = [(raw[i : i + 9], *struct.unpack_from("<QQQQ", raw, i + 9)) for i in range(0, n, 41)]
        self.bloom = Bloom(bytearray(read(bloom_at, bloom_n)))

    @staticmethod
    def over(data: bytes) -> ShardReader:
        return ShardReader(lambda at, n: data[at : at + n], len(data))

    def block(self, k: int) -> list[tuple[bytes, bytes]]:
        """(key bytes, ids as little-endian unsigned 32-bit integers) of block k."""
        data, out, at, key = zstandard.ZstdDecompressor().decompress(self.read(*self.index[k][1:3])), [], 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            n, at = read_varint(data, at + own)
            ids = data[at : at + n * self.width]
            at += n * self.width
            out.append((key, ids if self.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
        return out

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield key_int(key), ids

    def get_all(self, key: int | None) -> list[bytes]:
        """Ids of the documents with this key, which may stand in several blocks."""
        raw, out = key_bytes(key), []
        if raw not in self.bloom:
            return out
        lasts = [e[0] for e in self.index]
        for k in range(bisect_left(lasts, raw), len(self.index)):
            entries = self.block(k)
            keys = [e[0] for e in entries]
            out += [ids for _, ids in entries[bisect_left(keys, raw) : bisect_right(keys, raw)]]
            if lasts[k] > raw:
                break
        return out

    def get(self, key: int | None) -> bytes | None:
        """Ids of the first document with this key, or None."""
        return next(iter(self.get_all(key)), None)


#: Bytes of input in a range of keys, and a size from which a plan's size is only a guess.
RANGE_BYTES, UNKNOWN = 64 << 20, 1 << 50


def range_count(docs: DataFrame) -> int:
    """Ranges of keys for a table: RANGE_BYTES of its input each, as the plan estimates it, and at least one for each core and
    shuffle partition; just these where the size isn't known."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // RANGE_BYTES)) if size < UNKNOWN else least


def write_shards(docs: DataFrame, path: str, encode: Callable[[], Callable[[pa.Array], list[bytes]]], end_id: int = 0, wide: bool = False, partitions: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes documents, appends end_id to each and writes shards in ascending key order below path; returns their list.

    The list (a written table) has for each shard: part and seq (ascending with the keys), file, n_docs, n_ids, first and last
    (key bytes). A shard file has a name of its own for every attempt, and only those of finished tasks are listed, so a task
    that is run again after its executor was lost leaves at most an unlisted file. An id that doesn't fit the width is an error. Null texts count as empty (only the end id
    is written), null keys come first. Rows that repeat a key all stay. An empty table gives an empty list. wide: ids of 32
    bits, needed for vocabularies of 65,536 and more.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = partitions or range_count(docs)
    ordered = rows.repartitionByRange(n, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        ids_of, width, shard, seq = encode(), 4 if wide else 2, None, 0

        def close(part: int) -> pa.RecordBatch:
            data = shard.finish()
            name = f"{part:08d}-{seq:05d}-{uuid.uuid4().hex}.sst"
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": shard.n_docs, "n_ids": shard.n_ids, "first": shard.keys[0], "last": shard.keys[-1]}], _LIST)

        part = 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for k, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1))):
                shard = shard or ShardWriter(width)
                shard.add(k, ids + end)
                if shard.size + shard.block_size >= SHARD_BYTES:
                    yield close(part)
                    shard, seq = None, seq + 1
        if shard:
            yield close(part)

    return written(ordered.mapInArrow(run, "part int, seq int, file string, n_docs long, n_ids long, first binary, last binary"), "shards")


_LIST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])


def _open(fs: pafs.FileSystem, path: str) -> ShardReader:
    """A shard of which only the parts asked for are read."""
    file = fs.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return ShardReader(read, file.size())


def starts(shards: DataFrame) -> DataFrame:
    """shards with before, the ids in all shards that come earlier: sums of parts, of which there are as many as tasks wrote, and
    running sums within a part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("of_parts"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = shards.withColumn("of_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return rows.join(parts, "part").withColumn("before", F.col("of_parts") + F.col("of_part")).drop("of_parts", "of_part")


def read_shards(shards: DataFrame, path: str) -> DataFrame:
    """Documents of listed shards, read back: key, start (ids of all documents before it), n_ids, token_ids (little-endian unsigned 32-bit).

    Shards are dealt to tasks by name and read block by block.
    """
    n = max(shards.sparkSession.sparkContext.defaultParallelism, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = starts(shards).select("file", "before").repartition(n, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in range(batch.num_rows):
                reader, at = _open(fs, f"{folder}/{batch.column(0)[row].as_py()}"), batch.column(1)[row].as_py()
                for k in range(len(reader.index)):
                    keys, begins, counts, ids = [], [], [], []
                    for key, raw in reader.block(k):
                        keys.append(key_int(key))
                        begins.append(at)
                        counts.append(len(raw) // 4)
                        ids.append(raw)
                        at += counts[-1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "n_ids", "token_ids"])

    return rows.mapInArrow(run, "key long, start long, n_ids long, token_ids binary")


#: Most keys of one lookup.
MOST_KEYS = 10_000


def lookup(shards: DataFrame, path: str, keys: list[int | None]) -> DataFrame:
    """(key, token_ids) of all documents with one of the given keys; keys without a document give no row.

    Only shards whose range of keys holds one are opened, and of these only footers, filters and the blocks that a key leads to.
    """
    if len(keys) > MOST_KEYS:
        raise ValueError(f"at most {MOST_KEYS} keys at a time")
    wanted = sorted({key_bytes(k) for k in keys})
    asked = F.array(*(F.lit(k) for k in wanted)).cast("array<binary>")
    files = shards.filter(F.exists(asked, lambda k: (k >= F.col("first")) & (k <= F.col("last")))).select("file", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                reader = _open(fs, f"{folder}/{file}")
                hits = [(key_int(k), ids) for k in wanted[bisect_left(wanted, first) : bisect_right(wanted, last)] for ids in reader.get_all(key_int(k))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.binary())], ["key", "token_ids"])

    return files.mapInArrow(run, "key long, token_ids binary")


def new_folder(docs: DataFrame) -> str:
    return shared_folder(docs.sparkSession, "sst")
