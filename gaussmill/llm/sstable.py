"""Token ids as sorted-string-table shards, keyed by document id.

Shard file, integers little-endian unless noted:

    data blocks    entries in ascending key order; an entry is varint(bytes of
                   the key shared with the previous one), varint(rest), the rest
                   of the key, varint(value bytes), value; then zstd
    index          one entry per data block: key length u8, last key, offset
                   u64, bytes u32, crc32 u32
    Bloom filter   bits over all keys, 7 probes
    footer         part u32, sequence u32, documents u64, ids u64, ids before it
                   in its part u64, index offset u64, index bytes u32, filter
                   offset u64, filter bytes u32, id width u8, magic 8 bytes
    end mark       one byte 0x0A

A key is the id's sign-flipped big-endian 8 bytes after a byte 1; a null id is
the single byte 0 and so comes first.  A value is the ids of one document, two
bytes each if the vocabulary allows, else four.  Every shard is one row written
by Spark's own committer, so lost tasks are simply run again and nothing is
written outside the target folder.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaussmill.llm.common import col, map_batches, new_path, slices, text_of, worker_cached

BLOCK, SHARD, PROBES, END = 64 << 10, 16 << 20, 7, b"\n"
FOOTER, MAGIC = struct.Struct("<IIQQQQIQIB8s"), b"GMSST\x00\x01\x0a"
MOST_PIECES = 700_000
#: Latin-1 letters in lower case, numbers and white space, as the tokenizer classes them.
LETTER, NUMBER, SPACE = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x09-\x0d\x20\xa0"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if len(key) == 1 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    def __init__(self, part: int, width: int, shard_bytes: int = SHARD, block_bytes: int = BLOCK):
        self.part, self.width, self.most, self.block_bytes, self.sequence, self.before = part, width, shard_bytes, block_bytes, 0, 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.out, self.index, self.keys, self.docs, self.ids = bytearray(), bytearray(), [], 0, 0
        self.block, self.last = bytearray(), b""

    def _end_block(self) -> None:
        if self.block:
            data = self.zstd.compress(bytes(self.block))
            self.index += struct.pack("<B", len(self.last)) + self.last + struct.pack("<QII", len(self.out), len(data), zlib.crc32(data))
            self.out += data
            self.block, self.last = bytearray(), b""

    def add(self, key: bytes, value: bytes) -> bytes | None:
        """Append an entry; the finished shard if it became full."""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._end_block()
        return self.finish() if len(self.out) >= self.most else None

    def finish(self) -> bytes | None:
        if not self.docs:
            return None
        self._end_block()
        distinct = set(self.keys)
        bits = max(64, 10 * len(distinct))
        filled = np.zeros(bits, np.uint8)
        for key in distinct:
            filled[_probes(key, bits)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(filled).tobytes()
        at = len(self.out)
        self.out += self.index + bloom
        self.out += FOOTER.pack(self.part, self.sequence, self.docs, self.ids, self.before, at, len(self.index), at + len(self.index), len(bloom), self.width, MAGIC)
        made = bytes(self.out)
        self.sequence += 1
        self.before += self.ids
        self._open()
        return made


class ShardReader:
    def __init__(self, data: bytes):
        data = data.removesuffix(END) if data[-1:] == END and data[-9:-1] == MAGIC else data
        self.data = data
        self.part, self.sequence, self.docs, self.ids, self.before, at, n, self.bloom_at, self.bloom_n, self.width, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.last, self.blocks, end = [], [], at + n
        while at < end:
            size = data[at]
            self.last.append(bytes(data[at + 1 : at + 1 + size]))
            self.blocks.append(struct.unpack_from("<QII", data, at + 1 + size))
            at += 1 + size + 16

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size, crc = self.blocks[block]
        packed = self.data[offset : offset + size]
        if zlib.crc32(packed) != crc:
            raise ValueError("a block's checksum differs")
        data, at, key = zstandard.ZstdDecompressor().decompress(packed), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            n, at = _read_varint(data, at + rest)
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.entries(i)

    def may_hold(self, key: bytes) -> bool:
        (bits,) = struct.unpack_from("<Q", self.data, self.bloom_at)
        return all(self.data[self.bloom_at + 8 + (p >> 3)] >> (7 - (p & 7)) & 1 for p in _probes(key, bits))

    def lookup(self, key: bytes) -> list[bytes]:
        """Values of a key: Bloom filter, binary search in the sparse index, then its blocks."""
        out = []
        if self.may_hold(key):
            block = bisect_left(self.last, key)
            while block < len(self.blocks):
                out += [v for k, v in self.entries(block) if k == key]
                if self.last[block] != key:
                    break
                block += 1
        return out

    def array(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")


class WordEncoder(dict):
    """Texts to ids with the tokenizers library.  As a dict it keeps the ids of pieces already seen.

    The tokenizer lower-cases, splits and then merges inside each piece.  Texts
    of Latin-1 characters, whose lower case changes no other character, are
    split here as the tokenizer would split them.  White space ends every piece
    too, so of other texts the chunks between white space are encoded alone.
    """

    def __init__(self, tokenizer, width: int):
        super().__init__()
        self.tokenizer, self.width, self.kind = tokenizer, width, "<u2" if width == 2 else "<u4"
        self.split = re.compile(rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{LETTER}{NUMBER}{SPACE}]+").findall
        self.space = re.compile(r"[\x20\x09-\x0D]+").split

    def __missing__(self, piece: str) -> bytes:
        made = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes() if piece else b""
        if len(self) > MOST_PIECES:
            self.clear()
        if len(piece) < 64:
            self[piece] = made
        return made

    def _plain(self, text: str) -> bool:
        """Whether Python lower-cases and splits the text as the tokenizer does."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "\x85" not in text and "<|" not in text

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            return b"".join(map(self.__getitem__, self.split(text.lower())))
        return b"".join(map(self.__getitem__, self.space(text)))


def _encoder(name: str, end_id: int) -> WordEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(SparkFiles.get(name))
    return WordEncoder(tokenizer, 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)


def write_shards(docs: DataFrame, tokenizer_path: str, path: str | None = None, *, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD) -> str:
    """Encode whole texts, append `end_id` to each, write shards in ascending id order; returns the folder.

    Null texts are empty (their ids are the end id alone).  A null id comes
    first.  Rows with one id are all kept, in the order of their texts' hashes,
    and may be split over partitions.  An empty table gives a folder without
    shards.  `_manifest` in the folder lists the shards and their key ranges.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    spark.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_cached((name, end_id), lambda: _encoder(name, end_id))
        writer = ShardWriter(TaskContext.get().partitionId(), encoder.width, shard_bytes)
        end = end_id.to_bytes(encoder.width, "little")

        def shard(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            for part in slices(batch, 1):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    done = writer.add(key_of(i), encoder.encode(t) + end)
                    if done:
                        yield shard(done)
        done = writer.finish()
        if done:
            yield shard(done)

    shards = map_batches(rows, work, "value binary").select(F.col("value").cast("string").alias("value"))
    shards.write.option("maxRecordsPerFile", 1).option("lineSep", END.decode()).text(path)
    _write_manifest(spark, path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _write_manifest(spark: SparkSession, path: str) -> None:
    """One row for each shard in the folder's `_manifest`: file, part, sequence, ids, first and last key."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = ShardReader(data.as_py())
                first = next(iter(r))[0]
                values = ((name, pa.string()), (r.part, pa.int64()), (r.sequence, pa.int64()), (r.ids, pa.int64()), (first, pa.binary()), (r.last[-1], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["file", "part", "sequence", "ids", "first", "last"])

    found = map_batches(_files(spark, path), footers, "file string, part long, sequence long, ids long, first binary, last binary")
    found.coalesce(1).write.parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, part long, sequence long, ids long, first binary, last binary").parquet(f"{path}/_manifest")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, ids): ids packed as unsigned 32-bit, start the number of ids of all documents before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                reader = ShardReader(data.as_py())
                before = reader.before
                for block in range(len(reader.blocks)):
                    held = [(id_of(k), reader.array(v)) for k, v in reader.entries(block)]
                    starts = before + np.r_[0, np.cumsum([len(v) for _, v in held])]
                    before = int(starts[-1])
                    columns = [pa.array([reader.part] * len(held), pa.int64()), pa.array([k for k, _ in held], pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array([v.tobytes() for _, v in held], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "ids"])

    totals = manifest(spark, path).groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # a row for each partition written
    offsets, before = [], 0
    for t in totals:
        offsets.append((t["part"], before))
        before += t["ids"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))
    found = map_batches(_files(spark, path), rows, "part long, doc_id long, at long, ids binary")
    return found.join(offset, "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """Rows (doc_id, ids) of the wanted documents: shards whose key range may hold them, then Bloom filter and binary search in each."""
    keys = [(i, key_of(i)) for i in dict.fromkeys(doc_ids)]
    sought = spark.createDataFrame([(bytearray(k),) for _, k in keys], "key binary")
    files = [r["file"] for r in manifest(spark, path).join(F.broadcast(sought), F.col("key").between(F.col("first"), F.col("last"))).select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "doc_id long, ids binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                reader = ShardReader(data.as_py())
                found = [(i, reader.array(v).tobytes()) for i, k in keys for v in reader.lookup(k)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], names=["doc_id", "ids"])

    return map_batches(spark.read.format("binaryFile").load(files).select("content"), work, "doc_id long, ids binary")


def shard_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    held = read_shards(docs.sparkSession, write_shards(docs, tokenizer_path))
    return held.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
