"""Token ids in sorted-string-table shards.

Documents are ranged by id over partitions, tokenized there and written, in ascending id order, as shard files:

    magic | blocks | index | filter | footer

A block holds entries until BLOCK_BYTES: shared key bytes, new key bytes and value bytes as variable-length
integers, the new part of the key, and the value (ids as unsigned 16-bit integers if all fit, else 32-bit, after a
byte that says which). Keys are 9 bytes: a null mark and the id, big-endian with the sign flipped, so byte order is
id order. The index has each block's first key and place; the filter is a Bloom filter over the keys; the footer has
the places of both, the counts and a checksum. A lookup asks the filter, finds the block by binary search in the
index and reads that block alone.

A task writes files under names of their own, and only the rows of its manifest that Spark commits say which files
count: an attempt that is lost or repeated leaves files that no manifest names. All files are in the shared folder.

Edge cases: a null text has the end id alone; a null doc_id sorts first; documents with equal ids are all kept, in the
order of a hash of their texts, in several files if they are many; equal rows are entries each; a text of any length is
one entry; an empty table gives an empty manifest and no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, filesystem, fresh_path, ids_of, ranged_by_id, rows_frame, split_id, written
from ._tokens import END_ID, shared_words, tokenizer_path

MAGIC = b"LUMSST01"
BLOCK_BYTES = 32 << 10
SHARD_BYTES = 64 << 20
BITS_PER_KEY = 10
PROBES = 7
FOOTER = struct.Struct("<QQQQQQI8s")
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", int(doc_id) + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


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
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> np.ndarray:
    h = xxhash.xxh3_128_intdigest(key)
    return np.array([((h & (1 << 64) - 1) + k * (h >> 64 | 1)) % bits for k in range(PROBES)], np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


class Writer:
    """One shard file; keys must come in ascending order."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out = uri, fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.size, self.block, self.last = len(MAGIC), [], b""
        self.in_block, self.index, self.keys, self.n_tokens = 0, [], [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.in_block >= BLOCK_BYTES:
            self._flush()
        value = pack_ids(ids)
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.in_block += len(entry) + len(value)
        self.last = key
        self.keys.append(key)
        self.n_tokens += len(ids)

    def _flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.out.write(data)
            self.index.append((self.first, self.size, len(data)))
            self.size += len(data)
            self.block, self.in_block = [], 0

    def close(self) -> tuple[str, int, int]:
        self._flush()
        index = b"".join(k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = np.zeros(-(-max(1, len(self.keys)) * BITS_PER_KEY // 8) * 8, np.uint8)
        for k in set(self.keys):
            bits[_probes(k, len(bits))] = 1
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.size, len(index), self.size + len(index), len(bloom), len(self.keys), self.n_tokens, zlib.crc32(index + bloom), MAGIC))
        self.out.close()
        return self.uri, len(self.keys), self.n_tokens


class Reader:
    """One shard file: iterates over all entries, or looks up one key."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        at, n_index, bloom_at, n_bloom, self.n_docs, self.n_tokens, check, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        index, self.bloom = self._at(at, n_index), self._at(bloom_at, n_bloom)
        if magic != MAGIC or zlib.crc32(index + self.bloom) != check:
            raise ValueError(f"not a whole shard file: {uri}")
        self.index = [(index[k : k + 9], *struct.unpack_from("<QQ", index, k + 9)) for k in range(0, len(index), 25)]
        self.firsts = [k for k, _, _ in self.index]

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[k]
        data, i, key = self._at(at, n), 0, b""
        while i < n:
            shared, i = _read_varint(data, i)
            more, i = _read_varint(data, i)
            size, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + more]
            i += more
            yield key, unpack_ids(data[i : i + size])
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with that id."""
        key, out = key_of(doc_id), []
        p = _probes(key, len(self.bloom) * 8)
        if not all(self.bloom[b >> 3] & 128 >> (b & 7) for b in p.tolist()):
            return out
        k = bisect_right(self.firsts, key) - 1
        while k > 0 and self.firsts[k] == key:  # equal ids may begin in the block before
            k -= 1
        for j in range(max(k, 0), len(self.index)):
            if self.firsts[j] > key:
                break
            out += [ids for x, ids in self._block(j) if x == key]
        return out


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all documents as shards under path (a folder that all executors share); the committed manifest."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, seq, out, rows = shared_words(tokenizer), TaskContext.get().partitionId(), 0, None, []
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc_id, tokens in zip(ids_of(batch), words.encode(batch["text"].tolist())):
                if out is not None and out.size + out.in_block >= shard_bytes:
                    rows.append((part, seq, *out.close()))
                    out, seq = None, seq + 1
                if out is None:
                    out = Writer(f"{path}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.sst")
                out.add(key_of(doc_id), np.frombuffer(tokens + end, "<u4"))
        if out is not None:
            rows.append((part, seq, *out.close()))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return written(ranged_by_id(docs).select(split_id("text")).mapInPandas(write, MANIFEST), "sstable-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files."""
    # one row for each shard file, not for each document
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"].tolist()):
                rows, start = [], base
                for key, ids in Reader(path):
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield rows_frame(rows, ROWS)

    n = max(1, min(manifest.count(), 10_000))
    return placed.repartition(n, "path").mapInPandas(read, ROWS)


def lookup(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and ids (array) for each of a stated list of doc_ids, by lookup in every shard file whose filter may hold it."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                reader = Reader(path)
                yield pd.DataFrame([(i, x.tolist()) for i in wanted for x in reader.get(i)], columns=["doc_id", "ids"])

    return manifest.select("path").mapInPandas(find, "doc_id long, ids array<long>")


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(documents(spark, sf_dir), fresh_path(spark, "sstable"), tokenizer_path())
    return read_shards(manifest)
