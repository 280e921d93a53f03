"""Token-id output as sorted-string-table shards.

Documents are dealt out by ranges of doc_id of about SHARD_DOCS documents,
sorted, encoded, and each range is written as one shard file.  A shard is
streamed: memory holds one block, one Bloom filter being filled, the finished
filters (BLOOM_BITS_PER_KEY a key) and an index entry a block.

    block*      records sorted by key, in blocks of about BLOCK_BYTES
    index       one entry a block: its first key, offset, length, records
    bloom       Bloom filters over the keys, one for each BLOOM_KEYS of them in order
    footer      fixed size: places of index and bloom, counts, id width, magic

A record is ``varint shared | varint rest | varint value bytes | rest of key |
value``: keys are prefix-compressed against the record before, values are the
ids in 2 bytes (4 if the vocabulary needs them), little-endian.  A block is
compressed and followed by a CRC-32.  The key is doc_id as eight big-endian
bytes with the sign bit flipped, so that byte order is number order; a null
doc_id has the empty key and sorts first.

A shard is written under another name and then moved, so a task that is run
again replaces the same file with the same bytes.  ``lookup`` finds documents
by the shards' key ranges, Bloom filter, and binary search in the sparse index.

Defined results: a null or empty text holds the end id alone; very long texts
are one record; rows that repeat a doc_id are all kept, next to each other,
ordered by a hash of their text, in several shards if they are many; other
columns, whatever their names, are not looked at; an empty table has no shards.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN_TEXT, PLAIN_WORDS, byte_letters, filesystem, id_and_text, shared_dir, tokenizer

MAGIC = b"TKSST002"
BLOCK_BYTES = 1 << 16
#: Documents of a shard, about; there are as many shards as cores at least.
SHARD_DOCS = 200_000
BLOOM_KEYS = 1 << 15
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
_FOOTER = struct.Struct("<QQQQQQII8s")
_INDEX = struct.Struct("<QII")

KEPT_WORDS = 400_000
KEPT_LENGTH = 64

class _Words(dict):
    """word -> ids as bytes, by the library's model; bounded."""

    def __init__(self, tok):
        self.model = tok.model
        self.map = byte_letters()

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else "".join(map(self.map.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class LibraryEncoder:
    """Ids as the library gives them; the words of plain texts are encoded once."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.words = _Words(self.tok)

    def __call__(self, text: str) -> bytes:
        if PLAIN_TEXT.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.words.__getitem__, PLAIN_WORDS.findall(text.lower())))
        enc = self.tok.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(enc.ids, "<u4").tobytes()


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


_BLOOM_BITS = BLOOM_KEYS * BLOOM_BITS_PER_KEY


def _bloom_places(key: bytes) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % _BLOOM_BITS for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Streams records, in key order, to an open binary file."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.n_docs = self.n_tokens = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.blooms: list[tuple[bytes, bytearray]] = []
        self.n_keys, self.key = 0, None
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self._start()

    def _start(self) -> None:
        self.block, self.held, self.first, self.last, self.count = [], 0, None, b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        record = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(record)
        self.held += len(record)
        self.last = key
        self.count += 1
        if key != self.key:
            self._remember(key)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _remember(self, key: bytes) -> None:
        if self.n_keys % BLOOM_KEYS == 0:
            self.blooms.append((key, bytearray(_BLOOM_BITS // 8)))
        bits = self.blooms[-1][1]
        for p in _bloom_places(key):
            bits[p >> 3] |= 1 << (p & 7)
        self.n_keys += 1
        self.key = key

    def _flush(self) -> None:
        if self.count:
            data = self.compress(b"".join(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.count))
            self.at += len(data)
            self._start()

    def finish(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _INDEX.pack(o, n, c) for k, o, n, c in self.index)
        bloom = b"".join(bytes([len(k)]) + k + bits for k, bits in self.blooms)
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(
            _FOOTER.pack(
                self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_tokens,
                self.width, zlib.crc32(index), MAGIC,
            )
        )


class Shard:
    """Reads one shard file of any file system that pyarrow knows."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        footer = self.file.read_at(_FOOTER.size, size - _FOOTER.size)
        i_at, i_len, b_at, b_len, self.n_docs, self.n_tokens, self.width, crc, magic = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw = self.file.read_at(i_len, i_at)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{uri}: the index is damaged")
        self.index, at = [], 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *_INDEX.unpack_from(raw, at + n)))
            at += n + _INDEX.size
        self.first_keys = [x[0] for x in self.index]
        self.bloom_at, self.bloom_len, self.bloom = b_at, b_len, None
        self.expand = zstandard.ZstdDecompressor().decompress

    def records(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, count = self.index[block]
        data = self.file.read_at(n, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        buf, at, key = self.expand(data[:-4]), 0, b""
        for _ in range(count):
            shared, at = _read_varint(buf, at)
            rest, at = _read_varint(buf, at)
            n, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            yield key, np.frombuffer(buf, "<u2" if self.width == 2 else "<u4", n // self.width, at).astype("<u4")
            at += n

    def may_hold(self, key: bytes) -> bool:
        """Whether the filter for keys from this place in their order on knows the key."""
        if self.bloom is None:
            raw, at, self.bloom = self.file.read_at(self.bloom_len, self.bloom_at), 0, []
            while at < len(raw):
                n = raw[at]
                bits = at + 1 + n
                self.bloom.append((raw[at + 1 : bits], raw[bits : bits + _BLOOM_BITS // 8]))
                at = bits + _BLOOM_BITS // 8
        i = bisect.bisect_right(self.bloom, key, key=lambda x: x[0]) - 1
        return i >= 0 and all(self.bloom[i][1][p >> 3] >> (p & 7) & 1 for p in _bloom_places(key))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every record of that key."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found = []
        for block in range(max(0, bisect.bisect_left(self.first_keys, key) - 1), len(self.index)):
            if self.first_keys[block] > key:
                break
            found += [ids for k, ids in self.records(block) if k == key]
        return found


MANIFEST = "shard long, uri string, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint"


def write(docs: DataFrame, path: str, end_id: int, to: str) -> list:
    """Write shards below the folder ``to``; the manifest, one row a shard in key order.

    The manifest on the driver has a row for about SHARD_DOCS documents.  Rows
    that are equal in doc_id and text may stand in different shards, so many of
    them do not meet in one task.
    """
    rows = id_and_text(docs).withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // SHARD_DOCS))
    by = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ordered = rows.repartitionByRange(n, *by, F.col("_row")).sortWithinPartitions(*by, "text").select("doc_id", "text")

    def shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        width = 2 if max(encode.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4")
        number = TaskContext.get().partitionId()
        writer = stream = first = last = None
        fs, root = filesystem(to)
        name, temp = f"{root}/shard-{number:06d}.sst", f"{root}/.shard-{number:06d}-{uuid.uuid4().hex}"
        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(temp)
                    writer, first = ShardWriter(stream, width), doc_id
                writer.add(key_of(doc_id), np.concatenate([np.frombuffer(encode(text.as_py()), "<u4"), end]))
                last = doc_id
        if writer is not None:
            writer.finish()
            stream.close()
            fs.move(temp, name)
            row = [number, f"{to}/shard-{number:06d}.sst", first, last, writer.n_docs, writer.n_tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.string(), *[pa.int64()] * 4))],
                names=["shard", "uri", "first_id", "last_id", "n_docs", "n_tokens"],
            )

    manifest = sorted(ordered.mapInArrow(shard, MANIFEST).collect(), key=lambda r: r.shard)
    _remove_unfinished(to)
    return manifest


def _remove_unfinished(to: str) -> None:
    """Delete what attempts that failed have left."""
    fs, root = filesystem(to)
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(".shard-"):
            fs.delete_file(f.path)


def read(spark: SparkSession, manifest: list, with_ids: bool = False) -> DataFrame:
    """Every record of the shards: doc_id, start (ids before it), n_tokens, ids_crc32, and ids if wanted."""
    starts, at = [], 0
    for m in manifest:
        starts.append((m.uri, at))
        at += m.n_tokens
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    if not starts:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame(starts, "uri string, base bigint").repartition(len(starts))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(uri)
                for block in range(len(shard.index)):
                    rows = []
                    for key, ids in shard.records(block):
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes()), ids)[: 4 + with_ids])
                        start += len(ids)
                    types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return shards.mapInArrow(scan, schema)


def lookup(manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document, from the few shards whose range holds it."""
    key = key_of(doc_id)
    return [ids for m in manifest if key_of(m.first_id) <= key <= key_of(m.last_id) for ids in Shard(m.uri).get(doc_id)]


def query(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, path, 1, shared_dir(spark, "sst")))
