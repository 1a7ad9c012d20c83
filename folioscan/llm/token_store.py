"""Token ids in sorted-string-table files.

A file holds documents in ascending key order::

    data block ... data block | Bloom filter | block index | footer

* entry: varint bytes shared with the previous key, varint further key bytes,
  varint value bytes, key bytes, value. Every ``RESTART`` entries a key is
  whole; the block ends with the restart offsets (unsigned 32-bit) and their
  number, so a key is found by binary search over restarts.
* value: the ids, as unsigned 16-bit or 32-bit little-endian integers (see the footer).
* a block is stored zstd-compressed, followed by the crc32 of what is stored.
* Bloom filter: ``BLOOM_BITS`` bits a key, ``BLOOM_HASHES`` probes.
* block index: for each block its last key, place, stored size, documents and
  the number of ids before it; a lookup reads one block.
* footer (fixed size): places of filter and index, documents, ids, id width, magic.

A key is a byte 1 and the identifier as a biased big-endian 64-bit integer, so
byte order is numeric order, or a byte 2 and its text in UTF-8; a null
identifier is the single byte 0.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, qualified
from .tokens import encoded_texts

MAGIC = b"FOLIOSST"
RESTART = 16
BLOCK_BYTES = 256 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQI8s")


def key_of(doc_id: int | str | None) -> bytes:
    if doc_id is None:
        return b"\0"
    return b"\2" + doc_id.encode() if isinstance(doc_id, str) else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | str | None:
    if key[0] == 2:
        return key[1:].decode()
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
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


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


def split_uri(path: str) -> tuple[object, str]:
    """File system (None: this machine's) and path in it."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def replacing(path: str):
    """A file to write that takes the place of ``path`` when whole, so a task that runs again leaves one file."""
    system, local = split_uri(path)
    own = f"{local}.{uuid.uuid4().hex}.tmp"
    if system is None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(own, "wb") as f:
            yield f
        os.replace(own, local)
    else:
        with system.open_output_stream(own) as f:
            yield f
        system.move(own, local)


class TableWriter:
    """Writes one file; keys must not descend."""

    def __init__(self, out, wide: bool = False):
        import zstandard

        self.out, self.wide = out, wide
        self.pack = zstandard.ZstdCompressor(level=1)
        self.at = self.docs = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.first = self.last = None
        self._clear()

    def _clear(self) -> None:
        self.block, self.size, self.restarts, self.entries, self.before, self.previous = [], 0, [], 0, self.ids, b""

    def add(self, doc_id: int | str | None, ids: bytes) -> None:
        """``ids``: packed unsigned 32-bit little-endian integers."""
        key = key_of(doc_id)
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(self.size)
        else:
            shared = len(os.path.commonprefix([self.previous, key]))
        value = ids if self.wide else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += (entry, value)
        self.size += len(entry) + len(value)
        self.entries += 1
        self.docs += 1
        self.ids += len(ids) // 4
        self.first = key if self.first is None else self.first
        if key != self.last:
            self.keys.append(key)
        self.previous = self.last = key
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        raw = b"".join(self.block) + np.array([*self.restarts, len(self.restarts)], dtype="<u4").tobytes()
        stored = self.pack.compress(raw)
        self.out.write(stored)
        self.out.write(struct.pack("<I", zlib.crc32(stored)))
        self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QQQQ", self.at, len(stored), self.entries, self.before))
        self.at += len(stored) + 4
        self._clear()

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(bytes(bloom))
        self.out.write(index)
        self.out.write(_FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.docs, self.ids, 4 if self.wide else 2, MAGIC))


class TableReader:
    """Reads one file: in order with ``scan``, or one key with ``get``."""

    def __init__(self, path: str):
        import zstandard

        system, local = split_uri(path)
        self.file = open(local, "rb") if system is None else system.open_input_file(local)  # noqa: SIM115
        self.unpack = zstandard.ZstdDecompressor()
        self.file.seek(0, 2)
        self.file.seek(self.file.tell() - _FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.docs, self.ids, self.width, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token table: {path}")
        self.file.seek(bloom_at)
        self.bloom = self.file.read(bloom_n)
        index, at = self.file.read(index_n), 0
        self.lasts: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        while at < len(index):
            n, at = _read_varint(index, at)
            self.lasts.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QQQQ", index, at + n))
            at += n + 32

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _block(self, k: int) -> bytes:
        place, n, _, _ = self.blocks[k]
        self.file.seek(place)
        stored = self.file.read(n)
        if struct.unpack("<I", self.file.read(4))[0] != zlib.crc32(stored):
            raise ValueError("a block is damaged")
        return self.unpack.decompress(stored)

    def _entries(self, raw: bytes, at: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        end = len(raw) - 4 - 4 * struct.unpack_from("<I", raw, len(raw) - 4)[0]
        while at < end:
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + n]
            at += n

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype="<u4" if self.width == 4 else "<u2").astype("<u4")

    def scan(self) -> Iterator[tuple[int | str | None, int, np.ndarray]]:
        """(identifier, ids before it in this file, ids) in key order."""
        before = 0
        for k in range(len(self.blocks)):
            for key, value in self._entries(self._block(k), 0):
                ids = self._ids(value)
                yield id_of(key), before, ids
                before += len(ids)

    def get(self, doc_id: int | str | None) -> list[np.ndarray]:
        """Ids of the documents with this identifier (none: an empty list)."""
        import bisect

        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return []
        found: list[np.ndarray] = []
        for k in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            raw = self._block(k)
            n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
            restarts = struct.unpack_from(f"<{n}I", raw, len(raw) - 4 - 4 * n)
            first = lambda r: next(self._entries(raw, restarts[r]))[0]  # noqa: B023, E731
            r = max(0, bisect.bisect_left(range(n), key, key=first) - 1)
            for have, value in self._entries(raw, restarts[r]):
                if have > key:
                    return found
                if have == key:
                    found.append(self._ids(value))
            if self.lasts[k] > key:
                break
        return found


def id_type(docs: DataFrame, id_col: str) -> str:
    """The type that identifiers are stored as: bigint or string."""
    return "bigint" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every document and writes it to table files under ``path``, in ascending id order across files.

    Only text is shuffled (one range exchange on the id, equal ids dealt by
    the text's hash); ids are made where they are written. Returns the
    manifest, a row for each file: shard, path, docs, ids, offset (ids in
    earlier files).

    Identifiers are whole numbers of up to 64 bits or else texts (of other
    types: their text), in numeric or byte order. A null id comes first; a null
    text is the end id alone; rows with equal ids are all kept, next to each
    other. Other columns aren't read. An empty table gives no files.

    A ``path`` without a scheme is one of the default file system, as anywhere
    in Spark, and all executors must reach it.
    """
    kind = id_type(docs, id_col)
    path = qualified(docs.sparkSession, path)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        tail = np.array([end_id], dtype="<u4").tobytes()
        name = f"{path}/part-{shard:06d}.sst"
        with replacing(name) as out:
            wide = None
            for batch in (b for bs in ((first,), batches) for b in bs):
                if wide is None:
                    from .tokens import encoder

                    wide = max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
                    table = TableWriter(out, wide)
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded_texts(tokenizer_path, batch.column(1)), strict=True):
                    table.add(doc_id, ids + tail)
            table.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "docs": pa.array([table.docs], pa.int64()), "ids": pa.array([table.ids], pa.int64())})

    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    manifest = materialise(rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text").mapInArrow(run, "shard int, path string, docs long, ids long"), "token-manifest")
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.coalesce(F.sum("ids").over(upto), F.lit(0)))


def read_store(manifest: DataFrame, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Reads the files of a manifest: the identifier (``kind``: bigint or string), start (ids of all documents before), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with TableReader(name) as table:
                    rows = []
                    for doc_id, before, ids in table.scan():
                        rows.append((doc_id, offset + before, len(ids), zlib.crc32(ids)))
                        if len(rows) == 20_000:
                            yield of_rows(rows)
                            rows = []
                    if rows:
                        yield of_rows(rows)

    def of_rows(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "offset")
    # a number given is kept, so that files are read side by side however small the manifest is
    return files.repartition(max(1, files.count())).mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to a store in the shared folder and reads it back."""
    if id_col in ("start", "n_tokens", "ids_crc32"):
        raise ValueError(f"the result has a column {id_col} of its own")
    manifest = write_store(docs, new_path(docs.sparkSession, "token-store"), tokenizer_path, end_id, id_col, text_col)
    return read_store(manifest, id_col, id_type(docs, id_col))
