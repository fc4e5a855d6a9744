"""Media columns: payloads stored by content in tar shards; rows carry digest, shard, offset and length.

:func:`store` encodes every payload as a lossless grey PNG (192 samples of 8 bits a row) and appends it to a
tar shard in the shared folder unless the shard already holds that digest. A shard is written in memory-bounded
pieces, named by the digest of what it holds and moved into place at its end: a task that runs again after a lost
executor writes the same bytes under the same name. :func:`load` reads ranges of the shards back: the first 33
bytes of a payload (signature and image header) fill the metadata columns, and the whole range gives the
payload's own digests. Rows meet their shards in the order of the shards, so that a task opens few files.

A copy of a payload that another task also holds is kept in both shards (no text is shuffled to find it); all
columns but the place (``shard``, ``offset``) depend on the content alone.

Null text is the empty text; its payload is one row of 192 spaces. Texts of any length are one payload each.
Repeated rows are rows of their own with equal values. An empty table gives no rows and no shards. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .common import shared_dir, small_batches, written

#: Samples in a row of the image; a payload is a positive multiple of it.
ROW = 192
#: Bytes of payloads and headers after which a task begins another shard: the bound of its memory.
SHARD_BYTES = 32 << 20
#: Bytes at the start of a payload that hold all its metadata: signature, length, type, image header, checksum.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(payload: bytes) -> bytes:
    """An 8-bit grey PNG of the payload, ROW samples a line, no filter."""
    lines = len(payload) // ROW
    raw = b"".join(b"\x00" + payload[i : i + ROW] for i in range(0, len(payload), ROW))
    head = struct.pack(">IIBBBBB", ROW, lines, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample and colour type from the first HEADER bytes."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR" or struct.pack(">I", zlib.crc32(start[12:29])) != start[29:33]:
        raise ValueError("not an image header")
    return struct.unpack(">IIBB", start[16:26])


def decoded(media: bytes) -> bytes:
    """The samples of a stored image."""
    width, height, _, _ = header(media[:HEADER])
    at, data = HEADER, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    raw = zlib.decompress(b"".join(data))
    if len(raw) != height * (width + 1):
        raise ValueError("samples and header differ")
    return b"".join(raw[i + 1 : i + 1 + width] for i in range(0, len(raw), width + 1))


class _Shard:
    """A tar file that grows in memory and is moved into place under the digest of its members."""

    def __init__(self):
        self.data, self.at, self.name = io.BytesIO(), {}, hashlib.sha256()

    def add(self, digest: str, media: bytes) -> tuple[int, int]:
        if digest not in self.at:
            entry = tarfile.TarInfo(f"{digest}.png")
            entry.size = len(media)
            self.data.write(entry.tobuf(tarfile.USTAR_FORMAT))
            self.at[digest] = self.data.tell(), len(media)
            self.data.write(media + b"\0" * (-len(media) % 512))
            self.name.update(digest.encode())
        return self.at[digest]

    def close(self, folder: str) -> str:
        store, base = fs.FileSystem.from_uri(folder)
        name = f"{self.name.hexdigest()[:32]}.tar"
        self.data.write(b"\0" * 1024)
        store.create_dir(base, recursive=True)
        part = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(self.data.getbuffer())
        store.move(part, f"{base}/{name}")
        return name


PLACED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """One row a document: where its payload lies. Tasks write the shards into the folder as the rows are computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = _Shard(), []

        def placed() -> pa.RecordBatch:
            name = shard.close(folder)
            ids, n, digests, at, length = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array([name] * len(rows), pa.string()), pa.array(at, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = (t or "").encode()
                digest = hashlib.sha256(payload := padded(text)).hexdigest()
                rows.append((i, len(text), digest, *(shard.at.get(digest) or shard.add(digest, encoded(payload)))))
                if shard.data.tell() >= SHARD_BYTES:
                    yield placed()
                    shard, rows = _Shard(), []
        if rows:
            yield placed()

    return docs.select("doc_id", "text").mapInArrow(run, PLACED)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long"


def load(placed: DataFrame, folder: str) -> DataFrame:
    """One row a row of :func:`store`: what its stored bytes say when read back.

    feature is read from the header alone: format, width, height, bits a sample, colour type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for b in batches:
            out = []
            for doc, n, digest, shard, at, length in zip(*(c.to_pylist() for c in b.columns)):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open_input_file(f"{base}/{shard}")
                width, height, bits, kind = header(file.read_at(min(HEADER, length), at))
                media = file.read_at(length, at)
                payload = decoded(media)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"shard {shard} at {at}: another payload than the row says")
                out.append((doc, n, len(payload), found, zlib.crc32(payload[-16:]), length, hashlib.sha256(media).hexdigest(), f"png {width}x{height} {bits} bit type {kind}", shard, at))
            cols = list(zip(*out)) or [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        if file is not None:
            file.close()

    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_shard = placed.select("doc_id", "n_bytes", "digest", "shard", "offset", "length").repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    return by_shard.mapInArrow(run, READ)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text's payload in a folder of its own and returns what reading it back gives (see :data:`READ`)."""
    small_batches(docs.sparkSession)
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{os.path.abspath(folder)}"
    return load(written(store(docs, folder), "media-rows"), folder)
