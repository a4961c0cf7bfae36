"""Operator 12, token files: ids in shuffled planes, compressed, with a chunk index.

Documents are sorted by doc_id over the cluster. A task encodes its documents, appends an
end id to each, and writes the ids in chunks of fixed size. A chunk is transposed into
planes: byte planes (the first bytes of all its ids, then the second ones, ...) or bit
planes; each plane that is not all zero is compressed with zstandard on its own. At the
end of a file lie the chunks' places, and the doc_id and length of each document. Files
are named by no one else, and only those listed in the manifest, which is written last,
belong to the data: what a lost task leaves behind is never read.

A file: MAGIC; the planes of all chunks; the index; its place and length (two uint64); MAGIC.

Defined results: a null text is an empty one and gives just the end id; a null doc_id
comes first; rows of one doc_id are ordered by a hash of the text, and equal rows are
written each; an empty table gives a manifest without files; other columns are ignored.
Long texts run over many chunks; a task holds one chunk beside the text it encodes.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches
from provlake.llm._text import SAME, batches_of, fingerprints, text_buffers
from provlake.llm.packing import CACHE_WORDS, MAX_VOCABULARY_BYTES, Encoder

MAGIC = b"IDPLANE1"
END_ID = 0
CHUNK_IDS = 1 << 16
#: a file ends with the document that reaches this many ids
FILE_IDS = 1 << 26
LEVEL = 3
#: a text with this string is encoded whole: the vocabulary has one id for it
SPECIAL = b"<|endoftext|>"
MAX_CACHED_IDS = 1 << 24
MANIFEST = "part int, sub int, file string, n_docs long, n_ids long, n_bytes long"
_TAIL = struct.Struct("<QQ8s")

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ALNUM, _SIGN = (np.array([x < 128 and f(chr(x)) for x in range(256)]) for f in (str.isalnum, lambda c: "!" <= c <= "~" and not c.isalnum() and c != "'"))


class ByteEncoder(Encoder):
    """Ids of a byte-level vocabulary by pieces that it never joins: what its pattern matches
    cannot reach over a visible sign followed by white space, nor from an ASCII letter or digit
    to an ASCII sign other than the apostrophe. Each distinct piece is encoded once."""

    kept: dict[str, Encoder] = {}

    def clear(self) -> None:
        super().clear()
        self.flat[0] = END_ID

    @staticmethod
    def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each piece."""
        n = len(raw)
        unsure = (raw >= 0x1C) & (raw <= 0x1F)  # and the last byte of what may be white space beyond ASCII
        one, two = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
        one[1:], two[2:] = raw[:-1], raw[:-2]
        unsure |= (one == 0xC2) & ((raw == 0x85) | (raw == 0xA0))
        unsure |= ((two >= 0xE1) & (two <= 0xE3) & (one >= 0x80) & (one <= 0x81)) | ((two == 0xE1) & ((one == 0x9A) | (one == 0xA0))) | ((two == 0xEF) & (one == 0xBB))
        blank, alnum, sign = _BLANK[raw], _ALNUM[raw], _SIGN[raw]
        cut = np.zeros(n + 1, dtype=bool)
        cut[1:-1] = (blank[1:] & ~blank[:-1] & ~unsure[:-1]) | (alnum[1:] & sign[:-1]) | (sign[1:] & alnum[:-1])
        cut[offsets] = True
        places = np.flatnonzero(cut)
        return places[:-1], places[1:]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows on end, offsets of the rows), each row with its end id."""
        raw, offsets = text_buffers(column)
        if SPECIAL in raw.tobytes():
            each = [np.array([*self.tokenizer.encode(x or "", add_special_tokens=False).ids, END_ID], dtype=np.uint32) for x in column.to_pylist()]
            return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        start, end = self.pieces(raw, offsets) if len(raw) else (np.zeros(0, dtype=np.int64),) * 2
        first = np.searchsorted(start, offsets)  # pieces before each row
        distinct, at, place = np.unique(fingerprints(SAME[raw], start, end), return_index=True, return_inverse=True)
        if len(self.start) + len(distinct) > CACHE_WORDS or len(self.flat) > MAX_CACHED_IDS:
            self.clear()
        found = self.find(self.most, distinct)
        found = np.where(found < 0, self.find(self.latest, distinct), found)
        new = np.flatnonzero(found < 0)
        found[new] = self.learn(distinct[new], [raw[a:b].tobytes().decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
        known = np.insert(found[place], first[1:], 0)  # place 0 is the end id
        begin, length = np.frombuffer(self.start, dtype=np.int64)[known], np.frombuffer(self.length, dtype=np.int64)[known]
        ends = np.cumsum(length)
        ids = np.frombuffer(self.flat, dtype=np.uint32)[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends[first[1:] + np.arange(len(offsets) - 1)]))


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of some ids, lowest first; a plane of zeros is empty."""
    parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        parts = [np.packbits((parts[k // 8] >> np.uint8(k % 8)) & 1) for k in range(32)]
    return [p.tobytes() if p.any() else b"" for p in parts]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros((4, n), dtype=np.uint8)
    for k, p in enumerate(planes):
        if p and bits:
            out[k // 8] |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n) << np.uint8(k % 8)
        elif p:
            out[k] = np.frombuffer(p, dtype=np.uint8)
    return np.ascontiguousarray(out.T).view("<u4").reshape(-1)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class PlaneWriter:
    """One file; chunks are written as they fill."""

    def __init__(self, out, bits: bool = False, chunk_ids: int = CHUNK_IDS):
        self.out, self.bits, self.chunk_ids = out, bits, chunk_ids
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.n_held, self.at, self.n_ids = [], 0, len(MAGIC), 0
        self.places, self.lengths = array("Q"), array("Q")
        self.docs, self.known, self.tokens = array("q"), bytearray(), array("Q")
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.known.append(doc is not None)
        self.tokens.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.chunk_ids:
            self._chunks(False)

    def _chunks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        upto = len(ids) if last else len(ids) // self.chunk_ids * self.chunk_ids
        for at in range(0, upto, self.chunk_ids):
            planes = [self.pack.compress(p) if p else b"" for p in to_planes(ids[at : min(at + self.chunk_ids, upto)], self.bits)]
            self.places.append(self.at)
            self.lengths.extend(map(len, planes))
            self.out.write(body := b"".join(planes))
            self.at += len(body)
        self.held, self.n_held = [ids[upto:].copy()], len(ids) - upto

    def close(self) -> int:
        """Writes the rest and the index; the size of the file."""
        self._chunks(True)
        head = json.dumps({"bits": self.bits, "chunk_ids": self.chunk_ids, "n_ids": self.n_ids, "n_chunks": len(self.places), "n_docs": len(self.docs)}).encode()
        body = struct.pack("<Q", len(head)) + head + b"".join(np.frombuffer(x, dtype="<u8").tobytes() if len(x) else b"" for x in (self.places, self.lengths, self.tokens)) + self.docs.tobytes() + bytes(self.known)
        index = self.pack.compress(body)
        self.out.write(index)
        self.out.write(_TAIL.pack(self.at, len(index), MAGIC))
        return self.at + len(index) + _TAIL.size


class PlaneFile:
    """One file, read by its index: only the chunks that are asked for."""

    def __init__(self, source):
        self.source, size = source, source.size() if hasattr(source, "size") and callable(source.size) else source.seek(0, io.SEEK_END)
        if size < len(MAGIC) + _TAIL.size:
            raise ValueError("not a file of token planes")
        at, length, magic = _TAIL.unpack(self._bytes(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token planes")
        unpack = self.unpack = zstandard.ZstdDecompressor()
        body = unpack.decompress(self._bytes(at, length))
        n = struct.unpack_from("<Q", body)[0]
        head = json.loads(body[8 : 8 + n])
        self.bits, self.chunk_ids, self.n_ids = head["bits"], head["chunk_ids"], head["n_ids"]
        planes, at = 32 if self.bits else 4, 8 + n

        def taken(count, kind):
            nonlocal at
            out = np.frombuffer(body, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.places = taken(head["n_chunks"], "<u8").astype(np.int64)
        self.lengths = taken(planes * head["n_chunks"], "<u8").astype(np.int64).reshape(-1, planes)
        self.tokens = taken(head["n_docs"], "<u8").astype(np.int64)
        self.docs, known = taken(head["n_docs"], "<i8"), taken(head["n_docs"], "u1")
        self.doc_ids = [int(x) if y else None for x, y in zip(self.docs, known, strict=True)]

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        body, planes, at = self._bytes(int(self.places[k]), int(self.lengths[k].sum())), [], 0
        for n in self.lengths[k].tolist():
            planes.append(self.unpack.decompress(body[at : at + n]) if n else b"")
            at += n
        return from_planes(planes, min(self.chunk_ids, self.n_ids - k * self.chunk_ids), self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop, from the chunks that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        low = start // self.chunk_ids
        got = np.concatenate([self.chunk(k) for k in range(low, (stop - 1) // self.chunk_ids + 1)])
        return got[start - low * self.chunk_ids : stop - low * self.chunk_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order; each chunk is unpacked once."""
        at, ready, held, k = 0, 0, [], 0
        for doc, n in zip(self.doc_ids, self.tokens.tolist(), strict=True):
            while ready < n:
                held.append(self.chunk(k))
                ready, k = ready + len(held[-1]), k + 1
            ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, dtype="<u4")
            yield doc, at, ids[:n]
            held, ready, at = [ids[n:]], len(ids) - n, at + n


def write(docs: DataFrame, vocabulary_path: str, folder: str, bits: bool = False, chunk_ids: int = CHUNK_IDS, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all texts, in ascending order of doc_id, as files below folder."""
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary exceeds the broadcast bound")
    vocabulary = docs.sparkSession.sparkContext.broadcast(content)
    bounded_batches(docs.sparkSession)

    def run(batches):
        encoder, part, sub, writer, out = ByteEncoder.of(vocabulary.value), TaskContext.get().partitionId(), 0, None, None

        def closed():
            size = writer.close()
            out.close()
            row = [part, sub, name, len(writer.docs), writer.n_ids, size]
            return pa.RecordBatch.from_arrays([pa.array([v], type=pa.int32() if k < 2 else pa.string() if k == 2 else pa.int64()) for k, v in enumerate(row)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches_of(batches, "text"):
            every, at = encoder.ids(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.planes"
                    system, base = _at(f"{folder}/ids")
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}")
                    writer = PlaneWriter(out, bits, chunk_ids)
                writer.add(doc, every[at[k] : at[k + 1]])
                if writer.n_ids >= file_ids:
                    yield closed()
                    writer, sub = None, sub + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(file, ids before it) in order; as many as there were tasks."""
    total, out = 0, []
    for r in sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: (r["part"], r["sub"])):
        out.append((f"{folder}/ids/{r['file']}", total))
        total += r["n_ids"]
    return out


def ids(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """The ids from start to before stop of the whole data, by the index."""
    listed, got = files(spark, folder), []
    for k, (path, base) in enumerate(listed):
        if base < stop and (k + 1 == len(listed) or listed[k + 1][1] > start):
            system, at = _at(path)
            with system.open_input_file(at) as f:
                got.append(PlaneFile(f).ids(start - base, stop - base))
    return np.concatenate(got) if got else np.zeros(0, dtype="<u4")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's place and its ids as little-endian uint32, from the files."""
    listed = files(spark, folder)
    bounded_batches(spark)
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.binary() if k == 3 else pa.int64()) for k in range(4)], names=names)

        for some in batches:
            for path, base in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                system, at = _at(path)
                with system.open_input_file(at) as f:
                    rows, size = [], 0
                    for doc, start, found in PlaneFile(f).documents():
                        rows.append((doc, base + start, len(found), found.astype("<u4").tobytes()))
                        size += 4 * len(found)
                        if size >= 1 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    places = spark.createDataFrame(listed, "file string, base long")
    return places.repartition(max(1, len(listed))).mapInArrow(run, schema)
