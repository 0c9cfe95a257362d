"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record file is a sequence of frames, all numbers little-endian:

    u64 length of the payload | u32 masked checksum of these 8 bytes
    payload                   | u32 masked checksum of the payload | byte 0x0A

The payload is ``i64 doc_id, u8 has_id, u8 width, u16 zero, u32 count`` and
``count`` ids of ``width`` bytes: two where the vocabulary allows it, else four.
A checksum is CRC-32, rotated right by 15 bits plus a constant, so that a
checksum stored among checksummed bytes does not cancel out.

The files are written by Spark's own writer, whose commit leaves one copy of
each task's file however often a task ran, on any file system Spark knows. The
byte after a frame is that writer's row separator; no reader needs to search
for it. File k holds ids below those of file k + 1.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vitalstream.llm.common import col, pieces_of
from vitalstream.llm.tokens import encoder, tokenizer_path

#: The usual masking constant; the end id; bytes of text meant for a file.
MASK_DELTA = 0xA282EAD8
END_ID = 2
FILE_BYTES = 32 << 20
HEAD = "<qBBHI"
INDEX_SCHEMA = (
    "file string, file_no int, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without the separator."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    payload = struct.pack(HEAD, doc_id or 0, doc_id is not None, width, 0, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frame_at(data: memoryview | bytes, at: int) -> tuple[int, int | None, np.ndarray]:
    """Offset after the record (and separator), document id, ids. Raises ``ValueError`` on damaged bytes."""
    try:
        (length,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"damaged length at byte {at}")
        payload = data[at + 12 : at + 12 + length]
        (check,) = struct.unpack_from("<I", data, at + 12 + length)
    except struct.error:
        raise ValueError(f"record cut off at byte {at}") from None
    if masked(payload) != check:
        raise ValueError(f"damaged record at byte {at}")
    doc_id, has_id, width, _, count = struct.unpack_from(HEAD, payload)
    ids = np.frombuffer(payload, f"<u{width}", count, struct.calcsize(HEAD)).astype("<u4")
    return at + length + 17, doc_id if has_id else None, ids


def write_records(
    df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None,
    end_id: int = END_ID, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending order of ``doc_id`` and return the index.

    A null text is empty, a null id comes first; rows with equal ids are
    ordered by their text's hash and length. Other columns are not written. An empty table gives
    an empty index. The index is also stored, below ``path``/index.
    """
    tokenizer = tokenizer or tokenizer_path()
    docs = df.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text"), F.octet_length("text")]

    def run(batches):
        encode = encoder(tokenizer).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in pieces_of(batch, "text"):
                frames = [
                    frame(i, np.frombuffer(encode(t) + end, "<u4"))
                    for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    (
        docs.repartitionByRange(int(size // file_bytes) + 1, *order).sortWithinPartitions(*order)
        .mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
        .write.text(f"{path}/records")
    )
    index_records(df.sparkSession, path).write.parquet(f"{path}/index")
    return df.sparkSession.read.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content"
    )


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """The index, read from the record files: where each record lies, its tokens, and the ids before it in its file."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content")):
                yield from _index_of(file.as_py(), memoryview(content.as_buffer()))

    names = _files(spark, path).mapInArrow(
        run, "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"
    )
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return names.withColumn("file_no", number).select(*[f.split()[0] for f in INDEX_SCHEMA.split(", ")])


def _index_of(file: str, data: memoryview) -> Iterator[pa.RecordBatch]:
    names = ["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "before"]
    rows, at, before = [], 0, 0
    while at < len(data):
        after, doc_id, ids = frame_at(data, at)
        rows.append((file, at, after - at - 1, doc_id, len(ids), zlib.crc32(ids.tobytes()), before))
        before += len(ids)
        at = after
        if len(rows) == 8192 or at >= len(data):
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []


def with_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``: the ids of all records before this one, over all files.

    Only one row per file meets in one place.
    """
    files = index.groupBy("file", "file_no").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("file_no", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return index.join(files, "file").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted``, some rows of the index in any order, names: ``doc_id`` and ``ids`` as an array.

    A file is read once, and only where a record of it is wanted; within a file
    records are read by offset. To read in shuffled order, sort the result by a
    column of one's own, such as a hash of ``doc_id``.
    """
    offsets = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def run(batches):
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist()):
                data = memoryview(content.as_buffer())
                for i in range(0, len(offsets), 256):
                    found = [frame_at(data, at)[1:] for at in offsets[i : i + 256]]
                    ids = pa.array([x.tolist() for _, x in found], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), ids], ["doc_id", "ids"])

    return _files(spark, path).join(offsets, "file").select("content", "offsets").mapInArrow(
        run, "doc_id long, ids array<int>"
    )
