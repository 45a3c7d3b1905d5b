"""Length-delimited binary records with masked checksums, and an offset index in a file of its own.

A record is: length (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the payload (u32).
The payload is: doc_id (i64), 1 if doc_id is null (u8), bytes per id (u8), the ids.  All integers are
little-endian.  The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum stored
inside checked data doesn't disturb the check.  ``<name>.idx`` holds the offset of each record as u64.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.llm.common import checkpoint, map_batches, narrow, prepare, scratch
from haulspark.llm.wordbpe import encoder

#: Fixed value of the record format's checksum mask.
MASK_DELTA = 0xA282EAD8
#: A file is closed when it has this many bytes, so that a reader's buffer stays small.
FILE_BYTES = 16 << 20
MANIFEST = "pid int, file_no int, file string, n_docs bigint, n_ids bigint"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and the offset after it.  Raises ValueError for damaged data."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"bad length checksum at {at}")
    n = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"bad payload checksum at {at}")
    return payload, at + 16 + n


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids


def parse(p: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from("<qBB", p)
    return (None if null else doc_id), np.frombuffer(p, f"<u{width}", offset=10)


class _Writer:
    def __init__(self, folder: str, pid: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.pid, self.no, self.buffer, self.offsets, self.at, self.ids = pid, 0, [], [], 0, 0
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, record: bytes, n_ids: int) -> dict | None:
        self.buffer.append(record)
        self.offsets.append(self.at)
        self.at += len(record)
        self.ids += n_ids
        return self.close() if self.at >= FILE_BYTES else None

    def _put(self, name: str, data: bytes) -> None:
        # A task that runs twice writes the same bytes; the move makes a file appear whole.
        part = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        there = f"{self.folder}/{name}"
        if self.fs.get_file_info(there).type != pafs.FileType.NotFound:  # not every file system moves onto a file
            self.fs.delete_file(part)
            return
        try:
            self.fs.move(part, there)
        except OSError:
            if self.fs.get_file_info(there).type == pafs.FileType.NotFound:
                raise

    def close(self) -> dict | None:
        if not self.buffer:
            return None
        name = f"part-{self.pid:06d}-{self.no:05d}"
        self._put(f"{name}.rec", b"".join(self.buffer))
        self._put(f"{name}.idx", np.array(self.offsets, "<u8").tobytes())
        row = {"pid": [self.pid], "file_no": [self.no], "file": [name], "n_docs": [len(self.buffer)], "n_ids": [self.ids]}
        self.no, self.buffer, self.offsets, self.at, self.ids = self.no + 1, [], [], 0, 0
        return row


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` and write them in ascending ``id_col`` order; returns the manifest.

    A null text counts as empty and gives a record of the end id alone; a null id comes first; documents of the
    same id keep all their records, ordered by text.  No rows give no files.  The manifest has a row per file.
    """
    from pyspark import TaskContext

    prepare(docs.sparkSession)
    d = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # by id and the text's beginning, so that many rows of one id, or of none, go to many tasks
    d = d.repartitionByRange("doc_id", F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")

    def make():
        enc = encoder(tokenizer)
        out = _Writer(folder, TaskContext.get().partitionId())
        last = np.array([end_id], enc.width).tobytes()

        def step(b: pa.RecordBatch):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += last
                rows.append(out.add(frame(payload(doc_id, ids, enc.width.itemsize)), len(ids) // enc.width.itemsize))
            yield from filter(None, rows)

        step.end = lambda: filter(None, [out.close()])
        return step

    return checkpoint(map_batches(d, make, MANIFEST))


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds each file's first position in the whole sequence of ids: sums by partition, then within one."""
    total = manifest.groupBy("pid").agg(F.sum("n_ids").alias("ids"))
    before = total.select("pid", F.coalesce(F.sum("ids").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("pid").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("own", own).join(before, "pid").select("file", (F.col("own") + F.col("before")).alias("start"), "n_docs", "n_ids")


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Reads the files back through their index: (doc_id, start, n_tokens, ids), every checksum verified."""
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = with_starts(manifest).repartition(n, "file")  # a number of its own: the rows are few, the files are not small

    def make():
        fs, base = pafs.FileSystem.from_uri(folder)

        def get(name: str) -> bytes:
            with fs.open_input_file(f"{base}/{name}") as f:
                return f.read()

        def step(b: pa.RecordBatch) -> Iterator[dict]:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, offsets = get(f"{name}.rec"), np.frombuffer(get(f"{name}.idx"), "<u8")
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                for at in offsets.tolist():
                    doc_id, ids = parse(unframe(data, at)[0])
                    for k, v in zip(out, (doc_id, start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                        out[k].append(v)
                    start += len(ids)
                    if len(out["ids"]) >= 2000:
                        yield out
                        out = {k: [] for k in out}
                yield out

        return step

    return map_batches(files, make, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ``docs``, reads the files back and digests them: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch(spark, "records")
    manifest = write_records(docs, folder, tokenizer, end_id)
    back = read_records(spark, folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
