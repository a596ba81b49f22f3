"""Length-delimited binary record files with masked checksums and a separate offset index (operator 4).

Record file: for each record  u64 length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of
the payload, all little-endian. Payload:  u8 has_id | i64 doc_id | u8 bytes per id (2 or 4) | the ids.
Index file: for each record  u64 place in the record file | u64 place of its first id among the shard's ids.
Both lie in one folder of any file system that pyarrow.fs opens: part-NNNNNN.rec and part-NNNNNN.idx.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwright.llm.common import materialize, new_path, partitions

FRAME, HEAD, ENTRY = struct.Struct("<QI"), struct.Struct("<BqB"), np.dtype([("place", "<u8"), ("first", "<u8")])


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that checksums of checksums don't cancel out."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(read, place: int) -> bytes:
    """The payload of the record at `place`; read(place, n) gives bytes. Damage raises ValueError."""
    head = read(place, 12)
    length, check = FRAME.unpack(head)
    if masked_crc(head[:8]) != check:
        raise ValueError(f"length checksum is wrong at {place}")
    body = read(place + 12, length + 4)
    if len(body) != length + 4 or masked_crc(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError(f"payload checksum is wrong at {place}")
    return body[:-4]


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return HEAD.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = HEAD.unpack_from(payload)
    return (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=HEAD.size).astype("<u4")


def write_records(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, files: int | None = None) -> tuple[str, DataFrame]:
    """Encode every text of (doc_id, text) and write its ids, files in ascending doc_id order. -> (folder, manifest).

    manifest: (shard, path, n_records, n_tokens). Null texts count as empty; null ids come first; rows that
    repeat an id lie together, ordered by their text's hash and their place in the input, so that one id, and even one
    row however often it is there, may fill several files. A task writes under a name of its own attempt and renames at
    the end, so that a repeated or speculative attempt leaves the same file. Range partitions hold ids of
    one range each, and texts are encoded after the shuffle, once.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange(files or partitions(spark), "doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from chartwright.llm.bpe import Encoder

        task = TaskContext.get()
        shard, encoder = task.partitionId(), Encoder.open(vocabulary)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/part-{shard:06d}", f"{root}/.part-{shard:06d}-{task.taskAttemptId()}"
        n = place = tokens = 0
        with store.open_output_stream(f"{own}.rec") as out, store.open_output_stream(f"{own}.idx") as index:
            for batch in batches:
                for at in range(0, batch.num_rows, 4000):
                    part = batch.slice(at, 4000)
                    ids, bounds = encoder.encode_batch(part.column(1), end_id)
                    for i, doc_id in enumerate(part.column(0).to_pylist()):
                        record = frame(pack_ids(doc_id, ids[bounds[i] : bounds[i + 1]]))
                        index.write(np.array([(place, tokens)], ENTRY).tobytes())
                        out.write(record)
                        n, place, tokens = n + 1, place + len(record), tokens + int(bounds[i + 1] - bounds[i])
        for end in (".rec", ".idx"):
            store.move(own + end, name + end) if n else store.delete_file(own + end)
        if n:
            yield pa.record_batch([pa.array([shard]), pa.array([f"{folder}/part-{shard:06d}"]), pa.array([n]), pa.array([tokens])], names=["shard", "path", "n_records", "n_tokens"])

    manifest = rows.mapInArrow(run, "shard long, path string, n_records long, n_tokens long")
    return folder, materialize(manifest, "manifest")


def shard_records(path: str, entries: np.ndarray | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, place of its first id in the shard, ids) of the records of one file, by its index.

    entries: rows of the index in any order, for shuffled reads; all rows in order by default.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    if entries is None:
        with store.open_input_file(f"{root}.idx") as f:
            entries = np.frombuffer(f.read(), ENTRY)
    with store.open_input_file(f"{root}.rec") as f:
        for e in entries:
            doc_id, ids = unpack_ids(unframe(lambda at, n: f.read_at(n, at), int(e["place"])))
            yield doc_id, int(e["first"]), ids


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every record of the files, start = number of ids before it over all shards.

    One task reads a file at a time through its index, record by record, checking both checksums.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for doc_id, first, ids in shard_records(path):
                    rows.append((doc_id, base + first, ids.tobytes()))
                    size += len(ids)
                    if size > 1 << 21:
                        yield _records(pa, rows)
                        rows, size = [], 0
                if rows:
                    yield _records(pa, rows)

    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", base.alias("base")).repartition(partitions(spark), "path")
    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def _records(pa, rows):
    doc_id, start, ids = zip(*rows, strict=True)
    return pa.record_batch([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
