"""WARC archives: sorted ranges, files rolled by compressed size, revisits for repeated payloads, a manifest (operator 13).

A file holds one gzip member a record, a warcinfo record first. A response's block is an HTTP head and the payload; a
revisit has the head alone and names the response with the same payload. Which record lies in which file follows from the
table alone: records are ordered by (page_id, nulls last; digest of url and payload; number among equal rows), and a
file ends where the sum of all compressed sizes so far passes a multiple of file_bytes. Only files that the manifest
lists count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwright.llm.common import discard, join_by_size, materialize, new_path, partitions

ORDER = ["nul", "page_id", "ident", "occ"]
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
#: Files of one archive at most: their first keys are sent to all tasks, some 60 bytes each.
MOST_FILES = 1 << 20
#: Tasks that write at most; more files are dealt among them in turn.
MOST_WRITERS = 20_000
STEP = 10_000


def ident(url: bytes | None, digest: bytes) -> bytes:
    return hashlib.sha256((b"" if url is None else b"u" + url) + digest).digest()


def record_id(kind: str, page_id: int | None, name: bytes, occ: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {page_id} {name.hex()} {occ}'.encode()).digest()[:16])}>"


def target(page_id: int | None, url: bytes | None) -> str:
    return f"urn:page:{page_id}" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; the same bytes on every run."""
    fields = [*fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"".join((head.encode(), block, b"\r\n\r\n"))) + pack.flush()


def page_record(kind: str, page_id, url, payload: bytes | None, digest: bytes, size: int, occ: int, date: str, first=None) -> bytes:
    """A response with its payload, or a revisit of first = (page_id, url)."""
    name = ident(url, digest)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page_id, name, occ)), ("WARC-Date", date), ("WARC-Target-URI", target(page_id, url)), ("Page-Id", page_id)]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", first[0], ident(first[1], digest), 0)), ("WARC-Refers-To-Target-URI", target(*first)), ("Refers-To-Page-Id", first[0])]
    fields += [("WARC-Payload-Digest", "sha256:" + digest.hex()), ("Payload-Length", size), ("Content-Type", "application/http; msgtype=response")]
    return record(fields, (HTTP % size).encode() + (payload or b""))


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", None, name.encode(), 0)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return record(fields, block)


def _batch(pa, rows: list[tuple], types: tuple, names: list[str]):
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def write_archive(pages: DataFrame, folder: str | None = None, file_bytes: int = 1 << 30, least_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write one record for each row of (page_id, url, html) into files of about file_bytes. -> (folder, manifest).

    manifest: (file, path, n_records, n_bytes, sha256), also written to <folder>/manifest when all files are in place. A
    task writes under a name of its own attempt and renames at the end; as the bytes follow from the table, a repeated
    or speculative attempt leaves the same file.
    Null html is an empty payload, a null url stands as urn:page:<page_id>. Of records with equal payloads of at least
    least_bytes, the first in the archive's order is the response, others revisit it; rows equal in all three columns are
    as many records. An empty table gives an empty manifest. Other columns are ignored.
    Equal rows are counted before they are shuffled, and a payload travels once: only the first of those that a task
    has seen in order can be the response, and all other records need no payload. Repeated digests are joined by size.
    """
    spark, n = pages.sparkSession, partitions(pages.sparkSession)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").cast("binary").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))

    def listed(batches):
        """(page_id, url, digest, n_bytes, small, size): small payloads whole, others with their record's compressed size."""
        import pyarrow as pa

        for batch in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = html or b""
                digest, few = hashlib.sha256(body).digest(), len(body) < least_bytes
                out.append((page_id, url, digest, len(body), body if few else None, None if few else len(page_record("response", page_id, url, body, digest, len(body), 0, date))))
            if out:
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
                yield _batch(pa, out, types, ["page_id", "url", "digest", "n_bytes", "small", "size"])

    table = rows.mapInArrow(listed, "page_id long, url binary, digest binary, n_bytes long, small binary, size long")
    # small and size follow from the digest and the key
    table = materialize(table.groupBy("page_id", "url", "digest").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max("small").alias("small"), F.max("size").alias("size")), "listed")
    own = F.struct(F.col("page_id").isNull().alias("nul"), "page_id", F.expr("unhex(sha2(concat(coalesce(concat(encode('u', 'utf-8'), url), encode('', 'utf-8')), digest), 256))").alias("ident"), "url")
    first = table.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(own).alias("first")).where("n > 1")
    joined = join_by_size(table.withColumn("own", own), first, "digest", "n", table.count())
    leads = F.col("first").isNull() | (F.col("first.ident").eqNullSafe(F.col("own.ident")) & F.col("first.page_id").eqNullSafe(F.col("page_id")))
    # copies are numbered in two steps, as one array of them has no bound
    each = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(STEP))).alias("from"))
    each = each.select("*", F.explode(F.sequence("from", F.least(F.col("from") + STEP, "copies") - 1)).alias("occ")).withColumn("first", F.coalesce("first", "own"))
    each = each.select(
        F.col("own.nul").cast("int").alias("nul"), "page_id", F.col("own.ident").alias("ident"), "occ", "url", "digest", "n_bytes", "small", "size",
        F.when((F.col("n_bytes") >= least_bytes) & ~(leads & (F.col("occ") == 0)), "revisit").otherwise("response").alias("kind"),
        F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
    )
    sort = [F.asc(c) for c in ORDER]

    def composed(batches):
        """The records that need no payload, and the running sum of sizes within the task's range."""
        import pyarrow as pa
        from pyspark import TaskContext

        pid, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for nul, page_id, name, occ, url, digest, n_bytes, small, size, kind, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = None
                if kind == "revisit" or n_bytes < least_bytes:
                    member = page_record(kind, page_id, url, small if kind == "response" else None, digest, n_bytes, occ, date, (first_id, first_url))
                    size = len(member)
                out.append((nul, page_id, name, occ, member, pid, run))
                run += size
            types = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            if out:
                yield _batch(pa, out, types, ["nul", "page_id", "ident", "occ", "member", "pid", "before"])
        if run:  # the total of the range
            yield pa.record_batch([pa.array([None], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())] + [pa.array([pid]), pa.array([run])], names=["nul", "page_id", "ident", "occ", "member", "pid", "before"])

    known = each.repartitionByRange(n, *sort).sortWithinPartitions(*sort).mapInArrow(composed, "nul int, page_id long, ident binary, occ long, member binary, pid long, before long")
    known = materialize(known, "records")
    # one row a task
    base = known.where("nul is null").select("pid", F.coalesce(F.sum("before").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = known.where("nul is not null").join(F.broadcast(base), "pid").withColumn("file", F.floor((F.col("base") + F.col("before")) / file_bytes)).drop("pid", "before", "base")
    starts = placed.groupBy("file").agg(F.min(F.struct(F.col("nul"), F.coalesce("page_id", F.lit(0)).alias("page_id"), F.col("ident"), F.col("occ"))).alias("k")).orderBy("file").limit(MOST_FILES + 1).collect()
    if len(starts) > MOST_FILES:
        raise ValueError(f"over {MOST_FILES} files; take a larger file_bytes")
    bounds = spark.sparkContext.broadcast(([(r["k"]["nul"], r["k"]["page_id"], bytes(r["k"]["ident"]), r["k"]["occ"]) for r in starts], [r["file"] for r in starts]))

    def payloads(batches):
        """The response records of the payloads that come first among those that this task has seen."""
        import pyarrow as pa

        (keys, files), seen = bounds.value, {}
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = html or b""
                if len(body) < least_bytes:
                    continue
                digest = hashlib.sha256(body).digest()
                key = (int(page_id is None), page_id or 0, ident(url, digest), 0)
                if digest in seen and seen[digest] <= key:
                    continue
                seen[digest] = key
                out.append((files[bisect_right(keys, key) - 1], key[0], page_id, key[2], -1, page_record("response", page_id, url, body, digest, len(body), 0, date)))
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield _batch(pa, out, types, ["file", "nul", "page_id", "ident", "occ", "member"])

    whole = placed.select("file", *ORDER, "member").unionByName(rows.mapInArrow(payloads, "file long, nul int, page_id long, ident binary, occ long, member binary"))
    # files are dealt one by one: as many tasks as there are files, if tasks there be so many
    whole = whole.repartitionById(max(1, min(len(starts), MOST_WRITERS)), (F.col("file") % MOST_WRITERS).cast("int")).sortWithinPartitions("file", *sort)

    def write(batches):
        """A file's records in order; a payload comes right before the record that it belongs to, if any takes it."""
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt, now, out, held, done = TaskContext.get().taskAttemptId(), None, None, None, []

        def put(member):
            nonlocal n_bytes
            out.write(member)
            digest.update(member)
            n_bytes += len(member)

        def close():
            out.close()
            store.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")
            done.append((now, f"{folder}/{name}", n_records, n_bytes, digest.hexdigest()))

        for batch in batches:
            for file, nul, page_id, mark, occ, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    if out:
                        close()
                    now, name, n_records, n_bytes, digest = file, f"part-{file:08d}.warc.gz", 0, 0, hashlib.sha256()
                    out = store.open_output_stream(f"{root}/.{name}-{attempt}", compression=None)
                    put(_info(name, date))
                if occ < 0:
                    held = ((nul, page_id, mark), member)
                    continue
                if member is None:
                    if held is None or held[0] != (nul, page_id, mark):
                        raise ValueError(f"the payload of page {page_id} is missing")
                    member = held[1]
                put(member)
                n_records += 1
        if out:
            close()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["file", "path", "n_records", "n_bytes", "sha256"])

    schema = "file long, path string, n_records long, n_bytes long, sha256 string"
    whole.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    for used in (table, known):
        discard(used)
    return folder, spark.read.schema(schema).parquet(f"{folder}/manifest")


def file_records(path: str, sha256: str | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file, read one after another; wrong digests and cut files raise ValueError."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    total = hashlib.sha256()
    with store.open_input_stream(root, compression=None) as source:
        chunk, member, parts = b"", None, []
        while True:
            chunk = chunk or source.read(1 << 18)
            if not chunk:
                break
            if member is None:
                member, parts = zlib.decompressobj(31), []
            parts.append(member.decompress(chunk))
            rest = member.unused_data if member.eof else b""
            total.update(chunk[: len(chunk) - len(rest)])
            chunk = rest
            if member.eof:
                member = None
                yield _parsed(b"".join(parts), path)
    if member is not None:
        raise ValueError(f"{path} ends within a record")
    if sha256 and total.hexdigest() != sha256:
        raise ValueError(f"{path} isn't the file that the manifest lists")


def _parsed(data: bytes, path: str) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields.get("Content-Length", -1))]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields.get("WARC-Block-Digest"):
        raise ValueError(f"damaged record in {path}")
    return fields, block


def read_archive(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_id, record_type, payload, payload_bytes, payload_digest, refers_to) of every record of the
    manifest's files; null payload for revisits. A response's length and digest are taken from its payload and must be
    those of its fields. One task reads a file at a time, record by record."""

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "url", "record_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        whole = lambda v: None if v is None else int(v)
        for batch in batches:
            for path, sha256 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, size = [], 0
                for fields, block in file_records(path, sha256):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    payload, digest, n = None, fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                            raise ValueError(f"payload digest is wrong in {path}")
                    out.append((whole(fields.get("Page-Id")), fields["WARC-Target-URI"], fields["WARC-Record-ID"], fields["WARC-Type"], payload, n, digest, whole(fields.get("Refers-To-Page-Id"))))
                    size += len(block)
                    if size > 1 << 23:
                        yield _batch(pa, out, types, names)
                        out, size = [], 0
                if out:
                    yield _batch(pa, out, types, names)

    files = manifest.select("path", "sha256").repartition(partitions(spark), "path")
    return files.mapInArrow(run, "page_id long, url string, record_id string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
