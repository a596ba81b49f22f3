"""Hard negatives from Hilbert-ordered candidate blocks with zone maps (operator 11).

Candidates lie in Parquet files, one row group a block, ordered by label and by place on a Hilbert curve through all
dimensions; beside each file lie its blocks' zone maps: least and greatest value of each dimension and of the label, and
the greatest norm. For an anchor a and a block, interval arithmetic bounds every inner product: with a = p - m, both
not negative, it is at most p.high - m.low and at least p.low - m.high. A block is read for the anchors whose windows of
scores these bounds let in.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm.common import materialize, new_path, partitions

#: Norm of a row of whole components at most, so that 100 x a score stays within 64 bits.
MOST_NORM = float(1 << 28)
#: Stands for a null id, last in the order of ids.
NO_ID = (1 << 63) - 1
BITS, BLOCK_ROWS, GROUP = 4, 1024, 2048
#: Bytes of blocks that a worker keeps between groups of anchors.
KEPT = 64 << 20


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each row of cells (0 .. 2**bits - 1 in each dimension) on the Hilbert curve, as bytes that sort alike."""
    x = cells.T.astype(np.uint32).copy()
    d = len(x)
    if d == 0 or x.shape[1] == 0:
        return [b""] * len(cells)
    for b in range(bits - 1, 0, -1):  # undo the rotations of each level, highest first
        low = np.uint32((1 << b) - 1)
        for i in range(d):
            there = (x[i] >> b) & 1 == 1
            swap = np.where(there, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(there, low, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, np.uint32((1 << b) - 1), np.uint32(0)).astype(np.uint32)
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # level, dimension, row
    packed = np.packbits(planes.reshape(bits * d, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _rows(column, dim: int) -> np.ndarray:
    """The rows of a binary column of int32 components."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim)


def _asked(ids: np.ndarray, every: int) -> np.ndarray:
    return (ids % every == 0) & (ids != NO_ID)


def candidate_files(vectors: DataFrame, folder: str | None = None, anchor_every: int = 50, relabel_every: int = 7, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Write the candidates of (vec_id, embedding, label). -> (path, dim, n_blocks, n_anchors, label_low, label_high,
    norm, low, high), one row for each file: a range of one dimension, at most one a task and dimension.

    Rows with a null label or vector or a null or non-finite component take no part, nor do rows of a norm of MOST_NORM / 256
    or more, whose scores leave 64 bits. Where the id is divisible by relabel_every the label first becomes (label + 1) % 10.
    Components become floor(256 x). Rows equal in id, label and vector are counted before they are sorted and lie in a block
    once. A task writes under names of its own attempt and renames at the end.
    """
    spark = vectors.sparkSession
    folder = folder or new_path(spark, "candidates")
    id_, label, vec = F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vec_col).cast("array<double>")
    whole = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(whole & label.isNotNull()).select(F.coalesce(id_, F.lit(NO_ID)).alias("id"), F.when(id_ % relabel_every == 0, (label + 1) % 10).otherwise(label).alias("label"), vec.alias("vec"))
    ends = rows.agg(F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high")).first()
    low = 0.0 if ends["low"] is None else max(ends["low"], -MOST_NORM)
    wide = max((0.0 if ends["high"] is None else min(ends["high"], MOST_NORM)) - low, 1e-300)

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                vec = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(dim))
                with np.errstate(over="ignore"):
                    norm = np.sqrt((np.floor(256 * vec) ** 2).sum(1))
                fits = np.flatnonzero(norm < MOST_NORM)
                part, vec = part.take(pa.array(fits)), vec[fits]
                keys = hilbert_keys(np.clip((vec - low) / wide * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32))
                whole = [row.tobytes() for row in np.floor(256 * vec).astype("<i4")]
                yield pa.record_batch([pa.array(np.full(len(fits), dim, np.int32)), part.column(1), pa.array(keys, pa.binary()), part.column(0), pa.array(whole, pa.binary())], names=["dim", "label", "key", "id", "vec"])

    order = ["dim", "label", "key", "id"]
    rows = rows.mapInArrow(keyed, "dim int, label long, key binary, id long, vec binary")
    rows = rows.groupBy(*order, "vec").agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("copies"))  # more are in no result
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "vec").select("dim", "label", "id", "vec", "copies")

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, n_held, file, made = [], 0, None, []

        class File:
            def __init__(self, dim):
                self.dim, self.zones, self.anchors = dim, [], 0
                self.name, self.own = f"part-{task.partitionId():06d}-{dim}", f".part-{task.partitionId():06d}-{dim}-{task.taskAttemptId()}"
                self.out = None

            def put(self, table):
                if self.out is None:
                    self.sink = store.open_output_stream(f"{root}/{self.own}.parquet")
                    self.out = pq.ParquetWriter(self.sink, table.schema, compression="zstd", use_dictionary=False)
                self.out.write_table(table, row_group_size=max(1, table.num_rows))
                vec, ids, labels = _rows(table.column("vec"), self.dim), table.column("id").to_numpy(), table.column("label").to_numpy()
                self.anchors += int(_asked(ids, anchor_every).sum())
                self.zones.append((labels.min(), labels.max(), float(np.sqrt((vec.astype(float) ** 2).sum(1)).max()), vec.min(0).astype("<i4"), vec.max(0).astype("<i4")))

            def close(self):
                self.out.close()
                self.sink.close()
                a, b, norm, low, high = (list(c) for c in zip(*self.zones, strict=True))
                zones = pa.table({"label_low": a, "label_high": b, "norm": norm, "low": [x.tobytes() for x in low], "high": [x.tobytes() for x in high]})
                with store.open_output_stream(f"{root}/{self.own}.zones") as sink:
                    pq.write_table(zones, sink)
                for end in (".zones", ".parquet"):
                    store.move(f"{root}/{self.own}{end}", f"{root}/{self.name}{end}")
                return f"{folder}/{self.name}", self.dim, len(low), self.anchors, int(min(a)), int(max(b)), max(norm), np.min(low, 0).tobytes(), np.max(high, 0).tobytes()

        def cut(everything):
            nonlocal held, n_held
            while n_held >= block_rows or (everything and n_held):
                table = pa.Table.from_batches(held).combine_chunks()
                file.put(table.slice(0, block_rows).drop_columns("dim"))
                rest = table.slice(block_rows)
                held, n_held = rest.to_batches(), rest.num_rows

        for batch in batches:
            dims = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(dims, prepend=dims[:1] - 1))
            for at, to in zip(starts, [*starts[1:], len(dims)], strict=True):
                if file is None or file.dim != int(dims[at]):
                    if file:
                        cut(True)
                        made.append(file.close())
                    file = File(int(dims[at]))
                held.append(batch.slice(at, to - at))
                n_held += int(to - at)
                cut(False)
        if file:
            cut(True)
            made.append(file.close())
            names = ["path", "dim", "n_blocks", "n_anchors", "label_low", "label_high", "norm", "low", "high"]
            yield pa.record_batch([pa.array(c, pa.int32() if k == "dim" else None) for k, c in zip(names, zip(*made, strict=True), strict=True)], names=names)

    schema = "path string, dim int, n_blocks long, n_anchors long, label_low long, label_high long, norm double, low binary, high binary"
    return materialize(rows.mapInArrow(write, schema), "files")


class Blocks:
    """Zone maps and blocks of candidate files; what was read last is kept, up to KEPT bytes."""

    def __init__(self):
        self.kept, self.size = OrderedDict(), 0

    def _get(self, key, read):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key][0]
        value = read()
        size = sum(x.nbytes for x in value)
        self.kept[key] = value, size
        self.size += size
        while self.size > KEPT and len(self.kept) > 1:
            self.size -= self.kept.popitem(last=False)[1][1]
        return value

    def zones(self, path: str, dim: int):
        """(label_low, label_high, norm, low, high) of the file's blocks."""

        def read():
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(path)
            with store.open_input_file(root + ".zones") as f:
                t = pq.read_table(f)
            return (*(t.column(c).to_numpy() for c in ("label_low", "label_high", "norm")), *(_rows(t.column(c), dim).astype(np.float64) for c in ("low", "high")))

        return self._get((path, -1), read)

    def block(self, path: str, i: int, dim: int):
        """(label, id, vec, copies) of a block's rows."""

        def read():
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(path)
            with store.open_input_file(root + ".parquet") as f:
                t = pq.ParquetFile(f).read_row_group(i)
            return t.column("label").to_numpy(), t.column("id").to_numpy(), _rows(t.column("vec"), dim), t.column("copies").to_numpy()

        return self._get((path, i), read)


_WORKER = Blocks()


def inner(a: np.ndarray, b: np.ndarray, norm_a: float, norm_b: float) -> np.ndarray:
    """Exact inner products of whole rows: no partial sum exceeds the product of the norms, which says what type holds it."""
    kind = np.float32 if norm_a * norm_b < 1 << 23 else np.float64 if norm_a * norm_b < 1 << 52 else np.int64
    out = a.astype(kind) @ b.astype(kind).T
    return out if kind == np.int64 else out.astype(np.int64)


def bounds(plus: np.ndarray, minus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each anchor with any row of each zone, widened by what rounding may take."""
    least, most = plus @ low.T - minus @ high.T, plus @ high.T - minus @ low.T
    slack = 1e-12 * (plus @ np.maximum(np.abs(low), np.abs(high)).T + minus @ np.maximum(np.abs(low), np.abs(high)).T) + 0.5
    return least - slack, most + slack


class Best:
    """The first k of (score, id) for each of n slots, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)  # what a score must reach to matter

    def add(self, slot, score, id_):
        slot, score, id_ = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]
        full = rank == self.k - 1
        self.least[slot[full]] = np.maximum(self.least[slot[full]], score[full])

    def ranks(self):
        return np.arange(len(self.slot)) - np.searchsorted(self.slot, self.slot)


class Group:
    """Anchors of one file that are searched together."""

    def __init__(self, vec, ids, labels, dim, files, own, store: Blocks):
        self.vec, self.ids, self.labels, self.dim, self.store = vec, ids, labels, dim, store
        self.plus, self.minus = np.maximum(vec, 0).astype(float), np.maximum(-vec, 0).astype(float)
        self.norm = float(np.sqrt((vec.astype(float) ** 2).sum(1)).max())
        self.files = sorted(files, key=lambda f: f["path"] != own)  # the anchors' neighbours first
        self.read = self.skipped = 0

    def walk(self, wanted):
        """(rows, block, scores) of each block that wanted(least, most, label_low, label_high) asks for, best bounds first."""
        for f in self.files:
            low, high = (np.frombuffer(f[c], "<i4").astype(float)[None] for c in ("low", "high"))
            if not wanted(*bounds(self.plus, self.minus, low, high), np.array([f["label_low"]]), np.array([f["label_high"]])).any():
                self.skipped += f["n_blocks"]
                continue
            label_low, label_high, norm, low, high = self.store.zones(f["path"], self.dim)
            least, most = bounds(self.plus, self.minus, low, high)
            for b in np.argsort(-most.max(0), kind="stable"):
                at = slice(b, b + 1)
                rows = np.flatnonzero(wanted(least[:, at], most[:, at], label_low[at], label_high[at])[:, 0])
                if not len(rows):
                    self.skipped += 1
                    continue
                self.read += 1
                labels, ids, vec, copies = self.store.block(f["path"], int(b), self.dim)
                scores = inner(self.vec[rows], vec, self.norm, float(norm[b]))
                yield rows, (labels, ids, copies), scores

    def positives(self, k: int) -> Best:
        best, mine = Best(len(self.ids), k), self.labels[:, None]
        for rows, (labels, ids, copies), scores in self.walk(lambda least, most, a, b: (mine >= a) & (mine <= b) & (most >= best.least[:, None])):
            fits = (labels == mine[rows]) & (ids != self.ids[rows][:, None]) & (scores >= best.least[rows][:, None])
            i, j = np.nonzero(fits)
            if len(i):
                times = np.minimum(copies[j], k)
                best.add(np.repeat(rows[i], times), np.repeat(scores[i, j], times), np.repeat(ids[j], times))
        return best

    def negatives(self, found: Best, k: int, low_share: int, high_share: int) -> tuple[Best, np.ndarray]:
        """Best of each window, one for each positive, and the windows that hold any score (others are empty)."""
        high, low = high_share * found.score // 100, -(-low_share * found.score // 100)
        best, mine = Best(len(found.slot), k), self.labels[:, None]
        best.least = np.maximum(best.least, low)
        rank, some = found.ranks(), high >= low
        slots = np.full((len(self.ids), max(1, int(rank.max(initial=0)) + 1)), -1)  # windows of each anchor
        slots[found.slot[some], rank[some]] = np.flatnonzero(some)

        def wanted(least, most, a, b):
            out = np.zeros(most.shape, bool)
            for windows in slots.T:
                there = windows >= 0
                w = windows[there]
                out[there] |= (most[there] >= best.least[w][:, None]) & (least[there] <= high[w][:, None])
            return out & ~((a == b) & (mine == a))

        for rows, (labels, ids, copies), scores in self.walk(wanted):
            other = labels != mine[rows]
            for windows in slots.T:
                own = np.flatnonzero(windows[rows] >= 0)
                w = windows[rows[own]]
                i, j = np.nonzero(other[own] & (scores[own] <= high[w][:, None]) & (scores[own] >= best.least[w][:, None]))
                if len(i):
                    times = np.minimum(copies[j], k)
                    best.add(np.repeat(w[i], times), np.repeat(scores[own[i], j], times), np.repeat(ids[j], times))
        return best, some


def hard_negatives(vectors: DataFrame, anchor_every: int = 50, n_positives: int = 5, n_negatives: int = 3, low_share: int = 50, high_share: int = 95, folder: str | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, blocks_read, blocks_skipped).

    An anchor's positives are its first rows of the same label, its negatives for each of them the first rows of other
    labels whose score lies within the two shares (in hundredths) of the positive's; scores are inner products of whole
    components, higher ones first, then smaller ids, null ids last. A row is known by its id: one with the anchor's id isn't
    its positive, and an anchor that is there several times is asked once. Vectors meet those of their own length. Rows that
    take no part: see candidate_files(). A task holds GROUP anchors, a block and KEPT bytes. No rows or no anchors: no rows.
    """
    spark = vectors.sparkSession
    files = candidate_files(vectors, folder, anchor_every)
    # one row a task and vector length
    known = spark.sparkContext.broadcast([r.asDict() for r in files.orderBy("path").collect()])
    step = GROUP
    groups = files.where("n_anchors > 0").select("path", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_anchors") - 1, F.lit(step))).alias("start"))

    def search(batches):
        import pyarrow as pa

        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "blocks_read", "blocks_skipped"]
        for batch in batches:
            for path, dim, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files = [f for f in known.value if f["dim"] == dim]
                vec, ids, labels, seen = [], [], [], 0
                for b in range(next(f["n_blocks"] for f in files if f["path"] == path)):
                    label, id_, rows, _ = _WORKER.block(path, b, dim)
                    there = np.flatnonzero(_asked(id_, anchor_every))
                    there, seen = there[max(0, start - seen) : max(0, start + step - seen)], seen + len(there)
                    vec.append(rows[there]), ids.append(id_[there]), labels.append(label[there])
                group = Group(*(np.concatenate(x) for x in (vec, ids, labels)), dim, files, path, _WORKER)
                found = group.positives(n_positives)
                best, _ = group.negatives(found, n_negatives, low_share, high_share)
                n = len(best.slot)
                none = lambda x: pa.array(x, mask=x == NO_ID)
                yield pa.record_batch([pa.array(group.ids[found.slot[best.slot]]), none(found.id[best.slot]), pa.array((best.ranks() + 1).astype(np.int32)), none(best.id), pa.array(found.score[best.slot]), pa.array(best.score), pa.array(np.full(n, group.read)), pa.array(np.full(n, group.skipped))], names=names)

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, blocks_read long, blocks_skipped long"
    return groups.repartition(partitions(spark), "path", "start").mapInArrow(search, schema)
