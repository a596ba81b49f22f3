"""Packing of token sequences into windows by minimum bin slack (operator 3).

Whole windows are cut off long documents first. What remains of each document is shorter than a window, so
the remains fall into capacity - 1 length classes at most, and the packing itself needs only their counts:
a subset-sum dynamic programme over the counted lengths, its reachable sums held in the bits of one integer,
picks the multiset that fills a window closest to capacity, and the pick is repeated for as many windows as
the counts allow. Remains that no pick fills to capacity are laid end to end and cut at the windows' ends.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwright.llm.common import discard, materialize, new_path, partitions
from chartwright.llm.tokens import Ranker, encode_documents


def fullest_multiset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill `capacity` closest without passing it, long lengths first.

    counts: length -> number there. Binary splitting keeps one bitset for each power of two of each length;
    walking them back gives the counts of the best sum.
    """
    mask, sums, trail = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(step, left)
            trail.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left, step = left - take, step * 2
        if sums >> capacity & 1:
            break
    best, picked = sums.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> best & 1:
            picked[length] = picked.get(length, 0) + take
            best -= length * take
    return picked


def plan_windows(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """([(multiset, number of windows)], remaining counts): every window there is filled exactly.

    Stops when the fullest multiset leaves slack; then nothing that remains adds up to a window.
    """
    counts, plan = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        pick = fullest_multiset(counts, capacity)
        if sum(k * v for k, v in pick.items()) < capacity:
            break
        times = min(counts[k] // v for k, v in pick.items())
        plan.append((pick, times))
        for k, v in pick.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return plan, counts


class Layout:
    """Where the remains of each length class go, by their rank in the class; small enough to broadcast.

    Its size depends on capacity alone: each pick uses up a class or its last few members.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        plan, rest = plan_windows(counts, capacity)
        self.capacity, slots, used, base = capacity, {}, {}, 0
        for pick, times in plan:
            offset = 0
            for length in sorted(pick, reverse=True):
                each = pick[length]
                at = used.get(length, 0)
                slots.setdefault(length, []).append((at, each, base, offset))
                used[length] = at + each * times
                offset += each * length
            base += times
        self.line_base, self.line, total = base, {}, 0
        for length in sorted(rest, reverse=True):
            self.line[length] = (used.get(length, 0), total)
            total += rest[length] * length
        self.windows = base + total // capacity
        self.tail = total % capacity
        self.tail_parts = [1 << b for b in range(capacity.bit_length(), -1, -1) if self.tail >> b & 1]
        self.sequences = self.windows + len(self.tail_parts)
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """[(start in the remains, length, sequence, offset)] of one remains."""
        first_in_line, line_at = self.line.get(length, (None, 0))
        if first_in_line is None or rank < first_in_line:
            rows = self.slots[length]
            at, each, base, offset = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
            q, r = divmod(rank - int(at), int(each))
            return [(0, length, int(base) + q, int(offset) + r * length)]
        at, out, start = line_at + (rank - first_in_line) * length, [], 0
        while start < length:
            sequence, offset, room = self._spot(at + start)
            cut = min(length - start, room)
            out.append((start, cut, sequence, offset))
            start += cut
        return out

    def _spot(self, at: int) -> tuple[int, int, int]:
        window, offset = divmod(at, self.capacity)
        if self.line_base + window < self.windows:
            return self.line_base + window, offset, self.capacity - offset
        for i, size in enumerate(self.tail_parts):  # the last part of a window: powers of two, which need no padding
            if offset < size:
                return self.windows + i, offset, size - offset
            offset -= size
        raise AssertionError("past the end of the line")


def _plan(ranked: DataFrame, capacity: int) -> tuple[Layout, str]:
    """(layout of all remains, folder with one small file for each task of the ranked() table).

    A task's file says how many remains of each length class and how many whole windows lie in the tasks
    before it: capacity numbers at most. Classes are summed over tasks, one window group a class.
    """
    spark = ranked.sparkSession
    rows = ranked.where("n_tokens > 0").select("task", (F.col("n_tokens") % capacity).alias("rest"), F.floor(F.col("n_tokens") / capacity).cast("long").alias("full"))
    sizes = materialize(rows.groupBy("task", "rest").agg(F.count("*").alias("c"), F.sum("full").alias("f")), "sizes")
    counts = {r["rest"]: r["c"] for r in sizes.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # capacity - 1 rows at most
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    by_class = earlier.partitionBy("rest").orderBy("task")
    ranks = sizes.select("task", "rest", F.coalesce(F.sum("c").over(by_class), F.lit(0)).alias("rank0"))
    ranks = ranks.groupBy("task").agg(F.collect_list(F.struct("rest", "rank0")).alias("rests"))
    fulls = sizes.groupBy("task").agg(F.sum("f").alias("f"))  # one row a task
    fulls = fulls.select("task", F.coalesce(F.sum("f").over(earlier.orderBy("task")), F.lit(0)).alias("full0"))
    path = new_path(spark, "ranks")
    fulls.join(ranks, "task").repartition(partitions(spark), "task").write.partitionBy("task").parquet(path)
    discard(sizes)
    return Layout(counts, capacity), path


def place(ranked: DataFrame, capacity: int, keep: str, ids: bool = False) -> DataFrame:
    """(keep, start, length[, ids], n_tokens, sequence_id, offset): the pieces of every row, where the row lies.

    ranked: a materialized table with task, n_tokens, rank and full_before as tokens.encode_documents() makes
    them. No row moves: a row's rank among all remains of its length is its rank in its task plus the task's
    own base, which is read from the shared folder, a small file a task.
    """
    layout, path = _plan(ranked, capacity)
    plan = ranked.sparkSession.sparkContext.broadcast(layout)

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        layout, now = plan.value, None
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            task, n, rank, before = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            full, rest = n // capacity, n % capacity
            rank, before = rank.copy(), before.copy()
            starts = np.flatnonzero(np.diff(task, prepend=task[:1] - 1))
            for at, to in zip(starts, [*starts[1:], len(task)], strict=True):
                if now is None or now[0] != task[at]:
                    row = pq.ParquetDataset(f"{root}/task={task[at]}", filesystem=store).read(columns=["full0", "rests"]).to_pylist()[0]
                    base = np.zeros(capacity, np.int64)
                    for r in row["rests"]:
                        base[r["rest"]] = r["rank0"]
                    now = (task[at], row["full0"], base)
                before[at:to] += now[1]
                rank[at:to] += now[2][rest[at:to]]
            own = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
            pieces: Iterable = [(i, *p) for i in np.flatnonzero(rest) for p in layout.place(int(rest[i]), int(rank[i]))]
            cut = np.array(list(pieces), np.int64).reshape(-1, 5)
            at = np.concatenate([own, cut[:, 0]])
            start = np.concatenate([nth * capacity, full[cut[:, 0]] * capacity + cut[:, 1]])
            length = np.concatenate([np.full(len(own), capacity), cut[:, 2]])
            columns = {keep: batch.column(0).take(pa.array(at)), "start": pa.array(start), "length": pa.array(length)}
            if ids:
                data = batch.column(5).cast(pa.large_binary())
                flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)
                begin = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data)][at] + start * 4
                columns["ids"] = pa.array([flat[a : a + 4 * k].tobytes() for a, k in zip(begin.tolist(), length.tolist(), strict=True)], pa.binary())
            columns["doc_tokens"] = pa.array(n[at])
            columns["sequence_id"] = pa.array(np.concatenate([layout.sequences + before[own] + nth, cut[:, 3]]))
            columns["offset"] = pa.array(np.concatenate([np.zeros(len(own), np.int64), cut[:, 4]]))
            yield pa.record_batch(list(columns.values()), names=list(columns))

    columns = [F.col(keep).cast("long").alias(keep), "task", F.col("n_tokens").cast("long"), "rank", "full_before", *(["ids"] if ids else [])]
    schema = f"`{keep}` long, start long, length long, {'ids binary, ' if ids else ''}doc_tokens long, sequence_id long, offset long"
    return ranked.where("n_tokens > 0").select(*columns).mapInArrow(run, schema)


def pack(lengths: DataFrame, capacity: int = 1024, key: str = "row_id", length_col: str = "n_tokens") -> DataFrame:
    """(key, start, length, sequence_id, offset): the pieces of every row with at least one token.

    Each token lies in one piece, and offsets in a sequence are gapless from 0. Sequences hold exactly
    `capacity` tokens except at most log2(capacity) last ones, whose sizes are powers of two. Rows with a null
    or zero length have no piece; null and repeated keys stay as they are. Empty input: no rows. Other columns
    are ignored.

    Rows are ranked within their length class in the tasks that hold them, so one length that a third of all
    rows have is ranked in many tasks.
    """
    rows = lengths.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n_tokens"))

    def rank(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, ranker = TaskContext.get().partitionId(), Ranker(capacity)
        for batch in batches:
            ranks, before = ranker(batch.column(1).to_numpy())
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(ranks), task)), batch.column(1), pa.array(ranks), pa.array(before)], names=["k", "task", "n_tokens", "rank", "full_before"])

    ranked = materialize(rows.mapInArrow(rank, "k long, task long, n_tokens long, rank long, full_before long"), "ranked")
    pieces = place(ranked, capacity, "k")
    return pieces.select(F.col("k").alias(key), "start", "length", "sequence_id", "offset")


def packed_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every text's pieces with their ids.

    ids are little-endian 32-bit. Texts are encoded once, and ids are cut where the encoder left them. A null
    text is empty and holds its end only; null and repeated ids stay as they are. Empty input: no rows.
    """
    encoded = materialize(encode_documents(docs, vocabulary, end_id, capacity, id_col, text_col), "encoded")
    return place(encoded, capacity, "doc_id", ids=True)
