"""Repair of conversations: the cheapest edits by an auction on the lattice of turns and role states (operator 12).

A conversation's rows are letters of a small alphabet (role initial and fault). Node (i, q) of its lattice: i rows are
done and the last role kept is q. Arcs keep, rerole or delete the next row or insert one, at integer costs. Lattices are
cut into blocks of rows, solved from the last to the first: what a block's end costs on is the prices of the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import discard, free_name, join_by_size, materialize, partitions

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more rerolled or inserted row, and the role it gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS, OK, TRUNCATED, BLANK, DUPLICATE = "sua", 0, 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
BLOCK = 8
#: Bytes of texts that are held while the end of their conversation isn't known.
HELD = 32 << 20
#: The state after a kept row of each initial, from each state; where none is, it can't be kept.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})


def arcs_of(code: int, q: int) -> list[tuple[int, str, int, int]]:
    """(cost, letter, rows done, next state) of each arc from state q when the next row is `code` = 4 x initial + fault."""
    initial, fault = divmod(code, 4)
    out = [(DELETE, "D", 1, q), (INSERT, "I", 0, NEXT[q])]
    if fault < BLANK:
        cut = CUT if fault == TRUNCATED else 0
        if q in KEPT[initial]:
            out.append((KEEP + cut, "K", 1, KEPT[initial][q]))
        out.append((REROLE + cut, "R", 1, NEXT[q]))
    return out


ARCS = [[arcs_of(code, q) for q in range(4)] for code in range(16)]


def auction(arcs: list[list[tuple[int, str, int]]], origins: list[int]) -> list[int]:
    """Prices after a path from each origin has reached the sink, node -1, whose price stays 0.

    Prices start at 0 and never exceed cost + price along an arc. The path's end extends along an arc that attains
    its price; if none does, its price rises to the least that one offers and the path contracts by that node.
    When the path reaches the sink, the origin's price is its distance; later origins start from those prices.
    """
    price = [0] * (len(arcs) + 1)  # the last one is the sink's
    for origin in origins:
        path = [origin]
        while path[-1] >= 0:
            v = path[-1]
            best, to = min((cost + price[t], t) for cost, _, t in arcs[v])
            if price[v] < best:
                price[v] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def trace(arcs: list[list[tuple[int, str, int]]], price: list[int], origins: list[int], order: list[int]) -> list[tuple[str, int]]:
    """(letters, last node) of the path of each origin that is least in ASCII among those of tight arcs to the sink.

    A cheapest path has only tight arcs and every path of tight arcs to the sink is a cheapest one. order: nodes, those
    nearer to the sink first. Two tight arcs of one node never bear the same letter.
    """
    good = [False] * len(arcs)
    tight = [[(letter, t) for cost, letter, t in arcs[v] if price[v] == cost + price[t]] for v in range(len(arcs))]
    for _ in range(4):  # inserts lead on within a layer
        for v in order:
            good[v] = good[v] or any(t < 0 or good[t] for _, t in tight[v])
    out = []
    for v in origins:
        letters = []
        while True:
            letter, to = min((letter, t) for letter, t in tight[v] if t < 0 or good[t])
            letters.append(letter)
            if to < 0:
                break
            v = to
        out.append(("".join(letters), v))
    return out


def solve_block(codes: bytes, ends: tuple | None) -> tuple[list[int], list[tuple[str, int]]]:
    """Cost from each state before the rows to the end, and its letters with the state after them.

    ends: cost from each state after them (None: the conversation's end, which asks for START or ASSISTANT).
    """
    arcs = [[(cost, letter, 4 * (i + step) + to) for cost, letter, step, to in ARCS[code][q]] for i, code in enumerate(codes) for q in range(4)]
    n = len(codes)
    if ends is None:
        arcs += [[(INSERT, "I", 4 * n + NEXT[q])] + ([(0, "", -1)] if q in (START, ASSISTANT) else []) for q in range(4)]
    else:
        arcs += [[(ends[q], "", -1)] for q in range(4)]
    origins = [0, 1, 2, 3]
    price = auction(arcs, origins)
    return price[:4], [(letters, v % 4) for letters, v in trace(arcs, price, origins, list(range(4 * n + 3, -1, -1)))]


class Solver:
    """Cheapest edits of code strings; blocks and short conversations that were solved before are remembered, within bounds."""

    def __init__(self, most: int = 100_000):
        self.most, self.blocks, self.whole = most, {}, {}

    def _block(self, codes: bytes, ends: tuple | None):
        low = min(ends) if ends else 0
        key = codes, ends and tuple(e - low for e in ends)
        if key not in self.blocks:
            if len(self.blocks) >= self.most:
                self.blocks.clear()
            self.blocks[key] = solve_block(*key)
        cost, letters = self.blocks[key]
        return tuple(c + low for c in cost), letters

    def edits(self, codes: bytes) -> tuple[int, str]:
        """(cost, audit) of a conversation."""
        solved, ends = [], None
        for at in range((max(len(codes) - 1, 0) // BLOCK) * BLOCK, -1, -BLOCK):
            ends, letters = self._block(codes[at : at + BLOCK], ends)
            solved.append(letters)
        out, q = [], START
        for letters in reversed(solved):
            text, q = letters[q]
            out.append(text)
        return ends[START], "".join(out)

    def facts(self, codes: bytes) -> tuple[int, int, int, int, int, str]:
        """(blank, duplicate, truncated, illegal, cost, audit) of a conversation."""
        if codes not in self.whole:
            if len(self.whole) >= self.most:
                self.whole.clear()
            import numpy as np

            initial, fault = np.divmod(np.frombuffer(codes, np.uint8), 4)
            a, b = initial[:-1], initial[1:]
            illegal = len(a) - int((((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))).sum())
            found = (*(int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, *self.edits(codes))
            if len(codes) > 64:
                return found
            self.whole[codes] = found
        return self.whole[codes]


class Repaired:
    """The repaired rows of a conversation as its rows pass by: each row takes its letters of the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.q, self.first, self.digest = audit, 0, START, True, hashlib.sha256()

    def _put(self, line: str) -> str:
        self.digest.update((line if self.first else "\n" + line).encode("utf-8", "surrogatepass"))
        self.first = False
        return line

    def _inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.q, self.at = NEXT[self.q], self.at + 1
            yield self._put(ROLES[self.q] + ":")

    def row(self, role: str, text: str, copies: int) -> Iterator[str]:
        """Lines that a row and its copies leave, inserted ones before it included."""
        for _ in range(copies):
            yield from self._inserted()
            letter, self.at = self.audit[self.at], self.at + 1
            if letter == "K":
                self.q = KEPT[INITIALS.find(role[:1]) if role else 3][self.q]
                yield self._put(f"{role}:{text}")
            elif letter == "R":
                self.q = NEXT[self.q]
                yield self._put(f"{ROLES[self.q]}:{text}")

    def end(self) -> Iterator[str]:
        yield from self._inserted()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, alive) of each row as crc32('conv_id:turn') % 20 has it: 0 not alive, 1 without
    text, 2 without its [.!?], 3 twice, 4 by the user. Nulls stand as one space, but not in conv_id and turn themselves."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"), (kind != 0).alias("alive"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows
    (conv_id, turn, role, text, copies, alive): those that aren't alive count for nothing but the conversation's existence.

    A row's faults and the edits are those of the module's first lines and arcs_of(). Rows are taken by turn, nulls first,
    then role, then the digest of role and text; rows equal in all are copies of each other. A null conv_id is a
    conversation; one without rows alive has zeros, an empty audit and the digest of nothing. No rows: no rows.

    Copies are counted before anything else. Rows are sorted over ranges of (conv_id, turn, ...), so a conversation of
    any length is spread: a task ends those that lie within its range, and sends on one byte a row of those that may go
    on beyond it (two a task, and those of over HELD bytes). Only their digests, a chain over all their text, then
    need a pass in order, which streams.
    """
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    turn = F.when(F.col("alive"), F.col("turn"))
    convs = rows.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    some = rows.where("alive").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    said = F.unhex(F.sha1(F.concat_ws("\x00", conv, F.length("role").cast("string"), "role", "text").cast("binary")))
    some = some.select("conv_id", "turn", "role", "text", "copies", blank.alias("blank"), F.when(~blank, said).alias("said"), said.alias("tie"))
    some = materialize(some, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = some.where("said is not null").groupBy("said").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    told = join_by_size(some, first, "said", "n", some.count())
    heard = F.col("first").isNotNull() & (F.col("first") < place)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)], F.lit(3))
    rest = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    fault = F.when(F.col("blank"), BLANK).when(heard, DUPLICATE).when(cut, TRUNCATED).otherwise(OK)
    coded = told.select("conv_id", "turn", "role", "tie", "text", "copies", (4 * initial + fault).alias("code"), (4 * initial + rest).alias("more"))
    order = ["conv_id", "turn", "role", "tie"]
    ranged = coded.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text", "copies", "code", "more")
    kind = rows.schema["conv_id"].dataType.simpleString()
    columns = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def mend(batches):
        """Facts of the conversations that end here; (pid, codes) of the open ones."""
        import pyarrow as pa
        from pyspark import TaskContext

        pid, solver, out = TaskContext.get().partitionId(), Solver(), []
        conv, codes, texts, size, number = None, bytearray(), [], 0, 0

        def close(last: bool):
            if number > 1 and not last and texts is not None:
                facts = solver.facts(bytes(codes))
                made = Repaired(facts[-1])
                for row in texts:
                    for _ in made.row(*row):
                        pass
                for _ in made.end():
                    pass
                out.append((conv, None, None, *facts, made.digest.hexdigest()))
            else:
                out.append((conv, pid, bytes(codes), *[None] * 7))

        def batch_of():
            types = (None, pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.string())
            arrays = [pa.array(c, conv_type if t is None else t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.record_batch(arrays, names=["conv_id", "pid", "codes", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, role, text, copies, code, more in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not number or c != conv:
                    if number:
                        close(False)
                    conv, codes, texts, size, number = c, bytearray(), [], 0, number + 1
                codes.append(code)
                codes.extend(bytes((more,)) * (copies - 1))
                if texts is not None:
                    texts.append((role, text, copies))
                    size += len(role) + len(text)
                    if size > HELD:
                        texts = None
            if out:
                yield batch_of()
        if number:
            close(True)
            yield batch_of()

    found = materialize(ranged.mapInArrow(mend, f"conv_id {kind}, pid long, codes binary, {columns}"), "mended")
    parts = found.where("codes is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pid", "codes"))).alias("parts"))

    def join_up(batches):
        import pyarrow as pa

        solver = Solver()
        for batch in batches:
            facts = [solver.facts(b"".join(p["codes"] for p in parts)) for parts in batch.column(1).to_pylist()]
            if facts:
                types = (*[pa.int64()] * 5, pa.string())
                yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*facts, strict=True), types, strict=True))], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    joined = materialize(parts.mapInArrow(join_up, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "joined")
    # conversations at the ends of ranges, two a task, and those of over HELD bytes of text
    asked = F.broadcast(joined.select(F.col("conv_id").alias("asked")))
    again = coded.select(*order, "text", "copies").join(asked, F.col("conv_id").eqNullSafe(F.col("asked")), "left_semi")
    lines = joined.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("tie"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    lines = lines.unionByName(again).withColumn("row", F.col("role").isNotNull())
    lines = lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "tie").select("conv_id", "row", "role", "text", "copies")

    def digests(batches):
        import pyarrow as pa

        made, conv = None, None

        def ended():
            for _ in made.end():
                pass
            return pa.record_batch([pa.array([conv], conv_type), pa.array([made.digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, row, role, text, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not row:
                    if made:
                        yield ended()
                    made, conv = Repaired(text), c
                else:
                    for _ in made.row(role, text, copies):
                        pass
        if made:
            yield ended()

    hashed = materialize(lines.mapInArrow(digests, f"conv_id {kind}, repaired_sha256 string"), "digests")
    long = joined.alias("j").join(hashed.select(F.col("conv_id").alias("of"), "repaired_sha256"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    done = found.where("codes is null").drop("pid", "codes").unionByName(long)
    done = materialize(done.withColumnRenamed("conv_id", "of"), "repaired")
    for used in (some, found, joined, hashed):
        discard(used)
    out = convs.join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
