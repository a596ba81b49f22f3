"""Near-duplicate vectors by spherical k-means cells and blocked cosine products (operator 7)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import discard, join_by_size, materialize, partitions, sample_by_hash
from chartwright.llm.graph import connected_components, union_roots

#: Products held at a time while a cell is compared.
BLOCK = 2_000_000


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; an emptied cell takes over the row that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(rows)))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        scores = rows @ centres.T
        cell = scores.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        worst = np.argsort(scores[np.arange(len(rows)), cell])
        for i, c in enumerate(np.flatnonzero(np.bincount(cell, minlength=k) == 0)):
            sums[c] = rows[worst[i]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def effective_dimension(rows: np.ndarray) -> float:
    """Participation ratio of the spectrum: how many directions the rows spread over."""
    spread = np.linalg.svd(rows - rows.mean(0), compute_uv=False) ** 2
    return float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)) if spread.sum() > 0 else 1.0


def _usable(v):
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(rep, least, weight, vec): the distinct linkable vectors, written out.

    rep numbers them, least = smallest id with that vector (null if none has an id), weight = rows with it.
    Null vectors and those with a null or non-finite component, without a component or of length zero are
    left out. vec holds the components as given.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(_usable(F.col("vec")))
    nodes = rows.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    return materialize(nodes.select(F.monotonically_increasing_id().alias("rep"), "least", "weight", "vec"), "nodes")


def _matrix(column) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the norm
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _compare(vec: np.ndarray, rep: np.ndarray, weight: np.ndarray, side: np.ndarray, threshold: float):
    """Links of a block of a cell's homes (side 0) with a block of its homes (1) and guests (2).

    (reps, linked weight, links a, links b): linked weight of side 0, and of guests, whose own cell doesn't see the pair.
    """
    order = np.argsort(side, kind="stable")
    vec, rep, weight, side = vec[order], rep[order], weight[order], side[order]
    n = int((side == 0).sum())
    parent, found = np.arange(len(rep)), np.zeros(len(rep))
    rough, rest = vec.astype(np.float32), max(1, len(rep) - n)
    step = max(1, BLOCK // rest)
    for at in range(0, n, step):
        i, j = np.nonzero(rough[at : at + step][:n - at] @ rough[n:].T >= threshold - 1e-4)  # far above what float32 is off
        i, j = i + at, j + n
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            near = (np.einsum("ij,ij->i", vec[x], vec[y]) >= threshold) & (rep[x] != rep[y])
            x, y = x[near], y[near]
            found += np.bincount(x, weights=weight[y], minlength=len(rep))
            guests = side[y] == 2
            found += np.bincount(y[guests], weights=weight[x[guests]], minlength=len(rep))
            parent = union_roots(parent, x, y)
    linked, counted = np.flatnonzero(parent != np.arange(len(rep))), np.flatnonzero(found)
    return rep[counted], found[counted].astype(np.int64), rep[linked], rep[parent[linked]]


def vector_links(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = 1000, max_cells: int = 1024, sample_rows: int = 8192, spread: float | None = 3.0, block_rows: int = 4000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row; links are pairs of cosine >= threshold, none below.

    Equal vectors are one weighted node from the start. Centroids are fitted on at most sample_rows distinct
    vectors; every vector has a home cell and may be a guest in each further cell whose boundary is within
    `spread` standard deviations of what a linked neighbour can lie off, in the data's effective dimension
    (None: within the furthest it can lie, which loses no link but copies more). Of two cells only one takes
    guests of the other: the lower one if the sum of their numbers is even, else the higher. A pair of guest
    and home counts for both. A cell is dealt out in pairs of a block of about block_rows homes and one of
    about 4 x block_rows of all its rows, so that what a task holds is bounded.
    Vectors of different lengths never link.
    Rows that can't link have n_links 0 and are their own component. Rows that repeat an id or have none link
    like any other and count as links of others; a null id is never the smallest of a class, so that it is
    kept nowhere, and a class of null ids alone has a null component. Empty input: no rows.
    """
    spark = vectors.sparkSession
    nodes = unit_vectors(vectors, id_col, vec_col)
    total = nodes.count()
    fitted = sample_by_hash(nodes, "rep", sample_rows).select("vec").toArrow().column(0).combine_chunks()
    by_dim: dict[int, list[int]] = {}
    for i, d in enumerate(fitted.value_lengths().to_pylist()):
        by_dim.setdefault(d, []).append(i)
    cells, offset = {}, 0
    reach = math.sqrt(2 - 2 * threshold)
    for d, places in sorted(by_dim.items()):
        rows = _matrix(fitted.take(places))
        want = min(max_cells, math.ceil(total * len(places) / len(fitted) / cell_rows))
        centres = spherical_kmeans(rows, min(want, max(1, len(rows) // 4)))
        margin = reach if spread is None else min(reach, spread * reach / math.sqrt(effective_dimension(rows)))
        cells[d] = (centres, offset, margin)
        offset += len(centres)
    known = spark.sparkContext.broadcast(cells)

    def place(batches):
        """(cell, home, rep, weight, vec) of each home, and of each guest where its home cell doesn't take it for one."""
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                if d not in known.value:  # a length that the sample lacks: one cell of its own
                    cell = np.full(part.num_rows, -int(d))
                    yield pa.record_batch([pa.array(cell), pa.array(np.ones(len(cell), bool)), part.column(1), part.column(2), part.column(0)], names=["cell", "home", "rep", "weight", "vec"])
                    continue
                centres, first, margin = known.value[d]
                scores = _matrix(part.column(0)) @ centres.T
                best = scores.argmax(1)
                apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) <= 64 else np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
                gap = scores[np.arange(len(best)), best][:, None] - scores
                all_cells = np.arange(len(centres))
                takes = ((all_cells + best[:, None]) % 2 == 0) == (all_cells < best[:, None])
                row, cell = np.nonzero((gap <= margin * apart[best]) & (takes | (all_cells == best[:, None])))
                take = pa.array(row)
                yield pa.record_batch(
                    [pa.array(cell + first), pa.array(cell == best[row]), part.column(1).take(take), part.column(2).take(take), part.column(0).take(take)],
                    names=["cell", "home", "rep", "weight", "vec"],
                )

    n = partitions(spark)
    placed = materialize(nodes.select("vec", "rep", "weight").mapInArrow(place, "cell long, home boolean, rep long, weight long, vec array<double>"), "placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / block_rows).cast("int").alias("homes"), F.ceil(F.count("*") / (4 * block_rows)).cast("int").alias("alls"))  # max_cells rows and a few
    dealt = placed.join(F.broadcast(blocks), "cell").where("homes > 0")
    h, g = F.pmod(F.xxhash64("rep"), F.col("homes")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("alls")).cast("int")
    one, other = F.sequence(F.lit(0), F.col("homes") - 1), F.sequence(F.lit(0), F.col("alls") - 1)
    pairs = F.concat(
        F.transform(one, lambda x: F.struct(F.when(F.col("home"), 1).otherwise(2).alias("side"), x.alias("h"), g.alias("g"))),
        F.when(F.col("home"), F.transform(other, lambda x: F.struct(F.lit(0).alias("side"), h.alias("h"), x.alias("g")))).otherwise(F.array().cast("array<struct<side:int,h:int,g:int>>")),
    )
    dealt = dealt.select("cell", "rep", "weight", "vec", F.explode(pairs).alias("at"))
    dealt = dealt.select("cell", (F.col("at.h").cast("long") * (1 << 31) + F.col("at.g")).alias("block"), F.col("at.side").alias("side"), "rep", "weight", "vec")

    def compare(batches):
        """(a, b, linked): linked weight of a row (b null), or a link (linked null)."""
        import pyarrow as pa

        held, now = [], None

        def done():
            side, rep, weight, vec = (pa.chunked_array([h[i] for h in held]).combine_chunks() for i in range(4))
            mine, found, a, b = _compare(_matrix(vec), rep.to_numpy(), weight.to_numpy(), side.to_numpy(), threshold)
            none = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([pa.array(mine), pa.nulls(len(mine), pa.int64()), pa.array(found)], names=["a", "b", "linked"])
            yield pa.record_batch([pa.array(a), pa.array(b), none], names=["a", "b", "linked"])

        for batch in batches:
            cell, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero((np.diff(cell, prepend=cell[:1] - 1) != 0) | (np.diff(block, prepend=block[:1]) != 0))
            for at, to in zip(starts, [*starts[1:], len(cell)], strict=True):
                if now != (cell[at], block[at]):
                    if held:
                        yield from done()
                    held, now = [], (cell[at], block[at])
                held.append([batch.column(i).slice(at, to - at) for i in range(2, 6)])
        if held:
            yield from done()

    found = materialize(dealt.repartition(n, "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(compare, "a long, b long, linked long"), "found")
    classes = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("linked").alias("linked"))
    per_node = nodes.drop("vec").join(counts, F.col("rep") == F.col("a"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    per_node = materialize(per_node.select("rep", "least", "weight", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "linked")
    smallest = per_node.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = per_node.join(smallest, "component").select("rep", "n_links", "component_id")
    table = materialize(nodes.select("rep", "vec", "weight").join(per_node, "rep").select("vec", "weight", "n_links", "component_id"), "classes")
    for done in (placed, found, nodes):
        discard(done)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.select("id", F.when(_usable(F.col("vec")), F.col("vec")).alias("vec"))
    out = join_by_size(rows, table, "vec", "weight", rows.count())
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
