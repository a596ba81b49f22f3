"""SimHash near-duplicates by multi-index hashing (operator 8).

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Fingerprints are
cut into three segments of 22, 21 and 21 bits. Four differing bits or fewer put at most one into one of the
first two segments or none into the third, so it's enough to look up, segment by segment, the keys within
distance one, one and zero. Of two keys one bit apart, the one with the lower bit value asks for the other.

A key that very many fingerprints share is looked up further by the other bits, cut into five parts, one of
which two linked fingerprints share; what still meets in great number is compared as pairs of blocks.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import discard, free_name, join_by_size, materialize, partitions
from chartwright.llm.graph import connected_components

#: (bit of the lowest place, width, radius of the ball). Radii follow from the threshold: three segments, 4 bits.
SEGMENTS = ((42, 22, 1), (21, 21, 1), (0, 21, 0))
THRESHOLD = 4
#: Up to this many rows of a key are compared by shifting the whole batch; larger ones are walked.
SMALL = 12
#: Rows of a key compared in one piece, about; more are looked up by parts of the other bits, then as pairs of blocks.
MOST = 1 << 15
#: Bytes of a text cut into words at a time.
SLICE = 1 << 22
BLANK = re.compile(rb"[\t-\r ]")


def _slices(text: bytes):
    """A text in slices of about SLICE bytes, cut at white space."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + SLICE) if at + SLICE < len(text) else None
        to = blank.start() if blank else len(text)
        yield text[at:to]
        at = to


def _ones(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """How many shingles of `width` words (all words, if fewer) have each bit set."""
    from xxhash import xxh64_digest

    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = (ends[:n] - [len(w) + 1 for w in words[:n]]).tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        digests = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(begins[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of `width`.

    Fewer words than `width` make one shingle; no word gives zero. Repeated shingles count each time. A long
    text is taken slice by slice, with the last words of one before those of the next.
    """
    ones, n, words = np.zeros(64, np.int64), 0, []
    for part in _slices(text):
        words += part.lower().split()
        if len(words) >= width:
            ones += _ones(words, width, seed)
            n += len(words) - width + 1
            words = words[len(words) - width + 1 :]
    if not n and words:
        ones, n = _ones(words, width, seed), 1
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the signed long with the fingerprint's bits. Null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each run of equal keys (the arrays are sorted by key)."""
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    sizes = np.diff(edges, append=len(key))
    small = np.repeat(sizes <= SMALL, sizes)
    out_a, out_b = [], []
    for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
        hit = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        hit = hit[_near(fp[hit], fp[hit + d])]
        out_a.append(rep[hit])
        out_b.append(rep[hit + d])
    for at, size in zip(edges[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        left = np.arange(at, at + size)
        while len(left) > 1:  # grow one linked group after another; a member leaves the rest when it is reached
            front, left = [int(left[0])], left[1:]
            while front and len(left):
                one = front.pop()
                near = _near(fp[left], fp[one])
                found, left = left[near], left[~near]
                out_a.append(np.full(len(found), rep[one]))
                out_b.append(rep[found])
                front += found.tolist()
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _group(tag: int, own):
    """The number of a segment's key, below 2 ** 24; of arrays too."""
    return own | tag << 22


def _crowded(distinct: DataFrame, most: int) -> np.ndarray:
    """A bit for each group of _group(), packed: whether more than `most` rows may ask for it.

    A group of a ball of k keys holds more only where one of its keys has more than most / k rows. Keys have 22
    bits at most, so both what is collected and the result, 2 MB, are bounded whatever the table's size.
    """
    owns = [F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1).bitwiseOR(tag << 22) for tag, (low, width, _) in enumerate(SEGMENTS)]
    bound = F.element_at(F.array(*[F.lit(most // (1 + radius * width)) for _, width, radius in SEGMENTS]), (F.shiftright("own", 22) + 1).cast("int"))
    found = distinct.select(F.explode(F.array(*owns)).alias("own")).groupBy("own").count().where(F.col("count") > bound)
    own = found.select("own").toArrow().column(0).to_numpy()
    marks = np.zeros(len(SEGMENTS) << 22, bool)
    marks[own] = True
    for tag, (_, width, radius) in enumerate(SEGMENTS):
        for bit in range(width * radius):
            marks[own[own >> 22 == tag] | 1 << bit] = True
    return np.packbits(marks)


def near_links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, rep) with distinct fps -> (a, b) pairs of reps that connect all fingerprints within THRESHOLD bits.

    Not all pairs of a dense group are returned, only links that connect it. No group of more than about `most`
    rows is compared in one task, whatever the bits that fingerprints share.
    """
    spark = distinct.sparkSession
    crowded = _crowded(distinct, most)
    shared, any_crowded = spark.sparkContext.broadcast(crowded), bool(crowded.any())

    def probe(batches):
        import pyarrow as pa

        def table(*columns):
            return pa.record_batch([pa.array(x) for x in columns], names=["key", "fp", "rep"])

        full = np.unpackbits(shared.value).view(bool) if any_crowded else None
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = fp.view(np.uint64)
            for tag, (low, width, radius) in enumerate(SEGMENTS):
                own = ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                others = (bits >> np.uint64((low + width) % 64)) | (bits << np.uint64((64 - low - width) % 64))  # turned to the low end
                for bit in [None, *range(width)][: 1 + radius * width]:
                    ask = np.arange(len(own)) if bit is None else np.flatnonzero((own >> bit) & 1 == 0)
                    key = _group(tag, own[ask] | (0 if bit is None else 1 << bit))
                    over = full[key] if any_crowded else None
                    if not any_crowded or not over.any():
                        yield table(key, fp[ask], rep[ask])
                        continue
                    yield table(key[~over], fp[ask[~over]], rep[ask[~over]])
                    key, ask = key[over], ask[over]
                    for part in range(THRESHOLD + 1):
                        at, to = ((64 - width) * x // (THRESHOLD + 1) for x in (part, part + 1))
                        value = ((others[ask] >> np.uint64(at)) & np.uint64((1 << (to - at)) - 1)).astype(np.int64)
                        yield table(key | (part + 1) << 24 | value << 27, fp[ask], rep[ask])

    def compare(batches):
        import pyarrow as pa

        kept = [np.zeros(0, np.int64)] * 3

        def links(rows):
            a, b = _links(rows[0], rows[1].view(np.uint64), rows[2])
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            kept = [np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(kept)]
            if len(kept[0]) and kept[0][0] != kept[0][-1]:
                whole = int(np.searchsorted(kept[0], kept[0][-1]))  # the last key may go on in the next batch
                yield links([x[:whole] for x in kept])
                kept = [x[whole:] for x in kept]
        if len(kept[0]):
            yield links(kept)

    def met(keyed):
        return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()

    n = partitions(spark)
    keyed = distinct.select("fp", "rep").repartition(n).mapInArrow(probe, "key long, fp long, rep long")
    if not any_crowded:
        return met(keyed)
    finer = materialize(keyed.where(F.col("key") >= 1 << 24), "finer")
    links = materialize(met(keyed.where(F.col("key") < 1 << 24).union(_in_blocks(finer, most))), "links")
    discard(finer)
    return links


def _in_blocks(keyed: DataFrame, most: int) -> DataFrame:
    """(key, fp, rep) with the rows of a key that more than `most` have dealt into blocks, and a key for each two
    blocks, so that any two rows still meet. Two keys that get one number only share a comparison."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.ceil(2 * F.count("*") / most).cast("int").alias("blocks")).where(F.col("n") > most)
    rows = join_by_size(keyed, sizes, "key", "n", keyed.count())
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.where("blocks is not null").select("key", "fp", "rep", block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    pairs = dealt.where("i <> j").select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).bitwiseOR(-(1 << 63)).alias("key"), "fp", "rep")
    return rows.where("blocks is null").select("key", "fp", "rep").union(pairs)


def _classes(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, component, component_id) for every row; component = smallest fingerprint reachable over links."""
    rows = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    linked = connected_components(near_links(distinct.select("fp", F.col("fp").alias("rep")))).withColumnRenamed("component", "root")
    reached = materialize(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("component")), "reached")
    discard(distinct)
    smallest = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(reached.join(smallest, "component").select("fp", "n", "component", "component_id"), "classes")
    discard(reached)
    return join_by_size(rows, classes, "fp", "n", rows.count()).select("doc_id", "fp", "component", "component_id")


def simhash_classes(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id = smallest doc_id reachable over links.

    Fingerprints are the nodes, so that rows without an id or with a repeated one link like any other. Null ids
    are never the smallest, and a class of null ids alone has a null component_id. Null and empty texts have
    fingerprint zero. Empty input: no rows. Other columns are ignored.
    """
    return _classes(docs, width, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each class: one whose id is the class's smallest.

    Rows with a null id go, unless all of a class have none; then one of them stays. Where an id stands for
    several rows or for none, the row is found by its fingerprint too. Empty input: no rows.
    """
    import pandas as pd

    classes = materialize(_classes(docs.select(id_col, text_col), width, id_col, text_col), "rows")
    key_name, fp_name, want_key, want_fp = (free_name(docs, x) for x in ("own_key", "own_fp", "kept_key", "kept_fp"))
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("doc_id").alias(want_key), F.min("fp").alias(want_fp))
    kept = materialize(kept.select(want_key, want_fp), "kept")
    repeats = classes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(want_key))
    repeats = materialize(repeats, "repeats")
    discard(classes)
    key = docs[id_col].cast("long")
    clear = kept.where(F.col(want_key).isNotNull()).join(repeats, want_key, "left_anti")
    out = docs.join(clear.select(want_key), key == F.col(want_key), "left_semi")
    unclear = kept.where(F.col(want_key).isNull()).union(kept.join(repeats, want_key, "left_semi"))
    if not unclear.limit(1).count():
        return out

    def run(batches):
        for texts in batches:
            yield pd.Series([np.uint64(fingerprint(t or b"", width)).astype(np.int64) for t in texts], dtype="int64")

    run.__annotations__ = {}
    own = F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)(F.col(text_col).cast("string").cast("binary"))
    several = docs.where(key.isNull()).union(docs.join(repeats, key == F.col(want_key), "left_semi"))
    several = several.withColumns({key_name: F.col(id_col).cast("long"), fp_name: own})
    found = several.join(unclear, F.col(fp_name).eqNullSafe(F.col(want_fp)) & F.col(key_name).eqNullSafe(F.col(want_key)), "left_semi")
    return out.union(found.dropDuplicates([key_name, fp_name]).drop(key_name, fp_name))
