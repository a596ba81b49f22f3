"""Benchmark decontamination by pigeonhole edit matching (operator 1).

An item of m characters with an error budget of k is split into k + 1 pieces. A passage within k edits of
the item leaves at least one piece whole, so the exact hits of all pieces, found by one Aho-Corasick pass
over a document, lead to every such passage; Myers' bit-parallel distance around the hit decides. A hit is
verified in widening spans: of two neighbouring groups of p and q pieces in a passage with p + q - 1 edits or
fewer, one has at most its own number of pieces less one, so a chance hit fails in its first short span.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwright.llm.common import materialize

#: Characters of benchmark text searched for in one pass over the documents; more text takes more passes.
BLOCK_CHARS = 4_000_000
#: Copies of an item listed at a time.
STEP = 10_000


def normal(text: str | None) -> str:
    """Lower case, white space squeezed to single blanks."""
    return " ".join((text or "").lower().split())


def split_pieces(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """(error budget, [(place, piece)]): budget + 1 pieces of nearly equal length that make up the item."""
    budget = int(len(item) * rate)
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int]:
    """(least edit distance of the item to a substring of text, where that ends first); (budget + 1, -1) if above."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, budget + 1, -1
    left = len(text)
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(d0 | plus)), d0 & plus
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, at + 1
            if not best:
                break
        left -= 1
        if score - left > budget and best > budget:
            break
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
    return best, end


def widening_spans(cuts: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each piece, the (begin, end, budget) of the groups of pieces around it, from two or three pieces to all."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in cuts[1:]]

    def halve(first: int, last: int) -> None:
        if last - first > 1:
            middle = (first + last) // 2
            halve(first, middle)
            halve(middle, last)
            for i in range(first, last):
                out[i].append((cuts[first], cuts[last], last - first - 1))

    halve(0, len(cuts) - 1)
    return out


class Matcher:
    """Finds the items in normalised documents; made in each task from a broadcast block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items, where = [], {}
        for item_id, text in items:
            text = normal(text)
            if text:
                budget, pieces = split_pieces(text, rate)
                spans = widening_spans([at for at, _ in pieces] + [len(text)])
                for n, (place, piece) in enumerate(pieces):
                    where.setdefault(piece, []).append((len(self.items), place, n))
                masks = {(a, b): letter_masks(text[a:b]) for a, b, _ in {x for one in spans for x in one}}
                self.items.append((item_id, text, budget, spans, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple[object, int, int]]:
        """[(item_id, least distance, where in the normalised document that passage ends)]."""
        text = normal(raw)
        if not text or not self.items:
            return []
        hits: dict[int, set[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, place, n in places:
                hits.setdefault(item, set()).add((end + 1 - size - place, n))
        out = []
        for item, found in hits.items():
            item_id, wanted, budget, _, _ = self.items[item]
            exact = text.find(wanted)
            if exact >= 0:
                out.append((item_id, 0, exact + len(wanted)))
            elif budget:
                seen: dict[tuple[int, int, int], tuple[int, int]] = {}
                best = min((self._verify(item, text, line, n, seen) for line, n in sorted(found)), default=(budget + 1, -1))
                if best[0] <= budget:
                    out.append((item_id, *best))
        return out

    def _verify(self, item: int, text: str, line: int, n: int, seen: dict) -> tuple[int, int]:
        """(distance, end) of the whole item around piece n, which begins the item at `line`; budget + 1 if too far."""
        _, _, budget, spans, masks = self.items[item]
        got = (budget + 1, -1)
        for a, b, allowed in spans[n]:
            if (line, a, b) not in seen:
                begin = max(0, line + a - allowed)
                distance, end = myers(masks[a, b], b - a, text[begin : max(0, line + b + allowed)], allowed)
                seen[line, a, b] = (distance, begin + end)
            got = seen[line, a, b]
            if got[0] > allowed:
                return budget + 1, -1
        return got


def _items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(item_id, text, copies) of each item that can match, written out; (key, text, block) of each of their texts; blocks.

    Repeated items are counted, not repeated, and null, empty and blank ones are gone before anything is collected. Texts
    are dealt by the running sum of their lengths in the order of their keys, so a block holds BLOCK_CHARS characters
    and one text at most.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = items.where(F.col("text").rlike(r"\S")).withColumn("key", F.sha2("text", 256)).groupBy("item_id", "key", "text").agg(F.count("*").alias("copies"))
    items = materialize(items, "items")
    texts = items.select("key", F.col("text")).groupBy("key").agg(F.min("text").alias("text")).withColumn("group", F.substring("key", 1, 2))
    sizes = texts.select("key", "group", F.length("text").cast("long").alias("size"))
    # 256 groups by the first digits of the keys: sums of groups, then within each
    groups = sizes.groupBy("group").agg(F.sum("size").alias("n")).select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("base"))
    before = F.sum("size").over(Window.partitionBy("group").orderBy("key")) - F.col("size")
    placed = sizes.withColumn("before", before).join(F.broadcast(groups), "group").select("key", F.floor((F.col("base") + F.col("before")) / BLOCK_CHARS).alias("block"))
    dealt = materialize(texts.select("key", "text").join(placed, "key"), "texts")
    return items, dealt, int(dealt.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]) + 1


def _matcher(shared, rate: float) -> Matcher:
    """The automaton of a broadcast block of texts, made once in a worker while it works on that block."""
    key = shared.value[0], rate
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(shared.value[1], rate)
    return _BUILT[key]


_BUILT: dict = {}


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end): each item that occurs in a row's text within rate x its length edits.

    distance is the least over the text, `end` the first place in the normalised text where it is reached.
    Case and amounts of white space don't count. Null and empty texts match nothing, nor do empty items;
    repeated rows and repeated items are reported each. The benchmark's distinct texts are read in blocks of about
    BLOCK_CHARS characters, one broadcast and one pass over the documents each, so what is sent is bounded.
    """
    spark = docs.sparkSession
    items, texts, blocks = _items(benchmark)
    out = None
    for k in range(blocks):
        held = texts.where(F.col("block") == k).select("key", "text").orderBy("key").collect()
        matcher = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["key"], r["text"]) for r in held]))

        def run(batches, matcher=matcher):
            import pyarrow as pa

            found = _matcher(matcher, rate)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in found.find(t.as_py())]
                cols = zip(*rows, strict=True) if rows else [[]] * 4
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "key", "distance", "end"])

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        pairs = rows.mapInArrow(run, "doc_id long, key string, distance long, end long")
        out = pairs if out is None else out.unionByName(pairs)
    schema = "doc_id long, item_id long, distance long, end long"
    if out is None:
        return spark.createDataFrame([], schema)
    each = out.join(items.select("key", "item_id", "copies"), "key")
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STEP))).alias("part"))
    each = each.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEP).cast("long"), F.col("copies") - F.col("part") * STEP))))
    return each.select("doc_id", "item_id", "distance", "end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark item within rate x its length edits.

    Null and empty texts stay. One pass for each block of the benchmark, as in contaminated_pairs().
    """
    import pandas as pd

    _, dealt, blocks = _items(benchmark)
    for k in range(blocks):
        held = dealt.where(F.col("block") == k).select("text").orderBy("key").collect()
        matcher = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(i, r["text"]) for i, r in enumerate(held)]))

        def clean(batches, matcher=matcher):
            found = _matcher(matcher, rate)
            for texts in batches:
                yield pd.Series([not found.find(t) for t in texts], dtype=bool)

        clean.__annotations__ = {}
        docs = docs.where(F.pandas_udf(clean, "boolean", F.PandasUDFType.SCALAR_ITER)(F.col(text_col).cast("string")))
    return docs
