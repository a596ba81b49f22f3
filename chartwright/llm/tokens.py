"""Tables of token ids, and the exact length histogram (operator 9)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwright.llm.common import materialize

#: Distinct lengths summed in one window group.
SPAN = 1024


class Ranker:
    """Numbers a task's sequences of n tokens for packing into windows of `capacity`, batch after batch."""

    def __init__(self, capacity: int):
        self.capacity, self.seen, self.full = capacity, np.zeros(capacity, np.int64), 0

    def __call__(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank among the task's sequences with the same n mod capacity, whole windows in those before it)."""
        rest, full = n % self.capacity, n // self.capacity
        order = np.argsort(rest, kind="stable")
        ranked = rest[order]
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n)) - np.searchsorted(ranked, ranked) + self.seen[ranked]
        before = self.full + np.cumsum(full) - full
        self.seen += np.bincount(rest, minlength=self.capacity)
        self.full += int(full.sum())
        return rank, before


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int | None = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(task, doc_id, n_tokens, rank, full_before, ids) for every row; ids are little-endian unsigned 32-bit, end_id last.

    task, rank and full_before number the rows within the task that encoded them, as packing.place() needs
    them for windows of `capacity`; materialize() the result before using them. Null text counts as empty, a
    null id stays null, repeated rows are encoded one by one. Empty input: no rows. Other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from chartwright.llm.bpe import Encoder

        encoder, task, ranker = Encoder.open(vocabulary), TaskContext.get().partitionId(), Ranker(capacity)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                ids, bounds = encoder.encode_batch(part.column(1), end_id)
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids)])
                rank, before = ranker(np.diff(bounds))
                yield pa.record_batch(
                    [pa.array(np.full(part.num_rows, task)), part.column(0), pa.array(np.diff(bounds)), pa.array(rank), pa.array(before), data.cast(pa.binary())],
                    names=["task", "doc_id", "n_tokens", "rank", "full_before", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "task long, doc_id long, n_tokens long, rank long, full_before long, ids binary")


def encoded_lengths(docs: DataFrame, vocabulary: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row; as encode_documents, without keeping the ids."""

    def run(batches):
        import pyarrow as pa

        from chartwright.llm.bpe import Encoder

        encoder = Encoder.open(vocabulary)
        for batch in batches:
            _, bounds = encoder.encode_batch(batch.column(1), end_id)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(bounds))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs) for each distinct length; null lengths are left out."""
    return lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_totals(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length L as a context limit, exact answers from suffix sums.

    docs_from, tokens_from: documents of length L or more and their tokens. docs_to, tokens_to: of length L
    or less. truncated_tokens: tokens left when every document is cut to L. truncated_docs: those cut.
    quantile: share of documents of length L or less. An empty histogram gives no rows.

    Sums run in two levels, over groups of SPAN lengths and within a group, so that no task holds the whole
    histogram however many lengths there are.
    """
    h = materialize(histogram.withColumn("span", F.floor(F.col("length") / SPAN).cast("long")), "histogram")
    within = Window.partitionBy("span").orderBy(F.col("length").desc())
    over = Window.orderBy(F.col("span").desc())
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("length") * F.col("n_docs")).alias("t"))
    spans = spans.select(
        "span",
        (F.sum("d").over(over) - F.col("d")).alias("later_d"),
        (F.sum("t").over(over) - F.col("t")).alias("later_t"),
        F.sum("d").over(Window.partitionBy()).alias("all_d"),
        F.sum("t").over(Window.partitionBy()).alias("all_t"),
    )
    n = h.withColumn("tokens", F.col("length") * F.col("n_docs"))
    out = n.withColumns({"d": F.sum("n_docs").over(within), "t": F.sum("tokens").over(within)}).join(spans, "span")
    docs_from, tokens_from = F.col("d") + F.col("later_d"), F.col("t") + F.col("later_t")
    docs_to = F.col("all_d") - docs_from + F.col("n_docs")
    longer = docs_from - F.col("n_docs")
    return out.select(
        "length",
        "n_docs",
        F.col("tokens").alias("n_tokens"),
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        docs_to.alias("docs_to"),
        (F.col("all_t") - tokens_from + F.col("tokens")).alias("tokens_to"),
        longer.alias("truncated_docs"),
        (F.col("all_t") - tokens_from + F.col("tokens") + longer * F.col("length")).alias("truncated_tokens"),
        (docs_to / F.col("all_d")).alias("quantile"),
    )


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_docs, n_tokens, truncated_docs, truncated_tokens) for any context limits, from the histogram.

    Limits that are no length of any document count too. Repeated limits are answered once; an empty histogram
    gives zeros, no limit no rows. Null lengths aren't in a histogram.
    """
    spark = histogram.sparkSession
    asked = sorted(set(limits))

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(of), F.lit(0)).cast("long")

    wide = histogram.agg(
        *[
            F.array(
                F.lit(x).cast("long"),
                total(F.col("n_docs")),
                total(F.col("n_docs") * F.col("length")),
                total(F.when(F.col("length") > x, F.col("n_docs"))),
                total(F.least("length", F.lit(x)) * F.col("n_docs")),
            ).alias(f"a{i}")
            for i, x in enumerate(asked)
        ]
    )
    names = ["context_limit", "n_docs", "n_tokens", "truncated_docs", "truncated_tokens"]
    if not asked:
        return spark.createDataFrame([], ", ".join(f"{n} long" for n in names))
    return wide.select(F.explode(F.array(*wide.columns)).alias("a")).select(*[F.col("a")[i].alias(n) for i, n in enumerate(names)])


def quantile_lengths(totals: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least `share` of all documents don't exceed.

    totals: suffix_totals(), a row for each distinct length, so ties are one row. Shares above 1 and empty totals give no rows.
    """
    wanted = totals.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return totals.join(F.broadcast(wanted), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
