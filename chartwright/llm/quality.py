"""Importance resampling by hashed n-gram models and Gumbel top-k (operator 10).

Two bag-of-n-grams models over hashed buckets, of target documents and of all documents. A document's log
importance weight is the log of the ratio of its probabilities under both, the sum of its n-grams' log ratios.
The sample is the k documents of largest log weight plus standard Gumbel noise, which draws k documents one
after another without replacement, each with a probability in proportion to its weight.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import discard, materialize, sample_by_hash

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 10_000
#: Labelled rows used at most, those whose id hashes lowest.
SAMPLE_ROWS = 20_000
_MEMORY = 500_000


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > _MEMORY:
            self.clear()
        out = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return out


_HASHES = _Hashes()


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams; tokens are words and runs of marks.

    A token after itself is one n-gram of its own kind, whatever the token.
    """
    h = np.fromiter(map(_HASHES.__getitem__, TOKEN.findall(text or "")), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    pairs[h[:-1] == h[1:]] = 1
    return np.concatenate((h % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS))).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """n-grams of all rows by bucket; tasks add up their own rows first, BUCKETS rows reach the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(ngram_buckets(t.as_py()), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket, with half an n-gram added to each bucket of both."""
    return np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))


def log_weight(df: DataFrame, ratios: np.ndarray, text_col: str = "text") -> Column:
    """Log importance weight of a text; 0 for one without tokens."""
    import pandas as pd

    shared = df.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for texts in batches:
            yield pd.Series([float(shared.value[ngram_buckets(t)].sum()) for t in texts], dtype=float)

    run.__annotations__ = {}
    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col(text_col).cast("string"))


def gumbel(key: Column, seed: int | Column = 42) -> Column:
    """Standard Gumbel noise that a row's key and the seed decide."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most `bound` ids labelled with a quality; the least text and label of a repeated id."""
    sample = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    known = rows.join(F.broadcast(sample_by_hash(sample, "k", bound)), "k").groupBy("k").agg(F.min(F.struct("text", "label")).alias("x"))
    return known.select("x.text", "x.label")


def kth_largest(keys: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of a double column by repeated histograms, however large k is; inf for k = 0."""
    low, high, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or not n:
        return np.inf
    if k >= n:
        return low
    above, bins = 0, 4096
    while True:
        inside = keys.where(F.col(col).between(low, high))
        if inside.count() <= 5000 or low == high:
            rest = sorted((r[0] for r in inside.select(col).limit(5001).collect()), reverse=True) if low < high else [low]
            return rest[min(k - above, len(rest)) - 1]
        step = (high - low) / bins
        slot = F.least(F.greatest(F.floor((F.col(col) - low) / step), F.lit(0)), F.lit(bins - 1)).cast("int")
        for r in inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("slot")).collect():
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]


class Resampler:
    """Log ratios of the two models, and the share of target documents among the labelled ones."""

    def __init__(self, docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS):
        """Raw counts are over all documents, target counts over a bounded sample of those labelled good."""
        known = materialize(labelled_texts(docs, labels, bound), "labelled")
        target = bucket_counts(known.where("label = 1"))
        self.ratios = log_ratios(target, bucket_counts(docs)) if target.sum() else np.zeros(BUCKETS)
        self.good, self.labelled = known.agg(F.count_if(F.col("label") == 1), F.count("*")).first()
        discard(known)

    def target_rows(self, n: int) -> int:
        """k by default: how many of n documents are target-like by the labelled ones' share, and two standard
        errors of that share more; all of them if no target document is labelled."""
        if not self.good:
            return n
        share = self.good / self.labelled
        return min(n, int(np.ceil(n * (share + 2 * np.sqrt(share * (1 - share) / self.labelled)))))

    def weight_and_noise(self, docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
        """(log weight, noise) of a row; its id and its text decide the noise."""
        return log_weight(docs, self.ratios, text_col), gumbel(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")), seed)

    def least_key(self, keys: DataFrame, k: int | None = None) -> float:
        """The k-th largest of a column `key`. Rows that tie with it are all kept."""
        return kth_largest(keys, "key", self.target_rows(keys.count()) if k is None else k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, log_weight, key, kept): the rows drawn by Gumbel top-k; kept is true.

    k is the size of the sample, Resampler.target_rows() by default. Null and empty texts have weight 1 (log 0).
    Without labelled target documents all weigh the same and, k unset, all are kept. Rows that repeat an id and
    a text are drawn alike; null ids draw by their text. Empty input: no rows. Other columns are ignored.
    """
    model = Resampler(docs, labels)
    weight, noise = model.weight_and_noise(docs, seed)
    rows = materialize(docs.select("doc_id", weight.alias("log_weight"), (weight + noise).alias("key")), "weighed")
    return rows.where(F.col("key") >= float(model.least_key(rows, k))).withColumn("kept", F.lit(True))


def keep_sampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """The drawn rows with all their columns; cases as in resample().

    Only the keys are written out, 8 bytes a row; a row's key is then computed again where the row lies, from
    the same text, so that no text is copied.
    """
    model = Resampler(docs, labels)
    weight, noise = model.weight_and_noise(docs, seed)
    key = weight + noise
    keys = materialize(docs.select(key.alias("key")), "keys")
    least = float(model.least_key(keys, k))
    discard(keys)
    return docs.where(key >= least)
