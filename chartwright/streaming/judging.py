"""Judging as a stream with state: what was asked, what was answered and what was spent, run by run, across restarts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A request (kind request: request_no, cost, has_metadata) or an answer (kind answer: score, reasoning, confidence).
EVENT = "run_id string, kind string, key string, request_no long, cost double, has_metadata boolean, score double, reasoning string, confidence double"
OUTCOME = "run_id string, key string, outcome string, score double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def valid_answer(score, reasoning, confidence) -> bool:
    """The rules of a stored judgement: a score of 0 to 10, a reason of 1 to 600 characters, a confidence of 0 to 1."""
    number = lambda x, high: x is not None and x == x and 0 <= x <= high
    return number(score, 10) and isinstance(reasoning, str) and 1 <= len(reasoning) <= 600 and number(confidence, 1)


class Judging(StatefulProcessor):
    """Outcome of each event of a run: known (no metadata, 10 without a call), ask, over (the budget is spent), answer, refused.

    State: what the run has spent, and each key's standing (asked or answered). A request is asked once, in order of
    request_no within a batch, while what was spent before it is less than the cap. An answer counts once, if it is valid and
    its key was asked; a key whose answer was refused may be answered again. Repeats give no outcome, and of a batch's refused
    answers of one key only the first does.
    """

    def __init__(self, cap: float):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent double")
        self.standing = handle.getMapState("standing", "key string", "standing string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        events = pd.concat(list(rows), ignore_index=True)  # one run's rows of one batch
        spent = self.spent.get()[0] if self.spent.exists() else 0.0
        out, now, refused = [], {}, set()

        def standing(k):
            if k not in now:
                now[k] = self.standing.getValue((k,))[0] if self.standing.containsKey((k,)) else None
            return now[k]

        for r in events[events["kind"] == "answer"].sort_values(["key", "score"]).itertuples(index=False):
            if standing(r.key) == "answered":
                continue
            if standing(r.key) == "asked" and valid_answer(r.score, r.reasoning, r.confidence):
                now[r.key] = "answered"
                out.append((key[0], r.key, "answer", float(r.score)))
            elif r.key not in refused:
                refused.add(r.key)
                out.append((key[0], r.key, "refused", None))
        for r in events[events["kind"] == "request"].sort_values(["request_no", "key"]).itertuples(index=False):
            if standing(r.key) is not None:
                continue
            if not r.has_metadata:
                now[r.key] = "answered"
                out.append((key[0], r.key, "known", 10.0))
            elif spent < self.cap:
                spent += float(r.cost)
                now[r.key] = "asked"
                out.append((key[0], r.key, "ask", None))
            else:
                out.append((key[0], r.key, "over", None))
        self.spent.update((spent,))
        for k, v in now.items():
            if v is not None:
                self.standing.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["run_id", "key", "outcome", "score"]).astype({"run_id": object, "key": object, "outcome": object, "score": float})

    def close(self) -> None:
        pass


def judged(events: DataFrame, cap: float) -> DataFrame:
    """(run_id, key, outcome, score) of a stream of EVENT rows. The session's state store must keep its state on disk: start the
    query with PROVIDER. A run's rows of one batch are held by one task, so bound the batches."""
    return events.groupBy("run_id").transformWithStateInPandas(Judging(cap), OUTCOME, "Append", "None")


def run_judging(events: DataFrame, cap: float, path: str, checkpoint: str) -> None:
    """All that has landed, as outcomes appended to Parquet files at `path`; run again, it goes on where it stopped, with the
    budgets as they were."""
    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        judged(events, cap).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
