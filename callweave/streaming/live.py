"""Handover decisions on a stream of scored utterances."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K
from ..operators.handover import INSTANT, TREND, checked, handover_events, mass

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CALL = "next long, seen long, fired boolean, masses array<double>, gap_at long, idle_at long"


class FirstTrigger(StatefulProcessor):
    """Keeps the last masses of an open call and says once when it must be handed over.

    State of a call: the number of the next utterance, how many utterances it had, whether it has
    fired, the last w - 1 masses, and its timers; by number, also the utterances that wait for an earlier
    one. A call that has fired keeps no masses. With an idle time the state of silent calls goes.
    """

    def __init__(self, t: float, w: int, first: int | None, gap_ms: int | None, idle_ms: int | None):
        self.t, self.w, self.first, self.gap_ms, self.idle_ms = t, w, first, gap_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", CALL)
        self.waiting = handle.getMapState("waiting", "utterance long", "instant double, negative double, reset boolean")

    def load(self) -> None:
        start = (self.first or 0, 0, False, [], None, None)
        self.next, self.seen, self.fired, masses, self.gap_at, self.idle_at = self.call.get() if self.call.exists() else start
        self.masses, self.out = list(masses or []), []

    def take(self, instant: float, negative: float, reset: bool) -> None:
        """The next utterance; a reset begins a new conversation with it."""
        if reset:
            self.seen, self.fired, self.masses = 0, False, []
        if not self.fired:
            self.masses = [*self.masses, negative][-self.w :]
            trend = len(self.masses) == self.w and sum(self.masses) / self.w > self.t * 0.7
            if instant > self.t or trend:
                self.fired, self.masses = True, []
                self.out.append((self.seen, INSTANT if instant > self.t else TREND))
        self.seen += 1

    def take_waiting(self) -> None:
        """The utterances that waited for what has come by now."""
        while self.waiting.exists() and self.waiting.containsKey((self.next,)):
            row = self.waiting.getValue((self.next,))
            self.waiting.removeKey((self.next,))
            self.take(*row)
            self.next += 1

    def save(self, key, now: int) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()) if self.gap_ms or self.idle_ms else []:
            self.handle.deleteTimer(timer)
        self.gap_at = now + self.gap_ms if self.gap_ms and self.waiting.exists() else None
        self.idle_at = now + self.idle_ms if self.idle_ms else None
        for at in {self.gap_at, self.idle_at} - {None}:
            self.handle.registerTimer(at)
        self.call.update((self.next, self.seen, self.fired, self.masses, self.gap_at, self.idle_at))
        return pd.DataFrame([(key[0], *o) for o in self.out], columns=["dialogue_id", "trigger_utt", "trigger_reason"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        self.load()
        columns = ["utterance_id", "instant", "negative", "reset"]
        if self.first is None:
            for row in pd.concat(list(rows)).sort_values("utterance_id", kind="stable")[columns].itertuples(index=False):
                self.take(*row[1:])
        else:
            for chunk in rows:
                for row in chunk.sort_values("utterance_id", kind="stable")[columns].itertuples(index=False):
                    number, values = int(row[0]), (float(row[1]), float(row[2]), bool(row[3]))
                    if number == self.next:
                        self.take(*values)
                        self.next += 1
                    elif number > self.next:  # one that came before is not taken again
                        self.waiting.updateValue((number,), values)
                self.take_waiting()
        yield self.save(key, timer_values.getCurrentProcessingTimeInMs() if self.gap_ms or self.idle_ms else 0)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        self.load()
        at, now = expired.getExpiryTimeInMs(), timer_values.getCurrentProcessingTimeInMs()
        if self.gap_at == at:  # what is missing is not waited for any more
            for number in sorted(k[0] for k in self.waiting.keys()):
                self.next = number
                self.take_waiting()
            yield self.save(key, now)
        elif self.idle_at == at:
            self.call.clear()
            self.waiting.clear()
            yield pd.DataFrame([], columns=["dialogue_id", "trigger_utt", "trigger_reason"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timer_values) -> None:
        row = initialState.iloc[0]
        self.call.update((int(row["next"]), int(row["seen"]), bool(row["fired"]), [float(m) for m in row["masses"]], None, None))

    def close(self) -> None:
        pass


def call_history(scored: DataFrame, t: float, w: int, dialogue: str = "dialogue_id", utterance: str = "utterance_id", probs: str = "probs") -> DataFrame:
    """dialogue_id, next, seen, fired, masses: where calls stand after their scored utterances so far."""
    events = handover_events(scored, t, w, dialogue, utterance, probs).select(F.col(dialogue).alias("dialogue_id"), F.col(utterance).alias("u"), "handover", mass(probs, K.ANGER, K.FRUSTRATION, K.SADNESS).alias("m"))
    placed = events.withColumn("back", F.row_number().over(Window.partitionBy("dialogue_id").orderBy(F.desc("u"))))
    # The last w masses at most are gathered.
    last = F.array_sort(F.collect_list(F.when(F.col("back") <= w, F.struct((-F.col("back")).alias("at"), "m"))))
    calls = placed.groupBy("dialogue_id").agg((F.max("u") + 1).cast("bigint").alias("next"), F.count("*").alias("seen"), F.max("handover").alias("fired"), F.transform(last, lambda x: x["m"]).alias("masses"))
    return calls.withColumn("masses", F.when(F.col("fired"), F.array().cast("array<double>")).otherwise(F.col("masses")))


def stream_handover(
    stream: DataFrame,
    t: float = 0.6,
    w: int = 3,
    idle_ms: int | None = None,
    dialogue: str = "dialogue_id",
    utterance: str = "utterance_id",
    probs: str = "probs",
    first: int | None = None,
    gap_ms: int | None = None,
    reset: str | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """dialogue_id, trigger_utt, trigger_reason: the first trigger of each dialogue, once.

    With `first`, the number of the first utterance of a call, utterances are taken by number, whenever
    they come: one that comes before an earlier one waits for it in the state, and one that comes again is
    not taken again. After gap_ms without an utterance of the call, what is missing is not waited for any more. Without `first`,
    utterances are taken in order within a micro-batch and by arrival between them; then those of a
    call in a micro-batch are in memory at once, so a source with very long calls is read in bounded
    batches (maxFilesPerTrigger or maxBytesPerTrigger).

    reset names a boolean column: where it is true the utterance begins a new conversation of the dialogue, with an
    empty window, positions from 0 and a trigger of its own. history is a batch table of scored
    utterances that came before the stream began: calls go on from where they stand there. Needs
    the RocksDB state store.
    """
    checked(t, w)
    kind = stream.schema[dialogue].dataType.simpleString()
    rows = stream.select(
        F.col(dialogue).alias("dialogue_id"),
        F.col(utterance).alias("utterance_id"),
        mass(probs, K.ANGER, K.FRUSTRATION).alias("instant"),
        mass(probs, K.ANGER, K.FRUSTRATION, K.SADNESS).alias("negative"),
        (F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)).alias("reset"),
    )
    before = call_history(history, t, w, dialogue, utterance, probs).groupBy("dialogue_id") if history is not None else None
    return rows.groupBy("dialogue_id").transformWithStateInPandas(
        statefulProcessor=FirstTrigger(t, w, first, gap_ms, idle_ms),
        outputStructType=f"dialogue_id {kind}, trigger_utt long, trigger_reason string",
        outputMode="append",
        timeMode="processingTime" if idle_ms or gap_ms else "none",
        initialState=before,
    )
