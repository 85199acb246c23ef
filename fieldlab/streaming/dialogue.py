"""Understanding of messages as a stream: one stateful job whose state is a memory for each conversation."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldlab.operators import dialogue as d
from fieldlab.sources.shared import stage


class Carry(StatefulProcessor):
    """Advances a conversation's memory by the messages of a micro-batch, in the order of their times. By event time, `ttl`
    after its last message, a memory shrinks to that message's time."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "memory string")

    def _held(self) -> d.Memory:
        return d.read_memory(self.memory.get()[0]) if self.memory.exists() else d.Memory()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        memory, out = self._held(), []
        batch = pd.concat(list(rows)).sort_values(d.SORTED, na_position="first", kind="stable")
        for turn, hits in itertools.chain.from_iterable(d.turns_of([batch])):
            memory, meant = d.advance(memory, turn, hits, self.ttl)
            out.append({"conv_id": key[0], "turn": turn["turn"], **meant, "at": memory.seen, "memory": memory.text()})
        self.memory.update((memory.text(),))
        self._wake(memory, timerValues)
        yield pd.DataFrame(out, columns=d.COLUMNS)

    def _wake(self, memory: d.Memory, timers) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if memory.seen is not None:
            self.handle.registerTimer(max((memory.seen + self.ttl) // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.memory.exists():
            self.memory.update((d.Memory(seen=self._held().seen).text(),))
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        text = initialState["memory"].iloc[0]
        self.memory.update((text,))
        self._wake(d.read_memory(text), timerValues)

    def close(self) -> None:
        pass


def understand_stream(messages: DataFrame, catalog: DataFrame, delay: str = "1 hour", ttl: int = d.DAY, memories: DataFrame | None = None, rules: Sequence[d.Rule] = d.RULES) -> DataFrame:
    """What `understand` gives, of a stream of messages (conv_id, turn, ts, text), for append output; rows later than `delay`
    behind the newest are left out. Conversations begin with `memories` (conv_id, memory) where one is given. The state
    store must be RocksDB (spark.sql.streaming.stateStore.providerClass). The catalogue is a table; every micro-batch joins it."""
    sizes = catalog.agg(F.max(F.size(F.split("alias", " "))).alias("words"), F.count(F.lit(1)).alias("n")).first()
    rows = d.features(messages.withWatermark("ts", delay), rules)
    named = d.with_mentions(rows, catalog.select("alias", "kind", "name"), sizes.words or 1, sizes.n <= 100_000)
    begin = None if memories is None else stage(memories.select("conv_id", "memory"), "memories").groupBy("conv_id")
    return named.groupBy("conv_id").transformWithStateInPandas(Carry(ttl), d.RESULT, "append", "EventTime", begin)
