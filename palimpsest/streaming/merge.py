"""Streams of records: letters as records arrive, and tables to which only new keys are added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType


def rendered(records: DataFrame, render: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes what render makes of each record that arrives. Rendering looks at one record at a time, so it needs no
    state, and the file sink makes each record's text appear once."""
    return render(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _First(StatefulProcessor):
    """Of a key's rows the least of the first batch that has some; the state is that there was one."""

    def __init__(self, columns: list[str], order: tuple[str, ...]):
        self.columns, self.order = columns, [*order, *(c for c in columns if c not in order)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "had boolean")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        # nulls come first, as they do in Spark's order
        best = min(rows, key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in self.order), default=None)
        if not self.seen.exists() and best is not None:
            self.seen.update((True,))
            yield Row(**{c: best[c] for c in self.columns})

    def handleInitialState(self, key, initial, timers) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def keep_new(rows: DataFrame, path: str, key: str, checkpoint: str, order: tuple[str, ...] = (), have: DataFrame | None = None) -> StreamingQuery:
    """Appends to a table the first row of each key that it lacks: of a batch's rows of a key the least in order, then in
    all columns. The keys that were met are the stream's state, so the table is never read again, however large; have
    (with the key) are those that it had before the stream first ran. A batch that is run again gives the same rows, which
    the file sink writes once. Rows without a key are one key."""
    spark = rows.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema: StructType = rows.schema
    first = _First(rows.columns, order)
    initial = None if have is None else have.select(key).distinct().groupBy(key)
    new = rows.groupBy(key).transformWithState(first, schema, "append", "none", initialState=initial)
    return new.select(*(F.col(c) for c in rows.columns)).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
