"""Streams: micro-batches into a table, and counters in keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from emberlog.operators.segments import LogTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def into_table(stream: DataFrame, table: LogTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch becomes a level 0 segment, and merges that are due run; a batch seen again changes nothing.

    How many rows a flush takes is up to the source (maxFilesPerTrigger and the like), how often to the trigger."""

    def apply(batch: DataFrame, number: int) -> None:
        if table.apply(batch, checkpoint, number):
            table.run_due()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Counter(StatefulProcessor):
    """The next counts of the keys of a bucket, read and written at once; a delete clears a key's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "counts string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        counts = dict(json.loads(self.next.get()[0])) if self.next.exists() else {}
        codes, keys = pd.factorize(batch["key"], use_na_sentinel=False)
        keys = [None if pd.isna(k) else k for k in keys]
        order = np.lexsort((batch["seq"], codes))
        batch, codes = batch.iloc[order], codes[order]
        deleted, before = batch["deleted"].to_numpy(bool), np.array([counts.get(k, 0) for k in keys])
        # increments up to a row, less those up to the last delete of its key, or to the key's begin
        so_far, begins = np.cumsum(~deleted), np.diff(codes, prepend=-1) != 0
        since = np.maximum.accumulate(np.where(deleted | begins, np.arange(len(codes)), 0))
        n = so_far - np.where(deleted, so_far, so_far - 1 - before[codes])[since]
        ends = np.flatnonzero(np.diff(codes, append=-1))
        counts.update(zip((keys[c] for c in codes[ends]), (n[ends] % (1 << 32)).tolist()))
        self.next.update((json.dumps([x for x in counts.items() if x[1]]),))
        yield batch.loc[~deleted, ["key", "seq"]].assign(n=(n[~deleted] - 1) % (1 << 32))

    def close(self) -> None:
        pass


def counters(stream: DataFrame, buckets: int = 1024) -> DataFrame:
    """(key, seq, n) of every increment of a stream (key, seq, deleted); needs the RocksDB state store.

    Keys are dealt over buckets, each with one state, since a call for each key costs far more than its rows. A task holds
    a bucket's new rows and counts, so more keys want more buckets; with a checkpoint their number must stay."""
    dealt = stream.select("key", "seq", "deleted", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Counter(), "key string, seq long, n long", "append", "none")
