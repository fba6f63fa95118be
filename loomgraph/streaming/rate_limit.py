"""A per-client fixed-window rate limit (id N8), as a batch fold and as a stateful stream.

A window opens at a client's first event and at the first one ``window`` later; an
event is rejected when the window already took ``limit``; rejects do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_batch(events: DataFrame, limit: int = 3, window_us: int = 1_000_000, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, n_events, n_rejected) by one ordered fold over each client's timestamps.

    Clients are sorted within their partition and streamed through: the fold's state is a few
    numbers, however many events a client has.  Null clients are one client."""
    t = F.unix_micros(F.col(ts).cast("timestamp")).alias("t")
    rows = events.select(F.col(key).alias("k"), t, F.col(tie).alias("e")).repartition("k").sortWithinPartitions("k", "t", "e").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, opened, taken, seen, no, any_ = None, None, 0, 0, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            times = b.column(1).to_numpy(zero_copy_only=False)
            code = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            done: list[tuple] = []
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows], strict=True):
                name = b.column(0)[a].as_py()
                if not any_ or name != client:
                    if any_:
                        done.append((client, seen, no))
                    client, opened, taken, seen, no, any_ = name, None, 0, 0, 0, True
                seen += z - a
                while a < z:
                    if opened is None or times[a] - opened >= window_us:
                        opened, taken = int(times[a]), 0
                    end = a + int(np.searchsorted(times[a:z], opened + window_us))
                    no += max(0, taken + end - a - limit) - max(0, taken - limit)
                    taken, a = taken + end - a, end
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], b.schema.types[0] if i == 0 else pa.int64()) for i in range(3)], names)
            kind = b.schema.types[0]
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([client], kind), pa.array([seen]), pa.array([no])], names)

    names = [key, "n_events", "n_rejected"]
    return rows.mapInArrow(run, f"`{key}` {events.schema[key].dataType.simpleString()}, n_events long, n_rejected long")


def limit_stream(events: DataFrame, limit: int = 3, window_us: int = 1_000_000, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Streaming (key, ts, allowed) in order of arrival; the state of a client is two numbers."""

    def run(client: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        for b in batches:
            b = b.sort_values(ts, kind="stable")
            allowed = []
            for t in (int(x.value // 1000) for x in pd.DatetimeIndex(b[ts]).as_unit("ns")):
                if start is None or t - start >= window_us:
                    start, n = t, 0
                allowed.append(n < limit)
                n += allowed[-1]
            yield pd.DataFrame({key: [client[0]] * len(b), ts: b[ts], "allowed": allowed})
        state.update((start, n))

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{ts}` timestamp, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)
