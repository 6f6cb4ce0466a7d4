"""The state machines of spans: open, closed in time, or expired by a timer.

Spans are dealt to ``GROUPS`` keys, and the state of a key is a map from span to its start,
type and end as far as they have arrived, in either order, kept in the RocksDB store under
the query's checkpoint. What arrives in one batch is paired there, as a frame; only rows
without their partner ask the map or enter it. A start has to be closed within the
timeout, an end can only close a start that is not late, so each is *due* at a time, for
which the key registers an event-time timer (rounded up to the timeout, so that many spans
share one). When the watermark passes it, open spans that were due are written as failed
and leave the map. A span has one start and one end; of several that arrive the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GROUPS = 64
SPAN_SCHEMA = "span_id long, event_type string, status string, duration_us long"


def _rows(ids: list, types: list, durations: list) -> pd.DataFrame:
    return pd.DataFrame({"span_id": pd.array(ids, dtype="Int64"), "event_type": pd.array(types, dtype=object),
                         "status": ["failed" if x is None else "ok" for x in durations], "duration_us": pd.array(durations, dtype="Int64")})


class SpanStates(StatefulProcessor):
    def __init__(self, timeout_s: int):
        self.timeout_us = timeout_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span_id long", "open_us long, event_type string, close_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows, ignore_index=True).sort_values("us", kind="stable")
        closes = frame["closes"].to_numpy(dtype=bool)
        opened = frame[~closes].drop_duplicates("span_id").set_index("span_id")[["us", "event_type"]]
        closed = frame[closes].drop_duplicates("span_id").set_index("span_id")["us"].rename("close_us")
        both = opened.join(closed, how="outer")
        took = (both["close_us"] - both["us"]).to_numpy(dtype=float)
        paired = (took >= 0) & (took <= self.timeout_us)
        whole = both[paired]
        if len(whole):
            yield _rows(list(whole.index), list(whole["event_type"]), [int(x) for x in (whole["close_us"] - whole["us"])])
        ids, types, durations, due = [], [], [], set()
        for span, us, event_type, close_us in both[~paired].itertuples():
            at = (int(span),)
            start, kind, end = self.spans.getValue(at) if self.spans.containsKey(at) else (None, None, None)
            start, kind = (start, kind) if start is not None or np.isnan(us) else (int(us), event_type)
            end = end if end is not None or np.isnan(close_us) else int(close_us)
            if start is not None and end is not None and 0 <= end - start <= self.timeout_us:
                self.spans.removeKey(at)
                ids.append(int(span))
                types.append(kind)
                durations.append(end - start)
            else:
                self.spans.updateValue(at, (start, kind, end))
                due.add(-(-self._due(start, end) // self.timeout_us) * self.timeout_us)
        for us in due:
            self.handle.registerTimer(us // 1000 + 1)
        if ids:
            yield _rows(ids, types, durations)

    def _due(self, start: int | None, end: int | None) -> int:
        return end if start is None else start + self.timeout_us

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        over = [(at, state) for at, state in self.spans.iterator() if self._due(state[0], state[2]) < passed]
        for at, _ in over:
            self.spans.removeKey(at)
        failed = [(at[0], state[1]) for at, state in over if state[0] is not None]
        if failed:
            yield _rows([x for x, _ in failed], [x for _, x in failed], [None] * len(failed))

    def close(self) -> None:
        pass
