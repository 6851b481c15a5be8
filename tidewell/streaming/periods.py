"""Event-time periods over a stream with several sources per group.

A period of a group closes when the low watermark, the least mark of the group's live sources, has passed the period's end
by the allowed lateness. A source's mark is the greatest event time it has sent; a punctuation (a row without
value) moves it too. A source silent for ``idle_ms`` of processing time no longer holds the others back. Rows of closed
periods are diverted, not dropped. Open periods are emitted at every change, so late rows correct what was sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "grp string, period_start bigint, n_values bigint, sum_value double, min_value double, max_value double, closed boolean, late_ts bigint, late_value double"
STATE = "marks map<string,bigint>, seen map<string,bigint>, periods map<bigint,struct<n bigint,s double,lo double,hi double>>, closed_to bigint"
_NO = None


class Periods:
    """Open periods of one group; plain Python, so that it can be tested without a stream."""

    def __init__(self, period_ms: int, lateness_ms: int, idle_ms: int, state: tuple | None = None):
        self.period_ms, self.lateness_ms, self.idle_ms = period_ms, lateness_ms, idle_ms
        marks, seen, periods, closed_to = state or ({}, {}, {}, -(2**63))
        self.marks, self.seen, self.closed_to = dict(marks), dict(seen), closed_to
        self.open = {k: list(v) for k, v in dict(periods).items()}

    def state(self) -> tuple:
        return self.marks, self.seen, {k: tuple(v) for k, v in self.open.items()}, self.closed_to

    def low_watermark(self, now_ms: int) -> int | None:
        """The least mark of the sources that are not idle; if all are, the least of all."""
        live = [m for s, m in self.marks.items() if now_ms - self.seen[s] < self.idle_ms]
        return min(live or self.marks.values(), default=None)

    def add(self, rows: list[tuple[str, int, float | None]], now_ms: int) -> list[tuple]:
        """Rows (source, ts, value) in order of arrival -> output rows (without the group)."""
        out, touched = [], set()
        for source, ts, value in rows:
            start = ts - ts % self.period_ms
            if value is not None and start + self.period_ms <= self.closed_to:
                out.append((start, _NO, _NO, _NO, _NO, True, ts, value))
            elif value is not None:
                p = self.open.setdefault(start, [0, 0.0, value, value])
                p[0], p[1], p[2], p[3] = p[0] + 1, p[1] + value, min(p[2], value), max(p[3], value)
                touched.add(start)
            self.marks[source] = max(self.marks.get(source, ts), ts)
            self.seen[source] = now_ms
            self._advance(now_ms)
        done = [k for k in self.open if k + self.period_ms <= self.closed_to]
        for k in sorted(touched | set(done)):
            out.append((k, *self.open[k], k in done, _NO, _NO))
        for k in done:
            del self.open[k]
        return out

    def _advance(self, now_ms: int) -> None:
        mark = self.low_watermark(now_ms)
        if mark is not None:
            # periods that end at or before this are closed
            self.closed_to = max(self.closed_to, mark - self.lateness_ms)

    def timeout(self, now_ms: int) -> list[tuple]:
        self._advance(now_ms)
        return self.add([], now_ms)


def stream_periods(rows: DataFrame, period_ms: int, lateness_ms: int, idle_ms: int = 60_000) -> DataFrame:
    """Stream (grp string, source string, ts bigint, value double) -> OUTPUT rows.

    Rows with late_ts set are diverted late rows; the others are states of periods, the last with closed true.
    """

    def go(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        periods = Periods(period_ms, lateness_ms, idle_ms, tuple(state.get) if state.exists else None)
        if state.hasTimedOut:
            out = periods.timeout(now)
        else:
            got = [(s, int(t), None if pd.isna(v) else float(v)) for pdf in pdfs for s, t, v in zip(pdf.source, pdf.ts, pdf.value, strict=True)]
            out = periods.add(got, now)
        state.update(periods.state())
        state.setTimeoutDuration(idle_ms)
        columns = ["period_start", "n_values", "sum_value", "min_value", "max_value", "closed", "late_ts", "late_value"]
        frame = pd.DataFrame(out, columns=columns, dtype=object)
        frame.insert(0, "grp", key[0])
        for c in ("period_start", "n_values", "late_ts"):
            frame[c] = frame[c].astype("Int64")
        for c in ("sum_value", "min_value", "max_value", "late_value"):
            frame[c] = frame[c].astype("float64")
        frame["closed"] = frame["closed"].astype(bool)
        yield frame

    return rows.groupBy("grp").applyInPandasWithState(go, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
