"""Keyed state of the streams.

``InOrder`` holds the rows of a key until the watermark has passed them and then hands them on by event time, so results do
not depend on how the input is cut into batches. A row at or behind the watermark is late: it is handed on as such at
once and never changes the state. The caller passes event time as plain microseconds (``at``), since Spark would drop
late rows silently if it knew the column to be the event time; the watermark itself still comes from that column.

State is kept per bucket of keys. Each call on the state goes to the JVM and back, and each group costs a data frame, so
with a group per key those took nearly all the time; a bucket reads and writes its waiting rows as one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

#: What ``InOrder`` reads: the key, a key of the row, event time in microseconds, what parts equal times, and two texts for the subclass.
ROW = ["key", "form", "at", "tie", "error", "payload"]
Row = tuple[int, int, str, str]
Rows = list[tuple[Row, str]]


class InOrder(StatefulProcessor):
    """Subclasses say what is put out for late rows and for rows whose time has come. A row sent twice counts once.

    Groups are buckets of keys; bucket -1 is for rows without a key, which only carry the watermark on. (A filter on them
    would be moved in front of it.)
    """

    columns: list[str] = []

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "key long, form string, at long, tie long, error string, payload string")
        self.due = handle.getValueState("due", "ms long")

    def late(self, key: int, rows: list[tuple[str, Row]]) -> list[tuple]:
        raise NotImplementedError

    def release(self, ready: dict[int, Rows], passed: int) -> tuple[list[tuple], int | None]:
        """Rows for the output from those of each key whose time has come, and when something else than a waiting row
        needs looking at, in milliseconds."""
        raise NotImplementedError

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.columns)

    def _wake(self, ms: int) -> None:
        """One timer per bucket, at the earliest time it is needed. A timer goes off when the watermark is beyond it."""
        due = self.due.get()
        if due is None or ms - 1 < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(ms - 1)
            self.due.update((ms - 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        late: dict[int, dict[str, Row]] = {}
        waiting = []
        for frame in rows:
            if key[0] < 0:
                continue
            for owner, form, *row in zip(*(frame[n].tolist() for n in ROW)):
                if row[0] // 1000 <= passed:
                    forms, row = late.setdefault(owner, {}), tuple(row)
                    forms[form] = min(row, forms.get(form, row))
                else:
                    waiting.append((owner, form, *row))
        if waiting:
            self.pending.appendList(waiting)
            self._wake(min(row[2] for row in waiting) // 1000)
        yield from self._frame([out for owner, forms in late.items() for out in self.late(owner, list(forms.items()))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        least: dict[tuple[int, str], Row] = {}
        for owner, form, *row in self.pending.get():
            row = tuple(row)
            least[owner, form] = min(row, least.get((owner, form), row))
        ready: dict[int, Rows] = {}
        waiting = []
        for (owner, form), row in least.items():
            if row[0] // 1000 <= passed:
                ready.setdefault(owner, []).append((row, form))
            else:
                waiting.append((owner, form, *row))
        if waiting:
            self.pending.put(waiting)
        else:
            self.pending.clear()
        out, until = self.release({owner: sorted(rows) for owner, rows in ready.items()}, passed)
        times = [row[2] // 1000 for row in waiting] + ([] if until is None else [until])
        if times:
            self._wake(min(times))
        yield from self._frame(out)

    def close(self) -> None:
        pass


class FirstForms(InOrder):
    """The first good form of a ride; the others are refused. A ride is forgotten ``keep_ms`` after its first form."""

    columns = ["ride_id", "kind", "form", "reason", "payload"]
    schema = "ride_id long, kind string, form string, reason string, payload string"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.done = handle.getListState("done", "ride_id long, ms long")

    def late(self, key, rows):
        return [(key, "late", form, None, row[3]) for form, row in rows]

    def release(self, ready, passed):
        done = dict(self.done.get())
        known, out = len(done), []
        for ride, rows in ready.items():
            for (at, _, error, payload), form in rows:
                if error:
                    out.append((ride, "rejected", form, error, payload))
                elif ride in done:
                    out.append((ride, "rejected", form, "repeated_form", payload))
                else:
                    done[ride] = at // 1000
                    out.append((ride, "rated", form, None, payload))
        kept = [(ride, ms) for ride, ms in done.items() if ms + self.keep_ms > passed]
        if kept and (len(done) > known or len(kept) < len(done)):
            self.done.put(kept)
        elif known and not kept:
            self.done.clear()
        return out, min(ms for _, ms in kept) + self.keep_ms if kept else None


class Ratings(InOrder):
    """Running mean of a user's ratings, with an alert for every rating that takes it below the limit."""

    columns = ["rated_user_id", "kind", "rating_id", "score", "rated_at_us", "score_sum", "n", "mean_cents"]
    schema = ("rated_user_id long, kind string, rating_id long, score long, rated_at_us long, score_sum long, n long, "
              "mean_cents long")

    def __init__(self, limit_cents: int):
        self.limit_cents = limit_cents

    def init(self, handle) -> None:
        super().init(handle)
        self.total = handle.getMapState("total", "user long", "score_sum long, n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for user, score_sum, n in zip(*(initialState[c].tolist() for c in ("key", "score_sum", "n"))):
            before = self.total.getValue((user,)) or (0, 0)
            self.total.updateValue((user,), (before[0] + score_sum, before[1] + n))

    @staticmethod
    def mean_cents(score_sum: int, n: int) -> int:
        """The mean in hundredths, rounded half up."""
        return (200 * score_sum + n) // (2 * n)

    def late(self, key, rows):
        return [(key, "late", row[1], int(row[3]), row[0], 0, 0, 0) for _, row in rows]

    def release(self, ready, passed):
        out = []
        for user, rows in ready.items():
            score_sum, n = self.total.getValue((user,)) or (0, 0)
            for (at, rating_id, _, payload), _ in rows:
                was_low = n > 0 and self.mean_cents(score_sum, n) < self.limit_cents
                score_sum, n = score_sum + int(payload), n + 1
                mean = self.mean_cents(score_sum, n)
                if mean < self.limit_cents and not was_low:
                    out.append((user, "alert", rating_id, int(payload), at, score_sum, n, mean))
            self.total.updateValue((user,), (score_sum, n))
            out.append((user, "total", rating_id, int(payload), at, score_sum, n, mean))
        return out, None
