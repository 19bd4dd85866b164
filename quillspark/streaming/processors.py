"""Stateful processors for ``transformWithStateInPandas``, safe against late rows.

Input rows carry ``t`` (BIGINT event-time micros) and an event id. Rows are not applied as they come:
they wait in map state by event time, and an event-time timer hands them to the rule in order as soon
as the watermark has passed them. What comes late, but not later than the watermark, thus changes the
result exactly as in the batch operators. Waiting rows lie in chunks of bounded size, of which
only those that overlap in time are open at once, so no frame or list holds a key's backlog.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

CHUNK_ROWS = 1024   # rows of one state value
FRAME_ROWS = 4096   # rows of one output frame


class _Value:
    """Value state with a default for the first access."""

    def __init__(self, handle, name: str, schema: str, default: tuple):
        self.state, self.default = handle.getValueState(name, schema), default

    def get(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else self.default

    def set(self, *values) -> None:
        self.state.update(tuple(values))


def _plain(values: pd.Series) -> list:
    """Python values of a column, None for nulls."""
    return values.astype(object).where(values.notna(), None).tolist()


class Ordered(StatefulProcessor):
    """Base of the rules: ``step`` gets the rows of a key in the order of ``rank``.

    ``fields`` are the columns handed on beside t and event_id, ``own`` the schema and first value of
    the rule's own numbers. ``settle`` is called when nothing up to the watermark can come any more, and
    ``due`` names the next moment at which the rule itself wants that.
    """

    output = ""
    fields: tuple[str, ...] = ()
    own: tuple[str, tuple] = ("n long", (None,))

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "t long, part long", "rows string")
        self.meta = _Value(handle, "meta", "timer long, parts long", (None, 0))
        self.kept = _Value(handle, "kept", *self.own)

    # The rule ----------------------------------------------------------------------------

    def rank(self, row: list) -> tuple:
        """What rows are ordered by, the time first."""
        return row[0], row[1]

    def arrive(self, key: tuple, rows: list[list]) -> Iterable[tuple]:
        """Output that does not depend on the order: for rows as they come."""
        return ()

    def step(self, key: tuple, row: list) -> Iterable[tuple]:
        """Output of one row; the rule's numbers are in ``self.now``."""
        raise NotImplementedError

    def settle(self, key: tuple, until: int) -> Iterable[tuple]:
        return ()

    def due(self) -> int | None:
        return None

    def load(self) -> None:
        self.now = self.kept.get()

    def save(self) -> None:
        self.kept.set(*self.now)

    # Order -------------------------------------------------------------------------------

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names, types = zip(*(part.split() for part in self.output.split(", ")))
        frame = pd.DataFrame(rows, columns=list(names))
        return frame.astype({n: "Int64" for n, kind in zip(names, types) if kind == "bigint"})

    def _hold(self, rows: list[list], parts: int) -> int:
        for at in range(0, len(rows), CHUNK_ROWS):
            piece = rows[at:at + CHUNK_ROWS]
            self.rows.updateValue((piece[0][0], parts), (json.dumps(piece),))
            parts += 1
        return parts

    def _wake(self, timer: int | None, parts: int, *moments: int | None) -> None:
        """One timer per key, at the first of the moments; timers count milliseconds."""
        wanted = min((-(-m // 1000) for m in moments if m is not None), default=None)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.meta.set(wanted, parts)

    def handleInputRows(self, key, rows, timerValues):
        timer, parts = self.meta.get()
        first = None if timer is None else timer * 1000
        for pdf in rows:
            columns = [_plain(pdf[c]) for c in ("t", "event_id", *self.fields)]
            piece = sorted(map(list, zip(*columns)), key=self.rank)
            if not piece:
                continue
            first = piece[0][0] if first is None else min(first, piece[0][0])
            parts = self._hold(piece, parts)
            out = list(self.arrive(key, piece))
            if out:
                yield self._frame(out)
        self._wake(timer, parts, first)

    def _released(self, until: int, parts: int) -> Iterator[list]:
        """Waiting rows up to ``until`` in order, merged from the chunks. A chunk is opened when its
        first row is due; its rows after ``until`` go back to wait."""
        waiting = sorted(k for k in map(tuple, self.rows.keys()) if k[0] <= until)
        open_rows: list[tuple[list, int, Iterator[list]]] = []
        self.parts = parts
        at = 0
        while at < len(waiting) or open_rows:
            while at < len(waiting) and (not open_rows or waiting[at][0] <= open_rows[0][0][0]):
                rows = json.loads(self.rows.getValue(waiting[at])[0])
                self.rows.removeKey(waiting[at])
                self.parts = self._hold([r for r in rows if r[0] > until], self.parts)
                ready = iter([r for r in rows if r[0] <= until])
                row = next(ready)
                heapq.heappush(open_rows, (self.rank(row), at, row, ready))
                at += 1
            _, number, row, ready = open_rows[0]
            following = next(ready, None)
            if following is None:
                heapq.heappop(open_rows)
            else:
                heapq.heapreplace(open_rows, (self.rank(following), number, following, ready))
            yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        timer, parts = self.meta.get()
        self.load()
        out: list[tuple] = []
        for row in self._released(until, parts):
            out.extend(self.step(key, row))
            if len(out) >= FRAME_ROWS:
                yield self._frame(out)
                out = []
        out.extend(self.settle(key, until))
        self.save()
        pending = min((k[0] for k in self.rows.keys()), default=None)
        # The timer that has fired is gone.
        self._wake(None, self.parts, pending, self.due())
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


class Debounce(Ordered):
    """Events at least ``gap_us`` after the last accepted one."""

    output = "user_id bigint, t bigint, event_id bigint"
    own = ("t long", (None,))

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def step(self, key, row):
        if self.now[0] is None or row[0] - self.now[0] >= self.gap_us:
            self.now = (row[0],)
            yield key[0], row[0], row[1]


class Toggle(Debounce):
    """Accepted presses alternate start and stop."""

    output = "user_id bigint, t bigint, event_id bigint, action string"
    own = ("t long, active boolean", (None, False))

    def step(self, key, row):
        last, active = self.now
        if last is None or row[0] - last >= self.gap_us:
            self.now = row[0], not active
            yield key[0], row[0], row[1], "stop" if active else "start"


class HoldPairs(Ordered):
    """Press/release edges to intervals; a release counts only while active."""

    output = "user_id bigint, event_id bigint, start_us bigint, end_us bigint"
    fields = ("edge",)
    own = ("active boolean, start long, press long, release long", (False, None, None, None))

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def step(self, key, row):
        t, event_id, edge = row
        active, start, press, release = self.now
        if edge == "press":
            active = True
            if press is None or t - press >= self.gap_us:
                press = start = t
        elif active:
            active = False
            if release is None or t - release >= self.gap_us:
                release = t
                yield key[0], event_id, start, t
                start = None
        self.now = active, start, press, release


class AutoReset(Ordered):
    """States as they arrive, plus an ``idle`` row where ``done`` is not followed in time.

    States are passed on at once; whether a state came before the due moment is decided in order.
    """

    output = "user_id bigint, event_id bigint, state string, at_us bigint"
    fields = ("state",)
    own = ("due long, event_id long", (None, None))

    def __init__(self, reset_us: int, done: str = "done"):
        self.reset_us, self.done = reset_us, done

    def arrive(self, key, rows):
        return [(key[0], event_id, state, t) for t, event_id, state in rows]

    def settle(self, key, until):
        due, event_id = self.now
        if due is not None and due <= until:
            self.now = None, None
            yield key[0], event_id, "idle", due

    def step(self, key, row):
        t, event_id, state = row
        yield from self.settle(key, t - 1)
        self.now = (t + self.reset_us, event_id) if state == self.done else (None, None)

    def due(self):
        return self.now[0]


class Review(Ordered):
    """Transcripts and decisions of a key to final pairs, each transcript once.

    A transcript waits for the first decision within ``timeout_us``; none means accept, ``skip`` drops it,
    a corrected text replaces the cleaned one unless it is blank. Only undecided transcripts are kept.
    """

    output = "user_id bigint, event_id bigint, input string, output string, decision string"
    fields = ("side", "raw", "cleaned", "decision", "edited")

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "rows string")

    def rank(self, row):
        # A decision at the very moment of a transcript is one on it.
        return row[0], row[2], row[1]

    def load(self) -> None:
        """Undecided transcripts (t, event id, raw, cleaned), oldest first."""
        held = self.open.get() if self.open.exists() else ()
        self.now = [row for (rows,) in held for row in json.loads(rows)]

    def save(self) -> None:
        if self.now:
            self.open.put([(json.dumps(self.now[i:i + CHUNK_ROWS]),) for i in range(0, len(self.now), CHUNK_ROWS)])
        elif self.open.exists():
            self.open.clear()

    def settle(self, key, until):
        late = 0
        for t, event_id, raw, cleaned in self.now:
            if t + self.timeout_us > until:
                break
            late += 1
            yield key[0], event_id, raw, cleaned, "accept"
        del self.now[:late]

    def step(self, key, row):
        t, event_id, side, raw, cleaned, decision, edited = row
        yield from self.settle(key, t - 1)
        if side == 0:
            self.now.append([t, event_id, raw, cleaned])
            return
        decision = decision or "accept"
        text = (edited or "").strip()
        if decision != "skip":
            for _, number, raw, cleaned in self.now:
                yield key[0], number, raw, text if decision == "correct" and text else cleaned, decision
        self.now.clear()

    def due(self):
        return self.now[0][0] + self.timeout_us if self.now else None


class BoundedHistory(StatefulProcessor):
    """Newest ``n`` entries per key in list state; every update emits the whole history.

    The order of arrival does not matter, so nothing waits: each frame is cut to its newest n entries.
    """

    output = "user_id bigint, event_id bigint, t bigint"

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.entries = handle.getListState("entries", "t long, event_id long")

    def handleInputRows(self, key, rows, timerValues):
        kept = [tuple(e) for e in self.entries.get()] if self.entries.exists() else []
        for pdf in rows:
            kept = sorted(kept + list(zip(pdf["t"].tolist(), pdf["event_id"].tolist())))[-self.n:]
        self.entries.put(kept)
        yield pd.DataFrame([(key[0], e, t) for t, e in kept],
                           columns=["user_id", "event_id", "t"])

    def close(self) -> None:
        pass


class Quota(StatefulProcessor):
    """The first ``k`` distinct sentences of a key: batch by batch, by ``ord`` inside a batch.

    State is a counter and the sentences taken, ``k`` at most. A full key reads no sentence and emits
    nothing any more. Of a batch no more candidates are held than twice what is still open.
    """

    output = "grp string, ord bigint, sentence string"

    def __init__(self, k: int):
        self.k = k

    def init(self, handle) -> None:
        self.count = _Value(handle, "count", "n long", (0,))
        self.taken = handle.getListState("taken", "sentence string")

    def handleInputRows(self, key, rows, timerValues):
        room = self.k - self.count.get()[0]
        if room <= 0:
            for _ in rows:
                pass
            return
        taken = {sentence for (sentence,) in self.taken.get()}
        best: dict[str, int] = {}
        for frame in rows:
            for at, sentence in zip(frame["ord"].tolist(), frame["sentence"].tolist()):
                if sentence not in taken and at < best.get(sentence, at + 1):
                    best[sentence] = at
                    if len(best) > 2 * room:
                        best = self._first(best, room)
        fresh = self._first(best, room)
        if fresh:
            self.taken.appendList([(sentence,) for sentence in fresh])
            self.count.set(self.k - room + len(fresh))
            yield pd.DataFrame({"grp": key[0], "ord": list(fresh.values()), "sentence": list(fresh)})

    @staticmethod
    def _first(best: dict[str, int], room: int) -> dict[str, int]:
        return dict(heapq.nsmallest(room, best.items(), key=lambda kv: (kv[1], kv[0])))
