"""The ordered rule fold over one island of logs: what happens to open fibers, log by log.

Keys and attributes are taken by their place in the type, so that a log costs no more than a few lookups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field


class Fiber:
    """An open fiber: the tokens that it holds, its last values and the places that they were set at, and what it has
    taken up: first and last moment, number of logs, whether its last log closed it, fibers merged into it."""

    __slots__ = ("first_seq", "first_log", "first", "last", "keys", "values", "at", "low", "high", "n", "closed", "lost", "open")

    def __init__(self, first_seq: int, first_log: str, first: int, n_keys: int, n_values: int):
        self.first_seq, self.first_log, self.first, self.last = first_seq, first_log, first, first
        self.keys, self.values, self.at = [None] * n_keys, [None] * n_values, [None] * n_values
        self.low, self.high, self.n, self.closed, self.lost, self.open = first, first, 0, False, None, True

    def merged_away(self) -> Iterator[tuple[int, str]]:
        """First place and first log of all fibers that are part of it."""
        left = [self.lost] if self.lost else []
        while left:
            for seq, log, lost in left.pop():
                yield seq, log
                if lost:
                    left.append(lost)


@dataclass
class Events:
    """What came of logs: the fiber of each; merges as (seq, log, loser, survivor); conflicts as (seq, number of the
    attribute, old, new, at a merge, fiber); fibers that ended or are open still."""

    joined: list[Fiber] = field(default_factory=list)
    merged: list[tuple[int, str, Fiber, Fiber]] = field(default_factory=list)
    conflicts: list[tuple[int, int, str, str, bool, Fiber]] = field(default_factory=list)
    told: list[Fiber] = field(default_factory=list)


class Island:
    """Open fibers of one type; what comes of each log is added to ``events``. Times in microseconds."""

    def __init__(self, n_keys: int, n_values: int, gap: int | None, from_start: bool, events: Events):
        self.n_keys, self.n_values, self.gap, self.from_start, self.events = n_keys, n_values, gap, from_start, events
        self.index: list[dict[str, Fiber]] = [{} for _ in range(n_keys)]
        self.due: list[tuple[int, int, Fiber]] = []
        self.alive: dict[int, Fiber] = {}

    def _reference(self, f: Fiber) -> int:
        return f.first if self.from_start else f.last

    def _born(self, f: Fiber) -> Fiber:
        if self.gap is not None:
            heapq.heappush(self.due, (self._reference(f), f.first_seq, f))
        self.alive[f.first_seq] = f
        return f

    def _shut(self, f: Fiber) -> None:
        f.open = False
        del self.alive[f.first_seq]
        for index, token in zip(self.index, f.keys, strict=True):
            if token is not None and index.get(token) is f:
                del index[token]
        self.events.told.append(f)

    def _expire(self, clock: int) -> None:
        while self.due and clock - self.due[0][0] > self.gap:
            at, _, f = heapq.heappop(self.due)
            if not f.open:
                continue
            if self._reference(f) > at:  # it went on meanwhile
                heapq.heappush(self.due, (self._reference(f), f.first_seq, f))
                continue
            self._shut(f)

    def forget(self, key: int, token: str) -> None:
        """A key that a log of any island has freed before it matched."""
        if f := self.index[key].pop(token, None):
            f.keys[key] = None

    def seed(self, seq: int, log: str, ts: int, born: int, n: int, keys: Sequence, values: Sequence, places: Sequence) -> None:
        """A fiber that was open before, with the keys and values it holds; ``ts`` is its last activity."""
        f = Fiber(seq, log, born, self.n_keys, self.n_values)
        f.last, f.high, f.n = ts, ts, n
        self._born(f)
        for i, v in enumerate(values):
            if v is not None:
                f.values[i], f.at[i] = v, seq if places[i] is None else places[i]
        for i, token in enumerate(keys):
            if token is not None:
                self._set(f, i, token)
        self.events.joined.append(f)

    def step(self, seq: int, log: str, ts: int, clock: int | None, keys: Sequence, values: Sequence, own: int, close: bool) -> None:
        """``own``: the keys that the log releases itself, a bit each."""
        if self.gap is not None and clock is not None:
            self._expire(clock)
        f, more = None, None
        for index, token in zip(self.index, keys, strict=True):
            if token is not None and (g := index.get(token)) is not None and g is not f:
                if f is None:
                    f = g
                elif more is None:
                    more = [f, g]
                elif g not in more:
                    more.append(g)
        if f is None:
            f = self._born(Fiber(seq, log, ts, self.n_keys, self.n_values))
        elif more:
            more.sort(key=lambda f: (f.first, f.first_seq))
            f = more[0]
            for loser in more[1:]:
                self._merge(f, loser, seq, log)
        f.last, f.closed = ts, close
        f.n += 1
        if ts > f.high:
            f.high = ts
        if ts < f.low:
            f.low = ts
        held = f.values
        for i, v in enumerate(values):
            if v is not None:
                if (old := held[i]) is not None and old != v:
                    self.events.conflicts.append((seq, i, old, v, False, f))
                held[i], f.at[i] = v, seq
        for i, token in enumerate(keys):
            if token is not None:
                self._set(f, i, token)
        if own:
            for i, token in enumerate(f.keys):
                if own >> i & 1 and token is not None and self.index[i].get(token) is f:
                    del self.index[i][token]
                    f.keys[i] = None
        if close:
            self._shut(f)
        self.events.joined.append(f)

    def _merge(self, f: Fiber, loser: Fiber, seq: int, log: str) -> None:
        """All of ``loser`` goes to ``f``; of values that differ, that of the fiber with the later activity stays."""
        for i, token in enumerate(loser.keys):
            if token is not None:
                self._set(f, i, token)
        for i, theirs in enumerate(loser.values):
            if theirs is None:
                continue
            mine = f.values[i]
            if mine is None:
                f.values[i], f.at[i] = theirs, loser.at[i]
            elif mine != theirs:
                later = loser.last > f.last
                self.events.conflicts.append((seq, i, *((mine, theirs) if later else (theirs, mine)), True, f))
                if later:
                    f.values[i], f.at[i] = theirs, loser.at[i]
        f.last, f.low, f.high, f.n = max(f.last, loser.last), min(f.low, loser.low), max(f.high, loser.high), f.n + loser.n
        if f.lost is None:
            f.lost = []
        f.lost.append((loser.first_seq, loser.first_log, loser.lost))  # its own ones stay a list of theirs, whatever their number
        loser.open, loser.lost = False, None
        del self.alive[loser.first_seq]
        self.events.merged.append((seq, log, loser, f))

    def _set(self, f: Fiber, i: int, token: str) -> None:
        old = f.keys[i]
        if old is not None and old != token and self.index[i].get(old) is f:
            del self.index[i][old]
        f.keys[i] = token
        self.index[i][token] = f

    def end(self) -> None:
        """The fibers that are open still."""
        self.events.told += self.alive.values()
