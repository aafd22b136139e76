"""Fibers of types with one key, kept in Spark's state store by key, with timeouts on the watermark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import correlate as c
from ..operators.extract import cast_attributes, extract
from ..plans.rules import FiberType

#: A log's membership (``log_id``, without reason) or a fiber that ended (with reason, without ``log_id``).
TOLD = "key string, first_log_id string, log_id string, first_activity timestamp, last_activity timestamp, n_logs long, close_reason string"
_TOLD = TOLD.replace("timestamp", "long")  # times in microseconds
_NAMES = [x.split()[0] for x in _TOLD.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that the keys are dealt to: a call and a write to the state store cost much more than a key's rows.
BUCKETS = 4096


class KeyedFibers:
    """Logs of a key wait in the state until the watermark has passed them, so that they are taken in order whatever
    batches they came in; then they join the fiber that holds the key, or begin one. A fiber whose key was released waits
    for its gap as well.

    The state of a bucket of keys is one value: for each key that has anything open the next moment at which something is
    due, the fiber that holds it, those that were released and the waiting logs. One timeout a bucket stands at the first
    of these moments."""

    def __init__(self, gap: int | None, from_start: bool):
        self.gap, self.from_start = gap, from_start

    def __call__(self, bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = pickle.loads(state.get[0]) if state.exists else {}
        new: dict[str, list[tuple]] = {}
        if not state.hasTimedOut:
            for pdf in rows:
                for key, *log in zip(*(pdf[n].tolist() for n in ("key", "us", "log", "before", "after", "close")), strict=True):
                    new.setdefault(key, []).append(tuple(log))
        ms, out = state.getCurrentWatermarkMs(), []
        for key in [*new, *(k for k, kept in keys.items() if k not in new and kept[0] is not None and kept[0] <= ms * 1000)]:
            _, held, freed, waiting = keys.pop(key, (None, None, [], []))
            kept = self._go_on(key, held, freed, waiting + new.get(key, []), ms * 1000, out)
            if kept is not None:
                keys[key] = kept
        if keys:
            state.update((pickle.dumps(keys),))
        elif state.exists:
            state.remove()
        moments = [kept[0] for kept in keys.values() if kept[0] is not None]
        if moments:  # times out once the watermark has passed it
            state.setTimeoutTimestamp(max(-(-min(moments) // 1000) - 1, ms, 1))
        if out:
            yield pd.DataFrame(out, columns=_NAMES, dtype=object)

    def _go_on(self, key: str, held: tuple | None, freed: list[tuple], waiting: list[tuple], now: int, out: list[tuple]) -> tuple | None:
        """What is kept of a key after the logs until ``now``; ``out`` takes what came of them."""
        waiting.sort()
        due, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]

        def ended(f: tuple, why: str) -> None:
            out.append((key, f[2], None, f[0], f[1], f[3], why))

        for us, log, before, after, close in due:
            if held and self._over(held, us):
                ended(held, "timeout")
                held = None
            if held and before:
                freed.append(held)
                held = None
            first, _, name, n = held or (us, us, log, 0)
            held = (first, us, name, n + 1)
            out.append((key, name, log, None, None, None, None))
            if close:
                ended(held, "pattern")
                held = None
            elif after:
                freed.append(held)
                held = None
        for f in [f for f in freed if self._over(f, now)]:
            ended(f, "timeout")
        freed = [f for f in freed if not self._over(f, now)]
        if held and self._over(held, now):
            ended(held, "timeout")
            held = None
        moments = [r[0] for r in later[:1]]
        if self.gap is not None:
            moments += [self._since(f) + self.gap + 1 for f in (freed + ([held] if held else []))]
        return (min(moments, default=None), held, freed, later) if held or freed or later else None

    def _since(self, f: tuple) -> int:
        return f[0] if self.from_start else f[1]

    def _over(self, f: tuple, now: int) -> bool:
        return self.gap is not None and now - self._since(f) > self.gap


def stream_keyed_fibers(logs: DataFrame, fiber_type: FiberType, delay: str = "1 second") -> DataFrame:
    """Memberships and ended fibers (TOLD) of a type with one key, by the clock of its own logs and the watermark of all
    logs. What a batch writes is the state of the buckets of keys that it or the watermark touches. Logs without the key are left out;
    logs behind the watermark are late. PROVIDER keeps the state on disk."""
    if not c.is_chain(fiber_type) or not fiber_type.keys:
        raise ValueError(f"{fiber_type.name}: not a type with one key")
    rows = cast_attributes(extract(logs.withWatermark("ts", delay), fiber_type), fiber_type)
    key = fiber_type.keys[0]
    derived = next(a for a in fiber_type.attributes if a.name == key).derived is not None
    before = F.lit(False) if derived else F.array_contains("release_peer", key)
    rows = rows.select(
        "ts", F.col(f"attrs.{key}").alias("key"), F.unix_micros("ts").alias("us"), F.col("log_id").cast("string").alias("log"),
        before.alias("before"), F.array_contains("release_self", key).alias("after"), "close",
    )
    found = KeyedFibers(fiber_type.gap, fiber_type.gap_mode == "from_start")
    rows = rows.filter("key IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    told = rows.groupBy("bucket").applyInPandasWithState(found.__call__, _TOLD, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumns({n: F.timestamp_micros(n) for n in ("first_activity", "last_activity")})
