"""Correlation of logs to fibers.

Per type one of two plans. *Chains* (one key attribute at most): a fiber ends where a release, a close or the gap on the
logical clock says so. For session and infinite gaps each of these is a comparison with the log before it of the same
key, so windows over the key suffice; a gap from the start jumps from start to start through the sorted logs of a key.
*Islands* (everything else): a key with a value is a token, and a release or close ends its incarnation; logs that share
incarnations, however indirectly, form an island, and a stretch in which the clock passes the gap closes everything, so
an island is cut there. Islands are spread over the cluster and run through the ordered fold, one after another, sorted
by Spark. In chains fiber records, values and conflicts are aggregations and windows; for islands the fold tells them, as a
merge lets the value of the fiber with the later activity stay.

Fibers that are open when the input ends can be carried on (``Correlation.state``): as rows of their own, with the keys
they still hold, they come before the logs that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import typed
from ..plans.components import connected_components
from ..plans.fold import Events, Island
from ..plans.rules import FiberType, Rules
from ..plans.storage import stage
from .extract import cast_attributes, extract, key_tokens, match_types, matched
from .ordering import BLOCK, neighbour, running, running_max

#: Column of the log order and of the clock before each log.
SEQ, CLOCK = "seq", "prev_clock"


PARTS = ("fibers", "memberships", "merges", "conflicts", "state", "survivors")
#: A fiber that is open: what :func:`correlate_type` needs to go on with it.
STATE = (
    "fiber_type string, ruleset_version string, fiber_id string, first_seq long, first_log_id string, keys map<string,string>,"
    " attributes map<string,string>, value_seq map<string,long>, first_activity timestamp, last_activity timestamp, n_logs long"
)


@dataclass
class Correlation:
    """``fibers``; ``memberships``; ``merges``; ``conflicts`` of attribute values; ``state``: the fibers still open, as
    STATE; ``survivors``: of each fiber merged away, the one that it is part of in the end."""

    fibers: DataFrame
    memberships: DataFrame
    merges: DataFrame
    conflicts: DataFrame
    state: DataFrame
    survivors: DataFrame

    def stats(self) -> DataFrame:
        f = self.fibers.agg(F.count(F.lit(1)).alias("fibers_created"))
        m = self.memberships.agg(F.count(F.lit(1)).alias("memberships_written"), F.countDistinct("log_id").alias("logs_processed"))
        return f.crossJoin(m)  # one row each


def is_chain(t: FiberType) -> bool:
    return len(t.keys) <= 1


def is_constant(t: FiberType) -> bool:
    """A type whose one key is the same for every log, with an infinite gap and no release or close: a source type."""
    key = next((a for a in t.attributes if a.key), None)
    quiet = all(not (p.close or p.release_peer or p.release_self) for ps in t.sources.values() for p in ps)
    return bool(key and key.derived is not None and not key.inputs and t.gap is None and quiet)


def _rows(logs: DataFrame, t: FiberType, normalize_keys: bool, state: DataFrame | None, found: DataFrame | None = None) -> DataFrame:
    """Logs of the type and, before them, its open fibers: key values ``kv``, typed ``values``, and for each of these the
    place it was set at (``at``); ``n`` logs since ``born``."""
    if CLOCK not in logs.columns:
        if t.gap is not None:
            raise ValueError(f"{t.name}: a gap needs {CLOCK}")
        logs = logs.withColumn(CLOCK, F.lit(None).cast("timestamp"))
    rows = cast_attributes(extract(logs, t) if found is None else matched(found, t), t)
    kinds = {a.name: a.type for a in t.attributes}

    def key(k: str) -> Column:
        raw = F.col(f"attrs.{k}")
        return F.coalesce(typed(raw, kinds[k]).cast("string"), raw) if normalize_keys else raw

    kv = F.struct(*[key(k).alias(k) for k in t.keys] or [F.lit(None).cast("string").alias("_")])
    at = F.struct(*[F.when(F.col(f"values.{n}").isNotNull(), F.col(SEQ)).alias(n) for n in kinds])
    carried = [SEQ, "log_id", "ts", CLOCK, kv.alias("kv"), "values", at.alias("at"), "release_peer", "release_self", "close"]
    rows = rows.select(*carried, F.lit(1).cast("long").alias("n"), F.col("ts").alias("born"), F.lit(False).alias("open"))
    if state is None:
        return rows
    mine = state.filter(F.col("fiber_type") == t.name)
    kv = F.struct(*[F.col("keys")[k].alias(k) for k in t.keys] or [F.lit(None).cast("string").alias("_")])
    values = F.struct(*[typed(F.col("attributes")[n], kind).alias(n) for n, kind in kinds.items()])
    at = F.struct(*[F.col("value_seq")[n].alias(n) for n in kinds])
    none = F.array().cast("array<string>")
    seeds = mine.select(
        F.col("first_seq").alias(SEQ), F.col("first_log_id").cast(logs.schema["log_id"].dataType).alias("log_id"), F.col("last_activity").alias("ts"), F.lit(None).cast("timestamp").alias(CLOCK),
        kv.alias("kv"), values.alias("values"), at.alias("at"), none.alias("release_peer"), none.alias("release_self"), F.lit(False).alias("close"),
        F.col("n_logs").alias("n"), F.col("first_activity").alias("born"), F.lit(True).alias("open"),
    )
    return rows.unionByName(seeds)


def _flags(rows: DataFrame, t: FiberType) -> DataFrame:
    """Key value ``k``, and whether its fiber ends before (``cut_before``) or after (``cut_after``) the log."""
    key = t.keys[0] if t.keys else None
    rows = rows.withColumn("k", F.col(f"kv.{key}") if key else F.lit(None).cast("string"))
    derived = key and next(a for a in t.attributes if a.name == key).derived is not None
    peer = F.array_contains("release_peer", key) if key and not derived else F.lit(False)
    own = F.array_contains("release_self", key) if key else F.lit(False)
    return rows.withColumns({"cut_before": peer, "cut_after": own | F.col("close")})


def _starts_by_gap(keyed: DataFrame, gap: int) -> DataFrame:
    """``seq, first_seq, first_log`` where the gap counts from a fiber's start: within what releases and closes leave
    together, from start to start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_seq, first_log, limit, forced = None, 0, None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, logs = batch.column(0), batch.column(2).to_pylist()
            seq, born, clock, before, after = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4, 5, 6))
            keys = keys.dictionary_encode()
            codes, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            cut = before | np.r_[forced, after[:-1]]
            cut[1:] |= codes[1:] != codes[:-1]
            cut[0] |= names[codes[0]] != key
            edges = np.flatnonzero(cut)
            ends = np.r_[edges, len(seq)]
            firsts, first_logs = np.empty(len(seq), np.int64), [None] * len(seq)
            at = 0
            for end in ends:
                while at < end:
                    if not cut[at] and clock[at] <= limit:
                        stop = at + int(np.searchsorted(clock[at:end], limit, side="right"))
                    else:
                        first_seq, first_log, limit = int(seq[at]), logs[at], int(born[at]) + gap
                        cut[at] = False
                        stop = at + 1 + int(np.searchsorted(clock[at + 1 : end], limit, side="right"))
                    firsts[at:stop] = first_seq
                    first_logs[at:stop] = [first_log] * (stop - at)
                    at = stop
            key, forced = names[codes[-1]], bool(after[-1])
            yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(firsts), pa.array(first_logs, batch.column(2).type)], ["seq", "first_seq", "first_log"])

    least = F.lit(-(1 << 62))
    small = keyed.select("k", SEQ, "log_id", F.unix_micros("born"), F.coalesce(F.unix_micros(CLOCK), least), "cut_before", "cut_after")
    return small.repartition("k").sortWithinPartitions("k", SEQ).mapInArrow(run, f"seq long, first_seq long, first_log {keyed.schema['log_id'].dataType.simpleString()}")


def _chains(rows: DataFrame, t: FiberType, event_clock: bool) -> DataFrame:
    """The rows with ``owner`` and ``owner_log``, their fiber's first log, and ``k, cut_after``."""
    rows = _flags(rows, t)
    lone = rows.filter("k IS NULL").withColumns({"owner": F.col(SEQ), "owner_log": F.col("log_id")})
    keyed = rows.filter("k IS NOT NULL")
    if is_constant(t):
        first = keyed.agg(F.min_by(F.struct(SEQ, "log_id"), SEQ).alias("first"))
        keyed = keyed.crossJoin(F.broadcast(first))  # one row
    elif t.gap is not None and t.gap_mode == "from_start":
        clock = F.when(~F.col("open"), F.col("ts") if event_clock else F.col(CLOCK))
        keyed = keyed.withColumn(CLOCK, clock)
        found = _starts_by_gap(keyed, t.gap).select(F.col("seq").alias("__seq"), F.struct(F.col("first_seq").alias(SEQ), F.col("first_log").alias("log_id")).alias("first"))
        keyed = keyed.join(found, F.col(SEQ) == F.col("__seq")).drop("__seq")
    else:
        w = Window.partitionBy("k").orderBy(SEQ)
        start = F.col("cut_before") | F.coalesce(F.lag("cut_after").over(w), F.lit(True))
        if t.gap is not None:
            now = F.col("ts") if event_clock else F.col(CLOCK)
            start = start | F.coalesce(F.unix_micros(now) - F.unix_micros(F.lag("ts").over(w)) > t.gap, F.lit(False))
        keyed = keyed.withColumn("start", start)
        keyed = keyed.withColumn("first", F.max(F.when(F.col("start"), F.struct(SEQ, "log_id"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("start")
    keyed = keyed.withColumns({"owner": F.col(f"first.{SEQ}"), "owner_log": F.col("first.log_id")}).drop("first")
    return keyed.unionByName(lone)


def _cuts(t: FiberType) -> bool:
    """Whether logs may end what a key stands for: releases and closes, or a gap from the start."""
    ends = any(p.close or p.release_peer or p.release_self for ps in t.sources.values() for p in ps)
    return ends or (t.gap is not None and t.gap_mode == "from_start")


def _incarnations(rows: DataFrame, t: FiberType) -> DataFrame:
    """A row for each key of a log: ``key, value``, the incarnation ``inc``, and ``freed``: a peer release that comes before
    the log frees the incarnation before.

    A key with one value stands for something new from a peer release on, after a self release or a close, and (gap from
    the start) once the clock has passed the gap since the log before, as the fiber began no later. Incarnations are
    numbered over all logs, not within islands, so that what one island ends is ended for every other.
    """
    plain = {a.name for a in t.attributes if a.derived is None}
    tokens = F.array(*[
        F.struct(
            F.lit(k).alias("key"), F.col(f"kv.{k}").alias("value"),
            (F.array_contains("release_peer", k) if k in plain else F.lit(False)).alias("peer"),
            (F.array_contains("release_self", k) | F.col("close")).alias("ends"),
        ) for k in t.keys
    ])
    since = F.when(F.col("open"), F.col("born")).otherwise(F.col("ts"))
    each = rows.select(SEQ, CLOCK, since.alias("since"), F.inline(F.filter(tokens, lambda x: x["value"].isNotNull())))
    keys, block = ["key", "value"], F.floor(F.col(SEQ) / BLOCK)
    each = neighbour(each, keys, block, [SEQ], F.struct("ends", "since"), "before")
    cut = F.col("peer") | F.coalesce("before.ends", F.lit(False))
    if t.gap is not None and t.gap_mode == "from_start":
        cut = cut | F.coalesce(F.unix_micros(CLOCK) - F.unix_micros("before.since") > t.gap, F.lit(False))
    each = running(each, keys, block, [SEQ], cut.cast("long"), "inc")
    return each.select(SEQ, "key", "value", "inc", (F.col("peer") & F.col("before").isNotNull()).alias("freed"))


TOKEN = "struct<key:string,value:string,inc:bigint>"


def _id(t: FiberType, token: Column) -> Column:
    """A number of a token, smaller ones for the first keys. Tokens that should share one only share an island, in which the
    fold tells them apart."""
    nth = F.array_position(F.array(*[F.lit(k) for k in t.keys]), token["key"])
    return F.shiftleft(nth, 56) + F.shiftrightunsigned(F.xxhash64(token["key"], token["value"], token["inc"]), 8)


def _islands(rows: DataFrame, t: FiberType) -> DataFrame:
    """Adds ``tokens``, ``island`` and ``part``: logs linked by incarnations of keys (``island``), cut where the clock passes
    the gap between neighbours (``part``). A peer release is a row of its own besides (``gone``), in the island that knew the
    key before."""
    freed = None
    if _cuts(t):
        each = stage(_incarnations(rows, t), "incarnations")
        lists = each.groupBy(F.col(SEQ).alias("__seq")).agg(F.sort_array(F.collect_list(F.struct("key", "value", "inc"))).alias("tokens"))
        rows = rows.join(lists, F.col(SEQ) == F.col("__seq"), "left").drop("__seq")
        freed = each.filter("freed").select(SEQ, F.struct("key", "value", (F.col("inc") - 1).alias("inc")).alias("gone"))
    else:
        tokens = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"kv.{k}").alias("value"), F.lit(0).cast("long").alias("inc")) for k in t.keys])
        rows = rows.withColumn("tokens", F.filter(tokens, lambda x: x["value"].isNotNull()))
    rows = rows.withColumns({"tokens": F.coalesce("tokens", F.array().cast(f"array<{TOKEN}>")), "gone": F.lit(None).cast(TOKEN)})
    if freed is not None:
        rows = rows.unionByName(freed, allowMissingColumns=True)
    ids = F.transform("tokens", lambda x: _id(t, x))
    links = rows.filter(F.size("tokens") > 1).select(ids.alias("ids")).select(F.array_min("ids").alias("a"), F.explode("ids").alias("b"))
    labels = connected_components(links)
    token = F.when(F.col("gone").isNotNull(), _id(t, F.col("gone"))).when(F.size("tokens") > 0, _id(t, F.get("tokens", F.lit(0))))
    joined = rows.withColumn("t0", token).join(labels, F.col("t0") == F.col("id"), "left")
    joined = joined.withColumn("island", F.coalesce("component", "t0", -1 - F.col(SEQ))).drop("id", "component", "t0")
    if t.gap is None:
        return joined.withColumn("part", F.lit(0).cast("long"))
    block, order = F.floor(F.col(SEQ) / BLOCK), [SEQ, F.col("gone").isNull()]
    # open fibers are not in order of their last activity
    joined = running(joined, ["island"], block, order, F.col("ts"), "last", F.max, current=False)
    quiet = F.unix_micros(CLOCK) - F.unix_micros("last") > t.gap
    return running(joined, ["island"], block, order, F.coalesce(quiet, F.lit(False)).cast("long"), "part").drop("last")


FOLDED = (
    "kind int, seq long, fiber long, fiber_log string, other long, other_log string, log string, name string, old string, new string, open boolean,"
    " low long, high long, n long, closed boolean, told array<string>, places array<long>, held array<string>"
)
#: Rows of one kind that a task hands on at once.
EVENTS = 20_000


def _told(events: Events, names: list[str], plain: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    """kind 1: merge (fiber: loser, other: survivor); 2: fiber merged away and its last survivor; 3: conflict (fiber: that of
    the log, other: 1 at a merge); 4: fiber that is not merged away, with its logs' times and number, its values, where they
    were set, and the keys that an open one holds."""
    yield from _rows_of(1, [(s, x.first_seq, x.first_log, f.first_seq, f.first_log, log) for s, log, x, f in events.merged], "seq fiber fiber_log other other_log log")
    yield from _rows_of(3, [(s, f.first_seq, f.first_log, int(merged), names[i], old, new) for s, i, old, new, merged, f in events.conflicts], "seq fiber fiber_log other name old new")
    for at in range(0, len(events.told), EVENTS):
        part = events.told[at : at + EVENTS]
        yield from _rows_of(2, [(seq, log, f.first_seq, f.first_log) for f in part for seq, log in f.merged_away()], "fiber fiber_log other other_log")
        held = ([None if k is None else plain(k) for k in f.keys] if f.open else None for f in part)
        rows = [(f.first_seq, f.first_log, f.low, f.high, f.n, f.closed, f.values, f.at, h) for f, h in zip(part, held, strict=True)]
        yield from _rows_of(4, rows, "fiber fiber_log low high n closed told places held")
    events.merged, events.conflicts, events.told = [], [], []


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _batch(kind: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {"kind": pa.array(np.full(n, kind, np.int32))} | columns
    fields = [x.split() for x in FOLDED.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c].cast(_KINDS[k]) if c in columns else pa.nulls(n, _KINDS[k]) for c, k in fields], [c for c, _ in fields])


def _rows_of(kind: int, rows: list[tuple], columns: str) -> Iterator[pa.RecordBatch]:
    kinds = dict(x.split() for x in FOLDED.split(", "))
    for at in range(0, len(rows), EVENTS):
        part = rows[at : at + EVENTS]
        yield _batch(kind, len(part), {c: pa.array(v, _KINDS[kinds[c]]) for c, v in zip(columns.split(), zip(*part, strict=True), strict=True)})


def _listed(column: pa.Array) -> list:
    """The values of a flat column, null as None."""
    found = column.to_numpy(zero_copy_only=False) if not column.null_count or pa.types.is_string(column.type) else None
    return column.to_pylist() if found is None else found.tolist()


def _folded(rows: DataFrame, t: FiberType, seeded: bool) -> DataFrame:
    """What the fold tells of the islands, as FOLDED (kind 0: a log or open fiber and its own fiber); a task holds the open
    fibers of one island."""
    gap, from_start, cuts = t.gap, t.gap_mode == "from_start", _cuts(t)
    names, n_keys = [a.name for a in t.attributes], len(t.keys)

    def plain(token: str) -> str:
        return token.rsplit("\1", 1)[0] if cuts else token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, events, island = None, Events(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            col = lambda c: _listed(column[c])  # noqa: B023, E731  called at once
            keys = list(zip(*(col(f"k{i}") for i in range(n_keys)), strict=True))
            values = list(zip(*(col(f"v{i}") for i in range(len(names))), strict=True))
            gone = col("gone_key") if cuts else None
            freed = col("gone_token") if cuts else None
            opened = col("open") if seeded else None
            born, many = (col("born"), col("n")) if seeded else (None, None)
            places = list(zip(*(col(f"p{i}") for i in range(len(names))), strict=True)) if seeded else None
            clocks = col("clock") if gap is not None else repeat(None)
            own = col("own") if cuts else repeat(0)
            close = col("close") if cuts else repeat(False)
            places_of = zip(col("island"), col("part"), strict=True) if gap is not None else col("island")
            for i, (where, seq, log, us, clock, mine, shut) in enumerate(zip(places_of, col("seq"), col("log"), col("us"), clocks, own, close)):  # noqa: B905  some go on for ever
                if where != current:
                    if island is not None:
                        island.end()
                    current, island = where, Island(n_keys, len(names), gap, from_start, events)
                if gone is not None and gone[i] is not None:
                    island.forget(gone[i], freed[i])
                elif opened is not None and opened[i]:
                    island.seed(seq, log, us, born[i], many[i], keys[i], values[i], places[i])
                else:
                    island.step(seq, log, us, clock, keys[i], values[i], mine, shut)
            kept = batch.filter(column["gone_key"].is_null()) if cuts else batch
            if kept.num_rows:
                own_fiber = {"fiber": pa.array([f.first_seq for f in events.joined], pa.int64()), "fiber_log": pa.array([f.first_log for f in events.joined], pa.string())}
                same = {c: kept.column(c) for c in ("seq", "log", "open")} if seeded else {c: kept.column(c) for c in ("seq", "log")} | {"open": pa.array(np.zeros(kept.num_rows, bool))}
                events.joined = []
                yield _batch(0, kept.num_rows, same | own_fiber)
            yield from _told(events, names, plain)
        if island is not None:
            island.end()
            yield from _told(events, names, plain)

    def token(k: str, i: int) -> Column:
        if not cuts:
            return F.col(f"kv.{k}").alias(f"k{i}")
        inc = F.filter("tokens", lambda x: x["key"] == k)[0]["inc"]
        return F.concat(F.col(f"kv.{k}"), F.lit("\1"), inc.cast("string")).alias(f"k{i}")

    columns = [F.col("island"), F.col("part"), F.col(SEQ).alias("seq"), F.col("log_id").cast("string").alias("log"), F.unix_micros("ts").alias("us")]
    columns += [token(k, i) for i, k in enumerate(t.keys)] + [F.col(f"values.{n}").cast("string").alias(f"v{i}") for i, n in enumerate(names)]
    if gap is not None:
        columns.append(F.unix_micros(CLOCK).alias("clock"))
    if cuts:
        bits = [F.when(F.array_contains("release_self", k), 1 << i).otherwise(0) for i, k in enumerate(t.keys)]
        columns += [F.coalesce(reduce(add, bits), F.lit(0)).cast("long").alias("own"), F.coalesce("close", F.lit(False)).alias("close")]
        nth = F.array_position(F.array(*[F.lit(k) for k in t.keys]), F.col("gone.key")) - 1
        columns += [nth.alias("gone_key"), F.concat("gone.value", F.lit("\1"), F.col("gone.inc").cast("string")).alias("gone_token")]
    if seeded:
        columns += [F.coalesce("open", F.lit(False)).alias("open"), F.unix_micros("born").alias("born"), "n", *[F.col(f"at.{n}").alias(f"p{i}") for i, n in enumerate(names)]]
    small, by, first = rows.select(*columns), ["island", "part"], [F.col("gone_key").isNull()] if cuts else []
    return small.repartition(*by).sortWithinPartitions(*by, "seq", *first).mapInArrow(run, FOLDED)


def fiber_id_of(version: str, name: str, log_id: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(version), F.lit(name), log_id.cast("string")), 256)


def _held_in_chains(own: DataFrame, t: FiberType) -> DataFrame:
    """Per fiber (``f``) the keys it holds when the input ends: that of the last fiber of a key, if it was not released."""
    ends = own.groupBy("k", "owner").agg(F.max_by("cut_after", SEQ).alias("cut"))
    last = ends.withColumn("last", F.max("owner").over(Window.partitionBy("k")) == F.col("owner"))
    held = F.col("last") & ~F.col("cut") & F.col("k").isNotNull()
    keys = F.when(held, F.create_map(F.lit(t.keys[0]), F.col("k"))) if t.keys else F.lit(None)
    return last.select(F.col("owner").alias("f"), F.coalesce(keys, F.create_map().cast("map<string,string>")).alias("keys"))


def _conflicts_in_chains(known: DataFrame, names: list[str]) -> DataFrame:
    """Values that a fiber's log changed."""
    items = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(f"values.{n}").cast("string").alias("value"), F.col(f"at.{n}").alias(SEQ)) for n in names])
    items = known.select("fiber_id", F.inline(items)).filter("value IS NOT NULL")
    items = neighbour(items, ["fiber_id", "attribute"], F.floor(F.col(SEQ) / BLOCK), [SEQ], F.col("value"), "old_value")
    changed = items.filter("old_value <> value").withColumnRenamed("value", "new_value")
    return changed.withColumn("at_merge", F.lit(False))


def _map_of(names: list[str], values: str) -> Column:
    """A map of the names to the values of an array column, without null ones."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(values)[i].alias("value")) for i, n in enumerate(names)])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _with_survivors(rows: DataFrame, survivors: DataFrame, kind) -> DataFrame:
    """Adds ``survivor_log``, the first log of the fiber that ``owner`` is part of in the end."""
    last = survivors.select("fiber", F.col("other_log").cast(kind).alias("last_log"))
    rows = rows.join(last, F.col("owner") == F.col("fiber"), "left")
    return rows.withColumn("survivor_log", F.coalesce("last_log", "owner_log")).drop("fiber", "last_log")


def correlate_type(logs: DataFrame, t: FiberType, version: str = "1", flush: bool = True, timeout_clock: str = "sequenced", membership: str = "survivor", end: Column | None = None, normalize_keys: bool = False, state: DataFrame | None = None, found: DataFrame | None = None, named: bool = False) -> Correlation:
    """One type. ``logs``: log_id, ts, source_id, raw_text, seq, prev_clock (which a type without a gap does not need).
    ``end``: the clock at the end of the input.

    ``state``: fibers that were open before the first log (``seq`` goes on from theirs, ``prev_clock`` of the first log is
    the clock they were left at). ``normalize_keys`` compares keys by their typed values. ``found``: what the patterns of
    several types tell of the logs (:func:`match_types`). ``named``: memberships and merges tell the fibers' first logs
    besides, as ``first_log_id``, ``loser_log`` and ``survivor_log``.
    """
    rows = _rows(logs, t, normalize_keys, state, found)
    event = timeout_clock == "event"
    names = [a.name for a in t.attributes]
    if is_chain(t):
        own, folded = _chains(rows, t, event), None
        held = _held_in_chains(own, t)
        known = own.withColumns({"first_seq": F.col("owner"), "survivor_log": F.col("owner_log")})
        known = known.withColumn("fiber_id", fiber_id_of(version, t.name, F.col("survivor_log")))
        aggs = [F.min("born").alias("first_activity"), F.max("ts").alias("last_activity"), F.sum("n").alias("n_logs"), F.max_by("close", SEQ).alias("by_pattern")]
        aggs += [F.max_by(F.col(f"values.{n}"), F.col(f"at.{n}")).alias(f"a_{i}") for i, n in enumerate(names)]
        aggs += [F.max(F.col(f"at.{n}")).alias(f"s_{i}") for i, n in enumerate(names)]
        fibers = known.groupBy("first_seq", "survivor_log").agg(*aggs).withColumn("fiber_id", fiber_id_of(version, t.name, F.col("survivor_log")))
    else:
        rows = stage(rows.withColumn(CLOCK, F.when(~F.col("open"), F.col("ts"))) if event else rows, "rows")
        folded = stage(_folded(_islands(rows, t), t, state is not None), "folded")
        kind = logs.schema["log_id"].dataType
        survivors = folded.filter("kind = 2")
        own = folded.filter("kind = 0").select("seq", F.col("log").cast(kind).alias("log_id"), "open", F.col("fiber").alias("owner"), F.col("fiber_log").cast(kind).alias("owner_log"))
        known = _with_survivors(own, survivors, kind) if membership == "survivor" else own.withColumn("survivor_log", F.col("owner_log"))
        known = known.withColumn("fiber_id", fiber_id_of(version, t.name, F.col("survivor_log")))
        # at merges the value of the fiber with the later activity stays, so the fold tells the values, and all of the record
        last = folded.filter("kind = 4")
        held = last.filter("held IS NOT NULL").select(F.col("fiber").alias("f"), _map_of(t.keys, "held").alias("keys"))
        values = {f"a_{i}": typed(F.col("told")[i], a.type) for i, a in enumerate(t.attributes)} | {f"s_{i}": F.col("places")[i] for i in range(len(names))}
        times = {"first_activity": F.timestamp_micros("low"), "last_activity": F.timestamp_micros("high"), "n_logs": F.col("n"), "by_pattern": F.col("closed")}
        fibers = last.withColumns({"first_seq": F.col("fiber"), "survivor_log": F.col("fiber_log").cast(kind)} | times | values)
        fibers = fibers.select("first_seq", "survivor_log", *times, *values).withColumn("fiber_id", fiber_id_of(version, t.name, F.col("survivor_log")))
    if end is None:
        fibers = fibers.crossJoin(F.broadcast(logs.agg(F.max("ts").alias("end_clock"))))  # one row
    else:
        fibers = fibers.withColumn("end_clock", end)
    reason = F.when(F.col("by_pattern"), "pattern")
    if t.gap is not None:
        ref = F.col("first_activity") if t.gap_mode == "from_start" else F.col("last_activity")
        reason = reason.when(F.unix_micros("end_clock") - F.unix_micros(ref) > t.gap, "timeout")
    fibers = fibers.withColumn("reason", reason)
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"a_{i}").cast("string").alias("value")) for i, n in enumerate(names)])
    attributes = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("attributes")
    places = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"s_{i}").alias("value")) for i, n in enumerate(names)])
    still = fibers.filter("reason IS NULL").join(held, F.col("first_seq") == F.col("f"), "left")
    still = still.select(
        F.lit(t.name).alias("fiber_type"), F.lit(version).alias("ruleset_version"), "fiber_id", "first_seq", F.col("survivor_log").cast("string").alias("first_log_id"),
        F.coalesce("keys", F.create_map().cast("map<string,string>")).alias("keys"), attributes,
        F.map_from_entries(F.filter(places, lambda p: p["value"].isNotNull())).alias("value_seq"), "first_activity", "last_activity", "n_logs",
    )
    reason = F.coalesce("reason", F.lit("flush") if flush else F.lit(None).cast("string"))
    fibers = fibers.select(
        "fiber_id", F.lit(t.name).alias("fiber_type"), F.lit(version).alias("ruleset_version"), attributes,
        F.to_json(F.struct(*[F.col(f"a_{i}").alias(n) for i, n in enumerate(names)])).alias("attributes_json"),
        "first_activity", "last_activity", "n_logs", reason.isNotNull().alias("closed"), reason.alias("close_reason"),
        F.col("survivor_log").alias("first_log_id"),
    )
    first = [F.col("survivor_log").alias("first_log_id")] if named else []
    memberships = known.filter("NOT open").select("log_id", "fiber_id", F.lit(t.name).alias("fiber_type"), F.lit(version).alias("ruleset_version"), *first)
    if folded is None:
        none = memberships.filter(F.lit(False))
        logs_of_both = [F.col("first_log_id").alias(c) for c in ("loser_log", "survivor_log")] if named else []
        merged = none.select("fiber_type", F.col("fiber_id").alias("loser_id"), F.col("fiber_id").alias("survivor_id"), "log_id", *logs_of_both)
        final = merged.select("fiber_type", "loser_id", "survivor_id")
        conflicts = _conflicts_in_chains(known, names)
    else:
        ids = [F.lit(t.name).alias("fiber_type"), fiber_id_of(version, t.name, F.col("fiber_log")).alias("loser_id"), fiber_id_of(version, t.name, F.col("other_log")).alias("survivor_id")]
        logs_of_both = [F.col(a).cast(kind).alias(c) for a, c in (("fiber_log", "loser_log"), ("other_log", "survivor_log"))] if named else []
        merged = folded.filter("kind = 1").select(*ids, F.col("log").cast(kind).alias("log_id"), *logs_of_both)
        final = survivors.select(*ids)
        told = folded.filter("kind = 3").select(SEQ, F.col("name").alias("attribute"), F.col("old").alias("old_value"), F.col("new").alias("new_value"), (F.col("other") == 1).alias("at_merge"), F.col("fiber").alias("owner"), F.col("fiber_log").cast(kind).alias("owner_log"))
        conflicts = _with_survivors(told, survivors, kind).withColumn("fiber_id", fiber_id_of(version, t.name, F.col("survivor_log")))
    conflicts = conflicts.select(F.lit(t.name).alias("fiber_type"), "fiber_id", "attribute", "old_value", "new_value", SEQ, "at_merge")
    return Correlation(fibers, memberships, merged, conflicts, still, final)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlate(logs: DataFrame, rules: Rules, **settings) -> Correlation:
    """All types; a log may be in fibers of several. Settings as in :func:`correlate_type`. The patterns of several types
    are tried in one pass over the logs."""
    if len(rules.types) > 1:
        settings["found"] = stage(match_types(logs, rules), "matched")
        if settings.get("end") is None:
            settings["end"] = F.lit(logs.agg(F.max("ts")).first()[0]).cast("timestamp")
    each = [correlate_type(logs, t, rules.version, **settings) for t in rules.types]
    return Correlation(*(_union([getattr(c, n) for c in each]) for n in PARTS))


def open_fibers(logs: DataFrame, rules: Rules, at: Column | None = None) -> DataFrame:
    """Fibers that are open when the input ends (before ``at``): keys are among the attributes."""
    seen = logs if at is None else logs.filter(F.col("ts") < at)
    return correlate(seen, rules, flush=False).fibers.filter("close_reason IS NULL")


def resume(state: DataFrame, logs: DataFrame, rules: Rules, **settings) -> Correlation:
    """Goes on from the fibers that were open (``Correlation.state``) with the logs that follow.

    ``seq`` and ``prev_clock`` of the logs go on from those of the logs before. Memberships are those of the new logs;
    what earlier logs were in is told by ``survivors`` where a fiber was merged away.
    """
    return correlate(logs, rules, state=state, **settings)


def touched(state: DataFrame, logs: DataFrame, rules: Rules) -> DataFrame:
    """The open fibers that hold a key of one of the logs: no other one joins, merges or loses a key."""
    tokens = _union([key_tokens(extract(logs, t), t).select(F.lit(t.name).alias("fiber_type"), "key", "value") for t in rules.types]).distinct()
    held = state.select("fiber_type", "fiber_id", F.explode("keys").alias("key", "value")).join(tokens, ["fiber_type", "key", "value"], "left_semi")
    return state.join(held.select("fiber_type", "fiber_id").distinct(), ["fiber_type", "fiber_id"], "left_semi")


def timed_out(state: DataFrame, rules: Rules, end: Column) -> DataFrame:
    """Of open fibers those that the clock ``end`` has passed the gap of, as records."""
    parts = []
    for t in rules.types:
        since = F.col("first_activity") if t.gap_mode == "from_start" else F.col("last_activity")
        late = F.unix_micros(end) - F.unix_micros(since) > t.gap if t.gap is not None else F.lit(False)
        rows = state.filter((F.col("fiber_type") == t.name) & late)
        typed_values = F.struct(*[typed(F.col("attributes")[a.name], a.type).alias(a.name) for a in t.attributes])
        parts.append(rows.select("fiber_id", "fiber_type", "ruleset_version", "attributes", F.to_json(typed_values).alias("attributes_json"), "first_activity", "last_activity", "n_logs", F.lit(True).alias("closed"), F.lit("timeout").alias("close_reason"), "first_log_id"))
    return _union(parts)


def last_survivors(survivors: DataFrame) -> DataFrame:
    """``fiber_type, loser_id, survivor_id`` where survivors of one run may be merged away in a later one: the last ones.
    Each turn doubles the steps that are taken."""
    rows, turned = stage(survivors.select("fiber_type", "loser_id", "survivor_id").distinct(), "survivors"), True
    while turned:
        on = rows.select("fiber_type", F.col("loser_id").alias("survivor_id"), F.col("survivor_id").alias("further"))
        rows = stage(rows.join(on, ["fiber_type", "survivor_id"], "left").select("fiber_type", "loser_id", F.coalesce("further", "survivor_id").alias("survivor_id"), F.col("further").isNotNull().alias("turned")), "survivors")
        turned = not rows.filter("turned").isEmpty()
        rows = rows.drop("turned")
    return rows


def correlate_versioned(logs: DataFrame, schedule: list[tuple[str | None, Rules]], **settings) -> Correlation:
    """Rules by time: ``(effective from, rules)``, the first from None. Open fibers are flushed at each cut-over."""
    each = []
    for i, (start, rules) in enumerate(schedule):
        part = logs
        if start is not None:
            part = part.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
        if i + 1 < len(schedule):
            part = part.filter(F.col("ts") < F.lit(schedule[i + 1][0]).cast("timestamp"))
        each.append(correlate(part, replace(rules), **settings))
    return Correlation(*(_union([getattr(c, n) for c in each]) for n in PARTS))


def stamp_versions(logs: DataFrame, versions: DataFrame) -> DataFrame:
    """As-of join: each log's version in force (the latest ``effective_from`` at or before it)."""
    marks = versions.select(F.col("effective_from").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.struct("effective_from", "version").alias("mark"))
    rows = logs.withColumn("mark", F.lit(None).cast("struct<effective_from:timestamp,version:string>"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("arrival", F.unix_micros("ts"))
    both = running_max(both, "mark", "arrival", "in_force", width=3_600_000_000)
    return both.filter(F.col("seq") >= 0).select(*logs.columns, F.col("in_force.version").alias("ruleset_version"))

