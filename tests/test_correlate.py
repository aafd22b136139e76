"""The plans against a sequential model written for these tests, cuts in the input, and the cases of single rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.operators import correlate as C
from logweave.operators import ordering as O
from logweave.operators import sinks
from logweave.plans.rules import Attribute, FiberType, Pattern, Rules
from logweave.streaming import streams

KEYS = (Attribute("a", key=True), Attribute("b", key=True))
REGEX = r"a=(?P<a>\w+)?;b=(?P<b>\w+)?;"


def _type(keys=KEYS, regex=REGEX, gap="5s", mode="session"):
    flagged = tuple(
        Pattern(regex + extra, peer, own, close)
        for extra, peer, own, close in (("PEER", (keys[0].name,), (), False), ("SELF", (), (keys[0].name,), False), ("CLOSE", (), (), True), ("", (), (), False))
    )
    return FiberType("t", keys, {"s": flagged}, gap, mode)


def _logs(spark, rows):
    """rows: (seconds, text)."""
    data = [(f"l{i:04d}", "s", text, float(sec)) for i, (sec, text) in enumerate(rows)]
    df = spark.createDataFrame(data, "log_id string, source_id string, raw_text string, sec double")
    df = df.select("log_id", F.timestamp_micros((F.col("sec") * 1_000_000).cast("long")).alias("ts"), "source_id", "raw_text")
    return O.with_prev_clock(O.sequence(df, ["ts", "log_id"]))


def _groups(found):
    by = {}
    for r in found.memberships.collect():
        by.setdefault(r.fiber_id, set()).add(r.log_id)
    return sorted(map(sorted, by.values()))


class Model:
    """All fibers of one type in a plain list, each log looked up by walking over them."""

    def __init__(self, gap, from_start):
        self.gap, self.from_start, self.fibers, self.clock = gap, from_start, [], None

    def log(self, name, at, keys, peer=(), own=(), close=False):
        alive = [f for f in self.fibers if f["end"] is None]
        if self.gap is not None and self.clock is not None:
            for f in alive:
                if self.clock - (f["first"] if self.from_start else f["last"]) > self.gap:
                    f["end"] = "timeout"
        alive = [f for f in alive if f["end"] is None]
        for k in peer:
            for f in alive:
                if k in keys and f["keys"].get(k) == keys[k]:
                    del f["keys"][k]
        hit = [f for f in alive if any(f["keys"].get(k) == v for k, v in keys.items())]
        if hit:
            target = min(hit, key=lambda f: (f["first"], f["nth"]))
            for f in sorted(hit, key=lambda f: (f["first"], f["nth"])):
                if f is not target:
                    target["keys"].update(f["keys"])
                    target["logs"] += f["logs"]
                    f["end"] = "merged"
        else:
            target = {"first": at, "nth": len(self.fibers), "keys": {}, "logs": [], "end": None}
            self.fibers.append(target)
        target["last"] = at
        target["logs"].append(name)
        target["keys"].update(keys)
        for k in own:
            target["keys"].pop(k, None)
        if close:
            target["end"] = "pattern"
        self.clock = at

    def groups(self):
        return sorted(sorted(f["logs"]) for f in self.fibers if f["end"] != "merged")


def _parsed(text, keys):
    parts = dict(p.split("=") for p in text.split(";")[:-1])
    return {k: parts[k] for k in keys if parts.get(k)}, text.split(";")[-1]


def _model(rows, keys, gap, from_start):
    model = Model(gap, from_start)
    for i, (sec, text) in enumerate(rows):
        values, flag = _parsed(text, keys)
        model.log(f"l{i:04d}", int(sec * 1e6), values, keys[:1] * (flag == "PEER"), keys[:1] * (flag == "SELF"), flag == "CLOSE")
    return model.groups()


def _random_rows(rng, two):
    rows, t = [], 0
    for _ in range(120):
        t += rng.choice([0, 1, 1, 2, 7])
        a, b = rng.choice(["", "1", "2", "3"]), rng.choice(["", "x", "y"]) if two else ""
        rows.append((t, f"a={a};b={b};" + rng.choice(["", "", "", "PEER", "SELF", "CLOSE"])))
    return rows


#: Gap, its mode, whether there are two keys.
CASES = [("5s", "session", False), ("infinite", "session", False), ("5s", "from_start", False), ("5s", "session", True), ("infinite", "session", True), ("5s", "from_start", True)]


@pytest.mark.parametrize(("gap", "mode", "two"), CASES)
def test_plans_agree_with_the_model(spark, gap, mode, two):
    keys = KEYS if two else KEYS[:1]
    regex = REGEX if two else r"a=(?P<a>\w+)?;b=;"
    rows = _random_rows(random.Random(f"{mode}{two}{gap}"), two)
    found = C.correlate_type(_logs(spark, rows), _type(keys, regex, gap, mode))
    assert _groups(found) == _model(rows, [k.name for k in keys], 5_000_000 if gap == "5s" else None, mode == "from_start")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, "a=1;b=;"), (6, "a=2;b=;"), (7, "a=1;b=;")], [["l0000"], ["l0001"], ["l0002"]]),  # timeout
        ([(0, "a=1;b=;"), (100, "a=1;b=;")], [["l0000", "l0001"]]),  # nothing ticks the clock in between
        ([(0, "a=1;b=;"), (1, "a=1;b=;PEER")], [["l0000"], ["l0001"]]),
        ([(0, "a=1;b=;"), (1, "a=1;b=;CLOSE"), (2, "a=1;b=;")], [["l0000", "l0001"], ["l0002"]]),
        ([(0, "a=1;b=;"), (1, "a=;b=x;"), (2, "a=1;b=x;")], [["l0000", "l0001", "l0002"]]),  # merge
        ([(0, "a=;b=;"), (1, "a=;b=;")], [["l0000"], ["l0001"]]),  # no key
    ],
)
def test_rules(spark, rows, want):
    assert _groups(C.correlate_type(_logs(spark, rows), _type())) == want


def test_records_merges_conflicts(spark):
    found = C.correlate_type(_logs(spark, [(0, "a=1;b=;"), (1, "a=;b=x;"), (2, "a=1;b=x;"), (3, "a=2;b=x;")]), _type())
    fiber = found.fibers.collect()
    assert len(fiber) == 1 and fiber[0].n_logs == 4 and fiber[0].close_reason == "flush" and fiber[0].attributes == {"a": "2", "b": "x"}
    assert found.merges.count() == 1
    assert [(r.attribute, r.old_value, r.new_value) for r in found.conflicts.collect()] == [("a", "1", "2")]
    written = C.correlate_type(_logs(spark, [(0, "a=1;b=;"), (1, "a=;b=x;"), (2, "a=1;b=x;")]), _type(), membership="as_written")
    assert written.memberships.select("fiber_id").distinct().count() == 2


def test_event_clock_and_versions(spark):
    logs = _logs(spark, [(0, "a=1;b=;"), (100, "a=1;b=;")])
    one_key = _type(KEYS[:1], r"a=(?P<a>\w+)?;b=;")
    assert len(_groups(C.correlate_type(logs, one_key, timeout_clock="event"))) == 2
    both = C.correlate_versioned(logs, [(None, Rules((one_key,), version="1")), ("1970-01-01 00:00:50", Rules((one_key,), version="2"))])
    assert {r.ruleset_version for r in both.fibers.collect()} == {"1", "2"}


def _grouped(pairs):
    by = {}
    for log_id, fiber_id in pairs:
        by.setdefault(fiber_id, set()).add(log_id)
    return sorted(map(sorted, by.values()))


def _by_fiber(found):
    return {r.fiber_id: (r.first_activity, r.last_activity, r.n_logs, r.attributes) for r in found.fibers.collect()}


@pytest.mark.parametrize(("gap", "mode", "two"), [c for c in CASES if c[0] == "5s" or not c[2]])
def test_resumed_is_as_uncut(spark, gap, mode, two):
    """Logs cut at some place: what comes of both parts, with the state carried, is what comes of them at once."""
    keys, regex = (KEYS, REGEX) if two else (KEYS[:1], r"a=(?P<a>\w+)?;b=;")
    cut, rows = 37, _random_rows(random.Random(f"cut{mode}{two}{gap}"), two)
    rules = Rules((_type(keys, regex, gap, mode),))
    logs = _logs(spark, rows)
    whole = C.correlate(logs, rules)
    first = C.correlate(logs.filter(F.col("seq") < cut), rules, flush=False)
    rest = C.resume(first.state.persist(), logs.filter(F.col("seq") >= cut), rules)
    final = {r.loser_id: r.survivor_id for r in rest.survivors.collect()}
    pairs = [(r.log_id, final.get(r.fiber_id, r.fiber_id)) for r in first.memberships.collect()] + [(r.log_id, r.fiber_id) for r in rest.memberships.collect()]
    assert _grouped(pairs) == _groups(whole)
    # fibers that go on are the same to the last value; the others were told by the first part
    known, later = _by_fiber(whole), _by_fiber(rest)
    known_items, told = set(map(repr, known.items())), {**_by_fiber(first), **later}
    assert set(map(repr, later.items())) <= known_items <= set(map(repr, told.items()))


def test_released_keys_stay_released(spark):
    """The key of an open fiber that a self release has freed does not come back when the run goes on."""
    rows = [(0, "a=1;b=;"), (1, "a=1;b=;SELF"), (2, "a=1;b=;")]
    for keys, regex in ((KEYS, REGEX), (KEYS[:1], r"a=(?P<a>\w+)?;b=;")):
        rules, logs = Rules((_type(keys, regex),)), _logs(spark, rows)
        state = C.correlate(logs.filter("seq < 2"), rules, flush=False).state
        assert [(r.n_logs, r["keys"]) for r in state.collect()] == [(2, {})]
        rest = C.resume(state, logs.filter("seq >= 2"), rules)
        assert sorted(r.n_logs for r in rest.fibers.collect()) == [1, 2]


ABC = tuple(Attribute(k, key=True) for k in "abc")


@pytest.mark.parametrize(
    ("gap", "rows", "want"),
    [
        # a cut that another island makes; a dead key that would win a merge (found by random search)
        (3, [(4, 2, "a=0;b=2;c=3;"), (27, 27, "a=0;b=;c=;Sb"), (28, 27, "a=0;b=;c=2;PaSac"), (39, 30, "a=0;b=2;c=3;Sc")], 4),
        (6, [(107, 106, "a=0;b=2;c=2;PaSc"), (112, 107, "a=2;b=;c=1;"), (115, 113, "a=2;b=2;c=;Pa"), (117, 115, "a=;b=2;c=1;"), (131, 122, "a=2;b=0;c=;X")], 1),
    ],
)
def test_three_keys(spark, gap, rows, want):
    """Rows: time, clock before, text with P (peer release), S (self release) of keys, X (close)."""
    base, flags = r"a=(?P<a>\w+)?;b=(?P<b>\w+)?;c=(?P<c>\w+)?;", sorted({r[2].split(";")[-1] for r in rows}, key=len, reverse=True)
    parts = lambda f, x: tuple(f.split(x, 1)[1].split("S" if x == "P" else "P")[0].split("X")[0]) if x in f else ()
    patterns = tuple(Pattern(base + f + "$", parts(f, "P"), parts(f, "S"), "X" in f) for f in flags)
    t = FiberType("t", ABC, {"s": patterns}, f"{gap}s")
    data = [(f"l{i}", i, float(at), float(clock), text) for i, (at, clock, text) in enumerate(rows)]
    logs = spark.createDataFrame(data, "log_id string, seq long, at double, clock double, raw_text string")
    logs = logs.select("log_id", "seq", F.lit("s").alias("source_id"), "raw_text", F.timestamp_seconds("at").alias("ts"), F.timestamp_seconds("clock").alias("prev_clock"))
    assert len(_groups(C.correlate_type(logs, t))) == want


class Valued(Model):
    """The model with values: of a log the last one counts, of fibers that merge that of the one active later."""

    def __init__(self, gap, from_start):
        super().__init__(gap, from_start)
        self.conflicts = []

    def log(self, name, at, keys, peer=(), own=(), close=False, values=None):
        known = len(self.fibers)
        before = [(f, f["last"], dict(f["values"])) for f in self.fibers if f["end"] is None]
        super().log(name, at, keys, peer, own, close)
        for f in self.fibers[known:]:
            f["values"] = {}
        target = next(f for f in self.fibers if name in f["logs"] and f["end"] != "merged")
        last = next((t for f, t, _ in before if f is target), None)
        for f, t, held in sorted((x for x in before if x[0]["end"] == "merged"), key=lambda x: (x[0]["first"], x[0]["nth"])):
            for n, theirs in sorted(held.items()):
                mine = target["values"].get(n, theirs)
                if mine != theirs:
                    self.conflicts.append((name, n, *((mine, theirs) if t > last else (theirs, mine)), True))
                if n not in target["values"] or t > last:
                    target["values"][n] = theirs
            last = max(last, t)
        for n, v in (values or {}).items():
            if target["values"].get(n, v) != v:
                self.conflicts.append((name, n, target["values"][n], v, False))
            target["values"][n] = v


#: Peer releases, self releases and closes of some keys, as the end of a log tells them.
FLAGS = ["", "", "", "", "", "Pa", "Pb", "Pac", "Sa", "Sb", "Sabc", "PaSa", "PbSc", "X", "PaX"]


def _flagged(text):
    return tuple(re.sub("[SX].*|P", "", text)), tuple(re.sub("P[abc]*|[SX]", "", text)), "X" in text


def _valued_type(gap, mode):
    base = r"a=(?P<a>\w+)?;b=(?P<b>\w+)?;c=(?P<c>\w+)?;v=(?P<v>\d+)?;"
    patterns = tuple(Pattern(base + f + "$", *_flagged(f)) for f in sorted(set(FLAGS)))
    return FiberType("t", (*ABC, Attribute("v", "int")), {"s": patterns}, gap, mode)


@pytest.mark.parametrize(("gap", "mode"), [("6s", "session"), ("infinite", "session"), ("6s", "from_start")])
def test_values_and_incarnations(spark, gap, mode):
    """Three keys with releases and closes: groups, last values and conflicts are those of the model."""
    rng, rows, at = random.Random(gap + mode), [], 0
    for _ in range(1500):
        at += rng.choice([0, 0, 1, 1, 1, 2, 9])
        a, b, c = (rng.choice(["", "", "1", "2", "3", "4"]) for _ in "abc")
        rows.append((at, f"a={a};b={b};c={c};v={rng.choice(['', '1', '2', '3'])};{rng.choice(FLAGS)}"))
    model = Valued(6_000_000 if gap == "6s" else None, mode == "from_start")
    for i, (sec, text) in enumerate(rows):
        parts = dict(p.split("=") for p in text.split(";")[:-1])
        keys = {k: parts[k] for k in "abc" if parts[k]}
        model.log(f"l{i:04d}", sec * 1_000_000, keys, *_flagged(text.split(";")[-1]), values={n: v for n, v in parts.items() if v})
    logs = _logs(spark, rows)
    found = C.correlate_type(logs, _valued_type(gap, mode))
    names = {r.seq: r.log_id for r in logs.collect()}
    assert _groups(found) == model.groups()
    want = sorted((f["logs"][0], sorted(f["values"].items())) for f in model.fibers if f["end"] != "merged")
    assert sorted((r.first_log_id, sorted(r.attributes.items())) for r in found.fibers.collect()) == want
    assert sorted((names[r.seq], r.attribute, r.old_value, r.new_value, r.at_merge) for r in found.conflicts.collect()) == sorted(model.conflicts)


def test_value_of_the_later_fiber_stays(spark):
    t = FiberType("t", (*KEYS, Attribute("x")), {"s": (Pattern(r"a=(?P<a>\w+)?;b=(?P<b>\w+)?;x=(?P<x>\w+)?;"),)})
    found = C.correlate_type(_logs(spark, [(0, "a=1;b=;x=one;"), (1, "a=;b=2;x=two;"), (2, "a=1;b=;x=;"), (3, "a=1;b=2;x=;")]), t)
    assert [r.attributes for r in found.fibers.collect()] == [{"a": "1", "b": "2", "x": "one"}]
    assert [(r.attribute, r.old_value, r.new_value, r.seq, r.at_merge) for r in found.conflicts.collect()] == [("x", "two", "one", 3, True)]


def test_releases_bound_islands(spark):
    """A key that is freed again and again does not make one island of all its logs."""
    rows = [(i, f"a=1;b={i // 5};" + ("PEER" if i % 5 == 0 else "")) for i in range(100)]
    t = _type(gap="infinite")
    logs = C._rows(_logs(spark, rows), t, False, None)
    sizes = C._islands(logs, t).filter("gone IS NULL").groupBy("island").count().collect()
    assert max(r["count"] for r in sizes) == 5 and len(sizes) == 20


def test_normalized_keys(spark):
    t = FiberType("t", (Attribute("ip", "ip", key=True),), {"s": (Pattern(r"from (?P<ip>\S+)"),)})
    logs = _logs(spark, [(0, "from 192.168.001.001"), (1, "from 192.168.1.1"), (2, "from nowhere")])
    assert len(_groups(C.correlate_type(logs, t))) == 3
    assert len(_groups(C.correlate_type(logs, t, normalize_keys=True))) == 2


@pytest.mark.parametrize("two", [False, True])
def test_stream_is_as_batch(spark, tmp_path, monkeypatch, two):
    """Micro-batches one after another: closed fibers with their memberships are those of the whole input at once."""
    keys, regex = (KEYS, REGEX) if two else (KEYS[:1], r"a=(?P<a>\w+)?;b=;")
    rows = _random_rows(random.Random(f"stream{two}"), two)[:60]
    rules, logs = Rules((_type(keys, regex),)), _logs(spark, rows)
    plain = logs.select("log_id", "ts", "source_id", "raw_text", "seq")
    monkeypatch.setattr(streams, "COMPACT", 2)
    for k in range(3):
        plain.filter(F.col("seq").between(20 * k, 20 * k + 19)).drop("seq").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(plain.drop("seq").schema).parquet(f"{tmp_path}/in")
        streams.stream_correlate(stream, rules, f"{tmp_path}/out").awaitTermination()
    want = C.correlate(logs, rules, flush=False)
    closed = [r.fiber_id for r in want.fibers.filter("closed").collect()]
    got = sinks.read_fibers(spark, f"{tmp_path}/out/fibers").collect()
    assert sorted(r.fiber_id for r in got) == sorted(closed)
    assert sorted(r.n_logs for r in got) == sorted(r.n_logs for r in want.fibers.filter("closed").collect())
    members = [(r.log_id, r.fiber_id) for r in streams.stream_memberships(spark, f"{tmp_path}/out").collect()]
    assert sorted(members) == sorted((r.log_id, r.fiber_id) for r in want.memberships.collect())


def test_empty(spark):
    logs = _logs(spark, [(0, "a=1;b=;")]).filter("false")
    assert C.correlate_type(logs, _type()).fibers.count() == 0
