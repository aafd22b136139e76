"""Repair of conversations: the cheapest edits that make the turns alternate, told as they become certain.

A conversation's turns run through a Viterbi search over what was said last: nothing (``0``), the system (``S``), the user
(``U``) or the assistant (``A``). Edits hang in a tree of back-pointers that counts references; when all survivors share
an ancestor, the edits up to it are certain and are given out, so that only the unresolved suffixes are held. Among edits
of equal cost the ASCII-least wins: survivors keep the order of their complete unresolved suffixes. The order is carried
from row to row rather than read again, which suffices because no survivor's suffix begins another's (each ends with the
edit of the last row, and edits determine the state). A survivor goes as soon as another is cheaper by more than any way
on could give back, so survivors do meet.

Conversations are dealt by id, sorted by Spark. One of more than SEGMENT rows is cut: equal rows become one with a count,
the rest is ranged over tasks by turn. A segment is run from each of the four states; what that costs, and the order of the
results, is a small table; these tables are put together to find the states at the cuts, and the segments are run again
between those. The hash of a conversation's text is one stream by nature, of blocks as long as BLOCK.

Defined results: nulls of role, text and (for the draw of the damage) ids and turns count as one space. Rows of the same
turn follow role and text; rows that are equal throughout are duplicates of each other. A null id is a conversation of its
own. Roles other than those that begin with s, u or a fit nowhere. A conversation without rows has zeros, no edits and the
hash of the empty string. Empty tables give no rows; columns beside conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lookup_join, stage

#: Rows of a conversation that is not cut.
SEGMENT = 1 << 16
#: Characters of repaired text of a cut conversation that go on as one row.
BLOCK = 1 << 20

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STATES = "0SUA"
#: Where a turn of the user or the assistant leads from each state; the system only begins.
_SAYS = {"0": "U", "S": "U", "U": "A", "A": "U"}
_INITIAL = {"U": "u", "A": "a"}
_ROLE = {"U": "user", "A": "assistant"}
#: What is missing at the end of a conversation.
_TAIL = {"0": "", "S": "II", "U": "I", "A": ""}

COUNTS = ("blank", "duplicate", "truncated", "illegal")
REPAIRED = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n`` after seeded damage: ``n`` is 0 for a dropped row, 2 for one that is repeated."""
    one = F.lit(" ")
    code = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), one), F.coalesce(F.col("turn").cast("string"), one))) % 20
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _fault(text: Column, seen: Column) -> Column:
    """A row's first fault: blank, duplicate, truncated, or ``''``."""
    told = F.rtrim(text, F.lit(SPACE_CHARS))
    return F.when(told == "", "blank").when(seen, "duplicate").when(~told.rlike(r"[.!?]\z"), "truncated").otherwise("")


def _fault_of(text: str, seen: bool) -> str:
    told = text.rstrip(SPACE_CHARS)
    return "blank" if not told else "duplicate" if seen else "" if told[-1] in ".!?" else "truncated"


class Node:
    """An edit in the tree: ``refs`` counts the edits that follow and the survivor that ends here."""

    __slots__ = ("edits", "follow", "more", "parent", "refs", "role", "state", "text")

    def __init__(self, parent, edits="", state="0", role="", text="", more=0):
        self.parent, self.edits, self.state, self.role, self.text, self.more = parent, edits, state, role, text, more
        self.refs, self.follow = 1, []


def ways(state: str, initial: str, fault: str) -> list[tuple[int, str, str]]:
    """``cost, edits, next state`` of all that can become of a row. An insertion comes before a row that stays: before one
    that goes it costs as much and is greater than behind it."""
    found = [(DELETE, "D", state)]
    if fault in ("blank", "duplicate"):
        return found
    extra = TRUNCATED if fault == "truncated" else 0
    if state == "0" and initial == "s":
        found.append((extra, "K", "S"))
    says = _SAYS[state]
    for lead, cost in (("", 0), ("I", INSERT)):
        if lead:
            says = _SAYS[says]
        if initial == _INITIAL[says]:
            found.append((cost + extra, lead + "K", says))
        else:
            found.append((cost + REROLE + extra, lead + "R", says))
    return found


def advance(costs: dict[str, int], order: list[str], initial: str, fault: str) -> tuple[dict, list[str]]:
    """One row: of each state that can be reached, ``(cost, state before, edits)``, and these states in the order of all
    their edits so far."""
    best: dict[str, tuple] = {}
    for rank, state in enumerate(order):
        for cost, edits, then in ways(state, initial, fault):
            mine = (costs[state] + cost, rank, edits)
            if then not in best or mine < best[then]:
                best[then] = mine
    after = sorted(best, key=lambda s: best[s][1:])
    return {s: (best[s][0], order[best[s][1]], best[s][2]) for s in after}, after


def hopeless(costs: dict[str, int]) -> set[str]:
    """States that can't be on the cheapest way: from another one all that follows costs less.

    What starts as ``0`` may keep a system turn that others must delete; ``S`` goes on as ``A`` does; ``U`` and ``A`` are one
    insertion apart.
    """
    a, u = costs.get("A"), costs.get("U")
    likes = [c for c in (a, u + INSERT if u is not None else None) if c is not None]
    gone = {s for s, slack in (("0", DELETE), ("S", 0)) if s in costs and any(c + slack < costs[s] for c in likes)}
    if u is not None and any(costs[s] + INSERT < u for s in costs if s != "U"):
        gone.add("U")
    if a is not None and u is not None and u + INSERT < a:
        gone.add("A")
    return gone


class Repair:
    """The search from a state; ``told(edits, state, role, text)`` is called with edits once they are certain."""

    def __init__(self, told, start: str = "0"):
        self.told, self.root = told, Node(None, state=start)
        self.costs, self.order, self.tips = {start: 0}, [start], {start: self.root}
        self.held = self.most = 0

    def row(self, role: str, text: str, fault: str, more: int = 0) -> None:
        """A row, and ``more`` copies of it that all have to go."""
        found, order = advance(self.costs, self.order, role[:1], fault)
        before = self.tips
        self.tips = {}
        for state, (_, prev, edits) in found.items():
            node = Node(before[prev], edits, state, role, text, more)
            before[prev].refs += 1
            before[prev].follow.append(node)
            self.tips[state] = node
            self.held += 1
        self.costs = {s: c[0] + more * DELETE for s, c in found.items()}
        gone = hopeless(self.costs)
        self.order = [s for s in order if s not in gone]
        for node in before.values():
            self._drop(node)
        for s in gone:
            self._drop(self.tips.pop(s))
            del self.costs[s]
        self.most = max(self.most, self.held)
        self._settle()

    def _drop(self, node: Node) -> None:
        """One reference less; without any, the edit goes, and perhaps those before it."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node.parent.follow.remove(node)
            self.held -= 1
            node = node.parent
            node.refs -= 1

    def _settle(self) -> None:
        """While one edit alone follows the root, it is certain."""
        while self.root.refs == 1 and self.root.follow:
            (node,) = self.root.follow
            node.parent, self.root = None, node
            self.held -= 1
            self._tell(node)

    def _tell(self, node: Node) -> None:
        self.told(node.edits + "D" * node.more, node.state, node.role, node.text)

    def end(self, state: str | None = None) -> int:
        """Ends in ``state``, or as a whole conversation does, with what is missing inserted. Returns the cost."""
        if state is None:
            state = min(self.order, key=lambda s: (self.costs[s] + INSERT * len(_TAIL[s]), self.order.index(s)))
            tail = _TAIL[state]
        else:
            tail = ""
        path, node = [], self.tips[state]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._tell(node)
        if tail:
            self.told(tail, "A", "", "")
        return self.costs[state] + INSERT * len(tail)


def turns(edits: str, state: str, role: str, text: str) -> list[tuple[str, str]]:
    """The turns that edits of one row (or what is inserted at the end) leave: role and text."""
    if edits == "II":
        return [("user", ""), ("assistant", "")]
    found = []
    if edits[0] == "I":
        found.append((_ROLE[state if edits == "I" else _SAYS[state]], ""))
    if "K" in edits:
        found.append((role, text))
    elif "R" in edits:
        found.append((_ROLE[state], text))
    return found


class Report:
    """What comes of one conversation (or of a part of it): counts, audit, and the repaired text, hashed as it becomes
    certain or (``keep``) given out in blocks."""

    def __init__(self, start: str = "0", keep: bool = False):
        self.audit: list[str] = []
        self.lines: list[str] = []
        self.size, self.keep = 0, keep
        self.hash, self.any = hashlib.sha256(), False
        self.repair = Repair(self._told, start)
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.low = self.high = None
        self.n, self.distinct = 0, 0
        self.initials: list[str] = []

    def _told(self, *edit) -> None:
        self.audit.append(edit[0])
        for role, text in turns(*edit):
            if self.keep:
                self.lines.append(f"{role}:{text}")
                self.size += len(role) + len(text) + 2
            else:
                self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
                self.any = True

    def count(self, turn: int | None, role: str, fault: str, n: int) -> None:
        initial = role[:1]
        if self.n and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.initials[1:] = [initial]
        self.n += n
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += n - 1

    def row(self, turn: int | None, role: str, text: str, fault: str, n: int) -> None:
        self.count(turn, role, fault, n)
        self.repair.row(role, text, fault, n - 1)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that one task holds, in order of their turns."""
    schema = pa.schema([("conv_id", _arrow(rows.schema["conv_id"].dataType)), *[(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def close() -> None:
            cost = report.repair.end()
            out.append((conv, report.gaps, *report.counts.values(), cost, "".join(report.audit), report.hash.hexdigest()))

        conv, report, seen = None, None, set()
        for conv_id, turn, role, text, n in _rows(batches):
            if report is None or conv_id != conv:
                if report is not None:
                    close()
                if len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out.clear()
                conv, report, seen = conv_id, Report(), set()
            if not n:  # all that is known of it is that it was there
                continue
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            fault = _fault_of(text, key in seen)
            seen.add(key)
            report.row(turn, role, text, fault, n)
        if report is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = rows.select("conv_id", "turn", "role", "text", "n").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, REPAIRED.format(id=kind))


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# Conversations of more than SEGMENT rows


def _segments(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with ``fault``, equal ones as one with a count, and the number of their segment."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))).alias("first"))
    same = rows["conv_id"].eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    rows = rows.join(firsts, same)  # a role and text that a third of the rows have is split by the adaptive join
    rows = rows.withColumn("fault", _fault(F.col("text"), ~F.col("turn").eqNullSafe(F.col("first.turn"))))
    rows = rows.select("conv_id", "turn", "role", "text", "n", "fault")
    return rows.repartitionByRange("conv_id", "turn", "role", "text").withColumn("segment", F.spark_partition_id())


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")


def _summaries(rows: DataFrame, kind: str) -> DataFrame:
    """Per segment its counts, and what it costs from each state to each, with the order of the edits from a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, report, costs, order = [], None, None, {}, {}

        def close() -> None:
            table = [(s, t, c, order[s].index(t)) for s in STATES for t, c in costs[s].items()]
            out.append((*at, report.low, report.high, report.distinct, report.initials[0], report.initials[-1], *report.counts.values(), *map(list, zip(*table, strict=True))))

        for conv_id, segment, turn, role, n, fault in _rows(batches):
            if at != (conv_id, segment):
                if report is not None:
                    close()
                at, report = (conv_id, segment), Report()
                costs, order = {s: {s: 0} for s in STATES}, {s: [s] for s in STATES}
            report.count(turn, role, fault, n)
            for s in STATES:
                found, order[s] = advance(costs[s], order[s], role[:1], fault)
                costs[s] = {t: c[0] + (n - 1) * DELETE for t, c in found.items()}
        if report is not None:
            close()
            names = "conv_id segment low high distinct first last blank duplicate truncated illegal start then cost rank".split()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    ints = pa.list_(pa.int64())
    types = [_arrow(rows.schema["conv_id"].dataType), pa.int32(), *[pa.int64()] * 3, pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), ints, ints]
    counts = ", ".join(f"{c} long" for c in COUNTS)
    made = f"conv_id {kind}, segment int, low long, high long, distinct long, first string, last string, {counts}, start array<string>, then array<string>, cost array<long>, rank array<long>"
    return _dealt(rows).select("conv_id", "segment", "turn", "role", "n", "fault").mapInArrow(run, made)


def best_states(tables: list[dict]) -> tuple[int, list[str]]:
    """The cheapest cost and the states before each of the segments and after the last; ``tables``: of each segment
    ``(start, then) -> (cost, rank)``."""
    costs, order, back = {"0": 0}, ["0"], []
    for table in tables:
        best: dict[str, tuple] = {}
        for (start, then), (cost, rank) in table.items():
            if start in costs:
                mine = (costs[start] + cost, order.index(start), rank)
                if then not in best or mine < best[then]:
                    best[then] = mine
        back.append({t: order[b[1]] for t, b in best.items()})
        costs, order = {t: b[0] for t, b in best.items()}, sorted(best, key=lambda t: best[t][1:])
    state = min(order, key=lambda s: (costs[s] + INSERT * len(_TAIL[s]), order.index(s)))
    cost, path = costs[state] + INSERT * len(_TAIL[state]), [state]
    for step in reversed(back):
        path.append(step[path[-1]])
    return cost, path[::-1]


def _joined(summaries: DataFrame, kind: str) -> DataFrame:
    """Per segment the states it begins and ends with, and, on the last one, what is known of the whole conversation.

    A conversation's segments are no more than the tasks that its rows were ranged over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def close(conv, parts: list[tuple]) -> None:
            cost, path = best_states([dict(zip(zip(p[11], p[12], strict=True), zip(p[13], p[14], strict=True), strict=True)) for p in parts])
            counts = [sum(p[k] for p in parts) for k in (7, 8, 9, 10)]
            counts[3] += sum(p[6] + q[5] not in ("su", "ua", "au") for p, q in zip(parts, parts[1:], strict=False))
            told = [p for p in parts if p[2] is not None]
            distinct = sum(p[4] for p in told) - sum(p[3] == q[2] for p, q in zip(told, told[1:], strict=False))
            gaps = told[-1][3] - told[0][2] + 1 - distinct if told else 0
            for k, p in enumerate(parts):
                last = k == len(parts) - 1
                out.append((conv, p[1], path[k], path[k + 1], last, gaps, *counts, cost))

        conv, parts = None, []
        for row in _rows(batches):
            if parts and row[0] != conv:
                close(conv, parts)
                parts = []
            conv = row[0]
            parts.append(row)
        if parts:
            close(conv, parts)
            names = "conv_id segment start then last gaps blank duplicate truncated illegal cost".split()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [_arrow(summaries.schema["conv_id"].dataType), pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 6]
    dealt = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(run, f"conv_id {kind}, segment int, start string, then string, last boolean, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long")


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Audit and repaired text of each segment between its states, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            nonlocal nth
            text = "".join(line + "\n" for line in report.lines)
            columns = [[at[0]], [at[1]], [nth], ["".join(report.audit)], [text]]
            report.audit.clear()
            report.lines.clear()
            report.size, nth = 0, nth + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "segment", "nth", "audit", "text"])

        def close() -> pa.RecordBatch:
            report.repair.end(then)
            if last and _TAIL[then]:
                report._told(_TAIL[then], "A", "", "")
            return block()

        at, report, nth, then, last = None, None, 0, "", False
        for conv_id, segment, role, text, n, fault, start, to, is_last in _rows(batches):
            if at != (conv_id, segment):
                if report is not None:
                    yield close()
                at, report, nth, then, last = (conv_id, segment), Report(start, True), 0, to, is_last
            report.repair.row(role, text, fault, n - 1)
            if report.size > BLOCK:
                yield block()
        if report is not None:
            yield close()

    types = [_arrow(rows.schema["conv_id"].dataType), pa.int32(), pa.int64(), pa.string(), pa.string()]
    dealt = _dealt(rows).select("conv_id", "segment", "role", "text", "n", "fault", "start", "then", "last")
    return dealt.mapInArrow(run, f"conv_id {kind}, segment int, nth long, audit string, text string")


def _hashed(blocks: DataFrame, kind: str) -> DataFrame:
    """Per conversation its audit and the hash of its text, read block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, audit, found, ended = [], None, None, None, b""
        for conv_id, text_audit, text in _rows(batches):
            if audit is None or conv_id != conv:
                if audit is not None:
                    out.append((conv, "".join(audit), found.hexdigest()))
                conv, audit, found, ended = conv_id, [], hashlib.sha256(), b""
            audit.append(text_audit)
            if text:  # its last line end counts once more follows
                found.update(ended + text[:-1].encode())
                ended = b"\n"
        if audit is not None:
            out.append((conv, "".join(audit), found.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "audit", "repaired_sha256"])

    types = [_arrow(blocks.schema["conv_id"].dataType), pa.string(), pa.string()]
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "nth").select("conv_id", "audit", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def _cut(rows: DataFrame, kind: str) -> DataFrame:
    rows = stage(_segments(rows), "segments")
    states = stage(_joined(_summaries(rows, kind), kind), "states")
    known = states.select("conv_id", "segment", "start", "then", "last")
    told = _hashed(_blocks(lookup_join(rows, known, ["conv_id", "segment"], F.col("text")), kind), kind)
    ends = states.filter("last").select(F.col("conv_id").alias("c"), "gaps", *COUNTS, "cost")
    joined = told.join(ends, told["conv_id"].eqNullSafe(ends["c"]))
    return joined.select("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, segment: int | None = None) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, n: copies, 0 for a row that tells of its conversation only)
    its faults and cheapest repair, as REPAIRED. Conversations of more than ``segment`` rows are cut."""
    segment = SEGMENT if segment is None else segment
    kind = rows.schema["conv_id"].dataType.simpleString()
    marks = rows.filter("n = 0").select("conv_id").distinct()
    rows = rows.filter("n > 0")
    long = stage(rows.groupBy("conv_id").agg(F.sum("n").alias("__rows")).filter(F.col("__rows") > segment).select("conv_id", F.lit(True).alias("__long")), "long")
    if long.isEmpty():
        cut = None
    else:
        rows = lookup_join(rows, long, ["conv_id"], F.xxhash64("turn", "text"))
        cut = _cut(rows.filter("__long").drop("__long"), kind)
        rows = rows.filter("__long IS NULL").drop("__long")
        marks = lookup_join(marks, long, ["conv_id"], F.col("conv_id")).filter("__long IS NULL").drop("__long")
    none = [F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n")]
    whole = _whole(rows.select("conv_id", "turn", "role", "text", "n").unionByName(marks.select("conv_id", *none)), kind)
    return whole if cut is None else whole.unionByName(cut)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Damages conversations by a seeded draw and repairs them."""
    return repair(damage(conversations))
