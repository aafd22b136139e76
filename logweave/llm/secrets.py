"""Secrets in texts: patterns, and values in credential contexts that are hard to guess.

The patterns (``assign``, ``access``, ``hex``) find what they find. Beside them a context (``pwd is``, ``Bearer``, a user's
part of an address ..) names a value; dynamic programming over the value finds the cheapest way of guessing it, cut into
words, dates, repeats, keyboard walks, sequences and spans of brute force, in log10 guesses. One that costs LIMIT or more
is told as ``guess``. Words are those of the whole corpus: a word costs the log10 of all words to its own count. Counts
are partial by batch and merged by Spark; of all words only those that occur in some value come back to the values, by a
join, so that the vocabulary may grow as it likes. Each distinct value is judged once.

Defined results: null and empty texts have no spans, zeros and the hash of the empty string. Rows that repeat an id (null
ids too) are rows of their own. Long texts and values are taken whole; the search is linear in the value. An empty table
gives no rows; other columns are not looked at. A value that overlaps a pattern's span is left to it. A value of one word's
letters (a capital first, or all of them) is no secret however rare it is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, stage

KINDS = ("assign", "access", "hex", "guess")

#: The patterns, and how long a match has to be. ``hex`` and ``access`` match whole runs, so their least
#: length may stand in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HINTS = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}")

#: Where a credential's value may follow.
_WORDS = "pass(?:word|wd|phrase|code)?|pwd|pw|pin|secret|token|(?:api|access|private|client)[_ -]?key|key|auth(?:orization)?|credentials?|login|bearer|basic"
_VALUE = r"""([^\s"'`<>]{8,})"""
CONTEXT = re.compile(rf"""(?<![a-z0-9])(?:{_WORDS})(?:["']?\x20{{0,3}}(?::=|=>|[:=]|\x20is|\x20was)\x20{{0,3}}|(?<=bearer)\x20|(?<=basic)\x20)["'`]?{_VALUE}""", re.I | re.A)
ADDRESS = re.compile(r"://[^\s/:@]+:([^\s/@]{8,})@")
_CONTEXT_HINT = rf"""(?i)((?:{_WORDS})["']?\x20{{0,3}}(:=|=>|[:=]|\x20is|\x20was)|(bearer|basic)\x20|://[^\s/:@]+:)"""
_CLOSING = ".,;:!?)]}|*"

#: Log10 guesses from which a value is a secret; characters that it has at least.
LIMIT, LEAST = 10.0, 8
#: Letters of a word that is counted; what each segment adds; a character of brute force.
WORD_SIZES = range(3, 21)
SEGMENT, BRUTE = 0.3, 1.0
TWICE = math.log10(2)
#: Blocks up to so long are found repeated.
BLOCK = 16

_LEET = str.maketrans("430157@$!", "aeoistasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
#: A key's place: its column, moved by half a key a row, and its row.
_PLACE = {c: (2 * x + y + (0 if y == 0 else 1), y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
KEYS, TURNS = math.log10(47), math.log10(6)
YEARS = math.log10(150)
_DATE = re.compile(r"(?=((?:19|20)\d\d))|(?=(\d{1,2}([-/._]?)\d{1,2}\3(?:19|20)\d\d))|(?=((?:19|20)\d\d([-/._]?)\d\d\5\d\d))", re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the patterns' matches, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """``start, end, value`` in credential contexts, apart from the spans taken."""
    found = {}
    for pattern in (CONTEXT, ADDRESS):
        at = 0
        while m := pattern.search(text, at):
            value = m[1].rstrip(_CLOSING)
            start, end = m.start(1), m.start(1) + len(value)
            at = max(end, m.start() + 1)
            if len(value) >= LEAST and not _plain(value) and not any(a < end and start < b for a, _, b in taken):
                found[start] = (start, end, value)
    return [found[s] for s in sorted(found)]


def _plain(value: str) -> bool:
    """Letters as a word has them, hyphens between such."""
    return all(not p or p.isalpha() and (p.islower() or p.isupper() or p.istitle()) for p in value.split("-"))


def bare(value: str) -> str:
    """The value as words may be in it: small letters, look-alikes read as letters."""
    small = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return small.translate(_LEET)


def substrings(value: str) -> Iterator[tuple[int, str]]:
    """All that may be a word of it: ``start, letters``."""
    text, start = bare(value), 0
    for end in range(len(text) + 1):
        if end == len(text) or not text[end].isalpha():
            for a in range(start, end):
                for size in WORD_SIZES:
                    if a + size > end:
                        break
                    yield a, text[a : a + size]
            start = end + 1


def _word_cost(value: str, start: int, size: int, cost: float) -> float:
    """A word as it is written: capitals and look-alikes double the guesses."""
    part = value[start : start + size]
    capitals = sum(c.isupper() for c in part)
    if capitals and not (part.isupper() or capitals == 1 and part[0].isupper()):
        cost += math.log10(math.comb(size, min(capitals, size - capitals)) + 1)
    elif capitals:
        cost += TWICE
    return cost + TWICE * sum(not c.isalpha() for c in part)


def _repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """``start, block, times`` where a block follows itself."""
    n = len(value)
    for block in range(1, min(BLOCK, n // 2) + 1):
        run = 0
        for i in range(n - block + 1):
            if i < n - block and value[i] == value[i + block]:
                run += 1
                continue
            if run >= max(block, 2):
                yield i - run, block, run // block + 1
            run = 0


def guess_cost(value: str, words: list[tuple[int, int, float]], repeats: bool = True) -> float:
    """Log10 guesses of the cheapest segmentation; ``words``: ``start, size, cost`` of those that occur in it."""
    n = len(value)
    edges: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, size, cost in words:
        edges[start + size].append((start, _word_cost(value, start, size, cost)))
    for m in _DATE.finditer(value):
        for group, cost in ((1, YEARS), (2, YEARS + math.log10(372)), (4, YEARS + math.log10(372))):
            if m[group]:
                edges[m.end(group)].append((m.start(group), cost + (TWICE if group > 1 and m[group + 1] else 0)))
    if repeats:
        for start, block, times in _repeats(value):
            inside = [(a - start, size, c) for a, size, c in words if start <= a and a + size <= start + block] if block > 1 else []
            cost = guess_cost(value[start : start + block], inside, False) + math.log10(times)
            edges[start + block * times].append((start, cost))
    keys = [_PLACE.get(c) for c in value.lower().translate(_SHIFTED)]
    best, brute = [0.0] + [math.inf] * n, math.inf
    walk, turn, sequence, step = [math.inf] * 4, None, [math.inf] * 3, None
    for j in range(1, n + 1):
        brute = min(best[j - 1] + SEGMENT, brute) + BRUTE
        a, b = (keys[j - 2], keys[j - 1]) if j > 1 else (None, keys[0])
        move = (b[0] - a[0], b[1] - a[1]) if a and b else None
        if move is not None and abs(move[1]) <= 1 and abs(move[0]) <= (2 if move[1] == 0 else 1) and move != (0, 0):
            more = 0.1 if move == turn else TURNS
            walk = [math.inf, walk[0] + more, walk[1] + more, min(walk[2], walk[3]) + more]
            turn = move
        else:
            walk, turn = [math.inf] * 4, None
        walk[0] = best[j - 1] + SEGMENT + KEYS if b else math.inf
        gone = ord(value[j - 1]) - ord(value[j - 2]) if j > 1 else 0
        if abs(gone) == 1 and value[j - 1].isalnum():
            on = step in (None, gone)
            # in a new direction the sequence starts with the character before
            sequence = [math.inf, sequence[0], min(sequence[1], sequence[2]) + 0.1 if on else math.inf]
            step = gone
        else:
            sequence, step = [math.inf] * 3, None
        sequence[0] = best[j - 1] + SEGMENT + math.log10(36)
        best[j] = min([brute, walk[3], sequence[2], *(best[i] + SEGMENT + c for i, c in edges[j])])
    return best[n]


FOUND = (
    "row long, doc_id {id}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>,"
    " candidates array<struct<start:long,end:long,value:string>>, words array<struct<word:string,n:long>>"
)


def _word_counts(texts: pa.Array) -> pa.Table:
    """Words of letters in the texts, with what stands around them cut off, and how often they come."""
    counted = pc.value_counts(pc.list_flatten(pc.utf8_split_whitespace(texts)))
    words = pc.utf8_trim(pc.utf8_lower(counted.field("values")), """.,;:!?()[]{}"'`*_-""")
    fits = pc.and_(pc.utf8_is_alpha(words), pc.and_(pc.greater_equal(pc.utf8_length(words), WORD_SIZES[0]), pc.less_equal(pc.utf8_length(words), WORD_SIZES[-1])))
    table = pa.table({"word": words, "n": counted.field("counts")}).filter(fits)
    return table.group_by("word", use_threads=False).aggregate([("n", "sum")])


def _scanned(docs: DataFrame) -> DataFrame:
    """Rows with the patterns' spans and the candidates; and, per batch, a row of word counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        empty = hashlib.sha256(b"").hexdigest()
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        value = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        count = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            hints = [pc.match_substring_regex(texts, h) for h in (*_HINTS, _CONTEXT_HINT)]
            any_hint = hints[0]
            for h in hints[1:]:
                any_hint = pc.or_(any_hint, h)
            at = pc.indices_nonzero(any_hint)
            base, values, hashes, counts = [[]] * n, [[]] * n, [empty] * n, [[0] * n for _ in range(3)]
            for i, text in zip(at.to_pylist(), texts.take(at).to_pylist(), strict=True):
                spans = base_spans(text)
                if spans:
                    base[i] = [dict(start=a, kind=k, end=b) for a, k, b in spans]
                    hashes[i] = hashlib.sha256(told(spans).encode()).hexdigest()
                    for _, k, _ in spans:
                        counts[k][i] += 1
                values[i] = [dict(start=a, end=b, value=v) for a, b, v in candidates(text, spans)]
            words = _word_counts(texts)
            entries = pa.StructArray.from_arrays([words["word"].combine_chunks().cast(pa.string()), words["n_sum"].combine_chunks()], ["word", "n"])
            names = ["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates", "words"]
            columns = [pa.array(range(row, row + n), pa.int64()), ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes), pa.array(base, span), pa.array(values, value), pa.nulls(n, count)]
            yield pa.RecordBatch.from_arrays(columns, names)
            row += n
            columns = [pa.nulls(1, c.type) for c in columns[:-1]] + [pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND.format(id=kind))


def _judged(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``value, cost`` of the distinct values that cost LIMIT or more. ``vocabulary``: ``word, n``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(substrings(value))
                if found:
                    starts, words = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array(starts, pa.int64()), pa.array(words)], ["vid", "start", "word"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            costs = [guess_cost(v, [(w["start"], w["size"], w["cost"]) for w in words or ()]) for v, words in zip(values, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs)], ["value", "cost"])

    values = stage(values.distinct().select(F.monotonically_increasing_id().alias("vid"), "value"), "values")
    parts = values.mapInArrow(cut, "vid long, start long, word string")
    needed = parts.select("word").distinct()
    total = vocabulary.agg(F.sum("n").alias("total"))  # one row
    words = vocabulary.join(needed, "word").crossJoin(F.broadcast(total)).select("word", F.log10(F.col("total") / F.col("n")).alias("cost"))
    words = stage(words, "words")
    met = lookup_join(parts, words, ["word"], F.col("vid"), "inner")
    met = met.groupBy("vid").agg(F.collect_list(F.struct("start", F.length("word").alias("size"), "cost")).alias("words"))
    return values.join(met, "vid", "left").select("value", "words").mapInArrow(judge, "value string, cost double").filter(F.col("cost") >= LIMIT)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the patterns, their hash, and all spans, as text and as a list."""
    scanned = stage(_scanned(docs), "scanned")
    rows = scanned.filter("row IS NOT NULL").drop("words")
    vocabulary = scanned.filter("row IS NULL").select(F.inline("words")).groupBy("word").agg(F.sum("n").alias("n"))
    named = rows.select("row", F.inline("candidates"))
    judged = stage(_judged(named.select("value"), stage(vocabulary, "vocabulary")), "judged")
    hits = lookup_join(named, judged, ["value"], F.col("row"), "inner")
    hits = hits.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    some = rows.filter(F.size("candidates") > 0).join(hits, F.col("row") == F.col("__row"), "left").drop("__row")
    none = rows.filter(F.size("candidates") == 0).withColumn("added", F.lit(None).cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    both = some.unionByName(none)
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = F.sort_array(F.concat("base", F.coalesce("added", empty)))
    kinds = F.array(*map(F.lit, KINDS))
    both = both.withColumn("found", F.transform(found, lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "found")
