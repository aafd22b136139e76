"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets are one class; one document stands for it. Two sets of n shingles whose Jaccard
similarity reaches t share l tokens among their first n - ceil(t n) + l in any common order, for each l. The order here:
shingles that many documents have come last ("hot", by number), the rest by hash. Hot tokens are counted over all prefixes
by hash, then over what moves into the prefixes in their place.

Routing: documents meet in the lists of the tokens of their plain prefixes (l = 1). A document whose plain prefix lacks
tokens that are not hot leaves its hot ones out if it has too few of them for a link; else its candidates are costly, and
its prefix is lengthened by a step per doubling of their estimated number (the sum of its hot tokens' counts).
Before any pair is verified on the full sets, it must share as many tokens of both lengthened prefixes as the shorter of
the two stands for. This holds for all candidates, whichever way they met.

Lists of up to HOT documents give their pairs. A longer list is first compared with one document, that of the most hot
tokens (the centre of a group of near copies), then, outside of its largest component, with another one of that component.
Lists of up to LIST_DOCS documents are one row each, and of those with the same documents one goes on.
As only components are asked for, pairs within one need no comparison. What is still apart is compared in blocks:
documents outside of their lists' largest components, so many at a time, meet all documents that share a token of a plain
prefix with one of them, once per block and not once per token; a block counts shared prefix tokens for all its pairs,
verifies those that have enough and are not connected yet, and tells the links that connect. So no pair of documents
becomes a row, groups of thousands of near copies cost a few comparisons a document, and no link between components is
lost: every pair that the prefixes admit is either verified or already connected. Lists and blocks are dealt to tasks by
salt.

Defined results: null, empty or blank text has no shingles and is its own component; fewer than five words count as one
shingle; rows that share a ``doc_id`` are one node of the links; a null id takes part with its text's class only if that
has another id, else its component is null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from . import common
from .packing import text_slices
from .shingles import mix, shingle_sets

WORDS = 5
#: Similarity, in hundredths.
PERCENT = 75
#: More documents than this with a token make it hot; longer lists are not compared pair by pair.
HOT = 5
#: Documents with a larger share of hot tokens in their prefixes by hash (a 1 in so many) tell of hot tokens in all they have.
SUSPECT = 4
#: Hot tokens that are sent to the executors; beyond it the limit for being hot is doubled (any choice is right).
HOT_TOKENS = 500_000
#: Centres that a long list is compared with before blocks are.
STAR_ROUNDS = 2
#: Shared tokens that are asked for at most.
MAX_MATCHES = 16
SALTS = 32
#: Documents of a block, and shingles in them all; documents that one task compares with a block.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_PARTNERS = 256, 2_000_000, 512
#: Documents of a list that is kept in one row; longer lists are rows of their documents.
LIST_DOCS = 1_000
#: Rows of one longer list that meet its centre in one task.
ROWS_A_LIST = 10_000
#: Pairs of one document that meet its text in one task.
PAIRS_A_KEY = 1_000
#: Rows of 64 neighbouring ids that are broadcast to pick documents; more are joined by key.
BROADCAST_IDS = 500_000


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _arrow(fields: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], fields.split())


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_slices(batch):
                sets = shingle_sets(texts, k)
                keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
                yield _arrow("doc_id n d1 d2", pa.array(ids, pa.int64()), np.array([len(s) for s in sets], np.int64), keys[:, 0].copy(), keys[:, 1].copy())

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def _prefix_tokens(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Tokens of every document's plain prefix in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch):
                parts = [s[: len(s) - needed(len(s), percent) + 1] for s in shingle_sets(texts, k) if len(s)]
                if parts:
                    yield _arrow("token", np.concatenate(parts).view(np.int64))

    return docs.mapInArrow(run, "token long")


def _marks(hot: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
    """Counts of the hot tokens in a set, 0 for others."""
    tokens, counts = hot
    if not len(tokens):
        return np.zeros(len(s), np.int64)
    at = np.searchsorted(tokens, s)
    at[at == len(tokens)] = 0
    return np.where(tokens[at] == s, counts[at], 0)


def _suspect_tokens(docs: DataFrame, hot, k: int, percent: int) -> DataFrame:
    """Tokens beyond the plain prefixes of documents with hot ones in them: those that may move up, of suspects all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch):
                parts = []
                for s in shingle_sets(texts, k):
                    plain = len(s) - needed(len(s), percent) + 1
                    if n_hot := np.count_nonzero(_marks(hot.value, s[:plain])) if len(s) else 0:
                        parts.append(s[plain:] if SUSPECT * n_hot >= plain else s[plain : plain + SUSPECT * n_hot])
                if parts:
                    yield _arrow("token", np.concatenate(parts).view(np.int64))

    return docs.mapInArrow(run, "token long")


class Prefix(NamedTuple):
    """A set's lengthened prefix in the common order; ``routing`` of its tokens are the plain prefix."""

    tokens: np.ndarray
    counts: np.ndarray  # of hot tokens, 0 for others
    routing: int
    matches: int
    n_hot: int


def lengthened(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray], percent: int) -> Prefix:
    """The prefix of a sorted set that is not empty, and how many of its tokens a partner must share."""
    n = len(s)
    plain, matches = n - needed(n, percent) + 1, 1
    count = _marks(hot, s)
    n_hot = int(np.count_nonzero(count))
    if n_hot:
        order = np.lexsort((s, count))
        s, count = s[order], count[order]
    if n - n_hot < plain:
        if n_hot < needed(n, percent):
            plain = n - n_hot  # its links share tokens that are not hot
        else:
            matches = min(1 + int(math.log2(1 + int(count[:plain].sum()) / HOT)), MAX_MATCHES, needed(n, percent))
    part = slice(0, plain + matches - 1)
    return Prefix(s[part], count[part], plain, matches, n_hot)


INDEX = "token long, doc_id long, n int, hot int, is_hot boolean, many boolean"


def _index(docs: DataFrame, hot, k: int, percent: int) -> DataFrame:
    """Tokens of every document's plain prefix; ``hot``: the document's hot tokens in all; ``many``: of a token of more than LIST_DOCS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_slices(batch):
                tokens, marks, docs_ = [], [], []
                for doc_id, s in zip(ids, shingle_sets(texts, k), strict=True):
                    if not len(s) or doc_id is None:
                        continue
                    p = lengthened(s, hot.value, percent)
                    tokens.append(p.tokens[: p.routing])
                    marks.append(p.counts[: p.routing])
                    docs_.append((doc_id, len(s), p.n_hot))
                if tokens:
                    lengths = [len(x) for x in tokens]
                    doc_ids, sizes, hots = (np.repeat(np.array(c, np.int64), lengths) for c in zip(*docs_, strict=True))
                    counts = np.concatenate(marks)
                    yield _arrow("token doc_id n hot is_hot many", np.concatenate(tokens).view(np.int64), doc_ids, sizes.astype(np.int32), hots.astype(np.int32), counts > 0, counts > LIST_DOCS)

    return docs.mapInArrow(run, INDEX)


FOUND = "kind int, a long, b long, token long, n int, hot int, is_hot boolean, docs array<long>, ns array<int>, hots array<int>"


def _lists(index: DataFrame, percent: int) -> DataFrame:
    """Reads the index token by token. kind 0: a pair ``a, b`` to verify. kind 1: document ``a`` of a list of more than
    LIST_DOCS. kind 2: a shorter one, whole (``docs, ns, hots``), whose ``token`` is a hash of its documents.

    The lists of tokens of more than LIST_DOCS are dealt over salts, as all that is done here is to pass them on.
    """

    def emit(kind: int, a, b, token, n, hot, is_hot, lists=None) -> pa.RecordBatch:
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        lists = lists or [pa.nulls(len(a), k) for k in kinds]
        return _arrow(FOUND_NAMES, np.full(len(a), kind, np.int32), a, b, token, n, hot, is_hot, *lists)

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        z = np.zeros(len(a), np.int32)
        return emit(0, a, b, np.zeros(len(a), np.int64), z, z, z > 0)

    def step(cols, from_long: bool, last: bool):
        """Output of the complete lists, and what to hold back of the last one."""
        t, d, n, h, is_hot, many = cols
        out = []
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        sizes = np.diff(np.r_[starts, len(t)])
        rows = many[starts] | (sizes > LIST_DOCS)
        if from_long:
            rows[0] = True
        long = rows | (sizes > HOT) | is_hot[starts]
        done = np.ones(len(starts), bool)
        if not last:
            done[-1] = False
        pick = rows[np.repeat(np.arange(len(starts)), sizes)]
        if from_long:
            pick[0] = False  # stands for rows already told
        if pick.any():
            out.append(emit(1, d[pick], np.zeros(pick.sum(), np.int64), t[pick], n[pick], h[pick], is_hot[pick]))
        whole = long & ~rows & done & (sizes > 1)
        if whole.any():
            pick, first, m = whole[np.repeat(np.arange(len(starts)), sizes)], starts[whole], sizes[whole]
            offsets, z = np.r_[0, np.cumsum(m)].astype(np.int32), np.zeros(len(m), np.int32)
            same = np.add.reduceat(mix(d[pick].view(np.uint64)), offsets[:-1])  # in any order
            same = mix(same + m.astype(np.uint64) * np.uint64(2) + is_hot[first].astype(np.uint64)).view(np.int64)
            lists = [pa.ListArray.from_arrays(offsets, x[pick]) for x in (d, n, h)]
            out.append(emit(2, z.astype(np.int64), z.astype(np.int64), same, z, z, is_hot[first], lists))
        found_a, found_b = [], []
        for size in range(2, HOT + 1):
            first = starts[(sizes == size) & ~long & done]
            for i in range(size):
                for j in range(i + 1, size):
                    x, y = first + i, first + j
                    small, large = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
                    ok = (d[x] != d[y]) & (100 * small >= percent * large)
                    found_a.append(d[x[ok]])
                    found_b.append(d[y[ok]])
        if found_a and sum(map(len, found_a)):
            out.append(pairs(np.concatenate(found_a), np.concatenate(found_b)))
        if last:
            return out, None, False
        tail = slice(starts[-1], starts[-1] + 1) if rows[-1] else slice(starts[-1], None)
        return out, [x[tail] for x in cols], bool(rows[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, from_long = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            out, held, from_long = step(cols, from_long, False)
            yield from out
        if held is not None:
            yield from step(held, from_long, True)[0]

    salt = F.when(F.col("many"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    return index.repartition("token", salt).sortWithinPartitions("token").mapInArrow(run, FOUND)


FOUND_NAMES = " ".join(x.split()[0] for x in FOUND.split(", "))


def _whole_lists(lists: DataFrame, percent: int) -> DataFrame:
    """Lists in one row, each set of documents once. kind 0: a pair ``a, b`` of a document and its list's centre, that of the
    most hot tokens. kind 1: rows as :func:`_long_lists` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, keep = batch.column(0).to_pylist(), []
            for i, token in enumerate(tokens):
                if token not in seen:
                    seen.add(token)
                    keep.append(i)
            if not keep:
                continue
            token, is_hot, docs, ns, hots = (c.to_numpy(zero_copy_only=False) if k < 2 else c for k, c in enumerate(batch.take(pa.array(keep)).columns))
            m = docs.value_lengths().to_numpy()
            of, starts = np.repeat(np.arange(len(m)), m), np.cumsum(m) - m
            d, n, h = docs.flatten().to_numpy(), ns.flatten().to_numpy().astype(np.int64), hots.flatten().to_numpy().astype(np.int64)
            cold = ~is_hot[of]
            partner = np.maximum(np.minimum.reduceat(n, starts)[of], -(-percent * n // 100))
            enough = cold | ((100 + percent) * h >= percent * (n + partner))
            d, n, h, cold, of = d[enough], n[enough], h[enough], cold[enough], of[enough]
            if not len(d):
                continue
            order = np.lexsort((mix(d.view(np.uint64)), -h, of))
            first = order[np.r_[True, of[order][1:] != of[order][:-1]]]
            centre = first[np.searchsorted(of[first], of)]
            fit = (d != d[centre]) & (100 * np.minimum(n, n[centre]) >= percent * np.maximum(n, n[centre]))
            fit &= cold | ((100 + percent) * np.minimum(h, h[centre]) >= percent * (n + n[centre]))
            x, y = d[fit], d[centre][fit]
            x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            kind = np.repeat([0, 1], [len(x), len(d)]).astype(np.int32)
            z = np.zeros(len(x), np.int64)
            columns = (np.r_[x, d], np.r_[y, 0 * d], np.r_[z, token[of]], np.r_[z, n].astype(np.int32), np.r_[z, h].astype(np.int32), np.r_[z > 0, ~cold])
            yield _arrow("kind a b token n hot is_hot", kind, *columns)

    rows = lists.filter("kind = 2").select("token", "is_hot", "docs", "ns", "hots")
    return rows.repartition("token").mapInArrow(run, "kind int, a long, b long, token long, n int, hot int, is_hot boolean")


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose id is (not) among ``ids``. 64 neighbouring ids are bits of one row; up to BROADCAST_IDS rows are
    broadcast, so that no document moves, more are joined by key."""
    rows = ids.groupBy(F.shiftright(F.col("id").cast("long"), 6).alias("picked")).agg(F.expr("bit_or(shiftleft(1L, cast(id & 63 AS int)))").alias("bits"))
    rows = common.stage(rows, "picked")
    # own names, so that columns of the documents cannot clash with those made here
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id = F.col(names[docs.columns.index("doc_id")]).cast("long")
    joined = docs.toDF(*names).join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, F.shiftright(doc_id, 6) == F.col("picked"), "left")
    bit = F.getbit(F.coalesce("bits", F.lit(0).cast("long")), F.coalesce(doc_id.bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
    return joined.filter(bit == (1 if how == "left_semi" else 0)).select(*names).toDF(*docs.columns)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def paired_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b, text_a, text_b`` for pairs of ids; a document of many pairs meets them in several tasks."""
    pairs = common.stage(pairs, "pairs")
    degree = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_KEY).alias("copies"))
    degree = common.stage(degree, "degrees")
    texts = _picked(docs, degree, "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    many = degree.filter("copies > 1")
    pairs = common.lookup_join(pairs, many.select(F.col("id").alias("a"), F.col("copies").alias("of_a")), ["a"], F.col("b"))
    pairs = common.lookup_join(pairs, many.select(F.col("id").alias("b"), F.col("copies").alias("of_b")), ["b"], F.col("a"))
    part = lambda of, by: F.when(F.col(of) > 1, F.pmod(F.xxhash64(by), F.col(of))).otherwise(0)
    pairs = pairs.select("a", "b", part("of_a", "b").alias("part_a"), part("of_b", "a").alias("part_b"))
    texts = common.lookup_join(texts, many.select(F.col("id").alias("doc_id"), "copies"), ["doc_id"], F.col("text"))
    texts = texts.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)).alias("part"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("part").alias("part_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("part").alias("part_b"), F.col("text").alias("text_b"))
    return pairs.join(left, ["a", "part_a"]).join(right, ["b", "part_b"]).select("a", "b", "text_a", "text_b")


def _verified(pairs: DataFrame, docs: DataFrame, hot, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that share enough prefix tokens and whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                a, b, left, right = (part.column(i).to_pylist() for i in range(4))
                texts = list(dict.fromkeys(left + right))
                sets = dict(zip(texts, shingle_sets(texts, k), strict=True))
                prefixes = {t: lengthened(s, hot.value, percent) for t, s in sets.items()}
                hits = []
                for x, y in zip(left, right, strict=True):
                    p, q = prefixes[x], prefixes[y]
                    shared = len(np.intersect1d(p.tokens, q.tokens, assume_unique=True))
                    hits.append(shared >= min(p.matches, q.matches) and _similar(sets[x], sets[y], percent))
                keep = np.array(hits, bool)
                yield _arrow("a b", np.array(a, np.int64)[keep], np.array(b, np.int64)[keep])

    return common.stage(paired_texts(pairs, docs).mapInArrow(run, "a long, b long"), "verified")


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of lists with what ``lists`` has of each token (inner); only lists of many rows are dealt to several tasks."""
    if lists.count() <= common.BROADCAST_ROWS:
        return common.lookup_join(rows, lists, ["token"], F.col("a"), "inner")
    parts = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_LIST).alias("parts")).filter("parts > 1")
    parts = common.stage(parts, "parts")
    rows = common.lookup_join(rows, parts, ["token"], F.col("a"))
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    lists = common.lookup_join(lists, parts, ["token"], F.col("token"))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    return rows.join(lists.hint("merge"), ["token", "part"]).drop("part")


def _long_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of lists of several documents, without those whose hot tokens are too few for a link with any of the list."""
    per = rows.groupBy("token").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    rows = _with_lists(rows, common.stage(per, "least"))
    partner = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100))
    enough = ~F.col("is_hot") | ((100 + percent) * F.col("hot") >= percent * (F.col("n") + partner))
    return rows.filter(enough).select("token", "a", "n", "hot", "is_hot")


def _star(rows: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of rows and their lists' centres ``token, c, m, other``."""
    joined = _with_lists(rows, common.stage(centres, "centres")).filter("a <> c")
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    enough = (100 + percent) * F.least("hot", "other") >= percent * (F.col("n") + F.col("m"))
    joined = joined.filter(sizes & (~F.col("is_hot") | enough))
    return joined.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()


def _centres(rows: DataFrame, turn: int) -> DataFrame:
    first = F.min(F.struct((-F.col("hot")).alias("h"), F.xxhash64(F.col("a"), F.lit(turn)).alias("x"), "a", "n", "hot"))
    found = rows.groupBy("token").agg(first.alias("c"))
    return found.select("token", F.col("c.a").alias("c"), F.col("c.n").alias("m"), F.col("c.hot").alias("other"))


def _open_lists(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the lists that hold more than one component, with ``component`` and ``top``, the list's largest."""
    joined = rows.join(labels.hint("merge"), rows["a"] == labels["id"], "left")
    rows = common.stage(joined.select(*rows.columns, F.coalesce("component", "a").alias("component")), "labelled")
    per = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    lists = per.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "component")).alias("top"))
    lists = common.stage(lists.filter("parts > 1").select("token", F.col("top.component").alias("top")), "open")
    return common.stage(_with_lists(rows, lists), "open")


def _block_links(rest: DataFrame, docs: DataFrame, hot, k: int, percent: int) -> DataFrame:
    """Links that connect the components of open lists, by blocks of documents against all that share a token with them."""
    outside = rest.filter("component <> top")
    outer = outside.groupBy("a").agg(F.min("top").alias("cluster"), F.first("n").alias("n"), F.first("component").alias("component"))
    outer = common.stage(outer, "outer")
    per = outer.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    outer = common.lookup_join(outer, common.stage(per, "clusters"), ["cluster"], F.col("a"), "inner")
    outer = outer.select("a", "component", F.xxhash64("cluster", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("block"))
    outer = common.stage(outer, "blocks")
    routes = outside.select("token", "a").join(outer.select("a", "block"), "a").select("token", "block").distinct()
    met = common.lookup_join(rest.select("token", "a", "component"), common.stage(routes, "routes"), ["token"], F.col("a"), "inner")
    met = common.stage(met.select("block", "a", "component").distinct(), "met")
    salts = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PARTNERS).alias("salts"))
    salts = common.stage(salts, "salts")
    ours = common.lookup_join(outer, salts, ["block"], F.col("a"), "inner")
    ours = ours.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "a", "component")
    theirs = common.lookup_join(met, salts, ["block"], F.col("a"), "inner")
    theirs = theirs.select("block", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), "a", "component")
    rows = common.stage(ours.unionByName(theirs), "block-rows")
    texts = _picked(docs, rows.select(F.col("a").alias("id")).distinct(), "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.hint("merge").join(texts, rows["a"] == texts["doc_id"]).select("block", "salt", "role", "a", "component", "text")
    rows = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                blocks, salts, roles, ids, components, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                links: list[tuple[int, int]] = []
                sets = shingle_sets(texts, k)
                for where, role, doc_id, component, s in zip(zip(blocks, salts, strict=True), roles, ids, components, sets, strict=True):
                    if where != key:
                        block, key = _Block(hot.value, percent), where
                    if role == 0:
                        block.add(doc_id, component, s)
                    else:
                        links += block.compare(doc_id, component, s)
                if links:
                    yield _arrow("a b", *(np.array(c, np.int64) for c in zip(*links, strict=True)))

    return common.stage(rows.mapInArrow(run, "a long, b long"), "linked")


class _Block:
    """Some documents against a stream of others: the links that connect components not yet connected here."""

    def __init__(self, hot: tuple[np.ndarray, np.ndarray], percent: int):
        self.hot, self.percent = hot, percent
        self.ids, self.sets, self.prefixes, self.components = [], [], [], []
        self.parents: dict[int, int] = {}
        self.tokens = None

    def add(self, doc_id: int, component: int, s: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sets.append(s)
        self.prefixes.append(lengthened(s, self.hot, self.percent))
        self.components.append(component)

    def _root(self, x: int) -> int:
        while (up := self.parents.get(x, x)) != x:
            self.parents[x] = self.parents.get(up, up)
            x = up
        return x

    def compare(self, doc_id: int, component: int, s: np.ndarray) -> list[tuple[int, int]]:
        if self.tokens is None:
            tokens = np.concatenate([p.tokens for p in self.prefixes])
            owners = np.repeat(np.arange(len(self.ids)), [len(p.tokens) for p in self.prefixes])
            order = np.argsort(tokens, kind="stable")
            self.tokens, self.owners = tokens[order], owners[order]
            self.sizes = np.array([len(x) for x in self.sets])
            self.matches = np.array([p.matches for p in self.prefixes])
        p = lengthened(s, self.hot, self.percent)
        low, high = np.searchsorted(self.tokens, p.tokens, "left"), np.searchsorted(self.tokens, p.tokens, "right")
        runs = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.ids))
        fit = 100 * np.minimum(self.sizes, len(s)) >= self.percent * np.maximum(self.sizes, len(s))
        found = np.flatnonzero((shared >= np.minimum(self.matches, p.matches)) & fit)
        links = []
        for i in found[np.argsort(-shared[found], kind="stable")].tolist():
            mine, theirs = self._root(self.components[i]), self._root(component)
            if mine != theirs and _similar(self.sets[i], s, self.percent):
                self.parents[mine] = theirs
                links.append((min(self.ids[i], doc_id), max(self.ids[i], doc_id)))
        return links


def _hot(tokens: DataFrame, known):
    """Broadcast of the sorted hot tokens and their counts, together with those known."""
    counts = common.stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT), "hot")
    limit = HOT
    while counts.filter(F.col("n") > limit).count() > HOT_TOKENS:
        limit *= 2
    rows = counts.filter(F.col("n") > limit).toArrow()  # at most HOT_TOKENS
    found, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    if known is not None:
        found, n = np.concatenate([found, known.value[0]]), np.concatenate([n, known.value[1]])
        found, first = np.unique(found, return_index=True)
        n = n[first]
    order = np.argsort(found)
    return tokens.sparkSession.sparkContext.broadcast((found[order], n[order]))


def copy_ids(members: DataFrame) -> DataFrame:
    """Ids all of whose rows are copies of what another id stands for."""
    ids = members.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce(F.col("rep") != F.col("doc_id"), F.lit(False))).alias("copy"))
    return ids.filter("copy AND id IS NOT NULL").select("id")


def near_duplicate_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    sets = common.stage(_sets(docs, k), "sets")
    classes = sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("m")
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    members = common.stage(salted.join(classes, ["d1", "d2", "salt"], "left").select("doc_id", "n", "rep"), "members")

    reps = _picked(docs, copy_ids(members), "left_anti").filter("doc_id IS NOT NULL")

    hot = _hot(_prefix_tokens(reps, k, percent), None)
    hot = _hot(_suspect_tokens(reps, hot, k, percent), hot)
    common.free(docs.sparkSession)

    found = common.stage(_lists(_index(reps, hot, k, percent), percent), "lists")
    common.free(docs.sparkSession)
    whole = common.stage(_whole_lists(found, percent), "whole")
    near = found.filter("kind = 0").select("a", "b").unionByName(whole.filter("kind = 0").select("a", "b"))
    links = _verified(near.distinct(), reps, hot, k, percent)
    common.free(docs.sparkSession)
    long = common.stage(_long_lists(found.filter("kind = 1").select("a", "token", "n", "hot", "is_hot"), percent), "long")
    if not long.isEmpty():
        links = links.unionByName(_verified(_star(long, _centres(long, 0), percent), reps, hot, k, percent))
    lists = long.unionByName(whole.filter("kind = 1").drop("kind", "b"))
    labels = connected_components(links)
    for turn in range(1, STAR_ROUNDS):
        common.free(docs.sparkSession)
        rest = _open_lists(lists, labels)
        if rest.isEmpty():
            break
        star = _star(rest.filter("component <> top").drop("component", "top"), _centres(rest.filter("component = top"), turn), percent)
        links = links.unionByName(_verified(star, reps, hot, k, percent))
        labels = connected_components(links)
    common.free(docs.sparkSession)
    rest = _open_lists(lists, labels)
    if not rest.isEmpty():
        labels = connected_components(links.unionByName(_block_links(rest, reps, hot, k, percent)))

    of_class = classes.join(labels, classes["rep"] == labels["id"], "left").select("rep", F.coalesce("component", "rep").alias("of_class")).distinct()
    of_class = of_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(of_class, ["rep", "salt"], "left")
    joined = joined.join(labels, joined["doc_id"] == labels["id"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("of_class", "component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, that of the smallest id, with all columns; null ids stay."""
    classes = near_duplicate_classes(docs, k, percent)
    gone = common.stage(classes.filter("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    return _picked(docs, gone, "left_anti")
