"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each document that passes the fixed limits has a vector of four transformed statistics. Per (language, source) the
minimum-covariance-determinant estimate is searched: among subsets of the share COVERAGE of the documents, the one whose
covariance has the least determinant. The search starts from the coordinate medians and from STARTS - 1 seeded documents;
concentration steps (distances from the current centre and covariance, the nearest share of the documents, their mean and
covariance) lower the determinant each time. After FIRST_STEPS of them the BEST starts of a group go on until none of
their determinants falls any more, and the least one is the group's estimate. A document whose squared Mahalanobis
distance from it exceeds the chi-square quantile is rejected.

Covariances are regularized by a fixed diagonal target (FLOORS), each statistic's measure of what differences are of no
interest: a statistic that is nearly always 0 would else make every determinant 0, and condemn the first that isn't.

The vectors are whole numbers of small steps (STEPS), so documents are first counted by (group, vector): the estimate
is of those counts, exact over all documents, and its size is bounded by the grid and not by the documents. Each step is
an aggregation with partial sums, so a group with a third of all rows is dealt over all tasks. Groups of fewer than
MIN_GROUP documents, too few for a covariance of that many statistics, are pooled by language, and what is still small
over all languages. Only DataFrame functions are used.

Defined results: null or empty text has no words and fails the fixed limits; null language or source is a group of its
own; rows that repeat count each; an empty table gives an empty result; further columns are ignored by
:func:`quality_verdicts` and carried by :func:`keep_quality`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Grid steps of the vector: log word length, log1p symbols per 100 words, share of repeated lines, of repeated words.
STEPS = (0.02, 0.1, 0.02, 0.02)
#: Standard deviations, in the statistics' units, below which differences say nothing.
FLOORS = (0.10, 0.45, 0.12, 0.12)
COVERAGE = 0.75
STARTS, FIRST_STEPS, BEST = 6, 2, 2
#: Determinants that fall by less than this share have settled; steps after which a search ends in any case.
SETTLED, LAST_STEP = 1e-9, 50
REJECT_SHARE = 1e-5
P = 4
#: The usual least number of documents for an estimate of this kind: five a statistic.
MIN_GROUP = 5 * P


def _chi2_4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def _chi2_6(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def _quantile(p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_4(mid) < p else (low, mid)
    return low


#: Makes the covariance of the nearest COVERAGE consistent for normal data.
CONSISTENCY = COVERAGE / _chi2_6(_quantile(COVERAGE))
CUTOFF = _quantile(1 - REJECT_SHARE)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__q``, a struct of counts per text, computed row by row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD))
    rows = docs.withColumn("__w", words).withColumn("__l", lines)
    # words of each window of three, joined: a window that comes twice lies beside its like when sorted
    triples = F.when(
        F.size("__w") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("__w") - 3),
            lambda i: F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__t", triples)
    twice = F.size("__t") > F.size(F.array_distinct("__t"))
    placed = F.array_sort(F.transform("__t", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    rows = rows.withColumn("__s", F.when(twice, placed))
    hits = F.filter(
        F.transform(
            "__s",
            lambda x, k: F.when((F.get("__s", k - 1)["t"] == x["t"]) | (F.get("__s", k + 1)["t"] == x["t"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))
    counts = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate(text, common.SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(twice, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    # a generator of one row: the optimizer would else copy these expressions into everything that uses them
    return rows.select(*docs.columns, F.explode(F.array(counts)).alias("__q"))


def _failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def _vector(q: str) -> list[Column]:
    """The statistics in grid steps, as whole numbers; documents without words have zeros."""
    n = F.greatest(F.col(f"{q}.n_words"), F.lit(1))
    raw = (
        F.log(F.greatest(F.col(f"{q}.word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col(f"{q}.n_symbols") / n),
        F.col(f"{q}.n_dup_lines") / F.greatest(F.col(f"{q}.n_lines"), F.lit(1)),
        F.col(f"{q}.n_repeat_words") / n,
    )
    return [F.round(x / step).cast("long").alias(f"x{i}") for i, (x, step) in enumerate(zip(raw, STEPS, strict=True))]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _with_factors(rows: DataFrame) -> DataFrame:
    """Cholesky factors l<i><j> of the covariance c<i><j>."""
    for i, j in _pairs():  # row by row, each entry needs those before it
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return rows


def _with_distance(rows: DataFrame, out: str) -> DataFrame:
    """Squared Mahalanobis distance of x0.. from centre m0.. by the factors."""
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    rows = rows.withColumn(out, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    return rows.drop(*[f"z{i}" for i in range(P)])


KEYS = ["pool", "g_lang", "g_source"]
VECTOR = [f"x{i}" for i in range(P)]
ESTIMATE = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in _pairs()]
TARGET = [(f / s) ** 2 for f, s in zip(FLOORS, STEPS, strict=True)]


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of the group that an estimate is made of."""
    lang = F.when(F.col("pool") < 2, F.col("lang"))
    return rows.withColumn("g_lang", lang).withColumn("g_source", F.when(F.col("pool") == 0, F.col("source")))


def _starts(cells: DataFrame) -> DataFrame:
    """First estimates by group and start: medians, then seeded documents, all with the target as covariance."""
    medians = F.struct(*[F.percentile(x, 0.5, F.col("n")).cast("double").alias(f"m{i}") for i, x in enumerate(VECTOR)])
    vector = F.struct(*[F.col(x).cast("double").alias(f"m{i}") for i, x in enumerate(VECTOR)])
    made = [medians]
    for s in range(1, STARTS):  # a cell of n documents is as likely as n cells of one
        share = (F.pmod(F.xxhash64(*VECTOR, F.lit(s)), F.lit(1 << 30)) + 1) / (1 << 30)
        made.append(F.max_by(vector, F.log(share) / F.col("n")))
    rows = cells.groupBy(*KEYS).agg(F.array(*made).alias("made")).select(*KEYS, F.posexplode("made").alias("start", "m")).select(*KEYS, "start", "m.*")
    rows = rows.withColumns({f"c{i}{j}": F.lit(TARGET[i] if i == j else 0.0) for i, j in _pairs()})
    return common.stage(rows.withColumn("det", F.lit(float("inf"))).withColumn("moving", F.lit(True)), "starts")


def _step(cells: DataFrame, current: DataFrame) -> DataFrame:
    """A concentration step of every start: the estimate of the nearest documents, its determinant, whether it fell."""
    joined = common.lookup_join(cells, _with_factors(current).drop(*ESTIMATE[P:]), KEYS, F.col("x0"), "inner")
    near = common.stage(_with_distance(joined, "d2").select(*KEYS, "start", *VECTOR, "n", "d2"), "distances")
    limits = near.groupBy(*KEYS, "start").agg(F.percentile("d2", COVERAGE, F.col("n")).alias("limit"))
    near = common.lookup_join(near, common.stage(limits, "limits"), [*KEYS, "start"], F.col("x0"), "inner").filter("d2 <= limit")
    total = F.sum("n")
    sums = {f"m{i}": F.sum(F.col("n") * F.col(f"x{i}")) / total for i in range(P)}
    sums |= {f"c{i}{j}": F.sum(F.col("n") * F.col(f"x{i}") * F.col(f"x{j}")) / total for i, j in _pairs()}
    found = near.groupBy(*KEYS, "start").agg(*[x.alias(k) for k, x in sums.items()])
    raw = {f"c{i}{j}": (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(CONSISTENCY) + F.lit(TARGET[i] if i == j else 0.0) for i, j in _pairs()}
    found = _with_factors(found.withColumns(raw))
    for i in range(P):
        found = found.withColumn("det", F.col(f"l{i}{i}") * F.col(f"l{i}{i}") * (F.col("det") if i else F.lit(1.0)))
    old = current.select(*KEYS, "start", F.col("det").alias("old"))
    found = common.lookup_join(found.select(*KEYS, "start", *ESTIMATE, "det"), old, [*KEYS, "start"], F.col("start"), "inner")
    return common.stage(found.withColumn("moving", F.col("det") < F.col("old") * (1 - SETTLED)).drop("old"), "step")


def least_determinants(cells: DataFrame) -> DataFrame:
    """Per group ``pool, g_lang, g_source`` of counted vectors (n): the estimate of the least determinant found."""
    order = Window.partitionBy(*KEYS).orderBy("det", "start")  # a row for each start
    current = _starts(cells)
    for _ in range(FIRST_STEPS):
        current = _step(cells, current)
    current = common.stage(current.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= BEST).drop("r"), "best")
    found, turn = [], 0
    while not current.isEmpty() and turn < LAST_STEP:
        stepped = _step(cells, current)
        found.append(stepped.filter("NOT moving"))
        current = stepped.filter("moving")
        turn += 1
    found.append(current)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "start", "moving")


def estimates(cells: DataFrame) -> DataFrame:
    """One row per group ``lang, source`` with m0.., the factors l00.. and ``det``; ``cells`` has the counts n."""
    per = cells.groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    pooled = per.filter(F.col("docs") < MIN_GROUP).groupBy("lang").agg(F.sum("docs").alias("pooled"))
    per = common.lookup_join(per, common.stage(pooled, "pools"), ["lang"], F.col("source"))
    pool = F.when(F.col("docs") >= MIN_GROUP, 0).when(F.col("pooled") >= MIN_GROUP, 1).otherwise(2)
    per = common.stage(_keyed(per.select("lang", "source", pool.alias("pool"))), "groups")
    rows = common.lookup_join(cells, per, ["lang", "source"], F.col("x0"))
    rows = common.stage(rows.groupBy(*KEYS, *VECTOR).agg(F.sum("n").alias("n")), "grouped")
    keep = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in _pairs()]
    found = common.stage(_with_factors(least_determinants(rows)).select(*KEYS, *keep, "det"), "estimates")
    return common.lookup_join(per, found, KEYS, F.col("source")).select("lang", "source", *keep, "det")


def _judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows with lang, source and __q."""
    rows = rows.withColumn("base_failed", _failed(F.col("__q.n_words"), F.col("__q.n_repeat_words")))
    rows = rows.withColumns({f"x{i}": x for i, x in enumerate(_vector("__q"))})
    rows = _with_distance(common.lookup_join(rows, found.drop("det"), ["lang", "source"], F.col("__q.word_chars")), "distance2")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= CUTOFF))


def _fit(stats: DataFrame) -> DataFrame:
    good = stats.filter(~_failed(F.col("__q.n_words"), F.col("__q.n_repeat_words")))
    cells = good.select("lang", "source", *_vector("__q")).groupBy("lang", "source", *[f"x{i}" for i in range(P)]).agg(F.count(F.lit(1)).alias("n"))
    return common.stage(estimates(common.stage(cells, "cells")), "fitted")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the counts and ``base_failed``, what the fixed limits say."""
    stats = text_statistics(docs.select("doc_id", "text"))
    return stats.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in COUNTS], _failed(F.col("__q.n_words"), F.col("__q.n_repeat_words")).alias("base_failed"))


#: The same rows in DuckDB's SQL, for distinct doc_ids.
BASE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q"""


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed, kept`` and ``distance2``."""
    stats = text_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text")
    stats = common.stage(stats, "statistics")
    judged = _judged(stats, _fit(stats))
    return judged.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in COUNTS], "base_failed", "kept", "distance2")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; the counts are written beside them, so texts are read once."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    # own names, so that columns of the documents cannot clash with those of the estimate
    rows = docs.toDF(*names).withColumns({c: F.col(names[docs.columns.index(c)]) for c in ("lang", "source", "text")})
    rows = common.stage(text_statistics(rows).drop("text"), "counted")
    found = _fit(rows.select("lang", "source", "__q"))
    return _judged(rows, found).filter("kept").select(*names).toDF(*docs.columns)
