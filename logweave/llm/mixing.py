"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its weight's share of the mix, at most ``max_repeats`` times its size. The mix is counted in blocks
of ``block_words`` words: the blocks go to sources by highest quotients target / (2k + 1), each source's blocks go to
its shards by highest quotients words / (2k + 1), and a shard of n blocks with quota q takes all of its blocks q div n
times and, once more, a run of q mod n blocks that starts at a seeded place. Documents lie in a shard in seeded order
(by hash), so the run is a random sample of them. Only DataFrame functions are used.

Shards bound every window: a shard has SHARD_WORDS words, or, in sources so large that their shards would be many, some
multiple (SHARD_ROOT) of the square root of the source's words, so that neither a shard's documents nor a source's shards
are more than a task sorts. A shard's window holds three numbers a document. Sources and shards are small tables; documents find their source by a checked broadcast or a salted
join (``common.lookup_join``).

Defined results: null text has 0 words; a null source is a source of its own, ranked last; sources without words have
target 0; repeated rows count each; an empty table gives an empty result; further columns are ignored by
:func:`mix_plan` and carried by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 17
SHARD_ROOT = 8
SEED = "mix-1"

_ALL_BEFORE = (Window.unboundedPreceding, -1)


def _number(hexed: Column) -> Column:
    """A whole number of 8 hexadecimal digits."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """One row per source: ``source, source_size, rank, weight, target``; windows run over sources, not documents."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    rows = per_source.withColumn("rank", rank).withColumn("weight", weight.cast("double"))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(repeats)))
    # sources by limit per weight: those before the first that can hold its share are full
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("limit").over(order.rowsBetween(*_ALL_BEFORE)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.col("full")) / F.col("rest")
    rows = rows.withColumn("level", level)
    open_level = F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * open_level, F.col("limit")))
    return rows.select("source", "source_size", "rank", "weight", target.alias("target"))


def _seats(rows: DataFrame, group: list[str], votes: str, seats: Column, slack: Column, tie: str, out: str) -> DataFrame:
    """Sainte-Lague: ``seats`` of each group to its rows by highest quotients votes / (2k + 1).

    Rounding votes * seats / all votes misses the number of seats by some d; no row's seats are then further than
    ``slack`` = |d| from the rounded ones, so only quotients in that range are ranked.
    """
    keys = [*group, tie]
    low = F.greatest(F.col("__even") - slack, F.lit(0))
    near = rows.withColumn("__low", low).withColumn("__k", F.explode(F.sequence(F.col("__low"), F.col("__even") + slack)))
    near = near.withColumn("__q", F.col(votes) / (2 * F.col("__k") + 1))
    quotients = Window.partitionBy(*group).orderBy(F.col("__q").desc(), tie, "__k")
    nth = F.row_number().over(quotients)
    near = near.withColumn("__nth", nth).withColumn("__open", seats - F.col("__lows"))
    won = near.groupBy(*keys).agg((F.first("__low") + F.sum((F.col("__nth") <= F.col("__open")).cast("long"))).alias(out))
    return won


def _apportion(rows: DataFrame, group: list[str], votes: str, seats: Column, tie: str, out: str) -> DataFrame:
    """``rows`` with their seats in column ``out``; rows without votes get none."""
    whole = Window.partitionBy(*group)
    total = F.sum(votes).over(whole)
    voted = rows.filter(F.col(votes) > 0).withColumn("__seats", seats)
    voted = voted.withColumn("__even", F.floor(F.col(votes) * F.col("__seats") / total + 0.5).cast("long"))
    voted = voted.withColumn("__slack", F.abs(F.col("__seats") - F.sum("__even").over(whole)) + 1)
    voted = voted.withColumn("__lows", F.sum(F.greatest(F.col("__even") - F.col("__slack"), F.lit(0))).over(whole))
    won = _seats(voted, group, votes, F.col("__seats"), F.col("__slack"), tie, out)
    renamed = won.select(*[F.col(k).alias(f"__{k}") for k in [*group, tie]], out)
    on = [rows[k].eqNullSafe(renamed[f"__{k}"]) for k in [*group, tie]]
    joined = rows.join(renamed, on, "left").drop(*[f"__{k}" for k in [*group, tie]])
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = MIX_SHARE,
    repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, passes, parts, n_copy, hash``.

    The mix takes the document's words ``passes`` times whole, and once more those in the word ranges ``parts``.
    ``hash`` (of text and source) and ``n_copy`` (among rows equal in all of these) tell rows of one ``doc_id`` apart.
    """
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(
        F.col("doc_id"),
        F.col("source"),
        common.word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("at"),
        F.xxhash64(text, F.coalesce("source", F.lit(""))).alias("hash"),
    )
    sizes = common.stage(sizes, "sizes")
    targets = source_targets(sizes, weights, share, repeats)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    sources = _apportion(targets.withColumn("__one", F.lit(1)), ["__one"], "target", blocks, "rank", "quota").drop("__one")
    sources = common.stage(sources, "sources")

    shard_words = F.greatest(F.lit(float(SHARD_WORDS)), SHARD_ROOT * F.sqrt("source_size"))
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int")
    rows = common.lookup_join(sizes, sources.select("source", "source_size", "rank", "target", n_shards.alias("n_shards")), ["source"], F.col("doc_id"))
    rows = rows.withColumn("shard", F.pmod(_number(F.col("at")), F.col("n_shards")).cast("int"))

    shards = rows.groupBy("rank", "shard").agg(F.sum("size").alias("words"))
    shards = shards.join(sources.select("rank", "quota"), "rank")
    shards = _apportion(shards, ["rank"], "words", F.col("quota"), "shard", "seats")
    n = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block_words))).otherwise(0).cast("long")
    shards = shards.withColumn("n", n).withColumn("seats", F.least("seats", F.col("n") * repeats))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("rank"), F.col("shard")))
    shards = shards.select(
        "rank", "shard",
        F.when(F.col("n") > 0, F.floor(F.col("seats") / F.col("n"))).otherwise(0).cast("long").alias("passes"),
        F.expr("if(n > 0, seats % n, 0)").alias("more"),
        F.when(F.col("n") > 0, F.pmod(_number(place), F.col("n"))).otherwise(0).cast("long").alias("first"),
        "n", "words",
    )
    # the run of blocks, as one or two ranges of the shard's words; block b begins at word b * words div n
    shards = shards.selectExpr(
        "rank AS s_rank", "shard AS s_shard", "passes",
        "if(n > 0, (first * words) div n, 0) AS a1",
        "if(n > 0, (least(first + more, n) * words) div n, 0) AS b1",
        "if(n > 0, (greatest(first + more - n, 0) * words) div n, 0) AS b2",
    )

    order = Window.partitionBy("rank", "shard").orderBy("at", "size", "hash").rowsBetween(*_ALL_BEFORE)
    rows = rows.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = rows.join(shards, (F.col("rank") == F.col("s_rank")) & (F.col("shard") == F.col("s_shard")))

    def part(low: Column, high: Column) -> Column:
        start = F.least(F.greatest(low - F.col("begin"), F.lit(0)), F.col("size"))
        end = F.least(F.greatest(high - F.col("begin"), F.lit(0)), F.col("size"))
        return F.struct(start.cast("long").alias("start"), F.greatest(start, end).cast("long").alias("end"))

    parts = F.filter(F.array(part(F.lit(0), F.col("b2")), part(F.col("a1"), F.col("b1"))), lambda p: p["end"] > p["start"])
    rows = rows.withColumn("parts", parts)
    extra = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + extra)
    nth = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("begin"))
    return rows.withColumn("n_copy", nth).select("doc_id", "size", "source_size", "target", "taken", "passes", "parts", "n_copy", "hash")


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each whole pass is a row, and the parts of a further pass are one row with those words."""
    plan = mix_plan(docs, **settings).filter("taken > 0")
    plan = plan.select(F.col("doc_id").alias("of_id"), F.col("hash").alias("of_hash"), F.col("n_copy").alias("of_copy"), "passes", "parts")
    # own names, so that columns of the documents cannot clash with those made here
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, source, text = (names[docs.columns.index(c)] for c in ("doc_id", "source", "text"))
    marked = docs.toDF(*names).withColumn("hash", F.xxhash64(F.coalesce(text, F.lit("")), F.coalesce(source, F.lit(""))))
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy(doc_id, "hash").orderBy(text)))
    joined = marked.join(plan, marked[doc_id].eqNullSafe(plan["of_id"]) & (marked["hash"] == plan["of_hash"]) & (marked["nth"] == plan["of_copy"]))
    words = F.regexp_extract_all(text, F.lit(common.WORD + common.SPACE + "*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))), "")
    texts = F.concat(F.array_repeat(F.col(text), F.col("passes").cast("int")), F.when(F.size("parts") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    rows = joined.withColumn("mixed", F.explode(texts))
    return rows.select(*[F.col("mixed").alias(c) if c == text else F.col(c) for c in names]).toDF(*docs.columns)


MIX_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS spot
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM sizes GROUP BY source),
limits AS (
  SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM per_source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM limits),
targets AS (
  SELECT source, source_size, rank,
         least(most, coalesce(weight * max(CASE WHEN level <= most / weight THEN level END) OVER (), most))::DOUBLE AS target
  FROM levels),
seats0 AS (
  SELECT *, round(sum(target) OVER () / {BLOCK_WORDS})::BIGINT AS seats, sum(target) OVER () AS votes FROM targets),
seats1 AS (SELECT *, floor(target * seats / votes + 0.5)::BIGINT AS even FROM seats0 WHERE target > 0),
seats2 AS (SELECT *, abs(seats - sum(even) OVER ())::BIGINT + 1 AS slack FROM seats1),
seats3 AS (SELECT *, greatest(even - slack, 0) AS low FROM seats2),
seats4 AS (
  SELECT rank, low, seats, target, unnest(range(low, even + slack + 1)) AS k, (SELECT sum(low) FROM seats3) AS lows FROM seats3),
seats5 AS (
  SELECT rank, low, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) <= seats - lows AS won FROM seats4),
quotas AS (SELECT rank, any_value(low) + count(*) FILTER (WHERE won) AS quota FROM seats5 GROUP BY rank),
sources AS (
  SELECT t.*, coalesce(q.quota, 0) AS quota,
         greatest(1, ceil(source_size / greatest({SHARD_WORDS}::DOUBLE, {SHARD_ROOT} * sqrt(source_size))))::INT AS n_shards
  FROM targets t LEFT JOIN quotas q USING (rank)),
dealt AS (
  SELECT z.doc_id, z.size, z.spot, s.source_size, s.rank, s.target, s.quota,
         ('0x' || z.spot[1:8])::BIGINT % s.n_shards AS shard
  FROM sizes z JOIN sources s ON z.source IS NOT DISTINCT FROM s.source),
shards AS (SELECT rank, shard, any_value(quota) AS quota, sum(size)::BIGINT AS words FROM dealt GROUP BY rank, shard),
even1 AS (
  SELECT *, floor(words::DOUBLE * quota / sum(words) OVER (PARTITION BY rank) + 0.5)::BIGINT AS even FROM shards WHERE words > 0),
even2 AS (SELECT *, abs(quota - sum(even) OVER (PARTITION BY rank))::BIGINT + 1 AS slack FROM even1),
even3 AS (SELECT *, greatest(even - slack, 0) AS low FROM even2),
even4 AS (
  SELECT *, sum(low) OVER (PARTITION BY rank) AS lows FROM even3),
even5 AS (SELECT *, unnest(range(low, even + slack + 1)) AS k FROM even4),
even6 AS (
  SELECT rank, shard, low,
         row_number() OVER (PARTITION BY rank ORDER BY words / (2 * k + 1) DESC, shard, k) <= quota - lows AS won FROM even5),
won AS (SELECT rank, shard, any_value(low) + count(*) FILTER (WHERE won) AS seats FROM even6 GROUP BY rank, shard),
runs0 AS (
  SELECT s.rank, s.shard, s.words, coalesce(w.seats, 0) AS seats,
         CASE WHEN s.words > 0 THEN greatest(1, round(s.words / {BLOCK_WORDS}))::BIGINT ELSE 0 END AS n
  FROM shards s LEFT JOIN won w USING (rank, shard)),
runs1 AS (
  SELECT rank, shard, words, n, least(seats, 2 * n) AS seats,
         CASE WHEN n > 0 THEN ('0x' || md5('{SEED}:' || rank || ':' || shard)[1:8])::BIGINT % n ELSE 0 END AS begin_block FROM runs0),
runs AS (
  SELECT rank, shard, CASE WHEN n > 0 THEN seats // n ELSE 0 END AS passes,
         CASE WHEN n > 0 THEN begin_block * words // n ELSE 0 END AS a1,
         CASE WHEN n > 0 THEN least(begin_block + seats % n, n) * words // n ELSE 0 END AS b1,
         CASE WHEN n > 0 THEN greatest(begin_block + seats % n - n, 0) * words // n ELSE 0 END AS b2
  FROM runs1),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY spot, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM dealt)
SELECT doc_id, size, source_size, target,
       (passes * size
        + greatest(0, least(b2, begins + size) - begins)
        + greatest(0, least(b1, begins + size) - greatest(a1, begins)))::BIGINT AS taken
FROM placed JOIN runs USING (rank, shard)
"""
