"""Queries over text sources, collectors, resumed and streamed runs, and sinks, with the SQL that gives the same rows.

Their input is derived from the given tables and written to the shared folder first: lines of text, batches, stream files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import parse_time
from .operators import correlate as C
from .operators import extract as E
from .operators import ordering as O
from .operators import sinks
from .operators import tables as T
from .operators import versions as V
from .plans.rules import Attribute, FiberType, Pattern, Rules, Source
from .plans.storage import shared_dir, stage
from .queries import _BOTH, _EPOCHS, _FM, _L, _P, _READY, _SET, _USER, ERROR, SESSION, SOURCES, _fibers, _type, _versions, _wanted, logs_of, ordered_logs, query, session_tables, table
from .sources import lines as S
from .streaming import keyed, streams


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the session's file systems close."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


# text sources

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
_PATTERN = r"^(?P<ts>\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+Z)"
#: The text of an event as a log file has it: errors have a second, indented line, signups an unusable one.
_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || raw_text"
_MORE = "CASE source_id WHEN 'error' THEN chr(10) || '  at k=' || k ELSE '' END"
_F = _L + f", t AS (SELECT *, {_TEXT} AS line, {_MORE} AS more FROM l)"


def _sources(root: str) -> list[Source]:
    return [Source(s, f"{root}/source={s}", _PATTERN) for s in SOURCES]


def text_files(spark: SparkSession, d: str) -> list[Source]:
    """The events as log files, one for each source and day, in order of time."""
    rows = logs_of(spark, d).withColumn("k", F.regexp_extract("raw_text", r"k=(\d+)$", 1))
    more = F.when(F.col("source_id") == "error", F.concat(F.lit("\n  at k="), "k")).when(F.col("source_id") == "signup", F.lit("\n??? \r")).otherwise("")
    value = F.concat(F.date_format("ts", _ISO), F.lit(" "), "raw_text", more)
    rows = rows.select(F.col("source_id").alias("source"), F.to_date("ts").alias("day"), "ts", value.alias("value"))
    root = _folder(spark, "text")
    rows.repartition("source", "day").sortWithinPartitions("source", "day", "ts").drop("ts").write.partitionBy("source", "day").text(root)
    return _sources(root)


@query(_F + " SELECT source_id, ts, line || more AS raw_text, CASE source_id WHEN 'error' THEN 2 ELSE 1 END AS n_lines FROM t")
def text_records(spark, d):
    """Lines to records: times found, indented lines joined, unusable ones dropped."""
    return S.logs_from(spark, text_files(spark, d)).select("source_id", "ts", "raw_text", "n_lines")


@query(_F + " SELECT source_id, count(*) AS n_logs, count(*) AS n_ids FROM t GROUP BY source_id")
def text_log_ids(spark, d):
    """Ids by place: the same bytes read twice have the same ids, and no two records one."""
    sources = text_files(spark, d)
    twice = S.logs_from(spark, sources).unionByName(S.logs_from(spark, sources))
    return twice.groupBy("source_id").agg((F.count(F.lit(1)) / 2).cast("long").alias("n_logs"), F.countDistinct("log_id").alias("n_ids"))


@query(_F + " SELECT source_id, '???' AS value, count(*) AS n FROM t WHERE source_id = 'signup' GROUP BY source_id")
def text_rejects(spark, d):
    sources = text_files(spark, d)
    rows = S.rejected_lines(S.with_timestamp(S.read_lines(spark, sources), sources))
    return rows.groupBy("source_id", F.trim("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(_F + " SELECT source_id, source_id = 'signup' AS failed FROM t GROUP BY source_id")
def text_failures(spark, d):
    """Reading that fails at the first unusable line: whether it does, source by source."""
    told = []
    for s in text_files(spark, d):
        try:
            S.logs_from(spark, [s], on_error="fail").write.format("noop").mode("overwrite").save()
            told.append((s.source_id, False))
        except Exception as e:  # noqa: BLE001  the engine wraps what the query raises
            if "unusable line" not in str(e):
                raise
            told.append((s.source_id, True))
    return spark.createDataFrame(told, "source_id string, failed boolean")


@query(_EPOCHS + ", n AS (SELECT *, ceil(n_logs / 7.0)::INT AS n_parts FROM b), p AS (SELECT epoch_start, n_parts, n_logs, unnest(range(n_parts)) AS part FROM n) SELECT epoch_start, part::INT AS part, n_parts, least(7, n_logs - 7 * part) AS n_logs, row_number() OVER (ORDER BY epoch_start, part) - 1 AS sequence_num FROM p")
def epoch_parts(spark, d):
    """Nested epochs of more logs than a batch may hold, in parts."""
    found = O.epochs(logs_of(spark, d), 6 * 3600, max_logs=7)
    return found.select("epoch_start", "part", "n_parts", F.size("logs").cast("long").alias("n_logs"), "sequence_num")


_BYTES = "strlen(line) + 1 + strlen(more) + CASE source_id WHEN 'signup' THEN 6 ELSE 0 END"


@query(_F + f" SELECT source_id, ts::DATE AS day, sum({_BYTES})::BIGINT AS end_offset FROM t GROUP BY ALL")
def text_offsets(spark, d):
    """Where reading goes on: the end of the last line of every file."""
    found = S.source_offsets(S.read_lines(spark, text_files(spark, d)))
    return found.select("source_id", F.regexp_extract("file_path", r"day=([\d-]+)", 1).cast("date").alias("day"), "end_offset")


@query(_F + " , n AS (SELECT source_id, ts::DATE AS day, sum(CASE WHEN source_id IN ('error', 'signup') THEN 2 ELSE 1 END)::BIGINT - 3 AS n_lines FROM t GROUP BY ALL) SELECT * FROM n WHERE n_lines > 0")
def text_from_stored_offset(spark, d):
    """Reading goes on behind the third line of every file."""
    lines = stage(S.read_lines(spark, text_files(spark, d)), "lines")
    rest = S.from_position(lines, "stored_offset", S.source_offsets(lines.filter("line_ord < 3")))
    return rest.groupBy("source_id", F.regexp_extract("file_path", r"day=([\d-]+)", 1).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n_lines"))


@query(_F + " SELECT source_id, count(*) * CASE WHEN source_id IN ('error', 'signup') THEN 2 ELSE 1 END AS n_lines, 0 AS candidate, count(*) AS matched, count(*) AS parsed FROM t GROUP BY source_id UNION ALL SELECT source_id, count(*) * CASE WHEN source_id IN ('error', 'signup') THEN 2 ELSE 1 END, 1, count(*), 0 FROM t GROUP BY source_id")
def text_time_profile(spark, d):
    lines = S.read_lines(spark, text_files(spark, d))
    return S.profile_timestamps(lines, [(_PATTERN, "iso8601"), (r"user=(?P<ts>\d+) ", "%Y-%m-%d")])


@query(_L + " SELECT log_id, '7' AS ruleset_version, true AS stamped FROM l")
def ingestion_stamps(spark, d):
    return S.stamp_ingestion(logs_of(spark, d), "7").select("log_id", "ruleset_version", F.col("ingestion_time").isNotNull().alias("stamped"))


@query("SELECT event_id AS log_id, date_trunc('millisecond', ts)::TIMESTAMP AS ts FROM events")
def parse_epoch_millis(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("log_id"), parse_time(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), "epoch_ms").alias("ts"))


# collectors

_ARRIVAL = "(log_id // 7) * 7 + (6 - log_id % 7)"
_START = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')"


@query(_L + f", a AS (SELECT max({_START}) OVER (ORDER BY {_ARRIVAL}) AS epoch_start FROM l) SELECT epoch_start, count(*) AS n_logs FROM a GROUP BY 1")
def epochs_of_arrival(spark, d):
    """A log that comes late falls into the epoch that has begun."""
    arrival = (F.floor(F.col("log_id") / 7) * 7 + (6 - F.col("log_id") % 7)).cast("long")
    return O.epochs(logs_of(spark, d).withColumn("arrival", arrival), 6 * 3600, late="current", arrival="arrival", with_logs=False).select("epoch_start", "n_logs")


@query(_EPOCHS + ", m AS (SELECT max(ts) AS m FROM l) SELECT sequence_num, CASE WHEN sequence_num = (SELECT max(sequence_num) FROM b) THEN m ELSE epoch_end END AS watermark FROM b, m")
def epoch_watermarks(spark, d):
    logs = logs_of(spark, d)
    last = logs.agg(F.max("ts")).first()[0]
    return O.epochs(logs, 6 * 3600, watermark=F.lit(last), with_logs=False).select("sequence_num", "watermark")


def _batches(spark, d) -> DataFrame:
    """The logs as two collectors hand them on, in nested batches. The second one was rewound: it sent its first batches
    again under a new generation."""
    logs = logs_of(spark, d).withColumn("log_id", F.col("log_id").cast("string")).withColumns({"file_path": F.lit("f"), "line_ord": F.col("log_id").cast("long"), "file_offset": F.lit(0).cast("long")})
    logs = logs.select("log_id", "ts", "source_id", "raw_text", "file_path", "line_ord", "file_offset")
    ours = F.col("source_id").isin("click", "error")
    batches = [O.epochs(logs.filter(x), 24 * 3600, c) for c, x in (("c1", ours), ("c2", ~ours))]
    both = batches[0].withColumn("generation", F.lit(0).cast("long")).unionByName(batches[1].withColumn("generation", F.lit(0).cast("long")))
    both = both.unionByName(batches[1].filter("sequence_num < 5").withColumn("generation", F.lit(1).cast("long")))
    epoch = F.struct(F.col("epoch_start").alias("start"), F.col("epoch_end").alias("end"), "watermark", "generation")
    return both.select(F.concat_ws("-", "collector_id", "generation", "sequence_num").alias("batch_id"), "collector_id", epoch.alias("epoch"), "logs", F.lit(1).cast("long").alias("config_version"), "sequence_num")


def _collected(spark, d) -> DataFrame:
    path = _folder(spark, "batches")
    S.write_batches(_batches(spark, d), path)
    return S.read_batches(spark, path)


#: Logs of batches that a task sorts into one file.
BATCH_LOGS = 500_000


def _batch_files(spark, d, collector: str | None = None) -> str:
    """Batches as files that came one after another, each of some epochs; those of the rewound collector last. With all
    collectors these are several files each where they hold many logs, of whole batches."""
    path, rows = _folder(spark, "batches"), stage(_batches(spark, d), "batches")
    if collector:
        rows = rows.filter(F.col("collector_id") == collector)
    for part in ("epoch.generation = 0 AND sequence_num < 10", "epoch.generation = 0 AND sequence_num >= 10", "epoch.generation = 1"):
        rows_of = rows.filter(part)
        files = 1 if collector else -(-(rows_of.agg(F.sum(F.size("logs"))).first()[0] or 1) // BATCH_LOGS)
        spread = rows_of.coalesce(1) if files == 1 else rows_of.repartition(files, "collector_id", "sequence_num")
        S.write_batches(spread.sortWithinPartitions("sequence_num"), path)
    return path


@query(_P + " SELECT log_id::VARCHAR AS log_id, source_id, CASE WHEN source_id IN ('click', 'error') THEN 'c1' ELSE 'c2' END AS collector_id, seq FROM p")
def collected_logs(spark, d):
    """Batches of several collectors, some sent twice, as one ordered stream."""
    logs = O.dedupe_logs(S.flatten_batches(_collected(spark, d)))
    return O.sequence(logs, ["ts", "source_id", F.col("log_id").cast("long")]).select("log_id", "source_id", "collector_id", "seq")


#: An epoch of more than 10,000 logs comes in parts, each a batch with a number of its own.
_C = _L + ", c AS (SELECT CASE WHEN source_id IN ('click', 'error') THEN 'c1' ELSE 'c2' END AS collector_id, date_trunc('day', ts) AS s, unnest(range((count(*) + 9999) // 10000)) AS part FROM l GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY collector_id ORDER BY s, part) - 1 AS sequence_num FROM c), r AS (SELECT 0 AS g, * FROM b UNION ALL SELECT 1, * FROM b WHERE collector_id = 'c2' AND sequence_num < 5)"


@query(_C + " SELECT collector_id, g AS generation, sequence_num, s + INTERVAL 1 DAY AS watermark, false AS moved_backward FROM r")
def generation_watermarks(spark, d):
    """A higher generation comes after all of a lower one, whatever its times."""
    rows = O.batch_watermarks(_collected(spark, d))
    return rows.select("collector_id", F.col("mark.generation").alias("generation"), "sequence_num", F.col("mark.watermark").alias("watermark"), "moved_backward")


@query(_C + " SELECT collector_id, max(g) AS generation, arg_max(s, (g, s)) + INTERVAL 1 DAY AS watermark FROM r GROUP BY collector_id")
def latest_watermarks(spark, d):
    rows = O.latest_watermark(_collected(spark, d))
    return rows.select("collector_id", F.col("mark.generation").alias("generation"), F.col("mark.watermark").alias("watermark"))


# attributes and single rules

OPTIONAL = FiberType("optional", (Attribute("user", key=True), Attribute("k")), {s: (Pattern(r"user=(?P<user>\d+) .*k=(?P<k>[0-4]\d*)?"),) for s in SOURCES})
CHAINED = _type("chained", attributes=(Attribute("last", key=True, derived="<${pair}>"), Attribute("pair", derived="${user}/${k}"), Attribute("user"), Attribute("k")), regex=_BOTH)
KEYLESS = _type("keyless", attributes=(Attribute("user"),))


@query(_L + " SELECT log_id, user_id::VARCHAR AS user, CASE WHEN regexp_matches(k, '^[0-4]') THEN k END AS k FROM l")
def optional_groups(spark, d):
    return E.extract(logs_of(spark, d), OPTIONAL).select("log_id", "attrs.user", "attrs.k")


@query(_L + " SELECT log_id, '<' || user_id || '/' || k || '>' AS last FROM l")
def derived_from_derived(spark, d):
    return E.extract(logs_of(spark, d), CHAINED).select("log_id", "attrs.last")


@query(_L + " SELECT log_id AS first_log_id, 1 AS n_logs FROM l")
def keyless_fibers(spark, d):
    """Without a key every log is a fiber of its own."""
    return C.correlate_type(ordered_logs(spark, d), KEYLESS).fibers.select("first_log_id", "n_logs")


@query(_L + " SELECT 'keyless' AS fiber_type, count(*) AS n_fibers, count(*) AS n_memberships, count(*) AS n_logs FROM l")
def correlation_stats(spark, d):
    stats = C.correlate_type(ordered_logs(spark, d), KEYLESS).stats()
    return stats.select(F.lit("keyless").alias("fiber_type"), F.col("fibers_created").alias("n_fibers"), F.col("memberships_written").alias("n_memberships"), F.col("logs_processed").alias("n_logs"))


@query(_FM + " SELECT fiber_id, n_logs, first_activity FROM f WHERE fiber_id = 'user_session-3'")
def fiber_by_id(spark, d):
    return T.get_fiber(session_tables(spark, d)[1], "user_session-3").select("fiber_id", "n_logs", "first_activity")


@query("SELECT count(*) AS n_versions FROM customer WHERE c_custkey > 0")
def version_count(spark, d):
    return V.count_versions(_versions(spark, d))


@query("SELECT count(*) > 0 AS is_ancestor FROM customer WHERE c_custkey = 9 // 2 // 2")
def version_is_ancestor(spark, d):
    return V.is_ancestor(_versions(spark, d), "2", "9")


@query(_FM + " SELECT fiber_id FROM f WHERE fiber_id IN (SELECT fiber_id FROM m WHERE ts < TIMESTAMP '2024-01-05' OR ts > TIMESTAMP '2024-01-15')")
def fibers_after_clearing(spark, d):
    logs, fibers, m = session_tables(spark, d)
    kept = V.clear_results(m, logs, "2024-01-05", "2024-01-15")
    return V.cleared_fibers(fibers, kept).select("fiber_id")


@query(_FM + " SELECT fiber_id FROM f WHERE fiber_type <> 'user_session'")
def fibers_after_reprocessing(spark, d):
    """All fibers of the version that is reprocessed go, whatever memberships stay."""
    fibers = session_tables(spark, d)[1].drop("ruleset_version").withColumn("ruleset_version", F.when(F.col("fiber_type") == "user_session", "1").otherwise("2"))
    return V.cleared_fibers(fibers, version="1").select("fiber_id")


@query(_FM + " SELECT fiber_id FROM f WHERE usr = '7' AND regexp_matches(usr, '^[0-9]$')")
def attribute_filter_and(spark, d):
    return T.filter_attributes(session_tables(spark, d)[1], [("user", "7", False), ("user", "^[0-9]$", True)]).select("fiber_id")


@query(_FM + " SELECT fiber_id, n_logs FROM f WHERE fiber_type = 'user_session' AND usr = '7'")
def query_fibers_by_attribute(spark, d):
    return T.query_fibers(session_tables(spark, d)[1], ["user_session"], {"user": "7"}, max_fibers=1000).rows.select("fiber_id", "n_logs")


@query(
    _L + f", i AS ({_SET}), w AS (SELECT min(ts) - INTERVAL 4 HOUR AS a, max(ts) + INTERVAL 4 HOUR AS z FROM l JOIN i USING (log_id)), "
    "p AS (SELECT l.*, row_number() OVER (ORDER BY ts, log_id) AS seq, lag(ts) OVER (ORDER BY ts, log_id) AS prev_clock FROM l, w WHERE ts BETWEEN a AND z), "
    "s AS (SELECT *, CASE WHEN lag(ts) OVER v IS NULL OR prev_clock - lag(ts) OVER v > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS st FROM p WINDOW v AS (PARTITION BY user_id ORDER BY seq)), "
    "n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY seq) AS n FROM s), "
    "h AS (SELECT user_id, n, count(*) AS n_logs, count(i.log_id) AS matching FROM n LEFT JOIN i USING (log_id) GROUP BY user_id, n) "
    "SELECT matching / (n_logs + (SELECT count(*) FROM i) - matching)::DOUBLE AS iou, matching, (SELECT count(*) FROM i) - matching AS missing, n_logs - matching AS extra FROM h WHERE matching > 0"
)
def score_candidate_rules(spark, d):
    """A candidate type over a working set's window, scored against the set."""
    return V.score_rules(ordered_logs(spark, d), _wanted(spark, d), SESSION).select("iou", "matching", "missing", "extra")


# merges: an order's log opens the customer's fiber or joins it, its first line item opens one of the order, a receipt links both

RECEIPTS = FiberType("receipts", (Attribute("cust", key=True), Attribute("order", key=True)), {"a": (Pattern(r"cust=(?P<cust>\d+)$"),), "b": (Pattern(r"order=(?P<order>\d+)$"),), "c": (Pattern(r"cust=(?P<cust>\d+) order=(?P<order>\d+)"),)})
_R = """WITH i AS (SELECT l_orderkey AS o, min(l_shipdate)::TIMESTAMP AS s, max(l_shipdate)::TIMESTAMP AS r FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderdate::TIMESTAMP AS t, greatest(s, o_orderdate) + INTERVAL 1 HOUR AS s, greatest(r, o_orderdate) + INTERVAL 2 HOUR AS r FROM orders JOIN i ON o = o_orderkey),
f AS (SELECT c, arg_min('a' || o, (t, 'a' || o)) AS first_log, min(t) AS t0 FROM x GROUP BY c), y AS (SELECT x.*, first_log FROM x JOIN f USING (c))"""


def _receipts(spark, d) -> DataFrame:
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_shipdate").cast("timestamp").alias("s"), F.max("l_shipdate").cast("timestamp").alias("r"))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("timestamp").alias("t")).join(i, "o")
    hours = lambda c, n: F.timestamp_seconds(F.unix_seconds(c) + 3600 * n)
    log = lambda s, t, *text: F.struct(F.concat(F.lit(s), "o").alias("log_id"), t.alias("ts"), F.lit(s).alias("source_id"), F.concat(*text).alias("raw_text"))
    logs = x.select(F.inline(F.array(log("a", F.col("t"), F.lit("cust="), "c"), log("b", hours(F.greatest("s", "t"), 1), F.lit("order="), "o"), log("c", hours(F.greatest("r", "t"), 2), F.lit("cust="), "c", F.lit(" order="), "o"))))
    return O.sequence(logs, ["ts", "source_id", "log_id"])  # without a gap there is no need of the clock


@query(_R + " SELECT 'b' || o AS loser, first_log AS survivor, 'c' || o AS log_id FROM y")
def merges_of_receipts(spark, d):
    found = C.correlate_type(_receipts(spark, d), RECEIPTS, named=True).merges
    return found.select(F.col("loser_log").alias("loser"), F.col("survivor_log").alias("survivor"), "log_id")


@query(_R + " SELECT first_log AS first_log_id, 3 * count(*) AS n_logs, min(t) AS first_activity, max(r) AS last_activity, any_value(c)::VARCHAR AS cust, arg_max(o, (r, 'c' || o))::VARCHAR AS last_order FROM y GROUP BY first_log")
def merged_fibers(spark, d):
    """What merges leave: logs of all, last values (the key of the last receipt or line item in place of those before)."""
    f = C.correlate_type(_receipts(spark, d), RECEIPTS).fibers
    by_receipt = F.col("attributes")["order"]
    return f.select("first_log_id", "n_logs", "first_activity", "last_activity", F.col("attributes")["cust"].alias("cust"), by_receipt.alias("last_order"))


@query(_R + " SELECT 'a' || o AS log_id, first_log AS fiber FROM y UNION ALL SELECT 'b' || o, 'b' || o FROM y UNION ALL SELECT 'c' || o, first_log FROM y")
def memberships_as_written(spark, d):
    """Memberships that stay as they were when written, merges aside."""
    found = C.correlate_type(_receipts(spark, d), RECEIPTS, membership="as_written", named=True).memberships
    return found.select("log_id", F.col("first_log_id").alias("fiber"))


# values at merges: orders and line items have a mark of their own, which may differ when a receipt links both

MARKED = FiberType("receipts", (*RECEIPTS.attributes, Attribute("mark", "int")), {"a": (Pattern(r"cust=(?P<cust>\d+) mark=(?P<mark>\d)$"),), "b": (Pattern(r"order=(?P<order>\d+) mark=(?P<mark>\d)$"),), "c": RECEIPTS.sources["c"]})
_M = _R + """, e AS (SELECT first_log, c, t AS ts, 'a' AS k, 'a' || o AS log_id, o % 3 AS mark, NULL::TIMESTAMP AS other_last FROM y UNION ALL SELECT first_log, c, r, 'c', 'c' || o, (o // 3) % 3, s FROM y),
w AS (SELECT *, lag(ts) OVER (PARTITION BY c ORDER BY ts, k, log_id) AS last FROM e), v AS (SELECT *, CASE WHEN k = 'a' OR other_last > last THEN mark END AS won FROM w)"""


def _marked(spark, d) -> DataFrame:
    number = F.regexp_extract("log_id", r"(\d+)", 1).cast("long")
    mark = F.when(F.col("source_id") == "a", number % 3).when(F.col("source_id") == "b", F.floor(number / 3) % 3)
    return _receipts(spark, d).withColumn("raw_text", F.concat("raw_text", F.coalesce(F.concat(F.lit(" mark="), mark), F.lit(""))))


@query(
    _M + ", q AS (SELECT *, last_value(won IGNORE NULLS) OVER (PARTITION BY c ORDER BY ts, k, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM v) "
    "SELECT log_id, k = 'c' AS at_merge, (CASE WHEN won IS NULL THEN mark ELSE held END)::VARCHAR AS old_value, (CASE WHEN won IS NULL THEN held ELSE mark END)::VARCHAR AS new_value FROM q WHERE held <> mark"
)
def merge_conflicts(spark, d):
    """Marks that a log changed or that differed at a merge, where that of the fiber with the later activity stays."""
    logs = _marked(spark, d)
    found = C.correlate_type(logs, MARKED).conflicts.filter("attribute = 'mark'")
    return found.join(logs.select("seq", "log_id"), "seq").select("log_id", "at_merge", "old_value", "new_value")


@query(_M + " SELECT first_log AS first_log_id, (arg_max(won, (ts, k, log_id)) FILTER (WHERE won IS NOT NULL))::VARCHAR AS mark FROM v GROUP BY first_log")
def merged_attributes(spark, d):
    """The mark that a customer's fiber ends with."""
    return C.correlate_type(_marked(spark, d), MARKED).fibers.select("first_log_id", F.col("attributes")["mark"].alias("mark"))


# runs that are cut and go on

BOTH = _type("user_both", "4h", special={"error": (Pattern(_USER, release_self=("user",)),)})
_CUT = "lag(source_id) OVER w = 'error' OR prev_clock - lag(ts) OVER w > INTERVAL 4 HOUR"


@query(_fibers(_CUT).replace("SELECT first_log_id, first_activity, last_activity, n_logs, 'flush' AS close_reason FROM g", "SELECT first_log_id, first_activity, last_activity, n_logs FROM g"))
def resume_fibers(spark, d):
    """Cut in the middle of the time and gone on from the state: the fibers of both parts are those of an uncut run."""
    logs, rules = ordered_logs(spark, d), Rules((BOTH,))
    middle = logs.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2))).first()[0]
    first = C.correlate(logs.filter(F.col("ts") < F.lit(middle)), rules, flush=False)
    rest = C.resume(stage(first.state, "state"), logs.filter(F.col("ts") >= F.lit(middle)), rules)
    found = first.fibers.filter("closed").unionByName(rest.fibers)
    return found.select("first_log_id", "first_activity", "last_activity", "n_logs")


@query(
    _L + ", v AS (SELECT *, ts >= TIMESTAMP '2024-01-15' AS late FROM l), p AS (SELECT *, lag(ts) OVER (PARTITION BY late ORDER BY ts, source_id, log_id) AS prev_clock, row_number() OVER (ORDER BY ts, source_id, log_id) AS seq FROM v), "
    "s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (NOT late AND prev_clock - lag(ts) OVER w > INTERVAL 4 HOUR) THEN 1 ELSE 0 END AS st FROM p WINDOW w AS (PARTITION BY user_id, late ORDER BY seq)), "
    "f AS (SELECT *, sum(st) OVER (PARTITION BY user_id, late ORDER BY seq) AS n FROM s) SELECT CASE WHEN late THEN 'v2' ELSE 'v1' END AS ruleset_version, min(log_id) AS first_log_id, count(*) AS n_logs FROM f GROUP BY late, user_id, n"
)
def versioned_cut_over(spark, d):
    """Sessions by gap up to a moment, then users for ever under a new version; the clock of each part is its own."""
    logs = ordered_logs(spark, d)
    at = F.lit("2024-01-15").cast("timestamp")
    parts = [O.with_prev_clock(logs.filter(x).drop("prev_clock")) for x in (F.col("ts") < at, F.col("ts") >= at)]
    schedule = [(None, Rules((SESSION,), version="v1")), ("2024-01-15", Rules((_type("user_session"),), version="v2"))]
    found = C.correlate_versioned(parts[0].unionByName(parts[1]), schedule)
    return found.fibers.select("ruleset_version", "first_log_id", "n_logs")


# sinks


@query(_L + " SELECT log_id, source_id FROM l")
def log_sink(spark, d):
    """Logs written in overlapping parts are there once."""
    logs, path = logs_of(spark, d), _folder(spark, "sink")
    for part in ("log_id % 3 < 2", "log_id % 3 > 0", "log_id % 3 > 0"):
        sinks.write_logs(logs.filter(part), path)
    return sinks.read(spark, path).select("log_id", "source_id")


@query(_FM + " SELECT log_id, fiber_id FROM m")
def membership_sink(spark, d):
    m = session_tables(spark, d)[2].withColumn("ruleset_version", F.lit("1"))
    path = _folder(spark, "sink")
    for part in ("log_id % 3 < 2", "log_id % 3 > 0"):
        sinks.write_memberships(m.filter(part), path)
    return sinks.read(spark, path).select("log_id", "fiber_id")


@query(_L + " SELECT min(log_id) AS first_log_id, count(*) AS n_logs, max(ts) AS last_activity FROM l GROUP BY user_id")
def fiber_sink(spark, d):
    """Fibers as they were and as they are later: the later rows stay."""
    logs, path = ordered_logs(spark, d), _folder(spark, "sink")
    for rows in (logs.filter("ts < TIMESTAMP '2024-01-20'"), logs):
        sinks.upsert_fibers(C.correlate_type(rows, _type("user_forever")).fibers, path)
    return sinks.read_fibers(spark, path).select("first_log_id", "n_logs", "last_activity")


@query(_L + " SELECT 'all' AS sink, count(*) AS n FROM l UNION ALL SELECT 'errors', count(*) FROM l WHERE source_id = 'error'")
def fan_out_sinks(spark, d):
    paths = {k: _folder(spark, k) for k in ("all", "errors")}
    sinks.fan_out(ordered_logs(spark, d), lambda x: sinks.write_logs(x, paths["all"]), lambda x: sinks.write_logs(x.filter("source_id = 'error'"), paths["errors"]))
    rows = [sinks.read(spark, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("sink"), "n") for k, p in paths.items()]
    return rows[0].unionByName(rows[1])


# streams over files that the tables were written to


#: Logs of a file of a micro-batch; the most files of one.
FILE_LOGS, FILES = 100_000, 32


def _stream_files(spark, d, parts: int = 3) -> DataFrame:
    """The logs as files of consecutive times, read as a stream part by part: each micro-batch is as many files, which grow
    in number with the logs, so that no task writes or reads a whole one."""
    logs = ordered_logs(spark, d).select("log_id", "ts", "source_id", "raw_text")
    path = _folder(spark, "stream")
    ends = logs.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("z")).first()
    bounds = [ends["a"] + (ends["z"] - ends["a"]) * k // parts for k in range(parts + 1)] if ends["a"] is not None else [0] * (parts + 1)
    inside = [(F.unix_micros("ts") >= bounds[k]) & ((F.unix_micros("ts") < bounds[k + 1]) | F.lit(k == parts - 1)) for k in range(parts)]
    counts = logs.agg(*[F.count_if(x) for x in inside]).first()
    files = max(1, min(FILES, min(counts) // FILE_LOGS))  # of so many logs none stays empty
    for x in inside:  # one after another, so that their ages tell their order
        rows = logs.filter(x)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)  # a micro-batch
    return spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(_READY + " SELECT log_id, ts FROM l, w WHERE ts < w - INTERVAL 1 SECOND")
def stream_ready_logs(spark, d):
    """Micro-batches in global order: what all sources are past of."""
    out = _folder(spark, "ready")
    emit = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    streams.stream_sequence(_stream_files(spark, d), _folder(spark, "state"), list(SOURCES), emit).awaitTermination()
    return spark.read.parquet(out).select("log_id", "ts")


def _run(df: DataFrame, spark: SparkSession) -> DataFrame:
    out = _folder(spark, "emitted")
    df.writeStream.format("parquet").option("checkpointLocation", _folder(spark, "checkpoint")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(_EPOCHS + " SELECT epoch_start, epoch_end, n_logs, first_ts, last_ts FROM b WHERE epoch_end <= (SELECT max(ts) FROM l) - INTERVAL 1 SECOND")
def stream_epochs(spark, d):
    return _run(streams.stream_epochs(_stream_files(spark, d), 6 * 3600), spark)


@query(
    _L + ", s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS st FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM s), "
    "g AS (SELECT user_id::VARCHAR AS k, min(ts) AS first_activity, max(ts) AS last_activity, count(*) AS n_logs FROM n GROUP BY user_id, n) SELECT * FROM g WHERE last_activity + INTERVAL 4 HOUR <= (SELECT max(ts) FROM l) - INTERVAL 1 SECOND"
)
def stream_sessions(spark, d):
    return _run(streams.stream_sessions(E.extract(_stream_files(spark, d), SESSION), "user", 4 * 3600), spark)


@query(
    _fibers(_CUT).replace("SELECT first_log_id, first_activity, last_activity, n_logs, 'flush' AS close_reason FROM g", "SELECT first_log_id, first_activity, last_activity, n_logs FROM g WHERE (SELECT max(ts) FROM l) - last_activity > INTERVAL 4 HOUR")
)
def stream_fibers(spark, d):
    """General fibers over micro-batches with the state carried: those closed by the end, each written once."""
    out = _folder(spark, "fibers")
    streams.stream_correlate(_stream_files(spark, d), Rules((BOTH,)), out).awaitTermination()
    return sinks.read_fibers(spark, f"{out}/fibers").select("first_log_id", "first_activity", "last_activity", "n_logs")


@query(
    _fibers(_CUT).split("SELECT first_log_id, first_activity")[0] + "SELECT log_id, first_log_id FROM f JOIN (SELECT user_id, n, min(log_id) AS first_log_id FROM f GROUP BY user_id, n) USING (user_id, n)"
)
def stream_fiber_logs(spark, d):
    """Every log's fiber, as the micro-batches told it, those still open among them."""
    out, logs = _folder(spark, "fibers"), _stream_files(spark, d)
    streams.stream_correlate(logs, Rules((BOTH,)), out).awaitTermination()
    names = logs_of(spark, d).select(C.fiber_id_of("1", "user_both", F.col("log_id")).alias("fiber_id"), F.col("log_id").alias("first_log_id"))
    return streams.stream_memberships(spark, out).join(names, "fiber_id").select("log_id", "first_log_id")


@query(_L + " SELECT min(log_id) AS first_log_id, count(*) AS n_logs, 1 AS n_rows, 3 AS n_writes FROM l GROUP BY user_id")
def repeated_writes(spark, d):
    """A write that is repeated under its number, and one that died before it was finished, leave no trace."""
    logs, path = ordered_logs(spark, d), _folder(spark, "sink")
    for number, until in ((0, "2024-01-10"), (1, "2024-01-20"), (0, "2024-01-10"), (2, "2034-01-01"), (2, "2024-01-10")):
        sinks.upsert_fibers(C.correlate_type(logs.filter(F.col("ts") < F.lit(until).cast("timestamp")), _type("user_forever")).fibers, path, number)
    dead = C.correlate_type(logs, _type("user_forever"), version="2").fibers.withColumn("dt", F.to_date("first_activity"))
    dead.write.partitionBy("ruleset_version", "fiber_type", "dt").parquet(f"{path}/{sinks.BATCH}=3/attempt=dead")
    n = len(sinks.commits(spark, path))
    rows = sinks.read_fibers(spark, path)
    return rows.groupBy("first_log_id").agg(F.max("n_logs").alias("n_logs"), F.count(F.lit(1)).alias("n_rows")).withColumn("n_writes", F.lit(n))

_KEYED = _P + """, s AS (SELECT *, CASE WHEN lag(source_id) OVER w = 'error' OR coalesce(ts - lag(ts) OVER w > INTERVAL 4 HOUR, true) THEN 1 ELSE 0 END AS st FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, log_id)),
n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS n FROM s), e AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 SECOND AS mark FROM l),
f AS (SELECT user_id, n, arg_min(log_id, ts) AS first_log_id, min(ts) AS first_activity, max(ts) AS last_activity, count(*) AS n_logs FROM n GROUP BY user_id, n)"""


def _run_on_disk(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs with a state that is kept on disk, not in the executors' heaps."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.PROVIDER)
    try:
        return _run(df, spark)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _keyed(spark, d) -> DataFrame:
    return _run_on_disk(keyed.stream_keyed_fibers(_stream_files(spark, d), BOTH), spark)


@query(_KEYED + " SELECT first_log_id::VARCHAR AS first_log_id, first_activity, last_activity, n_logs, 'timeout' AS close_reason FROM f, e WHERE last_activity + INTERVAL 4 HOUR < mark")
def stream_keyed_fibers(spark, d):
    """Fibers of one key from the state store: those that ended by the watermark."""
    return _keyed(spark, d).filter("close_reason IS NOT NULL").select("first_log_id", "first_activity", "last_activity", "n_logs", "close_reason")


@query(_KEYED + " SELECT log_id::VARCHAR AS log_id, first_log_id::VARCHAR AS first_log_id FROM n JOIN f USING (user_id, n), e WHERE ts <= mark")
def stream_keyed_memberships(spark, d):
    return _keyed(spark, d).filter("log_id IS NOT NULL").select("log_id", "first_log_id")


@query(_L + " SELECT log_id::VARCHAR AS log_id, source_id, ts, CASE WHEN source_id IN ('click', 'error') THEN 'c1' ELSE 'c2' END AS collector_id FROM l")
def stream_collected_logs(spark, d):
    """Batches of collectors as a stream: what is sent again comes once."""
    logs = streams.stream_collected(S.stream_batches(spark, _batch_files(spark, d), files=FILES))
    return _run_on_disk(logs.select("log_id", "source_id", "ts", "collector_id"), spark)


@query(
    _EPOCHS + " , w AS (SELECT min(m) AS w FROM (SELECT max(ts) AS m FROM l GROUP BY source_id IN ('click', 'error'))) SELECT epoch_start, epoch_end, n_logs, first_ts, last_ts FROM b, w WHERE epoch_end <= w - INTERVAL 1 SECOND"
)
def stream_collector_epochs(spark, d):
    """Epochs over two collectors, emitted when the slower one is past them; re-sent logs count once."""
    parts = [S.flatten_batches(S.stream_batches(spark, _batch_files(spark, d, k), files=1).drop("arrival")) for k in ("c1", "c2")]
    return _run(streams.tumbling(streams.merge_collectors(parts), 6 * 3600), spark)


@query(_F + " SELECT source_id, ts, line AS value FROM t")
def stream_lines(spark, d):
    """Lines of files that are followed, with their times."""
    rows = streams.stream_lines(spark, text_files(spark, d)).filter("ts IS NOT NULL").select("source_id", "ts", "value")
    return _run(rows, spark)
