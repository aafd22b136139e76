import pytest
from pyspark.sql import functions as F

from logweave.functions.scalars import normalise_ip, normalise_mac, parse_time, strptime_pattern, typed
from logweave.plans.rules import Attribute, FiberType, Pattern, Regex, Rules, Source, parse_duration, with_source_types
from logweave.sources import lines as L

ISO = r"^(?P<ts>\S+Z)"


def _records(spark, tmp_path, text, on_error="drop"):
    (tmp_path / "a.log").write_bytes(text)
    return L.logs_from(spark, [Source("s", f"file://{tmp_path}/a.log", ISO)], on_error).orderBy("line_ord").collect()


def test_multi_line_records(spark, tmp_path):
    rows = _records(spark, tmp_path, b"2024-01-01T10:00:00Z Valve seven opens\n  one\r\n\ttwo\n2024-01-01T10:00:01Z Valve seven shuts\n")
    assert [r.n_lines for r in rows] == [3, 1]
    assert rows[0].raw_text == "2024-01-01T10:00:00Z Valve seven opens\n  one\n\ttwo"
    assert [r.file_offset for r in rows] == [0, 51]


def test_bad_lines(spark, tmp_path):
    text = b"2024-01-01T10:00:00Z Pump on\nno time at all\n2024-01-01T10:00:02Z Pump off\n"
    assert len(_records(spark, tmp_path, text)) == 2
    with pytest.raises(Exception, match="unusable line"):
        _records(spark, tmp_path, text, "fail")


def test_log_ids_and_offsets(spark, tmp_path):
    text = b"2024-01-01T10:00:00Z a\n2024-01-01T10:00:01Z b\n"
    first, again = _records(spark, tmp_path, text), _records(spark, tmp_path, text)
    assert [r.log_id for r in first] == [r.log_id for r in again]
    src = [Source("s", f"file://{tmp_path}/a.log", ISO)]
    read = L.read_lines(spark, src)
    stored = L.source_offsets(L.assemble_records(L.with_timestamp(read, src)).filter("line_ord = 0"))
    assert [r.value[-1] for r in L.from_position(read, "stored_offset", stored).collect()] == ["b"]
    assert L.from_position(read, "end").count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("2024-01-01T10:00:00+02:00", "iso8601", "2024-01-01 08:00:00"),
        ("2024-01-01", "iso8601", None),
        ("10/Oct/2023:13:55:36 +0000", "%d/%b/%Y:%H:%M:%S %z", "2023-10-10 13:55:36"),
        ("1000000000", "epoch", "2001-09-09 01:46:40"),
        ("1000000000123", "epoch_ms", "2001-09-09 01:46:40.123"),
        ("2024-01-01 10:00:00,250", "%Y-%m-%d %H:%M:%S,%3f", "2024-01-01 10:00:00.25"),
        ("nonsense", "epoch", None),
    ],
)
def test_times(spark, text, kind, want):
    assert spark.range(1).select(parse_time(F.lit(text), kind).cast("string").alias("t")).first().t == want


def test_unknown_directive():
    with pytest.raises(ValueError, match="unknown directive"):
        strptime_pattern("%Q")


def test_addresses_and_types(spark):
    cols = [normalise_ip(F.lit(x)) for x in ("192.168.001.001", "1.2.3.999", "host")] + [normalise_mac(F.lit(x)) for x in ("AA-BB-CC-11-22-33", "invalid")]
    cols += [typed(F.lit("12"), "int"), typed(F.lit("x"), "int"), typed(F.lit("1.5"), "float")]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert list(row) == ["192.168.1.1", None, "host", "aa:bb:cc:11:22:33", None, 12, None, 1.5]


def test_rules():
    assert parse_duration("250ms") == 250_000 and parse_duration("infinite") is None
    with pytest.raises(ValueError):
        parse_duration("1d")
    r = Regex(r"(?P<a_b>x)(?<c>y)?")
    assert r.groups == {"a_b": 1, "c": 2} and r.jvm == "(?d)(x)(y)?" and r.optional
    a, b = Attribute("a", derived="${b}"), Attribute("b", derived="${a}")
    with pytest.raises(ValueError, match="need each other"):
        FiberType("t", (a, b), {})
    with pytest.raises(ValueError, match="no keys"):
        FiberType("t", (Attribute("a"),), {"s": (Pattern("(?P<a>x)", release_self=("a",)),)})
    rules = Rules.from_dict({"fiber_types": {"t": {"temporal": {"max_gap": "5s"}, "attributes": [{"name": "a", "key": True}], "sources": {"s": {"patterns": [{"regex": "(?P<a>x)"}]}}}}})
    assert rules.named("t").gap == 5_000_000
    assert [t.name for t in with_source_types(rules, ["s", "t"]).types] == ["t", "s"]


def test_profile(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-01T10:00:00Z a\nx\n")
    read = L.read_lines(spark, [Source("s", f"file://{tmp_path}/a.log", ISO)])
    rows = L.profile_timestamps(read, [(ISO, "iso8601"), (r"^(?P<ts>\w+)", "epoch")]).orderBy("candidate").collect()
    assert [(r.matched, r.parsed) for r in rows] == [(1, 1), (2, 1)]  # "2024" is an epoch too
