import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("text, expected", [("noise - street/side's a.b-c", "Noise - Street/Side'S A.B-C"), ("ÉCOLE 12th", "École 12th"), ("", "")])
def test_title_case_starts_words_after_any_mark(spark, text, expected):
    assert one(spark, C.title_case(F.lit(text))) == expected


def test_trim_takes_spaces_only_and_runs_before_white_space_collapses(spark):
    assert one(spark, C.collapsed(F.lit("\tx\t"))) == " x "
    assert one(spark, C.collapsed(F.lit("  a  b "))) == "a b"
    assert one(spark, C.collapsed(F.lit("  "))) is None


@pytest.mark.parametrize(
    "local, utc", [("2026-11-01 01:30:00", "2026-11-01 06:30:00"), ("2026-03-08 02:30:00", "2026-03-08 07:30:00"), ("2026-07-01 12:00:00", "2026-07-01 16:00:00"), ("2026-01-01 12:00:00", "2026-01-01 17:00:00")]
)
def test_local_to_utc_at_clock_changes(spark, local, utc):
    assert one(spark, F.date_format(C.local_to_utc(F.to_timestamp_ntz(F.lit(local))), "yyyy-MM-dd HH:mm:ss")) == utc


@pytest.mark.parametrize("text, expected", [("40.4", "40.400000"), ("41.0000001", None), ("1e9", None), ("40.5\n", None), ("40.1234565", None), ("40.8765435", "40.876544")])
def test_boxed_decimal(spark, text, expected):
    got = one(spark, C.boxed_decimal(F.lit(text), "40.4", "41.0"))
    assert (None if got is None else str(got)) == expected


def test_a_date_that_only_looks_like_one_is_null(spark):
    assert one(spark, C.local_time(F.lit("2026-13-01T00:00:00"))) is None
    assert one(spark, C.local_time(F.lit("2026-12-01T00:00:00"))) == dt.datetime(2026, 12, 1)


def test_percent_and_half_up(spark):
    assert one(spark, C.percent(F.lit(0), F.lit(0))) == 100.0
    assert one(spark, C.percent(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, C.half_up(F.lit(0.495))) == 0.5
    assert one(spark, C.half_up(F.lit(-2.5), 0)) == -2.0


def test_hours_round_half_up(spark):
    start, end = F.lit(dt.datetime(2026, 1, 1)), F.lit(dt.datetime(2026, 1, 1, 0, 0, 18))
    assert str(one(spark, C.hours_between(start, end))) == "0.01"
    assert str(one(spark, C.hours_between(start, start))) == "0.00"


@pytest.mark.parametrize("attempt, expected", [(1, 500), (2, 1000), (7, 30_000), (60, 30_000), (2000, 30_000)])
def test_backoff_is_capped(spark, attempt, expected):
    assert one(spark, C.backoff_millis(F.lit(attempt), F.lit(500), F.lit(2.0), F.lit(30_000))) == expected


def test_name_uuid_is_version_3_without_a_namespace(spark):
    import hashlib

    for name in ("owner:a", "x", ""):
        d = bytearray(hashlib.md5(name.encode()).digest())
        d[6], d[8] = d[6] & 0x0F | 0x30, d[8] & 0x3F | 0x80
        assert one(spark, C.name_uuid(F.lit(name))) == str(uuid.UUID(bytes=bytes(d)))


def test_murmur2_has_the_published_values(spark):
    """Hashes that the message broker's own tests name."""
    known = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "a-little-bit-longer-string": -1486304829, "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971, "abc": 479470107}
    rows = spark.createDataFrame([(k,) for k in known], "k string").select("k", C.murmur2(F.col("k")).alias("h"), C.partition_of(F.col("k"), 12).alias("p")).collect()
    assert {r["k"]: r["h"] for r in rows} == known and all(r["p"] == (r["h"] & 0x7FFFFFFF) % 12 for r in rows)
