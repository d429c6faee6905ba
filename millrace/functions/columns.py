"""Column functions whose meaning Spark's built-ins miss by a little. All are built from built-ins and stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/New_York"
#: A date and time, and a date, at the start of a text.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}T"


def title_case(c: Column) -> Column:
    """Each run of letters and digits in lower case with its first letter in upper case, whatever stands between runs."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def trimmed(c: Column) -> Column:
    """Without outer spaces; null if nothing is left. Other white space stays."""
    return F.nullif(F.trim(c), F.lit(""))


def collapsed(c: Column) -> Column:
    """Trimmed of spaces first, then each run of white space as one space; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(""))


def local_to_utc(local: Column, zone: str = LOCAL_ZONE) -> Column:
    """A local wall-clock time as UTC. An hour that the clock repeats counts as its second pass, one that it leaves out as the time after it."""
    local = local.cast("timestamp")
    hour = F.expr("INTERVAL 1 HOUR")
    first, second = F.to_utc_timestamp(local, zone), F.to_utc_timestamp(local + hour, zone) - hour
    return F.when(F.from_utc_timestamp(second, zone) == local, second).otherwise(first)


def local_time(text: Column) -> Column:
    """The wall-clock time that a text starts with; null where it is no such time."""
    return F.when(text.rlike(DATE_TIME), F.try_to_timestamp(text).cast("timestamp_ntz"))


def hours_between(start: Column, end: Column) -> Column:
    """Exact hours, rounded half up to 2 places, as DECIMAL(10, 2)."""
    micros = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))).cast("decimal(20,0)")
    return F.round(micros / F.lit(3_600_000_000).cast("decimal(12,0)"), 2).cast("decimal(10,2)")


def boxed_decimal(text: Column, low: str, high: str) -> Column:
    """A plain decimal text inside a closed range as DECIMAL(9, 6); else null."""
    value = F.when(text.rlike(r"^-?\d+(\.\d+)?\z"), text.try_cast("decimal(38,12)"))
    return F.when(value.between(F.lit(low).cast("decimal(9,6)"), F.lit(high).cast("decimal(9,6)")), F.round(value, 6).cast("decimal(9,6)"))


def half_up(c: Column, places: int = 2) -> Column:
    """Rounds a double half toward plus infinity."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """100 for an empty whole, else the share in percent with 2 places."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(half_up(part * 100.0 / whole))


def date_key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def backoff_millis(attempt: Column, initial: Column, multiplier: Column, most: Column) -> Column:
    """Delay before a retry in whole milliseconds, without jitter."""
    return F.floor(F.least(initial * F.pow(multiplier, attempt - 1), most.cast("double"))).cast("long")


def jittered(base: Column, chance: Column) -> Column:
    """Full jitter: a share of the delay, cut to whole milliseconds."""
    return F.floor(base * chance).cast("long")


def ignored_kind(reason: Column) -> Column:
    """Why an input was ignored, as one of six kinds; the first that fits."""
    return (
        F.when(reason.isNull(), "other")
        .when(reason.startswith("stale attempt"), "stale_attempt")
        .when(reason.contains("already started"), "duplicate_start")
        .when(reason.startswith("workflow is") | reason.startswith("workflow not"), "workflow_not_running")
        .when(reason.contains("not due") | reason.contains("valid until"), "timer_early")
        .when(reason.startswith("task "), "duplicate_or_late")
        .otherwise("other")
    )


def name_uuid(name: Column) -> Column:
    """The version 3 UUID of a name without a namespace."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def murmur2(text: Column) -> Column:
    """The 32-bit murmur2 hash of a text's UTF-8 bytes, with the seed that message brokers use for keys, as a signed number."""
    #: Multiplier, seed, 32-bit mask.
    m, seed, low = F.lit(0x5BD1E995), F.lit(0x9747B28C), F.lit(0xFFFFFFFF)
    times = lambda x: (x * m).bitwiseAND(low)  # noqa: E731  below 2 ** 63
    folded = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))
    code = F.hex(F.encode(text, "UTF-8"))
    size = (F.length(code) / 2).cast("long")
    byte = lambda at: F.conv(F.substring(code, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    word = lambda at: byte(at) + F.shiftleft(byte(at + 1), 8) + F.shiftleft(byte(at + 2), 16) + F.shiftleft(byte(at + 3), 24)
    blocks = F.floor(size / 4)
    starts = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), blocks), lambda k: k < blocks), lambda k: k * 4)
    hashed = F.aggregate(starts, seed.bitwiseXOR(size), lambda h, at: times(h).bitwiseXOR(times(folded(times(word(at)), 24))))
    rest, at = size % 4, blocks * 4
    tail = F.when(rest == 3, byte(at) + F.shiftleft(byte(at + 1), 8) + F.shiftleft(byte(at + 2), 16)).when(rest == 2, byte(at) + F.shiftleft(byte(at + 1), 8)).when(rest == 1, byte(at))
    mixed = F.when(rest == 0, hashed).otherwise(times(hashed.bitwiseXOR(tail)))
    done = folded(times(folded(mixed, 13)), 15)
    return F.when(done >= 2**31, done - 2**32).otherwise(done).cast("int")


def partition_of(key: Column, partitions: int) -> Column:
    """Which partition of a topic a key goes to."""
    return (murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int")
