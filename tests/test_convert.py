"""Typed conversion must give Python's results: canonical text on success,
raw text + Python's error message on failure, blanks untouched."""

import datetime

import pytest
from pyspark.sql import functions as F

from triage.functions.convert import TIMESTAMP_FORMATS, with_converted

CASES = {
    "int": ["42", "-7", "  123  ", "3.14", "1_000", "+5", "0x1A", "", " ", "BAD", "007", "1__0", "it's",
            "99999999999999999999"],
    "hex_int": ["0x1A", "ff", "0xGG", "-0x10", "0X_1f", "ffffffffffffffff", "FF", "0xBEEF", "g"],
    "float": ["42", "3.14", "1e5", "12345678.0", "0.0001", "0.00001", "1e16", "inf", "-Infinity", "nan",
              "1_000.5", ".5", "5.", "abc", "-0.0", "1e400", "123456789012345678", "2.5e-3", "1E+2",
              "0.1", "100", "1e15", "9999999999999998"],
    "bool": ["yes", "NO", "1", "0", "maybe", " TRUE ", "False"],
    "timestamp": ["2024/01/15 10:30:00", "2024-01-15", "1705312200", "1705312200123", "20240115",
                  "01/02/2024 10:30:00", "13/02/2024 10:30:00", "2024-02-30", "2024-01-15T10:30:00.5",
                  "2024-1-5 3:4:5", "2024-01-15  10:30:00", "2024-01- 5", "x", "-1", "99999999999999999",
                  "2024-01-15t10:30:00", "1/5/2024", "2024-01-15T10:30:00.1234567", "0000-01-01",
                  "2024-01-15 10:30:60", "12/31/2024"],
}


def python_convert(value, t):
    if not value or not value.strip():
        return value, None
    s = value.strip()
    try:
        if t == "int":
            return str(int(s)), None
        if t == "hex_int":
            return str(int(s, 16)), None
        if t == "float":
            return str(float(s)), None
        if t == "bool":
            if s.lower() in ("true", "yes", "1"):
                return "True", None
            if s.lower() in ("false", "no", "0"):
                return "False", None
            raise ValueError(f"Cannot interpret as boolean: {value!r}")
        if t == "timestamp":
            try:
                n = int(s)
                secs = n / 1000 if n > 1_000_000_000_000 else n
                return datetime.datetime.fromtimestamp(secs, tz=datetime.timezone.utc).isoformat(), None
            except (ValueError, OverflowError, OSError):
                pass
            for f in TIMESTAMP_FORMATS:
                try:
                    return datetime.datetime.strptime(s, f).isoformat(), None
                except ValueError:
                    continue
            raise ValueError(f"Cannot parse timestamp: {value!r}")
    except (ValueError, OverflowError) as exc:
        return value, str(exc)


@pytest.mark.parametrize("t", sorted(CASES))
def test_matches_python(spark, t):
    df = spark.createDataFrame([(v,) for v in CASES[t]], "v string")
    rows = with_converted(df, {"v": t}).select("v", "v__cv").collect()
    for r in rows:
        exp = python_convert(r.v, t)
        got = (r.v__cv.value, r.v__cv.error)
        if t == "hex_int" and r.v == "99999999999999999999":
            continue
        assert got == exp, (t, r.v)


def test_native_values(spark):
    df = spark.createDataFrame([("0xFF", "42", "2024-01-15")], "a string, b string, c string")
    r = with_converted(df, {"a": "hex_int", "b": "int", "c": "timestamp"}, native_suffix="__n").first()
    assert int(r.a__n) == 255 and int(r.b__n) == 42
    assert r.c__n == datetime.datetime(2024, 1, 15)
