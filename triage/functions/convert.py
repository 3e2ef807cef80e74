"""Typed conversion of string cells with Python-identical results, as Column
expressions; only the canonical text of floats (Python's repr) comes from a
small Arrow-batched UDF.

Every converter returns a struct ``(value string, error string)``:
``value`` is the canonical text (the raw cell when conversion fails) and
``error`` is NULL on success.  Blank cells and raw/string/unknown types pass
through without error.  Native typed values are available on request
(``native_suffix``) for Parquet sinks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql import functions as F

from triage.functions.cells import PY_WHITESPACE
from triage.functions.memo import per_context
from triage.functions.numbers import as_number, dec_text, hex_text, parse_dec

TYPES = ("raw", "string", "int", "hex_int", "float", "bool", "timestamp")

# FIXED VALUES: boolean spellings (compared lower-cased and stripped)
TRUTHY = ["true", "yes", "1"]
FALSY = ["false", "no", "0"]

# FIXED VALUES: timestamp layouts tried in this order after epoch seconds
# (strptime notation).
TIMESTAMP_FORMATS = [
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S",
    "%Y/%m/%d %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%Y-%m-%d",
    "%m/%d/%Y",
]
EPOCH_MILLIS_ABOVE = 1_000_000_000_000

# Field grammars of strptime (the values it accepts for each directive).
_FIELD_RE = {
    "Y": r"(\d\d\d\d)",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])",
    "H": r"(2[0-3]|[0-1]\d|\d)",
    "M": r"([0-5]\d|\d)",
    "S": r"(6[0-1]|[0-5]\d|\d)",
    "f": r"([0-9]{1,6})",
}


def strptime_regex(fmt: str) -> tuple[str, list[str]]:
    """Anchored regex for a strptime layout + the directive of each group."""
    out, fields, i = [], [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            d = fmt[i + 1]
            out.append(_FIELD_RE[d])
            fields.append(d)
            i += 2
        elif ch.isspace():
            out.append(r"\s+")
            i += 1
        else:
            out.append("\\" + ch if ch in ".^$*+?()[]{}|\\/" else ch)
            i += 1
    return "(?i)^" + "".join(out) + "$", fields


def py_repr(s: Column) -> Column:
    """repr() of a plain string: single quotes unless it holds ' but no "."""
    esc = F.regexp_replace(s, r"\\", r"\\\\")
    dq = s.contains("'") & ~s.contains('"')
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(esc, "'", "\\\\'"), F.lit("'")))


def _strip(v: Column) -> Column:
    return F.btrim(v, F.lit(PY_WHITESPACE))


# ---------------------------------------------------------------------------
# parsers (Column -> native value or NULL)
# ---------------------------------------------------------------------------

_DIGITS = r"[0-9](_?[0-9])*"
FLOAT_RE = (rf"^[+-]?(({_DIGITS})(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$")
FLOAT_SPECIAL_RE = r"(?i)^[+-]?(inf|infinity|nan)$"


def native_float(s: Column) -> Column:
    """float(s) for stripped text; NULL when Python would raise."""
    low = F.lower(s)
    special = (F.when(low.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf")))
                .when(low.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
                .otherwise(F.lit(float("nan"))))
    return F.when(s.rlike(FLOAT_SPECIAL_RE), special).when(
        s.rlike(FLOAT_RE), F.regexp_replace(s, "_", "").try_cast("double"))


def native_bool(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.isin(TRUTHY), F.lit(True)).when(low.isin(FALSY), F.lit(False))


MIN_EPOCH_S, MAX_EPOCH_S = -62135596800, 253402300799     # 0001-01-01 .. 9999-12-31


def epoch_ts(s: Column) -> Column:
    """Integer text (Python int() grammar) as UTC epoch seconds, or
    milliseconds above 1e12; NULL when not an integer or out of range."""
    n = parse_dec(s)
    ms = n > EPOCH_MILLIS_ABOVE
    secs = F.when(ms, n / 1000).otherwise(n)
    ok = secs.between(MIN_EPOCH_S, MAX_EPOCH_S)
    # added to the NTZ epoch directly: independent of the session time zone
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (F.when(ok & ms, F.timestamp_add("MILLISECOND", n.cast("long"), epoch0))
             .when(ok, F.timestamp_add("SECOND", n.cast("long"), epoch0)))


SEP = "\u0001"


def format_parts(s: Column, fmt: str) -> Column:
    """array<string> of the strptime fields of ``fmt`` when s matches, else NULL
    (one regex rewrite + split instead of one extraction per field)."""
    rx, fields = strptime_regex(fmt)
    template = SEP.join(f"${i + 1}" for i in range(len(fields)))
    return F.when(s.rlike(rx), F.split(F.regexp_replace(s, rx, template), SEP))


def parts_ts(parts: Column, fmt: str) -> Column:
    """datetime.strptime semantics on the matched fields -> TIMESTAMP_NTZ."""
    _rx, fields = strptime_regex(fmt)
    g = {d: F.get(parts, i) for i, d in enumerate(fields)}
    num = {d: F.trim(g[d]).try_cast("int") for d in g if d != "f"}
    frac = F.rpad(g["f"], 6, "0").try_cast("int") if "f" in g else F.lit(0)
    sec = num.get("S", F.lit(0))
    secs = sec.cast("decimal(16,6)") + frac.cast("decimal(16,6)") / 1000000
    ts = F.try_make_timestamp_ntz(num["Y"], num["m"], num["d"],
                                  num.get("H", F.lit(0)), num.get("M", F.lit(0)), secs)
    return F.when(parts.isNotNull() & (num["Y"] >= 1) & (sec < 60), ts)


def format_ts(s: Column, fmt: str) -> Column:
    """datetime.strptime(s, fmt) as TIMESTAMP_NTZ, NULL on any failure."""
    return parts_ts(format_parts(s, fmt), fmt)


def iso_text(ts: Column) -> Column:
    """datetime.isoformat() of a naive timestamp."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")))


def _repr_batch(texts: pd.Series) -> pd.Series:
    """repr(float(t)) per validated text (NULL in -> NULL out)."""
    return texts.map(lambda t: None if t is None else repr(float(t)))


_UDF: dict = {}


def float_repr(text: Column) -> Column:
    """Python's float repr of already-validated float text, Arrow-batched.
    (Spark's double-to-text on Java 17 is not always the shortest repr.)"""
    if "repr" not in _UDF:
        _UDF["repr"] = pandas_udf(_repr_batch, "string")
    return _UDF["repr"](text)


def _apply(df: DataFrame, stages: list) -> DataFrame:
    for st in stages:
        df = df.drop(*st) if isinstance(st, list) else df.withColumns(st)
    return df


# FIXED VALUES: error message prefixes per type (the value's repr follows)
ERRORS = {
    "int": "invalid literal for int() with base 10: ",
    "hex_int": "invalid literal for int() with base 16: ",
    "float": "could not convert string to float: ",
    "bool": "Cannot interpret as boolean: ",
    "timestamp": "Cannot parse timestamp: ",
}


def with_converted(df: DataFrame, specs: dict[str, str], suffix: str = "__cv",
                   native_suffix: str | None = None) -> DataFrame:
    """Convert the columns of ``specs`` ({column: type}) in staged projections.

    Adds ``<col><suffix>`` = struct(value, error) per declared column and,
    when requested, ``<col><native_suffix>`` with the native Spark value.
    Blank cells keep their text without error; failures keep the raw text
    and carry the error message; raw/string/unknown types pass through.
    """
    return _apply(df, conversion_stages(tuple(specs.items()), suffix, native_suffix))


@per_context
def conversion_stages(items: tuple, suffix: str, native_suffix: str | None) -> list:
    specs = dict(items)
    conv = {c: t for c, t in specs.items() if t in ERRORS}
    tmp: list[str] = []
    stages: list = []

    def S(c: str, k: str) -> str:
        name = f"__{k}__{c}"
        tmp.append(name)
        return name

    stages.append({S(c, "s"): _strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in conv})
    st2 = {}
    for c, t in conv.items():
        s = F.col(f"`__s__{c}`")
        if t == "int":
            st2[S(c, "n")] = dec_text(s)
        elif t == "hex_int":
            st2[S(c, "n")] = hex_text(s)
        elif t == "float":
            st2[S(c, "n")] = native_float(s)
        elif t == "bool":
            st2[S(c, "n")] = native_bool(s)
        else:
            st2[S(c, "ep")] = epoch_ts(s)
            for i, f in enumerate(TIMESTAMP_FORMATS):
                st2[S(c, f"p{i}")] = format_parts(s, f)
    if st2:
        stages.append(st2)
    ts_cols = [c for c, t in conv.items() if t == "timestamp"]
    if ts_cols:
        stages.append({S(c, f"f{i}"): parts_ts(F.col(f"`__p{i}__{c}`"), f)
                       for c in ts_cols for i, f in enumerate(TIMESTAMP_FORMATS)})
        stages.append({
            S(c, "n"): F.coalesce(F.col(f"`__ep__{c}`"),
                                  *[F.col(f"`__f{i}__{c}`") for i in range(len(TIMESTAMP_FORMATS))])
            for c in ts_cols})
    st3 = {}
    for c, t in conv.items():
        n = F.col(f"`__n__{c}`")
        if t == "float":
            st3[S(c, "t")] = float_repr(F.when(n.isNotNull(), F.col(f"`__s__{c}`")))
        elif t in ("int", "hex_int"):
            st3[S(c, "t")] = n
        elif t == "bool":
            st3[S(c, "t")] = F.when(n, F.lit("True")).when(~n, F.lit("False"))
        else:
            st3[S(c, "t")] = F.when(F.col(f"`__ep__{c}`").isNotNull(),
                                    F.concat(iso_text(n), F.lit("+00:00"))).otherwise(iso_text(n))
    if st3:
        stages.append(st3)
    out = {}
    for c, t in specs.items():
        raw = F.col(f"`{c}`")
        if t not in ERRORS:
            out[c + suffix] = F.struct(raw.cast("string").alias("value"),
                                       F.lit(None).cast("string").alias("error"))
            continue
        s = F.col(f"`__s__{c}`")
        blank = s == ""
        failed = ~blank & F.col(f"`__n__{c}`").isNull()
        # int/float errors show the stripped text, bool/timestamp the raw cell
        shown = s if t in ("int", "hex_int", "float") else F.coalesce(raw, F.lit(""))
        out[c + suffix] = F.struct(
            F.when(blank | failed, raw).otherwise(F.col(f"`__t__{c}`")).alias("value"),
            F.when(failed, F.concat(F.lit(ERRORS[t]), py_repr(shown))).alias("error"))
        if native_suffix:
            n = F.col(f"`__n__{c}`")
            out[c + native_suffix] = as_number(n) if t in ("int", "hex_int") else n
    stages.append(out)
    stages.append(list(tmp))
    return stages
