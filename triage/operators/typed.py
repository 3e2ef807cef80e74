"""Typed conversion of a whole table under a column spec (CNV-08/09/10).

One projection converts every declared column (``with_converted``); the
typed table keeps every row and every column (undeclared columns pass
through), the error side table explodes the failed cells.  Both derive
from the same converted plan; a pipeline that needs both checkpoints it
once (``spark.checkpoint.dir``) instead of converting twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions.convert import with_converted
from triage.table import ForensicTable

SUFFIX = "__cv"


def matched_spec(t: ForensicTable, spec: dict[str, str]) -> dict[str, str]:
    """{physical column: type} for headers declared in the spec (exact,
    case-sensitive header match; undeclared headers pass through)."""
    out = {}
    for h, c in zip(t.headers, t.columns):
        if h in spec:
            out[c] = spec[h]
    return out


def converted(t: ForensicTable, spec: dict[str, str]) -> DataFrame:
    return with_converted(t.df, matched_spec(t, spec), suffix=SUFFIX)


def typed_frame(t: ForensicTable, spec: dict[str, str], conv: DataFrame | None = None) -> DataFrame:
    """Canonical-string typed table: same rows, same columns, converted text."""
    m = matched_spec(t, spec)
    conv = conv if conv is not None else converted(t, spec)
    keep = [c for c in conv.columns if c.startswith("_") and not c.endswith(SUFFIX)
            and c not in t.columns]
    cols = [F.col(f"`{c}{SUFFIX}`.value").alias(c) if c in m else F.col(f"`{c}`") for c in t.columns]
    return conv.select(*[F.col(k) for k in keep], *cols)


def parse_errors(t: ForensicTable, spec: dict[str, str], index_col: str = "_row_index",
                 conv: DataFrame | None = None) -> DataFrame:
    """One row per failed cell: row_index, column, raw_value, expected_type, error."""
    m = matched_spec(t, spec)
    conv = conv if conv is not None else converted(t, spec)
    header_of = dict(zip(t.columns, t.headers))
    cells = [F.struct(F.lit(header_of[c]).alias("column"), F.col(f"`{c}`").cast("string").alias("raw_value"),
                      F.lit(ty).alias("expected_type"), F.col(f"`{c}{SUFFIX}`.error").alias("error"))
             for c, ty in m.items()]
    if not cells:
        return conv.select(F.col(index_col).cast("long").alias("row_index"), F.lit("").alias("column"),
                           F.lit("").alias("raw_value"), F.lit("").alias("expected_type"),
                           F.lit("").alias("error")).limit(0)
    ex = conv.select(F.col(index_col).cast("long").alias("row_index"), F.explode(F.array(*cells)).alias("_e"))
    return ex.where(F.col("_e.error").isNotNull()).select("row_index", "_e.*")


def parse_table(t: ForensicTable, spec: dict[str, str], index_col: str = "_row_index"):
    """(typed DataFrame, errors DataFrame) from one converted plan."""
    conv = converted(t, spec)
    return typed_frame(t, spec, conv), parse_errors(t, spec, index_col, conv)
