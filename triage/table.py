"""ForensicTable: a DataFrame of string cells plus its original header list.

Exported forensic tables may carry duplicate or odd header names that a
DataFrame cannot hold verbatim; ``headers`` keeps the file's header row and
``columns`` the physical DataFrame column holding each header position.
Hidden bookkeeping columns start with ``_`` (``_row_id``, ``_source_file``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class ForensicTable:
    df: DataFrame
    headers: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    name: str = ""

    @classmethod
    def of(cls, df: DataFrame, name: str = "") -> "ForensicTable":
        cols = [c for c in df.columns if not c.startswith("_")]
        return cls(df=df, headers=list(cols), columns=list(cols), name=name)

    def column_for(self, index: int | None) -> str | None:
        if index is None:
            return None
        return self.columns[index]
