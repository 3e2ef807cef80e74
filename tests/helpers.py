import os
import tempfile

from triage.table import ForensicTable


def table(spark, headers, rows, name=""):
    """ForensicTable from inline string rows (positional columns, _row_id = order)."""
    cols = [f"_c{i}" for i in range(len(headers))]
    data = [(i, *r) for i, r in enumerate(rows)]
    schema = "_row_id long, " + ", ".join(f"{c} string" for c in cols)
    return ForensicTable(spark.createDataFrame(data, schema), list(headers), cols, name)


def write(dirpath, name, content, mode="w", encoding="utf-8"):
    path = os.path.join(dirpath, name)
    if "b" in mode:
        with open(path, mode) as f:
            f.write(content)
    else:
        with open(path, mode, encoding=encoding, newline="") as f:
            f.write(content)
    return path


def tmpdir():
    return tempfile.mkdtemp(prefix="triage-test-", dir="/tmp")
