"""Loadable rule sets (SRC-12): a JSON object {rule name: value} replaces the
built-in values of ``triage.rules`` while expressions are built.

Rules become literals of the plan, so a DataFrame that was built under a rule
set keeps it, whatever is loaded afterwards.
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import SparkSession

from triage import rules as R


def load_rules(spark: SparkSession, path: str) -> dict:
    """The rules of a JSON file; unknown names and other types are errors."""
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    loaded = json.loads(text)
    for name, value in loaded.items():
        built_in = getattr(R, name, None)
        if not name.isupper() or built_in is None:
            raise ValueError(f"unknown rule: {name}")
        if type(value) is not type(built_in):
            raise ValueError(f"rule {name}: expected {type(built_in).__name__}, got {type(value).__name__}")
    return loaded


@contextmanager
def using(loaded: dict):
    """Builds expressions under the given rules instead of the built-in ones."""
    before = {name: getattr(R, name) for name in loaded}
    version = R.VERSION
    try:
        for name, value in loaded.items():
            setattr(R, name, value)
        R.VERSION = json.dumps(loaded, sort_keys=True)
        yield
    finally:
        for name, value in before.items():
            setattr(R, name, value)
        R.VERSION = version
