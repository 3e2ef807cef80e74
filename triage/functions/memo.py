"""Memoisation of Column-expression builders.

Column expressions are unresolved trees that can be reused by any
DataFrame of the same SparkContext; building them costs one Py4J round
trip per node, so builders that only depend on names / types / the rule set
in use are cached per active SparkContext.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext

from triage import rules


def per_context(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        if sc is None:
            return fn(*args)
        # application id + start time identify a context even after a restart
        # (Python may reuse the id() of a stopped context's object)
        key = (sc.applicationId, sc.startTime, rules.VERSION, args)
        if key not in cache:
            if len(cache) > 512:
                cache.clear()
            cache[key] = fn(*args)
        return cache[key]

    return wrapper
