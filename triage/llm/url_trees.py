"""Operator 10, URL filters: rules, and gradient-boosted trees on lexical
features for the urls that no rule decides.

The trees are trained from labelled urls (those with a verdict; here the ones
that a rule decides) on length, depth, digit ratio, character entropy,
parameter counts, host shape, and suffix statistics: the smoothed share of
blocked urls among the labelled ones with the same last host label, and with
the same first path segment.  Everything is DataFrame functions: features are
cut into ``BINS`` bins at quantiles over all labelled urls, labelled urls are
added up by their vector of bins, a level of a tree is one aggregate of
gradients by node, feature and bin (a bounded table, from which the splits are
chosen), and the trained trees are one arithmetic expression.

Null urls and urls without ``://`` have an empty host and path; no rule fits
them and the trees judge their (empty) text.  Repeated rows each give a row;
null page_ids stay null; other columns are ignored.  Without labelled urls,
or with labels of one kind alone, every undecided url gets the more frequent
label, ``allow`` if there is none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.common import saved

#: Fixed values of the contract: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "depth", "digits", "entropy", "params", "host_labels", "host_length", "path_length", "tail", "segment"]
BINS = 16
TREES = 10
DEPTH = 3
RATE = 0.3
RIDGE = 1.0
PRIOR_WEIGHT = 20.0


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url ('' for null), host, path."""
    url = F.coalesce("url", F.lit(""))
    df = pages.select("page_id", url.alias("url")).withColumn("_rest", F.expr("if(instr(url, '://') > 0, substr(url, instr(url, '://') + 3), '')"))
    df = df.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substr(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return df.select("page_id", "url", F.translate("_host", UPPER, LOWER).alias("host"), path.alias("path"))


def with_rule(df: DataFrame) -> DataFrame:
    """Adds rule and decided (the rule's verdict): the longest rule that fits."""
    rule = decided = None
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        decided = F.when(fits, verdict) if decided is None else decided.when(fits, verdict)
    return df.withColumn("rule", rule).withColumn("decided", decided)


def _entropy(text: str) -> Column:
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(F.col(text), c, F.lit("")))) / size
    return -F.aggregate(F.array_distinct(F.split(text, "(?<=.)(?=.)")), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def with_features(df: DataFrame) -> DataFrame:
    """Adds the numeric features and the keys of the suffix statistics."""
    return df.withColumns({
        "length": F.length("url").cast("double"),
        "depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
        "digits": (F.length("url") - F.length(F.translate("url", "0123456789", ""))) / F.greatest(F.length("url"), F.lit(1)),
        "entropy": _entropy("url"),
        "params": (F.length("url") - F.length(F.translate("url", "=&", ""))).cast("double"),
        "host_labels": (F.length("host") - F.length(F.translate("host", ".", ""))).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "_tail": F.substring_index("host", ".", -1),
        "_segment": F.regexp_extract("path", r"^/([^/]*)", 1),
    })


def suffix_statistics(labelled: DataFrame, key: str, name: str, prior: float) -> DataFrame:
    """(key, name): smoothed share of blocked urls for each value of key."""
    return labelled.groupBy(key).agg(((F.sum("_y") + PRIOR_WEIGHT * prior) / (F.count("*") + PRIOR_WEIGHT)).alias(name))


def _bin(feature: str, cuts: list[float]) -> Column:
    return sum((F.when(F.col(feature) > c, 1).otherwise(0) for c in cuts), F.lit(0))


def _leaf_sums(data: DataFrame, node: Column):
    """Sums of gradients and curvatures by node, feature and bin; bounded by
    2^DEPTH x features x BINS rows.  ``margin`` holds the trees so far."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"b{k}").alias("b")) for k in range(len(FEATURES)))))
    rows = data.withColumn("_p", p).withColumn("_node", node)
    return (rows.select("_node", cells.alias("x"), (F.col("pos") - F.col("_p") * F.col("n")).alias("g"), (F.col("_p") * (1 - F.col("_p")) * F.col("n")).alias("h"))
            .groupBy(F.col("_node").alias("node"), F.col("x.f").alias("f"), F.col("x.b").alias("b"))
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())


def _score(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def _splits(cells) -> dict[int, tuple[int, int, float, float]]:
    """Best (feature, bin, value left, value right) of each node; rows with bin
    <= the split's go left.  A node without a gain is split nowhere."""
    nodes: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in cells:
        nodes.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
    out = {}
    for node, by_feature in nodes.items():
        best = None
        for f in sorted(by_feature):
            bins = by_feature[f]
            g, h = (sum(x[k] for x in bins.values()) for k in (0, 1))
            gl = hl = 0.0
            for b in sorted(bins)[:-1]:
                gl, hl = gl + bins[b][0], hl + bins[b][1]
                gain = _score(gl, hl) + _score(g - gl, h - hl) - _score(g, h)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b, RATE * gl / (hl + RIDGE), RATE * (g - gl) / (h - hl + RIDGE))
            if best is None:
                best = (0.0, 0, BINS, RATE * g / (h + RIDGE), RATE * g / (h + RIDGE))
        out[node] = best[1:]
    return out


def _descend(levels: list[dict]) -> Column:
    """Node number of a row after the levels' splits: 2 * node (left) or 2 * node + 1."""
    node = F.lit(0)
    for splits in levels:
        step = F.lit(0)
        for k, (f, b, _, _) in sorted(splits.items()):
            step = F.when(node == k, F.when(F.col(f"b{f}") <= b, 2 * k).otherwise(2 * k + 1)).otherwise(step)
        node = step
    return node


def _value(levels: list[dict]) -> Column:
    """A tree as one expression."""
    def at(depth, node):
        split = levels[depth].get(node)
        if split is None:
            return F.lit(0.0)
        f, b, left, right = split
        if depth + 1 < len(levels):
            left, right = at(depth + 1, 2 * node), at(depth + 1, 2 * node + 1)
        else:
            left, right = F.lit(left), F.lit(right)
        return F.when(F.col(f"b{f}") <= b, left).otherwise(right)

    return at(0, 0)


class UrlTrees:
    """cuts: bin edges of each feature; trees: split levels; base: log-odds."""

    def __init__(self, labelled: DataFrame):
        """labelled: the output of with_features with label (allow or block)."""
        rows = labelled.withColumn("_y", (F.col("label") == "block").cast("double"))
        total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("y")).first()
        self.prior = (total["y"] + 0.5) / (total["n"] + 1.0)
        self.one_kind = total["y"] in (0, total["n"])
        self.most = "block" if total["n"] and total["y"] * 2 > total["n"] else "allow"
        self.trees: list[list[dict]] = []
        if self.one_kind:
            return
        self.statistics = [saved(suffix_statistics(rows, "_tail", "tail", self.prior), "url-tails"),
                           saved(suffix_statistics(rows, "_segment", "segment", self.prior), "url-segments")]
        rows = self.with_statistics(rows)
        at = [k / BINS for k in range(1, BINS)]
        edges = rows.agg(*(F.percentile_approx(f, at, 5000).alias(f) for f in FEATURES)).first()
        self.cuts = [sorted(set(edges[f])) for f in FEATURES]
        bins = self.with_bins(rows).groupBy(*(f"b{k}" for k in range(len(FEATURES)))).agg(F.count("*").alias("n"), F.sum("_y").alias("pos"))
        self.base = math.log(self.prior / (1 - self.prior))
        data = saved(bins.withColumn("margin", F.lit(self.base)), "url-bins")
        for _ in range(TREES):
            levels: list[dict] = []
            for _ in range(DEPTH):
                levels.append(_splits(_leaf_sums(data, _descend(levels))))
            self.trees.append(levels)
            data = saved(data.withColumn("margin", F.col("margin") + _value(levels)), "url-bins")

    def with_statistics(self, df: DataFrame) -> DataFrame:
        for table, key, name in zip(self.statistics, ("_tail", "_segment"), ("tail", "segment")):
            df = df.join(table, key, "left").withColumn(name, F.coalesce(name, F.lit(self.prior)))
        return df

    def with_bins(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"b{k}": _bin(f, self.cuts[k]) for k, f in enumerate(FEATURES)})

    def margin(self) -> Column:
        return sum((_value(t) for t in self.trees), F.lit(self.base))

    def judged(self, df: DataFrame) -> DataFrame:
        """Adds p_block and learned (allow or block)."""
        if self.one_kind:
            return df.withColumn("p_block", F.lit(float(self.most == "block"))).withColumn("learned", F.lit(self.most))
        df = self.with_bins(self.with_statistics(df)).withColumn("p_block", 1 / (1 + F.exp(-self.margin())))
        return df.withColumn("learned", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block."""
    rows = with_features(with_rule(parts(pages)))
    model = UrlTrees(rows.where("decided is not null").withColumn("label", F.col("decided")))
    return model.judged(rows).select("page_id", "host", "path", "rule", F.coalesce("decided", "learned").alias("verdict"), "p_block")
