"""Operator 1, WARC fixity audit: Merkle trees over ordered offset ranges.

Every record is hashed together with its offset.  A leaf covers ``FANOUT``
consecutive offsets; its hash is that of the number of its records and of the
sums of their hashes' eight 32-bit lanes.  Such sums are added up before the
shuffle and hold one small row for a range, so a range (or an offset) with any
number of records is no task's burden.  An inner node is the hash of its
children's hashes in order, at most ``FANOUT``; a file of
FANOUT^(``LEVELS`` + 1) offsets has one root.

The audit compares the replicas' roots, then level by level only the children
of differing nodes, and at last only the records of differing leaves.

Records are identified by offset: a null offset counts as offset -1.  Every
field is hashed with its byte length, whatever it holds; null fields hash
differently from empty ones.  Repeated records count as often as
they occur.  Other columns are ignored.  An empty replica differs in every
file; two empty ones give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.common import saved

FANOUT = 16
LEVELS = 2
FILE = FANOUT ** (LEVELS + 1)


def _field(name: str):
    """A field with its byte length in front, so that no content can shift the border between two fields."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def records(replica: DataFrame, offset: str, fields: list[str]) -> DataFrame:
    """(o, digest) of each record."""
    o = F.coalesce(F.col(offset).cast("long"), F.lit(-1))
    return replica.select(o.alias("o"), F.sha2(F.concat_ws("\x1f", o.cast("string"), *map(_field, fields)), 256).alias("digest"))


def _range(col: str, width: int = FANOUT):
    """Number of the range of ``width`` (a power of two) that holds a value."""
    return F.shiftright(col, width.bit_length() - 1)


def leaves(recs: DataFrame) -> DataFrame:
    """(node, hash) of the offset ranges."""
    lane = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    sums = recs.groupBy(_range("o").alias("node")).agg(
        F.count("*").alias("n"), *(F.sum(lane(i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)))
    return sums.select("node", F.sha2(F.concat_ws("|", "n", *(f"s{i}" for i in range(8))), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return (nodes.groupBy(_range("node").alias("up")).agg(kids.alias("kids"))
            .select(F.col("up").alias("node"), F.sha2(F.concat_ws(",", F.transform("kids", lambda k: F.concat(k["node"].cast("string"), F.lit(":"), k["hash"]))), 256).alias("hash")))


def tree(recs: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots."""
    levels = [saved(leaves(recs), "merkle-leaves")]
    for _ in range(LEVELS):
        levels.append(parents(levels[-1]))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, hash_a, hash_b) of nodes that are not equal in both."""
    return (a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), "node", "full")
            .where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))))


def audit(rec_a: DataFrame, rec_b: DataFrame) -> DataFrame:
    """(file, root_a, root_b, leaf, record, digest, n_a, n_b): record hashes
    that occur differently often in the two replicas, with their path."""
    rec_a, rec_b = saved(rec_a, "merkle-a"), saved(rec_b, "merkle-b")
    tree_a, tree_b = tree(rec_a), tree(rec_b)
    roots = bad = saved(differing(tree_a[-1], tree_b[-1]), "merkle-roots")
    for a, b in zip(reversed(tree_a[:-1]), reversed(tree_b[:-1])):
        up = bad.select(F.col("node").alias("up"))
        below = [x.withColumn("up", _range("node")).join(up, "up", "left_semi").drop("up") for x in (a, b)]
        bad = saved(differing(*below), "merkle-level")
    leaf = bad.select(F.col("node").alias("leaf"))
    inside = [x.withColumn("leaf", _range("o")).join(leaf, "leaf", "left_semi").groupBy("leaf", "o", "digest").agg(F.count("*").alias("n"))
              for x in (rec_a, rec_b)]
    found = (inside[0].withColumnRenamed("n", "n_a").join(inside[1].withColumnRenamed("n", "n_b"), ["leaf", "o", "digest"], "full")
             .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b")}).where("n_a <> n_b"))
    return (found.withColumn("file", _range("o", FILE)).join(roots.select(F.col("node").alias("file"), F.col("hash_a").alias("root_a"), F.col("hash_b").alias("root_b")), "file", "left")
            .select("file", "root_a", "root_b", "leaf", F.col("o").alias("record"), "digest", "n_a", "n_b"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica with faults that follow from page_id: of 199 residues,
    at one a byte is added, at one the record is lost, at one it is stored twice."""
    fault = F.coalesce(F.pmod(F.col("page_id") * 7919 + 13, F.lit(199)), F.lit(0))
    changed = F.when(fault == 3, F.concat(F.coalesce("html", F.lit("")), F.lit("\x00"))).otherwise(F.col("html"))
    copies = F.when(fault == 5, F.lit(0)).when(fault == 7, F.lit(2)).otherwise(F.lit(1))
    return (pages.select("page_id", "url", changed.alias("html"), copies.alias("_copies")).where("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("page_id", "url", "html"))


#: DuckDB: whole trees of both replicas for the roots, and the differing records found without descending.
SQL = """
WITH given AS (SELECT coalesce(page_id, -1) AS o, url, html, coalesce((page_id * 7919 + 13) % 199, 0) AS fault FROM pages),
rec AS (
  SELECT side, o, sha256(concat_ws(chr(31), o::VARCHAR, coalesce(strlen(url) || ':' || url, 'n'), coalesce(strlen(html) || ':' || html, 'n'))) AS digest
  FROM (SELECT 'a' AS side, o, url, html FROM given UNION ALL
  SELECT 'b', o, url, CASE WHEN fault = 3 THEN coalesce(html, '') || chr(0) ELSE html END
  FROM (SELECT *, unnest(range(CASE fault WHEN 5 THEN 0 WHEN 7 THEN 2 ELSE 1 END)) AS k FROM given))),
leaf AS (SELECT side, o >> 4 AS node, sha256(concat_ws('|', count(*)::VARCHAR, {lanes})) AS hash FROM rec GROUP BY 1, 2),
mid AS (SELECT side, node >> 4 AS node, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM leaf GROUP BY side, node >> 4),
root AS (SELECT side, node >> 4 AS node, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM mid GROUP BY side, node >> 4),
diff AS (SELECT o, digest, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b FROM rec GROUP BY o, digest)
SELECT o >> 12 AS file, ra.hash AS root_a, rb.hash AS root_b, o >> 4 AS leaf, o AS record, digest, n_a, n_b
FROM diff LEFT JOIN root ra ON ra.side = 'a' AND ra.node = o >> 12 LEFT JOIN root rb ON rb.side = 'b' AND rb.node = o >> 12
WHERE n_a <> n_b
""".replace("{lanes}", ", ".join(f"sum(('0x' || substr(digest, {8 * i + 1}, 8))::UBIGINT)::VARCHAR" for i in range(8)))
