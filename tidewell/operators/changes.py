"""Processing only new or changed records, by a Merkle tree over key ranges.

A record is (topic, partition, offset).  Its current content is the row with
the greatest file id, its saved content the row that the last successful run
saw.  Leaves are ranges of 2**LEAF_BITS offsets of one topic partition.  A leaf's
current digest combines the digests of all its stored rows, its saved digest
those of the rows that the last successful runs saw; a parent's digests combine
those of its children.  Leaves need no versions of a record to be compared, so
they come from one hash aggregation.  changed_leaves() descends from the roots
only into nodes whose current and saved digests differ; only the rows of leaves
reached that way are grouped by record, and their contents compared.

Defined results: rows with a null key part count in nothing; rows with a null
file id are seen by no run; of rows with the same record and file id the one
with the greater digest stands; an attempt counts by its last state (ties in
logged_at: the greater state name); a ledger row with a null end, or an end
below its start, covers nothing; empty tables give no rows (an empty ledger:
every record).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import scan
from tidewell.session import staged

KEYS = ["_topic", "_partition"]
CONTENT = ["id", "name", "timestamp", "height", "width", "is_enabled", "child_ids", "parent_id", "transaction_id", "money_spent"]
#: Stands for the null file id of rows loaded by hand: below all others, seen by no run.
NO_FILE = -(1 << 62)
LEAF_BITS = 8
FANOUT_BITS = 6
LEVELS = 4
#: Changed leaves (about 50 bytes each) that may be broadcast.
BROADCAST_LEAVES = 200_000


def content_digest(columns: Sequence[str], arrays: Sequence[str] = ("child_ids",)) -> Column:
    """128 bits over the columns; nulls and array lengths are part of it, since
    the hash functions skip nulls and empty arrays."""
    marks = [F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.size(c) if c in arrays else F.lit(0)) for c in columns]
    cols = [F.col(c) for c in columns]
    return F.struct(F.xxhash64(*cols, *marks).alias("a"), F.xxhash64(F.lit(7919), *marks, *reversed(cols)).alias("b"))


def committed_ranges(run_ledger: DataFrame) -> DataFrame:
    """(_topic, _partition, s, e, seen): ranges of attempts whose last state is committed; seen is the greatest file id."""
    last = run_ledger.groupBy("run_id", "attempt").agg(
        F.max(F.struct("logged_at", "run_state", *KEYS, F.col("_start_offset").alias("s"), F.col("_end_offset").alias("e"), F.col("_max_file_id").alias("seen"))).alias("r")
    )
    ok = "run_state = 'committed' and _topic is not null and _partition is not null and s is not null and e >= s and seen is not null"
    return last.select("r.*").filter(ok).groupBy(*KEYS, "s", "e").agg(F.max("seen").alias("seen"))


def coverage_points(ranges: DataFrame, levels: int = 48) -> DataFrame:
    """(_topic, _partition, at, seen): from offset at on (to the next such row)
    the greatest seen of the ranges that cover it; null: none covers it.

    Every range is cut into its canonical dyadic nodes, at most two a level;
    a point looks up its ancestors.  No pair of overlapping ranges is formed."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    spread = ranges.withColumn("lv", level).withColumn("lo", F.expr("shiftright(s + shiftleft(1L, lv) - 1, lv)")).withColumn("hi", F.expr("shiftright(e + 1, lv)")).filter("lo < hi")
    left = spread.filter("lo % 2 = 1").select(*KEYS, "lv", F.col("lo").alias("node"), "seen")
    right = spread.filter("hi % 2 = 1").select(*KEYS, "lv", (F.col("hi") - 1).alias("node"), "seen")
    nodes = left.unionByName(right).groupBy(*KEYS, "lv", "node").agg(F.max("seen").alias("seen"))
    at = ranges.select(*KEYS, F.explode(F.array(F.col("s"), F.col("e") + 1)).alias("at")).distinct()
    probes = at.withColumn("lv", level).withColumn("node", F.expr("shiftright(at, lv)"))
    found = probes.join(nodes.hint("merge"), [*KEYS, "lv", "node"], "left")
    return found.groupBy(*KEYS, "at").agg(F.max("seen").alias("seen"))


def _levels(ranges: DataFrame) -> int:
    """Levels that the longest range can need: one number to the driver."""
    widest = ranges.agg(F.max(F.col("e") - F.col("s") + 1)).first()[0] or 1
    return min(62, int(widest).bit_length())


def row_digests(test_table: DataFrame, run_ledger: DataFrame, columns: Sequence[str] = CONTENT) -> DataFrame:
    """(_topic, _partition, _offset, f, a, b, seen): file id and digest of each stored
    row, and whether a successful run has seen it.

    Which run covers an offset is an as-of lookup of the last coverage point at
    or below it: a running maximum of (at, seen), by blocks of offsets."""
    rows = test_table.filter("_topic is not null and _partition is not null and _offset is not null").select(
        *KEYS, "_offset", F.struct(F.coalesce("_file_id", F.lit(NO_FILE)).alias("f"), content_digest(columns).alias("h")).alias("row"), F.lit(None).cast("struct<at:bigint,seen:bigint>").alias("point")
    )
    ranges = staged(committed_ranges(run_ledger), "ranges")
    # written once: it is as small as the ledger, and both the carries and the scan read it
    points = staged(coverage_points(ranges, _levels(ranges)), "coverage").select(*KEYS, F.col("at").alias("_offset"), F.struct("at", "seen").alias("point"))
    carried = scan.with_carries(rows.unionByName(points, allowMissingColumns=True), KEYS, "_offset", "point")
    w = Window.partitionBy(*KEYS, scan.BLOCK).orderBy("_offset").rangeBetween(Window.unboundedPreceding, 0)
    known = carried.withColumn("upto", F.max("point").over(w)["seen"]).filter("row is not null")
    seen = F.coalesce((F.col("row.f") <= F.col("upto")) & (F.col("row.f") != NO_FILE), F.lit(False))
    return known.select(*KEYS, "_offset", "row.f", "row.h.a", "row.h.b", seen.alias("seen"))


def leaves(rows: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """(_topic, _partition, node, current, saved): digests of leaf ranges.

    A pair (xor, count) of independently keyed hashes makes up a digest; rows
    that cancel each other out still count.  Combined before the shuffle."""
    key = [F.col("_topic"), F.col("_partition"), F.col("_offset"), F.col("f"), F.col("a"), F.col("b")]
    both = [F.xxhash64(*key), F.xxhash64(*reversed(key), F.lit(104729))]

    def digest(wanted: Column) -> Column:
        x = [F.bit_xor(F.when(wanted, h).otherwise(F.lit(0).cast("bigint"))) for h in both]
        return F.struct(x[0].alias("a"), x[1].alias("b"), F.count(F.when(wanted, 1)).alias("n"))

    return rows.groupBy(*KEYS, F.shiftright("_offset", leaf_bits).alias("node")).agg(digest(F.lit(True)).alias("current"), digest(F.col("seen")).alias("saved"))


def parents(nodes: DataFrame, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """The level above: each node's digest is over its children's digests and places."""
    def over(c: str) -> Column:
        d = F.col(c)
        return F.struct(
            F.bit_xor(F.when(d["n"] > 0, F.xxhash64("node", d["a"], d["b"], d["n"])).otherwise(F.lit(0).cast("bigint"))).alias("a"),
            F.bit_xor(F.when(d["n"] > 0, F.xxhash64(d["n"], d["b"], d["a"], "node")).otherwise(F.lit(0).cast("bigint"))).alias("b"),
            F.sum(d["n"]).alias("n"),
        )

    return nodes.groupBy(*KEYS, F.shiftright("node", fanout_bits).alias("node")).agg(over("current").alias("current"), over("saved").alias("saved"))


def tree(leaf_nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Levels from the leaves up."""
    out = [leaf_nodes]
    for _ in range(levels - 1):
        out.append(parents(out[-1]))
    return out


def changed_leaves(levels: Sequence[DataFrame], fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """(_topic, _partition, node) of leaves that differ, found from the top down."""
    differs = ~F.col("current").eqNullSafe(F.col("saved"))
    open_nodes = levels[-1].filter(differs).select(*KEYS, "node")
    for level in reversed(levels[:-1]):
        below = level.filter(differs).select(*KEYS, "node", F.shiftright("node", fanout_bits).alias("__up"))
        open_nodes = below.join(open_nodes.withColumnRenamed("node", "__up").hint("merge"), [*KEYS, "__up"], "left_semi").select(*KEYS, "node")
    return open_nodes


def within(rows: DataFrame, changed: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The rows whose leaf is in changed: (_topic, _partition, node), a stored table.

    Changed leaves are broadcast up to BROADCAST_LEAVES of them, which are
    counted; beyond that both sides are sorted and merged."""
    few = changed.count() <= BROADCAST_LEAVES
    placed = rows.withColumn("node", F.shiftright("_offset", leaf_bits))
    return placed.join(F.broadcast(changed) if few else changed.hint("merge"), [*KEYS, "node"], "left_semi").drop("node")


def differing(rows: DataFrame) -> DataFrame:
    """(_topic, _partition, _offset) of records without a seen row, or whose newest row differs from the newest seen one."""
    version = F.struct("f", "a", "b")
    saved = F.max(F.when(F.col("seen"), version))
    per = rows.groupBy(*KEYS, "_offset").agg(F.max(version).alias("c"), saved.alias("s"))
    return per.filter(F.col("s").isNull() | (F.col("c.a") != F.col("s.a")) | (F.col("c.b") != F.col("s.b"))).select(*KEYS, "_offset")


def to_process(test_table: DataFrame, run_ledger: DataFrame, columns: Sequence[str] = CONTENT) -> DataFrame:
    """Records new or changed since they were last processed successfully.

    The table is read and hashed once; digests of rows and leaves are written to
    the shared folder.  Descending reads leaves only, comparing contents the rows
    of changed leaves."""
    rows = staged(row_digests(test_table, run_ledger, columns), "digests")
    changed = staged(changed_leaves(tree(staged(leaves(rows), "leaves"))), "changed")
    return differing(within(rows, changed))
