"""Per-key results when a few keys hold most records.

Method: copies of a record are folded once and written to the shared folder;
keys are dictionary-encoded into dense codes; every split of what was written,
of equal size, keeps dense accumulator arrays (numpy bincount and
scatter-reduce), however its keys are mixed; the arrays' blocks are summed by a
distributed reduction.  No task's work depends on how many rows one key has.

Defined results: rows with a null key part or null order column are ignored;
repeated rows of a record (key, order) count once in records, the version with
the greatest version column supplies the value (ties: the greater value); a
null value adds nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import scan
from tidewell.session import staged

#: Codes per accumulator block.
BLOCK_SIZE = 4096
#: A dictionary of at most this many keys (about 40 MB, counted first) is broadcast whole, of a larger one its heaviest keys.
BROADCAST_KEYS = 500_000
#: Keys with at least one in so many records are heavy, so there are at most as many of them.
HEAVIEST = 1000
#: Open accumulator blocks per task (about 160 kB each) before they are flushed.
OPEN_BLOCKS = 512


def dictionary(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, n, code): rows of each key and dense codes from 0 in key order, ranked by ranges, so that no task sees all keys."""
    counted = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return scan.running_count(counted, [], keys, "code").select(*keys, "n", F.col("code").cast("bigint"))


def encode(records: DataFrame, codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds code.  A dictionary beyond BROADCAST_KEYS is joined by shuffle, but for
    its heaviest keys, which are few by definition."""
    total = codes.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).first()
    names = codes.drop("n")
    if total["keys"] <= BROADCAST_KEYS:
        return records.join(F.broadcast(names), list(keys))
    heavy = codes.filter(F.col("n") >= F.lit(max(1, -(-total["n"] // HEAVIEST)))).drop("n")
    first = records.join(F.broadcast(heavy), list(keys))
    rest = records.join(F.broadcast(heavy.drop("code")), list(keys), "left_anti").join(names.hint("merge"), list(keys))
    return first.unionByName(rest)


_SCHEMA = "block bigint, records array<bigint>, stored array<bigint>, newest array<bigint>, hi array<bigint>, lo array<bigint>"


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns code, order, stored, value (unscaled long).  Values are summed as
    two 32-bit halves, so that sums of a split cannot overflow."""
    low = np.iinfo(np.int64).min
    blocks: dict[int, list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if blocks:
            ids = sorted(blocks)
            cols = [pa.array(ids, pa.int64())] + [pa.array([blocks[i][k] for i in ids], pa.list_(pa.int64())) for k in range(5)]
            blocks.clear()
            yield pa.RecordBatch.from_arrays(cols, ["block", "records", "stored", "newest", "hi", "lo"])

    for batch in batches:
        code = batch.column(0).to_numpy()
        order = batch.column(1).to_numpy()
        stored = batch.column(2).to_numpy()
        value = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
        hi, lo = value >> 32, value & 0xFFFFFFFF
        which = code // BLOCK_SIZE
        for b in np.unique(which):
            at = which == b
            c = code[at] - b * BLOCK_SIZE
            acc = blocks.get(int(b))
            if acc is None:
                acc = blocks[int(b)] = [np.zeros(BLOCK_SIZE, np.int64), np.zeros(BLOCK_SIZE, np.int64), np.full(BLOCK_SIZE, low), np.zeros(BLOCK_SIZE, np.int64), np.zeros(BLOCK_SIZE, np.int64)]
            acc[0] += np.bincount(c, minlength=BLOCK_SIZE)
            # float64 sums of a batch stay exact: batches hold far fewer than 2**21 rows of 32-bit halves
            acc[1] += np.bincount(c, weights=stored[at], minlength=BLOCK_SIZE).astype(np.int64)
            np.maximum.at(acc[2], c, order[at])
            acc[3] += np.bincount(c, weights=hi[at], minlength=BLOCK_SIZE).astype(np.int64)
            acc[4] += np.bincount(c, weights=lo[at], minlength=BLOCK_SIZE).astype(np.int64)
        if len(blocks) >= OPEN_BLOCKS:
            yield from flush()
    yield from flush()


def key_totals(rows: DataFrame, keys: Sequence[str], order: str, version: str, value: str, scale: int = 6) -> DataFrame:
    """(keys…, records, stored, newest, total): distinct records, stored rows,
    the greatest order and the sum of value (decimal) over current versions."""
    keys = list(keys)
    usable = rows.dropna(subset=[*keys, order])
    unscaled = (F.col(value) * F.lit(10**scale)).cast("decimal(38,0)").cast("bigint")
    version = F.max(F.struct(F.col(version), unscaled.alias("v")))["v"]
    per_record = usable.groupBy(*keys, F.col(order).cast("bigint").alias("__order")).agg(F.count(F.lit(1)).alias("__stored"), version.alias("__value"))
    records = staged(per_record, "records")
    codes = staged(dictionary(records, keys), "codes")
    coded = encode(records, codes, keys).select("code", "__order", "__stored", "__value")
    arrays = coded.mapInArrow(_accumulate, _SCHEMA)
    zipped = arrays.select("block", F.posexplode(F.arrays_zip("records", "stored", "newest", "hi", "lo")).alias("at", "x")).filter("x.records > 0")
    sums = zipped.groupBy((F.col("block") * BLOCK_SIZE + F.col("at")).alias("code")).agg(
        F.sum("x.records").alias("records"), F.sum("x.stored").alias("stored"), F.max("x.newest").alias("newest"),
        F.sum(F.col("x.hi").cast("decimal(38,0)")).alias("hi"), F.sum(F.col("x.lo").cast("decimal(38,0)")).alias("lo"),
    )
    micro = F.col("hi") * F.lit(2**32).cast("decimal(11,0)") + F.col("lo")
    total = (micro.cast("decimal(32,0)") * F.lit(10**-scale).cast(f"decimal({scale + 1},{scale})")).cast("decimal(38,6)")
    return codes.drop("n").join(sums, "code").select(*keys, "records", "stored", "newest", total.alias("total"))


def heavy_keys(totals: DataFrame, keys: Sequence[str], share: float = 0.04) -> DataFrame:
    """Keys with at least share of all records; at most 1/share rows."""
    kept = staged(totals.select(*keys, "records"), "totals")
    everything = kept.agg(F.sum("records")).first()[0] or 0
    return kept.filter(F.col("records") * 10_000 >= F.lit(everything * round(share * 10_000))).select(*keys)
