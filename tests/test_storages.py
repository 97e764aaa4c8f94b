from decimal import Decimal
from pathlib import Path

import pytest
from conftest import rows

from tidewell.plans import storages
from tidewell.session import shared_dir

TABLE = "_file_id bigint, id int, name string, parent_id bigint, child_ids array<int>"
GREATEST = 2**55 - 1  # a payload's numbers are below 2**56, folded


def tables(spark, path, data):
    spark.createDataFrame(data, TABLE).write.parquet(f"{path}/test_table.parquet")
    return str(path)


@pytest.mark.parametrize("query, rest", [("avro_files", -5), ("protobuf_files", 5)])
def test_sums_of_payload_files_beyond_64_bits(spark, tmp_path, query, rest):
    run = storages.QUERIES[query]
    d = tables(spark, tmp_path / "wide", [(1, i, "a", GREATEST, [1, -2, None]) for i in range(300)] + [(1, 4, None, None, None)])
    assert rows(run(spark, d)) == [(False, 300, 300 * GREATEST), (True, 1, rest)]
    d = tables(spark, tmp_path / "fits", [(1, i, "a", GREATEST, [1]) for i in range(200)] + [(1, 4, None, None, None)])
    assert rows(run(spark, d)) == [(False, 200, 200 * GREATEST), (True, 1, rest)]
    assert dict(run(spark, d).dtypes) == {"no_text": "boolean", "records": "bigint", "n": "bigint"}


def test_parquet_settings_keeps_one_portion_of_one_codec(spark, tmp_path, monkeypatch):
    df = spark.range(400).selectExpr("IF(id % 3 = 0, NULL, concat('t', id % 3)) AS _topic", "CAST(id AS DECIMAL(18,6)) / 4 AS money").selectExpr("_topic", "CAST(money AS DECIMAL(18,6)) AS money_spent")
    df.coalesce(1).write.parquet(f"{tmp_path}/test_table.parquet")
    monkeypatch.setattr(storages, "PORTION_ROWS", 150, raising=False)
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before, read, seen = set(shared.rglob("*.parquet")), storages.files.read_parquet, []

    def watched(spark, base):
        filtered = [p for p in shared.rglob("*.parquet") if p not in before and p.is_file() and p.stat().st_size > 1 << 20]  # those with bloom filters
        assert filtered and all(str(p).startswith(base.removeprefix("file://")) for p in filtered)
        back = read(spark, base)
        seen.append(back.count())
        return back

    monkeypatch.setattr(storages.files, "read_parquet", watched)
    got = {(r["codec"], r["_topic"]): (r["records"], r["money_spent"]) for r in storages.parquet_settings(spark, str(tmp_path)).collect()}
    want = {t: [i for i in range(400) if (f"t{i % 3}" if i % 3 else None) == t] for t in (None, "t1", "t2")}
    assert got == {(c, t): (len(v), Decimal(sum(v)) / 4) for c in ("none", "zstd", "gzip", "snappy", "lz4") for t, v in want.items()}
    assert len(seen) == 15 and sum(seen) == 5 * 400 and max(seen) <= 200
