import json
import uuid
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewell.commit import loading, metadata, protocols
from tidewell.commit.ledger import Ledger, Offset, positions_frame
from tidewell.model import OffsetInterval, Position, Range, WatermarkInterval
from tidewell.operators import commit_strategy, formatting, positions, ranges, rewind, routing, watermark
from tidewell.operators.commit_strategy import AnyOf, FuzzyAnyOf
from tidewell.sources import files
from tidewell.sources import log as logs
from tidewell.streaming import retry, stateful
from tidewell.streaming.engine import Ingest, ProgressListener, stream_log

LOG = "topic string, partition int, offset bigint, timestamp_ms bigint"


def log_of(spark, data):
    return spark.createDataFrame([("t", *r) for r in data], LOG)


def test_watermarks(spark):
    marks = lambda times, **kw: [r["watermark_ms"] for r in watermark.with_watermark(log_of(spark, [(0, i, ts) for i, ts in enumerate(times)]), **kw).orderBy("offset").collect()]
    assert marks([10, 2, 3, 11], now_ms=1000) == [10, 10, 10, 11]
    assert marks([1, 101], now_ms=0, skew_ms=100) == [1, 1]
    assert marks([1, 101], now_ms=1, skew_ms=100) == [1, 101]
    assert marks([-1, None, 5], now_ms=1000) == [-1, -1, 5]
    seeds = spark.createDataFrame([("t", 0, 7)], "topic string, partition int, seed_ms bigint")
    assert marks([3, 9], now_ms=1000, seeds=seeds) == [7, 9]


def test_watermark_goes_on_across_micro_batches_as_in_one(spark, tmp_path):
    data = [(p, o, (o * 7919) % 50) for p in range(2) for o in range(20)]
    once = rows(watermark.with_watermark(log_of(spark, data), now_ms=30, skew_ms=0).select("partition", "offset", "watermark_ms"))
    source = tmp_path / "in"
    for part in (data[:7] + data[20:25], data[7:20] + data[25:]):
        log_of(spark, part).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    marked = stateful.MarkedLog(spark, str(tmp_path / "marks"), now_ms=30, skew_ms=0)
    stream.writeStream.foreachBatch(marked.process).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(marked.read().select("partition", "offset", "watermark_ms")) == once


def test_ranges(spark):
    r = spark.createDataFrame([("t", 1, 0, 0), ("t", 1, 10, 10), ("t", 1, 11, 10), ("t", 2, 1, 1), ("t", 2, 2, 11)], "topic string, partition int, offset bigint, watermark_ms bigint")
    assert rows(ranges.build(r)) == [("t", 1, 0, 0, 11, 10), ("t", 2, 1, 1, 2, 11)]
    assert Range("t", 0, Position(1, 1), Position(2, 2)).merge(Range("t", 0, Position(2, 2), Position(4, 4))) == Range("t", 0, Position(1, 1), Position(4, 4))
    with pytest.raises(ValueError):
        Range("t", 0, Position(1), Position(2)).merge(Range("t", 1, Position(1), Position(2)))
    schema = "topic string, partition int, start_offset bigint, start_watermark_ms bigint, end_offset bigint, end_watermark_ms bigint"
    a = spark.createDataFrame([("t", p, 1, 1, 2, 2) for p in (0, 1, 2)], schema)
    b = spark.createDataFrame([("t", p, 3, 3, 4, 4) for p in (0, 1, 3)], schema)
    assert rows(ranges.merge(a, b)) == [("t", 0, 1, 1, 4, 4), ("t", 1, 1, 1, 4, 4), ("t", 2, 1, 1, 2, 2), ("t", 3, 3, 3, 4, 4)]
    assert Position(1, 99) < Position(2, 0)


REWIND_LOG = [(0, 0, 0), (0, 10, 100), (0, 20, 90), (0, 30, 200), (1, 0, 0), (1, 10, 100), (1, 20, 300)]


@pytest.mark.parametrize(
    "interval, p0, p1",
    [
        (OffsetInterval(0), (31, 200), (21, 300)), (OffsetInterval(10), (21, 200), (11, 300)), (OffsetInterval(1000), (0, 200), (0, 300)),
        (WatermarkInterval(150), (10, 100), (20, 300)), (WatermarkInterval(36_000_000), (0, 0), (0, 0)),
    ],
)
def test_rewind(spark, interval, p0, p1):
    committed = positions_frame(spark, {("t", 0): Position(31, 200), ("t", 1): Position(21, 300), ("t", 2): None})
    assert rows(rewind.rewind(committed, log_of(spark, REWIND_LOG), interval).select("partition", "offset", "watermark_ms")) == [(0, *p0), (1, *p1), (2, None, None)]


def test_warm_up_touches_old_records_and_writes_new_ones(spark):
    committed = positions_frame(spark, {("t", 0): Position(31, 200), ("t", 1): Position(21, 300), ("t", 2): None})
    new = [(0, 31, 0), (0, 32, 0), (1, 21, 0), (1, 22, 0), (2, 0, 0)]
    got = rewind.split(log_of(spark, REWIND_LOG + new), committed)
    assert rows(got.filter("rewound").select("partition", "offset")) == sorted((p, o) for p, o, _ in REWIND_LOG)
    assert rows(got.filter("not rewound").select("partition", "offset")) == sorted((p, o) for p, o, _ in new)


def test_offsets_for_times_and_patterns(spark):
    log = log_of(spark, [(0, 0, 5), (0, 1, 9), (0, 2, 7)])
    targets = spark.createDataFrame([("t", 0, 6), ("t", 0, 10), ("u", 0, 1)], "topic string, partition int, target_ms bigint")
    assert rows(logs.offsets_for_times(log, targets).select("topic", "target_ms", "offset", "timestamp_ms")) == [("t", 6, 1, 9), ("t", 10, None, None), ("u", 1, None, None)]
    assert logs.topic_pattern(log, "t|u").count() == 3 and logs.topic_pattern(log, "tt").count() == 0
    assert logs.kafka_options("h:1", ["a"], positions={"a": {0: 5}})["startingOffsets"] == '{"a": {"0": 5}}'
    for bad in ({"topic_list": ["a"], "extra": {"kafka.enable.auto.commit": "true"}}, {}, {"topic_list": ["a"], "pattern": "b"}):
        with pytest.raises(ValueError):
            logs.kafka_options("h:1", **bad)


def test_positions_and_committed(spark):
    p = positions_frame(spark, {("t", 0): Position(5, 1), ("t", 1): None})
    r = spark.createDataFrame([(1, "t", 0, 4), (2, "t", 0, 5), (3, "t", 0, 4), (3, "t", 1, 0)], "b int, topic string, partition int, end_offset bigint")
    assert rows(positions.committed(r, p, "b")) == [(1, True), (2, False), (3, False)]
    assert rows(positions.requested(spark.createDataFrame([("t", 0), ("t", 9)], "topic string, partition int"), p)) == [("t", 0, 5, 1), ("t", 9, None, None)]


def test_groups(spark):
    parts = lambda *ps: spark.createDataFrame([("t", p) for p in ps], "topic string, partition int")
    g = routing.modulo_group(2)
    assert rows(routing.assign(parts(0, 1), parts(1, 2), g)) == [("t", 0, "partition_0"), ("t", 1, "partition_1"), ("t", 2, "partition_0")]
    assert rows(routing.revoke(parts(0, 1, 2), parts(1), g)) == [("t", 0, "partition_0"), ("t", 2, "partition_0")]


def test_strategies(spark):
    with pytest.raises(ValueError):
        AnyOf()
    s = AnyOf(open_ms=10, size=100, records=5)
    assert s.reached(10, lambda: 0, 0) and s.reached(0, lambda: 100, 0) and s.reached(0, lambda: 0, 5) and not s.reached(9, lambda: 99, 4)
    stats = spark.createDataFrame([(1, 10, 1, 1), (1, 0, 1, 1), (2, 10, 60, 1), (2, 11, 60, 1)], "b int, open_ms bigint, size bigint, records bigint")
    assert rows(commit_strategy.any_file(stats, ["b"], s)) == [(1, True), (2, True)]
    assert rows(commit_strategy.all_files(stats, ["b"], s)) == [(1, False), (2, True)]
    assert rows(commit_strategy.total(stats, ["b"], AnyOf(size=100)).select("b", "open_ms", "size", "ready")) == [(1, 10, 2, False), (2, 11, 120, True)]
    fuzzy = FuzzyAnyOf(open_ms=(10_000, 0), size=(1000, 0), records=(1000, 0), size_every=5, seed=1)
    assert [fuzzy.reached(0, lambda: 1000, 0) for _ in range(10)] == [False] * 4 + [True] + [False] * 4 + [True]
    assert fuzzy.reached(10_000, lambda: 0, 0) and fuzzy.reached(0, lambda: 0, 1000)


def test_count_cuts_and_prefilter_ranges(spark):
    log = log_of(spark, [(p, o, 60_000 * ((o * 7) % 5)) for p in range(2) for o in range(50)])
    cut = commit_strategy.cut_by_count(log, ["topic"], 30).groupBy("batch").count()
    assert rows(cut) == [(0, 30), (1, 30), (2, 30), (3, 10)]
    counts = formatting.written_and_batched(log, formatting.filtering("offset % 2 = 0 and partition = 0"))
    assert rows(counts) == [("t", 0, 50, 25), ("t", 1, 50, 0)]


def test_metadata_json_and_fallbacks():
    m = metadata.CommitMetadata(900, metadata.Staged("s", Position(17, 300), Position(40, 900)))
    # names and their order are fixed values of the format
    assert m.to_json() == '{"watermark":900,"staged":{"staging":"s","start_offset":17,"start_watermark":300,"end_offset":40,"end_watermark":900}}'
    assert metadata.CommitMetadata(5).to_json() == '{"watermark":5}'
    assert metadata.CommitMetadata.deserialize(m.serialize()) == m == metadata.CommitMetadata.deserialize(m.to_json())
    for bad in ("", "{}", "bm9wZQ==", '{"watermark":"x"}', '{"watermark":1,"staged":{}}1'):
        assert metadata.CommitMetadata.deserialize(bad) is None


def test_paths_codecs_and_load_statements(spark):
    r = [("b", 1, 5, 9), ("a", 0, 1, 2)]
    assert files.stable_uuid(r) == files.stable_uuid(r[::-1]) != files.stable_uuid(r[:1])
    df = spark.createDataFrame([(datetime(2019, 4, 10), r)], "day timestamp_ntz, r array<struct<topic:string,partition:int,start_offset:bigint,end_offset:bigint>>")
    path = df.select(files.TimePaths(extension="lz4").column(F.col("day"), F.col("r"))).first()[0]
    assert path == f"dt=20190410/{files.stable_uuid(r)}.lz4" and uuid.UUID(path[12:-4])
    assert files.Compression.parse("GZip") is files.Compression.GZIP and files.Compression.parse("x") is None
    for call in (lambda: files.Compression.BZIP.parquet_codec, lambda: files.check_codec("vertica", files.Compression.LZ4), lambda: files.check_codec("clickhouse", files.Compression.SNAPPY), lambda: loading.LoadMethod.parse("x")):
        with pytest.raises(ValueError):
            call()
    assert loading.copy_csv("table", "/tmp/test.zst", files.Compression.ZSTD, loading.LoadMethod.AUTO, ";", True) == "COPY table FROM LOCAL '/tmp/test.zst' ZSTD DELIMITER ';' SKIP 1 ABORT ON ERROR AUTO NO COMMIT"
    assert loading.copy_native("table", "/tmp/test.zst", files.Compression.ZSTD, loading.LoadMethod.AUTO) == "COPY table FROM LOCAL '/tmp/test.zst' ZSTD NATIVE ABORT ON ERROR AUTO NO COMMIT"
    assert loading.insert_settings([Range("t", 1, Position(2), Position(3))], 7)["insert_deduplication_token"] == "t:1:2:3"


def test_parquet_options_and_file_contents(spark, tmp_path):
    opts = files.ParquetConfig(files.Compression.SNAPPY, block_size=1024, dictionary=False, page_rows=10).options()
    assert opts == {"compression": "snappy", "parquet.block.size": "1024", "parquet.page.row.count.limit": "10", "parquet.enable.dictionary": "false"}
    spark.range(10).write.options(**opts).parquet(str(tmp_path / "p" / "day=1"))
    assert files.read_parquet(spark, str(tmp_path / "p")).count() == 10
    rowsdf = spark.createDataFrame([("f", 2, bytearray(b"b")), ("f", 1, bytearray(b"a"))], "f string, o int, row binary")
    r = files.file_contents(rowsdf, ["f"], "row", ["o"], b"H", files.Compression.NONE).first()
    assert bytes(r["content"]) == b"Hab" and (r["size"], r["records"]) == (3, 2)
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x").write_text("t;0;5;100;a;b\n")
    assert rows(files.read_lines(spark, str(tmp_path / "l"))) == [("t", 0, 5, 100, "a;b")]


B1 = [Range("t", 0, Position(0, 10), Position(7, 70)), Range("t", 1, Position(3, 30), Position(9, 90))]
B2 = [Range("t", 0, Position(8, 80), Position(12, 120)), Range("t", 1, Position(10, 100), Position(31, 310))]
KEYS = {("t", 0), ("t", 1)}


@pytest.mark.parametrize("fault, recover, stored, second", [(None, False, 1, False), ("stage_files", False, 1, False), ("stage_files", True, 1, False), ("stage_offsets", False, 1, False), ("stage_offsets", True, 1, False), ("store", True, 2, True), ("finalize", True, 2, True)])
def test_two_phase_faults(spark, tmp_path, fault, recover, stored, second):
    ledger = Ledger(spark, str(tmp_path / "ledger"), "g")
    make = lambda: protocols.TwoPhaseStorage(spark, str(tmp_path / "out"), ledger)
    storage = make()
    df = lambda n: spark.createDataFrame([(n,)], "n int")
    storage.commit_batch(df(1), B1)
    if fault:
        storage.fail_at = fault
        with pytest.raises(OSError):
            storage.commit_batch(df(2), B2)
    storage = make()
    if recover:
        storage.recover(KEYS)
    ends = {("t", r.partition): Position(r.end.offset + 1, r.end.watermark_ms) for r in (B2 if second else B1)}
    assert storage.committed_positions(KEYS | {("t", 9)}) == ends | {("t", 9): None}
    assert [r["n"] for r in storage.read().orderBy("n").collect()] == list(range(1, stored + 1))
    if fault:  # the batch comes again and is stored once
        if not protocols.is_committed(B2, storage.committed_positions(KEYS)):
            storage.commit_batch(df(2), B2)
        assert [r["n"] for r in storage.read().orderBy("n").collect()] == [1, 2]


def test_ledger_versions_and_table_positions(spark, tmp_path):
    a, b = (Ledger(spark, str(tmp_path / "l"), "g") for _ in range(2))
    a.commit({("x:y", 0): Offset(1)})
    b.commit({("t", 1): Offset(2, "m")})
    assert a.committed() == {("x:y", 0): Offset(1), ("t", 1): Offset(2, "m")}
    table = protocols.TableStorage(spark, str(tmp_path / "t"), "g", ledger=a)
    assert table.read() is None
    table.commit_batch(spark.createDataFrame([(1,)], "n int"), [Range("topic", 0, Position(0, 0), Position(10, 100))])
    assert table.committed_positions({("topic", 0), ("u", 0)}) == {("topic", 0): Position(11, 100), ("u", 0): None}
    assert a.committed({("topic", 0)})[("topic", 0)] == Offset(11, json.dumps({"watermark": 100}))


def test_retry():
    calls = []
    sleeps = []

    def fail():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        retry.on_failure(retry.Policy(2, 1, 3), fail, sleeps.append)
    assert len(calls) == 3 and sleeps == [1, 3]
    assert retry.Policy(2, 1, 3).next() == retry.Policy(1, 3, 3)
    seen = iter(range(1, 9))
    assert retry.until(retry.Policy(9), lambda n: n == 5, lambda: next(seen), sleeps.append) == 5
    assert retry.on_failure_if(retry.Policy(9), lambda: False, fail, sleeps.append) is None
    with pytest.raises(TimeoutError):
        retry.until(retry.Policy(1), bool, lambda: 0, sleeps.append)


def write_log(spark, path, offsets):
    data = [("t", p, o, 1000 * o, b"k", f"{o};name{o}".encode(), None) for p in range(2) for o in offsets]
    spark.createDataFrame(data, "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, watermark_ms bigint").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("fault", [None, "stage_files", "stage_offsets", "store", "finalize"])
def test_stream_survives_a_failure_at_every_step(spark, tmp_path, fault):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ledger = Ledger(spark, str(tmp_path / "ledger"), "g")
    schema = spark.createDataFrame([], "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, watermark_ms bigint").schema

    def run(fail=None):
        storage = protocols.TwoPhaseStorage(spark, out, ledger, protocols.Layout(files=1))
        storage.fail_at = fail
        ingest = Ingest(storage=storage, formatter=lambda d: d.select("partition", "offset", "watermark_ms"), strategy=AnyOf(records=6), now=lambda: 10**9, retry=retry.Policy(0))
        q = ingest.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "check"))
        if fail:
            with pytest.raises(Exception, match="injected"):
                q.awaitTermination()
        else:
            q.awaitTermination()
        return ingest, storage

    write_log(spark, source, range(5))
    if fault:
        run(fault)
    _, storage = run()
    write_log(spark, source, range(3, 8))  # polled again
    ingest, storage = run()
    assert rows(storage.read()) == [(p, o, 1000 * o) for p in range(2) for o in range(8)]
    assert ingest.metrics.polled == 6 and ingest.metrics.batches == 1
    with pytest.raises(ValueError):
        Ingest().build()


def test_own_source_reads_in_steps(spark, tmp_path):
    write_log(spark, str(tmp_path / "in"), range(10))
    file = next((tmp_path / "in").glob("part-*.parquet"))
    spark.dataSource.register(logs.LogDataSource)
    assert spark.read.format("tidewell_log").option("path", str(file)).load().count() == 20
    assert spark.read.format("tidewell_log").option("path", f"file://{tmp_path}/in").load().count() == 20
    sizes = []
    q = stream_log(spark, str(file), step=8).writeStream.foreachBatch(lambda d, i: sizes.append(d.count())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(sizes) == 20 and max(sizes) == 8
    listener = ProgressListener()
    assert list(listener.progress) == []


def test_recovered_ledger(spark):
    df = spark.createDataFrame([("t", 0, 5, None, False, False, 9, 90), ("t", 1, 5, 50, True, False, 9, 90), ("t", 2, 5, 50, True, True, 9, 90)], "topic string, partition int, offset bigint, watermark_ms bigint, staged boolean, stored boolean, end_offset bigint, end_watermark_ms bigint")
    assert rows(protocols.recover_ledger(df)) == [("t", 0, 5, 0, False), ("t", 1, 10, 90, True), ("t", 2, 10, 90, False)]


def test_external_offsets_and_multipart_uploads(spark, tmp_path):
    df = lambda n: spark.createDataFrame([(n,)], "n int")
    ext = protocols.ExternalOffsetStorage(spark, str(tmp_path / "x"), "g")
    assert ext.committed_positions(KEYS) == dict.fromkeys(KEYS) and ext.next_file_id() == 1
    ext.commit_batch(df(1), B1)
    ext.commit_batch(df(2), B2)
    assert rows(ext.read().select("_file_id", "n")) == [(1, 1), (2, 2)]
    assert ext.committed_positions(KEYS) == {("t", r.partition): Position(r.end.offset + 1, r.end.watermark_ms) for r in B2}
    assert protocols.ExternalOffsetStorage(spark, str(tmp_path / "x"), "other").committed_positions(KEYS) == dict.fromkeys(KEYS)
    ledger = Ledger(spark, str(tmp_path / "l"), "g")
    up = protocols.MultipartStorage(spark, str(tmp_path / "u"), ledger)
    up.commit_batch(df(1), B1)
    for step in ("store", "finalize"):
        up.fail_at = step
        with pytest.raises(OSError):
            up.commit_batch(df(2), B2)
        up.recover(KEYS)
        assert rows(up.read()) == [(1,), (2,)]
    assert up.committed_positions(KEYS) == ext.committed_positions(KEYS)
    inrow = protocols.InRowStorage(spark, str(tmp_path / "r"), "g")
    r = spark.createDataFrame([("t", 0, 4, datetime(1970, 1, 1, 0, 0, 1))], "_topic string, _partition int, _offset bigint, _watermark timestamp_ntz")
    assert inrow.committed_positions({("t", 0)}) == {("t", 0): None}
    inrow.commit_batch(r, B1[:1])
    assert inrow.committed_positions({("t", 0), ("t", 5)}) == {("t", 0): Position(5, 1000), ("t", 5): None}


def test_payloads_files_and_names(spark):
    data = [("t", 0, 1, bytearray(b'{"a": 1, "b": "x"}')), ("t", 0, 2, None), ("t", 0, 3, bytearray(b"{}"))]
    df = spark.createDataFrame(data, "topic string, partition int, offset bigint, value binary")
    f = formatting.chain(formatting.json_payload("a int, b string"), formatting.filtering("a is not null"))
    assert rows(f(df)) == [("t", 0, 1, 1, "x")]
    r = spark.createDataFrame([("t", 0, o, o, f"d{o % 2}") for o in range(4)], "topic string, partition int, offset bigint, watermark_ms bigint, day string")
    assert [(x["day"], [(y["start_offset"], y["end_offset"]) for y in x["ranges"]]) for x in ranges.by_file(r, ["day"]).orderBy("day").collect()] == [("d0", [(0, 2)]), ("d1", [(1, 3)])]
    a, b = files.uuid7(1000), files.uuid7(2000)
    assert a.version == 7 and a < b and int.from_bytes(a.bytes[:6], "big") == 1000
    m = Ingest(storage=object()).metrics
    m.polled = 3
    m.commit_s.extend([0.5, 1.5])
    m.watermark_delay_ms["t", 0] = 7
    got = m.report("x")
    assert got["x.records.polled"] == 3 and got["x.batch.commit.duration.p50"] == 1.0 and got["x.batch.commit.duration.max"] == 1.5 and got["x.records.polled.count"] == 0
    assert got["x.batch.committed.watermark.delay.ms.t.0"] == 7 and got["x.batch.commit.queue.size"] == 0


def test_an_entry_is_written_once_or_replaced(spark, tmp_path):
    from tidewell.commit.storage import Folder

    f = Folder(spark, str(tmp_path / "f"))
    assert f.write("a/1.json", "x") and not f.write("a/1.json", "y") and f.read("a/1.json") == "x"
    assert f.write("a/1.json", "ü", overwrite=True) and f.read("a/1.json") == "ü" and f.names("a") == ["1.json"] and f.names("none") == []


def test_cuts_by_records_and_bytes(spark):
    data = [("t", p, o, 1000 * o, b"k" * 4, bytes(6), None) for p in range(2) for o in range(40)]
    df = spark.createDataFrame(data, "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, watermark_ms bigint")
    for limit, most_n, most_b in ((AnyOf(records=7), 7, 70), (AnyOf(size=50), 5, 50), (AnyOf(records=7, size=55), 6, 60)):
        cut = rows(limit.cut(df, ["topic"]).groupBy("batch").agg(F.count("*"), F.min("timestamp_ms"), F.max("timestamp_ms")))
        assert sum(r[1] for r in cut) == 80 and all(r[1] <= most_n and 10 * r[1] <= most_b for r in cut)
        assert all(a[3] <= b[2] for a, b in zip(cut, cut[1:]))
    assert AnyOf(open_ms=500).cut(df, ["topic"]).columns == df.columns and Ingest(storage=object(), strategy=AnyOf(open_ms=500)).trigger() == {"processingTime": "500 milliseconds"}
    fuzzy = FuzzyAnyOf(records=(10, 3), seed=5)
    assert fuzzy.cut(df, ["topic"]).select("batch").distinct().count() >= 6


def _batch(spark, offsets):
    data = [("t", p, o, 1000 * o, b"k", f"{o};name{o}".encode(), None) for p in range(2) for o in offsets]
    return spark.createDataFrame(data, "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, watermark_ms bigint")


def test_batches_are_files_of_their_own_and_positions_are_held(spark, tmp_path):
    asked = []

    class Counting(protocols.InRowStorage):
        def committed_positions(self, partitions):
            asked.append(len(partitions))
            return super().committed_positions(partitions)

    storage = Counting(spark, str(tmp_path / "t"), "g", layout=protocols.Layout(sort_by=("_offset",)))
    shape = lambda d: d.select(F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.timestamp_millis("watermark_ms").cast("timestamp_ntz").alias("_watermark"), protocols.BATCH)
    beats = []
    ingest = Ingest(storage=storage, formatter=shape, strategy=AnyOf(records=6), now=lambda: 10**9, on_heartbeat=lambda t, p: beats.append((t, p)))
    ingest.process(_batch(spark, range(9)), 0)
    ingest.process(_batch(spark, range(5, 12)), 1)
    ingest.heartbeat()
    assert asked == [2] and sorted(beats) == [("t", 0), ("t", 1)]
    assert rows(storage.read().select("_partition", "_offset")) == [(p, o) for p in range(2) for o in range(12)]
    m = ingest.metrics
    assert (m.polled, m.batched, m.written, m.batches, m.queued, m.heartbeats) == (24, 24, 24, 3 + 1, 0, 1) and list(m.polled_sizes) == [18, 14]
    assert m.watermark_delay_ms["t", 0] == m.source_delay_ms["t", 1] == 10**9 - 11_000
    again = Ingest(storage=storage, formatter=shape, now=lambda: 10**9)
    again.process(_batch(spark, range(5, 12)), 2)
    assert again.metrics.batches == 0 and storage.read().count() == 24


def test_rewound_records_warm_up_only(spark, tmp_path):
    from tidewell.model import OffsetInterval, WatermarkInterval

    storage = protocols.TableStorage(spark, str(tmp_path / "t"), "g", layout=protocols.Layout("orc"))
    keep = lambda d: d.select("partition", "offset")
    Ingest(storage=storage, formatter=keep, now=lambda: 10**9).process(_batch(spark, range(8)), 0)
    for interval, first in ((OffsetInterval(3), 5), (WatermarkInterval(2000), 7), (WatermarkInterval(5500), 4), (OffsetInterval(99), 0)):
        warmed = []
        ingest = Ingest(storage=storage, formatter=keep, now=lambda: 10**9, rewind=interval, warm_up=lambda d: warmed.extend(rows(d.select("partition", "offset"))))
        ingest.process(_batch(spark, range(10)), 1)
        assert sorted(warmed) == [(p, o) for p in range(2) for o in range(first, 8 if interval == OffsetInterval(3) else 10)], interval
    assert rows(storage.read()) == [(p, o) for p in range(2) for o in range(10)]
    with pytest.raises(ValueError):
        Ingest(storage=storage, rewind=OffsetInterval(1)).build()


def test_snapshots_are_bounded_and_manifests_keep_every_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(protocols.TableStorage, "MANIFEST", 3)
    table = protocols.TableStorage(spark, str(tmp_path / "t"), "g")
    df = spark.createDataFrame([(1,)], "n int")
    for i in range(8):
        assert table.commit_batch(df, [Range("t", 0, Position(i, 0), Position(i, i))]) == 1
    assert len(table.folder.names("snapshots")) == 3 and table.read().count() == 8
    assert table.committed_positions({("t", 0)}) == {("t", 0): Position(8, 7)}


def test_watermarks_across_batches_by_state(spark, tmp_path):
    from tidewell.streaming.stateful import MarkedLog

    marked = MarkedLog(spark, str(tmp_path / "m"), 10**9)
    for i, offsets in enumerate((range(5), range(5, 9), range(5, 9))):
        marked.process(_batch(spark, offsets).withColumn("timestamp_ms", F.when(F.col("offset") % 3 == 2, F.lit(5)).otherwise(F.col("timestamp_ms"))), min(i, 1))
    whole = watermark.with_watermark(_batch(spark, range(9)).withColumn("timestamp_ms", F.when(F.col("offset") % 3 == 2, F.lit(5)).otherwise(F.col("timestamp_ms"))), 10**9)
    cols = ["topic", "partition", "offset", "watermark_ms"]
    assert rows(marked.read().select(*cols)) == rows(whole.select(*cols))


def test_a_wrapper_forwards(spark, tmp_path):
    from tidewell.streaming.engine import Wrapped

    calls = []

    class Loud(Wrapped):
        def process(self, df, batch_id):
            calls.append(batch_id)
            super().process(df, batch_id)

    storage = protocols.TableStorage(spark, str(tmp_path / "t"), "g")
    inner = Ingest(storage=storage, formatter=lambda d: d.select("offset"), now=lambda: 10**9)
    outer = Loud(Loud(inner))
    outer.process(_batch(spark, range(3)), 4)
    outer.heartbeat()
    assert calls == [4, 4] and storage.read().count() == 6 and inner.metrics.heartbeats == 1


def test_built_files_appear_in_two_phases(spark, tmp_path):
    from tidewell.commit import formats
    from tidewell.encode.csv import CsvFormat

    ledger = Ledger(spark, str(tmp_path / "ledger"), "g")
    schema = spark.createDataFrame([], "n int, s string").schema
    builder = formats.csv_files(schema, CsvFormat(separator=",", header=True), files.Compression.GZIP)
    make = lambda: formats.FormatStorage(spark, f"file://{tmp_path}/out", ledger, builder, lambda: F.col("s"))
    df = lambda n: spark.createDataFrame([(n, "a", 0), (n + 1, "b", 0), (n + 2, "a", 1)], f"n int, s string, {protocols.BATCH} bigint")
    storage = make()
    assert storage.commit_batch(df(1), B1) == 3
    storage.fail_at = "store"
    with pytest.raises(OSError):
        storage.commit_batch(df(10), B2)
    assert make().read().count() == 3
    storage = make()
    storage.recover(KEYS)
    assert rows(storage.read_lines().select("line").filter("line != 'n,s'")) == [("1,a",), ("10,a",), ("11,b",), ("12,a",), ("2,b",), ("3,a",)]
    assert {r["path"].split("/")[0] for r in storage.read().collect()} == {"a", "b"} and storage.read().count() == 6
    assert storage.committed_positions(KEYS) == {("t", r.partition): Position(r.end.offset + 1, r.end.watermark_ms) for r in B2}
    again = make()
    again.commit_batch(df(10), B2)
    assert again.read().count() == 6
    empty = formats.FormatStorage(spark, f"file://{tmp_path}/none", ledger, builder)
    assert empty.commit_batch(df(1).limit(0), B1) == 0
    framed = formats.FileBuilder(lambda: F.lit(b"x"), b"<", b">").build(df(1), ("s",))
    assert sorted((r["s"], bytes(r["content"]), r["size"], r["records"]) for r in framed.collect()) == [("a", b"<xx>", 4, 2), ("b", b"<x>", 3, 1)]
