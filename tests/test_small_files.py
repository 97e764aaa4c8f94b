import hashlib
import io
import zlib
from datetime import datetime

import pytest
import zstandard
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import small_files as S

SCHEMA = "_file_id bigint, file_path string, file_open_duration_ms bigint, file_size bigint, records_written bigint, reported_at timestamp_ntz"


def stats(spark, data):
    return spark.createDataFrame([(i, p, 1, s, n, datetime(2023, 1, 1, 0, 0, t)) for i, p, s, n, t in data], SCHEMA)


def test_last_reports_decide(spark):
    data = [
        (1, "d/a", 100, 5, 1), (2, "d/b", 200, 5, 1), (2, "d/b", None, 6, 2), (3, "d/c", 20_000, 5, 2), (3, "d/c", 10, 1, 1), (4, "d/e", None, 5, 1),
        (5, "d/f", 50, 0, 2), (5, "d/f", 50, 9, 1), (6, "lonely/a", 10, 1, 1), (7, "x", 1, 1, 1), (8, "y", 1, 1, 1), (None, "d/z", 1, 1, 1), (9, None, 1, 1, 1), (1, "d/a", 100, 5, 1), (10, "d/k", 16_384, 5, 1),
    ]
    assert [r[0] for r in rows(S.to_merge(stats(spark, data)).select("_file_id"))] == [1, 2, 7, 8]


def test_targets_are_filled_to_aim_and_hold_each_file_once(spark):
    data = [(i * 7, "hot/f" + str(i), 1000 + i % 50, 3, 1) for i in range(2000)] + [(100_001 + i, f"cold/f{i}", 9000, 3, 1) for i in range(5)]
    plan = S.plan(stats(spark, data), aim=20_000).collect()
    assert len(plan) == len({r["_file_id"] for r in plan}) == 2005
    fill = {}
    for r in plan:
        fill[(r["directory"], r["target"])] = fill.get((r["directory"], r["target"]), 0) + r["size"]
    last = {d: max(t for e, t in fill if e == d) for d, _ in fill}
    assert all(n > 20_000 - 9000 for (d, t), n in fill.items() if t != last[d]) and all(n < 20_000 + 9000 for n in fill.values())
    for d in last:
        own = sorted((r for r in plan if r["directory"] == d), key=lambda r: r["_file_id"])
        at = 0
        for r in own:
            assert r["begins"] == at and r["target"] == at // 20_000
            at += r["size"]


def test_regrouping_keeps_every_row(spark):
    t = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (None, 13), (9, 14)], "_file_id bigint, id int").withColumn("directory", F.lit("clash"))
    got = rows(S.regroup(t, stats(spark, [(1, "d/a", 10, 2, 1), (2, "d/b", 10, 1, 1)])).select("id", "directory", "target"))
    assert got == [(10, "d", 0), (11, "d", 0), (12, "d", 0), (13, None, None), (14, None, None)]


def test_empty(spark):
    s = stats(spark, [])
    assert rows(S.to_merge(s)) == [] and rows(S.plan(s)) == []


@given(st.lists(st.binary(max_size=200), min_size=1, max_size=6))
def test_frames_round_trip(parts):
    c = zstandard.ZstdCompressor(write_content_size=True)
    whole = S.join_bytes([c.compress(p) for p in parts], "zstd", [(len(p), zlib.crc32(p)) for p in parts])
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read() == b"".join(parts)


def test_wrong_content_is_refused():
    frame = zstandard.ZstdCompressor().compress(b"abc")
    with pytest.raises(ValueError):
        S.join_bytes([frame], "zstd", [(3, zlib.crc32(b"abd"))])
    with pytest.raises(ValueError):
        S.join_bytes([b"h1\na\n", b"h2\nb\n"], "lines", header_lines=1)


def test_lines_get_missing_breaks_and_one_header():
    assert S.join_bytes([b"a\nb", b"", b"c\n"], "lines") == b"a\nb\nc\n"
    assert S.join_bytes([b"h\na", b"h\n", b"h\nb\n"], "lines", header_lines=1) == b"h\na\nb\n"


def test_files_are_joined_on_disk_and_again_on_retry(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "d").mkdir(parents=True)
    for i in range(4):
        (src / "d" / f"f{i}").write_bytes(b"line %d" % i)
    moves = spark.createDataFrame([("d", i // 2, f"d/f{i}", i) for i in range(4)], "directory string, target bigint, path string, place bigint")
    for _ in range(2):
        got = rows(S.concat_files(moves, str(src), str(out), "lines").select("target", "files", "bytes"))
        assert got == [(0, 2, 14), (1, 2, 14)]
    assert (out / "d" / "part-000000").read_bytes() == b"line 0\nline 1\n"
    assert sorted(p.name for p in (out / "d").iterdir()) == ["part-000000", "part-000001"]


def test_recorded_lengths_and_checksums_of_parts_are_compared(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    blobs = {f"f{i}": zstandard.ZstdCompressor().compress(b"line %d\n" % i * 50) for i in range(3)}
    for n, b in blobs.items():
        (src / n).write_bytes(b)
    moves = lambda crc: spark.createDataFrame([("d", 0, n, i, len(b), zlib.crc32(b) + (crc if i == 1 else 0)) for i, (n, b) in enumerate(blobs.items())], "directory string, target bigint, path string, place bigint, bytes bigint, crc bigint")
    joined = S.concat_files(moves(0), f"file://{src}", f"file://{out}", "zstd")
    got = S.contents(joined).first()
    assert (got["files"], got["lines"]) == (3, 150) and got["content"] == hashlib.md5(b"".join(b"line %d\n" % i * 50 for i in range(3))).hexdigest()
    with pytest.raises(Exception, match="not what was recorded"):
        S.concat_files(moves(1), f"file://{src}", f"file://{out}", "zstd").collect()
    (src / "f2").write_bytes(blobs["f2"][:-2])
    with pytest.raises(Exception, match="cut short"):
        S.concat_files(moves(0).drop("bytes", "crc"), f"file://{src}", f"file://{out}", "zstd").collect()
    assert sorted(p.name for p in (out / "d").iterdir()) == ["part-000000"]


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=4), st.booleans(), st.integers(1, 40))
def test_frames_cut_short_are_refused(parts, checksum, lost):
    c = zstandard.ZstdCompressor(write_content_size=lost % 2 == 0, write_checksum=checksum)
    whole = b"".join(c.compress(p) for p in parts)
    assert S.whole_frames(whole) == len(parts)
    ends = {len(b"".join(c.compress(p) for p in parts[:n])) for n in range(len(parts) + 1)}
    cut = max(0, len(whole) - lost)
    if cut in ends:
        S.whole_frames(whole[:cut])
    else:
        with pytest.raises(ValueError):
            S.whole_frames(whole[:cut])


def test_rows_as_frames(spark):
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "ü")], "_file_id bigint, place int, line string")
    got = {r["_file_id"]: r for r in S.frames(lines).collect()}
    plain = zstandard.ZstdDecompressor().decompress(bytes(got[1]["frame"])).decode()
    assert plain == "a\nb\n" and (got[1]["rows"], got[2]["plain_bytes"]) == (2, 3)
