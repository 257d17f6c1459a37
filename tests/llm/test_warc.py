import base64
import glob
import hashlib

import pytest
import zstandard

from panelcast.llm import warc

KIND = "page_id long, url string, html string, key string"


def brute(rows, least):
    tops = {}
    for i, u, h in rows:
        h = h or ""
        if len(h.encode()) >= least:
            tops[h] = max(tops.get(h, (-1,)), (-1 if i is None else i,))
    out = []
    for i, u, h in rows:
        h = h or ""
        body = h.encode()
        top = tops.get(h, (i,))[0]
        again = top != (-1 if i is None else i)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, u, "revisit" if again else "response", len(body), digest, top if again else None, None if again else body))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a", "same"), (9, "http://b\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""),
    (6, "u", "é" * 200_000), (7, "u", "WARC/1.1\r\n\r\nx"), (None, "n", "alone"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], KIND).repartition(3)
    index = warc.write_bundles(df, str(tmp_path / "w"), min_bytes=least, bundle_bytes=100_000, frame_bytes=50)
    got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in warc.read_bundles(spark, str(tmp_path / "w")).collect()), key=repr)
    want = [(*r[:1], r[1].replace("\r", "%0D").replace("\n", "%0A") if r[1] else None, *r[2:]) for r in brute(ROWS, least)]
    assert got == sorted(want, key=repr)
    assert index.count() == len(ROWS) and index.select("bundle").distinct().count() > 1


def test_repeated_rows_have_one_response(spark, tmp_path):
    rows = [(2, "u", "x", "")] * 40 + [(1, "u", "x", "")]
    warc.write_bundles(spark.createDataFrame(rows, KIND), str(tmp_path / "w"))
    got = warc.read_bundles(spark, str(tmp_path / "w")).collect()
    assert len(got) == 41 and sum(r["record_type"] == "response" for r in got) == 1
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2}


def test_frames_are_independent_and_listed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 30, "") for i in range(200)], KIND)
    warc.write_bundles(df, str(tmp_path / "w"), frame_bytes=2000)
    (path,) = glob.glob(str(tmp_path / "w" / "bundle-*"))
    data = open(path, "rb").read()
    with open(path, "rb") as file:
        frames = warc.seek_table(file, len(data))
    assert len(frames) > 5
    start, packed, raw = frames[3]
    assert len(zstandard.ZstdDecompressor().decompress(data[start : start + packed])) == raw
    # Any Zstandard reader sees one stream: the seek table is a skippable frame.
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 200


def test_records_by_key(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i}", "") for i in range(100)], KIND)
    index = warc.write_bundles(df, str(tmp_path / "w"), bundle_bytes=500, frame_bytes=300)
    wanted = spark.createDataFrame([(7,), (7,), (93,), (1000,)], "key long")
    got = warc.read_records(index, str(tmp_path / "w"), wanted).collect()
    assert sorted((r["key"], bytes(r["payload"])) for r in got) == [(7, b"page 7"), (93, b"page 93")]


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], KIND)
    assert warc.write_bundles(empty, str(tmp_path / "w")).count() == 0
    assert warc.read_bundles(spark, str(tmp_path / "w")).count() == 0


def test_damage_is_noticed():
    record = warc._record(1, "u", b"abc", warc.base32_sha1(b"abc"), 3, None, 0, warc.DATE)
    assert list(warc.parse_records(record))[0][-1] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse_records(record.replace(b"abc", b"abd")))


def test_paths_without_a_scheme_lie_on_the_default_file_system(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None)], "page_id long, url string, html string")
    asked = []
    real = warc.qualified
    monkeypatch.setattr(warc, "qualified", lambda session, path: asked.append(path) or real(session, path))
    folder = str(tmp_path / "bundles")
    warc.write_bundles(df, folder)
    assert warc.read_bundles(spark, folder).count() == 3 and set(asked) == {folder}
    assert real(spark, folder) == f"file://{folder}"
