import hashlib
import random

import zstandard

from cairnflow.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_bundle_frames_are_independent():
    w = warc.BundleWriter(100, 3)
    records = {f"r{k}": bytes([k]) * (k * 17 % 250 + 1) for k in range(30)}
    for name, data in records.items():
        w.add(name, data)
    archive = w.bytes()
    reader = warc.BundleReader(archive)
    assert len(reader.starts) > 3
    for r in reversed(w.records):
        assert reader.record(r["frame"], r["offset"], r["length"]) == records[r["record_id"]]
    # any decompressor reads the bundle from end to end: the seek table is a skippable frame
    plain = zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read()
    assert plain == b"".join(records.values())


def test_contract(spark, tmp_path):
    rng = random.Random(11)
    big = ["".join(rng.choice("abc é") for _ in range(1200)) for _ in range(3)]
    rows = [(k, f"http://h/{k}", rng.choice([*big, "small", None, ""]), "x") for k in range(60)] + [(100, None, "y" * 300_000, None), (101, "http://a\r\nb", big[0], None), (102, "u", "z" * 1000, None), (103, "u", "z" * 1000, None)]
    df = pages(spark, rows)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, frame_bytes=5000, bundle_bytes=2000)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    last = {}
    for page_id, _, html, _ in rows:
        last[html or ""] = page_id
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        refers = last[html or ""] if len(data) >= 1000 and last[html or ""] != page_id else None
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers)
        assert r.stored_bytes == (len(data) if refers is None else 0)
    assert got[102].refers_to == 103
    places = {r.record_id: r for r in warc.index(spark, path).collect()}
    assert set(places) == {str(p) for p, *_ in rows} and len({r.bundle_id for r in places.values()}) > 1
    one = places["100"]
    bundle = spark.read.parquet(path).where(f"bundle_id = '{one.bundle_id}'").first().archive
    head, _, _, payload = warc.parse_record(warc.BundleReader(bytes(bundle)).record(one.frame, one.offset, one.length))
    assert payload == b"y" * 300_000 and head["WARC-Record-ID"] == "<urn:page:100>"


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(None, "u", "x" * 2000, None), (1, "u", "q" * 1500, None), (1, "u", "q" * 1500, None)]
    warc.write_archives(pages(spark, rows), path)
    got = warc.read_archives(spark, path).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "None"] and {r.record_type for r in got} == {"response"}
    none = str(tmp_path / "none")
    warc.write_archives(pages(spark, []), none)
    assert warc.read_archives(spark, none).count() == 0
