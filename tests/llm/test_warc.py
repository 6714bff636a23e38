"""Operator 10: exact round trips, and archives damaged on purpose."""

import base64
import gzip
import hashlib
import random

from cellarium.llm import warc

PAGES = "page_id long, url string, html string, file string"


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/c", "<p>x</p>", "f"), (2, None, None, "f"), (3, "http://a/\r\nX: y z", "", "f"), (4, "u", "<p>x</p>", "f"), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 3, "f"), (6, "u", "long " * 60000, "f"), (6, "u", "other", "f"), (None, "u", "<p>x</p>", "f"), (None, "u", "alone", "f")]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    got = warc.read_archives(spark, path).collect()
    best = {}
    for i, _, h, _ in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        keeper = best.get(h or "")
        revisit = keeper is not None and keeper != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    warc.write_archives(spark.createDataFrame([], PAGES), path + "2")
    assert warc.read_archives(spark, path + "2").count() == 0


def test_salvage():
    rng = random.Random(4)
    payloads = ["".join(rng.choices("abcdef \n", k=rng.randint(0, 400))).encode() for _ in range(40)]
    parts = [warc.record(i, f"http://a/{i}", p, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), None, "d") for i, p in enumerate(payloads)]
    for form in ("plain", "gzip", "nothing between"):
        pack = {"plain": lambda p: p, "gzip": gzip.compress, "nothing between": lambda p: gzip.compress(p) + gzip.compress(b"")}[form]
        whole = [pack(p) for p in parts]
        assert [r["payload"] for r, *_ in warc.salvage(b"".join(whole))] == payloads
        hurt = {3: lambda x: x[: len(x) // 2], 10: lambda x: b"junk \x1f\x8b\x08 WARC/1.1\r\n" + x, 20: lambda x: x[:60] + b"?" + x[61:], 39: lambda x: x[:-25]}
        data = [hurt[i](x) if i in hurt else x for i, x in enumerate(whole)]
        found = list(warc.salvage(b"".join(data)))
        kept = {warc.page_of(r["warc-record-id"]) for r, *_ in found if r}
        assert kept >= set(range(40)) - {3, 20, 39} and 39 not in kept and 3 not in kept
        assert found[0][1] == 0 and all(x[2] <= y[1] for x, y in zip(found, found[1:], strict=False))
        assert all(why for r, _, _, why in found if r is None) and sum(r is None for r, *_ in found) >= 3
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"nothing here")] == [None]


def test_a_long_record_ends_with_a_member_of_nothing():
    rec = warc.record(1, "u", b"x" * (1 << 24), 1 << 24, base64.b32encode(hashlib.sha1(b"x" * (1 << 24)).digest()).decode(), None, "d")
    assert [len(r["payload"]) for r, *_ in warc.salvage(b"\0".join([warc.unended(rec), warc.unended(rec), b""]))] == [1 << 24] * 2


def test_a_long_url_is_kept(spark, tmp_path):
    urls = ["u" * 200_000, "http://a/" + " \x01" * 100_000, "http://a/WARC/1.1"]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(i, u, f"<p>{i}</p>", "f") for i, u in enumerate(urls)], PAGES), path)
    got = {r.page_id: (r.url, r.record_type) for r in warc.read_archives(spark, path).collect()}
    assert got == {i: (u.translate(warc.CONTROL), "response") for i, u in enumerate(urls)}
    parts = [warc.record(i, u, b"x", 1, base64.b32encode(hashlib.sha1(b"x").digest()).decode(), None, "d") for i, u in enumerate(urls)]
    assert [warc.page_of(r["warc-record-id"]) for r, *_ in warc.salvage(b"".join(parts))] == [0, 1, 2]
    found = list(warc.salvage(parts[0][:150_000] + b"\r\n" + parts[1] + parts[2]))  # the first one's header has no end
    assert [r and warc.page_of(r["warc-record-id"]) for r, *_ in found] == [None, 1, 2] and found[0][3] == "header end"


def test_files_are_bounded_by_bytes_and_a_hot_payload_is_whole(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "u", "same" if i % 3 == 0 else "".join(rng.choices("abcdefgh", k=3000)), "f") for i in range(600)]
    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"file://{path}", file_bytes=20_000)
    files = [f for f in path.rglob("part-*") if not f.name.endswith(".crc")]
    assert len(files) > 10 and max(f.stat().st_size for f in files) < 25_000
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{path}").collect()}
    assert got == {i: ("revisit", 597) if i % 3 == 0 and i != 597 else ("response", None) for i in range(600)}


def test_damaged_archives_are_read_from_a_store(spark, tmp_path):
    """Archives that Spark wrote, damaged on disk: all other records, and a row for each gap. The largest page_ids of a payload are repeated."""
    rows = [(i, f"http://a/{i}", f"<p>{i % 50}</p>" * 20, "f") for i in range(200)] + [(199, "again", "<p>49</p>" * 20, "f")]
    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{path}")
    (file,) = [f for f in path.rglob("part-*") if not f.name.endswith(".crc")]
    whole = {(r.page_id, r.url): (r.payload_digest, r.record_type, r.refers_to, r.start, r.end) for r in warc.read_archives(spark, f"file://{path}").collect()}
    assert len(whole) == 201 and sum(x[1] == "response" for x in whole.values()) == 51
    data = bytearray(file.read_bytes())
    hurt = sorted(whole.items(), key=lambda x: x[1][3])[10:200:40]
    for _, (*_, start, end) in hurt:
        data[(start + end) // 2] ^= 0xFF
    file.write_bytes(data)
    (path / file.relative_to(path).parent / f".{file.name}.crc").unlink(missing_ok=True)
    got = warc.read_archives(spark, f"file://{path}").collect()
    found = {(r.page_id, r.url): (r.payload_digest, r.record_type, r.refers_to, r.start, r.end) for r in got if r.record_type != "quarantine"}
    assert found == {k: x for k, x in whole.items() if k not in {k for k, _ in hurt}}
    gaps = [(r.start, r.end, r.error) for r in got if r.record_type == "quarantine"]
    assert len(gaps) >= len(hurt) and all(any(a <= start and end <= b for a, b, _ in gaps) for _, (*_, start, end) in hurt) and all(e for *_, e in gaps)
