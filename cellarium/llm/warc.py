"""Operator 10, WARC: archives of gzip members, written with Spark's text writer and read back by a salvage reader.

Spark's text writer puts the members' bytes on any store that Spark can write, under its commit protocol, so a lost
executor never leaves half a file.
The reader works on bytes, plain or one gzip member a record, and survives damage: after a failed check it searches
for the next member or version line from which a whole record can be read, and logs the bytes it passed over.

Edge cases: a null payload is empty; a null url is left out of the header; control characters in a url are
percent-encoded; a null page_id is written as an empty id and never answers for others unless its whole group has no
id; of rows that repeat the largest page_id with the same payload, each is a response; an empty table gives no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = {c: f"%{c:02X}" for c in [*range(33), 127]}
FILE_BYTES = 64 << 20
PAGES = "page_id long, url string, n long, digest string, member binary"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, start long, end long, error string"


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, resp: int | None, date: str) -> bytes:
    """A whole record; payload None makes a revisit of page `resp`."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(CONTROL)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(resp)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def unended(rec: bytes) -> bytes:
    """A gzip member of the record without its last byte, a zero: the writer's separator supplies it.

    The last byte is the highest of the size's four, zero under 16 MB; a longer record is followed by a member of nothing.
    """
    packed = gzip.compress(rec, 6, mtime=0)
    return packed[:-1] if packed[-1] == 0 else packed + gzip.compress(b"", 6, mtime=0)[:-1]


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Archives of one gzip member a record under path; a file is full at file_bytes, as a reader holds a file and the longest record.

    Payloads are compressed before the shuffle that finds each digest's largest page_id, so they travel and are stored
    small. Digests of more than one in HEAVY of all pages meet theirs by a broadcast. Spark's text writer, with a zero
    byte as separator, writes the members' bytes as they are.
    """
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, url, html in zip(x["page_id"], x["url"], x["html"], strict=True):
                payload, i = (html or "").encode("utf-8", "replace"), None if pd.isna(i) else int(i)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.append((i, url, len(payload), digest, unended(record(i, url, payload, len(payload), digest, None, date))))
            yield pd.DataFrame(out, columns=["page_id", "url", "n", "digest", "member"]).astype({"page_id": "Int64"})

    def revisits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = 0
        for x in batches:
            out = []
            for i, url, n, digest, m, resp in x.itertuples(index=False, name=None):
                m = m if pd.isna(resp) else unended(record(None if pd.isna(i) else int(i), url, None, n, digest, int(resp), date))
                out.append((m, written // file_bytes))
                written += len(m)
            yield pd.DataFrame(out, columns=["value", "file"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(members, PAGES)
    again = pages.groupBy(F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1")).agg(F.max(F.col("page_id").cast("long")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    # only payloads that occur again take part in the joins
    again = again.where("n > 1").select(base32_of_hex(F.col("sha1")).alias("digest"), "keeper", F.col("n").alias("copies"))
    total = pages.count()
    heavy = again.where(F.col("copies") * HEAVY > total).select("digest", F.col("keeper").alias("heavy_keeper"), F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(heavy), "digest", "left").withColumn("place", F.when(F.col("heavy"), 1 + F.pmod(F.xxhash64("page_id", "url"), F.lit(HEAVY))).otherwise(0))
    light = again.where(F.col("copies") * HEAVY <= total).select("digest", "keeper", F.lit(0).cast("long").alias("place"))
    joined = rows.join(light, ["digest", "place"], "left").withColumn("keeper", F.coalesce("heavy_keeper", "keeper"))
    resp = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    joined = joined.select("page_id", "url", "n", "digest", F.when(resp.isNull(), F.col("member")).alias("member"), resp.alias("resp"))
    joined.mapInPandas(revisits, "value binary, file long").select(F.col("value").cast("string"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 40-digit hex string: each 5-bit group lies within two neighbouring hex digits."""
    def letter(i: int) -> Column:
        pair = F.conv(F.substring(digest, 5 * i // 4 + 1, 2), 16, 10).cast("int")
        return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(pair, 3 - 5 * i % 4).bitwiseAND(31) + 1, F.lit(1))

    return F.concat(*[letter(i) for i in range(32)])


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
STOP = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")


def parse(data: bytes | memoryview, at: int, end: int) -> tuple[dict, int]:
    """The record at `at` and where it ends; ValueError names the check that it fails."""
    if not VERSION.match(data, at, end):
        raise ValueError("version line")
    found = STOP.search(data, at, end)  # however long the header is; the next version line ends a damaged one
    if not found or found.end() - found.start() > 4:
        raise ValueError("header end")
    stop = found.start() - at
    head = {}
    for line in bytes(data[at : at + stop]).split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise ValueError("header line")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("content length")
    first, last = at + stop + 4, at + stop + 4 + int(length)
    if last + 4 > end or bytes(data[last : last + 4]) != b"\r\n\r\n":
        raise ValueError("record end")
    block = bytes(data[first:last])
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    digest = head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
        raise ValueError("payload digest")
    return head | {"payload": payload}, last + 4


def member(data: bytes, at: int) -> tuple[dict | None, int]:
    """The record in the gzip member at `at` (None: it holds nothing), and where the member ends."""
    z, out, to = zlib.decompressobj(31), [], at
    try:
        while not z.eof and to < len(data):  # by blocks, so that what follows the member is not copied each time
            out.append(z.decompress(data[to : to + 65536]))
            to = min(len(data), to + 65536)
    except zlib.error as e:
        raise ValueError("gzip member") from e
    if not z.eof:
        raise ValueError("gzip member")
    out = b"".join(out)
    found, end = parse(out, 0, len(out)) if out else (None, 0)
    if end != len(out):
        raise ValueError("member end")
    return found, to - len(z.unused_data)


def salvage(data: bytes) -> Iterator[tuple[dict | None, int, int, str]]:
    """(record, start, end, "") for each record that passes its checks and (None, start, end, check) for each gap between them."""
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            found, end = member(data, at) if data[at : at + 2] == b"\x1f\x8b" else parse(data, at, len(data))
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            following = NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield None, gap, at, why
            gap = None
        if found:
            yield found, at, end, ""
        at = end
    if gap is not None:
        yield None, gap, len(data), why


def page_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, and one with record_type `quarantine` and the failed check for each byte gap."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for r, a, b, why in salvage(bytes(content)):
                    if r is None:
                        out.append((None, None, None, None, "quarantine", None, name, a, b, why))
                        continue
                    size = r.get("x-payload-length", "")
                    n = int(size) if r["warc-type"] == "revisit" and size.isdigit() else len(r["payload"])
                    out.append((page_of(r.get("warc-record-id", "")), r.get("warc-target-uri"), n, r.get("warc-payload-digest", "").removeprefix("sha1:"), r.get("warc-type"), page_of(r.get("warc-refers-to", "")), name, a, b, None))
                frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "start", "end", "error"])
                yield frame.astype({k: "Int64" for k in ("page_id", "payload_bytes", "refers_to", "start", "end")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, ROWS)
