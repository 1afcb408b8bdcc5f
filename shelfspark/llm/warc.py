"""WARC archives: range-sorted records in rolled, deterministic files with their digests, and a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, arrow_batches, cut, discard, fresh_dir, small_side, table
from .ranges import byte_ranges

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
_FILES = "file string, records long, bytes long, sha1 string"
_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _sha1(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page: int | None, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{payload}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One record: a response with its HTTP head and payload, or a revisit of the page `refers` with the head alone."""
    digest = _sha1(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers is not None else head + payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _name(page, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(refers, digest)), ("Refers-To-Page", str(refers))]
    if page is not None:
        fields.append(("Page-Number", str(page)))
    fields += [("Payload-Length", str(len(payload))), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record; raises ValueError if its lengths or digests are wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first.encode() != VERSION or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{_sha1(block)}":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, block


def write_warc(pages: DataFrame, path: str, roll_bytes: int = 64 << 20, part_bytes: int = 64 << 20) -> list[dict]:
    """Write one record per row of pages (page_id, url, html) below `path`; returns the rows of manifest.json there.

    Of rows with equal payloads (html in UTF-8; null: empty) the one with the largest page_id is a response, the
    others revisit it. Equality is by SHA-256 of the payload and settled over hashes alone; payloads are shuffled once,
    together with a mark for each row that revisits another, so a hot payload is never gathered and nothing is
    broadcast. Records are dealt by exact ranges of page_id of about `part_bytes` payload bytes (byte_ranges(); a hot
    or null page_id is split by a hash of url and payload) and sorted, a part's file is rolled before it would pass
    `roll_bytes` compressed, each record is a gzip member without a time stamp: the same rows give the same files.
    Files get their names by renaming when complete, and the manifest comes last. Rows without page_id or url have
    no such field; of rows that repeat a page_id with equal payloads each is a response; an empty table leaves an
    empty manifest.
    """
    arrow_batches(pages.sparkSession, 200)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("_p")).withColumn("_h", F.unhex(F.sha2("_p", 256)))
    rows = rows.withColumn("_x", F.xxhash64("url", "_h"))
    hashed = cut(rows.select("page_id", "_x", "_h", F.octet_length("_p").cast("long").alias("size")), "hashed")
    same = hashed.groupBy("_h").agg(F.max("page_id").alias("_to"), F.count("*").alias("_n")).where("_n > 1").select("_h", "_to")
    marks = hashed.join(small_side(cut(same, "equal"), 56), "_h").where("_to is not null and not _to <=> page_id").select("page_id", "_x", "_to").distinct()
    parts, part_of = byte_ranges(hashed.select(F.col("page_id").alias("k"), F.col("_x").alias("x"), "size"), part_bytes)
    none = F.lit(None).cast
    whole = rows.select("page_id", "_x", "url", "_p", none("long").alias("_to")).unionByName(marks.select("page_id", "_x", none("string").alias("url"), none("binary").alias("_p"), "_to"))
    whole = whole.withColumn("_part", part_of(F.col("page_id"), F.col("_x"))).repartitionById(parts, "_part")
    whole = whole.sortWithinPartitions("_part", "page_id", "_x", F.col("_p").isNotNull())  # a mark comes before its rows

    def write(batches):
        import gzip
        import hashlib

        import pyarrow as pa

        store, made, done, temporary, at = Store(path), None, [], f"_{uuid.uuid4().hex}", None
        number, records, size, digest, marked = 0, 0, 0, hashlib.sha1(), None

        def close() -> None:
            made.close()
            name = f"records-{at:06d}-{number:04d}.warc.gz"
            store.rename(f"{temporary}.{at}.{number}", name)
            done.append({"file": name, "records": records, "bytes": size, "sha1": digest.hexdigest()})

        for batch in batches:
            for page, x, url, payload, to, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is None:
                    marked = (page, x, to)
                    continue
                refers = marked[2] if marked and marked[:2] == (page, x) else None
                one = gzip.compress(record(page, url, payload, refers), 6, mtime=0)
                if made and (part != at or size + len(one) > roll_bytes):
                    close()
                    made, records, size, digest = None, 0, 0, hashlib.sha1()
                    number += 1
                if part != at:
                    at, number = part, 0
                made = made or store.create(f"{temporary}.{at}.{number}")
                made.write(one)
                digest.update(one)
                records, size = records + 1, size + len(one)
        if made:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    files = [r.asDict() for r in whole.mapInArrow(write, _FILES).collect()]
    discard(hashed)
    files.sort(key=lambda r: r["file"])
    Store(path).write_json("manifest.json", {"files": files})
    return files


def read_warc(spark: SparkSession, path: str, files: list[dict]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a broken one raises."""

    def read(batches):
        import gzip
        import io
        import zlib

        import pyarrow as pa

        def members(f):
            """Each gzip member in turn, of a stream that is never held whole."""
            held = b""
            while True:
                inflate, out = zlib.decompressobj(31), []
                while not inflate.eof:
                    held = held or f.read(1 << 20)
                    if not held:
                        return
                    out.append(inflate.decompress(held))
                    held = inflate.unused_data
                yield b"".join(out)

        def row(data: bytes) -> dict:
            fields, block = parse(data)
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            payload = block.partition(b"\r\n\r\n")[2]
            if kind == "response" and (_sha1(payload) != digest or len(payload) != int(fields["Payload-Length"])):
                raise ValueError(f"broken payload in {fields['WARC-Record-ID']}")
            number = lambda k: int(fields[k]) if k in fields else None
            return {"page_id": number("Page-Number"), "payload_bytes": number("Payload-Length"), "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Page")}

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        store = Store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open(name) as f:
                    rows = []
                    for data in members(f):
                        rows.append(row(data))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    if not files:
        return spark.createDataFrame([], _ROWS)
    listed = spark.createDataFrame([(f["file"],) for f in files], "file string")
    return listed.repartitionByRange(len(files), "file").mapInArrow(read, _ROWS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    return read_warc(spark, path, write_warc(table(spark, sf_dir, "pages"), path))


#: Base32 is spelt out over the 160 bits of the digest, five at a time.
SQL = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
             q AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS keep FROM p),
             b AS (SELECT *, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(x, i, 1)) - 1) AS n FROM q)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                   (((n[(5 * k) // 4 + 1] * 16 + coalesce(n[(5 * k) // 4 + 2], 0)) >> (3 - (5 * k) % 4)) & 31))::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM b"""
}
