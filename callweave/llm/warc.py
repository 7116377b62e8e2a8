"""WARC bundles in the seekable Zstandard format.

Records are grouped into independent frames; a bundle ends with a skippable frame that holds the seek
table (compressed and plain size of each frame). An index maps each record to its bundle, frame and
offset within the plain frame, so a reader decompresses one frame for one record. Tasks write bundles
under names of their own into a folder that all executors reach; a bundle counts only through the index
that the successful task returned, so retried tasks do no harm.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is a
response and the others revisit it. Defined cases: null html is an empty payload; null page_id ranks
lowest; a repeated row with the response's own id is a response too; an empty table writes no bundle and
gives an empty result; line ends in a url are percent-encoded; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, runs, shared_dir, table

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 256 << 20, 3
# Fixed values of the seekable format: magic of a skippable frame, and of the seek table's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame long, at long, length long, payload_bytes long, record_type string"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(handle, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame; the handle can seek and read."""
    handle.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    handle.seek(size - 9 - width * count)
    raw, out, at = handle.read(width * count), [], 0
    for i in range(count):
        c, d = struct.unpack_from("<II", raw, width * i)
        out.append((at, c, d))
        at += c
    return out


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with payload_digest, record_type and refers_to."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("payload_digest", F.sha1("html"))
    large = own.select("page_id", "payload_digest").filter(F.octet_length("html") >= MIN_REVISIT)
    response = large.groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    response = materialise(response.select("payload_digest", "response"), "warc-responses")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return own.join(response, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"),
    )


def write_bundles(planned: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write records into bundles under `folder`; returns the index, one row per record."""

    def work(batches):
        import zstandard
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        out = name = None
        frames, plain, rows, written = [], [], [], 0

        def end_frame():
            nonlocal plain, written
            if plain:
                packed = squeeze.compress(raw := b"".join(plain))
                out.write(packed)
                frames.append((len(packed), len(raw)))
                written += len(packed)
                plain = []

        def end_bundle():
            nonlocal out, frames, rows, written
            end_frame()
            out.write(seek_table(frames))
            out.close()
            done, out, frames, rows, written = rows, None, [], [], 0
            columns = list(zip(*done, strict=True))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
            names = ["page_id", "bundle", "frame", "at", "length", "payload_bytes", "record_type"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for a, b in runs(sizes):
                for page, url, html, digest, kind, refers in zip(*[c.slice(a, b - a).to_pylist() for c in batch.columns], strict=True):
                    if out is None:
                        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    raw = record(page, url, payload, digest, kind, refers)
                    if not plain:
                        held = 0
                    rows.append((page, name, len(frames), held, len(raw), len(payload), kind))
                    plain.append(raw)
                    held += len(raw)
                    if held >= frame_bytes:
                        end_frame()
                    if written >= bundle_bytes:
                        yield end_bundle()
        if out is not None:
            yield end_bundle()

    return materialise(planned.select("page_id", "url", "html", "payload_digest", "record_type", "refers_to").mapInArrow(work, INDEX), "warc-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string"


def read_bundles(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read every indexed record back: sizes and digests (of responses from the content read; of revisits
    from their headers), and with `payloads` the content."""

    def work(batches):
        import zstandard
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        plain = zstandard.ZstdDecompressor()
        bundle = handle = None
        tables, frame_at, frame = [], None, b""
        for batch in batches:
            rows = []
            for page, name, number, at, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != bundle:
                    handle = files.open_input_file(f"{root}/{name}")
                    tables, bundle, frame_at = read_seek_table(handle, handle.size()), name, None
                if number != frame_at:
                    offset, packed, _ = tables[number]
                    handle.seek(offset)
                    frame, frame_at = plain.decompress(handle.read(packed)), number
                headers, content = parse(frame[at : at + length])
                if headers["WARC-Record-ID"] != f"<urn:page:{page}>":
                    raise ValueError(f"the index leads to {headers['WARC-Record-ID']}, not to {page}")
                kind = headers["WARC-Type"]
                if kind == "response":
                    size, digest, refers = len(content), hashlib.sha1(content).hexdigest(), None
                else:
                    size, refers = int(headers["X-Payload-Length"]), int(headers["WARC-Refers-To"].split(":")[-1].rstrip(">"))
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                rows.append((page, size, digest, kind, refers, name) + ((content,) if payloads else ()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle"] + ["content"] * payloads
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return index.select("page_id", "bundle", "frame", "at", "length").mapInArrow(work, READ + ", content binary" * payloads)


def new_folder(spark) -> str:
    base = shared_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/callweave/warc-{uuid.uuid4().hex}"


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    index = write_bundles(plan_records(table(spark, sf_dir, "pages")), folder)
    return read_bundles(index, folder).drop("bundle")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""
