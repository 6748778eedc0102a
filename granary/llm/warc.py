"""Deterministic sharded WARC archives (operator 2).

write() sorts the records by page_id into shards of about equal bytes whose bounds depend on the data only, writes each
record as a gzip member with headers and digests made anew, rolls a shard's file at a compressed size, writes under a
temporary name, renames at the end to a name that has the digest of the bytes, and then commits a manifest of the files (a
Parquet table). A finished file is never deleted or overwritten: a task that runs again writes the same bytes, finds the name
taken and drops its own, so lost executors and speculative tasks do no harm; files that the manifest does not name are not
read. read() takes the manifest and gives the records back, digests checked.

Shards have SHARD_BYTES, or more where there would be more than MOST_SHARDS: bounds are in every task's closure.

Edge cases: null html is an empty payload; a null url gives the target urn:page:<page_id>; rows without a page_id are written
without an id, dealt out over all shards by their digest, and never referred to; rows that repeat a page_id are each
written, as responses where that page_id is the smallest of its payload; an empty table gives a manifest without files. Other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_arrow, scratch
from .exact_dedup import attach

#: Records with equal payloads of at least so many bytes are revisits of the first.
LEAST_REVISIT = 100
SHARD_BYTES, FILE_BYTES, MOST_SHARDS = 32 << 20, 16 << 20, 100_000
BINS, LEVEL = 4096, 5
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string"
RECORD = "page_id long, record_id string, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def shard_bounds(sizes: DataFrame, target: int) -> list[int]:
    """First page_ids of the shards but the first. Byte sums over bins of the id range; a bin larger than a shard is parted
    again, so clumped ids are dealt out too. Sums of whole numbers: the same whatever the partitions."""
    lo, hi = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if lo is None:
        return []
    spans, done = [(lo, hi + 1)], []
    while spans:
        heavy = []
        for a, b in spans:
            width = max(1, -(-(b - a) // BINS))
            bins = sizes.where((F.col("page_id") >= a) & (F.col("page_id") < b)).groupBy(F.expr(f"CAST((page_id - {a}L) DIV {width}L AS INT)").alias("bin")).agg(F.sum("payload_bytes").alias("n"))
            for r in bins.collect():
                start = a + r["bin"] * width
                (heavy if r["n"] > target and width > 1 else done).append((start, min(start + width, b)) if r["n"] > target and width > 1 else (start, r["n"]))
        spans = heavy
    bounds, held = [], 0
    for start, n in sorted(done):
        if held and held + n > target:
            bounds.append(start)
            held = 0
        held += n
    return bounds


def plan(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, list[int]]:
    """(page_id, refers_to) of the pages that refer to another, and the bounds of the shards."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    facts = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("digest")), "payloads")
    large = facts.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    refs = attach(large, cut(first, "first"), "digest", "n").where(F.col("page_id") > F.col("refers_to")).select("page_id", "refers_to").dropDuplicates(["page_id"])
    sizes = facts.select("page_id", (F.col("payload_bytes") + 512).alias("payload_bytes"))
    total = sizes.agg(F.sum("payload_bytes")).first()[0] or 0
    return refs, shard_bounds(sizes, max(shard_bytes, -(-total // MOST_SHARDS)))


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    payload = (html or "").encode()
    digest = hashlib.sha256(payload).hexdigest()
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    ident = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{ident(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{ident(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, out: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Writes the archives and their manifest under out; gives the manifest's path."""
    refs, bounds = plan(pages, shard_bytes)
    edges = np.array(bounds, dtype=np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["page_id"].fill_null(0).to_numpy(zero_copy_only=False)
            shards = np.searchsorted(edges, ids, side="right")
            for i in np.flatnonzero(b["page_id"].is_null().to_numpy(zero_copy_only=False)).tolist():
                shards[i] = int(hashlib.sha256((b["html"][i].as_py() or "").encode()).hexdigest()[:12], 16) % (len(edges) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *b.columns], ["shard", *b.schema.names])

    # References come as rows of their own, before their page's, so that whole pages are shuffled once.
    columns = {"page_id": "long", "url": "string", "html": "string", "refers_to": "long"}
    rows = pages.select("page_id", "url", "html").unionByName(refs, allowMissingColumns=True).select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])
    rows = in_arrow(rows, placed, "shard int, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", F.desc_nulls_last("refers_to"), "url", "html")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{root}/.tmp", recursive=True)
        shard = seq = -1
        stream = None
        done: list[tuple] = []
        reference = (None, None)

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                # The name has the digest of the bytes: an attempt that runs again finds its own bytes under it, or nothing.
                name = f"part-{shard:06d}-{seq:05d}-{sha.hexdigest()[:16]}.warc.gz"
                if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    fs.move(temp, f"{root}/{name}")
                else:
                    fs.delete_file(temp)
                done.append((name, shard, seq, count, size, sha.hexdigest()))
                stream = None

        for b in batches:
            for r in b.to_pylist():
                if r["refers_to"] is not None:
                    reference = (r["page_id"], r["refers_to"])
                    continue
                refers_to = reference[1] if reference[0] == r["page_id"] else None
                if r["shard"] != shard:
                    close()
                    shard, seq = r["shard"], -1
                if stream is None:
                    seq += 1
                    temp, count, size, sha = f"{root}/.tmp/{shard}-{seq}-{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
                    stream = fs.open_output_stream(temp, compression=None)
                member = gzip.compress(record(r["page_id"], r["url"], r["html"], refers_to), LEVEL, mtime=0)
                stream.write(member)
                sha.update(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(manifest_schema.names, x, strict=True)) for x in done], manifest_schema)

    manifest_schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    in_arrow(rows, written, MANIFEST).write.parquet(f"{out}/manifest")
    fs, root = pafs.FileSystem.from_uri(out)
    if fs.get_file_info(f"{root}/.tmp").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/.tmp")  # what lost attempts have left
    return f"{out}/manifest"


def headers(stream) -> dict[str, str] | None:
    line = stream.readline()
    if not line:
        return None
    found = {"": line.decode().strip()}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        found[name.lower()] = value.strip()
    return found


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an unpacked archive."""
    while (head := headers(stream)) is not None:
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        if head["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError(f"digest of {head['warc-record-id']} differs")
        yield head, block


def read(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """The records of the archives that the manifest under out names; the payloads too if asked for."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for name in (x for b in batches for x in b["file"].to_pylist()):
            rows: list[dict] = []
            with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for head, block in records(stream):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    whole = head["warc-type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if whole else head["warc-payload-digest"].removeprefix("sha256:")
                    if "sha256:" + digest != head["warc-payload-digest"]:
                        raise ValueError(f"payload digest of {head['warc-record-id']} differs")
                    length = len(payload) if whole else int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append(dict(zip(schema.names, (number("x-page-id"), head["warc-record-id"], head["warc-type"], head["warc-target-uri"], number("x-refers-to-page-id"), length, digest, payload if payloads and whole else None), strict=True)))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select("file")
    n = max(1, files.count())
    return in_arrow(files.repartition(min(n, 4096)), unpacked, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, then reads these back."""
    out = scratch(pages.sparkSession, "warc")
    write(pages, out)
    return read(pages.sparkSession, out)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
