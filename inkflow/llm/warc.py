"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by page_id and payload digest, one sorted range a task.  A task rolls to a new file when the compressed size
passes roll_bytes; every record is a gzip member of its own.  Headers, record ids, lengths and digests are made
anew from the payload, so equal input gives equal bytes.  Files are written under temporary names; the manifest is
a Parquet table that Spark commits; then the named files get their final names, and a second run of that step
finds them done.  Files of lost attempts are in no manifest.

Of records with equal payloads of at least revisit_bytes, the one with the largest page_id is the response and the
others revisit it without storing the payload.  Record ids are made of page_id and digest, and of a count for further
rows of the same ones, so no two records share one.  Nulls: a null html is an empty payload; a null url is an empty
target; rows with a null page_id are response records, spread over the tasks, and come back null.  Repeated page_ids stay
separate rows.  A very long page is one record, held by one task.  An empty table gives no files and no rows.  Other
columns, of whatever name, are ignored; the manifest has columns of its own only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import shared_dir, store

ROLL_BYTES = 256 << 20
REVISIT_BYTES = 1000
#: The profile of revisits by equal digest, and the date that every record carries unless one is given.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "part int, seq int, temp string, path string, n_records long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_id(page_id: int | None, digest: str, further: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}{further}')}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, further: str = "", date: str = DATE) -> bytes:
    """A response or revisit record as bytes.  The first record of a page_id and payload has no further mark."""
    sha = hashlib.sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha.hexdigest(), further)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join(url.splitlines()),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {base32(sha.digest())}",
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha.hexdigest())}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def warcinfo(name: str, date: str = DATE) -> bytes:
    block = b"software: inkflow\r\nformat: WARC File Format 1.1\r\n"
    return (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {date}\r\n"
        f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    ).encode() + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, refers_to, sha of every page that repeats a payload.  Only ids and digests are shuffled, and the group of
    a digest is one row after map-side aggregation; Spark splits a hot digest in the join."""
    rows = pages.where(F.octet_length(F.encode("html", "UTF-8")) >= least).select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(F.encode("html", "UTF-8"), 256).alias("sha")
    )
    first = rows.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "sha").where("page_id <> refers_to").select("page_id", "refers_to", "sha").distinct()


def write_warc(pages: DataFrame, out_dir: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the files and return MANIFEST.  The pages are shuffled once, with the few revisit rows among them."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt, seq, out, done = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None, []
        fs, folder = pafs.FileSystem.from_uri(out_dir)
        name, n, size = "", 0, 0
        last, again, to = None, 0, None  # (page_id, digest) of the row before, its rows so far, and what they refer to

        def close():
            out.close()
            done.append((part, seq, f"{folder}/.tmp-{attempt}-{name}", f"{folder}/{name}", n, size))

        for pdf in batches:
            null = pdf["page_id"].isna().tolist()
            for i, row in enumerate(pdf.itertuples(index=False)):
                page_id = None if null[i] else int(row.page_id)
                if last != (page_id, row.sha):
                    last, again, to = (page_id, row.sha), 0, None
                if row.kind == 0:  # such a row comes just before its pages
                    to = int(row.refers_to)
                    continue
                if out is None or size >= roll_bytes:
                    if out is not None:
                        close()
                        seq += 1
                    name, n = f"part-{part:06d}-{seq:05d}.warc.gz", 0
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/.tmp-{attempt}-{name}", compression=None)
                    head = member(warcinfo(name))
                    out.write(head)
                    size = len(head)
                further = f":{part}:{again}" if page_id is None else f":{again}" if again else ""
                data = member(record(page_id, row.url, row.html.encode(), to, further))
                out.write(data)
                n, size, again = n + 1, size + len(data), again + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["part", "seq", "temp", "path", "n_records", "n_bytes"])

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(out_dir)
        for pdf in batches:
            for temp, path, n_bytes in zip(pdf["temp"], pdf["path"], pdf["n_bytes"], strict=True):
                if fs.get_file_info(temp).type == pafs.FileType.File:
                    fs.move(temp, path)
                if fs.get_file_info(path).size != n_bytes:
                    raise OSError(f"{path} is not of the size that the manifest says")
            yield pdf

    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("string")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    both = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(F.encode(html, "UTF-8"), 256).alias("sha"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"),
    ).unionByName(revisits(pages, revisit_bytes).select("page_id", "sha", F.lit(0).alias("kind"), "refers_to", F.lit("").alias("url"), none.alias("html")))
    # Rows without an id refer to nothing and nothing to them, so they may be spread.
    both = both.withColumn("spread", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    rows = both.repartitionByRange(n, "page_id", "sha", "spread").sortWithinPartitions("page_id", "sha", "kind", "url", "spread").drop("spread")
    written = store(rows.mapInPandas(write, MANIFEST), f"{out_dir}/_manifest-temporary")
    return store(written.repartition(max(1, min(n, 64)), "part", "seq").mapInPandas(rename, MANIFEST), f"{out_dir}/_manifest")


def parse_records(fs: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; one member is in memory at a time."""
    with fs.open_input_stream(path, compression=None) as f:
        waiting = b""
        while True:
            z, out = zlib.decompressobj(31), []
            while not z.eof:
                data = waiting or f.read(1 << 20)
                if not data:
                    break
                out.append(z.decompress(data))
                waiting = z.unused_data
            if not out:
                return
            if not z.eof:
                raise ValueError(f"{path} is cut off")
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def read_warc(manifest: DataFrame, out_dir: str) -> DataFrame:
    """RECORDS of the archives, checking every stored payload and block against its digest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(out_dir)
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                for fields, block in parse_records(fs, path):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    if base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']} in {path}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} in {path}")
                    page_id, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page_id and int(page_id), n, digest, fields["WARC-Type"], to and int(to), fields["WARC-Target-URI"]))
                found = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")])
                yield found.astype({"page_id": "Int64", "refers_to": "Int64"})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInPandas(read, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    out_dir = shared_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, out_dir), out_dir).drop("url")

