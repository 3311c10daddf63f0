"""Deterministic sharded WARC archives.

Pages are range-sorted by id into shards whose bounds come from the ids with the smallest hashes (so that the same
pages give the same shards in every run), each shard's task writes one gzip member a record, rolls to the next file
when the compressed size is reached, and regenerates HTTP and WARC headers, record ids and SHA-1 digests. Tasks write
under temporary names only and report what they wrote; the report of the attempts that counted is stored as a
manifest, and only files named there are renamed to their final names. A lost or repeated attempt leaves at most an
unnamed temporary file. Of pages with equal payloads the one with the largest id is a response record, the
others are revisits of it.

The output folder must be one that pyarrow.fs opens on every executor (a shared mount, HDFS, S3, GCS).

Defined cases: null payload counts as empty; null url becomes the empty URI; null ids are spread over the shards by
payload, sort first there, and never are the response of a group that has an id; of rows with equal id and equal payload the first is the response, the others
revisit it; empty tables give an empty archive folder with a manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, lean, new_path, stage

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace of URLs
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temporary string, name string, records long, bytes long, sha256 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str | None, url: str, payload: bytes, refers: str | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record with its closing blank lines, uncompressed."""
    payload_digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    rid = lambda x: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{x}/{payload_digest}')}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", rid(page)), ("WARC-Date", date), ("WARC-Target-URI", url)]
    if page is not None:
        head.append(("WARC-Page-ID", page))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", rid(refers))]
        head += [("WARC-Refers-To-Page-ID", refers)] if refers is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    clean = lambda v: " ".join(v.split("\r")).replace("\n", " ")
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp: equal records give equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Roll:
    """Writes the files of one task; .done has a manifest row for each closed file."""

    def __init__(self, uri: str, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.roll_bytes, self.shard, self.done, self.out = roll_bytes, None, [], None

    def put(self, shard: int, data: bytes) -> None:
        if self.shard != shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out and self.bytes + len(data) > self.roll_bytes:
            self.close()
            self.number += 1
        if not self.out:
            self.name, self.bytes, self.records, self.hash = f"_temporary/{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.name, f"pages-{self.shard:06d}-{self.number:05d}.warc.gz", self.records, self.bytes, self.hash.hexdigest()))
            self.out = None


MOST = 1 << 16  # shards: their bounds are held by the driver and each task


def shard_bounds(ids: DataFrame, shards: int) -> list:
    """At most shards - 1 different ids that cut the ids about evenly, from the 20 * shards ids of the smallest hashes. Beyond MOST shards
    they grow instead; files don't, since tasks stream and roll."""
    shards = min(shards, MOST)
    some = sorted(r[0] for r in ids.where(F.col("__id").isNotNull()).select("__id").orderBy(F.xxhash64("__id"), "__id").limit(20 * shards).collect())
    return sorted({some[len(some) * i // shards] for i in range(1, shards)}) if some else []


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = 16 << 20, shard_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages under uri; return the manifest."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keys = stage(pages.select(F.col(id_col).alias("__id"), F.sha1(payload).alias("__sha1"), F.length(payload).alias("__bytes")), "payloads")
    n, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    shared = keys.where(F.col("__bytes") >= min_bytes).groupBy("__sha1").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    roles = attach(keys, stage(shared, "shared_payloads"), "__sha1", "__n", n).where(F.col("__n").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__keep")))
    bounds = np.array(shard_bounds(keys, max(1, -(-size // shard_bytes))))

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        there = ids.notna().to_numpy()
        out = np.full(len(ids), -1, "int32")
        out[there] = np.searchsorted(bounds, ids[there].to_numpy().astype(bounds.dtype), "right") if len(bounds) else 0
        return pd.Series(out)

    empty = lambda name, t: F.lit(None).cast(t).alias(name)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), empty("sha1", "string"), empty("refers", kind), F.lit(1).alias("is_page"))
    notes = roles.select(F.col("__id").alias("id"), empty("url", "string"), empty("payload", "string"), F.col("__sha1").alias("sha1"), F.col("__keep").alias("refers"), F.lit(0).alias("is_page")).distinct()
    spread = F.pmod(F.xxhash64(F.coalesce("sha1", F.sha1(F.col("payload").cast("binary")))), F.lit(len(bounds) + 1)).cast("int")
    both = rows.unionByName(notes).withColumn("shard", shard("id"))
    both = both.withColumn("shard", F.when(F.col("id").isNull(), spread).otherwise(F.col("shard")))  # by payload, so that equal ones meet
    ordered = both.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", "id", "is_page", F.col("url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Roll(uri, roll_bytes)
        at, revisits, first = object(), {}, set()
        for b in batches:
            for r in b.to_pylist():
                if r["id"] != at:
                    at, revisits, first = r["id"], {}, set()
                if not r["is_page"]:
                    revisits[r["sha1"]] = r["refers"]
                    continue
                data = r["payload"].encode()
                sha1 = hashlib.sha1(data).hexdigest()
                again = sha1 in first and len(data) >= min_bytes
                refers = revisits.get(sha1, at)
                page = None if at is None else str(at)
                out.put(r["shard"], member(record(page, r["url"], data, None if refers is None else str(refers), again or sha1 in revisits and refers is not None, date)))
                first.add(sha1)
        out.close()
        yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in out.done], pa.int64() if k in ("records", "bytes") else pa.string()) for i, k in enumerate(("temporary", "name", "records", "bytes", "sha256"))})

    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    ordered.mapInArrow(lean(write), MANIFEST).write.parquet(f"{uri}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for r in b.to_pylist():
                old, new = f"{root}/{r['temporary']}", f"{root}/{r['name']}"
                if fs.get_file_info(old).type != pafs.FileType.NotFound:
                    fs.move(old, new)
                if fs.get_file_info(new).size != r["bytes"]:
                    raise OSError(f"{new} isn't what its manifest says")
            yield b

    manifest.mapInArrow(lean(commit), MANIFEST).write.format("noop").mode("overwrite").save()
    fs.delete_dir(f"{root}/_temporary")
    return manifest


def members(stream) -> Iterator[bytes]:
    """The records of a file: its gzip members, one after the other."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last record is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; its block digest and, of a response, its payload digest are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"{h['WARC-Record-ID']}: block digest")
    return h, block


def read_warc(spark: SparkSession, uri: str, manifest: DataFrame, id_type: str = "long", files_a_task: int = 4) -> DataFrame:
    """A row for each record: page_id, url, payload (null of revisits), payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in members(f):
                        h, block = parse(data)
                        payload = None
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if h["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
                                raise ValueError(f"{h['WARC-Record-ID']}: payload digest")
                        rows.append((h.get("WARC-Page-ID"), h["WARC-Target-URI"], payload, int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"][5:], h["WARC-Type"], h.get("WARC-Refers-To-Page-ID")))
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"page_id": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    files = manifest.select("name").distinct()
    tasks = max(1, -(-manifest.count() // files_a_task))
    rows = files.repartition(tasks, "name").mapInArrow(lean(read), "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write pages into a new folder of the shared one and read the archives back; columns as of read_warc."""
    uri = new_path(pages.sparkSession, "warc")
    manifest = write_warc(pages, uri, id_col, **options)
    return read_warc(pages.sparkSession, uri, manifest, dict(pages.dtypes)[id_col])
