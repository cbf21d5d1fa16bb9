"""Deterministic sharded WARC archives: write, commit, read back.

The same rows give the same bytes, whatever the partitioning, retries or speculative attempts:
records are ordered by (page id, digest), shards are cut where the running payload size in that
order passes a multiple of ``shard_bytes``, files inside a shard roll by compressed size, gzip
headers carry no time, record ids are derived from the rows. Every file is written under a
temporary name and renamed; files count only once the manifest, written last, names them.

Null html is an empty payload; a null url becomes ``urn:page:<id>``; a page id may be null (such rows
come first in the order and are never a response that others refer to). Rows that repeat the
largest id of their group are all responses. An empty table gives an archive without files. Extra
columns are ignored. All rows of one page id and digest are written by one task, as a stream.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.session import shared_path, stage_table

MANIFEST = "file string, shard long, records long, n_bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, position long"
DATE = "2000-01-01T00:00:00Z"
# a table of responses with copies up to this many rows travels to every executor (under 100 bytes a row)
SMALL_LEADERS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- one record -----------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(row: dict, date: str) -> bytes:
    """One record with headers regenerated from the row; a revisit has no payload."""
    digest = f"sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}"
    revisit = row["leader"] is not None
    payload = b"" if revisit else (row["html"] or "").encode()
    if not revisit and hashlib.sha1(payload).hexdigest() != row["digest"]:
        raise ValueError(f"payload of page {row['page_id']} does not match its digest")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
    block = http.encode() + payload
    url = "".join(c if " " < c < "\x7f" or c > "\xa0" else f"%{ord(c):02X}" for c in row["url"] or "")
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(row["page_id"], row["digest"]),
        "WARC-Date": date,
        "WARC-Target-URI": url or f"urn:page:{row['page_id']}",
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Payload-Length": str(row["n_bytes"]),
    }
    if row["page_id"] is not None:
        headers["X-Page-Id"] = str(row["page_id"])
    if revisit:
        headers["WARC-Profile"] = REVISIT_PROFILE
        headers["WARC-Refers-To"] = record_id(row["leader"], row["digest"])
        headers["X-Refers-To-Page-Id"] = str(row["leader"])
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict | None:
    """The fields of one record, checked against its digests; None for an info record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    if h["WARC-Type"] == "warcinfo":
        return None
    size = int(h["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {h['WARC-Record-ID']} is cut")
    digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
    revisit = h["WARC-Type"] == "revisit"
    n = int(h["X-Payload-Length"])
    if not revisit:
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != n:
            raise ValueError(f"record {h['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {
        "page_id": number("X-Page-Id"), "payload_bytes": n, "payload_digest": digest,
        "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"),
    }


# ---- files ----------------------------------------------------------------------


def _open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _File:
    """One archive file under a temporary name; ``commit`` renames it."""

    def __init__(self, folder: str, shard: int, part: int, date: str):
        self.fs, self.base = _open_folder(folder)
        self.name, self.shard, self.records, self.size = f"part-{shard:06d}-{part:05d}.warc.gz", shard, 0, 0
        self.temporary = f"{self.base}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.base}/_temporary")
        self.out, self.sha = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
        body = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        head = (
            f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, self.name)}\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        )
        self._put(head.encode() + body + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        member = gzip.compress(data, compresslevel=6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def commit(self) -> pa.RecordBatch:
        self.out.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        row = [[self.name], [self.shard], [self.records], [self.size], [self.sha.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=[x.split()[0] for x in MANIFEST.split(", ")])


def _writer(folder: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, file = None, 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if file and (row["shard"] != shard or file.size >= roll_bytes):
                        yield file.commit()
                        file, part = None, part + 1
                    if row["shard"] != shard:
                        shard, part = row["shard"], 0
                    file = file or _File(folder, shard, part, date)
                    file.add(record_bytes(row, date))
        if file:
            yield file.commit()

    return write


def members(stream, sha=None, block: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one in memory at a time."""
    rest, inflate, out = b"", None, io.BytesIO()
    while True:
        data = rest
        if not data:
            data = stream.read(block)
            if sha is not None:
                sha.update(data)
        if not data:
            if inflate is not None:
                raise ValueError("the last member is cut")
            return
        inflate = inflate or zlib.decompressobj(wbits=31)
        out.write(inflate.decompress(data))
        rest = inflate.unused_data
        if inflate.eof:
            yield out.getvalue()
            inflate, out = None, io.BytesIO()


# ---- the whole table ------------------------------------------------------------


def _cuts(facts: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (page_id, digest) of every shard in order: as many rows as shards."""
    spark = facts.sparkSession
    order = [F.asc_nulls_first("page_id"), F.col("digest")]
    parts = stage_table(
        facts.select("page_id", "digest", "n_bytes").repartitionByRange(*order).withColumn("part", F.spark_partition_id()),
        "warc-order",
    )
    offset, offsets = 0, []
    for part, size in sorted((r[0], r[1]) for r in parts.groupBy("part").agg(F.sum("n_bytes")).collect()):
        offsets.append((part, offset))
        offset += size
    starts = spark.createDataFrame(offsets, "part int, start long")
    before = F.sum("n_bytes").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    at = parts.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.coalesce(before, F.lit(0)))
    key = F.struct(F.col("page_id").isNotNull().alias("some"), F.coalesce("page_id", F.lit(0)).alias("id"), "digest")
    firsts = at.groupBy(F.floor(F.col("at") / shard_bytes).alias("shard")).agg(F.min(key).alias("first")).collect()
    return sorted(tuple(r["first"]) for r in firsts)


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    revisit_bytes: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, date: str = DATE,
) -> DataFrame:
    """Write one record per row below ``folder``; returns the manifest (one row per file).

    Of the rows with equal payloads of at least ``revisit_bytes`` bytes, those with the largest
    page id are responses and the others revisits of it.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"),
    )
    facts = stage_table(rows.select("page_id", "digest", "n_bytes"), "warc-facts")
    large = facts.where((F.col("n_bytes") >= revisit_bytes) & F.col("page_id").isNotNull())
    groups = facts.where(F.col("n_bytes") >= revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"))
    leaders = large.groupBy("digest").agg(F.max("page_id").alias("leader")).join(groups.where("n > 1"), "digest")
    leaders = stage_table(leaders.select("digest", "leader"), "warc-leaders")
    if leaders.limit(SMALL_LEADERS + 1).count() <= SMALL_LEADERS:
        leaders = F.broadcast(leaders)
    rows = rows.join(leaders, "digest", "left")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    rows = rows.withColumn("leader", F.when(revisit, F.col("leader")))
    rows = rows.withColumn("html", F.when(F.col("leader").isNull(), F.col("html")))
    cuts = _cuts(facts, shard_bytes)

    @F.pandas_udf("long")
    def shard(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        keys = ((pd.notna(p), 0 if pd.isna(p) else int(p), d) for p, d in zip(page_id, digest, strict=True))
        return pd.Series([max(0, bisect.bisect_right(cuts, k) - 1) for k in keys], dtype="int64")

    # page ids travel as text: a column with nulls would come to pandas as doubles
    rows = rows.withColumn("shard", shard(F.col("page_id").cast("string"), "digest"))
    rows = rows.repartitionById(max(1, len(cuts)), F.col("shard").cast("int"))
    rows = rows.sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest")
    wanted = rows.select("shard", "page_id", "url", "digest", "n_bytes", "leader", "html")
    wanted.mapInArrow(_writer(folder, roll_bytes, date), MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in the manifest, checked against their digests and sizes."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_folder(folder)
        schema = pa.schema(
            [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in RECORDS.split(", "))]
        )
        for batch in batches:
            for entry in batch.to_pylist():
                sha, n, some = hashlib.sha256(), 0, []
                with fs.open_input_stream(f"{base}/{entry['file']}", compression=None) as stream:
                    for position, data in enumerate(members(stream, sha)):
                        if record := parse_record(data):
                            n += 1
                            some.append(record | {"file": entry["file"], "position": position})
                        if len(some) >= 5000:
                            yield pa.RecordBatch.from_pylist(some, schema=schema)
                            some = []
                if sha.hexdigest() != entry["sha256"] or n != entry["records"]:
                    raise ValueError(f"{entry['file']} does not match the manifest")
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000)).mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages below the shared folder and read the archive back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    write_archive(pages, folder, **options)
    return read_archive(spark, folder)
