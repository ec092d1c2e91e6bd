"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by id into shards, each shard's records go to files that are rolled once they
reach a compressed size, and headers and digests are made anew from the payload. Shard borders are
quantiles of the ids whose hash falls below a bound, so that the same rows and settings give the
same files byte for byte, whichever tasks run them. Each record is a gzip member of its own without
a time stamp. Files are written under temporary names, renamed once complete, and count only if the
manifest names them; a task that runs twice writes the same bytes to the same name.

Of records with equal payloads of ``min_bytes`` or more, the one of the least id is a response, the
others are revisits that name it and keep digest and length of the full payload (the length in the
HTTP header that a revisit carries). Which rows are revisits is found on ids and digests alone and
meets the records in the shard's sort order, so payloads move once, compressed.

A null payload is empty. Rows with a null id are written first; they revisit if a row with an id has
the payload and are responses else. Of repeated rows with the same id and payload the first is the
response. A null address becomes ``urn:page:ID``. Other columns are ignored.
"""

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, cut, utf8
from sieveline.session import shared_folder

FILE_BYTES = 256 * 1024 * 1024
#: Shards per shuffle partition, payload bytes of a shard at most on average, and sampled ids per shard.
SHARDS, SHARD_BYTES, SAMPLE = 3, 32 * 1024 * 1024, 20
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "shard int, page_id long, digest string, page boolean, refers_to long, url string, size long, record binary"
MANIFEST = "name string, records long, bytes long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))]), "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def page_record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed record; a revisit has no payload but the full one's digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, f"{digest}/{kind}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", f"urn:page:{page_id}" if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if kind == "revisit":
        fields.append(("WARC-Profile", REVISIT))
        fields.append(("WARC-Refers-To", record_id(refers_to, f"{digest}/response")))
        fields.append(("Refers-To-Page-Id", str(refers_to)))
    return _member(fields, block)


def _info(name: str) -> bytes:
    fields = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
    ]
    return _member(fields, b"format: WARC File Format 1.1\r\n")


def revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest, refers_to for the rows of every payload that occurs more than once."""
    large = rows.where(F.col("size") >= min_bytes)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and refers_to is not null").drop("n")
    return large.select("page_id", "digest").distinct().join(first, "digest").select("page_id", "digest", "refers_to")


def shard_borders(rows: DataFrame, total: int, shards: int) -> list[int]:
    """Ids that cut the ``total`` rows into about equal shards, from a sample chosen by hash."""
    rate = min(1.0, SAMPLE * shards / max(1, total))
    chosen = F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < int(rate * (1 << 40))
    # About SAMPLE ids per shard come to the driver.
    ids = sorted(r[0] for r in rows.where(F.col("page_id").isNotNull() & chosen).select("page_id").distinct().collect())
    return [ids[len(ids) * k // shards] for k in range(1, shards)] if ids else []


class _Archive:
    """A file of records under a temporary name."""

    def __init__(self, store: pafs.FileSystem, folder: str, name: str, attempt: int):
        self.store, self.name, self.records = store, name, 0
        self.temporary, self.final = f"{folder}/.{name}.{attempt}", f"{folder}/{name}"
        self.out = store.open_output_stream(self.temporary)
        self.bytes = self.out.write(_info(name))

    def add(self, record: bytes) -> None:
        self.bytes += self.out.write(record)
        self.records += 1

    def commit(self) -> tuple[str, int, int]:
        self.out.close()
        self.store.move(self.temporary, self.final)
        return self.name, self.records, self.bytes


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
    min_bytes: int = 0, file_bytes: int = FILE_BYTES, shards: int | None = None,
) -> DataFrame:
    """Writes the archives and returns the manifest: name, records, bytes of each file."""
    spark = pages.sparkSession
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.select("page_id", F.sha1("html").alias("digest"), "url", "html")
    narrow = cut(rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("size")), "payloads")
    total, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = shards or max(least, -(-size // SHARD_BYTES))
    borders = np.array(shard_borders(narrow, total, n_shards), np.int64)
    marks = revisits(narrow, min_bytes).select(
        "page_id", "digest", F.lit(False).alias("page"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit("").alias("html")
    )
    no_id = F.lit(None).cast("long").alias("refers_to")
    both = rows.select("page_id", "digest", F.lit(True).alias("page"), no_id, "url", "html").unionByName(marks)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payloads in blocks(batch, "html"):
                ids = part.column("page_id").to_pylist()
                shards = [0 if i is None else int(np.searchsorted(borders, i, "right")) for i in ids]
                records = [
                    page_record("response", i, url, payload_digest(p), len(p), p, None) if page else b""
                    for i, url, page, p in zip(ids, part.column("url").to_pylist(), part.column("page").to_pylist(), payloads)
                ]
                columns = [
                    pa.array(shards, pa.int32()), *(part.column(c) for c in ("page_id", "digest", "page", "refers_to", "url")),
                    pa.array([len(p) for p in payloads], pa.int64()), pa.array(records, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ROW.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        done, archive, shard, part = [], None, None, 0
        key, refers_to, answered = None, None, False
        for batch in batches:
            names = ("shard", "page_id", "digest", "page", "refers_to", "url", "size")
            for at, *values in zip(range(batch.num_rows), *(batch.column(n).to_pylist() for n in names)):
                row_shard, page_id, digest, page, refers, url, size = values
                if key != (page_id, digest):
                    key, refers_to, answered = (page_id, digest), None, False
                if not page:  # sorts before the page's own rows
                    refers_to = refers
                    continue
                if archive and (row_shard != shard or archive.bytes >= file_bytes):
                    done.append(archive.commit())
                    part = part + 1 if row_shard == shard else 0
                    archive = None
                if archive is None:
                    archive = _Archive(store, path, f"{row_shard:07d}-{part:05d}.warc.gz", attempt)
                    shard = row_shard
                if refers_to is not None and (page_id != refers_to or answered):
                    full = base64.b32encode(bytes.fromhex(digest)).decode()
                    archive.add(page_record("revisit", page_id, url, full, size, b"", refers_to))
                else:
                    archive.add(batch.column("record")[at].as_py())
                    answered = True
        if archive:
            done.append(archive.commit())
        columns = list(zip(*done)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["name", "records", "bytes"])

    dealt = both.mapInArrow(compress, ROW).repartition(max(1, n_shards // SHARDS), "shard")
    ordered = dealt.sortWithinPartitions("shard", "page_id", "digest", "page", "url")
    return cut(ordered.mapInArrow(write, MANIFEST), "warc-manifest")


def _members(file) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    rest, inflate, out = b"", zlib.decompressobj(31), []
    while True:
        if not rest:
            rest = file.read(1 << 20)
            if not rest:
                break
        out.append(inflate.decompress(rest))
        rest = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; digests that do not fit raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "warcinfo":
        return fields, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    answer = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return fields, answer, payload


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and html (null for revisits) of every record."""
    files = max(1, manifest.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", html string" if with_payload else ""
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as file:
                    for member in _members(file):
                        fields, http, payload = parse_record(member)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        row = (
                            number("Page-Id"), fields["WARC-Target-URI"], int(http["Content-Length"]),
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number("Refers-To-Page-Id"),
                        )
                        rows.append((*row, payload.decode() if kind == "response" else None) if with_payload else row)
                        held += len(payload) if with_payload else 100
                        if held >= 1 << 22 or len(rows) >= 10_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("name").repartition(files).mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """What reading back archives of all rows, written in the shared folder, gives of each record."""
    folder = shared_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    return read_archives(pages.sparkSession, manifest, folder, with_payload=False)
