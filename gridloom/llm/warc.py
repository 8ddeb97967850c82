"""WARC archives that are indexed as they are written.

Writers number their records by byte offset: the index (file, offset, length,
url, digest) is their output, so it exists before anything is read.  A read
takes index rows, sorts them by file and offset, joins neighbouring byte ranges
and fetches each joined range once.  Each record is a gzip member of its own,
so that offsets and lengths are those of the compressed file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.durable import durable, fresh_path, qualified
from gridloom.plans.session import bounded_batches

#: Smaller payloads are always stored: a revisit record would save nothing.
LEAST_REVISIT = 1000
#: Ranges that are at most so far apart are fetched together, up to the most bytes at once.
GAP, MOST = 64 << 10, 4 << 20
#: Compressed bytes of selected records a task reads, about, and payload bytes that it hands on at once.
SPLIT, HANDED = 32 << 20, 4 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def decide(pages: DataFrame, key: str = "page_id", body: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that are stored as a reference.

    Of equal payloads of ``least`` bytes or more the largest id is stored and
    the others refer to it.  Rows without an id are stored each, and so are
    rows that repeat the largest one.  Null payloads are empty.
    """
    payload = F.coalesce(F.col(body), F.lit(""))
    slim = durable(
        pages.select(F.col(key).alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")),
        "warc-digests",
    )
    stored = (
        slim.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("digest", "kept")
    )
    twin = slim.filter("page_id IS NOT NULL").join(stored, "digest").filter("page_id <> kept")
    return twin.select("page_id", "digest", F.col("kept").alias("refers_to")).distinct()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, ordinal: int) -> bytes:
    """One WARC/1.1 record.  A revisit has the length of its payload but not the payload."""
    name = page_id if page_id is not None else f"none-{ordinal}"
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = b"" if revisit else payload
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises if it isn't whole."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than the index has")
    return fields, rest[:n]


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Archive ``pages`` below ``folder`` and return the index of all records.

    One file a task, written under a name of its own and moved into place when
    it is whole, so a task that is run twice leaves no half file and the index
    names only files of attempts that ended.
    """
    folder = qualified(pages.sparkSession, folder)
    refers = decide(pages, key, body, least)
    rows = bounded_batches(pages).select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary")))
    marked = rows.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "body", "digest", "refers_to")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        at = 0
        index: list[pd.DataFrame] = []
        out = None
        for pdf in batches:
            if out is None:
                out = fs.open_output_stream(f"{name}.part")
            found = []
            for page, link, text, digest, refers_to in zip(*(pdf[c] for c in ("page_id", "url", "body", "digest", "refers_to"))):
                payload = text.encode("utf-8", "surrogatepass")
                page, to = (None if pd.isna(v) else int(v) for v in (page, refers_to))
                raw = gzip.compress(record_bytes(page, link, payload, digest, to, at), LEVEL, mtime=0)
                out.write(raw)
                found.append((page, f"{name}", at, len(raw), link, digest, "response" if to is None else "revisit", to))
                at += len(raw)
            frame = pd.DataFrame(found, columns=[x.split()[0] for x in INDEX.split(", ")])
            index.append(frame.astype({"page_id": "Int64", "refers_to": "Int64"}))
        if out is not None:
            out.close()
            fs.move(f"{name}.part", name)
            yield from index

    return durable(marked.mapInPandas(archive, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, list[int]]]:
    """Join sorted ``(offset, length)`` to ``(start, stop, members)``.

    Ranges at most ``gap`` apart are joined while the whole stays within
    ``most`` bytes; a longer record is a range of its own.
    """
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(rows):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            start, stop, members = out[-1]
            out[-1] = (start, max(stop, offset + length), [*members, k])
        else:
            out.append((offset, offset + length, [k]))
    return out


def unzip(raw: memoryview) -> bytes:
    """One gzip member, decompressed piece by piece."""
    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as source:
        return b"".join(iter(lambda: source.read(1 << 20), b""))


def read(spark: SparkSession, index: DataFrame, folder: str, gap: int = GAP, most: int = MOST, split: int = SPLIT, payloads: bool = True, handed: int = HANDED) -> DataFrame:
    """The records of the index rows, fetched by joined byte ranges.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to`` and, if asked for, ``payload``; a stored payload is hashed anew
    and must have the digest of its header.  However well records compress, a
    task holds one fetched range, one record and ``handed`` payload bytes.  The index is dealt out in ranges of file and offset,
    as many as the selected bytes need, so a large file is spread over tasks.
    """
    folder = qualified(spark, folder)
    chosen = bounded_batches(index).select("file", "offset", "length")
    total = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / split), min(chosen.select("file").distinct().count(), spark.sparkContext.defaultParallelism))
    sorted_rows = chosen.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def framed(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for file, part in pdf.groupby("file", sort=False):
                with fs.open_input_file(file) as source:
                    spots = list(zip(part["offset"].tolist(), part["length"].tolist()))
                    for start, stop, members in ranges(spots, gap, most):
                        source.seek(start)
                        view = memoryview(source.read(stop - start))
                        found, held = [], 0
                        for k in members:
                            offset, length = spots[k]
                            fields, block = parse_record(unzip(view[offset - start : offset - start + length]))
                            digest = b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                            kind = fields["WARC-Type"]
                            if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                                raise ValueError(f"{file} at {offset}: the payload has another digest than its header")
                            ident = [fields.get(h, "").removeprefix("<urn:page:").removesuffix(">") for h in ("WARC-Record-ID", "WARC-Refers-To")]
                            page, to = (int(v) if v.lstrip("-").isdigit() else None for v in ident)
                            found.append((page, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, kind, to, *[block] * payloads))
                            held += len(block)
                            if held >= handed:
                                yield framed(found)
                                found, held = [], 0
                        if found:
                            yield framed(found)

    return sorted_rows.mapInPandas(fetch, schema)


def archive_and_read(pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Write all ``pages`` and read every record back through the index."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    return read(spark, write(pages, folder), folder, payloads=payloads)
