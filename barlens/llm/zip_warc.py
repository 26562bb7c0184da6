"""Web archives in ZIP packages: written per task, read back by ranges.

A package holds a WARC of individually compressed records (``archive/data.warc.gz``) and an index of their offsets
(``indexes/index.tsv``), both stored without ZIP compression, so that every record is a byte range of the package.

The reader never extracts: it reads the package's tail, follows the ZIP64 locator where there is one, parses the central
directory, steps over the local headers to the stored members, reads the index and then the records by range, in batches.
Only range reads are asked of the file system, so packages may lie in any store that pyarrow can open.

Of pages with equal payloads of at least ``least`` bytes, that with the smallest ``page_id`` is a response and the others
revisit it; smaller payloads are all responses. Digests are made by Spark; copies meet as a digest, a number and an id.

Defined results: null html is an empty payload; a null ``page_id`` is written without an id and never referred to; rows
that repeat the smallest ``page_id`` of a payload are all responses; a null or odd url is left out or percent-encoded;
other columns are ignored; an empty table writes no package and reads no record.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import bound_batches, settle

LEAST = 100
#: A package is closed after so many bytes of records; so many bytes of records are read at a time.
PACKAGE, READ = 64 << 20, 8 << 20
#: Tasks that read packages back, at most.
READERS = 20_000
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.tsv"


def roles(pages: DataFrame, *, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to``: which page each copy revisits."""
    body = F.coalesce("html", F.lit(""))
    p = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("html"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha2(F.encode(body, "utf-8"), 256).alias("payload_digest")
    )
    copies = p.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    # pages without their html meet the copies; what moves the html then has the page in its key, however often a payload repeats
    refs = p.select("page_id", "payload_digest").join(copies, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    refs = refs.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("first_id").alias("refers_to")).distinct()
    p = p.join(refs, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return p.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of what it revisits, with its ``size``, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def store(folder: str):
    """The file system and path of a folder URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows of :func:`roles` as packages below ``folder``; returns ``(package, records)``, those of finished tasks only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, done = None, []
        where, base = store(folder)
        where.create_dir(base, recursive=True)

        def close():
            at["member"].close()
            with at["zip"].open(INDEX, "w") as f:
                f.write("".join(f"{i}\t{o}\t{n}\n" for i, o, n in at["index"]).encode())
            at["zip"].close()
            at["file"].close()
            done.append((at["name"], len(at["index"])))

        for b in batches:
            for page_id, url, html, size, digest, refers in zip(b["page_id"].astype("Int64"), b["url"], b["html"], b["payload_bytes"], b["payload_digest"], b["refers_to"].astype("Int64")):
                if at is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    file = where.open_output_stream(f"{base}/{name}")
                    pack = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True)
                    at = {"name": name, "file": file, "zip": pack, "member": pack.open(MEMBER, "w", force_zip64=True), "index": [], "size": 0}
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                raw = gzip.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers, int(size)), 6, mtime=0)
                at["member"].write(raw)
                at["index"].append(("" if page_id is None else page_id, at["size"], len(raw)))
                at["size"] += len(raw)
                if at["size"] >= PACKAGE:
                    close()
                    at = None
        if at is not None:
            close()
        yield pd.DataFrame({"package": [f"{folder}/{n}" for n, _ in done], "records": [n for _, n in done]}).astype({"package": str, "records": "int64"})

    bound_batches(pages.sparkSession)
    return pages.mapInPandas(run, "package string, records bigint")


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Name to ``(offset, length)`` of the stored members, from the central directory at the end of a package."""
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<10xHII", tail[end : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (far,) = struct.unpack("<8xQ", tail[end - 20 : end - 4])
        file.seek(far)
        count, length, start = struct.unpack("<32xQQQ", file.read(56))
    file.seek(start)
    directory, at, out = file.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n, extra, note, local = struct.unpack("<10xH8xIIHHH8xI", directory[at : at + 46])
        name, more = directory[at + 46 : at + 46 + n].decode(), directory[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:  # the ZIP64 field holds, in this order, those values that did not fit
            kind, w = struct.unpack("<HH", more[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{w // 8}Q", more[4 : 4 + w // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            more = more[4 + w :]
        if method == 0:
            file.seek(local)
            a, b = struct.unpack("<26xHH", file.read(30))
            out[name] = (local + 30 + a + b, packed)
        at += 46 + n + extra + note
    return out


def parse(raw: bytes) -> dict:
    """A record's fields and payload; the payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    number = lambda name: int(fields[name][len("<urn:page:") : -1]) if name in fields else None
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_packages(packages: DataFrame, *, payload: bool = False) -> DataFrame:
    """The records of packages named in column ``package``, read by range; ``payload`` adds the bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
        for b in batches:
            for package in b["package"]:
                where, path = store(package)
                with where.open_input_file(path) as file:
                    held = members(file, file.size())
                    file.seek(held[INDEX][0])
                    index = [tuple(map(int, x.split(b"\t")[1:])) for x in file.read(held[INDEX][1]).splitlines()]
                    base, i = held[MEMBER][0], 0
                    while i < len(index):
                        j, span = i, 0
                        while j < len(index) and (not span or span + index[j][1] <= READ):
                            span += index[j][1]
                            j += 1
                        file.seek(base + index[i][0])
                        data, out = file.read(span), []
                        for o, n in index[i:j]:
                            r = parse(gzip.decompress(data[o - index[i][0] : o - index[i][0] + n]))
                            out.append([r[c] for c in names])
                        i = j
                        got = pd.DataFrame(out, columns=names)
                        yield got.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    bound_batches(packages.sparkSession)
    return packages.select("package").mapInPandas(run, RECORD + ", payload binary" * payload)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages below ``folder`` and read every record back."""
    manifest = settle(write_packages(roles(pages), folder))
    # a stated number of tasks: by size alone the few bytes of package names would all become one
    tasks = min(max(1, manifest.count()), READERS)
    return read_packages(manifest.repartition(tasks, "package"))
