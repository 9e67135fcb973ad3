"""WARC records in ZIP archives: written by tasks, read back by byte ranges without extraction.

An archive holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.jsonl`` (page, byte offset and length of every record), both
stored, not deflated, so a record is a byte range of the archive file. The
reader parses the end record, the ZIP64 locator and end record, and the central
directory, finds the stored members, reads the index and then ranges of records;
ranges are dealt out in blocks, so one large archive is read by many tasks.

Of pages with equal payloads of ``min_bytes`` or more the smallest page_id is a
response and the others are revisits without a payload that refer to it.

Defined results: a null html is an empty payload; null urls are left out of the
record; pages with a null id come back with a null id and are never referred to
(equal ones of null ids only are all responses); repeated rows of one page_id
are all responses if that id is the smallest; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace, broadcast_if_small, open_fs, prepare_workers, publish

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_BYTES = 8 << 20


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: HTTP head and payload, or for a revisit the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_uri(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields, HTTP length and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"fields": fields, "length": length, "payload": payload}


def page_of(uri: str | None) -> int | None:
    value = uri and uri[len("<urn:x-page:") : -1]
    return int(value) if value and value != "null" else None


def write(pages: DataFrame, folder: str, min_bytes: int = 100, level: int = 3) -> DataFrame:
    """Write one archive per task with rows; returns (uri, n_records, n_bytes) per archive."""
    prepare_workers(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    same = Workspace(pages.sparkSession, "warc-digests").write(same.where("n > 1 and first_id is not null").select("digest", "first_id"), "same")
    rows = rows.join(broadcast_if_small(same), "digest", "left")
    rows = rows.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, index = TaskContext.get(), []
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        uri = f"{folder}/pages-{task.partitionId():06d}.zip"

        def records() -> Iterator[tuple]:
            for batch in (b for source in ([first], batches) for b in source):
                whole = lambda v: None if pd.isna(v) else int(v)
                yield from ((whole(p), u, d, g, whole(r)) for p, u, d, g, r in zip(batch["page_id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"]))

        def body(out) -> None:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                    at = 0
                    for page_id, url, payload, digest, refers_to in records():
                        data = gzip.compress(warc_record(page_id, url, bytes(payload), digest, refers_to), level, mtime=0)
                        member.write(data)
                        index.append((page_id, at, len(data)))
                        at += len(data)
                lines = (json.dumps({"page_id": p, "offset": a, "length": n}) + "\n" for p, a, n in index)
                with archive.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                    for line in lines:
                        member.write(line.encode())

        publish(uri, body, task.taskAttemptId())
        yield pd.DataFrame({"uri": [uri], "n_records": [len(index)], "n_bytes": [sum(r[2] for r in index)]})

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInPandas(run, "uri string, n_records long, n_bytes long")


def directory(file) -> dict[str, tuple[int, int]]:
    """First byte and size of every stored member, from the archive's central directory."""
    size = file.size()
    tail = file.read_at(min(size, 22 + 65535), size - min(size, 22 + 65535))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    end = size - len(tail) + at
    if end >= 20 and (locator := file.read_at(20, end - 20))[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", locator, 8)
        record = file.read_at(56, end64)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, begin = struct.unpack_from("<QQQ", record, 32)
    central, members, p = file.read_at(length, begin), {}, 0
    for _ in range(count):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError("not a central directory entry")
        method, = struct.unpack_from("<H", central, p + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, p + 20)
        (local,) = struct.unpack_from("<I", central, p + 42)
        name = central[p + 46 : p + 46 + n_name].decode()
        extra = central[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # the 64-bit values of those fields that hold all ones, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + n
        if method == 0:
            n_local = struct.unpack("<HH", file.read_at(4, local + 26))
            members[name] = (local + 30 + sum(n_local), plain)
        p += 46 + n_name + n_extra + n_comment
    return members


def read_index(archives: DataFrame) -> DataFrame:
    """(uri, offset, length) in the archive file of every record of the archives (column uri)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                store, path = open_fs(uri)
                with store.open_input_file(path) as file:
                    members = directory(file)
                    data, (at, n) = members[DATA][0], members[INDEX]
                    rows = [json.loads(line) for line in file.read_at(n, at).splitlines()]
                yield pd.DataFrame([(uri, data + r["offset"], r["length"]) for r in rows], columns=["uri", "offset", "length"])

    prepare_workers(archives.sparkSession)
    return archives.select("uri").mapInPandas(run, "uri string, offset long, length long")


def read_records(index: DataFrame, with_payload: bool = True, parts: int | None = None) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type and refers_to of every record.

    ``parts`` tasks read (the index is small, so that its own size would ask for too few).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, file, out = None, None, []
        columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        size = 0
        for batch in batches:
            for path, offset, length in zip(batch["uri"], batch["offset"], batch["length"]):
                if path != uri:
                    store, local = open_fs(path)
                    uri, file = path, store.open_input_file(local)
                r = parse_record(zlib.decompress(file.read_at(length, offset), 31))
                fields, revisit = r["fields"], r["fields"]["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(r["payload"]).hexdigest()
                out.append((page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), r["payload"] if with_payload and not revisit else None, r["length"], digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))))
                size += r["length"]
                if size > BLOCK_BYTES:
                    yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                    out, size = [], 0
        yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    block = ("uri", (F.col("offset") / BLOCK_BYTES).cast("long"))
    dealt = (index.repartition(parts, *block) if parts else index.repartition(*block)).sortWithinPartitions("uri", "offset")
    return dealt.mapInPandas(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 100, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read their records back."""
    ws = Workspace(pages.sparkSession, "warc-zip")
    archives = ws.write(write(pages, ws.at("archives"), min_bytes), "list")
    total = archives.agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes")).first()
    index = read_index(archives.repartition(max(1, min(total["n"], 10_000)), "uri"))
    return read_records(index, with_payload, max(1, min((total["n_bytes"] or 0) // BLOCK_BYTES, 100_000)))
