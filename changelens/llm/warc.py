"""WARC (2): deterministic sharded writer, and a reader for its archives.

Records are range-sorted by id; each range's task rolls a new file when the
compressed size passes ``roll_bytes``.  Headers and digests are made anew from
the payload, with a fixed date and name-based record ids, so the same rows
give the same bytes.  A task writes under temporary names with its attempt
number; only names in the manifest of finished tasks are renamed, and readers
read only what the committed manifest names, so tasks lost or run twice leave
nothing behind that counts.

Of records with equal payloads of at least ``revisit_bytes``, the one with the
largest id is the response and the others are revisits of it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, filesystem, partitions, scratch

_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


def _record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}')}>"


def record(key, url: str | None, payload: bytes, refers_to, date: str, revisit: bool) -> bytes:
    """One gzip member holding one record; ``key`` may be None."""
    digest = hashlib.sha1(payload).hexdigest()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
             "\r\n\r\n").encode()
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_record_id(key, digest)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {re.sub(r'[\x00-\x20]+', '%20', url or 'about:blank')}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if key is not None:
        lines.append(f"X-Page-ID: {key}")
    if revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _members(stream):
    """The unpacked gzip members of a file, one after the other."""
    data = stream.read(_READ)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data:
                raise ValueError("archive ends within a record")
            parts.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else stream.read(_READ)
        yield b"".join(parts)
        data = data or stream.read(_READ)


def parse(raw: bytes) -> dict:
    """Headers and payload of a record; its digests are checked."""
    head, _, rest = raw.partition(_CRLF * 2)
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    if f"sha1:{hashlib.sha1(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"broken record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(_CRLF * 2)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"broken payload {headers['WARC-Record-ID']}")
    return {"headers": headers, "payload": payload, "payload_bytes": size, "payload_digest": digest}


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               revisit_bytes: int = 1000, roll_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z",
               prefix: str = "pages") -> DataFrame:
    """Write all rows below ``folder`` and return the committed manifest:
    ``path``, ``records``, ``bytes``, ``sha1``.

    Defined cases: a null payload is empty; rows with a null id sort last and
    their records carry no page id; of repeated rows that are the largest id of
    their payload the first is the response and the others revisit it; null
    URLs become ``about:blank``; an empty table gives an empty manifest."""
    n = partitions(df.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("same"),
                     F.octet_length(payload).alias("size"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keys = rows.where(F.col("size") >= revisit_bytes).select("id", "same")
    largest = keys.groupBy("same").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # (id, payload) of rows that aren't the largest of their payload: small rows that meet
    # their page in the same range, so pages are shuffled once
    notes = (keys.join(largest, "same").where(~F.col("id").eqNullSafe(F.col("refers_to")))
             .select("id", "same", "refers_to").distinct())
    both = (rows.select("id", "same", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"),
                        (F.col("size") >= revisit_bytes).alias("long"))
            .unionByName(notes.select("id", "same", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                                      F.lit(None).cast("string").alias("html"), "refers_to", F.lit(True).alias("long"))))
    order = [F.col("id").asc_nulls_last(), F.col("same").asc()]

    def write(batches):
        context = TaskContext.get()
        out, names, done, note, before = None, None, [], None, None

        def close():
            nonlocal out
            out.close()
            done.append({"temporary": names[0], "path": names[1], "records": state["records"],
                         "bytes": state["bytes"], "sha1": state["sha1"].hexdigest()})
            out = None

        state: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["id"], r["same"])
                if not r["kind"]:
                    note = (key, r["refers_to"])
                    continue
                revisit, refers_to = False, None
                if note and note[0] == key:
                    revisit, refers_to = True, note[1]
                elif r["long"] and before == key:  # a repeated row of the response
                    revisit, refers_to = True, r["id"]
                before = key
                data = record(r["id"], r["url"], r["html"].encode(), refers_to, date, revisit)
                if out is None:
                    name = f"{prefix}-{context.partitionId():05d}-{len(done):05d}"
                    names = (f"{folder}/.{name}.{context.taskAttemptId()}.tmp", f"{folder}/{name}.warc.gz")
                    fs, plain = filesystem(names[0])
                    fs.create_dir(plain.rpartition("/")[0], recursive=True)
                    out, state = fs.open_output_stream(plain, compression=None), {
                        "records": 0, "bytes": 0, "sha1": hashlib.sha1()}
                out.write(data)
                state["records"] += 1
                state["bytes"] += len(data)
                state["sha1"].update(data)
                if state["bytes"] >= roll_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    files = "temporary string, path string, records long, bytes long, sha1 string"
    written = cut((both.repartitionByRange(n, *order).sortWithinPartitions(*order, "kind").mapInArrow(write, files)),
                  "warc-written")
    return cut(written.mapInArrow(_commit, files.removeprefix("temporary string, ")), "warc-manifest")


def _commit(batches):
    """Rename finished files; a rename that another attempt has made is fine."""
    for batch in batches:
        for r in batch.to_pylist():
            fs, old = filesystem(r["temporary"])
            _, new = filesystem(r["path"])
            if fs.get_file_info(old).type != pafs.FileType.NotFound:
                fs.move(old, new)
            if fs.get_file_info(new).size != r["bytes"]:
                raise OSError(f"{new} is not the file that was written")
        yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the manifest's files: ``page_id``, ``url``,
    ``payload_bytes``, ``payload_digest`` (bare hex SHA-1), ``record_type``,
    ``refers_to``, ``path`` and, if asked for, ``payload`` (null for revisits)."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("path", pa.string())] + ([("payload", pa.binary())] if with_payload else [])
    schema = pa.schema(fields)

    def read(batches):
        def number(x):
            return int(x) if x is not None else None
        for batch in batches:
            for f in batch.to_pylist():
                fs, plain = filesystem(f["path"])
                rows, size = [], 0
                with fs.open_input_stream(plain, compression=None) as stream:
                    for raw in _members(stream):
                        r = parse(raw)
                        h = r["headers"]
                        rows.append({"page_id": number(h.get("X-Page-ID")), "url": h["WARC-Target-URI"],
                                     "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"],
                                     "record_type": h["WARC-Type"],
                                     "refers_to": number(h.get("X-Refers-To-Page-ID")), "path": f["path"],
                                     "payload": r["payload"] if h["WARC-Type"] == "response" else None})
                        size += len(raw) if with_payload else 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
    types = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return (manifest.repartition(partitions(manifest.sparkSession))
            .mapInArrow(read, ", ".join(f"{k} {types[v]}" for k, v in fields)))


def write_and_read(df: DataFrame, **params) -> DataFrame:
    return read_warc(write_warc(df, scratch(df.sparkSession, "warc"), **params))
