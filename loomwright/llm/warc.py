"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Payload digests are SHA-1. Of the records with equal payloads of at least ``REVISIT_AT_LEAST`` bytes, the one with the
largest page_id is a response and the others are revisits that refer to it; rows that share this largest id are all
responses, and NULL counts as smaller than any id. NULL pages have an empty payload. Archives are written by tasks under
names of their own; the manifest lists those of the attempts that counted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.files import attempt_name, fresh_path, open_in, open_out, spread
from loomwright.llm.sampling import about
from loomwright.llm.words import slices
from loomwright.plans.store import cut

REVISIT_AT_LEAST = 1000
#: Pages that the dictionary is trained on, about so many by a hash of their ids; bytes of each, and of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 512, 16 << 10, 32 << 10
#: Format constants (fixed values).
SKIPPABLE = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "path string, n_records bigint, bytes bigint"


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is set for revisits only."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"))
    same = rows.filter(F.octet_length("payload") >= REVISIT_AT_LEAST).groupBy(F.col("payload_digest").alias("__digest"))
    first = cut(same.agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = rows.join(first, F.col("payload_digest") == F.col("__digest"), "left")
    other = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(other, F.col("__first")).alias("refers_to"))


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty where they are too few for one."""
    chosen = about(pages.filter("html is not null"), SAMPLE_PAGES, "page_id").select(F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    samples = sorted(r["html"].encode() for r in chosen.collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def _lines(first: str, pairs: list[tuple[str, str]]) -> bytes:
    clean = [f"{k}: {v}".replace("\r", " ").replace("\n", " ") for k, v in pairs]
    return ("\r\n".join([first, *clean]) + "\r\n\r\n").encode()


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One whole record. A revisit keeps the response's head but not its payload."""
    http = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block)))]
    head += [("WARC-Target-URI", url)] if url is not None else []
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _lines("WARC/1.1", head) + block + b"\r\n\r\n"


def _fields(raw: bytes, what: str) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode().split("\r\n")
    out = {}
    for line in rest:
        name, colon, value = line.partition(": ")
        if not colon or not name or name.lower() in out:
            raise ValueError(f"{what}: bad header line {line[:80]!r}")
        out[name.lower()] = value
    return first, out


def parse(record: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of one record, all checked."""
    end = record.find(b"\r\n\r\n")
    version, head = _fields(record[:end], "record") if end >= 0 else ("", {})
    if version != "WARC/1.1":
        raise ValueError(f"no WARC/1.1 record: {record[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in head:
            raise ValueError(f"a record has no {name}")
    size = int(head["content-length"])
    block, tail = record[end + 4:end + 4 + size], record[end + 4 + size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError(f"{head['warc-record-id']}: its length is not what its header says")
    stop = block.find(b"\r\n\r\n")
    status, http = _fields(block[:stop], "HTTP head") if stop >= 0 else ("", {})
    if not status.startswith("HTTP/1.1 ") or "content-length" not in http:
        raise ValueError(f"{head['warc-record-id']}: no HTTP head")
    length, payload = int(http["content-length"]), block[stop + 4:]
    name, _, coded = head["warc-payload-digest"].partition(":")
    digest = base64.b32decode(coded).hex() if name == "sha1" else ""
    kind = head["warc-type"]
    if kind == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{head['warc-record-id']}: the payload does not fit its length or digest")
    elif kind != "revisit" or payload or head.get("warc-profile") != PROFILE or "warc-refers-to" not in head:
        raise ValueError(f"{head['warc-record-id']}: neither a response nor a revisit")
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return (None if page is None else int(page), head.get("warc-target-uri"), length, digest, kind, None if refers is None else int(refers), payload)


def write(pages: DataFrame, base: str | None = None, level: int = 3) -> DataFrame:
    """Write one archive a task; returns the manifest."""
    dictionary = train(pages)
    base = base or fresh_path(pages.sparkSession, "warc")

    def run(batches):
        out, count, size = None, 0, 0
        for batch in slices(batches, 256):
            if out is None:
                path = attempt_name(base, TaskContext.get().partitionId(), ".warc.zst")
                out = open_out(path)
                frame = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
                out.write(frame)
                size += len(frame)
                known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                frame = packer.compress(build(*row))
                out.write(frame)
                count, size = count + 1, size + len(frame)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "bytes": [size]})

    return cut(roles(pages).mapInArrow(run, MANIFEST))


def frames(stream, path: str, step: int = 1 << 20):
    """Records of an archive one by one: the dictionary first, then each frame decoded as the bytes come in."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    raw = bytes(stream.read(size)) if magic == SKIPPABLE else b""
    if magic != SKIPPABLE or len(raw) != size:
        raise ValueError(f"{path}: no dictionary in front")
    if raw and raw[:4] != DICT_MAGIC:
        raise ValueError(f"{path}: the leading frame holds no dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    held = bytes(stream.read(step))
    while held:
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            held = bytes(stream.read(step))
            if not held:
                raise ValueError(f"{path}: a frame breaks off")
        yield b"".join(parts)
        held = held or bytes(stream.read(step))


ROWS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """All records of the archives; with ``payload`` also the payload itself (empty for revisits)."""
    schema = ROWS + (", payload binary" if payload else "")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        for batch in batches:
            for path, n_records, _ in zip(*[c.to_pylist() for c in batch.columns]):
                rows, held, count = [], 0, 0
                with open_in(path) as stream:
                    for record in frames(stream, path):
                        rows.append(parse(record)[:len(names)])
                        count += 1
                        held += len(record)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if count != n_records:
                    raise ValueError(f"{path}: {count} records, the manifest says {n_records}")
                if rows:
                    yield batch_of(rows)

    return spread(manifest, manifest.count()).mapInArrow(run, schema)
