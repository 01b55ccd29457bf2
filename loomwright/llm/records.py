"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record: length of the data (8 bytes), masked checksum of those bytes (4), the data, masked checksum of the data (4),
all little-endian; the checksum is CRC-32, rotated right by 15 bits and shifted by a constant. The data: whether the id
is known (1 byte), doc_id (8), then the ids as 16-bit numbers where the vocabulary fits, else 32-bit. Beside each file
stands its index: offset of the record and number of ids (8 bytes each) for every record.

Files hold ranges of doc_id in ascending order (NULL first, then by text where ids are equal). A task names its files
anew at each attempt, and the manifest lists those of the attempts that counted.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.bpe import portions, shared_words
from loomwright.llm.files import attempt_name, fresh_path, open_in, open_out, spread
from loomwright.plans.store import cut

#: The mask of checksums (fixed value).
MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
MANIFEST = "part int, path string, kind string, n_records bigint, n_ids bigint, bytes bigint"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked_crc(size)), data, struct.pack("<I", masked_crc(data))))


def read_frame(stream, path: str) -> bytes | None:
    """The next record's data, or None at the end; a damaged record raises."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError(f"{path}: a record breaks off in its head")
    size, crc = _HEAD.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError(f"{path}: wrong checksum of a length")
    body = stream.read(size + 4)
    if len(body) < size + 4:
        raise ValueError(f"{path}: a record breaks off in its data")
    data = bytes(body[:size])
    if masked_crc(data) != struct.unpack("<I", body[size:])[0]:
        raise ValueError(f"{path}: wrong checksum of data")
    return data


def write(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", base: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write the record files; returns the manifest."""
    base = base or fresh_path(docs.sparkSession, "records")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    ordered = raw.repartitionByRange("doc_id", F.xxhash64("body")).sortWithinPartitions("doc_id", "body")

    def run(batches):
        out = index = None
        count = n_ids = at = 0
        for batch in batches:
            if out is None:
                words = shared_words(tokenizer_path)
                wide = words.words.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 or end_id >= 1 << 16
                kind = "<u4" if wide else "<u2"
                path = attempt_name(base, TaskContext.get().partitionId(), ".rec")
                out, index = open_out(path), open_out(path + ".idx")
                end = np.array([end_id], kind).tobytes()
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for first, n in portions(pc.binary_length(texts).to_pylist()):
                ids, edges = words.ids(texts.slice(first, n))
                ids = ids.astype(kind)
                heads, parts = [], []
                for name, i, j in zip(names[first:first + n], edges[:-1].tolist(), edges[1:].tolist()):
                    record = frame(struct.pack("<?q", name is not None, name or 0) + ids[i:j].tobytes() + end)
                    heads.append((at, j - i + 1))
                    parts.append(record)
                    at += len(record)
                    n_ids += j - i + 1
                count += n
                out.write(b"".join(parts))
                index.write(np.array(heads, "<i8").tobytes())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "kind": [kind],
                "n_records": [count], "n_ids": [n_ids], "bytes": [at]})

    return cut(ordered.mapInArrow(run, MANIFEST))


ROWS = "doc_id bigint, part int, position bigint, start bigint, ids binary"


def read(manifest: DataFrame) -> DataFrame:
    """All records of the files: (doc_id, part, position, start, ids), ids as 32-bit numbers.

    ``start`` counts the ids of all records before, over all files (the sums run over one manifest row a file).
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        for batch in batches:
            for part, path, kind, n_records, n_ids, size, earlier in zip(*[c.to_pylist() for c in batch.columns]):
                with open_in(path + ".idx") as s:
                    index = np.frombuffer(s.read(), "<i8").reshape(-1, 2)
                if len(index) != n_records or int(index[:, 1].sum()) != n_ids:
                    raise ValueError(f"{path}: the index does not fit the manifest")
                starts = np.concatenate([[0], np.cumsum(index[:, 1])])
                with open_in(path) as raw:
                    rows, held, at = [], 0, 0
                    for k in range(n_records):
                        if at != index[k, 0]:
                            raise ValueError(f"{path}: record {k} is not where the index says")
                        data = read_frame(raw, path)
                        if data is None:
                            raise ValueError(f"{path}: fewer records than the manifest says")
                        at += len(data) + 16
                        known, name = struct.unpack_from("<?q", data)
                        ids = np.frombuffer(data, kind, offset=9).astype("<u4")
                        if len(ids) != index[k, 1]:
                            raise ValueError(f"{path}: record {k} has another length than the index says")
                        rows.append((name if known else None, part, k, earlier + int(starts[k]), ids.tobytes()))
                        held += len(data)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if raw.read(1):
                        raise ValueError(f"{path}: more records than the manifest says")
                    if rows:
                        yield _batch(rows)

    return spread(files, manifest.count()).mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.binary())],
        ["doc_id", "part", "position", "start", "ids"])


def fetch(path: str, positions: list[int], kind: str = "<u2") -> list[np.ndarray]:
    """Records of one file in any order, by the index: for shuffled reads. Only the records asked for are read."""
    with open_in(path + ".idx") as s:
        index = np.frombuffer(s.read(), "<i8").reshape(-1, 2)
    out = []
    with open_in(path, seekable=True) as s:
        for k in positions:
            s.seek(int(index[k, 0]))
            out.append(np.frombuffer(read_frame(s, path), kind, offset=9))
    return out
