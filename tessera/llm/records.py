"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A record is: the payload's length (8 bytes), the masked CRC-32C of those 8 bytes (4), the
payload, and the payload's masked CRC-32C (4); all little-endian. The payload is the
document's id (8 bytes, signed) and its token ids, 2 bytes each where the vocabulary has at
most 65,536 ids, else 4. Each task writes one file; the index, a table beside the files,
has file, position and length of every record, so that readers may take records in any
order and check each one alone.

A task that runs again writes another file, and the index holds the names of the attempt
that counted; the files of other attempts are removed when the index is complete.

Defined results: rows with a null id or a null text have no record; an empty text has a
record without ids; rows that repeat an id have a record each; a text of any length is one
record; other columns are left out; an empty table gives an empty index and no file. A
record that was changed or cut raises ValueError when it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PASS, VOCABULARY, ragged, vocabulary
from .spill import fresh_path
from .textkit import passes

HEAD, TAIL = 12, 4
INDEX = "doc_id bigint, file string, position bigint, length bigint, n_tokens int, checksum bigint"
_BLOCK = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0x82F63B78), table >> np.uint32(1)).astype(np.uint32)
    return table


def _tables(images: np.ndarray) -> np.ndarray:
    """4 x 256 table of a linear map on 32 bits from the images of the single bits."""
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(values >> bit & 1, images[8 * k + bit], 0).astype(np.uint32)
    return out


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


_BYTE = _byte_table()
_PAIR = (_BYTE[np.arange(65536) & 255] >> np.uint32(8)) ^ _BYTE[(_BYTE[np.arange(65536) & 255] ^ (np.arange(65536) >> 8).astype(np.uint32)) & 255]
_ONE = np.uint32(1) << np.arange(32, dtype=np.uint32)
_SHIFT = [_tables(_BYTE[_ONE & 255] ^ (_ONE >> np.uint32(8)))]
while len(_SHIFT) < 48:
    _SHIFT.append(_tables(_apply(_SHIFT[-1], _apply(_SHIFT[-1], _ONE))))


def _shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The register after so many zero bytes."""
    crc, left, k = crc.copy(), zeros.astype(np.int64), 0
    while left.any():
        rows = np.flatnonzero(left & 1)
        crc[rows] = _apply(_SHIFT[k], crc[rows])
        left, k = left >> 1, k + 1
    return crc


def crc32c(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32C of byte ranges of `data`."""
    size = size.astype(np.int64)
    blocks = -(-size // _BLOCK)
    ends = np.cumsum(blocks)
    padded = np.zeros(int(ends[-1]) * _BLOCK if len(ends) else 0, np.uint8)
    padded[ragged(ends * _BLOCK - size, size)] = data[ragged(start, size)]
    words = np.ascontiguousarray(padded.view("<u2").reshape(-1, _BLOCK // 2).T).astype(np.uint32)
    crc = np.zeros(words.shape[1], np.uint32)
    for w in words:
        crc = _PAIR[(crc ^ w) & np.uint32(0xFFFF)] ^ (crc >> np.uint32(16))
    after = np.repeat(ends, blocks) - 1 - np.arange(len(crc))
    crc = _shifted(crc, after * _BLOCK)
    out = _shifted(np.full(len(size), 0xFFFFFFFF, np.uint32), size)
    some = np.flatnonzero(blocks)
    if len(some):
        out[some] ^= np.bitwise_xor.reduceat(crc, (ends - blocks)[some])
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(doc_id: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all records, length of each with its frame, masked checksum of each payload)."""
    n = len(doc_id)
    payload = 8 + sizes * width
    length = HEAD + payload + TAIL
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    heads = np.zeros((n, 20), np.uint8)
    heads[:, :8] = payload.astype("<u8").view(np.uint8).reshape(n, 8)
    heads[:, 8:12] = masked(crc32c(heads.ravel(), np.arange(n) * 20, np.full(n, 8))).astype("<u4").view(np.uint8).reshape(n, 4)
    heads[:, 12:] = doc_id.astype("<i8").view(np.uint8).reshape(n, 8)
    out[ragged(start, np.full(n, 20))] = heads.ravel()
    out[ragged(start + 20, sizes * width)] = ids.astype(f"<u{width}").view(np.uint8)
    check = masked(crc32c(out, start + HEAD, payload))
    out[ragged(start + length - TAIL, np.full(n, TAIL))] = check.astype("<u4").view(np.uint8)
    return out, length, check


def parse(data: bytes, width: int) -> tuple[int, np.ndarray]:
    """(document's id, token ids) of one record; ValueError if a checksum or length is wrong."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < HEAD + 8 + TAIL:
        raise ValueError("record is cut short")
    at = np.array([0])
    if masked(crc32c(raw, at, np.array([8])))[0] != raw[8:12].view("<u4")[0]:
        raise ValueError("the length's checksum is wrong")
    size = int(raw[:8].view("<u8")[0])
    if size != len(raw) - HEAD - TAIL:
        raise ValueError("record has another length")
    body = raw[HEAD : HEAD + size]
    if masked(crc32c(body, at, np.array([size])))[0] != raw[-TAIL:].copy().view("<u4")[0]:
        raise ValueError("the payload's checksum is wrong")
    return int(body[:8].copy().view("<i8")[0]), body[8:].copy().view(f"<u{width}").astype(np.int32)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def id_width(path: str) -> int:
    return 2 if len(vocabulary(path).tokens) <= 1 << 16 else 4


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Writes a record for each document to `folder`, and returns the index, which is written there too."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, width = vocabulary(path), id_width(path)
        files, base = open_folder(folder)
        name, sink, at = f"{uuid.uuid4().hex}.rec", None, 0
        for batch in batches:
            where = 0
            for texts in passes(batch.column(1), PASS):
                doc_id = batch.column(0).slice(where, len(texts)).to_numpy()
                where += len(texts)
                if sink is None:
                    files.create_dir(base, recursive=True)
                    sink = files.open_output_stream(f"{base}/{name}")
                ids, sizes = v.encode(texts)
                data, length, check = frame(doc_id, ids, sizes, width)
                sink.write(data)
                position = at + np.cumsum(length) - length
                at += int(length.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id), pa.array([name] * len(doc_id), pa.string()), pa.array(position), pa.array(length), pa.array(sizes, pa.int32()), pa.array(check, pa.int64())],
                    ["doc_id", "file", "position", "length", "n_tokens", "checksum"],
                )
        if sink is not None:
            sink.close()

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null and text is not null")
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    keep = {r.file for r in index.select("file").distinct().collect()}  # a name for each task
    files, base = open_folder(folder)
    for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.extension == "rec" and info.base_name not in keep:
            files.delete_file(info.path)
    return index


def read_records(index: DataFrame, folder: str, seed: int = 0, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids) of the index's records, in an order given by the seed; every checksum is tested."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        width = id_width(path)
        held: dict[str, pa.NativeFile] = {}
        for batch in batches:
            out = []
            for name, position, length in zip(*(batch.column(c).to_pylist() for c in ("file", "position", "length")), strict=True):
                if name not in held:
                    if len(held) >= 64:
                        held.pop(next(iter(held))).close()
                    held[name] = files.open_input_file(f"{base}/{name}")
                out.append(parse(held[name].read_at(length, position), width))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    order = F.xxhash64("file", "position", F.lit(seed))
    shuffled = index.select("file", "position", "length", order.alias("o")).repartition("o").sortWithinPartitions("o", "file", "position")
    return shuffled.drop("o").mapInArrow(read, "doc_id bigint, token_ids array<int>")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_records(docs, fresh_path(spark, "records"))


QUERIES = {"op2_token_records": op2_token_records}
ORACLE_SQL: dict[str, str] = {}
