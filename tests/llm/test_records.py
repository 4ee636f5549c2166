import numpy as np
import pytest

from tessera.llm import bpe, records
from tessera.llm.spill import fresh_path

from .helpers import docs, empty, odd


def slow_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    raw = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    start, size = np.array([0, 5, 100, 17, 0, 4999]), np.array([5000, 1, 300, 64, 0, 1])
    assert records.crc32c(raw, start, size).tolist() == [slow_crc(raw[a : a + b].tobytes()) for a, b in zip(start, size, strict=True)]
    assert records.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xE3069283


@pytest.mark.parametrize("width", [2, 4])
def test_frame_and_parse(width):
    data, length, _ = records.frame(np.array([7, -9]), np.array([1, 2, 50000]), np.array([3, 0]), width)
    whole = data.tobytes()
    first, second = whole[: length[0]], whole[length[0] :]
    assert records.parse(first, width)[0] == 7 and records.parse(first, width)[1].tolist() == [1, 2, 50000]
    assert records.parse(second, width)[0] == -9 and not len(records.parse(second, width)[1])
    for k in range(len(first)):
        broken = bytearray(first)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            records.parse(bytes(broken), width)
    with pytest.raises(ValueError):
        records.parse(first[:-1], width)


def test_round_trip_in_any_order(spark):
    texts = [f"text number {k} " * (k % 7) for k in range(200)]
    folder = fresh_path(spark, "records")
    index = records.write_records(docs(spark, texts).repartition(3), folder)
    assert index.count() == 200 and index.select("file").distinct().count() <= 3
    expected = {r.doc_id: r.token_ids for r in bpe.encode_and_check(docs(spark, texts)).collect()}
    orders = []
    for seed in (1, 2):
        rows = records.read_records(index, folder, seed).collect()
        assert {r.doc_id: r.token_ids for r in rows} == expected
        orders.append([r.doc_id for r in rows])
    assert orders[0] != orders[1]


def test_files_of_other_attempts_go(spark):
    folder = fresh_path(spark, "records")
    files, base = records.open_folder(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/lost.rec") as f:
        f.write(b"part of a task that was lost")
    index = records.write_records(docs(spark, ["a b c"]), folder)
    from pyarrow import fs

    left = {i.base_name for i in files.get_file_info(fs.FileSelector(base)) if i.extension == "rec"}
    assert left == {index.first().file}


def test_odd_tables(spark):
    folder = fresh_path(spark, "records")
    index = records.write_records(odd(spark), folder)
    assert sorted(r.doc_id for r in index.collect()) == [2, 3, 4, 5, 5, 6, 7]
    assert index.where("doc_id = 2").first().n_tokens == 0
    assert records.read_records(index, folder).count() == 7
    assert records.write_records(empty(spark), fresh_path(spark, "records")).count() == 0
