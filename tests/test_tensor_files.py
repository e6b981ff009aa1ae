import json
import random

import numpy as np
import pytest

from loomscan import queries
from loomscan.functions.dtypes import DTYPES, eight_bit_floats
from loomscan.operators import scan
from loomscan.operators.iterate import ChunkStreamer, FileChunks, TensorStreamer, as_array
from loomscan.sources.decode import decode
from loomscan.sources.files import TensorFileError, list_tensor_files, read_range
from loomscan.sources.headers import make_header, parse_header, read_header

ERRORS = {
    "bad_dtype": "Unsupported dtype", "bad_json": "not valid JSON", "bad_utf8": "not valid UTF-8", "empty_file": "truncated or empty", "first_not_zero": "gap", "holes": "gap",
    "mismatch": "Shape claims 40 bytes, but offsets reserve 4", "no_offsets": "missing data_offsets", "overlap": "overlaps with next tensor", "too_large": "exceeds limit", "truncated_header": "End of file",
}
FINE = {"duplicate_keys": 1, "empty_header": 0, "only_metadata": 0, "trailing_bytes": 1, "truncated_body": 1, "unsorted": 2}


@pytest.fixture()
def corrupt(tmp_path):
    for name, data in queries.corrupt_files().items():
        (tmp_path / f"{name}.safetensors").write_bytes(data)
    return tmp_path


def test_corrupt_headers(spark, corrupt):
    for name, part in ERRORS.items():
        with pytest.raises(TensorFileError, match=part):
            read_header(str(corrupt / f"{name}.safetensors"))
        with pytest.raises(Exception, match=part.split(",")[0]):
            scan.tensor_catalog(spark, str(corrupt / f"{name}.safetensors")).collect()
    for name, n in FINE.items():
        assert len(read_header(str(corrupt / f"{name}.safetensors"))) == n
    rows = {r["file"]: r for r in queries.validate_corrupt_files(spark, "").collect()}
    assert {k for k, r in rows.items() if r["problem"]} == ERRORS.keys() and all(rows[k]["n_tensors"] == n for k, n in FINE.items())


def test_truncated_body_fails_while_reading(spark, corrupt):
    rows = scan.tensors(spark, str(corrupt / "truncated_body.safetensors"))
    with pytest.raises(Exception, match="End of file"):
        rows.collect()


def test_unsorted_header(spark, corrupt):
    rows = scan.tensors(spark, str(corrupt / "unsorted.safetensors")).collect()
    assert {r["name"]: bytes(r["data"]) for r in rows} == {"First": b"\x01" * 10, "Second": b"\x02" * 10}


def random_file(rng, path):
    entries, blobs = [], []
    for i in range(rng.randint(1, 20)):
        dtype = rng.choice(list(DTYPES))
        shape = [rng.randint(0 if rng.random() < 0.1 else 1, 6) for _ in range(rng.randint(0, 4))]
        data = rng.randbytes(int(np.prod(shape, dtype=int)) * DTYPES[dtype].width)
        entries.append((f"tensor_{i}", dtype, shape, len(data)))
        blobs.append(data)
    path.write_bytes(make_header(entries) + b"".join(blobs))
    return {(path.name, e[0]): (e[1], e[2], b) for e, b in zip(entries, blobs, strict=True)}


def test_random_files_bit_for_bit(spark, tmp_path):
    rng, want = random.Random(8), {}
    for i in range(6):
        want |= random_file(rng, tmp_path / f"model-{i:05d}-of-00006.safetensors")
    for limit in ("700", "100000000"):
        rows = scan.tensors(spark, str(tmp_path), partition_bytes=limit)
        got = {(r["path"].rsplit("/", 1)[1], r["name"]): (r["dtype"], r["shape"], bytes(r["data"])) for r in rows.collect()}
        assert got == want
    assert scan.tensors(spark, str(tmp_path), partition_bytes="700").rdd.getNumPartitions() > 6
    catalog = scan.tensor_catalog(spark, str(tmp_path)).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["name"]) for r in catalog} == want.keys()
    with TensorStreamer(spark) as s:
        s.stream_files(list_tensor_files(str(tmp_path)))
        assert sum(1 for _ in s.get_tensors()) == len(want)


def test_name_filter_reaches_the_reader(spark, tmp_path):
    entries = [("a", "U8", [4], 4), ("b", "U8", [1000], 1000)]
    path = tmp_path / "cut.safetensors"
    path.write_bytes(make_header(entries) + b"abcd")  # b isn't there
    rows = scan.tensors(spark, str(path)).filter("name = 'a'").collect()
    assert [bytes(r["data"]) for r in rows] == [b"abcd"]


def test_decoders():
    e4, e5, e8 = eight_bit_floats(4, 3), eight_bit_floats(5, 2), eight_bit_floats(8, 0)
    assert (e4[0x7E], e4[0x38], e4[0x01], e4[0x88]) == (448.0, 1.0, 2.0**-9, -(2.0**-6)) and np.isnan(e4[[0x7F, 0xFF]]).all()
    assert (e5[0x7B], e5[0x3C], e5[0x01], e5[0x7C], e5[0xFC]) == (57344.0, 1.0, 2.0**-16, np.inf, -np.inf) and np.isnan(e5[[0x7D, 0xFF]]).all()
    assert (e8[127], e8[0], e8[254]) == (1.0, np.float32(2.0**-127), np.float32(2.0**127)) and np.isnan(e8[255])
    assert DTYPES["BF16"].decode(b"\x80\x3f\xc0\xff")[0] == 1.0 and np.isnan(DTYPES["BF16"].decode(b"\xc0\xff")[0])
    assert DTYPES["U64"].decode(b"\xff" * 8)[0] == 2**64 - 1
    assert as_array(bytes(range(8)), "U16", [2, 2]).tolist() == [[256, 770], [1284, 1798]]


def test_typed_values(spark):
    folder = queries.typed_file(spark)
    rows = scan.tensors(spark, folder).cache()
    for x in DTYPES.values():
        if x.decode is None:
            with pytest.raises(ValueError):
                decode(rows, x.name)
            continue
        got = {r["name"]: r["values"] for r in decode(rows, x.name).collect()}
        raw = {r["name"]: bytes(r["data"]) for r in rows.filter(f"dtype = '{x.name}'").collect()}
        assert got[f"none_{x.name}"] == [] and len(got[f"scalar_{x.name}"]) == 1
        want = x.decode(raw[f"full_{x.name}"])
        ours = [r.asDict() if x.name == "C64" else r for r in got[f"full_{x.name}"]]
        assert repr(ours) == repr(want)
    zero = queries.zero_size_tensors(spark, "").collect()
    assert all((r["n_elements"], r["n_bytes"] == 0) in ((0, True), (1, False)) for r in zero)


def test_text_chunks(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"XTest Text1TestText2Test-Text3\n")
    b.write_bytes(b"YTest Text44TestText")
    with ChunkStreamer(spark) as s:
        s.stream_files([FileChunks(17, str(a), 1, [10, 0, 9, 10]), FileChunks(18, str(b), 1, [11, 8])])
        got = {(i, j): d for i, j, d in s.get_chunks()}
    assert got == {(17, 0): b"Test Text1", (17, 1): b"", (17, 2): b"TestText2", (17, 3): b"Test-Text3", (18, 0): b"Test Text44", (18, 1): b"TestText"}
    options = {"manifest": json.dumps([[1, str(a), 1, [10, 9]]])}
    rows = spark.read.format("bytechunks").options(**options).load().collect()
    assert [bytes(r["data"]) for r in rows] == [b"Test Text1", b"TestText2"]
    with ChunkStreamer(spark) as s:
        s.stream_files([])
        assert list(s.get_chunks()) == []


def test_read_errors(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"12345")
    for offset, size in ((3, 3), (9, 1)):
        with pytest.raises(TensorFileError, match="End of file"):
            read_range(str(path), offset, size)
    with pytest.raises(TensorFileError, match="access"):
        read_range(str(tmp_path / "no"), 0, 1)
    mixed = spark.createDataFrame([(0, "s3://b/k", 0, 0, 1), (1, "/x", 0, 0, 1)], "file_id bigint, path string, chunk_idx int, offset bigint, size bigint")
    with pytest.raises(ValueError, match="several kinds"):
        scan.read_chunks(mixed)


def test_header_rules():
    assert parse_header(b"{}") == []
    with pytest.raises(TensorFileError, match="no object"):
        parse_header(b"[]")


def test_new_files_arrive_as_a_stream(spark, tmp_path):
    from loomscan.streaming.watch import watch_catalog

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.safetensors").write_bytes(make_header([("a", "U8", [2], 2)]) + b"xy")
    query = watch_catalog(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        (folder / "b.safetensors").write_bytes(make_header([("b", "U8", [1], 1), ("c", "U8", [1], 1)]) + b"zw")
        query.processAllAvailable()
        assert [r["name"] for r in spark.sql("select name from arrived order by name").collect()] == ["a", "b", "c"]
    finally:
        query.stop()
