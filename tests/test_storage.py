"""Object stores: settings, listings, globs, scans and copies, against pyarrow with local folders behind its file systems."""

import pyarrow as pa
import pytest
from pyarrow import fs

from loomscan.operators import scan
from loomscan.sources import storage
from loomscan.sources.files import OpenFile, TensorFileError, file_system, glob_files, list_tensor_files, listing, parts_of, read_blocks, read_range
from loomscan.sources.headers import make_header, read_header
from loomscan.sources.materialize import Materialized, pull_files
from loomscan.sources.options import Options
from loomscan.sources.storage import StorageError, az_arguments, gs_arguments, s3_arguments, settings
from loomscan.sources.tensorfile import TensorReader, expand

ENDPOINT = {"s3": "S3FileSystem", "gs": "GcsFileSystem", "az": "AzureFileSystem"}


@pytest.fixture(params=["s3", "gs", "az"])
def served(request, tmp_path, monkeypatch):
    """A scheme whose file system keeps its buckets in a folder; what it was opened with is kept."""
    calls = []

    def made(**arguments):
        calls.append(arguments)
        return fs.SubTreeFileSystem(str(tmp_path / "store"), fs.LocalFileSystem())

    monkeypatch.setattr(fs, ENDPOINT[request.param], made)
    monkeypatch.setenv("AZURE_STORAGE_ACCOUNT_NAME", "someone")
    storage._opened.cache_clear()
    bucket = tmp_path / "store/bucket"
    (bucket / "nested/deep").mkdir(parents=True)
    for name in ("a.safetensors", "b.safetensors", "nested/c.safetensors", "nested/deep/d.safetensors", "nested/config.json"):
        (bucket / name).write_bytes(make_header([(name, "U8", [3], 3)]) + b"xyz")
    yield request.param, calls, tmp_path
    storage._opened.cache_clear()


def test_a_store_is_listed_read_and_copied(served):
    scheme, calls, tmp = served
    root = f"{scheme}://bucket"
    assert list_tensor_files(root) == [f"{root}/a.safetensors", f"{root}/b.safetensors"]
    assert [f.path for f in listing(f"{root}/nested", recursive=True, ignore=["*.json"])] == [f"{root}/nested/c.safetensors", f"{root}/nested/deep/d.safetensors"]
    assert [t.name for t in read_header(f"{root}/nested/c.safetensors")] == ["nested/c.safetensors"]
    size = (tmp / "store/bucket/a.safetensors").stat().st_size
    assert read_range(f"{root}/a.safetensors", size - 3, 3) == b"xyz"
    assert pull_files(root, str(tmp / "to"), allow=["*.safetensors"]) == 4 and (tmp / "to/nested/deep/d.safetensors").exists()
    with Materialized(root, str(tmp / "model")) as m:
        assert m.pull() == 5
    assert len(calls) == 1  # one file system for one set of settings


def test_globs_on_stores_and_disks(served):
    scheme, _, tmp = served
    for root in (f"{scheme}://bucket", str(tmp / "store/bucket")):
        names = lambda pattern: [f.path.removeprefix(root + "/") for f in glob_files(f"{root}/{pattern}")]  # noqa: B023, E731
        assert names("*.safetensors") == ["a.safetensors", "b.safetensors"]
        assert names("[b-z].safe*") == ["b.safetensors"]
        assert names("nested/*") == ["nested/c.safetensors", "nested/config.json"]
        assert names("*/?.safetensors") == ["nested/c.safetensors"]
        assert names("**/*.safetensors") == ["a.safetensors", "b.safetensors", "nested/c.safetensors", "nested/deep/d.safetensors"]
        assert names("*.none") == []
        assert [f.path for f in expand([f"{root}/nested/*.safetensors", f"{root}/a.safetensors"])] == [f"{root}/nested/c.safetensors", f"{root}/a.safetensors"]
        assert all(f.size > 3 for f in expand([root]))


def test_a_glob_is_scanned(spark, served):
    _, _, tmp = served
    rows = scan.tensors(spark, str(tmp / "store/bucket/**/*.safetensors")).collect()
    assert sorted(r["name"] for r in rows) == ["a.safetensors", "b.safetensors", "nested/c.safetensors", "nested/deep/d.safetensors"]
    assert {bytes(r["data"]) for r in rows} == {b"xyz"}


def test_s3_arguments():
    found = {"access_key": "k", "secret_key": "s", "session_token": "t", "region": "eu-west-1", "endpoint": "http://host:9000", "ca_file": "/ca.pem", "request_timeout": "2.5", "connect_timeout": "1", "max_attempts": "7"}
    got = s3_arguments(found)
    assert got.pop("retry_strategy").max_attempts == 7
    assert got == {"access_key": "k", "secret_key": "s", "session_token": "t", "region": "eu-west-1", "endpoint_override": "host:9000", "scheme": "http", "force_virtual_addressing": False, "tls_ca_file_path": "/ca.pem", "request_timeout": 2.5, "connect_timeout": 1.0}
    assert s3_arguments({"endpoint": "https://host", "virtual_addressing": "true"})["force_virtual_addressing"]
    assert s3_arguments({"anonymous": "true", "region": "r", "access_key": "k", "secret_key": "s"}) == {"anonymous": True, "region": "r"}
    for bad in ({"access_key": "k"}, {"anonymous": "maybe"}, {"request_timeout": "-1"}, {"max_attempts": "x"}):
        with pytest.raises(StorageError):
            s3_arguments(bad)
    assert fs.S3FileSystem(**s3_arguments(found)).region == "eu-west-1"


def test_gs_and_az_arguments(monkeypatch):
    assert gs_arguments({"anonymous": "1", "endpoint": "http://h:1", "project": "p"}) == {"anonymous": True, "endpoint_override": "h:1", "scheme": "http", "project_id": "p"}
    assert gs_arguments({"access_token": "t"})["access_token"] == "t" and gs_arguments({"retry_seconds": "9"})["retry_time_limit"].total_seconds() == 9
    monkeypatch.setenv("GOOGLE_APPLICATION_CREDENTIALS", "")
    assert gs_arguments({"credential_file": "/c.json"}) == {}
    whole = "DefaultEndpointsProtocol=http;AccountName=me;AccountKey=a2V5PT0=;BlobEndpoint=http://127.0.0.1:10000/me"
    assert az_arguments({"connection_string": whole}) == {"account_name": "me", "account_key": "a2V5PT0=", "blob_storage_authority": "127.0.0.1:10000/me", "dfs_storage_authority": "127.0.0.1:10000/me", "blob_storage_scheme": "http", "dfs_storage_scheme": "http"}
    assert az_arguments({"connection_string": whole, "account_name": "you"})["account_name"] == "you"
    assert az_arguments({"account_name": "me", "sas_token": "s"}) == {"account_name": "me", "sas_token": "s"}
    with pytest.raises(StorageError):
        az_arguments({})


def test_settings_come_from_options_then_the_environment():
    environment = {"AWS_ENDPOINT_URL": "http://usual", "LOOMSCAN_S3_REGION": "own", "AWS_REGION": "usual", "AWS_CA_BUNDLE": "/ca", "AZURE_STORAGE_ACCOUNT_NAME": "me"}
    assert settings("s3", None, environment) == {"endpoint": "http://usual", "region": "own", "ca_file": "/ca"}
    assert settings("s3", {"s3.region": "given", "az.account_name": "x"}, environment)["region"] == "given"
    assert settings("az", None, environment) == {"account_name": "me"}
    for bad in ("s3.colour", "ftp.host", "region"):
        with pytest.raises(StorageError):
            settings("s3", {bad: "x"}, {})


def test_settings_reach_the_tasks(served):
    scheme, calls, _ = served
    given = {"s3": {"s3.region": "r"}, "gs": {"gs.project": "r"}, "az": {"az.sas_token": "r"}}[scheme]
    import json

    reader = TensorReader({"path": f"{scheme}://bucket/", "store": json.dumps(given)}, True)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["data"] for r in rows] == [b"xyz"] * 2 and "r" in calls[0].values()


def test_azure_opens():
    given = {"az.account_name": "someone", "az.account_key": "a2V5PT0="}
    system, path = file_system("az://container/key", None, given)
    assert isinstance(system, fs.AzureFileSystem) and path == "container/key"


def test_blocks_read_side_by_side(tmp_path, monkeypatch):
    data = bytes(range(256)) * 4096
    path = tmp_path / "f"
    path.write_bytes(data)
    blocks = [(i * 1000, n) for i, n in enumerate([5, 0, 90000, 1, 700000, 3])]
    for options in (Options(concurrency=1), Options(concurrency=4), Options(concurrency=4, memory_limit=0), Options(concurrency=3, memory_limit=100)):
        assert [x.to_pybytes() for x in read_blocks(str(path), blocks, options=options)] == [data[o : o + n] for o, n in blocks]
    monkeypatch.setattr("loomscan.sources.files.object_store", lambda scheme, given: fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()))
    asked = []
    read = OpenFile.read
    monkeypatch.setattr(OpenFile, "read", lambda self, o, n: asked.append((o, n)) or read(self, o, n))
    assert b"".join(x.to_pybytes() for x in read_blocks("s3://f", [(0, 1 << 20)], options=Options(concurrency=4, block_bytes=300000))) == data
    assert sorted(asked) == [(0, 300000), (300000, 300000), (600000, (1 << 20) - 600000)]
    assert parts_of(10, 3) == [(0, 3), (3, 3), (6, 4)] and parts_of(2, 3) == [(0, 2)] and parts_of(0, 3) == [(0, 0)]
    for offset, size in ((-1, 1), (0, -1), (1 << 62, 1 << 62)):
        with pytest.raises(TensorFileError, match="Invalid request"):
            read_range(str(path), offset, size)
    with pytest.raises(TensorFileError, match="End of file"):
        list(read_blocks(str(path), [(0, 10), (len(data) - 1, 2)], options=Options(concurrency=2)))


def test_many_files_are_planned_without_their_headers(tmp_path, monkeypatch):
    for i in range(10000):
        (tmp_path / f"m-{i:05d}.safetensors").write_bytes(make_header([("t", "U8", [1], 1)]) + b"x")
    reader = TensorReader({"path": str(tmp_path)}, True)
    with monkeypatch.context() as m:
        m.setattr("loomscan.sources.tensorfile.header_of", lambda f: pytest.fail("the driver read a header"))
        parts = reader.partitions()
    assert 10 < len(parts) < 200 and sum(len(p.files) for p in parts) == 10000
    assert sum(b.num_rows for p in parts[:2] for b in reader.read(p)) == sum(len(p.files) for p in parts[:2])


def test_parts_of_a_file_hold_each_tensor_once(tmp_path):
    import random

    rng = random.Random(4)
    entries = [(f"t{i}", "U8", [n], n) for i, n in enumerate(rng.choice([0, 1, 50, 3000]) for _ in range(200))]
    path = tmp_path / "m.safetensors"
    path.write_bytes(make_header(entries) + b"".join(bytes([i % 251]) * n for i, (_, _, _, n) in enumerate(entries)))
    for limit in (100, 7000, 10**6):
        reader = TensorReader({"path": str(path), "partition_bytes": str(limit)}, True)
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        rows = pa.Table.from_batches(batches).to_pylist()
        assert {r["name"]: r["data"] for r in rows} == {e[0]: bytes([i % 251]) * e[3] for i, e in enumerate(entries)} and len(rows) == 200
