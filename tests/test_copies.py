import multiprocessing
import os

import pytest

from loomscan.sources.files import list_tensor_files, listing
from loomscan.sources.materialize import Materialized, mocked, pull_files, unmocked


@pytest.fixture()
def remote(tmp_path):
    root = tmp_path / "bucket"
    (root / "nested_folder").mkdir(parents=True)
    for name in ("model.safetensors", "config.json", "nested_folder/y.safetensors"):
        (root / name).write_text(name)
    return "s3://bucket/", {"s3://bucket/": str(root)}, tmp_path


def test_listings(remote):
    path, roots, _ = remote
    assert list_tensor_files(path, roots) == ["s3://bucket/model.safetensors"]
    assert [f.path for f in listing(path, recursive=True, roots=roots)] == ["s3://bucket/config.json", "s3://bucket/model.safetensors", "s3://bucket/nested_folder/y.safetensors"]
    assert listing("s3://bucket/none", roots=roots) == []


def test_pull(spark, remote):
    path, roots, tmp = remote
    assert pull_files(path, str(tmp / "a"), roots=roots) == 3
    assert (tmp / "a/nested_folder/y.safetensors").read_text() == "nested_folder/y.safetensors"
    assert pull_files(path, str(tmp / "b"), ["*.safetensors"], ["*nested*"], roots, spark) == 1
    assert pull_files(path, str(tmp / "c"), ["*.none"], roots=roots) == 0
    assert pull_files(path, str(tmp / "d"), roots=roots, spark=spark) == 3
    with pytest.raises(NotImplementedError):
        pull_files("/local", str(tmp / "e"))


def test_materialise(remote):
    path, roots, tmp = remote
    target = tmp / "model"
    with pytest.raises(KeyError), Materialized(path, str(target), roots) as m:
        m.pull()
        raise KeyError
    assert not (target / Materialized.MARK).exists()
    (target / "stale").write_text("x")
    with Materialized(path, str(target) + "/", roots) as m:
        assert m.pull() == 3
    assert (target / Materialized.MARK).exists() and not (target / "stale").exists()
    with Materialized(path, str(target), roots) as m:
        assert m.done and m.pull() == 0
    with pytest.raises(RuntimeError), Materialized("s3://bucket/none", str(tmp / "empty"), roots):
        pass
    with pytest.raises(ValueError):
        Materialized("/local", str(tmp / "x"))


def visit(path, roots, target, out):
    with Materialized(path, target, roots) as m:
        out.put(m.pull())


def test_one_of_many_processes_copies(remote):
    path, roots, tmp = remote
    context = multiprocessing.get_context("spawn")
    out = context.Queue()
    tasks = [context.Process(target=visit, args=(path, roots, str(tmp / "model"), out)) for _ in range(4)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join(60)
        assert t.exitcode == 0
    assert sorted(out.get(timeout=5) for _ in tasks) == [0, 0, 0, 3]


def test_root_maps():
    roots = {"s3://bucket/": "/data/x"}
    assert mocked("s3://bucket/a/b", roots) == "/data/x/a/b" and unmocked("/data/x/a/b", roots) == "s3://bucket/a/b"
    assert mocked("/other", roots) == "/other" == unmocked("/other", roots) and os.sep == "/"
