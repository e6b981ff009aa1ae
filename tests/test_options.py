import pytest

from loomscan.sources.options import Options


def test_defaults_and_floors():
    assert Options.read("file", {}).block_bytes == 2 << 20 and Options.read("object", {}) == Options(8, 8 << 20)
    assert Options.read("object", {"LOOMSCAN_BLOCK_BYTES": "1"}).block_bytes == 5 << 20
    assert Options.read("file", {"LOOMSCAN_CONCURRENCY": "3", "LOOMSCAN_MEMORY_LIMIT": "-1"}).concurrency == 3


@pytest.mark.parametrize(("name", "text"), [("CONCURRENCY", "0"), ("CONCURRENCY", "4x"), ("CONCURRENCY", ""), ("ALIGNMENT", "1048577"), ("ALIGNMENT", "-1"), ("MEMORY_LIMIT", "-2"), ("PARTITION_POLICY", "rows"), ("SCOPE", "world")])
def test_bad_values(name, text):
    with pytest.raises(ValueError):
        Options.read("file", {f"LOOMSCAN_{name}": text})


def test_request_limits():
    assert Options(memory_limit=-1).request_limit(10, 4) == 10 and Options(memory_limit=0).request_limit(10, 4) == 4
    assert Options(memory_limit=5).request_limit(10, 4) == 5 and Options(memory_limit=50).request_limit(10, 4) == 10
    with pytest.raises(ValueError):
        Options(memory_limit=3).request_limit(10, 4)


def test_given_options_come_first():
    assert Options.read("file", {"LOOMSCAN_CONCURRENCY": "3"}, {"concurrency": "5"}).concurrency == 5
    assert Options.read("file", {"LOOMSCAN_SCOPE": "global"}).scope == "global" and Options.read("file", {}).scope == "local"
    assert set(Options.names()) == {"concurrency", "block_bytes", "memory_limit", "partition_policy", "batch_bytes", "alignment", "scope"}
