import numpy as np

from loomscan.llm import near_copies


def test_links_by_chance_group_nothing(spark, monkeypatch):
    """Fingerprints that meet in a table and are within the checked bits, but far apart in all of them, aren't linked; in small buckets and in searched ones."""
    rng, n = np.random.default_rng(3), near_copies.WORDS * 64
    bits = rng.integers(0, 2, (7, n), dtype=np.uint8)
    bits[:, :128] = bits[0, :128]
    for i in range(6):
        bits[i, 32 + 15 * i : 47 + 15 * i] ^= 1
    bits[6] = bits[5]
    bits[6, rng.choice(np.arange(128, n), 150, replace=False)] ^= 1
    prints = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node bigint, print binary").repartition(3)
    for run in (64, 2):
        monkeypatch.setattr(near_copies, "RUN", run)
        assert {(r["a"], r["b"]) for r in near_copies.candidates(nodes).collect()} == {(6, 5)}
