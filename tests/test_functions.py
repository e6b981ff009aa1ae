import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from loomscan.functions import paths, sizes


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("pattern", ["*.txt2", "a?c", "[ab]*", "[!a]x", "x[", "a.b", "*", "", "[]]x", "[!]]x", "a\\b*", "[a-c]1", "^x$"])
def test_globs(pattern):
    for name in ("test.txt2", "dir/test.txt2", "abc", "a/c", "bx", "ax", "x[", "a.b", "axb", "", "]x", "a\\bc", "b1", "^x$", "multi\nline.txt2"):
        assert bool(re.search(paths.glob_regex(pattern).replace("$", r"\Z") if not pattern.endswith("$") else r"\A\^x\$\Z", name)) == fnmatch.fnmatchcase(name, pattern), name


def test_filters(spark):
    df = spark.createDataFrame([(x,) for x in ("f1.txt1", "dir/f2.txt2", "f3.txt3", "dir/")], "p string")
    kept = lambda *a: [r[0] for r in df.filter(paths.allowed(F.col("p"), *a)).collect()]
    assert kept() == ["f1.txt1", "dir/f2.txt2", "f3.txt3"]
    assert kept(["*.txt2"]) == ["dir/f2.txt2"] and kept([]) == [] and kept(None, ["*.txt2"]) == ["f1.txt1", "f3.txt3"]


@pytest.mark.parametrize(("uri", "want"), [("s3://b/k", ("s3", "b", "k")), ("gs://b/k/l", ("gs", "b", "k/l")), ("", None), ("s3://b/", None), ("s3://", None), ("s3:///k", None), ("nfs://k", None)])
def test_uris(spark, uri, want):
    got = one(spark, paths.uri_parts(F.col("u")), u=uri)
    assert (None if got is None else tuple(got)) == want


def test_prefixes(spark):
    for text, prefix, want in (("test_prefix_string", "test_prefix_", "string"), ("test_prefix_string", "test_suffix_", "test_prefix_string")):
        assert one(spark, paths.strip_prefix(F.col("t"), F.col("p")), t=text, p=prefix) == want
    for p, want in (("dir/sub", "dir/sub/"), ("dir//", "dir/"), ("", ""), ("/", "")):
        assert one(spark, paths.normal_prefix(F.col("p")), p=p) == want
    df = spark.createDataFrame([("dir/sub/a",), ("dir/sub/x/b",), ("dir/sub/",), ("dir/a",)], "p string")
    assert [r[0] for r in df.filter(paths.directly_below(F.col("p"), F.lit("dir/sub/"))).collect()] == ["dir/sub/a"]
    assert one(spark, paths.connector_path(F.col("p")), p="az://c/k") == "abfss://c/k"


def test_homogeneous(spark):
    for rows, want in ((["s3://a/b", "s3://c/d"], True), (["s3://a/b", "/x"], False), (["/a", "b"], True)):
        assert paths.homogeneous(spark.createDataFrame([(x,) for x in rows], "path string")).first()["homogeneous"] is want


def human(n):
    i, d = 0, float(n)
    while n // 1000 > 0 and i < 6:
        d, n, i = n / 1000.0, n // 1000, i + 1
    return f"{d:.2f} {sizes.UNITS[i]}"


def test_sizes(spark):
    values = [0, 1, 999, 1000, 1005, 1125, 1375, 1015, 2675, 999999, 123456789, 10**18, 2**63 - 1, *range(1000, 20000, 5)]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    assert [r[0] for r in df.select(sizes.human_size(F.col("n"))).collect()] == list(map(human, values))
    for n in (0, 1, 255, 256, 2**32, 2**62 + 77):
        assert one(spark, sizes.little_endian(F.col("b")), b=bytearray(n.to_bytes(8, "little"))) == n
    assert one(spark, sizes.status_text(F.col("c")), c=3) == "End of file reached" and one(spark, sizes.status_text(F.col("c")), c=99) == sizes.NO_STATUS
    assert one(spark, sizes.padding(F.col("c"), 512), c=1000) == 24
