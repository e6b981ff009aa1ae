"""Column functions over paths and object URIs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Object-store schemes, and the Hadoop connector that serves each.
SCHEMES = {"s3": "s3a", "gs": "gs", "az": "abfss"}
URI_RE = r"^(s3|gs|az)://([^/]+)/([\s\S]+)$"


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a shell pattern in which * and ? also match slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))) >= 0:
            body = pattern[i:end]
            i = end + 1
            negate, body = body.startswith("!"), body.removeprefix("!")
            out.append("[" + "^" * negate + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]")
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"


def matches_any(path: Column, patterns: list[str] | None) -> Column:
    """True if one of the patterns matches; False without patterns."""
    found = F.lit(False)
    for p in patterns or []:
        found = found | path.rlike(glob_regex(p))
    return found


def allowed(path: Column, allow: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """Directory markers go first; then what no allow pattern matches (if there are any), then what an ignore pattern matches."""
    kept = ~path.endswith("/")
    if allow is not None:
        kept = kept & matches_any(path, allow)
    return kept & ~matches_any(path, ignore)


def scheme_of(path: Column) -> Column:
    """The object-store scheme of a path, or "file"."""
    found = F.lit("file")
    for s in SCHEMES:
        found = F.when(path.startswith(f"{s}://"), s).otherwise(found)
    return found


def uri_parts(path: Column) -> Column:
    """struct(scheme, bucket, key), null unless all three are there."""
    part = lambda n: F.regexp_extract(path, URI_RE, n)
    return F.when(path.rlike(URI_RE), F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key")))


def strip_prefix(text: Column, prefix: Column) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.char_length(prefix) + 1)).otherwise(text)


def normal_prefix(prefix: Column) -> Column:
    """A listing prefix: no slashes at its end but one, and none if it is empty."""
    bare = F.regexp_replace(prefix, "/+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("/")))


def remap(path: Column, roots: dict[str, str]) -> Column:
    """The path under a root map (prefix to root); the longest prefix that it begins with counts."""
    found = path
    for prefix, root in sorted(roots.items(), key=lambda x: len(x[0])):
        rest = F.regexp_replace(F.substr(path, F.lit(len(prefix) + 1)), "^/+", "")
        found = F.when(path.startswith(prefix), F.concat(F.lit(root.rstrip("/") + "/"), rest)).otherwise(found)
    return found


def directly_below(path: Column, prefix: Column) -> Column:
    """True for what a listing that doesn't descend returns."""
    rest = F.substr(path, F.char_length(prefix) + 1)
    return path.startswith(prefix) & (F.instr(rest, "/") == 0) & (rest != "")


def homogeneous(paths: DataFrame, col: str = "path") -> DataFrame:
    """One row: how many schemes the paths have, and whether they may be read in one request."""
    return paths.agg(F.count_distinct(scheme_of(F.col(col))).alias("n_schemes")).select("n_schemes", (F.col("n_schemes") <= 1).alias("homogeneous"))


def connector_path(path: Column) -> Column:
    """The path as Hadoop's connectors take it."""
    found = path
    for s, connector in SCHEMES.items():
        found = F.when(path.startswith(f"{s}://"), F.concat(F.lit(connector), F.substr(path, F.lit(len(s) + 1)))).otherwise(found)
    return found
