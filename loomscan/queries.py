"""The engine's registered queries over the driver's tables, and the SQL that each is checked by.

Most run over a chunk manifest M made of documents (a file for each source and language, a chunk for each document) or over
tensor files written from embeddings (a file for each label). Files go to a fresh folder in the shared one.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscan.functions import paths, sizes
from loomscan.functions.dtypes import DTYPES
from loomscan.operators import scan, validate
from loomscan.plans import folds, manifest, workers
from loomscan.sources.decode import decode
from loomscan.sources.files import OpenFile, TensorFileError, file_system, remapped
from loomscan.sources.headers import header_of
from loomscan.sources.materialize import Materialized, pull_files
from loomscan.sources.shared import fresh_dir
from loomscan.sources.tensorfile import expand
from loomscan.sources.writer import float_bytes, write_raw_files, write_tensor_files

#: Production parameters of the planning queries, of a size that cuts these tables often.
PARTS = 8
REQUEST_LIMIT = 262_144
BLOCK = 4096
CONCURRENCY = 16
PART_CHUNK = 1000
BATCH_BYTES = 262_144
BATCH_CHUNKS = 32
ALIGNMENT = 512
HOSTS = 8
#: Bytes of a file that one buffer of chunk_projection stands for.
BUFFER_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("s3://corpus/"), "source", F.lit("/"), "lang")
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")


def base_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "path", F.octet_length("text").cast("bigint").alias("size"))
    order = Window.partitionBy("path").orderBy("doc_id")
    return manifest.numbered_files(rows).select("file_id", "path", F.lit(0).cast("bigint").alias("file_offset"), (F.row_number().over(order) - 1).cast("bigint").alias("chunk_idx"), "size", "doc_id")


_M = """m AS (SELECT dense_rank() OVER (ORDER BY path) - 1 AS file_id, path, CAST(0 AS BIGINT) AS file_offset, row_number() OVER (PARTITION BY path ORDER BY doc_id) - 1 AS chunk_idx, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id, text FROM (SELECT *, 's3://corpus/' || source || '/' || lang AS path FROM documents)),
o AS (SELECT *, CAST(file_offset + coalesce(sum(size) OVER (PARTITION BY file_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM m),
t AS (SELECT file_id, path, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS total_bytes, max(size) AS largest FROM m GROUP BY file_id, path),
b AS (SELECT file_id, total_bytes, CAST(coalesce(sum(total_bytes) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS buffer_offset FROM t)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- manifests


@query(f'WITH {_M} SELECT file_id, chunk_idx, size, "offset" FROM o')
def chunk_offsets(spark, sf_dir):
    return manifest.chunk_offsets(base_manifest(spark, sf_dir)).select("file_id", "chunk_idx", "size", "offset")


@query(f"WITH {_M} SELECT * FROM b")
def buffer_offsets(spark, sf_dir):
    return manifest.buffer_offsets(base_manifest(spark, sf_dir))


@query(f"WITH {_M} SELECT * FROM t")
def file_totals(spark, sf_dir):
    return manifest.file_totals(base_manifest(spark, sf_dir))


@query(f"WITH {_M} SELECT coalesce(max(size), 0) AS largest FROM m")
def largest_chunk(spark, sf_dir):
    return base_manifest(spark, sf_dir).agg(F.coalesce(F.max("size"), F.lit(0).cast("bigint")).alias("largest"))


@query(f"WITH {_M}, s AS (SELECT CAST(sum(size) AS BIGINT) AS total, max(size) AS largest FROM m) SELECT 'unlimited' AS mode, total AS buffer_bytes FROM s UNION ALL SELECT 'largest_chunk', largest FROM s UNION ALL SELECT 'limited', least(total, {REQUEST_LIMIT}) FROM s")
def memory_modes(spark, sf_dir):
    return manifest.memory_modes(base_manifest(spark, sf_dir), REQUEST_LIMIT)


@query(f'WITH {_M} SELECT file_id, count(*) AS n_units, CAST(sum(size) AS BIGINT) AS n_bytes, min("offset") AS first_offset, max("offset" + size) AS end_offset FROM o WHERE size > 0 GROUP BY file_id')
def nonempty_units(spark, sf_dir):
    rows = manifest.chunk_offsets(base_manifest(spark, sf_dir)).filter("size > 0")
    return rows.groupBy("file_id").agg(F.count("*").alias("n_units"), F.sum("size").alias("n_bytes"), F.min("offset").alias("first_offset"), F.max(F.col("offset") + F.col("size")).alias("end_offset"))


_REQUESTS = f"""{_M}, q AS (SELECT page_id % 40 + 1000 AS file_id, page_id % 5 AS kind, page_id FROM pages),
w AS (SELECT file_id, chunk_idx, size FROM m UNION ALL SELECT file_id, CASE WHEN kind > 0 THEN page_id END, CASE kind WHEN 1 THEN 0 WHEN 2 THEN -page_id - 1 WHEN 3 THEN page_id WHEN 4 THEN page_id % 2 END FROM q),
v AS (SELECT file_id, coalesce(sum(size), 0) AS bytes, count(size) AS n, min(size) AS least FROM w GROUP BY file_id)"""


@query(f"WITH {_REQUESTS} SELECT w.file_id, w.chunk_idx, CAST(CASE WHEN bytes = 0 AND n = 0 THEN 8 WHEN bytes <= 0 OR n = 0 OR least < 0 THEN 7 ELSE 0 END AS INTEGER) AS status FROM w JOIN v ON w.file_id = v.file_id")
def request_validation(spark, sf_dir):
    """Requests of documents, and invented ones: without chunks, without bytes, with negative sizes, and sound."""
    good = base_manifest(spark, sf_dir).select("file_id", "chunk_idx", "size")
    page, kind = F.col("page_id"), F.col("page_id") % 5
    size = F.when(kind == 1, F.lit(0)).when(kind == 2, -page - 1).when(kind == 3, page).when(kind == 4, page % 2)
    made = _table(spark, sf_dir, "pages").select((page % 40 + 1000).alias("file_id"), F.when(kind > 0, page).alias("chunk_idx"), size.alias("size"))
    return scan.check_chunks(good.unionByName(made)).select("file_id", "chunk_idx", "status")


# ---- raw ranges


#: Folders that queries of an application have written, by what is in them: they are written once and scanned by many.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _once(spark, kind: str, sf_dir: str, write) -> str:
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = write()
    return _WRITTEN[key]


def _raw_files(spark, sf_dir):
    """The documents' bytes as files below a root that stands for s3://corpus/; the root map."""
    return {"s3://corpus/": _once(spark, "raw", sf_dir, lambda: _write_raw_files(spark, sf_dir))}


def _write_raw_files(spark, sf_dir) -> str:
    folder = fresh_dir(spark)
    rows = base_manifest(spark, sf_dir)
    data = _documents(spark, sf_dir).select("doc_id", F.col("path").alias("file"), F.encode("text", "UTF-8").alias("data")).join(rows.select("doc_id", F.col("chunk_idx").alias("idx")), "doc_id")
    write_raw_files(data.withColumn("file", F.regexp_replace("file", "^s3://corpus/", "")), folder)
    return folder


@query(f"WITH {_M} SELECT file_id, chunk_idx, size, md5(text) AS digest FROM m")
def raw_chunk_scan(spark, sf_dir):
    roots = _raw_files(spark, sf_dir)
    rows = manifest.chunk_offsets(base_manifest(spark, sf_dir))
    return scan.read_chunks(rows, roots).select("file_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "size", F.md5("data").alias("digest"))


@query(f"WITH {_M} SELECT file_id, md5(string_agg(text, '' ORDER BY chunk_idx)) AS digest FROM m GROUP BY file_id")
def whole_file_scan(spark, sf_dir):
    roots = _raw_files(spark, sf_dir)
    totals = manifest.file_totals(base_manifest(spark, sf_dir)).select("file_id", "path", F.lit(0).alias("chunk_idx"), F.lit(0).alias("offset"), F.col("total_bytes").alias("size"))
    return scan.read_chunks(totals, roots).select("file_id", F.md5("data").alias("digest"))


@query(f"WITH {_M} SELECT file_id, chunk_idx, size, md5(text) AS digest FROM m")
def chunk_projection(spark, sf_dir):
    """Chunks cut out of buffers, as substrings.

    A file has a buffer for each BUFFER_BYTES of it, with the chunks that begin there, so that no row holds a whole file. Each buffer
    meets the list of its chunks once, in a join that merges: the reader's size is taken from the manifest, not from the bytes.
    """
    roots = _raw_files(spark, sf_dir)
    rows = manifest.chunk_offsets(base_manifest(spark, sf_dir)).withColumn("buffer", sizes.div(F.col("offset"), BUFFER_BYTES))
    cuts = rows.groupBy("file_id", "path", "buffer").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.coalesce("size", F.lit(0))).alias("end"), F.collect_list(F.struct("chunk_idx", "offset", "size")).alias("chunks"))
    buffers = scan.read_chunks(cuts.select("file_id", "path", F.col("buffer").alias("chunk_idx"), F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("size")), roots)
    joined = cuts.hint("merge").join(buffers.select("file_id", F.col("chunk_idx").cast("bigint").alias("buffer"), "data"), ["file_id", "buffer"])
    digest = lambda c: F.md5(F.substring(F.col("data"), (c["offset"] - F.col("start") + 1).cast("int"), c["size"].cast("int")))
    cut = F.transform("chunks", lambda c: F.struct(c["chunk_idx"].alias("chunk_idx"), c["size"].alias("size"), digest(c).alias("digest")))
    return joined.select("file_id", cut.alias("cut")).select("file_id", F.inline("cut"))


# ---- folds

_PACK = f"""{_M}, s AS (SELECT *, row_number() OVER (ORDER BY file_id, chunk_idx) AS rn FROM m),
r(rn, file_id, chunk_idx, size, request_id, used) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
SELECT s.rn, s.file_id, s.chunk_idx, s.size, CASE WHEN r.used + s.size > {REQUEST_LIMIT} THEN r.request_id + 1 ELSE r.request_id END, CASE WHEN r.used + s.size > {REQUEST_LIMIT} THEN s.size ELSE r.used + s.size END FROM r JOIN s ON s.rn = r.rn + 1)"""


def _packed(spark, sf_dir):
    return folds.pack_requests(base_manifest(spark, sf_dir).drop("doc_id"), REQUEST_LIMIT)


@query(f"WITH RECURSIVE {_PACK} SELECT file_id, chunk_idx, size, request_id, used - size AS request_offset FROM r WHERE rn > 0")
def request_packing(spark, sf_dir):
    return _packed(spark, sf_dir).select("file_id", "chunk_idx", "size", "request_id", "request_offset")


@query(f"WITH RECURSIVE {_PACK} SELECT request_id, file_id, row_number() OVER (PARTITION BY request_id, file_id ORDER BY chunk_idx) - 1 AS local_idx, row_number() OVER (PARTITION BY file_id ORDER BY request_id, chunk_idx) - 1 AS global_idx, chunk_idx FROM r WHERE rn > 0")
def request_global_index(spark, sf_dir):
    return folds.request_indices(_packed(spark, sf_dir))


def _lpt(rows: str, order: str, size: str) -> str:
    bins = ", ".join(["CAST(0 AS BIGINT)"] * PARTS)
    return f"""s AS (SELECT *, row_number() OVER (ORDER BY {size} DESC, {order}) AS rn FROM {rows}),
r(rn, part, loads) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), [{bins}] UNION ALL
SELECT s.rn, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS BIGINT), list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + s.{size} ELSE x END) FROM r JOIN s ON s.rn = r.rn + 1),
a AS (SELECT s.*, r.part FROM s JOIN r ON s.rn = r.rn)"""


_BY_CHUNKS = f"{_M}, {_lpt('(SELECT * FROM o WHERE size > 0)', 'file_id, chunk_idx', 'size')}"
_BY_FILES = f"{_M}, {_lpt('t', 'file_id', 'total_bytes')}"
_RUNS = """c AS (SELECT *, CASE WHEN lag("offset" + size) OVER w = "offset" THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY part, path ORDER BY "offset")),
u AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY part, path ORDER BY "offset") AS BIGINT) AS run FROM c)"""


def _by_chunks(spark, sf_dir):
    return folds.partition_chunks(manifest.chunk_offsets(base_manifest(spark, sf_dir)).drop("doc_id"), PARTS)


@query(f"WITH RECURSIVE {_BY_CHUNKS} SELECT file_id, chunk_idx, size, part FROM a")
def partition_chunks(spark, sf_dir):
    return _by_chunks(spark, sf_dir).select("file_id", "chunk_idx", "size", "part")


@query(f"WITH RECURSIVE {_BY_FILES} SELECT file_id, total_bytes, part FROM a")
def partition_files(spark, sf_dir):
    return folds.partition_files(manifest.file_totals(base_manifest(spark, sf_dir)), PARTS).select("file_id", "total_bytes", "part")


@query(f"WITH RECURSIVE {_BY_CHUNKS} SELECT part, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS n_bytes FROM a GROUP BY part")
def partition_sizes(spark, sf_dir):
    return _by_chunks(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n_chunks"), F.sum("size").alias("n_bytes"))


@query(f'WITH RECURSIVE {_BY_CHUNKS}, {_RUNS} SELECT part, path, CAST(row_number() OVER (PARTITION BY part, path, run ORDER BY "offset") - 1 AS BIGINT) AS run_idx, run, file_id, chunk_idx, size FROM u')
def partition_source_map(spark, sf_dir):
    """Lineage: where each chunk of a part's ranges comes from."""
    return folds.coalesce_ranges(_by_chunks(spark, sf_dir)).select("part", "path", "run_idx", F.col("run").cast("bigint").alias("run"), "file_id", "chunk_idx", "size")


@query(f'WITH RECURSIVE {_BY_CHUNKS}, {_RUNS} SELECT part, path, run, min("offset") AS range_start, CAST(sum(size) AS BIGINT) AS n_bytes, count(*) AS n_chunks FROM u GROUP BY part, path, run')
def coalesced_ranges(spark, sf_dir):
    runs = folds.coalesce_ranges(_by_chunks(spark, sf_dir))
    return runs.groupBy("part", "path", F.col("run").cast("bigint").alias("run")).agg(F.min("offset").alias("range_start"), F.sum("size").alias("n_bytes"), F.count("*").alias("n_chunks"))


@query(f"WITH {_M} SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS n_bytes FROM m WHERE size > 0")
def partition_conservation(spark, sf_dir):
    cols = ["file_id", "chunk_idx", "size", "offset"]
    before = manifest.chunk_offsets(base_manifest(spark, sf_dir)).filter("size > 0").select(*cols)
    after = _by_chunks(spark, sf_dir).select(*cols)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    sums = after.agg(F.count("*").alias("n_chunks"), F.sum("size").alias("n_bytes"))
    return n(before.exceptAll(after), "missing").crossJoin(n(after.exceptAll(before), "extra")).crossJoin(sums)


_BATCHES = f"""{_BY_CHUNKS}, q AS (SELECT *, row_number() OVER (ORDER BY part, file_id, chunk_idx) AS n FROM a),
z(n, part, file_id, chunk_idx, size, batch_id, batch_offset, used, cnt) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
SELECT n, part, file_id, chunk_idx, size, CASE WHEN other THEN 0 WHEN fresh THEN batch_id + 1 ELSE batch_id END, CASE WHEN fresh THEN 0 ELSE at_ END, CASE WHEN fresh THEN 0 ELSE at_ END + size, CASE WHEN fresh THEN 1 ELSE cnt + 1 END FROM (
SELECT q.n, q.part, q.file_id, q.chunk_idx, q.size, z.batch_id, z.cnt, q.part <> z.part AS other, CAST(ceil(z.used / {ALIGNMENT}.0) * {ALIGNMENT} AS BIGINT) AS at_, q.part <> z.part OR z.cnt > 0 AND (z.cnt >= {BATCH_CHUNKS} OR ceil(z.used / {ALIGNMENT}.0) * {ALIGNMENT} + q.size > {BATCH_BYTES}) AS fresh FROM z JOIN q ON q.n = z.n + 1))"""


def _batches(spark, sf_dir):
    return folds.aligned_batches(_by_chunks(spark, sf_dir), ["file_id", "chunk_idx"], BATCH_BYTES, BATCH_CHUNKS, ALIGNMENT)


@query(f"WITH RECURSIVE {_BATCHES} SELECT part, file_id, chunk_idx, size, batch_id, batch_offset FROM z WHERE n > 0")
def aligned_batches(spark, sf_dir):
    """Each part fills batches from its own chunks."""
    return _batches(spark, sf_dir).select("part", "file_id", "chunk_idx", "size", "batch_id", "batch_offset")


@query(f"WITH RECURSIVE {_BATCHES} SELECT batch_id, part, rank, file_id, chunk_idx, size, CAST(row_number() OVER (PARTITION BY part, batch_id, rank ORDER BY batch_offset, file_id, chunk_idx) - 1 AS BIGINT) AS turn FROM z, (SELECT unnest(range({PARTS})) AS rank) WHERE n > 0")
def broadcast_schedule(spark, sf_dir):
    """Every chunk for every rank: in round batch_id each part sends its batch, and all ranks receive it."""
    expected = base_manifest(spark, sf_dir).filter("size > 0").count()
    return folds.broadcast_schedule(_batches(spark, sf_dir), PARTS, expected).select("batch_id", "part", "rank", "file_id", "chunk_idx", "size", "turn")


@query(f"WITH RECURSIVE {_BY_CHUNKS} SELECT part, file_id, chunk_idx, size, md5(text) AS digest FROM a")
def partitioned_scan(spark, sf_dir):
    """Chunks dealt over parts, and each part's bytes read by one task in order of place."""
    roots = _raw_files(spark, sf_dir)
    rows = manifest.chunk_offsets(base_manifest(spark, sf_dir))
    return scan.read_partitioned(rows, PARTS, "chunks", roots).select("part", "file_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "size", F.md5("data").alias("digest"))


@query(f"WITH RECURSIVE {_PACK} SELECT CAST(request_id AS BIGINT) AS round, r.file_id, r.chunk_idx, md5(m.text) AS digest FROM r JOIN m ON r.file_id = m.file_id AND r.chunk_idx = m.chunk_idx WHERE rn > 0")
def capped_rounds(spark, sf_dir):
    """Chunks read in rounds of bounded bytes, with the round that each comes in."""
    roots = _raw_files(spark, sf_dir)
    packed = folds.pack_requests(manifest.chunk_offsets(base_manifest(spark, sf_dir)).drop("doc_id"), REQUEST_LIMIT)
    read = scan.read_chunks(packed, roots).select("file_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.md5("data").alias("digest"))
    return packed.select(F.col("request_id").alias("round"), "file_id", "chunk_idx").join(read, ["file_id", "chunk_idx"])


# ---- workers

_W = f"""{_M}, g AS (SELECT o.*, b.buffer_offset + o."offset" AS start FROM o JOIN b ON o.file_id = b.file_id),
n0 AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM m), n1 AS (SELECT total, greatest(least(total // {BLOCK}, {CONCURRENCY}), 1) AS workers FROM n0),
n2 AS (SELECT total, workers, (total // {BLOCK}) // workers * {BLOCK} AS base FROM n1), quota AS (SELECT *, total - base * workers AS rest FROM n2),
ranges AS (SELECT worker, CASE WHEN worker = 0 THEN 0 ELSE base * worker + rest END AS range_start, base * (worker + 1) + rest AS range_end FROM (SELECT *, unnest(range(workers)) AS worker FROM quota)),
tasks AS (SELECT g.file_id, g.chunk_idx, g.size, r.worker, greatest(g.start, r.range_start) AS task_start, least(g.start + g.size, r.range_end) - greatest(g.start, r.range_start) AS task_size FROM g JOIN ranges r ON g.start < r.range_end AND g.start + g.size > r.range_start)"""


def _quota(spark, sf_dir):
    return workers.quotas(base_manifest(spark, sf_dir).agg(F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("total")), BLOCK, CONCURRENCY)


def _tasks(spark, sf_dir):
    rows = manifest.global_offsets(base_manifest(spark, sf_dir)).select("file_id", "chunk_idx", "size", "start")
    return workers.assign(rows, _quota(spark, sf_dir))


@query(f"WITH {_W} SELECT *, range_end - range_start AS n_bytes FROM ranges")
def worker_quota(spark, sf_dir):
    return workers.worker_ranges(_quota(spark, sf_dir))


@query(f"WITH {_W} SELECT b.file_id, r.worker, greatest(b.buffer_offset, r.range_start) - b.buffer_offset AS file_offset, least(b.buffer_offset + b.total_bytes, r.range_end) - greatest(b.buffer_offset, r.range_start) AS task_size FROM b JOIN ranges r ON b.buffer_offset < r.range_end AND b.buffer_offset + b.total_bytes > r.range_start")
def worker_assignment(spark, sf_dir):
    files = manifest.buffer_offsets(base_manifest(spark, sf_dir)).select("file_id", F.col("total_bytes").alias("size"), F.col("buffer_offset").alias("start"))
    return workers.assign(files, _quota(spark, sf_dir)).select("file_id", "worker", (F.col("task_start") - F.col("start")).alias("file_offset"), "task_size")


@query(f"WITH {_W} SELECT file_id, chunk_idx, worker, task_start, task_size FROM tasks")
def chunk_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir).select("file_id", "chunk_idx", "worker", "task_start", "task_size")


@query(f"WITH {_W} SELECT file_id, chunk_idx, count(*) AS n_tasks, CAST(sum(task_size) AS BIGINT) AS n_bytes, CAST(coalesce(max_by(CASE worker % 4 WHEN 1 THEN 3 WHEN 2 THEN 2 END, worker) FILTER (WHERE worker % 4 IN (1, 2)), 0) AS INTEGER) AS status FROM tasks GROUP BY file_id, chunk_idx")
def request_completion(spark, sf_dir):
    """Completion of chunks where some workers find a file's end and others can't read theirs: the last error stays."""
    kind = F.col("worker") % 4
    return workers.completion(_tasks(spark, sf_dir), F.when(kind == 1, 3).when(kind == 2, 2).otherwise(0))


@query(f"WITH {_W} SELECT worker, file_id, count(*) AS n_tasks, min(task_start) AS range_start, max(task_start + task_size) AS range_end FROM tasks GROUP BY worker, file_id")
def batch_ranges(spark, sf_dir):
    return workers.batch_ranges(_tasks(spark, sf_dir))


@query(f"WITH {_W} SELECT (SELECT count(*) FROM m) AS n_responses, CAST(sum(task_size) AS BIGINT) AS n_bytes, (SELECT total FROM n0) AS n_expected FROM tasks")
def byte_conservation(spark, sf_dir):
    rows = _tasks(spark, sf_dir)
    total = base_manifest(spark, sf_dir).agg(F.count("*").alias("n_responses"), F.sum("size").alias("n_expected"))
    return rows.agg(F.sum("task_size").alias("n_bytes")).crossJoin(total)


@query(f"WITH {_W}, f AS (SELECT worker, file_id, min(task_start) AS range_start FROM tasks GROUP BY worker, file_id) SELECT tasks.worker, tasks.file_id, chunk_idx, (task_start + task_size - f.range_start + {BLOCK - 1}) // {BLOCK} AS done_block FROM tasks JOIN f ON tasks.worker = f.worker AND tasks.file_id = f.file_id")
def task_completion_block(spark, sf_dir):
    return workers.completion_block(_tasks(spark, sf_dir), BLOCK).select("worker", "file_id", "chunk_idx", "done_block")


@query(f"WITH {_M} SELECT file_id, chunk_idx, part_idx, part_idx * {PART_CHUNK} AS part_offset, CASE WHEN part_idx = n - 1 THEN size - part_idx * {PART_CHUNK} ELSE {PART_CHUNK} END AS part_size FROM (SELECT *, unnest(range(n)) AS part_idx FROM (SELECT *, greatest(size // {PART_CHUNK}, 1) AS n FROM m))")
def object_parts(spark, sf_dir):
    return workers.object_parts(base_manifest(spark, sf_dir), PART_CHUNK).select("file_id", "chunk_idx", "part_idx", "part_offset", "part_size")


@query(f"WITH {_M} SELECT file_id, chunk_idx, block_idx, block_idx * {PART_CHUNK} AS block_offset, least({PART_CHUNK}, size - block_idx * {PART_CHUNK}) AS block_size FROM (SELECT *, unnest(range((size + {PART_CHUNK - 1}) // {PART_CHUNK})) AS block_idx FROM m WHERE size > 0)")
def fs_block_reads(spark, sf_dir):
    return workers.block_reads(base_manifest(spark, sf_dir), PART_CHUNK).select("file_id", "chunk_idx", "block_idx", "block_offset", "block_size")


@query("SELECT w AS worker, n_bytes, seconds, round(n_bytes / greatest(seconds, 1), 6) AS bytes_per_second FROM (SELECT user_id % 16 AS w, CAST(sum(octet_length(encode(props))) AS BIGINT) AS n_bytes, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1)")
def throughput_by_worker(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 16).alias("worker"))
    sums = rows.agg(F.sum(F.octet_length("props")).cast("bigint").alias("n_bytes"), (F.max(F.col("ts").cast("timestamp")).cast("bigint") - F.min(F.col("ts").cast("timestamp")).cast("bigint")).alias("seconds"))
    return sums.select("*", F.round(F.col("n_bytes") / F.greatest("seconds", F.lit(1)), 6).alias("bytes_per_second"))


@query(f"SELECT host, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks, count(*) AS n_ranks FROM (SELECT DISTINCT user_id AS rank, 'host' || (user_id % {HOSTS}) AS host FROM events) GROUP BY host")
def host_groups(spark, sf_dir):
    """Ranks of each host, in order. A host has a bounded number of ranks."""
    ranks = _table(spark, sf_dir, "events").select(F.col("user_id").alias("rank"), F.concat(F.lit("host"), (F.col("user_id") % HOSTS).cast("string")).alias("host")).distinct()
    return ranks.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("rank")).cast("array<string>"), ",").alias("ranks"), F.count("*").alias("n_ranks"))


_RANKS = f"r AS (SELECT DISTINCT user_id AS rank, 'host' || (user_id % {HOSTS}) AS host FROM events)"


@query(f"WITH {_RANKS} SELECT 'local' AS scope, rank, dense_rank() OVER (ORDER BY host) - 1 AS group_id, row_number() OVER (PARTITION BY host ORDER BY rank) - 1 AS place, count(*) OVER (PARTITION BY host) AS group_size FROM r UNION ALL SELECT 'global', rank, 0, row_number() OVER (ORDER BY rank) - 1, (SELECT count(*) FROM r) FROM r")
def rank_groups(spark, sf_dir):
    """Which ranks share what they read: those of one host, or all."""
    ranks = _table(spark, sf_dir, "events").select(F.col("user_id").alias("rank"), F.concat(F.lit("host"), (F.col("user_id") % HOSTS).cast("string")).alias("host")).distinct()
    both = [workers.rank_groups(ranks, scope).select(F.lit(scope).alias("scope"), "rank", "group_id", "place", "group_size") for scope in ("local", "global")]
    return both[0].unionByName(both[1])


# ---- paths


def _uris(spark, sf_dir):
    scheme = F.element_at(F.array(*map(F.lit, ("s3", "gs", "az", "https"))), (F.col("page_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?", "").alias("rest"), scheme.alias("kind")).select("page_id", F.concat("kind", "rest").alias("path"))


_U = "u AS (SELECT page_id, ['s3', 'gs', 'az', 'https'][CAST(page_id % 4 + 1 AS INTEGER)] || regexp_replace(url, '^https?', '') AS path FROM pages)"


@query(f"WITH {_U}, p AS (SELECT page_id, path, regexp_matches(path, '^(s3|gs|az)://([^/]+)/(.+)$', 's') AS ok FROM u) SELECT page_id, CASE WHEN ok THEN regexp_extract(path, '^(s3|gs|az)://', 1) END AS scheme, CASE WHEN ok THEN regexp_extract(path, '^(s3|gs|az)://([^/]+)/', 2) END AS bucket, CASE WHEN ok THEN regexp_extract(path, '^(s3|gs|az)://([^/]+)/(.+)$', 3) END AS key FROM p")
def uri_parse(spark, sf_dir):
    return _uris(spark, sf_dir).select("page_id", paths.uri_parts(F.col("path")).alias("u")).select("page_id", "u.scheme", "u.bucket", "u.key")


@query(f"WITH {_U} SELECT CASE WHEN starts_with(path, 's3://') THEN 's3' WHEN starts_with(path, 'gs://') THEN 'gs' WHEN starts_with(path, 'az://') THEN 'az' ELSE 'file' END AS scheme, count(*) AS n FROM u GROUP BY 1")
def scheme_predicates(spark, sf_dir):
    return _uris(spark, sf_dir).groupBy(paths.scheme_of(F.col("path")).alias("scheme")).agg(F.count("*").alias("n"))


@query(f"WITH {_U} SELECT count(DISTINCT CASE WHEN regexp_matches(path, '^(s3|gs|az)://') THEN left(path, 2) ELSE 'file' END) AS n_schemes, count(DISTINCT CASE WHEN regexp_matches(path, '^(s3|gs|az)://') THEN left(path, 2) ELSE 'file' END) <= 1 AS homogeneous FROM u")
def scheme_homogeneity(spark, sf_dir):
    return paths.homogeneous(_uris(spark, sf_dir))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN substr(url, 13) ELSE url END AS stripped FROM pages")
def strip_prefix(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", paths.strip_prefix(F.col("url"), F.lit("https://www.")).alias("stripped"))


@query("SELECT page_id, CASE WHEN regexp_replace(url, '/+$', '') = '' THEN '' ELSE regexp_replace(url, '/+$', '') || '/' END AS prefix FROM pages")
def normalize_prefix(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", paths.normal_prefix(F.col("url")).alias("prefix"))


@query("SELECT page_id, url FROM pages WHERE NOT ends_with(url, '/') AND (url GLOB '*.example.com/*[0-5]' OR url GLOB '*/de/*')")
def allow_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url").filter(paths.allowed(F.col("url"), ["*.example.com/*[0-5]", "*/de/*"]))


@query("SELECT page_id, url FROM pages WHERE NOT ends_with(url, '/') AND NOT (url GLOB '*.example.org/*' OR url GLOB '*/en/?[0-9]*')")
def ignore_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url").filter(paths.allowed(F.col("url"), None, ["*.example.org/*", "*/en/?[0-9]*"]))


@query("SELECT page_id, url FROM pages WHERE NOT ends_with(url, '/')")
def dir_marker_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url").filter(paths.allowed(F.col("url")))


_KEYS = "k AS (SELECT page_id, 'models/' || (page_id % 5) || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '/nested/' END || page_id || CASE WHEN page_id % 2 = 0 THEN '.safetensors' ELSE '.json' END AS key FROM pages)"


def _keys(spark, sf_dir):
    p = F.col("page_id")
    key = F.concat(F.lit("models/"), (p % 5).cast("string"), F.when(p % 3 == 0, "/").otherwise("/nested/"), p.cast("string"), F.when(p % 2 == 0, ".safetensors").otherwise(".json"))
    return _table(spark, sf_dir, "pages").select("page_id", key.alias("key"))


@query(f"WITH {_KEYS} SELECT page_id, key FROM k WHERE starts_with(key, 'models/2/') AND strpos(substr(key, 10), '/') = 0 AND key GLOB '*.safetensors'")
def list_flat(spark, sf_dir):
    return _keys(spark, sf_dir).filter(paths.directly_below(F.col("key"), F.lit("models/2/")) & paths.allowed(F.col("key"), ["*.safetensors"]))


@query(f"WITH {_KEYS} SELECT page_id, key FROM k WHERE starts_with(key, 'models/2/') AND NOT key GLOB '*.json'")
def list_recursive(spark, sf_dir):
    return _keys(spark, sf_dir).filter(F.col("key").startswith("models/2/") & paths.allowed(F.col("key"), None, ["*.json"]))


_ROOTS = {"s3://": "/mirror/s3", "gs://www.": "/mirror/gs-www/", "gs://": "/mirror/gs"}


@query(f"WITH {_U} SELECT page_id, CASE WHEN starts_with(path, 'gs://www.') THEN '/mirror/gs-www/' || substr(path, 10) WHEN starts_with(path, 's3://') THEN '/mirror/s3/' || substr(path, 6) WHEN starts_with(path, 'gs://') THEN '/mirror/gs/' || substr(path, 6) ELSE path END AS place FROM u")
def uri_remap(spark, sf_dir):
    """Where paths lie under a root map; the longest prefix counts."""
    return _uris(spark, sf_dir).select("page_id", paths.remap(F.col("path"), _ROOTS).alias("place"))


@query(f"WITH {_U} SELECT page_id, CASE WHEN starts_with(path, 's3://') THEN 's3a://' || substr(path, 6) WHEN starts_with(path, 'az://') THEN 'abfss://' || substr(path, 6) ELSE path END AS path FROM u")
def connector_paths(spark, sf_dir):
    """Paths as Spark's own readers take them."""
    return _uris(spark, sf_dir).select("page_id", paths.connector_path(F.col("path")).alias("path"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN a < 0 OR b < a OR b > total THEN 7 ELSE 0 END AS INTEGER) AS status FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) - 20 AS a, CAST(l_suppkey AS BIGINT) * 10 AS b, 1500 AS total FROM lineitem)")
def range_validation(spark, sf_dir):
    """Ranges [begin, end) of a file of 1,500 bytes: before its begin, ending before they begin, or beyond its end."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey").cast("bigint") - 20).alias("a"), (F.col("l_suppkey").cast("bigint") * 10).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", sizes.range_status(F.col("a"), F.col("b"), F.lit(1500)).alias("status"))


# ---- scalars


_TEXTS = ", ".join(f"({k}, '{v}')" for k, v in sizes.STATUS.items())


@query(f"SELECT c AS code, coalesce(t.x, '{sizes.NO_STATUS}') AS description FROM (SELECT DISTINCT CAST(user_id % 20 - 2 AS INTEGER) AS c FROM events) LEFT JOIN (VALUES {_TEXTS}) t(k, x) ON c = t.k")
def status_text(spark, sf_dir):
    return _table(spark, sf_dir, "events").select((F.col("user_id") % 20 - 2).cast("int").alias("code")).distinct().select("code", sizes.status_text(F.col("code")).alias("description"))


def _human(n: str) -> str:
    value, cases = n, f"{n} || '.00 B'"
    for u in sizes.UNITS[1:]:
        cases, value = f"CASE WHEN {value} // 1000 > 0 THEN printf('%.2f', {value} / 1000.0::DOUBLE) || ' {u}' ELSE {cases} END", f"({value} // 1000)"
    return cases


@query(f"SELECT l_orderkey, l_linenumber, {_human('n')} AS readable FROM (SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS BIGINT) * l_orderkey * CAST(l_partkey AS BIGINT) AS n FROM lineitem)")
def human_size(spark, sf_dir):
    """Products beyond a long, for which the SQL raises an error, are worked out as decimals."""
    order, part = (F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey"))
    wide = order.cast("decimal(19,0)") * order.cast("decimal(19,0)") * part.cast("decimal(19,0)")
    n = F.try_multiply(F.try_multiply(order, order), part)
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), F.when(n.isNull(), wide).alias("wide"))
    return rows.select("l_orderkey", "l_linenumber", sizes.human_size(F.col("n"), F.col("wide")).alias("readable"))


@query("SELECT DISTINCT l_linenumber AS workers, CAST(l_linenumber * 64 AS BIGINT) AS fds, greatest(8, 128 // l_linenumber) AS requests, greatest(CAST(l_linenumber AS BIGINT) * 524288, 2097152) AS block FROM lineitem")
def fd_budget(spark, sf_dir):
    w = F.col("l_linenumber").cast("bigint")
    rows = _table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return rows.select(F.col("l_linenumber").alias("workers"), sizes.fd_budget(w).alias("fds"), sizes.client_concurrency(F.lit(8).cast("bigint"), F.lit(64).cast("bigint"), w).alias("requests"), sizes.block_bytes(w * 524288).alias("block"))


@query("SELECT l_orderkey, l_linenumber, (512 - l_partkey % 512) % 512 AS padding FROM lineitem")
def alignment_padding(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sizes.padding(F.col("l_partkey"), ALIGNMENT).alias("padding"))


# ---- tensor files


def embedding_files(spark, sf_dir) -> str:
    """embeddings as tensor files, one a label; their folder."""
    return _once(spark, "tensors", sf_dir, lambda: _write_embedding_files(spark, sf_dir))


def _write_embedding_files(spark, sf_dir) -> str:
    folder = fresh_dir(spark, "tensors")
    rows = _table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.concat(F.lit("label-"), F.lpad(F.col("label").cast("string"), 5, "0"), F.lit(".safetensors")).alias("file"), F.col("vec_id").alias("idx"), F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("name"), F.lit("F32").alias("dtype"), F.array(F.size("embedding").cast("bigint")).alias("shape"), float_bytes(F.col("embedding")).alias("data"))
    write_tensor_files(vectors, folder)
    return folder


_E = "e AS (SELECT vec_id, embedding, label, 'vec_' || vec_id AS name, dense_rank() OVER (ORDER BY label) - 1 AS file_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS tensor_idx, CAST(len(embedding) AS BIGINT) AS n FROM embeddings)"


def _weighted(rows: DataFrame, *names: str) -> DataFrame:
    values = decode(rows.withColumn("n_bytes", F.length("data").cast("bigint")), "F32")
    sums = F.aggregate(F.transform("values", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return values.select(*names, "n_bytes", F.round(sums, 6).alias("weighted"))


@query(f'WITH {_E} SELECT file_id, tensor_idx, name, \'F32\' AS dtype, n AS n_elements, CAST(coalesce(sum(4 * n) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, 4 * n AS n_bytes FROM e')
def tensor_catalog(spark, sf_dir):
    rows = scan.tensor_catalog(spark, embedding_files(spark, sf_dir))
    return rows.select("file_id", "tensor_idx", "name", "dtype", sizes.element_count(F.col("shape")).alias("n_elements"), "start", (F.col("end") - F.col("start")).alias("n_bytes"))


@query(f"WITH {_E} SELECT file_id, count(*) AS n_tensors, true AS first_bytes_agree FROM e GROUP BY file_id")
def header_roundtrip(spark, sf_dir):
    """Header lengths by Spark's functions over the first 8 bytes of each file, against where the catalog's data begins."""
    catalog = scan.tensor_catalog(spark, embedding_files(spark, sf_dir))
    files = catalog.groupBy("file_id", "path").agg(F.count("*").alias("n_tensors"), F.max("data_base").alias("base"))
    first = scan.read_chunks(files.select("file_id", "path", F.lit(0).alias("chunk_idx"), F.lit(0).alias("offset"), F.lit(8).alias("size"))).select("file_id", sizes.little_endian(F.col("data")).alias("n"))
    return files.join(first, "file_id").select("file_id", "n_tensors", (F.col("n") + 8 == F.col("base")).alias("first_bytes_agree"))


@query(f"WITH {_E} SELECT name, 4 * n AS n_bytes, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 6) AS weighted FROM e")
def tensor_bytes(spark, sf_dir):
    """Payload of every tensor, with a sum that depends on each value and its place."""
    return _weighted(scan.tensors(spark, embedding_files(spark, sf_dir)), "name")


@query("SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norms FROM embeddings GROUP BY label")
def tensor_decode_f32(spark, sf_dir):
    """The flagship query: embeddings written to tensor files, scanned, decoded, and summed by label."""
    rows = decode(scan.tensors(spark, embedding_files(spark, sf_dir)), "F32")
    label = F.regexp_extract("path", "label-([0-9]+)", 1).cast("int")
    norm = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(norm), 6).alias("norms"))


@query("SELECT 'vec_' || vec_id AS name, label, CAST(len(embedding) AS BIGINT) AS n_elements, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id IN (20, 40)")
def tensor_name_filter(spark, sf_dir):
    """Names are pushed to the reader, which doesn't read other tensors."""
    rows = scan.tensors(spark, embedding_files(spark, sf_dir)).filter(F.col("name").isin("vec_20", "vec_40"))
    found = decode(rows, "F32")
    return found.select("name", F.regexp_extract("path", "label-([0-9]+)", 1).cast("int").alias("label"), F.size("values").cast("bigint").alias("n_elements"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query(f"WITH {_E} SELECT file_id, count(*) AS n_tensors, CAST(sum(4 * n) AS BIGINT) AS n_bytes FROM e GROUP BY file_id")
def multi_file_union(spark, sf_dir):
    """Files given one by one are read as one scan, in their order."""
    folder = embedding_files(spark, sf_dir)
    rows = scan.tensors(spark, [f.path for f in expand([folder])])
    return rows.groupBy("file_id").agg(F.count("*").alias("n_tensors"), F.sum(F.length("data")).cast("bigint").alias("n_bytes"))


@query(f"WITH {_E} SELECT file_id, tensor_idx, name, 4 * n AS n_bytes, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 6) AS weighted FROM e")
def chunk_metadata_join(spark, sf_dir):
    """Payload read as plain chunks and joined with the catalog."""
    catalog = scan.tensor_catalog(spark, embedding_files(spark, sf_dir))
    rows = catalog.select("file_id", "path", F.col("tensor_idx").alias("chunk_idx"), (F.col("data_base") + F.col("start")).alias("offset"), (F.col("end") - F.col("start")).alias("size"))
    return _weighted(scan.with_metadata(scan.read_chunks(rows), catalog), "file_id", "tensor_idx", "name")


# ---- checks of headers

#: Entries of invented headers: (file, name, dtype, shape, start, end).
ENTRIES = [
    ("good", "a", "F32", [2, 3], 0, 24), ("good", "b", "U8", [4], 24, 28), ("good", "c", "I64", [], 28, 36), ("good", "d", "F16", [0], 36, 36),
    ("overlap", "a", "U8", [10], 0, 10), ("overlap", "b", "U8", [10], 5, 15), ("holes", "a", "U8", [10], 0, 10), ("holes", "b", "U8", [10], 20, 30),
    ("mismatch", "a", "F32", [10], 0, 4), ("alien", "a", "ALIEN_TYPE_128", [1], 0, 4), ("late", "a", "U8", [4], 3, 7), ("reversed", "a", "U8", [4], 8, 4),
]
_ENTRY_SQL = "h(file, name, dtype, shape, s, e) AS (VALUES " + ", ".join(f"('{f}', '{n}', '{t}', CAST({x} AS BIGINT[]), CAST({s} AS BIGINT), CAST({e} AS BIGINT))" for f, n, t, x, s, e in ENTRIES) + ")"
_WIDTHS = "w(dtype, width) AS (VALUES " + ", ".join(f"('{x.name}', {x.width})" for x in DTYPES.values()) + ")"


_CATALOG_SQL = f"""{_ENTRY_SQL}, {_WIDTHS}, {_E}, k AS (SELECT * FROM h UNION ALL SELECT 'label-' || lpad(CAST(label AS VARCHAR), 5, '0'), name, 'F32', [n], before, before + 4 * n
FROM (SELECT *, CAST(coalesce(sum(4 * n) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM e))"""


def _entries(spark, sf_dir):
    """The invented entries and the whole catalog of files written from embeddings."""
    made = spark.createDataFrame(ENTRIES, "file string, name string, dtype string, shape array<bigint>, start bigint, end bigint")
    read = scan.tensor_catalog(spark, embedding_files(spark, sf_dir))
    return made.unionByName(read.select(F.regexp_extract("path", "(label-[0-9]+)", 1).alias("file"), "name", "dtype", "shape", "start", "end"))


@query(f"WITH {_CATALOG_SQL}, b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY file ORDER BY s, e, name), 0) AS before FROM k) SELECT file, name, CASE WHEN s < before THEN 'overlap' WHEN s > before THEN 'gap' ELSE 'ok' END AS verdict FROM b")
def validate_overlap_gap(spark, sf_dir):
    return validate.overlap_gap(_entries(spark, sf_dir))


@query(f"WITH {_CATALOG_SQL} SELECT file, name, CAST(coalesce(list_product(shape), 1) * width AS BIGINT) AS claimed, e - s AS reserved, CASE WHEN s > e THEN 'corrupt offset' WHEN coalesce(list_product(shape), 1) * width <> e - s THEN 'mismatch' ELSE 'ok' END AS verdict FROM k JOIN w ON k.dtype = w.dtype")
def validate_shape(spark, sf_dir):
    return validate.shapes(_entries(spark, sf_dir))


@query(f"WITH {_CATALOG_SQL} SELECT file, name, dtype FROM k WHERE dtype NOT IN (SELECT dtype FROM w)")
def validate_dtype(spark, sf_dir):
    return validate.unknown_types(_entries(spark, sf_dir))


def corrupt_files() -> dict[str, bytes]:
    """Small files, good and corrupt, by name."""
    import json

    def made(header, data: bytes = b"") -> bytes:
        body = header if isinstance(header, bytes) else json.dumps(header).encode()
        return len(body).to_bytes(8, "little") + body + data

    entry = lambda dtype, shape, *at: {"dtype": dtype, "shape": shape, "data_offsets": list(at)}
    return {
        "bad_dtype": made({"a": entry("ALIEN_TYPE_128", [1], 0, 4)}, bytes(4)),
        "bad_json": made(b'{"test": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]', bytes(4)),
        "bad_utf8": made(b"\xff\xfe{}"),
        "duplicate_keys": made(b'{"a":{"dtype":"U8","shape":[1],"data_offsets":[0,1]},"a":{"dtype":"U8","shape":[2],"data_offsets":[0,2]}}', bytes(2)),
        "empty_file": b"",
        "empty_header": made({}),
        "first_not_zero": made({"a": entry("U8", [4], 3, 7)}, bytes(7)),
        "holes": made({"A": entry("U8", [10], 0, 10), "B": entry("U8", [10], 20, 30)}, bytes(30)),
        "mismatch": made({"a": entry("F32", [10], 0, 4)}, bytes(4)),
        "no_offsets": made({"a": {"dtype": "U8", "shape": [1]}}, bytes(1)),
        "only_metadata": made({"__metadata__": {"k": "v"}}),
        "overlap": made({"A": entry("U8", [10], 0, 10), "B": entry("U8", [10], 5, 15)}, bytes(20)),
        "too_large": (104857601).to_bytes(8, "little") + b"{}",
        "trailing_bytes": made({"a": entry("U8", [1], 0, 1)}, bytes(9)),
        "truncated_body": made({"a": entry("U8", [100], 0, 100)}, bytes(10)),
        "truncated_header": (100).to_bytes(8, "little") + b"short",
        "unsorted": made({"Second": entry("U8", [10], 10, 20), "First": entry("U8", [10], 0, 10)}, b"\x01" * 10 + b"\x02" * 10),
    }


# What reading each of these headers must give.
CORRUPT = [
    ("bad_dtype", None, "Unsupported dtype"), ("bad_json", None, "not valid JSON"), ("bad_utf8", None, "not valid UTF-8"), ("duplicate_keys", 1, None), ("empty_file", None, "truncated or empty"), ("empty_header", 0, None),
    ("first_not_zero", None, "gap"), ("holes", None, "gap"), ("mismatch", None, "Shape claims 40 bytes, but offsets reserve 4"), ("no_offsets", None, "missing data_offsets"), ("only_metadata", 0, None), ("overlap", None, "overlaps with next tensor"),
    ("too_large", None, "exceeds limit"), ("trailing_bytes", 1, None), ("truncated_body", 1, None), ("truncated_header", None, "End of file"), ("unsorted", 2, None),
]
_PROBLEMS = "|".join(dict.fromkeys(p for _, _, p in CORRUPT if p))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', CAST({'NULL' if n is None else n} AS INTEGER), {'NULL' if p is None else repr(p)})" for f, n, p in CORRUPT) + ") AS t(file, n_tensors, problem)")
def validate_corrupt_files(spark, sf_dir):
    """What tasks find that read the header of each of these files."""
    folder = fresh_dir(spark, "corrupt")
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    for name, data in corrupt_files().items():
        with system.open_output_stream(f"{place}/{name}.safetensors") as out:
            out.write(data)

    def run(batches):
        for batch in batches:
            rows = []
            for name in batch.column("file").to_pylist():
                try:
                    with OpenFile(f"{folder}/{name}.safetensors") as f:
                        rows.append((name, len(header_of(f)), None))
                except TensorFileError as e:
                    rows.append((name, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["file", "n_tensors", "error"])

    found = spark.createDataFrame([(n,) for n in corrupt_files()], "file string").mapInArrow(run, "file string, n_tensors int, error string")
    return found.select("file", "n_tensors", F.nullif(F.regexp_extract("error", f"({_PROBLEMS})", 1), F.lit("")).alias("problem"))


def typed_file(spark) -> str:
    """One tensor of each element type, some without elements and a scalar, in a file of the shared folder."""
    folder = fresh_dir(spark, "types")
    rows, i = [], 0
    for x in DTYPES.values():
        data = bytes(range(256))[: 32 * x.width] if x.width > 1 else bytes(range(256))
        for name, shape, d in ((f"full_{x.name}", [len(data) // x.width], data), (f"none_{x.name}", [3, 0], b""), (f"scalar_{x.name}", [], data[: x.width])):
            rows.append(("types.safetensors", i, name, x.name, shape, d))
            i += 1
    write_tensor_files(spark.createDataFrame(rows, "file string, idx bigint, name string, dtype string, shape array<bigint>, data binary"), folder)
    return folder


# Exponent and mantissa bits of float types.
_FLOATS = "f(dtype, eb, mb) AS (VALUES ('F64', 11, 52), ('F32', 8, 23), ('C64', 8, 23), ('F16', 5, 10), ('BF16', 8, 7), ('F8_E4M3', 4, 3), ('F8_E5M2', 5, 2))"
_DECODED = f"""{_WIDTHS}, {_FLOATS}, x AS (SELECT dtype, CASE dtype WHEN 'C64' THEN 4 ELSE width END AS w, CASE WHEN width = 1 THEN 256 ELSE 32 * width END AS total FROM w WHERE dtype <> 'F4'),
y AS (SELECT dtype, w, unnest(range(total // w)) AS pos FROM x), z AS (SELECT dtype, w, pos, unnest(range(w)) AS j FROM y),
u AS (SELECT dtype, w, pos, sum(CAST(pos * w + j AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(8 * j AS INTEGER))) AS u FROM z GROUP BY dtype, w, pos),
p AS (SELECT u.*, eb, mb, u // (CAST(1 AS HUGEINT) << mb) % (CAST(1 AS HUGEINT) << eb) AS e, u % (CAST(1 AS HUGEINT) << mb) AS m, CASE WHEN u >= (CAST(1 AS HUGEINT) << CAST(8 * w - 1 AS INTEGER)) THEN -1 ELSE 1 END AS sign, (CAST(1 AS HUGEINT) << (eb - 1)) - 1 AS bias FROM u LEFT JOIN f ON u.dtype = f.dtype),
q AS (SELECT *, CASE WHEN dtype = 'F8_E8M0' AND u = 255 OR dtype = 'F8_E4M3' AND u % 128 = 127 THEN 'nan' WHEN dtype <> 'F8_E4M3' AND e = 2 * bias + 1 THEN CASE WHEN m <> 0 THEN 'nan' WHEN sign < 0 THEN '-inf' ELSE 'inf' END ELSE '' END AS special FROM p)
SELECT 'full_' || dtype AS name, CAST(pos AS INTEGER) AS pos, special, CASE WHEN special <> '' THEN NULL WHEN dtype = 'F8_E8M0' THEN pow(2.0, CAST(u AS INTEGER) - 127) WHEN dtype = 'BOOL' THEN CAST(u <> 0 AS INTEGER)
WHEN dtype LIKE 'I%' THEN CAST(CASE WHEN sign < 0 THEN u - (CAST(1 AS HUGEINT) << CAST(8 * w AS INTEGER)) ELSE u END AS DOUBLE) WHEN dtype LIKE 'U%' THEN CAST(u AS DOUBLE)
WHEN e = 0 THEN sign * (CAST(m AS DOUBLE) / pow(2.0, mb)) * pow(2.0, CAST(1 - bias AS INTEGER)) ELSE sign * (1 + CAST(m AS DOUBLE) / pow(2.0, mb)) * pow(2.0, CAST(e - bias AS INTEGER)) END AS value FROM q"""


@query(f"WITH {_DECODED}")
def decode_all_dtypes(spark, sf_dir):
    """Every element type decoded from all bytes, a row for each element; complex numbers give two."""
    rows, found = scan.tensors(spark, typed_file(spark)).filter(F.col("name").startswith("full_")), None
    for x in DTYPES.values():
        if x.decode is None:
            continue
        one = decode(rows, x.name)
        numbers = F.flatten(F.transform("values", lambda v: F.array(v["re"], v["im"]))) if x.name == "C64" else F.col("values")
        one = one.select("name", F.posexplode(F.transform(numbers, lambda v: v.cast("double"))).alias("pos", "v"))
        found = one if found is None else found.unionByName(one)
    special = F.when(F.isnan("v"), "nan").when(F.col("v") == float("inf"), "inf").when(F.col("v") == float("-inf"), "-inf").otherwise("")
    return found.select("name", "pos", special.alias("special"), F.when(special == "", F.col("v")).alias("value"))


@query(f"WITH {_WIDTHS} SELECT 'none_' || dtype AS name, dtype, CAST(2 AS INTEGER) AS n_dims, CAST(0 AS BIGINT) AS n_elements, CAST(0 AS INTEGER) AS n_bytes FROM w UNION ALL SELECT 'scalar_' || dtype, dtype, 0, 1, width FROM w")
def zero_size_tensors(spark, sf_dir):
    rows = scan.tensors(spark, typed_file(spark)).filter(~F.col("name").startswith("full_"))
    return rows.select("name", "dtype", F.size("shape").alias("n_dims"), sizes.element_count(F.col("shape")).alias("n_elements"), F.length("data").alias("n_bytes"))


# ---- copies


def _remote(spark, sf_dir) -> tuple[str, dict[str, str]]:
    folder = embedding_files(spark, sf_dir)
    return "s3://models/embeddings", {"s3://models/embeddings": folder}


@query("SELECT 'label-' || lpad(CAST(label AS VARCHAR), 5, '0') || '.safetensors' AS file, count(*) AS n_tensors FROM embeddings WHERE label % 2 = 0 GROUP BY label")
def pull_files_query(spark, sf_dir):
    """Files with even labels pulled to another shared folder and catalogued there."""
    source, roots = _remote(spark, sf_dir)
    target = remapped(fresh_dir(spark, "pulled"), None)
    local = "/" + target[5:].lstrip("/") if target.startswith("file:") else target
    pull_files(source, local, allow=["*[02468].safetensors"], roots=roots, spark=spark)
    rows = scan.tensor_catalog(spark, local)
    return rows.groupBy(F.regexp_extract("path", "([^/]+)$", 1).alias("file")).agg(F.count("*").alias("n_tensors"))


QUERIES["pull_files"] = QUERIES.pop("pull_files_query")
ORACLE_SQL["pull_files"] = ORACLE_SQL.pop("pull_files_query")


@query("SELECT CAST(count(DISTINCT label) AS BIGINT) AS n_first, CAST(0 AS BIGINT) AS n_second, true AS complete FROM embeddings")
def materialize_idempotent(spark, sf_dir):
    """A folder is filled once; a second visit finds it whole and copies nothing."""
    source, roots = _remote(spark, sf_dir)
    counts = []
    with tempfile.TemporaryDirectory(prefix="loomscan-copy-") as folder:
        for _ in range(2):
            with Materialized(source, f"{folder}/model", roots) as m:
                counts.append(m.pull())
        done = Path(folder, "model", Materialized.MARK).exists()
    return spark.createDataFrame([(counts[0], counts[1], done)], "n_first bigint, n_second bigint, complete boolean")
