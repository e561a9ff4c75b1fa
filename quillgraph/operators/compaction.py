"""Many tiny chunk files into few well-sized ones.

1. Name: every file is led back to the chunk it was written for, whatever stray name it has.
2. Repeats: files of one chunk whose bodies read the same are one record; the smallest id stays.
3. Schedule: records are hashed to tasks of some FILES output files. A task's records come longest
   first, and each goes to the file with the least load so far (a heap).
4. Write: the task streams its records through pyarrow to its files, as they come; it holds at most
   BUFFER bytes a file, and never more than about 1.5 FILES files are open. Names carry the attempt.
5. Publish: what was written is read back and must have the count, the bytes and the checksum of the
   records that went in; then the manifest appears under its final name in one rename.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Table, delete, new_path

#: Content bytes of an output file, at least so many where there is little content; files a task; bytes held for each.
TARGET_BYTES, LEAST_BYTES, FILES, BUFFER = 96 << 20, 4 << 20, 8, 4 << 20
#: Files without an id get one from here on.
NAMELESS = 1 << 62


@dataclass(frozen=True)
class Names:
    """What tells the chunk of a file: patterns of stray folders, of a name with its stray parts ($1 folder, $2 stem),
    of a chunk's own path, and of the domain in a source path; domains in ``plain`` have no folder of their own."""

    folders: str = r"^(?:\./|/|(?:_staging|_?lost\+found|retry-\d+|\.trash|tmp)/)+"
    name: str = r"^((?:.*/)?)\.?([^/]*?)(?:-\d+~| ?\((?:copy|\d+)\)| copy)?\.txt(?:~|\.(?:bak|tmp|swp|orig|old|part))*$"
    own: str = r"^(?:[^/_.][^/]*/)?[^/_.][^/]*/\d+\.txt$|(?:^|/)_[^/]*\.txt$"
    domain: str = r"^/[^/]*/[^/]*/([^/]+)/[^/]+$"
    plain: tuple[str, ...] = ("inbox",)


#: A block between two lines of three hyphens at the start, of any number of lines; possessive, so it is scanned once.
BLOCK = r"^\uFEFF?---[ \t]*\r?\n(?:(?!---[ \t]*+(?:\r?\n|\z))[^\n]*+\n)*+---[ \t]*(?:\r?\n|\z)"


def front_of(content: Column) -> Column:
    """The front matter of a stored chunk, '' where there is none; a block without a type is a part of the body."""
    block = F.regexp_extract(content, BLOCK, 0)
    return F.when(block.rlike(r"(?m)^type:"), block).otherwise("")


def body_of(content: Column) -> Column:
    """The content behind the front matter, if there is any."""
    rest = F.substring(content, F.char_length(front_of(content)) + 1, F.char_length(content))
    return F.regexp_replace(rest, r"^\uFEFF", "")


def front_value(content: Column, key: str) -> Column:
    """A value of the front matter, '' where there is none."""
    return F.trim(F.regexp_extract(front_of(content), rf"(?m)^{key}:[ \t]*([^\r\n]*)", 1))


def chunk_path(path: Column, content: Column, names: Names = Names()) -> Column:
    """The path of the chunk a file was written for.

    Separators, stray folders and stray endings are undone. If that leaves no chunk name, the front
    matter's source and position tell it; if there is none either, the cleaned path stands.
    """
    p = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, names.folders, ""), names.name, "$1$2.txt")
    src, pos = front_value(content, "source"), front_value(content, "position")
    parts = F.split(src, "/")
    stem = F.regexp_replace(F.lower(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")), r"[^a-z0-9._-]", "")
    domain = F.regexp_extract(src, names.domain, 1)
    told = F.concat(
        F.when((domain == "") | domain.isin(*names.plain), "").otherwise(F.concat(domain, F.lit("/"))),
        stem, F.lit("/"), F.when(F.length(pos) < 2, F.lpad(pos, 2, "0")).otherwise(pos), F.lit(".txt"),
    )
    return F.when(~p.rlike(names.own), F.when((src != "") & pos.rlike(r"^\d+$"), told).otherwise(p)).otherwise(p)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def on_screen(body: Column) -> Column:
    """A body as it reads on a screen: one form for composed letters, line ends and blanks that show
    nothing (behind a line, before the first and behind the last line, of no width)."""
    # only text with letters beyond U+02FF can change under NFC, so only that leaves the JVM
    b = F.coalesce(_nfc(F.when(body.rlike(r"[^\x{0}-\x{2FF}]"), body)), body)
    b = F.regexp_replace(b, r"[\u200B-\u200D\u2060\uFEFF\u00AD]", "")
    b = F.regexp_replace(b, r"[\u00A0\u2007\u202F]", " ")
    b = F.regexp_replace(F.regexp_replace(b, r"[ \t\r\f\u000B]+\n", "\n"), r"\r", "\n")
    return F.regexp_replace(F.regexp_replace(b, r"^[ \t\n]*\n", ""), r"\s+$", "")


def identify(files: DataFrame, names: Names = Names()) -> DataFrame:
    """(file_id, chunk, size, sum, body_hash) of each file with a body: its chunk's path, content bytes, a checksum of
    chunk and content, and a hash of chunk and body on screen."""
    shown = files.select("file_id", "content", chunk_path(F.col("path"), F.col("content"), names).alias("chunk"), on_screen(body_of(F.col("content"))).alias("shown"))
    return shown.where(F.col("shown") != "").select(
        "file_id", "chunk", F.octet_length("content").cast("long").alias("size"), F.xxhash64("chunk", "content").alias("sum"), F.unhex(F.sha2(F.concat_ws("\n", "chunk", "shown"), 256)).alias("body_hash")
    )


#: Columns of an output file.
_RECORD = "path string, content string, file_id long"


class Compaction:
    """What ``compact`` made: ``manifest`` (a DataFrame), ``repeats`` (a DataFrame) and ``path``."""

    def __init__(self, path: str, manifest: DataFrame, repeats: DataFrame):
        self.path, self.manifest, self.repeats = path, manifest, repeats


class _Balanced:
    """Open output files, and the heap of their loads."""

    def __init__(self, system, root: str, part: int, count: int):
        import uuid

        import pyarrow.parquet as pq

        schema = pa.schema([("path", pa.string()), ("content", pa.string()), ("file_id", pa.int64())])
        self.names = [f"part-{part:06d}-{k:02d}-{uuid.uuid4().hex[:12]}.parquet" for k in range(count)]
        self.writers = [pq.ParquetWriter(f"{root}/{n}", schema, filesystem=system, compression="zstd") for n in self.names]
        self.records, self.bytes = [0] * count, [0] * count
        self.rows: list[list[pa.Table]] = [[] for _ in range(count)]
        self.held = [0] * count
        self.heap = [(0, k) for k in range(count)]

    def put(self, rows: pa.Table, sizes: np.ndarray) -> None:
        """Each record, longest first, to the least loaded file."""
        to = np.zeros(len(sizes), np.int64)
        if len(self.heap) > 1:
            for i, s in enumerate(sizes.tolist()):
                load, k = self.heap[0]
                heapq.heapreplace(self.heap, (load + s, k))
                to[i] = k
        for k in np.unique(to).tolist():
            mine = to == k
            n = int(sizes[mine].sum())
            self.rows[k].append(rows.filter(pa.array(mine)))
            self.records[k] += int(mine.sum())
            self.bytes[k] += n
            self.held[k] += n
            if self.held[k] >= BUFFER:
                self.flush(k)

    def flush(self, k: int) -> None:
        if self.rows[k]:
            self.writers[k].write_table(pa.concat_tables(self.rows[k]))
            self.rows[k], self.held[k] = [], 0

    def close(self) -> list[tuple[str, int, int]]:
        for k, w in enumerate(self.writers):
            self.flush(k)
            w.close()
        return list(zip(self.names, self.records, self.bytes))


def _writer(out: str, files_of: dict[int, int]):
    """Streams the records of a task to its files.

    Rows come longest first, then by id and mark. A row without mark announces a record: its id and
    path. The marked row right behind it holds the record's content; all others are repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), None
        told_id, told_mark, told_path = None, 1, None  # of the row before
        for b in batches:
            if not b.num_rows:
                continue
            ids, marks, paths, sizes = b["file_id"].to_numpy(), b["mark"].to_numpy(), b["path"], b["size"].to_numpy()
            before_id = np.r_[told_id if told_id is not None else 0, ids[:-1]]
            before = np.r_[told_mark, marks[:-1]]
            keep = (marks == 1) & (before == 0) & (before_id == ids)
            at = np.nonzero(keep)[0]
            if len(at):
                named = pa.concat_arrays([pa.array([told_path], pa.string()), paths.cast(pa.string())]).take(pa.array(at))  # the row before, one on
                if made is None:
                    system, root = fs.FileSystem.from_uri(out)
                    system.create_dir(root, recursive=True)
                    made = _Balanced(system, root, part, files_of[part])
                made.put(pa.table({"path": named, "content": b["content"].take(pa.array(at)).cast(pa.string()), "file_id": pa.array(ids[at])}), sizes[at])
            told_id, told_mark, told_path = int(ids[-1]), int(marks[-1]), paths[-1].as_py()
        done = made.close() if made else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
            names=["file", "records", "content_bytes"],
        )

    return run


def _checksum(df: DataFrame) -> tuple[int, int, int]:
    """Count, content bytes and an order-free checksum of (path, content) records."""
    r = df.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "content")), F.lit(0))
    ).first()
    return tuple(r)


def compact(files: DataFrame, out: str | None = None, *, target_bytes: int = TARGET_BYTES, names: Names = Names()) -> Compaction:
    """Write every chunk record of ``files`` exactly once, in files of some ``target_bytes`` of content.

    ``files``: (file_id, path, content), extra columns are not read. A record is a chunk and a body
    as it reads on a screen; of the files that hold it the one of smallest ``file_id`` gives the
    content. Files without a body (null, empty, blank or nothing behind the front matter) hold no
    record. Exact repeats of a row count once, files with a null id too; other rows must not share an
    id. An empty table makes an empty manifest. ``out``: a new folder, by default in the shared
    folder. The folder holds ``manifest.json`` only if all records are there; without it readers
    must take the folder for unfinished. ``repeats`` are the files with a body that the published
    files do not hold. Where there is little content, files are smaller, so that several tasks write.
    """
    spark = files.sparkSession
    out = out or new_path(spark, "compact")
    with_id = files.select("file_id", "path", "content").where(F.col("file_id").isNotNull())
    nameless = files.select("path", "content").where(F.col("file_id").isNull()).distinct()
    own = F.pmod(F.xxhash64("path", "content"), F.lit(NAMELESS >> 1)) + NAMELESS  # larger than real ids
    files = with_id.unionByName(nameless.select(own.alias("file_id"), "path", "content"))
    known = Table(identify(files, names), "files")
    kept = Table(known.df.groupBy("body_hash").agg(F.min(F.struct("file_id", "chunk", "size", "sum")).alias("r")).select("r.*"), "kept")

    # the schedule: records to tasks by a hash of the id, of some FILES files each; one row a task reaches the driver
    total, expected = kept.df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.struct(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.bit_xor("sum"), F.lit(0)))).first()
    tasks = max(1, ceil(total / (FILES * target_bytes)), min(spark.sparkContext.defaultParallelism, total // (2 * LEAST_BYTES)))
    each = min(target_bytes, max(LEAST_BYTES, total // (2 * tasks)))
    task = F.pmod(F.xxhash64("file_id"), F.lit(tasks)).cast("int").alias("task")  # repeated rows share it
    large = F.col("size") >= each  # fills a file of its own
    loads = kept.df.groupBy(task).agg(F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("small"), F.count_if(large).alias("large"))
    files_of = {r.task: max(1, round(r.small / each) + r.large) for r in loads.collect()}
    # contents move once: what is a record, and its path, is told to the writers by rows of their own in the same order
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size")
    rows = files.select("file_id", size, F.lit(None).cast("string").alias("path"), "content", F.lit(1).alias("mark"))
    told = kept.df.select("file_id", "size", F.col("chunk").alias("path"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("mark"))
    staged = rows.unionByName(told).withColumn("task", task).repartitionById(tasks, F.col("task")).sortWithinPartitions(F.desc("size"), "file_id", "mark")
    staging = f"{out}/data"
    made = Table(staged.select("size", "file_id", "mark", "path", "content").mapInArrow(_writer(staging, files_of), "file string, records long, content_bytes long"), "made").df

    # verify: a lost attempt may have left files that no row of ``made`` names
    written = [r.file for r in made.select("file").collect()]  # one name a file
    if written:
        found = _checksum(spark.read.schema(_RECORD).parquet(*(f"{staging}/{n}" for n in written)))
        if tuple(found) != tuple(expected):
            raise RuntimeError(f"the files hold {found}, the records are {tuple(expected)}")
    elif expected[0]:
        raise RuntimeError("nothing was written")
    _publish(spark, out, {"records": expected[0], "content_bytes": expected[1], "checksum": expected[2], "files": sorted(written)})
    ids = read_compacted(spark, out).select("file_id")
    repeats = Table(known.df.select("file_id").where(F.col("file_id") < NAMELESS).join(ids, "file_id", "left_anti").distinct(), "repeats").df
    known.drop()
    kept.drop()
    return Compaction(out, made, repeats)


def _publish(spark, out: str, manifest: dict) -> None:
    """Make the manifest appear in one rename."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = path(f"{out}/.manifest.json.draft")
    stream = system.create(draft, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not system.rename(draft, path(f"{out}/manifest.json")):
        delete(spark, draft.toString())
        raise RuntimeError(f"{out} has a manifest already")


def read_compacted(spark, out: str) -> DataFrame:
    """(path, content, file_id) of a published folder; only the files that its manifest names."""
    text = "".join(r.value for r in spark.read.text(f"{out}/manifest.json").collect())
    names = json.loads(text)["files"]
    schema = _RECORD
    return spark.read.schema(schema).parquet(*(f"{out}/data/{n}" for n in names)) if names else spark.createDataFrame([], schema)
