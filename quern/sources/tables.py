"""Reading tables with fixed schemas, and checks that a table keeps its contract."""

from __future__ import annotations

import contextlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.ordered import numbered
from quern.sources.scratch import exists, stored

#: Values of a NumPy array that are held at once, values that are dealt to tasks as one, and so many of these for a task.
CHUNK = 1 << 18
SPAN = 1 << 20
TASK_SPANS = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header, JSON lines or Parquet; a schema is applied, never inferred, if given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind in ("json", "parquet"):
        return getattr(reader, kind)(path)
    raise ValueError(f"no reader for {kind}")


def cached_parquet(spark: SparkSession, path: str, cache: str, schema: StructType | str) -> DataFrame:
    """A CSV file as Parquet: converted on first use, read from then on. An unfinished conversion is not taken for a
    cache, since Spark marks a finished one."""
    if not exists(spark, cache + "/_SUCCESS"):
        read(spark, path, "csv", schema).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def score_pool(spark: SparkSession, files: dict[str, tuple[str, str]], id: str = "id") -> DataFrame:
    """Score files of several kinds as one long table ``(id, model, score)``; ``files`` maps a model to (path, kind).
    The one numeric column beside the id is the score."""
    out = None
    for model, (path, kind) in sorted(files.items()):
        df = spark.read.option("header", True).option("inferSchema", True).csv(path) if kind == "csv" else read(spark, path, kind)
        rest = [c for c, t in df.dtypes if c != id and t in ("double", "float", "int", "bigint")]
        if len(rest) != 1:
            raise ValueError(f"{model}: one numeric column is needed, found {rest}")
        part = df.select(F.col(id).cast("bigint").alias("id"), F.lit(model).alias("model"), F.col(rest[0]).cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """``(file, hash)``: the first 16 hex digits of the SHA-256 of each file below ``path``; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"))


def _by_arrow(spark: SparkSession, path: str) -> tuple[pafs.FileSystem, str] | None:
    """``path`` on the file system that Spark takes it to be on, if Arrow knows that too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return pafs.FileSystem.from_uri(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())
    except (pa.ArrowException, OSError):
        return None


def _npy(out: BinaryIO, n: int, values: Callable[[np.ndarray], np.ndarray]) -> None:
    np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (n,)})
    for first in range(0, n, CHUNK):
        out.write(values(np.arange(first, min(n, first + CHUNK))).astype("<f8").tobytes())


class _Created:
    """A new file on a file system that only Spark knows, to be written from the driver; some 25 MB a second."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)

    def write(self, data: bytes) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.out.close()


def save_npy(spark: SparkSession, path: str, n: int, values: Callable[[np.ndarray], np.ndarray] | dict[str, Callable[[np.ndarray], np.ndarray]]) -> None:
    """An array of ``n`` numbers as an .npy file, or several by name as an .npz file. ``values`` makes them from their places, some
    CHUNK at a time, which is all that is held of them."""
    if found := _by_arrow(spark, path):
        found[0].create_dir(found[1].rpartition("/")[0], recursive=True)
    with contextlib.closing(found[0].open_output_stream(found[1], compression=None) if found else _Created(spark, path)) as out:
        if callable(values):
            return _npy(out, n, values)
        with zipfile.ZipFile(out, "w", allowZip64=True) as members:
            for name, make in values.items():
                with members.open(f"{name}.npy", "w", force_zip64=True) as member:
                    _npy(member, n, make)


def _header(f: BinaryIO, name: str) -> tuple[int, np.dtype]:
    """Number and kind of the values of an array, of which ``f`` is read up to the first."""
    version = np.lib.format.read_magic(f)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) != 1 or kind.hasobject:
        raise ValueError(f"{name}: a plain array of one dimension is needed, found {kind} of shape {shape}")
    return shape[0], kind


def _spans(f: BinaryIO, path: str) -> Iterator[tuple[str, str | None, int | None, str, int, int]]:
    """``model, member, at, kind, first, n`` of up to SPAN values each of a NumPy file: ``at`` is the byte they begin at. A compressed
    member is one span, without ``at``. Others are read to their end, as only the whole tells whether a member is damaged."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    def parts(model: str, member: str | None, at: int, n: int, kind: np.dtype):
        for first in range(0, n, SPAN):
            yield model, member, at + first * kind.itemsize, kind.str, first, min(SPAN, n - first)

    magic = f.read(4)
    f.seek(0)
    if not magic.startswith(b"PK"):
        n, kind = _header(f, stem)
        yield from parts(stem, None, f.tell(), n, kind)
        return
    with zipfile.ZipFile(f) as members:
        for info in members.infolist():
            model = f"{stem}/{info.filename.removesuffix('.npy')}"
            with members.open(info) as member:
                n, kind = _header(member, model)
                head = member.tell()
                if info.compress_type != zipfile.ZIP_STORED:
                    yield model, info.filename, None, kind.str, 0, n
                    continue
                while member.read(CHUNK):
                    pass
            f.seek(info.header_offset + 26)
            name, extra = struct.unpack("<HH", f.read(4))
            yield from parts(model, info.filename, info.header_offset + 30 + name + extra + head, n, kind)


def _values(f: BinaryIO, model: str, member: str | None, at: int | None, kind: str, first: int, n: int) -> Iterator[pa.RecordBatch]:
    """The values of a span by CHUNK."""
    with contextlib.ExitStack() as open_files:
        if at is None:
            f = open_files.enter_context(open_files.enter_context(zipfile.ZipFile(f)).open(member))
            _header(f, model)
        else:
            f.seek(at)
        for start in range(first, first + n, CHUNK):
            size = min(CHUNK, first + n - start)
            found = f.read(size * np.dtype(kind).itemsize)
            if len(found) < size * np.dtype(kind).itemsize:
                raise ValueError(f"{model} ends before its values do")
            score = np.frombuffer(found, kind).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + size)), pa.repeat(model, size), pa.array(score, from_pandas=True)], ["place", "model", "score"])
        if at is None:
            f.read()  # to its end, where it is checked


def npy_members(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """``(id, model, score)`` of NumPy files (.npy, or .npz with one member an array) below ``path``: values stand in the order
    of ``ids``. Tasks read spans of files, so none holds a file; a compressed member is read by one task, piece by piece. On file
    systems that only Spark can open, a file is held by the task that reads it."""
    spans_of, values_of = "path string, model string, member string, at bigint, kind string, first bigint, n bigint", "place bigint, model string, score double"
    opened = lambda at: (lambda found: found[0].open_input_file(found[1]))(pafs.FileSystem.from_uri(quote(at, safe="/:@")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column("path").to_pylist():
                with opened(at) as f:
                    yield from ready([(at, *s) for s in _spans(f, at)])

    def ready(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in spans_of.split(", ")])

    def read_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for span in b.to_pylist():
                with opened(span.pop("path")) as f:
                    yield from _values(f, **span)

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for span in list(_spans(io.BytesIO(content), at)):
                    yield from _values(io.BytesIO(content), *span)

    files = spark.read.format("binaryFile").load(path)
    if _by_arrow(spark, path):
        spans = stored(files.select("path").mapInArrow(listed, spans_of), "spans")
        n, cores = spans.count(), spark.sparkContext.defaultParallelism
        scores = spans.repartition(max(1, min(n, max(cores, n // TASK_SPANS)))).mapInArrow(read_spans, values_of)
    else:
        scores = files.select("path", "content").mapInArrow(read_files, values_of)
    # Spark takes scores to be as small as the list of spans, and would broadcast them.
    return numbered(ids.select("id").distinct(), "id", "place").join(scores.hint("merge"), "place").select("id", "model", "score")


def save_json(spark: SparkSession, path: str, value: object) -> None:
    """One JSON document as a text file."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def cached_features(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of features with the names of its columns beside it, made on first use and again if either cannot be read or
    they disagree."""
    try:
        names, found = load_json(spark, path + "/names"), spark.read.parquet(path + "/table")
        if found.columns == names:
            return found
    except (AnalysisException, ValueError):
        pass
    made = make()
    made.write.mode("overwrite").parquet(path + "/table")
    save_json(spark, path + "/names", made.columns)
    return spark.read.parquet(path + "/table")


def scattered(rows: DataFrame, parts: Sequence[DataFrame], column: str, default: float) -> DataFrame:
    """``rows(id)`` with ``column`` from parts of disjoint ids, and a default where no part has the id."""
    every = reduce(DataFrame.unionByName, (p.select("id", column) for p in parts))
    return rows.join(every, "id", "left").withColumn(column, F.coalesce(column, F.lit(default)))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, rows)``: how many rows break each rule; a rule that is null for a row is broken."""
    counts = [F.struct(F.lit(k).alias("rule"), F.count_if(~F.coalesce(v, F.lit(False))).alias("rows")) for k, v in rules.items()]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, which fails when a row that breaks a rule is read."""
    for name, rule in rules.items():
        df = df.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"a row breaks the rule: {name}")).cast("boolean")))
    return df


def aligned(ids: DataFrame, scores: DataFrame, id: str = "id") -> DataFrame:
    """``ids`` with their scores; a repeated id in ``scores`` or an id without a score is an error."""
    if not scores.groupBy(id).count().where("count > 1").isEmpty():
        raise ValueError("scores repeat an id")
    joined = ids.select(id).join(scores, id, "left")
    if not joined.where(F.col("score").isNull()).isEmpty():
        raise ValueError("an id has no score")
    return joined


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*names)
