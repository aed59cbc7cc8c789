"""Matrices in ``.npy`` files (§2: S12): a data source whose parts are ranges of rows, and a writer of files of bounded size.

Files are opened through Arrow's file systems, so that a path is local (or a
shared mount) or a URI of a store that Arrow knows.
"""

from __future__ import annotations

import ast
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftgrain.session import checkpointed

SCHEMA = "file string, row long, vector array<double>"
#: Rows of a part that is read, and of a file that is written.
PART_ROWS, FILE_ROWS = 65_536, 65_536
#: What a header can be long at most; it is read before the rows.
HEADER = 65_536


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(raw: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """Kind, shape and place of the first row; only matrices in the order of rows are read."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = raw[6] > 1
    size = int.from_bytes(raw[8:12] if wide else raw[8:10], "little")
    begin = 12 if wide else 10
    named = ast.literal_eval(raw[begin : begin + size].decode("latin1"))
    kind, shape = np.dtype(named["descr"]), tuple(named["shape"])
    if len(shape) != 2 or named["fortran_order"] or kind.kind not in "fiu":
        raise ValueError(f"a matrix of numbers by rows is wanted, not {named}")
    return kind, shape, begin + size


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, kind: str, width: int, begin: int):
        self.path, self.first, self.last, self.kind, self.width, self.begin = path, first, last, kind, width, begin


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", PART_ROWS))

    def partitions(self) -> list[Range]:
        """Headers alone are read here."""
        store, path = located(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path))
        out = []
        for f in sorted((x for x in files if x.is_file and x.base_name.endswith(".npy")), key=lambda x: x.path):
            with store.open_input_file(f.path) as source:
                kind, (n, width), begin = header(source.read(HEADER))
            if f.size < begin + n * width * kind.itemsize:
                raise ValueError(f"{f.path}: shorter than its header says")
            out += [Range(f.path, i, min(i + self.rows, n), kind.str, width, begin) for i in range(0, n, self.rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        kind, step = np.dtype(part.kind), max(1, (8 << 20) // max(1, part.width * 8))
        with store.open_input_file(part.path) as source:
            source.seek(part.begin + part.first * part.width * kind.itemsize)
            for i in range(part.first, part.last, step):
                n = min(step, part.last - i)
                x = np.frombuffer(source.read(n * part.width * kind.itemsize), kind).astype(np.float64)
                edges = pa.array(np.arange(n + 1, dtype=np.int32) * part.width)
                name = part.path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(i, i + n)), pa.ListArray.from_arrays(edges, pa.array(x))], ["file", "row", "vector"])


class Matrices(DataSource):
    """``spark.read.format("npy").load(path)``: a file or a folder of them; option ``rows``: of a part."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


def read_npy(spark: SparkSession, path: str, rows: int = PART_ROWS) -> DataFrame:
    """file, row (in its file, from 0) and vector."""
    spark.dataSource.register(Matrices)
    return spark.read.format("npy").option("rows", rows).load(path)


def write_npy(df: DataFrame, vector: str, path: str, rows: int = FILE_ROWS) -> DataFrame:
    """Writes files of at most ``rows`` rows into a folder that all machines share; gives file, row and the other columns of each row written.

    A task that runs again writes the same names. Vectors of a file are of one
    length; null vectors raise.
    """
    names = [c for c in df.columns if c != vector]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in names]).schema.fields]
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = located(path)
        store.create_dir(folder, recursive=True)
        held, n, number = [], 0, 0

        def out(batch: pa.Table) -> Iterator[pa.RecordBatch]:
            column = batch.column(vector).combine_chunks()
            if column.null_count:
                raise ValueError("a vector is null")
            body = io.BytesIO()
            np.save(body, column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))
            name = f"part-{TaskContext.get().partitionId():05d}-{number:05d}.npy"
            with store.open_output_stream(f"{folder}/{name}") as sink:
                sink.write(body.getvalue())
            yield from batch.select(names).add_column(0, "row", pa.array(np.arange(len(batch)))).add_column(0, "file", pa.array([name] * len(batch), pa.string())).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= rows:
                whole = pa.Table.from_batches(held)
                yield from out(whole.slice(0, rows))
                number += 1
                held, n = whole.slice(rows).to_batches(), n - rows
        if n:
            yield from out(pa.Table.from_batches(held))

    return checkpointed(df.mapInArrow(write, ", ".join(["file string", "row long", *fields])))


def read_gzip_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """§2: S8. Objects of gzipped JSON lines; bytes that aren't UTF-8 are left out, and lines that still don't parse dropped.

    Such a file can't be split, so its rows are dealt out after reading.
    """
    marks = "\N{REPLACEMENT CHARACTER}"
    lines = spark.read.text(path).repartition(spark.sparkContext.defaultParallelism)
    clean = F.replace(F.make_valid_utf8("value"), F.lit(marks), F.lit(""))
    parsed = lines.select(F.from_json(clean, f"{schema}, _wrong string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_wrong"}).alias("z"))
    return parsed.filter("z is not null and z._wrong is null").select("z.*").drop("_wrong")
