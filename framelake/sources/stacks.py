"""Stacks in files: reading with a decoder (ours: .npy), and writing frames to Parquet."""

from __future__ import annotations

import ast
import io
import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

EPOCH = datetime(2024, 1, 1)
Decoder = Callable[[bytes], Iterator[tuple[int, datetime, int, int, str, np.ndarray]]]


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def decode_npy(data: bytes) -> Iterator[tuple[int, datetime, int, int, str, np.ndarray]]:
    """Frames of a (frames, height, width) or (height, width) array; one second apart from 2024-01-01."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    size = struct.unpack("<H", data[8:10])[0] if data[6] == 1 else struct.unpack("<I", data[8:12])[0]
    head = ast.literal_eval(data[10 if data[6] == 1 else 12 :][:size].decode("latin-1"))
    array = np.load(io.BytesIO(data), allow_pickle=False)
    array = array[None] if array.ndim == 2 else array
    if array.ndim != 3:
        raise ValueError(f"{array.ndim} dimensions")
    for k, frame in enumerate(array):
        yield k, EPOCH + timedelta(seconds=k), frame.shape[0], frame.shape[1], np.dtype(head["descr"]).name, frame


def stack_of(path: Column | str) -> Column:
    """The stack_id of a file: a hash of its path without the scheme of local files, so that it depends neither on the listing nor on the reader."""
    return F.xxhash64(F.regexp_replace(path, "^file:/*", "/"))


def decoded(files: DataFrame, decoder: Decoder = decode_npy) -> DataFrame:
    """Frames of a table of files (stack_id, path, content), each with its path, and one row with an error and no frame for a file that cannot be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found, error = [], None
                try:
                    for k, ts, h, w, kind, a in decoder(bytes(row.content)):
                        found.append((row.stack_id, k, ts, h, w, kind, np.asarray(a, float).ravel(), row.path, None))
                except Exception as e:  # noqa: BLE001  a decoder is the caller's and may raise anything
                    found, error = [], f"{type(e).__name__}: {e}"
                if error:
                    found = [(row.stack_id, None, None, None, None, None, None, row.path, error)]
                yield pd.DataFrame(found, columns=["stack_id", "frame", "ts", "height", "width", "dtype", "px", "path", "error"])

    out = "stack_id long, frame long, ts timestamp, height int, width int, dtype string, px array<double>, path string, error string"
    return files.select("stack_id", "path", "content").mapInPandas(run, out)


def decode_stacks(files: DataFrame, decoder: Decoder = decode_npy) -> tuple[DataFrame, DataFrame]:
    """Frames and errors of a table of files as two tables; using both decodes the files twice, `decoded` once."""
    both = decoded(files, decoder)
    names = ["stack_id", "frame", "ts", "height", "width", "dtype", "px"]
    return both.where("error is null").select(*names), both.where("error is not null").select("stack_id", "path", "error")


def stack_files(spark: SparkSession, path: str, pattern: str = "*.npy", stack_id: Column | None = None) -> DataFrame:
    """A folder's files as `decoded` takes them; stack_id is `stack_of` the path, unless an expression is given. A file is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select((stack_of("path") if stack_id is None else stack_id).alias("stack_id"), "path", "content")


def read_stacks(spark: SparkSession, path: str, decoder: Decoder = decode_npy, pattern: str = "*.npy", stack_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and errors of a folder of files, see `stack_files`. For large .npy files on a mounted file system see `large`, which reads frame ranges."""
    return decode_stacks(stack_files(spark, path, pattern, stack_id), decoder)


#: Folders of a frame sink, and frame numbers of a stack that are written by one task.
FOLDERS, CHUNK = 32, 256


def write_frames(frames: DataFrame, out: str, inputs: list[str] = (), rows: int = 4096) -> None:
    """Writes Parquet; refuses an output that is, holds or lies in an input.

    Stacks share FOLDERS folders, dealt by a hash, so that a stack's rows lie in one folder. A folder's rows are
    written by several tasks, the more the session's shuffle partitions are; each takes whole runs of CHUNK frame
    numbers of some stacks, in order, so that no long stack is one task. Little data comes to few tasks, as
    Spark joins small partitions: files follow the rows, at most `rows` of them each, not the tasks or stacks.
    """
    schema.require(frames, schema.FRAMES)
    clean = lambda p: p.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"
    for path in inputs:
        if clean(out).startswith(clean(path)) or clean(path).startswith(clean(out)):
            raise ValueError(f"output {out} and input {path} overlap")
    parts = max(4, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FOLDERS)
    dealt = frames.withColumn("stacks", F.pmod(F.xxhash64("stack_id"), F.lit(FOLDERS)).cast("int"))
    dealt = dealt.repartition("stacks", F.pmod(F.xxhash64("stack_id", F.floor(F.col("frame") / CHUNK)), F.lit(parts))).sortWithinPartitions("stacks", "stack_id", "frame")
    dealt.write.mode("errorifexists").option("maxRecordsPerFile", rows).partitionBy("stacks").parquet(out)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames that `write_frames` wrote."""
    return spark.read.parquet(path).drop("stacks")
