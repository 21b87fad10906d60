"""Large .npy stacks, read by frame ranges of at most `frames` frames, so that no large file is whole in a task.

Ranges are packed into partitions of about `BYTES` stored bytes (option "bytes"), as many small files would
each be a task otherwise, but into as many as there are cores where there are that many ranges.

For stacks on a file system that all executors mount; where only Spark reaches the files, use
`stacks.read_stacks`. Register once per session with `register(spark)`, then

    spark.read.format("npy_frames").option("path", folder).option("frames", 16).load()

stack_id is that of `stacks.stack_of`, or with the option "stack" the number in that pattern's first group.
"""

from __future__ import annotations

import glob
import math
import os
import re
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from .stacks import EPOCH


#: Stored bytes of a partition, and values of a batch that a task hands over.
BYTES, VALUES = 1 << 23, 1 << 19


class Ranges(InputPartition):
    """Ranges as (path, stack, first, last)."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__((ranges[0][0], ranges[0][2]))
        self.ranges = ranges


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.frames, self.pattern = options["path"], int(options.get("frames", 16)), options.get("stack")
        self.bytes, self.least = int(options.get("bytes", BYTES)), int(options.get("partitions", os.cpu_count() or 1))

    def stack(self, path: str) -> int:
        if self.pattern:
            return int(re.search(self.pattern, path)[1])
        value = xxhash.xxh64_intdigest(os.path.abspath(path).encode(), 42)  # as Spark's xxhash64
        return value - (1 << 64) if value >> 63 else value

    def partitions(self) -> list[Ranges]:
        """Only headers are read here."""
        found, sizes = [], []
        for path in sorted(glob.glob(os.path.join(self.folder, "*.npy"))):
            array = np.load(path, mmap_mode="r", allow_pickle=False)
            n = array.shape[0] if array.ndim == 3 else 1
            stack, one = self.stack(path), array.nbytes // max(1, n)
            for i in range(0, n, self.frames):
                found.append((path, stack, i, min(n, i + self.frames)))
                sizes.append((found[-1][3] - i) * one)
        held = min(self.bytes, sum(sizes) / max(1, self.least))
        out, total = [], math.inf
        for part, size in zip(found, sizes, strict=True):
            if total + size > held:
                out.append([])
                total = 0
            out[-1].append(part)
            total += size
        return [Ranges(p) for p in out]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        rows, values = [], 0
        for path, stack, first, last in part.ranges:
            array = np.load(path, mmap_mode="r", allow_pickle=False)
            array = array[None] if array.ndim == 2 else array
            for k in range(first, last):
                frame = np.asarray(array[k])
                rows.append((stack, k, EPOCH + timedelta(seconds=k), *frame.shape, frame.dtype.name, frame.astype(float).ravel()))
                values += frame.size
                if values >= VALUES:
                    yield _batch(rows)
                    rows, values = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Frames as an Arrow batch; times are in UTC."""
    stack, frame, ts, height, width, kind, px = zip(*rows, strict=True)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in px])]).astype(np.int32)
    columns = [pa.array(stack, pa.int64()), pa.array(frame, pa.int64()), pa.array(ts, pa.timestamp("us", "UTC")), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(kind), pa.ListArray.from_arrays(bounds, np.concatenate(px))]
    return pa.RecordBatch.from_arrays(columns, names=["stack_id", "frame", "ts", "height", "width", "dtype", "px"])


class NpyFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_frames"

    def schema(self) -> str:
        return schema.FRAMES

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyFrames)
