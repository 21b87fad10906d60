"""Running numpy kernels over packed frames, and moving between packed and long form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(part: pd.DataFrame, h: int, w: int, column: str = "px") -> np.ndarray:
    """The packed images of rows of one size as (n, h, w); a wrong length or a null names its row."""
    for i, px in enumerate(part[column]):
        if px is None or len(px) != h * w:
            at = ", ".join(f"{k} {part[k].iloc[i]}" for k in ("stack_id", "frame", "scan_id", "sy", "sx") if k in part)
            raise ValueError(f"{column} does not hold {h} x {w} values at {at}")
    return np.stack([np.asarray(px, float) for px in part[column]]).reshape(-1, h, w)


#: Values of the images that a kernel gets at once; its own arrays are some ten times as large.
VALUES = 1 << 19


def by_size(pdf: pd.DataFrame, h: str, w: str) -> Iterator[tuple[pd.DataFrame, int, int]]:
    """A batch's rows by size of their images, at most VALUES values of them at once (one image at least), so that a worker's memory does not follow the rows of a batch."""
    for (hh, ww), part in pdf.groupby([h, w], sort=False):
        step = max(1, VALUES // max(1, int(hh) * int(ww)))
        for k in range(0, len(part), step):
            yield part.iloc[k : k + step], int(hh), int(ww)


def map_images(df: DataFrame, kernel: Callable[[np.ndarray, pd.DataFrame], dict], out: str, keep: list[str], px: str = "px", h: str = "height", w: str = "width", extra: list[str] = ()) -> DataFrame:
    """Runs kernel(images, rows) on each Arrow batch; it gives one value a row for each column of `out`.

    Only the columns that are kept or needed go to Python. A NaN that a kernel gives for a row comes
    back as null, which counts as missing too.
    """
    kinds = dict(df.dtypes)
    needed = list(dict.fromkeys([*keep, h, w, px, *extra]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, hh, ww in by_size(pdf, h, w):
                made = kernel(stacked(part, hh, ww, px), part)
                yield part[keep].reset_index(drop=True).assign(**{k: list(v) for k, v in made.items()})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), out])
    return df.select(*needed).mapInPandas(run, schema)


def explode_images(df: DataFrame, kernel: Callable[[np.ndarray, pd.DataFrame], pd.DataFrame], out: str, needed: list[str]) -> DataFrame:
    """Runs a kernel that gives any number of rows for each batch of equal-sized images."""
    columns = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, h, w in by_size(pdf, "height", "width"):
                yield kernel(stacked(part, h, w), part)[columns]

    return df.select(*dict.fromkeys([*needed, "height", "width", "px"])).mapInPandas(run, out)


def unpacked(df: DataFrame, keep: list, array: str, at: str, value: str) -> DataFrame:
    """One row a value of an array: the kept columns, its place and the value; a null or empty array has no row.

    Of the inner posexplode Spark infers a filter on the array's size, which it pushes to the source with the expression
    that makes the array: arrays were made twice, once by as few tasks as the source has. Of the outer one it infers none.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, value)).where(F.col(at).isNotNull())


def long_form(df: DataFrame, keys: list[str], px: str = "px", w: str = "width") -> DataFrame:
    """One row a pixel: keys, y, x, v."""
    return unpacked(df, [*keys, F.col(w).alias("_w")], px, "_i", "v").select(*keys, F.expr("cast(_i div _w as int)").alias("y"), F.expr("cast(_i % _w as int)").alias("x"), "v")


def measured(v, one=1):
    """v where it counts: neither null nor NaN."""
    return F.when(v.isNotNull() & ~F.isnan(v), v if one == 1 else one)
