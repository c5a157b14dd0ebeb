"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

from ..sources.workspace import drop_folder, fresh_folder

#: Folders written by each ``cleaned`` function that is running, innermost last.
_running: list[list[str]] = []
#: Folders of the written tables that are still in use.
_folder_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: this cuts lineage and survives lost executors."""
    path = fresh_folder(df.sparkSession, "table")
    if _running:
        _running[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folder_of[out] = path
    return out


def in_files(df: DataFrame, rows: int, rows_a_file: int = 16_384) -> DataFrame:
    """``df``, which has about ``rows`` rows, in at most as many partitions as keep files from being tiny; large tables stay as they are dealt out."""
    return df.coalesce(max(1, ceil(rows / rows_a_file)))


def drop(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` wrote; other tables are left alone."""
    if path := _folder_of.pop(df, None):
        drop_folder(df.sparkSession, path)


def cleaned(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Make ``f`` write its result and drop the tables that it wrote on the way."""

    @wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _running.append([])
        try:
            out = f(*args, **kwargs)
            own, _running[-1] = _running[-1], []
            kept = materialize(out)
            result = _running[-1]
        except BaseException:
            own, result = _running[-1], []
            raise
        finally:
            _running.pop()
            for path in own:
                drop_folder(args[0].sparkSession, path)
        if _running:
            _running[-1] += result
        return kept

    return run
