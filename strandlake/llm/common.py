"""What several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import materialized

#: Rows written once to the shared folder and read again: lineage ends here.
written = materialized

#: A word, as the contracts of the corpus operators define it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def sheltered(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """docs with its columns under names that no operator uses, and what finds them by their own names."""
    names = {c.lower(): f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda c: F.col(names[c.lower()])


def kept_names(columns: list[str], results: list[str]) -> list[str]:
    """Names of a table's columns beside results: one that a result needs becomes <name>_given."""
    taken = {c.lower() for c in [*columns, *results]}
    out = []
    for c in columns:
        new = c
        if c.lower() in {r.lower() for r in results}:
            while new.lower() in taken:
                new += "_given"
            taken.add(new.lower())
        out.append(new)
    return out


def restored(df: DataFrame, columns: list[str], results: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """The sheltered columns under their own names (see kept_names), but for those to drop, then the results."""
    gone = {d.lower() for d in drop}
    names = kept_names(columns, results)
    return df.select(*[F.col(f"_in{i}").alias(new) for i, (c, new) in enumerate(zip(columns, names, strict=True)) if c.lower() not in gone], *results)


def in_parts(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df, small and of about so many rows, dealt anew to a part for each of those.

    Every part is a file, for which a local file system starts three processes that set permissions; a join or a
    grouping leaves as many parts as the session has shuffle partitions, however few the rows.
    """
    return df.repartition(1 + rows // each)


def chunk_count(df: DataFrame, text: str, chunk_bytes: int) -> int:
    """Chunks of about chunk_bytes of text that the table makes; at least one."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes))


#: What operators keep in a worker between tasks.
_KEPT: list[dict] = []


def kept_between_tasks() -> dict:
    """A table that an operator keeps in its worker, until another operator works there."""
    _KEPT.append({})
    return _KEPT[-1]


def release_memory(own: dict | None = None) -> None:
    """Gives a worker's free memory back to the system, so that idle workers leave it to the others.

    What other operators keep in the worker goes too: the same workers run all stages of a pipeline.
    """
    for kept in _KEPT:
        if kept is not own:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
