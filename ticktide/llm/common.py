"""Shared pieces of the corpus operators: the shared folder, written tables, skew-safe joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import delete, new_path, stored, written  # noqa: F401  (for the operators)

#: A broadcast relation made here never holds more rows than this.
BROADCAST_ROWS = 50_000
#: ASCII white space: the characters that separate words in every contract.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return shared.new_path(spark, "x").rsplit("/", 1)[0]


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that are not saved yet need them."""
    delete(spark, work_dir(spark))


def numbered(df: DataFrame, label: str, name: str) -> DataFrame:
    """``df`` as a written table with a number of its own for each row in ``name``.

    The number is the row's place in the table's files, by their names: task (22
    bits), file of the task (6) and place in the file (35), so it never changes.
    """
    table = written(df, label)
    file = F.col("_metadata.file_name")
    task, part = (F.regexp_extract(file, r"^part-(\d+)-.*-c(\d+)\.", k).cast("long") for k in (1, 2))
    number = F.shiftleft(task, 41) + F.shiftleft(part, 35) + F.col("_metadata.row_index")
    return table.select("*", number.alias(name))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two frames."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def with_group(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, n_rows: int) -> DataFrame:
    """``rows`` with the columns of their group, for keys as uneven as they come; rows without one go.

    ``groups`` has one row per ``key`` with (at least) its number of rows in
    ``size``, which together are no more than ``n_rows``. Groups above
    ``n_rows / BROADCAST_ROWS`` rows (at most BROADCAST_ROWS of them can
    exist) are broadcast, so that their rows stay where they are; all others are
    joined by a shuffle, where no key holds more than that many rows. ``key``
    has no nulls. Both frames are read twice: pass written tables.
    """
    keys = [key] if isinstance(key, str) else key
    floor = max(100, n_rows // BROADCAST_ROWS + 1)
    big = groups.where(F.col(size) > floor)
    cold = groups.where(F.col(size) <= floor)
    if big.isEmpty():
        return rows.join(cold.hint("merge"), keys)
    rest = rows.join(F.broadcast(big.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(big), keys).unionByName(rest.join(cold.hint("merge"), keys))


def without(docs: DataFrame, dropped: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """``docs`` whose keys are not in the written table ``dropped``.

    The keys are broadcast while they are fewer than ``most``; beyond that both
    sides are shuffled.
    """
    dropped = dropped.select(*[F.col(k).alias(f"__{k}") for k in keys])
    if dropped.count() <= most:
        dropped = F.broadcast(dropped)
    on = F.lit(True)
    for k in keys:
        on = on & docs[k].eqNullSafe(dropped[f"__{k}"])
    return docs.join(dropped, on, "left_anti")


def fresh_names(df: DataFrame, *stems: str) -> list[str]:
    """Distinct column names that ``df`` does not have."""
    return [fresh_name(df, stem) for stem in stems]


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name
