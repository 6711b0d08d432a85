"""Schemas of source rows and records, and the exact check of a source file."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from . import errors
from .shared import store_of

#: The total order of records.
KEY = ("exchange_ts", "venue_id", "sequence_number", "instrument_id")
DELTA, TRADE, SNAPSHOT = 0, 1, 2
BID, ASK = 0, 1
LEVELS = "array<struct<price: bigint, size: bigint>>"
SOURCE_SCHEMA = (
    "exchange_ts bigint, sequence_number decimal(20,0), instrument_id bigint, venue_id bigint, record_type bigint, "
    "side_flags bigint, price bigint, size bigint, levels array<struct<side: bigint, price: bigint, size: bigint>>"
)
RECORD_SCHEMA = (
    "exchange_ts bigint, sequence_number decimal(20,0), instrument_id bigint, venue_id int, record_type int, "
    f"side_flags int, price bigint, size bigint, bids {LEVELS}, asks {LEVELS}"
)
_FIELDS = {
    "exchange_ts": pa.int64(), "sequence_number": pa.uint64(), "instrument_id": pa.uint32(), "venue_id": pa.uint32(),
    "record_type": pa.uint32(), "side_flags": pa.uint32(), "price": pa.int64(), "size": pa.int64(),
}
_LEVEL = {"side": pa.uint32(), "price": pa.int64(), "size": pa.int64()}


def check_source_schema(schema: pa.Schema, strict: bool = False) -> None:
    """Raise SourceSchema naming the first field, in canonical order, that does not match.

    ``strict`` also asks for required fields; a list of the level struct stands for
    the repeated group otherwise.
    """

    def fault(name: str, why: str) -> errors.TapeError:
        return errors.named("SourceSchema")(f"{name}: {why}")

    for name, kind in _FIELDS.items():
        at = schema.get_field_index(name)
        if at < 0:
            raise fault(name, "missing")
        field = schema.field(at)
        if field.type != kind:
            raise fault(name, f"is {field.type}, not {kind}")
        if strict and field.nullable:
            raise fault(name, "is optional")
    at = schema.get_field_index("levels")
    if at < 0:
        raise fault("levels", "missing")
    kind = schema.field(at).type
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        raise fault("levels", "is not a repeated group")
    own = {f.name: f.type for f in kind.value_type}
    for name, want in _LEVEL.items():
        if own.get(name) != want:
            raise fault(f"levels.{name}", f"is {own.get(name, 'missing')}")
    for name in own:
        if name not in _LEVEL:
            raise fault(f"levels.{name}", "is not a known field")
    for name in schema.names:
        if name not in _FIELDS and name != "levels":
            raise fault(name, "is not a known field")


def check_source_file(path: str, strict: bool = False) -> int:
    """Rows of a source file, in any store that Spark names by a URL, whose schema is right; only the footer is read."""
    store, at = store_of(path)
    with store.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        check_source_schema(file.schema_arrow, strict)
        return file.metadata.num_rows


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Source rows with their number in the file, ``row_index``."""
    return spark.read.schema(SOURCE_SCHEMA).parquet(path).select("*", "_metadata.row_index")
