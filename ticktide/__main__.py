"""Batch commands: ``python -m ticktide convert|replay|runs|benchmarks``; run them by spark-submit on a cluster.

    convert SOURCE FOLDER [--epoch-every N] [--price-scale N]   source Parquet to ordered records with epochs
    export FOLDER ARTIFACTS                                     converted records to binary artifacts
    replay FOLDER [--from-ts T] [--to PATH]                     the total order: its digest, and its records if asked for
    runs FOLDER                                                 run manifests into the table of runs
    benchmarks FILE --commit ID                                 a benchmark text into the table of benchmarks

A failure of the data prints its class and where, and exits with 1.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .operators import canonical, catalogue, convert, order
from .sources import hotfile


def _records(spark: SparkSession, folder: str, from_ts: int | None) -> DataFrame:
    records = convert.replay(spark, folder, from_ts).drop("emit_index")
    return records.withColumn("venue_id", F.col("venue_id").cast("int"))


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    for name in convert.convert(spark, a.source, a.folder, a.epoch_every, a.price_scale):
        print(name)


def _export(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, sha in hotfile.export(_records(spark, a.folder, None), a.artifacts):
        print(sha, name)


def _replay(spark: SparkSession, a: argparse.Namespace) -> None:
    records = _records(spark, a.folder, a.from_ts)
    if a.to:
        indexed = order.with_emit_index(records)
        indexed.repartitionByRange("emit_index").sortWithinPartitions("emit_index").write.parquet(a.to)
    digest, n = canonical.digest(records)
    print(f"{n} records, digest {digest}")


def _runs(spark: SparkSession, a: argparse.Namespace) -> None:
    catalogue.create_tables(spark)
    print(f"{catalogue.ingest_manifests(spark, a.folder)} runs")


def _benchmarks(spark: SparkSession, a: argparse.Namespace) -> None:
    catalogue.create_tables(spark)
    print(f"{catalogue.ingest_benchmarks(spark, a.file, a.commit)} measurements")


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="ticktide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)

    def command(name: str, call, *places: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        own.set_defaults(call=call)
        for place in places:
            own.add_argument(place)
        return own

    own = command("convert", _convert, "source", "folder")
    own.add_argument("--epoch-every", type=int, default=convert.DEFAULT_EPOCH)
    own.add_argument("--price-scale", type=int, default=convert.DEFAULT_SCALE)
    command("export", _export, "folder", "artifacts")
    own = command("replay", _replay, "folder")
    own.add_argument("--from-ts", type=int)
    own.add_argument("--to")
    command("runs", _runs, "folder")
    command("benchmarks", _benchmarks, "file").add_argument("--commit", required=True)
    a = parser.parse_args(args)
    try:
        a.call(SparkSession.builder.appName("ticktide").getOrCreate(), a)
    except errors.TapeError as e:
        kind = e.kind.__name__ if isinstance(e, errors.RowError | errors.LineError) else type(e).__name__
        print(f"{kind}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
