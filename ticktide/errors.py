"""Failures, one class each, so that callers can tell them apart."""

from __future__ import annotations


class TapeError(Exception):
    """Base of all failures of this library."""


def _kinds(*names: str) -> dict[str, type[TapeError]]:
    return {n: type(n, (TapeError,), {"__module__": __name__}) for n in names}


_ALL = _kinds(
    # conversion of source rows
    "VenueIdRange", "RecordTypeRange", "SideFlagsRange", "LevelsOnNonSnapshot", "SnapshotFieldSet", "LevelSide",
    "ExchangeTsDecreased", "SourceSchema",
    # order
    "DuplicateKey", "OutOfOrder", "VenueMismatch", "DuplicateVenue", "WorkerCount", "NoVenues",
    # books
    "LevelNotFound", "DuplicateLevel", "WrongRecordType", "WrongInstrument", "BidCountOutOfRange",
    # delivery
    "BadCapacity", "MaxBlobBytes", "BlobTooLarge", "ModeUnset", "StartUnset", "StartLapped", "Closed", "Evicted",
    "Canceled", "InvalidSpeed", "SpeedMismatch",
    # catalogue
    "MissingMetric", "BadValue", "DuplicateRun", "DuplicateBenchmark",
    # binary files
    "ShortHeader", "BadMagic", "HeaderChecksum", "TrailerChecksum", "FormatVersion", "NotFinalized", "HeaderSize",
    "BlockSize", "PriceScale", "RecordCount", "OffsetChain", "IndexOrder", "IndexRange", "IndexCount",
    "FooterGeometry", "BlockRange", "BlockChecksum", "HeaderRange", "NotSnapshot", "BlobOutOfRange", "BlobChecksum",
    "BlobLength", "BlobLevelCount", "TooManyLevels", "ReservedSet", "UnusedFieldSet", "ShortRecord", "RecordType",
    "SideFlags", "WriterClosed",
)
globals().update(_ALL)


class RowError(TapeError):
    """A source row that cannot be converted: ``row`` counts from 0, ``kind`` names the failure's class."""

    def __init__(self, row: int, kind: str):
        super().__init__(f"row {row}: {kind}")
        self.row, self.kind = row, _ALL[kind]


class LineError(TapeError):
    """A line of a benchmark text that cannot be read; lines count from 1."""

    def __init__(self, line: int, kind: str):
        super().__init__(f"line {line}: {kind}")
        self.line, self.kind = line, _ALL[kind]


def named(kind: str) -> type[TapeError]:
    return _ALL[kind]
