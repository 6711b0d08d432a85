"""Best-fit packing of documents into sequences, after Martello-Toth reduction.

Only the lengths of pieces matter, and there are at most ``cap`` of them. Their
histogram, whose size does not grow with the data, goes to the driver, which
plans patterns of lengths with multiplicities: first the sets that provably
dominate every alternative (dominance reduction, Martello and Toth 1990), then
best-fit decreasing for what is left. Pieces are numbered within their length where
they are read, and the number picks the place that the plan has for it; pieces of
full length are sequences of their own and need no number among all.

Defined cases: a null text is empty; an empty document is the end id alone; a
document longer than ``cap`` is cut into pieces of ``cap`` ids, of which the first
may be shorter; null ids and repeated rows are documents of their own; an empty
table gives no sequence; other columns are not read. ``pack`` carries all columns
of its pieces, whatever their names; where they have ``sequence_id`` or ``offset``,
its own get a leading underscore.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ranks, tokens

CAP = 2048


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each with ``k`` pieces of each (length, k) in ``items``."""

    items: tuple[tuple[int, int], ...]
    times: int


class _Left:
    """Counts of the pieces that are not placed yet, by length."""

    def __init__(self, counts: dict[int, int], cap: int):
        self.n = np.zeros(cap + 1, dtype=np.int64)
        for size, n in counts.items():
            self.n[size] = n

    def most(self, limit: int, besides: int) -> int:
        """The largest length up to ``limit``, one piece of length ``besides`` put aside; 0 if none."""
        for size in np.flatnonzero(self.n[: max(limit, 0) + 1])[::-1][:2].tolist():
            if size != besides or self.n[size] > 1:
                return size
        return 0

    def smallest(self, k: int, besides: int) -> list[int]:
        """The ``k`` smallest pieces, one of length ``besides`` put aside."""
        out: list[int] = []
        for size in np.flatnonzero(self.n)[: k + 1].tolist():
            out += [size] * int(min(k, self.n[size] - (size == besides)))
        return out[:k]

    def take(self, items: tuple[tuple[int, int], ...]) -> Pattern:
        times = min(int(self.n[size]) // k for size, k in items)
        for size, k in items:
            self.n[size] -= k * times
        return Pattern(items, times)


def _counted(sizes: list[int]) -> tuple[tuple[int, int], ...]:
    return tuple((s, sizes.count(s)) for s in sorted(set(sizes), reverse=True))


def dominating(left: _Left, size: int, cap: int) -> tuple[tuple[int, int], ...] | None:
    """A set with a piece of ``size`` that dominates all sets with it, if one is known.

    A set dominates another if its pieces can stand for disjoint groups of the
    other's pieces, each group no longer than the piece that stands for it.
    """
    room = cap - size
    best = left.most(room, size)
    if not best:
        return ((size, 1),)
    if best == room:  # fills the sequence: anything else in there is no longer
        return _counted([size, best])
    low = left.smallest(3, size)
    if len(low) < 2 or low[0] + low[1] > room:  # no two others fit
        return _counted([size, best])
    if len(low) < 3 or sum(low) > room:  # no three others fit
        second = 0
        for x in np.flatnonzero(left.n[: room - best + 1])[::-1].tolist():
            if left.n[x] > (x == size) + (x == best):
                second = x
                break
        half = left.most(room // 2, size)  # bounds the smaller of any two others
        if second and half <= second:
            return _counted([size, best, second])
    return None


def reduce(counts: dict[int, int], cap: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns fixed by dominance, and the counts that remain."""
    left, fixed, changed = _Left(counts, cap), [], True
    while changed:
        changed = False
        for size in np.flatnonzero(left.n)[::-1].tolist():
            while left.n[size] and (items := dominating(left, size, cap)):
                fixed.append(left.take(items))
                changed = True
    return fixed, {int(s): int(left.n[s]) for s in np.flatnonzero(left.n)}


def best_fit(counts: dict[int, int], cap: int) -> list[Pattern]:
    """Best-fit decreasing; sequences that are alike are handled together."""
    by_room: list[list[Pattern]] = [[] for _ in range(cap + 1)]
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = next((r for r in range(size, cap) if by_room[r]), cap)
            held = by_room[room].pop() if room < cap else Pattern((), n)
            k = room // size
            if n < k:
                k, times = n, 1
            else:
                times = min(held.times, n // k)
            if room < cap and held.times > times:
                by_room[room].append(Pattern(held.items, held.times - times))
            by_room[room - k * size].append(Pattern((*held.items, (size, k)), times))
            n -= k * times
    return [p for ps in by_room for p in ps]


def plan(counts: dict[int, int], cap: int) -> list[Pattern]:
    fixed, rest = reduce(counts, cap)
    return fixed + best_fit(rest, cap)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of it per sequence, offset of the first)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        at = 0
        for size, k in p.items:
            first = rank.get(size, 0)
            rank[size] = first + k * p.times
            rows.append((size, first, rank[size], sequence, k, at))
            at += k * size
        sequence += p.times
    return rows


PIECES = "doc_id {id_type}, piece int, start long, length long, ids binary"


def cut(n: int, cap: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    start, length = 0, n % cap or cap
    while start < n:
        yield start, min(length, n)
        start, length = start + length, cap


def token_pieces(
    docs: DataFrame, path: str, cap: int = CAP, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ranked: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids) of each piece; ids are unsigned 32-bit, little-endian.

    ``ranked`` adds (part, rank) for ``placed``, in the same pass.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECES.format(id_type=dict(rows.dtypes)["doc_id"]) + (", part int, rank long" if ranked else "")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counter = tokens.encoder(path, False).encode, ranks.Counter(cap)

        def pieces(batch):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, cap)):
                    yield 4 * length, (doc_id, k, start, length, ids[4 * start : 4 * (start + length)])

        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            own = pa.schema(list(zip(["doc_id", "piece", "start", "length", "ids"], kinds)))
            for out in tokens.batched(pieces(batch), own):
                yield counter.ranked(out, "length", "part", "rank") if ranked else out
        tokens.trim()

    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, cap: int = CAP) -> DataFrame:
    """``pieces`` (with ``length``, from 1 to ``cap``) with ``sequence_id`` and ``offset``.

    All other columns are carried. A sequence holds at most ``cap``.
    """
    part, rank = common.fresh_names(pieces, "part", "rank")
    dealt = common.written(ranks.locally_ranked(pieces, "length", cap, part, rank), "pieces")
    return placed(dealt, cap, part, rank)


def placed(dealt: DataFrame, cap: int = CAP, part: str = "part", rank: str = "rank") -> DataFrame:
    """``pack`` of a written table of pieces that were numbered within their length where they were read."""
    spark, pieces = dealt.sparkSession, dealt.drop(part, rank)
    begin, n = common.fresh_names(dealt, "begin", "n")
    sequence, offset = common.fresh_names(pieces, "sequence_id", "offset")
    some = dealt.where(F.col("length") < cap)
    counts = common.written(some.groupBy("length", part).agg(F.count("*").alias(n)), "lengths")
    total = {int(s): int(n) for s, n in counts.groupBy("length").agg(F.sum(n)).collect()}  # less than cap rows
    patterns = plan(total, cap)
    # the plan's rows depend on the lengths that occur, not on the number of documents
    size, first, end, start, k, at = common.fresh_names(dealt, "size", "first", "end", "start", "k", "at")
    kinds = ", ".join(f"`{c}` long" for c in (size, first, end, start, k, at))
    table = F.broadcast(spark.createDataFrame(places(patterns), kinds))
    ranked = some.join(ranks.begins(counts, "length", part, n, begin).hint("merge"), ["length", part])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(begin))
    found = ranked.join(
        table, (F.col("length") == F.col(size)) & (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(end))
    )
    nth = F.col(rank) - F.col(first)
    own = [F.col(f"`{c}`") for c in pieces.columns]
    found = found.select(
        *own,
        (F.col(start) + F.floor(nth / F.col(k)).cast("long")).alias(sequence),
        (F.col(at) + nth % F.col(k) * F.col("length")).cast("long").alias(offset),
    )
    n_planned = sum(p.times for p in patterns)
    alone = F.lit(n_planned).cast("long") + F.shiftleft(F.col(part).cast("long"), 36) + F.col(rank)
    full = dealt.where(F.col("length") == cap).select(*own, alone.alias(sequence), F.lit(0).cast("long").alias(offset))
    return found.unionByName(full)


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces that carry ``ids``; a sequence is at most one cap long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all ``documents`` in sequences of at most 2048 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs)


def packed(docs: DataFrame) -> DataFrame:
    pieces = token_pieces(docs, tokens.public_path("byte_bpe_50k.json"), ranked=True).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "rank"
    )
    return placed(common.written(pieces, "pieces"))
