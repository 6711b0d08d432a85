"""SimHash near-dedup by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their
8 bytes: at least 4 positional bytes are shared. The index has two levels. A distinct
fingerprint is posted under its values at 20 triples of byte positions, chosen so
that every 4 positions hold one of the triples (Turan's construction): each pair
that can reach the guaranteed count meets in a posting, and postings of 24 bits
stay short as the corpus grows, unlike those of single bytes. In a posting, its
members are posted again by each single position and byte. The lists tally how
many positional bytes a fingerprint shares with each other member; pairs at the
guaranteed minimum are verified by their differing bits, all others are never
looked at.

A posting is searched from one fingerprint to the next, and what is linked leaves
the posting, so a group of near copies costs about its size and gives a link for
each member, not all pairs. A posting above ``BLOCK`` fingerprints is put off and
posted under a fourth position (5 rows for each member, 32 bits); one that is still
above ``LARGE`` links through midpoints: fingerprints within 4 bits are those that
have a number within 2 bits of both, so each is posted under the 2081 numbers around
it, where at most 2081 can meet. All of it grows in proportion to the members.

Defined cases: null and empty texts have no words and fingerprint zero, linked
like any other; fewer words than a shingle are one shingle; A-Z are lower-cased;
rows with equal fingerprints are one node, whatever their number; null ids are
never a component's name while it has another id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .components import components

SHINGLE, MAX_BITS, SHARED_BYTES = 4, 4, 4
#: Most fingerprints of a posting of three, and of one of four positions, that a task searches.
BLOCK, LARGE = 4096, 65536


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions; every 4 positions hold one of them.

    Positions fall into parts 0, 1, 2 by their remainder by 3; a triple lies in one
    part, or has two positions in a part and one in the next.
    """
    out = []
    for t in combinations(range(8), 3):
        parts = sorted(p % 3 for p in t)
        n = [parts.count(k) for k in range(3)]
        if 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    # bytes: lower() and split() know ASCII only, which is what the words are defined by
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1]
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins.tolist(), ends[n - 1 :].tolist())]
    counts = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype=">u8").view(np.uint8)
    for at in range(0, len(values), 8 << 15):  # bounded memory for very long texts
        bits = np.unpackbits(values[at : at + (8 << 15)]).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], names=["doc_id", "fp"])
        tokens.trim()

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def postings(nodes: DataFrame) -> DataFrame:
    """(key, fp, node): a fingerprint under each triple of its byte positions."""

    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = [
        F.lit(k << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c)
        for k, (a, b, c) in enumerate(triples())
    ]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp", "node")


class Lists:
    """The byte-position inverted index of a posting's fingerprints."""

    def __init__(self, fp: np.ndarray):
        self.bytes = fp.view(np.uint8).reshape(-1, 8)
        order = [np.argsort(self.bytes[:, p], kind="stable") for p in range(8)]
        ends = [np.cumsum(np.bincount(self.bytes[:, p], minlength=256)) for p in range(8)]
        self.order, self.ends = order, [np.append(0, e) for e in ends]

    def shared(self, one: int) -> np.ndarray:
        """Members that share the guaranteed number of positional bytes with member ``one``."""
        lists = [
            self.order[p][self.ends[p][b] : self.ends[p][b + 1]] for p, b in enumerate(self.bytes[one].tolist())
        ]
        tally = np.bincount(np.concatenate(lists), minlength=len(self.bytes))
        return np.flatnonzero(tally >= SHARED_BYTES)


def links_within(fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected in a posting: a forest of real links."""
    while len(fp) > 1:
        index, here = Lists(fp), np.ones(len(fp), bool)
        left = len(fp)
        # the index is made anew for what is left once half of it has gone
        while 2 * left > len(fp) or left == len(fp):
            first = int(here.argmax())
            here[first], left, front = False, left - 1, [first]
            while front:
                one = front.pop()
                met = index.shared(one)
                met = met[here[met]]
                near = met[np.bitwise_count(fp[met] ^ fp[one]) <= MAX_BITS]
                here[near], left = False, left - len(near)
                name = int(node[one])
                for x in near.tolist():
                    yield name, int(node[x])
                front += near.tolist()
                if not left:
                    return
        fp, node = fp[here], node[here]


def links_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs that are alone in their posting link: by shared bytes, then by bits."""
    odd = a ^ b
    out = np.flatnonzero((odd.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= SHARED_BYTES)
    return out[np.bitwise_count(odd[out]) <= MAX_BITS]


FOUND = "key long, a long, b long, fp long"


def _search(most: int):
    """mapInArrow over (key, fp, node) rows sorted by key: links (a, b).

    A group above ``most`` rows comes back as rows (key, node in a, fp) instead, in
    the order they were read, so that no more than it and a batch are held.
    """

    def table(late: list[tuple[int, np.ndarray, np.ndarray]], a: list[int], b: list[int]) -> pa.RecordBatch:
        n = sum(len(fp) for _, fp, _ in late)
        key = np.concatenate([np.full(len(fp), k) for k, fp, _ in late]) if late else np.empty(0, np.int64)
        fps = np.concatenate([fp.view(np.int64) for _, fp, _ in late]) if late else np.empty(0, np.int64)
        ids = np.concatenate([node for _, _, node in late]) if late else np.empty(0, np.int64)
        none = pa.nulls(len(a), pa.int64())
        columns = [
            pa.concat_arrays([pa.array(key, pa.int64()), none]), pa.array([*ids.tolist(), *a], pa.int64()),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(b, pa.int64())]), pa.concat_arrays([pa.array(fps, pa.int64()), none]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.uint64, np.int64)]
        flowing = None  # the group that is put off just now
        for batch in chain(batches, [None]):
            late: list[tuple[int, np.ndarray, np.ndarray]] = []
            a: list[int] = []
            b: list[int] = []
            key, fp, node = held
            if batch is not None:
                new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                key, fp, node = (
                    np.concatenate(x) for x in zip(held, (new[0], new[1].view(np.uint64), new[2]), strict=True)
                )
            if flowing is not None:
                n = int(np.searchsorted(key, flowing, "right")) if len(key) else 0
                late.append((flowing, fp[:n], node[:n]))
                key, fp, node = key[n:], fp[n:], node[n:]
                if len(key):
                    flowing = None
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            whole = len(bounds) - 1 if batch is None else max(len(bounds) - 2, 0)
            many = np.diff(bounds[: whole + 1])
            two = bounds[np.flatnonzero(many == 2)]
            two = two[links_of_pairs(fp[two], fp[two + 1])]
            a += node[two].tolist()
            b += node[two + 1].tolist()
            for k in np.flatnonzero(many > 2).tolist():
                x, y = int(bounds[k]), int(bounds[k + 1])
                if y - x > most:
                    late.append((int(key[x]), fp[x:y], node[x:y]))
                    continue
                for one, other in links_within(fp[x:y], node[x:y]):
                    a.append(one)
                    b.append(other)
            x = int(bounds[whole])
            held = [key[x:], fp[x:], node[x:]]
            if len(held[0]) > most:
                flowing = int(held[0][0])
                late.append((flowing, held[1], held[2]))
                held = [h[:0] for h in held]
            yield table(late, a, b)

    return run


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point, node): each fingerprint under all numbers within 2 bits of it."""
    ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), ones, ones[i] ^ ones[j]])
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        node = batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 256):  # half a million rows at once
            points = (fp[at : at + 256, None] ^ masks).reshape(-1).view(np.int64)
            nodes = np.repeat(node[at : at + 256], len(masks))
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(nodes)], names=["point", "node"])


def links(nodes: DataFrame, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """(a, b) links between nodes, connecting all that MAX_BITS connects.

    ``nodes``: (fp, node), distinct by fp, node a long.
    """

    def searched(posted: DataFrame, most: int, label: str) -> tuple[DataFrame, DataFrame]:
        dealt = posted.repartition("key").sortWithinPartitions("key", "fp")
        found = common.stored(dealt.mapInArrow(_search(most), FOUND), label)
        return found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL").select("key", "fp", F.col("a").alias("node"))

    out, late = searched(postings(nodes), block, "found")
    if late.isEmpty():
        return out
    # a pair that links shares a fourth position besides the three of the posting
    fourth = [
        F.shiftleft(F.col("key"), 11) + F.lit(p << 8) + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)
    ]
    own = F.array(*(F.array(*(F.lit(p) for p in range(8) if p not in t)) for t in triples()))
    keys = F.transform(F.get(own, F.shiftright("key", 24).cast("int")), lambda p: F.get(F.array(*fourth), p))
    more, late = searched(late.select(F.explode(keys).alias("key"), "fp", "node"), large, "found_of_large")
    out = out.unionByName(more)
    if late.isEmpty():
        return out
    points = common.stored(late.select("fp", "node").distinct().mapInArrow(_midpoints, "point long, node long"), "midpoints")
    lowest = points.groupBy("point").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    near = points.join(lowest.hint("merge"), "point").where("node <> b")  # at most 2081 rows for a point
    return out.unionByName(near.select(F.col("node").alias("a"), "b").distinct())


def near_groups(marked: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of a written table (doc_id, fp).

    Components are found between distinct fingerprints, each named by its smallest
    doc_id, and brought back to all rows that have the fingerprint.
    """
    nodes = common.stored(
        marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_docs")), "nodes"
    )
    found = components(links(nodes.where("node IS NOT NULL").select("fp", "node")))
    named = nodes.join(found, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"), "n_docs"
    )
    out = common.with_group(marked, common.stored(named, "named"), "fp", "n_docs", marked.count())
    return out.select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprints and components of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_groups(common.stored(fingerprints(docs), "fingerprints"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, the smallest id, of each component.

    An id goes if none of its rows stays; rows without an id cannot be named, and stay.
    """
    marked = common.stored(fingerprints(docs, id_col, text_col), "fingerprints")
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = near_groups(marked).groupBy(F.col("doc_id").alias(id_col)).agg(stays.alias("stays")).where("NOT stays")
    return common.without(docs, common.stored(gone.select(id_col).dropna(), "near_copies"), [id_col])
