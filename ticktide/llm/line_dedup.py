"""Line dedup by pairwise alignment.

Lines that have words are hashed. A line that several documents hold links each of
them to the first (smallest id) document that holds it, so a line in n documents
makes n - 1 pairs. Pairs come from rare lines, those in at most
``rare`` documents, and, however frequent, from lines and from runs of lines that
reach ``min_words`` words: each block that is long enough to go is made of them.
The common lines of a pair are aligned by patience
diff (lines unique on both sides first, the longest increasing run of them, then
the gaps between), and aligned blocks of at least ``min_words`` words are deleted
from the later document. A run of which a line is still there, since its first
holder has it in another order, is tried with the next holders (1, 2, 4, ... of
them) until it is gone or all are tried: the result is that of aligning all pairs.

Defined cases: a null or empty text has no lines and stays; white space within and
around lines does not matter, blank lines stay where they are and do not part a
block; repeated rows with the same id are one document; null ids stay as they are;
an empty table gives an empty result; other columns, whatever their names, are not
touched, and where they are called removed_lines or removed_words, the added ones
get a leading underscore. Ids are integers, as "earlier" is their order; any other
type is an error.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, ranks

RARE, MIN_WORDS = 1000, 20
#: Removed lines that are broadcast at most, 4 bytes each.
MOST_LINES = 1 << 20


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\f\r")), common.SPACE_CLASS + "+", " ")


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, rank, at, h1, h2, words): the lines with words of (id, text); ``at`` counts all lines."""
    split = docs.select("id", F.split("text", "\n").alias("lines"))
    at = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(r"[^\x20\x09-\x0D]")
    )
    each = split.select("id", "lines", at.alias("at")).select(
        "id", F.posexplode(F.transform("at", lambda i: F.struct(i.alias("at"), F.get("lines", i).alias("line")))).alias("rank", "x")
    )
    line = each.select("id", "rank", F.col("x.at").alias("at"), _normal(F.col("x.line")).alias("line"))
    return line.select(
        "id", "rank", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        (F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).alias("words"),
    )


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (x, y) ascending by y, the longest subsequence ascending by x (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (x, _) in enumerate(pairs):
        pile = bisect_left(tops, x)
        back[k] = at[pile - 1] if pile else -1
        tops[pile : pile + 1] = [x]
        at[pile : pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(early: dict[int, int], late: dict[int, int]) -> dict[int, int]:
    """Late rank -> early rank of the aligned lines. Both map the ranks of common lines to the line."""
    out: dict[int, int] = {}
    todo = [(min(early), max(early) + 1, min(late), max(late) + 1)] if early and late else []
    e_ranks, l_ranks = sorted(early), sorted(late)
    while todo:
        e0, e1, l0, l1 = todo.pop()
        while e0 < e1 and l0 < l1 and early.get(e0, -1) == late.get(l0, -2):
            out[l0] = e0
            e0, l0 = e0 + 1, l0 + 1
        while e0 < e1 and l0 < l1 and early.get(e1 - 1, -1) == late.get(l1 - 1, -2):
            e1, l1 = e1 - 1, l1 - 1
            out[l1] = e1
        if e0 >= e1 or l0 >= l1:
            continue
        es = e_ranks[bisect_left(e_ranks, e0) : bisect_left(e_ranks, e1)]
        ls = l_ranks[bisect_left(l_ranks, l0) : bisect_left(l_ranks, l1)]
        e_count, l_count = Counter(early[e] for e in es), Counter(late[x] for x in ls)
        where = {early[e]: e for e in es if e_count[early[e]] == 1}
        unique = [(where[late[x]], x) for x in ls if l_count[late[x]] == 1 and late[x] in where]
        if not unique:
            # only repeated lines are left: each takes the next of its kind
            places: dict[int, list[int]] = {}
            for e in reversed(es):
                places.setdefault(early[e], []).append(e)
            for x in ls:
                own = places.get(late[x], [])
                while own and own[-1] < e0:
                    own.pop()
                if own:
                    out[x] = own.pop()
                    e0 = out[x] + 1
            continue
        done_e, done_l = e0, l0
        for e, x in _longest_increasing(unique):
            out[x] = e
            todo.append((done_e, e, done_l, x))
            done_e, done_l = e + 1, x + 1
        todo.append((done_e, e1, done_l, l1))
    return out


def doomed(early: dict[int, int], late: dict[int, int], words: dict[int, int], min_words: int) -> set[int]:
    """Late ranks in aligned blocks of at least ``min_words`` words."""
    met, out = align(early, late), set()
    block: list[int] = []
    for x in [*sorted(met), None]:
        if x is None or block and (x != block[-1] + 1 or met[x] != met[block[-1]] + 1):
            if sum(words[b] for b in block) >= min_words:
                out.update(block)
            block = []
        block.append(x)
    return out


def _aligned(min_words: int):
    """mapInArrow over (late, early, h1, h2, side, rank, at, words) sorted by the pair and the side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[int, int], int] = {}
        pair, early, late, words, at = None, {}, {}, {}, {}

        def close() -> list[tuple[int, int, int]]:
            return [(pair[0], at[x], words[x]) for x in sorted(doomed(early, late, words, min_words))] if pair else []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [()] * 3
            kinds = (pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "at", "words"])

        for batch in batches:
            rows: list[tuple] = []
            for a, b, h1, h2, side, rank, place, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != pair:
                    rows += close()
                    pair, names, early, late, words, at = (a, b), {}, {}, {}, {}, {}
                name = names.setdefault((h1, h2), len(names))
                if side:
                    late[rank], words[rank], at[rank] = name, n, place
                else:
                    early[rank] = name
            yield table(rows)
        yield table(close())

    return run


def runs(shared: DataFrame, min_words: int) -> DataFrame:
    """(id, h, lo, hi, n): the shortest runs of consecutive lines with ``min_words`` words.

    A run goes from a line onwards, or from a line back, until it has the words, which
    are at most as many lines; ``lo`` and ``hi`` are its places, ``n`` its lines. Each line
    of a block that is long enough to go is in such a run within the block.
    """
    out = []
    for sign in (1, -1):
        ends = (0, min_words - 1) if sign > 0 else (1 - min_words, 0)
        ahead = Window.partitionBy("id").orderBy("rank").rangeBetween(*ends)
        lines = F.collect_list(F.struct("rank", "h1", "h2", "words", "at")).over(ahead)
        start = F.struct(
            F.lit(0).alias("words"), F.col("rank").alias("next"), F.col("at").alias("end"), F.lit(sign).cast("long").alias("h")
        )

        def step(acc: Column, x: Column) -> Column:
            more = (acc["words"] < min_words) & (x["rank"] == acc["next"])
            return F.struct(
                F.when(more, acc["words"] + x["words"]).otherwise(acc["words"]).alias("words"),
                F.when(more, acc["next"] + sign).otherwise(acc["next"]).alias("next"),
                F.when(more, x["at"]).otherwise(acc["end"]).alias("end"),
                F.when(more, F.xxhash64(acc["h"], x["h1"], x["h2"])).otherwise(acc["h"]).alias("h"),
            )

        each = shared.withColumn("run", F.aggregate(lines if sign > 0 else F.reverse(lines), start, step))
        # a line that has the words alone is the same run in both directions
        each = each.where(f"run.words >= {min_words}" + ("" if sign > 0 else f" AND words < {min_words}"))
        out.append(
            each.select(
                "id", F.col("run.h").alias("h"), F.least("at", "run.end").alias("lo"),
                F.greatest("at", "run.end").alias("hi"), F.abs(F.col("run.next") - F.col("rank")).alias("n"),
            )
        )
    return out[0].unionByName(out[1]).distinct()


def aligned(pairs: DataFrame, shared: DataFrame, min_words: int) -> DataFrame:
    """(id, at, words) of the lines that go from the later documents of ``pairs``.

    A line of an early document that very many later ones have comes to them by a
    broadcast, all others by a shuffle.
    """
    late = pairs.join(shared.withColumnRenamed("id", "late").hint("merge"), "late").select(
        "late", "early", "h1", "h2", "rank", "at", "words"
    )
    late = common.stored(late, "late_lines")
    keys = ["early", "h1", "h2"]
    asked = common.stored(late.select("late", *keys).distinct(), "asked")
    places = shared.select(F.col("id").alias("early"), "h1", "h2", "rank").groupBy(*keys).agg(F.collect_list("rank").alias("e_ranks"))
    groups = asked.groupBy(*keys).agg(F.count("*").alias("n_late")).join(places.hint("merge"), keys)
    met = common.with_group(asked, common.stored(groups, "asked_lines"), keys, "n_late", asked.count())
    met = common.stored(met.select("late", *keys, "e_ranks"), "met")
    both = late.join(met.select("late", *keys).hint("merge"), ["late", *keys], "left_semi").select(
        "late", *keys, F.lit(True).alias("side"), "rank", "at", "words"
    ).unionByName(
        met.select(
            "late", *keys, F.lit(False).alias("side"), F.explode("e_ranks").alias("rank"),
            F.lit(0).alias("at"), F.lit(0).alias("words"),
        )
    )
    dealt = both.repartition("late").sortWithinPartitions("late", "early", "side", "rank")
    return dealt.mapInArrow(_aligned(min_words), "id long, at int, words int").distinct()


def still_there(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``held`` (id, lo, hi, n, ...) of which a line is not in ``gone``."""
    at = gone.groupBy("id").agg(F.collect_set("at").alias("ats"))
    rest = held.join(at.hint("merge"), "id", "left")
    met = F.size(F.filter("ats", lambda a: (a >= F.col("lo")) & (a <= F.col("hi"))))
    return rest.where(F.col("ats").isNull() | (met < F.col("n"))).select(*held.columns)


def repeated_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, at, words) of the lines of (id, text) to delete; id is a long."""
    docs = docs.where("id IS NOT NULL AND text IS NOT NULL")
    lines = lines_of(docs)
    if not docs.groupBy("id").count().where("count > 1").isEmpty():
        lines = lines.distinct()  # rows that repeat are one document
    lines = common.stored(lines, "lines")
    stats = (
        lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("own")).groupBy("h1", "h2")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum("own").alias("n_lines")).where("n > 1")
    )
    stats = common.stored(stats, "line_counts")
    shared = common.stored(common.with_group(lines, stats, ["h1", "h2"], "n_lines", lines.count()).drop("n_lines"), "shared")
    every = common.stored(runs(shared, min_words), "runs")
    first = common.stored(every.groupBy("h").agg(F.min("id").alias("early"), F.count("*").alias("n_runs")), "first_holders")
    held = common.with_group(every, first.where("n_runs > 1"), "h", "n_runs", every.count())
    held = common.stored(held.where("id <> early").drop("n_runs"), "held")
    pairs = shared.where(f"id <> first AND (n <= {rare} OR words >= {min_words})")
    pairs = pairs.select(F.col("id").alias("late"), F.col("first").alias("early"))
    pairs = common.stored(pairs.unionByName(held.select(F.col("id").alias("late"), "early")).distinct(), "pairs")
    gone = common.stored(aligned(pairs, shared, min_words), "gone_lines")

    # runs that their first holder did not take are tried with the next ones, twice as many each time
    left = common.stored(still_there(held, gone), "left")
    if left.isEmpty():
        return gone
    asked = common.stored(left.select("h").distinct().join(first.drop("early").hint("merge"), "h"), "asked_runs")
    holders = common.with_group(every.select("h", "id"), asked, "h", "n_runs", every.count()).select("h", "id").distinct()
    holders = common.stored(ranks.ranked_within(holders, "h", "id", "place"), "holders")
    left, low = left.join(holders.hint("merge"), ["h", "id"]), 2
    while not (left := common.stored(left.where(f"place > {low}"), "left")).isEmpty():
        some = holders.where(f"place >= {low} AND place < {2 * low}").select("h", F.col("id").alias("early"))
        met = left.select("h", F.col("id").alias("late")).join(some.hint("merge"), "h").where("early < late")
        more = met.select("late", "early").distinct().join(pairs.hint("merge"), ["late", "early"], "left_anti")
        more = common.stored(more, "pairs")
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            gone = common.stored(gone.unionByName(aligned(more, shared, min_words)).distinct(), "gone_lines")
            left = still_there(left, gone)
        low *= 2
    return gone


def dedup_lines(
    docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with cleaned texts, removed_lines (places among all lines) and removed_words."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} is no integer column")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = repeated_lines(rows, rare, min_words).groupBy("id").agg(
        F.sort_array(F.collect_list("at")).alias("at"), F.sum("words").alias("n")
    )
    a, b, key, split = common.fresh_names(docs, "removed_lines", "removed_words", "key", "split")
    gone = common.stored(gone.select(F.col("id").alias(key), F.col("at").alias(a), F.col("n").alias(b)), "gone")
    n_docs, n_lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(a)), F.lit(0))).first()
    if n_docs <= common.BROADCAST_ROWS and n_lines <= MOST_LINES:
        gone = F.broadcast(gone)
    out = docs.join(gone, docs[id_col] == gone[key], "left")
    # a document loses few of its lines or most: both arrays are short next to its text
    lines = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(a))
    left = F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n")
    out = out.withColumn(split, F.when(F.col(a).isNotNull(), lines))
    return out.select(
        *[
            (F.when(F.col(a).isNotNull(), left).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c))
            for c in docs.columns
        ],
        F.coalesce(a, F.array().cast("array<int>")).alias(a),
        F.coalesce(b, F.lit(0)).cast("long").alias(b),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all ``documents``, cleaned."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
