"""Quality rules: base counts of each text, and lines that too much of a host shares.

Lines are normalised and hashed; for each host (``source``) the distinct documents
that hold a line are counted, documents with equal texts as one; lines above the
limits are removed, except from the first document (smallest id) of the host
that holds them, so that no text is lost everywhere; a document that lost more
than ``max_removed`` of its words is depleted and rejected, as are those that
fail the base rules. All of it is DataFrame code. No table of all lines is written:
they are read once for the counts and once for the hits, as each file that Spark
writes to a local folder starts a process (see ``shared.stored``).

Defined cases: a null or empty text has no words and fails the base rules; a null
host is a host of its own; documents on one line, however long, are one line;
a repeated row counts once as a document and gets a result row each; a row without
an id loses no lines; an empty table gives an empty result; other columns, whatever
their names, are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Limits:
    """A line goes if more than ``share`` of the host's distinct documents and more
    than ``docs`` of them hold it."""

    min_words: int = 50
    max_repeat_pct: int = 50
    share: float = 0.05
    docs: int = 20
    max_removed: float = 0.7


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, common.SPACE_CLASS + "+")
    )


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normal_line(line: Column) -> Column:
    spaced = F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\f\r")), common.SPACE_CLASS + "+", " ")
    return F.lower(spaced)


def counted(docs: DataFrame) -> DataFrame:
    """(id, host, text) with the base counts and the lines that have words.

    Each step is a projection of its own: what a later lambda reads many times is
    computed once.
    """
    n = F.size("words")
    a = docs.withColumn("words", words_of(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), has_word)
    )
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    b = a.withColumn(
        "windows",
        F.transform(starts, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    c = b.withColumn(
        "sorted",
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    d = c.withColumn(
        "again",
        F.when(
            F.col("sorted").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        "sorted",
                        lambda e, k: (F.coalesce(F.get("sorted", k - 1)["h"] == e["h"], F.lit(False)))
                        | (F.coalesce(F.get("sorted", k + 1)["h"] == e["h"], F.lit(False))),
                    ),
                    lambda e: e["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.cast("int").alias("last")
        ),
        lambda acc: acc["n"],
    )
    symbols = F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]", ""))
    return d.select(
        "id", "host", "text", "lines",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """(id, host, text_key, at, line, n_line) of the lines with words of (id, host, text).

    ``line`` is the hash of the normal line, ``n_line`` its words, ``at`` its place among all lines.
    """
    each = docs.select("id", "host", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    line = each.where(has_word(F.col("raw"))).select("id", "host", "text_key", "at", normal_line(F.col("raw")).alias("line"))
    spaces = F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    return line.select("id", "host", "text_key", "at", F.xxhash64("line").alias("line"), (spaces + 1).alias("n_line"))


def common_lines(docs: DataFrame, lines: DataFrame, limits: Limits) -> DataFrame:
    """(host, line) above the limits, with the first document that holds it.

    The first shuffle is by host, line and text, so a line that a third of all
    documents hold is spread; the second gets partial counts.
    """
    once = lines.groupBy("host", "line", "text_key").agg(F.min("id").alias("first"))
    counts = once.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    hosts = docs.groupBy("host").agg(F.count_distinct(F.xxhash64("text")).alias("n_docs"))
    hosts = hosts.withColumnRenamed("host", "h")
    above = counts.where(F.col("n") > limits.docs).join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return above.where(F.col("n") > F.col("n_docs") * limits.share).select("host", "line", "first", "n")


def removed_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id, text_key, at, n_line) of the lines that go. ``docs``: (id, host, text)."""
    lines = host_lines(docs)
    above = common_lines(docs, lines, limits).select(F.col("host").alias("h"), F.col("line").alias("k"), "first")
    # one file, which holds them all unless it is full; it is not used then (Spark drops a limit above the rows it counted)
    found = common.written(above.limit(common.BROADCAST_ROWS + 1).repartition(1), "common_lines")
    if found.count() <= common.BROADCAST_ROWS:
        found = F.broadcast(found)
    else:  # a join of two shuffled sides, whose skewed keys are split
        found = common.written(above, "common_lines")
    hit = lines.join(found, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("k"))).where("id <> first")
    # a row that repeats counts its lines once
    return hit.select("id", "text_key", "at", "n_line").distinct()


def line_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id, text_key, removed_words, removed_lines) of the documents that lose lines. ``docs``: (id, host, text)."""
    gone = removed_lines(docs, limits)
    return gone.groupBy("id", "text_key").agg(F.sum("n_line").alias("removed_words"), F.count("*").alias("removed_lines"))


def quality_rules(
    docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """A row per row of ``docs``: its counts, base_failed, removed_words, removed_lines, depleted, kept."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    lost = line_rules(rows, limits).select(
        F.col("id").alias("lost_id"), F.col("text_key").alias("lost_key"), "removed_words", "removed_lines"
    )
    base = counted(rows).withColumn("text_key", F.xxhash64("text")).drop("text", "lines")
    out = base.join(lost, (F.col("id") == F.col("lost_id")) & (F.col("text_key") == F.col("lost_key")), "left")
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words")
    )
    removed = F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = removed > F.col("n_words") * limits.max_removed
    return out.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), removed.alias("removed_words"),
        F.coalesce(F.col("removed_lines"), F.lit(0)).alias("removed_lines"),
        depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
    )


def keep_good(
    docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` that the rules keep; an id goes if none of its rows is kept."""
    verdicts = quality_rules(docs, limits, id_col, text_col, host_col)
    gone = verdicts.groupBy(F.col("id").alias(id_col)).agg(F.max("kept").alias("kept")).where("NOT kept")
    return common.without(docs, common.written(gone.select(id_col), "rejected"), [id_col])


def without_common_lines(
    docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """``docs`` with the lines above the limits taken out of their texts; a text that loses none stays as it is."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    own, key, places, split = common.fresh_names(docs, "own", "key", "places", "split")
    gone = removed_lines(rows, limits).groupBy(F.col("id").alias(own), F.col("text_key").alias(key)).agg(
        F.collect_list("at").alias(places)
    )
    gone = common.written(gone, "gone_lines")
    n_docs, n_lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    if n_docs <= common.BROADCAST_ROWS and n_lines <= 1 << 20:  # 4 bytes a line
        gone = F.broadcast(gone)
    out = docs.join(gone, (docs[id_col] == gone[own]) & (F.xxhash64(docs[text_col]) == gone[key]), "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    left = F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n")
    out = out.withColumn(split, F.when(F.col(places).isNotNull(), lines))
    cleaned = F.when(F.col(places).isNotNull(), left).otherwise(F.col(text_col)).alias(text_col)
    return out.select(*[cleaned if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all ``documents``, hosts by ``source``."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
      FROM (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(lines) AS line FROM w),
k AS (SELECT doc_id, source, text, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_line,
        lower(regexp_replace(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
f AS (SELECT source, line, count(DISTINCT text) AS n, min(doc_id) AS first FROM k GROUP BY source, line),
h AS (SELECT source, count(DISTINCT text) AS n_docs FROM d GROUP BY source),
a AS (SELECT f.* FROM f JOIN h USING (source) WHERE n > 20 AND n > n_docs * 0.05),
x AS (SELECT doc_id, sum(n_line) AS removed_words, count(*) AS removed_lines
      FROM k JOIN a USING (source, line) WHERE doc_id <> first GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words > n_words * 0.7 AS depleted FROM b)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v
"""
