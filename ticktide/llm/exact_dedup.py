"""Exact dedup against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest, in a folder
that outlives the session. A batch is reduced to one row per digest and probed
once by a sort-merge join with what the index has: the digests that it lacks (the
anti-join) are appended, those that it has bring their kept ids. Everything is
DataFrame code; only digests and ids are shuffled, never texts.

Each append is a generation: one sorted file per bucket, read in stored order, so
that the join shuffles and sorts nothing of the index. Beyond ``MOST`` generations
they are merged into one. A log of versions tells which generations count; what a
broken append left is never read. One writer at a time.

Defined cases: a null text is the empty text, and empty texts are equal to each
other; texts are equal if identical after lower-casing A-Z; of a batch's equal
texts the row with the largest id stays (nulls last), one of them if rows repeat;
every row gets a result row; a digest that an earlier batch brought keeps that
batch's row; an empty table gives an empty result; other columns, whatever their
names, are not touched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Generations that are kept side by side.
MOST = 8
#: Lets the scan of a bucket with one file report its stored order.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _stored_order(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_ORDERED, None)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ORDERED)
        else:
            spark.conf.set(_ORDERED, before)


class DigestIndex:
    """Digests seen so far: (digest, keep_id, n_rows), in generations below ``path``.

    The number of buckets is fixed by the first append (the session's shuffle
    partitions if not given) and kept in the log, so that any session reads it right.
    """

    LOG = "name string, buckets int"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        _, self.names, stored = self._newest()
        self.buckets = stored or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}

    def _newest(self) -> tuple[int, list[str], int | None]:
        """(version, generations, buckets) as the log has them."""
        try:
            log = self.spark.read.schema(f"{self.LOG}, version int").parquet(f"{self.path}/log")
            rows = log.orderBy(F.col("version").desc()).limit(MOST + 1).collect()  # a version has at most MOST rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if not rows:
            return -1, [], None
        own = [r for r in rows if r.version == rows[0].version]
        return own[0].version, sorted(r.name for r in own), own[0].buckets

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            folder = f"{self.path}/{name}"
            self.tables[name] = table = "digest_index_" + hashlib.sha1(folder.encode()).hexdigest()[:16]
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id {self.id_type}, n_rows BIGINT) "
                f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
            )
        return self.spark.table(self.tables[name])

    def generations(self) -> list[DataFrame]:
        """The tables to be joined; one without rows where there is none yet."""
        return [self._table(name) for name in self.names or ["none"]]

    def read(self) -> DataFrame:
        out, *more = self.generations()
        for one in more:
            out = out.unionByName(one)
        return out

    def _write(self, rows: DataFrame) -> str:
        name = f"generation-{uuid.uuid4().hex}"
        self._table(name)
        # the bucket of a digest is its partition here, so a bucket is one file
        rows.select("digest", "keep_id", "n_rows").repartition(self.buckets, "digest").write.insertInto(self.tables[name])
        return name

    def append(self, fresh: DataFrame) -> None:
        """A generation of digests that the index does not have, and the version of the log with it."""
        version, names, _ = self._newest()
        if names != self.names:
            raise RuntimeError(f"another writer has changed the index at {self.path}")
        names = [*names, self._write(fresh)]
        old = []
        if len(names) > MOST:
            self.names, old = names, names
            # written first: Spark takes the union of bucketed scans for dealt by digest already
            names = [self._write(common.written(self.read(), "merged"))]
        log = self.spark.createDataFrame([(n, self.buckets) for n in names], self.LOG)
        log.coalesce(1).write.parquet(f"{self.path}/log/version={version + 1}")
        self.names = sorted(names)
        for name in old:  # merged; the newest version does not name them
            self.forget([name])
            common.delete(self.spark, f"{self.path}/{name}")

    def probe(self, groups: DataFrame) -> DataFrame:
        """``groups`` (with digest) with ``known``, whether the index has them, and ``known_id``. To be written under ``_stored_order``."""
        out = groups.withColumns({"known": F.lit(False), "known_id": F.lit(None).cast(self.id_type)})
        for one in self.generations():
            seen = one.select("digest", F.col("keep_id").alias("seen_id"), F.lit(True).alias("seen"))
            out = out.join(seen.hint("merge"), "digest", "left").select(
                *groups.columns, F.coalesce("seen", "known").alias("known"),
                F.when(F.col("seen"), F.col("seen_id")).otherwise(F.col("known_id")).alias("known_id"),
            )
        return out

    def forget(self, names: list[str] | None = None) -> None:
        """Take the index's tables out of the session's catalogue; the files stay."""
        for name in list(self.tables) if names is None else names:
            if table := self.tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def digest(text) -> F.Column:
    return F.sha2(common.ascii_lower(F.coalesce(text, F.lit(""))), 256)


def exact_dedup(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Verdicts of a batch; its new digests are in ``index`` afterwards.

    Returns (id, digest, keep_id, group_size, kept), a row per row of ``docs``. Of
    the rows with the kept id and text, where they repeat, one is kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    rows = common.numbered(rows, "digests", "at")
    # partial aggregates: a digest that a third of all rows has is one row per task before the shuffle
    groups = rows.groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.coalesce(F.max_by("at", "id"), F.min("at")).alias("keep_at"), F.count("*").alias("group_size")
    )
    with _stored_order(docs.sparkSession):
        groups = common.written(index.probe(groups), "verdicts")
    fresh = groups.where("NOT known")
    index.append(fresh.select("digest", "keep_id", F.col("group_size").alias("n_rows")))
    keep = F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id"))
    out = common.with_group(rows, groups, "digest", "group_size", rows.count())
    return out.select(
        "id", "digest", keep.alias("keep_id"), "group_size", (~F.col("known") & (F.col("at") == F.col("keep_at"))).alias("kept")
    )


def keep_one(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one for each new text."""
    verdicts = common.written(exact_dedup(docs, index, id_col, text_col), "exact")
    key = common.fresh_name(docs, "digest")
    keys = [id_col, key]
    named = docs.withColumn(key, digest(F.col(text_col)))
    # rows that repeat have a kept one and others: those are no reason to drop what they equal
    per = verdicts.groupBy(F.col("id").alias(id_col), F.col("digest").alias(key)).agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")
    )
    per = common.written(per.where("NOT kept OR n > 1"), "dropped")
    out = common.without(named, per.where("NOT kept").select(*keys), keys)
    repeated = per.where("kept").select(*keys)
    if not repeated.isEmpty():
        once = out.join(repeated, common.same(out, repeated, keys), "left_semi").dropDuplicates(keys)
        out = common.without(out, repeated, keys).unionByName(once)
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every row of ``documents`` against an index that is new."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = DigestIndex(spark, common.new_path(spark, "digest_index"))
    out = exact_dedup(docs, index)
    index.forget()
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
