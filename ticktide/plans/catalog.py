"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions.columns import artifact_name, floor_div, utc_day
from ..operators import book, canonical, catalogue, convert, delivery, epoch, order, pacing, validate
from ..schema import KEY, SNAPSHOT
from ..sources import tables

FROM_TS = 1_705_000_000_000_000_000
CAPACITY, EVERY, START = 1024, 100, 1_000_000
SPEED = pacing.Speed(3, 7)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RECORDS = """records AS (
  SELECT epoch_us(date_trunc('hour', ts)) * 1000 AS exchange_ts, event_id AS sequence_number, user_id % 8 AS instrument_id,
    CAST(user_id % 4 + 1 AS INT) AS venue_id, CAST(event_id % 2 AS INT) AS side_flags,
    CAST(round(value * 100) AS BIGINT) % 20 AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS size,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS record_type, event_type, event_id
  FROM events)"""
SNAPS = f"""{RECORDS}, base AS (SELECT * REPLACE (CASE WHEN event_type = 'signup' THEN 2 ELSE record_type END AS record_type) FROM records),
snaps AS (SELECT exchange_ts, sequence_number, instrument_id, venue_id, record_type,
    CASE WHEN record_type = 2 THEN 0 ELSE side_flags END AS side_flags,
    CASE WHEN record_type = 2 THEN 0 ELSE price END AS price, CASE WHEN record_type = 2 THEN 0 ELSE size END AS size,
    CASE WHEN record_type = 2 THEN [{{price: price, size: size + 1}}, {{price: price - 2, size: 3}}] END AS bids,
    CASE WHEN record_type = 2 THEN [{{price: price + 5, size: size + 1}}, {{price: price + 7, size: 3}}] END AS asks FROM base)"""
K = "exchange_ts, venue_id, sequence_number, instrument_id"
SOURCE = f"""{RECORDS}, src AS (SELECT event_id AS row_index, exchange_ts, sequence_number, instrument_id,
    CASE WHEN event_id % 97 = 0 THEN 65536 ELSE venue_id END AS venue_id,
    CASE WHEN event_id % 89 = 0 THEN 3 WHEN event_type = 'signup' THEN 2 ELSE record_type END AS record_type,
    CASE WHEN event_id % 83 = 0 THEN 2 WHEN event_type = 'signup' THEN 0 ELSE side_flags END AS side_flags,
    CASE WHEN event_type = 'signup' AND event_id % 71 <> 0 THEN 0 ELSE price END AS price,
    CASE WHEN event_type = 'signup' THEN 0 ELSE size END AS size,
    CASE WHEN event_type = 'signup' OR event_id % 79 = 0 THEN [
      {{side: CASE WHEN event_id % 61 = 0 THEN 2 ELSE event_id % 2 END, price: price, size: size}},
      {{side: (event_id + 1) % 2, price: price + 1, size: 2}}, {{side: event_id % 2, price: price + 3, size: 4}}] ELSE [] END AS levels
  FROM records),
rejects AS (SELECT *, CASE WHEN venue_id > 65535 THEN 'VenueIdRange' WHEN record_type > 2 THEN 'RecordTypeRange'
    WHEN side_flags > 1 THEN 'SideFlagsRange' WHEN record_type <> 2 AND len(levels) > 0 THEN 'LevelsOnNonSnapshot'
    WHEN record_type = 2 AND (price <> 0 OR size <> 0 OR side_flags <> 0) THEN 'SnapshotFieldSet'
    WHEN len(list_filter(levels, lambda x: x.side > 1)) > 0 THEN 'LevelSide' END AS reject FROM src)"""


def book_sql(ts: str) -> str:
    """A CTE ``book``: the books of ``snaps`` before a time."""
    return f"""live AS (SELECT * FROM snaps WHERE exchange_ts < {ts} AND record_type <> 1),
seg AS (SELECT *, sum(CASE WHEN record_type = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY venue_id, instrument_id ORDER BY {K}) AS seg,
    sum(CASE WHEN record_type = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY venue_id, instrument_id) AS last_seg FROM live),
ev AS (SELECT {K}, seg, side_flags AS side, price, size, false AS snap FROM seg WHERE record_type = 0 AND seg = last_seg
  UNION ALL SELECT {K}, seg, 0, l.price, l.size, true FROM (SELECT *, unnest(bids) AS l FROM seg WHERE record_type = 2 AND seg = last_seg)
  UNION ALL SELECT {K}, seg, 1, l.price, l.size, true FROM (SELECT *, unnest(asks) AS l FROM seg WHERE record_type = 2 AND seg = last_seg)),
lst AS (SELECT *, row_number() OVER (PARTITION BY venue_id, instrument_id, side, price ORDER BY exchange_ts DESC, sequence_number DESC) AS rn FROM ev),
book AS (SELECT venue_id, instrument_id, side, price, size FROM lst WHERE rn = 1 AND (snap OR size <> 0))"""


BOUNDS = f"""g AS (SELECT venue_id, exchange_ts, count(*) AS n, max(sequence_number) AS last_seq,
    row_number() OVER (PARTITION BY venue_id ORDER BY exchange_ts) AS i, count(*) OVER (PARTITION BY venue_id) AS m
  FROM snaps GROUP BY venue_id, exchange_ts),
walk AS (
  SELECT venue_id, i, m, exchange_ts, last_seq, n AS since FROM g WHERE i = 1
  UNION ALL SELECT g.venue_id, g.i, g.m, g.exchange_ts, g.last_seq, CASE WHEN w.since >= {EVERY} THEN 0 ELSE w.since END + g.n
  FROM walk w JOIN g ON g.venue_id = w.venue_id AND g.i = w.i + 1),
bounds AS (SELECT venue_id, row_number() OVER (PARTITION BY venue_id ORDER BY i) - 1 AS epoch, exchange_ts, last_seq
  FROM walk WHERE since >= {EVERY} AND i < m)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_EMIT = "SELECT exchange_ts, venue_id, sequence_number, instrument_id, row_number() OVER (ORDER BY {K}) - 1 AS emit_index FROM records"


@query("replay_from_ts", f"WITH {RECORDS} {_EMIT.format(K=K)} WHERE exchange_ts >= {FROM_TS}")
def _(spark, sf):
    """M-04, M-06, M-13: the tail of the replay from a time, with its own index."""
    return order.with_emit_index(order.seek(tables.records(spark, sf), FROM_TS)).select(*KEY, "emit_index")


@query("replay_full_emit_index", f"WITH {RECORDS} {_EMIT.format(K=K)}")
def _(spark, sf):
    """M-01, M-13."""
    return order.with_emit_index(tables.records(spark, sf)).select(*KEY, "emit_index")


@query("merge_venues", f"WITH {RECORDS} SELECT *, emit_index - row_number() OVER (PARTITION BY venue_id ORDER BY emit_index) + 1 AS before_of_others FROM ({_EMIT.format(K=K)})")
def _(spark, sf):
    """M-04, V-08, M-14: the union of venue streams, one of them empty; what comes before from others."""
    every, path = tables.records(spark, sf), shared.new_path(spark, "venues")
    every.withColumn("v", F.col("venue_id")).write.partitionBy("v").parquet(path)  # a table for each venue
    streams = [spark.read.schema(every.schema).parquet(f"{path}/v={v}") for v in (1, 2, 3, 4)]
    out = order.with_emit_index(order.merge([*streams, every.limit(0)])).select(*KEY, "emit_index")
    return order.with_position(out).select(*KEY, "emit_index", (F.col("emit_index") - F.col("position")).alias("before_of_others"))


@query("seek_suffix_check", f"""WITH {RECORDS}, f AS ({_EMIT.format(K=K)}), s AS ({_EMIT.format(K=K)} WHERE exchange_ts >= {FROM_TS}),
n AS (SELECT count(*) AS skipped FROM records WHERE exchange_ts < {FROM_TS})
SELECT count(*) AS n_tail, count(*) FILTER (f.emit_index = s.emit_index + skipped) AS n_same, any_value(skipped) AS skipped
FROM s JOIN f USING (exchange_ts, venue_id, sequence_number, instrument_id) CROSS JOIN n""")
def _(spark, sf):
    """M-06: a seek gives exactly the tail of the whole replay."""
    every = tables.records(spark, sf)
    full = order.with_emit_index(every).select(*KEY, "emit_index")
    tail = order.with_emit_index(order.seek(every, FROM_TS)).select(*KEY, F.col("emit_index").alias("tail_index"))
    skipped = every.where(F.col("exchange_ts") < FROM_TS).agg(F.count("*").alias("skipped"))
    both = tail.join(full, list(KEY)).join(F.broadcast(skipped))  # one row
    return both.agg(
        F.count("*").alias("n_tail"), F.count_if(F.expr("emit_index = tail_index + skipped")).alias("n_same"),
        F.any_value("skipped").alias("skipped"),
    )


@query("venue_subsequences", f"WITH {RECORDS} SELECT {K}, row_number() OVER (PARTITION BY venue_id ORDER BY {K}) - 1 AS position FROM records")
def _(spark, sf):
    """M-11: every venue's stream."""
    return order.with_position(tables.records(spark, sf)).select(*KEY, "position")


@query("venue_record_counts", f"WITH {RECORDS} SELECT venue_id, count(*) AS n_records, count(*) FILTER (record_type = 1) AS n_trades FROM records GROUP BY venue_id")
def _(spark, sf):
    """A-08, S-15."""
    return tables.records(spark, sf).groupBy("venue_id").agg(F.count("*").alias("n_records"), F.count_if(F.expr("record_type = 1")).alias("n_trades"))


@query("venue_ts_range", f"WITH {RECORDS} SELECT venue_id, min(exchange_ts) AS min_ts, max(exchange_ts) AS max_ts, count(*) AS n_records FROM records GROUP BY venue_id")
def _(spark, sf):
    """V-04."""
    return order.venue_ranges(tables.records(spark, sf))


@query("header_range_check", f"WITH {RECORDS} SELECT venue_id, min(exchange_ts) AS min_ts, max(exchange_ts) + venue_id % 2 AS max_ts FROM records GROUP BY venue_id HAVING venue_id % 2 = 1")
def _(spark, sf):
    """V-04: stated ranges that differ from the records; odd venues state a wrong one."""
    every = tables.records(spark, sf)
    stated = order.venue_ranges(every).select("venue_id", "min_ts", (F.col("max_ts") + F.col("venue_id") % 2).alias("max_ts"))
    return order.check_ranges(every, stated).select("venue_id", "min_ts", "max_ts")


_DAY = "(exchange_ts - ((exchange_ts % 86400000000000) + 86400000000000) % 86400000000000) // 86400000000000"


@query("partition_by_venue_day", f"WITH {RECORDS} SELECT venue_id, {_DAY} AS day, count(*) AS n_records FROM records GROUP BY ALL")
def _(spark, sf):
    """P-04, W-01."""
    dated = tables.records(spark, sf).withColumn("day", utc_day(F.col("exchange_ts")))
    return dated.groupBy("venue_id", "day").agg(F.count("*").alias("n_records"))


@query("artifact_file_names", f"WITH {RECORDS} SELECT 'venue-' || venue_id || '-' || strftime(DATE '1970-01-01' + CAST({_DAY} AS INT), '%Y-%m-%d') || '.bin' AS artifact, count(*) AS n_records FROM records GROUP BY ALL")
def _(spark, sf):
    """P-05."""
    return convert.with_partition(tables.records(spark, sf)).groupBy("artifact").agg(F.count("*").alias("n_records"))


@query("floor_division", f"WITH {RECORDS}, x AS (SELECT sequence_number, price * 7 - 60 AS a FROM records) SELECT sequence_number, a, CAST(floor(a / 13.0) AS BIGINT) AS q FROM x")
def _(spark, sf):
    """P-06."""
    x = tables.records(spark, sf).select("sequence_number", (F.col("price") * 7 - 60).alias("a"))
    return x.withColumn("q", floor_div(F.col("a"), 13))


_PERM = f"permuted AS (SELECT *, (sequence_number * 7919) % 10007 AS position FROM records UNION ALL SELECT *, 20000 + sequence_number FROM records WHERE sequence_number % 50 = 0)"


def _permuted(spark, sf):
    every = tables.records(spark, sf)
    place = (F.col("sequence_number") * 7919) % 10007
    return every.withColumn("position", place).unionByName(
        every.where("sequence_number % 50 = 0").withColumn("position", F.lit(20000) + F.col("sequence_number"))
    )


@query("duplicate_keys", f"WITH {RECORDS}, {_PERM} SELECT {K}, count(*) AS n FROM permuted GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    """V-05."""
    return order.duplicate_keys(_permuted(spark, sf))


@query("order_violations", f"""WITH {RECORDS}, {_PERM}, p AS (SELECT *, row(exchange_ts, venue_id, sequence_number, instrument_id) AS k FROM permuted),
l AS (SELECT *, lag(k) OVER (PARTITION BY venue_id ORDER BY position, sequence_number) AS b FROM p)
SELECT venue_id, CASE WHEN k = b THEN 'DuplicateKey' ELSE 'OutOfOrder' END AS kind, count(*) AS n FROM l WHERE k <= b GROUP BY ALL""")
def _(spark, sf):
    """V-05, M-03, M-16: keys that do not increase in the order of a permuted stream."""
    rows = _permuted(spark, sf).withColumn("place", F.struct("position", "sequence_number"))
    return order.order_violations(rows, "place").groupBy("venue_id", "kind").agg(F.count("*").alias("n"))


@query("ts_decreases", f"""WITH {RECORDS}, {_PERM}, m AS (SELECT *, max(exchange_ts) OVER (PARTITION BY venue_id ORDER BY position, sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_max FROM permuted)
SELECT venue_id, count(*) AS n, max(earlier_max - exchange_ts) AS worst FROM m WHERE exchange_ts < earlier_max GROUP BY venue_id""")
def _(spark, sf):
    """V-06."""
    rows = _permuted(spark, sf).withColumn("place", F.struct("position", "sequence_number"))
    bad = order.ts_decreases(rows, "place")
    return bad.groupBy("venue_id").agg(F.count("*").alias("n"), F.max(F.col("earlier_max") - F.col("exchange_ts")).alias("worst"))


@query("reject_classes", f"WITH {SOURCE} SELECT reject, count(*) AS n, min(row_index) AS first_row FROM rejects WHERE reject IS NOT NULL GROUP BY reject")
def _(spark, sf):
    """V-01: classes of bad rows, each by the first rule it breaks."""
    rows = tables.source_rows(spark, sf).withColumn("reject", validate.reject_class()).where("reject IS NOT NULL")
    return rows.groupBy("reject").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


@query("first_fault", f"WITH {SOURCE} SELECT row_index, reject FROM rejects WHERE reject IS NOT NULL ORDER BY row_index LIMIT 1")
def _(spark, sf):
    """V-01: what a rejected conversion reports."""
    rows = tables.source_rows(spark, sf).select("row_index", validate.reject_class().alias("reject"))
    return rows.where("reject IS NOT NULL").orderBy("row_index").limit(1)


@query("split_levels_sorted", f"""WITH {SOURCE}, l AS (SELECT row_index, unnest(levels) AS x, generate_subscripts(levels, 1) AS i FROM rejects WHERE reject IS NULL AND record_type = 2)
SELECT row_index, CAST(x.side AS INT) AS side, CAST(row_number() OVER (PARTITION BY row_index, x.side ORDER BY CASE WHEN x.side = 0 THEN -x.price ELSE x.price END, i) AS INT) AS rank,
  x.price AS price, CAST(x.size AS BIGINT) AS size FROM l""")
def _(spark, sf):
    """V-02, B-07, B-08: levels by side, best first."""
    good = tables.source_rows(spark, sf).where(validate.reject_class().isNull() & (F.col("record_type") == SNAPSHOT))
    records = validate.to_records(good)
    parts = [
        records.select("row_index", F.lit(s).alias("side"), F.posexplode(c).alias("at", "x")) for s, c in ((0, "bids"), (1, "asks"))
    ]
    return parts[0].unionByName(parts[1]).select("row_index", "side", (F.col("at") + 1).alias("rank"), "x.price", "x.size")


@query("record_faults", f"""WITH {SOURCE}, f AS (SELECT CASE WHEN record_type > 2 THEN 'RecordType' WHEN side_flags > 1 THEN 'SideFlags'
  WHEN record_type = 2 AND (price <> 0 OR size <> 0 OR side_flags <> 0) THEN 'UnusedFieldSet'
  WHEN record_type <> 2 AND len(levels) > 0 THEN 'UnusedFieldSet' END AS fault FROM src) SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault""")
def _(spark, sf):
    """V-03."""
    rows = tables.source_rows(spark, sf).withColumns({"bids": F.col("levels"), "asks": F.lit(None).cast("array<struct<side: bigint, price: bigint, size: bigint>>")})
    return rows.select(validate.record_fault().alias("fault")).where("fault IS NOT NULL").groupBy("fault").agg(F.count("*").alias("n"))


@query("seek_index_per_venue", f"WITH {RECORDS} SELECT venue_id, count(*) FILTER (exchange_ts < {FROM_TS}) AS seek_index, count(*) AS n FROM records GROUP BY venue_id")
def _(spark, sf):
    """M-07, M-09."""
    return order.seek_index(tables.records(spark, sf), FROM_TS)


_PLACED = f"placed AS (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY {K}) - 1 AS position FROM snaps)"


@query("snapshot_before", f"WITH {SNAPS}, {_PLACED} SELECT venue_id, position, max(CASE WHEN record_type = 2 THEN position END) OVER (PARTITION BY venue_id ORDER BY position) AS snapshot_before FROM placed")
def _(spark, sf):
    """M-08, M-10."""
    placed = order.with_position(tables.with_snapshots(spark, sf))
    return order.snapshot_before(placed).select("venue_id", "position", "snapshot_before")


@query("epoch_runs", f"""WITH {SNAPS}, {_PLACED}, r AS (SELECT venue_id, position, position - row_number() OVER (PARTITION BY venue_id ORDER BY position) AS run FROM placed WHERE record_type = 2)
SELECT venue_id, min(position) AS first_position, max(position) AS last_position, count(*) AS n FROM r GROUP BY venue_id, run""")
def _(spark, sf):
    """J-02."""
    return order.epoch_runs(order.with_position(tables.with_snapshots(spark, sf)))


@query("record_at", f"WITH {SNAPS}, {_PLACED} SELECT venue_id, position, exchange_ts, sequence_number, instrument_id, record_type FROM placed WHERE position IN (0, 17, 100)")
def _(spark, sf):
    """S-03."""
    placed = order.with_position(tables.with_snapshots(spark, sf))
    return placed.where(F.col("position").isin(0, 17, 100)).select("venue_id", "position", "exchange_ts", "sequence_number", "instrument_id", "record_type")


@query("book_at_ts", f"WITH {SNAPS}, {book_sql(FROM_TS)} SELECT * FROM book")
def _(spark, sf):
    """B-02, B-03, B-09."""
    return book.book_at(tables.with_snapshots(spark, sf), FROM_TS)


@query("book_deltas_only", f"WITH {SNAPS}, {book_sql(FROM_TS).replace('FROM snaps', 'FROM (SELECT * FROM snaps WHERE record_type <> 2)')} SELECT * FROM book")
def _(spark, sf):
    """B-03, B-04: books that no snapshot begins."""
    return book.book_at(tables.with_snapshots(spark, sf).where("record_type <> 2"), FROM_TS)


@query("book_all_instruments", f"""WITH {SNAPS}, {book_sql('9223372036854775807')} SELECT *, CAST(row_number() OVER (PARTITION BY venue_id, instrument_id, side ORDER BY CASE WHEN side = 0 THEN -price ELSE price END) AS INT) AS rank FROM book""")
def _(spark, sf):
    """B-07, B-08, B-13."""
    return book.ranked(book.book_at(tables.with_snapshots(spark, sf)))


_BEST = """b AS (SELECT venue_id, instrument_id, max(CASE WHEN side = 0 THEN price END) AS bid_price, min(CASE WHEN side = 1 THEN price END) AS ask_price FROM book GROUP BY ALL),
best AS (SELECT b.venue_id, b.instrument_id, bid_price, x.size AS bid_size, ask_price, y.size AS ask_size FROM b
  LEFT JOIN book x ON x.venue_id = b.venue_id AND x.instrument_id = b.instrument_id AND x.side = 0 AND x.price = bid_price
  LEFT JOIN book y ON y.venue_id = b.venue_id AND y.instrument_id = b.instrument_id AND y.side = 1 AND y.price = ask_price)"""


@query("best_bid_ask", f"WITH {SNAPS}, {book_sql(FROM_TS)}, {_BEST} SELECT * FROM best")
def _(spark, sf):
    """B-05, B-06."""
    return book.best(book.book_at(tables.with_snapshots(spark, sf), FROM_TS))


@query("crossed_books", f"WITH {SNAPS}, {book_sql(FROM_TS)}, {_BEST} SELECT * FROM best WHERE bid_price >= ask_price")
def _(spark, sf):
    """B-05, B-06: books whose best bid reaches the best ask."""
    return book.crossed(book.book_at(tables.with_snapshots(spark, sf), FROM_TS))


@query("top_levels", f"""WITH {SNAPS}, {book_sql(FROM_TS)} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY venue_id, instrument_id, side ORDER BY CASE WHEN side = 0 THEN -price ELSE price END) AS INT) AS rank FROM book) WHERE rank <= 3""")
def _(spark, sf):
    """B-07, B-08."""
    return book.top(book.book_at(tables.with_snapshots(spark, sf), FROM_TS), 3)


@query("book_depth", f"WITH {SNAPS}, {book_sql(FROM_TS)} SELECT venue_id, instrument_id, side, count(*) AS n_levels, CAST(sum(size) AS BIGINT) AS total_size FROM book GROUP BY ALL")
def _(spark, sf):
    """B-07, B-08."""
    return book.depth(book.book_at(tables.with_snapshots(spark, sf), FROM_TS))


@query("book_divergence", f"""WITH {SNAPS}, live AS (SELECT * FROM snaps WHERE record_type <> 1),
seg AS (SELECT *, sum(CASE WHEN record_type = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY venue_id, instrument_id ORDER BY {K}) AS seg FROM live),
ev AS (SELECT {K}, seg, side_flags AS side, price, size, false AS snap FROM seg WHERE record_type = 0
  UNION ALL SELECT {K}, seg, 0, l.price, l.size, true FROM (SELECT *, unnest(bids) AS l FROM seg WHERE record_type = 2)
  UNION ALL SELECT {K}, seg, 1, l.price, l.size, true FROM (SELECT *, unnest(asks) AS l FROM seg WHERE record_type = 2)),
p AS (SELECT *, lag(snap OR size <> 0) OVER (PARTITION BY venue_id, instrument_id, seg, side, price ORDER BY exchange_ts, sequence_number) AS there FROM ev)
SELECT venue_id, instrument_id, exchange_ts, sequence_number, side, price FROM p WHERE NOT snap AND size = 0 AND NOT coalesce(there, false)""")
def _(spark, sf):
    """B-03: removals of levels that are not there."""
    return book.divergence(tables.with_snapshots(spark, sf))


@query("snapshot_levels_explode", f"""WITH {SNAPS}, l AS (SELECT {K}, 0 AS side, unnest(bids) AS x FROM snaps WHERE record_type = 2 UNION ALL SELECT {K}, 1, unnest(asks) FROM snaps WHERE record_type = 2)
SELECT venue_id, exchange_ts, sequence_number, side, x.price AS price, x.size AS size FROM l""")
def _(spark, sf):
    """S-04, S-04b."""
    levels = book.level_events(tables.with_snapshots(spark, sf)).where("snap")
    return levels.select("venue_id", "at.exchange_ts", "at.sequence_number", "side", "price", "size")


@query("warm_up_resume", f"""WITH {SNAPS}, {book_sql(FROM_TS)}, r AS (SELECT count(*) AS resume FROM snaps WHERE exchange_ts < {FROM_TS} AND venue_id = 2)
SELECT book.*, resume FROM book CROSS JOIN r WHERE venue_id = 2 AND instrument_id = 5""")
def _(spark, sf):
    """B-09, J-01."""
    levels, resume = book.warm_up(tables.with_snapshots(spark, sf).where("venue_id = 2"), 5, FROM_TS)
    return levels.withColumn("resume", F.lit(resume).cast("long"))


@query("epoch_boundaries", f"WITH RECURSIVE {SNAPS}, {BOUNDS} SELECT venue_id, epoch, exchange_ts, last_seq AS last_sequence FROM bounds")
def _(spark, sf):
    """A-10, B-11."""
    found = epoch.boundaries(tables.with_snapshots(spark, sf), EVERY)
    return found.withColumn("last_sequence", F.col("last_sequence").cast("long"))


_EPOCH_SEEN = """seen AS (SELECT b.venue_id, b.epoch, b.exchange_ts, b.last_seq, i.instrument_id FROM bounds b
  JOIN (SELECT venue_id, instrument_id, min(exchange_ts) AS first_ts FROM snaps WHERE record_type <> 1 GROUP BY ALL) i
  ON i.venue_id = b.venue_id AND i.first_ts <= b.exchange_ts)"""
_EPOCH_LEVELS = f"""seg AS (SELECT *, sum(CASE WHEN record_type = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY venue_id, instrument_id ORDER BY {K}) AS seg FROM snaps WHERE record_type <> 1),
ev AS (SELECT {K}, seg, side_flags AS side, price, size, false AS snap FROM seg WHERE record_type = 0
  UNION ALL SELECT {K}, seg, 0, l.price, l.size, true FROM (SELECT *, unnest(bids) AS l FROM seg WHERE record_type = 2)
  UNION ALL SELECT {K}, seg, 1, l.price, l.size, true FROM (SELECT *, unnest(asks) AS l FROM seg WHERE record_type = 2)),
pit AS (SELECT b.epoch, e.*, max(seg) OVER (PARTITION BY b.epoch, e.venue_id, e.instrument_id) AS last_seg,
    row_number() OVER (PARTITION BY b.epoch, e.venue_id, e.instrument_id, seg, side, price ORDER BY e.exchange_ts DESC, e.sequence_number DESC) AS rn
  FROM bounds b JOIN ev e ON e.venue_id = b.venue_id AND e.exchange_ts <= b.exchange_ts),
lv AS (SELECT * FROM pit WHERE rn = 1 AND seg = last_seg AND (snap OR size <> 0))"""


@query("epoch_rows", f"""WITH RECURSIVE {SNAPS}, {BOUNDS}, {_EPOCH_SEEN}, {_EPOCH_LEVELS},
c AS (SELECT venue_id, instrument_id, epoch, count(*) FILTER (side = 0) AS n_bids, count(*) FILTER (side = 1) AS n_asks,
  CAST(sum(price * size) AS BIGINT) AS weight FROM lv GROUP BY ALL)
SELECT s.venue_id, s.epoch, s.exchange_ts, s.instrument_id, last_seq + row_number() OVER (PARTITION BY s.venue_id, s.epoch ORDER BY s.instrument_id) AS sequence_number,
  coalesce(n_bids, 0) AS n_bids, coalesce(n_asks, 0) AS n_asks, coalesce(weight, 0) AS weight
FROM seen s LEFT JOIN c USING (venue_id, instrument_id, epoch)""")
def _(spark, sf):
    """B-12, B-13."""
    rows = epoch.epoch_rows(tables.with_snapshots(spark, sf), EVERY)
    weight = F.aggregate(F.concat("bids", "asks"), F.lit(0).cast("long"), lambda a, x: a + x["price"] * x["size"])
    return rows.select(
        "venue_id", "epoch", "exchange_ts", "instrument_id", F.col("sequence_number").cast("long").alias("sequence_number"),
        F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"), weight.alias("weight"),
    )


@query("canonical_projection", f"WITH {RECORDS} SELECT exchange_ts, sequence_number, instrument_id, venue_id, record_type, side_flags, price, size FROM records")
def _(spark, sf):
    """P-03."""
    return canonical.projection(tables.records(spark, sf))


@query("canonical_record_bytes_len", f"WITH {SNAPS} SELECT record_type, CASE WHEN record_type = 2 THEN 46 + 16 * (len(bids) + len(asks)) ELSE 40 END AS n_bytes, count(*) AS n FROM snaps GROUP BY ALL")
def _(spark, sf):
    """P-03, A-01."""
    rows = tables.with_snapshots(spark, sf).select("record_type", canonical.bytes_length().alias("n_bytes"))
    return rows.groupBy("record_type", "n_bytes").agg(F.count("*").alias("n"))


@query("canonical_digest")
def _(spark, sf):
    """A-01, A-02."""
    return spark.createDataFrame([canonical.digest(tables.records(spark, sf))], "digest string, n_records long")


@query("canonical_digest_sha256")
def _(spark, sf):
    """A-03."""
    return spark.createDataFrame([canonical.sha256_digest(tables.records(spark, sf))], "digest string, n_records long")


_BASE = "b AS (SELECT min(exchange_ts) AS base FROM records)"


@query("delivery_schedule", f"WITH {RECORDS}, {_BASE} SELECT {K}, CAST({START} + (CAST(exchange_ts - base AS HUGEINT) * 7) // 3 AS BIGINT) AS deadline_ns FROM records CROSS JOIN b")
def _(spark, sf):
    """T-01, T-02, T-05."""
    return pacing.schedule(tables.records(spark, sf), SPEED, START).select(*KEY, "deadline_ns")


@query("delivery_schedule_saturating", f"""WITH {RECORDS}, {_BASE} SELECT {K}, CAST(least(CAST(9223372036854775807 AS HUGEINT), 9223372036000000000 + CAST(exchange_ts - base AS HUGEINT) * 1024) AS BIGINT) AS deadline_ns FROM records CROSS JOIN b""")
def _(spark, sf):
    """T-02, T-08: a start near the largest long."""
    return pacing.schedule(tables.records(spark, sf), pacing.Speed(1, 1024), 9223372036000000000).select(*KEY, "deadline_ns")


_STREAM = f"s AS (SELECT *, row_number() OVER (ORDER BY {K}) - 1 AS emit_index FROM records), w AS (SELECT count(*) AS n FROM records)"


def _stream(spark, sf):
    every = tables.records(spark, sf)
    return order.with_emit_index(every), every.count()


def _held(every):
    """What a ring of CAPACITY holds at the end, and the number of all records."""
    return order.last_records(every, CAPACITY), every.count()


def _gaps(stream, n):
    cursors = stream.select(F.col("emit_index").alias("cursor"), F.lit(n).cast("long").alias("written"))
    held = cursors.withColumn("held", delivery.held_index(F.col("cursor"), F.col("written"), CAPACITY))
    return held.select("cursor", "written", "held", delivery.gap(F.col("cursor"), F.col("held")).alias("g")).select("cursor", "written", "held", "g.*")


@query("ring_retained", f"WITH {RECORDS}, {_STREAM} SELECT {K}, emit_index FROM s CROSS JOIN w WHERE emit_index >= n - {CAPACITY}")
def _(spark, sf):
    """D-04."""
    stream, n = _held(tables.records(spark, sf))
    return delivery.retained(stream, delivery.Ring(CAPACITY), n).select(*KEY, "emit_index")


@query("drop_gap_all_cursors", f"""WITH {RECORDS}, {_STREAM}, c AS (SELECT emit_index AS cursor, n AS written, emit_index + {CAPACITY} * ((n - 1 - emit_index) // {CAPACITY}) AS held FROM s CROSS JOIN w)
SELECT cursor, written, held, CASE WHEN held > cursor THEN cursor END AS first_missed, CASE WHEN held > cursor THEN held - 1 END AS last_missed, CASE WHEN held > cursor THEN held - cursor END AS missed_count FROM c""")
def _(spark, sf):
    """D-07: the closed form at every cursor."""
    return _gaps(*_stream(spark, sf))


@query("delivery_accounting", f"""WITH {RECORDS}, w AS (SELECT count(*) AS n FROM records), h AS (SELECT n, 5 + {CAPACITY} * ((n - 1 - 5) // {CAPACITY}) AS held FROM w)
SELECT n - held AS received, CASE WHEN held > 5 THEN 1 ELSE 0 END::BIGINT AS gaps, held - 5 AS missed, 5::BIGINT AS unaccounted FROM h""")
def _(spark, sf):
    """A-05: a drop subscriber stalled at index 5; what lies before its start is all that is unaccounted for."""
    stream, n = _stream(spark, sf)
    got = delivery.deliveries(_held(tables.records(spark, sf))[0], delivery.Ring(CAPACITY), 5, n)
    left = delivery.unaccounted(stream, got).agg(F.count("*").alias("unaccounted"))
    return delivery.accounting(got).join(F.broadcast(left))  # one row each


@query("start_positions", f"""WITH {RECORDS}, {_STREAM} SELECT 'beginning' AS start, 0::BIGINT AS cursor UNION ALL SELECT 'emit_index', 77 UNION ALL SELECT 'live', n FROM w
UNION ALL SELECT 'exchange_ts', coalesce((SELECT min(emit_index) FROM s CROSS JOIN w WHERE emit_index >= n - {CAPACITY} AND exchange_ts >= {FROM_TS}), (SELECT n FROM w))
UNION ALL SELECT 'past_end', n FROM w""")
def _(spark, sf):
    """D-03, D-05."""
    stream, n = _held(tables.records(spark, sf))
    starts = {
        "beginning": delivery.beginning(), "emit_index": delivery.emit_index(77), "live": delivery.live(),
        "exchange_ts": delivery.exchange_ts(FROM_TS), "past_end": delivery.exchange_ts(2**62),
    }
    ring = delivery.Ring(CAPACITY)
    rows = [(k, delivery.start_index(stream, ring, n, delivery.DROP, s)) for k, s in starts.items()]
    return spark.createDataFrame(rows, "start string, cursor long")


_SUBS = "subs AS (SELECT c_custkey AS cursor, CASE WHEN c_nationkey % 2 = 0 THEN 'block' ELSE 'drop' END AS mode, ['beginning', 'exchange_ts', 'emit_index', 'live'][c_custkey % 4 + 1] AS start_kind FROM customer)"


def _subscribers(spark, sf):
    kinds = F.array(*(F.lit(x) for x in ("beginning", "exchange_ts", "emit_index", "live")))
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("cursor"), F.when(F.col("c_nationkey") % 2 == 0, "block").otherwise("drop").alias("mode"),
        F.get(kinds, (F.col("c_custkey") % 4).cast("int")).alias("start_kind"),
    )


@query("block_barrier_min_cursor", f"WITH {_SUBS} SELECT CAST(coalesce(min(CASE WHEN mode = 'block' THEN cursor END), 18446744073709551615) AS BIGINT) AS min_cursor FROM subs")
def _(spark, sf):
    """A-09, D-09."""
    return delivery.min_block_cursor(_subscribers(spark, sf)).select(F.col("min_cursor").cast("long").alias("min_cursor"))


@query("subscriber_mix", f"WITH {_SUBS} SELECT mode, start_kind, count(*) AS n_subscribers FROM subs GROUP BY ALL")
def _(spark, sf):
    """A-06."""
    return delivery.subscriber_mix(_subscribers(spark, sf))


_SNAP_STREAM = f"s AS (SELECT *, row_number() OVER (ORDER BY {K}) - 1 AS emit_index FROM snaps)"


def _delivered(spark, sf):
    stream, n = _held(tables.with_snapshots(spark, sf))
    return delivery.deliveries(stream, delivery.Ring(CAPACITY), 5, n)


_HELD = f"w AS (SELECT count(*) AS n FROM snaps), h AS (SELECT n, 5 + {CAPACITY} * ((n - 1 - 5) // {CAPACITY}) AS held FROM w)"


@query("run_metrics", f"""WITH {SNAPS}, {_SNAP_STREAM}, {_HELD}
SELECT count(*) AS records, CAST(sum(64 + CASE WHEN record_type = 2 THEN 4 + 16 * (len(bids) + len(asks)) ELSE 0 END) AS BIGINT) AS bytes,
  CAST(any_value(CASE WHEN held > 5 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, any_value(held - 5) AS missed, max(emit_index) AS last_index FROM s CROSS JOIN h WHERE emit_index >= held""")
def _(spark, sf):
    """A-07."""
    return delivery.run_metrics(_delivered(spark, sf))


@query("wire_projection", f"""WITH {SNAPS}, {_SNAP_STREAM}, {_HELD}
SELECT emit_index, exchange_ts, sequence_number, instrument_id, CAST(venue_id AS BIGINT) AS venue_id, CAST(record_type AS BIGINT) AS record_type, CAST(side_flags AS BIGINT) AS side_flags, price, size,
  CAST(coalesce(len(bids) + len(asks), 0) AS BIGINT) AS n_levels, CAST(coalesce(len(bids), 0) AS BIGINT) AS bid_count,
  CASE WHEN emit_index = held AND held > 5 THEN 5 END::BIGINT AS first_missed, CASE WHEN emit_index = held AND held > 5 THEN held - 1 END AS last_missed,
  CASE WHEN emit_index = held AND held > 5 THEN held - 5 ELSE 0 END AS missed_count FROM s CROSS JOIN h WHERE emit_index >= held""")
def _(spark, sf):
    """W-12, D-06."""
    wire = delivery.to_wire(_delivered(spark, sf))
    return wire.withColumn("n_levels", F.size("levels").cast("long")).drop("levels")


@query("blob_too_large", f"WITH {SNAPS} SELECT count(*) AS n FROM snaps WHERE record_type = 2 AND 4 + 16 * (len(bids) + len(asks)) > 60")
def _(spark, sf):
    """D-21."""
    return delivery.too_large(tables.with_snapshots(spark, sf), delivery.Ring(CAPACITY, 60)).agg(F.count("*").alias("n"))


@query("dataset_hash", """WITH f AS (SELECT s_nationkey AS run, s_name AS path, sha256(s_name) AS hash FROM supplier)
SELECT run, sha256(string_agg(path || chr(9) || hash || chr(10), '' ORDER BY path)) AS dataset_hash FROM f GROUP BY run""")
def _(spark, sf):
    """A-04, S-19: suppliers stand for files."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    file = F.struct(F.col("s_name").alias("path"), F.sha2("s_name", 256).alias("hash"))
    files = s.groupBy(F.col("s_nationkey").alias("run")).agg(F.sort_array(F.collect_list(file)).alias("files"))
    return files.select("run", catalogue.dataset_hash(F.col("files")).alias("dataset_hash"))


_BENCH = """raw AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 5 = 0 THEN 'ok  package ' || p_size
  WHEN p_partkey % 7 = 0 THEN 'Benchmark' || replace(p_brand, '#', '') || '-8 ' || p_size || ' ' || p_retailprice || ' ns/op 16 B/op'
  ELSE 'Benchmark' || replace(p_brand, '#', '') || '-16   ' || (p_size + 1) || '  ' || CAST(p_size * 1.5 AS DOUBLE) || ' ns/op   ' || p_size || ' B/op  ' || (p_size % 3) || ' allocs/op' END AS value FROM part)"""


@query("bench_parse", f"""WITH {_BENCH}, m AS (SELECT line, value, regexp_replace(regexp_extract(value, '^(\\S+)', 1), '-\\d+$', '') AS name,
  TRY_CAST(regexp_extract(value, '^\\S+\\s+(\\d+)', 1) AS BIGINT) AS iterations, TRY_CAST(nullif(regexp_extract(value, '(\\S+)\\s+ns/op', 1), '') AS DOUBLE) AS ns_per_op,
  TRY_CAST(nullif(regexp_extract(value, '(\\S+)\\s+B/op', 1), '') AS BIGINT) AS bytes_per_op, TRY_CAST(nullif(regexp_extract(value, '(\\S+)\\s+allocs/op', 1), '') AS BIGINT) AS allocs_per_op
  FROM raw WHERE value LIKE 'Benchmark%')
SELECT line, name, iterations, ns_per_op, bytes_per_op, allocs_per_op, CASE WHEN allocs_per_op IS NULL THEN 'MissingMetric' END AS fault,
  CAST(row_number() OVER (PARTITION BY name ORDER BY line) - 1 AS INT) AS sample FROM m""")
def _(spark, sf):
    """S-11: benchmark lines made of parts, some without all metrics."""
    lines = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey AS line",
        """CASE WHEN p_partkey % 5 = 0 THEN concat('ok  package ', p_size)
        WHEN p_partkey % 7 = 0 THEN concat('Benchmark', replace(p_brand, '#', ''), '-8 ', p_size, ' ', p_retailprice, ' ns/op 16 B/op')
        ELSE concat('Benchmark', replace(p_brand, '#', ''), '-16   ', p_size + 1, '  ', cast(p_size * 1.5 as double), ' ns/op   ', p_size, ' B/op  ', p_size % 3, ' allocs/op') END AS value""",
    )
    return catalogue.parse_benchmarks(lines)


@query("runs_ingest", """SELECT 'run-' || o_orderkey AS run_id, sha256('a.bin' || chr(9) || o_orderstatus || chr(10)) AS dataset_hash, CAST(o_custkey AS BIGINT) AS emit_index_at_end,
  o_orderpriority AS canonical_hash, CAST(o_orderkey AS BIGINT) AS elapsed_nanos FROM orders""")
def _(spark, sf):
    """S-10, W-08: orders stand for run manifests."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("a.bin").alias("path"), F.col("o_orderstatus").alias("hash"))).alias("dataset"),
            F.struct(F.lit(1).alias("speed_num")).alias("config"),
            F.struct(F.col("o_custkey").alias("emit_index_at_end"), F.col("o_orderpriority").alias("canonical_hash")).alias("result"),
            F.struct(F.col("o_orderkey").alias("elapsed_nanos")).alias("timing"),
        )
    )
    texts = o.select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), text.alias("value"))
    return catalogue.parse_manifests(texts).select("run_id", "dataset_hash", "emit_index_at_end", "canonical_hash", "elapsed_nanos")
