"""Small fixtures of records."""

from ticktide.schema import RECORD_SCHEMA

BASE = 1_704_067_200_000_000_000


def rec(ts, seq, instrument, venue=7, kind=0, side=0, price=0, size=0, bids=None, asks=None):
    def levels(x):
        return None if x is None else [{"price": p, "size": s} for p, s in x]

    return (ts, seq, instrument, venue, kind, side, price, size, levels(bids), levels(asks))


def frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(r[0], Decimal(r[1]), *r[2:]) for r in rows], RECORD_SCHEMA)


def snap(ts, seq, instrument, bids=(), asks=(), venue=7):
    return rec(ts, seq, instrument, venue, 2, bids=list(bids), asks=list(asks))


#: One venue with two snapshot epochs and three instruments.
WARM = [
    snap(1000, 1, 101, [(99, 5), (100, 10)], [(101, 8), (102, 3)]),
    snap(1000, 2, 202, [(50, 20)], [(52, 15), (53, 7)]),
    rec(1100, 3, 101, side=0, price=100, size=12), rec(1100, 4, 202, side=1, price=52, size=0),
    rec(1120, 5, 303, side=0, price=10, size=100), rec(1150, 6, 101, side=1, price=103, size=4),
    rec(1150, 7, 202, side=0, price=48, size=9),
    snap(1200, 8, 101, [(200, 1)], [(210, 1)]), snap(1200, 9, 202, [(300, 2)], [(310, 2)]), snap(1200, 10, 303, [(10, 100)]),
    rec(1300, 11, 101, side=0, price=200, size=5), rec(1300, 12, 202, side=1, price=320, size=1),
    rec(1400, 13, 101, side=1, price=210, size=0), rec(1400, 14, 202, side=0, price=300, size=9),
]
#: A session whose epochs of four records are known.
SESSION = [
    (1, 1, 10, 0, 100, 5), (2, 2, 11, 1, 200, 6), (3, 3, 10, 0, 99, 7), (4, 4, 11, 1, 201, 8), (5, 5, 10, 1, 105, 9),
    (6, 6, 11, 0, 195, 10), (7, 7, 10, 0, 100, 0), (8, 8, 11, 1, 200, 11), (9, 9, 10, 0, 98, 12), (10, 10, 11, 0, 194, 13),
]


def session(spark):
    return frame(spark, [rec(BASE + t, q, i, side=s, price=p, size=n) for t, q, i, s, p, n in SESSION])
