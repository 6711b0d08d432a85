"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest

from ticktide import shared
from ticktide.llm import (
    chat_format,
    common,
    exact_dedup,
    html_text,
    line_dedup,
    packing,
    quality_rules,
    sentencepiece_sampling,
    sharding,
    simhash,
    token_file,
    tokens,
)

LONG = "wort " * 30_000
ROWS = [
    (1, None, "h", 0), (2, "", None, 0), (3, "a b c", "h", 0), (3, "a b c", "h", 0), (4, "A b C", "h", 1),
    (5, LONG, "h", 2), (None, "ohne id", "h", 3), (6, " \n\t ", "h", 4), (7, "x\x00y ☃ 日本", "h", 5),
]
SCHEMA = "doc_id long, text string, source string, DIGEST long"


@pytest.fixture(scope="module")
def docs(spark):
    return common.written(spark.createDataFrame(ROWS, SCHEMA), "docs")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def index(spark):
    return exact_dedup.DigestIndex(spark, common.new_path(spark, "digest_index"), buckets=4)


def test_exact_dedup(spark, docs, nothing):
    rows = exact_dedup.exact_dedup(docs, index(spark)).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.id: r for r in rows}
    assert by_id[3].group_size == 3 and by_id[3].keep_id == 4 and not by_id[3].kept and by_id[4].kept
    assert by_id[1].keep_id == 2 and by_id[2].kept and not by_id[1].kept
    assert by_id[None].kept
    kept = exact_dedup.keep_one(docs, index(spark))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "7", "None"]
    assert exact_dedup.exact_dedup(nothing, index(spark)).count() == 0
    assert exact_dedup.keep_one(nothing, index(spark)).count() == 0


def test_repeated_row_stays_once(spark):
    docs = spark.createDataFrame([(3, "a"), (3, "a"), (2, "A"), (None, "b"), (None, "b")], "doc_id long, text string")
    out = [tuple(r) for r in exact_dedup.exact_dedup(docs, index(spark)).drop("digest").collect()]
    assert sorted(out, key=str) == [(2, 3, 3, False), (3, 3, 3, False), (3, 3, 3, True), (None, None, 2, False), (None, None, 2, True)]
    kept = [(r.doc_id, r.text) for r in exact_dedup.keep_one(docs, index(spark)).collect()]
    assert sorted(kept, key=str) == [(3, "a"), (None, "b")]


def test_index_lasts(spark):
    path = common.new_path(spark, "digest_index")
    old = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    new = spark.createDataFrame([(7, "TWO"), (8, "three")], "doc_id long, text string")
    exact_dedup.exact_dedup(old, exact_dedup.DigestIndex(spark, path, 4)).count()
    out = {r.id: r for r in exact_dedup.exact_dedup(new, exact_dedup.DigestIndex(spark, path, 7)).collect()}
    assert not out[7].kept and out[7].keep_id == 2 and out[8].kept
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.read().count() == 3
    exact_dedup.exact_dedup(new, again).count()
    assert again.read().count() == 3
    kept = exact_dedup.keep_one(new.unionByName(spark.createDataFrame([(9, "four")], old.schema)), again)
    assert [r.doc_id for r in kept.collect()] == [9]


def test_index_is_read_in_stored_order(spark, monkeypatch):
    """No exchange and no sort of the index, generations are merged, a second writer is noticed."""
    monkeypatch.setattr(exact_dedup, "MOST", 3)
    one = index(spark)
    for batch in range(5):
        docs = spark.createDataFrame([(10 * batch + i, f"text {batch + i}") for i in range(3)], "doc_id long, text string")
        rows = exact_dedup.exact_dedup(docs, one).collect()
        assert sum(r.kept for r in rows) == (3 if batch == 0 else 1) and len(one.names) <= 3
    assert one.read().count() == 7
    probed = spark.createDataFrame([("x",)], "digest string").groupBy("digest").count()
    with exact_dedup._stored_order(spark):
        plan = one.probe(probed)._jdf.queryExecution().executedPlan().toString()
    tables = plan.count("Scan parquet spark_catalog.default.digest_index")
    assert tables == len(one.names) and plan.count("SortMergeJoin") == tables
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # of the batch, not of the index
    other = exact_dedup.DigestIndex(spark, one.path)
    other.append(spark.createDataFrame([("y", 1, 1)], "digest string, keep_id long, n_rows long"))
    with pytest.raises(RuntimeError, match="another writer"):
        one.append(spark.createDataFrame([("z", 1, 1)], "digest string, keep_id long, n_rows long"))


def test_quality(spark, docs, nothing):
    out = {r.id: r for r in quality_rules.quality_rules(docs).collect()}
    assert out[1].n_words == out[2].n_words == out[6].n_words == 0 and out[1].base_failed
    assert out[5].n_words == 30_000 and out[5].n_repeat_words == 30_000 and out[5].base_failed
    assert out[7].word_chars == 6 and out[7].n_words == 3
    assert quality_rules.quality_rules(nothing).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 0
    line, own = "this line stands on every page of the host and is long", " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{line}\n\n{own} {i}", "h", i) for i in range(40)] + [(5, f"{line}\n\n{own} 5", "h", 5), (None, line, "h", 1)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").selectExpr(
        "*", "1 AS __h", "2 AS __gone", "3 AS KEY", "4 AS host", "5 AS id", "6 AS line", "7 AS split"
    )
    out = quality_rules.without_common_lines(many)
    assert out.columns == many.columns
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(i, t if i in (0, None) else "\n" + t.split("\n")[2], h, n, 1, 2, 3, 4, 5, 6, 7) for i, t, h, n in rows]
    assert got == sorted(want, key=str)
    kept = quality_rules.keep_good(many)
    assert kept.columns == many.columns and kept.count() == 41


def test_sharding(spark, docs, nothing):
    from pyspark.sql import functions as F

    def sized(df):
        text = F.coalesce("text", F.lit(""))
        return df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), sharding.slot_of(F.col("doc_id")).alias("virtual_slot"))

    slots = sharding.SlotMap(spark, common.new_path(spark, "slot_map"))
    out = sharding.shard_records(common.written(sized(docs), "sized"), slots, 3).collect()
    assert len(out) == len(ROWS)
    for shard in range(3):
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))
    assert slots.read(0).count() == slots.read(1).count() == sharding.SLOTS
    empty = sharding.shard_records(sized(nothing), sharding.SlotMap(spark, common.new_path(spark, "slot_map")), 3)
    assert empty.count() == 0
    extra = sized(docs).withColumns({c: F.lit(7) for c in ("shard", "SLOT", "rank", "begin", "n", "at", "part")})
    out = sharding.shard_records(extra, sharding.SlotMap(spark, common.new_path(spark, "slot_map")), 3)
    assert out.columns == [*extra.columns, "_shard", "_slot"]
    assert all((r.shard, r.SLOT, r["rank"], r.begin, r.n, r["at"], r.part) == (7,) * 7 for r in out.collect())


def test_slot_map_is_edited(spark):
    """Three batches in a row: each edits the newest version, few slots move, all batches stay even."""
    import numpy as np

    slots = sharding.SlotMap(spark, common.new_path(spark, "slot_map"))
    assert slots.newest() is None
    kinds, rng, held = "doc_id long, size long, virtual_slot int", np.random.default_rng(2), np.zeros(512, np.int64)
    for batch in range(3):
        rows = [(batch * 10_000 + i, int(n), int(rng.integers(512))) for i, n in enumerate(rng.gamma(2, 500, 6000) + 1)]
        for _, n, slot in rows:
            held[slot] += n
        df = spark.createDataFrame(rows, kinds)
        out = sharding.shard_records(df, slots, 5 if batch == 2 else 4, 512, tolerance=0.02).collect()
        assert slots.newest() == batch + 1
        shard_of, weight = slots.load(batch + 1)
        assert (weight == held).all() and all(shard_of[r.virtual_slot] == r.shard for r in out)
        load = np.bincount(shard_of, weights=held)
        assert load.max() - load.min() <= 0.02 * load.mean()
        moved = (shard_of != slots.load(batch)[0]).mean()
        assert moved <= (0.3 if batch == 2 else 0.08)  # a fifth of all goes to a new shard
        for shard in set(shard_of.tolist()):
            assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    fewer = sharding.rebalanced(shard_of, held, 3)
    assert set(fewer.tolist()) == {0, 1, 2}


def test_simhash(spark, docs, nothing):
    marked = common.written(simhash.fingerprints(docs), "fp")
    out = {r.doc_id: r for r in simhash.near_groups(marked).collect()}
    assert out[1].fp == out[2].fp == out[6].fp == 0 and out[6].component_id == 1
    assert out[3].component_id == out[4].component_id == 3
    assert simhash.near_groups(common.written(simhash.fingerprints(nothing), "fp")).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "5", "7", "None"]


def test_packing(spark, docs, nothing):
    out = packing.packed(docs).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[3]) == 2 and by_id[1][0].length == 1 and sum(r.length for r in by_id[5]) > 30_000
    assert all(r.length == packing.CAP for r in by_id[5] if r.piece)
    check_places(out)
    assert packing.packed(nothing).count() == 0


def test_packing_carries_columns(spark):
    from pyspark.sql import functions as F

    names = ("part", "__part", "rank", "begin", "n", "size", "first", "end", "k", "at", "OFFSET", "sequence_id")
    rows = [(i % 7, 5 if i % 3 else packing.CAP - 1 + i % 2) for i in range(60)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").withColumns({c: F.lit(i) for i, c in enumerate(names)})
    out = packing.pack(pieces)
    assert out.columns == [*pieces.columns, "_sequence_id", "_offset"] and out.count() == 60
    places = {}
    for r in out.collect():
        assert [r[c] for c in names] == list(range(len(names)))
        places.setdefault(r["_sequence_id"], []).append((r["_offset"], r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAP


def check_places(out):
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAP


def test_token_files(spark, docs, nothing):
    path = tokens.public_path("word_bpe_49k.json")
    for df, n in ((docs, len(ROWS)), (nothing, 0)):
        folder = common.new_path(spark, "token_files")
        token_file.write_tokens(df, folder, path, end_id=2)
        out = sorted((tuple(r) for r in token_file.read_tokens(spark, folder).collect()), key=lambda r: r[1])
        assert len(out) == n
        at = 0
        for _, start, count, ids in out:
            assert start == at and len(ids) == 4 * count and ids[-4:] == b"\2\0\0\0"
            at += count
    assert token_file.read_tokens(spark, folder).count() == 0
    with pytest.raises(TypeError, match="no integer"):
        token_file.write_tokens(docs.selectExpr("cast(doc_id as string) AS doc_id", "text"), folder, path, 2)


def test_one_id_of_many_rows_makes_several_files(spark, monkeypatch):
    """A third of all rows with one id are dealt to several tasks; files roll; the order of ids holds."""
    monkeypatch.setattr(token_file, "TASK", 300)
    monkeypatch.setattr(token_file, "ROLL", 200)
    path, folder = tokens.public_path("word_bpe_49k.json"), common.new_path(spark, "token_files")
    rows = [(7 if i % 3 == 0 else i, "ein wort " * (i % 20)) for i in range(300)]
    token_file.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder, path, end_id=2)
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert manifest.count() > 10 and manifest.select("part").distinct().count() > 4
    out = sorted((tuple(r) for r in token_file.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == sorted(i for i, _ in rows) and len(out) == 300
    at = 0
    for _, start, count, ids in out:
        assert start == at and len(ids) == 4 * count
        at += count


def test_stores_of_urls(tmp_path):
    from pyarrow import fs

    for url in (f"file://{tmp_path}", f"file:{tmp_path}", str(tmp_path)):
        store, root = token_file.store_of(url)
        assert isinstance(store, fs.LocalFileSystem) and root == str(tmp_path)


def test_line_dedup(spark, docs, nothing):
    out = line_dedup.dedup_lines(docs.withColumn("removed_lines", docs.doc_id))
    assert out.columns[:5] == [*docs.columns, "removed_lines"] and "_removed_lines" in out.columns
    assert out.count() == len(ROWS)
    assert {r.doc_id: r.text for r in out.collect()}[5] == LONG
    assert line_dedup.dedup_lines(nothing).count() == 0
    block = "\n".join("abcdefghijklmnopqrstuvwxyz"[k] + " word" * 9 for k in range(4))
    extra = spark.createDataFrame(
        [(1, block, "keep1", "s", 1), (1, block, "keep1", "s", 1), (2, "x\n" + block, "keep2", "t", 2), (None, block, "keep3", "u", 3)],
        "doc_id long, text string, __lines string, SPLIT string, key long",
    )
    rows = sorted(map(tuple, line_dedup.dedup_lines(extra).collect()), key=str)
    assert rows == [
        (1, block, "keep1", "s", 1, [], 0), (1, block, "keep1", "s", 1, [], 0), (2, "x", "keep2", "t", 2, [1, 2, 3, 4], 40),
        (None, block, "keep3", "u", 3, [], 0),
    ]
    with pytest.raises(TypeError, match="no integer"):
        line_dedup.dedup_lines(docs.selectExpr("cast(doc_id as string) AS doc_id", "text"))


def test_line_dedup_starts_no_process(tmp_path):
    """A chmod for each file is for moments a twin of the executor, which sums of memory count twice."""
    import os
    import subprocess
    import sys

    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/log\nexec /bin/chmod "$@"\n')
    (tmp_path / "bin/chmod").chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
from ticktide.llm import common, line_dedup
conf = {{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}}
spark = SparkSession.builder.config(map=conf | {{"spark.checkpoint.dir": "file://{tmp_path}/shared"}}).getOrCreate()
rows = [(k, f"own {{k}}\\n" + "passage " * 30) for k in range(9)]
out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
assert sorted(tuple(r.removed_lines) for r in out) == [(), *[(1,)] * 8]
common.written(spark.range(1), "probe")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}"})
    started = [x for x in (tmp_path / "log").read_text().splitlines() if f"{tmp_path}/shared/ticktide" in x]
    assert any("probe-" in x for x in started) and not [x for x in started if "probe-" not in x]


def test_simhash_starts_no_process(tmp_path):
    """As for op5: fingerprints, postings of all three levels and the rounds of components."""
    import os
    import subprocess
    import sys

    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/log\nexec /bin/chmod "$@"\n')
    (tmp_path / "bin/chmod").chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
from ticktide.llm import common, simhash
conf = {{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}}
spark = SparkSession.builder.config(map=conf | {{"spark.checkpoint.dir": "file://{tmp_path}/shared"}}).getOrCreate()
rows = [(k, " ".join(f"word{{j}}" for j in range(400)) + f" own{{k}}") for k in range(9)] + [(9, None), (10, "")]
assert sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [rows[0], rows[9]]
simhash.links.__defaults__ = (2, 2)
fps = spark.createDataFrame([(k, 1 << k) for k in range(9)], "doc_id long, fp long")
assert {{r.component_id for r in simhash.near_groups(fps).collect()}} == {{0}}
common.written(spark.range(1), "probe")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}"})
    assert [x for x in os.listdir(next((tmp_path / "shared/ticktide").iterdir())) if x.startswith("midpoints-")]
    started = [x for x in (tmp_path / "log").read_text().splitlines() if f"{tmp_path}/shared/ticktide" in x]
    assert any("probe-" in x for x in started) and not [x for x in started if "probe-" not in x]


def test_quality_starts_few_processes(tmp_path):
    """As for op5, but Spark writes here: one file for the lines that go, whatever the number of tasks, and no table of all lines."""
    import os
    import subprocess
    import sys

    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/log\nexec /bin/chmod "$@"\n')
    (tmp_path / "bin/chmod").chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
from ticktide.llm import common, quality_rules
conf = {{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "16"}}
conf |= {{"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
line = lambda j: f"line {{j}} " + "word " * 9
rows = [(k, f"own {{k}}\\n" + "\\n".join(map(line, range(40))), "a" if k % 2 else None) for k in range(60)]
docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12)
got = lambda: sorted(map(tuple, quality_rules.quality_rules(docs).collect()))
out = got()
assert [r[8] for r in out] == [0, 0] + [40] * 58 and [r[7] for r in out] == [0, 0] + [440] * 58
common.written(spark.range(1), "probe")
common.BROADCAST_ROWS = 7
assert got() == out
common.BROADCAST_ROWS = 79
assert got() == out
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}"})
    started = [x for x in (tmp_path / "log").read_text().splitlines() if f"{tmp_path}/shared/ticktide" in x]
    at = next(k for k, x in enumerate(started) if "probe-" in x)
    files = [x for x in started[:at] if "/part-" in x]
    assert len(files) == 1 and "common_lines-" in files[0] and at < 16


def test_stored_tables(spark, tmp_path, monkeypatch):
    schema = "id long, at array<int>, n int, flag boolean, s string"
    rows = [(k, None if k % 3 == 0 else [k, None], k, k % 2 == 0, None if k % 5 == 0 else f"é{k}") for k in range(25_000)]
    frame = spark.createDataFrame(rows, schema)
    table = common.stored(frame.repartition(3), "stored")
    assert table.dtypes == frame.dtypes and sorted(map(tuple, table.collect())) == rows and len(table.inputFiles()) == 3
    assert common.stored(frame.where("id < 0"), "stored").collect() == []
    home = tmp_path / "a b%20c"
    for url in (f"file://{home}", f"file:{home}"):
        monkeypatch.setattr(shared, "folder", lambda session, url=url: url)
        assert common.stored(frame.limit(9), "stored").union(common.written(frame.limit(9), "written")).count() == 18
    assert sorted(p.name.split("-")[0] for p in home.glob("ticktide/*/*")) == ["stored"] * 2 + ["written"] * 2
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    with open(f"{folder}/_part-of-a-failed-attempt.parquet", "wb") as f:
        f.write(b"PAR1")
    assert spark.read.schema(table.schema).parquet(f"file://{folder}").count() == len(rows)


def test_repeated_lines_align_fast():
    import time

    lines = {k: k % 7 * (k % 3) for k in range(20_000)}
    began = time.time()
    met = line_dedup.align(lines, {k + 3: v for k, v in lines.items()})
    assert time.time() - began < 5 and all(lines[e] == lines[x - 3] for x, e in met.items())


def test_html(spark, docs, nothing):
    out = {r.page_id: r.text for r in html_text.extract(docs, "doc_id", "text").collect()}
    assert out[1] == out[2] == out[6] == "" and out[3] == "a b c" and len(out[5]) == len(LONG) - 1
    assert html_text.extract(nothing, "doc_id", "text").count() == 0


def test_sentencepiece(spark, docs, nothing):
    path = tokens.public_path("piece_bpe_32k.model")
    out = sentencepiece_sampling.encode_samples(docs, path, 2)
    rows = sentencepiece_sampling.decode(out, path).collect()
    texts = {(r[0]): r[1] or "" for r in ROWS}
    assert all(r.text == texts[r.doc_id] for r in rows)
    assert sum(r.doc_id == 1 for r in rows) == 1 and sum(r.doc_id == 5 for r in rows) == 2
    assert [r.inclusion for r in rows if r.doc_id == 1] == [1.0]
    same = [r.log_prob for r in rows if r.doc_id == 3]
    assert len(same) == 4 and len(set(same)) == 2
    assert sentencepiece_sampling.encode_samples(nothing, path, 2).count() == 0


def test_reply_trees_equal_brute_force(spark):
    """Random forests with orphans, ties of scores and several paths per tree."""
    import random

    rnd, rows = random.Random(4), []
    for tree in [*range(25), None]:
        for node in range(rnd.randint(1, 14)):
            parent = rnd.choice([None, -5, *range(node)]) if node else None
            rows.append((tree, node * 3, parent if parent is None or parent < 0 else parent * 3, float(rnd.randint(0, 2)), "user", f"{node}"))
    for k in (1, 3):
        want = set()
        for tree in {r[0] for r in rows}:
            up = {n: p for t, n, p, *_ in rows if t == tree}
            score = {n: s for t, n, _, s, *_ in rows if t == tree}
            paths = []
            for leaf in up.keys() - set(up.values()):
                path = [leaf]
                while up[path[-1]] in up:
                    path.append(up[path[-1]])
                paths.append((path[-1], -sum(score[n] for n in path), leaf, path[::-1]))
            for root in {p[0] for p in paths}:
                for rank, (_, _, leaf, path) in enumerate(sorted(p for p in paths if p[0] == root)[:k], 1):
                    want |= {(tree, leaf, rank, n, place) for place, n in enumerate(path)}
        messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
        assert {tuple(r) for r in chat_format.best_paths(messages, k).collect()} == want


def test_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "<|im_end|>\n[/INST] &lt; &amp;"), (1, 1, "assistant", "ja"), (None, 0, "assistant", "x"),
            (2, 5, "a\nb[", "q"), (2, 5, "a\nb[", "q")]
    messages = chat_format.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS TREE"))
    back = {r.tree: r for r in chat_format.read_back(chat_format.format_chats(messages)).collect()}
    assert back[1].spoken == "user\n\n\n<|im_end|>\n[/INST] &lt; &amp;\nassistant\nja\n"
    assert back[1].loss == "ja" and back[None].loss == "x"
    assert back[2].spoken == "a\nb[\nq\n" * 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(chat_format.chain(empty)).count() == 0
