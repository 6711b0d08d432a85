"""The pipeline against a plain version of its stages."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import brute_components
from ticktide.llm import common, packing, quality_rules, simhash, tokens


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {r.id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after.append({r.doc_id: r.text or "" for r in docs.collect()})
        assert all(rows[i] == t for i, t in after[-1].items())
    assert set(after[0]) == kept
    last = {}
    for i, t in sorted(after[0].items()):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        last[hashlib.sha256(low.encode()).digest()] = i
    assert set(after[1]) == set(last.values())
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(common.written(simhash.fingerprints(
        spark.createDataFrame(list(after[1].items()), "doc_id long, text string")), "fp")).collect()}
    assert set(after[2]) == {i for i, c in groups.items() if i == c}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(after[2])
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in packed} == {
        (r.doc_id, r.piece, r.ids_crc32) for r in packing.packed(docs).collect()
    }


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_fingerprint(text):
    own = words(lower(text))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 4]).encode(), 42) for i in range(max(1, len(own) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_equals_plain_stages(spark):
    """All four stages in plain Python, sharing no code with the operators; no line of sf0.001 is above the limits."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {}
    for i, t in docs.items():
        own = words(t)
        seen = {}
        for k in range(len(own) - 2):
            seen.setdefault(tuple(own[k : k + 3]), []).append(k)
        again = {p for at in seen.values() if len(at) > 1 for k in at for p in (k, k + 1, k + 2)}
        if len(own) >= 50 and 100 * len(again) <= 50 * len(own):
            kept[i] = t
    last = {lower(t): i for i, t in sorted(kept.items())}
    left = {i: kept[i] for i in sorted(last.values())}
    ids = list(left)
    groups = brute_components(np.array([plain_fingerprint(left[i]) for i in ids], dtype=np.uint64))
    left = {i: left[i] for k, i in enumerate(ids) if groups[k] == k}
    out = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out.keys() == left.keys()
    library, total, sequences = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json")), 0, {}
    for i, rows in out.items():
        own = [*library.encode(left[i], add_special_tokens=False).ids, 0]
        total += len(own)
        at = 0
        for r in sorted(rows, key=lambda r: r.piece):
            assert r.start == at and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            at += r.length
        assert at == len(own)
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-total // 2048) + 2


LONG = " ".join(f"word{k * k % 99991}" for k in range(30_000))
GOOD = " ".join(f"term{k * 7919 % 1009}" for k in range(80))


@pytest.mark.parametrize("extra", [(), ("digest", "KEY", "part", "own", "kept", "length")])
def test_stages_on_odd_documents(spark, extra):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names; and no rows at all."""
    rows = [
        (1, None, "de", "h", 0), (2, "", None, None, None), (3, GOOD, "de", "h", 1), (3, GOOD, "de", "h", 1), (4, GOOD.upper(), None, "h", 2),
        (5, LONG, "en", None, 3), (None, GOOD + " x", "en", "h", 4), (6, " \n\t ", "en", "h", None), (7, GOOD + " y", "en", "g", 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, schema).selectExpr("*", *(f"{k} AS {c}" for k, c in enumerate(extra)))
    kept = []
    docs = common.written(table, "docs")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, ""), "stage")
        assert docs.columns == table.columns
        assert all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in docs.collect())
        kept.append(sorted(str(r.doc_id) for r in docs.collect()))
    # GOOD in capitals has the same text to dedup: of 3, 3 and 4 the largest id stays; a row without an id stays
    assert kept[0] == ["3", "3", "4", "5", "7", "None"]
    assert kept[1] == ["4", "5", "7", "None"]
    assert "5" in kept[2] and "None" in kept[2] and set(kept[2]) <= set(kept[1])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted({str(r.doc_id) for r in out}) == sorted(set(kept[2])) and sum(r.length for r in out if r.doc_id == 5) > 30_000
    empty = common.written(spark.createDataFrame([], table.schema), "docs")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
