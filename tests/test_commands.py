"""The batch commands, end to end."""

from tests.test_engine import BENCH, row, source_file
from ticktide.__main__ import main


def test_convert_export_replay(spark, tmp_path, capsys):
    source_file(tmp_path / "in.parquet", [row(10 + i, i, 7 + i % 2, price=5 + i) for i in range(9)])
    out, files = str(tmp_path / "out"), str(tmp_path / "files")
    assert main(["convert", str(tmp_path / "in.parquet"), out, "--epoch-every", "2"]) == 0
    names = capsys.readouterr().out.split()
    assert names == ["venue-7-1970-01-01.bin", "venue-8-1970-01-01.bin"]
    assert main(["export", out, files]) == 0
    assert capsys.readouterr().out.split()[1::2] == names
    assert main(["replay", out]) == 0 and main(["replay", out, "--from-ts", "14", "--to", str(tmp_path / "tail")]) == 0
    whole, tail = capsys.readouterr().out.splitlines()
    rows = spark.read.parquet(str(tmp_path / "tail")).orderBy("emit_index").collect()
    assert [r.emit_index for r in rows] == list(range(len(rows))) and rows[0].exchange_ts >= 14
    assert int(tail.split()[0]) == len(rows) < int(whole.split()[0])
    source_file(tmp_path / "bad.parquet", [row(10, 1), row(9, 2)])
    assert main(["convert", str(tmp_path / "bad.parquet"), str(tmp_path / "none")]) == 1
    assert "ExchangeTsDecreased: row 1" in capsys.readouterr().err and not (tmp_path / "none").exists()


def test_catalogue_commands(spark, tmp_path, capsys):
    spark.sql("DROP TABLE IF EXISTS benchmarks")
    (tmp_path / "bench.txt").write_text(BENCH)
    assert main(["benchmarks", str(tmp_path / "bench.txt"), "--commit", "of the command"]) == 0
    assert capsys.readouterr().out == "3 measurements\n"
    assert main(["benchmarks", str(tmp_path / "bench.txt"), "--commit", "of the command"]) == 1
    assert "DuplicateBenchmark" in capsys.readouterr().err
    spark.sql("DROP TABLE benchmarks")
