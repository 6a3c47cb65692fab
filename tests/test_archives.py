"""The archive source against plain unpacking, and the way from archives to one checked grid."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marketloom.operators import training
from marketloom.operators.validate import ValidationError
from marketloom.sources import archives, ingest

DAY = 86_400_000


def write(folder, name, members):
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
        for member, text in members.items():
            z.writestr(member, text)


def plain(folder, symbol, kind):
    out = []
    for path in sorted(folder.rglob("*.zip")):
        named = archives.archive_of(path.name, kind)
        if named and named[0] == symbol:
            with zipfile.ZipFile(path) as z:
                for member in sorted(n for n in z.namelist() if n.endswith(".csv")):
                    out += [(*row, named[1]) for row in csv.reader(io.TextIOWrapper(z.open(member), "utf-8"))]
    return sorted(out)


def test_rows_filters_and_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BLOCK_BYTES", 2000)
    for d in range(1, 6):
        rows = "timestamp,percentage,depth,notional\n" + "".join(f"2024-01-0{d} 00:00:{i % 60:02d},{i % 5 + 1},{i}.5,\n" for i in range(300))
        write(tmp_path, f"AB-bookDepth-2024-01-0{d}.zip", {"b.csv": rows, "a.csv": "1,2,3,\"x,\u00e9\"\n", "empty.csv": "", "note.txt": "no"})
    write(tmp_path, "AB-1m-2024-01-01.zip", {"k.csv": ",".join("1" * 12) + "\n"})
    write(tmp_path, "ABC-bookDepth-2024-01-01.zip", {"b.csv": "9,9,9,9\n"})
    got = ingest.read_archives(spark, str(tmp_path), "AB", "bookDepth")
    assert got.columns == [*ingest.schema_of("bookDepth"), "archive_day"]
    assert sorted(map(tuple, got.collect())) == plain(tmp_path, "AB", "bookDepth")
    assert ingest.read_archives(spark, f"file://{tmp_path}", "AB", "klines").count() == 1
    source = spark.read.format("market_archives").option("kind", "bookDepth").option("partition_bytes", 1).load(str(tmp_path))
    some = source.filter((F.col("archive_symbol") == "AB") & (F.col("archive_day") >= "2024-01-03") & F.col("archive_day").isin("2024-01-03", "2024-01-05", "2024-01-01") & (F.col("percentage") == "2"))
    assert {r.archive_day for r in some.collect()} == {"2024-01-03", "2024-01-05"} and some.rdd.getNumPartitions() == 2
    assert "archive_symbol" not in some._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1].split("\n")[0]
    assert ingest.read_archives(spark, str(tmp_path), "NONE", "bookDepth").count() == 0


def test_rows_of_other_lengths(spark, tmp_path):
    write(tmp_path, "AB-bookDepth-2024-01-01.zip", {"b.csv": "1,2,3,4\n1,2,3,4,5\n1,2\n"})
    with pytest.raises(Exception, match="(?i)column|field"):
        ingest.read_archives(spark, str(tmp_path), "AB", "bookDepth").collect()
    kept = spark.read.format("market_archives").option("kind", "bookDepth").option("bad_rows", "skip").load(str(tmp_path))
    assert kept.count() == 1


def test_load_from_archives_to_one_grid(spark, tmp_path):
    """Two days of a symbol: book, candles and metrics end up on one checked grid in order of time."""
    from marketloom.operators.reshape import BANDS

    folder = tmp_path / "zips"
    folder.mkdir()
    step, n = 3_600_000, 48
    for d in range(2):
        hours = [h for h in range(n) if h // 24 == d]
        book = "".join(f"{h * step},{b},{h + abs(b)}.0,{h}.5\n" for h in hours for b in BANDS)
        candles = "".join(f"{h * step},1,2,0.5,{h + 1},10,{h * step + step - 1},5,3,1,1,0\n" for h in hours)
        metrics = "".join(f"{h * step + 1000},AB,{h + 7},2.0,1.0,1.1,1.2,1.3\n" for h in hours)
        for kind, text in (("bookDepth", book), ("1h", candles), ("metrics", metrics)):
            write(folder, f"AB-{kind}-1970-01-0{d + 1}.zip", {"x.csv": text})
    data = training.TrainingData()
    rows = data.load(spark, str(folder), str(tmp_path / "store"), "AB", "1h").collect()
    assert [r.timestamp for r in rows] == [h * step for h in range(n)]
    assert [r.close for r in rows] == [h + 1.0 for h in range(n)] and rows[5]["depth_-3"] == 8.0 and rows[5].sum_open_interest == 12
    (folder / "AB-1h-1970-01-02.zip").unlink()
    with pytest.raises(ValidationError):
        data.load(spark, str(folder), str(tmp_path / "other"), "AB", "1h")
