"""Daily tables as a partitioned source: equal rows, cut files, pruned days."""

import os
import random

from pyspark.sql import functions as F

from coweave.sources import daily_csv, daily_source as ds

HEAD = "head,1,2,3,4,5,6,7,8,9,10\nsub,a,b,c,d,e,f,g,h,i,j\n"


def write(path, name, content):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "wb") as f:
        f.write(content.encode())


def some_files(path, seed=1, ends="\n"):
    rnd = random.Random(seed)
    for day in range(1, 8):
        lines = [f"{rnd.choice(['steel', 'gold', 'öl'])}/x{i},{i},{rnd.randint(-9, 9)}.{i}%,,,,,,,," + "z" * rnd.randint(0, 40)
                 for i in range(rnd.randint(0, 60))]
        if day == 3:
            lines[5:5] = ["", '"oil, crude/y",1,--,,,,,,,,']
        write(path, f"2024-01-{day:02}.csv", HEAD.replace("\n", ends) + ends.join(lines) + (ends if day % 2 else ""))
    write(path, "2024-02-01.csv", "")
    write(path, "2024-02-02.csv", HEAD)
    write(path, "_notes.csv", "not a table")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_the_whole_file_reader(spark, tmp_dir):
    for ends in ("\n", "\r\n"):
        path = f"{tmp_dir}/{len(ends)}"
        some_files(path, ends=ends)
        want = rows(daily_csv.read_daily_csv(spark, path))
        assert rows(ds.read_daily(spark, path)) == want and len(want) > 100
        for size in (7, 64, 1000):          # files cut anywhere, even within the leading rows
            assert rows(ds.read_daily(spark, path, split_bytes=size)) == want


def test_parts_hold_every_line_once(tmp_dir, monkeypatch):
    text = b"".join(b"line %d\n" % i for i in range(300)) + b"\n\n" + b"x" * 500 + b"\nlast"
    write(tmp_dir, "2024-01-01.csv", text.decode())
    for read_bytes in (3, 100, 1 << 20):
        monkeypatch.setattr(ds, "READ_BYTES", read_bytes)
        for size in (1, 5, 64, 999, 10_000):
            reader = ds.DailyReader({"path": tmp_dir, "split_bytes": str(size)})
            got = [line for p in reader.partitions() for line in ds.lines_between(tmp_dir, p)]
            assert got == text.split(b"\n")


def test_a_day_chooses_its_file(spark, tmp_dir):
    some_files(tmp_dir)
    whole = ds.read_daily(spark, tmp_dir)
    day = F.col("date") == "2024-01-03"
    one = ds.read_daily(spark, tmp_dir, days=day)
    assert whole.rdd.getNumPartitions() >= 8 and one.rdd.getNumPartitions() == 1
    assert rows(one) == [r for r in rows(whole) if r[0] == "2024-01-03.csv"]
    some = ds.read_daily(spark, tmp_dir, days=F.col("date").between("2024-01-02", "2024-01-04"))
    assert some.rdd.getNumPartitions() == 3
    assert rows(some) == [r for r in rows(whole) if "2024-01-02" <= r[0][:10] <= "2024-01-04"]
    assert ds.read_daily(spark, tmp_dir, days=F.col("date") == "1999-01-01").count() == 0
    chosen = ds.read_daily(spark, tmp_dir, days=F.col("date").isin("2024-01-01", "2024-01-05") & (F.col("line") != ""))
    assert chosen.rdd.getNumPartitions() == 2


def test_folders_of_days_and_an_empty_folder(spark, tmp_dir):
    write(f"{tmp_dir}/d/date=2024-01-02", "part-0.txt", HEAD + "steel/x,1,1.5%,,,,,,,,\n")
    write(f"{tmp_dir}/d/date=2024-01-03", "part-0.txt", HEAD + "gold/x,1,2%,,,,,,,,\n")
    got = rows(ds.read_daily(spark, f"{tmp_dir}/d", day_folders=True))
    assert [(r[0], r[4], r[5], r[6], r[7]) for r in got] == [
        ("2024-01-02", "2024-01", 0, "steel", 1.5), ("2024-01-03", "2024-01", 0, "gold", 2.0)]
    os.makedirs(f"{tmp_dir}/none")
    assert ds.read_daily(spark, f"{tmp_dir}/none").count() == 0
