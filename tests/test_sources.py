"""Round trips of the file sources and sinks."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import graph_of
from coweave.operators import cooccur, ranking
from coweave.sources import daily_csv, gexf, messages, text


def _write(path, name, content):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(content)


def test_vertices_with_double_space(spark, tmp_dir):
    _write(tmp_dir, "name.txt", "101 alice\n205  bob smith\n309 carol\n")
    got = {r["id"]: r["name"] for r in text.read_vertices(spark, tmp_dir).collect()}
    assert got == {101: "alice", 205: "bob smith", 309: "carol"}


def test_bad_lines_raise(spark, tmp_dir):
    _write(tmp_dir + "/v", "name.txt", "101 alice\nxx bad\n")
    _write(tmp_dir + "/e", "pairs.txt", "1 2 3\n1 two 3\n")
    _write(tmp_dir + "/m", "101.txt", "101 205 x9 \n")
    with pytest.raises(Exception, match="not an id: xx"):
        text.read_vertices(spark, tmp_dir + "/v").collect()
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        text.read_edges(spark, tmp_dir + "/e").collect()
    with pytest.raises(Exception, match="not an id: x9"):
        text.read_memberships(spark, tmp_dir + "/m").collect()


def test_work_ids_do_not_depend_on_the_splits(spark, tmp_dir):
    _write(tmp_dir, "1.txt", "".join(f"1 {i} \n" for i in range(2, 40)))
    _write(tmp_dir, "2.txt", "2 1 \n2 3 \n")
    def ids():
        return sorted((r["work_id"].rsplit("/", 1)[1], r["member"])
                      for r in text.membership_rows(text.read_memberships(spark, tmp_dir)).collect())
    whole = ids()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert ids() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ("1.txt#0", 2) in whole and ("2.txt#1", 3) in whole


def test_edges_round_trip(spark, tmp_dir):
    e = spark.createDataFrame([(1, 2, 3), (2, 5, 1)], "src bigint, dst bigint, w bigint")
    text.write_pair_counts(e, tmp_dir + "/pairs")
    back = sorted(tuple(r) for r in text.read_edges(spark, tmp_dir + "/pairs").collect())
    assert back == [(1, 2, 3), (2, 5, 1)]


def test_memberships_directory_to_edges(spark, tmp_dir):
    _write(tmp_dir, "101.txt", "101 205 309 \n101 205 \n")
    _write(tmp_dir, "205.txt", "205 101 \n")
    lines = text.read_memberships(spark, tmp_dir)
    assert lines.count() == 3
    e = cooccur.cooccurrence_edges(text.membership_rows(lines))
    got = sorted(tuple(r) for r in e.collect())
    assert got == [(101, 205, 3), (101, 309, 1), (205, 309, 1)]


def test_write_memberships_and_vertices(spark, tmp_dir):
    df = spark.createDataFrame([(101, [101, 205]), (101, [101, 309])],
                               "member bigint, members array<bigint>")
    text.write_memberships(df, tmp_dir + "/m")
    lines = sorted(r["value"] for r in spark.read.text(tmp_dir + "/m/member=101").collect())
    assert lines == ["101 205 ", "101 309 "]
    v = spark.createDataFrame([(1, "a")], "id bigint, name string")
    text.write_vertices(v, tmp_dir + "/v")
    assert [r["value"] for r in spark.read.text(tmp_dir + "/v").collect()] == ["1 a"]


def test_daily_csv(spark, tmp_dir):
    head = "head,1,2,3,4,5,6,7,8,9,10\nsub,a,b,c,d,e,f,g,h,i,j\n"
    _write(tmp_dir, "2024-01-02.csv", head + 'steel/x,1,1.5%,,,,,,,,\n"oil, crude/y",1,--,,,,,,,,\n')
    _write(tmp_dir, "2024-02-01.csv", head + "gold,1,2%,,,,,,,,\n")
    rows = sorted((r["file"], r["pos"], r["name"], r["pct"], r["month_key"])
                  for r in daily_csv.read_daily_csv(spark, tmp_dir).collect())
    assert rows == [("2024-01-02.csv", 0, "steel", 1.5, "2024-01"),
                    ("2024-01-02.csv", 1, "oil, crude", 0.0, "2024-01"),
                    ("2024-02-01.csv", 0, "gold", 2.0, "2024-02")]


def test_export_and_read_result_json(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'a"b', 7), (2, "c", 5)], "id bigint, name string, v bigint")
    top = ranking.top_n(df, "v", 2)
    txt = messages.export_pairs_json(top, "name", "v").first()["text"]
    assert json.loads(txt) == [['a"b', 7], ["c", 5]]
    _write(tmp_dir, "neighbour.json", txt)
    _write(tmp_dir, "pa.json", json.dumps(["x", "y"]))
    got = sorted((r["file"], r["pos"], r["name"], r["value"])
                 for r in messages.read_result_json(spark, tmp_dir).collect())
    assert got == [("neighbour.json", 1, 'a"b', 7.0), ("neighbour.json", 2, "c", 5.0),
                   ("pa.json", 1, "x", None), ("pa.json", 2, "y", None)]


def test_gexf_round_trip(spark, tmp_dir):
    g = graph_of(spark, [(1, 2, 3), (2, 3, 1)], vertices={1: "a<b", 2: "c", 3: "d"})
    gexf.write_gexf(g, tmp_dir + "/g")
    parts = sorted(glob.glob(tmp_dir + "/g/part-*"))
    doc = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert doc.startswith('<?xml') and doc.rstrip().endswith("</gexf>")
    assert doc.index("<nodes>") < doc.index("<node ") < doc.index("</nodes>") < doc.index("<edge ")
    with open(tmp_dir + "/doc.gexf", "w", encoding="utf-8") as f:
        f.write(doc)
    nodes, edges = gexf.read_gexf(spark, tmp_dir + "/doc.gexf")
    assert {r["id"]: r["label"] for r in nodes.collect()} == {"1": "a<b", "2": "c", "3": "d"}
    assert sorted((r["source"], r["target"], r["weight"]) for r in edges.collect()) == [
        ("1", "2", 3.0), ("2", "1", 3.0), ("2", "3", 1.0), ("3", "2", 1.0)]


def test_read_gexf_missing_weight(spark, tmp_dir):
    _write(tmp_dir, "x.gexf", '<gexf><graph><nodes><node id="0" label="a"/><node id="1" label="b"/>'
           '</nodes><edges><edge id="0" source="1" target="0"/>'
           '<edge id="1" source="0" target="1" weight="8.0"/></edges></graph></gexf>')
    _, edges = gexf.read_gexf(spark, tmp_dir + "/x.gexf")
    assert sorted(r["weight"] for r in edges.collect()) == [1.0, 8.0]


def test_write_metric_partitions(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1.0)], "name string, value double")
    messages.write_metric(df, "neighbour", tmp_dir + "/r")
    messages.write_metric(df.withColumn("value", F.lit(2.0)), "pagerank", tmp_dir + "/r")
    messages.write_metric(df.withColumn("value", F.lit(3.0)), "neighbour", tmp_dir + "/r")
    got = sorted((r["metric"], r["value"]) for r in spark.read.parquet(tmp_dir + "/r").collect())
    assert got == [("neighbour", 3.0), ("pagerank", 2.0)]


def test_gexf_of_several_part_files_is_read_whole(spark, tmp_dir):
    names = {n: f"v{n}" for n in range(400)} | {0: 'a <b> & "c" \'d\'', 1: "two\nlines", 2: "&lt;", 3: ""}
    g = graph_of(spark, [(n, n + 1, n % 7 + 1) for n in range(399)], vertices=names)
    lines = gexf.gexf_lines(g).orderBy("section", "k1", "k2").select("line")
    lines.repartitionByRange(5, "line").write.text(tmp_dir + "/g")
    nodes, edges = gexf.read_gexf(spark, tmp_dir + "/g")
    assert {r["id"]: r["label"] for r in nodes.collect()} == {str(n): v.replace("\n", " ") for n, v in names.items()}
    assert sorted((int(r["source"]), int(r["target"]), r["weight"]) for r in edges.collect()) == sorted(
        e for n in range(399) for e in ((n, n + 1, n % 7 + 1.0), (n + 1, n, n % 7 + 1.0)))
