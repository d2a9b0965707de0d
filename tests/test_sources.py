import pytest

from veilframe.plans import marts
from veilframe.sources import tables


@pytest.fixture()
def folder(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
        return str(p)

    return write


@pytest.mark.parametrize("path, kind", [
    ("/d/KDDTrain+.csv", tables.NSL), ("/d/UNSW_NB15_training-set.csv", tables.UNSW), ("/d/MachineLearningCVE/", tables.CIC),
    ("x/Friday.pcap_ISCX.csv", tables.CIC), ("/d/dataset.csv", tables.UNKNOWN),
])
def test_detect(path, kind):
    assert tables.detect(path) == kind


def test_flows_by_content(spark, folder):
    path = folder("KDDTest.csv", "﻿ index, a ,b,note,klass\n1,1.5,x,q,Normal\n2,inf,y,q,neptune\n3,3,z,q,normal\n")
    got = tables.load(spark, path)
    assert (got.label, got.features) == ("klass", ["a"])
    assert sorted((r.a is None, r.klass) for r in got.rows.collect()) == [(False, "Normal"), (False, "normal"), (True, "neptune")]
    with pytest.raises(ValueError):
        tables.load_flows(spark, folder("none.csv", "a,b\n1,x\n"))


def test_unsw(spark, folder):
    path = folder("unsw.csv", "id,dur,proto,attack_cat,label\n1,0.5,tcp, DoS ,1\n2,x,udp,,0\n3,2,udp,nan,1\n4,3,udp,Worms,0\n")
    got = tables.load(spark, path)
    assert got.features == ["dur"]
    assert sorted((r.label_str, r.dur) for r in got.rows.collect() if r.dur is not None) == [("DoS", 0.5), ("Normal", 2.0), ("Normal", 3.0)]
    named = {(r.label_str, r.category) for r in tables.with_category(got, tables.UNSW).collect()}
    assert named == {("DoS", "DoS"), ("Normal", "Normal")}


def test_cic_directory(spark, folder):
    one = folder("cic/a.csv", " Flow Bytes, Label\nInfinity,BENIGN\n1,DDoS\n")
    folder("cic/b.csv", " Flow Bytes, Label\n2,BENIGN\n")
    got = tables.load_cic(spark, one.rsplit("/", 1)[0])
    assert got.features == ["Flow Bytes"] and got.rows.count() == 3
    assert {(r.label, r.n) for r in tables.label_counts(got).collect()} == {("BENIGN", 2), ("DDoS", 1)}
    assert got.rows.where("`Flow Bytes` is null").count() == 1


def test_files_are_united_by_name(spark, folder):
    one = folder("swapped/a.csv", "\ufeff Flow Duration, Total Fwd,Fwd Len,Fwd Len, Label\n2,200,7,8,BENIGN\n")
    folder("swapped/b.csv", " Total Fwd,Extra, Flow Duration, Label\n200,9,2,DDoS\n")
    folder("swapped/empty.csv", "")
    folder("swapped/other.txt", "x\n1\n")
    got = tables.load_cic(spark, one.rsplit("/", 1)[0])
    assert got.features == ["Flow Duration", "Total Fwd", "Fwd Len", "Fwd Len.1", "Extra"]
    rows = {r.Label: r.asDict() for r in got.rows.collect()}
    assert rows["BENIGN"] == {"Flow Duration": 2.0, "Total Fwd": 200.0, "Fwd Len": 7.0, "Fwd Len.1": 8.0, "Extra": None, "Label": "BENIGN"}
    assert rows["DDoS"] == {"Flow Duration": 2.0, "Total Fwd": 200.0, "Fwd Len": None, "Fwd Len.1": None, "Extra": 9.0, "Label": "DDoS"}
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, folder("swapped/none/x.csv", ""))


def test_unreadable_files_fail_or_are_named(spark, tmp_path):
    import gzip

    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"b,a\n4,3\n"))
    (tmp_path / "bad one.csv.gz").write_bytes(b"this is no gzip stream")
    with pytest.raises(tables.UnreadableFiles, match="1 files.*bad one.csv.gz"):
        tables.read_csv(spark, str(tmp_path))
    scan = tables.scan_csv(spark, str(tmp_path), skip_unreadable=True)
    assert sorted((r.a, r.b) for r in scan.rows.collect()) == [("1", "2"), ("3", "4")]
    (left,) = scan.left_out.collect()
    assert left.file.endswith("bad one.csv.gz") and left.error == "unreadable"


def test_headers(spark, tmp_path):
    (tmp_path / "a b%.csv").write_text('\n\n"one\nname",b\n1,2\n')
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "long.csv").write_text("a,b\n" + "x,y\n" * 200_000)
    got = {r.file.rsplit("/", 1)[1]: (r.header, r.lines, r.error) for r in tables.csv_headers(spark, str(tmp_path)).collect()}
    assert got == {"a b%.csv": ('"one\nname",b', 2, None), "blank.csv": (None, 0, None), "long.csv": ("a,b", 1, None)}
    rows = tables.read_csv(spark, str(tmp_path))
    assert rows.columns == ["one\nname", "b", "a"] and rows.count() == 200_001
    assert rows.where("a is null").first().b == "2"


def test_many_files_are_one_scan(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i:03}.csv").write_text(f"k,label\n{i},{'Normal ' if i == 59 else 'x'}\n")
    rows = tables.read_csv(spark, str(tmp_path))
    assert rows.selectExpr("sum(k)").first()[0] == 1770 and rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert tables.label_column(rows) is None  # it comes after the first 50 values
    assert tables.label_column(rows, rows=60) == "label"


def test_label_column(spark, folder):
    rows = tables.read_csv(spark, folder("kdd.csv", "n,a,b,c\n" + "1,,x,nOrmal. \n" * 40 + "1,normal,x,y\n" * 40))
    assert tables.label_column(rows) == "a" and tables.label_column(rows, rows=3) == "a" and tables.label_column(rows, "x") == "b"
    assert tables.label_column(rows.select("n", "b", "c")) == "c" and tables.label_column(rows, "absent") is None
    assert tables.label_column(spark.range(3)) is None and tables.label_column(rows.limit(0)) is None
    strange = spark.createDataFrame([("normal", "q")], "_file string, `a.b` string")
    assert tables.label_column(strange) == "_file" and tables.label_column(strange, "q") == "a.b"


def test_headerless_text(spark, folder, tmp_path):
    row = ["0", "tcp", "http", "SF"] + ["1"] * 37 + ["neptune", "21"]
    path = folder("records.txt", ",".join(row) + "\n")
    tables.text_to_csv(spark, path, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == tables.NSL_COLUMNS and back.first().label == "neptune" and len(back.columns) == 43


def test_synthetic_table(spark):
    specs = {"dur": {"*": (0.5, 2.0, 0.0, 60.0), "DoS": (0.01, 0.05, 0.0, 1.0)}, "bytes": {"*": (1000.0, 10.0, 0.0, 5000.0)}}
    df = tables.synthetic(spark, {"Normal": 300, "DoS": 100}, specs, integers=["bytes"]).cache()
    assert {(r.attack_cat, r.label): r["count"] for r in df.groupBy("attack_cat", "label").count().collect()} == {("Normal", 0): 300, ("DoS", 1): 100}
    r = df.selectExpr("min(id) as a", "max(id) as z", "count(distinct id) as n", "min(dur) as lo", "max(dur) as hi", "max(bytes) as b").first()
    assert (r.a, r.z, r.n) == (1, 400, 400) and r.lo >= 0 and r.hi <= 60 and r.b <= 5000
    assert df.where("attack_cat = 'DoS' and dur > 1").count() == 0
    df.unpersist()


def test_sinks_and_json_sections(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c")).collect()} == {("a", "1.5"), ("b", None)}
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    got = marts.json_sections({"one": df, "none": df.limit(0)}).collect()
    assert {r.section: r.body for r in got} == {"one": '[{"k":"a","v":1.5},{"k":"b"}]', "none": "[]"}
