import hashlib

import pytest
from pyspark.sql import functions as F

from obsweave.plans import build
from obsweave.sources import folder


@pytest.fixture
def root(tmp_path):
    def write(name, content, encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode(encoding))

    write.path = str(tmp_path)
    return write


def test_discover(spark, root):
    for name in ("a.CSV", "sub dir/b.tsv", "meta.json", "x.PDF", "c.txt"):
        root(name, "x")
    got = {r["file"]: r["kind"] for r in folder.discover(spark, root.path).collect()}
    assert got == {"a.CSV": "table", "sub dir/b.tsv": "table", "meta.json": "readable", "c.txt": "readable", "x.PDF": "skipped"}


def dialects(spark, root):
    found = folder.dialects(folder.heads(folder.discover(spark, root.path).where("kind = 'table'")))
    return {r["file"]: r for r in found.collect()}


@pytest.mark.parametrize("content,sep", [
    ("a\tb\n1\t2\n", "\t"), ("a;b\n1,5;2\n", ";"), ("a,b\n1,2\n", ","), ("a\n1\n", ","), ("\n\n", ","),
    ("a;b;c\n1;2\n", ";"),           # uneven: largest smallest count
    ("a,b;c,d\n1,2;3\n\n\n1,2;3\n", ";"),
])
def test_delimiter(spark, root, content, sep):
    root("f.csv", content)
    assert dialects(spark, root)["f.csv"]["sep"] == sep


def test_only_first_five_lines_count(spark, root):
    root("f.csv", "a,b\n" * 5 + "x\n" * 20)
    assert dialects(spark, root)["f.csv"]["sep"] == ","


def test_encoding(spark, root):
    root("utf.csv", "µ,b\n1,2\n")
    root("latin.csv", "µ,b\n1,2\n", "latin-1")
    # a multibyte character across the end of the first read stays utf-8
    root("cut.csv", "a" * 8191 + "µ,b\n1,2\n")
    root("late.csv", "a,b\n" + "1,2\n" * 5000 + "µ,1\n", "latin-1")
    got = {k: v["encoding"] for k, v in dialects(spark, root).items()}
    assert got == {"utf.csv": "utf-8", "latin.csv": "latin-1", "cut.csv": "utf-8", "late.csv": "utf-8"}


def test_two_row_header(spark, root):
    root("two.csv", ",Flow,Flow\nTime,rate,Unnamed x\n2020,1,2\n")
    root("one.csv", ",Flow\n2020,1\n2021,2\n")
    got = dialects(spark, root)
    assert (got["two.csv"]["header_rows"], list(got["two.csv"]["names"])) == (2, ["Time", "Flow rate", "Flow"])
    assert (got["one.csv"]["header_rows"], list(got["one.csv"]["names"])) == (1, ["Unnamed: 0", "Flow"])


def test_repeated_names_and_quotes(spark, root):
    root("f.csv", '"a,x",b,b,b\n1,2,3,4\n')
    assert list(dialects(spark, root)["f.csv"]["names"]) == ["a,x", "b", "b.1", "b.2"]


def test_rows_of_mixed_dialects(spark, root):
    root("a b+c/é.csv", 'time,v,note\n1,1.5,"x, ""y"""\n\n2,NA,\n3\n')
    root("t.tsv", "Level (MSL)[m]\tpH[]\n1,5\t7\n", "latin-1")
    found = folder.dialects(folder.heads(folder.discover(spark, root.path).where("kind = 'table'")))
    got = {(r["file"], r["row"]): r["cells"] for r in folder.raw_rows(spark, root.path, found).collect()}
    assert got == {
        ("a b+c/é.csv", 0): ["1", "1.5", 'x, "y"'], ("a b+c/é.csv", 1): ["2", None, None], ("a b+c/é.csv", 2): ["3", None, None],
        ("t.tsv", 0): ["1,5", "7"],
    }


def test_row_numbers_over_many_blocks(spark, root):
    n = 20_000
    root("big.csv", "i,v\n" + "".join(f"{i},{i * 2}\n" for i in range(n)))
    root("small.csv", "i,v\n0,0\n1,2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = folder.dialects(folder.heads(folder.discover(spark, root.path).where("kind = 'table'")))
        rows = folder.raw_rows(spark, root.path, found)
        wrong = rows.where(F.col("row") != F.get("cells", F.lit(0)).cast("long")).count()
        assert (rows.count(), wrong) == (n + 2, 0)
        assert folder.raw_rows(spark, root.path, found, max_rows=10).count() == 12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_companions(spark, root):
    root("meta.json", '  {"a": 1}\n')
    root("empty.txt", "  \n")
    root("bad.md", "µ", "latin-1")
    got = {r["source"]: r["text"] for r in folder.companions(spark, root.path).collect()}
    assert got == {"meta.json": '{"a": 1}', "bad.md": "�"}


def test_large_companions_come_in_pieces(spark, root):
    long = "x" * 700
    body = "\n".join(f"line {i}\r" for i in range(100)) + "\n\n" + long + "µ end"
    root("notes.txt", " \n\u3000" + body + "\x85\n \n")
    root("blank.txt", " \n" * 500)
    pieces = list(folder._pieces(f"{root.path}/notes.txt", 64))
    assert "".join(pieces) == body and len(pieces) > 10 and max(map(len, pieces)) <= 256
    got = [tuple(r) for r in folder.companion_digests(spark, root.path).collect()]
    assert got == [("notes.txt", "notes.txt", len(body), hashlib.md5(body.encode()).hexdigest())]


def columns(spark, root):
    found = build.profile_folder(spark, root.path, "d")
    return {(r["file"], r["column"]): r for r in found.columns.collect()}, {r["file"]: r for r in found.files.collect()}


def test_profile_of_documented_file(spark, root):
    root("f.csv", "timestamp,water_level,Flagey,qc flag,quality_flag,note,gone\n" + "".join(f"2020-01-01T00:0{i}:00+01:00,{i}.5,1,0,1,x,\n" for i in range(4)))
    cols, files = columns(spark, root)
    role = {c: r["role"] for (_, c), r in cols.items()}
    assert role == {
        "timestamp": "timestamp", "water_level": "observable_property", "Flagey": "observable_property", "qc flag": "quality_flag",
        "quality_flag": "observable_property", "note": "unknown", "gone": "observable_property",
    }
    f = files["f.csv"]
    assert (f["datetime_column"], f["datetime_format"], f["timezone"], f["frequency"], f["row_count"]) == ("timestamp", "%Y-%m-%dT%H:%M:%S%z", "+01:00", "0 days 00:01:00", 4)
    level, gone = cols["f.csv", "water_level"], cols["f.csv", "gone"]
    assert (level["min"], level["max"], level["null_pct"], level["sample_values"]) == (0.5, 3.5, 0.0, ["0.5", "1.5", "2.5", "3.5"])
    assert (gone["dtype"], gone["null_pct"], gone["min"], gone["sample_values"]) == ("float64", 1.0, None, [])


def test_sentinels_become_null(spark, root):
    root("f.csv", "v,w\n" + "".join(f"{i},{'OL' if i % 5 == 0 else i}\n" for i in range(18)) + "OL,1\n7,2\n")
    cols, _ = columns(spark, root)
    v, w = cols["f.csv", "v"], cols["f.csv", "w"]
    assert (v["dtype"], v["null_pct"], v["max"]) == ("float64", 0.05, 17.0)
    assert w["dtype"] == "object"  # below nine tenths


def test_decimal_comma_holds_for_the_file(spark, root):
    root("f.csv", "a;b;c\n" + "".join(f"{i},5;{i};x\n" for i in range(5)))
    cols, files = columns(spark, root)
    assert files["f.csv"]["decimal"] == "," and cols["f.csv", "a"]["max"] == 4.5 and cols["f.csv", "b"]["dtype"] == "int64"


def test_names_with_underscore_are_no_dates(spark, root):
    root("f.csv", "sample_date,date,second time,lasted\n01.02.2020 10:00,01.02.2020 10:00,2020-01-01T10:00:00Z,0 days 12:31:00\n")
    cols, files = columns(spark, root)
    role = {c: r["role"] for (_, c), r in cols.items()}
    assert role == {"sample_date": "unknown", "date": "timestamp", "second time": "auxiliary", "lasted": "auxiliary"}
    assert files["f.csv"]["datetime_column"] == "date"


def test_normalized_rows(spark, root):
    root("lab data/f.csv", "time;a;b\n01.02.2020 10:00;1,5;x\nnever;;y\n03.02.2020 10:00;2,5;\n")
    found = build.profile_folder(spark, root.path, "d")
    # the format holds for all of the first values or for none
    assert found.files.first()["datetime_format"] is None
    root("lab data/f.csv", "time;a;b\n" + "01.02.2020 10:00;1,5;x\n" * 25 + "never;;y\n")
    found = build.profile_folder(spark, root.path, "d")
    got = build.normalized(found).where("row >= 24 and value_col <> 'time'").orderBy("row", "pos").collect()
    assert [(r["row"], r["result_time"], r["value_col"], r["value"], r["value_num"]) for r in got] == [
        ("24", "2020-02-01T10:00:00", "a", "1.5", 1.5), ("24", "2020-02-01T10:00:00", "b", "x", None),
        ("25", None, "a", None, None), ("25", None, "b", "y", None),
    ]


def test_listing_reads_no_content(spark, root):
    root("f.csv", "a,b\n1,2\n")
    plan = folder.discover(spark, root.path)._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan


def test_no_file_and_no_row_is_lost(spark, root):
    root("a.Csv", "x,y\n1,2\n")
    root("blank.csv", "\nx,y\n1,2\n")
    root("late.csv", "x,y\n" + "1,2\n" * 5000 + "µ,1\n", "latin-1")
    root("notes.Md", "text")
    found = folder.dialects(folder.heads(folder.discover(spark, root.path).where("kind = 'table'")))
    rows = folder.raw_rows(spark, root.path, found)
    got = {(r["file"], r["row"]): (r["names"], r["cells"]) for r in rows.where("row = 0 or row = 5000").collect()}
    assert got["a.Csv", 0] == got["blank.csv", 0] == (["x", "y"], ["1", "2"])
    assert got["late.csv", 5000][1] == ["µ", "1"]
    assert [r["source"] for r in folder.companions(spark, root.path).collect()] == ["notes.Md"]


def test_cells_with_line_breaks(spark, root):
    root("q.csv", 'time,note,v\n2020-01-01,"two\nlines, ""quoted""",1\n2020-01-02,5" pipe,2\n2020-01-03,"x\ny\nz",3\n')
    root("p.csv", 'time,note,v\n2020-01-01,5" pipe,1\n2020-01-02,"a,b",2\n')
    found = folder.dialects(folder.heads(folder.discover(spark, root.path).where("kind = 'table'")))
    got = {(r["file"], r["row"]): r["cells"] for r in folder.raw_rows(spark, root.path, found).collect()}
    assert got == {
        ("q.csv", 0): ["2020-01-01", 'two\nlines, "quoted"', "1"], ("q.csv", 1): ["2020-01-02", '5" pipe', "2"], ("q.csv", 2): ["2020-01-03", "x\ny\nz", "3"],
        ("p.csv", 0): ["2020-01-01", '5" pipe', "1"], ("p.csv", 1): ["2020-01-02", "a,b", "2"],
    }


def test_profile_reads_all_rows_and_lost_values_are_counted(spark, root):
    from obsweave.operators import profile

    root("long.csv", "level,late\n" + "1.5,7\n" * 100_500 + "n1,8\n99.5,x\n")
    found = build.profile_folder(spark, root.path, "d")
    got = {r["column"]: r for r in found.columns.collect()}
    assert got["level"]["max"] == 99.5 and found.files.first()["row_count"] == 100_502
    lost = {r["column"]: (r["present"], r["lost"]) for r in profile.values_lost(found.rows, found.columns, found.files).collect()}
    assert lost == {"level": (100_502, 1), "late": (100_502, 1)}
    assert found.columns.schema["ord"].dataType.typeName() == "long"


def found_rows(spark, root, split=None):
    """Rows by file and number, the unclosed quotes, and how many blocks the files were read in."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found = folder.dialects(folder.heads(folder.discover(spark, root.path).where("kind = 'table'")))
        lines, blocks = folder.table_lines(spark, root.path, found)
        rows = {(r["file"], r["row"]): r["cells"] for r in folder.rows_of(lines, blocks, found).collect()}
        return rows, {r["file"]: r["row"] for r in folder.unclosed_quotes(blocks, found).collect()}, blocks.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_unclosed_quote_swallows_nothing(spark, root):
    root("u.csv", "a,b\n" + "".join(f"{i},{'\"open' if i == 4 else 'x'}\n" for i in range(9)))
    root("fine.csv", 'a,b\n1,"x\n\ny"\n\n2,z\n')
    rows, unclosed, _ = found_rows(spark, root)
    assert [rows["u.csv", i][0] for i in range(9)] == [str(i) for i in range(9)] and rows["u.csv", 4] == ["4", "open"]
    assert unclosed == {"u.csv": 4}
    assert rows["fine.csv", 0] == ["1", "x\n\ny"] and rows["fine.csv", 1] == ["2", "z"] and len(rows) == 11


def test_broken_records_over_many_blocks_equal_the_csv_module(spark, root):
    import csv
    import io
    import random

    draw = random.Random(4)
    values = ["x", "", 'say ""hi""', "a\nb", "\n\n", 'five"', "long " * 40, "l1\n\"\"\nl3", "a,b", "c;d", "µ\n" * 30]

    def cell():
        v = draw.choice(values)
        return f'"{v}"' if "\n" in v or '""' in v or draw.random() < 0.4 and '"' not in v else v.replace(",", ".")

    text = "i,u,v\n" + "".join(f"{i},{cell()},{cell()}\n" for i in range(3000))
    root("big.csv", text)
    root("tail.csv", text + 'last,"never closed\n' + "".join(f"{i},y,z\n" for i in range(2000)))
    want = list(csv.reader(io.StringIO(text)))[1:]
    rows, unclosed, blocks = found_rows(spark, root, "20000")
    assert blocks > 10 and unclosed == {"tail.csv": 3000}
    got = [rows["big.csv", i] for i in range(3000)]
    assert [[c or "" for c in r] for r in got] == want
    assert [rows["tail.csv", i] for i in range(3000)] == got and rows["tail.csv", 3000] == ["last", "never closed", None]
    assert [rows["tail.csv", 3001 + i] for i in range(2000)] == [[str(i), "y", "z"] for i in range(2000)] and len(rows) == 3000 + 5001


def test_line_functions_compose():
    import itertools

    import numpy as np

    from obsweave.sources.records import composed

    for functions in itertools.product([(0, 0), (0, 1), (1, 0), (1, 1)], repeat=4):
        out, inside = (np.array(x, dtype=bool) for x in zip(*functions))
        for start in (False, True):
            state, want = start, []
            for o, i in functions:
                state = bool(i if state else o)
                want.append(state)
            assert composed(out, inside, start).tolist() == want


def test_lines_are_not_shuffled_and_changed_splits_are_refused(spark, root, monkeypatch):
    from pyspark.errors import PySparkException

    from obsweave.sources import records

    monkeypatch.setattr(records, "STABLE_SPLITS", 0)  # as for inputs of many full splits: nothing is copied
    root("f.csv", "a,b\n" + "".join(f"{i},x\n" for i in range(5000)))
    found = folder.dialects(folder.heads(folder.discover(spark, root.path).where("kind = 'table'")))
    rows = folder.raw_rows(spark, root.path, found)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert rows.where("row <> cast(cells[0] AS long)").isEmpty() and rows.count() == 5000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        with pytest.raises(PySparkException, match="split size"):
            folder.rows_of(*stale(spark, root, found, before), found).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def stale(spark, root, found, size):
    """Lines of now with blocks counted under another split size."""
    now = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    _, blocks = folder.table_lines(spark, root.path, found)
    spark.conf.set("spark.sql.files.maxPartitionBytes", now)
    return folder.table_lines(spark, root.path, found)[0], blocks
