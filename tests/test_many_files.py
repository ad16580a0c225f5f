"""Many small files: the driver holds no list of them, and all lines are the same as in one scan."""

import glob
import os

from pyspark.sql import functions as F

from obsweave.sources import folder, sinks

CONTENT = {
    "plain.csv": b"a,b\n1,2\n\n3,4\n", "s 1/bom.csv": b"\xef\xbb\xbfa;b\n1;2\n", "[x]{y} 100%+.CSV": b"a\tb\r\n1\t2\r\n", "s 1/cr.csv": b"a,b\r1,2\r3,4",
    "d=%23/quoted.csv": b'a,b\n"x\ny",2\n3,"z\n\nw"\n', "late.csv": b"a,b\n" + b"1,2\n" * 3000 + b"\xb5,1\n", "open.csv": b'a,b\n1,2\n"3,4\n5,6\n', "d=%23/deep/er/end.tsv": b"a\n1",
    "blank.csv": b"\n\n", "empty.csv": b"", "_hidden.csv": b"a\n1\n", "_part=1/shown.csv": b"a\n1\n", ".dot/no.csv": b"a\n1\n", "notes.txt": b"text",
}
HIDDEN = {"empty.csv", "_hidden.csv", ".dot/no.csv"}


def laid(tmp_path):
    for name, content in CONTENT.items():
        path = tmp_path / "m" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "m")


def test_listing_is_left_to_tasks(spark, tmp_path, monkeypatch):
    root = laid(tmp_path)
    found = folder.discover(spark, root)
    # the files of a Spark scan are held by the driver
    assert not [f for f in found.inputFiles() if not f.endswith(".parquet")]
    got = {r["file"]: (r["path"], r["length"]) for r in found.collect()}
    assert got == {f: (f"file:{root}/{f}", len(c)) for f, c in CONTENT.items() if f not in HIDDEN}


def test_small_files_read_by_tasks_give_the_rows_of_a_scan(spark, tmp_path, monkeypatch):
    root = laid(tmp_path)

    def rows():
        found = folder.dialects(folder.heads(folder.discover(spark, root).where("kind = 'table'")))
        lines, blocks = folder.table_lines(spark, root, found)
        opened = {r["file"]: r["row"] for r in folder.unclosed_quotes(blocks, found).collect()}
        return sorted((r["file"], r["row"], r["names"], r["cells"]) for r in folder.rows_of(lines, blocks, found).collect()), opened

    scanned = rows()
    assert len(scanned[0]) > 3000 and scanned[1] == {"open.csv": 1}
    monkeypatch.setattr(folder, "MANY_FILES", 2, raising=False)
    monkeypatch.setattr(folder, "SMALL_FILE", 2000, raising=False)  # late.csv and no other is scanned
    reads = []
    text = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, paths, *a, **k: reads.append(paths) or text(self, paths, *a, **k))
    assert rows() == scanned
    assert reads == [[f"file:{root}/late.csv"]]


def test_files_of_one_device_have_one_header_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 2)
    wide = spark.range(200).select(F.lit("s").alias("site"), F.lit("d^[#]").alias("device"), F.col("id").alias("timestamp"), F.col("id").cast("double").alias("v"))
    (tmp_path / "w").mkdir()
    (tmp_path / "w/old.csv").write_text("old")
    sinks.write_sites(wide, str(tmp_path / "w"))
    files = glob.glob(str(tmp_path / "w/**"), recursive=True)
    files = [open(f).read().splitlines() for f in files if os.path.isfile(f)]
    # two files in one task used to be one with two headers
    assert all(f[0] == "timestamp,v" and f.count("timestamp,v") == 1 for f in files)
    assert sorted(int(r.split(",")[0]) for f in files for r in f[1:]) == list(range(200))
    assert os.listdir(tmp_path / "w/site=s") == ["device=d%5E%5B%23%5D"]
