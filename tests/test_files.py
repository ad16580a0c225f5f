import glob

import pytest
from pyspark.sql import functions as F

from obsweave.functions.text import unescape
from obsweave.sources import sinks, tables


U = "\\" + "u"  # begins the escape of a code point


@pytest.mark.parametrize("escaped,raw", [
    (f"{U}00B5m", chr(0xB5) + "m"), (r"a\tb\bc\fd\'e\"f\\n", "a\tb\bc\fd'e\"f\\n"), (rf"\U0001F600{U}D83D{U}DE00", chr(0x1F600) * 2),
    (f"{U}D800x", chr(0xFFFD) + "x"), (r"\UFFFFFFFF", chr(0xFFFD)), (rf"\q{U}12", rf"\q{U}12"), ("plain", "plain"), (rf"\{U}00B5", f"{U}00B5"),
])
def test_unescape(rows, escaped, raw):
    assert rows("t string", (escaped,)).select(unescape(F.col("t"))).first()[0] == raw


def test_every_line_of_ntriples_is_read_or_rejected(spark, tmp_path):
    long = "x" * 300_000 + r"\n\"" * 20_000
    lines = [
        rf'<http://e/{U}00B5> <http://e/p> "a \"b\" . # c" . # said by "d" .', "# a comment", "", '_:b1 <http://e/p> <http://e/o>.', '<http://e/s> <http://e/p> "5"^^<http://e/int> .',
        '<http://e/s> <http://e/p> "x"@en-GB . ', '<http://e/s> <http://e/p> "open .', "nonsense", "nonsense", '<http://e/s> <http://e/p> "" .', f'<http://e/s> <http://e/p> "{long}" .',
    ]
    (tmp_path / "t.nt").write_text("\n".join(lines))
    got = {(r["s"], r["o"], r["o_kind"], r["o_datatype"], r["o_lang"]) for r in tables.ntriples(spark, str(tmp_path)).collect()}
    assert got == {
        ("http://e/µ", 'a "b" . # c', "literal", None, None), ("_:b1", "http://e/o", "iri", None, None), ("http://e/s", "5", "literal", "http://e/int", None),
        ("http://e/s", "x", "literal", None, "en-GB"), ("http://e/s", "", "literal", None, None), ("http://e/s", "x" * 300_000 + '\n"' * 20_000, "literal", None, None),
    }
    assert {tuple(r) for r in tables.ntriples_rejected(spark, str(tmp_path)).collect()} == {('<http://e/s> <http://e/p> "open .', 1), ("nonsense", 2)}


def test_a_line_meets_its_pattern_once(spark, tmp_path):
    (tmp_path / "t.nt").write_text("<http://e/s> <http://e/p> <http://e/o> .\n")
    plan = tables.ntriples(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_extract(" not in plan


def test_every_device_file_has_its_own_columns(rows, tmp_path, monkeypatch):
    wide = rows("site string, device string, timestamp string, h double, q double, note string",
                ("s", "d", "t2", 1.0, None, None), ("s", "d", "t1", None, None, 'a "b", c\nd'), ("s", "e", "t1", None, 2.5, None), ("s 2", "f/g", "t1", None, None, None))
    sinks.write_sites(wide, str(tmp_path / "w"))
    got = {p.split("/w/")[1].rsplit("/", 1)[0]: open(p).read() for p in glob.glob(str(tmp_path / "w/*/*/*.csv"))}
    assert got == {
        "site=s/device=d": 'timestamp,h,note\nt1,,"a ""b"", c\nd"\nt2,1.0,\n', "site=s/device=e": "timestamp,q\nt1,2.5\n", "site=s 2/device=f%2Fg": "timestamp\nt1\n",
    }
    monkeypatch.setattr(sinks, "FILE_ROWS", 1)
    sinks.write_sites(wide, str(tmp_path / "v"))
    parts = [open(p).read() for p in glob.glob(str(tmp_path / "v/site=s/device=d/*.csv"))]
    assert all(p.startswith("timestamp,h,note\n") for p in parts)


def test_a_graph_is_written_compressed_in_many_files_and_plain_lines_are_read_as_by_the_pattern(spark, rows, tmp_path, monkeypatch):
    odd = ["plain", "", " . ", 'a "b"', "a>b", 'x"^^<y> .', "a\\nb", "line\nbreak", '" .', "> .", "µ  "]
    literals = [(f"http://e/{i}", "http://e/p", o, "literal", d, lang) for i, o in enumerate(odd) for d, lang in ((None, None), ("http://e/int", None), (None, "en"))]
    graph = rows("s string, p string, o string, o_kind string, o_datatype string, o_lang string",
                 *literals, *[(f"http://e/{i}", "http://e/p", f"http://e/{i}", "iri", None, None) for i in range(40)], ("http://e/<", "http://e/\"", "http://e/ <", "iri", None, None))
    monkeypatch.setattr(sinks, "GRAPH_LINES", 5, raising=False)
    sinks.write_ntriples(graph.coalesce(1), str(tmp_path / "g"))
    files = glob.glob(str(tmp_path / "g/part-*"))
    assert len(files) == 15 and all(f.endswith(".txt.gz") for f in files)
    assert sorted(map(str, tables.ntriples(spark, str(tmp_path / "g")).collect())) == sorted(map(str, graph.collect()))
    spaced = ['<http://e/s> <http://e/p>  <http://e/o> .', '<http://e/s> <http://e/p> "a" "b" .', '<http://e/s> <http://e/p> "a"^^<b> . x', '<a> <b> "c"^^<d>> .', '<a> <b> <c> . .', '<a> <b> <c>', '<> <> <> .',
              '<a> <b> "" .', '<a> <b> " .', '<a> <b> ""^^<d> .', '<a> <b> "c" .>', '<a> <b> "c"@en .', '<a> <b> "c"^^<> .', '<a> <b> < > .', '<a> x<b> <c> .', '<a> <b> "c"^<d> .', '<a> <b> "c\\" .']
    (tmp_path / "s.nt").write_text("\n".join(spaced))
    fast = tables.ntriples_lines(spark, str(tmp_path / "s.nt")).collect()
    monkeypatch.setattr(tables, "_plain_parts", lambda cut: F.lit(None).cast("array<string>"))
    assert fast == tables.ntriples_lines(spark, str(tmp_path / "s.nt")).collect()
