"""Loaders, options, text, drawing, streams."""

from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

from timberline.operators.grow import fit
from timberline.operators.render import layout, parse_text, render_report, report, summary, tree_text
from timberline.options import CART, Backend, Options, apply_command_line
from timberline.sources import dataset_summary, load_inferred, load_positional
from timberline.sources.lines import numbered_lines


def write(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    return str(path)


def test_positional(spark, tmp_path):
    df = load_positional(spark, write(tmp_path, "id,a,b,y\r\n1,1.5,2,p\r\n\r\n2,-3,4e1,q"))
    assert df.columns == ["a", "b", "label"]
    assert sorted(map(tuple, df.collect())) == [(-3.0, 40.0, "q"), (1.5, 2.0, "p")]


def test_strict_lines_keep_the_carriage_return(spark, tmp_path):
    path = write(tmp_path, "id,a,y\n1,1,p\r\n2,2,p")
    assert sorted(r.label for r in load_positional(spark, path, strict_lines=True).collect()) == ["p", "p\r"]


@pytest.mark.parametrize("text, message", [("a,b\n1,2", "header format"), ("", "empty"), ("id,a,y\n1,2,", "Malformed"), ("id,a,y\n1,x,p", "CAST|cast|INVALID")])
def test_refused(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        load_positional(spark, write(tmp_path, text)).collect()


def test_cells_with_any_character(spark, tmp_path):
    path = write(tmp_path, "id,a,b,y\n1,1.5,2,x\x01y\n2,3,4,\x00\x02 \u2028z\"'\\\n")
    assert sorted(map(tuple, load_positional(spark, path).collect())) == [(1.5, 2.0, "x\x01y"), (3.0, 4.0, "\x00\x02 \u2028z\"'\\")]


def test_malformed_rows_are_named(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("id,a,y\n" + "1,2,p\n" * 40 + ("1,2\n" if i == 1 else ""))
    with pytest.raises(Exception, match=r"Malformed CSV row: .*1\.csv, line 42"):
        load_positional(spark, str(tmp_path)).collect()


def test_headers_of_files_in_many_splits(spark, tmp_path):
    """Several files in a task and several tasks for a file: each header goes, and equal lines elsewhere stay."""
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("1,2,p\n" + "".join(f"{k},{k % 7},p\n" if k % 50 else "1,2,p\n" for k in range(1, 400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("500", "3000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = load_positional(spark, str(tmp_path))
            assert got.columns == ["2", "label"] and got.count() == 3 * 399
            lines = numbered_lines(spark, str(tmp_path))
            assert lines.count() == 1200 and lines.filter("start = 0 and line = 0").count() == 3 and lines.select("file", "start", "line").distinct().count() == 1200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_hexadecimal_numbers(spark, tmp_path):
    cells = ["0x1" + "0" * 20, "0x0." + "0" * 20 + "8", "-0x" + "0" * 30 + "ff", "0x1000001" + "0" * 20, "0x1000001" + "0" * 20 + "1", "0x1000003" + "0" * 12, "0x" + "f" * 25, "0x0p99999999999", "0x1.8p3"]
    got = load_positional(spark, write(tmp_path, "id,a,y\n" + "".join(f"{i},{c},{i}\n" for i, c in enumerate(cells)))).collect()
    want = {i: float(np.float32(float.fromhex(c) if "999" not in c else 0.0)) for i, c in enumerate(cells)}
    want[4] = float.fromhex("0x1000002" + "0" * 21)  # just above the middle of two floats; by way of a double it would go down
    assert {int(r.label): r.a for r in got} == want
    with pytest.raises(Exception, match="out of range"):
        load_positional(spark, write(tmp_path, "id,a,y\n1,0x1p99999999999,p\n")).collect()


def test_inferred(spark, tmp_path):
    df = load_inferred(spark, write(tmp_path, "Id,island,size,Species\n1,x,2.5,a\n2,y,NA,b\n3,z,3,c\n"))
    assert df.columns == ["size", "label"] and sorted(map(tuple, df.collect())) == [(2.5, "a"), (3.0, "c")]


def test_summary_of_rows(spark):
    df = spark.createDataFrame([(2, 1.0, "a"), (1, 5.0, "b")], "id int, v double, label string")
    assert tuple(dataset_summary(df, ["id"]).first()) == (2, "v", "v=5.0 label=b")


def test_command_line():
    got = apply_command_line(["--serial", "-d5", "x.csv", "-d", "6", "y.csv"], Options())
    assert (got.backend, got.max_depth, got.dataset_path) == (Backend.Serial, 6, "y.csv")
    for bad in (["--bogus"], ["-x"], ["-d"]):
        with pytest.raises(ValueError):
            apply_command_line(bad, Options())


def test_text_layout_and_drawing(spark):
    df = spark.createDataFrame([(1.0, "a<"), (2.0, "b"), (3.0, "a<")], "v float, label string")
    tree = fit(df, replace(CART, max_depth=2))
    boxes = layout(parse_text(tree_text(tree).split("\n")))
    at = {b.path: b for b in boxes}
    assert at[""].x == (at["L"].x + at["R"].x) / 2 and at["L"].y == 170
    drawn = render_report(report(tree, df, CART))
    assert drawn.startswith("<svg") and "a&lt;" in drawn and "accuracy = 100.0000%" in drawn and "impurityMeasure = Gini" in drawn
    assert "checked samples = 3" in summary(tree, df)
    with pytest.raises(ValueError):
        parse_text(["nonsense"])
    with pytest.raises(ValueError):
        parse_text([])


def test_stream(spark, tmp_path):
    from timberline.streaming import predict_stream

    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v float, label string")
    tree = fit(df, CART)
    df.write.parquet(str(tmp_path / "in"))
    stream = predict_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), tree)
    query = stream.writeStream.format("memory").queryName("predicted").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("predicted").collect())) == [(1.0, "a", "a"), (2.0, "b", "b")]


def test_header_is_told_by_its_place(spark, tmp_path):
    df = load_positional(spark, write(tmp_path, "id,a,y\n1,2,p\nid,a,y\n3,4,q\n"))
    with pytest.raises(Exception, match="CAST|cast|INVALID"):
        df.collect()
    rows = load_positional(spark, write(tmp_path, "1,2,3\n1,2,3\n1,2,3\n4,5,6")).collect()
    assert sorted(map(tuple, rows)) == [(2.0, "3"), (2.0, "3"), (5.0, "6")]
    many = tmp_path / "many"
    many.mkdir()
    for i in range(3):
        (many / f"{i}.csv").write_text(f"id,a,y\n{i},{i},p\n")
    assert sorted(r.a for r in load_positional(spark, str(many)).collect()) == [0.0, 1.0, 2.0]
    assert [r.label for r in load_positional(spark, write(tmp_path, 'id,a,y\n1,2,"p" \\ q\n')).collect()] == ['"p" \\ q']


def test_numbers_as_a_cell_begins(spark, tmp_path):
    cells = {"0x1A": 26.0, "-0x.8p3": -4.0, "0X1.8P-1z": 0.75, "1e3x": 1000.0, " 7 ": 7.0, "inf": float("inf"), "0e-99": 0.0, ".5": 0.5, "0x": 0.0}
    rows = "".join(f"{i},{c},p\n" for i, c in enumerate(cells))
    got = load_positional(spark, write(tmp_path, "id,a,y\n" + rows)).collect()
    assert sorted(r.a for r in got) == sorted(cells.values())


@pytest.mark.parametrize("cell", ["1e39", "-4e38", "1e-39", "1e-400", "0x1p128", "0x1p-130"])
def test_numbers_beyond_the_floats_are_refused(spark, tmp_path, cell):
    with pytest.raises(Exception, match="out of range"):
        load_positional(spark, write(tmp_path, f"id,a,y\n1,{cell},p\n")).collect()


TREE = ["ROOT [n=9]: if wide or not <= 1.5", "  yes [n=4]: Leaf -> a: <b>", "  no [n=5]: if x <= -2", "    yes [n=1]: Leaf -> c", "    no [n=4]: Leaf -> a"]


def test_parsed_text():
    boxes = parse_text(["", *TREE, " "])
    assert [(b.path, b.depth, b.edge, b.count, b.is_leaf) for b in boxes] == [("", 0, "ROOT", 9, False), ("L", 1, "yes", 4, True), ("R", 1, "no", 5, False), ("RL", 2, "yes", 1, True), ("RR", 2, "no", 4, True)]
    assert [b.title for b in boxes] == ["wide or not <= 1.500", "Leaf: a: <b>", "x <= -2.000", "Leaf: c", "Leaf: a"]


@pytest.mark.parametrize("line", ["ROOT: Leaf -> a", "ROOT [n=x]: Leaf -> a", "ROOT [n=3]: Leaf a", "ROOT [n=3]: if x < 2", "ROOT [n=3]: if x <= two", "ROOT [n=3] if x <= 2", "ROOT [n=3]: Leaf -> "])
def test_lines_that_are_no_tree(line):
    with pytest.raises(ValueError, match="Cannot read"):
        parse_text([line])


def test_drawing(tmp_path):
    import xml.etree.ElementTree as xml

    from timberline.operators import render

    (tmp_path / "in.txt").write_text("\n".join(["META: tree depth = 2", "OPTION: maxDepth = 2", "OPTION: a<b", *TREE]))
    assert render.main([str(tmp_path / "in.txt"), str(tmp_path / "out.svg")]) == 0 and render.main([]) == 1
    root = xml.parse(tmp_path / "out.svg").getroot()
    kinds = [g.get("class") for g in root.iter("{http://www.w3.org/2000/svg}g")]
    assert (kinds.count("branch"), kinds.count("end"), kinds.count("panel")) == (2, 3, 2)
    said = ["".join(t.itertext()) for t in root.iter("{http://www.w3.org/2000/svg}text")]
    assert "Leaf: a: <b>4 rows" in said and "OptionsmaxDepth = 2a<b" in said and said.count("yes") == 2
    wide, high = map(float, root.get("viewBox").split()[2:])
    for b in layout(parse_text(TREE), render.MARGIN + render.CARD_SHIFT):
        assert 260 < b.x and b.x + render.WIDE <= wide and b.y + render.HIGH <= high


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from timberline.__main__ import main

    table = write(tmp_path, "id,a,y\n" + "".join(f"{i},{i % 7},{'p' if i % 7 > 3 else 'q'}\n" for i in range(60)))
    drawing = tmp_path / "tree.svg"
    assert main(["--serial", "-d2", table], svg_path=str(drawing)) == 0
    out = capsys.readouterr().out
    assert "Loaded samples: 60" in out and "accuracy = 100.0000%" in out and "<svg" in drawing.read_text()
    assert main(["--bogus"]) == 1 and "Unknown option" in capsys.readouterr().err
    assert main([str(tmp_path / "none.csv")]) == 1


def test_kept_tables_are_released(spark):
    from timberline.tables import keep, kept, release

    since = kept(spark)
    table = keep(spark.range(3))
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert table.count() == 3 and kept(spark) == since + 1
    release(spark, since)
    assert not Path(path).exists() and kept(spark) == since
    tables = [keep(spark.range(i)) for i in (3, 4, 5)]
    release(spark, since, 1)
    assert kept(spark) == since + 1 and tables[2].count() == 5
    release(spark, since)
