"""CSV by each file's header and by byte ranges, against Spark's own reader."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from tablerecon.sources import read_csv_upload, read_files
from tablerecon.sources.csv_records import read_records, records

ESCAPES = {"unix": "\\", "excel": '"'}


def written(rows, style, end="\n", sep=","):
    out = io.StringIO()
    escape = {"doublequote": True} if style == "excel" else {"doublequote": False, "escapechar": "\\"}
    csv.writer(out, lineterminator=end, delimiter=sep, quoting=csv.QUOTE_MINIMAL, **escape).writerows(rows)
    return out.getvalue()


def plain_reader(spark, path, style, names, sep=","):
    """Spark's reader, one task a file."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"multiLine": "true", "escape": ESCAPES[style], "sep": sep, "header": "true", "enforceSchema": "false"}
    return sorted(map(tuple, spark.read.options(**options).schema(schema).csv(path).collect()), key=repr)


def some_cell(rnd, style):
    letters = ["a", "b", '"', ",", "\n", " ", "é", "\\" if style == "excel" else "x", '""', "\n\n"]
    return "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("style", ["unix", "excel"])
def test_random_quoted_cells_like_sparks_reader(spark, tmp_path, small_splits, style):
    rnd = random.Random(style)
    for n in range(3):
        rows = [["k", "v", "w"]] + [[f"r{i}", some_cell(rnd, style), some_cell(rnd, style)] for i in range(80)]
        (tmp_path / f"{n}.csv").write_text(written(rows, style))
    params = {"parseHeaderRow": True, "style": style}
    got = read_csv_upload(spark, str(tmp_path), params, ["k", "v", "w"])
    assert sorted(map(tuple, got.collect()), key=repr) == plain_reader(spark, str(tmp_path), style, ["k", "v", "w"])
    text = records(spark, str(tmp_path), {"escape": ESCAPES[style]})
    assert text.select("file", "number").distinct().count() == text.count() == 3 * 81


def test_a_file_is_many_tasks(spark, tmp_path):
    cell = "line one\nline, two " + "x" * 80
    rows = [["id", "text"]] + [[i, f"{cell} {i}"] for i in range(40_000)]
    path = tmp_path / "one.csv"
    path.write_text(written(rows, "unix"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        found = records(spark, str(path), {"escape": "\\"})
        assert found.rdd.getNumPartitions() > 8
        got = read_csv_upload(spark, str(path), {"parseHeaderRow": True}, [("id", "int"), "text"])
        assert got.selectExpr("count(*)", "sum(id)", "count(distinct text)", "max(length(text))").first()[:] == (
            40_000, sum(range(40_000)), 40_000, len(cell) + 6,
        )
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_file_has_its_own_header(spark, tmp_path, rows):
    (tmp_path / "1.csv").write_text("name,email\nAnn,ann@x\n")
    (tmp_path / "2.csv").write_text("email,name\nbob@x,Bob\n")
    (tmp_path / "3.csv").write_text('email,"na\nme",name\ncy@x,odd,"Cy\nand more"\n')
    (tmp_path / "4.csv").write_text("email\ndi@x\n")
    got = read_csv_upload(spark, str(tmp_path), {"parseHeaderRow": True}, ["name", "email"])
    assert rows(got) == [("Ann", "ann@x"), ("Bob", "bob@x"), ("Cy\nand more", "cy@x"), (None, "di@x")]
    with pytest.raises(ValueError, match="different headers"):
        read_csv_upload(spark, str(tmp_path), {"parseHeaderRow": True})
    for more in ({"multiLine": False}, {"skipRowsAfterHeader": 0}):
        some = [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]
        assert rows(read_files(spark, some, "csv", {"parseHeaderRow": True, **more}, ["name", "email"])) == [
            ("Ann", "ann@x"), ("Bob", "bob@x"),
        ]


def test_line_ends_blank_lines_and_empty_files(spark, tmp_path, rows):
    (tmp_path / "1.csv").write_bytes(b'id,t\r\n1,"a\r\nb"\r\n\r\n2,c')
    (tmp_path / "2.csv").write_bytes(b"")
    (tmp_path / "3.csv").write_bytes(b"id,t\n")
    got = read_csv_upload(spark, str(tmp_path), {"parseHeaderRow": True}, [("id", "int"), "t"])
    assert rows(got) == [(1, "a\r\nb"), (2, "c")]
    (tmp_path / "4.csv").write_text('id,t\n3,ab"c\n4,"d"x"\n5,"e"\n')
    got = read_csv_upload(spark, str(tmp_path / "4.csv"), {"parseHeaderRow": True}, ["id", "t"])
    assert rows(got) == plain_reader(spark, str(tmp_path / "4.csv"), "unix", ["id", "t"])
    nothing = tmp_path / "none"
    nothing.mkdir()
    (nothing / "e.csv").write_bytes(b"")
    assert rows(read_csv_upload(spark, str(nothing), {"parseHeaderRow": True}, ["id", "t"])) == []


def test_rows_that_are_skipped_may_hold_line_breaks(spark, tmp_path, rows, small_splits):
    text = '"note\nof two lines",x\nid;ignored,y\nid,t\nunits,"-\n-"\n' + "".join(f'{i},"v\n{i}"\n' for i in range(60))
    (tmp_path / "1.csv").write_text(text)
    params = {"parseHeaderRow": True, "skipRowsBeforeHeader": 2, "skipRowsAfterHeader": 1}
    got = read_csv_upload(spark, str(tmp_path), params, [("id", "int"), "t"])
    assert rows(got) == sorted((i, f"v\n{i}") for i in range(60)) or sorted(map(tuple, got.collect())) == [(i, f"v\n{i}") for i in range(60)]


def test_without_a_header_cells_go_by_place(spark, tmp_path, rows, small_splits):
    lines = [[f"a{i}", f"b\n{i}", i] for i in range(50)]
    (tmp_path / "1.csv").write_text(written(lines, "unix", sep=";"))
    got = read_csv_upload(spark, str(tmp_path), {"separator": ";"}, ["x", "y", ("n", "int")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lines))
    with pytest.raises(ValueError, match="declared columns"):
        read_records(spark, str(tmp_path), {}, [], header=False)
