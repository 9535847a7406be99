import zipfile
from datetime import date, datetime
from decimal import Decimal

import pandas as pd
import pytest

from tablewright.operators.custom import CustomStep, Param, custom_step
from tablewright.operators.dates import DatetimeEncoder
from tablewright.operators.encode import Encoder
from tablewright.operators.scale import Scaler
from tablewright.session import CHECKPOINT_CONF, checkpoint_root
from tablewright.sources import workbook as sheets
from tablewright.sources.readers import read_csv, read_excel, read_excel_sheets, read_parquet
from tablewright.sources.sinks import preview, write_csv, write_excel, write_parquet, write_report
from tablewright.sources.workbook import column_number
from tablewright.streaming.apply import apply_to_stream, file_stream, write_available

PEOPLE = "name,age,score\nAlice,30,95.5\nBob,25,87.0\nCharlie,35,92.3\n"


def test_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(PEOPLE)
    df = read_csv(spark, str(path))
    assert df.dtypes == [("name", "string"), ("age", "int"), ("score", "double")] and df.count() == 3
    path.write_text(PEOPLE.replace(",", "\t").split("\n", 1)[1])
    bare = read_csv(spark, str(path), separator="\t", header=False)
    assert bare.columns == ["0", "1", "2"] and bare.first()[1] == 30
    typed = read_csv(spark, str(path), separator="\t", header=False, schema="who string, years long, pts double")
    assert typed.columns == ["who", "years", "pts"]
    with pytest.raises(ValueError, match="path is required"):
        read_csv(spark, "")


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,text,day\n1,"say ""hi"", ok",2024-01-01\n2,"two\nlines",2024-01-02\n')
    rows = read_csv(spark, str(path), multiline=True).collect()
    assert [r["text"] for r in rows] == ['say "hi", ok', "two\nlines"] and str(rows[0]["day"]) == "2024-01-01"
    one = tmp_path / "one.csv"
    one.write_text('id,text,day\n1,"say ""hi"", ok",2024-01-01\n')
    assert read_csv(spark, str(one)).first()["text"] == 'say "hi", ok'
    odd = [(1, 'a "quoted" word'), (2, "x,y"), (3, "line\nbreak"), (4, '"'), (5, "back\\slash"), (6, None)]
    write_csv(spark.createDataFrame(odd, "id int, text string"), str(tmp_path / "o"))
    back = read_csv(spark, str(tmp_path / "o"), schema="id int, text string", multiline=True)
    assert sorted(map(tuple, back.collect())) == odd


def test_parquet_columns(spark, tmp_path):
    write_parquet(spark.createDataFrame([(1, 4, 7), (2, 5, 8)], "a int, b int, c int"), str(tmp_path / "t"))
    assert read_parquet(spark, str(tmp_path / "t"), "a, c").columns == ["a", "c"]
    plan = read_parquet(spark, str(tmp_path / "t"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int>" in plan


def workbook(path, sheets, skip=0):
    """A minimal .xlsx: shared strings for text, plain values for numbers."""
    strings, parts, names = [], [], []
    for i, (name, lines) in enumerate(sheets.items(), 1):
        rows = []
        for r, line in enumerate(lines, 1 + skip):
            cells = ""
            for c, v in enumerate(line):
                ref = f"{chr(65 + c)}{r}"
                if isinstance(v, str):
                    strings.append(v)
                    cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                elif v is not None:
                    cells += f'<c r="{ref}"><v>{v}</v></c>'
            rows.append(f'<row r="{r}">{cells}</row>')
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        parts.append(f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData></worksheet>")
        names.append(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>')
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>{''.join(names)}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(parts) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
        for i, part in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", part)


def test_excel(spark, tmp_path):
    lines = [("name", "age", "score"), ("Alice", 30, 95.5), ("Bob", None, 87.0), ("Charlie", 35, None)]
    workbook(tmp_path / "a.xlsx", {"first": lines, "second": [lines[0], ("Dora", 41, 60.25)]})
    workbook(tmp_path / "b.xlsx", {"first": [lines[0], ("Eve", 22, 71.0)]})
    schema = "name string, age int, score double"
    df = read_excel(spark, str(tmp_path), schema)
    assert sorted(map(tuple, df.collect()))[:2] == [("Alice", 30, 95.5), ("Bob", None, 87.0)] and df.count() == 4
    second = read_excel(spark, str(tmp_path / "a.xlsx"), "score double, name string", sheet="second")
    assert [tuple(r) for r in second.collect()] == [(60.25, "Dora")]
    with pytest.raises(Exception, match="has no sheet"):
        read_excel(spark, str(tmp_path), schema, sheet="nope").collect()
    with pytest.raises(Exception, match="has no columns"):
        read_excel(spark, str(tmp_path), "zip string").collect()


def test_excel_days_and_times(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"s": [("day", "moment"), (45123, 45123.75), (None, None), ("2024-02-03", "2024-02-03 04:05:06")]})
    rows = read_excel(spark, str(tmp_path), "day date, moment timestamp").collect()
    assert [str(r["day"]) for r in rows] == ["2023-07-16", "None", "2024-02-03"]
    assert [str(r["moment"]) for r in rows] == ["2023-07-16 18:00:00", "None", "2024-02-03 04:05:06"]


def test_excel_skipped_rows(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"s": [("title",), ("name", "age"), ("Alice", 30)]}, skip=2)
    df = read_excel(spark, str(tmp_path), "age long", header_row=1, skip_rows=2)
    assert [r["age"] for r in df.collect()] == [30]
    assert (column_number("A1"), column_number("AB7")) == (0, 27)


def test_sinks_and_preview(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(30)], "a int, s string")
    write_csv(df, str(tmp_path / "c"))
    assert read_csv(spark, str(tmp_path / "c")).count() == 30
    write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 30
    shown = preview(df.repartition(5), "a")
    assert [r["a"] for r in shown.rows().collect()] == list(range(10)) and shown.total() == 30


def test_custom_steps(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 8.0)], "k int, v double")

    @custom_step({"by": Param(2, low=1, high=5), "mode": Param("x", choices=["x", "y"])})
    def scaled(frame, by, mode):
        return frame.selectExpr("k", f"v * {by} AS v")

    assert [r["v"] for r in scaled(df, by=3).collect()] == [6.0, 12.0, 24.0]
    for given, message in (({"by": 9}, "outside"), ({"mode": "z"}, "not one of"), ({"nope": 1}, "unknown parameters")):
        with pytest.raises(ValueError, match=message):
            scaled(df, **given)
    groups = CustomStep(lambda f: pd.DataFrame({"k": [f.k.iloc[0]], "n": [len(f)]}), {}, "groups", "k int, n long", ("k",))
    assert sorted(map(tuple, groups(df).collect())) == [(1, 2), (2, 1)]
    for kw, message in ((dict(mode="rows"), "unknown mode"), (dict(mode="batches"), "output schema"), (dict(mode="groups", schema="k int"), "grouping columns")):
        with pytest.raises(ValueError, match=message):
            CustomStep(lambda f: f, {}, **kw)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT id, id * 1.5D AS v, if(id % 2 = 0, 'a', 'b') AS s, timestamp_ntz'2024-01-01 10:00:00' AS ts FROM range(100)")
    source = str(tmp_path / "in")
    df.limit(60).write.parquet(source)
    steps = []
    ready = df
    for step in (Scaler(columns="v"), Encoder("label", "s"), DatetimeEncoder("ts")):
        steps.append(step.fit(ready))
        ready = steps[-1].transform(ready)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def advance():
        stream = apply_to_stream(file_stream(spark, source, df.schema), steps)
        write_available(stream, out, mark).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    assert advance() == sorted(map(tuple, apply_to_stream(df.limit(60), steps).collect()))
    df.where("id >= 60").write.mode("append").parquet(source)
    assert advance() == sorted(map(tuple, ready.collect()))


def test_checkpoint_folder_comes_from_the_session(spark):
    class Session:
        def __init__(self, **values):
            self.values = values
            self.conf = self

        def get(self, key, default=None):
            return self.values.get(key, default)

    assert checkpoint_root(Session(**{CHECKPOINT_CONF: "hdfs:///shared", "spark.master": "yarn"})) == "hdfs:///shared"
    with pytest.raises(ValueError, match="every executor can reach"):
        checkpoint_root(Session(**{"spark.master": "yarn"}))


ODD_TEXTS = ["", " lead and trail ", "a<b & c>d \"q\"", "line\nbreak\ttab", "\x01\x1f", "_x0041_ stays", "_x", "ünï 中 \U0001f600", "\r\n", None]


def odd_table(spark):
    rows = [
        (i, t, [1.5, -0.1, 1e300, float("nan"), float("inf"), None][i % 6], 2**62 + i, i % 2 == 0, date(2024, 2, 1 + i), datetime(2024, 2, 3, 4, 5, i, 250000), Decimal(f"{i}.25"))
        for i, t in enumerate(ODD_TEXTS)
    ]
    schema = "k int, t string, v double, big long, flag boolean, day date, moment timestamp_ntz, price decimal(9,2)"
    return spark.createDataFrame([*rows, (None,) * 8], schema)


def plain_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("reader", [read_excel, read_excel_sheets])
def test_excel_round_trip(spark, tmp_path, reader):
    df = odd_table(spark)
    write_excel(df.repartition(4), str(tmp_path / "t"))
    files = sorted(f.name for f in (tmp_path / "t").iterdir())
    assert files and all(f.startswith("part-") and f.endswith(".xlsx") for f in files)
    assert plain_rows(reader(spark, str(tmp_path / "t"), df.schema)) == plain_rows(df)


def test_excel_modes(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "id long"
    write_excel(spark.range(5), path)
    with pytest.raises(FileExistsError):
        write_excel(spark.range(5), path)
    write_excel(spark.range(5, 7), path, mode="append")
    assert sorted(r.id for r in read_excel_sheets(spark, path, kind).collect()) == list(range(7))
    write_excel(spark.range(3), path, mode="overwrite")
    assert sorted(r.id for r in read_excel_sheets(spark, path, kind).collect()) == [0, 1, 2]
    write_excel(spark.range(0), str(tmp_path / "none"))
    assert read_excel_sheets(spark, str(tmp_path / "none"), kind).count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        write_excel(spark.range(1), path, mode="replace")


def test_excel_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(100, numPartitions=4).selectExpr("id", "CASE WHEN id = 99 THEN raise_error('bad') ELSE 'x' END AS t")
    with pytest.raises(Exception, match="bad"):
        write_excel(bad, str(tmp_path / "t"))
    assert [f.name for f in (tmp_path / "t").iterdir() if not f.name.startswith(".")] == []
    with pytest.raises(Exception, match="nested"):
        write_excel(spark.range(1).selectExpr("array(id) AS a"), str(tmp_path / "u"))


def test_excel_sheets_are_partitions(spark, tmp_path):
    lines = [("name", "age"), ("Alice", 30)]
    workbook(tmp_path / "a.xlsx", {"first": lines, "second": [lines[0], ("Dora", 41)]})
    workbook(tmp_path / "b.xlsx", {"first": [lines[0], ("Eve", 22), ("Finn", 5)]})
    df = read_excel_sheets(spark, str(tmp_path), "age int, name string")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == [(5, "Finn"), (22, "Eve"), (30, "Alice"), (41, "Dora")]
    assert read_excel_sheets(spark, str(tmp_path), "name string", sheet=None).count() == 3
    loaded = spark.read.format("workbooks").load(str(tmp_path))
    assert loaded.columns == ["name", "age"] and loaded.count() == 3
    with pytest.raises(Exception, match="need a string type"):
        spark.read.format("workbooks").schema("age int").load(str(tmp_path)).collect()


def test_workbook_goes_on_in_a_next_sheet(tmp_path):
    with open(tmp_path / "a.xlsx", "wb") as file:
        sheets.write(file, ["n"], ([i] for i in range(7)), sheet_rows=4)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as book:
        names = sheets.sheet_names(book)
    content = (tmp_path / "a.xlsx").read_bytes()
    found = [[r[0] for b in sheets.batches(content, n, 0, 0, ["n"], "a") for r in b] for n in names]
    assert found == [["0", "1", "2"], ["3", "4", "5"], ["6"]]
