import csv
import io
import json
import random

import pytest
from test_forms import ROWS, workbook

from quillfold.plans import headers, layout, records
from quillfold.sources import sheet_source as S
from quillfold.sources import sheets

ALPHABET = ['"', '""', ",", "\n", "\r", "\r\n", "a", "é", " ", 'x"y', '",', ',"', '"\n']


def ragged(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(ALPHABET) for _ in range(n))


def ranges(path, size):
    begin, end = S.after_mark(path), S.files(path)[0][1]
    return S.chained([(path, a, min(a + size, end), *S.outcomes(S.blocks_of(path, a, min(a + size, end)))) for a in range(begin, end, size)])


def test_any_ranges_give_the_rows_of_the_whole_file(tmp_path):
    path = str(tmp_path / "x.csv")
    for seed in range(150):
        text = ragged(seed, 60)
        data = (b"\xef\xbb\xbf" if seed % 3 == 0 else b"") + text.encode()
        with open(path, "wb") as f:
            f.write(data)
        want = list(enumerate(csv.reader(io.StringIO(text, newline="")), 1))
        for size in (1, 2, 3, 7, 20, 1000):
            got = [(n, cells) for part in ranges(path, size) for _, n, cells in S.csv_rows(part)]
            assert got == want, (seed, size, text)


def test_states_do_not_depend_on_blocks():
    for seed in range(60):
        data = ragged(seed, 50).encode()
        whole = S.outcomes([data])
        assert whole == S.outcomes([data[i : i + 3] for i in range(0, len(data), 3)])


def test_many_tasks_read_one_file(spark, tmp_path):
    rows = [[str(i), f'line "{i}"\nnext, {i}\r\n' * (i % 5), "é" * (i % 3)] for i in range(3000)] + [["one cell"], []]
    path = tmp_path / "big.csv"
    text = io.StringIO()
    csv.writer(text).writerows(rows)
    path.write_bytes(b"\xef\xbb\xbf" + text.getvalue().encode())
    df = S.read(spark, str(path), range_bytes=10_000)
    assert df.rdd.getNumPartitions() == -(-(path.stat().st_size - 3) // 10_000) > 10
    got = sorted(df.select("row", "cells").collect())
    want = list(csv.reader(io.StringIO(text.getvalue(), newline="")))
    assert [r["row"] for r in got] == list(range(1, len(want) + 1))
    assert [r["cells"] for r in got] == want
    few = S.read(spark, str(path), "row int, C string, AB string", range_bytes=10_000).filter("row = 3001 or row = 3").orderBy("row").collect()
    assert [tuple(r) for r in few] == [(3, "éé", None), (3001, None, None)]


def test_workbooks_and_kinds(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    one = S.read(spark, str(tmp_path)).select("sheet", "row", "cells").orderBy("row").collect()
    assert [tuple(r) for r in one] == [("One", 1, ["shared", None, "inline"]), ("One", 2, [None, "TRUE", None, "45000.5"])]
    assert S.read(spark, str(tmp_path), sheet="Two").count() == 0 and S.read(spark, str(tmp_path), sheet="*").count() == 2
    (tmp_path / "c.csv").write_text("a,b\n1")
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "empty.csv").write_text("")
    assert S.read(spark, str(tmp_path)).groupBy().count().first()[0] == 4
    with pytest.raises(Exception, match="not a column of a sheet"):
        S.read(spark, str(tmp_path), "row int, colour string").count()
    (tmp_path / "d.txt").write_text("x")
    with pytest.raises(ValueError, match="not a sheet"):
        S.read(spark, str(tmp_path))


def moved(tmp_path):
    """The forms of test_forms with their columns in another order, and the mapping that says so."""
    order = list(range(len(layout.LAYOUT)))
    random.Random(5).shuffle(order)
    path = tmp_path / "moved.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        for row in [[f.name for f in layout.LAYOUT], *ROWS]:
            w.writerow([(row[k] or "") if k < len(row) else "" for k in order])
    names = {v: k for k, v in headers.SECTIONS.items()}
    body: dict = {}
    for f in layout.LAYOUT:
        entry = {"field": f.name, "column": sheets.column_letters(order.index(sheets.column_index(f.column)))}
        into = body.setdefault(names.get(f.section, f.section), [])
        if f.index:
            if len(into) < f.index:
                into.append({"index": f.index, "columns": []})
            into = into[f.index - 1]["columns"]
        into.append(entry)
    (tmp_path / "mapping.json").write_text(json.dumps(body))
    return str(path), body


def test_the_mapping_names_columns(spark, tmp_path):
    path, _ = moved(tmp_path)
    df = S.read(spark, path, mapping=str(tmp_path / "mapping.json"))
    assert {"scalars_wifi_available", "address_groups_2_postcode", "opening_hours_groups_1_type"} < set(df.columns)
    header = df.filter("row = 1").first()
    assert header["scalars_wifi_available"] == "wifi_available" and header["address_groups_2_postcode"] == "postcode"


def test_records_of_a_moved_sheet(spark, tmp_path):
    path, body = moved(tmp_path)
    (tmp_path / "straight.csv").write_text("")
    with open(tmp_path / "straight.csv", "w", newline="") as f:
        csv.writer(f).writerows([[x.name for x in layout.LAYOUT], *ROWS])
    want = records.clean_cells(S.read(spark, str(tmp_path / "straight.csv"), "row int, cells array<string>")).orderBy("source_row_number").collect()
    got = records.clean_cells(headers.arranged(S.read(spark, path, "row int, cells array<string>"), body)).orderBy("source_row_number").collect()
    raw = [c for c in want[0].asDict() if not c.startswith("raw_")]
    assert [[r[c] for c in raw] for r in got] == [[r[c] for c in raw] for r in want]
