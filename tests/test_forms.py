import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillfold.operators import issues as I
from quillfold.plans import actions, layout, records
from quillfold.sources import archive, config, sheets


def test_letters():
    assert [sheets.column_letters(i) for i in (0, 25, 26, 203)] == ["A", "Z", "AA", "GV"]
    assert all(sheets.column_index(sheets.column_letters(i)) == i for i in range(800))


def test_layout_is_the_wide_sheet():
    assert len(layout.LAYOUT) == 204 and layout.LAYOUT[-1].column == "GV"
    firsts = {s: next(f.column for f in layout.LAYOUT if f.section == s) for s in ("metadata", "scalar", "address", "counter_service", "interview_rooms", "contact", "opening_hours")}
    assert firsts == {"metadata": "A", "scalar": "G", "address": "AA", "counter_service": "BS", "interview_rooms": "CU", "contact": "CX", "opening_hours": "EU"}
    assert layout.column_of("opening_hours", "type", 2) == "FW"


def wide(**answers):
    row = [""] * 204
    for k, v in answers.items():
        section, _, rest = k.partition("__")
        name, _, index = rest.partition("__")
        row[sheets.column_index(layout.column_of(section, name, int(index or 0)))] = v
    return row


ROWS = [
    wide(scalar__court_slug_raw="https://x.gov.uk/courts/Bristol", metadata__completion_time="2024-01-01T10:00:00", scalar__lift_available="Yes", scalar__lift_door_width="800 mm", scalar__food_and_drink="Cafeteria;Snack vending machines", scalar__wifi_available="yes",
         address__line_1__1="1 High St", address__town_or_city__1="Bristol", address__postcode__1="bs1 1aa", address__address_type__1="visit us", address__line_1__3="3 Low Rd", address__postcode__3="nope",
         contact__phone__1="a@b.com", contact__description__1="Enquiries", counter_service__opening_hour="9", counter_service__opening_minute="00", counter_service__closing_hour="17", counter_service__closing_minute="00", opening_hours__type__1="Court open", opening_hours__monday_opening_hour__1="10:00", opening_hours__monday_closing_hour__1="16", opening_hours__monday_closing_minute__1="30"),
    wide(metadata__forms_id="2"),
    wide(scalar__court_slug_raw="bristol", metadata__completion_time="2024-02-01T10:00:00", scalar__wifi_available="perhaps"),
    wide(scalar__court_slug_raw="!!!", scalar__wifi_available="no"),
    wide(scalar__wifi_available="no", interview_rooms__has_interview_rooms="yes", interview_rooms__room_count="two rooms"),
    wide(scalar__court_slug_raw="leeds", scalar__translation_phone="020 7946 0958", counter_service__opening_hour="00", counter_service__opening_minute="00", counter_service__closing_hour="00", counter_service__closing_minute="00"),
]


@pytest.fixture(scope="module")
def sheet(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("forms") / "forms.csv"
    text = io.StringIO()
    w = csv.writer(text)
    w.writerow([f.name for f in layout.LAYOUT])
    for r in ROWS:
        w.writerow(r)
    path.write_bytes(b"\xef\xbb\xbf" + text.getvalue().encode())
    return sheets.read_sheet(spark, str(path))


@pytest.fixture(scope="module")
def built(sheet):
    df = records.build_records(sheet).cache()
    return df, {r["source_row_number"]: r for r in df.collect()}


def test_records(built):
    _, got = built
    assert sorted(got) == [2, 4, 5, 6, 7]
    a = got[2]
    assert a["court_slug"] == "bristol" and a["facilities"]["wifi_available"] is True and a["facilities"]["food_and_drink"] == ["Cafeteria", "Snack vending machines"]
    assert [(x["index"], x["postcode"]) for x in a["addresses"]] == [(1, "BS1 1AA"), (3, "NOPE")]
    assert a["contacts"][0]["email"] == "a@b.com" and a["contacts"][0]["phone"] is None
    assert tuple(a["counter_service"]["monday_to_friday"]) == ("09:00", "17:00", "valid_time")
    assert tuple(a["opening_hours"][0]["monday"]) == ("10:00", "16:30", "valid_time")
    assert {i["code"] for i in a["issues"]} == {"INVALID_POSTCODE", "INVALID_PHONE", "COURT_SLUG_NORMALISED"} and a["status"] == "needs_human_review"
    assert next(i["field"] for i in a["issues"] if i["code"] == "INVALID_POSTCODE") == "addresses[3].postcode"
    assert got[5]["status"] == got[6]["status"] == "failed" and got[7]["counter_service"]["monday_to_friday"] is None


def test_selection_and_plan(spark, built):
    df, _ = built
    courts = spark.createDataFrame([("id-1", "bristol", "Bristol")], "id string, slug string, name string")
    chosen = records.check_existence(records.select_authoritative(df), courts).cache()
    got = {r["source_row_number"]: r for r in chosen.collect()}
    assert got[2]["status"] == "skipped" and got[2]["superseded_by"] == 4 and got[4]["selection_status"] == "authoritative"
    assert any(i["code"] == "COURT_SLUG_NOT_FOUND" for i in got[7]["issues"]) and got[7]["status"] == "needs_human_review"
    s = records.summary(chosen).first()
    assert s["records"] == 5 and s["skipped"] == 1 and s["failed"] == 2
    only_first = records.check_existence(df.filter("source_row_number = 2"), courts)
    plan = actions.plan(only_first).cache()
    rows = plan.orderBy("action_id").collect()
    assert [r["resource"] for r in rows] == ["building_facilities", "accessibility_options", "counter_service_opening_hours", "address", "address", "contact_detail", "court_opening_hours"]
    assert [r["action_id"] for r in rows] == [f"bristol-{k:03d}" for k in range(1, 8)]
    body = json.loads(rows[1]["body"])
    assert body["liftDoorWidth"] == 80 and body["liftDoorLimit"] == 1 and rows[1]["readiness"] == "pending" and "accessibleParking is required" in rows[1]["reason"]
    assert json.loads(rows[2]["body"])["openingTimesDetails"] == [{"dayOfWeek": "EVERYDAY", "openingTime": "09:00", "closingTime": "17:00"}]
    assert rows[3]["readiness"] == "ready" and rows[4]["readiness"] == "pending"
    folded = {r["resource"]: r for r in actions.fold_collections(plan).collect()}
    assert len(folded["address"]["bodies"]) == 2 and folded["address"]["readiness"] == "pending" and folded["address"]["action_id"] == "bristol-004"
    assert actions.record_readiness(plan).first()["readiness"] == "partially_ready"
    assert I.report(df, "source_row_number").count() == sum(len(r["issues"]) for r in df.collect())


def test_cleaning_is_spread_and_written_once_a_kind(sheet):
    """However few tasks read the sheet, many clean it; a cleaner stands in the plan once and not once a field."""
    cells = records.clean_cells(sheet.coalesce(1))
    assert cells.rdd.getNumPartitions() >= sheet.sparkSession.sparkContext.defaultParallelism
    plan = records.clean_cells(sheet)._jdf.queryExecution().analyzed().treeString()
    assert [plan.count(code) for code in ("INVALID_PHONE", "INVALID_EMAIL", "UNKNOWN_BOOLEAN", "TIME_FORMAT_RECOVERED")] == [1, 1, 1, 1]


def test_a_key_with_several_ids_multiplies_no_record(spark, built):
    df, rows = built
    courts = spark.createDataFrame([("id-2", "bristol"), ("id-1", "bristol"), ("id-3", "leeds")], "id string, slug string")
    got = {r["source_row_number"]: r["court_id"] for r in records.check_existence(df, courts).collect()}
    assert got == {2: "id-1", 4: "id-1", 5: None, 6: None, 7: "id-3"} and records.check_existence(df, courts).count() == len(rows)


def workbook(path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = '<row r="9"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t><t>line</t></is></c></row><row r="2"><c r="B2" t="b"><v>1</v></c><c r="D2"><v>45000.5</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><r><t>sha</t></r><r><t>red</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{ns}"><dimension ref="A1:A1"/><sheetData>{cells}</sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{ns}"><sheetData/></worksheet>')


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    rows = sheets.read_sheet(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()
    assert [(r["sheet"], r["row"], r["cells"]) for r in rows] == [("One", 1, ["shared", None, "inline"]), ("One", 2, [None, "TRUE", None, "45000.5"])]
    assert sheets.read_sheet(spark, str(tmp_path / "b.xlsx"), "Two").count() == 0


def test_vocabularies(spark, tmp_path):
    p = tmp_path / "v.json"
    p.write_text(json.dumps({"vocabularies": {"t": [{"code": "a", "name": "A", "aliases": ["x"]}]}}))
    v = config.vocabularies(spark, str(p))
    assert v.first()["aliases"] == ["x"]
    other = spark.createDataFrame([("t", 0, "z", "Z", "1", [])], config.VOCABULARY)
    assert [r["code"] for r in config.over_fallback(v, other).collect()] == ["z"]
    p.write_text(json.dumps({"t": [{"code": " ", "name": "A"}]}))
    with pytest.raises(ValueError):
        config.vocabularies(spark, str(p))


def test_archive_is_immutable(spark, tmp_path):
    df = spark.range(3)
    files = archive.publish({"t": df}, str(tmp_path), "r1").collect()
    assert files and all(len(f["sha256"]) == 64 and f["bytes"] > 0 for f in files)
    assert all(f["path"].startswith("t/") for f in files)
    with pytest.raises(FileExistsError):
        archive.publish({"t": df}, str(tmp_path), "r1")
    archive.publish({"t": df}, str(tmp_path), "r2", "sheet")
    assert spark.read.json(f"{tmp_path}/_latest").first()["run_id"] == "r2" and spark.read.parquet(f"{tmp_path}/run_id=r1/t").count() == 3
    assert not list((tmp_path / "_staging").glob("run_id*"))


def test_shards(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "base")], "k string, saved_at int, state string")
    shards = spark.createDataFrame([("a", 1, "shard"), ("b", 4, "late"), ("c", 1, "new")], "k string, saved_at int, state string")
    assert {r["k"]: r["state"] for r in config.state_with_shards(base, shards, ["k"]).collect()} == {"a": "shard", "b": "base", "c": "new"}


def test_tolerant_state(spark, tmp_path):
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "b.json").write_text('{"x": 1}')
    assert config.tolerant_json(spark, [str(tmp_path / "none.json"), str(tmp_path / "a.json"), str(tmp_path / "b.json")], "x int").first()["x"] == 1


def test_payload(built):
    df, _ = built
    out = archive.payload(df.withColumn("status", F.lit("processed")), ["court_slug", "addresses"]).collect()
    assert {r["source_row_number"] for r in out} == {2, 4, 7}
