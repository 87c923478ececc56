import json
import zipfile

from pyspark.sql import functions as F

from tickloom.sources import results

ROW = "file_name string, symbol string, interval string, mcc double, params map<string,double>"


def test_json_and_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.pine", "X", "1d", 0.5, {"n": 3.0}), ("b.pine", "X", "1d", None, {}), ("a.pine", "Y", "4h", 0.25, None), (None, "Y", "4h", 1.0, {})], ROW)
    plain = rows.withColumn("params", F.to_json("params"))
    results.write_json(plain, f"{tmp_path}/json", ["symbol"], F.lit("run-1"))
    got = results.read_json(spark, f"{tmp_path}/json", ROW.replace("map<string,double>", "string"))
    assert sorted((r.run, r.file_name, r.symbol, r.mcc) for r in got.where("mcc IS NOT NULL").collect()) == [("run-1", "a.pine", "X", 0.5), ("run-1", "a.pine", "Y", 0.25)]
    assert got.count() == 3  # the row without a file name is left out
    results.write_csv(rows, f"{tmp_path}/csv")
    table = spark.read.csv(f"{tmp_path}/csv", header=True)
    assert table.count() == 4 and json.loads(table.where("symbol = 'X' AND mcc = 0.5").first()["params"]) == {"n": 3.0}


def test_a_document_over_several_lines_and_broken_ones(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"run": "r", "matrix": [{"file_name": "a", "symbol": "X", "interval": "1d", "mcc": 1.0}]}, indent=2))
    (tmp_path / "in" / "b.json").write_text("{broken")
    (tmp_path / "in" / "c.json").write_text("{}")
    assert [tuple(r) for r in results.read_json(spark, f"{tmp_path}/in", ROW.rsplit(",", 2)[0], one_a_file=True).collect()] == [("r", "a", "X", "1d", 1.0)]


def test_reports_without_parts(spark):
    made = spark.createDataFrame([(1, None), (2, ""), (3, "PERFORMANCE COMPARISON\nMCC (primary)  0.1  x  +\nMax Drawdown  5%  1,004%  -\nOther  1  2  3"), (4, "Optimization config:\n\na: b")], "k int, body string")
    assert [tuple(r) for r in results.comparison(made, "body", ["k"]).collect()] == [(3, "mcc", 0.1, None), (3, "max_drawdown", 5.0, 1004.0)]
    assert results.settings(made, "body", ["k"]).count() == 0


def test_archives_and_folders_give_equal_rows(spark, tmp_path):
    schema = ROW.rsplit(",", 2)[0]
    (tmp_path / "in").mkdir()
    (tmp_path / "zips").mkdir()
    texts = {f"{k}.json": json.dumps({"run": f"r{k}", "matrix": [{"file_name": f"f{j}", "symbol": "X", "interval": "1d", "mcc": j / 8} for j in range(k)]}) for k in range(5)} | {"bad.json": "{broken", "note.txt": "{}"}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    for part, names in enumerate((list(texts)[:3], list(texts)[3:])):
        with zipfile.ZipFile(tmp_path / "zips" / f"{part}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            for name in names:
                archive.writestr(f"some/folder/{name}", texts[name])
    (tmp_path / "zips" / "broken.zip").write_bytes(b"no archive")
    got = sorted(map(tuple, results.read_zip(spark, f"{tmp_path}/zips", schema).collect()))
    assert got and got == sorted(map(tuple, results.read_json(spark, f"{tmp_path}/in/*.json", schema, one_a_file=True).collect()))
    assert sorted(map(tuple, results.read_zip(spark, f"{tmp_path}/zips/1.zip", schema).collect())) == [r for r in got if r[0] in ("r3", "r4")]
