import json

from pyspark.sql import functions as F

from tickloom.sources import bars as source
from tickloom.sources import feed
from tickloom.streaming.bars import append_bars

HOUR = 3_600_000


def page(folder, symbol, start, n, name=None):
    rows = [[(start + k) * HOUR, "1.5", "2", "1", str(k), "10", 0, "0", 5, "0", "0", None] for k in range(n)]
    folder.mkdir(exist_ok=True)
    (folder / (name or f"{symbol}_1h_{start * HOUR}_{(start + n - 1) * HOUR}.json")).write_text(json.dumps(rows))


def test_pages_become_bars(spark, tmp_path):
    spark.dataSource.register(feed.PageFeed)
    page(tmp_path / "p", "BTCUSDT", 0, 4)
    page(tmp_path / "p", "ETHUSDT", 2, 3)
    (tmp_path / "p" / "other.json").write_text("no page")
    rows = spark.read.format("pages").load(f"{tmp_path}/p")
    assert rows.count() == 7 and rows.schema.simpleString().startswith("struct<symbol:string,interval:string,open_time:bigint")
    made = source.project_feed(rows, F.col("symbol"), F.col("interval")).where("symbol = 'ETHUSDT'").orderBy("timestamp").collect()
    assert [(r.open, r.close) for r in made] == [(1.5, 0.0), (1.5, 1.0), (1.5, 2.0)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("pages").load(f"{tmp_path}/none").count() == 0


def test_a_restarted_stream_reads_no_page_twice(spark, tmp_path):
    spark.dataSource.register(feed.PageFeed)
    folder = tmp_path / "p"
    page(folder, "BTCUSDT", 0, 3)
    page(folder, "ETHUSDT", 5, 2)
    run = lambda: append_bars(spark.readStream.format("pages").load(f"file://{folder}"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(200)
    run()
    for name in list(folder.iterdir()):
        name.write_text("a page that must not be opened again")
    page(folder, "BTCUSDT", 3, 2)
    page(folder, "ETHUSDT", 7, 1)
    page(folder, "SOLUSDT", 0, 2)
    run()
    run()
    got = sorted((r.symbol, r.open_time // HOUR) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("BTCUSDT", k) for k in range(5)] + [("ETHUSDT", k) for k in (5, 6, 7)] + [("SOLUSDT", 0), ("SOLUSDT", 1)]
