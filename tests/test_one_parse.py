"""A batch for many tables is parsed once, and each record ends where it did."""

from tidelake import Lake
from tidelake.operators import ingest
from tidelake.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_a_batch_parses_each_image_once(spark, tmp_path, monkeypatch):
    parses, parse = [], ingest._parse
    monkeypatch.setattr(ingest, "_parse", lambda *a: parses.append(1) or parse(*a))
    lake = Lake(spark, str(tmp_path / "lake"), [fx.ACCOUNT], [fx.ACCOUNT_KINDS])
    bad = str(tmp_path / "bad")
    lake.apply(fx.faulty_changes(spark, SF), fx.NOW, bad, batch=0)
    assert len(parses) == 1
    kinds = {r.event_type: r["count"] for r in fx.table(spark, SF, "events").groupBy("event_type").count().collect()}
    assert lake.table("account").scan().count() == kinds["view"]
    wrong = spark.read.parquet(f"{bad}/account").groupBy("_cast_errors").count().collect()
    assert {tuple(r._cast_errors): r["count"] for r in wrong} == {
        ("eventId",): kinds["click"], ("kind",): kinds["purchase"]
    }
    unknown = spark.read.parquet(f"{bad}/_unknown")
    assert unknown.count() == kinds["signup"] + kinds["error"]
    assert unknown.filter("image is null or op is null").count() == 0
