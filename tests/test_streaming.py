import datetime as dt

from quillon.schemas import conform
from quillon.sources.warehouse import Warehouse
from quillon.streaming import ingest


def test_upserts_from_a_stream(spark, tmp_path):
    inbox, w = str(tmp_path / "in"), Warehouse(spark, str(tmp_path / "wh"))
    (tmp_path / "wh").mkdir()

    def arrive(*rows):
        conform(spark.createDataFrame(list(rows), "author_id string, canonical_name string, observed_at timestamp_ntz"), "authors").write.mode("append").parquet(inbox)

    def run():
        ingest.upsert_stream(ingest.read_table(spark, inbox, "authors"), w, "authors", str(tmp_path / "cp")).awaitTermination()
        return {(r.author_id, r.canonical_name) for r in w.table("authors").collect()}

    day = lambda n: dt.datetime(2026, 1, n)
    arrive(("a", "old", day(1)), ("a", "new", day(2)), ("b", "one", day(1)))
    assert run() == {("a", "new"), ("b", "one")}
    arrive(("b", "two", day(3)))
    assert run() == {("a", "new"), ("b", "two")}
    assert run() == {("a", "new"), ("b", "two")}


def test_windows_and_sessions(spark):
    t = lambda h, m: dt.datetime(2026, 1, 1, h, m)
    e = spark.createDataFrame([(1, "view", 1.0, t(9, 0)), (1, "view", 2.0, t(9, 20)), (1, "click", 3.0, t(11, 0)), (2, "view", 4.0, t(9, 59))], "user_id int, event_type string, value double, ts timestamp")
    assert sorted((r.start.hour, r.event_type, r.n, r.value) for r in ingest.event_counts(e).collect()) == [(9, "view", 3, 7.0), (11, "click", 1, 3.0)]
    assert sorted((r.user_id, r.n) for r in ingest.sessions(e).collect()) == [(1, 1), (1, 2), (2, 1)]
