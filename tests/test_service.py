import json
import threading
import time
import urllib.request

import pytest

from lakeweave import Engine, QueryError
from lakeweave.engine import serve
from lakeweave.sources import midi, prompt, sheet
from lakeweave.streaming import series, windows


def test_explain_nodes(spark):
    out = Engine(spark).explain("with d as (select i from generate_series(5)) select i, sum(i) over (order by i) as s from d order by i")
    assert [n["name"] for n in out["nodes"]] == ["Generator", "Projection", "Scope", "Projection", "Sort"]
    assert out["edges"] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_stream(spark):
    engine = Engine(spark)
    events = list(engine.stream(engine.submit("select i from generate_series(250)")["query_id"]))
    assert [e["event"] for e in events if e["event"] != "OperatorStats"] == ["QueryStart", "ResultSchema", "ResultRows", "ResultRows", "ResultRows", "QueryStats", "QueryComplete"]
    assert sum(len(e["rows"]) for e in events if e["event"] == "ResultRows") == 250
    made = list(engine.stream(engine.submit("create table streamed as (select i from generate_series(7))")["query_id"]))
    assert made[1]["status"].startswith("CREATE 7 in ")
    failed = list(engine.stream(engine.submit("select 1 / i as x from generate_series(1)")["query_id"]))
    assert failed[-1]["event"] == "QueryError"
    with pytest.raises(QueryError):
        next(engine.stream("unknown"))


def test_terminate(spark):
    from pyspark.sql import functions as F

    engine = Engine(spark)
    slow = F.udf(lambda i: time.sleep(0.5) or i, "long")
    engine.catalog.add("slow", spark.range(160).select(slow("id").alias("i")))
    query_id = engine.submit("select sum(i) as s from slow")["query_id"]
    threading.Timer(4, lambda: engine.terminate(query_id)).start()
    began = time.time()
    assert [e["event"] for e in engine.stream(query_id)][-1] == "QueryError"
    assert time.time() - began < 15


def test_http(spark):
    thread = serve(Engine(spark), 0)
    url = f"http://127.0.0.1:{thread.server.server_address[1]}"

    def post(path, **body):
        return json.load(urllib.request.urlopen(urllib.request.Request(url + path, json.dumps(body).encode())))

    assert json.load(urllib.request.urlopen(url + "/healthcheck")) == {"ok": True}
    query_id = post("/query", sql="select 1 as a")["query_id"]
    body = urllib.request.urlopen(f"{url}/stream?query_id={query_id}").read().decode()
    assert "event: ResultRows" in body and "[[1]]" in body
    assert post("/explain", sql="select 1 as a")["nodes"][0]["name"] == "Row Generator"
    assert post("/terminate", query_id="none") == {"ok": True}
    for path, sent, code in (("/query", b"{}", 400), ("/query", b"[", 400), ("/query", b'{"sql": "select"}', 400), ("/terminate", b"[]", 400), ("/none", b"{}", 404), ("/stream?query_id=none", None, 400), ("/stream", None, 400)):
        with pytest.raises(urllib.error.HTTPError) as raised:
            urllib.request.urlopen(urllib.request.Request(url + path, sent))
        assert raised.value.code == code and "error" in json.loads(raised.value.read())
    thread.server.shutdown()


def test_sheet(spark, tmp_path, monkeypatch):
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "Notes.csv").write_text("note,frequency\nA,440\nB\n")
    monkeypatch.setenv("LAKEWEAVE_SHEETS", str(tmp_path))
    sheet.set_fetcher(sheet.from_folder)
    want = [{"note": "A", "f": 440.0}, {"note": "B", "f": None}]
    for tab in (", 'Notes'", ""):
        assert Engine(spark).run(f"select note, frequency::float as f from google_sheet('book'{tab}) order by note") == want
    with pytest.raises(QueryError):
        Engine(spark).run("select * from google_sheet('book', 'None')")


def test_prompt(spark):
    prompt.set_client(None)
    with pytest.raises(QueryError, match="client"):
        Engine(spark).run("select * from ask_gpt('x')")
    prompt.set_client(lambda p: f"a, b\n 1,{p}\n")
    assert Engine(spark).run("select * from ask_gpt('hi')") == [{"a": "1", "b": "hi"}]
    prompt.set_client(None)


def test_midi_rows():
    track = bytes.fromhex("00ff510307a120" "00903c40" "60803c00" "00ff2f00")
    data = b"MThd" + (6).to_bytes(4, "big") + bytes([0, 0, 0, 1, 0, 96]) + b"MTrk" + len(track).to_bytes(4, "big") + track
    assert list(midi.notes(data)) == [(0.0, "C", 5, 523.25, 0.5, 0.5, 0)]
    with pytest.raises(ValueError):
        list(midi.notes(b"RIFF" + data[4:]))


def test_paced_series_streams(spark):
    query = series.paced_series(spark, 5, 0.01).writeStream.format("memory").queryName("paced").start()
    deadline = time.time() + 60
    while time.time() < deadline and spark.table("paced").count() < 5:
        time.sleep(0.5)
    query.stop()
    assert sorted(r.i for r in spark.table("paced").collect()) == [0, 1, 2, 3, 4]


def test_windows_on_a_stream(spark, tmp_path):
    rows = "select id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int) * 10) as ts, 'k' as k from range(12)"
    spark.sql(rows).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted((r.start.minute, r.n) for r in windows.tumbling(batch, "ts", "1 hour", ["k"]).collect()) == [(0, 6), (0, 6)]
    assert windows.sessions(batch, "ts", "5 minutes", ["k"]).count() == 12
    assert windows.sliding(batch, "ts", "1 hour", "30 minutes", ["k"]).count() == 5
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream, "ts", "1 hour", ["k"], "10 minutes").writeStream.format("memory").outputMode("complete").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("hours").collect()) == [6, 6]


def test_registered_functions(spark):
    """Scalar, aggregate, window and table functions of one's own."""
    from pyspark.sql import functions as F

    from lakeweave import functions
    from lakeweave.functions.typed import Typed

    functions.register_scalar("TWICE", 1, lambda a: Typed(a[0].col * 2, a[0].kind))
    functions.register_aggregate("SPREAD", lambda x, distinct, delimiter, order: Typed(F.max(x.col) - F.min(x.col), x.kind))
    functions.register_window("LAST", lambda a: Typed(F.last(a[0].col), a[0].kind))
    functions.register_table("EVENS", (1,), lambda spark, n: spark.range(0, 2 * n, 2).toDF("i"))
    engine = Engine(spark)
    assert engine.run("select twice(spread(i)) as x from evens(4)") == [{"x": 12}]
    assert [r["x"] for r in engine.run("select i, last(i) over (order by i rows between current row and unbounded following) as x from evens(3) order by i")] == [4, 4, 4]


def test_replaced_table_stays_if_the_swap_fails(spark, monkeypatch):
    engine = Engine(spark)
    engine.run("create table swapped as (select i from generate_series(3))")
    plain = type(spark).sql

    def fails(self, text, *a, **k):
        if text.startswith("alter table") and text.endswith("rename to `swapped`") and not fails.done:
            fails.done = True
            raise RuntimeError("lost")
        return plain(self, text, *a, **k)

    fails.done = False
    monkeypatch.setattr(type(spark), "sql", fails)
    with pytest.raises(RuntimeError):
        engine.run("create table swapped as (select i from generate_series(9))")
    monkeypatch.undo()
    assert len(Engine(spark).run("select * from swapped")) == 3
