"""Venue parsers, book maintenance, sinks and streams."""

import json
import os

import pytest

from pyspark.sql import functions as F

from forerun.config import HOUR, Config
from forerun.operators import detect, monitor, score
from forerun.schema import LEG, QUOTE
from forerun.sources import feeds, sinks, venues
from forerun.streaming import live, watch


def messages(spark, rows):
    return spark.createDataFrame([(i, i, json.dumps(m)) for i, m in enumerate(rows, 1)], "seq long, recv_us long, json string")


def test_okx(spark):
    arg = {"channel": "bbo-tbt", "instId": "BTC-USDT"}
    df = messages(spark, [{"arg": arg, "data": [{"bids": [["100", "1", "0", "1"]], "asks": [["101", "2", "0", "1"]], "ts": "1700000000123"}]}, {"arg": arg, "data": [{"bids": [["100", "1", "0", "1"]], "asks": [["101", "2", "0", "1"]]}]}, {"arg": arg, "data": [{"bids": [], "asks": [["1", "1", "0", "0"]], "ts": "1"}]}])
    q = venues.okx_quotes(df).orderBy("recv_us").collect()
    assert [(r["exch_us"], r["bid"], r["asksz"]) for r in q] == [(1700000000123000, 100.0, 2.0), (2, 100.0, 2.0)]
    assert venues.changed(venues.okx_quotes(df).withColumn("seq", F.col("recv_us")), ["sym"], "recv_us", "seq", ["bid", "bidsz", "ask", "asksz"]).count() == 1
    trades = messages(spark, [{"arg": {"channel": "trades", "instId": "BTC-USDT"}, "data": [{"instId": "BTC-USDT", "tradeId": "7", "px": "5", "sz": "2", "side": s, "ts": "9"} for s in ("buy", "sell", "odd")]}])
    assert sorted(r["side"] for r in venues.okx_trades(trades).collect()) == ["B", "S"]


def test_coinbase_flips_the_maker(spark):
    rows = [{"type": "match", "product_id": "BTC-USD", "trade_id": 1, "side": s, "size": "1", "price": "10", "time": "2024-01-01T00:00:00.000001Z"} for s in ("buy", "sell")] + [{"type": "match", "product_id": "BTC-USD", "side": "buy"}]
    got = venues.coinbase_trades(messages(spark, rows)).orderBy("recv_us").collect()
    assert [r["side"] for r in got] == ["S", "B"] and got[0]["exch_us"] == 1704067200000001


def test_binance(spark):
    row = {"e": "trade", "E": 5, "s": "BTCUSDT", "t": 3, "p": "10", "q": "2", "T": 4, "m": True}
    r = venues.binance_trades(messages(spark, [row])).first()
    assert (r["exch_us"], r["trade_us"], r["side"], r["tid"]) == (5000, 4000, "S", 3)
    depth = {"e": "depthUpdate", "E": 5, "s": "BTCUSDT", "U": 10, "u": 12, "pu": 9, "b": [["1", "2"]], "a": []}
    r = venues.binance_depth(messages(spark, [depth])).first()
    assert (r["first_u"], r["last_u"], r["prev_u"], r["bids"]) == (10, 12, 9, [["1", "2"]])
    ticker = {"u": 1, "s": "BTCUSDT", "b": "1", "B": "2", "a": "3", "A": "4"}
    r = venues.binance_quotes(messages(spark, [ticker])).first()
    assert (r["exch_us"], r["bid"], r["bidsz"], r["ask"], r["asksz"]) == (1, 1.0, 2.0, 3.0, 4.0)
    mark = {"e": "markPriceUpdate", "E": 5, "s": "BTCUSDT", "p": "10", "i": "11", "P": "12", "r": "0.1", "T": 7}
    r = venues.binance_marks(messages(spark, [mark])).first()
    assert (r["mark"], r["index"], r["est_settle"], r["funding"], r["next_funding_us"]) == (10.0, 11.0, 12.0, 0.1, 7000)


def test_book_rebuild(spark):
    t = "2024-01-01T00:00:00Z"
    rows = [
        {"type": "l2update", "product_id": "X", "time": t, "changes": [["buy", "1", "1"]]},  # before a snapshot: ignored
        {"type": "snapshot", "product_id": "X", "bids": [["100", "1"], ["99", "2"], ["98", "3"]], "asks": [["101", "1"], ["102", "2"]]},
        {"type": "l2update", "product_id": "X", "time": t, "changes": [["buy", "99", "5"]]},  # inner level: silent
        {"type": "l2update", "product_id": "X", "time": t, "changes": [["buy", "100.5", "1"]]},
        {"type": "l2update", "product_id": "X", "time": t, "changes": [["buy", "100.5", "0"]]},
        {"type": "l2update", "product_id": "X", "time": t, "changes": [["sell", "101", "4"]]},
        {"type": "snapshot", "product_id": "X", "bids": [["50", "1"]], "asks": []},  # one-sided: none
        {"type": "l2update", "product_id": "X", "time": t, "changes": [["sell", "51", "1"]]},
    ]
    got = venues.best_quotes(venues.coinbase_levels(messages(spark, rows))).orderBy("recv_us").collect()
    assert [(r["recv_us"], r["bid"], r["ask"], r["asksz"]) for r in got] == [(2, 100.0, 101.0, 1.0), (4, 100.5, 101.0, 1.0), (5, 100.0, 101.0, 1.0), (6, 100.0, 101.0, 4.0), (8, 50.0, 51.0, 1.0)]


def quotes(spark, n=400):
    rows = []
    for i in range(n):
        mid = 100 * (1 + 0.001 * ((i * 7919) % 13 - 6))
        rows.append((i, 1000 * i, 1000 * i, "BTC", "AB"[i % 2], "SPOT", mid - 0.01, mid + 0.01, mid))
    return spark.createDataFrame(rows, QUOTE)


def files(spark, frame, path, parts, per):
    for k in range(parts):  # a file, and so a micro-batch, each
        frame.where((F.col("seq") >= per * k) & (F.col("seq") < per * (k + 1))).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, frame, path, schema, detector, tmp, name="out"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = detector(stream).writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.exception() is None
    return spark.read.parquet(f"{tmp}/{name}")


@pytest.mark.parametrize("mode", ["tickwise", "cumstale", "winreset"])
def test_stream_equals_batch(spark, tmp_path, mode):
    cfg = Config(mode=mode, move_window=5000, threshold_by_sym={}, threshold_bps=30.0)
    q = quotes(spark)
    files(spark, q, str(tmp_path / "in"), 3, 134)
    cols = [*LEG, "seq", "direction"]
    got = sorted(map(tuple, streamed(spark, q, str(tmp_path / "in"), QUOTE, lambda s: live.stream_moves(s, cfg), tmp_path).select(cols).collect()))
    want = sorted(map(tuple, detect.quote_moves(q, cfg).select(cols).collect()))
    assert got == want and got


def test_trade_streams_equal_batch(spark, tmp_path):
    cfg = Config(move_window=5000, trade_bps=30.0, bar_by_sym={}, bar_default=4.0)
    t = quotes(spark, 240).select("seq", "event_us", "recv_us", *LEG, F.col("mid").alias("px"), ((F.col("seq") * 31) % 11 - 5.0).alias("signed"))
    files(spark, t, str(tmp_path / "in"), 2, 120)
    schema = "seq long, event_us long, recv_us long, sym string, venue string, inst string, px double, signed double"
    bars = streamed(spark, t, str(tmp_path / "in"), schema, lambda s: live.stream_bars(s, cfg), tmp_path, "bars")
    want = {(r["venue"], r["seq"]): "up" if r["dir"] > 0 else "down" for r in detect.imbalance_bars(t, cfg).collect()}
    assert {(r["venue"], r["seq"]): r["direction"] for r in bars.collect()} == want and want
    moved = streamed(spark, t, str(tmp_path / "in"), schema, lambda s: live.stream_trade_moves(s, cfg), tmp_path, "moves")
    assert sorted(r["seq"] for r in moved.collect()) == sorted(r["seq"] for r in detect.trade_moves(t, cfg).collect()) != []


def test_a_leg_goes_on_in_another_mode():
    args = (0.01, 100, "log")
    state = live.LegState()
    for t, v in ((0, 100.0), (10, 100.5), (20, 101.2)):
        state.tickwise(t, v, *args)
    assert (state.base, state.base_at) == (101.2, 20)
    assert state.cumstale(60, 102.5, *args) > 0.01 and state.cumstale(500, 110.0, *args) is None  # the base is too old
    assert state.winreset(510, 110.2, *args) is None and state.winreset(520, 111.5, *args) > 0.01
    assert (state.last, state.base) == (111.5, 111.5)


def test_foreach_batch_scores_with_state_across_batches(spark, tmp_path):
    cfg = Config(threshold_by_sym={}, follow_window=5000, dead_band=0, session_window=HOUR)
    q = quotes(spark, 60)
    files(spark, q, str(tmp_path / "in"), 3, 20)
    seen = {}
    step = live.on_batch(cfg, str(tmp_path / "moves"), lambda name, df: seen.__setitem__(name, df.collect()))
    stream = spark.readStream.schema(QUOTE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = live.stream_moves(stream, cfg).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    moves = detect.quote_moves(q, cfg)
    assert spark.read.parquet(str(tmp_path / "moves")).count() == moves.count() == 58  # only a leg's first tick is no move
    want = score.session_score(moves, cfg, 59_000).collect()
    assert {(r["venue"], r["n_events"], r["score"]) for r in seen["session"]} == {(r["venue"], r["n_events"], r["score"]) for r in want}
    step(moves, 2)  # a retry replaces its own epoch
    step(moves.limit(0), 3)
    later = moves.limit(2).withColumn("recv_us", F.col("recv_us") + 5 * HOUR)
    step(later, 4)  # hours before the session are removed
    assert spark.read.parquet(str(tmp_path / "moves")).count() == 2


def test_watermark_drops_late_ticks(spark, tmp_path):
    minute, seen = 60_000_000, set()
    rows = [quotes(spark, 3).withColumn("recv_us", F.lit(m * minute).cast("long") + F.col("seq")) for m in (1, 10, 11, 2)]
    for i, r in enumerate(rows):  # one file each, in the order of their times
        r.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("part-*")):
            if f not in seen:
                os.utime(f, (1_700_000_000 + 10 * i,) * 2)
                seen.add(f)
    got = streamed(spark, None, str(tmp_path / "in"), QUOTE, live.watermarked_counts, tmp_path)
    assert {(r["start_us"] // minute) for r in got.collect()} <= {1, 10} and got.where(F.col("start_us") == minute).agg(F.sum("n")).first()[0] == 3


def test_streams_start_and_stop_in_order(spark, tmp_path):
    quotes(spark, 5).write.parquet(str(tmp_path / "in"))
    frame = spark.readStream.schema(QUOTE).parquet(str(tmp_path / "in"))
    counted = []
    running = watch.start_all({"a": (frame, lambda df, e: counted.append(df.count())), "b": (frame, lambda df, e: None)}, str(tmp_path / "ck"))
    running[0].processAllAvailable()
    assert [q.name for q in running] == ["a", "b"] and sum(counted) == 5
    watch.stop_all(running)
    assert not any(q.isActive for q in running)
    with pytest.raises(Exception):
        watch.start_all({"c": (frame, lambda df, e: None), "d": (quotes(spark, 1), lambda df, e: None)}, str(tmp_path / "ck2"))
    assert not spark.streams.active


def test_feeds_route_and_connect(spark):
    rows = feeds.to_table(spark, [(1, "5"), (2, None)], "seq long, px string")
    assert [tuple(r) for r in feeds.to_table(spark, rows, "px double, seq int").collect()] == [(5.0, 1), (None, 2)]
    got = []
    batch = spark.createDataFrame([("trades", 1), ("quotes", 2), ("noise", 3), ("trades", 4)], "table string, seq long")
    feeds.dispatcher({"quotes": lambda df, e: got.append(("quotes", e, df.columns, df.count())), "trades": lambda df, e: got.append(("trades", e, df.columns, df.count())), "none": lambda df, e: got.append("never")})(batch, 7)
    assert got == [("quotes", 7, ["seq"], 1), ("trades", 7, ["seq"], 2)]
    waited, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "ok"

    assert feeds.connect(flaky, 5, 2.0, waited.append) == "ok" and waited == [2.0, 2.0]
    with pytest.raises(OSError):
        feeds.connect(lambda: (_ for _ in ()).throw(OSError()), 2, 0, waited.append)


def test_sequences_by_hand(spark):
    cols = "seq long, kind string, first_u long, last_u long, prev_u long"
    spot = [("delta", 5, 7, None), ("snapshot", None, 3, None), ("delta", 8, 9, None), ("snapshot", None, 8, None), ("delta", 8, 9, None), ("delta", 10, 12, None), ("delta", 1, 5, None), ("delta", 15, 16, None), ("delta", 17, 18, None), ("snapshot", None, 30, None), ("delta", 31, 33, None), ("snapshot", None, 40, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(spot)], cols).withColumn("sym", F.lit("X")).withColumn("recv_us", F.lit(0).cast("long"))
    assert [r["state"] for r in venues.spot_gaps(df, ["sym"]).orderBy("seq").collect()] == ["waiting", "early", "waiting", "synced", "ok", "ok", "stale", "gap", "waiting", "synced", "ok", "unused"]
    perp = [("snapshot", None, 9, None), ("delta", 1, 5, 0), ("delta", 6, 12, 5), ("snapshot", None, 8, None), ("delta", 13, 15, 12), ("delta", 13, 14, 12), ("delta", 20, 22, 18), ("snapshot", None, 25, None), ("delta", 24, 25, 23), ("delta", 24, 30, 1), ("delta", 31, 32, None), ("delta", 40, 41, 39)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(perp)], cols).withColumn("sym", F.lit("X")).withColumn("recv_us", F.lit(0).cast("long"))
    assert [r["state"] for r in venues.perp_gaps(df, ["sym"]).orderBy("seq").collect()] == ["early", "waiting", "waiting", "synced", "ok", "stale", "gap", "synced", "stale", "ok", "ok", "gap"]


def test_depth_book_through_a_gap(spark):
    up = lambda u0, u1, b=(), a=(): {"e": "depthUpdate", "E": 1, "s": "X", "U": u0, "u": u1, "b": [list(x) for x in b], "a": [list(x) for x in a]}
    rows = [up(5, 6, [("99", "1")]), {"lastUpdateId": 5, "bids": [["98", "2"]], "asks": [["101", "3"]]}, up(7, 8, (), [("100", "1")]), up(9, 9, (), [("102", "1")]), up(12, 13, [("99.5", "1")]), up(14, 14), {"lastUpdateId": 20, "bids": [["97", "1"]], "asks": [["103", "1"]]}, up(20, 22, [("97", "0"), ("96", "4")])]
    m = messages(spark, rows).withColumn("sym", F.lit("X"))
    got = venues.depth_quotes(venues.binance_depth(m), venues.binance_snapshots(m)).orderBy("seq").collect()
    assert [(r["seq"], r["bid"], r["bidsz"], r["ask"], r["asksz"]) for r in got] == [(2, 99.0, 1.0, 101.0, 3.0), (3, 99.0, 1.0, 100.0, 1.0), (7, 97.0, 1.0, 103.0, 1.0), (8, 96.0, 4.0, 103.0, 1.0)]
    ticker = messages(spark, [{"type": "ticker", "product_id": "BTC-USD", "time": "2024-01-01T00:00:00.5Z", "best_bid": "1", "best_ask": "2", "best_bid_size": "3"}, {"type": "ticker", "product_id": "BTC-USD", "best_bid": "1"}])
    assert [(r["exch_us"], r["bid"], r["bidsz"], r["ask"], r["asksz"]) for r in venues.coinbase_tickers(ticker).collect()] == [(1704067200500000, 1.0, 3.0, 2.0, None)]


def test_reconnect_emits_again(spark):
    rows = [(1, 5.0, False), (2, 5.0, False), (3, 5.0, True), (4, 5.0, False), (5, 6.0, False)]
    df = spark.createDataFrame(rows, "seq long, bid double, fresh boolean").withColumn("sym", F.lit("X"))
    assert [r["seq"] for r in venues.changed(df, ["sym"], "seq", "seq", ["bid"], F.col("fresh")).orderBy("seq").collect()] == [1, 3, 5]


def test_texts_high_water_and_uptime(spark, tmp_path):
    assert [sinks.age_text(x) for x in (None, 12.4, 1500, 90_000, 7_200_000)] == ["-", "12ms", "1.5s", "1.5m", "2.0h"]
    assert sinks.uptime_text(3_723_000) == "1h 2m 3s" and sinks.uptime_text(None) == "-"
    assert [sinks.count_text(n, True) for n in (None, 932, 4400, 44_000, 1_200_000)] == ["-", "932", "4,400", "44.0k", "1.2M"] and sinks.count_text(1_200_000) == "1,200,000"
    mark = sinks.HighWater(spark, str(tmp_path / "mark"))
    assert mark.read() is None
    mark.write(5)
    mark.write(7)
    assert mark.read() == 7
    began = spark.sparkContext.startTime
    assert monitor.uptime_ms(spark, None, began + 1234) == 1234 and monitor.memory(spark)["executors"] >= 1


def test_sinks_and_snapshot(spark, tmp_path):
    alerts = spark.createDataFrame([(i, None if i % 2 else "BTC", "A", "SPOT", "stale", "m") for i in range(30)], "ts long, sym string, venue string, inst string, alert_type string, msg string")
    assert [r["ts"] for r in sinks.recent_alerts(alerts).collect()] == list(range(29, 9, -1))
    sinks.append_events(alerts, str(tmp_path / "csv"))
    sinks.append_events(alerts, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 60
    sinks.snapshot_table(alerts, str(tmp_path / "snap"), 5)
    sinks.replace_table(alerts, str(tmp_path / "tab"))
    sinks.write_thresholds(spark.createDataFrame([("BTC", 2.34567)], "root string, bps double"), str(tmp_path / "thr"))
    assert spark.read.json(str(tmp_path / "thr")).first()["bps"] == 2.346
    scores = spark.createDataFrame([("BTC", "A", "SPOT", 0.5, 0.0), ("BTC", "B", "SPOT", None, 1.0)], "sym string, venue string, inst string, score double, p_value double")
    snap = sinks.snapshot({"alerts": alerts, "trades": None}, {"session": scores}, scores, alerts)
    fresh = spark.createDataFrame([("BTC", "A", "SPOT", 1500.0, 100.0)], "sym string, venue string, inst string, age_ms double, mid double")
    whole = sinks.snapshot(dict.fromkeys(sinks.COUNTED), {"score": scores, "score30": scores, "session": scores}, scores, alerts, fresh, 9_000_000, 2_000, {"executors": 1})
    assert len(whole) - 1 + len(sinks.COUNTED) == 23 and whole["uptime_ms"] == 7000 and whole["score30"].count() == 2 and whole["session"].count() == 1
    assert "up 0h 0m 7s" in sinks.render(whole) and "BTC A/SPOT 1.5s" in sinks.render(whole)
    text = sinks.render(snap)
    assert snap["counts"] == {"alerts": 30, "trades": None} and "BTC A/SPOT +0.500 p=0" in text and "B/SPOT" not in text


def test_recorded_messages(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.txt").write_text('5\t{"a":1}\nbroken\n6\t{"b":\t2}\n')
    got = venues.recorded(spark, str(tmp_path / "feed")).orderBy("recv_us").collect()
    assert [(r["recv_us"], r["json"]) for r in got] == [(5, '{"a":1}'), (6, '{"b":\t2}')]
    assert venues.recorded(spark, str(tmp_path / "feed"), streaming=True).isStreaming


def test_idle_listener_tells_once():
    now, told = [0.0], []
    listener = watch.IdleListener(lambda name, s: told.append((name, s)), 90, lambda: now[0])
    for t, rows in ((0, 1), (60, 0), (91, 0), (120, 0), (130, 5), (240, 0)):
        now[0] = t
        listener.seen("okx", rows)
    assert told == [("okx", 91.0), ("okx", 110.0)]
