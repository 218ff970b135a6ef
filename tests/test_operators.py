"""Detectors, statistics and joins against hand-computed cases and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from forerun.config import Config
from forerun.functions import exprs as E
from forerun.functions import stats as S
from forerun.operators import detect, match, monitor, pairs, recal, relational, score
from forerun.operators import fold as K
from forerun.schema import MOVE, QUOTE


def quote(seq, t, venue, mid, half=0.005, recv=None, sym="BTC", inst="SPOT"):
    return (seq, t, t if recv is None else recv, sym, venue, inst, mid - half, mid + half, mid)


def lead_scenario(spark):
    rows = []
    for i, mid in enumerate([100.0, 100.05, 100.10, 100.05]):
        rows += [quote(2 * i, 2_000_000 * i, "A", mid), quote(2 * i + 1, 2_000_000 * i + 200_000, "B", mid)]
    return spark.createDataFrame(rows, QUOTE)


def test_known_lead_gives_three_events(spark):
    cfg = Config()
    found = match.events(detect.quote_moves(lead_scenario(spark), cfg), cfg).orderBy("ts").collect()
    assert [r["direction"] for r in found] == ["up", "up", "down"]
    assert all((r["lead_venue"], r["follow_venue"], r["lag_ms"]) == ("A", "B", 200.0) for r in found)
    assert [round(r["move_size_bps"], 3) for r in found] == [5.0, 4.998, -4.995]


def test_statistics_by_hand(spark):
    cases = [(5, 8, 0.723674), (500, 800, 1.9955e-12), (3, 3, 0.248213), (5, 10, 0.999999999), (100, 100, 0.0), (0, 0, 1.0)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long").select(S.sign_test(F.col("k"), F.col("n")).alias("p"))
    for r, (_, _, want) in zip(df.collect(), cases):
        assert r["p"] == pytest.approx(want, abs=1e-6, rel=1e-3)
    lo, hi = S.wilson(F.col("k"), F.col("n"), 1.959964)
    r = spark.createDataFrame([(5, 8), (500, 800), (0, 0)], "k long, n long").select((2 * lo - 1).alias("lo"), (2 * hi - 1).alias("hi")).collect()
    assert [(round(x["lo"], 6), round(x["hi"], 6)) for x in r] == [(-0.388515, 0.726311), (0.181860, 0.315750), (-1, 1)]
    x = spark.createDataFrame([(i / 10,) for i in range(-80, 81)], "x double")
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-7 for r in x.select("x", S.normal_cdf(F.col("x")).alias("p")).collect())


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 101)], "k string, v long")
    assert relational.nearest_rank(df, ["k"], "v", {"p": 0.05}).collect()[0]["p"] == 5


def naive_winreset(thr, window, points):
    out, held = [], []
    for t, v in points:
        held = [h for h in held if h[0] >= t - window] + [(t, v)]
        up, down = math.log(v / min(x for _, x in held)), math.log(max(x for _, x in held) / v)
        if up >= thr or down >= thr:
            out.append((t, 1 if up >= thr else -1))
            held = [(t, v)]
    return out


def test_winreset_equals_naive_and_splits():
    rng = random.Random(5)
    t, v, points = 0, 100.0, []
    for _ in range(3000):
        t += rng.randint(1, 50)
        v *= math.exp(rng.gauss(0, 0.002))
        points.append((t, v))
    step = K.winreset(0.01, 400)
    got = [(t, g[0]) for t, v in points if (g := step(t, v))]
    assert got == naive_winreset(0.01, 400, points) and got


def test_resettable_detectors_by_hand():
    step = K.cumulative(0.1, "rel")
    assert [step(t, v) is not None for t, v in enumerate([100, 105, 111, 115, 123])] == [False, False, True, False, True]
    step = K.cumstale(0.1, 2, "rel")
    # at t=3 the base of t=0 is older than the window: replaced, though 12 % away
    assert [step(t, v) is not None for t, v in [(0, 100), (2, 105), (3, 112), (4, 124)]] == [False, False, False, True]
    step = K.imbalance(10)
    assert [step(v) for v in (6, -2, 7, 9, -30)] == [None, None, (1,), None, (-1,)]
    step = K.cooldown(10)
    assert [step(t) is not None for t in (0, 0, 5, 10, 10, 12, 21)] == [True, True, False, True, True, False, True]


def random_moves(spark, n, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.randint(1, 400)
        rows.append((rng.choice(["X", "Y"]), rng.choice(["A", "B", "C"]), rng.choice(["SPOT", "PERP"]), t, t + rng.randint(0, 50), i, 1.0, 1.0, rng.choice(["up", "down"])))
    return rows, spark.createDataFrame(rows, MOVE)


@pytest.mark.parametrize("dead", [0, 100, 1000, 2000])
def test_pair_counts_equal_brute_force(spark, dead):
    rows, df = random_moves(spark, 300, dead)
    keys = pairs.leg_pairs(df, "both")
    got = {tuple(r[c] for c in pairs.PAIR): (r["obs"], r["lag_us"]) for r in pairs.pair_counts(df.withColumn("t", F.col("event_us")), keys, 1000, dead).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[8] == b[8] and (a[1] != b[1]) != (a[2] != b[2]) and dead <= b[3] - a[3] <= 1000:
                k = (a[0], a[8], a[1], a[2], b[1], b[2])
                n, s = want.get(k, (0, 0))
                want[k] = (n + 1, s + b[3] - a[3])
    assert {k: v for k, v in got.items() if v[0]} == want


def test_bars_do_not_depend_on_the_order_of_arrival(spark):
    rows = [("BTC", "A", "SPOT", 1, 1, 250.0), ("BTC", "A", "SPOT", 1, 1, 100.0), ("BTC", "A", "SPOT", 1, 1, -100.0), ("BTC", "A", "SPOT", 2, 2, 120.0)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        trades = spark.createDataFrame(order, "sym string, venue string, inst string, event_us long, seq long, signed double").coalesce(1)
        got = [tuple(r) for r in detect.imbalance_bars(trades, Config(bar_by_sym={}, bar_default=300.0)).collect()]
        assert got == [("BTC", "A", "SPOT", 2, 2, 1)]


def test_pair_sums_beyond_64_bits(spark):
    day = 86_400_000_000
    lead = spark.range(30_000).select(F.lit("BTC").alias("sym"), F.lit("A").alias("venue"), F.lit("SPOT").alias("inst"), F.lit("up").alias("direction"), (F.col("id") % 3 * day).alias("t"))
    foll = spark.range(30_000).select(F.lit("BTC").alias("sym"), F.lit("B").alias("venue"), F.lit("SPOT").alias("inst"), F.lit("up").alias("direction"), F.lit(2500 * day).alias("t"))
    df = lead.unionByName(foll)
    got = pairs.pair_counts(df, pairs.leg_pairs(df, "crossVenue"), 2600 * day, 0).where("obs > 0").collect()
    assert [(r["lead_venue"], r["obs"], int(r["lag_us"])) for r in got] == [("A", 9 * 10**8, 9 * 10**8 * 2499 * day)]
    m = pairs.pair_matrix(df.withColumn("event_us", F.col("t")).withColumn("recv_us", F.col("t")), Config(follow_window=2600 * day), None, None, 0).where("obs > 0").first()
    assert m["avg_lag_ms"] == pytest.approx(2499 * day / 1000)


def test_matches_equal_brute_force(spark):
    rows, df = random_moves(spark, 250, 9)
    cfg = Config(follow_window=900, dead_band=0)
    want = sum(a[0] == b[0] and a[8] == b[8] and a[2] == b[2] and a[1] != b[1] and 0 < b[3] - a[3] <= 900 for a in rows for b in rows)
    assert match.follow_matches(df, cfg).count() == want > 0


def test_match_sides_carry_clocks_as_one_offset(spark):
    rows, df = random_moves(spark, 120, 10)
    cfg = Config(follow_window=900, dead_band=0)
    want = sorted((b[5], a[3], ((a[3] - a[4]) - (b[3] - b[4])) / 1000) for a in rows for b in rows if a[0] == b[0] and a[8] == b[8] and a[2] == b[2] and a[1] != b[1] and 0 < b[3] - a[3] <= 900)
    got = match.follow_matches(df, cfg)
    assert sorted((r["seq"], r["lead_clk"], r["clock_skew_ms"]) for r in got.collect()) == want
    # of microseconds only the lag clock and the offset go through the join, so what is shuffled stays small
    for side in match._sides(df, cfg):
        assert sum(t == "bigint" for c, t in side.dtypes if c not in ("seq", "bucket")) == 2


@pytest.mark.parametrize("dead", [0, 300, 900, 901])
def test_follows_go_to_few_buckets_and_miss_no_leader(spark, dead):
    rows, df = random_moves(spark, 400, 11)
    cfg = Config(follow_window=900, dead_band=dead)
    want = sorted((b[5], a[3]) for a in rows for b in rows if a[0] == b[0] and a[8] == b[8] and a[2] == b[2] and a[1] != b[1] and max(dead, 1) <= b[3] - a[3] <= 900)
    assert sorted((r["seq"], r["lead_clk"]) for r in match.follow_matches(df, cfg).collect()) == want
    lead, foll = match._sides(df, cfg)
    assert lead.count() == len(rows)
    # each copy of a follow is shuffled; two of each were
    assert foll.count() < 1.4 * len(rows)


def test_events_equal_cooled_matches(spark):
    _, df = random_moves(spark, 250, 9)
    key = lambda r: tuple(r[c] for c in (*match.DIRECTED, "ts", "lag_ms", "move_size_bps", "clock_skew_ms"))
    for dead in (0, 7, 1000):
        cfg = Config(follow_window=900, dead_band=dead, cooldown=400)
        got = sorted(map(key, match.events(df, cfg).collect()))
        assert got == sorted(map(key, match.cooled(match.follow_matches(df, cfg), cfg.cooldown).collect())) and bool(got) == (dead <= 900)


def test_cooldown_reads_follow_times_not_matches(spark, monkeypatch):
    df = spark.range(400).select(F.lit("X").alias("sym"), F.when(F.col("id") < 200, "A").otherwise("B").alias("venue"), F.lit("SPOT").alias("inst"), F.when(F.col("id") < 200, 10).otherwise(600).cast("long").alias("event_us"), F.lit(700).cast("long").alias("recv_us"), F.col("id").alias("seq"), F.lit(1.0).alias("mid"), F.lit(1.0).alias("move_bps"), F.lit("up").alias("direction"))
    seen, cooled = [], match.cooled
    monkeypatch.setattr(match, "cooled", lambda m, gap: seen.append(m.count()) or cooled(m, gap))
    assert match.events(df, Config(follow_window=900, dead_band=7)).count() == 200 * 200
    assert seen == [1]


def test_dead_band_beyond_window_expects_nothing(spark):
    _, df = random_moves(spark, 100, 3)
    got = pairs.pair_matrix(df, Config(follow_window=100, dead_band=500), None, None).collect()
    assert got and all(r["obs"] == 0 and r["expected"] == 0 and r["p_value"] == 1 for r in got)


def test_score_identity(spark):
    _, df = random_moves(spark, 300, 4)
    p = pairs.pair_matrix(df, Config(follow_window=1000, dead_band=50, pair_mode="all"), None, None)
    # the expected count is symmetric, so a leg's net excess is its net count
    for r in score.leg_scores(p, 1.96).join(p.groupBy("sym", F.col("lead_venue").alias("venue"), F.col("lead_inst").alias("inst")).agg(F.sum("obs").alias("led")), ["sym", "venue", "inst"]).collect():
        assert r["score"] == pytest.approx((2 * r["led"] - r["n_events"]) / r["n_events"], abs=1e-6)


def test_skew_and_dead_band(spark):
    rows = [("A", "SPOT", 1_000_000 + i, 130_000 + 1000 * (i % 50)) for i in range(200)] + [("A", "SPOT", 1_000_500, 0)] * 10 + [("B", "SPOT", 1_000_000 + i, 60_000) for i in range(20)]
    df = spark.createDataFrame(rows, "venue string, inst string, recv_us long, diff_us long")
    got = monitor.skew_stats(df, Config()).collect()
    assert len(got) == 1 and got[0]["n"] == 200 and got[0]["offset_us"] == 132_000
    band = monitor.dead_band(spark.createDataFrame([("A", 180_000)], "venue string, jitter_us long"), Config(dead_band_mode="auto")).first()
    assert band["measured_us"] == band["dead_band_us"] == round(180_000 * math.sqrt(2))


def test_regime_ignores_quotes_after_the_window(spark):
    rows = [quote(1, 10, "A", 100.0), quote(2, 20, "A", 101.0), quote(3, 999_999_999, "A", 500.0)]
    r = monitor.regimes(spark.createDataFrame(rows, QUOTE), Config(), 1000).collect()
    assert len(r) == 1 and r[0]["regime_bucket"] == "tight_high"


def test_health_and_edges(spark):
    rows = [(i, 1_000_000 * i, 1_000_000 * i, "BTC", "A", "SPOT", True) for i in range(45)] + [(100 + i, 1_000_000 * i, 1_000_000 * i, "BTC", "B", "SPOT", True) for i in range(11)]
    df = spark.createDataFrame(rows, "seq long, event_us long, recv_us long, sym string, venue string, inst string, valid boolean")
    samples = df.withColumn("diff_us", F.lit(5).cast("long"))
    seen = {}
    for now in (15, 45, 50):
        h = monitor.feed_health(df, samples, Config(), now * 1_000_000)
        seen[now] = {(r["venue"], r["alert_type"]) for r in monitor.health_conditions(h, Config()).collect()}
        if now == 45:
            assert {r["venue"]: r["n_accepted"] for r in h.collect()}["B"] == 11
    assert seen == {15: set(), 45: {("B", "feedstale")}, 50: {("B", "feedstale")}}
    active = spark.createDataFrame([(45, None, "B", "SPOT", "x"), (50, None, "B", "SPOT", "x"), (87, None, "B", "SPOT", "x")], "ts long, sym string, venue string, inst string, alert_type string")
    got = sorted((r["ts"], r["edge"]) for r in monitor.edges(active, spark.createDataFrame([(t,) for t in (15, 45, 50, 56, 87)], "ts long")).collect())
    assert got == [(45, "onset"), (56, "recovery"), (87, "onset")]


def test_status_rule():
    assert [monitor.status(*a) for a in ((False, 1, []), (True, None, []), (True, 400_000, []), (True, 1, ["x"] * 11), (True, 1, ["stale"] * 20), (True, 60_000, []))] == ["DISCONNECTED", "WARMING", "DEGRADED", "DEGRADED", "HEALTHY", "WARMING"]


def naive_solve(rate, target, floor):
    if rate(floor) <= target:
        return floor
    lo, hi = floor, 2 * floor
    while target <= rate(hi) and hi < 1e6:
        hi *= 2
    for _ in range(16):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if target <= rate(mid) else (lo, mid)
    return (lo + hi) / 2


def test_solver_takes_the_steps_of_a_bisection():
    assert recal.solve(lambda b: 100 / b, 24, 10) == 10
    for rate in (lambda b: 1000 / b, lambda b: int(5000 / b), lambda b: max(0, 30 - b), lambda b: 24 + (b < 77), lambda b: 25):
        assert recal.solve(rate, 24, 3.7) == naive_solve(rate, 24, 3.7)
    assert recal.solve(lambda b: 0, 24, 0.0) > 0


def test_calibration_equals_a_naive_one(spark):
    rng, rows = random.Random(6), []
    for sym, step in (("BTC", 0.0004), ("ETH", 0.002), ("SOL", 0.0)):
        t, mid = 0, 100.0
        for i in range(1500):
            t += rng.choice([1000, 1_000_000, 30_000_000])
            mid *= math.exp(rng.gauss(0, step))
            rows.append(quote(len(rows), t, "A", mid, recv=t + rng.randint(0, 2_000_000), sym=sym))
    cfg = Config(move_window=20_000_000, recal_rate=40.0)
    got = {r["root"]: r for r in recal.calibrate(spark.createDataFrame(rows, QUOTE).repartition(5), cfg).collect()}
    for sym in ("BTC", "ETH", "SOL"):
        mine = sorted((r for r in rows if r[3] == sym), key=lambda r: (r[2], r[0]))
        steps = [math.log(b[8] / a[8]) for a, b in zip(mine, mine[1:])]
        mean = sum(steps) / len(steps)
        spreads = sorted((r[7] - r[6]) / r[8] * 1e4 for r in mine)
        unit = max((spreads[749] + spreads[750]) / 2, 1e4 * math.sqrt(sum((x - mean) ** 2 for x in steps) / len(steps)))
        hours = (mine[-1][1] - mine[0][1]) / 3.6e9  # by the event clock

        def rate(b, mine=mine, hours=hours):
            step = K.winreset(b / 1e4, cfg.move_window, "log")
            return sum(step(r[1], r[8]) is not None for r in mine) / hours

        want = naive_solve(rate, 40.0, unit)
        r = got[sym]
        assert r["unit"] == pytest.approx(unit) and r["span_hours"] == pytest.approx(hours) and r["n"] == 1500
        assert r["bps"] == pytest.approx(want, rel=1e-9) and r["rate"] == pytest.approx(rate(r["bps"])) and r["floored"] == (want <= unit)
    assert got["SOL"]["floored"] and not got["ETH"]["floored"]


def test_recalibration_run_and_schedule(spark):
    rng, rows, mid = random.Random(7), [], 100.0
    for i in range(600):
        mid *= math.exp(rng.gauss(0, 0.001))
        rows += [quote(2 * i, i * 20_000_000, "A", mid, sym="XBT"), quote(2 * i + 1, i * 20_000_000, "B", mid, sym="XBT")]
    rows.append((9999, 1, 1, "XBT", "A", "SPOT", 5.0, 4.0, 4.5))  # crossed
    cfg = Config(symbols={"XBT": "BTC"}, recal_min_ticks=100, recal_rate=10.0, move_window=60_000_000)
    book, current = spark.createDataFrame(rows, QUOTE), spark.createDataFrame([("BTC", 3.0), ("ETH", 5.0)], "root string, bps double")
    applied = []
    dry = {r["root"]: r for r in recal.run(book, current, cfg, "A").collect()}
    assert dry["BTC"]["status"].startswith("OK") and dry["ETH"]["status"] == "SKIP_NODATA" and 500 < dry["BTC"]["n"] <= 600
    again = {r["root"]: r for r in recal.run(book, current, cfg, "A", apply=lambda t: applied.append({r["root"]: r["bps"] for r in t.collect()})).collect()}
    assert again == dry and applied == [{"BTC": round(dry["BTC"]["new_bps"], 3), "ETH": 5.0}]
    recal.run(book, current, cfg.with_(recal_min_ticks=10_000), "A", apply=applied.append)
    assert len(applied) == 1  # nothing passed, nothing applied
    now, ran = [0.0], []
    schedule = recal.Schedule(60, lambda: now[0])
    for t in (0, 30, 59, 61, 100, 121, 122):
        now[0] = t
        schedule.poll(lambda: ran.append(now[0]))
    assert ran == [0, 61, 121] and schedule.runs == 3
    now[0] = 500
    assert schedule.poll(lambda: 1 / 0) is None and schedule.next == 560


def test_pieces_of_a_silent_leg_fold_as_one(spark):
    rng, rows, t, v = random.Random(8), [], 0, 100.0
    for i in range(2000):
        t += rng.choice([10, 10, 40, 500, 2000])
        v *= math.exp(rng.gauss(0, 0.01))
        rows.append((i, t + rng.randint(-60, 60), t, rng.choice("XY"), "A", "SPOT", v, v, v))
    df = spark.createDataFrame(rows, QUOTE)
    for mode, make in (("winreset", lambda: K.winreset(0.03, 300)), ("cumstale", lambda: K.cumstale(0.03, 300))):
        cfg = Config(mode=mode, threshold_by_sym={}, threshold_bps=300.0, move_window=300)
        got = sorted(r["seq"] for r in detect.quote_moves(df, cfg).collect())
        want = []
        for sym in "XY":
            step = make()
            want += [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[3] == sym and step(r[1], r[8]) is not None]
        assert got == sorted(want) and len(got) > 30
    pair = ("X", "A", "SPOT", "B", "SPOT", "up")
    times = sorted(rng.randrange(100_000) for _ in range(800))
    step = K.cooldown(300)
    want = [x for x in times if step(x) is not None]
    m = spark.createDataFrame([(*pair, x, 1.5) for x in times], "sym string, lead_venue string, lead_inst string, follow_venue string, follow_inst string, direction string, ts long, lag_ms double")
    assert sorted(r["ts"] for r in match.cooled(m, 300).collect()) == want


def test_placed_and_medians(spark):
    rng = random.Random(10)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(700)] + [("c", None, 700), ("c", 4, 701)]
    df = spark.createDataFrame(rows, "k string, v long, seq long")
    got = relational.placed(df.where("v IS NOT NULL"), "v", ["v", "seq"]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1)) and [(r["v"], r["seq"]) for r in got] == sorted((v, s) for _, v, s in rows if v is not None)
    found = {r["k"]: r["m"] for r in relational.medians(df, ["k"], "v", "m").collect()}
    for k in "abc":
        mine = sorted(v for x, v, _ in rows if x == k and v is not None)
        assert found[k] == (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2


def test_dead_band_keeps_or_drops_a_lead(spark):
    """Two legs whose delays swing over 200 ms: the fixed band keeps a lead of 220 ms, the measured one drops it."""
    rows = [(i, 1_000_000 + 1000 * i, 1_000_000 + 1000 * i + floor + 1000 * (i % 201), "BTC", venue, "SPOT", 99.99, 100.01, 100.0) for k, (venue, floor) in enumerate((("A", 130_000), ("B", 60_000))) for i in range(402)]
    samples = spark.createDataFrame(rows, QUOTE).withColumn("diff_us", F.col("recv_us") - F.col("event_us"))
    stats = monitor.skew_stats(samples, Config())
    assert {r["jitter_us"] for r in stats.collect()} == {180_000}
    band = {mode: monitor.dead_band(stats, Config(dead_band_mode=mode)).first() for mode in ("fixed", "auto")}
    assert band["auto"]["measured_us"] == 254_558 == band["auto"]["dead_band_us"] and band["fixed"]["dead_band_us"] == 100_000
    moves = spark.createDataFrame([("BTC", "A", "SPOT", 5_000_000, 5_000_000, 1, 100.1, 10.0, "up"), ("BTC", "B", "SPOT", 5_220_000, 5_220_000, 2, 100.1, 10.0, "up")], MOVE)
    assert [match.events(moves, Config(dead_band=band[m]["dead_band_us"])).count() for m in ("fixed", "auto")] == [1, 0]
    none = monitor.dead_band(monitor.skew_stats(samples.limit(5), Config()), Config(dead_band_mode="auto")).first()
    assert none["measured_us"] == none["dead_band_us"] == 100_000  # the floor stands for what was not measured


def test_scores_of_unequal_rates_are_not_biased(spark):
    """Independent walks score near 0 even at 5:1 rates; thirty injected leads score well above."""
    seeds, rows = 8, []
    for seed in range(seeds):
        for case, gap, leads in (("even", 200, 0), ("uneven", 1000, 0), ("lead", 1000, 30)):
            rng = random.Random(f"{seed} {case}")
            sym = f"{case}{seed}"
            for venue, every in (("A", 200), ("B", gap)):
                for t in range(0, 60_000, every):
                    at = 1000 * (t + rng.randrange(every))
                    rows.append((sym, venue, "SPOT", at, at, len(rows), 1.0, 5.0, rng.choice(["up", "down"])))
            for i in range(leads):
                at, way = 1000 * (2000 * i + 137), rng.choice(["up", "down"])
                rows += [(sym, "A", "SPOT", at, at, len(rows), 1.0, 5.0, way), (sym, "B", "SPOT", at + 200_000, at + 200_000, len(rows) + 1, 1.0, 5.0, way)]
    found = score.leg_scores(pairs.pair_matrix(spark.createDataFrame(rows, MOVE), Config(), None, None), 1.959964).where("venue = 'A'").collect()
    mean = {case: sum(r["score"] for r in found if r["sym"].rstrip("0123456789") == case) / seeds for case in ("even", "uneven", "lead")}
    assert abs(mean["even"]) < 0.08 and abs(mean["uneven"]) < 0.08 and mean["lead"] > max(0.1, mean["uneven"] + 0.05)
    assert sorted(r["p_value"] for r in found if r["sym"].startswith("lead"))[seeds // 2] < 0.05


def test_invalid_and_fallback_health(spark):
    at = lambda i: 1_000_000 * i
    rows = [(i, at(i), at(i), "BTC", "A", "SPOT", i >= 10) for i in range(60)] + [(100 + i, at(i), at(i), "BTC", "B", "SPOT", True) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, event_us long, recv_us long, sym string, venue string, inst string, valid boolean")
    samples = df.where("valid").withColumn("diff_us", F.when(F.col("venue") == "B", 50_000).otherwise(0).cast("long"))
    h = monitor.feed_health(df, samples, Config(), at(60))
    got = {r["venue"]: r for r in h.collect()}
    assert got["A"]["invalid_share"] == pytest.approx(1 / 6) and got["A"]["n_rejected"] == 10 and got["B"]["invalid_share"] == 0 and df.where("valid").count() == 110
    assert got["A"]["fallback_share"] == 1.0 and got["A"]["one_way_floor_ms"] is None and got["B"]["one_way_floor_ms"] == 50.0
    found = sorted(map(tuple, monitor.health_conditions(h, Config()).collect()), key=str)
    assert found == [("BTC", "A", "SPOT", "invalid"), (None, "A", "SPOT", "clockfallback")]
    later = {r["alert_type"] for r in monitor.health_conditions(monitor.feed_health(df, samples, Config(quiet=at(500)), at(130)), Config(quiet=at(500))).collect()}
    assert "invalid" not in later  # no ticks in the window, no share


def test_gate_and_merge(spark):
    solved = spark.createDataFrame([("BTC", 2.34567, 9000, 3.0, False), ("ETH", 0.01, 9000, 3.0, False), ("SOL", 3.0, 10, 3.0, False), ("XRP", 1.5, 9000, 3.0, True)], "root string, bps double, n long, span_hours double, floored boolean")
    current = spark.createDataFrame([("BTC", 3.0), ("ETH", 5.0), ("DOGE", 4.0)], "root string, bps double")
    got = {r["root"]: (r["bps"], r["status"]) for r in recal.merged(current, solved, Config()).collect()}
    assert got == {"BTC": (2.346, "OK"), "ETH": (5.0, "SKIP_BOUNDS"), "DOGE": (4.0, "SKIP_NODATA"), "XRP": (1.5, "OK_FLOORED")}


def test_bad_modes_raise():
    with pytest.raises(ValueError):
        E.comparable("nope", *[F.lit(1)] * 4)
    with pytest.raises(ValueError):
        E.change("nope", F.lit(1), F.lit(2))
    with pytest.raises(ValueError):
        detect.detect(None, "nope", [], "t", "s", "v", 1, 1, "log")


def test_lookup_join_overwrites_only_matches(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    right = spark.createDataFrame([("a", None)], "k string, v int")
    assert sorted(map(tuple, relational.lookup_join(left, right, ["k"]).collect())) == [("a", None), ("b", 2)]
