"""The engine's queries by operator, and the SQL that checks them.

Doubles are rounded to six decimals on both sides. Windows suit the test data's pace (hours, not milliseconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HOUR, MINUTE, Config
from ..functions import exprs as E
from ..functions import stats as S
from ..operators import detect, match, monitor, pairs, recal, relational, score
from ..operators import fold as K
from ..schema import LEG
from ..sources import mapping as M
from ..sources import sinks, venues
from . import oracle as O

CFG = Config(threshold_by_sym={}, follow_window=6 * HOUR, dead_band=10 * MINUTE, cooldown=12 * HOUR, score_window=48 * HOUR, session_window=240 * HOUR, skew_window=240 * HOUR, regime_window=72 * HOUR, stale_window=2 * HOUR, alert_cooldown=24 * HOUR, health_window=48 * HOUR, quiet=10 * HOUR, move_window=12 * HOUR)
#: 2024-01-25 and 2024-01-20, in microseconds.
END, MID = 1706140800000000, 1705708800000000
L = ", ".join(LEG)

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    # adding 0 turns a negative zero into zero
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in cols)


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tickwise(M.quotes(spark, sf_dir), CFG)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quotes(spark, sf_dir).select(*LEG, F.col("event_us").alias("t"), "seq", "mid")


SERIES_SQL = f"{O.BOOK_SQL}, src AS (SELECT {L}, event_us AS t, seq, mid AS v FROM q)"

# --- projections and predicates -------------------------------------------------------------------------------------


@query("p1_normalise_quote", f"WITH {O.BOOK_SQL} SELECT seq, event_us, recv_us, CASE sym WHEN 'click' THEN 'CLK' WHEN 'view' THEN 'VIEW' ELSE sym END AS sym, venue, inst, {r6('bid', 'ask')}, round((bid + ask) / 2, 6) AS mid FROM b")
def p1(spark, sf):
    return M.book(spark, sf).select("seq", "event_us", "recv_us", E.canonical(F.col("sym"), M.ALIASES).alias("sym"), "venue", "inst", "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))


@query("p2_mid", f"WITH {O.BOOK_SQL} SELECT seq, {r6('mid')} FROM q")
def p2(spark, sf):
    return M.quotes(spark, sf).select("seq", "mid")


@query("p3_validity", f"WITH {O.BOOK_SQL} SELECT seq, coalesce(bid < ask, false) AS valid FROM b")
def p3(spark, sf):
    return M.book(spark, sf).select("seq", E.valid_book(F.col("bid"), F.col("ask")).alias("valid"))


@query("p4_universe", f"WITH {O.BOOK_SQL} SELECT seq, sym FROM b WHERE sym IN ('click', 'purchase', 'error')")
def p4(spark, sf):
    return M.book(spark, sf).where(F.col("sym").isin("click", "purchase", "error")).select("seq", "sym")


@query("p5_canonical_sym", f"WITH {O.BOOK_SQL} SELECT CASE sym WHEN 'click' THEN 'CLK' WHEN 'view' THEN 'VIEW' ELSE sym END AS sym, count(*) AS n FROM b GROUP BY 1")
def p5(spark, sf):
    return M.book(spark, sf).groupBy(E.canonical(F.col("sym"), M.ALIASES).alias("sym")).agg(F.count("*").alias("n"))


_RAW = "CASE l_linenumber % 3 WHEN 0 THEN '-USDT' WHEN 1 THEN '-USD' ELSE 'USDT' END"


@query("p6_venue_suffix", f"SELECT CASE WHEN s LIKE '%-USDT' THEN 'OKX' WHEN s LIKE '%-USD' THEN 'COINBASE' ELSE 'BINANCE' END AS venue, count(*) AS n FROM (SELECT 'P' || (l_partkey % 5) || {_RAW} AS s FROM lineitem) GROUP BY 1")
def p6(spark, sf):
    raw = F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string"), F.expr(_RAW))
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(E.venue_of(raw).alias("venue")).agg(F.count("*").alias("n"))


@query("p7_threshold", f"WITH {O.BOOK_SQL} SELECT DISTINCT sym, round(1.5 * CASE sym WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 2 END, 6)::DOUBLE AS threshold_bps FROM b")
def p7(spark, sf):
    return M.book(spark, sf).select("sym").distinct().select("sym", E.threshold(F.col("sym"), {"click": 3.0, "view": 4.0}, 2.0, 1.5).alias("threshold_bps"))


@query("p8_signed_notional", f"WITH {O.TRADES_SQL} SELECT seq, round(px * qty * CASE WHEN side = 'B' THEN 1 ELSE -1 END, 6) AS signed FROM t")
def p8(spark, sf):
    return M.trades(spark, sf).select("seq", E.signed_notional(F.col("px"), F.col("qty"), F.col("side")).alias("signed"))


def _pair_mode(mode):
    sql = f"WITH {O.BOOK_SQL}, l AS (SELECT DISTINCT {L} FROM q) SELECT a.sym, a.venue AS lead_venue, a.inst AS lead_inst, b.venue AS follow_venue, b.inst AS follow_inst FROM l a JOIN l b ON a.sym = b.sym AND {O.comparable(mode, 'a', 'b')}"

    @query(f"p9_pairmode_{mode.lower()}", sql)
    def run(spark, sf):
        legs = M.quotes(spark, sf).select(*LEG).distinct()
        a = legs.select("sym", F.col("venue").alias("lead_venue"), F.col("inst").alias("lead_inst"))
        b = legs.select("sym", F.col("venue").alias("follow_venue"), F.col("inst").alias("follow_inst"))
        return a.join(b, "sym").where(E.comparable(mode, F.col("lead_venue"), F.col("lead_inst"), F.col("follow_venue"), F.col("follow_inst")))


for _mode in ("crossVenue", "crossInst", "both", "all"):
    _pair_mode(_mode)


@query("p10_lag_clock", f"WITH {O.BOOK_SQL} SELECT seq, recv_us AS recv_clk, event_us AS event_clk, event_us + coalesce(CASE venue WHEN 'V0' THEN 130000 WHEN 'V1' THEN 60000 END, 0) AS cal_clk FROM q")
def p10(spark, sf):
    offset = F.when(F.col("venue") == "V0", 130000).when(F.col("venue") == "V1", 60000)
    q = M.quotes(spark, sf).withColumn("offset_us", offset)
    return q.select("seq", E.lag_clock("recv").alias("recv_clk"), E.lag_clock("event").alias("event_clk"), E.lag_clock("cal").alias("cal_clk"))


@query("p11_return_basis", f"WITH {O.BOOK_SQL}, x AS (SELECT seq, mid, lag(mid) OVER (PARTITION BY {L} ORDER BY recv_us, seq) AS p FROM q) SELECT seq, round((mid - p) / p, 6) AS rel, round(mid - p, 6) AS abs, round(ln(mid / p), 6) AS log FROM x WHERE p IS NOT NULL")
def p11(spark, sf):
    q = M.quotes(spark, sf).withColumn("p", F.lag("mid").over(Window.partitionBy(*LEG).orderBy("recv_us", "seq"))).where("p IS NOT NULL")
    return q.select("seq", *[E.change(b, F.col("p"), F.col("mid")).alias(b) for b in ("rel", "abs", "log")])


@query("p12_two_sided_mapped", f"WITH {O.BOOK_SQL} SELECT seq FROM b WHERE bid IS NOT NULL AND ask IS NOT NULL AND bid < ask AND sym IN ('click', 'view')")
def p12(spark, sf):
    known = spark.createDataFrame([(k,) for k in M.ALIASES], "sym string")
    return M.book(spark, sf).where(E.valid_book(F.col("bid"), F.col("ask"))).join(F.broadcast(known), "sym", "left_semi").select("seq")


@query("p13_range_gate", f"WITH {O.BOOK_SQL} SELECT seq FROM q WHERE mid BETWEEN 0.1 AND 100")
def p13(spark, sf):
    return M.quotes(spark, sf).where(F.col("mid").between(0.1, 100)).select("seq")


@query("p15_take_columns", f"WITH {O.MOVES_SQL} SELECT direction, sym, {r6('move_bps')}, seq FROM mv")
def p15(spark, sf):
    return moves(spark, sf).select("direction", "sym", "move_bps", "seq")


@query("p16_ungroup", f"WITH {O.BOOK_SQL} SELECT sym, venue, inst, event_us FROM q")
def p16(spark, sf):
    nested = M.quotes(spark, sf).groupBy(*LEG, F.floor(F.col("event_us") / (24 * HOUR)).alias("day")).agg(F.sort_array(F.collect_list("event_us")).alias("times"))
    return nested.select(*LEG, F.explode("times").alias("event_us"))


@query("p17_nest_per_key", f"WITH {O.BOOK_SQL} SELECT {L}, event_us // {24 * HOUR} AS day, count(*) AS n, min(event_us) AS first_us, max(event_us) AS last_us FROM q GROUP BY ALL")
def p17(spark, sf):
    nested = M.quotes(spark, sf).groupBy(*LEG, F.floor(F.col("event_us") / (24 * HOUR)).alias("day")).agg(F.sort_array(F.collect_list("event_us")).alias("times"))
    return nested.select(*LEG, "day", F.size("times").cast("long").alias("n"), F.element_at("times", 1).alias("first_us"), F.element_at("times", -1).alias("last_us"))


# --- joins ----------------------------------------------------------------------------------------------------------

BAND = O.pairs(CFG.with_(pair_mode="all"))
PAIR_COLS = ", ".join(pairs.PAIR)


@query("j1_leg_pairs", f"WITH {O.MOVES_SQL}, {O.pairs(CFG)} SELECT {PAIR_COLS}, n_lead, n_follow FROM pr")
def j1(spark, sf):
    return pairs.leg_pairs(moves(spark, sf), CFG.pair_mode)


@query("j2_one_key", f"WITH {O.MOVES_SQL}, l AS (SELECT DISTINCT {L} FROM q) SELECT a.seq, b.venue AS leg_venue, b.inst AS leg_inst FROM mv a JOIN l b ON a.sym = b.sym")
def j2(spark, sf):
    legs = M.quotes(spark, sf).select("sym", F.col("venue").alias("leg_venue"), F.col("inst").alias("leg_inst")).distinct()
    return moves(spark, sf).select("seq", "sym").join(legs, "sym").select("seq", "leg_venue", "leg_inst")


@query("j3_lookup_overwrite", f"WITH {O.BOOK_SQL}, m AS (SELECT venue, max(bid) AS bid FROM q WHERE venue <> 'V2' GROUP BY 1) SELECT seq, q.venue, round(CASE WHEN m.venue IS NOT NULL THEN m.bid ELSE q.bid END, 6) AS bid FROM q LEFT JOIN m ON q.venue = m.venue")
def j3(spark, sf):
    q = M.quotes(spark, sf)
    best = q.where("venue <> 'V2'").groupBy("venue").agg(F.max("bid").alias("bid"))
    return relational.lookup_join(q.select("seq", "venue", "bid"), best, ["venue"])


@query("j4_theta_residual", f"WITH {O.BOOK_SQL}, l AS (SELECT {L}, count(*) AS n FROM q GROUP BY ALL) SELECT a.sym, a.venue AS lead_venue, b.venue AS follow_venue, a.n AS lead_n, b.n AS follow_n FROM l a JOIN l b ON a.sym = b.sym AND a.inst = b.inst AND a.n > b.n")
def j4(spark, sf):
    legs = M.quotes(spark, sf).groupBy(*LEG).agg(F.count("*").alias("n"))
    a = legs.select("sym", "inst", F.col("venue").alias("lead_venue"), F.col("n").alias("lead_n"))
    b = legs.select("sym", "inst", F.col("venue").alias("follow_venue"), F.col("n").alias("follow_n"))
    return a.join(b, ["sym", "inst"]).where("lead_n > follow_n").select("sym", "lead_venue", "follow_venue", "lead_n", "follow_n")


@query("j5_pair_count", f"WITH {O.MOVES_SQL}, {O.pairs(CFG)} SELECT {PAIR_COLS}, obs, CAST(lag_us AS BIGINT) AS lag_us FROM pm0")
def j5(spark, sf):
    m = moves(spark, sf).withColumn("t", F.col("event_us") - F.lit(1704067200000000))
    keys = pairs.leg_pairs(m, CFG.pair_mode)
    return pairs.pair_counts(m, keys, CFG.follow_window, CFG.dead_band).withColumn("lag_us", F.col("lag_us").cast("long"))


MATCH_SQL = f"""jm AS (SELECT b.event_us AS ts, b.seq, a.sym, a.venue AS lead_venue, a.inst AS lead_inst, b.venue AS follow_venue, b.inst AS follow_inst, a.direction, (b.event_us - a.event_us) / 1000 AS lag_ms,
  a.move_bps AS move_size_bps, ((a.event_us - a.recv_us) - (b.event_us - b.recv_us)) / 1000 AS clock_skew_ms, a.event_us AS lead_clk
  FROM mv a JOIN mv b ON a.sym = b.sym AND a.direction = b.direction AND {O.comparable("crossVenue", "a", "b")} AND a.event_us < b.event_us AND b.event_us - a.event_us BETWEEN {CFG.dead_band} AND {CFG.follow_window})"""
MATCH_COLS = "ts, sym, lead_venue, lead_inst, follow_venue, follow_inst, direction, " + r6("lag_ms", "move_size_bps", "clock_skew_ms")


@query("j6_follow_match", f"WITH {O.MOVES_SQL}, {MATCH_SQL} SELECT {MATCH_COLS} FROM jm")
def j6(spark, sf):
    return match.follow_matches(moves(spark, sf), CFG).drop("seq", "lead_clk")


STALE_SQL = f"""ld AS (SELECT * FROM mv WHERE recv_us <= {END} - {CFG.stale_window} AND recv_us > {MID}), lg AS (SELECT DISTINCT {L} FROM q),
st AS (SELECT {END} AS ts, a.sym, b.venue, b.inst, 'stale' AS alert_type, a.venue || '/' || a.inst || '_' || a.direction AS msg FROM ld a JOIN lg b ON a.sym = b.sym AND {O.comparable("crossVenue", "a", "b")}
  WHERE NOT EXISTS (SELECT 1 FROM mv m WHERE m.sym = a.sym AND m.venue = b.venue AND m.inst = b.inst AND m.direction = a.direction AND m.recv_us BETWEEN a.recv_us - {CFG.stale_window} AND a.recv_us + {CFG.stale_window}))"""


@query("j7_stale_anti", f"WITH {O.MOVES_SQL}, {STALE_SQL} SELECT sym, venue, inst, msg, count(*) AS n FROM st GROUP BY ALL")
def j7(spark, sf):
    return monitor.stale_followers(moves(spark, sf), M.quotes(spark, sf), CFG, MID, END).groupBy("sym", "venue", "inst", "msg").agg(F.count("*").alias("n"))


@query("j8_as_of", f"WITH {SERIES_SQL} SELECT sym, venue, inst, t, seq, round(coalesce((SELECT max_by(p.v, p.t) FROM src p WHERE p.sym = a.sym AND p.venue = a.venue AND p.inst = a.inst AND p.t <= a.t - {CFG.move_window}), first_value(v) OVER (PARTITION BY {L} ORDER BY t, seq)), 6) AS base FROM src a")
def j8(spark, sf):
    return relational.as_of(series(spark, sf), LEG, "t", "seq", "mid", CFG.move_window, "base").drop("mid")


@query("j9_semi", f"WITH {O.MOVES_SQL} SELECT seq FROM q WHERE EXISTS (SELECT 1 FROM mv WHERE mv.sym = q.sym AND mv.venue = q.venue AND mv.inst = q.inst AND mv.direction = 'up' AND mv.move_bps > 500000)")
def j9(spark, sf):
    return M.quotes(spark, sf).join(moves(spark, sf).where("direction = 'up' AND move_bps > 500000").select(*LEG), LEG, "left_semi").select("seq")


@query("j10_anti_null_safe", f"WITH {O.BOOK_SQL}, k AS (SELECT CASE WHEN sym = 'view' THEN NULL ELSE sym END AS sym, venue, inst, seq, bid FROM b) SELECT seq FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.bid IS NULL AND o.inst = 'PERP' AND o.sym IS NOT DISTINCT FROM k.sym AND o.venue = k.venue AND o.venue <> 'V1')")
def j10(spark, sf):
    k = M.book(spark, sf).select(F.when(F.col("sym") != "view", F.col("sym")).alias("sym"), "venue", "inst", "seq", "bid")
    return relational.absent_from(k, k.where("bid IS NULL AND inst = 'PERP' AND venue <> 'V1'"), ["sym", "venue"]).select("seq")


@query("j11_upsert", f"WITH {O.BOOK_SQL}, u AS (SELECT {L}, mid, 0 AS side, 0 AS recv_us, 0 AS seq FROM q WHERE recv_us < {MID} UNION ALL SELECT {L}, mid, 1, recv_us, seq FROM q WHERE recv_us >= {MID}), x AS (SELECT *, row_number() OVER (PARTITION BY {L} ORDER BY side DESC, recv_us DESC, seq DESC) AS rn FROM u) SELECT {L}, {r6('mid')} FROM x WHERE rn = 1 AND side = 1")
def j11(spark, sf):
    q = M.quotes(spark, sf)
    state = q.where(F.col("recv_us") < MID).groupBy(*LEG).agg(F.min("mid").alias("mid"))
    changes = q.where(F.col("recv_us") >= MID)
    merged = relational.upsert(state, changes.select(*LEG, "mid", "recv_us", "seq"), LEG, ["recv_us", "seq"])
    return merged.join(changes.select(*LEG).distinct(), LEG, "left_semi")


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("a1_group_sum", f"WITH {O.MOVES_SQL} SELECT sym, venue, inst, {r6('s')} FROM (SELECT {L}, sum(move_bps) AS s FROM mv GROUP BY ALL)")
def a1(spark, sf):
    return moves(spark, sf).groupBy(*LEG).agg(F.sum("move_bps").alias("s"))


@query("a2_group_count", f"WITH {O.MOVES_SQL} SELECT {L}, direction, count(*) AS n FROM mv GROUP BY ALL")
def a2(spark, sf):
    return moves(spark, sf).groupBy(*LEG, "direction").agg(F.count("*").alias("n"))


@query("a3_accept_reject", f"WITH {O.BOOK_SQL} SELECT {L}, CAST(count_if(coalesce(bid < ask, false)) AS BIGINT) AS n_accepted, CAST(count_if(NOT coalesce(bid < ask, false)) AS BIGINT) AS n_rejected FROM b GROUP BY ALL")
def a3(spark, sf):
    return monitor.health_counts(M.book(spark, sf).withColumn("valid", E.valid_book(F.col("bid"), F.col("ask"))))


@query("a4_last_quote", f"WITH {O.BOOK_SQL} SELECT {L}, round(arg_max(bid, (recv_us - 1704067200000000) * 100000 + seq % 100000), 6) AS bid, max(recv_us) AS recv_us FROM q GROUP BY ALL")
def a4(spark, sf):
    return M.quotes(spark, sf).groupBy(*LEG).agg(F.max_by("bid", F.struct("recv_us", "seq")).alias("bid"), F.max("recv_us").alias("recv_us"))


@query("a5_global_span", f"WITH {O.MOVES_SQL} SELECT greatest(1, max(event_us) - min(event_us)) AS span FROM mv")
def a5(spark, sf):
    return moves(spark, sf).agg(F.greatest(F.lit(1), F.max("event_us") - F.min("event_us")).alias("span"))


@query("a6_nearest_rank", f"WITH {O.BOOK_SQL} SELECT venue, inst, list_sort(list(recv_us - event_us))[1 + CAST(floor(0.05 * (count(*) - 1)) AS INT)] AS p5, list_sort(list(recv_us - event_us))[1 + CAST(floor(0.95 * (count(*) - 1)) AS INT)] AS p95, count(*) AS n FROM q GROUP BY ALL")
def a6(spark, sf):
    return relational.nearest_rank(M.quotes(spark, sf).withColumn("diff", F.col("recv_us") - F.col("event_us")), ["venue", "inst"], "diff", {"p5": 0.05, "p95": 0.95})


@query("a7_share", f"WITH {O.BOOK_SQL} SELECT venue, inst, round(avg(CASE WHEN recv_us = event_us THEN 1.0 ELSE 0.0 END), 6) AS share FROM q GROUP BY ALL")
def a7(spark, sf):
    return M.quotes(spark, sf).groupBy("venue", "inst").agg(F.avg(F.when(F.col("recv_us") == F.col("event_us"), 1.0).otherwise(0.0)).alias("share"))


@query("a8_median", f"WITH {O.BOOK_SQL} SELECT sym, round(median((ask - bid) / mid * 10000), 6) AS spread_bps FROM q GROUP BY 1")
def a8(spark, sf):
    return relational.medians(M.quotes(spark, sf).withColumn("spread", (F.col("ask") - F.col("bid")) / F.col("mid") * 10000), ["sym"], "spread", "spread_bps")


@query("a9_population_stdev", f"WITH {O.BOOK_SQL}, x AS (SELECT sym, (mid - lag(mid) OVER w) / lag(mid) OVER w AS r FROM q WINDOW w AS (PARTITION BY {L} ORDER BY recv_us, seq)) SELECT sym, round(stddev_pop(r), 6) AS dev FROM x GROUP BY 1")
def a9(spark, sf):
    p = F.lag("mid").over(Window.partitionBy(*LEG).orderBy("recv_us", "seq"))
    return M.quotes(spark, sf).withColumn("r", (F.col("mid") - p) / p).groupBy("sym").agg(F.stddev_pop("r").alias("dev"))


@query("a10_realised_vol", f"WITH {O.BOOK_SQL}, x AS (SELECT {L}, 10000 * (mid - lag(mid) OVER w) / lag(mid) OVER w AS r FROM q WINDOW w AS (PARTITION BY {L} ORDER BY recv_us, seq)) SELECT {L}, round(sqrt(sum(r * r)), 4) AS vol_bps FROM x GROUP BY ALL")
def a10(spark, sf):
    return monitor.realised_vol(M.quotes(spark, sf)).select(*LEG, F.round("vol_bps", 4).alias("vol_bps"))


@query("a11_inventory", f"WITH {O.MOVES_SQL} SELECT 'book' AS name, (SELECT count(*) FROM b) AS n UNION ALL SELECT 'quotes', (SELECT count(*) FROM q) UNION ALL SELECT 'moves', (SELECT count(*) FROM mv)")
def a11(spark, sf):
    tables = {"book": M.book(spark, sf), "quotes": M.quotes(spark, sf), "moves": moves(spark, sf)}
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a12_ticks_by_venue", f"WITH {O.BOOK_SQL} SELECT sym, venue, count(*) AS n FROM q GROUP BY ALL")
def a12(spark, sf):
    return M.quotes(spark, sf).groupBy("sym", "venue").agg(F.count("*").alias("n"))


@query("a14_distinct_legs", f"WITH {O.BOOK_SQL} SELECT DISTINCT {L} FROM q")
def a14(spark, sf):
    return M.quotes(spark, sf).select(*LEG).distinct()


# --- ordered series and detectors -------------------------------------------------------------------------------------


@query("w1_lag", f"WITH {O.BOOK_SQL} SELECT seq, round(lag(mid) OVER (PARTITION BY {L} ORDER BY recv_us, seq), 6) AS prev FROM q")
def w1(spark, sf):
    return M.quotes(spark, sf).select("seq", F.lag("mid").over(Window.partitionBy(*LEG).orderBy("recv_us", "seq")).alias("prev"))


@query("w2_tickwise", f"WITH {O.MOVES_SQL} SELECT {L}, event_us, recv_us, seq, {r6('mid', 'move_bps')}, direction FROM mv")
def w2(spark, sf):
    return moves(spark, sf)


@query("w3_tickwise_log", f"WITH {SERIES_SQL}, x AS (SELECT *, ln(v / lag(v) OVER (PARTITION BY {L} ORDER BY t, seq)) AS r FROM src) SELECT {L}, t, seq, CAST(sign(r) AS INTEGER) AS dir, round(abs(r), 6) AS size FROM x WHERE abs(r) >= 0.5")
def w3(spark, sf):
    return detect.detect(series(spark, sf), "tickwise", LEG, "t", "seq", "mid", 0.5, 0, "log")


@query("w4_windowed", f"""WITH {SERIES_SQL}, x AS (SELECT a.*, coalesce((SELECT max_by(p.v, p.t) FROM src p WHERE p.sym = a.sym AND p.venue = a.venue AND p.inst = a.inst AND p.t <= a.t - {CFG.move_window}), first_value(v) OVER (PARTITION BY {L} ORDER BY t, seq)) AS base FROM src a),
y AS (SELECT *, ln(v / base) AS r, CASE WHEN abs(ln(v / base)) >= 0.5 THEN sign(ln(v / base)) ELSE 0 END AS dir FROM x), z AS (SELECT *, coalesce(lag(dir) OVER (PARTITION BY {L} ORDER BY t, seq), 0) AS pd FROM y)
SELECT {L}, t, seq, CAST(dir AS INTEGER) AS dir, round(abs(r), 6) AS size FROM z WHERE dir <> 0 AND dir <> pd""")
def w4(spark, sf):
    return detect.detect(series(spark, sf), "windowed", LEG, "t", "seq", "mid", 0.5, CFG.move_window, "log")


_OUT = f"SELECT {L}, t, seq, CAST(dir AS INTEGER) AS dir, round(size, 6) AS size FROM fold WHERE dir <> 0"
THR = 1.0
_FIRE = f"abs(ln(r.v / s.base)) >= {O.d(THR)}"


@query("w5_cumulative", O.fold_sql(SERIES_SQL, LEG, "t, seq", "v AS base, 0 AS dir, 0.0::DOUBLE AS size", {"base": f"CASE WHEN {_FIRE} THEN r.v ELSE s.base END"}, f"CASE WHEN {_FIRE} THEN CAST(sign(ln(r.v / s.base)) AS INTEGER) ELSE 0 END, abs(ln(r.v / s.base))", _OUT))
def w5(spark, sf):
    return detect.detect(series(spark, sf), "cumulative", LEG, "t", "seq", "mid", THR, 0, "log")


_OLD = f"r.t - s.bt > {CFG.move_window}"


@query("w6_cumstale", O.fold_sql(SERIES_SQL, LEG, "t, seq", "v AS base, t AS bt, 0 AS dir, 0.0::DOUBLE AS size", {"base": f"CASE WHEN {_OLD} OR {_FIRE} THEN r.v ELSE s.base END", "bt": f"CASE WHEN {_OLD} OR {_FIRE} THEN r.t ELSE s.bt END"}, f"CASE WHEN NOT ({_OLD}) AND {_FIRE} THEN CAST(sign(ln(r.v / s.base)) AS INTEGER) ELSE 0 END, abs(ln(r.v / s.base))", _OUT))
def w6(spark, sf):
    return detect.detect(series(spark, sf), "cumstale", LEG, "t", "seq", "mid", THR, CFG.move_window, "log")


def _winreset_sql(source: str, keys: list[str], thr: float, window: int) -> str:
    k = ", ".join(keys)
    live = f"list_append(list_filter(s.win, lambda x: x.t >= r.t - {window}), {{'t': r.t, 'v': r.v}})"
    lo, hi = "list_min(list_transform(w, lambda x: x.v))", "list_max(list_transform(w, lambda x: x.v))"
    return f"""
WITH RECURSIVE {source}, nr AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY t, seq) AS no FROM src),
fold AS (
  SELECT {k}, no, t, seq, [{{'t': t, 'v': v}}] AS win, 0 AS dir, 0.0::DOUBLE AS size FROM nr WHERE no = 1
  UNION ALL
  SELECT {k}, no, t, seq, CASE WHEN dir <> 0 THEN [{{'t': t, 'v': v}}] ELSE w END, dir, CASE WHEN dir > 0 THEN up ELSE dn END
  FROM (SELECT *, CASE WHEN up >= {O.d(thr)} THEN 1 WHEN dn >= {O.d(thr)} THEN -1 ELSE 0 END AS dir FROM (SELECT *, ln(v / {lo}) AS up, ln({hi} / v) AS dn FROM (
    SELECT {", ".join("r." + x for x in keys)}, r.no, r.t, r.seq, r.v, {live} AS w FROM fold s JOIN nr r ON {" AND ".join(f"r.{x} = s.{x}" for x in keys)} AND r.no = s.no + 1)))
)
SELECT {k}, t, seq, CAST(dir AS INTEGER) AS dir, round(size, 6) AS size FROM fold WHERE dir <> 0"""


@query("w7_winreset", _winreset_sql(SERIES_SQL, LEG, 3.0, CFG.move_window))
def w7(spark, sf):
    return detect.detect(series(spark, sf), "winreset", LEG, "t", "seq", "mid", 3.0, CFG.move_window, "log")


_BAR = 400000.0
_BARS = f"abs(s.acc + r.v) >= {O.d(_BAR)}"


@query("w8_imbalance_bars", O.fold_sql(f"{O.TRADES_SQL}, src AS (SELECT {L}, event_us AS t, seq, round(px * qty, 2) * CASE WHEN side = 'B' THEN 1 ELSE -1 END AS v FROM t)", LEG, "t, seq", f"CASE WHEN abs(v) >= {O.d(_BAR)} THEN 0.0 ELSE v END AS acc, CASE WHEN abs(v) >= {O.d(_BAR)} THEN CAST(sign(v) AS INTEGER) ELSE 0 END AS dir", {"acc": f"CASE WHEN {_BARS} THEN 0.0 ELSE s.acc + r.v END"}, f"CASE WHEN {_BARS} THEN CAST(sign(s.acc + r.v) AS INTEGER) ELSE 0 END", f"SELECT {L}, t AS event_us, seq, CAST(dir AS INTEGER) AS dir FROM fold WHERE dir <> 0"))
def w8(spark, sf):
    signed = F.round(F.col("px") * F.col("qty"), 2) * F.when(F.col("side") == "B", 1.0).otherwise(-1.0)
    return detect.imbalance_bars(M.trades(spark, sf).withColumn("signed", signed), CFG.with_(bar_by_sym={}, bar_default=_BAR))


# some trades of the test data share their number; they have no order, so they count as one, at the highest price
_TRADE_SRC = f"{O.TRADES_SQL}, src AS (SELECT {L}, recv_us AS t, seq, max(px) AS v FROM t GROUP BY ALL)"


@query("w9_trade_winreset", _winreset_sql(_TRADE_SRC, LEG, 0.35, 96 * HOUR))
def w9(spark, sf):
    t = M.trades(spark, sf).groupBy(*LEG, F.col("recv_us").alias("t"), "seq").agg(F.max("px").alias("px"))
    return detect.detect(t, "winreset", LEG, "t", "seq", "px", 0.35, 96 * HOUR, "log")


COOL_SQL = f"""cs AS (SELECT DISTINCT {", ".join(match.DIRECTED)}, ts FROM jm), cn AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(match.DIRECTED)} ORDER BY ts) AS no FROM cs),
cf AS (SELECT *, ts AS kept_at, true AS kept FROM cn WHERE no = 1 UNION ALL SELECT r.*, CASE WHEN r.ts - s.kept_at >= {CFG.cooldown} THEN r.ts ELSE s.kept_at END, r.ts - s.kept_at >= {CFG.cooldown} FROM cf s JOIN cn r ON {" AND ".join(f"r.{c} = s.{c}" for c in match.DIRECTED)} AND r.no = s.no + 1)"""


@query("w10_cooldown", f"WITH RECURSIVE {O.MOVES_SQL}, {MATCH_SQL}, {COOL_SQL} SELECT {', '.join(match.DIRECTED)}, ts FROM cf WHERE kept")
def w10(spark, sf):
    m = match.follow_matches(moves(spark, sf), CFG).select(*match.DIRECTED, "ts").distinct()
    return match.cooled(m, CFG.cooldown)


@query("w11_prefix_sums", f"WITH {SERIES_SQL} SELECT {L}, seq, round(sum(v) OVER (PARTITION BY {L} ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 4) AS total FROM src")
def w11(spark, sf):
    w = Window.partitionBy(*LEG).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return series(spark, sf).select(*LEG, "seq", F.round(F.sum("mid").over(w), 4).alias("total"))


@query("w12_run_collapse", f"WITH {SERIES_SQL}, x AS (SELECT *, CASE WHEN v > 100 THEN 1 WHEN v < 10 THEN -1 ELSE 0 END AS dir FROM src), y AS (SELECT *, coalesce(lag(dir) OVER (PARTITION BY {L} ORDER BY t, seq), 0) AS p FROM x) SELECT {L}, t, seq, dir FROM y WHERE dir <> 0 AND dir <> p")
def w12(spark, sf):
    s = series(spark, sf).withColumn("dir", F.when(F.col("mid") > 100, 1).when(F.col("mid") < 10, -1).otherwise(0)).drop("mid")
    return detect.runs(s, LEG, "t", "seq")


@query("w13_rolling_median", f"WITH {O.BOOK_SQL}, x AS (SELECT sym, seq, CASE WHEN count(*) OVER w >= 20 THEN CAST(trunc(median(recv_us - event_us) OVER w) AS DOUBLE) END AS median FROM q WINDOW w AS (PARTITION BY sym ORDER BY recv_us, seq ROWS 199 PRECEDING)) SELECT * FROM x")
def w13(spark, sf):
    s = M.quotes(spark, sf).select("sym", "recv_us", "seq", (F.col("recv_us") - F.col("event_us")).alias("d"))
    return venues.rolling_median(s, ["sym"], "recv_us", "seq", "d").select("sym", "seq", F.col("median").cast("double").alias("median"))


@query("w13_stale_offset", f"WITH {O.BOOK_SQL}, x AS (SELECT sym, recv_us, seq, CASE WHEN count(*) OVER w >= 20 THEN CAST(trunc(median(recv_us - event_us) OVER w) AS BIGINT) END AS median FROM q WHERE inst = 'SPOT' WINDOW w AS (PARTITION BY sym ORDER BY recv_us, seq ROWS 199 PRECEDING)), y AS (SELECT p.seq, p.recv_us, (SELECT {{'at': x.recv_us, 'median': x.median}} FROM x WHERE x.sym = p.sym AND x.recv_us <= p.recv_us ORDER BY x.recv_us DESC, x.seq DESC LIMIT 1) AS o FROM q p WHERE p.inst = 'PERP') SELECT seq, CAST(CASE WHEN recv_us - o.at <= {3 * HOUR} THEN o.median END AS DOUBLE) AS offset_us FROM y")
def w13_stale(spark, sf):
    q = M.quotes(spark, sf).select("sym", "inst", "recv_us", "seq", (F.col("recv_us") - F.col("event_us")).alias("d"))
    medians = venues.rolling_median(q.where("inst = 'SPOT'"), ["sym"], "recv_us", "seq", "d")
    return venues.clock_offsets(q.where("inst = 'PERP'"), medians, ["sym"], 3 * HOUR).select("seq", F.col("offset_us").cast("double").alias("offset_us"))


@query("w14_change_only", f"WITH {O.BOOK_SQL}, x AS (SELECT seq, sym, round(bid) AS b1, lag(round(bid)) OVER w AS b0, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY {L} ORDER BY recv_us, seq)) SELECT seq, sym FROM x WHERE n = 1 OR b1 IS DISTINCT FROM b0 OR seq % 97 = 0")
def w14(spark, sf):
    b = M.book(spark, sf).withColumn("top", F.round("bid"))
    return venues.changed(b, LEG, "recv_us", "seq", ["top"], F.col("seq") % 97 == 0).select("seq", "sym")


# --- order, limits, sets ----------------------------------------------------------------------------------------------


@query("o1_sorted", f"WITH {O.BOOK_SQL} SELECT seq, row_number() OVER (ORDER BY recv_us, seq) AS place FROM q")
def o1(spark, sf):
    return relational.placed(M.quotes(spark, sf).select("seq", "recv_us"), "recv_us", ["recv_us", "seq"]).select("seq", F.col("place").cast("long").alias("place"))


@query("o2_recent", f"WITH {O.MOVES_SQL} SELECT seq, recv_us FROM mv ORDER BY recv_us DESC, seq DESC LIMIT 20")
def o2(spark, sf):
    return moves(spark, sf).select("seq", "recv_us").orderBy(F.desc("recv_us"), F.desc("seq")).limit(20)


@query("o3_top_by_size", f"WITH {O.MOVES_SQL} SELECT seq, {r6('move_bps')} FROM mv ORDER BY abs(mv.move_bps) DESC, seq LIMIT 10")
def o3(spark, sf):
    return moves(spark, sf).select("seq", "move_bps").orderBy(F.desc(F.abs("move_bps")), "seq").limit(10)


@query("o4_stalest_first", f"WITH {O.BOOK_SQL}, l AS (SELECT {L}, max(recv_us) AS last_us FROM q GROUP BY ALL) SELECT {L}, row_number() OVER (ORDER BY last_us, {L}) AS place FROM l")
def o4(spark, sf):
    legs = M.quotes(spark, sf).groupBy(*LEG).agg(F.max("recv_us").alias("last_us"))
    return legs.select(*LEG, F.row_number().over(Window.orderBy(F.desc_nulls_last(-F.col("last_us")), *LEG)).cast("long").alias("place"))


@query("o5_sorted_vector", f"WITH {O.BOOK_SQL} SELECT venue, inst, list_sort(list(seq))[3] AS third FROM q GROUP BY ALL")
def o5(spark, sf):
    q = M.quotes(spark, sf).select("venue", "inst", "seq")
    first = q.withColumn("no", F.row_number().over(Window.partitionBy("venue", "inst").orderBy("seq"))).where("no <= 3")  # cut before the shuffle
    return first.groupBy("venue", "inst").agg(F.max(F.when(F.col("no") == 3, F.col("seq"))).alias("third"))


@query("u1_append", f"WITH {O.BOOK_SQL} SELECT seq FROM q WHERE inst = 'SPOT' UNION ALL SELECT seq FROM q WHERE venue = 'V0'")
def u1(spark, sf):
    q = M.quotes(spark, sf)
    return q.where("inst = 'SPOT'").select("seq").unionByName(q.where("venue = 'V0'").select("seq"))


@query("u2_union_keys", f"WITH {O.MOVES_SQL}, {O.pairs(CFG)} SELECT sym, lead_venue AS venue, lead_inst AS inst FROM pm UNION SELECT sym, follow_venue, follow_inst FROM pm")
def u2(spark, sf):
    p = pairs.leg_pairs(moves(spark, sf), CFG.pair_mode)
    return p.select("sym", F.col("lead_venue").alias("venue"), F.col("lead_inst").alias("inst")).union(p.select("sym", "follow_venue", "follow_inst")).distinct()


@query("u3_multiset_difference", f"WITH {O.BOOK_SQL} SELECT sym, venue FROM q WHERE (sym, venue) NOT IN (SELECT (sym, venue) FROM q WHERE inst = 'PERP' AND ask - bid > 0.2)")
def u3(spark, sf):
    q = M.quotes(spark, sf)
    return relational.absent_from(q.select("sym", "venue"), q.where("inst = 'PERP' AND ask - bid > 0.2"), ["sym", "venue"])


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("f_normal_cdf", f"SELECT event_id AS seq, round({O.phi('(value / 50 - 4)')}, 6) AS p FROM events")
def f_cdf(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), S.normal_cdf(F.col("value") / 50 - 4).alias("p"))


@query("f_json_scalar", "SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f_json(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.from_json("props", "k long").k.alias("k"))


@query("f_clock_strings", f"WITH {O.BOOK_SQL} SELECT seq, strftime(make_timestamp(event_us), '%Y-%m-%d %H:%M:%S') AS at, upper(sym) || '/' || venue AS leg FROM q")
def f_strings(spark, sf):
    return M.quotes(spark, sf).select("seq", F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.concat_ws("/", F.upper("sym"), "venue").alias("leg"))


# --- statistics and scores --------------------------------------------------------------------------------------------

PM_COLS = f"{PAIR_COLS}, n_lead, n_follow, obs, {r6('obs_k', 'expected', 'excess', 'lag_sum_ms', 'avg_lag_ms', 'p_value')}"
SC_COLS = f"{L}, {r6('score', 'score_k', 'avg_lag_ms')}, n_events, {r6('p_value', 'ci_low', 'ci_high')}"


@query("m1_pair_matrix", f"WITH {O.MOVES_SQL}, {O.pairs(CFG)} SELECT {PM_COLS} FROM pm")
def m1(spark, sf):
    return pairs.pair_matrix(moves(spark, sf), CFG, None, None)


@query("m1_pair_matrix_all_legs", f"WITH {O.MOVES_SQL}, {BAND} SELECT {PM_COLS} FROM pm")
def m1_all(spark, sf):
    return pairs.pair_matrix(moves(spark, sf), CFG.with_(pair_mode="all"), None, None)


@query("m2_poisson_tail", f"WITH {O.MOVES_SQL}, {O.pairs(CFG.with_(pair_mode='crossInst'))} SELECT {PAIR_COLS}, obs, {r6('expected', 'p_value')} FROM pm")
def m2(spark, sf):
    return pairs.pair_matrix(moves(spark, sf), CFG.with_(pair_mode="crossInst"), None, None).select(*pairs.PAIR, "obs", "expected", "p_value")


_K, _N = "(user_id % 60)", "(user_id % 60 + event_id % 40)"
_SAFE = f"CAST(CASE WHEN {_N} > 0 THEN {_N} ELSE 1 END AS DOUBLE)"


@query("m3_sign_test", f"SELECT event_id AS seq, round(CASE WHEN {_N} > 0 THEN 2 * (1 - {O.phi(f'(greatest({O.d(0.0)}, abs({_K} - {_SAFE} / 2) - {O.d(0.5)}) / sqrt({_SAFE} / 4))')}) ELSE 1 END, 6) AS p FROM events")
def m3(spark, sf):
    k = F.col("user_id") % 60
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), S.sign_test(k, k + F.col("event_id") % 40).alias("p"))


_Z2 = f"({O.d(1.959964)} * {O.d(1.959964)})"
_P, _DEN = f"({_K} / {_SAFE})", f"(1 + {_Z2} / {_SAFE})"


@query("m4_wilson", f"SELECT event_id AS seq, round(CASE WHEN {_N} > 0 THEN ({_P} + {_Z2} / (2 * {_SAFE})) / {_DEN} - {O.d(1.959964)} / {_DEN} * sqrt({_P} * (1 - {_P}) / {_SAFE} + {_Z2} / (4 * {_SAFE} * {_SAFE})) ELSE 0 END, 6) + CAST(0 AS DOUBLE) AS lo, round(CASE WHEN {_N} > 0 THEN ({_P} + {_Z2} / (2 * {_SAFE})) / {_DEN} + {O.d(1.959964)} / {_DEN} * sqrt({_P} * (1 - {_P}) / {_SAFE} + {_Z2} / (4 * {_SAFE} * {_SAFE})) ELSE 1 END, 6) + CAST(0 AS DOUBLE) AS hi FROM events")
def m4(spark, sf):
    k = F.col("user_id") % 60
    lo, hi = S.wilson(k, k + F.col("event_id") % 40, CFG.z)
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), lo.alias("lo"), hi.alias("hi"))


@query("m5_leg_score", f"WITH {O.MOVES_SQL}, {O.pairs(CFG)}, {O.scores(CFG.z)} SELECT {SC_COLS} FROM sc")
def m5(spark, sf):
    return score.leg_scores(pairs.pair_matrix(moves(spark, sf), CFG, None, None), CFG.z)


@query("m6_windowed_score", f"WITH {O.MOVES_SQL}, {O.pairs(CFG, where=f'recv_us BETWEEN {END - CFG.score_window} AND {END}')}, {O.scores(CFG.z)} SELECT {SC_COLS} FROM sc")
def m6(spark, sf):
    return score.windowed_score(moves(spark, sf), CFG, END)


@query("m7_session_score", f"WITH {O.MOVES_SQL}, {O.pairs(CFG, where=f'recv_us BETWEEN {END - CFG.session_window} AND {END}')}, {O.scores(CFG.z)} SELECT {SC_COLS} FROM sc")
def m7(spark, sf):
    return score.session_score(moves(spark, sf), CFG, END)


_TCFG = CFG.with_(follow_window=240 * HOUR, dead_band=24 * HOUR)
_TMOVES = f"{O.TRADES_SQL}, td AS (SELECT *, lag(px) OVER (PARTITION BY {L} ORDER BY recv_us, seq) AS prev FROM t), tm AS (SELECT {L}, event_us, recv_us, seq, CASE WHEN px > prev THEN 'up' ELSE 'down' END AS direction FROM td WHERE abs(10000 * (px - prev) / prev) >= 4000)"


@query("m8_trade_score", f"WITH {_TMOVES}, {O.pairs(_TCFG, moves='tm', dead=48 * HOUR)}, {O.scores(CFG.z)} SELECT {SC_COLS} FROM sc")
def m8(spark, sf):
    t = M.trades(spark, sf).withColumnRenamed("px", "mid")
    m = detect.tickwise(t, _TCFG.with_(threshold_bps=4000.0))
    return score.leg_scores(pairs.pair_matrix(m, _TCFG, None, None, 48 * HOUR), CFG.z)


REGIME_SQL = f"""rw AS (SELECT *, lag(mid) OVER (PARTITION BY {L} ORDER BY recv_us, seq) AS pm_ FROM q WHERE recv_us BETWEEN {END - CFG.regime_window} AND {END}),
rl AS (SELECT {L}, arg_max(10000 * (ask - bid) / mid, (recv_us - 1704067200000000) * 100000 + seq % 100000) AS spread_bps, coalesce(sqrt(sum((10000 * (mid - pm_) / pm_) * (10000 * (mid - pm_) / pm_))), 0) AS vol_bps FROM rw GROUP BY ALL),
rg AS (SELECT {L}, spread_bps, vol_bps, CASE WHEN spread_bps <= 5 THEN 'tight' WHEN spread_bps <= 10 THEN 'normal' ELSE 'wide' END || '_' || CASE WHEN vol_bps <= 500000 THEN 'low' ELSE 'high' END AS regime_bucket FROM rl)"""
RCFG = CFG.with_(tight_bps=5.0, wide_bps=10.0, low_vol_bps=500000.0)


@query("m9_stamped_score", f"WITH {O.MOVES_SQL}, {O.pairs(CFG, where=f'recv_us BETWEEN {MID} AND {END}')}, {O.scores(CFG.z)}, {REGIME_SQL} SELECT {', '.join('sc.' + c for c in LEG)}, {r6('score')}, n_events, regime_bucket FROM sc LEFT JOIN rg USING ({L})")
def m9(spark, sf):
    r = monitor.regimes(M.quotes(spark, sf), RCFG, END)
    return score.stamped_score(moves(spark, sf), r, CFG, MID, END).select(*LEG, "score", "n_events", "regime_bucket")


@query("m10_events", f"WITH RECURSIVE {O.MOVES_SQL}, {MATCH_SQL}, {COOL_SQL} SELECT {MATCH_COLS.replace('ts,', 'jm.ts,', 1)} FROM jm JOIN (SELECT * FROM cf WHERE kept) k USING ({', '.join(match.DIRECTED)}, ts)")
def m10(spark, sf):
    return match.events(moves(spark, sf), CFG)


SKEW_SQL = f"""sk AS (SELECT venue, inst, recv_us - event_us AS diff FROM q WHERE recv_us >= (SELECT max(recv_us) FROM q) - {CFG.skew_window} AND recv_us <> event_us),
ss AS (SELECT venue, inst, list_sort(list(diff))[1 + CAST(floor(0.05 * (count(*) - 1)) AS INT)] AS lo, list_sort(list(diff))[1 + CAST(floor(0.95 * (count(*) - 1)) AS INT)] AS hi, count(*) AS n FROM sk GROUP BY ALL HAVING count(*) >= 50)"""


def samples(spark, sf):
    return M.quotes(spark, sf).withColumn("diff_us", F.col("recv_us") - F.col("event_us"))


@query("m11_clock_skew", f"WITH {O.BOOK_SQL}, {SKEW_SQL} SELECT venue, inst, lo AS offset_us, hi - lo AS jitter_us, n FROM ss")
def m11(spark, sf):
    return monitor.skew_stats(samples(spark, sf), CFG)


@query("m12_dead_band", f"WITH {O.BOOK_SQL}, {SKEW_SQL} SELECT CAST(round(sqrt(2) * max(hi - lo)) AS BIGINT) AS measured_us, greatest(100000, CAST(round(sqrt(2) * max(hi - lo)) AS BIGINT)) AS dead_band_us FROM ss")
def m12(spark, sf):
    return monitor.dead_band(monitor.skew_stats(samples(spark, sf), CFG), CFG.with_(dead_band=100_000, dead_band_mode="auto"))


@query("m13_calibrated_clock", f"WITH {O.MOVES_SQL}, {SKEW_SQL} SELECT seq, event_us + coalesce(lo, 0) AS cal_us FROM mv LEFT JOIN ss USING (venue, inst)")
def m13(spark, sf):
    return monitor.calibrated(moves(spark, sf), monitor.skew_stats(samples(spark, sf), CFG)).select("seq", "cal_us")


@query("m14_regime", f"WITH {O.BOOK_SQL}, {REGIME_SQL} SELECT {L}, round(spread_bps, 6) AS spread_bps, round(vol_bps, 4) AS vol_bps, regime_bucket FROM rg")
def m14(spark, sf):
    return monitor.regimes(M.quotes(spark, sf), RCFG, END).withColumn("vol_bps", F.round("vol_bps", 4))


@query("m15_stale_alerts", f"WITH {O.MOVES_SQL}, {STALE_SQL} SELECT DISTINCT * FROM st WHERE NOT (venue = 'V0' AND msg LIKE 'V1%')")
def m15(spark, sf):
    found = monitor.stale_followers(moves(spark, sf), M.quotes(spark, sf), CFG, MID, END)
    sent = found.where("venue = 'V0' AND msg LIKE 'V1%'").withColumn("ts", F.col("ts") - F.lit(CFG.alert_cooldown // 2))
    return monitor.new_alerts(found, sent, CFG, END)


# --- health -------------------------------------------------------------------------------------------------------------

HEALTH_SQL = f"""hv AS (SELECT *, coalesce(bid < ask, false) AS valid FROM b WHERE recv_us <= {END}), hl AS (SELECT {L}, max(recv_us) AS last_us FROM hv WHERE valid GROUP BY ALL),
hc AS (SELECT {L}, CAST(count_if(valid) AS BIGINT) AS a, CAST(count_if(NOT valid) AS BIGINT) AS r FROM hv WHERE recv_us >= {END - CFG.health_window} GROUP BY ALL),
hq AS (SELECT * FROM q WHERE recv_us <= {END}), hf AS (SELECT venue, inst, avg(CASE WHEN recv_us = event_us THEN 1.0 ELSE 0.0 END) AS fallback_share, count(*) AS n_skew FROM hq WHERE recv_us >= (SELECT max(recv_us) FROM hq) - {CFG.skew_window} GROUP BY ALL),
hk AS (SELECT venue, inst, recv_us - event_us AS diff FROM hq WHERE recv_us >= (SELECT max(recv_us) FROM hq) - {CFG.skew_window} AND recv_us <> event_us),
hs AS (SELECT venue, inst, list_sort(list(diff))[1 + CAST(floor(0.05 * (count(*) - 1)) AS INT)] AS lo, list_sort(list(diff))[1 + CAST(floor(0.95 * (count(*) - 1)) AS INT)] AS hi FROM hk GROUP BY ALL HAVING count(*) >= 50),
hh AS (SELECT {L}, ({END} - last_us) / 1000 AS last_tick_age_ms, coalesce(a, 0) / {CFG.health_window / 60_000_000} AS ticks_per_min, coalesce(a, 0) AS n_accepted, coalesce(r, 0) AS n_rejected, CASE WHEN coalesce(a, 0) + coalesce(r, 0) > 0 THEN r / (a + r) END AS invalid_share,
  lo / 1000 AS one_way_floor_ms, (hi - lo) / 1000 AS one_way_jitter_ms, fallback_share, coalesce(n_skew, 0) AS n_skew FROM hl LEFT JOIN hc USING ({L}) LEFT JOIN hf USING (venue, inst) LEFT JOIN hs USING (venue, inst)),
ha AS (SELECT {L}, 'feedstale' AS alert_type FROM hh WHERE last_tick_age_ms > {CFG.quiet / 1000} UNION ALL SELECT {L}, 'invalid' FROM hh WHERE invalid_share > 0.05 AND n_accepted + n_rejected >= 5 UNION ALL SELECT DISTINCT NULL, venue, inst, 'clockfallback' FROM hh WHERE fallback_share > 0.03 AND n_skew >= 50)"""
HCFG = CFG.with_(invalid_min=5, fallback_share=0.03)


def health(spark, sf, now=END):
    rows = M.book(spark, sf).withColumn("valid", E.valid_book(F.col("bid"), F.col("ask")))
    return monitor.feed_health(rows, samples(spark, sf), HCFG, now)


@query("h1_feed_health", f"WITH {O.BOOK_SQL}, {HEALTH_SQL} SELECT {L}, {r6('last_tick_age_ms', 'ticks_per_min')}, n_accepted, n_rejected, {r6('invalid_share', 'one_way_floor_ms', 'one_way_jitter_ms', 'fallback_share')}, n_skew FROM hh")
def h1(spark, sf):
    return health(spark, sf)


@query("h3_conditions", f"WITH {O.BOOK_SQL}, {HEALTH_SQL} SELECT * FROM ha")
def h3(spark, sf):
    return monitor.health_conditions(health(spark, sf), HCFG)


@query("h4_edges", f"""WITH {O.BOOK_SQL}, ev AS (SELECT {MID} + i * {12 * HOUR} AS ts, i FROM range(0, 10) r(i)), act AS (SELECT DISTINCT ts, i, sym, venue, inst FROM ev, (SELECT DISTINCT {L} FROM q) l WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.sym = l.sym AND q.venue = l.venue AND q.inst = l.inst AND q.recv_us BETWEEN ts - {3 * HOUR} AND ts))
SELECT ts, {L}, 'feedstale' AS alert_type, 'onset' AS edge FROM act a WHERE NOT EXISTS (SELECT 1 FROM act p WHERE p.i = a.i - 1 AND p.sym = a.sym AND p.venue = a.venue AND p.inst = a.inst)
UNION ALL SELECT n.ts, a.sym, a.venue, a.inst, 'feedstale', 'recovery' FROM act a JOIN ev n ON n.i = a.i + 1 WHERE NOT EXISTS (SELECT 1 FROM act p WHERE p.i = a.i + 1 AND p.sym = a.sym AND p.venue = a.venue AND p.inst = a.inst)""")
def h4(spark, sf):
    q = M.quotes(spark, sf)
    times = spark.range(10).select((F.lit(MID) + F.col("id") * 12 * HOUR).alias("ts"))
    quiet = monitor.silent_legs(q, times, 3 * HOUR)
    return monitor.edges(quiet.withColumn("alert_type", F.lit("feedstale")), times)


@query("a13_venue_rollup", f"WITH {O.BOOK_SQL}, {HEALTH_SQL} SELECT venue, round(sum(ticks_per_min), 6) AS ticks_per_min, round(max(last_tick_age_ms), 6) AS max_age_ms, round(max(invalid_share), 6) AS max_invalid_share FROM hh GROUP BY 1")
def a13(spark, sf):
    return monitor.venue_rollup(health(spark, sf))


@query("q2_leg_freshness", f"WITH {O.BOOK_SQL} SELECT {L}, round(({END + 30 * 24 * HOUR} - max(recv_us)) / 1000, 6) AS age_ms, round(arg_max(mid, (recv_us - 1704067200000000) * 100000 + seq % 100000), 6) AS mid FROM q GROUP BY ALL")
def q2(spark, sf):
    return monitor.leg_freshness(M.quotes(spark, sf), END + 30 * 24 * HOUR)


@query("q3_scored_legs", f"WITH {O.MOVES_SQL}, {O.pairs(CFG, where=f'recv_us BETWEEN {END - 6 * HOUR} AND {END}')}, {O.scores(CFG.z)} SELECT {L}, {r6('score')} FROM sc WHERE score IS NOT NULL")
def q3(spark, sf):
    return score.windowed_score(moves(spark, sf), CFG.with_(score_window=6 * HOUR), END).where("score IS NOT NULL").select(*LEG, "score")


# --- recalibration --------------------------------------------------------------------------------------------------------


@query("c1_c3_calibrate")
def c3(spark, sf):
    return recal.calibrate(M.quotes(spark, sf), CFG.with_(recal_rate=1.0))


_C_SRC = f"{O.BOOK_SQL}, src AS (SELECT sym, recv_us, seq, event_us AS et, mid AS v, (ask - bid) / mid * 10000 AS spread FROM q)"


@query("c1_move_rate", f"{_winreset_sql(f'{O.BOOK_SQL}, src AS (SELECT sym, event_us AS t, seq, mid AS v FROM q)', ['sym'], 2.0, CFG.move_window).rsplit('SELECT', 1)[0]} SELECT sym, count(*) FILTER (dir <> 0) AS fired, count(*) AS n FROM fold GROUP BY sym")
def c1(spark, sf):
    # events come in the order of their clock here, so that both sides fold alike
    q = M.quotes(spark, sf).withColumn("recv_us", F.col("event_us"))
    counts = {k: v[1] for k, v in recal.move_rates(q, {r["sym"]: [50000.0, 20000.0, 10000.0] for r in q.select("sym").distinct().collect()}, CFG).items()}
    return q.groupBy("sym").agg(F.count("*").alias("n")).withColumn("fired", E.lookup(counts, F.col("sym"), F.lit(0)).cast("long"))


@query("c2_unit", f"WITH {_C_SRC}, x AS (SELECT *, ln(v / lag(v) OVER (PARTITION BY sym ORDER BY recv_us, seq)) AS step FROM src), f AS (SELECT sym, first(et ORDER BY recv_us, seq) AS a, last(et ORDER BY recv_us, seq) AS b FROM src GROUP BY sym) SELECT sym, count(*) AS n, round((any_value(b) - any_value(a)) / {HOUR}, 6) AS span_hours, round(greatest(median(spread), 10000 * stddev_pop(step)), 6) AS unit FROM x JOIN f USING (sym) GROUP BY sym")
def c2(spark, sf):
    return recal.unit_bps(M.quotes(spark, sf), CFG)


_GATE = "CASE WHEN n IS NULL OR n = 0 THEN 'SKIP_NODATA' WHEN n < 300 OR span_hours < 0.5 THEN 'SKIP_THIN' WHEN NOT bps BETWEEN 0.1 AND 100 THEN 'SKIP_BOUNDS' WHEN floored THEN 'OK_FLOORED' ELSE 'OK' END"


@query("c4_gating", f"WITH {O.BOOK_SQL}, x AS (SELECT {L}, count(*) AS n, (max(recv_us) - min(recv_us)) / {HOUR} AS span_hours, max(mid) / 4 AS bps, min(mid) < 0.1 AS floored FROM q GROUP BY ALL) SELECT {L}, {_GATE} AS status FROM x")
def c4(spark, sf):
    x = M.quotes(spark, sf).groupBy(*LEG).agg(F.count("*").alias("n"), ((F.max("recv_us") - F.min("recv_us")) / HOUR).alias("span_hours"), (F.max("mid") / 4).alias("bps"), (F.min("mid") < 0.1).alias("floored"))
    return x.select(*LEG, recal.gate(F.col("n"), F.col("span_hours"), F.col("bps"), F.col("floored"), CFG.with_(recal_min_ticks=300)).alias("status"))


@query("c5_recal_series", f"WITH {O.BOOK_SQL} SELECT sym, count(*) AS n, round(median((ask - bid) / mid * 10000), 6) AS spread_bps, min(event_us) AS first_us FROM q WHERE recv_us >= {MID} GROUP BY 1")
def c5(spark, sf):
    q = sinks.retained(M.quotes(spark, sf), "recv_us", MID, 0)
    q = q.withColumn("spread", (F.col("ask") - F.col("bid")) / F.col("mid") * 10000)
    return q.groupBy("sym").agg(F.count("*").alias("n"), F.min("event_us").alias("first_us")).join(relational.medians(q, ["sym"], "spread", "spread_bps"), "sym")


@query("snk6_retention", f"WITH {O.BOOK_SQL} SELECT seq FROM q WHERE recv_us >= {END} - {24 * HOUR}")
def snk6(spark, sf):
    return sinks.retained(M.quotes(spark, sf), "recv_us", END, 24 * HOUR).select("seq")


@query("src5_pushdown_pull", f"WITH {O.TRADES_SQL} SELECT venue, max(recv_us) AS last_us, count(*) AS n FROM t WHERE venue IN ('V0', 'V1') AND recv_us >= 946684800000000 GROUP BY 1")
def src5(spark, sf):
    return M.trades(spark, sf).where(F.col("venue").isin("V0", "V1") & (F.col("recv_us") >= 946684800000000)).groupBy("venue").agg(F.max("recv_us").alias("last_us"), F.count("*").alias("n"))


# --- books and sequences ----------------------------------------------------------------------------------------------------


def deltas(spark, sf):
    """Events as depth updates, some with holes, some seen before; every 23rd is a snapshot."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    first = i + F.when(i % 13 == 0, 3).when(i % 17 == 0, -4).otherwise(0)
    last = i + F.when(i % 23 == 0, 2).when(i % 17 == 0, -2).otherwise(25)
    return e.select(F.col("event_type").alias("sym"), F.lit(0).cast("long").alias("recv_us"), i.alias("seq"), F.when(i % 23 == 0, "snapshot").otherwise("delta").alias("kind"), first.alias("first_u"), last.alias("last_u"), F.when(i % 7 != 0, F.lag(last).over(Window.partitionBy("event_type").orderBy("event_id")) - F.when(i % 19 == 0, 40).otherwise(0)).alias("prev_u"))


def _followed_sql(perp: bool) -> str:
    """The rules as a recursion: state (last, bridged, waiting updates); waiting ones are reduced when a snapshot comes."""

    def rule(last: str, bridged: str, e: str) -> str:
        steady = f"CASE WHEN {e}.l < {last} THEN 'stale' WHEN {e}.f > {last} + 1 THEN 'gap' ELSE 'ok' END"
        if not perp:
            return steady
        named = f"CASE WHEN {e}.l <= {last} THEN 'stale' WHEN {e}.p IS NOT NULL AND {e}.p <> -1 AND {e}.p <> {last} THEN 'gap' ELSE 'ok' END"
        bridge = f"CASE WHEN {e}.l < {last} + 1 THEN 'stale' WHEN {e}.f <= {last} + 1 THEN 'ok' ELSE 'gap' END"
        return f"CASE WHEN {bridged} THEN {named} ELSE {bridge} END"

    none = "CAST([] AS STRUCT(f BIGINT, l BIGINT, p BIGINT)[])"
    event = "{'f': r.f, 'l': r.l, 'p': r.p}"
    seen = rule("a.last", "a.bridged", "x")
    outcome = seen.replace("x.", "y.held[1].")
    reduced = f"list_reduce(list_transform(list_filter(s.held, lambda h: h.l > r.l), lambda h: {{'last': CAST(NULL AS BIGINT), 'bridged': false, 'bad': false, 'held': [h]}}), lambda a, y: CASE WHEN a.bad THEN a WHEN {outcome} = 'ok' THEN {{'last': y.held[1].l, 'bridged': true, 'bad': false, 'held': {none}}} WHEN {outcome} = 'gap' THEN {{'last': CAST(NULL AS BIGINT), 'bridged': false, 'bad': true, 'held': y.held}} ELSE a END, {{'last': r.l, 'bridged': false, 'bad': false, 'held': {none}}})"
    return f"""
WITH RECURSIVE src AS (
  SELECT event_type AS sym, event_id AS seq, event_id % 23 = 0 AS snap, event_id + CASE WHEN event_id % 13 = 0 THEN 3 WHEN event_id % 17 = 0 THEN -4 ELSE 0 END AS f,
    event_id + CASE WHEN event_id % 23 = 0 THEN 2 WHEN event_id % 17 = 0 THEN -2 ELSE 25 END AS l FROM events
), nr AS (
  SELECT *, CASE WHEN seq % 7 <> 0 THEN lag(l) OVER w - CASE WHEN seq % 19 = 0 THEN 40 ELSE 0 END END AS p, row_number() OVER w AS no FROM src WINDOW w AS (PARTITION BY sym ORDER BY seq)
), fold AS (
  SELECT sym, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS last, false AS bridged, {none} AS held, '' AS state FROM (SELECT DISTINCT sym FROM nr)
  UNION ALL
  SELECT sym, no, seq,
    CASE WHEN state = 'ok' THEN l WHEN state = 'gap' THEN NULL WHEN state = 'synced' THEN acc.last ELSE last END,
    CASE WHEN state = 'ok' THEN true WHEN state = 'gap' THEN false WHEN state = 'synced' THEN acc.bridged ELSE bridged END,
    CASE WHEN state = 'gap' THEN CASE WHEN snap THEN acc.held ELSE [e] END WHEN state = 'waiting' THEN list_append(held, e) WHEN state IN ('synced', 'ok') THEN {none} ELSE held END,
    state
  FROM (
    SELECT *, CASE WHEN NOT snap THEN CASE WHEN last IS NULL THEN 'waiting' ELSE {rule('last', 'bridged', 'e')} END
      WHEN last IS NOT NULL THEN 'unused' WHEN len(held) = 0 OR l < held[1].f THEN 'early' WHEN acc.bad THEN 'gap' ELSE 'synced' END AS state
    FROM (SELECT r.sym, r.no, r.seq, r.snap, r.l, {event} AS e, s.last, s.bridged, s.held, {reduced} AS acc FROM fold s JOIN nr r ON r.sym = s.sym AND r.no = s.no + 1)
  )
)
SELECT seq, state FROM fold WHERE no > 0"""


@query("str8_spot_gaps", _followed_sql(False))
def str8(spark, sf):
    return venues.spot_gaps(deltas(spark, sf), ["sym"]).select("seq", "state")


@query("str9_perp_gaps", _followed_sql(True))
def str9(spark, sf):
    return venues.perp_gaps(deltas(spark, sf), ["sym"]).select("seq", "state")


@query("str7_book_top", "WITH RECURSIVE e AS (SELECT event_type AS sym, event_id AS seq, event_id % 2 = 0 AS buy, CASE WHEN event_id % 2 = 0 THEN 100 - event_id // 2 % 5 ELSE 101 + event_id // 2 % 5 END AS px, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 9 + 1 END AS qty FROM events), lv AS (SELECT *, lead(seq, 1, CAST(1099511627776 AS BIGINT)) OVER (PARTITION BY sym, buy, px ORDER BY seq) AS until FROM e), tk AS (SELECT sym, seq, row_number() OVER (PARTITION BY sym ORDER BY seq) AS no FROM e), tp AS (SELECT t.sym, t.seq, t.no, max(px) FILTER (buy) AS bid, arg_max(qty, px) FILTER (buy) AS bidsz, min(px) FILTER (NOT buy) AS ask, arg_min(qty, px) FILTER (NOT buy) AS asksz FROM tk t JOIN lv l ON l.sym = t.sym AND l.seq <= t.seq AND t.seq < l.until AND l.qty > 0 GROUP BY ALL), ok AS (SELECT *, lag((bid, bidsz, ask, asksz)) OVER (PARTITION BY sym ORDER BY seq) AS p FROM tp WHERE bid IS NOT NULL AND ask IS NOT NULL) SELECT sym, seq, bid::DOUBLE AS bid, bidsz::DOUBLE AS bidsz, ask::DOUBLE AS ask, asksz::DOUBLE AS asksz FROM ok WHERE p IS DISTINCT FROM (bid, bidsz, ask, asksz)")
def str7(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i, half = F.col("event_id"), F.floor(F.col("event_id") / 2)
    level = F.struct(F.when(i % 2 == 0, "buy").otherwise("sell").alias("side"), F.when(i % 2 == 0, 100 - half % 5).otherwise(101 + half % 5).cast("double").alias("px"), F.when(i % 7 == 0, 0).otherwise(i % 9 + 1).cast("double").alias("qty"))
    first = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) == 1
    rows = e.select(F.col("event_type").alias("sym"), F.lit(0).cast("long").alias("recv_us"), i.alias("seq"), F.when(first, "snapshot").otherwise("l2update").alias("kind"), F.lit(0).cast("long").alias("exch_us"), F.to_json(F.array(level)).alias("levels"))
    return venues.best_quotes(rows).select("sym", "seq", "bid", "bidsz", "ask", "asksz")


def messages(spark, sf):
    """Trades as messages of the venues: V0 names the taker, V1 the maker, V2 whether the buyer made."""
    t = M.trades(spark, sf)
    text = lambda c: F.col(c).cast("string")
    buy = F.when(F.col("side") == "B", "buy").otherwise("sell")
    ms = F.floor(F.col("event_us") / 1000).cast("string")
    taker = F.to_json(F.struct(F.struct(F.lit("trades").alias("channel"), F.col("sym").alias("instId")).alias("arg"), F.array(F.struct(F.col("sym").alias("instId"), text("seq").alias("tradeId"), text("px").alias("px"), text("qty").alias("sz"), buy.alias("side"), F.when(F.col("seq") % 11 == 0, "n/a").otherwise(ms).alias("ts"))).alias("data")))
    iso = F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    maker = F.to_json(F.struct(F.lit("match").alias("type"), F.col("sym").alias("product_id"), F.col("seq").alias("trade_id"), buy.alias("side"), text("qty").alias("size"), text("px").alias("price"), F.when(F.col("seq") % 11 != 0, iso).alias("time")))
    flag = F.to_json(F.struct(F.lit("trade").alias("e"), F.floor(F.col("event_us") / 1000).alias("E"), F.col("sym").alias("s"), text("px").alias("p"), text("qty").alias("q"), (F.col("side") == "B").alias("m"), F.floor(F.col("event_us") / 1000).alias("T"), F.col("seq").alias("t")))
    of = lambda venue, json: t.where(F.col("venue") == venue).select((F.col("recv_us") + 5).alias("recv_us"), json.alias("json"))
    return of("V0", taker), of("V1", maker), of("V2", flag)


@query("str11_trade_side", f"WITH {O.TRADES_SQL} SELECT venue, CASE WHEN venue IN ('V1', 'V2') THEN CASE side WHEN 'B' THEN 'S' ELSE 'B' END ELSE side END AS side, count(*) AS n, CAST(sum(seq) AS BIGINT) AS ids FROM t GROUP BY ALL")
def str11(spark, sf):
    taker, maker, flag = messages(spark, sf)
    parsed = [venues.okx_trades(taker).withColumn("venue", F.lit("V0")), venues.coinbase_trades(maker).withColumn("venue", F.lit("V1")), venues.binance_trades(flag).withColumn("venue", F.lit("V2"))]
    rows = parsed[0].unionByName(parsed[1]).unionByName(parsed[2])
    return rows.groupBy("venue", "side").agg(F.count("*").alias("n"), F.sum("tid").alias("ids"))


@query("str12_time_fallback", f"WITH {O.TRADES_SQL} SELECT seq, CASE WHEN seq % 11 = 0 AND venue <> 'V2' THEN recv_us + 5 ELSE event_us END AS exch_us FROM t")
def str12(spark, sf):
    taker, maker, flag = messages(spark, sf)
    rows = venues.okx_trades(taker).unionByName(venues.coinbase_trades(maker)).unionByName(venues.binance_trades(flag))
    return rows.select(F.col("tid").alias("seq"), "exch_us")


@query("f_array", f"WITH {O.BOOK_SQL}, x AS (SELECT seq, list_sort([bid, mid, ask, 50.0, 100.0]) AS v FROM q) SELECT seq, CAST(len(list_filter(v, lambda y: y <= 75)) AS INTEGER) AS below, round(v[1], 6) AS least, round(list_concat(v, [1.5])[6], 6) AS last FROM x")
def f_array(spark, sf):
    v = F.array_sort(F.array("bid", "mid", "ask", F.lit(50.0), F.lit(100.0)))
    q = M.quotes(spark, sf).select("seq", v.alias("v"))
    return q.select("seq", F.size(F.filter("v", lambda y: y <= 75)).alias("below"), F.element_at("v", 1).alias("least"), F.element_at(F.concat("v", F.array(F.lit(1.5))), 6).alias("last"))


@query("f_time_texts", "SELECT event_id AS seq, epoch_us(ts) // 1000 * 1000 AS from_ms, epoch_us(ts) AS from_iso FROM events")
def f_time_texts(spark, sf):
    ts = F.col("ts").cast("timestamp")
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), F.unix_millis(ts).cast("string").alias("ms"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"))
    return e.select("seq", venues.micros_from_ms(F.col("ms")).alias("from_ms"), venues.micros_from_iso(F.col("iso")).alias("from_iso"))
