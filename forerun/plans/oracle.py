"""SQL fragments (DuckDB dialect) that restate the engine's operators independently of its plans."""

from __future__ import annotations

from ..config import Config
from ..functions.stats import NORMAL_B, NORMAL_P
from ..sources.mapping import BOOK_SQL, TRADES_SQL


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def phi(x: str) -> str:
    t = f"(1 / (1 + {d(NORMAL_P)} * abs({x})))"
    poly = d(0.0)
    for b in reversed(NORMAL_B):
        poly = f"(({poly} + {d(b)}) * {t})"
    upper = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly})"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {upper} ELSE {upper} END)"


def comparable(mode: str, a: str, b: str) -> str:
    return {
        "crossVenue": f"({a}.inst = {b}.inst AND {a}.venue <> {b}.venue)",
        "crossInst": f"({a}.venue = {b}.venue AND {a}.inst <> {b}.inst)",
        "both": f"(({a}.venue <> {b}.venue) <> ({a}.inst <> {b}.inst))",
        "all": f"({a}.venue <> {b}.venue OR {a}.inst <> {b}.inst)",
    }[mode]


#: Moves of one tick to the next, 2 basis points, in receive order.
MOVES_SQL = f"""
{BOOK_SQL}, mv0 AS (SELECT *, lag(mid) OVER (PARTITION BY sym, venue, inst ORDER BY recv_us, seq) AS prev FROM q),
mv AS (SELECT sym, venue, inst, event_us, recv_us, seq, mid, 10000 * (mid - prev) / prev AS move_bps, CASE WHEN mid > prev THEN 'up' ELSE 'down' END AS direction
  FROM mv0 WHERE abs(10000 * (mid - prev) / prev) >= 2)
"""


def pairs(cfg: Config, moves: str = "mv", where: str = "true", dead: int | None = None, clock: str = "event_us") -> str:
    dead = cfg.dead_band if dead is None else dead
    w, width = cfg.follow_window, max(0, cfg.follow_window - dead)
    return f"""
w AS (SELECT *, {clock} AS clk FROM {moves} WHERE {where}),
span AS (SELECT greatest(1, max(clk) - min(clk)) AS span FROM w),
leg AS (SELECT sym, venue, inst, direction, count(*) AS n FROM w GROUP BY ALL),
pr AS (SELECT a.sym, a.direction, a.venue AS lead_venue, a.inst AS lead_inst, b.venue AS follow_venue, b.inst AS follow_inst, a.n AS n_lead, b.n AS n_follow
  FROM leg a JOIN leg b ON a.sym = b.sym AND a.direction = b.direction AND {comparable(cfg.pair_mode, "a", "b")}),
hit AS (SELECT a.sym, a.direction, a.venue AS lead_venue, a.inst AS lead_inst, b.venue AS follow_venue, b.inst AS follow_inst, count(*) AS obs, sum(b.clk - a.clk) AS lag_us
  FROM w a JOIN w b ON a.sym = b.sym AND a.direction = b.direction AND {comparable(cfg.pair_mode, "a", "b")} AND b.clk - a.clk BETWEEN {dead} AND {w} GROUP BY ALL),
pm0 AS (SELECT pr.*, coalesce(obs, 0) AS obs, coalesce(lag_us, 0) AS lag_us, n_follow * (n_lead / span) * {width} AS expected
  FROM pr LEFT JOIN hit USING (sym, direction, lead_venue, lead_inst, follow_venue, follow_inst), span),
pm AS (SELECT sym, direction, lead_venue, lead_inst, follow_venue, follow_inst, n_lead, n_follow, CAST(obs AS BIGINT) AS obs, obs - lag_us / {w} AS obs_k, expected, obs - expected AS excess,
  lag_us / 1000 AS lag_sum_ms, CASE WHEN obs > 0 THEN lag_us / obs / 1000 END AS avg_lag_ms,
  CASE WHEN expected > 0 THEN {phi("((expected - obs) / sqrt(CASE WHEN expected > 0 THEN expected ELSE 1 END))")} ELSE 1 END AS p_value FROM pm0)
"""


def scores(z: float, source: str = "pm") -> str:
    n = "(lo + fo)"
    safe = f"CAST(CASE WHEN {n} > 0 THEN {n} ELSE 1 END AS DOUBLE)"
    dd = f"greatest({d(0.0)}, abs(lo - {safe} / 2) - {d(0.5)})"
    p = f"(lo / {safe})"
    den = f"(1 + {d(z)} * {d(z)} / {safe})"
    centre = f"(({p} + {d(z)} * {d(z)} / (2 * {safe})) / {den})"
    half = f"({d(z)} / {den} * sqrt({p} * (1 - {p}) / {safe} + {d(z)} * {d(z)} / (4 * {safe} * {safe})))"
    return f"""
sd AS (SELECT sym, lead_venue AS venue, lead_inst AS inst, excess AS le, obs AS lo, obs_k AS lk, 0 AS fe, 0 AS fo, 0 AS fk, lag_sum_ms AS lg FROM {source}
  UNION ALL SELECT sym, follow_venue, follow_inst, 0, 0, 0, excess, obs, obs_k, 0 FROM {source}),
sl AS (SELECT sym, venue, inst, sum(le) AS le, sum(lo) AS lo, sum(lk) AS lk, sum(fe) AS fe, sum(fo) AS fo, sum(fk) AS fk, sum(lg) AS lg FROM sd GROUP BY ALL),
sc AS (SELECT sym, venue, inst, CASE WHEN {n} <> 0 THEN (le - fe) / {n} END AS score, CASE WHEN lk + fk <> 0 THEN (lk - fk) / (lk + fk) END AS score_k, CASE WHEN lo <> 0 THEN lg / lo END AS avg_lag_ms,
  CAST({n} AS BIGINT) AS n_events, CASE WHEN {n} > 0 THEN 2 * (1 - {phi(f"({dd} / sqrt({safe} / 4))")}) ELSE 1 END AS p_value,
  CASE WHEN {n} > 0 THEN 2 * ({centre} - {half}) - 1 ELSE -1 END AS ci_low, CASE WHEN {n} > 0 THEN 2 * ({centre} + {half}) - 1 ELSE 1 END AS ci_high FROM sl)
"""


def fold_sql(series: str, keys: list[str], order: str, init: str, state: dict[str, str], fired: str, out: str) -> str:
    """A recursive scan: ``state`` maps a column to its next value from s (state) and r (row); ``init`` gives its first."""
    k = ", ".join(keys)
    on = " AND ".join(f"r.{x} = s.{x}" for x in keys)
    nxt = ", ".join(f"{e} AS {c}" for c, e in state.items())
    return f"""
WITH RECURSIVE {series}, nr AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS no FROM src),
fold AS (
  SELECT {k}, no, t, seq, {init} FROM nr WHERE no = 1
  UNION ALL
  SELECT {", ".join("r." + x for x in keys)}, r.no, r.t, r.seq, {nxt}, {fired} FROM fold s JOIN nr r ON {on} AND r.no = s.no + 1
)
{out}
"""


__all__ = ["BOOK_SQL", "MOVES_SQL", "TRADES_SQL", "comparable", "d", "fold_sql", "pairs", "phi", "scores"]
