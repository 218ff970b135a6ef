"""Declared schemas of the engine's inputs and outputs (times are epoch microseconds)."""

LEG = ["sym", "venue", "inst"]
BOOK_TICKER = "exch_us long, recv_us long, sym string, venue string, inst string, bid double, bidsz double, ask double, asksz double"
TRADES = "exch_us long, trade_us long, recv_us long, sym string, px double, qty double, side string, tid long"
QUOTE = "seq long, event_us long, recv_us long, sym string, venue string, inst string, bid double, ask double, mid double"
MOVE = "sym string, venue string, inst string, event_us long, recv_us long, seq long, mid double, move_bps double, direction string"
DEPTH = "exch_us long, recv_us long, sym string, first_u long, last_u long, prev_u long, bids array<struct<px:double,qty:double>>, asks array<struct<px:double,qty:double>>"
ALERT = "ts long, sym string, venue string, inst string, alert_type string, msg string"
