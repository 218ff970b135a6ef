"""Venue messages (JSON text) to normalised rows, order-book maintenance and sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fold as K

_LEVELS = "array<array<string>>"
OKX = f"arg struct<channel:string,instId:string>, data array<struct<bids:{_LEVELS},asks:{_LEVELS},ts:string,instId:string,tradeId:string,px:string,sz:string,side:string>>"
COINBASE = f"type string, product_id string, time string, trade_id long, side string, size string, price string, bids {_LEVELS}, asks {_LEVELS}, changes {_LEVELS}"


def micros_from_ms(text: Column) -> Column:
    return F.try_to_number(text, F.lit("9999999999999999999")).cast("long") * 1000


def micros_from_iso(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text))


def number(text: Column) -> Column:
    return text.try_cast("double")


def okx_quotes(messages: DataFrame) -> DataFrame:
    """Top of book per message (recv_us, json); a missing or unreadable time falls back to the receive time."""
    m = messages.select("recv_us", F.from_json("json", OKX).alias("m")).select("recv_us", "m.arg.*", F.explode("m.data").alias("d")).where(F.col("channel").isin("bbo-tbt", "books5"))
    level = lambda side, i: number(F.get(F.get(F.col(f"d.{side}"), F.lit(0)), F.lit(i)))
    rows = m.select(F.coalesce(F.col("d.ts").try_cast("long") * 1000, F.col("recv_us")).alias("exch_us"), "recv_us", F.col("instId").alias("sym"), F.lit("OKX").alias("venue"), F.lit("SPOT").alias("inst"), level("bids", 0).alias("bid"), level("bids", 1).alias("bidsz"), level("asks", 0).alias("ask"), level("asks", 1).alias("asksz"))
    return rows.where("bid IS NOT NULL AND ask IS NOT NULL")


def okx_trades(messages: DataFrame) -> DataFrame:
    """Trades with the taker's side as it stands; incomplete ones are left out."""
    m = messages.select("recv_us", F.from_json("json", OKX).alias("m")).select("recv_us", "m.arg.*", F.explode("m.data").alias("d")).where(F.col("channel") == "trades")
    t = F.coalesce(F.col("d.ts").try_cast("long") * 1000, F.col("recv_us"))
    side = F.when(F.lower("d.side") == "buy", "B").when(F.lower("d.side") == "sell", "S")
    rows = m.select(t.alias("exch_us"), t.alias("trade_us"), "recv_us", F.coalesce("d.instId", "instId").alias("sym"), number(F.col("d.px")).alias("px"), number(F.col("d.sz")).alias("qty"), side.alias("side"), F.col("d.tradeId").try_cast("long").alias("tid"))
    return rows.where("px IS NOT NULL AND qty IS NOT NULL AND side IS NOT NULL")


def coinbase_trades(messages: DataFrame) -> DataFrame:
    """Matches; the venue names the maker's side, so it is flipped to the aggressor's."""
    m = messages.select("recv_us", F.from_json("json", COINBASE).alias("m")).select("recv_us", "m.*").where(F.col("type").isin("match", "last_match"))
    t = F.coalesce(micros_from_iso(F.col("time")), F.col("recv_us"))
    side = F.when(F.col("side") == "buy", "S").when(F.col("side") == "sell", "B")
    rows = m.select(t.alias("exch_us"), t.alias("trade_us"), "recv_us", F.col("product_id").alias("sym"), number(F.col("price")).alias("px"), number(F.col("size")).alias("qty"), side.alias("side"), F.col("trade_id").alias("tid"))
    return rows.where("px IS NOT NULL AND qty IS NOT NULL AND side IS NOT NULL")


def binance_trades(messages: DataFrame, perp: bool = False) -> DataFrame:
    """Trades or aggregate trades; a buying maker means a selling aggressor."""
    # field names differ by case alone, which struct fields cannot
    f = lambda name: F.get_json_object("json", f"$.{name}")
    long = lambda name: f(name).try_cast("long")
    rows = messages.where(f("e") == ("aggTrade" if perp else "trade"))
    return rows.select((long("E") * 1000).alias("exch_us"), (long("T") * 1000).alias("trade_us"), "recv_us", f("s").alias("sym"), number(f("p")).alias("px"), number(f("q")).alias("qty"), F.when(f("m") == "true", "S").otherwise("B").alias("side"), long("a" if perp else "t").alias("tid"))


def binance_depth(messages: DataFrame) -> DataFrame:
    """Depth updates with their sequence range and levels (price, quantity) as text pairs."""
    f = lambda name: F.get_json_object("json", f"$.{name}")
    long = lambda name: f(name).try_cast("long")
    rows = messages.where(f("e") == "depthUpdate")
    return rows.select("recv_us", "seq", (long("E") * 1000).alias("exch_us"), f("s").alias("sym"), long("U").alias("first_u"), long("u").alias("last_u"), long("pu").alias("prev_u"), F.from_json(f("b"), _LEVELS).alias("bids"), F.from_json(f("a"), _LEVELS).alias("asks"))


def binance_quotes(messages: DataFrame, perp: bool = False) -> DataFrame:
    """Book tickers; the spot one carries no time, so the receive time stands in."""
    f = lambda name: F.get_json_object("json", f"$.{name}")
    t = F.coalesce(f("E").try_cast("long") * 1000, F.col("recv_us"))
    rows = messages.select(t.alias("exch_us"), "recv_us", f("s").alias("sym"), F.lit("BINANCE").alias("venue"), F.lit("PERP" if perp else "SPOT").alias("inst"), number(f("b")).alias("bid"), number(f("B")).alias("bidsz"), number(f("a")).alias("ask"), number(f("A")).alias("asksz"))
    return rows.where("bid IS NOT NULL AND ask IS NOT NULL")


def binance_marks(messages: DataFrame) -> DataFrame:
    """Mark price, index, estimated settlement and funding of perpetuals."""
    f = lambda name: F.get_json_object("json", f"$.{name}")
    rows = messages.where(f("e") == "markPriceUpdate")
    return rows.select((f("E").try_cast("long") * 1000).alias("exch_us"), "recv_us", f("s").alias("sym"), number(f("p")).alias("mark"), number(f("i")).alias("index"), number(f("P")).alias("est_settle"), number(f("r")).alias("funding"), (f("T").try_cast("long") * 1000).alias("next_funding_us"))


def coinbase_levels(messages: DataFrame) -> DataFrame:
    """(recv_us, seq, sym, kind, exch_us, levels of (side, px, qty)) of snapshots and updates, in the order received."""
    m = messages.select("recv_us", "seq", F.from_json("json", COINBASE).alias("m")).select("recv_us", "seq", "m.*").where(F.col("type").isin("snapshot", "l2update"))
    of = lambda side, levels: F.transform(levels, lambda x: F.struct(F.lit(side).alias("side"), number(F.get(x, F.lit(0))).alias("px"), number(F.get(x, F.lit(1))).alias("qty")))
    delta = F.transform("changes", lambda x: F.struct(F.get(x, F.lit(0)).alias("side"), number(F.get(x, F.lit(1))).alias("px"), number(F.get(x, F.lit(2))).alias("qty")))
    levels = F.when(F.col("type") == "snapshot", F.concat(of("buy", F.col("bids")), of("sell", F.col("asks")))).otherwise(delta)
    return m.select("recv_us", "seq", F.col("product_id").alias("sym"), F.col("type").alias("kind"), F.coalesce(micros_from_iso(F.col("time")), F.col("recv_us")).alias("exch_us"), F.to_json(levels).alias("levels"))


def coinbase_tickers(messages: DataFrame) -> DataFrame:
    """Best quotes of the ticker channel; sizes may be missing."""
    f = lambda name: F.get_json_object("json", f"$.{name}")
    t = F.coalesce(micros_from_iso(f("time")), F.col("recv_us"))
    rows = messages.where(f("type") == "ticker")
    out = rows.select(t.alias("exch_us"), "recv_us", f("product_id").alias("sym"), F.lit("COINBASE").alias("venue"), F.lit("SPOT").alias("inst"), number(f("best_bid")).alias("bid"), number(f("best_bid_size")).alias("bidsz"), number(f("best_ask")).alias("ask"), number(f("best_ask_size")).alias("asksz"))
    return out.where("bid IS NOT NULL AND ask IS NOT NULL")


def binance_snapshots(messages: DataFrame) -> DataFrame:
    """Depth snapshots (recv_us, seq, sym, json) with the id of their last update and their levels as text pairs."""
    f = lambda name: F.get_json_object("json", f"$.{name}")
    return messages.where(f("lastUpdateId").isNotNull()).select("recv_us", "seq", "sym", f("lastUpdateId").try_cast("long").alias("last_u"), F.from_json(f("bids"), _LEVELS).alias("bids"), F.from_json(f("asks"), _LEVELS).alias("asks"))


def _depth_book(perp: bool):
    """The book of one symbol that ``_sequence`` allows: emits its changed two-sided tops, and again after a resync."""
    import json

    follow, bids, asks = _sequence(perp), {}, {}
    waiting: list[tuple] = []
    last = None

    def put(book, levels):
        for level in json.loads(levels or "[]"):
            px, qty = float(level[0]), float(level[1])
            if qty:
                book[px] = qty
            else:
                book.pop(px, None)

    def step(kind, first, end, before, exch_us, bid_levels, ask_levels):
        nonlocal last, waiting
        (state,) = follow(kind, first, end, before)
        event = (end, bid_levels, ask_levels)
        if state == "gap":
            bids.clear()
            asks.clear()
            waiting, last = [] if kind == "snapshot" else [event], None
            return None
        if state == "waiting":
            waiting.append(event)
            return None
        if state not in ("ok", "synced"):
            return None
        if state == "synced":
            bids.clear()
            asks.clear()
            last = None
        for e, b, a in [event, *(w for w in waiting if w[0] > end)] if state == "synced" else [event]:
            put(bids, b)
            put(asks, a)
        waiting = []
        if not bids or not asks:
            return None
        bid, ask = max(bids), min(asks)
        top = (bid, bids[bid], ask, asks[ask])
        if top == last:
            return None
        last = top
        return (exch_us, *top)

    return step


def depth_quotes(depth: DataFrame, snapshots: DataFrame, perp: bool = False) -> DataFrame:
    """(sym, recv_us, seq, exch_us, bid, bidsz, ask, asksz): tops of books kept from updates and snapshots."""
    none, text = F.lit(None).cast("long"), lambda c: F.to_json(c)
    updates = depth.select("sym", "recv_us", "seq", F.lit("delta").alias("kind"), "first_u", "last_u", "prev_u" if perp else none.alias("prev_u"), "exch_us", text("bids").alias("bids"), text("asks").alias("asks"))
    whole = snapshots.select("sym", "recv_us", "seq", F.lit("snapshot").alias("kind"), none.alias("first_u"), "last_u", none.alias("prev_u"), F.col("recv_us").alias("exch_us"), text("bids").alias("bids"), text("asks").alias("asks"))
    as_int = lambda x: None if x is None or x != x else int(x)

    def make(sym):
        step = _depth_book(perp)
        return lambda kind, first, end, before, at, b, a: step(kind, as_int(first), as_int(end), as_int(before), as_int(at), b, a)

    return K.fold(updates.unionByName(whole), ["sym"], ["recv_us", "seq"], ["kind", "first_u", "last_u", "prev_u", "exch_us", "bids", "asks"], make, {"exch_us": "long", "bid": "double", "bidsz": "double", "ask": "double", "asksz": "double"})


def _book():
    """Order book of one symbol: snapshots replace, updates set or (size 0) delete; emits a changed two-sided top."""
    import json

    sides: dict[str, dict[float, float]] | None = None
    last = None

    def step(kind, exch_us, levels):
        nonlocal sides, last
        if kind == "snapshot":
            sides = {"buy": {}, "sell": {}}
        elif sides is None:
            return None
        for x in json.loads(levels):
            side = sides.get(x.get("side"))
            if side is None or "px" not in x or "qty" not in x:
                continue
            if x["qty"] > 0:
                side[x["px"]] = x["qty"]
            else:
                side.pop(x["px"], None)
        if not sides["buy"] or not sides["sell"]:
            return None
        bid, ask = max(sides["buy"]), min(sides["sell"])
        top = (bid, sides["buy"][bid], ask, sides["sell"][ask])
        if top == last:
            return None
        last = top
        return (exch_us, *top)

    return step


def best_quotes(levels: DataFrame) -> DataFrame:
    """Changed tops of the books rebuilt from snapshots and updates, per symbol."""
    return K.fold(levels, ["sym"], ["recv_us", "seq"], ["kind", "exch_us", "levels"], lambda sym: _book(), {"exch_us": "long", "bid": "double", "bidsz": "double", "ask": "double", "asksz": "double"})


def changed(quotes: DataFrame, keys: list[str], time: str, seq: str, cols: list[str], reset: Column | None = None) -> DataFrame:
    """Rows whose values differ from the row before of the key, null-safely; the first always stays.

    So does the first after a reconnect, which ``reset`` marks.
    """
    w = Window.partitionBy(*keys).orderBy(time, seq)
    now = F.struct(*cols)
    again = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    return quotes.withColumn("_before", F.lag(now).over(w)).withColumn("_reset", again).where(F.col("_reset") | ~F.col("_before").eqNullSafe(now)).drop("_before", "_reset")


def _sequence(perp: bool):
    """Whether a book follows its depth updates: they wait for a snapshot, a gap drops the book and waits for the next.

    A snapshot is taken while updates wait, unless it is older than the first of them; the waiting ones are then applied.
    A perpetual's first update after a snapshot must bridge it, later ones must name their predecessor; a spot update
    must begin no later than after the last one.
    """
    last, bridged, waiting = None, False, []

    def apply(first, end, before) -> str:
        nonlocal last, bridged, waiting
        if perp and not bridged:
            state = "stale" if end < last + 1 else "ok" if first <= last + 1 else "gap"
            bridged = state == "ok"
        elif perp:
            state = "stale" if end <= last else "gap" if before is not None and before != -1 and before != last else "ok"
        else:
            state = "stale" if end < last else "gap" if first > last + 1 else "ok"
        if state == "ok":
            last = end
        if state == "gap":
            last, bridged, waiting = None, False, [(first, end, before)]
        return state

    def step(kind, first, end, before):
        nonlocal last, waiting
        if kind != "snapshot":
            if last is not None:
                return (apply(first, end, before),)
            waiting.append((first, end, before))
            return ("waiting",)
        if last is not None:
            return ("unused",)
        if not waiting or end < waiting[0][0]:
            return ("early",)
        held, waiting, last = [w for w in waiting if w[1] > end], [], end
        for event in held:
            if apply(*event) == "gap":
                return ("gap",)
        return ("synced",)

    return step


def _followed(rows: DataFrame, keys: list[str], perp: bool) -> DataFrame:
    as_int = lambda step: lambda kind, *n: step(kind, *[None if x is None or x != x else int(x) for x in n])
    dense = rows.select(*keys, "recv_us", "seq", "kind", "first_u", "last_u", "prev_u")
    return K.fold(dense, keys, ["recv_us", "seq"], ["kind", "first_u", "last_u", "prev_u"], lambda *key: as_int(_sequence(perp)), {"state": "string"})


def spot_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recv_us, seq, state) of depth updates (kind ``delta``, first_u, last_u) and snapshots (last_u).

    Updates are ``waiting`` for a snapshot, ``ok``, ``stale`` (wholly seen) or a ``gap``; snapshots are ``synced``,
    ``early`` (nothing waits, or something earlier than it), ``unused``, or a ``gap`` if the waiting updates have one.
    """
    return _followed(rows.withColumn("prev_u", F.lit(None).cast("long")), keys, False)


def perp_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As ``spot_gaps`` for updates that name their predecessor (prev_u; null or -1: not named)."""
    return _followed(rows, keys, True)


def clock_offsets(quotes: DataFrame, offsets: DataFrame, keys: list[str], stale: int = 60_000_000) -> DataFrame:
    """``quotes`` with the last ``median`` of ``offsets`` (keys, recv_us, median) no older than ``stale``, else null."""
    q = quotes.withColumn("_row", F.struct(*quotes.columns)).select(*keys, "recv_us", F.lit(1).alias("_kind"), "_row", F.lit(None).cast("struct<at:long,median:long>").alias("_o"))
    o = offsets.select(*keys, "recv_us", F.lit(0).alias("_kind"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), F.struct(F.col("recv_us").alias("at"), F.col("median").cast("long").alias("median")).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("recv_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = o.unionByName(q).withColumn("_last", F.last("_o", ignorenulls=True).over(w)).where("_kind = 1")
    fresh = F.when(F.col("recv_us") - F.col("_last.at") <= stale, F.col("_last.median"))
    return both.select("_row.*", fresh.alias("offset_us"))


def rolling_median(samples: DataFrame, keys: list[str], time: str, seq: str, value: str, rows: int = 200, least: int = 20) -> DataFrame:
    """Truncated median of the last ``rows`` values, null before there are ``least``. ``clock_offsets`` lets it go stale."""
    w = Window.partitionBy(*keys).orderBy(time, seq).rowsBetween(-(rows - 1), 0)
    s = samples.withColumn("_v", F.array_sort(F.collect_list(value).over(w))).withColumn("_n", F.size("_v"))
    mid = (F.element_at("_v", F.floor((F.col("_n") + 1) / 2).cast("int")) + F.element_at("_v", (F.floor(F.col("_n") / 2) + 1).cast("int"))) / 2
    return s.withColumn("median", F.when(F.col("_n") >= least, mid.cast("long"))).drop("_v", "_n")


def recorded(spark, path: str, streaming: bool = False) -> DataFrame:
    """Recorded messages (seq, recv_us, json): lines of receive time, a tab and the message, as a table or a stream.

    A stream takes files as they land; ``seq`` orders messages of one file and receive time.
    """
    lines = (spark.readStream if streaming else spark.read).text(path)
    cut = F.split("value", "\t", 2)
    return lines.select(F.monotonically_increasing_id().alias("seq"), F.get(cut, F.lit(0)).try_cast("long").alias("recv_us"), F.get(cut, F.lit(1)).alias("json")).where("recv_us IS NOT NULL")
