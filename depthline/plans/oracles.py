"""DuckDB SQL for the registered queries, written from the definitions rather than from the plans.

Shared pieces are common table expressions; each statement names those it needs.
"""

from __future__ import annotations

_CTE = {
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "l2": """SELECT CAST(user_id % 4 AS VARCHAR) AS instrument, event_id AS pos,
      (epoch_us(ts) - 1704067200000000) // 259200 // 10000 * 10000 AS ts_us,
      CASE event_type WHEN 'signup' THEN 'Add' WHEN 'purchase' THEN 'Trade' WHEN 'error' THEN 'Delete' ELSE 'Modify' END AS type,
      CASE WHEN (user_id // 4) % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side,
      CAST(1000000 + CASE WHEN (user_id // 4) % 2 = 0 THEN -100 ELSE 100 END * (1 + k % 10) AS BIGINT) AS px,
      CASE WHEN event_type = 'error' THEN 0 ELSE greatest(1, CAST(floor(value * 10) AS BIGINT)) END AS qty FROM ev""",
    "seg": "SELECT *, sum(CASE WHEN type IN ('Modify', 'Delete') THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, side, px ORDER BY pos) AS seg, CASE type WHEN 'Trade' THEN -qty WHEN 'Delete' THEN 0 ELSE qty END AS d FROM l2",
    "run": "SELECT *, sum(d) OVER (PARTITION BY instrument, side, px, seg ORDER BY pos) AS s FROM seg",
    "ends": "SELECT instrument, max(pos) + 1 AS e FROM l2 GROUP BY instrument",
    "lev": """SELECT r.instrument, r.side, r.px, r.pos, coalesce(lead(r.pos) OVER (PARTITION BY r.instrument, r.side, r.px ORDER BY r.pos), e) AS next_pos,
      CAST(s - least(0, min(s) OVER (PARTITION BY r.instrument, r.side, r.px, seg ORDER BY r.pos)) AS BIGINT) AS vol FROM run r JOIN ends USING (instrument)""",
    "live": "SELECT m.instrument, m.pos, v.side, v.px, v.vol FROM l2 m JOIN lev v ON v.instrument = m.instrument AND v.pos <= m.pos AND m.pos < v.next_pos AND v.vol > 0",
    "bbo": """SELECT m.instrument, m.pos, m.ts_us, coalesce(max(v.px) FILTER (v.side = 'Buy'), 0) AS best_bid, coalesce(arg_max(v.vol, v.px) FILTER (v.side = 'Buy'), 0) AS best_bid_qty,
      coalesce(min(v.px) FILTER (v.side = 'Sell'), 0) AS best_ask, coalesce(arg_min(v.vol, v.px) FILTER (v.side = 'Sell'), 0) AS best_ask_qty
      FROM l2 m LEFT JOIN live v ON v.instrument = m.instrument AND v.pos = m.pos GROUP BY ALL""",
    "two": "SELECT *, best_bid <> 0 AND best_ask <> 0 AS ok, best_bid / 10000.0::DOUBLE AS b, best_ask / 10000.0::DOUBLE AS a, best_bid_qty::DOUBLE AS bq, best_ask_qty::DOUBLE AS aq FROM bbo",
    "rawp": "SELECT *, CASE WHEN ok THEN (b + a) / 2 END AS mid0, CASE WHEN ok THEN a - b END AS spr0, CASE WHEN ok THEN (b * aq + a * bq) / (bq + aq) END AS mic0, CASE WHEN ok THEN (bq - aq) / (bq + aq) END AS imb0 FROM two",
    "pr": """SELECT instrument, pos, ts_us, best_bid, best_bid_qty, best_ask, best_ask_qty, ok,
      coalesce(last_value(mid0 IGNORE NULLS) OVER w, 0) AS midprice, coalesce(last_value(spr0 IGNORE NULLS) OVER w, 0) AS spread,
      coalesce(last_value(mic0 IGNORE NULLS) OVER w, 0) AS microprice, coalesce(last_value(imb0 IGNORE NULLS) OVER w, 0) AS queue_imbalance
      FROM rawp WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "top": "SELECT *, row_number() OVER (PARTITION BY instrument, pos, side ORDER BY CASE WHEN side = 'Buy' THEN -px ELSE px END) - 1 AS rank FROM live QUALIFY rank < 5",
    "sl": "SELECT instrument, pos, side, count(*) AS n, regr_slope(ln(greatest(vol, 1)::DOUBLE), rank::DOUBLE) AS slope FROM top GROUP BY ALL",
    "sl2": "SELECT m.instrument, m.pos, ok, coalesce((SELECT slope FROM sl WHERE sl.instrument = m.instrument AND sl.pos = m.pos AND side = 'Buy' AND n >= 2), 0) AS bs, coalesce((SELECT slope FROM sl WHERE sl.instrument = m.instrument AND sl.pos = m.pos AND side = 'Sell' AND n >= 2), 0) AS sa FROM pr m",
    "slope": "SELECT instrument, pos, coalesce(last_value(CASE WHEN ok THEN bs END IGNORE NULLS) OVER w, 0) AS bid_slope, coalesce(last_value(CASE WHEN ok THEN sa END IGNORE NULLS) OVER w, 0) AS ask_slope FROM sl2 WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS UNBOUNDED PRECEDING)",
    "ret": "SELECT instrument, pos, ln(midprice / lag(midprice) OVER (PARTITION BY instrument ORDER BY pos)) AS r FROM pr WHERE ok",
    "dev": "SELECT instrument, pos, coalesce(stddev_samp(r) OVER (PARTITION BY instrument ORDER BY pos ROWS 8 PRECEDING), 0) AS v FROM ret",
    "vola": "SELECT pr.instrument, pr.pos, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY pr.instrument ORDER BY pr.pos ROWS UNBOUNDED PRECEDING), 0) AS volatility FROM pr LEFT JOIN dev USING (instrument, pos)",
    "rate": """SELECT a.instrument, a.pos, CAST(count(*) FILTER (b.type = 'Add') AS DOUBLE) AS arrival_rate, CAST(count(*) FILTER (b.type = 'Delete') AS DOUBLE) AS cancel_rate,
      CAST(count(*) FILTER (b.type = 'Trade') AS DOUBLE) AS trade_intensity
      FROM l2 a JOIN l2 b ON a.instrument = b.instrument AND b.pos <= a.pos AND b.ts_us >= a.ts_us - 1000000 GROUP BY ALL""",
    "buys": "SELECT l2.instrument, l2.pos, l2.ts_us, l2.type = 'Trade' AS t, l2.type = 'Trade' AND ok AND l2.px / 10000.0::DOUBLE >= midprice AS hit FROM l2 JOIN pr USING (instrument, pos)",
    "br0": "SELECT a.instrument, a.pos, count(*) FILTER (b.hit) / nullif(count(*) FILTER (b.t), 0)::DOUBLE AS r FROM buys a JOIN buys b ON a.instrument = b.instrument AND b.pos <= a.pos AND b.ts_us >= a.ts_us - 1000000 GROUP BY ALL",
    "br": "SELECT instrument, pos, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS buy_ratio FROM br0",
    "lag": "SELECT *, CASE WHEN type = 'Delete' THEN 0 ELSE qty END AS cur, coalesce(lag(CASE WHEN type = 'Delete' THEN 0 ELSE qty END) OVER (PARTITION BY instrument, side, px ORDER BY pos), 0) AS prev FROM l2",
    "dl": "SELECT instrument, pos, CASE WHEN side = 'Buy' THEN 1 ELSE -1 END * greatest(cur - prev, 0) AS delta FROM lag",
    "ofi": "SELECT instrument, pos, CAST(sum(delta) OVER (PARTITION BY instrument ORDER BY pos) AS BIGINT) AS ofi FROM dl",
    "num": "SELECT instrument, pos, ts_us, row_number() OVER (PARTITION BY instrument ORDER BY pos) AS i FROM l2",
    "lab": "SELECT *, lead(midprice, 1) OVER w AS m1, lead(midprice, 5) OVER w AS m5, lead(midprice, 10) OVER w AS m10, lead(microprice, 1) OVER w AS c1, lead(microprice, 5) OVER w AS c5, lead(microprice, 10) OVER w AS c10 FROM pr WHERE midprice > 0 WINDOW w AS (PARTITION BY instrument ORDER BY ts_us, pos)",
    "sco": "SELECT instrument, pos, ts_us, midprice, (m1 - midprice) / greatest(midprice, 1e-12) AS ret, CAST(coalesce(m1 > midprice, false) AS INTEGER) AS y, pos * 7919 % 1000 / 1000.0::DOUBLE AS prob FROM lab",
    "sc": "SELECT event_id AS pos, event_id * 7919 % 1000 / 1000.0::DOUBLE AS prob, CAST(event_id % 3 = 0 AS INTEGER) AS y FROM events",
    "probe": "SELECT instrument, pos, side, CAST(1000000 + CASE WHEN side = 'Buy' THEN -100 ELSE 100 END * (1 + pos % 10) AS BIGINT) AS px FROM l2 WHERE pos % 3 = 0",
    "l3o": "SELECT o_orderkey AS order_id, CAST(o_custkey % 4 AS VARCHAR) AS instrument, CASE WHEN o_orderkey % 2 = 1 THEN 'Sell' ELSE 'Buy' END AS side, CAST(1000000 + CASE WHEN o_orderkey % 2 = 1 THEN 100 ELSE -100 END * (1 + o_orderkey % 10) AS BIGINT) AS px, CAST((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS total, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "l3x": "SELECT o.*, CAST(l_quantity AS BIGINT) AS qty, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem JOIN l3o o ON l_orderkey = order_id",
    "l3": "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t, order_id, n) AS pos FROM (SELECT instrument, order_id, side, px, 'Add' AS type, total AS qty, 0 AS n, o_orderdate AS t FROM l3o UNION ALL SELECT instrument, order_id, side, px, 'Execute', qty, n, greatest(o_orderdate, l_shipdate) FROM l3x)",
    "rem": "SELECT *, CAST(greatest(sum(CASE WHEN type = 'Add' THEN qty ELSE -qty END) OVER (PARTITION BY order_id ORDER BY pos), 0) AS BIGINT) AS remaining FROM l3",
    "strat": "SELECT *, position * coalesce(ret, 0) - turnover * cost AS sret FROM (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY instrument ORDER BY pos), 0)) AS turnover FROM posn)",
}
_NEEDS = {
    "l2": "ev", "seg": "l2", "run": "seg", "ends": "l2", "lev": "run ends", "live": "l2 lev", "bbo": "live", "two": "bbo", "rawp": "two", "pr": "rawp", "top": "live", "sl": "top", "sl2": "sl pr", "slope": "sl2",
    "ret": "pr", "dev": "ret", "vola": "dev", "rate": "l2", "buys": "pr", "br0": "buys", "br": "br0", "lag": "l2", "dl": "lag", "ofi": "dl", "num": "l2", "lab": "pr", "sco": "lab", "probe": "l2", "l3x": "l3o", "l3": "l3x", "rem": "l3",
}


def _with(needs: str, body: str, extra: tuple[tuple[str, str], ...] = (), recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS MATERIALIZED ({_CTE[n]})" for n in order if n not in dict(extra)] + [f"{n} AS ({sql})" for n, sql in extra]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


_LIVE_SEG = (
    ("lm", "SELECT * REPLACE (CASE WHEN pos % 1000 < 3 THEN 'Snapshot' ELSE type END AS type) FROM l2"),
    ("le", "SELECT *, sum(CASE WHEN type = 'Snapshot' AND coalesce(before, '') <> 'Snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY pos) AS epoch FROM (SELECT *, lag(type) OVER (PARTITION BY instrument ORDER BY pos) AS before FROM lm)"),
    ("ls", "SELECT *, sum(CASE WHEN type IN ('Modify', 'Delete', 'Snapshot') THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, epoch, side, px ORDER BY pos) AS seg, CASE type WHEN 'Trade' THEN -qty WHEN 'Delete' THEN 0 ELSE qty END AS d FROM le"),
    ("lr", "SELECT *, sum(d) OVER (PARTITION BY instrument, epoch, side, px, seg ORDER BY pos) AS s FROM ls"),
)


def _chain(count: int) -> str:
    firsts = "SELECT instrument, ts_us, min(i) AS i FROM num GROUP BY ALL"
    nxt = f"SELECT a.instrument, a.i, least(a.i + {count}, coalesce(b.i, 9223372036854775807)) AS j FROM (SELECT instrument, i, ts_us + 100000 AS due FROM num) a ASOF LEFT JOIN firsts b ON a.instrument = b.instrument AND a.due <= b.ts_us"
    hops = f"SELECT instrument, 1::BIGINT AS i FROM num WHERE i = 1 UNION ALL SELECT h.instrument, nx.j FROM hop h JOIN nx ON nx.instrument = h.instrument AND nx.i = h.i JOIN tops ON tops.instrument = h.instrument AND nx.j <= tops.n"
    parts = (("firsts", firsts), ("tops", "SELECT instrument, max(i) AS n FROM num GROUP BY 1"), ("nx", nxt), ("hop", hops))
    return _with("num", "SELECT instrument, pos FROM hop JOIN num USING (instrument, i)", parts, True).replace("nx AS (", "nx AS MATERIALIZED (").replace("tops AS (", "tops AS MATERIALIZED (")


def _labels(h: int) -> str:
    return _with("lab", f"SELECT instrument, pos, round((m{h} - midprice) / greatest(midprice, 1e-12), 9) AS next_return_{h}, coalesce(m{h} > midprice, false) AS label_{h}, round(c{h} - microprice, 9) AS microprice_change_{h} FROM lab")


def _queue(side: str, columns: str) -> str:
    q = "best_bid_qty" if side == "buy" else "best_ask_qty"
    first = f"SELECT a.instrument, a.pos, arg_min(b.ts_us, b.i) - any_value(a.ts_us) AS dt FROM nn a JOIN nn b ON a.instrument = b.instrument AND b.i > a.i AND b.i < a.i + 100 AND b.{q} < a.{q} - 100 GROUP BY ALL"
    return _with("pr", f"SELECT n.instrument, n.pos, n.{q} AS depth_ahead, CAST(dt AS DOUBLE) AS expected_fill_time_us{columns} FROM nn n LEFT JOIN f USING (instrument, pos) WHERE ok", (("nn", "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY pos) AS i FROM pr"), ("f", first)))


def _position(threshold: float, cost: float = 0.0) -> tuple[str, str]:
    return ("posn", f"SELECT *, CASE WHEN prob > {threshold} THEN 1 WHEN prob < 1 - {threshold} THEN -1 ELSE 0 END AS position, {cost}::DOUBLE AS cost FROM sco")


_STRAT = ("strat", _CTE["strat"])
_FULL = "SELECT l2.instrument, l2.pos, ofi, arrival_rate, cancel_rate, trade_intensity, buy_ratio, round(midprice, 9) AS midprice, round(spread, 9) AS spread, round(microprice, 9) AS microprice, round(queue_imbalance, 9) AS queue_imbalance, round(bid_slope, 9) AS bid_slope, round(ask_slope, 9) AS ask_slope, round(volatility, 9) AS volatility"
_JOINS = " FROM l2 JOIN pr USING (instrument, pos) JOIN slope USING (instrument, pos) JOIN vola USING (instrument, pos) JOIN rate USING (instrument, pos) JOIN ofi USING (instrument, pos) JOIN br USING (instrument, pos)"
_ALL = "l2 pr slope vola rate ofi br"
_PAIR = "event_id % 40 / 8.0::DOUBLE"
_F = ["midprice", "spread", "microprice", "ofi::DOUBLE", "queue_imbalance", "arrival_rate", "cancel_rate", "bid_slope", "ask_slope", "volatility", "trade_intensity", "buy_ratio"]
_RANK = (("g", "SELECT prob, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY prob"), ("cum", "SELECT prob, p, n, coalesce(sum(p) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(n) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(p) OVER () AS pt, sum(n) OVER () AS nt FROM g"))
_DEPTH = f"""SELECT event_id, 0::BIGINT AS n, 'Buy' AS side, CAST(trunc(CAST(printf('%.4f', (1000000 - 100 * (1 + k % 10)) / 10000.0::DOUBLE) AS DOUBLE) * 10000) AS BIGINT) AS px, CAST(round({_PAIR}) AS BIGINT) AS qty, epoch_us(ts) // 1000 * 1000 AS ts_us FROM ev
  UNION ALL SELECT event_id, 1, 'Sell', CAST(trunc(CAST(printf('%.4f', (1000000 + 100 * (1 + k % 10)) / 10000.0::DOUBLE) AS DOUBLE) * 10000) AS BIGINT), CAST(round({_PAIR}) AS BIGINT), epoch_us(ts) // 1000 * 1000 FROM ev
  UNION ALL SELECT event_id, 2, 'Sell', CAST(trunc(101.9999::DOUBLE * 10000) AS BIGINT), 0, epoch_us(ts) // 1000 * 1000 FROM ev"""
_VOLUME = "coalesce((SELECT arg_max(v.vol, v.pos) FROM lev v WHERE v.instrument = p.instrument AND v.px = p.px AND v.pos <= p.pos AND v.side = {}), 0)"

ORACLES: dict[str, str] = {
    "parse_depth_json": _with("ev", "SELECT event_id, n, event_id + 1 AS seq, ts_us, CASE WHEN qty = 0 THEN 'Delete' ELSE 'Modify' END AS type, px, qty, side FROM x", (("x", _DEPTH),)),
    "parse_snapshot_json": _with("ev", "SELECT event_id, event_id + 1 AS seq, 0::BIGINT AS ts_us, 'Snapshot' AS type, px, qty, side FROM x WHERE qty <> 0", (("x", _DEPTH),)),
    "route_lines": "SELECT CASE WHEN event_id % 7 = 0 THEN 'snapshot' ELSE 'update' END AS kind, count(*) AS n FROM events WHERE event_id % 7 = 0 OR event_id % 5 <> 0 GROUP BY ALL",
    "itch_parse": _with("l3", "SELECT instrument, pos - 1 AS n, CAST(pos % 65536 AS INTEGER) AS track, pos AS ts_us, type, order_id, CASE WHEN type = 'Add' THEN px ELSE 0 END AS px, qty, CASE WHEN type = 'Add' THEN side ELSE 'Buy' END AS side FROM l3"),
    "batch_track_range": _with("l3", "SELECT instrument, CAST(1 AS INTEGER) AS first_track, CAST(max(pos) % 65536 AS INTEGER) AS last_track FROM l3 GROUP BY instrument"),
    "be_decode": "SELECT o_orderkey, o_orderkey AS u64, o_orderkey % 65536 AS u16 FROM orders",
    "itch_sizes": "SELECT chr((65 + i)::INTEGER) AS kind, coalesce(n, 0)::BIGINT AS size FROM range(26) t(i) LEFT JOIN (VALUES ('S', 12), ('A', 36), ('F', 40), ('E', 31), ('C', 36), ('X', 23), ('D', 19), ('U', 35), ('P', 44), ('Q', 36)) v(k, n) ON k = chr((65 + i)::INTEGER)",
    "scan_parquet": "SELECT event_id, value FROM events WHERE event_type = 'purchase'",
    "csv_format": r"SELECT event_id, regexp_replace(regexp_replace(printf('%.6f', floor(value * 1000) / 8000.0::DOUBLE), '0+$', ''), '\.$', '.0') AS text FROM events",
    "price_fixed": "SELECT event_id, px, px / 10000.0::DOUBLE AS back FROM (SELECT event_id, CAST(trunc(floor(value * 100) / 100.0::DOUBLE * 10000.0::DOUBLE) AS BIGINT) AS px FROM events)",
    "qty_round": "SELECT event_id, CAST(round((event_id % 41 - 20) / 8.0::DOUBLE) AS BIGINT) AS replay, CAST(trunc((event_id % 41 - 20) / 8.0::DOUBLE) AS BIGINT) AS live FROM events",
    "side_opposite": _with("l2", "SELECT instrument, pos, CASE side WHEN 'Buy' THEN 'Sell' ELSE 'Buy' END AS other FROM l2"),
    "feature_vector": _with(_ALL, "SELECT l2.instrument, l2.pos, " + ", ".join(f"round({c}, 6) AS f{i}" for i, c in enumerate(_F)) + _JOINS),
    "feature_fill": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN value ELSE 0 END AS x FROM events",
    "two_sided_rows": _with("bbo", "SELECT instrument, pos, best_bid, best_bid_qty, best_ask, best_ask_qty FROM bbo WHERE best_bid <> 0 AND best_ask <> 0"),
    "diff_sync": "SELECT event_id * 3 AS first, event_id * 3 + 2 AS final FROM events WHERE event_id * 3 + 2 > 500",
    "normalize_msgs": _with("l2", "SELECT instrument, pos, CASE WHEN type = 'Modify' AND coalesce(lag(type) OVER (PARTITION BY instrument, side, px ORDER BY pos), 'Delete') = 'Delete' THEN 'Add' ELSE type END AS type FROM l2"),
    "seq_gap": _with("num", "SELECT instrument, pos, CAST((b + 1) % 65536 AS INTEGER) AS expected, CAST(t AS INTEGER) AS actual FROM x WHERE b <> 0 AND (b + 1) % 65536 <> t", (("x", "SELECT *, lag(t) OVER (PARTITION BY instrument ORDER BY pos) AS b FROM (SELECT instrument, pos, (i + pos // 997) % 65536 AS t FROM num)"),)),
    "l2_levels": _with("lev", "SELECT * FROM lev"),
    "l2_levels_live": _with("l2", "SELECT instrument, side, px, pos, CAST(s - least(0, min(s) OVER (PARTITION BY instrument, epoch, side, px, seg ORDER BY pos)) AS BIGINT) AS vol FROM lr", _LIVE_SEG),
    "bbo": _with("bbo", "SELECT instrument, pos, best_bid, best_bid_qty, best_ask, best_ask_qty FROM bbo"),
    "compat_book": _with("bbo", "SELECT instrument, pos, best_bid, best_bid_qty, best_ask, best_ask_qty FROM bbo"),
    "volume_at": _with("lev probe", f"SELECT instrument, side, px, pos, {_VOLUME.format('p.side')} AS volume FROM probe p"),
    "level_imbalance": _with("lev probe", f"SELECT instrument, pos, CASE WHEN b + a = 0 THEN 0.5::DOUBLE ELSE b / (b + a)::DOUBLE END AS level_imbalance FROM (SELECT instrument, pos, {_VOLUME.format(chr(39) + 'Buy' + chr(39))} AS b, {_VOLUME.format(chr(39) + 'Sell' + chr(39))} AS a FROM probe p)"),
    "depth_topn": _with("top", "SELECT instrument, pos, side, rank, px, vol FROM top WHERE pos % 10 = 0"),
    "l3_remaining": _with("rem", "SELECT instrument, order_id, pos, remaining FROM rem"),
    "l3_orphans": _with("l3x", "SELECT instrument, order_id, CAST(greatest(any_value(total) - coalesce(sum(qty) FILTER (l_shipdate >= o_orderdate), 0), 0) AS BIGINT) AS remaining FROM l3x GROUP BY ALL"),
    "l3_levels": _with("rem", "SELECT instrument, side, px, pos, CAST(sum(d) OVER (PARTITION BY instrument, side, px ORDER BY pos) AS BIGINT) AS vol FROM (SELECT *, remaining - coalesce(lag(remaining) OVER (PARTITION BY order_id ORDER BY pos), 0) AS d FROM rem) WHERE d <> 0"),
    "l3_replace": _with("l3o", "SELECT instrument, side, CAST(px + CASE WHEN order_id % 10 <> 0 THEN 0 WHEN side = 'Buy' THEN -50 ELSE 50 END AS BIGINT) AS px, CAST(sum(total) AS BIGINT) AS vol FROM l3o GROUP BY ALL"),
    "order_lookup": _with("rem", "SELECT instrument, pos, order_id, CASE WHEN b > 0 THEN px END AS px, CASE WHEN b > 0 THEN side END AS side, CASE WHEN b > 0 THEN b END AS remaining FROM (SELECT *, lag(remaining) OVER (PARTITION BY order_id ORDER BY pos) AS b FROM rem) WHERE type = 'Execute'"),
    "midprice": _with("pr", "SELECT instrument, pos, midprice FROM pr"),
    "spread": _with("pr", "SELECT instrument, pos, round(spread, 9) AS spread FROM pr"),
    "microprice": _with("pr", "SELECT instrument, pos, round(microprice, 9) AS microprice FROM pr"),
    "queue_imbalance": _with("pr", "SELECT instrument, pos, round(queue_imbalance, 9) AS queue_imbalance FROM pr"),
    "ofi_cumulative": _with("ofi", "SELECT * FROM ofi"),
    "ofi_interval": _with("dl num", "SELECT instrument, (i - 1) // 50 AS bucket, CAST(sum(delta) AS BIGINT) AS ofi FROM dl JOIN num USING (instrument, pos) GROUP BY ALL"),
    "arrival_rate": _with("rate", "SELECT instrument, pos, arrival_rate FROM rate"),
    "cancel_rate": _with("rate", "SELECT instrument, pos, cancel_rate FROM rate"),
    "trade_intensity": _with("rate", "SELECT instrument, pos, trade_intensity FROM rate"),
    "buy_ratio": _with("br", "SELECT * FROM br"),
    "book_slope": _with("slope", "SELECT instrument, pos, round(bid_slope, 9) AS bid_slope, round(ask_slope, 9) AS ask_slope FROM slope"),
    "book_slope_live": _with("l2 sl", "SELECT l2.instrument, l2.pos, round(coalesce(b.slope, 0), 9) AS bid_slope, round(coalesce(a.slope, 0), 9) AS ask_slope FROM l2 LEFT JOIN sl b ON b.instrument = l2.instrument AND b.pos = l2.pos AND b.side = 'Buy' AND b.n >= 3 LEFT JOIN sl a ON a.instrument = l2.instrument AND a.pos = l2.pos AND a.side = 'Sell' AND a.n >= 3"),
    "live_features": _with("rawp", "SELECT instrument, pos, round(mid0, 9) AS midprice, round(spr0, 9) AS spread, round(mic0, 9) AS microprice, round(CASE WHEN bq + aq = 0 THEN 0.5::DOUBLE ELSE bq / (bq + aq) END, 9) AS queue_imbalance FROM rawp"),
    "volatility": _with("vola", "SELECT instrument, pos, round(volatility, 9) AS volatility FROM vola"),
    "features_all": _with(_ALL, _FULL + _JOINS),
    "sample_snapshots": _chain(1000),
    "sample_snapshots_by_count": _chain(7),
    "sample_every_k": _with("num", "SELECT instrument, pos FROM num WHERE (i - 1) % 7 = 0"),
    "labels_1": _labels(1),
    "labels_5": _labels(5),
    "labels_10": _labels(10),
    "chrono_split": _with("num", "SELECT instrument, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(pos) AS first FROM (SELECT *, count(*) OVER (PARTITION BY instrument) AS n FROM num) GROUP BY 1, 2"),
    "queue_fill_sim": _queue("buy", ", coalesce(dt <= 1000, false) AS fill_1ms, coalesce(dt <= 5000, false) AS fill_5ms, coalesce(dt <= 10000, false) AS fill_10ms"),
    "queue_fill_sim_sell": _queue("sell", ""),
    "queue_features": _with("lev probe pr", f"SELECT p.instrument, p.pos, p.side, p.px, {_VOLUME.format('p.side')} AS depth_ahead, round(midprice, 9) AS midprice, round(spread, 9) AS spread, round(queue_imbalance, 9) AS queue_imbalance FROM probe p JOIN pr USING (instrument, pos)"),
    "backtest_positions": _with("sco", "SELECT instrument, pos, CAST(position AS BIGINT) AS position, CAST(turnover AS BIGINT) AS turnover FROM strat", (_position(0.55), _STRAT)),
    "turnover": _with("sco", "SELECT instrument, CAST(sum(turnover) AS BIGINT) AS turnover FROM strat GROUP BY 1", (_position(0.5), _STRAT)),
    "equity_curve": _with("sco", "SELECT instrument, pos, round(product(1 + sret) OVER (PARTITION BY instrument ORDER BY pos), 9) AS equity FROM strat", (_position(0.5, 1e-4), _STRAT)),
    "backtest_summary": _with(
        "sco",
        "SELECT instrument, round(avg(sret) / greatest(stddev_pop(sret), 1e-12) * sqrt(252 * 6.5 * 3600), 3) AS sharpe, round(avg(CASE WHEN (position > 0) = (coalesce(ret, 0) > 0) THEN 1.0 ELSE 0 END), 4) AS hit_rate, round(arg_max(eq, pos) - 1, 4) AS total_return, round(max(eq) - 1, 4) AS max_drawdown, CAST(sum(abs(position)) AS BIGINT) AS n_trades, round(avg(CASE WHEN position = 1 THEN 1.0 ELSE 0 END), 4) AS long_pct, round(avg(CASE WHEN position = -1 THEN 1.0 ELSE 0 END), 4) AS short_pct FROM (SELECT *, product(1 + sret) OVER (PARTITION BY instrument ORDER BY pos) AS eq FROM strat) GROUP BY 1",
        (("posn", "SELECT *, CASE WHEN prob > 0.5 THEN 1 WHEN prob < 0.5 THEN -1 ELSE 0 END AS position, 0::DOUBLE AS cost FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_us, pos) AS i, count(*) OVER (PARTITION BY instrument) AS n FROM sco) WHERE i > floor(n * 0.8)"), _STRAT),
    ),
    "direction_pnl": _with("sco", "SELECT instrument, CAST(sum(r) AS BIGINT) AS pnl, avg(r) AS mean FROM (SELECT instrument, CASE WHEN (prob > 0.5) = (y = 1) THEN 1 ELSE -1 END AS r FROM sco) GROUP BY 1"),
    "pnl_curve": _with("sco", "SELECT instrument, pos, round(sum(CASE WHEN (prob > 0.5) = (y = 1) THEN 1 ELSE -1 END) OVER (PARTITION BY instrument ORDER BY pos) * 1e-4::DOUBLE, 9) AS curve FROM sco"),
    "live_signal": _with("sc", "SELECT pos, CAST(CASE WHEN prob > 0.55 THEN 1 WHEN prob < 1 - 0.55::DOUBLE THEN -1 ELSE 0 END AS BIGINT) AS position, CASE WHEN prob > 0.55 THEN 'UP' WHEN prob < 0.45 THEN 'DOWN' ELSE 'FLAT' END AS label FROM sc"),
    "live_accuracy": _with("sco", "SELECT instrument, pos, round(h / s::DOUBLE, 9) AS accuracy, CAST(2 * h - s AS BIGINT) AS pnl FROM (SELECT instrument, pos, count(*) OVER w AS s, sum(CASE WHEN (p > 0.5) = (midprice > m) THEN 1 ELSE 0 END) OVER w AS h FROM (SELECT *, lag(prob, 5) OVER (PARTITION BY instrument ORDER BY pos) AS p, lag(midprice, 5) OVER (PARTITION BY instrument ORDER BY pos) AS m FROM sco) WHERE p IS NOT NULL WINDOW w AS (PARTITION BY instrument ORDER BY pos))"),
    "confusion_matrix": _with("sc", "SELECT y, yhat, n, n / sum(n) OVER (PARTITION BY y)::DOUBLE AS share FROM (SELECT y, CAST(prob > 0.5 AS INTEGER) AS yhat, count(*) AS n FROM sc GROUP BY ALL)"),
    "auc_rank": _with("sc", "SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 9) AS auc FROM (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS r FROM sc)"),
    "roc_points": _with("sc", "SELECT prob, round((nt - nb) / nt::DOUBLE, 9) AS fpr, round((pt - pb) / pt::DOUBLE, 9) AS tpr FROM cum", _RANK),
    "calibration": _with("sc", "SELECT CAST(least(floor(prob * 10), 9) AS BIGINT) AS bin, round(avg(prob), 9) AS mean_pred, round(avg(y), 9) AS mean_label, count(*) AS n FROM sc GROUP BY 1"),
    "brier": _with("sc", "SELECT round(avg((prob - y) * (prob - y)), 9) AS brier FROM sc"),
    "classif_metrics": _with("sc", "SELECT round(avg(CASE WHEN (y = 1) = (prob > 0.5) THEN 1.0 ELSE 0 END), 9) AS accuracy, round(count(*) FILTER (y = 1 AND prob > 0.5) / count(*) FILTER (prob > 0.5)::DOUBLE, 9) AS precision, round(count(*) FILTER (y = 1 AND prob > 0.5) / count(*) FILTER (y = 1)::DOUBLE, 9) AS recall FROM sc"),
    "class_weights": _with("sc", "SELECT y, round((SELECT count(*) FROM sc) / (2.0::DOUBLE * count(*)), 9) AS weight FROM sc GROUP BY y"),
    "standard_scale": _with("pr", "SELECT instrument, pos, round((midprice - (SELECT avg(midprice) FROM pr)) / (SELECT stddev_pop(midprice) FROM pr), 6) AS midprice, round((spread - (SELECT avg(spread) FROM pr)) / (SELECT stddev_pop(spread) FROM pr), 6) AS spread FROM pr"),
    "union_sides": _with("l2", "SELECT instrument, pos, CASE side WHEN 'Buy' THEN 0 ELSE 1 END::BIGINT AS part, px, qty FROM l2"),
}
_SAMPLED = _chain(1000).removeprefix("WITH RECURSIVE ").rsplit("SELECT instrument, pos FROM hop", 1)
ORACLES["prediction_default"] = "WITH RECURSIVE " + _SAMPLED[0] + "SELECT instrument, pos, true AS none FROM hop" + _SAMPLED[1]
ORACLES["market_snapshots"] = f"""SELECT f.instrument, f.pos, b.ts_us AS seq, b.ts_us, best_bid, best_bid_qty, best_ask, best_ask_qty, f.* EXCLUDE (instrument, pos)
FROM ({ORACLES['features_all']}) f JOIN ({_with('bbo', 'SELECT * FROM bbo')}) b USING (instrument, pos) JOIN ({ORACLES['sample_snapshots']}) s USING (instrument, pos)"""

_BOTH = "(SELECT p.instrument, p.pos, " + _VOLUME.format("'Buy'") + " AS vb, " + _VOLUME.format("'Sell'") + " AS va FROM probe p)"
_EIGHT = "round(queue_imbalance, 9) AS top_imbalance, round(spread, 9) AS spread, round(midprice, 9) AS midprice, arrival_rate, cancel_rate, ofi"
ORACLES["queue_model_features"] = _with("lev probe pr rate ofi", f"SELECT p.instrument, p.pos, p.side, p.px, {_VOLUME.format('p.side')} AS depth_ahead, round(CASE WHEN vb + va = 0 THEN 0.5::DOUBLE ELSE vb / (vb + va)::DOUBLE END, 9) AS level_imbalance, {_EIGHT} FROM probe p JOIN {_BOTH} x USING (instrument, pos) JOIN pr USING (instrument, pos) JOIN rate USING (instrument, pos) JOIN ofi USING (instrument, pos)")
_FILLS = ORACLES["queue_fill_sim"]
ORACLES["queue_train_table"] = f"""SELECT q.instrument, q.pos, best_ask + 100 AS order_price, q.depth_ahead, round(best_bid_qty / (best_bid_qty + best_ask_qty)::DOUBLE, 9) AS level_imbalance, {_EIGHT}, fill_1ms, fill_5ms, fill_10ms
FROM ({_FILLS}) q JOIN ({_with('pr rate ofi', 'SELECT * FROM pr JOIN rate USING (instrument, pos) JOIN ofi USING (instrument, pos)')}) z USING (instrument, pos)"""
ORACLES["evaluate_sharpe"] = _with("sco", "SELECT instrument, round(avg(r) / greatest(stddev_pop(r), 1e-12) * sqrt(252 * 6.5 * 3600), 6) AS sharpe, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 9) AS right, count(*) AS n FROM (SELECT instrument, CASE WHEN (prob > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE -1.0 END AS r FROM sco) GROUP BY 1").replace('AS right', 'AS "right"')
ORACLES["depth_pipeline"] = _with(
    "ev",
    """SELECT m.pos, any_value(m.type) AS type, coalesce(max(v.px) FILTER (v.side = 'Buy'), 0) AS best_bid, coalesce(arg_max(v.qty, v.px) FILTER (v.side = 'Buy'), 0) AS best_bid_qty,
  coalesce(min(v.px) FILTER (v.side = 'Sell'), 0) AS best_ask, coalesce(arg_min(v.qty, v.px) FILTER (v.side = 'Sell'), 0) AS best_ask_qty
FROM k m LEFT JOIN (SELECT * FROM k WHERE qty > 0) v ON v.pos <= m.pos AND m.pos < v.nxt GROUP BY m.pos""",
    (("x", _DEPTH), ("k", "SELECT *, event_id * 3 + n AS pos, coalesce(lead(event_id * 3 + n) OVER w, 9223372036854775807) AS nxt, CASE WHEN qty = 0 THEN 'Delete' WHEN coalesce(lag(qty) OVER w, 0) = 0 THEN 'Add' ELSE 'Modify' END AS type FROM x WINDOW w AS (PARTITION BY side, px ORDER BY event_id * 3 + n)")),
)

# The order feed: the same statements over other messages, levels, rates and trade sides.
_FEED = {
    "of": """SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY pos) - 1 AS k, lead(pos) OVER (PARTITION BY order_id ORDER BY pos) IS NULL AS lst,
      first_value(qty) OVER (PARTITION BY order_id ORDER BY pos) AS total, order_id % 6 AS kind, px + CASE side WHEN 'Buy' THEN -50 ELSE 50 END AS px2 FROM l3""",
    "l2": """SELECT instrument, pos, pos * 20000 AS ts_us, order_id AS root,
      CASE WHEN k = 0 THEN 'Add' WHEN kind = 1 OR kind = 3 AND lst THEN 'Delete' WHEN kind = 2 THEN 'Trade' WHEN kind = 4 AND k = 1 THEN 'Replace' ELSE 'Execute' END AS type,
      CASE WHEN kind = 4 AND k > 1 THEN order_id + 1000000000 ELSE order_id END AS order_id, CASE WHEN kind = 4 AND k = 1 THEN order_id + 1000000000 ELSE 0 END AS new_order_id,
      CAST(CASE WHEN k = 0 OR kind = 2 THEN px WHEN kind = 4 AND k = 1 THEN px2 ELSE 0 END AS BIGINT) AS px,
      CAST(CASE WHEN kind = 3 AND lst AND k > 0 THEN 0 WHEN kind = 4 AND k = 1 THEN total ELSE qty END AS BIGINT) AS qty, CASE WHEN k = 0 THEN side ELSE 'Buy' END AS side FROM of""",
    "orem": """SELECT *, CASE WHEN kind = 3 AND lst AND k > 0 THEN 0 ELSE greatest(total - sum(CASE WHEN k = 0 OR kind = 4 AND k = 1 THEN 0 ELSE qty END) OVER (PARTITION BY order_id ORDER BY pos), 0) END AS rem FROM of""",
    "odel": """SELECT instrument, side, CASE WHEN kind = 4 AND k > 0 THEN px2 ELSE px END AS px, pos, CASE WHEN kind = 4 AND k = 1 THEN total ELSE rem - coalesce(lag(rem) OVER (PARTITION BY order_id ORDER BY pos), 0) END AS d FROM orem
      UNION ALL SELECT instrument, side, px, pos, -total FROM orem WHERE kind = 4 AND k = 1""",
    "lev": """SELECT instrument, side, px, pos, coalesce(lead(pos) OVER w, 9223372036854775807) AS next_pos, CAST(sum(d) OVER w AS BIGINT) AS vol FROM odel WHERE d <> 0 WINDOW w AS (PARTITION BY instrument, side, px ORDER BY pos)""",
    # Levels are listed by every 256 positions they stand in, so the interval join has an equality.
    "levb": "SELECT *, unnest(range(pos // 256, least(next_pos - 1, (SELECT max(pos) FROM l2)) // 256 + 1)) AS bk FROM lev WHERE vol > 0",
    "live": "SELECT m.instrument, m.pos, v.side, v.px, v.vol FROM l2 m JOIN levb v ON v.instrument = m.instrument AND v.bk = m.pos // 256 AND v.pos <= m.pos AND m.pos < v.next_pos",
    "rate": """SELECT instrument, pos, CAST(count(*) FILTER (type = 'Add') OVER w AS DOUBLE) AS arrival_rate, CAST(count(*) FILTER (type = 'Delete') OVER w AS DOUBLE) AS cancel_rate,
      CAST(count(*) FILTER (type IN ('Trade', 'Execute')) OVER w AS DOUBLE) AS trade_intensity FROM l2 WINDOW w AS (PARTITION BY instrument ORDER BY ts_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW)""",
    "buys": "SELECT l2.instrument, l2.pos, l2.ts_us, l2.type IN ('Trade', 'Execute') AS t, l2.type IN ('Trade', 'Execute') AND orem.rem > 0 AND orem.side = 'Sell' AS hit FROM l2 JOIN orem USING (instrument, pos)",
    "br0": "SELECT instrument, pos, count(*) FILTER (hit) OVER w / nullif(count(*) FILTER (t) OVER w, 0)::DOUBLE AS r FROM buys WINDOW w AS (PARTITION BY instrument ORDER BY ts_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW)",
}
# The published engine's quirks: trades a tick away, whole levels deleted, replaced orders on the bid side; id 0 is no order.
_QUIRKS = {
    "l2": _FEED["l2"].replace("SELECT instrument, pos,", "SELECT * REPLACE (CASE WHEN type = 'Trade' AND root % 12 = 2 THEN px + 100 ELSE px END AS px) FROM (SELECT instrument, pos,", 1) + ")",
    "cev": """SELECT instrument, CASE WHEN kind = 4 AND k > 1 THEN 'Buy' ELSE side END AS side, pos, 0 AS part, kind = 3 AND lst AND k > 0 AS sets,
        CASE WHEN kind = 4 AND k > 1 THEN px2 WHEN kind = 2 AND k > 0 AND order_id % 12 = 2 THEN px + 100 ELSE px END AS px,
        CASE WHEN k = 0 THEN qty WHEN kind = 3 AND lst THEN 0 WHEN kind = 4 AND k = 1 THEN -total ELSE -qty END AS d FROM orem WHERE order_id <> 0 OR k = 0
      UNION ALL SELECT instrument, 'Buy', pos, 1, false, px2, total FROM orem WHERE kind = 4 AND k = 1""",
    "cseg": "SELECT *, sum(CASE WHEN sets THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, side, px ORDER BY pos, part) AS seg FROM cev",
    "crun": "SELECT *, sum(d) OVER (PARTITION BY instrument, side, px, seg ORDER BY pos, part) AS s FROM cseg",
    "lev": """SELECT instrument, side, px, pos, coalesce(lead(pos) OVER (PARTITION BY instrument, side, px ORDER BY pos, part), 9223372036854775807) AS next_pos,
      CAST(s - least(0, min(s) OVER (PARTITION BY instrument, side, px, seg ORDER BY pos, part)) AS BIGINT) AS vol FROM crun""",
    "buys": _FEED["buys"].replace("orem.side = 'Sell'", "orem.side = 'Sell' AND NOT (orem.kind = 4 AND orem.k > 0)"),
}
_FEED_NEEDS = {"of": "l3", "l2": "of", "orem": "of", "odel": "orem", "lev": "odel", "levb": "lev l2", "live": "l2 levb", "buys": "l2 orem"}
_QUIRK_NEEDS = {"cev": "orem", "cseg": "cev", "crun": "cseg", "lev": "crun"}


def _feed_oracles(quirks: bool) -> dict[str, str]:
    kept = dict(_CTE), dict(_NEEDS)
    _CTE.update(_FEED | (_QUIRKS if quirks else {}))
    _NEEDS.update(_FEED_NEEDS | (_QUIRK_NEEDS if quirks else {}))
    try:
        full, best, chain = _with(_ALL, _FULL + _JOINS), _with("bbo", "SELECT * FROM bbo"), _chain(1000)
        snapshots = f"""SELECT f.instrument, f.pos, b.ts_us AS seq, b.ts_us, best_bid, best_bid_qty, best_ask, best_ask_qty, f.* EXCLUDE (instrument, pos)
FROM ({full}) f JOIN ({best}) b USING (instrument, pos) JOIN ({chain}) s USING (instrument, pos)"""
        if quirks:
            return {"order_bbo_compat": _with("bbo", "SELECT instrument, pos, best_bid, best_bid_qty, best_ask, best_ask_qty FROM bbo"), "itch_snapshots_compat": snapshots}
        return {
            "itch_messages": _with("l2", "SELECT instrument, pos, ts_us, type, order_id, new_order_id, px, qty, side FROM l2"),
            "itch_ranges": _with("l2", "SELECT instrument, pos, ts_us, type, order_id, new_order_id, px, qty, side FROM l2"),
            "order_bbo": _with("bbo", "SELECT instrument, pos, best_bid, best_bid_qty, best_ask, best_ask_qty FROM bbo"),
            "buy_ratio_orders": _with("br", "SELECT * FROM br"),
            "order_features": full,
            "itch_snapshots": snapshots,
        }
    finally:
        for now, before in zip((_CTE, _NEEDS), kept):
            now.clear()
            now.update(before)


ORACLES.update(_feed_oracles(False) | _feed_oracles(True))
