"""The registered queries in DuckDB SQL, with closed forms of the fixtures in place of the bit arithmetic."""

from __future__ import annotations

FRAMES = """f0 AS (
  SELECT event_id AS seq, (epoch_us(ts) - 1704067200000000) // 100000 AS t_us, CAST(user_id % 2 AS INTEGER) AS channel,
         CASE event_type WHEN 'click' THEN 272 WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 528 ELSE 200 END
              WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 816 ELSE 201 END WHEN 'signup' THEN 1952
              ELSE CASE WHEN user_id % 2 = 0 THEN 416944369 ELSE 416944370 END END AS id,
         event_type = 'error' AS extended, CASE WHEN event_type = 'purchase' THEN 3 ELSE 8 END AS dlc,
         CASE WHEN user_id % 5 = 0 THEN 'Tx' ELSE 'Rx' END AS dir, CAST(round(value * 100) AS BIGINT) AS w0, user_id AS u
  FROM events),
f AS (SELECT *, rpad(left(printf('%02X%02X%02X%02X%02X%02X%02X00', w0 % 256, w0 // 256, u % 256, (seq % 65536) // 256, seq % 256, (u * 7 + seq) % 256, seq % 8 + 8 * (u % 32)), CAST(dlc * 2 AS INTEGER)), 16, '0') AS data FROM f0),
m(channel, id, extended, name, dlc, transmitter) AS (VALUES (0, 272, false, 'DriveState', 8, 'DriveUnit'), (0, 528, false, 'BodyState', 8, 'BodyUnit'), (0, 816, false, 'StopInfo', 3, 'BodyUnit'),
  (0, 416944369, true, 'DiagReply', 8, ''), (1, 272, false, 'CabinState', 8, 'CabinUnit'), (1, 200, false, 'WheelState', 8, 'WheelUnit'), (1, 201, false, 'WheelShort', 3, 'WheelUnit')),
n(channel, node) AS (VALUES (0, 'DriveUnit'), (0, 'BodyUnit'), (0, 'Panel'), (0, 'Logger'), (1, 'CabinUnit'), (1, 'WheelUnit'), (1, 'Panel'), (1, 'Logger')),
dec AS (
  SELECT f.*, s.signal, s.ord, s.unit, s.lo, s.hi,
         CASE s.ord WHEN 0 THEN w0 WHEN 1 THEN u % 256 WHEN 2 THEN seq % 65536 WHEN 3 THEN (u * 7 + seq) % 256 WHEN 4 THEN seq % 8 ELSE u % 32 END AS raw,
         CASE s.ord WHEN 0 THEN w0 * 0.01::DOUBLE WHEN 1 THEN u % 256 - 40 WHEN 2 THEN seq % 65536
              WHEN 3 THEN (CASE WHEN (u * 7 + seq) % 256 >= 128 THEN (u * 7 + seq) % 256 - 256 ELSE (u * 7 + seq) % 256 END) * 0.5::DOUBLE WHEN 4 THEN seq % 8 ELSE u % 32 END::DOUBLE AS value
  FROM f JOIN m USING (channel, id)
  JOIN (VALUES ('Level', 0, 'u', 0, 655.35), ('Unit', 1, 'degC', -40, 215), ('Counter', 2, '', 0, 0), ('Trim', 3, '%', -64, 63.5), ('Phase', 4, '', 0, 7), ('Slot', 5, '', 0, 0)) s(signal, ord, unit, lo, hi)
    ON m.dlc = 8 OR s.ord < 2),
agg AS (SELECT channel, id, count(*) AS count, arg_min(extended, seq) AS extended, arg_max(dir, seq) AS dir, arg_max(dlc, seq) AS dlc, arg_max(data, seq) AS data, arg_max(t_us, seq) AS last_t_us FROM f GROUP BY channel, id),
d AS (SELECT *, CASE WHEN lag(t_us) OVER w IS NULL THEN NULL ELSE greatest(t_us - lag(t_us) OVER w, 0) END AS dt, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY channel, id ORDER BY seq)),
r AS (SELECT *, row_number() OVER (PARTITION BY channel, id ORDER BY seq DESC) - 1 AS r, count(dt) OVER (PARTITION BY channel, id) AS c FROM d),
cyc AS (SELECT channel, id, coalesce(min(dt), 0) / 1000.0::DOUBLE AS cycle_min_ms,
  round(coalesce(sum(CASE WHEN dt IS NULL THEN 0 WHEN r = c - 1 THEN pow(0.9::DOUBLE, r) * dt ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, r) * dt END), 0) / 1000.0, 6) AS cycle_avg_ms, coalesce(max(dt), 0) / 1000.0::DOUBLE AS cycle_max_ms FROM r GROUP BY channel, id)"""

# Values from 655.36 on leave the 16 bits of w0, of which a payload holds the low ones.
FRAMES_16 = FRAMES.replace("CAST(round(value * 100) AS BIGINT) AS w0", "CAST(round(value * 100) AS BIGINT) % 65536 AS w0")

THIN = """nx AS (SELECT seq, t_us, channel, id, min(seq) OVER (PARTITION BY channel, id ORDER BY t_us RANGE BETWEEN 50000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
  row_number() OVER (PARTITION BY channel, id ORDER BY seq) AS rn FROM f),
kept AS (SELECT seq, nxt FROM nx WHERE rn = 1 UNION ALL SELECT nx.seq, nx.nxt FROM kept JOIN nx ON nx.seq = kept.nxt),
k AS (SELECT dec.* FROM dec JOIN kept USING (seq))"""

THIN_HOT = THIN[: THIN.index("k AS (SELECT dec")].rstrip(",\n ").replace("FROM f)", "FROM fh)")

PARTS = """p AS (
  SELECT p_partkey % 2 AS channel, p_partkey AS id, p_partkey % 7 = 0 AS extended, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS name,
         regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS brand, regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g') AS kind, p_size, p_size % 10 = 0 AS nobody FROM part),
s AS (
  SELECT channel, id, extended, name, CASE WHEN nobody THEN '' ELSE brand END AS transmitter, 0 AS ord, 'Size' AS signal, 0 AS start_bit, p_size % 16 + 1 AS size, false AS big_endian, false AS signed,
         0.5::DOUBLE AS factor, -1.0::DOUBLE AS "offset", 'Panel,' || brand AS receivers, p_size::DOUBLE AS hi, brand FROM p
  UNION ALL
  SELECT channel, id, extended, name, CASE WHEN nobody THEN '' ELSE brand END, 1, kind, 23, p_size % 8 + 2, true, true, 2.0, 0.0, '', 0, brand FROM p)"""


def _f(body: str, thin: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if thin else ''}{FRAMES}{', ' + THIN if thin else ''} {body}"


def _g(body: str) -> str:
    return f"WITH {FRAMES_16} {body}"


def _p(body: str) -> str:
    return f"WITH {PARTS} {body}"


LINE = "(t_us // 1000000)::VARCHAR || '.' || lpad((t_us % 1000000)::VARCHAR, 6, '0') || '  ' || (channel + 1) || '  ' || printf('%X', id) || CASE WHEN extended THEN 'x' ELSE '' END || '  ' || dir || '  ' || dlc || '  ' || regexp_replace(left(data, CAST(dlc * 2 AS INTEGER)), '(..)(?=.)', '\\1 ', 'g')"
BYTES = "trim(regexp_replace(left(data, CAST(least(dlc, 8) * 2 AS INTEGER)), '(..)', '\\1 ', 'g'))"
LINE = LINE.replace("regexp_replace(left(data, CAST(dlc * 2 AS INTEGER)), '(..)(?=.)', '\\1 ', 'g')", BYTES)
BROKEN = f"""CASE seq % 42 WHEN 35 THEN regexp_replace(line, '^(\\S+)\\s+\\d+', '\\1 bus') WHEN 28 THEN '   ' WHEN 21 THEN regexp_replace(line, '\\S+$', 'ZZ')
  WHEN 14 THEN regexp_replace(line, '^(\\S+\\s+\\d+\\s+)\\S+', '\\11G') WHEN 7 THEN regexp_replace(line, '(Rx|Tx)', 'RX') ELSE regexp_replace(line, '^\\S+', '1d') END"""
BUS = "CASE channel WHEN 0 THEN 'CAN1' WHEN 1 THEN 'CAN2' ELSE 'CAN' || (channel + 1) END"
SMOOTH = """SELECT w, {cols}, round(CASE WHEN i0 IS NULL OR w < i0 THEN 0 ELSE (SELECT sum(CASE WHEN y.w = x.i0 THEN pow(0.9::DOUBLE, x.w - y.w) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, x.w - y.w) END * y.v) FROM z y WHERE y.w BETWEEN x.i0 AND x.w) END, 6) AS {out}
  FROM (SELECT *, (SELECT min(w) FROM z WHERE v > 0) AS i0 FROM z) x"""
SPINE = """q AS (SELECT t_us // 1000000 AS w, count(*)::BIGINT AS frames, sum(CASE WHEN extended THEN 67 ELSE 47 END + dlc * 8)::BIGINT AS bits FROM f GROUP BY 1),
sp AS (SELECT unnest(range(0, (SELECT max(w) + 1 FROM q))) AS w),
z AS (SELECT w, coalesce(frames, 0) AS frames, coalesce(bits, 0) AS bits, {v} AS v FROM sp LEFT JOIN q USING (w))"""

# Several runs: the same tables by run.
RUN = "'run' || (seq // 400)"
RUN_THIN = """fr AS (SELECT *, seq // 400 AS run FROM f),
nx AS (SELECT seq, run, min(seq) OVER (PARTITION BY run, channel, id ORDER BY t_us RANGE BETWEEN 50000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
  row_number() OVER (PARTITION BY run, channel, id ORDER BY seq) AS rn FROM fr),
kept AS (SELECT seq, nxt FROM nx WHERE rn = 1 UNION ALL SELECT nx.seq, nx.nxt FROM kept JOIN nx ON nx.seq = kept.nxt),
k AS (SELECT dec.*, seq // 400 AS run FROM dec JOIN kept USING (seq))"""
RUN_CYCLES = """rd AS (SELECT seq // 400 AS run, seq, channel, id, t_us, dlc, CASE WHEN lag(t_us) OVER w IS NULL THEN NULL ELSE greatest(t_us - lag(t_us) OVER w, 0) END AS dt, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY seq // 400, channel, id ORDER BY seq)),
rr AS (SELECT *, row_number() OVER (PARTITION BY run, channel, id ORDER BY seq DESC) - 1 AS r, count(dt) OVER (PARTITION BY run, channel, id) AS c FROM rd)"""

SQL = {
    "asc_scan": _g("SELECT seq, t_us, channel, id, extended, dlc, data, dir FROM f WHERE seq % 7 <> 0"),
    "asc_rejects": _f(f"SELECT seq, {BROKEN} AS value FROM (SELECT seq, {LINE} AS line FROM f WHERE seq % 7 = 0)"),
    "asc_render": _g(f"SELECT seq, {LINE} AS line FROM f"),
    "replay_until": _f("SELECT seq, t_us, channel, id FROM f WHERE seq < coalesce((SELECT min(seq) FROM f WHERE t_us > 10000000), 9223372036854775807)"),
    "trace_export": _f(f"SELECT seq, {LINE} AS line FROM (SELECT * FROM f ORDER BY seq DESC LIMIT 50000) f JOIN (SELECT channel, id, name FROM m) USING (channel, id) WHERE dir = 'Rx' AND (upper(name) LIKE '%STATE%' OR printf('%X', id) LIKE '%STATE%')"),
    "stats_export": _f(f"SELECT {BUS} AS bus, id, coalesce(name, '-') AS name, count, cycle_min_ms, cycle_avg_ms, cycle_max_ms, agg.dlc FROM agg JOIN cyc USING (channel, id) LEFT JOIN (SELECT channel, id, name FROM m) USING (channel, id)"),
    "messages_export": _f(f"SELECT {BUS} AS bus, id, coalesce(name, '-') AS name, dir, count, cycle_avg_ms AS cycle_ms, dlc, {BYTES} AS data FROM agg JOIN cyc USING (channel, id) LEFT JOIN (SELECT channel, id, name FROM m) USING (channel, id)"),
    "history_export": _f(f"SELECT t_us AS time_us, {BUS} AS bus, signal, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY channel, id, signal ORDER BY seq DESC) AS nth FROM k) WHERE nth <= 4000 AND channel = 0 AND id = 272 AND signal IN ('Level', 'Trim')", thin=True),
    "latest_export": _f(f"SELECT {BUS} AS bus, signal, coalesce(round(value, 6), 0) AS value, coalesce(unit, '') AS unit FROM (VALUES (0, 272, 'Level'), (1, 201, 'Unit'), (1, 99, 'Ghost')) v(channel, id, signal) LEFT JOIN (SELECT channel, id, signal, arg_max(value, seq) AS value, any_value(unit) AS unit FROM dec GROUP BY 1, 2, 3) USING (channel, id, signal)"),
    "catalogue_scan": _p("SELECT 'bus' || channel || '.dbc' AS path, id, extended, name, transmitter, ord, signal, start_bit, size, big_endian, signed, factor, \"offset\", receivers FROM s"),
    "catalogue_wrapped": _p("SELECT 'bus' || channel || '.dbc' AS path, id, extended, name, transmitter, ord, signal, start_bit, size, big_endian, signed, factor, \"offset\", receivers FROM s"),
    "catalogue_nodes": _p("SELECT 'bus' || channel || '.dbc' AS path, node, count(*) AS n FROM (SELECT channel, brand AS node FROM p UNION ALL SELECT channel, kind FROM p) GROUP BY 1, 2"),
    "bus_report": _p(
        "SELECT b.channel, bus_name, status, coalesce(messages, 0) AS messages, 2 * coalesce(messages, 0) AS signals, coalesce(rejects, 0) AS rejects FROM (VALUES (0, 'A', 'loaded'), (1, 'B', 'loaded'), (2, 'C', 'missing'), (3, 'D', 'no messages'), (4, 'E', 'not text'), (5, 'F', 'no path')) b(channel, bus_name, status) LEFT JOIN (SELECT channel, count(*) AS messages, count(*) FILTER (p_size % 9 = 0) AS rejects FROM p GROUP BY 1) USING (channel)"
    ),
    "bus_catalogue": _p("SELECT b.channel, bus_name, count(id) AS messages, coalesce(sum(id), 0)::BIGINT AS ids FROM (VALUES (0, 'A'), (1, 'B'), (2, 'C')) b(channel, bus_name) LEFT JOIN p ON p.channel = b.channel GROUP BY 1, 2"),
    "catalogue_search": _p("SELECT DISTINCT channel, id, name FROM s WHERE printf('%X', id) LIKE '%ED%' OR upper(name) LIKE '%ED%' OR upper(signal) LIKE '%ED%'"),
    "select_matching": _p("SELECT channel, id FROM p WHERE printf('%X', id) LIKE '%ED%' OR upper(name) LIKE '%ED%'"),
    "signal_search": _p("SELECT channel, id, name, signal FROM s WHERE upper(name) LIKE '%ED%' OR upper(signal) LIKE '%ED%'"),
    "signal_ranges": _p("SELECT channel, id, signal, CASE WHEN hi > 0 THEN 0.0 WHEN ord = 0 THEN -1.0 ELSE -pow(2, size - 1) * 2 END::DOUBLE AS low, CASE WHEN hi > 0 THEN hi WHEN ord = 0 THEN (pow(2, size) - 1) * 0.5 - 1 ELSE (pow(2, size - 1) - 1) * 2 END::DOUBLE AS high FROM s"),
    "node_rx": _p("SELECT s.channel, s.brand AS node, s.id, s.name, s.signal, s.transmitter AS sender FROM s JOIN (SELECT DISTINCT channel, transmitter FROM s WHERE transmitter <> '') t ON t.channel = s.channel AND t.transmitter = s.brand WHERE s.ord = 0"),
    "selection_counts": _p("SELECT channel, coalesce(id, -1) AS id, count(*) FILTER (size % 3 = 0) AS selected, count(*) AS total FROM s GROUP BY GROUPING SETS ((channel), (channel, id))"),
    "active_signals": _p("SELECT DISTINCT channel, id, signal FROM s WHERE size % 3 = 0 OR size % 2 = 0"),
    "selection_update": _p("SELECT DISTINCT channel, id FROM s WHERE (size % 3 = 0 OR size % 2 = 0) AND (channel, id) NOT IN (SELECT (channel, id) FROM s WHERE size > 9 AND (size % 3 = 0 OR size % 2 = 0))"),
    "extract_raw": _g("SELECT seq, signal, raw FROM dec"),
    "to_physical": _g("SELECT channel, id, signal, count(*) AS n, round(sum(value), 3) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM dec GROUP BY 1, 2, 3"),
    "from_physical": _g("SELECT seq AS frame, signal, CASE ord WHEN 0 THEN least(w0 * 3, 65535) WHEN 1 THEN least(greatest((u % 256 - 40) * 3 + 40, 0), 255) WHEN 2 THEN least((seq % 65536) * 3, 65535) WHEN 3 THEN (least(greatest(CAST(value * 6 AS BIGINT), -128), 127) + 256) % 256 WHEN 4 THEN least((seq % 8) * 3, 7) ELSE least((u % 32) * 3, 31) END AS raw FROM dec"),
    "pack_raw": _g("SELECT seq AS frame, signal, CASE ord WHEN 0 THEN printf('%02X%02X000000000000', w0 % 256, w0 // 256) WHEN 1 THEN printf('0000%02X0000000000', u % 256) WHEN 2 THEN printf('000000%02X%02X000000', (seq % 65536) // 256, seq % 256) WHEN 3 THEN printf('0000000000%02X0000', raw) WHEN 4 THEN printf('000000000000%02X00', seq % 8) ELSE printf('000000000000%02X00', 8 * (u % 32)) END AS data FROM dec"),
    "encode_batch": _g("SELECT seq AS frame, channel, id, f.extended, f.dlc, data FROM f JOIN (SELECT channel, id FROM m) USING (channel, id)"),
    "encode_unknown": _g("SELECT seq AS frame, channel, CASE WHEN seq % 3 = 0 THEN id + 1000 ELSE id END AS id, CASE WHEN seq % 3 = 0 THEN id + 1000 > 2047 ELSE f.extended END AS extended, CASE WHEN seq % 3 = 0 THEN 8 ELSE f.dlc END AS dlc, CASE WHEN seq % 3 = 0 THEN '0000000000000000' ELSE data END AS data FROM f JOIN (SELECT channel, id FROM m) USING (channel, id)"),
    "scope_bus": _g("SELECT seq, t_us, channel, id, extended, dlc, data, dir FROM f WHERE channel = 1"),
    "scope_manual": _g("SELECT seq, t_us, channel, id, extended, dlc, data, dir FROM f WHERE (channel = 0 AND id = 816) OR (channel = 1 AND id = 200)"),
    "trace_filter": _f("SELECT seq, channel, id, name, dir FROM f JOIN (SELECT channel, id, name FROM m) USING (channel, id) WHERE dir = 'Rx' AND (upper(name) LIKE '%STATE%' OR printf('%X', id) LIKE '%STATE%')"),
    "messages_filter": _f("SELECT channel, id, '-' AS name, count FROM agg ANTI JOIN m USING (channel, id)"),
    "drop_bus": _f("SELECT seq, channel - 1 AS channel, id FROM f WHERE channel > 0"),
    "bus_removed": _f(
        ", t(name, channel) AS (SELECT 'frames', channel FROM f UNION ALL SELECT 'buses', c FROM (VALUES (0), (1), (2)) x(c) UNION ALL SELECT 'messages', channel FROM m UNION ALL SELECT 'signals', channel FROM m, range(6) r(k) WHERE m.dlc = 8 OR k < 2 UNION ALL SELECT 'nodes', channel FROM n UNION ALL SELECT 'selections', c FROM (VALUES (0), (0), (1), (0), (1), (1)) x(c)) SELECT name, channel - 1 AS channel, count(*) AS n FROM t WHERE channel > 0 GROUP BY 1, 2"
    ),
    "trace_named": _g(f"SELECT seq, CASE WHEN extended THEN printf('%08X', id) || 'x' ELSE printf('%03X', id) END AS id_text, coalesce(name, '-') AS name, {BYTES} AS data FROM f LEFT JOIN (SELECT channel, id, name FROM m) USING (channel, id)"),
    "decode_signals": _f("SELECT seq, channel, id, signal, round(value, 6) AS value, unit FROM dec"),
    "decode_subscribed": _g("SELECT seq, channel, id, signal, round(value, 6) AS value FROM dec WHERE (channel = 0 AND id = 272 AND signal IN ('Level', 'Trim')) OR (channel = 1 AND id = 200 AND signal = 'Counter')"),
    "unknown_ids": _f("SELECT channel, id, count FROM agg ANTI JOIN m USING (channel, id)"),
    "node_tx": _f("SELECT n.channel, node, m.id, name, coalesce(count, 0) AS count FROM n JOIN m ON m.channel = n.channel AND m.transmitter = n.node LEFT JOIN agg ON agg.channel = m.channel AND agg.id = m.id"),
    "node_activity": _f("SELECT n.channel, node, coalesce(max(count), 0) > 0 AS active FROM n LEFT JOIN m ON m.channel = n.channel AND m.transmitter = n.node LEFT JOIN agg ON agg.channel = m.channel AND agg.id = m.id GROUP BY 1, 2"),
    "node_summary": _f(", to_node(signal, receiver) AS (VALUES ('Level', 'Panel'), ('Counter', 'Panel'), ('Trim', 'Panel'), ('Trim', 'Logger')) SELECT n.channel, node, count(m.id) AS sent, coalesce(sum(count), 0)::BIGINT AS frames, (SELECT count(*) FROM m x JOIN to_node ON x.dlc = 8 OR to_node.signal = 'Level' WHERE x.channel = n.channel AND to_node.receiver = n.node) AS received FROM n LEFT JOIN m ON m.channel = n.channel AND m.transmitter = n.node LEFT JOIN agg ON agg.channel = m.channel AND agg.id = m.id GROUP BY 1, 2"),
    "message_agg": _f("SELECT channel, id, count, extended, dir, dlc, data, last_t_us FROM agg"),
    "cycle_stats": _f("SELECT * FROM cyc"),
    "bus_share": _f("SELECT channel, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share FROM f GROUP BY channel"),
    "statistics": _f("SELECT channel, id, coalesce(name, '-') AS name, count, round(count / sum(count) OVER () * 100, 6) AS share, agg.extended, agg.dlc, cycle_min_ms, cycle_avg_ms, cycle_max_ms FROM agg JOIN cyc USING (channel, id) LEFT JOIN (SELECT channel, id, name FROM m) USING (channel, id)"),
    "messages_decoded": _f("SELECT channel, id, ord, signal, round(arg_max(value, seq), 6) AS value, any_value(unit) AS unit FROM dec GROUP BY channel, id, ord, signal"),
    "run_summary": _f("SELECT (SELECT count(*) FROM f) AS frames, least((SELECT count(*) FROM f), 50000) AS trace, (SELECT count(*) FROM (SELECT DISTINCT channel, id, signal FROM dec)) AS signals"),
    "cycle_delta": _f("SELECT seq, channel, id, k AS count, coalesce(dt, -1) AS dt FROM d"),
    "cycle_running": f"WITH RECURSIVE {FRAMES}, e AS (SELECT channel, id, k, seq, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM d WHERE k = 1 UNION ALL SELECT d.channel, d.id, d.k, d.seq, CASE WHEN e.v IS NULL THEN d.dt ELSE 0.9::DOUBLE * e.v + 0.1::DOUBLE * d.dt END, least(coalesce(e.lo, d.dt), d.dt), greatest(coalesce(e.hi, d.dt), d.dt) FROM e JOIN d ON d.channel = e.channel AND d.id = e.id AND d.k = e.k + 1) SELECT seq, k AS count, round(coalesce(v, -1), 3) AS ewma_us, coalesce(lo, -1) AS min_us, coalesce(hi, -1) AS max_us FROM e",
    "frame_rate": _f(", " + SPINE.format(v="coalesce(frames, 0)::DOUBLE") + " " + SMOOTH.format(cols="frames", out="rate")),
    "bus_load": _f(", " + SPINE.format(v="coalesce(bits, 0) / 500000.0::DOUBLE * 100") + " " + SMOOTH.format(cols="bits", out="load")),
    "trace_newest": _f("SELECT seq, t_us, channel, id, extended, dlc, data, dir FROM (SELECT * FROM f ORDER BY seq DESC LIMIT 50000) WHERE channel = 1 ORDER BY seq DESC LIMIT 1000"),
    "trace_ring": _f("SELECT seq, t_us, channel, id FROM f ORDER BY seq DESC LIMIT 50000"),
    "view_counts": _f(", rows_ AS (SELECT agg.channel, agg.id, count, coalesce(name, '-') AS name, m.name IS NOT NULL AS known, agg.dir FROM agg LEFT JOIN m USING (channel, id)), v(view) AS (VALUES ('all'), ('bus1'), ('manual'), ('empty'), ('text'), ('hex'), ('dash')) SELECT view, count(id) AS messages, coalesce(sum(count), 0)::BIGINT AS frames FROM v LEFT JOIN rows_ ON CASE view WHEN 'all' THEN true WHEN 'bus1' THEN channel = 1 WHEN 'manual' THEN (channel = 0 AND id = 816) OR (channel = 1 AND id = 200) WHEN 'empty' THEN false WHEN 'text' THEN known AND (lower(name) LIKE '%state%' OR printf('%x', id) LIKE '%state%') WHEN 'hex' THEN lower(name) LIKE '%7a%' OR printf('%x', id) LIKE '%7a%' ELSE name LIKE '%-%' END GROUP BY view"),
    "scan_statistics": _f(", " + RUN_CYCLES + " SELECT 'run' || run AS run_id, channel, id, coalesce(any_value(name), '-') AS name, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY run) * 100, 6) AS share, arg_max(rr.dlc, seq) AS dlc, coalesce(min(dt), 0) / 1000.0::DOUBLE AS cycle_min_ms, round(coalesce(sum(CASE WHEN dt IS NULL THEN 0 WHEN r = c - 1 THEN pow(0.9::DOUBLE, r) * dt ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, r) * dt END), 0) / 1000.0, 6) AS cycle_avg_ms, coalesce(max(dt), 0) / 1000.0::DOUBLE AS cycle_max_ms FROM rr LEFT JOIN (SELECT channel, id, name FROM m) USING (channel, id) GROUP BY run, channel, id"),
    "scan_message_agg": _f(f"SELECT {RUN} AS run_id, channel, id, count(*) AS count, arg_min(extended, seq) AS extended, arg_max(dir, seq) AS dir, arg_max(dlc, seq) AS dlc, arg_max(data, seq) AS data, arg_max(t_us, seq) AS last_t_us FROM f GROUP BY 1, 2, 3"),
    "frame_rate_wild": _f(
        ", q AS (SELECT seq // 400 AS run, (t_us + CASE WHEN seq = 399 THEN 1000000000000000 ELSE 0 END) // 1000000 AS w, count(*)::BIGINT AS frames FROM f WHERE seq % 97 <> 0 GROUP BY 1, 2), g AS (SELECT *, lag(w) OVER r AS w0, lead(w) OVER r AS w1 FROM q WINDOW r AS (PARTITION BY run ORDER BY w)), i AS (SELECT *, sum(CASE WHEN w0 IS NULL OR w - w0 > 8192 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY w) AS island, w0 IS NULL OR w - w0 > 8192 AS first FROM g), x AS (SELECT run, island, w AS own, frames, unnest(range(w, CASE WHEN w1 IS NULL THEN w + 1 ELSE least(w1, w + 51) END)) AS w FROM i) SELECT 'run' || run AS run_id, w, CASE WHEN w = own THEN frames ELSE 0 END AS frames, round((SELECT sum(CASE WHEN y.first THEN 1 ELSE 0.1::DOUBLE END * pow(0.9::DOUBLE, x.w - y.w) * y.frames) FROM i y WHERE y.run = x.run AND y.island = x.island AND y.w <= x.w), 6) AS rate FROM x"
    ),
    "scan_cycle_delta": _f(", " + RUN_CYCLES + " SELECT 'run' || run AS run_id, channel, id, k AS count, t_us, coalesce(dt, -1) AS dt FROM rd"),
    "trace_view_runs": _f(f", ring AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq // 400 ORDER BY seq DESC) AS nth FROM f) WHERE nth <= 150), shown AS (SELECT *, row_number() OVER (PARTITION BY seq // 400 ORDER BY seq DESC) AS n2 FROM ring WHERE channel = 1) SELECT {RUN} AS run_id, seq, channel, id, coalesce(name, '-') AS name FROM shown LEFT JOIN (SELECT channel, id, name FROM m) USING (channel, id) WHERE n2 <= 40"),
    "run_summary_runs": _f(f", n_ AS (SELECT {RUN} AS run_id, count(*) AS frames FROM f GROUP BY 1), s_ AS (SELECT {RUN} AS run_id, count(DISTINCT (channel, id, signal)) AS signals FROM dec GROUP BY 1) SELECT run_id, frames, least(frames, 150) AS trace, coalesce(signals, 0) AS signals FROM n_ LEFT JOIN s_ USING (run_id)"),
    "bus_load_runs": _f(", q AS (SELECT seq // 400 AS run, channel, t_us // 50000 AS w, sum(CASE WHEN extended THEN 67 ELSE 47 END + dlc * 8)::BIGINT AS bits FROM f GROUP BY 1, 2, 3), ends AS (SELECT run, min(w) AS a, max(w) AS b FROM q GROUP BY 1), sp AS (SELECT run, channel, unnest(range(a, b + 1)) AS w FROM (SELECT DISTINCT run, channel FROM q) JOIN ends USING (run)), z AS (SELECT run, channel, w, coalesce(bits, 0) AS bits, coalesce(bits, 0) / 0.05::DOUBLE / 500000 * 100 AS v FROM sp LEFT JOIN q USING (run, channel, w)), x AS (SELECT *, (SELECT min(w) FROM z y WHERE y.run = z.run AND y.channel = z.channel AND y.v > 0) AS i0 FROM z) SELECT 'run' || run AS run_id, channel, w, bits, round(CASE WHEN i0 IS NULL OR w < i0 THEN 0 ELSE (SELECT sum(CASE WHEN y.w = x.i0 THEN pow(0.9::DOUBLE, x.w - y.w) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, x.w - y.w) END * y.v) FROM z y WHERE y.run = x.run AND y.channel = x.channel AND y.w BETWEEN x.i0 AND x.w) END, 6) AS load FROM x"),
    "viewport_overlay": f"WITH RECURSIVE {FRAMES}, {RUN_THIN} SELECT 'run' || run AS run_id, round(lo, 6) AS lo, round(CASE WHEN hi - lo < 1e-9 THEN lo + 1 ELSE hi END, 6) AS hi FROM (SELECT run, coalesce(min(value) FILTER (t_us >= 1000000), 0) AS lo, coalesce(max(value) FILTER (t_us >= 1000000), 1) AS hi FROM k GROUP BY 1)",
    "signal_samples": _f("SELECT channel, id, signal, seq, t_us, round(value, 6) AS value FROM k", thin=True),
    "history_ring": _f("SELECT channel, id, signal, seq, t_us, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY channel, id, signal ORDER BY seq DESC) AS nth FROM k) WHERE nth <= 4000", thin=True),
    "history_full": _f(
        "SELECT signal, seq, t_us, round(CASE s.ord WHEN 0 THEN w0 * 0.01::DOUBLE WHEN 1 THEN u % 256 - 40 WHEN 2 THEN seq % 65536 WHEN 3 THEN (CASE WHEN (u * 7 + seq) % 256 >= 128 THEN (u * 7 + seq) % 256 - 256 ELSE (u * 7 + seq) % 256 END) * 0.5::DOUBLE WHEN 4 THEN seq % 8 ELSE u % 32 END::DOUBLE, 6) AS value FROM (SELECT * FROM f WHERE dlc = 8 ORDER BY seq DESC LIMIT 4000), (VALUES ('Level', 0), ('Unit', 1), ('Counter', 2), ('Trim', 3), ('Phase', 4), ('Slot', 5)) s(signal, ord)"
    ),
    "samples_hot": f"WITH RECURSIVE {FRAMES}, fh AS (SELECT seq, t_us, CASE WHEN seq % 10 = 0 THEN channel ELSE 0 END AS channel, CASE WHEN seq % 10 = 0 THEN id ELSE 272 END AS id FROM f), {THIN_HOT} SELECT seq, t_us, channel, id FROM fh JOIN kept USING (seq)",
    "subscribed_samples": f"WITH RECURSIVE {FRAMES}, sub(subscription, channel, id, signal, a, b) AS (VALUES ('a', 0, 272, 'Level', 5000000, 15000000), ('b', 0, 272, 'Trim', 5000000, 15000000), ('c', 0, 272, 'Level', 7013000, NULL), ('d', 1, 200, 'Counter', 0, 20000000), ('e', 1, 99, 'Ghost', 0, NULL)), fs AS (SELECT f.seq, f.t_us, sub.* FROM f JOIN sub ON f.channel = sub.channel AND f.id = sub.id AND t_us >= a AND (b IS NULL OR t_us < b)), nx AS (SELECT subscription, seq, min(seq) OVER (PARTITION BY subscription ORDER BY t_us RANGE BETWEEN 50000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, row_number() OVER (PARTITION BY subscription ORDER BY seq) AS rn FROM fs), kept AS (SELECT subscription, seq, nxt FROM nx WHERE rn = 1 UNION ALL SELECT nx.subscription, nx.seq, nx.nxt FROM kept JOIN nx ON nx.subscription = kept.subscription AND nx.seq = kept.nxt) SELECT kept.subscription, dec.channel, dec.id, dec.signal, seq, t_us, round(value, 6) AS value FROM kept JOIN sub ON sub.subscription = kept.subscription JOIN dec USING (seq) WHERE dec.signal = sub.signal",
    "signal_minmax": _f("SELECT channel, id, signal, round(min(value), 6) AS low, round(max(value), 6) AS high FROM k GROUP BY 1, 2, 3", thin=True),
    "latest_values": _f("SELECT channel, id, signal, max(t_us) AS t_us, round(arg_max(value, seq), 6) AS value, any_value(unit) AS unit, round(CASE WHEN any_value(hi) > any_value(lo) THEN greatest(least((arg_max(value, seq) - any_value(lo)) / (any_value(hi) - any_value(lo)), 1), 0) ELSE 0 END, 6)::DOUBLE AS gauge FROM dec GROUP BY 1, 2, 3"),
    "viewport": _f("SELECT channel, id, signal, round(lo, 6) AS lo, round(CASE WHEN hi - lo < 1e-9 THEN lo + 1 ELSE hi END, 6) AS hi FROM (SELECT channel, id, signal, coalesce(min(value) FILTER (t_us >= 10000000), 0) AS lo, coalesce(max(value) FILTER (t_us >= 10000000), 1) AS hi FROM k GROUP BY 1, 2, 3)", thin=True),
    "viewport_points": _f(
        "SELECT channel, id, signal, seq, round(least((t_us - 10000000) / 10000000.0::DOUBLE, 1), 7) AS x, round((value - vlo) / (CASE WHEN vhi - vlo < 1e-9 THEN 1 ELSE vhi - vlo END), 6) AS y FROM (SELECT *, min(value) OVER w AS vlo, max(value) OVER w AS vhi, count(*) OVER w AS n FROM k WHERE t_us >= 10000000 WINDOW w AS (PARTITION BY channel, id, signal)) WHERE n >= 2",
        thin=True,
    ),
    "cursor_values": _f(
        ", pr AS (SELECT DISTINCT channel, id, signal, t FROM k, (SELECT -1 AS t UNION ALL SELECT unnest(range(0, 31)) * 1000000)), v AS (SELECT pr.channel, pr.id, pr.signal, t, (SELECT round(arg_max(value, seq), 6) FROM k WHERE k.channel = pr.channel AND k.id = pr.id AND k.signal = pr.signal AND k.t_us <= t) AS x FROM pr) SELECT channel, id, signal, t AS t_us, CASE WHEN t < 0 OR x IS NULL THEN '-' WHEN abs(x) >= 1000 THEN printf('%.0f', round(x, 0)) WHEN abs(x) >= 10 THEN printf('%.1f', round(x, 1)) ELSE printf('%.2f', round(x, 2)) END AS text FROM v",
        thin=True,
    ),
    "history_extent": _f("SELECT min(t_us) AS oldest_us, greatest(30000000 - min(t_us), 0) AS span_us FROM (SELECT *, row_number() OVER (PARTITION BY channel, id, signal ORDER BY seq DESC) AS nth FROM k) WHERE nth <= 4000", thin=True),
}
