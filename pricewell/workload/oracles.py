"""DuckDB SQL giving the same rows as `queries`, written from the table definitions."""

from __future__ import annotations

from pricewell.workload import queries as q

STATION = """
  SELECT c_custkey AS node_id, c_name AS trading_name, c_mktsegment AS brand_name,
         CASE WHEN c_acctbal >= 0 THEN c_nationkey::VARCHAR || ' ' || c_mktsegment END AS address_line_1,
         CASE WHEN c_acctbal >= 5000 THEN '' WHEN c_acctbal >= 2000 THEN 'Unit 1' END AS address_line_2,
         'CITY_' || c_nationkey::VARCHAR AS city,
         substr(c_mktsegment, 1, 4) || lpad(c_nationkey::VARCHAR, 2, '0') AS postcode,
         c_acctbal / 100 AS latitude, c_nationkey::DOUBLE AS longitude
  FROM customer"""
TYPES = "(VALUES (1,'view','View'),(2,'signup','Sign-up'),(3,'error','Error'),(4,'purchase','Purchase'),(5,'click','Click')) AS t(id, code, display)"
PRICE = f"""
  SELECT user_id AS node_id, t.id::BIGINT AS fuel_type_id, t.code, t.display, value AS price, ts AS updated,
         date_trunc('minute', ts) AS effective
  FROM events JOIN {TYPES} ON t.code = event_type"""
FLAGS = "(VALUES (1,'A','Accepted'),(2,'N','None'),(3,'R','Returned')) AS t(id, code, display)"
LINE_PRICE = f"""
  SELECT l_suppkey AS node_id, t.id::BIGINT AS fuel_type_id, t.code, t.display, l_extendedprice AS price,
         l_shipdate AS updated, l_shipdate + to_hours(l_linenumber) AS effective
  FROM lineitem JOIN {FLAGS} ON t.code = l_returnflag"""
ADDRESS = "concat_ws(', ', address_line_1, address_line_2, city, postcode)"


def repair(c: str) -> str:
    return f"CASE WHEN {c} <= 10 THEN {c} * 100.0::DOUBLE WHEN {c} >= 1000 THEN {c} / 10.0::DOUBLE ELSE {c} END"


def label(ts: str) -> str:
    return f"strftime(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London', '%-d %B %Y')"


def digest(c: str) -> str:
    return f"upper(sha256({c}))"


def latest(rows: str) -> str:
    return f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY node_id, fuel_type_id ORDER BY updated DESC, effective DESC, price DESC) AS rn
    FROM ({rows})) WHERE rn = 1"""


def latest_columns(rows: str) -> str:
    return f"""
SELECT node_id, fuel_type_id, price, epoch_us(updated) AS price_last_updated,
       epoch_us(effective) AS price_change_effective_timestamp
FROM ({latest(rows)})"""


def report(stations: str, rows: str, ranking: str, where: str = "true") -> str:
    return f"""
WITH chosen AS (SELECT node_id, trading_name FROM ({stations}) WHERE {where}),
     l AS ({latest(rows)})
SELECT l.node_id,
       CASE WHEN row_number() OVER (PARTITION BY l.node_id ORDER BY fuel_type_id) = 1 THEN trading_name ELSE '' END AS name,
       display AS fuel_type, price, {label('effective')} AS effective_date,
       max(price) FILTER (WHERE code = '{ranking}') OVER (PARTITION BY l.node_id) AS rank_price
FROM l JOIN chosen USING (node_id)"""


SUPPLIER = "SELECT s_suppkey AS node_id, s_name AS trading_name, s_nationkey::VARCHAR AS postcode FROM supplier"
BAD_STATION = "(latitude < -5 OR brand_name = 'MACHINERY')"
BAD_EVENT = """((event_type = 'error' AND value < 20) OR (event_type = 'signup' AND value > 200)
           OR (event_type = 'click' AND value < 5))"""
PAGE = f"floor(event_id / {500}) + 1"
HEX = "upper(lpad(to_hex({}), 64, '0'))"
CODES = "(VALUES ('view','E10',5),('signup','E5',6),('error','B7_STANDARD',2),('purchase','HVO',4),('click','B10',3)) AS f(kind, code, id)"
GOOD_PRICES = f"""
  SELECT {HEX.format('user_id')} AS node_id, f.id::BIGINT AS fuel_type_id, event_id, ts,
         CASE WHEN event_type = 'purchase' THEN 250.0::DOUBLE ELSE {repair('value')} END AS price,
         date_trunc('second', ts) AS updated, date_trunc('minute', ts) AS effective
  FROM events JOIN {CODES} ON f.kind = event_type
  WHERE NOT {BAD_EVENT}
    AND user_id IN (SELECT node_id FROM ({STATION}) WHERE NOT {BAD_STATION})"""


def stored(rows: str) -> str:
    return f"""
SELECT node_id, fuel_type_id, price, epoch_us(updated) AS price_last_updated,
       epoch_us(effective) AS price_change_effective_timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY node_id, fuel_type_id, updated, effective ORDER BY event_id DESC) AS rn
      FROM ({rows})) WHERE rn = 1"""


def ts(moment) -> str:
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


MERGE = f"""
WITH once AS (
  SELECT node_id, fuel_type_id, date_trunc('second', updated) AS updated, effective, max(price) AS price
  FROM ({PRICE}) GROUP BY ALL),
tgt AS (SELECT * FROM once WHERE updated < TIMESTAMP '2024-01-20 00:00:00'),
src AS (SELECT node_id, fuel_type_id, updated, effective, {repair('price')} AS price FROM once
        WHERE updated >= TIMESTAMP '2024-01-10 00:00:00'),
merged AS (
  SELECT node_id, fuel_type_id, updated, coalesce(s.price, t.price) AS price,
         CASE WHEN t.price IS NULL THEN 'inserted' WHEN s.price IS NULL THEN 'kept'
              WHEN s.price <> t.price THEN 'updated' ELSE 'unchanged' END AS action
  FROM tgt t FULL JOIN src s USING (node_id, fuel_type_id, updated, effective))"""

SESSIONS = """
  SELECT user_id, min(ts) AS s, max(ts) AS e, count(*) AS n_touches FROM (
    SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
      SELECT user_id, ts, event_id,
             CASE WHEN lag(ts) OVER w > ts - INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS starts
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
  GROUP BY user_id, session"""
LAST_STATE = """
  SELECT * FROM (SELECT user_id, event_id, ts, props,
                        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn = 1"""


def parts(keys: str, bucket: str, order: str, rows: str) -> str:
    return f"""
  SELECT *, (row_number() OVER (PARTITION BY {keys}, bucket ORDER BY {order}) - 1) // {q.SERIES_SIZE} AS part
  FROM (SELECT *, {bucket} AS bucket FROM ({rows}))"""


NINE_TENTHS = "(SELECT greatest(1, (max({}) // 500 + 1) * 9 // 10) FROM {})"
# Stored prices with what the report shows of them.
STORED_PRICE = """
  SELECT p.node_id, fuel_type_id, c.name AS code, c.display, price, make_timestamp(price_last_updated) AS updated,
         make_timestamp(price_change_effective_timestamp) AS effective
  FROM ({}) p JOIN (VALUES (2,'B7_STANDARD','B7 standard'),(3,'B10','B10'),(4,'HVO','HVO'),(5,'E10','Petrol E10'),(6,'E5','Petrol E5')) AS c(id, name, display)
  ON c.id = fuel_type_id"""
STORED_STATION = f"SELECT * REPLACE ({HEX.format('node_id')} AS node_id) FROM ({STATION}) s WHERE NOT {BAD_STATION}"
CUT_ID = f"(node_id // 500 + 1 >= {NINE_TENTHS.format('c_custkey', 'customer')})"
CUT_PRICE = f"(event_id // 500 + 1 >= {NINE_TENTHS.format('c_custkey', 'customer')})"

ORACLES = {
    "prefix_scan": f"""
SELECT node_id, {digest('node_id::VARCHAR')} AS node_hex, postcode, trading_name
FROM ({STATION}) WHERE postcode ILIKE '{q.PREFIX}%'""",
    "point_lookup": f"""
SELECT {digest('node_id::VARCHAR')} AS node_id, trading_name, {ADDRESS} AS full_address, latitude, longitude
FROM ({STATION}) WHERE {digest('node_id::VARCHAR')} = upper('{q.LOOKUP}')""",
    "station_facts": f"""
SELECT node_id, fuel_type_id::SMALLINT AS fuel_type_id, price, epoch_us(updated) AS price_last_updated
FROM ({PRICE}) WHERE node_id = 0""",
    "id_status": f"""
WITH asked AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN substr({digest('user_id::VARCHAR')}, 1, 63)
           WHEN 'signup' THEN {digest("'x' || user_id::VARCHAR")}
           WHEN 'click' THEN lower({digest('user_id::VARCHAR')}) ELSE {digest('user_id::VARCHAR')} END AS id
  FROM events)
SELECT event_id, CASE WHEN NOT regexp_full_match(id, '[0-9a-fA-F]{{64}}') THEN 'malformed'
         WHEN EXISTS (SELECT 1 FROM customer WHERE {digest('c_custkey::VARCHAR')} = upper(id)) THEN 'valid'
         ELSE 'absent' END AS status
FROM asked""",
    "incremental_scan": f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS feed_ts,
       strftime(ts - INTERVAL 60 SECOND, '%Y-%m-%d %H:%M:%S') AS overlap_ts
FROM events WHERE ts >= {ts(q.CURSOR)} - INTERVAL 60 SECOND""",
    "unit_repair": f"SELECT event_id, {repair('value')} AS price FROM events",
    "unit_repair_large": f"SELECT l_orderkey, l_linenumber, {repair('l_extendedprice')} AS price FROM lineitem",
    "date_labels": f"""
SELECT event_id AS id, 'event' AS kind, {label('ts')} AS label FROM events
UNION ALL
SELECT o_orderkey, 'order', {label("(o_orderdate + INTERVAL '23 hours 30 minutes')")} FROM orders""",
    "full_address": f"SELECT node_id, trading_name, {ADDRESS} AS full_address, latitude, longitude FROM ({STATION})",
    "csv_list": """
WITH s AS (SELECT p_partkey, p_size, list_filter(string_split(
             concat_ws(',', p_brand, '', replace(p_name, ' ', ',,'), p_type, ''), ','), lambda x: x <> '') AS items FROM part)
SELECT p_partkey, len(items)::BIGINT AS n_items, array_to_string(items, ',') AS csv, p_size::DOUBLE::VARCHAR AS size_text
FROM s""",
    "strict_rows": f"""
SELECT fuel_type_id::SMALLINT AS fuel_type_id, count(*) AS n_rows, min(price) AS least, max(price) AS most,
       max(epoch_us(updated)) AS newest FROM ({PRICE}) GROUP BY 1""",
    "one_per_key": """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "dim_left_join": """
SELECT l_orderkey, l_linenumber, l_suppkey, r_name FROM lineitem LEFT JOIN region ON l_linenumber = r_regionkey""",
    "dim_strict": """
SELECT c_custkey, n_nationkey AS nation_id FROM customer JOIN nation ON n_name = 'NATION_' || c_nationkey::VARCHAR""",
    "absent_keys": """
SELECT user_id AS node_id, event_id FROM events
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal >= 0)""",
    "present_rows": """
SELECT user_id AS node_id, event_id, value FROM events
WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal >= 0)""",
    "station_prices_nested": f"""
WITH p AS ({parts('node_id', "date_trunc('week', updated)", 'updated, effective, code, price', PRICE)}),
     l AS (SELECT node_id, bucket, part, count(*) AS n,
                  string_agg(epoch_us(updated)::VARCHAR || '|' || code || '|' || price::VARCHAR, ';'
                             ORDER BY updated, effective, code, price) AS txt
           FROM p GROUP BY ALL)
SELECT s.node_id, trading_name, strftime(bucket, '%Y-%m-%d') AS bucket, coalesce(part, 0)::BIGINT AS part,
       coalesce(n, 0) AS n_prices, coalesce(txt, '') AS fuel_prices
FROM ({STATION}) s LEFT JOIN l USING (node_id)""",
    "latest_per_type": latest_columns(LINE_PRICE),
    "latest_per_type_events": latest_columns(PRICE),
    "latest_report": report(STATION, PRICE, "purchase"),
    "postcode_report": report(STATION, PRICE, "purchase", "postcode ILIKE 'auto%'"),
    "supplier_report": report(SUPPLIER, LINE_PRICE, "N"),
    "cheapest_order": f"""
SELECT s.node_id, trading_name, l.price AS rank_price
FROM ({STATION}) s LEFT JOIN (SELECT * FROM ({latest(PRICE)}) WHERE code = 'purchase') l USING (node_id)
ORDER BY rank_price NULLS FIRST, node_id""",
    "history_points": f"SELECT node_id, display AS name, epoch_us(effective) // 1000 AS x, price AS y FROM ({PRICE})",
    "history_series_json": f"""
WITH p AS ({parts('node_id, display', "date_trunc('week', effective)", 'effective, price', PRICE)})
SELECT node_id, strftime(bucket, '%Y-%m-%d') AS bucket, part,
       '{{"name":"' || display || '","data":[' ||
       string_agg('{{"x":' || (epoch_us(effective) // 1000)::VARCHAR || ',"y":' || price::VARCHAR || '}}', ','
                  ORDER BY effective, price) || ']}}' AS series
FROM p GROUP BY node_id, bucket, part, display""",
    "supplier_history": f"""
WITH p AS (SELECT *, year(effective) AS year,
             (row_number() OVER (PARTITION BY node_id, display, year(effective) ORDER BY effective, price) - 1) // 10000 AS part
           FROM ({LINE_PRICE}))
SELECT node_id, display AS name, year::BIGINT AS year, part, count(*) AS n_points,
       min(epoch_us(effective)) // 1000 AS first_x, max(epoch_us(effective)) // 1000 AS last_x, max(price) AS dearest,
       string_agg((epoch_us(effective) // 1000)::VARCHAR || ':' || price::VARCHAR, ',' ORDER BY effective, price) AS points
FROM p GROUP BY node_id, display, year, part""",
    "last_writer": """
SELECT l_suppkey, l_returnflag, shipped, l_orderkey, l_linenumber, l_extendedprice, batch_number FROM (
  SELECT *, epoch_us(l_shipdate) AS shipped, (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END)::BIGINT AS batch_number,
         row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_shipdate
           ORDER BY CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END DESC, l_orderkey DESC, l_linenumber DESC,
                    l_extendedprice DESC) AS rn
  FROM lineitem) WHERE rn = 1""",
    "upsert_all_columns": f"""
WITH tgt AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate FROM orders
             WHERE o_orderdate < TIMESTAMP '2000-01-01'),
src AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
               CASE WHEN o_orderpriority = '1-URGENT' THEN {repair('o_totalprice')} ELSE o_totalprice END AS o_totalprice
        FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
m AS (SELECT o_orderkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus,
             coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice,
             coalesce(s.o_orderpriority, t.o_orderpriority) AS o_orderpriority, t.o_orderdate,
             CASE WHEN t.o_totalprice IS NULL THEN 'inserted' WHEN s.o_totalprice IS NULL THEN 'kept'
                  WHEN s.o_totalprice <> t.o_totalprice THEN 'updated' ELSE 'unchanged' END AS action
      FROM tgt t FULL JOIN src s USING (o_orderkey))
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, action,
       epoch_us(CASE WHEN action IN ('inserted', 'updated') THEN {ts(q.BATCH_TS)} ELSE o_orderdate END) AS last_updated
FROM m""",
    "upsert_one_column": f"""{MERGE}
SELECT node_id, fuel_type_id, epoch_us(updated) AS price_last_updated, price, action,
       epoch_us(CASE WHEN action IN ('inserted', 'updated') THEN {ts(q.BATCH_TS)} ELSE updated END) AS last_updated
FROM merged""",
    "upsert_counts": f"""{MERGE}
SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated,
       count(*) FILTER (WHERE action = 'unchanged') AS unchanged FROM merged""",
    "prune_prices": f"SELECT event_id, user_id, epoch_us(ts) AS last_updated FROM events WHERE NOT ts < {ts(q.SINCE)}",
    "prune_stations_cascade": f"""
WITH age AS (SELECT o_custkey AS node_id, max(o_orderdate) AS newest FROM orders GROUP BY 1)
SELECT node_id, NULL::BIGINT AS event_id, 'station' AS kind FROM age WHERE newest >= {ts(q.STATION_SINCE)}
UNION ALL
SELECT user_id, event_id, 'price' FROM events
WHERE user_id NOT IN (SELECT node_id FROM age WHERE newest < {ts(q.STATION_SINCE)})""",
    "station_items": f"""
SELECT (floor(node_id / 500) + 1)::BIGINT AS batch_number,
       row_number() OVER (PARTITION BY floor(node_id / 500) ORDER BY node_id) - 1 AS idx,
       CASE WHEN NOT {BAD_STATION} THEN {HEX.format('s.node_id')} END AS node_id,
       CASE WHEN NOT {BAD_STATION} THEN address_line_2 END AS address_line_2,
       CASE WHEN NOT {BAD_STATION} THEN longitude END AS longitude,
       concat_ws(', ', CASE WHEN latitude < -5 THEN 'trading_name' END,
                 CASE WHEN brand_name = 'MACHINERY' THEN 'location.longitude' END) AS reason
FROM ({STATION}) s""",
    "price_items": f"""
WITH i AS (SELECT *, ({PAGE})::BIGINT AS batch_number,
                  row_number() OVER (PARTITION BY {PAGE} ORDER BY event_id) - 1 AS idx FROM events),
p AS (SELECT *, 0::BIGINT AS price_idx, value AS price FROM i
      UNION ALL SELECT *, 1::BIGINT, 2.5::DOUBLE FROM i WHERE event_type = 'purchase')
SELECT batch_number, idx, price_idx, {HEX.format('user_id')} AS node_id, f.code AS fuel_type, price,
       epoch_us(ts) // 1000 AS updated_ms, epoch_us(date_trunc('minute', ts)) // 1000 AS effective_ms
FROM p JOIN {CODES} ON f.kind = event_type WHERE NOT {BAD_EVENT}""",
    "reject_summary": f"""
SELECT 'stations: ' || concat_ws(', ', CASE WHEN latitude < -5 THEN 'trading_name' END,
         CASE WHEN brand_name = 'MACHINERY' THEN 'location.longitude' END) AS reason, count(*) AS n_items
FROM ({STATION}) WHERE {BAD_STATION} GROUP BY 1
UNION ALL
SELECT 'prices: ' || CASE event_type WHEN 'error' THEN 'node_id' WHEN 'signup' THEN 'trading_name' ELSE 'fuel_prices' END,
       count(*) FROM events WHERE {BAD_EVENT} GROUP BY 1""",
    "unknown_types": f"""
WITH i AS (SELECT *, ({PAGE})::BIGINT AS batch_number,
                  row_number() OVER (PARTITION BY {PAGE} ORDER BY event_id) - 1 AS idx FROM events)
SELECT batch_number, idx, CASE event_type WHEN 'error' THEN 'node_id' WHEN 'signup' THEN 'trading_name'
         WHEN 'click' THEN 'fuel_prices' ELSE 'fuel_type' END AS reason
FROM i WHERE {BAD_EVENT} OR event_type = 'purchase'""",
    "page_sequence": """
WITH p AS (SELECT (floor(event_id / 20) + 1)::BIGINT AS batch_number, count(*) FILTER (WHERE value > 100) AS n_items
           FROM events GROUP BY 1)
SELECT batch_number, n_items,
       batch_number < (SELECT min(n) FROM (SELECT 1 AS n UNION ALL SELECT batch_number + 1 FROM p WHERE n_items > 0) c
                       WHERE n NOT IN (SELECT batch_number FROM p WHERE n_items > 0)) AS used
FROM p""",
    "full_load": stored(GOOD_PRICES),
    "partial_load": f"""
{stored(f"SELECT * FROM ({GOOD_PRICES}) WHERE ts >= {ts(q.CURSOR)} - INTERVAL 60 SECOND")}
UNION ALL
SELECT 'STATIONS-AND-PRICES', NULL, NULL, epoch_us({ts(q.BATCH_TS)} - INTERVAL 60 SECOND), NULL""",
    "stream_ingest": stored(GOOD_PRICES),
    "stream_restart": stored(GOOD_PRICES),
    "stream_late_station": stored(GOOD_PRICES),
    "malformed_page": stored(f"SELECT * FROM ({GOOD_PRICES}) WHERE event_id // 500 + 1 < {NINE_TENTHS.format('event_id', 'events')}"),
    "stored_dimension": f"""
SELECT * REPLACE (CASE fuel_type_id WHEN 4 THEN 9 ELSE fuel_type_id END AS fuel_type_id) FROM ({stored(GOOD_PRICES)})""",
    "stored_stations": f"""
SELECT {HEX.format('s.node_id')} AS node_id, trading_name, brand_name, address_line_1, address_line_2, city, postcode, latitude,
       longitude, false AS temporary_closure, NULL::BOOLEAN AS permanent_closure, 'E10,E5' AS fuel_types,
       epoch_us({ts(q.SINCE)}) AS last_updated
FROM ({STATION}) s WHERE NOT {BAD_STATION}""",
    "report_file": report(STATION, PRICE, "purchase"),
    "page_files": f"""
SELECT event_id // 500 + 1 AS batch_number, count(*) AS n_items FROM events
WHERE event_id // 500 + 1 < {NINE_TENTHS.format('event_id', 'events')} GROUP BY 1""",
    "table_retention": f"""
SELECT 'CARS' AS name, count(*) AS n_rows FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
UNION ALL
SELECT fuel_type_id::VARCHAR, count(DISTINCT (node_id, date_trunc('second', updated), effective)) FROM ({PRICE})
WHERE node_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE') GROUP BY 1""",
    "activity_sessions": f"""
SELECT user_id, epoch_us(s) AS session_start, epoch_us(e) AS session_end, n_touches FROM ({SESSIONS})""",
    "active_users": f"""
SELECT user_id, epoch_us(max(ts)) AS last_touch FROM events GROUP BY 1
HAVING max(ts) > {ts(q.AS_OF)} - INTERVAL 15 MINUTE""",
    "unexpired_state": f"""
SELECT user_id, epoch_us(ts) AS last_touch, props FROM ({LAST_STATE}) WHERE NOT ts < {ts(q.AS_OF)} - INTERVAL 1 HOUR""",
    "state_latest": f"SELECT user_id, event_id, epoch_us(ts) AS last_touch, props FROM ({LAST_STATE})",
    "stream_sessions": f"""
SELECT user_id, epoch_us(s) AS session_start, epoch_us(e) AS session_end, n_touches FROM ({SESSIONS})
WHERE epoch_us(e) + 899999999 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)""",
    "stream_state": f"""
SELECT user_id, event_id, epoch_us(ts) AS last_touch, props FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
WHERE (next IS NULL OR next > ts + INTERVAL 1 HOUR)
  AND epoch_us(ts) + 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)""",
}
ORACLES["stream_rejects"] = f"""
{ORACLES['reject_summary']}
UNION ALL
SELECT 'absent station', count(*) FROM events WHERE NOT {BAD_EVENT}
AND user_id NOT IN (SELECT node_id FROM ({STATION}) WHERE NOT {BAD_STATION}) HAVING count(*) > 0"""
ORACLES |= {
    "increment_load": f"""
SELECT *, epoch_us({ts(q.BATCH_TS)} - INTERVAL 60 SECOND) AS cursor FROM ({stored(GOOD_PRICES)})""",
    "malformed_ids": f"""
WITH s AS (SELECT {HEX.format('s.node_id')} AS id, node_id, latitude, brand_name, {CUT_ID} AS cut FROM ({STATION}) s),
bad AS (
  SELECT concat_ws(', ', CASE WHEN cut THEN 'node_id' END, CASE WHEN latitude < -5 THEN 'trading_name' END,
                   CASE WHEN brand_name = 'MACHINERY' THEN 'location.longitude' END) AS reason FROM s
  UNION ALL
  SELECT concat_ws(', ', CASE WHEN (event_type = 'error' AND value < 20) OR {CUT_PRICE} THEN 'node_id' END,
                   CASE WHEN event_type = 'signup' AND value > 200 THEN 'trading_name' END,
                   CASE WHEN event_type = 'click' AND value < 5 THEN 'fuel_prices' END) FROM events)
SELECT 'quarantine: rejected' AS kind, reason AS name, count(*) AS n_items FROM bad WHERE reason <> '' GROUP BY ALL
UNION ALL
SELECT kind, id, 1 FROM (VALUES ('fail: station'), ('quarantine: station')) k(kind), s WHERE NOT cut AND NOT {BAD_STATION}
UNION ALL
SELECT kind, node_id, count(*) FROM (VALUES ('fail: price'), ('quarantine: price')) k(kind),
  ({stored(f"SELECT * FROM ({GOOD_PRICES}) WHERE NOT {CUT_PRICE} AND node_id IN (SELECT id FROM s WHERE NOT cut)")}) GROUP BY ALL
UNION ALL
SELECT 'fail: failed', unnest(['load_stations', 'load_prices']), 1""",
    "stored_postcode_report": report(STORED_STATION, STORED_PRICE.format(stored(GOOD_PRICES)), "HVO", f"postcode ILIKE '{q.STORED_PREFIX}%'"),
    "stored_station_history": f"""
WITH p AS ({STORED_PRICE.format(stored(GOOD_PRICES))})
SELECT node_id, display AS name, epoch_us(effective) // 1000 AS x, price AS y, {ADDRESS} AS full_address
FROM p JOIN ({STORED_STATION}) USING (node_id) WHERE node_id = (SELECT min(node_id) FROM p)""",
    "report_after_increments": report(STORED_STATION, STORED_PRICE.format(f"""
SELECT node_id, fuel_type_id, price, epoch_us(updated) AS price_last_updated, epoch_us(effective) AS price_change_effective_timestamp
FROM (SELECT *, (event_id // 500 + 1) % 3 AS turn, row_number() OVER (PARTITION BY node_id, fuel_type_id, updated, effective
               ORDER BY (event_id // 500 + 1) % 3 DESC, event_id DESC) AS rn FROM ({GOOD_PRICES}))
WHERE rn = 1 AND turn > 0"""), "HVO"),
    "series_append": f"""
WITH p AS (SELECT *, year(effective) AS year,
             (row_number() OVER (PARTITION BY node_id, fuel_type_id, year(effective) ORDER BY effective, price) - 1) // {q.STORED_SIZE} AS part
           FROM ({LINE_PRICE}))
SELECT node_id, fuel_type_id, year::BIGINT AS year, part, count(*) AS n,
       string_agg((epoch_us(effective) // 1000)::VARCHAR || ':' || price::VARCHAR, ',' ORDER BY effective, price) AS points
FROM p GROUP BY node_id, fuel_type_id, year, part""",
    "stream_out_of_order": stored(
        GOOD_PRICES.replace("250.0::DOUBLE", "12.5::DOUBLE").replace(repair("value"), repair("('1' || value::VARCHAR)::DOUBLE"))
    ),
    "stream_overlap": f"""
SELECT replace(reason, 'prices: ', '') AS reason, n_items FROM ({ORACLES['stream_rejects']})
WHERE NOT starts_with(reason, 'stations: ')""",
    "parked_expiry": stored(f"SELECT * FROM ({GOOD_PRICES}) WHERE (event_id // 500 + 1) % 2 = 1"),
    "stream_active_users": """
WITH w AS (
  SELECT user_id, ts, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 MINUTE,
                                             ts + INTERVAL 15 MINUTE - INTERVAL 1 MICROSECOND, INTERVAL 1 MINUTE)) AS as_of FROM events),
u AS (SELECT as_of, user_id, max(ts) AS last FROM w
      WHERE epoch_us(as_of) <= (SELECT (epoch_us(max(ts)) - 1) // 1000 * 1000 - 3600000000 FROM events) GROUP BY ALL)
SELECT epoch_us(as_of) AS as_of, count(*) AS n_users, epoch_us(max(last)) AS newest FROM u GROUP BY as_of""",
}
