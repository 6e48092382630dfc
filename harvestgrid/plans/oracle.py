"""The registered queries in SQL, written apart from the DataFrame code, for a comparison run."""

from __future__ import annotations

# --- shared pieces ------------------------------------------------------------------------------

PANEL = """
    sums AS (
        SELECT o_custkey AS loc_id, year(o_orderdate)::BIGINT AS year, sum(c)::BIGINT AS total, count(*) AS n,
               min(c) AS low, max(c) AS high
        FROM (SELECT o_custkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
        GROUP BY 1, 2),
    raw AS (
        SELECT loc_id, year, total / 1000000e0 AS yield, n::DOUBLE AS f1, total / 100e0 / n AS f2,
               CASE WHEN n > 1 THEN low / 100e0 END AS f3, high / 100e0 AS f4
        FROM sums),
    stats AS (
        SELECT avg(f1) m1, avg(f2) m2, avg(f3) m3, avg(f4) m4,
               stddev_samp(f1) s1, stddev_samp(f2) s2, stddev_samp(f3) s3, stddev_samp(f4) s4
        FROM raw WHERE year <= 2000),
    panel AS (
        SELECT loc_id, year, yield,
               coalesce((f1 - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 0) AS f1,
               coalesce((f2 - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 0) AS f2,
               coalesce((f3 - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END, 0) AS f3,
               coalesce((f4 - m4) / CASE WHEN s4 = 0 THEN 1 ELSE s4 END, 0) AS f4
        FROM raw, stats WHERE yield >= 5),
    means AS (SELECT year, avg(yield) AS avg_yield FROM panel GROUP BY year),
    scalars AS (
        SELECT year, avg_yield,
               (avg_yield - (SELECT avg(avg_yield) FROM means))
               / nullif((SELECT stddev_samp(avg_yield) FROM means), 0) AS ybar
        FROM means)
"""

VECTORS = """
    vec AS (
        SELECT label::BIGINT AS loc_id, (1995 + vec_id % 7)::BIGINT AS year, 5.0e0 + vec_id % 11 AS yield,
               embedding::DOUBLE[] AS features, vec_id AS src_order
        FROM embeddings),
    last_vec AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loc_id, year ORDER BY src_order DESC) AS rn FROM vec)
        WHERE rn = 1)
"""


def lat(key: str) -> str:
    return f"(24.0037e0 + (({key}) * 37 % 2200) / 100e0)"


def lon(key: str) -> str:
    return f"(122.0041e0 + (({key}) * 53 % 2400) / 100e0)"


def celled(source: str) -> str:
    """Adds the digits, the code and the row and column of the cell of (lat, lon)."""
    return f"""
        SELECT *, concat(p, u, q, v, r, w) AS code8, concat(p, u) AS tile4,
               (p * 80 + q * 10 + r)::BIGINT AS iy, (u * 80 + v * 10 + w)::BIGINT AS ix,
               p >= 10 AND p <= 99 AND u >= 10 AND u <= 99 AS on_grid,
               p / 1.5e0 + q / 12e0 + r / 120e0 + 1 / 240e0 AS clat,
               u + 100 + v / 8e0 + w / 80e0 + 1 / 160e0 AS clon
        FROM (
            SELECT *, floor((b_ - q) * 10)::BIGINT AS r, floor((d_ - v) * 10)::BIGINT AS w
            FROM (
                SELECT *, floor(b_)::BIGINT AS q, floor(d_)::BIGINT AS v
                FROM (
                    SELECT *, (a_ - p) * 8 AS b_, (c_ - u) * 8 AS d_
                    FROM (SELECT *, lat * 1.5e0 AS a_, floor(lat * 1.5e0)::BIGINT AS p,
                                 lon - 100e0 AS c_, floor(lon - 100e0)::BIGINT AS u
                          FROM ({source})))))
    """


WEATHER = """
    weather AS (
        SELECT user_id AS place, CAST(ts AS DATE) AS date, event_type AS element,
               sum(CAST(round(value * 100) AS BIGINT))::BIGINT / 100e0 / count(*) AS value
        FROM events GROUP BY 1, 2, 3)
"""

_EVENTS = f"""SELECT *, event_type AS element, CAST(round(value * 100) AS BIGINT) AS c, {lat('user_id')} AS lat, {lon('user_id')} AS lon
              FROM events"""
_MEAN = "sum(c)::BIGINT / 100e0 / count(*) AS value"

GRID = f"""
    {WEATHER},
    observed AS (
        SELECT element, 'observed' AS kind, tile4 AS tile, code8 AS mesh_code, clat AS lat, clon AS lon, iy, ix,
               CAST(ts AS DATE) AS date, {_MEAN}
        FROM ({celled(_EVENTS)}) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9),
    type_means AS (
        SELECT element, tile4, code8, clat, clon, iy, ix, {_MEAN} FROM ({celled(_EVENTS)}) GROUP BY 1, 2, 3, 4, 5, 6, 7),
    normal AS (
        SELECT element, 'normal' AS kind, tile4 AS tile, code8 AS mesh_code, clat AS lat, clon AS lon, iy, ix,
               CAST(d AS DATE) AS date, value
        FROM type_means,
             generate_series(DATE '2024-01-01', DATE '2024-01-20', INTERVAL 1 DAY) AS g(d))
"""

STATIC = f"""
    static_cells AS (
        SELECT 'altitude' AS element, tile4 AS tile, code8 AS mesh_code, clat AS lat, clon AS lon, iy, ix, c_acctbal AS raw
        FROM ({celled(f"SELECT *, {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon FROM customer")})
        UNION ALL
        SELECT 'landuse', tile4, code8, clat, clon, iy, ix, c_nationkey::DOUBLE
        FROM ({celled(f"SELECT *, {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon FROM customer")})),
    static AS (
        SELECT element, tile, mesh_code, lat, lon, iy, ix, max(raw) AS value FROM static_cells GROUP BY 1, 2, 3, 4, 5, 6, 7)
"""

BOXES = f"""
    boxes AS (
        SELECT c_custkey AS box_id, {lat('c_custkey')} AS south, {lat('c_custkey')} + (c_custkey % 7) * 0.9e0 AS north,
               {lon('c_custkey')} AS west, {lon('c_custkey')} + (c_custkey % 5) * 1.1e0 AS east
        FROM customer)
"""

RECORDS = f"""
    records AS (
        SELECT o_orderkey AS record_id,
               CASE WHEN o_orderkey % 10 <> 3 THEN 'C' || o_custkey::VARCHAR END AS place,
               year(o_orderdate)::BIGINT AS year, {lat('o_orderkey')} AS lat, {lon('o_orderkey')} AS lon,
               CASE WHEN o_orderkey % 9 <> 2 THEN o_totalprice END AS yield,
               CASE WHEN o_orderkey % 7 = 1 THEN ' 　 ' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS seed_date,
               CASE WHEN o_orderkey % 11 = 5 THEN '' ELSE o_orderpriority END AS harvest_date
        FROM orders)
"""

WIDE = f"""
    {WEATHER},
    wide AS (
        SELECT place, date, 2023::BIGINT AS year,
               max(CASE WHEN element = 'click' THEN value END) AS click,
               max(CASE WHEN element = 'error' THEN value END) AS error,
               max(CASE WHEN element = 'purchase' THEN value END) AS purchase,
               max(CASE WHEN element = 'signup' THEN value END) AS signup,
               max(CASE WHEN element = 'view' THEN value END) AS "view"
        FROM weather GROUP BY 1, 2)
"""

AREA_CASE = """CASE
    WHEN south >= 118 / 3e0 AND north <= 46 AND west >= 139 AND east <= 146 THEN 1
    WHEN south >= 208 / 6e0 AND north <= 42 AND west >= 137 AND east <= 143 THEN 2
    WHEN south >= 32 AND north <= 232 / 6e0 AND west >= 135 AND east <= 142 THEN 3
    WHEN south >= 196 / 6e0 AND north <= 220 / 6e0 AND west >= 130 AND east <= 138 THEN 4
    WHEN south >= 172 / 6e0 AND north <= 106 / 3e0 AND west >= 128 AND east <= 133 THEN 5
    WHEN south >= 24 AND north <= 88 / 3e0 AND west >= 122 AND east <= 132 THEN 6 END"""

SEASON = """CASE WHEN month(date) >= 4 THEN year(date)
                 WHEN month(date) < 3 OR day(date) <= 24 THEN year(date) - 1 END"""

SQL: dict[str, str] = {}

# --- panel and sequences ------------------------------------------------------------------------

SQL["panel_zscore"] = f"""
WITH {PANEL}
SELECT loc_id, year, yield, round(f1, 6) + 0 AS z1, round(f2, 6) + 0 AS z2, round(f3, 6) + 0 AS z3, round(f4, 6) + 0 AS z4
FROM panel
"""

SQL["vec_zscore"] = f"""
WITH {VECTORS},
long AS (SELECT src_order, loc_id, year, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM vec),
st AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_samp(x) = 0 THEN 1 ELSE stddev_samp(x) END AS s FROM long WHERE year <= 2000 GROUP BY pos)
SELECT src_order, loc_id, year, long.pos::BIGINT AS pos, round((x - m) / s, 6) + 0 AS z FROM long JOIN st ON long.pos = st.pos
"""

SQL["year_stats"] = f"""
WITH {PANEL}
SELECT year, round(avg_yield, 6) AS avg_yield, round(ybar, 6) + 0 AS ybar FROM scalars
UNION ALL
SELECT 2002, round(avg_yield, 6), round(ybar, 6) + 0 FROM scalars
WHERE year = 2001 AND NOT EXISTS (SELECT 1 FROM scalars WHERE year = 2002)
"""

SQL["train_sequences"] = f"""
WITH {PANEL},
ranked AS (SELECT *, dense_rank() OVER (ORDER BY year) AS rk FROM panel),
ends AS (
    SELECT loc_id, rk, year AS last_year, yield AS y_last,
           count(*) OVER (PARTITION BY loc_id ORDER BY rk RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS n,
           max(CASE WHEN year = 2001 THEN 1 ELSE 0 END)
               OVER (PARTITION BY loc_id ORDER BY rk RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS held
    FROM ranked)
SELECT e.loc_id, e.last_year, (r.rk - e.rk + 5)::BIGINT AS step, r.year, round(f1, 6) + 0 AS e1, round(f2, 6) + 0 AS e2,
       round(f3, 6) + 0 AS s1, round(f4, 6) + 0 AS p1, round(ybar, 6) + 0 AS ybar, r.yield AS step_yield, e.y_last
FROM ends e JOIN ranked r ON r.loc_id = e.loc_id AND r.rk BETWEEN e.rk - 4 AND e.rk
JOIN scalars s ON s.year = r.year
WHERE e.n = 5 AND e.held = 0
"""

SQL["holdout_sequences"] = f"""
WITH {PANEL},
year_means AS (
    SELECT year, avg(f1) AS f1, avg(f2) AS f2, avg(f3) AS f3, avg(f4) AS f4 FROM panel GROUP BY year),
mean_steps AS (
    SELECT y::BIGINT AS year, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3, coalesce(f4, 0) AS f4,
           CASE WHEN f1 IS NULL THEN 0 ELSE ybar END AS ybar, avg_yield
    FROM generate_series(1997, 2000) AS g(y) LEFT JOIN year_means m ON m.year = y LEFT JOIN scalars s ON s.year = y),
own AS (SELECT * FROM panel WHERE year = 2001)
SELECT o.loc_id, 2001::BIGINT AS last_year, (m.year - 1996)::BIGINT AS step, m.year, round(m.f1, 6) + 0 AS e1,
       round(m.f2, 6) + 0 AS e2, round(m.f3, 6) + 0 AS s1, round(m.f4, 6) + 0 AS p1, round(m.ybar, 6) + 0 AS ybar,
       round(m.avg_yield, 6) AS step_yield, o.yield AS y_last
FROM own o, mean_steps m
UNION ALL
SELECT o.loc_id, 2001, 5, 2001, round(f1, 6) + 0, round(f2, 6) + 0, round(f3, 6) + 0, round(f4, 6) + 0, round(ybar, 6) + 0,
       round(o.yield, 6), o.yield
FROM own o JOIN scalars s ON s.year = 2001
"""

SQL["dedupe_last"] = f"""
WITH {VECTORS}
SELECT loc_id, year, yield, i - 1 AS entry, features[i] AS feature FROM last_vec, generate_series(1, 64) AS g(i)
"""

SQL["feature_groups"] = f"""
WITH {VECTORS}
SELECT src_order, CASE WHEN i <= 52 THEN 'e' WHEN i <= 60 THEN 's' ELSE 'p' END AS feature_group,
       i - 1 - CASE WHEN i <= 52 THEN 0 WHEN i <= 60 THEN 52 ELSE 60 END AS entry, features[i] AS feature
FROM vec, generate_series(1, 64) AS g(i)
"""

SQL["feature_ablation"] = f"""
WITH {VECTORS},
m AS (SELECT year, avg(yield) AS y FROM last_vec GROUP BY year),
sc AS (SELECT year, (y - (SELECT avg(y) FROM m)) / nullif((SELECT stddev_samp(y) FROM m), 0) AS ybar FROM m),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY year) AS rk FROM last_vec),
ends AS (
    SELECT loc_id, rk, year AS last_year, yield AS y_last,
           count(*) OVER (PARTITION BY loc_id ORDER BY rk RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS n
    FROM ranked)
SELECT e.loc_id, e.last_year, (r.rk - e.rk + 5)::BIGINT AS step, r.year, r.features[1] AS e_first, r.features[52] AS e_last,
       52::BIGINT AS e_size, round(ybar, 6) + 0 AS ybar, r.yield AS step_yield, e.y_last
FROM ends e JOIN ranked r ON r.loc_id = e.loc_id AND r.rk BETWEEN e.rk - 4 AND e.rk JOIN sc ON sc.year = r.year
WHERE e.n = 5 AND e.last_year <> 2001 AND NOT EXISTS (
    SELECT 1 FROM ranked h WHERE h.loc_id = e.loc_id AND h.year = 2001 AND h.rk BETWEEN e.rk - 4 AND e.rk)
"""

SQL["weekly_reshape"] = f"""
WITH {VECTORS}
SELECT src_order, (i - 1) // 13 + 1 AS variable, (i - 1) % 13 AS week, features[i] AS feature FROM vec, generate_series(1, 52) AS g(i)
"""

SQL["keyed_lookup"] = f"""
WITH {PANEL}
SELECT a.loc_id, a.year, a.yield, b.yield AS next_yield
FROM panel a JOIN panel b ON b.loc_id = a.loc_id AND b.year = a.year + 1
WHERE EXISTS (SELECT 1 FROM panel h WHERE h.loc_id = a.loc_id AND h.year = 2001)
"""

SQL["panel_csv_load"] = f"""
WITH {PANEL}
SELECT loc_id, year, yield, f1, f2, f3, f4 FROM raw
"""

SQL["rows_per_year"] = f"""
WITH {PANEL}
SELECT year, count(*) AS rows FROM panel GROUP BY year
"""

# --- completeness -------------------------------------------------------------------------------

SQL["complete_records"] = f"""
WITH {RECORDS}
SELECT record_id, place, year, lat, lon FROM records
WHERE place IS NOT NULL AND year IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND yield IS NOT NULL
  AND seed_date IS NOT NULL AND harvest_date IS NOT NULL
"""

SQL["complete_blank"] = f"""
WITH {RECORDS}
SELECT record_id, place, year, lat, lon FROM records
WHERE lat IS NOT NULL AND lon IS NOT NULL AND yield IS NOT NULL
  AND trim(seed_date, ' 　') <> '' AND trim(harvest_date, ' 　') <> ''
"""

_PROFILED = ("place", "year", "lat", "lon", "yield", "seed_date", "harvest_date", "record_id")
SQL["null_profile"] = f"""
WITH {RECORDS},
counts AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(*) AS row_count FROM records" for c in _PROFILED)})
SELECT column_name, missing::BIGINT AS missing, (SELECT sum(missing) FROM counts)::BIGINT AS total_missing, row_count,
       (SELECT sum(missing) FROM counts) = 0 AS complete
FROM counts
"""

# --- mesh and time ------------------------------------------------------------------------------

_POINTS = f"SELECT c_custkey, {lat('c_custkey')} - CASE WHEN c_custkey % 13 = 0 THEN 20e0 ELSE 0e0 END AS lat, {lon('c_custkey')} AS lon FROM customer"

SQL["mesh_encode"] = f"""
SELECT c_custkey, CASE WHEN on_grid THEN code8 END AS mesh_code, CASE WHEN on_grid THEN tile4 END AS tile, iy AS row, ix AS "column"
FROM ({celled(_POINTS)})
"""

SQL["mesh_decode"] = f"""
SELECT c_custkey, code8 AS mesh_code, round(clat, 9) AS lat, round(clon, 9) AS lon, code8 AS again, NULL::DOUBLE AS short_lat
FROM ({celled(_POINTS)}) WHERE on_grid
"""

SQL["grid_axis"] = f"""
WITH b AS (
    SELECT c_custkey AS box_id, {lat('c_custkey')} AS south, {lat('c_custkey')} + (c_custkey % 7) * 0.05e0 AS north,
           {lon('c_custkey')} AS west, {lon('c_custkey')} + (c_custkey % 5) * 0.05e0 AS east
    FROM customer)
SELECT box_id, 'lat' AS axis, (i + 0.5e0) / 120e0 AS centre
FROM b, generate_series(floor(south * 120)::BIGINT, floor(north * 120)::BIGINT) AS g(i) WHERE south < north
UNION ALL
SELECT box_id, 'lon', (i + 0.5e0) / 80e0
FROM b, generate_series(floor(west * 80)::BIGINT, floor(east * 80)::BIGINT) AS g(i) WHERE west < east
"""

SQL["day_axis"] = """
SELECT o_orderkey, CAST(d AS DATE) AS day
FROM (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + (o_orderkey % 4)::INT, INTERVAL 1 DAY)) AS d FROM orders)
"""

SQL["parse_dates"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day,
       CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day_text
FROM orders
"""

SQL["parse_hours"] = """
SELECT event_id,
       CASE event_id % 6
            WHEN 0 THEN d + INTERVAL 1 HOUR
            WHEN 1 THEN d + to_hours(hour(ts))
            WHEN 2 THEN d + to_hours(hour(ts) + CASE WHEN minute(ts) > 30 THEN 1 ELSE 0 END)
            WHEN 3 THEN d + INTERVAL 24 HOUR END AS start_hour,
       CASE event_id % 6
            WHEN 0 THEN d + INTERVAL 24 HOUR
            WHEN 1 THEN d + to_hours(hour(ts))
            WHEN 2 THEN d + to_hours(hour(ts) + CASE WHEN minute(ts) > 30 THEN 1 ELSE 0 END)
            WHEN 3 THEN d + INTERVAL 24 HOUR END AS end_hour
FROM (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP AS d FROM events)
"""

SQL["year_split"] = """
SELECT o_orderkey, y::BIGINT AS year,
       CASE WHEN y = year(s) THEN dayofyear(s) - 1 ELSE 0 END::BIGINT AS first,
       CASE WHEN y = year(e) THEN dayofyear(e) - 1
            WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 365 ELSE 364 END::BIGINT AS last
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + (o_orderkey % 800)::INT AS e FROM orders),
     LATERAL (SELECT unnest(generate_series(year(s), year(e))) AS y)
"""

SQL["hourly_year"] = """
SELECT event_id, year(h - INTERVAL 1 HOUR)::BIGINT AS storage_year,
       ((epoch(h) - epoch(make_timestamp(year(h - INTERVAL 1 HOUR), 1, 1, 1, 0, 0.0))) / 3600)::BIGINT AS storage_hour,
       (year(h) % 4 = 0 AND (year(h) % 100 <> 0 OR year(h) % 400 = 0)) AS leap
FROM (SELECT event_id, date_trunc('hour', ts)::TIMESTAMP - to_hours(((event_id % 3) * 8784)::INT) AS h FROM events)
"""

SQL["hour_split"] = """
SELECT event_id, y::BIGINT AS year,
       CASE WHEN y = year(s - INTERVAL 1 HOUR)
            THEN ((epoch(s) - epoch(make_timestamp(y, 1, 1, 1, 0, 0.0))) / 3600)::BIGINT ELSE 0 END AS first,
       CASE WHEN y = year(e - INTERVAL 1 HOUR)
            THEN ((epoch(e) - epoch(make_timestamp(y, 1, 1, 1, 0, 0.0))) / 3600)::BIGINT
            WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 8783 ELSE 8759 END AS last
FROM (SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS s,
             date_trunc('hour', ts)::TIMESTAMP + to_hours(((event_id % 30) * 500)::INT) AS e FROM events),
     LATERAL (SELECT unnest(generate_series(year(s - INTERVAL 1 HOUR), year(e - INTERVAL 1 HOUR))) AS y)
"""

SQL["local_time"] = """
SELECT event_id, ts::TIMESTAMP + INTERVAL 9 HOUR AS ts_local, ts::TIMESTAMP AS ts_utc, ts::TIMESTAMP AS no_zone FROM events
"""

SQL["round_half_even"] = """
SELECT o_orderkey, v, CASE WHEN f = 0.5 AND floor(v * 10) % 2 = 0 THEN floor(v * 10) / 10 ELSE floor(v * 10 + 0.5) / 10 END + 0 AS tenth,
       CASE WHEN v - floor(v) = 0.5 AND floor(v) % 2 = 0 THEN floor(v) ELSE floor(v + 0.5) END::BIGINT AS whole
FROM (SELECT o_orderkey, v, v * 10 - floor(v * 10) AS f FROM (SELECT o_orderkey, (o_orderkey % 801 - 400) / 8e0 AS v FROM orders))
"""

SQL["season_filter"] = f"""
SELECT date, lines, ({SEASON})::BIGINT AS season_year,
       datediff('day', make_date({SEASON}, 4, 1), date) + 1 AS season_day,
       (date >= DATE '1997-04-01' AND date <= DATE '1998-03-24') AS in_1997
FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS lines FROM lineitem GROUP BY 1)
WHERE {SEASON} IN (1996, 1997, 1998)
"""

# --- boxes and areas ----------------------------------------------------------------------------

SQL["cell_box"] = f"""
WITH {STATIC}
SELECT element, mesh_code, value FROM static
WHERE iy BETWEEN 3600 AND 54 * 80 - 1 AND ix BETWEEN 30 * 80 AND 40 * 80 + 40
"""

SQL["centre_box"] = f"""
WITH {STATIC}
SELECT element, mesh_code, value FROM static WHERE lat BETWEEN 30 AND 36 AND lon BETWEEN 130 AND 140.5
"""

SQL["nearest_coord"] = f"""
WITH {STATIC},
near AS (SELECT lat FROM (SELECT DISTINCT lat FROM static) ORDER BY abs(lat - 33.333), lat LIMIT 1)
SELECT element, mesh_code, round(lat, 9) AS lat, value FROM static WHERE lat = (SELECT lat FROM near) AND lon BETWEEN 122 AND 150
"""

SQL["box_tiles"] = f"""
WITH {BOXES}, {STATIC},
listed AS (SELECT DISTINCT tile FROM static),
spans AS (
    SELECT box_id, south, north, west, east,
           floor(south * 1.5e0)::BIGINT AS p0, greatest(ceil(north * 1.5e0)::BIGINT - 1, floor(south * 1.5e0)::BIGINT) AS p1,
           floor(west - 100e0)::BIGINT AS u0, greatest(ceil(east - 100e0)::BIGINT - 1, floor(west - 100e0)::BIGINT) AS u1
    FROM boxes),
corners AS (
    SELECT s.box_id, s.p0, s.p1, s.u0, s.u1, a.iy AS iy0, a.ix AS ix0, b.iy AS iy1, b.ix AS ix1
    FROM spans s
    JOIN ({celled("SELECT box_id AS id_a, south AS lat, west AS lon FROM boxes")}) a ON a.id_a = s.box_id
    JOIN ({celled("SELECT box_id AS id_b, north AS lat, east AS lon FROM boxes")}) b ON b.id_b = s.box_id)
SELECT box_id, tile,
       CASE WHEN p = p0 THEN iy0 - p * 80 ELSE 0 END::BIGINT AS row0,
       CASE WHEN p = p1 THEN least(iy1 - p * 80, 79) ELSE 79 END::BIGINT AS row1,
       CASE WHEN u = u0 THEN ix0 - u * 80 ELSE 0 END::BIGINT AS col0,
       CASE WHEN u = u1 THEN least(ix1 - u * 80, 79) ELSE 79 END::BIGINT AS col1
FROM (
    SELECT c.*, p, u, concat(p, u) AS tile
    FROM corners c, LATERAL (SELECT unnest(generate_series(p0, p1)) AS p), LATERAL (SELECT unnest(generate_series(u0, u1)) AS u))
WHERE tile IN (SELECT tile FROM listed)
"""

SQL["area_lookup"] = f"""
WITH {BOXES},
found AS (SELECT *, ({AREA_CASE})::BIGINT AS area_num FROM boxes)
SELECT box_id, area_num,
       CASE area_num WHEN 1 THEN '北海道' WHEN 2 THEN '東北' WHEN 3 THEN '関東北陸' WHEN 4 THEN '西日本'
                     WHEN 5 THEN '九州' WHEN 6 THEN '西南諸島' END AS area_name,
       CASE WHEN south BETWEEN 32 AND 232 / 6e0 THEN least(a.iy - 32 * 120, 799) ELSE 0 END::BIGINT AS row0,
       CASE WHEN north BETWEEN 32 AND 232 / 6e0 THEN least(b.iy - 32 * 120, 799) ELSE 799 END::BIGINT AS row1,
       CASE WHEN west BETWEEN 135 AND 142 THEN least(a.ix - 35 * 80, 559) ELSE 0 END::BIGINT AS col0,
       CASE WHEN east BETWEEN 135 AND 142 THEN least(b.ix - 35 * 80, 559) ELSE 559 END::BIGINT AS col1
FROM found
JOIN ({celled("SELECT box_id AS id_a, south AS lat, west AS lon FROM boxes")}) a ON a.id_a = box_id
JOIN ({celled("SELECT box_id AS id_b, north AS lat, east AS lon FROM boxes")}) b ON b.id_b = box_id
"""

# --- grid scans ---------------------------------------------------------------------------------

_SCAN = "SELECT element, mesh_code, round(lat, 9) AS lat, round(lon, 9) AS lon"

SQL["grid_scan_daily"] = f"""
WITH {GRID}
{_SCAN}, date, value, 'mean ' || element AS long_name, 'unit' AS unit, 'mean ' || element || ' (unit)' AS label
FROM observed
WHERE element = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND iy BETWEEN 30 * 120 AND 36 * 120 - 1 AND ix BETWEEN 25 * 80 AND 40 * 80 + 40
"""

SQL["grid_scan_point"] = f"""
WITH {GRID}
SELECT element, mesh_code, date, value FROM observed
WHERE element = 'view' AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'
  AND mesh_code = (SELECT code8 FROM ({celled(f"SELECT {lat('7')} AS lat, {lon('7')} AS lon")}))
"""

SQL["grid_scan_normal"] = f"""
WITH {GRID}
{_SCAN}, date, value FROM normal
WHERE element = 'view' AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-25'
  AND iy BETWEEN 30 * 120 AND 36 * 120 - 1 AND ix BETWEEN 25 * 80 AND 40 * 80 + 40
"""

SQL["grid_scan_area"] = f"""
WITH {GRID}
{_SCAN}, date, value FROM observed
WHERE element = 'error' AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'
  AND iy BETWEEN 33 * 120 AND 36 * 120 + 60 AND ix BETWEEN 31 * 80 AND 37 * 80
"""

SQL["scenario_scan"] = f"""
WITH {GRID}
{_SCAN}, date, value + 3.0e0 AS value FROM observed
WHERE element = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND iy BETWEEN 30 * 120 AND 36 * 120 - 1 AND ix BETWEEN 25 * 80 AND 40 * 80 + 40
"""

SQL["geo_scan"] = f"""
WITH {STATIC}
{_SCAN}, value FROM static
WHERE element = 'altitude' AND iy BETWEEN 30 * 120 AND 36 * 120 - 1 AND ix BETWEEN 25 * 80 AND 40 * 80 + 40
"""

SQL["scenario_scan_area"] = f"""
WITH {GRID}
{_SCAN}, date, value + 1.5e0 AS value FROM observed
WHERE element = 'error' AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'
  AND iy BETWEEN 33 * 120 AND 36 * 120 + 60 AND ix BETWEEN 31 * 80 AND 37 * 80
"""

_POINT = f"(SELECT code8 FROM ({celled(f"SELECT {lat('7')} AS lat, {lon('7')} AS lon")}))"

SQL["scenario_scan_point"] = f"""
WITH {GRID}
SELECT element, mesh_code, date, value + 3.0e0 AS value FROM observed
WHERE element = 'view' AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND mesh_code = {_POINT}
"""

SQL["geo_scan_area"] = f"""
WITH {STATIC}
{_SCAN}, value FROM static
WHERE element = 'landuse' AND iy BETWEEN 33 * 120 AND 36 * 120 + 60 AND ix BETWEEN 31 * 80 AND 37 * 80
"""

SQL["geo_scan_point"] = f"""
WITH {STATIC}
SELECT element, mesh_code, value FROM static WHERE element = 'altitude' AND mesh_code = {_POINT}
"""

SQL["extract_cells"] = f"""
WITH {GRID}
SELECT element, mesh_code, date, CASE WHEN value <= 200 THEN value END AS value, 'mean ' || element AS long_name, 'unit' AS unit
FROM observed
WHERE element = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND lat BETWEEN 30 AND 36 AND lon BETWEEN 125 AND 140.5
"""

_HOURLY = f"""
    h AS (
        SELECT element, code8, clat, clon, iy, ix, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 10 HOUR AS ts_local, {_MEAN}
        FROM ({celled(_EVENTS)}) GROUP BY 1, 2, 3, 4, 5, 6, 7)
"""

_TENTH = """CASE WHEN abs(value * 10 - floor(value * 10) - 0.5) < 1e-9 AND floor(value * 10) % 2 = 0
            THEN floor(value * 10) / 10 ELSE floor(value * 10 + 0.5) / 10 END"""

SQL["hourly_scan_point"] = f"""
WITH {_HOURLY}
SELECT element, code8 AS mesh_code, ts_local, {_TENTH} AS value
FROM h
WHERE element = 'click' AND ts_local BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-02-01 00:00:00' AND code8 = {_POINT}
"""

SQL["hourly_scan"] = f"""
WITH {_HOURLY}
SELECT element, code8 AS mesh_code, round(clat, 9) AS lat, round(clon, 9) AS lon, ts_local,
       {_TENTH} AS value
FROM h
WHERE element = 'purchase' AND ts_local BETWEEN TIMESTAMP '2024-01-03 13:00:00' AND TIMESTAMP '2024-01-22 00:00:00'
  AND iy BETWEEN 30 * 120 AND 36 * 120 - 1 AND ix BETWEEN 25 * 80 AND 40 * 80 + 40
"""

SQL["merge_pieces"] = f"""
WITH {GRID}
SELECT element, mesh_code, date, value FROM observed
"""

SQL["sentinel_round_trip"] = f"""
WITH {WIDE}
SELECT place, date, click, coalesce(click, 9.96921e36) AS click_filled,
       CASE WHEN error > 50 THEN NULL ELSE error END AS error_masked
FROM wide
"""

# --- weather tables -----------------------------------------------------------------------------

SQL["site_weather_wide"] = f"""
WITH {GRID},
sites AS ({celled(f"SELECT c_custkey AS place, {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon FROM customer")}),
by_cell AS (
    SELECT mesh_code, date,
           max(CASE WHEN element = 'click' THEN value END) AS click,
           max(CASE WHEN element = 'error' THEN value END) AS error,
           max(CASE WHEN element = 'purchase' THEN value END) AS purchase,
           max(CASE WHEN element = 'signup' THEN value END) AS signup,
           max(CASE WHEN element = 'view' THEN value END) AS "view"
    FROM observed GROUP BY 1, 2)
SELECT place, 2023::BIGINT AS year, date, click, error, purchase, signup, "view"
FROM sites JOIN by_cell ON mesh_code = code8
"""

SQL["union_by_name"] = f"""
WITH {WIDE}
SELECT place, date, click, error, NULL::DOUBLE AS signup FROM wide
UNION ALL
SELECT place, date, NULL, error, signup FROM wide
"""

SQL["prefix_rename"] = f"""
WITH {WIDE}
SELECT year, place, date, click AS "TMP_mea", error AS "OPR", purchase AS "OPR label ()", 'C' AS source FROM wide
"""

SQL["backfill_column"] = f"""
WITH {WEATHER},
w AS (
    SELECT place, date, (2010 + place % 15)::BIGINT AS year, max(CASE WHEN element = 'click' THEN value END) AS a,
           max(CASE WHEN element = 'error' THEN value END) AS b
    FROM weather GROUP BY 1, 2)
SELECT place, date, year, CASE WHEN year >= 2017 THEN b ELSE a END AS "OPR", b AS "OPRori" FROM w
"""

_SHEET = """
    sheet AS (
        SELECT d + 60 AS date, CASE WHEN day(d) % 5 <> 0 THEN n::DOUBLE END AS vp
        FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1))
"""

SQL["update_merge"] = f"""
WITH {WEATHER}, {_SHEET},
w AS (
    SELECT place, date + 60 AS date, 2023 + place % 2 AS year, max(CASE WHEN element = 'click' THEN value END) AS click,
           max(value) AS old
    FROM weather GROUP BY 1, 2, 3),
targets AS (SELECT DISTINCT c_custkey AS place, 2023 + c_custkey % 2 AS year FROM customer WHERE c_nationkey < 20),
updates AS (
    SELECT t.place, t.year, s.date, s.vp FROM targets t JOIN sheet s
    ON s.date BETWEEN make_date(t.year::INT, 4, 1) AND make_date(t.year::INT + 1, 3, 24))
SELECT w.place, w.year::BIGINT AS year, w.date, w.click, CASE WHEN u.place IS NOT NULL THEN u.vp ELSE w.old END AS "VP",
       u.place IS NOT NULL AS matched
FROM w LEFT JOIN updates u ON u.place = w.place AND u.year = w.year AND u.date = w.date
"""

SQL["rows_updated"] = f"""
SELECT year, count(*) AS rows FROM ({SQL["update_merge"]}) WHERE matched GROUP BY year
"""

SQL["table_round_trip"] = f"""
WITH {WIDE}
SELECT place, date, click, error, signup, 2023 + place % 2 AS year FROM wide WHERE click > 20
"""

# --- anomaly and output tables ------------------------------------------------------------------

SQL["anomaly"] = f"""
WITH {GRID}
SELECT o.element, o.mesh_code, o.date, n.value AS normal, o.value AS obs, o.value - n.value AS anomaly,
       sign(o.value - n.value)::BIGINT AS sign, o.date = DATE '2024-01-15' AS is_today
FROM observed o JOIN normal n ON n.element = o.element AND n.mesh_code = o.mesh_code AND n.date = o.date
WHERE o.date BETWEEN DATE '2023-11-12' AND DATE '2024-03-19'
"""

SQL["date_table"] = f"""
WITH {GRID}
SELECT o.date AS "Date", n.value AS "Normal", o.value AS "Obs."
FROM observed o JOIN normal n ON n.element = o.element AND n.mesh_code = o.mesh_code AND n.date = o.date
WHERE o.element = 'click' AND o.mesh_code = (SELECT code8 FROM ({celled(f"SELECT {lat('7')} AS lat, {lon('7')} AS lon")}))
"""

_DAYS = ",\n           ".join(f"max(CASE WHEN date = DATE '2024-01-{d:02}' THEN value END) AS d{d:02}" for d in range(1, 31))
SQL["mesh_pivot"] = f"""
WITH {GRID},
p AS (
    SELECT mesh_code, round(lat, 9) AS lat, round(lon, 9) AS lon,
           {_DAYS}
    FROM observed WHERE element = 'click' GROUP BY 1, 2, 3)
SELECT * FROM p WHERE coalesce({", ".join(f"d{d:02}" for d in range(1, 31))}) IS NOT NULL
"""

SQL["mesh_csv"] = SQL["mesh_pivot"]

SQL["extent"] = f"""
WITH {STATIC}
SELECT round(min(lat), 9) AS min_lat, round(max(lat), 9) AS max_lat, count(DISTINCT lat) AS count_lat,
       round(min(lon), 9) AS min_lon, round(max(lon), 9) AS max_lon, count(DISTINCT lon) AS count_lon,
       round((max(lat) - min(lat)) / (count(DISTINCT lat) - 1), 9) AS step_lat,
       round(min(lat) - (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) / 2, 9) AS lower_lat,
       round(max(lat) + (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) / 2, 9) AS upper_lat,
       round((max(lon) - min(lon)) / (count(DISTINCT lon) - 1), 9) AS step_lon,
       round(min(lon) - (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) / 2, 9) AS lower_lon,
       round(max(lon) + (max(lon) - min(lon)) / (count(DISTINCT lon) - 1) / 2, 9) AS upper_lon
FROM static
"""

SQL["raster_cells"] = f"""
WITH {STATIC},
ends AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM static),
b AS (SELECT s, n, w, e, round((n - s) * 120) + 1 AS h, round((e - w) * 80) + 1 AS wd FROM ends),
p AS (SELECT *, (n - s) / (h - 1) AS py, (e - w) / (wd - 1) AS px FROM b)
SELECT element AS layer, round((n - lat) / py)::BIGINT AS row, round((lon - w) / px)::BIGINT AS "column", value, h::BIGINT AS height,
       wd::BIGINT AS width, round(px, 9) AS pixel_x, round(py, 9) AS pixel_y, round(w - px / 2, 9) AS west, round(s - py / 2, 9) AS south,
       round(e + px / 2, 9) AS east, round(n + py / 2, 9) AS north
FROM static, p
"""

SQL["map_classes"] = f"""
WITH {STATIC},
l AS (SELECT min(value) AS lo, max(value) AS hi FROM static WHERE element = 'altitude')
SELECT mesh_code, round(6378137 * radians(lon), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y, value,
       CASE WHEN value = hi THEN 10 ELSE floor((value - lo) / ((hi - lo) / 10)) + 1 END::BIGINT AS value_class
FROM static, l WHERE element = 'altitude'
"""

SQL["map_days"] = f"""
WITH {GRID}
SELECT mesh_code, min(date) AS value, datediff('day', DATE '2024-01-01', min(date)) AS value_class
FROM observed WHERE element = 'click' GROUP BY mesh_code
"""

SQL["nearest_place"] = f"""
WITH pts AS (SELECT c_custkey AS place, {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon FROM customer),
gaz AS (
    SELECT s_suppkey AS place_id, s_name AS name, 'region ' || s_nationkey AS admin1,
           {lat('s_suppkey')} + 0.0031e0 AS glat, {lon('s_suppkey')} + 0.0017e0 AS glon
    FROM supplier),
d AS (
    SELECT place, lat, lon, place_id, name, admin1,
           round(2 * 6371008.8e0 * asin(least(1, sqrt(pow(sin(radians(glat - lat) / 2), 2)
               + cos(radians(lat)) * cos(radians(glat)) * pow(sin(radians(glon - lon) / 2), 2)))), 3) AS dist
    FROM pts, gaz)
SELECT place, lat, lon, name AS city, admin1 AS prefecture, round(dist, 1) AS distance_m
FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY dist, place_id) AS rn FROM d) WHERE rn = 1
"""

# --- metrics ------------------------------------------------------------------------------------

_SCORED = f"""
    {PANEL},
    scored AS (SELECT loc_id, year, yield AS y_true, 10 + 5 * (total / 1000000e0) / n AS y_pred FROM panel JOIN sums USING (loc_id, year))
"""

SQL["metrics_by_year"] = f"""
WITH {_SCORED}
SELECT year, count(*) AS n, round(sqrt(avg(pow(y_pred - y_true, 2))), 6) AS rmse,
       round(covar_pop(y_true, y_pred) / nullif(stddev_pop(y_true) * stddev_pop(y_pred), 0), 6) AS pearson,
       round(avg(abs(y_pred - y_true)), 6) AS mae,
       round(avg(CASE WHEN abs(y_pred - y_true) <= 1 THEN pow(y_pred - y_true, 2) / 2 ELSE abs(y_pred - y_true) - 0.5 END), 6) AS huber
FROM scored GROUP BY year
"""

def _huber(error: str) -> str:
    return f"avg(CASE WHEN abs({error}) <= 1 THEN pow({error}, 2) / 2 ELSE abs({error}) - 0.5 END)"


SQL["loss_of_outputs"] = f"""
WITH {_SCORED}
SELECT round(0.75 * {_huber("y_pred - y_true")} + 0.25 * ({_huber("y_pred - y_true")} + {_huber("y_pred - y_true / 2")}) / 2, 6) AS loss
FROM scored
"""

SQL["multi_encoding_load"] = """
SELECT doc_id, text AS content FROM documents
"""

SQL["top_rows"] = """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15
"""

SQL["sample_shuffle"] = """
SELECT c_custkey, c_name FROM customer
"""

SQL["distinct_years"] = """
SELECT DISTINCT year(o_orderdate)::BIGINT AS year FROM orders
"""

SQL["empty_scan"] = """
SELECT NULL::VARCHAR AS element, NULL::VARCHAR AS mesh_code, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::DATE AS date,
       NULL::DOUBLE AS value
WHERE false
"""

# Predictions are the learner's own; what SQL can state is which rows are scored, and that the fit beats the mean.
SQL["yield_model_keys"] = f"""
WITH {PANEL}
SELECT loc_id, year, yield AS y_true FROM panel WHERE year = 2001
"""

SQL["stored_grid_scan"] = f"""
WITH {STATIC}
{_SCAN}, value FROM static
WHERE element = 'altitude' AND iy BETWEEN 30 * 120 AND 36 * 120 - 1 AND ix BETWEEN 25 * 80 AND 40 * 80 + 40
"""

SQL["stored_daily_scan"] = f"""
WITH {GRID}
{_SCAN}, date, value FROM observed
WHERE element = 'view' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND iy BETWEEN 30 * 120 AND 36 * 120 - 1 AND ix BETWEEN 25 * 80 AND 40 * 80 + 40
"""

SQL["stored_hourly_scan"] = SQL["hourly_scan"]

SQL["co_located_weather"] = SQL["site_weather_wide"]

SQL["mesh_hours"] = f"""
WITH {_HOURLY}
SELECT code8 AS mesh_code, 8784 AS steps, datediff('hour', TIMESTAMP '2024-01-01 01:00:00', ts_local)::INTEGER AS hour, value
FROM h WHERE element = 'click' AND ts_local BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2025-01-01 00:00:00'
"""

SQL["merge_drifted"] = f"""
WITH {GRID}
SELECT element, round(lat, 9) AS lat, round(lon, 9) AS lon, date, value FROM observed
"""

SQL["period_updates"] = """
WITH periods AS (
    SELECT c_custkey AS place, DATE '1995-01-01' + (c_custkey * 13 % 2200)::INTEGER AS start_day,
        CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 700 ELSE c_custkey % 40 END::INTEGER AS days
    FROM customer
),
sheet AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT place, start_day AS start, start_day + days AS "end", date, lines
FROM periods JOIN sheet ON date BETWEEN start_day AND start_day + days
"""

SQL["new_column_merge"] = f"""
WITH {WIDE},
sheet AS (SELECT CAST(ts AS DATE) AS date, count(*)::DOUBLE AS vp FROM events GROUP BY 1)
SELECT w.place, w.date, w.year, w.click, CASE WHEN w.place % 3 = 0 AND c.c_custkey IS NOT NULL THEN s.vp END AS "VP"
FROM wide w LEFT JOIN sheet s USING (date) LEFT JOIN customer c ON c.c_custkey = w.place
"""

SQL["table_swap"] = f"""
WITH {WIDE}
SELECT * REPLACE (click * 2 AS click) FROM wide
"""

SQL["four_encodings"] = """
SELECT c_custkey, chr((12449 + c_custkey % 60)::INTEGER) || chr(29681) || c_name AS content FROM customer
"""
