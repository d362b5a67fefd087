"""The trajectory queries in DuckDB SQL, from the same tables."""

from __future__ import annotations

#: Reports and ports, as in ``sources.fixture``.
AIS = """
numbered AS (SELECT event_id, user_id AS u, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
phased AS (SELECT *, (k * (3 + u % 5) + u * 7) % 40 AS ph FROM numbered),
waved AS (SELECT *, CASE WHEN ph < 20 THEN ph ELSE 40 - ph END AS tri FROM phased),
ais AS (SELECT event_id AS row_id, u AS mmsi, CAST(floor(epoch(ts)) AS BIGINT) AS seconds,
  (-700 + (u % 20) * 200 + tri * 5) / 100.0::DOUBLE AS lon, (3000 + (u % 15) * 100 + (k * k + u) % 7) / 100.0::DOUBLE AS lat,
  CAST((event_id * 37) % 360 AS DOUBLE) AS cog, CASE WHEN tri IN (0, 20) THEN 0.0::DOUBLE ELSE (CAST(floor(value * 100) AS BIGINT) % 300) / 10.0::DOUBLE END AS speed,
  ['Cargo', 'Tanker', 'Passenger'][CAST(u % 3 + 1 AS INTEGER)] AS ship_type FROM waved)"""

PORTS = """
lanes AS (SELECT i AS lane, -700 + (i % 20) * 200 AS x, 3000 + (i % 15) * 100 AS y FROM range(60) t(i)),
ports AS (SELECT CAST(2 * lane + e AS INTEGER) AS id, (x - 2 + 90 * e) / 100.0::DOUBLE AS w, (x + 12 + 90 * e) / 100.0::DOUBLE AS ea, (y - 2) / 100.0::DOUBLE AS s, (y + 8) / 100.0::DOUBLE AS n FROM lanes, (VALUES (0), (1)) v(e)),
corners AS (SELECT id, unnest([0, 1, 2, 3, 4]) AS place, unnest([w, ea, ea, w, w]) AS lon, unnest([s, s, n, n, s]) AS lat FROM ports)"""

#: Even-odd rule over the edges of each port.
PORT_OF = """
edges AS (SELECT id, lag(lon) OVER o AS x1, lag(lat) OVER o AS y1, lon AS x2, lat AS y2 FROM corners WINDOW o AS (PARTITION BY id ORDER BY place)),
boxes AS (SELECT id, min(lon) AS bw, max(lon) AS be, min(lat) AS bs, max(lat) AS bn FROM corners GROUP BY id),
crossings AS (SELECT a.row_id, e.id, count(*) FILTER (WHERE ((y1 <= a.lat AND a.lat < y2) OR (y2 <= a.lat AND a.lat < y1)) AND a.lon < (x2 - x1) * (a.lat - y1) / (y2 - y1) + x1) AS c
  FROM ais a JOIN boxes b ON a.lon BETWEEN bw AND be AND a.lat BETWEEN bs AND bn JOIN edges e ON e.id = b.id AND x1 IS NOT NULL GROUP BY a.row_id, e.id),
port_of AS (SELECT a.*, p.port FROM ais a LEFT JOIN (SELECT row_id, min(id) AS port FROM crossings WHERE c % 2 = 1 GROUP BY row_id) p USING (row_id))"""

TRACK = "PARTITION BY mmsi ORDER BY seconds, row_id"
LAGGED = f"""lagged AS (SELECT * FROM (SELECT *, lag(lon) OVER o AS p_lon, lag(lat) OVER o AS p_lat, lag(cog) OVER o AS p_cog, lag(speed) OVER o AS p_speed, lag(seconds) OVER o AS p_seconds FROM ais WINDOW o AS ({TRACK})) WHERE p_seconds IS NOT NULL)"""

SEGMENTS = f"""
gaps AS (SELECT *, coalesce(seconds - lag(seconds) OVER ({TRACK}), 0) AS since FROM port_of),
flagged AS (SELECT *, since >= 86400 AS g, port IS NOT NULL OR since >= 86400 AS active FROM gaps),
lasts AS (SELECT *, lag(coalesce(port, -1)) OVER (PARTITION BY mmsi, active ORDER BY seconds, row_id) AS lp FROM flagged),
xs AS (SELECT *, coalesce(active AND g AND port IS NOT NULL AND lp = port, false) AS x FROM lasts),
islands AS (SELECT *, sum(CAST(NOT x AS INTEGER)) OVER (PARTITION BY mmsi, active ORDER BY seconds, row_id) AS island FROM xs),
runs AS (SELECT *, sum(CAST(x AS INTEGER)) OVER (PARTITION BY mmsi, active, island ORDER BY seconds, row_id) AS place FROM islands),
states AS (SELECT *, CASE WHEN active THEN CASE WHEN x AND place % 2 = 1 THEN -1 ELSE coalesce(port, -1) END END AS st FROM runs),
prevs AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER ({TRACK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev_port FROM states),
arrivals AS (SELECT *, coalesce(port <> prev_port, false) AS arrive FROM prevs),
segments AS (SELECT *, CAST(coalesce(sum(CAST(arrive AS INTEGER)) OVER ({TRACK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + sum(CAST(NOT arrive AND g AS INTEGER)) OVER ({TRACK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS voyage_seq FROM arrivals)"""

VOYAGES = """
ended AS (SELECT *, max(CASE WHEN arrive THEN prev_port END) OVER w AS f, max(CASE WHEN arrive THEN port END) OVER w AS t, sum(CAST(port IS NULL AS INTEGER)) OVER w AS npos FROM segments WINDOW w AS (PARTITION BY mmsi, voyage_seq)),
voyages AS (SELECT row_id, mmsi, seconds, lon, lat, cog, speed, mmsi || '-' || voyage_seq AS voyage_id, f || '_to_' || t AS itinerary FROM ended WHERE port IS NULL AND f >= 0 AND t IS NOT NULL AND npos >= 3)"""


def cell(lon: str, lat: str, step: int = 200_000, columns: int = 231, rows: int = 91, stride: int = 231) -> str:
    x, y = f"CAST(floor({lon} * 1e6 + 0.5) AS BIGINT) + 8000000", f"CAST(floor({lat} * 1e6 + 0.5) AS BIGINT) - 29000000"
    return f"CASE WHEN {x} >= 0 AND {x} < {columns * step} AND {y} >= 0 AND {y} < {rows * step} THEN ({y}) // {step} * {stride} + ({x}) // {step} + 1 END"


def fine(lon: str, lat: str) -> str:
    return cell(lon, lat, 10_000, 4620, 1820, 4621)


def km(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({c}) - radians({a})) / 2), 2))"
    return f"6371.0 * (2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def spheroid(a: str, b: str, c: str, d: str) -> str:
    """Metres on the WGS84 spheroid (Lambert)."""
    f = "(1 / 298.257223563::DOUBLE)"
    u, v = (f"atan((1 - {f}) * tan(radians({x})))" for x in (b, d))
    h = f"(pow(sin(({v} - {u}) / 2), 2) + cos({u}) * cos({v}) * pow(sin((radians({c}) - radians({a})) / 2), 2))"
    g = f"(2 * atan2(sqrt({h}), sqrt(1 - {h})))"
    x = f"({g} - sin({g})) * (pow(sin(({u} + {v}) / 2) * cos(({v} - {u}) / 2), 2) / (1 - {h}))"
    y = f"({g} + sin({g})) * (pow(cos(({u} + {v}) / 2) * sin(({v} - {u}) / 2), 2) / nullif({h}, 0))"
    return f"CASE WHEN {h} = 0 THEN 0.0::DOUBLE ELSE 6378137.0::DOUBLE * ({g} - {f} / 2 * ({x} + {y})) END"


def turn(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} - {b}) <= 180.0 THEN abs({a} - {b}) ELSE abs(360.0 - greatest({a}, {b}) + least({a}, {b})) END"


def bearing(a: str, b: str, c: str, d: str, signed: bool = True) -> str:
    dl = f"(radians({c}) - radians({a}))" if signed else f"abs(radians({c}) - radians({a}))"
    return f"degrees(atan2(cos(radians({d})) * sin({dl}), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos({dl})))"


def lagrange(at: str) -> str:
    x, y = ("lon1", "lon", "lon3"), ("lat1", "lat", "lat3")
    terms = []
    for i in range(3):
        j, k = [n for n in range(3) if n != i]
        terms.append(f"(({at} - {x[j]}) / ({x[i]} - {x[j]})) * (({at} - {x[k]}) / ({x[i]} - {x[k]})) * {y[i]}")
    return "(" + " + ".join(terms) + ")"


def spread(c: str, n: str) -> str:
    return f"round(avg({c}), 6) + 0.0 AS mean_{n}, round(stddev_pop({c}), 6) + 0.0 AS std_{n}, round(min({c}), 6) + 0.0 AS min_{n}, round(max({c}), 6) + 0.0 AS max_{n}"


def labels(points: str, near: str, min_points: int, keys: str = "") -> str:
    """CTEs that label ``points`` by density: near is a condition on l and r."""
    return f"""
pairs AS (SELECT l.row_id AS a, r.row_id AS b FROM {points} l JOIN {points} r ON {keys} l.row_id <> r.row_id AND {near}),
core AS (SELECT row_id FROM {points} p LEFT JOIN (SELECT a, count(*) AS c FROM pairs GROUP BY a) ON a = row_id WHERE coalesce(c, 0) + 1 >= {min_points}),
linked AS (SELECT a, b FROM pairs WHERE a IN (SELECT row_id FROM core) AND b IN (SELECT row_id FROM core)),
reach AS (SELECT row_id AS a, row_id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
named AS (SELECT a AS row_id, min(b) AS cluster_id FROM reach GROUP BY a),
border AS (SELECT p.a AS row_id, min(n.cluster_id) AS cluster_id FROM pairs p JOIN named n ON p.b = n.row_id WHERE p.a NOT IN (SELECT row_id FROM core) GROUP BY p.a),
labelled AS (SELECT * FROM named UNION ALL SELECT * FROM border)"""


CELLS = f"cells AS (SELECT * FROM (SELECT *, {cell('lon', 'lat')} AS cell_id FROM voyages) WHERE cell_id IS NOT NULL)"
STOPS = f"stops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, mmsi ORDER BY seconds, row_id) AS rn FROM (SELECT *, {fine('lon', 'lat')} AS cell_id FROM ais WHERE speed = 0) WHERE cell_id IS NOT NULL) WHERE rn = 1)"
STEPS = f"steps AS (SELECT *, {km('lag(lon) OVER o', 'lag(lat) OVER o', 'lon', 'lat')} AS d FROM cells WINDOW o AS (PARTITION BY itinerary, cell_id ORDER BY voyage_id, seconds, row_id))"


def hull(points: str, keys: str) -> str:
    """CTEs of convex hulls per ``keys`` (no nulls) of points in hundredths of a degree: ``hull_edge``, ``hull_ring`` and ``hull_text``.

    An edge is a pair of points with no point on its right, nor beyond it on its line. Only the outer points of each latitude can be corners.
    """
    k = [c.strip() for c in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in k)
    of = lambda a: ", ".join(f"{a}.{c}" for c in k)
    side = "((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))"
    beyond = "((p.x - r.x) * (q.x - r.x) + (p.y - r.y) * (q.y - r.y))"
    return f"""
hull_all AS (SELECT DISTINCT {keys}, CAST(round(lon * 100) AS BIGINT) AS x, CAST(round(lat * 100) AS BIGINT) AS y FROM {points}),
hull_outer AS (SELECT {keys}, x, y FROM (SELECT *, min(x) OVER (PARTITION BY {keys}, y) AS lo, max(x) OVER (PARTITION BY {keys}, y) AS hi FROM hull_all) WHERE x IN (lo, hi)),
hull_pair AS (SELECT {of("p")}, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM hull_outer p JOIN hull_outer q ON {same("p", "q")} AND (p.x <> q.x OR p.y <> q.y) JOIN hull_outer r ON {same("p", "r")}
  GROUP BY ALL HAVING count(*) FILTER (WHERE {side} < 0 OR ({side} = 0 AND {beyond} > 0)) = 0
  UNION ALL SELECT {keys}, x, y, x, y FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS c FROM hull_all) WHERE c = 1),
hull_step AS (SELECT *, CASE WHEN qx > px OR (qx = px AND qy > py) THEN 1 ELSE -1 END AS way FROM hull_pair),
hull_place AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY way DESC, way * px, way * py) - 1 AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY {keys}) AS INTEGER) AS corners FROM hull_step),
hull_edge AS (SELECT {keys}, px / 100.0::DOUBLE AS x1, py / 100.0::DOUBLE AS y1, qx / 100.0::DOUBLE AS x2, qy / 100.0::DOUBLE AS y2, place, corners FROM hull_place),
hull_ring AS (SELECT {keys}, place, x1 AS lon, y1 AS lat FROM hull_edge UNION ALL SELECT {keys}, corners, x1, y1 FROM hull_edge WHERE place = 0),
hull_text AS (SELECT {keys}, 'POLYGON ((' || string_agg(CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR), ', ' ORDER BY place) || '))' AS polygon FROM hull_ring GROUP BY {keys})"""


def quadrant(points: str, keys: str) -> str:
    """CTEs of cluster statistics: means, and start and end by the quadrant of the mean course."""
    return QUADRANT.replace("SELECT itinerary,", f"SELECT {keys},").replace("FROM voyages GROUP BY itinerary", f"FROM {points} GROUP BY {keys}")


def new_points(step: int) -> tuple[str, str]:
    """CTEs of the points that interpolation sets every ``step`` seconds."""
    frames = f"""
single AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY voyage_id, lon, lat) AS c FROM voyages) WHERE c = 1),
framed AS (SELECT *, lag(lon) OVER o AS lon1, lag(lat) OVER o AS lat1, lead(lon) OVER o AS lon3, lead(lat) OVER o AS lat3, lead(seconds) OVER o AS seconds3, lag(row_id) OVER o AS r1 FROM single WINDOW o AS (PARTITION BY voyage_id ORDER BY seconds, row_id)),
wide AS (SELECT *, (seconds3 - seconds) // {step} - 1 AS n FROM framed WHERE r1 IS NOT NULL AND seconds3 IS NOT NULL AND seconds3 - seconds > {2 * step} AND lon3 <> lon AND lon1 <> lon AND lon1 <> lon3),
ks AS (SELECT *, (lon3 - lon) / CAST(n AS DOUBLE) AS inc, unnest(generate_series(1, n - 1)) AS k FROM wide WHERE n >= 2)"""
    points = f"""
set_k AS (SELECT *, lon + k * inc AS lon_k, CASE WHEN k = 1 THEN lon ELSE lon + (k - 1) * inc END AS lon_p FROM ks),
lat_k AS (SELECT *, {lagrange('lon_k')} AS lat_k, CASE WHEN k = 1 THEN lat ELSE {lagrange('lon_p')} END AS lat_p FROM set_k),
new AS (SELECT voyage_id, seconds + k * {step} AS seconds, k, lon_k, lat_k, lon_p, lat_p FROM lat_k WHERE NOT EXISTS (SELECT 1 FROM ports p WHERE lon_k >= w AND lon_k < ea AND lat_k >= s AND lat_k < n_))"""
    return frames, points


FOLDS = "folds AS (SELECT itinerary, CAST((row_number() OVER (ORDER BY md5('7:' || itinerary), itinerary) - 1) % 10 AS INTEGER) AS fold FROM (SELECT DISTINCT itinerary FROM voyages))"
QUADRANT = """
g AS (SELECT itinerary, avg(cog) AS c, avg(speed) AS sp, stddev_pop(speed) AS sd, stddev_pop(cog) AS cd, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM voyages GROUP BY itinerary),
q AS (SELECT *, CASE WHEN c <= 90 THEN 1 WHEN c <= 180 THEN 2 WHEN c <= 270 THEN 3 ELSE 4 END AS q FROM g),
stats AS (SELECT itinerary, CASE WHEN q <= 2 THEN w ELSE e END AS start_lon, CASE WHEN q IN (1, 4) THEN s ELSE n END AS start_lat,
  CASE WHEN q <= 2 THEN e ELSE w END AS end_lon, CASE WHEN q IN (1, 4) THEN n ELSE s END AS end_lat,
  round(c, 6) + 0.0 AS avg_cog, round(sp, 6) + 0.0 AS avg_speed, round(sd, 6) + 0.0 AS speed_deviation, round(cd, 6) + 0.0 AS cog_deviation FROM q)"""


CLOCK = "strftime(make_timestamp(seconds * 1000000), '%Y-%m-%d %H:%M:%S')"
#: Raw reports as they are read: unknown numbers -1, unknown headings 0, missing notes NULL.
READ = f"""SELECT mmsi, CASE WHEN row_id % 3 = 0 THEN -1 ELSE row_id END AS imo, lat, lon, cog, CASE WHEN row_id % 5 = 0 THEN 0.0::DOUBLE ELSE cog END AS heading, round(speed, 6) + 0.0 AS speed, seconds, {CLOCK} AS timestamp,
  'VESSEL ' || mmsi AS shipname, ship_type, 'bound, ' || row_id AS destination, CASE WHEN row_id % 7 = 0 THEN 'NULL' ELSE 'note' END AS annotation FROM ais"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"


def sql() -> dict[str, str]:
    ais, port, seg, voy = _with(AIS), _with(AIS, PORTS, PORT_OF), _with(AIS, PORTS, PORT_OF, SEGMENTS), _with(AIS, PORTS, PORT_OF, SEGMENTS, VOYAGES)
    more = lambda *parts, recursive=False: _with(AIS, PORTS, PORT_OF, SEGMENTS, VOYAGES, *parts, recursive=recursive)
    lagged = _with(AIS, LAGGED)
    wkt = "'POLYGON ((' || string_agg(CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR), ', ' ORDER BY place) || '))'"
    steps = km("p_lon", "p_lat", "lon", "lat")
    x, y, z = "6371.0 * cos(radians({b})) * cos(radians({a}))", "6371.0 * cos(radians({b})) * sin(radians({a}))", "6371.0 * sin(radians({b}))"
    diff = [f"pow({e.format(a='p_lon', b='p_lat')} - {e.format(a='lon', b='lat')}, 2)" for e in (x, y, z)]
    delta = "(600 * (speed * 1.852) / 3600 / 6371.0)"
    dr_lat = f"round(degrees(asin(sin(radians(lat)) * cos({delta}) + cos(radians(lat)) * sin({delta}) * cos(radians(cog)))), 6)"
    dr_lon = f"round(degrees(radians(lon) + atan2(sin(radians(cog)) * sin({delta}) * cos(radians(lat)), cos({delta}) - sin(radians(lat)) * sin(radians(dl)))), 6)"
    geo_near = f"{km('l.lon', 'l.lat', 'r.lon', 'r.lat')} * 1000.0 <= 2000.0"
    stop_labels = _with(AIS, STOPS, labels("stops", geo_near, 3), recursive=True)
    limits = f"""{STEPS}, limits AS (SELECT itinerary, cell_id, round(coalesce(stddev_pop(d), 0.0), 6) AS d, round(stddev_pop(speed), 6) AS s, round(stddev_pop(cog), 6) AS h FROM steps GROUP BY itinerary, cell_id),
limited AS (SELECT c.*, d, s, h FROM cells c JOIN limits USING (itinerary, cell_id))"""
    similar = f"round({km('l.lon', 'l.lat', 'r.lon', 'r.lat')}, 6) <= l.d AND round(abs(l.speed - r.speed), 6) <= l.s AND {turn('l.cog', 'r.cog')} <= l.h"
    traj = more(CELLS, limits, labels("limited", similar, 3, "l.itinerary = r.itinerary AND l.cell_id = r.cell_id AND"), recursive=True)
    route_near = f"round({km('l.lon', 'l.lat', 'r.lon', 'r.lat')}, 6) <= 5.0 AND round(abs(l.speed - r.speed), 6) <= 10.0 AND {turn('l.cog', 'r.cog')} <= 60.0"
    near_in_itinerary = f"round({km('l.lon', 'l.lat', 'r.lon', 'r.lat')}, 6) <= 10.0 AND round(abs(l.speed - r.speed), 6) <= 20.0 AND {turn('l.cog', 'r.cog')} <= 90.0"
    in_itinerary = more(labels("voyages", near_in_itinerary, 5, "l.itinerary = r.itinerary AND"), """members AS (SELECT v.*, cluster_id FROM labelled JOIN voyages v USING (row_id)),
good AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY itinerary, cluster_id) AS members FROM members) WHERE members > 10 AND (itinerary, cluster_id) IN (SELECT (itinerary, cluster_id) FROM members GROUP BY itinerary, cluster_id HAVING count(DISTINCT voyage_id) > 1))""",
        quadrant("good", "itinerary, cluster_id"), hull("good", "itinerary, cluster_id"), recursive=True)
    good_cells = f"""members AS (SELECT c.*, cluster_id FROM labelled JOIN cells c USING (row_id)),
good AS (SELECT * FROM members WHERE cluster_id IN (SELECT cluster_id FROM members GROUP BY cluster_id HAVING count(DISTINCT voyage_id) > 1)),
features AS (SELECT cluster_id, itinerary, cell_id, {spread('cog', 'heading')}, {spread('speed', 'speed')} FROM good GROUP BY cluster_id, itinerary, cell_id)"""
    ports_n = PORTS.replace("AS n FROM lanes", "AS n_ FROM lanes").replace("s, s, n, n, s", "s, s, n_, n_, s")
    filled, filled_180 = (_with(AIS, ports_n, PORT_OF, SEGMENTS, VOYAGES, *new_points(step)) for step in (3600, 180))
    return {
        "ais_positions": ais + "SELECT * FROM ais",
        "cell_assign": ais + f"SELECT row_id, {cell('lon', 'lat')} AS cell_id, {fine('lon', 'lat')} AS fine_cell_id FROM ais",
        "grid_cells": "SELECT r * 231 + c + 1 AS cell_id, round((-8000000 + c * 200000) / 1e6, 2) AS lon, round((29000000 + r * 200000) / 1e6, 2) AS lat FROM range(91) a(r), range(231) b(c)",
        "format_wkt": _with(PORTS) + f"SELECT id, {wkt} AS wkt FROM corners GROUP BY id",
        "parse_wkt": _with(PORTS) + "SELECT id, place, lon, lat FROM corners",
        "polygon_area": _with(PORTS) + "SELECT id, round((ea - w) * (n - s), 6) AS area FROM ports",
        "stopped_filter": ais + "SELECT row_id, mmsi, lon, lat FROM ais WHERE speed = 0",
        "shiptype_filter": ais + "SELECT row_id, mmsi, ship_type FROM ais WHERE contains(ship_type, 'Cargo')",
        "first_per_cell_vessel": ais + f"SELECT row_id, mmsi, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, mmsi ORDER BY seconds, row_id) AS rn FROM (SELECT *, {fine('lon', 'lat')} AS cell_id FROM ais) WHERE cell_id IS NOT NULL) WHERE rn = 1",
        "unique_coords": voy + "SELECT row_id, voyage_id FROM (SELECT *, count(*) OVER (PARTITION BY voyage_id, lon, lat) AS c FROM voyages) WHERE c = 1",
        "haversine_steps": lagged + f"SELECT row_id, round({steps}, 6) + 0.0 AS km FROM lagged",
        "spheroid_steps": lagged + f"SELECT row_id, round({spheroid('p_lon', 'p_lat', 'lon', 'lat')}, 3) + 0.0 AS metres FROM lagged",
        "heading_diff": lagged + f"SELECT row_id, {turn('p_cog', 'cog')} AS degrees FROM lagged",
        "turning_points": lagged + f"SELECT row_id, mmsi FROM lagged WHERE {turn('p_cog', 'cog')} >= 90",
        "dead_reckoning": _with(AIS, f"d AS (SELECT *, {dr_lat} AS dl FROM ais)") + f"SELECT row_id, CASE WHEN speed <> 0 THEN {dr_lon} ELSE lon END + 0.0 AS lon_600, CASE WHEN speed <> 0 THEN dl ELSE lat END + 0.0 AS lat_600 FROM d",
        "to_cartesian": ais + "SELECT row_id, " + ", ".join(f"round({e.format(a='lon', b='lat')}, 6) + 0.0 AS {n}" for e, n in ((x, "x"), (y, "y"), (z, "z"))) + " FROM ais",
        "to_geodetic": ais + "SELECT row_id, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM ais",
        "euclidean": lagged + f"SELECT row_id, round(sqrt({' + '.join(diff)}), 6) + 0.0 AS chord_km, round(sqrt({' + '.join(diff[:2])}) / 1000, 6) + 0.0 AS planar FROM lagged",
        "bearing": lagged + f"SELECT row_id, round({bearing('p_lon', 'p_lat', 'lon', 'lat')}, 6) + 0.0 AS degrees, round({bearing('p_lon', 'p_lat', 'lon', 'lat', False)}, 6) + 0.0 AS unsigned FROM lagged",
        "implied_speed": lagged + f"SELECT row_id, round({steps} * 3600.0 / nullif(seconds - p_seconds, 0) / 1.852, 6) + 0.0 AS knots FROM lagged",
        "similar_steps": lagged + f"SELECT row_id, CASE WHEN {steps} <= 20.0 AND abs(p_speed - speed) <= 12.0 AND {turn('p_cog', 'cog')} <= 90.0 THEN 0.0 ELSE 1.0 END::DOUBLE AS apart, round(abs(p_lon - lon), 6) + 0.0 AS lon_apart, trunc(speed) AS whole_knots FROM lagged",
        "lagrange3": _with(AIS, f"f AS (SELECT row_id, lag(lon) OVER o AS lon1, lag(lat) OVER o AS lat1, lon, lat, lead(lon) OVER o AS lon3, lead(lat) OVER o AS lat3 FROM ais WINDOW o AS ({TRACK}))") + f"SELECT row_id, {lagrange('((lon + lon3) / 2)')} AS lat_mid FROM f WHERE lon1 <> lon AND lon <> lon3 AND lon1 <> lon3",
        "pip_waypoint_lookup": port + "SELECT row_id, port FROM port_of",
        "pip_semi": port + "SELECT row_id, mmsi FROM port_of WHERE port IS NOT NULL",
        "pip_anti": port + "SELECT row_id, mmsi FROM port_of WHERE port IS NULL",
        "gap_flags": ais + f"SELECT row_id, coalesce(seconds - lag(seconds) OVER ({TRACK}), 0) AS since, coalesce(seconds - lag(seconds) OVER ({TRACK}), 0) >= 86400 AS is_gap FROM ais",
        "voyage_positions": seg + "SELECT row_id, mmsi, voyage_seq, prev_port, arrive FROM segments",
        "voyage_segments": voy + "SELECT row_id, mmsi, voyage_id, itinerary, seconds, lon, lat FROM voyages",
        "voyages_stream": voy + "SELECT row_id, mmsi, voyage_id, itinerary, seconds, lon, lat FROM voyages",
        "voyage_summary": voy + "SELECT voyage_id, itinerary, count(*) AS positions, min(seconds) AS start_s, max(seconds) AS end_s FROM voyages GROUP BY voyage_id, itinerary",
        "interpolate": filled + f"SELECT voyage_id, seconds, k, lon_k AS lon, lat_k AS lat, round({km('lon_p', 'lat_p', 'lon_k', 'lat_k')} * 3600.0 / 3600.0 / 1.852, 4) + 0.0 AS knots, round({bearing('lon_p', 'lat_p', 'lon_k', 'lat_k')}, 4) + 0.0 AS bearing FROM new",
        "interpolate_fill": filled + "SELECT v.voyage_id, v.c + coalesce(m.c, 0) AS positions, coalesce(m.c, 0) AS interpolated FROM (SELECT voyage_id, count(*) AS c FROM voyages GROUP BY voyage_id) v LEFT JOIN (SELECT voyage_id, count(*) AS c FROM new GROUP BY voyage_id) m USING (voyage_id)",
        "interpolate_180s": filled_180 + f"SELECT voyage_id, seconds, k, lon_k AS lon, lat_k AS lat, round({km('lon_p', 'lat_p', 'lon_k', 'lat_k')} * 3600.0 / 180.0 / 1.852, 4) + 0.0 AS knots, round({bearing('lon_p', 'lat_p', 'lon_k', 'lat_k')}, 4) + 0.0 AS bearing FROM new",
        "interpolate_fill_180s": filled_180 + "SELECT v.voyage_id, v.c + coalesce(m.c, 0) AS positions, coalesce(m.c, 0) AS interpolated FROM (SELECT voyage_id, count(*) AS c FROM voyages GROUP BY voyage_id) v LEFT JOIN (SELECT voyage_id, count(*) AS c FROM new GROUP BY voyage_id) m USING (voyage_id)",
        "cell_stats": more(CELLS) + f"SELECT itinerary || '-' || cell_id AS key, itinerary, cell_id, {spread('cog', 'heading')}, {spread('speed', 'speed')} FROM cells GROUP BY itinerary, cell_id",
        "step_distance_stats": more(CELLS, STEPS) + "SELECT itinerary, cell_id, round(coalesce(avg(d), 0), 6) + 0.0 AS mean_km, round(coalesce(stddev_pop(d), 0), 6) + 0.0 AS std_km FROM steps GROUP BY itinerary, cell_id",
        "cluster_stats_quadrant": more(QUADRANT) + "SELECT * FROM stats",
        "cluster_endpoints": more(QUADRANT) + "SELECT itinerary AS id, p AS place, CASE WHEN p = 0 THEN start_lat ELSE end_lat END AS latitude, CASE WHEN p = 0 THEN start_lon ELSE end_lon END AS longitude, avg_cog AS avgheading, avg_speed AS avgspeed, speed_deviation AS speeddeviation, cog_deviation AS headingdeviation FROM stats, (VALUES (0), (1)) v(p)",
        "circular_stats": voy + "SELECT itinerary, round(sum(sin(radians(cog))), 5) + 0.0 AS sum_sin, round(degrees(sqrt(greatest(0.0, -2 * ln(least(1.0, sqrt(pow(avg(sin(radians(cog))), 2) + pow(avg(cos(radians(cog))), 2))))))), 4) + 0.0 AS circular_std FROM voyages GROUP BY itinerary",
        "vessel_voyage_counts": voy + "SELECT itinerary, count(DISTINCT mmsi) AS vessels, count(DISTINCT voyage_id) AS voyages, count(*) AS positions FROM voyages GROUP BY itinerary",
        "key_counts": "SELECT user_id AS mmsi, count(*) AS n FROM events GROUP BY user_id",
        "balanced_partition": "SELECT user_id AS mmsi, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM events GROUP BY user_id",
        "dbscan_labels": stop_labels + "SELECT row_id, cluster_id FROM labelled",
        "dbscan_spheroid": _with(AIS, STOPS, labels("stops", f"{geo_near.replace('2000.0', '2100.0')} AND {spheroid('l.lon', 'l.lat', 'r.lon', 'r.lat')} <= 2000.0", 3), recursive=True) + "SELECT row_id, cluster_id FROM labelled",
        "waypoints": stop_labels + "SELECT row_number() OVER (ORDER BY cluster_id) - 1 AS id, cluster_id, count(*) AS members, round(min(lon), 6) + 0.0 AS west, round(max(lon), 6) + 0.0 AS east FROM labelled JOIN stops USING (row_id) GROUP BY cluster_id",
        "traj_clusters": traj + "SELECT row_id, itinerary, cell_id, cluster_id FROM labelled JOIN cells USING (row_id)",
        "route_clusters": more(labels("voyages", route_near, 5), recursive=True) + "SELECT row_id, cluster_id FROM labelled",
        "hull_features": traj + f"SELECT cluster_id, itinerary, cell_id, {spread('cog', 'heading')}, {spread('speed', 'speed')} FROM labelled JOIN cells USING (row_id) GROUP BY cluster_id, itinerary, cell_id HAVING count(DISTINCT voyage_id) > 1",
        "waypoint_hulls": _with(AIS, STOPS, labels("stops", geo_near, 3), "found AS (SELECT s.*, cluster_id FROM labelled JOIN stops s USING (row_id))", hull("found", "cluster_id"), recursive=True) + "SELECT * FROM hull_text",
        "hull_rows": more(CELLS, limits, labels("limited", similar, 3, "l.itinerary = r.itinerary AND l.cell_id = r.cell_id AND"), good_cells, hull("good", "cluster_id"), recursive=True) + "SELECT * FROM features JOIN hull_text USING (cluster_id)",
        "itinerary_clusters": in_itinerary + "SELECT * FROM stats JOIN hull_text USING (itinerary, cluster_id)",
        "convex_hull_vertices": more(hull("voyages", "itinerary")) + "SELECT itinerary, CAST(count(*) AS INTEGER) AS points, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, any_value(polygon) AS polygon FROM hull_ring JOIN hull_text USING (itinerary) GROUP BY itinerary",
        "positions_file": ais + READ,
        "positions_file_stream": ais + READ,
        "voyages_file": voy + "SELECT voyage_id, itinerary, mmsi, seconds, lon, lat, cog, cog AS heading, speed FROM voyages",
        "ports_file": _with(PORTS) + "SELECT id, place, lon, lat FROM corners",
        "hulls_file": more(hull("voyages", "itinerary")) + "SELECT 'hull ' || itinerary AS id, itinerary, place, lon, lat FROM hull_ring",
        "grid_file": "SELECT r * 231 + c + 1 AS cell_id, round((-8000000 + c * 200000) / 1e6, 2) AS lon, round((29000000 + r * 200000) / 1e6, 2) AS lat FROM range(91) a(r), range(231) b(c)",
        "wkt_file": _with(PORTS) + f"SELECT '\"' || {wkt} || '\"' AS line, any_value(round((ea - w) * (n - s), 6)) AS area FROM corners JOIN ports USING (id) GROUP BY id",
        "cell_members_file": more(CELLS) + f"SELECT voyage_id, cell_id, lon, lat, {CLOCK} AS timestamp FROM cells",
        "cell_stats_file": more(CELLS) + f"SELECT itinerary || '-' || cell_id AS key, itinerary, cell_id, {spread('cog', 'heading')}, {spread('speed', 'speed')} FROM cells GROUP BY itinerary, cell_id",
        "hull_bounds": voy + "SELECT itinerary, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM voyages GROUP BY itinerary",
        "kfold_split": more(FOLDS) + "SELECT * FROM folds",
        "kfold_rows": more(FOLDS) + "SELECT CAST(f AS INTEGER) AS fold, CASE WHEN f = fold THEN 'TEST' ELSE 'TRAIN' END AS type, itinerary FROM folds, range(10) t(f)",
        "hull_accuracy": more(FOLDS, hull("voyages", "itinerary"), """
hull_box AS (SELECT h.itinerary, fold, min(lon) AS bw, max(lon) AS be, min(lat) AS bs, max(lat) AS bn FROM hull_ring h JOIN folds USING (itinerary) GROUP BY h.itinerary, fold),
own AS (SELECT row_id, lon, lat, fold FROM voyages JOIN folds USING (itinerary)),
inside AS (SELECT DISTINCT row_id FROM (SELECT o.row_id, b.itinerary FROM own o JOIN hull_box b ON b.fold <> o.fold AND o.lon BETWEEN bw AND be AND o.lat BETWEEN bs AND bn JOIN hull_edge e ON e.itinerary = b.itinerary GROUP BY o.row_id, b.itinerary
  HAVING count(*) FILTER (WHERE ((y1 <= o.lat AND o.lat < y2) OR (y2 <= o.lat AND o.lat < y1)) AND o.lon < (x2 - x1) * (o.lat - y1) / (y2 - y1) + x1) % 2 = 1)),
per AS (SELECT fold, avg(CASE WHEN i.row_id IS NULL THEN 0.0 ELSE 1.0 END) AS accuracy FROM own LEFT JOIN inside i USING (row_id) GROUP BY fold)""") + "SELECT fold, round(accuracy, 6) + 0.0 AS accuracy, CAST(NULL AS DOUBLE) AS std FROM per UNION ALL SELECT -1, round(avg(accuracy), 6) + 0.0, round(stddev_pop(accuracy), 6) + 0.0 FROM per",
        "box_accuracy": more(FOLDS, """
hull AS (SELECT fold, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM voyages JOIN folds USING (itinerary) GROUP BY itinerary, fold),
hit AS (SELECT v.row_id, f.fold, max(CAST(h.fold IS NOT NULL AS INTEGER)) AS hit FROM voyages v JOIN folds f USING (itinerary) LEFT JOIN hull h ON h.fold <> f.fold AND v.lon >= w AND v.lon < e AND v.lat >= s AND v.lat < n GROUP BY v.row_id, f.fold),
per AS (SELECT fold, avg(hit) AS accuracy FROM hit GROUP BY fold)""") + "SELECT fold, round(accuracy, 6) + 0.0 AS accuracy, CAST(NULL AS DOUBLE) AS std FROM per UNION ALL SELECT -1, round(avg(accuracy), 6) + 0.0, round(stddev_pop(accuracy), 6) + 0.0 FROM per",
    }
