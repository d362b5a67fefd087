import random

from pyspark.sql import functions as F

from periplus.functions import polygons
from periplus.operators import clustering, folds, hulls, interpolation, partitioning, spatial_join, voyages
from periplus.sources import ais, fixture
from periplus.streaming.voyages import advance


def machine(rows, gap=86_400):
    """Voyages of one vessel by the state machine: (from, to, row ids), closed ones only."""
    prev, last, held, out = -1, None, [], []
    for row_id, seconds, port in rows:
        silent = last is not None and seconds - last >= gap
        if port is not None and port != prev:
            held.append((row_id, port))
            out.append((prev, port, held))
            held, prev = [], port
        else:
            if silent:
                out.append((prev, -1, held))
                held, prev = [], -1
            held.append((row_id, port))
        last = seconds
    return [(a, b, [r for r, p in h if p is None]) for a, b, h in out if a >= 0 and b >= 0 and sum(p is None for _, p in h) >= 3]


def tracks(seed, vessels=40, n=60):
    r, rows, k = random.Random(seed), [], 0
    for m in range(vessels):
        t = 0
        for _ in range(n):
            t += r.choice([60] * 8 + [86_399, 86_400, 200_000])
            rows.append((k, m, t, r.choice([None, None, None, 1, 2, 3])))
            k += 1
    return rows


def test_voyages_follow_the_state_machine(spark):
    rows = tracks(1)
    df = spark.createDataFrame([(*x, 0.0, 0.0, 0.0, 0.0) for x in rows], "row_id long, mmsi long, seconds long, port int, lon double, lat double, cog double, speed double")
    got = {}
    for r in voyages.voyages(df).collect():
        got.setdefault((r["mmsi"], r["voyage_id"], r["itinerary"]), []).append(r["row_id"])
    got = sorted((m, i, sorted(v)) for (m, _, i), v in got.items())
    want = sorted((m, f"{a}_to_{b}", ids) for m in range(40) for a, b, ids in machine([(k, t, p) for k, mm, t, p in rows if mm == m]))
    assert got == want and len(want) > 20


def test_stream_steps_follow_the_state_machine():
    for m in range(40):
        rows = [(k, t, p) for k, mm, t, p in tracks(2) if mm == m]
        state, held, out = (-1, 0, None), [], []
        for k, t, p in rows:
            state, ends, pair, _ = advance(state, (t, p))
            if ends:
                if pair and pair[0] >= 0 and len(held) >= 3:
                    out.append((*pair, held))
                held = []
            if p is None:
                held.append(k)
        assert out == machine(rows)


def test_stream_flushes_silent_vessels(spark, tmp_path):
    """Vessel 1 is silent while vessel 2 sails on; its open positions go, those after the flush are its voyage."""
    from periplus.streaming import voyages as streamed

    day = 86_400
    def report(vessel, row, seconds, port=None):
        return (vessel, row, seconds, 1.0, 31.0, 90.0, 10.0, port)

    batches = [[report(1, 1, 0, 5), *[report(1, k, 60 * k) for k in (2, 3, 4)]], [report(2, 5, 40 * day)], [report(2, 6, 41 * day)], [report(1, 7, 42 * day, 6)]]
    schema = "mmsi long, row_id long, seconds long, lon double, lat double, cog double, speed double, port int"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in-{k}"))
    import glob
    import os
    import shutil

    os.mkdir(tmp_path / "in")
    for k in range(len(batches)):
        shutil.copy(next(p for p in glob.glob(str(tmp_path / f"in-{k}" / "*.parquet"))), tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1000 + k, 1000 + k))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for idle, want in ((None, [2, 3, 4]), (30 * day, [])):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = str(tmp_path / f"out-{idle}")
            q = streamed.segment(stream, gap=100 * day, idle=idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
            q.awaitTermination()
            assert sorted(r["row_id"] for r in spark.read.schema(streamed.OUTPUT).parquet(out).collect()) == want
    finally:
        spark.conf.unset(provider)


def test_point_in_polygon_joins(spark):
    shapes = spark.createDataFrame([(2, "POLYGON ((0 30, 10 30, 10 40, 0 40, 0 30))"), (1, "POLYGON ((5 35, 6 35, 6 36, 5 36, 5 35))"), (3, "POLYGON ((-9 28, -7 28, -7 30, -9 30, -9 28))")], "id int, wkt string")
    shapes = shapes.select("id", polygons.parse_wkt(F.col("wkt")).alias("ring"))
    points = spark.createDataFrame([(1, 5.5, 35.5), (2, 1.0, 31.0), (3, 20.0, 31.0), (4, -7.5, 29.5), (5, None, 1.0), (6, 9.9, 39.9), (7, 5.05, 35.05)], "row_id long, lon double, lat double")
    got = {r["row_id"]: r["port"] for r in spatial_join.lookup(points, shapes).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 3, 5: None, 6: 2, 7: 1}
    assert {r["row_id"]: r["shape_id"] for r in spatial_join.matches(points, shapes, "row_id").collect()} == {1: 1, 2: 2, 4: 3, 6: 2, 7: 1}
    assert spatial_join.inside(points, shapes).count() == 5 and spatial_join.outside(points, shapes).count() == 2
    # The compatibility index knows vertex cells only: the middle of a large polygon is missed.
    compat = {r["row_id"]: r["port"] for r in spatial_join.lookup(points, shapes, compat=True).collect()}
    assert compat[7] == 1 and compat[1] is None and compat[2] is None


def test_large_covers_are_not_broadcast(spark, monkeypatch):
    """Few shapes over many cells: the index counts, not the shapes; both joins find the same."""
    wide = "POLYGON ((-7.5 29.5, 37.5 29.5, 37.5 46.5, -7.5 46.5, -7.5 29.5))"
    shapes = spark.createDataFrame([(k, wide) for k in range(8)], "id int, wkt string").select("id", polygons.parse_wkt(F.col("wkt")).alias("ring"))
    assert spatial_join.index_bytes(shapes) == spatial_join.cell_index(shapes).count() * (5 * 16 + 32) > spatial_join.BROADCAST_BYTES
    points = spark.createDataFrame([(1, 5.5, 35.5), (2, 50.0, 31.0), (3, None, 1.0)], "row_id long, lon double, lat double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(spatial_join.lookup(points, shapes)) and "BroadcastHashJoin" not in plan(spatial_join.matches(points, shapes, "row_id"))
    one = shapes.where("id < 1")
    assert "BroadcastHashJoin" in plan(spatial_join.lookup(points, one))
    small = {r["row_id"]: r["port"] for r in spatial_join.lookup(points, one).collect()}
    monkeypatch.setattr(spatial_join, "BROADCAST_BYTES", 0)
    assert {r["row_id"]: r["port"] for r in spatial_join.lookup(points, one).collect()} == small == {1: 0, 2: None, 3: None}
    assert spatial_join.index_bytes(shapes.limit(0)) == 0


def voyage(spark, points):
    return spark.createDataFrame([("v", "1_to_2", 1, k, t, float(x), float(y)) for k, (t, x, y) in enumerate(points)], "voyage_id string, itinerary string, mmsi int, row_id long, seconds long, lon double, lat double")


def test_interpolation(spark):
    ports = fixture.ports(spark).where("false")
    at = lambda points, **k: sorted((r["seconds"], round(r["lon"], 9), round(r["lat"], 9)) for r in interpolation.interpolated(voyage(spark, points), ports, **k).collect())
    line = at([(0, 0, 0), (100, 1, 1), (1000, 5, 5)])
    assert line == [(280, 2.0, 2.0), (460, 3.0, 3.0), (640, 4.0, 4.0)]
    west = [(0, 5, 5), (100, 4, 4), (1000, 0, 0)]
    assert at(west) == [(280, 3.0, 3.0), (460, 2.0, 2.0), (640, 1.0, 1.0)]
    assert at(west, compat=True)[0][1] == 5.0
    assert at([(0, 0, 0), (100, 1, 1), (460, 5, 5)]) == []
    assert at([(0, 0, 0), (100, 1, 1), (1000, 1, 5)]) == []
    assert at([(0, 0, 0), (100, 1, 1)]) == []
    filled = interpolation.fill(voyage(spark, [(0, 0, 0), (100, 1, 1), (1000, 5, 5)]), ports)
    assert filled.count() == 6 and filled.where("is_interpolated").count() == 3


def brute_dbscan(points, near, least):
    ids = [p[0] for p in points]
    adj = {p[0]: [q[0] for q in points if q[0] != p[0] and near(p, q)] for p in points}
    core = {i for i in ids if len(adj[i]) + 1 >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in label:
                    label[j] = i
                    stack += [k for k in adj[j] if k in core]
    for i in ids:
        if i not in core and (near_core := [label[j] for j in adj[i] if j in core]):
            label[i] = min(near_core)
    return label


def test_geographic_clusters(spark):
    import math

    r = random.Random(3)
    points = [(k, r.choice([1.0, 1.2, 5.0]) + r.gauss(0, 0.012), 40 + r.gauss(0, 0.012)) for k in range(150)]

    def near(p, q):
        a = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 6371_000 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) <= 500

    df = spark.createDataFrame(points, "row_id long, lon double, lat double")
    got = {x["row_id"]: x["cluster_id"] for x in clustering.geographic(df, 500.0, 4).collect()}
    want = brute_dbscan(points, near, 4)
    assert got == want and len(set(want.values())) > 1 and len(want) < 150
    assert clustering.geographic(df.where("false"), 500.0, 4).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = clustering.components(edges).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


def test_hulls_by_group(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 0.0), ("a", 2.0, 2.0), ("a", 0.0, 2.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", None, 1.0)], "g string, lon double, lat double").repartition(3)
    got = {r["g"]: [(p["lon"], p["lat"]) for p in r["ring"]] for r in hulls.convex(df, ["g"]).collect()}
    assert got == {"a": [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], "b": [(1, 1), (1, 1)]}
    assert hulls.concave(df.where("g = 'a'"), ["g"]).count() == 1


def test_balance_and_folds(spark):
    assert dict(partitioning.assign([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2)) == {"a": 0, "b": 1, "c": 1, "d": 0}
    names = spark.createDataFrame([(f"{k}_to_{k + 1}",) for k in range(25)], "itinerary string")
    got = [r["fold"] for r in folds.split(names).collect()]
    assert sorted(got.count(f) for f in range(10)) == [2] * 5 + [3] * 5
    assert folds.rows(folds.split(names)).where("type = 'TEST'").count() == 25


def test_files(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text('MMSI,IMO,LATITUDE,LONGITUDE,COG,HEADING,SOG,TIMESTAMP,NAME,SHIP_TYPE,DESTINATION,ANNOTATION\n7,NULL,36.5,23.25,10.5,NULL,125,2020-01-02 03:04:05,"A, B",Cargo,PIRAEUS\n8,9,bad,23.25,10.5,11,0,never,C,Tanker,,x\n')
    a, b = ais.read_positions(spark, str(raw)).orderBy("mmsi").collect()
    assert (a["imo"], a["heading"], a["speed"], a["seconds"], a["annotation"], a["shipname"]) == (-1, 0.0, 12.5, 1577934245, "NULL", "A, B")
    assert b["lat"] is None and b["seconds"] is None and b["annotation"] == "x"
    rows = ais.read_positions(spark, str(raw)).withColumn("voyage_id", F.lit("v")).withColumn("itinerary", F.lit("1_to_2"))
    ais.write_positions(rows, str(tmp_path / "v"))
    again = ais.read_voyages(spark, str(tmp_path / "v")).where("mmsi = 7").first()
    assert (again["voyage_id"], again["speed"], again["seconds"]) == ("v", 12.5, 1577934245)
    ports = fixture.ports(spark)
    ais.write_polygons(ports, str(tmp_path / "p"))
    assert ais.read_polygons(spark, str(tmp_path / "p")).exceptAll(ports).count() == 0
    from periplus.functions.grid import Grid

    cells = Grid(0.0, 0.0, 1.0, 1.0, 0.5, 0.5).cells(spark)
    ais.write_grid(cells, str(tmp_path / "g"))
    assert ais.read_grid(spark, str(tmp_path / "g")).exceptAll(cells).count() == 0


def test_neighbours_in_the_far_north(spark):
    """Reports at 85 degrees and near the pole: as many pairs as brute force finds."""
    import math

    def km(a, b):
        (x, y), (u, v) = (map(math.radians, p) for p in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    for lat, step in ((85.0, 0.02), (89.95, 4.0)):
        places = [(10 + k * step, lat) for k in range(8)]
        rows = [("a", k, x, y, 10.0, 90.0) for k, (x, y) in enumerate(places)]
        df = spark.createDataFrame(rows, "itinerary string, row_id long, lon double, lat double, speed double, cog double")
        d = 1.01 * km(places[0], places[2])
        near = {k: sum(km(p, q) <= d for q in places) for k, p in enumerate(places)}
        for keys in (["itinerary"], []):
            got = {r["row_id"] for r in clustering.trajectories(df, keys, 5, None, d, 1.0, 1.0).collect()}
            core = {k for k, n in near.items() if n >= 5}
            assert core and got == {k for k in near if any(km(places[k], places[c]) <= d for c in core)}


def test_similar_reports_against_brute_force(spark):
    """Tiles, date line, wrapping courses, missing values and border reports: the clusters of all pairs."""
    import math

    from periplus.functions import geo

    r = random.Random(5)
    rows = [(k, r.choice(["a", "b"]), (179.9 + r.random() * 0.2 + 180) % 360 - 180, 40 + r.random() * 0.06, r.randrange(80) / 10, float(r.randrange(0, 360, 5))) for k in range(1500)]
    rows += [(1500, "a", None, 40.0, 1.0, 1.0), (1501, "b", 179.9, 40.0, float("nan"), 1.0), (1502, None, 179.9, 40.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, itinerary string, lon double, lat double, speed double, cog double").repartition(3)

    def near(p, q):
        if None in p + q or math.isnan(p[4]) or math.isnan(q[4]) or abs(p[4] - q[4]) > 2.0000001 or p[1] != q[1]:
            return False
        turn = abs(p[5] - q[5])
        a = math.sin(math.radians(q[3] - p[3]) / 2) ** 2 + math.cos(math.radians(p[3])) * math.cos(math.radians(q[3])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return min(turn, 360 - turn) <= 20 and round(geo.EARTH_KM * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)), 6) <= 1.5

    got = {x["row_id"]: x["cluster_id"] for x in clustering.trajectories(df, ["itinerary"], 5, None, 1.5, 2.0, 20.0).collect()}
    want = brute_dbscan(rows, near, 5)
    assert got == want and len(set(want.values())) > 3 and len(want) < 1500
    assert clustering.trajectories(df.where("false"), ["itinerary"], 5).count() == 0


def test_crowded_reports_need_no_pairs(spark):
    """300,000 reports in one place and 20 near them: 45 thousand million pairs."""
    import time

    df = spark.range(300_000).selectExpr("id AS row_id", "1.0D AS lon", "40.0D AS lat", "CAST(id % 7 AS DOUBLE) AS speed", "CAST(id % 360 AS DOUBLE) AS cog")
    df = df.unionByName(spark.range(20).selectExpr("300000 + id AS row_id", "1.0D + id / 1000 AS lon", "40.0D AS lat", "3.0D AS speed", "90.0D AS cog"))
    began = time.perf_counter()
    got = clustering.trajectories(df, [], 5, None, 1.0, 10.0, 60.0).groupBy("cluster_id").count().collect()
    assert [tuple(x) for x in got] == [(0, 300_020)] and time.perf_counter() - began < 120
