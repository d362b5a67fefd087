from pyspark.sql import functions as F

from periplus.functions import geo, register
from periplus.plans import jobs
from periplus.sources import ais, fixture


def test_jobs_hand_over_files(spark, small, tmp_path):
    at = lambda name: str(tmp_path / name)
    reports = fixture.ais(spark, small).withColumn("timestamp", F.date_format(F.timestamp_seconds("seconds"), ais.TIME_FORMAT)).withColumn("ship_type", F.lit("Cargo"))
    ais.write_positions(reports, at("raw"))
    ais.write_polygons(fixture.ports(spark), at("ports"))
    assert jobs.segment_voyages(spark, at("raw"), at("ports"), at("voyages")).select("voyage_id").distinct().count() == 82
    filled = jobs.fill_gaps(spark, at("voyages"), at("ports"), at("filled"), 3600)
    assert filled.where("is_interpolated").count() == 902 == ais.read_voyages(spark, at("filled")).count() - ais.read_voyages(spark, at("voyages")).count()
    assert jobs.cell_statistics(spark, at("voyages"), at("ports"), at("cells")).count() > 50
    assert jobs.cluster_hulls(spark, at("voyages"), at("hulls"), 3).count() == 5
    assert jobs.hull_accuracy(spark, at("voyages"), at("accuracy")).where("fold = -1").count() == 1
    assert jobs.discover_ports(spark, at("raw"), at("found"), "Cargo", 3000.0, 1).count() > 5
    jobs.route_clusters(spark, at("raw"), at("members"), at("stats"), 20.0, 30.0, 180.0, 3)
    assert spark.read.csv(at("stats"), header=True).count() > 0
    assert jobs.itinerary_clusters(spark, at("voyages"), at("ports"), at("itineraries")).columns[0] == "itinerary"


def test_sql_functions(spark):
    assert "haversine_km" in register.register(spark)
    row = spark.sql("SELECT haversine_km(0, 0, 1, 1) AS a, heading_difference(350, 20) AS b, polygon_contains(array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 2D, 'lat', 0D), named_struct('lon', 2D, 'lat', 2D)), 1.5, 1.0) AS c, is_turning_point(0, 50, 40) AS d").first()
    want = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("v")).first()["v"]
    assert abs(row["a"] - want) < 1e-9 and row["b"] == 30 and row["c"] and row["d"]
