from periplus.plans import catalogue


def test_gaps_of_some_minutes_get_points(spark, small):
    fine, coarse = (catalogue.queries()[n](spark, small).count() for n in ("interpolate_180s", "interpolate"))
    assert fine > 10 * coarse
