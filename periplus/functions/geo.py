"""Geodesy and angles as Column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in km, km/h in a knot.
EARTH_KM = 6371.0
KNOT_KMH = 1.852


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in kilometres."""
    lon1, lat1, lon2, lat2 = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(EARTH_KM) * (2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


#: WGS84: equatorial radius in metres and flattening.
WGS84_METRES, WGS84_FLATTENING = 6378137.0, 1 / 298.257223563


def spheroid_metres(lon1, lat1, lon2, lat2) -> Column:
    """Distance on the WGS84 spheroid by Lambert's formula: a great circle between reduced latitudes, with the flattening's first-order term.

    A hundred-thousandth of the distance is its error at most, for points that are not nearly opposite each other.
    """
    f = WGS84_FLATTENING
    lon1, lat1, lon2, lat2 = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    b1, b2 = F.atan((1 - f) * F.tan(lat1)), F.atan((1 - f) * F.tan(lat2))
    h = F.pow(F.sin((b2 - b1) / 2), F.lit(2.0)) + F.cos(b1) * F.cos(b2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0))
    angle = 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (angle - F.sin(angle)) * F.try_divide(F.pow(F.sin(p) * F.cos(q), F.lit(2.0)), 1 - h)
    y = (angle + F.sin(angle)) * F.try_divide(F.pow(F.cos(p) * F.sin(q), F.lit(2.0)), h)
    return F.when(h == 0, 0.0).otherwise(WGS84_METRES * (angle - f / 2 * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))))


def heading_difference(a, b) -> Column:
    """Circular difference of two headings in degrees, 0 to 180."""
    a, b = _c(a), _c(b)
    d = F.abs(a - b)
    return F.when(d <= 180.0, d).otherwise(F.abs(F.lit(360.0) - F.greatest(a, b) + F.least(a, b)))


def is_turning_point(a, b, threshold: float) -> Column:
    return heading_difference(a, b) >= threshold


def dead_reckoning(speed, course, lon, lat, t0, t1) -> Column:
    """Projected ``struct<lon, lat>`` after t1 - t0 seconds at ``speed`` knots; a vessel at rest stays."""
    speed, course, lon, lat, t0, t1 = (_c(x) for x in (speed, course, lon, lat, t0, t1))
    kmh = speed * KNOT_KMH
    delta = (t1 - t0) * kmh / 3600 / EARTH_KM
    head, rlon, rlat = F.radians(course), F.radians(lon), F.radians(lat)
    new_lat = F.round(F.degrees(F.asin(F.sin(rlat) * F.cos(delta) + F.cos(rlat) * F.sin(delta) * F.cos(head))), 6)
    new_lon = F.round(F.degrees(rlon + F.atan2(F.sin(head) * F.sin(delta) * F.cos(rlat), F.cos(delta) - F.sin(rlat) * F.sin(F.radians(new_lat)))), 6)
    return F.when(kmh != 0.0, F.struct(new_lon.alias("lon"), new_lat.alias("lat"))).otherwise(F.struct(lon.alias("lon"), lat.alias("lat")))


def to_cartesian(lon, lat) -> Column:
    """Spherical earth-centred ``struct<x, y, z>`` in kilometres."""
    lon, lat = F.radians(_c(lon)), F.radians(_c(lat))
    return F.struct((EARTH_KM * F.cos(lat) * F.cos(lon)).alias("x"), (EARTH_KM * F.cos(lat) * F.sin(lon)).alias("y"), (EARTH_KM * F.sin(lat)).alias("z"))


def to_geodetic(x, y, z) -> Column:
    x, y, z = _c(x), _c(y), _c(z)
    r = F.sqrt(x * x + y * y + z * z)
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.asin(F.try_divide(z, r))).alias("lat"))


def euclidean_km(lon1, lat1, lon2, lat2) -> Column:
    """Straight chord between two places, in kilometres."""
    a, b = to_cartesian(lon1, lat1), to_cartesian(lon2, lat2)
    return F.sqrt(sum((F.pow(a.getField(k) - b.getField(k), F.lit(2.0)) for k in "xyz"), F.lit(0.0)))


def planar_thousandths(lon1, lat1, lon2, lat2) -> Column:
    """Compatibility form of the chord: without z, and divided by 1000."""
    a, b = to_cartesian(lon1, lat1), to_cartesian(lon2, lat2)
    return F.sqrt(F.pow(b.getField("x") - a.getField("x"), F.lit(2.0)) + F.pow(b.getField("y") - a.getField("y"), F.lit(2.0))) / 1000


def lagrange3(x0, y0, x1, y1, x2, y2, at) -> Column:
    """Quadratic through three points; null if two abscissas agree."""
    xs, ys, at = [_c(x0), _c(x1), _c(x2)], [_c(y0), _c(y1), _c(y2)], _c(at)
    total = F.lit(0.0)
    for i in range(3):
        term = F.lit(1.0)
        for j in range(3):
            if j != i:
                term = term * F.try_divide(at - xs[j], xs[i] - xs[j])
        total = total + term * ys[i]
    return total


def lagrange(xs, ys, at) -> Column:
    """Lagrange polynomial through arrays of points of any length; null if two abscissas agree."""
    xs, ys, at = _c(xs), _c(ys), _c(at)
    indices = F.sequence(F.lit(0), F.size(xs) - 1)

    def term(i: Column) -> Column:
        return F.aggregate(indices, F.lit(1.0), lambda acc, j: F.when(i == j, acc).otherwise(acc * F.try_divide(at - F.get(xs, j), F.get(xs, i) - F.get(xs, j))))

    return F.when(F.size(xs) > 0, F.aggregate(indices, F.lit(0.0), lambda acc, i: acc + term(i) * F.get(ys, i)))


def bearing(lon1, lat1, lon2, lat2, signed: bool = True) -> Column:
    """Initial bearing in degrees, -180 to 180; unsigned, the longitudes' difference counts eastwards."""
    lon1, lat1, lon2, lat2 = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    dl = lon2 - lon1 if signed else F.abs(lon2 - lon1)
    return F.degrees(F.atan2(F.cos(lat2) * F.sin(dl), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dl)))


def truncated(x, decimals: int = 0) -> Column:
    """Towards zero; null for what is no finite number."""
    scale = 10.0**decimals
    v = _c(x) * scale
    return F.when(F.abs(v) < 9e15, v.cast("bigint") / scale)


def longitude_difference(a, b) -> Column:
    return F.abs(_c(a) - _c(b))


def implied_knots(km, seconds) -> Column:
    return F.try_divide(F.try_divide(_c(km) * 3600.0, _c(seconds)), F.lit(KNOT_KMH))


def ais_similarity(lon1, lat1, speed1, heading1, lon2, lat2, speed2, heading2, d, s, h) -> Column:
    """0 if two reports are similar (distance, speed and heading within limits), else 1."""
    near = (haversine_km(lon1, lat1, lon2, lat2) <= _c(d)) & (F.abs(_c(speed1) - _c(speed2)) <= _c(s)) & (heading_difference(heading1, heading2) <= _c(h))
    return F.when(near, 0.0).otherwise(1.0)


def circular_mean(angle) -> Column:
    """Aggregate: mean direction in degrees, 0 to 360."""
    a = F.radians(_c(angle))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))) + 360.0, F.lit(360.0))


def circular_std(angle) -> Column:
    """Aggregate: circular standard deviation in degrees."""
    a = F.radians(_c(angle))
    r = F.sqrt(F.pow(F.avg(F.sin(a)), F.lit(2.0)) + F.pow(F.avg(F.cos(a)), F.lit(2.0)))
    return F.degrees(F.sqrt(F.greatest(F.lit(0.0), -2 * F.ln(F.least(r, F.lit(1.0))))))
