"""Directions in degrees.  Spark's % keeps the sign, so every wrap is a pmod."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def wrap180(angle: Column) -> Column:
    """In [-180, 180)."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def difference(a: Column, b: Column) -> Column:
    """Signed circular difference a - b in [-180, 180)."""
    return wrap180(a - b)


def in_sector(direction: Column, centre: Column, half_width: float) -> Column:
    return F.abs(difference(direction, centre)) <= half_width


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of an offset east, north."""
    return wrap360(F.degrees(F.atan2(dx, dy)))


def vector_mean(direction: Column) -> Column:
    """Aggregate: direction of the mean unit vector."""
    r = F.radians(direction)
    return wrap360(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))))


def sector(direction: Column, sectors: int) -> Column:
    """Number of the sector, the first centred on north."""
    width = 360.0 / sectors
    return F.floor(wrap360(direction + width / 2) / width).cast("int")


def yaw_loss(angle: Column) -> Column:
    """Share of power lost to a yaw error: 1 - cos squared."""
    return 1 - F.pow(F.cos(F.radians(angle)), F.lit(2.0))


def components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward wind of a meteorological (coming-from) direction."""
    r = F.radians(direction)
    return -speed * F.sin(r), -speed * F.cos(r)


def local_metres(latitude: Column, longitude: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Offsets east and north of a reference point on the equirectangular plane."""
    return (longitude - lon0) * 111_320.0 * F.cos(F.radians(lat0)), (latitude - lat0) * 110_574.0


#: WGS84: equatorial radius in metres and flattening; scale on UTM's central meridian (fixed values).
RADIUS, FLATTENING, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def utm_to_degrees(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude on WGS84 of UTM coordinates in the northern hemisphere, by Krueger's series in the third
    flattening n (to n cubed, which is exact to well under a millimetre): from the plane to the conformal sphere, whose
    conformal latitude then becomes the geodetic one."""
    n = FLATTENING / (2 - FLATTENING)
    meridian = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    to_sphere = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    to_latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    up, right = northing / (UTM_SCALE * meridian), (easting - 500_000.0) / (UTM_SCALE * meridian)
    xi, eta = up, right
    for k, b in enumerate(to_sphere, 1):
        xi = xi - b * F.sin(2 * k * up) * F.cosh(2 * k * right)
        eta = eta - b * F.cos(2 * k * up) * F.sinh(2 * k * right)
    conformal = F.asin(F.sin(xi) / F.cosh(eta))
    latitude = conformal
    for k, d in enumerate(to_latitude, 1):
        latitude = latitude + d * F.sin(2 * k * conformal)
    return F.degrees(latitude), F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183)
