"""Column functions for planar and geographic measures, sectors and relation labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000
METRES_PER_DEGREE = 111_320
# The sectors, distance bands and topology classes of the relation tables.
DIRECTIONS_8 = ("North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest")
DIRECTIONS_16 = (
    "North", "NorthNortheast", "Northeast", "EastNortheast", "East", "EastSoutheast", "Southeast", "SouthSoutheast",
    "South", "SouthSouthwest", "Southwest", "WestSouthwest", "West", "WestNorthwest", "Northwest", "NorthNorthwest",
)
DIST_BANDS = (("VeryClose", 50), ("Close", 200), ("Medium", 500), ("Far", 1000))
TOPOLOGIES = ("Coincident", "Abutting", "Opposite", "SameSide", "Intersection", "Detour", "Isolated")
AMBIGUITY_BANDS = (("EXACT", 5.0), ("SLIGHT", 15.0), ("MODERATE", 22.5))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def rounded(v: Column, digits: int = 6) -> Column:
    """Measures of 0 or more, up to 1e12, rounded by whole numbers: Spark's own rounding goes through decimals, which costs
    more than measuring a pair."""
    return F.floor(v * 10.0**digits + 0.5) / 10.0**digits


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north in [0, 360); null where both points are one."""
    turned = F.degrees(F.atan2(dx, dy))
    turned = F.when(turned < 0, turned + 360).otherwise(turned)
    return F.when((dx != 0) | (dy != 0), F.when(turned >= 360, 0.0).otherwise(turned))


def dist_level(d: Column) -> Column:
    """Band of a distance; null beyond the last, whose end belongs to it."""
    *inner, (last, most) = DIST_BANDS
    out = F.when(d < inner[0][1], inner[0][0])
    for name, end in inner[1:]:
        out = out.when(d < end, name)
    return out.when(d <= most, last)


def _sector(az: Column, names: Sequence[str]) -> Column:
    """Sectors around the names' centres. An edge belongs to the sector before it, the last edge to north."""
    width = 360 / len(names)
    out = F.when(((az >= 360 - width / 2) & (az <= 360)) | ((az >= 0) & (az <= width / 2)), names[0])
    for k, name in enumerate(names[1:], 1):
        out = out.when(az.between(width * (k - 0.5), width * (k + 0.5)), name)
    return out


def direction_8(az: Column) -> Column:
    return _sector(az, DIRECTIONS_8)


def direction_16(az: Column, topology: Column, d: Column) -> Column:
    """The fine sector where the relation is precise enough, else the coarse one."""
    fine = (topology.isin("Opposite", "Abutting") & (d < 200)) | (topology == "Intersection")
    return F.when(fine, _sector(az, DIRECTIONS_16)).otherwise(direction_8(az))


def is_ambiguous(az: Column) -> Column:
    """Within the last 2.5 degrees of a sixteenth of the circle, counted from north."""
    return F.coalesce((az % 22.5).between(20, 25), F.lit(False))


def combo_class(topology: Column) -> Column:
    return F.when(topology.isin("Coincident", "Abutting", "Intersection"), "Implicit").otherwise("Explicit")


def deviation(az: Column, direction: Column) -> Column:
    """Smallest angle between an azimuth and the centre of its eighth of the circle."""
    centre = F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(DIRECTIONS_8) for x in (name, 45.0 * k))), direction)
    off = F.abs(az - centre) % 360
    return F.when(direction.isNotNull(), F.when(off > 180, 360 - off).otherwise(off))


def ambiguity_level(dev: Column, bands: Sequence[tuple[str, float]] = AMBIGUITY_BANDS) -> Column:
    out = F.when(dev.isNull(), None)
    for name, most in bands:
        out = out.when(dev <= most, name)
    return out.otherwise("CROSS_BOUNDARY")


def has_road_ref(road_name: Column) -> Column:
    return F.coalesce(F.trim(road_name) != "", F.lit(False))


def scene_code(topology: Column, combo: Column, road_name: Column, abutting_scene_a: bool = False) -> Column:
    """Scene by topology; with ``abutting_scene_a`` every abutting pair is SCENE-A, else only explicit ones."""
    named = has_road_ref(road_name)
    abutting = (topology == "Abutting") & (F.lit(abutting_scene_a) | (combo == "Explicit"))
    return (
        F.when(topology.isin("Opposite", "SameSide", "Intersection"), F.when(named, "SCENE-B").otherwise("SCENE-E"))
        .when(abutting, "SCENE-A")
        .when(topology == "Coincident", "SCENE-D")
        .when(topology.isin("Isolated", "Detour") | (combo == "Implicit"), "SCENE-C")
        .otherwise("SCENE-E")
    )


def template_key(scene: Column, topology: Column, level: Column, direction: Column, ambiguity: Column) -> Column:
    return F.concat_ws("_", scene, topology, level, F.coalesce(direction, F.lit("None")), F.coalesce(ambiguity, F.lit("EXACT")))


def relation_quality(level: Column, d: Column, az: Column, topology: Column) -> Column:
    """SUSPECT where a stored band, azimuth or topology contradicts itself, else VALID."""
    over = F.lit(False)
    for name, most in DIST_BANDS[:-1]:
        over = over | ((level == name) & (d > most))
    wrong = over | ((level == "Far") & (d < 500)) | az.isNull() | (az < 0) | (az >= 360) | ~F.coalesce(topology.isin(*TOPOLOGIES), F.lit(False))
    return F.when(F.coalesce(wrong, F.lit(False)), "SUSPECT").otherwise("VALID")


def in_box(x: Column, y: Column, x1: float, x2: float, y1: float, y2: float) -> Column:
    return x.between(x1, x2) & y.between(y1, y2)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def moved(lon: Column, lat: Column, direction: Column, metres: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place some metres from another in an eighth of the circle."""
    angle = F.radians(F.element_at(F.create_map(*(F.lit(x) for k, n in enumerate(DIRECTIONS_8) for x in (n, 45.0 * k))), direction))
    east, north = metres * F.sin(angle), metres * F.cos(angle)
    return lon + east / (METRES_PER_DEGREE * F.cos(F.radians(lat))), lat + north / METRES_PER_DEGREE


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres."""
    r = 6_378_137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def transverse_mercator(lon: Column, lat: Column, central: float = 117.0, scale: float = 0.9996, east0: float = 500_000.0) -> tuple[Column, Column]:
    """Metres on the WGS 84 ellipsoid by the Krueger series in the third flattening: UTM by default (zone 50 N)."""
    a, f = 6_378_137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - central)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east0 + scale * radius * x, scale * radius * y
