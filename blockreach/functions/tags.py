"""Map-tag expressions: road class, speed, land use, building flag, amenity category."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from blockreach.functions.numeric import to_number

# Road classes, their groups and default speeds (km/h).
DRIVABLE_ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link",
    "secondary", "secondary_link", "tertiary", "tertiary_link",
    "residential", "living_street", "unclassified", "service",
)
STREETS = (*DRIVABLE_ROADS, "cycleway", "path")
BIKEABLE_STREETS = (
    "residential", "living_street", "unclassified", "service",
    "tertiary", "tertiary_link", "cycleway", "path",
)
MAJOR_STREETS = (
    "motorway", "motorway_link", "trunk", "trunk_link",
    "primary", "primary_link", "secondary", "secondary_link",
)
LOCAL_STREETS = ("residential", "living_street", "unclassified", "service")
DEFAULT_SPEED_KMH = {
    "motorway": 105.0, "motorway_link": 65.0, "trunk": 90.0, "trunk_link": 55.0,
    "primary": 65.0, "primary_link": 45.0, "secondary": 55.0, "secondary_link": 40.0,
    "tertiary": 45.0, "tertiary_link": 35.0, "residential": 30.0, "living_street": 15.0,
    "unclassified": 35.0, "service": 20.0, "cycleway": 15.0, "path": 10.0,
}
OTHER_SPEED_KMH = 30.0
KM_PER_MILE = 1.60934

# Land-use tags by group.
LANDUSE_GROUPS = {
    "residential": ("residential",),
    "commercial": ("commercial", "office"),
    "retail": ("retail",),
    "industrial": ("industrial", "railway", "quarry", "landfill"),
    "civic": ("education", "religious", "cemetery", "military", "government"),
    "green": ("grass", "forest", "meadow", "recreation_ground", "park", "village_green"),
}
NOT_A_BUILDING = ("no", "none", "false")

# Tags by opportunity category, for each of the three tag keys.
CATEGORIES = ("food_retail", "healthcare", "education", "recreation", "public_services")
AMENITY_TAGS = {
    "food_retail": (
        "restaurant", "cafe", "fast_food", "bar", "pub", "marketplace", "supermarket",
        "convenience", "greengrocer", "bakery", "butcher", "deli",
    ),
    "healthcare": ("hospital", "clinic", "doctors", "dentist", "pharmacy", "veterinary"),
    "education": ("school", "college", "university", "kindergarten", "library"),
    "recreation": ("park", "sports_centre"),
    "public_services": (
        "post_office", "courthouse", "police", "fire_station", "townhall", "community_centre",
    ),
}
SHOP_TAGS = {
    "food_retail": (
        "supermarket", "convenience", "greengrocer", "bakery", "butcher", "deli", "seafood",
        "cheese", "farm", "alcohol", "beverages", "department_store", "mall",
    ),
}
LEISURE_TAGS = {
    "recreation": ("park", "sports_centre", "playground", "pitch", "stadium", "fitness_centre"),
}

_BLANKS = " \t\n\r\x0b\x0c"


def _membership(value: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Name of the group whose list holds ``value``; null outside all of them."""
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(value.isin(list(members)), F.lit(name)).otherwise(out)
    return out


def primary_tag(tag: Column) -> Column:
    """First ``;`` part of a tag, lower case without outer blanks; null counts as empty."""
    first = F.split(F.coalesce(tag, F.lit("")), ";").getItem(0)
    return F.btrim(F.lower(first), F.lit(_BLANKS))


def tag_value(other_tags: Column, tag: str) -> Column:
    """Value of one key in ``"k"=>"v"`` text, null when the key is absent."""
    found = F.regexp_extract(F.coalesce(other_tags, F.lit("")), f'"{re.escape(tag)}"=>"([^"]+)"', 1)
    return F.nullif(found, F.lit(""))


def speed_kmh(maxspeed: Column, road_class: Column) -> Column:
    """First number of a speed tag (miles converted), else the class default, else 30."""
    raw = F.lower(F.coalesce(maxspeed, F.lit("")))
    number = to_number(F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1))
    posted = F.when(raw.contains("mph"), number * KM_PER_MILE).otherwise(number)
    by_speed: dict[float, list[str]] = {}
    for name, speed in DEFAULT_SPEED_KMH.items():
        by_speed.setdefault(speed, []).append(name)
    default = F.lit(OTHER_SPEED_KMH)
    for speed, names in by_speed.items():
        default = F.when(road_class.isin(names), F.lit(speed)).otherwise(default)
    return F.coalesce(posted, default)


def landuse_group(landuse: Column) -> Column:
    """One of six land-use groups, or ``other``."""
    return F.coalesce(_membership(primary_tag(landuse), LANDUSE_GROUPS), F.lit("other"))


def is_building(building: Column) -> Column:
    """True for a non-empty building tag that does not say no."""
    tag = F.btrim(F.lower(F.coalesce(building, F.lit(""))), F.lit(_BLANKS))
    return (tag != "") & ~tag.isin(list(NOT_A_BUILDING))


def amenity_category(amenity: Column, shop: Column, leisure: Column) -> Column:
    """Opportunity category from the amenity tag, else the shop tag, else the leisure tag."""
    return F.coalesce(
        _membership(F.lower(amenity), AMENITY_TAGS),
        _membership(F.lower(shop), SHOP_TAGS),
        _membership(F.lower(leisure), LEISURE_TAGS),
    )
