"""Ids, feature families and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Predictor families by column prefix.
FAMILY_PREFIXES = {"pt": "pt_", "be": "be_", "acs": "acs_"}
FAMILY_CODES = {"pt": "PT", "be": "BE", "acs": "ACS"}
FAMILY_TITLES = {
    "pt": "public transport",
    "be": "built environment",
    "acs": "sociodemographic",
}

# Direction of a feature by its value/attribution correlation.
DIRECTION_CUTOFF = 0.2
DIRECTION_TEXT = {
    "up": "higher feature values generally raise predictions",
    "down": "higher feature values generally lower predictions",
    "mixed": "mixed or weak directional pattern",
}

# State codes.
STATE_FIPS = {
    "al": "01", "ak": "02", "az": "04", "ar": "05", "ca": "06", "co": "08", "ct": "09",
    "de": "10", "dc": "11", "fl": "12", "ga": "13", "hi": "15", "id": "16", "il": "17",
    "in": "18", "ia": "19", "ks": "20", "ky": "21", "la": "22", "me": "23", "md": "24",
    "ma": "25", "mi": "26", "mn": "27", "ms": "28", "mo": "29", "mt": "30", "ne": "31",
    "nv": "32", "nh": "33", "nj": "34", "nm": "35", "ny": "36", "nc": "37", "nd": "38",
    "oh": "39", "ok": "40", "or": "41", "pa": "42", "ri": "44", "sc": "45", "sd": "46",
    "tn": "47", "tx": "48", "ut": "49", "vt": "50", "va": "51", "wa": "53", "wv": "54",
    "wi": "55", "wy": "56", "pr": "72",
}


def node_id(city: Column, block_id: Column) -> Column:
    """City-qualified block id."""
    return F.concat_ws(":", city, block_id)


def tract_of(block_id: Column) -> Column:
    """Tract id: the first eleven characters of a block id."""
    return F.substring(block_id, 1, 11)


def state_fips(abbreviation: Column) -> Column:
    """Two-digit state code; null for an unknown abbreviation (see ``checks.require_known``)."""
    table = F.create_map(*[F.lit(v) for pair in STATE_FIPS.items() for v in pair])
    return F.try_element_at(table, F.lower(abbreviation))


def family_name(feature: str) -> str:
    """Family key of a feature name known at plan time."""
    return next((k for k, p in FAMILY_PREFIXES.items() if feature.startswith(p)), "other")


def _family(feature: Column, names: dict[str, str]) -> Column:
    out = F.lit("other")
    for key, prefix in FAMILY_PREFIXES.items():
        out = F.when(feature.startswith(prefix), F.lit(names[key])).otherwise(out)
    return out


def family_code(feature: Column) -> Column:
    """PT, BE, ACS or other."""
    return _family(feature, FAMILY_CODES)


def family_title(feature: Column) -> Column:
    """Family written out."""
    return _family(feature, FAMILY_TITLES)


def feature_label(feature: Column) -> Column:
    """Readable name: family prefix removed, underscores as spaces."""
    return F.replace(F.regexp_replace(feature, "^(pt_|be_|acs_)", ""), F.lit("_"), F.lit(" "))


def direction(correlation: Column) -> Column:
    """Which way higher values move the prediction."""
    return (
        F.when(correlation >= DIRECTION_CUTOFF, F.lit(DIRECTION_TEXT["up"]))
        .when(correlation <= -DIRECTION_CUTOFF, F.lit(DIRECTION_TEXT["down"]))
        .otherwise(F.lit(DIRECTION_TEXT["mixed"]))
    )
