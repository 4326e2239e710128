"""Names, labels, roles and small conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The legend's mark of a missing age.
NO_AGE = -999999.0
#: Roles of the geological, fluid and background collections.
ROLES = {
    "geol": [
        "undef", "fault", "tectonic", "intrusive", "unconformity", "top", "base", "bedding", "foliation", "lineation",
        "axial_surface", "fold_axis", "TM_unit", "TS_unit", "INT_unit", "formation",
    ],
    "fluid": ["undef", "top", "base", "seal"],
    "backgrnd": ["undef", "annotations", "imported"],
}
#: Exchange-file geological types of the roles that have one.
GOCAD_TYPES = {
    "tectonic": "fault", "bedding": "intraformational", "foliation": "intraformational",
    "fault": "fault", "intrusive": "intrusive", "unconformity": "unconformity", "top": "top",
}
#: Names under which files give coordinates.
COORDINATE_ALIASES = {
    "X": ["easting", "east", "longitude", "lon", "utm_e", "utme", "coordx", "xcoord", "xcoordinate"],
    "Y": ["northing", "north", "latitude", "lat", "utm_n", "utmn", "coordy", "ycoord", "ycoordinate"],
    "Z": ["elevation", "height", "altitude", "depth", "coordz", "zcoord", "zcoordinate"],
}


def sanitize(s: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def number(x: Column) -> Column:
    """Text of a number, without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def label(name: Column, kind: str, *values: Column) -> Column:
    """Name of an entity made from another: threshold, cut_in, cut_out, subsamp, split, prj, int, proj_dem, delaunay2d."""
    tail = {
        "threshold": lambda lo, hi: F.concat(F.lit("_thresh_"), number(lo), F.lit("_"), number(hi)),
        "cut_in": lambda: F.lit("_cut_in"),
        "cut_out": lambda: F.lit("_cut_out"),
        "subsamp": lambda f: F.concat(F.lit("_subsamp_"), number(f)),
        "split": lambda: F.lit("_split"),
        "prj": lambda s: F.concat(F.lit("_prj_"), s),
        "int": lambda s: F.concat(F.lit("_int_"), s),
        "proj_dem": lambda: F.lit("_proj_DEM"),
        "delaunay2d": lambda: F.lit("_delaunay2d"),
    }
    return F.concat(name, tail[kind](*values))


def role_from_type(kind: Column) -> Column:
    """Role of an exchange file's geological type, whatever its case."""
    k = F.lower(kind)
    return F.when(k.isin(*ROLES["geol"]), k).when(k.contains("fault"), "fault").when(k.contains("horizon"), "top").otherwise("undef")


def type_from_role(role: Column) -> Column:
    """Geological type that an exchange file gives a role; null where it has none."""
    out = F.lit(None).cast("string")
    for r, t in sorted(GOCAD_TYPES.items()):
        out = F.when(role == r, t).otherwise(out)
    return out


def slice_index(size: Column, t: Column) -> Column:
    """1-based index of a normalised position, kept inside."""
    return F.greatest(F.lit(1), F.least(size, F.floor(t * (size - 1)).cast("int") + 1))


def slice_position(size: Column, index: Column) -> Column:
    """Normalised position of a 1-based index."""
    return F.coalesce(F.try_divide((index - 1).cast("double"), size - 1), F.lit(0.0))


def component(values: Column, j) -> Column:
    """The j-th component, from 0, of a property with several; null where there is none."""
    return F.get(values, F.lit(j) if isinstance(j, int) else j)


def age_or_null(time: Column) -> Column:
    return F.nullif(time, F.lit(NO_AGE))
