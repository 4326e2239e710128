"""Upkeep of entity and legend tables: joins on the legend, bulk edits, merges, splits, counts, names."""

from __future__ import annotations

from bisect import bisect_right
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

KEYS = ["role", "feature", "scenario"]


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a table that is shown to be small; leave larger ones to Spark."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


#: What a well's style goes by.
WELL_KEYS = ["name"]


def with_legend(entities: DataFrame, legend: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Entities with the style, time and sequence of their role, feature and scenario; wells (WELL_KEYS) with those of their name."""
    return entities.join(_small(legend), keys, "left")


def legend_missing(entities: DataFrame, legend: DataFrame, time: float = 0.0, sequence: str = "strati_0", keys: list[str] = KEYS) -> DataFrame:
    """Legend rows to add, with defaults and a colour from a hash, for combinations that have none; wells' rows have no time and sequence."""
    new = entities.select(*keys).distinct().join(legend, keys, "left_anti")
    shade = lambda k: F.pmod(F.crc32(F.concat_ws("|", *keys, F.lit(str(k))).cast("binary")), F.lit(256)).cast("int")
    style = {"color_R": shade(0), "color_G": shade(1), "color_B": shade(2)}
    style = style if keys == WELL_KEYS else {"time": F.lit(time), "sequence": F.lit(sequence)} | style
    return new.withColumns(style | {"line_thick": F.lit(5.0), "point_size": F.lit(10.0), "opacity": F.lit(100)})


def legend_prune(legend: DataFrame, entities: DataFrame) -> DataFrame:
    """Legend rows that some entity uses."""
    return legend.join(entities.select(*KEYS).distinct(), KEYS, "left_semi")


def legend_by_time(legend: DataFrame) -> DataFrame:
    """Legend in order of time, then of its keys."""
    return legend.orderBy("time", *KEYS)


def distinct_isovalues(legend: DataFrame) -> DataFrame:
    """Known times, each with the first of its legend rows by key."""
    known = legend.withColumn("time", N.age_or_null(F.col("time"))).where("time is not null")
    return known.groupBy("time").agg(F.min(F.struct(*KEYS)).alias("k")).select("time", "k.*")


def section_children(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that belong to each section, by collection."""
    s = sections.select(F.col("uid").cast("string").alias("section_uid"), F.col("name").alias("section"))
    return entities.join(s, F.col("parent_uid") == F.col("section_uid")).groupBy("section", "collection").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid"))


def filter_entities(entities: DataFrame, query: Column | str, uids: DataFrame | None = None) -> DataFrame:
    """uids that satisfy a condition and are among given ones."""
    got = entities.where(query).select("uid")
    return got if uids is None else got.join(uids.select("uid").distinct(), "uid", "left_semi")


def lookup(entities: DataFrame, attribute: str, value: str) -> DataFrame:
    """uids with this value of an attribute."""
    return entities.where(F.col(attribute) == value).select("uid")


def set_attribute(entities: DataFrame, uids: DataFrame, column: str, value, roles: dict[str, list[str]] | None = None) -> DataFrame:
    """Entities with a column set for some uids; a role must be valid for the entity's collection."""
    if column == "role" and not any(value in r for r in (roles or N.ROLES).values()):
        raise ValueError(f"{value!r} is no role")
    chosen = uids.select(F.col("uid").alias("_u")).distinct()
    e = entities.join(chosen, F.col("uid") == F.col("_u"), "left")
    allowed = F.col("_u").isNotNull()
    if column == "role":
        fits = F.lit(False)
        for kind, valid in (roles or N.ROLES).items():
            fits = fits | ((F.col("collection") == kind) & F.lit(value in valid))
        allowed = allowed & fits
    return e.withColumn(column, F.when(allowed, F.lit(value)).otherwise(F.col(column))).drop("_u")


def export_selection(entities: DataFrame, topologies: list[str]) -> DataFrame:
    """Geological entities whose topology a format can hold."""
    return entities.where((F.col("collection") == "geol") & F.col("topology").isin(*topologies))


def add_property(entities: DataFrame, name: str, components: int = 1) -> DataFrame:
    """Entities whose property lists have name; those that had it keep theirs."""
    has = F.array_contains("properties_names", name)
    return entities.withColumns({
        "properties_components": F.when(has, F.col("properties_components")).otherwise(F.array_append("properties_components", F.lit(components))),
        "properties_names": F.when(has, F.col("properties_names")).otherwise(F.array_append("properties_names", F.lit(name))),
    })


def remove_property(entities: DataFrame, name: str) -> DataFrame:
    """Entities whose property lists lack name."""
    kept = F.filter(F.arrays_zip("properties_names", "properties_components"), lambda p: p["properties_names"] != name)
    e = entities.withColumn("_p", kept)
    return e.withColumns({
        "properties_names": F.transform("_p", lambda p: p["properties_names"]),
        "properties_components": F.transform("_p", lambda p: p["properties_components"]),
    }).drop("_p")


def common_properties(entities: DataFrame) -> DataFrame:
    """Properties that all of the entities have."""
    n = entities.agg(F.countDistinct("uid").alias("total"))
    p = entities.select("uid", F.explode("properties_names").alias("property_name")).distinct().groupBy("property_name").agg(F.count(F.lit(1)).alias("n"))
    return p.join(F.broadcast(n), F.col("n") == F.col("total")).select("property_name", "n")


FIXED_PROPERTIES = ["X", "Y", "Z", "MD"]


def property_catalog(entities: DataFrame) -> DataFrame:
    """Names of all properties; those of several components as name[j]; and X, Y, Z and MD, which every entity has."""
    p = entities.select(F.explode(F.arrays_zip("properties_names", "properties_components")).alias("p"))
    p = p.select(F.col("p.properties_names").alias("name"), F.col("p.properties_components").alias("k"))
    many = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.concat(F.col("name"), F.lit("["), j.cast("string"), F.lit("]")))
    got = p.select(F.explode(F.when(F.col("k") > 1, many).otherwise(F.array("name"))).alias("property_name"))
    fixed = entities.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FIXED_PROPERTIES))).alias("property_name"))
    return got.union(fixed).distinct()


def update_properties(legend: DataFrame, entities: DataFrame, colormap: str = "rainbow") -> DataFrame:
    """Property legend (property_name, colormap) after a change of entities: new names come with the default colormap, unused ones go."""
    now = property_catalog(entities)
    kept = legend.select("property_name", "colormap").join(now, "property_name", "left_semi")
    new = now.join(legend, "property_name", "left_anti").select("property_name", F.lit(colormap).alias("colormap"))
    return kept.union(new)


def hierarchy_counts(entities: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of the entity tree: every prefix of the levels, null below it."""
    return entities.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def count_features(features: DataFrame) -> DataFrame:
    """Entities that rows of features will make: points one for each (feature, role, scenario), lines one each."""
    points = features.where("geometry = 'point'").select(*KEYS).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("point").alias("geometry"), "n")
    lines = features.where("geometry <> 'point'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("line").alias("geometry"), "n")
    return points.union(lines)


def role_validation(features: DataFrame, valid: list[str]) -> DataFrame:
    """Rows by role, whether it is valid, and the role after invalid ones became undef."""
    ok = F.coalesce(F.col("role").isin(*valid), F.lit(False))
    return features.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max(ok).alias("valid"), F.max(F.when(ok, F.col("role")).otherwise("undef")).alias("new_role"))


def group_points_to_entities(features: DataFrame) -> DataFrame:
    """Point rows as one entity for each combination; name and azimuth of the first row, dip direction from it."""
    e = features.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_points"), F.min_by("name", "row_no").alias("name"), F.min_by("dir", "row_no").alias("dir"))
    return e.withColumn("dip_dir", F.pmod(F.col("dir") + 90, F.lit(360.0)))


def _merged(points: DataFrame, entities: DataFrame, uids: list[str], topology: str, parent_uid: str) -> tuple[DataFrame, DataFrame]:
    """The entities of uids with this topology and parent, and where the point ids of each begin, in order of uid."""
    chosen = entities.where(F.col("uid").isin(*uids) & (F.col("topology") == topology) & (F.col("parent_uid") == parent_uid)).select("uid")
    sizes = points.join(chosen, "uid", "left_semi").groupBy("uid").agg(F.max("point_id").alias("last"))
    start = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chosen, F.broadcast(sizes.select("uid", start.alias("start")))  # a row for each merged uid


def merge_entities(points: DataFrame, entities: DataFrame, uids: list[str], new_uid: str, topology: str, parent_uid: str) -> DataFrame:
    """Points of the entities of one topology and parent, as one entity; ids follow each other in order of uid."""
    _, start = _merged(points, entities, uids, topology, parent_uid)
    return points.join(start, "uid").withColumn("point_id", F.col("point_id") + F.col("start")).withColumn("uid", F.lit(new_uid)).drop("start")


def merge_cells(cells: DataFrame, points: DataFrame, entities: DataFrame, uids: list[str], new_uid: str, topology: str, parent_uid: str, corners: tuple[str, ...] = ("p0", "p1", "p2")) -> DataFrame:
    """Cells of the merged entities on the ids that merge_entities gives their points, numbered anew in order of uid and cell_id."""
    _, start = _merged(points, entities, uids, topology, parent_uid)
    c = cells.join(start, "uid").withColumns({k: F.col(k) + F.col("start") for k in corners})
    number = F.row_number().over(Window.orderBy("start", "cell_id")) - 1
    return c.withColumn("cell_id", number.cast("long")).withColumn("uid", F.lit(new_uid)).drop("start")


def without_merged(table: DataFrame, points: DataFrame, entities: DataFrame, uids: list[str], topology: str, parent_uid: str) -> DataFrame:
    """Rows of entities, points or cells of all uids but the merged ones, for merges that remove their sources."""
    chosen, _ = _merged(points, entities, uids, topology, parent_uid)
    return table.join(F.broadcast(chosen), "uid", "left_anti")


def append(*tables: DataFrame) -> DataFrame:
    """Union of tables by name; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def clone(entities: DataFrame, salt: str = "copy") -> DataFrame:
    """Copies with new uids from a hash of the old."""
    return entities.withColumn("uid", F.md5(F.concat(F.col("uid"), F.lit("/" + salt))))


def remove(entities: DataFrame, uids: DataFrame) -> DataFrame:
    """Entities without some; their uids also leave the texture lists of the others."""
    gone = uids.select("uid").distinct()
    kept = entities.join(gone, "uid", "left_anti")
    if "textures" not in entities.columns:
        return kept
    t = kept.select("uid", F.posexplode_outer("textures").alias("_at", "_t")).join(gone.withColumnRenamed("uid", "_g"), F.col("_t") == F.col("_g"), "left")
    t = t.where("_t is not null and _g is null").groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda s: s["_t"]).alias("_textures"))
    return kept.join(t, "uid", "left").withColumn("textures", F.when(F.col("textures").isNotNull(), F.coalesce("_textures", F.array().cast("array<string>")))).drop("_textures")


def split_by_label(points: DataFrame, label: str) -> DataFrame:
    """Points re-keyed to one entity for each label of each uid, named uid_i with i from 0 in order of labels."""
    labels = points.select("uid", label).distinct()
    labels = labels.withColumn("part", F.row_number().over(Window.partitionBy("uid").orderBy(label)) - 1)
    out = points.join(_small(labels), ["uid", label])
    return out.withColumn("new_uid", F.concat_ws("_", F.col("uid").cast("string"), F.col("part").cast("string")))


def modelling_input(points: DataFrame, entities: DataFrame, legend: DataFrame, keep: list[str]) -> DataFrame:
    """Points of the entities with the legend's time (null if unknown) and sequence; attributes null everywhere are dropped."""
    styled = entities.select("uid", *KEYS).join(_small(legend.select(*KEYS, "time", "sequence")), KEYS)
    p = points.join(styled.select("uid", N.age_or_null(F.col("time")).alias("time"), "sequence"), "uid")
    counts = p.agg(*[F.count(c).alias(c) for c in keep]).first()
    return p.drop(*[c for c in keep if not counts[c]])


def _tailed(batches):
    """First free number of tails of each new name; rows come family by family, taken ones first, and only runs of taken numbers are carried on."""
    family, starts, ends = object(), [], []
    for pdf in batches:
        got = []
        for base, kind, t in zip(pdf["base"], pdf["kind"], pdf["t"]):
            if base != family:
                family, starts, ends = base, [], []
            at = bisect_right(starts, t) - 1
            held = at >= 0 and ends[at] > t
            t = ends[at] if held and kind else t
            got.append(t)
            if held and not kind:
                continue
            left, right = at >= 0 and ends[at] == t, at + 1 < len(starts) and starts[at + 1] == t + 1
            if left and right:
                ends[at] = ends.pop(at + 1)
                starts.pop(at + 1)
            elif left:
                ends[at] = t + 1
            elif right:
                starts[at + 1] = t
            else:
                starts.insert(at + 1, t)
                ends.insert(at + 1, t + 1)
        yield pdf.assign(t=got)[pdf["kind"] == 1]


def unique_names(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New names, repeated `_(1)` appended until none is taken (by an existing or an earlier new name).

    A name's family is the name without its `_(1)` tails, so a round of a family needs no other family.
    """
    base = lambda c: F.regexp_replace(c, r"(_\(1\))+$", "")
    tails = lambda c: (F.length(c) - F.length(base(c))) / 4
    parts = [base(F.col("name")).alias("base"), tails(F.col("name")).cast("int").alias("t")]
    taken = existing.where("name is not null").select(F.lit(None).cast("long").alias("id"), *parts, F.lit(0).alias("kind")).distinct()
    named = new.where("name is not null").select(F.col("id").cast("long").alias("id"), *parts, F.lit(1).alias("kind"))
    rows = taken.unionByName(named).repartition("base").sortWithinPartitions("base", "kind", "id", "t")
    out = rows.mapInPandas(_tailed, rows.schema).select("id", F.concat(F.col("base"), F.repeat(F.lit("_(1)"), F.col("t"))).alias("name"))
    return out.unionByName(new.where("name is null").select(F.col("id").cast("long").alias("id"), "name"))


def conform(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns of a collection: x_section becomes parent_uid, unknown ones go, missing ones get their default."""
    if "x_section" in df.columns and "parent_uid" not in df.columns:
        df = df.withColumnRenamed("x_section", "parent_uid")
    return df.select(*[F.col(c) if c in df.columns else d.alias(c) for c, d in defaults.items()])


def match_coordinate_columns(columns: list[str]) -> tuple[dict[str, str], list[str]]:
    """Axis of each column that names one, and the axes that none names."""
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    known = {plain(a): axis for axis, names in N.COORDINATE_ALIASES.items() for a in (axis, *names)}
    found: dict[str, str] = {}
    for c in columns:
        axis = known.get(plain(c))
        if axis and axis not in found.values():
            found[c] = axis
    return found, [a for a in "XYZ" if a not in found.values()]


def fuzzy_match_columns(columns: list[str], targets: list[str], least: float = 0.8) -> dict[str, str]:
    """Best target of each column, if it is more alike than least."""
    out = {}
    for c in columns:
        score, best = max(((SequenceMatcher(None, c.lower(), t.lower()).ratio(), t) for t in targets), default=(0, ""))
        if score > least:
            out[c] = best
    return out


def match_feature_attributes(columns: list[str], fields: list[str]) -> dict[str, str]:
    """First column of each field by name, whatever its case; dir and dip_dir exclude each other."""
    out: dict[str, str] = {}
    for f in fields:
        c = next((c for c in columns if c.lower() == f.lower() and c not in out.values()), None)
        if c and not (f == "dip_dir" and "dir" in out) and not (f == "dir" and "dip_dir" in out):
            out[f] = c
    return out
