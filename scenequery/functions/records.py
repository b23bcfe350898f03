"""Catalogue records: assets, features, granule metadata, listings, georeference, model texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Asset keys in the order in which they are looked for.
ASSET_KEYS = ("data", "hdf5", "h5", "gcov", "nisar", "visual", "image", "cog", "data", "B0", "vv", "vh", "hh", "hv", "default")

UMM = """struct<GranuleUR: string, TemporalExtent: struct<RangeDateTime: struct<BeginningDateTime: string>>, RelatedUrls: array<struct<URL: string, Type: string>>,
  SpatialExtent: struct<HorizontalSpatialDomain: struct<Geometry: struct<GPolygons: array<struct<Boundary: struct<Points: array<struct<Longitude: double, Latitude: double>>>>>,
    BoundingRectangles: array<struct<WestBoundingCoordinate: double, SouthBoundingCoordinate: double, EastBoundingCoordinate: double, NorthBoundingCoordinate: double>>>>>>"""


def asset_type(key: Column, href: Column, media: Column, roles: Column) -> Column:
    """hdf5 or cog by media type, extension or key, of loadable assets; null for others."""
    href, media = F.coalesce(href, F.lit("")), F.coalesce(media, F.lit(""))
    hdf5 = media.contains("hdf") | href.rlike(r"(?i)\.(h5|hdf5|he5|nc)(\?|$)") | F.lower(key).contains("hdf5") | F.lower(key).contains("gcov")
    cog = media.contains("tiff") | href.rlike(r"(?i)\.(tif|tiff|geotiff)(\?|$)")
    return F.when(hdf5, "hdf5").when(cog, "cog")


def resolve_asset(assets: Column) -> Column:
    """The asset to load from an array of (key, href, type, title, roles) in the item's order: known keys first, then any; null if none."""
    typed = F.filter(F.transform(assets, lambda a: F.struct(a["href"].alias("url"), asset_type(a["key"], a["href"], a["type"], a["roles"]).alias("type"), a["key"].alias("key"), F.coalesce(F.nullif(a["title"], F.lit("")), a["key"]).alias("title"))), lambda a: a["type"].isNotNull())
    place = lambda a: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ASSET_KEYS)), a["key"]), F.lit(0)), F.lit(99))
    ranked = F.array_sort(F.transform(typed, lambda a, i: F.struct(place(a).alias("place"), i.alias("i"), a.alias("asset"))))
    return F.when(F.size(ranked) > 0, F.element_at(ranked, 1)["asset"])


def safe_json(text: Column) -> Column:
    """A JSON text in its compact form; what does not parse comes back as it was."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def with_datetime(properties: Column, datetime: Column) -> Column:
    """A map of properties that has a datetime: its own, or the row's."""
    missing = datetime.isNotNull() & F.coalesce(F.element_at(properties, "datetime"), F.lit("")).isin("")
    own = F.map_filter(properties, lambda k, v: k != "datetime")
    return F.when(missing, F.map_concat(own, F.create_map(F.lit("datetime"), datetime))).otherwise(properties)


def umm_ring(umm: Column) -> Column:
    """The footprint of a granule record: its polygon, closed, before its rectangle; null if it has neither."""
    shape = umm["SpatialExtent"]["HorizontalSpatialDomain"]["Geometry"]
    points = F.transform(F.get(shape["GPolygons"], F.lit(0))["Boundary"]["Points"], lambda p: F.struct(p["Longitude"].alias("x"), p["Latitude"].alias("y")))
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    b = F.get(shape["BoundingRectangles"], F.lit(0))
    w, s, e, n = (b[f"{side}BoundingCoordinate"] for side in ("West", "South", "East", "North"))
    box = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))))
    return F.when(F.size(points) > 0, closed).when(b.isNotNull(), box)


def umm_details(item: Column) -> Column:
    """A struct (id, concept, collection, datetime, browse, size) of a granule record, a VARIANT with members meta and umm.

    The date is the beginning of a range, else a single date, given as such or as a member; the first browse link and size count.
    """
    get = lambda path, kind="string": F.try_variant_get(item, path, kind)
    date = F.coalesce(get("$.umm.TemporalExtent.RangeDateTime.BeginningDateTime"), get("$.umm.TemporalExtent.SingleDateTime.Date"), F.when(F.schema_of_variant(get("$.umm.TemporalExtent.SingleDateTime", "variant")) == "STRING", get("$.umm.TemporalExtent.SingleDateTime")))
    shown = F.filter(get("$.umm.RelatedUrls", "array<struct<Type: string, URL: string>>"), lambda u: u["Type"] == "GET RELATED VISUALIZATION")
    concept = get("$.meta['concept-id']")
    return F.struct(F.coalesce(get("$.umm.GranuleUR"), concept, F.lit("")).alias("id"), concept.alias("concept"), get("$.meta['collection-concept-id']").alias("collection"), date.alias("datetime"), F.get(shown, 0)["URL"].alias("browse"), get("$.umm.DataGranule.ArchiveAndDistributionInformation[0].SizeInBytes", "long").alias("size"))


def data_url(urls: Column) -> Column:
    """The first data link that ends in .h5, else the first data link, else null."""
    data = F.filter(urls, lambda u: u["Type"] == "GET DATA")
    best = F.filter(data, lambda u: u["URL"].endswith(".h5"))
    return F.coalesce(F.get(best, F.lit(0))["URL"], F.get(data, F.lit(0))["URL"])


def split_name(name: Column, mission: str) -> dict[str, Column]:
    """product, track, direction, frame and polarization of a granule name by its parts; all null with fewer than twelve."""
    parts = F.split(name, "_")
    fits = (F.size(parts) >= 12) & (F.element_at(parts, 1) == mission)
    part = lambda k: F.when(fits, F.get(parts, F.lit(k)))
    whole = lambda k: F.nullif(F.regexp_extract(part(k), r"^\s*([0-9]+)", 1), F.lit("")).cast("int")
    return {"product": part(3), "track": whole(5), "direction": part(6), "frame": whole(7), "polarization": part(9)}


def bucket_entries(xml: Column, prefix: Column) -> Column:
    """Entries of an object listing, an array of (key, directory, size): common prefixes, then objects, without the prefix itself and empty directory markers."""
    folders = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<CommonPrefixes>.*?</CommonPrefixes>"), F.lit(0)), lambda b: F.struct(F.xpath_string(b, F.lit("CommonPrefixes/Prefix")).alias("key"), F.lit(True).alias("directory"), F.lit(0).cast("long").alias("size")))
    files = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<Contents>.*?</Contents>"), F.lit(0)), lambda b: F.struct(F.xpath_string(b, F.lit("Contents/Key")).alias("key"), F.lit(False).alias("directory"), F.coalesce(F.xpath_string(b, F.lit("Contents/Size")).try_cast("long"), F.lit(0).cast("long")).alias("size")))
    return F.concat(F.filter(folders, lambda e: e["key"] != ""), F.filter(files, lambda e: (e["key"] != prefix) & ~(e["key"].endswith("/") & (e["size"] == 0))))


def georeference(width: Column, height: Column, transformation: Column, tiepoint: Column, scale: Column) -> Column:
    """Bounds (x0, y0, x1, y1) of a raster from its 16 transformation values, else its first tiepoint and pixel scale; sides in
    the wrong order are swapped; null where there is neither."""
    t, p, s = (lambda k: F.get(transformation, F.lit(k))), (lambda k: F.get(tiepoint, F.lit(k))), (lambda k: F.get(scale, F.lit(k)))
    by_matrix = (t(3), t(7) + height * t(5), t(3) + width * t(0), t(7))
    by_point = (p(3) - p(0) * s(0), p(4) - (height - p(1)) * s(1), p(3) + (width - p(0)) * s(0), p(4) + p(1) * s(1))
    box = lambda b: F.struct(*(f(b[i], b[j]).alias(n) for f, i, j, n in ((F.least, 0, 2, "x0"), (F.least, 1, 3, "y0"), (F.greatest, 0, 2, "x1"), (F.greatest, 1, 3, "y1"))))
    return F.when(F.size(transformation) == 16, box(by_matrix)).when((F.size(tiepoint) >= 6) & (F.size(scale) >= 2), box(by_point))


def class_names(xml: Column) -> Column:
    """Map of class number to label from metadata items: CATEGORY_NAMES_3 and the like, sample="3" of a category, or one list."""
    attribute = lambda a, n: F.regexp_extract(a, f'(?i)\\b{n}\\s*=\\s*"([^"]*)"', 1)
    from .names import xml_text

    pattern = r"(?is)<Item\b([^>]*)>(.*?)</Item>"
    items = F.transform(F.regexp_extract_all(xml, F.lit(pattern), F.lit(0)), lambda i: F.struct(F.regexp_extract(i, pattern, 1).alias("a"), F.trim(F.regexp_extract(i, pattern, 2)).alias("text")))
    items = F.transform(items, lambda i: F.struct(attribute(i["a"], "name").alias("name"), F.lower(attribute(i["a"], "role")).alias("role"), F.regexp_extract(i["a"], r'(?i)\bsample\s*=\s*"(\d+)"', 1).alias("sample"), i["text"].alias("text")))
    items = F.filter(items, lambda i: (i["text"] != "") & (i["role"] != "description"))
    one = lambda n, text: F.array(F.struct(n.cast("int").alias("k"), xml_text(text).alias("label")))
    suffix = lambda i: F.regexp_extract(i["name"], r"_(\d+)\s*$", 1)
    listed = lambda i: F.filter(F.transform(F.split(i["text"], r"\s*[,;|]\s*"), lambda x, k: F.struct(k.cast("int").alias("k"), xml_text(x).alias("label"))), lambda x: x["label"] != "")
    found = F.transform(
        items,
        lambda i: F.when(i["name"].rlike("(?i)^(CATEGORY_NAMES?|CLASS(_NAMES?)?)") & (suffix(i) != ""), one(suffix(i), i["text"]))
        .when((i["sample"] != "") & ((i["role"] == "category") | i["name"].rlike("(?i)(CATEGORY|CLASS)[_ ]?NAMES?")), one(i["sample"], i["text"]))
        .when(i["name"].rlike("(?i)^(CLASS_NAMES?|CATEGORY_NAMES?)$") & i["text"].rlike("[,;|]"), listed(i))
        .otherwise(F.expr("CAST(array() AS array<struct<k: int, label: string>>)")),
    )
    pairs = F.flatten(found)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def colour_table(values: Column) -> Column:
    """Up to 256 colours (r, g, b) of a palette stored as all reds, all greens, all blues, of 16 bits if any exceeds 255; null if it has fewer than two."""
    n = F.floor(F.size(values) / 3).cast("int")
    scale = F.when(F.array_max(values) > 255, 255 / 65535).otherwise(1.0)
    at = lambda k: F.floor(F.element_at(values, k.cast("int")) * scale + 0.5).cast("int")
    colours = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(256))), lambda i: F.struct(at(i).alias("r"), at(n + i).alias("g"), at(2 * n + i).alias("b")))
    return F.when(n >= 2, colours)
