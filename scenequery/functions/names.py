"""Parsing of product names, links, listings and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the letters of a polarization code stand for.
POLARIZATIONS = {"SH": "single HH", "SV": "single VV", "DH": "dual HH/HV", "DV": "dual VV/VH", "QP": "quad", "CL": "compact left", "CR": "compact right", "NA": "none"}

#: The fields of a product name, in order, with the pattern of each; numbers are read as such.
FIELDS = (
    ("mission", "[A-Z]+"), ("instrument", "[LS]"), ("level", "\\d"), ("processing", "[A-Z]{2}"), ("product", "[A-Z]{4}"), ("cycle", "\\d{3}"), ("track", "\\d{3}"),
    ("direction", "[AD]"), ("frame", "\\d{3}"), ("mode", "\\d{4}"), ("pol", "[A-Z]{4}"), ("source", "[AM]"), ("start", "\\d{8}T\\d{6}"), ("end", "\\d{8}T\\d{6}"),
    ("crid", "[A-Z]\\d{5}"), ("accuracy", "[PMNF]"), ("coverage", "[FP]"), ("location", "[A-Z]"), ("counter", "\\d{3}"),
)
NUMBERS = ("level", "cycle", "track", "frame", "counter")
PATTERN = "^" + "_".join(f"({p})" for _, p in FIELDS).replace("([LS])_(", "([LS])(") + "\\.(.+)$"


def parse_product(name: Column) -> dict[str, Column]:
    """The fields of a product name, whose path does not count, and its extension; all null if it has another form."""
    base = F.regexp_replace(name, r"^.*[\\/]", "")
    parts = F.when(base.rlike(PATTERN), F.split(F.substring_index(base, ".", 1), "_"))  # the form is checked once, then underscores tell fields apart
    at = {f: i - (i > 1) for i, (f, _) in enumerate(FIELDS)}  # instrument and level share a part
    found = {f: F.get(parts, at[f]) for f, _ in FIELDS}
    found |= {"instrument": F.substring(found["instrument"], 1, 1), "level": F.substring(found["level"], 2, 1)}
    found["extension"] = F.when(parts.isNotNull(), F.substr(base, F.instr(base, ".") + 1))
    return {f: c.cast("int") if f in NUMBERS else c for f, c in found.items()}


def name_time(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss"))


def polarization_label(code: Column) -> Column:
    """Labels of both halves of a four-letter code, joined."""
    table = F.create_map(*[F.lit(x) for kv in POLARIZATIONS.items() for x in kv])
    half = lambda a: F.element_at(table, F.substring(code, a, 2))
    return F.concat_ws(" + ", half(1), F.when(half(3) != "none", half(3)))


def format_of(name: Column) -> Column:
    lower = F.lower(name)
    return F.when(lower.rlike("\\.(h5|hdf5|he5)$"), "hdf5").when(lower.rlike("\\.tiff?$"), "geotiff").when(lower.rlike("\\.(nitf|ntf)$"), "nitf").otherwise("other")


#: What stands for a band in a file's name, between separators, and the band's name; the first that fits counts.
BANDS = (
    ("VV", "VV"), ("VH", "VH"), ("HH", "HH"), ("HV", "HV"), ("pre", "pre"), ("post", "post"), ("during", "during"), ("before", "before"), ("after", "after"),
    ("coh", "coherence"), ("phase", "phase"), ("amp", "amplitude"), ("int", "intensity"),
)


def band_of(url: Column, place: Column) -> Column:
    """The band that a file's URL names, or band_ and its place in the list, from 1."""
    found = F.concat(F.lit("band_"), place.cast("string"))
    for part, band in reversed(BANDS):
        found = F.when(url.rlike(f"(?i)[_-]{part}[_.-]"), band).otherwise(found)
    return found


_ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>.*?</a\s*>([^<]*)"""


def links(html: Column, base: Column, prefix: Column) -> Column:
    """Entries of a directory listing, an array of (key, directory, size), from its anchors in order.

    Left out are empty links, the parent, the root, queries, fragments, and absolute links beyond ``base``. Names are decoded
    and follow ``prefix``; a name that ends in a slash is a directory. The size stands at the end of the text that follows.
    """
    found = F.transform(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0)), lambda a: F.split(F.regexp_replace(a, _ANCHOR, "$1$2$3\u0001$4"), "\u0001"))  # both parts in one match
    anchors = F.transform(found, lambda p: F.struct(xml_text(F.get(p, 0)).alias("href"), F.get(p, 1).alias("text")))
    kept = F.filter(anchors, lambda a: ~a["href"].isin("", "../", "/") & ~a["href"].rlike("^[?#]") & ~(a["href"].startswith("http") & ~a["href"].startswith(base)))
    name = lambda a: F.coalesce(F.try_url_decode(F.replace(a["href"], F.lit("+"), F.lit("%2B"))), a["href"])
    return F.transform(kept, lambda a: F.struct(F.concat(prefix, name(a)).alias("key"), name(a).endswith("/").alias("directory"), F.when(name(a).endswith("/"), 0).otherwise(listed_bytes(a["text"])).cast("long").alias("size")))


def listed_bytes(text: Column) -> Column:
    """The size at the end of a listing's line, such as 1.5K or 20 MB, in bytes; 0 where there is none."""
    form = r"(?i)([0-9]+(?:[.][0-9]+)?)\s*([KMGT]?B?)\s*$"
    number = F.coalesce(F.regexp_extract(text, form, 1).try_cast("double"), F.lit(0.0))
    unit = F.upper(F.substring(F.regexp_extract(text, form, 2), 1, 1))
    return number * F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)


def size_text(n: Column) -> Column:
    """Bytes as text: a dash for none, whole KB, MB with one decimal, GB with two; halves are rounded up, exactly."""
    tenths, hundredths = F.floor((n * 20 + 2**20) / F.lit(2**21)), F.floor((n * 200 + 2**30) / F.lit(2**31))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    found = F.when(n < 1024, text(n, " B")).when(n < 1024**2, text(F.floor((n * 2 + 1024) / F.lit(2048)), " KB")).when(n < 1024**3, text(F.floor(tenths / 10), ".", F.pmod(tenths, F.lit(10)), " MB"))
    return F.when(n.isNull() | (n == 0), "—").otherwise(found.otherwise(text(F.floor(hundredths / 100), ".", F.lpad(F.pmod(hundredths, F.lit(100)).cast("string"), 2, "0"), " GB")))


def bytes_of(text: Column) -> Column:
    """A listing's size such as 1.5K, 20M: bytes, null where it is none."""
    number = F.regexp_extract(text, r"^([\d.]+)\s*([KMGT]?)$", 1).try_cast("double")
    factor = F.create_map(*[F.lit(x) for kv in {"": 1, "K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4}.items() for x in kv])
    return (number * F.element_at(factor, F.regexp_extract(text, r"^([\d.]+)\s*([KMGT]?)$", 2))).cast("long")


def s3_parts(uri: Column) -> tuple[Column, Column]:
    return F.nullif(F.regexp_extract(uri, "^s3://([^/]+)/?(.*)$", 1), F.lit("")), F.nullif(F.regexp_extract(uri, "^s3://([^/]+)/?(.*)$", 2), F.lit(""))


def xml_text(text: Column) -> Column:
    """Entities back to characters, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def day_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Dates without a time of day stand for the whole day."""
    whole = lambda c, t: F.when(F.length(c) == 10, F.concat(c, F.lit(t))).otherwise(c)
    return whole(start, "T00:00:00Z"), whole(end, "T23:59:59Z")
