"""GeoTIFF as a Spark data source: ``spark.read.format("geotiff")`` and ``write_float32`` / ``write_rgba``.

Writing. Pixels are grouped into tiles, which are deflated where they meet. A file's tile sizes give its directories, one more row
of bytes. Rows then go to one task a file, in the order of the file, which streams them out: a file is never held in memory.
Tasks write under temporary names; the commit gives files their own.

Reading. A partition is a stretch of tiles of one file and level, or several short ones. Directories say where tiles are; a box or filters on level, row
and column leave out tiles that cannot have rows. ``what=images`` gives a row an image instead of its pixels: the catalogue that
checks of grids work on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import tiff

TILE = 512
TILES_AT_ONCE = 16  # of a read partition
PIXELS_AT_ONCE = 1 << 18  # up to which stretches of small files share one
FILES_AT_ONCE = 64  # of a read partition, where a row is an image
OVERVIEWS = (2, 4, 8)
FILES = "file, width, height, x0, y0, x1, y1, epsg"
IMAGES = "file string, level int, width int, height int, tile_width int, tile_height int, samples int, sample_type string, bounds array<double>, crs string, nodata string"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# ---- reading ---------------------------------------------------------------------------------------------------------------


@dataclass
class Tiles(InputPartition):
    path: str
    file: str
    number: int
    level: tiff.Level
    which: list[int]
    more: list[Tiles] = field(default_factory=list)  # further stretches that the same task reads


@dataclass
class Files(InputPartition):
    path: str
    files: list[str]


def _levels(at: fs.FileSystem, path: str) -> list[tiff.Level]:
    with at.open_input_file(path) as f:
        return tiff.read_levels(lambda offset, size: f.read_at(size, offset))


class Reader(DataSourceReader):
    def __init__(self, options: dict, bands: list[str]):
        self.root, self.bands = options["path"], bands
        self.images = options.get("what") == "images"
        level = options.get("level", 0)
        self.limits = {"level": {"all": [0, 99], "overviews": [1, 99]}.get(level) or [int(level)] * 2, "row": [0, 1 << 31], "col": [0, 1 << 31]}
        if "box" in options:
            r0, c0, r1, c1 = map(int, options["box"].split(","))  # of rows and columns of the level, ends included
            self.limits |= {"row": [r0, r1], "col": [c0, c1]}
        self.hard = {k: list(v) for k, v in self.limits.items()}

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        at, root = open_fs(self.root)
        info = at.get_file_info(root)
        if info.type == fs.FileType.File:
            return at, [root]
        found = at.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return at, sorted(f.path for f in found if f.is_file and f.base_name.lower().endswith((".tif", ".tiff")))

    def partitions(self):
        at, files = self._files()
        if self.images:
            return [Files(self.root, files[k : k + FILES_AT_ONCE]) for k in range(0, len(files), FILES_AT_ONCE)]
        with ThreadPoolExecutor(16) as pool:
            levels = list(pool.map(lambda f: _levels(at, f), files))
        found = []
        for file, images in zip(files, levels, strict=True):
            for number, level in enumerate(images):
                if self.limits["level"][0] <= number <= self.limits["level"][1]:
                    which = [t for t in range(len(level.offsets)) if self._meets(level, t)]
                    found += [Tiles(self.root, file, number, level, which[k : k + TILES_AT_ONCE]) for k in range(0, len(which), TILES_AT_ONCE)]
        return self._together(found)

    @staticmethod
    def _together(stretches: list[Tiles]) -> list[Tiles]:
        """Neighbours up to a number of pixels become one partition, so many small files are not as many tasks."""
        found, pixels = [], 0
        for s in stretches:
            n = len(s.which) * s.level.tile_width * s.level.tile_height
            if found and pixels + n <= PIXELS_AT_ONCE:
                found[-1].more.append(s)
                pixels += n
            else:
                found.append(s)
                pixels = n
        return found

    def _meets(self, level: tiff.Level, tile: int) -> bool:
        r, c = (tile // level.across) * level.tile_height, (tile % level.across) * level.tile_width
        (r0, r1), (c0, c1) = self.limits["row"], self.limits["col"]
        return r <= r1 and r + level.tile_height > r0 and c <= c1 and c + level.tile_width > c0

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        at, _ = open_fs(partition.path)
        if isinstance(partition, Files):
            yield from (self._images(at, f) for f in partition.files)
            return
        for stretch in [partition, *partition.more]:
            yield from self._pixels(at, stretch)

    def _images(self, at: fs.FileSystem, file: str) -> pa.RecordBatch:
        rows, name = [], file.rpartition("/")[2]
        for k, level in enumerate(_levels(at, file)):
            where = tiff.place(level)
            kind = {1: "uint", 2: "int", 3: "float"}.get(level.sample_format, "other") + str(level.bits)
            nodata = level.tags.get(tiff.NODATA)
            rows.append((name, k, level.width, level.height, level.tile_width, level.tile_height, level.samples, kind, where["bounds"], where["crs"], nodata.rstrip(b"\0 ").decode() if nodata else None))
        kinds = [pa.string(), *[pa.int32()] * 6, pa.string(), pa.list_(pa.float64()), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in IMAGES.split(", ")])

    def _pixels(self, at: fs.FileSystem, partition: Tiles) -> Iterator[pa.RecordBatch]:
        level, name = partition.level, partition.file.rpartition("/")[2]
        nodata = level.tags.get(tiff.NODATA)
        missing = float(nodata.rstrip(b"\0 ")) if nodata else None
        (r0, r1), (c0, c1) = self.hard["row"], self.hard["col"]
        with at.open_input_file(partition.file) as f:
            for t in partition.which:
                grid = tiff.decode_tile(f.read_at(level.counts[t], level.offsets[t]), level)
                top, left = (t // level.across) * level.tile_height, (t % level.across) * level.tile_width
                rows = np.arange(max(top, r0), min(top + level.tile_height, level.height, r1 + 1))
                cols = np.arange(max(left, c0), min(left + level.tile_width, level.width, c1 + 1))
                if len(rows) and len(cols):
                    values = grid[rows[0] - top : rows[-1] + 1 - top, cols[0] - left : cols[-1] + 1 - left].reshape(-1, level.samples).astype(np.float64)
                    columns = [pa.array(v, pa.float64(), mask=np.isnan(v) | (v == missing) if missing is not None else np.isnan(v)) for v in values.T[: len(self.bands)]]
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, partition.number, np.int32)), pa.array(np.repeat(rows, len(cols)).astype(np.int32)), pa.array(np.tile(cols, len(rows)).astype(np.int32)), *columns], names=["file", "level", "row", "col", *self.bands])


class PushingReader(Reader):
    def pushFilters(self, filters):  # noqa: N802
        """Comparisons with level, row and col narrow down which tiles are read; Spark still filters their rows."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.limits and isinstance(getattr(f, "value", None), int):
                low, high = self.limits[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.limits[name] = [low, high]
            yield f


# ---- writing ---------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Streams rows (file, place, payload), a file's rows together and in order, into files of these names."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, root = open_fs(self.root)
        at.create_dir(f"{root}/_temporary", recursive=True)
        found, name, out = [], None, None
        for batch in iterator:
            for file, payload in zip(batch.column("file").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if file != name:
                    if out:
                        out.close()
                    name, where = file, f"{root}/_temporary/{uuid.uuid4().hex}"
                    found.append((where, f"{root}/{file}"))
                    out = at.open_output_stream(where)
                out.write(payload)
        if out:
            out.close()
        return Written(found)

    def commit(self, messages: list[Written]) -> None:
        at, root = open_fs(self.root)
        for written, final in (f for m in messages if m for f in m.files):
            at.move(written, final)
        if at.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list[Written]) -> None:
        at, root = open_fs(self.root)
        if at.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/_temporary")


class GeoTiff(DataSource):
    """Options of a read: path (a file or a folder), bands (names, comma-separated; b1, b2, ... without), level (0 without, all, or overviews),
    box (first row, first column, last row, last column), what=images, pushdown=true (where spark.sql.python.filterPushdown.enabled is
    set: comparisons with level, row and col choose tiles)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _bands(self) -> list[str]:
        if self.options.get("bands"):
            return [b.strip() for b in self.options["bands"].split(",")]
        at, files = Reader(self.options, [])._files()
        return [f"b{k + 1}" for k in range(_levels(at, files[0])[0].samples)] if files else []

    def schema(self) -> str:
        if self.options.get("what") == "images":
            return IMAGES
        return ", ".join(["file string, level int, row int, col int", *(f"`{b}` double" for b in self._bands())])

    def reader(self, schema) -> Reader:
        kind = PushingReader if self.options.get("pushdown") == "true" else Reader  # Spark takes no reader that can push where it may not
        return kind(self.options, [f.name for f in schema.fields[4:]])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def _tiles(pixels: DataFrame, files: DataFrame, bands: list[str], levels: list[int], tile: int, rgba: bool) -> DataFrame:
    """(file, level, tile, payload) of every tile of every level; pixels that are missing are NaN, or transparent black."""
    kind, samples = ("u1", 4) if rgba else ("<f4", len(bands))
    blank = 0 if rgba else np.nan

    def encode(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("file", "level", "tile", "across", "width", "height")}
        top, left = first["tile"] // first["across"] * tile, first["tile"] % first["across"] * tile
        grid = np.zeros((tile, tile, samples), kind)
        grid[: first["height"] - top, : first["width"] - left] = blank
        r, c = table.column("row").to_numpy() - top, table.column("col").to_numpy() - left
        there = table.column("row").is_valid().to_numpy()
        for k, band in enumerate(bands):
            v = table.column(band).to_numpy().astype(np.float64)
            grid[r[there].astype(int), c[there].astype(int), k] = np.nan_to_num(v[there]) if rgba else v[there]
        return pa.table({"file": [first["file"]], "level": pa.array([first["level"]], pa.int32()), "tile": pa.array([first["tile"]], pa.int32()), "payload": pa.array([tiff.encode_tile(grid)], pa.binary())})

    def tiled(n):
        return F.ceil(n / F.lit(tile)).cast("int")

    image = files.select("file", F.posexplode(F.array(*map(F.lit, levels))).alias("level", "scale"), "width", "height")
    image = image.filter((F.col("scale") == 1) | ((F.col("width") / F.col("scale") >= tile) & (F.col("height") / F.col("scale") >= tile)))
    image = image.select("file", "level", F.floor(F.col("width") / F.col("scale")).cast("int").alias("width"), F.floor(F.col("height") / F.col("scale")).cast("int").alias("height")).withColumn("across", tiled(F.col("width")))
    every = image.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("across") * tiled(F.col("height")) - 1)))
    placed = pixels.join(image.select("file", "level", F.col("across").alias("_across")), ["file", "level"])
    placed = placed.select("file", "level", (F.floor(F.col("row") / tile) * F.col("_across") + F.floor(F.col("col") / tile)).cast("int").alias("tile"), "row", "col", *(F.col(b).cast("double").alias(b) for b in bands))
    return every.join(placed, ["file", "level", "tile"], "left").groupBy("file", "level", "tile").applyInArrow(encode, "file string, level int, tile int, payload binary")


def _save(tiles: DataFrame, files: DataFrame, path: str, samples: int, tile: int, rgba: bool) -> None:
    spark = tiles.sparkSession
    register(spark)
    encoded = tiles.cache()  # sizes and bytes come from one encoding; what is lost is encoded again alike

    def lead(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["level"], r["tile"]))
        first, levels = rows[0], []
        for r in rows:
            if r["level"] == len(levels):
                s = ([1, *OVERVIEWS] if rgba else [1])[r["level"]]
                levels.append({"width": first["width"] // s, "height": first["height"] // s, "counts": []})
            levels[-1]["counts"].append(r["size"])
        data = tiff.head(levels, tile, samples, rgba, tuple(first[k] for k in ("x0", "y0", "x1", "y1")), first["epsg"])
        return pa.table({"file": [first["file"]], "level": pa.array([-1], pa.int32()), "tile": pa.array([0], pa.int32()), "payload": pa.array([data], pa.binary())})

    sizes = encoded.select("file", "level", "tile", F.octet_length("payload").alias("size")).join(files, "file")
    heads = sizes.groupBy("file").applyInArrow(lead, "file string, level int, tile int, payload binary")  # a number a tile
    rows = heads.unionByName(encoded).repartition("file").sortWithinPartitions("file", "level", "tile").select("file", "payload")
    try:
        rows.write.format("geotiff").mode("append").save(path)
    finally:
        encoded.unpersist()


def write_float32(pixels: DataFrame, files: DataFrame, path: str, bands: list[str], tile: int = TILE) -> None:
    """A file of 32-bit floats for each row of ``files`` (file, width, height, x0, y0, x1, y1, epsg), its bands interleaved by pixel.

    ``pixels``: file, row, col, bands; of pixels that are given twice one counts. Pixels outside, or of files that are not listed,
    are not written. Pixels that are missing or null are NaN, which the file declares as no data.
    """
    inside = pixels.join(files.select("file", "width", "height"), "file").filter("row >= 0 and col >= 0 and row < height and col < width")
    placed = inside.select("file", F.lit(0).alias("level"), "row", "col", *bands)
    _save(_tiles(placed, files, bands, [1], tile, False), files, path, len(bands), tile, False)


def overviews(pixels: DataFrame, files: DataFrame, limits: dict[str, tuple[float, float]] | None, tile: int = TILE) -> DataFrame:
    """RGBA pixels (file, row, col, r, g, b, a) with those of the levels 2, 4 and 8 times smaller, while a side has ``tile`` pixels.

    Colours are averaged as powers between the decibel limits of their channel, alpha as it is; missing pixels count as zeros.
    """
    levels = F.array(*(F.struct(F.lit(k + 1).alias("level"), F.lit(s).alias("s")) for k, s in enumerate(OVERVIEWS)))
    sized = pixels.join(files.select("file", "width", "height"), "file").filter("row >= 0 and col >= 0 and row < height and col < width")
    down = sized.withColumn("o", F.explode(levels)).filter((F.col("width") / F.col("o.s") >= tile) & (F.col("height") / F.col("o.s") >= tile))
    at = {c: F.floor(F.col(c) / F.col("o.s")).cast("int") for c in ("row", "col")}
    down = down.filter((at["row"] < F.floor(F.col("height") / F.col("o.s"))) & (at["col"] < F.floor(F.col("width") / F.col("o.s"))))
    rounded = lambda x: F.floor(x + 0.5)
    total = F.col("s") * F.col("s")

    def mean(channel: str):
        if channel == "a" or not limits:
            return lambda: F.sum(channel), lambda c: rounded(c / total)
        low, high = map(float, limits[channel])
        power = lambda byte: F.pow(F.lit(10.0), (byte / 255.0 * (high - low) + low) / 10)
        db = lambda c: 10 * F.log10(F.greatest((c + (total - F.col("n")) * power(F.lit(0.0))) / total, F.lit(1e-10)))
        return lambda: F.sum(power(F.col(channel))), lambda c: rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db(c) - low) / (high - low))) * 255)

    both = {c: mean(c) for c in "rgba"}
    found = down.groupBy("file", F.col("o.level").alias("level"), F.col("o.s").alias("s"), at["row"].alias("row"), at["col"].alias("col")).agg(F.count("*").alias("n"), *(both[c][0]().alias(c) for c in "rgba"))
    found = found.select("file", "level", "row", "col", *(both[c][1](F.col(c)).cast("int").alias(c) for c in "rgba"))
    return sized.select("file", F.lit(0).alias("level"), "row", "col", *(F.col(c).cast("int").alias(c) for c in "rgba")).unionByName(found)


def write_rgba(pixels: DataFrame, files: DataFrame, path: str, limits: dict[str, tuple[float, float]] | None = None, tile: int = TILE) -> None:
    """A file of RGBA bytes with overviews for each row of ``files``; ``pixels``: file, row, col, r, g, b, a."""
    levels = overviews(pixels, files, limits, tile)
    _save(_tiles(levels, files, list("rgba"), [1, *OVERVIEWS], tile, True), files, path, 4, tile, True)


# ---- grids -----------------------------------------------------------------------------------------------------------------


def describe(images: DataFrame) -> DataFrame:
    """One row a file from its images: width, height, images, bounds, crs, is_cog (tiled, with overviews), max_zoom, projected."""
    base = images.groupBy("file").agg(F.count("*").alias("images"), *(F.min_by(c, "level").alias(c) for c in ("width", "height", "bounds", "crs", "nodata")))
    zoom = F.ceil(F.log2(F.greatest("width", "height") / F.lit(256.0))).cast("int")
    return base.withColumns({"is_cog": F.col("images") > 1, "max_zoom": zoom, "projected": F.coalesce((F.abs(F.col("bounds")[0]) > 180) | (F.abs(F.col("bounds")[2]) > 180), F.lit(False))})


def check_grids(described: DataFrame, group: str, order: str, strict: bool) -> DataFrame:
    """Adds problem and text: files of a group must have the size of its first one. Another size is an error where bands are put
    together by pixel (``strict``), else a warning; bounds or a CRS that differ only warn."""
    first = described.groupBy(group).agg(F.min_by(F.struct("file", "width", "height", "bounds", "crs"), order).alias("_ref"))
    met = described.join(first, group)
    size = (F.col("width") != F.col("_ref.width")) | (F.col("height") != F.col("_ref.height"))
    drift = ~F.col("bounds").eqNullSafe(F.col("_ref.bounds")) | ~F.col("crs").eqNullSafe(F.col("_ref.crs"))
    grid = lambda a: F.concat(F.col(f"{a}width").cast("string"), F.lit("x"), F.col(f"{a}height").cast("string"))
    return met.withColumn("problem", F.when(size, "error" if strict else "warning").when(drift, "warning")).withColumn("text", F.when(size, F.concat(F.lit("grid "), grid(""), F.lit(" is not "), grid("_ref."))).when(drift, F.lit("bounds or CRS differ"))).drop("_ref")
