"""Depth images: validity, statistics, resizing, geometry.

An image is an array column, row by row; missing pixels are null. What concerns
one image is worked out in place, by array functions or by numpy over Arrow
batches; only statistics across images take pixels apart, by pixels().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Images that are worked on at a time.
IMAGES = 16


def pixels(frames: DataFrame, image: str, width: int) -> DataFrame:
    """A row per pixel: other columns, px, u, v, d. For statistics across images."""
    rest = [c for c in frames.columns if c != image]
    d = frames.select(*rest, F.posexplode(image).alias("px", "d"))
    return d.withColumn("u", F.col("px") % width).withColumn("v", F.floor(F.col("px") / width).cast("int"))


def each_image(frames: DataFrame, image: str, width: int, outputs: str, work: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """frames with outputs (a schema) in place of image: the rows that work gives for each image, with NaN for missing pixels.

    An output that is an array comes as a numpy array, NaN for null; one of structs
    as a table of theirs. Rows stay in their partitions; a null image gives none.
    Columns of frames that bear an output's name are replaced.
    """
    extra = frames.sparkSession.createDataFrame([], outputs).schema
    gone = {image.lower(), *(f.name.lower() for f in extra)}
    rest = [c for c in frames.columns if c.lower() not in gone]
    d = frames.select(*rest, F.col(image).cast("array<double>").alias("_image"))
    schema = d.drop("_image").schema
    for field in extra:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), IMAGES):
                part = batch.slice(lo, IMAGES)
                of, rows = [], []
                for k, values in enumerate(part.column(len(rest))):
                    if values.is_valid:
                        made = work(values.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
                        of += [k] * len(made)
                        rows += made
                take = pa.array(of, pa.int64())
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(extra)
                arrays = [part.column(k).take(take) for k in range(len(rest))]
                arrays += [column_of(c, f.dataType.simpleString()) for c, f in zip(columns, extra, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return d.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(n, _arrow(k)) for n, k in (f.split(":") for f in kind[7:-1].split(","))])
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind]


def column_of(values: Sequence, kind: str) -> pa.Array:
    """An Arrow column of values: numbers, or a numpy array or None per row for arrays."""
    if not kind.startswith("array<"):
        return pa.array(values, _arrow(kind), from_pandas=True)
    inner = _arrow(kind[6:-1])
    offsets = np.append(0, np.cumsum([0 if v is None else len(v) for v in values]))
    held = [v for v in values if v is not None and len(v)]
    if pa.types.is_struct(inner):
        flat = np.concatenate(held) if held else np.zeros((0, inner.num_fields))
        items = pa.StructArray.from_arrays([pa.array(flat[:, k], from_pandas=True).cast(inner.field(k).type) for k in range(inner.num_fields)], fields=list(inner))
    else:
        items = pa.array(np.concatenate(held) if held else np.zeros(0), from_pandas=True).cast(inner)
    mask = pa.array([v is None for v in values], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=mask)


def metric(image: Column, scale: float) -> Column:
    """Raw units in metres; 0 is no measurement."""
    return F.transform(image, lambda x: F.when(x > 0, x * scale))


def clipped(x: Column, low: float, high: float) -> Column:
    """x limited to a range; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def in_band(image: Column, low: float, high: float) -> Column:
    """image without depths outside of [low, high], both ends included."""
    return F.transform(image, lambda x: F.when(x.between(low, high), x))


def in_box(image: Column, width: int, x: Column | int, y: Column | int, side: Column | int) -> Column:
    """image of the same shape, null outside of the square."""
    x, y, side = (F.lit(v) if isinstance(v, int) else v for v in (x, y, side))
    row = lambda i: F.floor(i / width)
    inside = lambda i: (i % width >= x) & (i % width < x + side) & (row(i) >= y) & (row(i) < y + side)
    return F.transform(image, lambda v, i: F.when(inside(i), v))


def crop(image: Column, width: int, x: int, y: int, side: int) -> Column:
    """The square of image as an image of its own."""
    return F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + side - 1)), lambda r: F.slice(image, r * width + x + 1, F.lit(side))))


def decimated(image: Column, width: int, height: int, step: int) -> Column:
    """Every step-th pixel of every step-th row, as an image of its own; deproject() takes the same step."""
    pick = F.sequence(F.lit(0), F.lit(width * height - 1))
    pick = F.filter(pick, lambda i: (i % width % step == 0) & (F.floor(i / width) % step == 0))
    return F.transform(pick, lambda i: F.element_at(image, i.cast("int") + 1))


def frame_stats(frames: DataFrame, image: str, clip: float) -> DataFrame:
    """frames with valid_frac, rail_frac, std and median of each image; without valid pixels 0, 1, 0 and null."""

    def work(a: np.ndarray) -> list[tuple]:
        v = a[np.isfinite(a)]
        if not v.size:
            return [(0.0, 1.0, 0.0, None)]
        return [(v.size / a.size, float((np.abs(v) >= clip - 1e-3).mean()), float(v.std()), float(np.median(v)))]

    return each_image(frames, image, 1, "valid_frac double, rail_frac double, std double, median double", work)


def stable_pixels(px: DataFrame, near: float, far: float, share: float = 0.5) -> DataFrame:
    """The pixels that are strictly inside the band in at least share of the frames."""
    inside = F.coalesce((F.col("d") > near) & (F.col("d") < far), F.lit(False))
    return px.groupBy("px").agg(F.avg(inside.cast("double")).alias("share")).where(F.col("share") >= share)


def pixel_median(px: DataFrame, *keys: str) -> DataFrame:
    """(keys, px, d): the median of each pixel's samples across images."""
    return px.groupBy(*keys, "px").agg(F.median("d").alias("d"))


def temporal_std(px: DataFrame, key: str) -> DataFrame:
    """(key, std): the median over pixels of the population deviation over images."""
    return px.groupBy(key, "px").agg(F.stddev_pop("d").alias("s")).groupBy(key).agg(F.median("s").alias("std"))


def deform(frame: Column, reference: Column, scale: float) -> Column:
    """struct(depth, mask) arrays: frame minus reference, null where either is; clipped last, 0 where masked."""
    moved = F.zip_with(frame, reference, lambda a, b: a - b)
    mask = F.transform(moved, lambda x: x.isNotNull().cast("double"))
    return F.struct(F.transform(moved, lambda x: F.coalesce(clipped(x / scale, -1.0, 1.0), F.lit(0.0))).alias("depth"), mask.alias("mask"))


def footprint_coverage(frame: Column, reference: Column) -> Column:
    """The share of the pixels that reference has which frame has too; 0 without any."""
    both = F.zip_with(frame, reference, lambda a, b: F.when(b.isNotNull(), a.isNotNull().cast("double")))
    face = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(face) > 0, F.aggregate(face, F.lit(0.0), lambda s, x: s + x) / F.size(face)).otherwise(0.0)


def overlaps(n_in: int, n_out: int) -> np.ndarray:
    """The share of each of n_out equal cells that each of n_in pixels covers."""
    width = n_in / n_out
    low = np.arange(n_out)[:, None] * width
    high = np.arange(1, n_out + 1)[:, None] * width
    pixel = np.arange(n_in)[None, :]
    return np.clip(np.minimum(high, pixel + 1) - np.maximum(low, pixel), 0, None) / width


def _held(n_in: int, n_out: int) -> list[np.ndarray]:
    """Along one side, for each cell (a row) its pixels, their shares, how many cells after and before it hold them, and how many do in all."""
    share = overlaps(n_in, n_out)
    held = share > 0
    most = max(1, held.sum(axis=1).max(initial=0))
    pixel = np.argsort(~held, axis=1, kind="stable")[:, :most]
    upto, n = held.cumsum(axis=0), held.sum(axis=0)
    return [pixel, *(np.take_along_axis(x, pixel, axis=1) for x in (share, n - upto, upto - held, np.broadcast_to(n, held.shape)))]


@lru_cache(maxsize=8)
def cell_pixels(h: int, w: int, size: int, tile: int | None = None, top: int = 0, left: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each cell (a column) of a grid of size x size its pixels of an image and their shares, in the order of summing.

    A cut pixel has several cells, and gives to the lower and then to the left ones first.
    A cell takes the pixels that give to it first, those that give to it second, and so on,
    each row by row, or tile by tile where tile is a side; top and left are the image's place
    in the tiled frame. So the joins of the queries' SQL hand them on, too: where a float
    stands at a border of rounding, it falls on the same side.
    """
    tile = tile or max(h, w) + max(top, left)
    row, down, below, _, _ = (x[:, None, :, None] for x in _held(h, size))
    column, across, _, before, n = (x[None, :, None, :] for x in _held(w, size))
    key = ((below * n + before) * (h + top) + (row + top) // tile) * (w + left) + (column + left) // tile
    order = np.argsort(key.reshape(size * size, -1), axis=1, kind="stable")
    pixel, share = (x.reshape(size * size, -1) for x in (row * w + column, down * across))
    return tuple(np.ascontiguousarray(np.take_along_axis(x, order, axis=1).T) for x in (pixel, share))


def masked_resize(values: np.ndarray, valid: np.ndarray, size: int, support: float, *tiles: int) -> np.ndarray:
    """Area averages of the valid pixels on a grid of size x size; NaN where their share is support or less.

    Cells that cut pixels take their share of them, in both directions of scaling. For tiles see cell_pixels().
    """
    flat, inside = np.where(valid, values, 0.0).ravel(), valid.ravel().astype(float)
    total, share = np.zeros(size * size), np.zeros(size * size)
    for pixel, part in zip(*cell_pixels(*values.shape, size, *tiles), strict=True):
        total += flat[pixel] * part
        share += inside[pixel] * part
    good = share > support
    return np.where(good, total / np.where(good, share, 1), np.nan).reshape(size, size)


def resized(frames: DataFrame, image: str, width: int, size: int, support: float) -> DataFrame:
    """frames with image as size x size area averages of the valid pixels; null where their share is support or less."""
    d = each_image(frames, image, width, "_cells array<double>", lambda a: [(masked_resize(a, np.isfinite(a), size, support).ravel(),)])
    return d.withColumnRenamed("_cells", image)


def deproject(image: Column, width: int, fx: float, fy: float, cx: float, cy: float, scale: float = 1.0, step: int = 1) -> Column:
    """array<struct<x, y, z>> of a pinhole camera, scaled; null where the depth is missing, 0 or less.

    step is that of decimated(): the points are those of the sensor's own pixels.
    """

    def point(d: Column, i: Column) -> Column:
        x = (i % width * step - cx) * d / fx * scale
        y = (F.floor(i / width) * step - cy) * d / fy * scale
        return F.when(d > 0, F.struct(x.alias("x"), y.alias("y"), (d * scale).alias("z")))

    return F.transform(image, point)


def mesh_arrays(image: np.ndarray, fx: float, fy: float, cx: float, cy: float, max_edge: float, scale: float = 1.0, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, faces and normals of one image; see meshes()."""
    h, w = image.shape
    z = np.where(image > 0, image, np.nan)
    points = np.stack([(np.arange(w)[None, :] * step - cx) * z / fx, (np.arange(h)[:, None] * step - cy) * z / fy, z], axis=-1) * scale
    valid = np.isfinite(z)
    number = np.where(valid, np.cumsum(valid).reshape(h, w) - 1, -1)
    corners = {"tl": np.s_[:-1, :-1], "tr": np.s_[:-1, 1:], "bl": np.s_[1:, :-1], "br": np.s_[1:, 1:]}
    faces = []
    for names in (("tl", "tr", "bl"), ("tr", "br", "bl")):
        at = [points[corners[n]] for n in names]
        ids = np.stack([number[corners[n]] for n in names], axis=-1)
        with np.errstate(invalid="ignore"):
            short = [np.sqrt(((at[a] - at[b]) ** 2).sum(axis=-1)) < max_edge for a, b in ((0, 1), (1, 2), (0, 2))]
        faces.append(ids[short[0] & short[1] & short[2]])
    face = np.concatenate(faces) if h > 1 and w > 1 else np.zeros((0, 3), np.int64)
    vertex = points[valid]
    normal = np.zeros_like(vertex)
    if len(face):
        a, b, c = (vertex[face[:, k]] for k in range(3))
        cross = np.cross(b - a, c - a)
        for k in range(3):
            np.add.at(normal, face[:, k], cross)
    size = np.sqrt((normal**2).sum(axis=1, keepdims=True))
    normal = normal / np.where(size == 0, 1, size)
    normal[normal[:, 2] > 0] *= -1
    return vertex, face, normal


def meshes(frames: DataFrame, image: str, width: int, fx: float, fy: float, cx: float, cy: float, max_edge: float, scale: float = 1.0, step: int = 1, center: bool = False) -> DataFrame:
    """frames with vertices, faces and normals, worked out for each image in one pass.

    Vertices are the valid points, row by row; a cell of the grid gives the
    triangles (top left, top right, bottom left) and (top right, bottom right,
    bottom left) whose three edges are all shorter than max_edge, all of the first
    kind first. A normal is the sum of its faces' cross products, of length 1,
    towards the camera (z of 0 or less); a vertex without faces has zeros. With
    center, vertices are less their mean.
    """

    def work(a: np.ndarray) -> list[tuple]:
        vertex, face, normal = mesh_arrays(a, fx, fy, cx, cy, max_edge, scale, step)
        if center and len(vertex):
            vertex = vertex - vertex.mean(axis=0)
        return [(vertex, face, normal)]

    outputs = "vertices array<struct<x:double,y:double,z:double>>, faces array<struct<i0:int,i1:int,i2:int>>, normals array<struct<nx:double,ny:double,nz:double>>"
    return each_image(frames, image, width, outputs, work)


def distance_histogram(values: DataFrame, low: float, high: float, bins: int, least: int, around: float) -> DataFrame:
    """One row (distance, share): the centre of the fullest bin, the first of equals, and the share of values within around of it.

    Only values strictly between low and high count; under `least` of them give (null, 0).
    """
    d = values.select("d").where((F.col("d") > low) & (F.col("d") < high))
    width = (high - low) / bins
    b = d.groupBy(F.least(F.floor((F.col("d") - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    best = b.agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.sum("n").alias("total"))
    best = F.broadcast(best.select(F.when(F.col("total") >= least, low + (F.col("bin") + 0.5) * width).alias("distance"), "total"))
    # best and near are one row each: aggregates without a key.
    near = d.join(best, F.abs(F.col("d") - F.col("distance")) <= around).agg(F.count("*").alias("near"))
    share = F.when(F.col("distance").isNotNull(), F.col("near") / F.col("total")).otherwise(0.0)
    return near.join(best, F.lit(True)).select("distance", share.alias("share"))


def relief(px: DataFrame, key: str, scale: float = 1000.0) -> DataFrame:
    """(key, relief): the span from the 5th to the 95th percentile of each key's pixels, interpolated."""
    p = F.percentile("d", F.array(F.lit(0.05), F.lit(0.95)))
    return px.groupBy(key).agg(p.alias("p")).select(key, ((F.col("p")[1] - F.col("p")[0]) * scale).alias("relief"))


def spread_tolerance_mm(reference: Column, explicit: float | None = None, frac: float = 0.05, floor: float = 5.0) -> Column:
    """How far a pixel's samples may spread: explicit, or frac of the reference distance, floor at least; 6 mm without one."""
    if explicit:
        return F.lit(float(explicit))
    return F.when(F.coalesce(reference, F.lit(0.0)) == 0, F.lit(max(floor, 6.0))).otherwise(F.greatest(F.lit(floor), reference * frac))


def average_depth(px: DataFrame, key: str, spread: float, least: int = 3) -> DataFrame:
    """(key, px, d, dropped): the median of each pixel's samples over 0.

    d is null if they are fewer than least or spread too far (p90 - p10); dropped
    tells whether such samples were there. See dropped_share().
    """
    p = F.percentile("d", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    d = px.withColumn("d", F.when(F.col("d") > 0, F.col("d"))).groupBy(key, "px").agg(p.alias("p"), F.count("d").alias("n"))
    steady = (F.col("n") >= least) & (F.col("p")[2] - F.col("p")[0] <= spread)
    return d.select(key, "px", F.when(steady, F.col("p")[1]).alias("d"), (F.coalesce(~steady, F.lit(True)) & (F.col("n") > 0)).alias("dropped"), (F.col("n") > 0).alias("had"))


#: Numbers of a group of strips, and pixels of a strip at most.
STRIP_CELLS, STRIP = 1 << 22, 8192


def across(frames: DataFrame, key: str, image: str, outputs: str, work: Callable[[np.ndarray], list[np.ndarray]], size: int | None = None) -> DataFrame:
    """(key, outputs): images that work makes of all images of a key, pixel by pixel.

    Images are cut into strips, and the strips of a key with the same place come
    together as one matrix, images by pixels with NaN where missing, from which
    work gives an array per output (a schema of arrays of numbers). The more
    images a key has, the narrower the strips, so a group stays bounded. Nothing
    is taken apart into rows of pixels. size is the number of pixels, else the
    longest image's; shorter images lack the rest.
    """
    extra = frames.sparkSession.createDataFrame([], outputs).schema
    names = [f.name for f in extra]
    most = frames.groupBy(key).agg(F.count("*").alias("n"), *([] if size else [F.max(F.size(image)).alias("size")])).agg(F.max("n"), *([] if size else [F.max("size")])).first()
    many, size = most[0] or 1, max(1, size or most[1] or 1)
    strip = max(1, min(STRIP, size, STRIP_CELLS // many))
    # Even strips: a short last one would be a group of its own.
    strip = -(-size // -(-size // strip))
    cut = F.transform(F.sequence(F.lit(0), F.lit(-(-size // strip) - 1)), lambda k: F.slice(image, k * strip + 1, F.lit(strip)))
    kind = frames.schema[key].dataType.simpleString()
    d = frames.where(F.col(image).isNotNull()).select(F.col(key).alias("_key"), F.posexplode(cut).alias("_strip", "_values"))

    def run(group: pa.Table) -> pa.Table:
        lists = group.column("_values").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        stack = np.full((len(sizes), int(sizes.max(initial=0))), np.nan)
        stack[np.arange(stack.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        made = [column_of([x], f.dataType.simpleString()) for x, f in zip(work(stack), extra, strict=True)]
        return pa.Table.from_arrays([group.column("_key").slice(0, 1), group.column("_strip").slice(0, 1), *made], names=["_key", "_strip", *names])

    whole = d.groupBy("_key", "_strip").applyInArrow(run, f"_key {kind}, _strip int, {outputs}").groupBy("_key")
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("_strip", *names))).alias("_all"))
    return whole.select(F.col("_key").alias(key), *[F.flatten(F.col(f"_all.`{n}`")).alias(n) for n in names])


def quantiles(stack: np.ndarray, shares: Sequence[float]) -> tuple[list[np.ndarray], np.ndarray]:
    """The interpolated quantiles of each column of images by pixels, NaN without any, and how many numbers a column has."""
    n = np.isfinite(stack).sum(axis=0)
    ordered = np.sort(stack, axis=0)  # NaN last
    columns = np.arange(stack.shape[1])
    out = []
    for share in shares:
        at = share * np.maximum(n - 1, 0)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, np.maximum(n - 1, 0))
        a, b = ordered[low, columns], ordered[high, columns]
        out.append(np.where(n > 0, a + (b - a) * (at - low), np.nan))
    return out, n


def median_images(frames: DataFrame, key: str, image: str, size: int | None = None) -> DataFrame:
    """(key, image): each pixel's median over the images of a key."""
    return across(frames, key, image, f"`{image}` array<double>", lambda stack: quantiles(stack, [0.5])[0], size)


def average_images(frames: DataFrame, key: str, image: str, spread: float, least: int = 3, scale: float = 1.0, size: int | None = None) -> DataFrame:
    """(key, image, dropped, n, share): what average_depth() and dropped_share() give, as images.

    image is the median of each pixel's samples over 0, times scale, null where they
    are fewer than least or spread too far; dropped tells for each pixel whether
    such samples were there, n counts the images that aren't null.
    """

    def work(stack: np.ndarray) -> list[np.ndarray]:
        stack = np.where(stack > 0, stack, np.nan) * scale
        (low, middle, high), n = quantiles(stack, (0.1, 0.5, 0.9))
        good = (n >= least) & (np.nan_to_num(high - low, nan=np.inf) <= spread)
        return [np.where(good, middle, np.nan), ~good & (n > 0), n > 0]

    made = across(frames, key, image, f"`{image}` array<double>, dropped array<boolean>, _had array<boolean>", work, size)
    many = lambda c: F.size(F.filter(c, lambda x: x)).cast("double")
    share = F.coalesce(many("dropped") / F.nullif(many("_had"), F.lit(0.0)), F.lit(1.0))
    counts = frames.where(F.col(image).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return made.withColumn("share", share).drop("_had").join(counts, key)


def inside_shares(frames: DataFrame, key: str, image: str, near: float, far: float) -> DataFrame:
    """(key, shares, n): for each pixel in what share of a key's n images it is strictly inside the band.

    Each task counts its own images first, so what is brought together is an image
    of counts per task and key; a task with many keys hands them on in parts.
    """
    kind = frames.schema[key].dataType.simpleString()
    d = frames.where(F.col(image).isNotNull()).select(F.col(key).alias("_key"), F.col(image).cast("array<double>").alias("_image"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def handed() -> pa.RecordBatch:
            keys = pa.array(list(held), key_type)
            made = [np.append(n, counts).astype(np.int64) for n, counts in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([keys, column_of(made, "array<bigint>")], names=["_key", "_counts"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = values.values.to_numpy(zero_copy_only=False)
                n, counts = held.get(k, (0, np.zeros(len(v), np.int64)))
                if len(counts) < len(v):
                    counts = np.append(counts, np.zeros(len(v) - len(counts), np.int64))
                counts[: len(v)] += (v > near) & (v < far)
                held[k] = n + 1, counts
                if len(held) * len(counts) > STRIP_CELLS:
                    yield handed()
        if held:
            yield handed()

    parts = d.mapInArrow(run, f"_key {kind}, _counts array<bigint>")
    total = across(parts, "_key", "_counts", "_sums array<bigint>", lambda stack: [np.nansum(stack, axis=0).astype(np.int64)])
    share = F.transform(F.slice("_sums", 2, F.size("_sums")), lambda x: x / F.col("_sums")[0])
    return total.select(F.col("_key").alias(key), share.alias("shares"), F.col("_sums")[0].alias("n"))


def dropped_share(averaged: DataFrame, key: str) -> DataFrame:
    """(key, share): of the pixels with samples, the share that average_depth() dropped; 1 without any."""
    share = F.sum(F.col("dropped").cast("double")) / F.nullif(F.sum(F.col("had").cast("double")), F.lit(0.0))
    return averaged.groupBy(key).agg(F.coalesce(share, F.lit(1.0)).alias("share"))


def relative(frames: DataFrame, image: str, reference: float, clip: float, center: bool = False) -> DataFrame:
    """frames with image relative to reference; a pixel counts if its depth is over 0 and within clip of it.

    With center, each image's own median is taken off and validity is judged again
    on the shifted values, which can bring pixels back.
    """
    if not center:
        rel = lambda x: x - reference
        return frames.withColumn(image, F.transform(F.col(image).cast("array<double>"), lambda x: F.when((x > 0) & (F.abs(rel(x)) <= clip), rel(x))))

    def work(a: np.ndarray) -> list[tuple]:
        with np.errstate(invalid="ignore"):
            rel = a - reference
            valid = (a > 0) & (np.abs(rel) <= clip)
            if valid.any():
                rel = rel - np.median(rel[valid])
                valid = (a > 0) & (np.abs(rel) <= clip)
        return [(np.where(valid, rel, np.nan).ravel(),)]

    return each_image(frames, image, 1, "_rel array<double>", work).withColumnRenamed("_rel", image)


def gradients(frames: DataFrame, image: str, width: int) -> DataFrame:
    """frames with gx and gy: central differences, one-sided at the borders; holes are filled with the image's median first.

    An image without valid pixels has no gradients: nulls.
    """

    def work(a: np.ndarray) -> list[tuple]:
        if not np.isfinite(a).any():
            return [(np.full(a.size, np.nan), np.full(a.size, np.nan))]
        full = np.where(np.isfinite(a), a, np.nanmedian(a))
        gy, gx = (np.gradient(full, axis=k) if full.shape[k] > 1 else np.zeros_like(full) for k in (0, 1))
        return [(gx.ravel(), gy.ravel())]

    return each_image(frames, image, width, "gx array<double>, gy array<double>", work)


#: The light of a shaded relief, its ambient and diffuse parts, and the colour of missing pixels.
LIGHT, AMBIENT, DIFFUSE = (-0.35, -0.55, -1.0), 0.18, 0.85


def shaded(frames: DataFrame, image: str, width: int, fx: float, fy: float, cx: float, cy: float, scale: float = 1000.0) -> DataFrame:
    """frames with shade, a brightness from 0 to 255 of each pixel of the lit surface, null where depth is missing."""
    light = np.array(LIGHT) / np.sqrt(np.square(LIGHT).sum())

    def work(a: np.ndarray) -> list[tuple]:
        z = np.where(a > 0, a, np.nan) * scale
        if not np.isfinite(z).any():
            return [(np.full(a.size, np.nan),)]
        full = np.where(np.isfinite(z), z, np.nanmedian(z))
        gy, gx = (np.gradient(full, axis=k) if full.shape[k] > 1 else np.zeros_like(full) for k in (0, 1))
        x = (np.arange(a.shape[1])[None, :] - cx) * z / fx
        y = (np.arange(a.shape[0])[:, None] - cy) * z / fy

        def pitch(p: np.ndarray, axis: int) -> float:
            steps = np.abs(np.diff(p, axis=axis))
            steps = steps[np.isfinite(steps)]
            return (float(np.median(steps)) if steps.size else 0.0) or 1.0

        normal = np.stack([-gx / pitch(x, 1), -gy / pitch(y, 0), np.ones_like(full)])
        normal /= np.sqrt((normal**2).sum(axis=0))
        lit = np.clip(-np.tensordot(light, normal, 1), 0, 1)
        shade = np.floor(np.clip(AMBIENT + DIFFUSE * lit, 0, 1) * 255)
        return [(np.where(np.isnan(z), np.nan, shade).ravel(),)]

    return each_image(frames, image, width, "shade array<int>", work)


def depth_shades(points: DataFrame, key: str, z: str = "z") -> DataFrame:
    """points with shade, 0 to 1, stretched between the 2nd and the 98th percentile of each key's z."""
    p = F.percentile(z, F.array(F.lit(0.02), F.lit(0.98))).over(Window.partitionBy(key))
    return points.withColumn("_p", p).withColumn("shade", clipped((F.col(z) - F.col("_p")[0]) / F.greatest(F.lit(1e-6), F.col("_p")[1] - F.col("_p")[0]), 0.0, 1.0)).drop("_p")


def extents(points: DataFrame, key: str) -> DataFrame:
    """(key, dx, dy, dz, x, y, z): the span and the centroid of each key's points."""
    return points.groupBy(key).agg(*[(F.max(c) - F.min(c)).alias(f"d{c}") for c in "xyz"], *[F.avg(c).alias(c) for c in "xyz"])


def centered(points: DataFrame, key: str) -> DataFrame:
    """points less their key's centroid."""
    w = Window.partitionBy(key)
    return points.withColumns({c: F.col(c) - F.avg(c).over(w) for c in "xyz"})


def centre_readout(frames: DataFrame, image: str, width: int, half: int = 4, scale: float = 1.0) -> DataFrame:
    """frames with centre: the median of the depths over 0 in the square of 2 * half + 1 pixels in the middle, scaled; null without any."""

    def work(a: np.ndarray) -> list[tuple]:
        y, x = a.shape[0] // 2, a.shape[1] // 2
        v = a[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]
        v = v[v > 0]
        return [(float(np.median(v)) * scale if v.size else None,)]

    return each_image(frames, image, width, "centre double", work)


def largest_surface(frames: DataFrame, key: str, image: str, width: int, least: int = 1) -> DataFrame:
    """(key, px): the pixels of each image's largest 8-connected part of non-null pixels, the first in row order of equals.

    An image whose largest part has fewer than `least` pixels gives none.
    """

    def work(a: np.ndarray) -> list[tuple]:
        part = largest_part(np.isfinite(a))
        return [(int(i),) for i in part] if len(part) >= least else []

    return each_image(frames.select(key, image), image, width, "px int", work)


def largest_of(image: np.ndarray, least: int = 200) -> tuple[np.ndarray, int]:
    """image with only its largest 8-connected part, and how many more parts there were; as it is, and 0, where that has fewer than `least` pixels."""
    valid = np.nan_to_num(image) > 0
    label = parts(valid)
    best = largest_part(valid, label)
    if len(best) < max(1, least):
        return image, 0
    keep = np.zeros(image.size, bool)
    keep[best] = True
    return np.where(keep.reshape(image.shape), image, np.nan), len(np.unique(label[valid])) - 1


def keep_largest_surface(frames: DataFrame, image: str, width: int, least: int = 200) -> DataFrame:
    """frames with only the largest 8-connected part of each image, and others; see largest_of()."""

    def work(a: np.ndarray) -> list[tuple]:
        kept, others = largest_of(a, least)
        return [(kept.ravel(), others)]

    return each_image(frames, image, width, "_kept array<double>, others int", work).withColumnRenamed("_kept", image)


def parts(inside: np.ndarray) -> np.ndarray:
    """For each pixel inside, a number of its 8-connected part, in row order of the parts' first pixels; -1 outside.

    Runs of a row are joined with those that they touch in the row above; least
    numbers spread and jump until nothing changes.
    """
    h, w = inside.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = inside
    step = np.diff(wide.ravel())
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # in rows of w + 2
    out = np.full(h * (w + 2), -1)
    if not len(start):
        return out.reshape(h, w + 2)[:, :w]
    low = np.searchsorted(end, start - (w + 2))
    high = np.searchsorted(start, end - (w + 2), "right")
    n = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(start)), n)
    above = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(start))
    while True:
        least = np.minimum(label[below], label[above])
        new = label.copy()
        np.minimum.at(new, below, least)
        np.minimum.at(new, above, least)
        np.minimum.at(new, label[below], least)
        np.minimum.at(new, label[above], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    of = np.repeat(label, end - start)
    at = np.arange((end - start).sum()) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + np.repeat(start, end - start)
    out[at] = np.unique(of, return_inverse=True)[1]
    return out.reshape(h, w + 2)[:, :w]


def largest_part(inside: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The pixels of the largest part, in row order; of equals the one that begins first."""
    label = parts(inside) if label is None else label
    count = np.bincount(label[label >= 0]) if (label >= 0).any() else np.zeros(0, int)
    return np.flatnonzero(label.ravel() == count.argmax()) if len(count) else np.zeros(0, np.int64)
