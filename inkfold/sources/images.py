"""Image sources: PNG headers, raw sample planes, pixels and tiles, admission from metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a tile. A tile of samples is the most that one Python call holds.
TILE = 256
PIXELS = "image_id string, x int, y int, r int, g int, b int, a int"


def png_size(content: Column) -> Column:
    """(width, height, error) from the first 24 bytes of a file."""
    head = F.hex(F.substring(content, 1, 24))
    width, height = (F.conv(F.substr(head, F.lit(at), F.lit(8)), 16, 10).cast("long") for at in (33, 41))
    error = (
        F.when(F.length(head) != 48, "PNG header is incomplete")
        .when(F.substr(head, F.lit(1), F.lit(16)) != "89504E470D0A1A0A", "image does not have a PNG signature")
        .when(F.substr(head, F.lit(17), F.lit(16)) != "0000000D49484452", "PNG does not start with an IHDR chunk")
        .when((width == 0) | (height == 0), "PNG dimensions must be positive")
    )
    return F.struct(F.when(error.isNull(), width).alias("width"), F.when(error.isNull(), height).alias("height"), error.alias("error"))


def plane_error(width: Column, height: Column, components: Column, color: Column, alpha: Column) -> Column:
    pixels = width.cast("long") * height
    return (
        F.when(~components.isin(1, 3), "decoded image samples are not RGB or grayscale")
        .when(F.octet_length(color) != pixels * components, "decoded image samples have the wrong length")
        .when(F.octet_length(alpha) != pixels, "decoded soft mask has the wrong length")
    )


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image, width, height, components, color, alpha in zip(*(batch.column(c) for c in ("image_id", "width", "height", "components", "color", "alpha")), strict=True):
            w, h, n = width.as_py(), height.as_py(), components.as_py()
            samples = np.frombuffer(color.as_buffer(), np.uint8).reshape(h, w, n)
            mask = np.frombuffer(alpha.as_buffer(), np.uint8).reshape(h, w) if alpha.is_valid else np.full((h, w), 255, np.uint8)
            rgb = samples if n == 3 else np.repeat(samples, 3, axis=2)
            for y in range(0, h, TILE):
                for x in range(0, w, TILE):
                    part, own = rgb[y : y + TILE, x : x + TILE], mask[y : y + TILE, x : x + TILE]
                    th, tw = own.shape
                    ys, xs = np.divmod(np.arange(th * tw), tw)
                    cols = [xs + x, ys + y, *(part[:, :, c].ravel() for c in range(3)), own.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array([image.as_py()] * (th * tw), pa.string()), *(pa.array(c.astype(np.int32)) for c in cols)], names=["image_id", "x", "y", "r", "g", "b", "a"])


def decode(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """images(image_id, width, height, components, color, alpha) -> (pixels, errors): planes as pixel rows, tile by tile.

    Gray samples become RGB; without a mask alpha is 255. An image with an error has no pixels.
    """
    found = images.withColumn("error", plane_error(*(F.col(c) for c in ("width", "height", "components", "color", "alpha"))))
    good = found.where("error IS NULL").select("image_id", "width", "height", "components", "color", "alpha")
    return good.mapInArrow(_decoded, PIXELS), found.where("error IS NOT NULL").select("image_id", F.lit("unsupported_image").alias("error_kind"), "error")


def admit(meta: DataFrame) -> DataFrame:
    """meta(image_id, width, height, bits, has_decode, space, filter, mask_id) -> meta with an error column.

    space: gray, rgb or else; mask_id names another row of meta, the soft mask.
    """
    mask = meta.select(F.col("image_id").alias("m_id"), F.col("width").alias("m_width"), F.col("height").alias("m_height"), F.col("has_decode").alias("m_decode"))
    both = meta.join(mask, F.col("mask_id") == F.col("m_id"), "left")
    masked = F.col("mask_id").isNotNull()
    error = (
        F.when(F.col("bits") != 8, "only 8-bit image components are supported")
        .when(F.col("has_decode"), "image Decode arrays are not supported")
        .when(~F.coalesce(F.col("space").isin("gray", "rgb"), F.lit(False)), "unsupported image color space")
        .when((F.col("filter") == "DCTDecode") & masked, "JPEG images with soft masks are not supported")
        .when(~F.col("filter").isin("DCTDecode", "FlateDecode"), F.concat(F.lit("unsupported image filter: "), F.col("filter")))
        .when(masked & F.col("m_id").isNull(), "SMask does not reference an image stream")
        .when((F.col("m_width") != F.col("width")) | (F.col("m_height") != F.col("height")), "soft-mask dimensions differ from the image")
        .when(F.col("m_decode"), "image Decode arrays are not supported")
    )
    return both.select(*meta.columns, error.alias("error"))
