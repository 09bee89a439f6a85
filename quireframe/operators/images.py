"""Image statistics and filters over pixel tables.

pixels(image_id, px, r, g, b, a).  Statistics are histograms of 256 bins built by partial aggregation, so the size of an
image does not matter; filters join an image's few numbers back to its pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BINS = 256
KEY = "image_id"


def luminance() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def gray_level() -> Column:
    return F.least(F.greatest(F.floor(luminance() + 0.5), F.lit(0)), F.lit(BINS - 1)).cast("int")


def luminance_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(KEY, gray_level().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: The threshold of an image without pixels.
EMPTY_THRESHOLD = 128


def otsu_threshold(pixels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """The level of largest variance between the two classes, the lowest on a tie; at most 256 rows per image are ordered.

    ``images`` (image_id, ...) adds those that have no pixels, with the middle of the scale.
    """
    h = luminance_histogram(pixels)
    whole, upto = W.partitionBy(KEY), W.partitionBy(KEY).orderBy("bin")
    h = h.withColumn("below", F.sum("n").over(upto)).withColumn("sum_below", F.sum(F.col("bin") * F.col("n")).over(upto))
    h = h.withColumn("total", F.sum("n").over(whole)).withColumn("sum_all", F.sum(F.col("bin") * F.col("n")).over(whole))
    above = F.col("total") - F.col("below")
    delta = F.col("sum_below") / F.col("below") - (F.col("sum_all") - F.col("sum_below")) / F.when(above > 0, above)
    h = h.withColumn("spread", F.col("below").cast("double") * above * delta * delta)
    usable = F.when(F.col("spread").isNotNull(), F.struct("spread", -F.col("bin")))
    found = h.groupBy(KEY).agg(F.coalesce(F.max_by("bin", usable), F.lit(0)).alias("threshold"))
    if images is None:
        return found
    return images.select(KEY).distinct().join(found, KEY, "left").withColumn("threshold", F.coalesce("threshold", F.lit(EMPTY_THRESHOLD)))


def luminance_percentiles(pixels: DataFrame) -> DataFrame:
    """p2 and p98 by rank floor(p (n - 1)) of the exact luminance: distinct values are counted first, then ranked."""
    v = pixels.groupBy(KEY, luminance().alias("lum")).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = W.partitionBy(KEY).orderBy("lum"), W.partitionBy(KEY)
    v = v.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))

    def pick(p: int) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.lit(p / 100.0) * (F.col("total") - 1)), F.col("lum")))

    return v.groupBy(KEY).agg(pick(2).alias("p2"), pick(98).alias("p98"))


def has_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(KEY).agg(F.max(F.col("a") != 255).alias("has_alpha"))


def grayscale(pixels: DataFrame) -> DataFrame:
    g = gray_level()
    return pixels.withColumn("_g", g).select(KEY, "px", F.col("_g").alias("r"), F.col("_g").alias("g"), F.col("_g").alias("b"), "a")


def threshold_bw(pixels: DataFrame, fixed: float | None = None) -> DataFrame:
    """Black and white at Otsu's level or a fixed one."""
    p = pixels.withColumn("threshold", F.lit(float(fixed))) if fixed is not None else pixels.join(otsu_threshold(pixels), KEY)
    return p.withColumn("_v", F.when(luminance() > F.col("threshold"), 255).otherwise(0)).select(KEY, "px", F.col("_v").alias("r"), F.col("_v").alias("g"), F.col("_v").alias("b"), "a")


def _byte(c: Column) -> Column:
    return F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(255)).cast("int")


def contrast_stretch(pixels: DataFrame) -> DataFrame:
    p = pixels.join(luminance_percentiles(pixels), KEY)
    span = F.greatest(F.lit(1.0), F.col("p98") - F.col("p2"))
    return p.select(KEY, "px", *[_byte((F.col(c) - F.col("p2")) * 255 / span).alias(c) for c in "rgb"], "a")


def remove_background(pixels: DataFrame, threshold: int = 235, band: int = 20) -> DataFrame:
    """Near-white pixels turn transparent, over a linear band of 20 levels."""
    low = F.least("r", "g", "b")
    alpha = F.when(low >= threshold, 0).when(low >= threshold - band, _byte(F.col("a") * (threshold - low) / float(band))).otherwise(F.col("a"))
    return pixels.withColumn("a", alpha.cast("int"))


def filter_page_images(images: DataFrame, pixels: DataFrame, how) -> tuple[DataFrame, DataFrame]:
    """images(image_id, doc_id, page_index, readable): ``how`` applied to every readable image, and how many per page."""
    ok = images.filter("readable")
    return how(pixels.join(ok.select(KEY), KEY, "left_semi")), ok.groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("touched"))


def compression_plan(images: DataFrame, dpi_max: float) -> DataFrame:
    """images(width_px, height_px, w_pt, h_pt, ...): effective resolution, whether to rescale, and the target size."""
    def dpi(px: str, pt: str) -> Column:
        return F.when(F.col(pt) > 0, F.col(px) * 72.0 / F.col(pt)).otherwise(0.0)

    d = images.withColumn("dpi", F.greatest(dpi("width_px", "w_pt"), dpi("height_px", "h_pt"))).withColumn("rescale", F.col("dpi") > dpi_max)

    def target(px: str) -> Column:
        return F.when(F.col("rescale"), F.greatest(F.lit(1), F.floor(F.col(px) * (F.lit(dpi_max) / F.col("dpi")) + 0.5))).otherwise(F.col(px)).cast("int")

    return d.withColumn("target_w", target("width_px")).withColumn("target_h", target("height_px"))


def compression_report(planned: DataFrame) -> DataFrame:
    """planned images with has_alpha, raw_size, jpeg_size, bitmap_size: what is replaced, and bytes before and after.

    A transparent image is only ever rescaled as a bitmap; an opaque one becomes a JPEG if that is smaller, else a
    rescaled bitmap if it was to be rescaled, else it stays.
    """
    how = (
        F.when(F.col("has_alpha"), F.when(F.col("rescale"), "bitmap").otherwise("keep"))
        .when(F.col("jpeg_size") < F.coalesce("raw_size", F.lit(2**53)), "jpeg").when(F.col("rescale"), "bitmap").otherwise("keep")
    )
    after = F.when(F.col("how") == "jpeg", F.col("jpeg_size")).when(F.col("how") == "bitmap", F.col("bitmap_size")).otherwise(F.col("raw_size"))
    p = planned.withColumn("how", how).withColumn("after", after)
    g = p.groupBy("doc_id").agg(F.sum("raw_size").alias("before_bytes"), F.sum("after").alias("after_bytes"), F.count_if(F.col("how") != "keep").alias("images"))
    return g.withColumn("saving_pct", F.floor((1 - F.col("after_bytes") / F.when(F.col("before_bytes") > 0, F.col("before_bytes"))) * 100 + 0.5).cast("long"))
