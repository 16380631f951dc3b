"""What one page shows: its section, techniques with keyframes, regions and text blocks; books and images by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import layout, page_parse


def placed_keyframes(keyframes: DataFrame, images: DataFrame) -> DataFrame:
    """``keyframes(id, book, page, bbox)`` with abs_n: the first of the page's ``images(book, page, n, x, y, w, h)`` that holds the bbox's center."""
    box = lambda i: F.get("bbox", i).cast("double")
    items = keyframes.filter("bbox is not null").select("book", "page", F.col("id").alias("i"), (box(0) + box(2) / 2).alias("cx"), (box(1) + box(3) / 2).alias("cy"))
    held = layout.box_holding_center(items, images, ["book", "page"]).select(F.col("i").alias("id"), F.col("n").alias("abs_n"))
    return keyframes.join(held, "id", "left")


def assigned(images: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Images with whether a keyframe of their page lies in them."""
    taken = keyframes.filter("abs_n is not null").select("book", "page", F.col("abs_n").alias("n")).distinct().withColumn("__t", F.lit(True))
    return images.join(taken, ["book", "page", "n"], "left").withColumn("assigned", F.coalesce("__t", F.lit(False))).drop("__t")


def page_bundle(pages: DataFrame, sections: DataFrame, techniques: DataFrame, keyframes: DataFrame, images: DataFrame, blocks: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """One row for each of ``pages(book, page)``: section, techniques with their keyframes, regions and text blocks as arrays in order.

    Of one page of a book the arrays are small; every part is reduced to its page by an
    equality join, so any number of pages is one plan.
    """
    on = ["book", "page"]
    wanted = pages.select(*on).distinct()
    here = lambda df: df.join(wanted, on, "left_semi")
    frames = placed_keyframes(here(keyframes), here(images))
    regions = assigned(here(images), frames)

    def lists(df: DataFrame, name: str, order: str, *fields: str, by: tuple[str, ...] = ("book", "page")) -> DataFrame:
        return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias(name))

    steps = lists(frames.withColumnRenamed("technique", "__t"), "keyframes", "step_index", "id", "abs_n", by=("__t",)).withColumnRenamed("__t", "id")
    techs = lists(here(techniques).join(steps, "id", "left"), "techniques", "seq", "id", "name", "keyframes")
    out = page_parse.sections_of(wanted, sections, corrections)
    out = out.select(*on, F.struct("context", "kind", "weapon", "form").alias("section"))
    for part in (techs, lists(regions, "regions", "n", "x", "y", "w", "h", "assigned"), lists(here(blocks), "textblocks", "block", "text", "translation")):
        out = out.join(part, on, "left")
    return out


def selects_book(selector: Column, book: Column, volume: Column) -> Column:
    """Whether a selector names a book: by its id, its volume, or `vol` and its volume."""
    wanted, number = F.lower(selector), volume.cast("string")
    return (book == wanted) | F.coalesce(number == wanted, F.lit(False)) | F.coalesce(F.concat(F.lit("vol"), number) == wanted, F.lit(False))


def image_url(image: Column, root: str) -> Column:
    """The path below ``root`` (a folder's last part ending in /) under `/img/`; one that isn't below it stays whole; none is null."""
    below = F.when(image.contains(root), F.substring(image, F.instr(image, root) + F.length(F.lit(root)), F.length(image))).otherwise(image)
    return F.when(F.coalesce(image, F.lit("")) != "", F.concat(F.lit("/img/"), below))
