"""Pages of words to records: sections, captions, regions and numbered steps put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.scalars import fold, slug
from loomline.operators import layout, lexicon, overlay
from loomline.storage import Scratch, bound_batches

#: The contexts in which captions name movements of a weapon.
ARMED = ("aiki-ken", "aiki-jo")

_TEXTS = "array<string>"
_CAPTION = f"struct<cap:int,y:long,romaji:string,native:string,qualifiers:{_TEXTS},technique:string,attack:string,direction:string,form:{_TEXTS},raw:string>"
#: What is known of a book besides its pages.
_BOOK = ("full_title", "performer", "performer_name", "era", "lineage")


def _apart(pages: DataFrame) -> DataFrame:
    """Rows by page, to be joined by sorting.

    A page takes few bytes of a compressed file and many in memory, so Spark would
    broadcast millions of them by the size of their files.
    """
    return pages.hint("merge")


def sections_of(pages: DataFrame, seed: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Pages (book, page) with context, kind, weapon and form.

    The seed's first range that holds the page; without one a page is of techniques.
    The latest correction (book, first, last, context, kind, weapon, form, date, seq)
    replaces weapon and form as they are, and context and kind where it names them.
    Ranges are met by aligned spans.
    """
    found = overlay.range_lookup(pages, seed.select("book", "first", "last", "context", "kind", "weapon", "form", "seq"), ["book"], "page", grown=True)
    found = found.withColumns({"context": F.coalesce("context", F.lit("taijutsu")), "kind": F.coalesce("kind", F.lit("technique"))})
    if corrections is None:
        return found
    latest = F.row_number().over(W.partitionBy("book").orderBy(F.desc_nulls_last("date"), F.desc_nulls_last("seq")))
    ranked = corrections.select("book", "first", "last", F.struct("context", "kind", "weapon", "form").alias("c"), latest.alias("seq"))
    own = F.col("c").isNotNull()
    return overlay.range_lookup(found, ranked, ["book"], "page", grown=True).select(
        *pages.columns, F.coalesce("c.context", "context").alias("context"), F.coalesce("c.kind", "kind").alias("kind"),
        F.when(own, F.col("c.weapon")).otherwise(F.col("weapon")).alias("weapon"), F.when(own, F.col("c.form")).otherwise(F.col("form")).alias("form"),
    )


def readable(pages: DataFrame) -> DataFrame:
    """Pages of sections that aren't skipped; filter before any work on images."""
    return pages.filter("kind <> 'skip'")


def armed(context: Column) -> Column:
    return context.isin(*ARMED)


def captions_of(lines: DataFrame, armed: Column, scratch: Scratch | None = None) -> DataFrame:
    """Lines (book, page, text, y0, and others) that are captions: name, native, qualifiers, technique, attack, direction, form, slug, raw.

    In armed sections a caption is told by movement words and has no slots.  Each line
    is classified once; the table is cut there.
    """
    scratch = scratch or Scratch(lines.sparkSession)
    bound_batches(lines.sparkSession)
    told = lines.withColumn("__w", F.coalesce(armed, F.lit(False)))
    plain = scratch.cut(told.filter("not __w").withColumn("__f", lexicon.classify(F.col("text"))), "classified").filter(lexicon.is_caption(F.col("text"), F.col("__f")))
    moved = told.filter("__w").filter(lexicon.is_weapon_caption(F.col("text")))
    plain, moved = plain.withColumn("__p", lexicon.parse_caption(F.col("text"), F.col("__f"))), moved.withColumn("__p", lexicon.parse_weapon_caption(F.col("text")))
    none, number = F.lit(None).cast("string"), F.array_compact(F.array("__p.number"))
    own = slug(fold(F.concat_ws(" ", "__p.name", "__p.number")))
    a = plain.select(
        *lines.columns, F.col("__p.name").alias("name"), none.alias("native"), *(F.col(f"__p.{c}").alias(c) for c in ("qualifiers", "technique", "attack", "direction", "form", "slug")), F.col("text").alias("raw")
    )
    b = moved.select(
        *lines.columns, F.col("__p.name").alias("name"), F.col("__p.native").alias("native"), number.alias("qualifiers"), *(none.alias(s) for s in ("technique", "attack", "direction")),
        F.array().cast(_TEXTS).alias("form"), F.coalesce(F.nullif(own, F.lit("")), F.lit("technique")).alias("slug"), F.col("__p.raw").alias("raw"),
    )
    return a.unionByName(b)


def _linked(captions: Column, boxes: Column) -> Column:
    """Captions in the order of y with their boxes in reading order, each at the caption nearest to its center, of two the upper one; one caption has all as they are."""
    down = F.array_sort(F.transform(captions, lambda c: F.struct(c["y"].alias("y"), c["cap"].alias("cap"), c.alias("c"))))
    away = lambda b: F.transform(down, lambda s: F.abs(b["y"] + b["h"] / 2 - s["y"]))
    # each box is measured once
    nearest = F.transform(boxes, lambda b: F.struct(b.alias("b"), F.transform(F.array(away(b)), lambda d: F.array_position(d, F.array_min(d)) - 1)[0].alias("at")))
    own = lambda j: F.transform(F.filter(nearest, lambda n: n["at"] == j), lambda n: n["b"])
    several = F.transform(down, lambda s, j: F.struct(s["c"].alias("c"), overlay.by_rows(own(j)).alias("boxes")))
    return F.when(F.size(captions) == 1, F.transform(captions, lambda c: F.struct(c.alias("c"), boxes.cast(overlay.BOXES).alias("boxes")))).otherwise(several)


def _assigned(captions: Column, boxes: Column, assign: Column) -> Column:
    """What explicit links give: captions in their order with the boxes named; unknown captions and boxes are passed over."""
    known = F.filter(assign, lambda a: (F.coalesce(a["caption_index"], F.lit(0)) < F.size(captions)) & (F.coalesce(a["caption_index"], F.lit(0)) >= 0))
    some = lambda a: F.array_compact(F.transform(F.coalesce(a["regions"], F.array().cast("array<int>")), lambda i: F.get(boxes, i)))
    return F.transform(known, lambda a: F.struct(F.get(captions, F.coalesce(a["caption_index"], F.lit(0))).alias("c"), some(a).cast(overlay.BOXES).alias("boxes")))


def _captions(lines: DataFrame, sections: DataFrame, forced: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(book, page, captions): the page's captions in order, merged and forced."""
    on = ["book", "page"]
    told = layout.native_beside(lines.join(_apart(sections.select(*on, "context")), on), on, "at").withColumnRenamed("native", "beside")
    found = captions_of(told, armed(F.col("context")), scratch)
    found = scratch.cut(found.select(
        *on, F.col("at").cast("long").alias("at"), F.col("y0").cast("long").alias("y"), F.col("name").alias("romaji"), F.when(armed(F.col("context")), F.col("native")).otherwise(F.col("beside")).alias("native"),
        "technique", "attack", "direction", "form", "qualifiers", "raw", "context",
    ), "captions")
    plain = layout.merge_bilingual(found.filter(~armed(F.col("context"))).drop("raw", "context"))
    merged = plain.join(_apart(found.select(*on, "at", "raw")), [*on, "at"])
    fields = [F.col(c) for c in ("at", "y", "romaji", "native", "qualifiers", "technique", "attack", "direction", "form", "raw")]
    every = merged.select(*on, *fields).unionByName(found.filter(armed(F.col("context"))).select(*on, *fields))
    # a section of movements without a caption has one all the same
    bare = sections.filter(armed(F.col("context"))).join(_apart(found.select(*on).distinct()), on, "left_anti")
    placed = F.trim(F.concat(F.col("context"), F.lit(" "), F.coalesce("weapon", F.lit("")), F.lit(" "), F.col("kind")))
    none, empty = F.lit(None).cast("string"), F.array().cast(_TEXTS)
    every = every.unionByName(bare.select(
        *on, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("y"), F.lit("").alias("romaji"), none.alias("native"), empty.alias("qualifiers"), *(none.alias(s) for s in ("technique", "attack", "direction")),
        empty.alias("form"), placed.alias("raw"),
    ))
    if forced is not None:
        known = forced
        for name, kind in (("native", "string"), ("qualifiers", _TEXTS), ("technique", "string"), ("attack", "string"), ("direction", "string"), ("form", _TEXTS)):
            known = known if name in known.columns else known.withColumn(name, F.lit(None).cast(kind))
        own = known.join(_apart(sections.select(*on)), on, "left_semi")
        hidden = own.filter(F.coalesce("suppress", F.lit(True))).select(*on).distinct()
        name = F.coalesce("name", F.lit(""))
        extra = own.select(
            *on, F.lit(1 << 40).alias("at"), F.lit(0).cast("long").alias("y"), name.alias("romaji"), "native", F.coalesce("qualifiers", empty).alias("qualifiers"), "technique", "attack", "direction",
            F.coalesce("form", empty).alias("form"), F.coalesce(F.nullif(name, F.lit("")), F.col("native"), F.lit("")).alias("raw"),
        )
        every = every.join(_apart(hidden), on, "left_anti").unionByName(extra)
    order = F.array_sort(F.collect_list(F.struct("at", F.struct(*(c for c in fields[1:])).alias("c"))))
    numbered = F.transform(order, lambda s, i: F.struct(i.alias("cap"), *(s["c"][c].alias(c) for c in ("y", "romaji", "native", "qualifiers", "technique", "attack", "direction", "form", "raw"))))
    return every.groupBy(*on).agg(numbered.cast(f"array<{_CAPTION}>").alias("captions"))


def parsed(
    pages: DataFrame, lines: DataFrame, regions: DataFrame, seed: DataFrame, section_corrections: DataFrame | None = None, forced: DataFrame | None = None,
    operations: DataFrame | None = None, links: DataFrame | None = None, books: DataFrame | None = None, images: str | None = None, retrieved: str = "",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Techniques, keyframes and captions of whole pages (book, page).

    lines(book, page, at, text, y0), in the order of ``at``, are read for captions by
    their page's section; captions in two scripts are merged, with their forms and
    qualifiers, and named after that.  forced(book, page, name, suppress, and any of
    native, qualifiers, slots) stands for them or behind them; regions(book, page,
    boxes) go through operations(book, page, ops) of ``overlay.region_ops``, and
    links(book, page, assign) of (caption_index, regions) decide which boxes a caption
    has, else the nearest caption does.  books(book, full_title, performer,
    performer_name, era, lineage) tell where records come from; ``images`` is the folder
    that keyframes' images are named in, if they are written.

    Linked captions are numbered in their order, then those without a box are passed
    over; steps count within a caption.  Of records of one id, here or there on a page,
    the last stays.  Skipped pages give nothing.
    """
    on = ["book", "page"]
    scratch = Scratch(pages.sparkSession)
    sections = scratch.cut(readable(sections_of(pages.select(*on).distinct(), seed, section_corrections)), "sections")
    captions = scratch.cut(_captions(lines, sections, forced, scratch), "told")
    boxes = regions.join(_apart(sections.select(*on)), on, "left_semi").select(*on, F.col("boxes").cast(overlay.BOXES).alias("boxes"))
    if operations is not None:
        # pages without photos of their own may be given some
        changed = boxes.join(operations.join(_apart(sections.select(*on)), on, "left_semi"), on, "full")
        none = F.array().cast(overlay.BOXES)
        boxes = changed.select(*on, F.when(F.col("ops").isNull(), F.col("boxes")).otherwise(overlay.region_ops(F.coalesce("boxes", none), F.coalesce("ops", F.array().cast(changed.schema["ops"].dataType)))).alias("boxes"))
    met = captions.join(_apart(sections), on).join(_apart(boxes), on)
    linked = _linked(F.col("captions"), F.col("boxes"))
    if links is not None:
        met = met.join(_apart(links.select(*on, "assign")), on, "left")
        # an empty list decides nothing
        linked = F.when(F.size(F.coalesce("assign", F.array().cast(links.schema["assign"].dataType))) > 0, _assigned(F.col("captions"), F.col("boxes"), F.col("assign"))).otherwise(linked)
    if books is not None:
        met = met.join(books.select("book", *_BOOK), "book", "left")
    else:
        met = met.withColumns({c: F.lit(None).cast("string") for c in _BOOK})
    each = scratch.cut(met.select(*on, "context", "kind", "weapon", F.col("form").alias("named_form"), *_BOOK, F.posexplode(linked).alias("at", "l")), "linked")
    each = each.filter(F.size("l.boxes") > 0).select(*(c for c in each.columns if c not in ("at", "l")), (F.col("at") + 1).alias("seq"), F.col("l.boxes").alias("boxes"), "l.c.*")
    moves = armed(F.col("context"))
    own = lexicon.caption_slug(F.col("romaji"), F.col("qualifiers"), F.col("attack"), F.col("technique"), F.col("direction"), F.col("form"))
    stand_in = slug(F.concat_ws("-", F.coalesce(F.nullif("weapon", F.lit("")), F.col("context")), "kind", F.coalesce(F.get("qualifiers", 0), F.col("seq").cast("string"))))
    each = each.withColumn("slug", own).withColumn("slug", F.when(moves & (F.col("slug") == "technique"), F.coalesce(F.nullif(stand_in, F.lit("")), F.lit("weapon"))).otherwise(F.col("slug")))
    attack = F.when(~moves, F.col("attack"))
    base = F.concat_ws("-", "book", F.concat(F.lit("p"), "page"), "slug")
    count = F.size("boxes")
    frame = lambda i: F.format_string("kf:%s-%02d", base, i)
    provenance = F.struct(
        "performer", "performer_name", "era", F.lit("book").alias("medium"), F.col("book").alias("recording"), "lineage",
    ).alias("provenance")
    source = [F.col("book"), F.col("full_title").alias("title"), F.col("page").alias("pdf_page")]
    told = [F.lit("provisional").alias("status"), F.lit(retrieved).alias("retrieved")]
    techniques = each.select(
        F.concat(F.lit("tech:"), base).alias("id"), *on, "seq", F.col("romaji").alias("name_romaji"), F.col("native").alias("name_native"), "qualifiers", "kind", "context", "weapon", F.col("named_form").alias("form"),
        F.struct("technique", attack.alias("attack"), "direction", "form").alias("slots"), count.alias("step_count"), F.transform(F.sequence(F.lit(1), count), frame).alias("keyframes"),
        F.struct(*source).alias("source"), provenance, F.col("raw").alias("raw_caption"), F.lit("ocr").alias("confidence"), *told,
    )
    steps = each.select("*", F.posexplode("boxes").alias("i", "b")).withColumn("step_index", F.col("i") + 1)
    box = F.array(*(F.col(f"b.{c}") for c in "xywh"))
    image = F.lit("") if images is None else F.format_string("%s/%s/p%s-%s/step_%02d.png", F.lit(images), "book", F.col("page").cast("string"), "slug", "step_index")
    frames = steps.select(
        frame(F.col("step_index")).alias("id"), F.concat(F.lit("tech:"), base).alias("technique"), "step_index", count.alias("step_count"), image.alias("image"), *on, "seq", F.col("romaji").alias("name_romaji"),
        F.col("native").alias("name_native"), attack.alias("attack"), box.alias("bbox"), F.struct(*source, box.alias("bbox")).alias("source"), provenance, F.coalesce("b.kind", F.lit("photo")).alias("granularity"),
        F.lit("book-keyframe").alias("role"), F.lit(None).cast("string").alias("pose"), F.lit(None).cast("array<float>").alias("embedding"), *told,
    )
    last = lambda df: df.groupBy("id").agg(F.max_by(F.struct(*(c for c in df.columns if c != "id")), "seq").alias("r")).select("id", "r.*")
    shown = captions.select(*on, F.explode("captions").alias("c")).select(*on, "c.*")
    return last(techniques), last(frames).drop("seq"), shown
