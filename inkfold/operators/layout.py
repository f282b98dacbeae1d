"""Layout records: regions, strokes, angles, tables, stamps, document types."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..stored import settled

PAGE = ["doc_id", "page_num"]


def _within(value: Column, span: tuple[float, float]) -> Column:
    return value.between(*span)


def classify_regions(shapes: DataFrame) -> DataFrame:
    """Every kind that a candidate box passes as, with the kind's fixed confidence."""
    area, aspect = F.col("w") * F.col("h"), F.col("w") / F.col("h")
    angle = F.abs("angle")
    kinds = [
        ("stamp", (area >= fixed.STAMP_MIN_AREA) & _within(aspect, fixed.STAMP_ASPECT), fixed.STAMP_CONFIDENCE),
        ("handwriting", (area >= fixed.HANDWRITING_MIN_AREA) & ((F.col("std") / (F.col("mean") + 1e-6) > fixed.HANDWRITING_RATIO) | (F.col("mean") > fixed.HANDWRITING_MEAN)), fixed.HANDWRITING_CONFIDENCE),
        ("table", (area >= fixed.TABLE_MIN_AREA) & _within(aspect, fixed.TABLE_ASPECT) & (F.col("density") > fixed.TABLE_DENSITY), fixed.TABLE_CONFIDENCE),
        ("strikethrough", ((angle < fixed.STRIKE_FLAT_DEGREES[0]) | (angle > fixed.STRIKE_FLAT_DEGREES[1])) & (F.col("w") > fixed.STRIKE_LENGTH) & (F.col("density") > fixed.STRIKE_DENSITY), fixed.STRIKE_CONFIDENCE),
    ]
    rows = F.filter(F.array(*[F.when(ok, F.struct(F.lit(k).alias("type"), F.lit(c).alias("confidence"))) for k, ok, c in kinds]), lambda x: x.isNotNull())
    return shapes.select(*PAGE, "shape_ord", F.inline(rows))


def classify_fine(shapes: DataFrame) -> DataFrame:
    """The second detector: kinds with a confidence from the shape itself."""
    area, aspect = F.col("w") * F.col("h"), F.col("w") / F.col("h")
    kinds = [
        ("stamp", _within(F.col("radius"), fixed.FINE_STAMP_RADIUS) & F.col("is_red"), F.greatest(F.lit(0.9), F.col("density"))),
        ("handwriting", (area >= fixed.FINE_WRITING_AREA) & _within(aspect, fixed.FINE_WRITING_ASPECT) & (area <= fixed.FINE_WRITING_MAX_BOX) & ((F.col("mean") > fixed.FINE_STROKE_WIDTH) | (F.col("std") > fixed.FINE_STROKE_VARIANCE)), F.least(F.lit(1.0), 0.6 + F.col("std"))),
        ("strikethrough", _within(F.col("thickness"), fixed.FINE_STRIKE_THICKNESS) & (F.col("density") > fixed.STRIKE_DENSITY), F.least(F.lit(1.0), 0.7 + F.col("density"))),
    ]
    rows = F.filter(F.array(*[F.when(ok, F.struct(F.lit(k).alias("type"), c.alias("confidence"))) for k, ok, c in kinds]), lambda x: x.isNotNull())
    return shapes.select(*PAGE, "shape_ord", F.inline(rows))


def special_items(regions: DataFrame) -> DataFrame:
    """Flags and counts of the kinds of region on each page."""
    kinds = ["stamp", "handwriting", "table", "strikethrough"]
    return regions.groupBy(*PAGE).agg(*[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds], *[F.bool_or(F.col("type") == k).alias(f"has_{k}") for k in kinds])


def _mode(angles: DataFrame, bucket: Column) -> DataFrame:
    """The most frequent bucket of each page; a tie goes to the one seen first, then to the smaller one."""
    counts = angles.groupBy(*PAGE, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("shape_ord").alias("first"))
    return counts.groupBy(*PAGE).agg(F.max_by("bucket", F.struct("n", -F.col("first"), -F.col("bucket"))).alias("bucket"))


def orientation(angles: DataFrame) -> DataFrame:
    """Page orientation from the mode of the angles in steps of five degrees."""
    folded = F.when(F.col("angle") < -45, F.col("angle") + 90).otherwise(F.col("angle"))
    b = F.col("bucket")
    turned = F.when(_within(b, (-10, 10)), 0).when(_within(b, (40, 50)), 90).when(_within(b, (-50, -40)), 270).when((b >= 80) | (b <= -80), 180).otherwise(0)
    return _mode(angles, F.bround(folded / 5, 0) * 5).select(*PAGE, turned.alias("orientation"))


def skew(lines: DataFrame) -> DataFrame:
    """Skew of each page from its line segments: mode of their angles in steps of half a degree."""
    angle = F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")))
    angle = F.when(angle > 45, angle - 90).when(angle < -45, angle + 90).otherwise(angle)
    return _mode(lines.filter("dx != 0"), F.bround(angle * 2, 0) / 2).withColumnRenamed("bucket", "skew")


def document_type(pages: DataFrame) -> DataFrame:
    """The kind with the highest score; ties in the order of ``DOCUMENT_TYPES``.

    ``pages``: aspect (height over width), has_table, has_stamp, has_handwriting.
    """
    a = F.col("aspect")
    points = lambda c, n: F.when(c, n).otherwise(0)
    scores = [
        points(a > 2.0, 3) + points(~F.col("has_table"), 1),
        points(_within(a, (1.2, 1.6)), 1) + points(F.col("has_table"), 2) + points(F.col("has_stamp"), 1),
        points(_within(a, (1.2, 1.6)), 1) + points(F.col("has_table"), 1) + points(F.col("has_handwriting"), 1),
        points(F.col("has_handwriting"), 3),
    ]
    ranked = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("o"), F.lit(kind).alias("kind")) for k, (kind, s) in enumerate(zip(fixed.DOCUMENT_TYPES, scores, strict=True))])
    return pages.withColumn("document_type", F.array_max(ranked)["kind"])


def stroke_stats(samples: DataFrame) -> DataFrame:
    """Mean, population deviation and their ratio per page; handwritten if wide or uneven."""
    out = samples.groupBy(*PAGE).agg(F.avg("thickness").alias("mean"), F.stddev_pop("thickness").alias("std"))
    out = out.withColumn("ratio", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0))
    return out.withColumn("handwritten", (F.col("mean") > fixed.FINE_STROKE_WIDTH) | (F.col("ratio") > fixed.FINE_STROKE_VARIANCE))


def cells_to_grid(cells: DataFrame, columns: list[int]) -> DataFrame:
    """Cell texts by table row, one output column per column index; missing cells are empty, of repeated ones the greatest text stays."""
    wide = cells.groupBy("table_id", "row_index").pivot("column_index", columns).agg(F.max("text"))
    return wide.select("table_id", "row_index", *[F.coalesce(F.col(str(c)), F.lit("")).alias(f"c{c}") for c in columns])


def key_values(pairs: DataFrame) -> DataFrame:
    """Last value of every key per document."""
    return pairs.groupBy("doc_id", "key").agg(F.max_by("value", "ord").alias("value"))


def resolve_params(pages: DataFrame) -> DataFrame:
    """Image parameters of each page: its language's (English if unknown), overridden by its document type's."""
    names = fixed.IMAGE_PARAMETERS
    as_row = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
    by_lang, by_type = F, F
    for code, values in fixed.LANGUAGE_PARAMETERS.items():
        by_lang = by_lang.when(F.col("lang") == code, as_row(values))
    by_lang = by_lang.otherwise(as_row(fixed.LANGUAGE_PARAMETERS["eng"]))
    for kind, values in fixed.DOCUMENT_PARAMETERS.items():
        by_type = by_type.when(F.col("document_type") == kind, as_row(values))
    return pages.withColumn("_l", by_lang).withColumn("_t", by_type).select(*pages.columns, *[F.coalesce(F.col(f"_t.{n}"), F.col(f"_l.{n}")).alias(n) for n in names])


#: Shapes of a page that are compared with each other directly; pages with more go through the grid.
PAGE_SHAPES = 64


def overlapping_pairs(shapes: DataFrame, cell: int = 300, few: int = PAGE_SHAPES) -> DataFrame:
    """(page, a, b): shapes whose centres are closer than their radii together.

    Shapes of pages with up to ``few`` of them meet on their page.  On others pairs meet
    in grid cells: one side stands in its own cell, the other in the cells around it;
    ``cell`` has to be at least twice the largest radius.
    """
    return _pairs(shapes, cell, few).select(*PAGE, "a", "b")


def _pairs(shapes: DataFrame, cell: int, few: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``overlapping_pairs`` with the columns ``carry`` of both sides, as ``a_`` and ``b_``."""
    rows = shapes.select(*PAGE, "shape_ord", "x", "y", "radius", *carry)
    many = rows.groupBy(*PAGE).agg(F.count("*").alias("n")).filter(F.col("n") > few).select(*PAGE)
    if many.isEmpty():
        return _met(rows, rows, PAGE, carry)
    many = settled(many, "full-pages")
    light, full = rows.join(many, PAGE, "left_anti"), rows.join(many, PAGE, "left_semi")
    own = full.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = own.withColumn("cx", F.explode(F.transform(step, lambda k: F.col("cx") + k))).withColumn("cy", F.explode(F.transform(step, lambda k: F.col("cy") + k)))
    return _met(light, light, PAGE, carry).union(_met(own, around, [*PAGE, "cx", "cy"], carry))


def _met(left: DataFrame, right: DataFrame, on: list[str], carry: tuple[str, ...]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    apart = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    near = (F.col("a.shape_ord") < F.col("b.shape_ord")) & (apart < F.col("a.radius") + F.col("b.radius"))
    return a.join(b, same & near).select(*[f"a.{c}" for c in PAGE], *[F.col(f"{side}.shape_ord").alias(side) for side in "ab"], *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in carry for side in "ab"])


def accepted_stamps(shapes: DataFrame, rounds: int = 16) -> DataFrame:
    """Greedy per page: circles stay; a square stays unless it overlaps an accepted stamp before it.

    Squares on circles go first.  Then links between squares are worked off in rounds: a
    square without an earlier one left on it stays, and what it overlaps goes with its
    links.  What is left after ``rounds`` are long chains; their links are walked in order.
    Shapes of one number follow each other by place and radius.
    """
    order = [*PAGE, "shape_ord", "x", "y", "radius"]
    own = shapes.select(*order, "is_circle").repartitionByRange(*order).sortWithinPartitions(*order)
    shapes = settled(own.withColumn("_number", F.col("shape_ord")).withColumn("shape_ord", F.monotonically_increasing_id()), "stamps")  # rises with the order
    reach = shapes.agg(F.max("radius")).first()[0] or 0
    pairs = _pairs(shapes, max(1, int(2 * reach) + 1), PAGE_SHAPES, ("is_circle",))
    pairs = settled(pairs.filter(~(F.col("a_is_circle") & F.col("b_is_circle"))), "stamp-pairs")
    on_circle = pairs.filter("a_is_circle").select(*PAGE, F.col("b").alias("n")).union(pairs.filter("b_is_circle").select(*PAGE, F.col("a").alias("n"))).distinct()
    gone = settled(on_circle, "stamps-gone")
    named = lambda rows, n: rows.withColumnRenamed("n", n)
    links = pairs.filter("not a_is_circle and not b_is_circle").select(*PAGE, "a", "b")
    links = settled(links.join(named(gone, "a"), [*PAGE, "a"], "left_anti").join(named(gone, "b"), [*PAGE, "b"], "left_anti"), "stamp-links")
    lost = [gone]
    for _ in range(rounds):
        if links.isEmpty():
            break
        first = links.select(*PAGE, "a").join(links.select(*PAGE, F.col("b").alias("a")), [*PAGE, "a"], "left_anti").distinct()
        gone = settled(links.join(first, [*PAGE, "a"], "left_semi").select(*PAGE, F.col("b").alias("n")).distinct(), "stamps-gone")
        lost.append(gone)
        links = links.join(first, [*PAGE, "a"], "left_anti").join(named(gone, "a"), [*PAGE, "a"], "left_anti").join(named(gone, "b"), [*PAGE, "b"], "left_anti")
        links = settled(links, "stamp-links")
    lost.append(_walked_links(links))
    gone = reduce(DataFrame.union, lost).withColumnRenamed("n", "shape_ord")
    return shapes.join(gone, [*PAGE, "shape_ord"], "left_anti").select(*PAGE, F.col("_number").alias("shape_ord"))


def _walked_links(links: DataFrame) -> DataFrame:
    """``n``: squares that go, by their links in order of the later square; a task holds those of one page."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, gone = None, set()
        for batch in batches:
            out = []
            for doc, num, a, b in batch[[*PAGE, "a", "b"]].itertuples(index=False, name=None):
                if (doc, num) != page:
                    page, gone = (doc, num), set()
                if a not in gone and b not in gone:  # all links of a earlier square come before
                    gone.add(b)
                    out.append((doc, num, b))
            yield pd.DataFrame(out, columns=[*PAGE, "n"])

    kinds = {f.name: f.dataType.simpleString() for f in links.schema}
    dealt = links.repartition(*PAGE).sortWithinPartitions(*PAGE, "b", "a").select(*PAGE, "a", "b")
    return dealt.mapInPandas(walk, f"doc_id {kinds['doc_id']}, page_num {kinds['page_num']}, n {kinds['b']}")
