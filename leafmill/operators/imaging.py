"""Page quality, blank page, document boundary and card jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions import imaging as rules
from leafmill.functions.common import any_of, count_true, first_match
from leafmill.plans.ordered import Ordered


def image_metrics(images: DataFrame) -> DataFrame:
    """Variance, ink, brightness, sharpness, bars and dark band of every page image."""
    g, w, h = F.col("gray"), F.col("width"), F.col("height")
    tones, bars, band = rules.brightness_contrast(g), rules.bar_pattern(g, w, h), rules.dark_band(g, w, h)
    staged = images.select(
        "page_id", "doc_id", "page_num", rules.variance(g).alias("variance"),
        rules.ink_density(g, w, h).alias("density"), tones.alias("tone"),
        rules.sharpness(g, w, h).alias("sharpness"), bars.alias("bar"), band.alias("band"))
    return staged.select(
        "page_id", "doc_id", "page_num", "variance", "density", "tone.brightness", "tone.contrast",
        F.col("tone.issues").alias("issues"), F.col("tone.level").alias("tone_level"), "sharpness",
        rules.sharpness_level(F.col("sharpness")).alias("sharpness_level"), "bar.bars", "bar.has_barcode",
        F.col("bar.confidence").alias("barcode_conf"), "band.longest_run", "band.has_stripe",
        F.col("band.confidence").alias("stripe_conf"))


def blank_pages(ink: DataFrame, settings: DataFrame | None = None, *tenant: str) -> DataFrame:
    """Blank flag per page. ``settings`` (see ``catalog.load_settings``) gives the thresholds
    of each ``tenant``; a tenant without settings, or no settings, takes the usual ones."""
    if settings is None:
        rule = rules.classify_blank("variance", "density")
    else:
        names = ["blank_page_variance_threshold", "blank_page_density_threshold"]
        ink = ink.join(settings.select(*tenant, *names), list(tenant), "left")
        rule = rules.classify_blank("variance", "density", *[
            F.coalesce(c, F.lit(usual)) for c, usual in zip(names, (rules.VARIANCE_THRESHOLD, rules.DENSITY_THRESHOLD))])
    return ink.select("doc_id", "page_num", rule.alias("r")).select(
        "doc_id", "page_num", "r.is_blank", F.round("r.confidence", 2).alias("confidence"))


def blank_summary(flags: DataFrame) -> DataFrame:
    """Per document: pages, blank pages and their mean confidence (0.95 without any)."""
    blank = F.col("is_blank")
    count = count_true(blank)
    return flags.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), count.alias("blank_count"),
        F.round(F.coalesce(F.avg(F.when(blank, F.col("confidence"))), F.lit(0.95)), 9).alias("confidence"),
        F.when(count > 0, F.format_string("Skip %d pages", count)).otherwise("No blank pages detected").alias("message"))


def page_similarity(images: DataFrame) -> DataFrame:
    """Likeness of each page's header and footer to the page before it, whatever its
    number. Only the two bands travel, in blocks of pages."""
    g, w, h = F.col("gray"), F.col("width"), F.col("height")
    bands = images.select("doc_id", "page_num", rules.header_rows(g, w, h).alias("header"),
                          rules.footer_rows(g, w, h).alias("footer"))
    score = (rules.band_similarity(F.col("header"), F.col("prior.header"))
             + rules.band_similarity(F.col("footer"), F.col("prior.footer"))) / 2
    return (_with_prior(bands, ["header", "footer"]).filter("prior IS NOT NULL")
            .select("doc_id", "page_num", score.alias("similarity"))
            .withColumn("header_changed", F.col("similarity") < 0.6))


def layout_parts() -> Column:
    return F.array(*[F.floor(F.col(f"q{i}") / 10).cast("int") for i in (1, 2, 3, 4)])


def layout_signature() -> Column:
    return F.array_join(F.transform(layout_parts(), lambda n: n.cast("string")), "-")


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, v: acc + v)


def layout_changes(features: DataFrame) -> DataFrame:
    """Layout signature, distance to the page before it, whatever its number, and whether it moved by over ten."""
    sig = features.select("doc_id", "page_num", layout_signature().alias("signature"), layout_parts().alias("parts"))
    moved = F.coalesce(_distance(F.col("parts"), F.col("prior.parts")), F.lit(0))
    return _with_prior(sig, ["parts"]).select("doc_id", "page_num", "signature", moved.alias("distance"),
                         (moved > 10).alias("layout_changed"))


def _page_order() -> Ordered:
    return Ordered(["doc_id"], ["page_num"], F.floor(F.col("page_num") / 1000))


def _with_prior(pages: DataFrame, values: list[str]) -> DataFrame:
    """Pages with ``prior``, the values of the page before in their document; NULL for the first."""
    return _page_order().segments(pages, values, lambda row, prior: F.lit(False))


def document_boundaries(features: DataFrame) -> DataFrame:
    """Where documents start inside a scanned stack, why, and each page's document.

    Page 1 always starts one. The page after a blank page starts one, and that
    reason comes first; a blank page that is not the last is not tested itself.
    Otherwise page-one marks, header changes and layout changes are averaged.
    """
    def reasons(row: Column, prior: Column) -> dict[str, Column]:
        return {
            "page_one_detected": row["is_page_one"],
            "header_change": row["header_changed"],
            "layout_change": F.coalesce(_distance(row["layout"], prior["layout"]) > 10, F.lit(False)),
        }

    def breaks(row: Column, prior: Column) -> Column:
        return prior["is_blank"] | (~row["is_blank"] & any_of(list(reasons(row, prior).values())))

    values = ["page_num", "is_blank", "is_page_one", "header_changed", "layout"]
    cut = _page_order().segments(features.withColumn("layout", layout_parts()), values, breaks)
    row, prior = F.struct(*values), F.col("prior")
    tested = ~F.col("is_blank") | F.col("is_last")
    hits = {name: tested & hit for name, hit in reasons(row, prior).items()}
    # A blank last page is tested too; nothing follows it, so only its own row moves on.
    late = ~F.col("starts") & F.col("is_blank") & any_of(list(hits.values()))
    cut = cut.withColumn("segment", F.col("segment") + late.cast("int")).withColumn("starts", F.col("starts") | late)
    weights = dict(zip(hits, (0.80, 0.70, 0.60)))
    count = sum((h.cast("int") for h in hits.values()), F.lit(0))
    weight = sum((F.when(h, weights[n]).otherwise(0.0) for n, h in hits.items()), F.lit(0.0))
    confidence = first_match([(~F.col("starts"), F.lit(None)), (prior.isNull(), F.lit(1.0)),
                              (prior["is_blank"], F.lit(0.85))],
                             F.least(F.try_divide(weight, count), F.lit(0.95)))
    reason = first_match([
        (~F.col("starts"), F.lit(None)), (prior.isNull(), F.lit("first_page")),
        (prior["is_blank"], F.concat(F.lit("blank_page_"), prior["page_num"].cast("string")))],
        F.concat_ws(",", *[F.when(h, n) for n, h in hits.items()]))
    return cut.select("doc_id", "page_num", F.col("starts").alias("is_split"),
                      F.round(confidence, 6).alias("confidence"), reason.alias("reason"),
                      F.col("segment").alias("document_no"))


def document_ranges(boundaries: DataFrame) -> DataFrame:
    """First and last page of each document with its reason."""
    start = F.col("is_split")
    return boundaries.groupBy("doc_id", "document_no").agg(
        F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"),
        F.max(F.when(start, F.col("confidence"))).alias("confidence"),
        F.max(F.when(start, F.col("reason"))).alias("reason"))


def boundary_summary(boundaries: DataFrame) -> DataFrame:
    """Documents per stack; mean confidence, or 0.90 for a single document."""
    splits = count_true(F.col("is_split"))
    return boundaries.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), splits.alias("documents"),
        F.round(F.when(splits > 1, F.avg("confidence")).otherwise(0.90), 9).alias("confidence"))


def pages_to_documents(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages with the document whose range holds them, for ranges that come from
    elsewhere. Ranges are unrolled, so the join is on (document, page)."""
    spread = ranges.select("doc_id", "document_no",
                           F.explode(F.sequence("first_page", "last_page")).alias("page_num"))
    return pages.join(spread, ["doc_id", "page_num"])


def card_sides(scans: DataFrame) -> DataFrame:
    return scans.select("doc_id", "page_num", rules.classify_card_side().alias("r")).select(
        "doc_id", "page_num", "r.is_id_card", "r.side", "r.card_type", F.round("r.confidence", 2).alias("confidence"))


def pair_card_sides(cards: DataFrame) -> DataFrame:
    """Fronts and backs paired in page order; what has no partner stands alone.

    Runs of alternating sides do not touch each other, so pairs are two by two
    from the start of each run.
    """
    def breaks(row: Column, prior: Column) -> Column:
        return ~(row["side"].isin("recto", "verso") & prior["side"].isin("recto", "verso")
                 & (row["side"] != prior["side"]))

    runs = _page_order().segments(cards, ["side"], breaks)
    pair = F.floor((F.col("position") - 1) / 2)
    return runs.groupBy("doc_id", "segment", pair.alias("pair")).agg(
        F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"),
        F.count(F.lit(1)).alias("sides")).select("doc_id", "first_page", "last_page", "sides")


def card_summary(sides: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cards, groupings and mean confidence per document; 0.9 where no card is seen."""
    card = F.col("is_id_card")
    found = sides.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), count_true(card).alias("cards"),
        F.round(F.coalesce(F.avg(F.when(card, F.col("confidence"))), F.lit(0.9)), 9).alias("confidence"))
    groups = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groupings"),
                                         count_true(F.col("sides") == 2).alias("pairs"))
    return found.join(groups, "doc_id", "left").select(
        "doc_id", "total_pages", "cards", F.coalesce("groupings", F.lit(0)).alias("groupings"),
        F.coalesce("pairs", F.lit(0)).alias("pairs"), "confidence")


def page_quality(scans: DataFrame) -> DataFrame:
    """Score, level and recommendations per page from measured columns."""
    issues = F.array_compact(F.array(
        first_match([(F.col("too_dark"), F.lit("too_dark")), (F.col("too_bright"), F.lit("too_bright"))]),
        F.when(F.col("low_contrast"), "low_contrast")))
    return scans.select("doc_id", "page_num", rules.page_quality("dpi", "blur_score", issues, "skew_angle").alias("r")) \
        .select("doc_id", "page_num", F.round("r.score", 2).alias("quality_score"),
                F.col("r.level").alias("quality_level"), "r.recommendations",
                (F.size("r.recommendations") > 0).alias("needs_preprocessing"))


def quality_summary(quality: DataFrame) -> DataFrame:
    score = F.avg("quality_score")
    return quality.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.round(score, 9).alias("average_quality_score"),
        first_match([(score >= 85, F.lit("excellent")), (score >= 70, F.lit("good")),
                     (score >= 50, F.lit("acceptable"))], F.lit("poor")).alias("overall_quality"),
        F.bool_or("needs_preprocessing").alias("needs_preprocessing"))


def quality_recommendations(quality: DataFrame) -> DataFrame:
    """Distinct recommendations per document, with the pages that call for each."""
    return quality.select("doc_id", F.explode("recommendations").alias("recommendation")).groupBy(
        "doc_id", "recommendation").agg(F.count(F.lit(1)).alias("pages"))
