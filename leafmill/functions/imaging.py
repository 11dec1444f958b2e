"""Rules over page images kept as one row per page: width, height and a
row-major ``gray`` array. All are row-local, so images are never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leafmill.functions.common import col, first_match, let

# Thresholds of the blank, brightness and quality rules.
VARIANCE_THRESHOLD, DENSITY_THRESHOLD = 100.0, 0.02
WHITE = 240
MIN_DPI, GOOD_DPI = 150, 300
MIN_SHARPNESS = 100
MIN_BRIGHTNESS, MAX_BRIGHTNESS, MIN_CONTRAST = 50, 200, 30
MAX_SKEW = 3.0

# Card proportions, tried in order, and their tolerance.
CARD_RATIOS = [("credit_card", 1.586), ("driving_license_qc", 1.58), ("health_card_qc", 1.56)]
CARD_TOLERANCE = 0.15


def total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, v: acc + v.cast(kind))


def mean(values: Column) -> Column:
    return total(values, "double") / F.size(values)


def variance(values: Column) -> Column:
    """Population variance from the sum and the sum of squares, in one pass.
    The sums are whole numbers for pixels, so no digits are lost before the division."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def step(acc: Column, v: Column) -> Column:
        x = v.cast("double")
        return F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q"))

    return let(values, lambda v: let(F.size(v).cast("double"), lambda n: F.aggregate(
        v, start, step, lambda acc: F.greatest(F.lit(0.0), n * acc["q"] - acc["s"] * acc["s"]) / (n * n))))


def ink_density(gray: Column, width: Column, height: Column, grid: int = 3) -> Column:
    """Mean share of non-white pixels over a grid of equal cells; the pixels left
    over at the right and bottom do not count. Equal cells have the mean of
    their union."""
    cell_w, cell_h = F.floor(width / grid), F.floor(height / grid)
    inked = F.filter(gray, lambda v, i: (v < WHITE) & (i % width < cell_w * grid)
                     & (F.floor(i / width) < cell_h * grid))
    return F.try_divide(F.size(inked), cell_w * cell_h * grid * grid)


def classify_blank(ink_variance: str | Column, density: str | Column, variance_threshold: float | Column = VARIANCE_THRESHOLD,
                   density_threshold: float | Column = DENSITY_THRESHOLD) -> Column:
    """Struct(is_blank, confidence). Thresholds are numbers or columns."""
    v, d = col(ink_variance) / variance_threshold, col(density) / density_threshold
    blank = (v < 1) & (d < 1)
    sure = F.when(blank, ((1 - v) + (1 - d)) / 2).otherwise(
        (F.least(F.lit(1.0), v - 1) + F.least(F.lit(1.0), d - 1)) / 2)
    return F.struct(blank.alias("is_blank"), F.greatest(F.lit(0.5), F.least(F.lit(1.0), sure)).alias("confidence"))


def brightness_issues(brightness: Column, contrast: Column) -> Column:
    return F.array_compact(F.array(
        first_match([(brightness < MIN_BRIGHTNESS, F.lit("too_dark")),
                     (brightness > MAX_BRIGHTNESS, F.lit("too_bright"))]),
        F.when(contrast < MIN_CONTRAST, "low_contrast")))


def tone_verdict(brightness: Column, contrast: Column) -> Column:
    """Struct(brightness, contrast, issues, level)."""
    issues = brightness_issues(brightness, contrast)
    level = first_match([(F.size(issues) == 0, F.lit("good")), (F.size(issues) == 1, F.lit("acceptable"))],
                        F.lit("poor"))
    return F.struct(brightness.alias("brightness"), contrast.alias("contrast"), issues.alias("issues"), level.alias("level"))


def brightness_contrast(gray: Column) -> Column:
    """Struct(brightness, contrast, issues, level)."""
    return let(F.struct(mean(gray).alias("b"), F.sqrt(variance(gray)).alias("c")), lambda stats: tone_verdict(stats["b"], stats["c"]))


def _mirror(at: Column, size: Column) -> Column:
    """Index reflected at the border without repeating the edge."""
    return F.when(at < 0, -at).when(at >= size, size * 2 - 2 - at).otherwise(at)


def _pixel(gray: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    return F.get(gray, (_mirror(y, height) * width + _mirror(x, width)).cast("int"))


def laplacian(gray: Column, width: Column, height: Column) -> Column:
    """Four-neighbour Laplacian of every pixel."""
    def at(v: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        near = [_pixel(gray, width, height, x + dx, y + dy) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        return near[0] + near[1] + near[2] + near[3] - v * 4

    return F.transform(gray, at)


def sharpness(gray: Column, width: Column, height: Column) -> Column:
    return variance(laplacian(gray, width, height))


def sharpness_level(score: Column) -> Column:
    return first_match([(score > 500, F.lit("excellent")), (score > 200, F.lit("good")),
                        (score > 100, F.lit("acceptable")), (score > 50, F.lit("poor"))], F.lit("very_poor"))


def sobel_x(gray: Column, width: Column, height: Column) -> Column:
    """Absolute horizontal Sobel response of every pixel."""
    def at(v: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width)

        def side(dx: int) -> Column:
            column = [_pixel(gray, width, height, x + dx, y + dy) for dy in (-1, 0, 1)]
            return column[0] + column[1] * 2 + column[2]

        return F.abs(side(1) - side(-1))

    return F.transform(gray, at)


def bar_pattern(gray: Column, width: Column, height: Column) -> Column:
    """Struct(bars, has_barcode, confidence) from the bottom third of a card."""
    top = F.floor(height * 0.66).cast("int")
    low = F.slice(gray, top * width + 1, (height - top) * width)

    def bars(edges: Column) -> Column:
        limit = mean(edges) + F.sqrt(variance(edges))
        rows = F.sequence(F.lit(0), height - top - 1)

        def count(cut: Column) -> Column:
            columns = F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.size(
                F.filter(rows, lambda y: F.get(edges, y * width + x) > cut)))
            return F.size(F.filter(columns, lambda n: n > height * 0.1))

        return let(limit, count)

    # The slice is bound first: the lambda of every pixel would copy it again.
    found = let(low, lambda part: let(sobel_x(part, width, height - top), bars))
    return let(found, lambda n: bar_verdict(n, width))


def bar_verdict(bars: Column, width: Column) -> Column:
    """Struct(bars, has_barcode, confidence) from the number of columns with many edges."""
    wide = width > 10
    return F.struct(
        bars.alias("bars"), (wide & (bars > width * 0.2)).alias("has_barcode"),
        F.when(wide, F.least(bars / (width * 0.3), F.lit(1.0))).otherwise(0.0).alias("confidence"))


def dark_band(gray: Column, width: Column, height: Column) -> Column:
    """Struct(longest_run, has_stripe, confidence) from the row means."""
    means = F.transform(F.sequence(F.lit(0), height - 1),
                        lambda y: mean(F.slice(gray, y * width + 1, width)))
    return let(let(means, longest_dark_run), lambda run: band_verdict(run, height))


def longest_dark_run(means: Column) -> Column:
    """Rows in the longest run of row means below their mean by a standard deviation."""
    limit = mean(means) - F.sqrt(variance(means))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, v, cut):
        run = F.when(v < cut, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return let(limit, lambda cut: F.aggregate(means, start, lambda acc, v: step(acc, v, cut),
                                              lambda acc: acc["best"]))


def band_verdict(run: Column, height: Column) -> Column:
    """Struct(longest_run, has_stripe, confidence) from the rows of the longest dark run."""
    expected = height * 0.075
    return F.struct(
        run.alias("longest_run"), (run > expected * 0.5).alias("has_stripe"),
        F.when(run > expected * 0.5, F.least(run / expected, F.lit(1.0))).otherwise(0.0).alias("confidence"))


def band_similarity(a: Column, b: Column) -> Column:
    """One over one plus the mean squared difference of two bands in thousands."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return 1 / (1 + mean(squares) / 1000)


def header_rows(gray: Column, width: Column, height: Column) -> Column:
    return F.slice(gray, F.lit(1), F.greatest(F.lit(1), F.floor(height * 0.1).cast("int")) * width)


def footer_rows(gray: Column, width: Column, height: Column) -> Column:
    size = F.greatest(F.lit(1), F.floor(height * 0.1).cast("int")) * width
    return F.slice(gray, width * height - size + 1, size)


def estimated_dpi(width: str | Column, height: str | Column, dpi_x: str | Column, dpi_y: str | Column) -> Column:
    """Mean of the declared resolutions, else the long side over eleven inches."""
    declared = ((col(dpi_x) + col(dpi_y)) / 2).cast("int")
    return F.coalesce(declared, F.floor(F.greatest(col(width), col(height)) / 11).cast("int"))


def page_quality(dpi: str | Column, blur: str | Column, issues: Column, skew: str | Column) -> Column:
    """Struct(score, level, recommendations)."""
    d, b, tilt = col(dpi), col(blur), F.abs(col(skew))
    dpi_cut = first_match([(d < MIN_DPI, (MIN_DPI - d) / MIN_DPI * 40),
                           (d < GOOD_DPI, (GOOD_DPI - d) / GOOD_DPI * 10)], F.lit(0.0))
    blur_cut = F.when(b < MIN_SHARPNESS, (MIN_SHARPNESS - b) / MIN_SHARPNESS * 30).otherwise(0.0)
    skew_cut = F.when(tilt > MAX_SKEW, F.least(tilt * 5, F.lit(20.0))).otherwise(0.0)
    raw = F.lit(100.0) - dpi_cut - blur_cut - F.size(issues) * 15 - skew_cut
    advice = F.array_compact(F.concat(
        F.array(F.when(d < MIN_DPI, F.format_string(f"increase_dpi_from_%d_to_{MIN_DPI}", d)),
                F.when(b < MIN_SHARPNESS, "image_too_blurry")),
        issues,
        F.array(F.when(tilt > MAX_SKEW, F.format_string("deskew_%.1f_degrees", tilt)))))
    return let(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), lambda score: F.struct(
        score.alias("score"),
        first_match([(score >= 85, F.lit("excellent")), (score >= 70, F.lit("good")),
                     (score >= 50, F.lit("acceptable")), (score >= 30, F.lit("poor"))],
                    F.lit("very_poor")).alias("level"),
        advice.alias("recommendations")))


def classify_card_side() -> Column:
    """Struct(is_id_card, side, card_type, confidence) from the columns
    aspect_ratio, has_/_conf of hologram, barcode and stripe, and rounded_conf."""
    ratio = F.col("aspect_ratio")
    kind = first_match([(F.abs(ratio - r) / r < CARD_TOLERANCE, F.lit(n)) for n, r in CARD_RATIOS])

    def part(name: str, weight: float) -> Column:
        return F.when(F.col(f"has_{name}"), F.col(f"{name}_conf") * weight).otherwise(0.0)

    base = F.col("rounded_conf") * 0.3
    recto = part("hologram", 0.6) + base
    verso = part("barcode", 0.7) + part("stripe", 0.5) + base
    weak = F.greatest(recto, verso) < 0.3
    side = first_match([(kind.isNull() | weak, F.lit("unknown")), (recto > verso, F.lit("recto"))], F.lit("verso"))
    sure = first_match([(kind.isNull(), F.lit(0.1)), (weak, F.lit(0.3))],
                       F.least(F.greatest(recto, verso), F.lit(0.95)))
    return F.struct(kind.isNotNull().alias("is_id_card"), side.alias("side"),
                    F.coalesce(kind, F.lit("not_a_card")).alias("card_type"), sure.alias("confidence"))
