"""Queries over page images, page features and card scans."""

from pyspark.sql import functions as F

from leafmill.functions import imaging as rules
from leafmill.operators import catalog, imaging as ops, tiles
from leafmill.registry import Inputs, query

_PIXELS = """
    WITH px AS (SELECT page_id, gray, unnest(gray) AS v, unnest(range(0, 64)) AS i FROM page_images),
         xy AS (SELECT *, i % 16 AS x, i // 16 AS y FROM px),
         nb AS (SELECT *, CASE x WHEN 0 THEN 1 ELSE x - 1 END AS xm, CASE x WHEN 15 THEN 14 ELSE x + 1 END AS xp,
                       CASE y WHEN 0 THEN 1 ELSE y - 1 END AS ym, CASE y WHEN 3 THEN 2 ELSE y + 1 END AS yp FROM xy),
         tone AS (SELECT page_id, (64 * sum(v * v) - sum(v) * sum(v)) / 4096::DOUBLE AS variance, avg(v) AS brightness,
                         sqrt((64 * sum(v * v) - sum(v) * sum(v)) / 4096::DOUBLE) AS contrast
                  FROM xy GROUP BY page_id),
         ink AS (SELECT page_id, avg(share) AS density FROM (
                     SELECT page_id, x // 5 AS cx, y AS cy, avg((v < 240)::INT) AS share FROM xy
                     WHERE x < 15 AND y < 3 GROUP BY ALL) GROUP BY page_id),
         le AS (SELECT page_id, gray[y * 16 + xm + 1] + gray[y * 16 + xp + 1] + gray[ym * 16 + x + 1]
                                + gray[yp * 16 + x + 1] - 4 * v AS e FROM nb),
         lap AS (SELECT page_id, (64 * sum(e * e) - sum(e) * sum(e)) / 4096::DOUBLE AS sharpness FROM le GROUP BY page_id),
         sob AS (SELECT page_id, x, y, abs(2 * (gray[(5 - y) * 16 + xp + 1] + gray[y * 16 + xp + 1])
                                           - 2 * (gray[(5 - y) * 16 + xm + 1] + gray[y * 16 + xm + 1])) AS e
                 FROM nb WHERE y >= 2),
         cut AS (SELECT page_id, avg(e) + stddev_pop(e) AS cut FROM sob GROUP BY page_id),
         bars AS (SELECT page_id, count(*) FILTER (n > 0.4) AS bars FROM (
                      SELECT page_id, x, count(*) FILTER (e > cut) AS n FROM sob JOIN cut USING (page_id)
                      GROUP BY page_id, x) GROUP BY page_id),
         rm AS (SELECT page_id, y, avg(v) AS m FROM xy GROUP BY page_id, y),
         dk AS (SELECT page_id, y, m < avg(m) OVER p - stddev_pop(m) OVER p AS dark FROM rm
                WINDOW p AS (PARTITION BY page_id)),
         isl AS (SELECT page_id, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS g FROM dk WHERE dark),
         runs AS (SELECT page_id, max(n) AS longest_run FROM (
                      SELECT page_id, g, count(*) AS n FROM isl GROUP BY page_id, g) GROUP BY page_id)"""


_METRICS = _PIXELS + """
    SELECT i.page_id, i.doc_id, i.page_num, variance, round(density, 6) AS density,
           brightness, contrast,
           concat_ws(',', CASE WHEN brightness < 50 THEN 'too_dark' WHEN brightness > 200 THEN 'too_bright' END,
                     CASE WHEN contrast < 30 THEN 'low_contrast' END) AS issues,
           CASE (brightness < 50 OR brightness > 200)::INT + (contrast < 30)::INT WHEN 0 THEN 'good'
                WHEN 1 THEN 'acceptable' ELSE 'poor' END AS tone_level,
           sharpness,
           CASE WHEN sharpness > 500 THEN 'excellent' WHEN sharpness > 200 THEN 'good' WHEN sharpness > 100
                THEN 'acceptable' WHEN sharpness > 50 THEN 'poor' ELSE 'very_poor' END AS sharpness_level,
           bars::INT AS bars, bars > 3.2 AS has_barcode, round(least(bars / 4.8::DOUBLE, 1), 6) AS barcode_conf,
           coalesce(longest_run, 0)::INT AS longest_run, coalesce(longest_run, 0) > 0.15 AS has_stripe,
           CASE WHEN coalesce(longest_run, 0) > 0.15 THEN least(longest_run / 0.3::DOUBLE, 1) ELSE 0 END AS stripe_conf
    FROM page_images i JOIN tone USING (page_id) JOIN ink USING (page_id) JOIN lap USING (page_id)
    JOIN bars USING (page_id) LEFT JOIN runs USING (page_id)"""


@query("image_metrics", ["A21", "A22", "A23", "W8", "W9"], _METRICS)
def image_metrics(q: Inputs):
    rows = ops.image_metrics(q.view("page_images"))
    return rows.withColumns({
        "issues": F.array_join("issues", ","), "density": F.round("density", 6),
        "barcode_conf": F.round("barcode_conf", 6)})


@query("tiled_image_metrics", ["A21", "A22", "A23", "W8", "W9"], f"SELECT * EXCLUDE (doc_id, page_num) FROM ({_METRICS})")
def tiled_image_metrics(q: Inputs):
    rows = tiles.tiled_metrics(tiles.cut_tiles(q.view("page_images"), 5), 5)
    return rows.withColumns({
        "issues": F.array_join("issues", ","), "density": F.round("density", 6),
        "barcode_conf": F.round("barcode_conf", 6)})


@query("page_similarity", ["W10"], """
    WITH px AS (SELECT doc_id, page_num, unnest(gray)::DOUBLE AS v, unnest(range(0, 64)) AS i FROM page_images),
         d AS (SELECT a.doc_id, a.page_num, avg(pow(a.v - b.v, 2)) FILTER (a.i < 16) AS mh,
                      avg(pow(a.v - b.v, 2)) FILTER (a.i >= 48) AS mf
               FROM px a JOIN px b ON a.doc_id = b.doc_id AND a.page_num = b.page_num + 1 AND a.i = b.i
               GROUP BY a.doc_id, a.page_num)
    SELECT doc_id, page_num, round((1 / (1 + mh / 1000) + 1 / (1 + mf / 1000)) / 2, 6) AS similarity,
           (1 / (1 + mh / 1000) + 1 / (1 + mf / 1000)) / 2 < 0.6 AS header_changed FROM d""")
def page_similarity(q: Inputs):
    return ops.page_similarity(q.view("page_images")).withColumn("similarity", F.round("similarity", 6))


_BLANK = """
    WITH r AS (SELECT doc_id, page_num, variance < 100 AND density < 0.02 AS is_blank,
                      variance / 100::DOUBLE AS v, density / 0.02::DOUBLE AS d FROM page_ink),
         flags AS (SELECT doc_id, page_num, is_blank, round(greatest(0.5::DOUBLE, least(1::DOUBLE,
                      CASE WHEN is_blank THEN ((1 - v) + (1 - d)) / 2
                           ELSE (least(1::DOUBLE, v - 1) + least(1::DOUBLE, d - 1)) / 2 END)), 2) AS confidence FROM r)"""


@query("blank_pages", ["C5"], _BLANK + " SELECT * FROM flags")
def blank_pages(q: Inputs):
    return ops.blank_pages(q.view("page_ink"))


@query("tenant_blank_pages", ["C5", "S7"], """
    WITH s AS (SELECT tenant, coalesce(try_cast(max(svalue) FILTER (skey = 'blank_page_variance_threshold') AS DOUBLE), 100.0::DOUBLE) AS vt,
                      coalesce(try_cast(max(svalue) FILTER (skey = 'blank_page_density_threshold') AS DOUBLE), 0.02::DOUBLE) AS dt
               FROM tenant_settings GROUP BY tenant),
         r AS (SELECT doc_id, page_num, variance / coalesce(vt, 100) AS v, density / coalesce(dt, 0.02) AS d
               FROM page_ink LEFT JOIN s ON page_ink.tenant = s.tenant)
    SELECT doc_id, page_num, v < 1 AND d < 1 AS is_blank, round(greatest(0.5::DOUBLE, least(1::DOUBLE,
           CASE WHEN v < 1 AND d < 1 THEN ((1 - v) + (1 - d)) / 2
                ELSE (least(1::DOUBLE, v - 1) + least(1::DOUBLE, d - 1)) / 2 END)), 2) AS confidence FROM r""")
def tenant_blank_pages(q: Inputs):
    settings = catalog.load_settings(q.view("tenant_settings"), "tenant")
    return ops.blank_pages(q.view("page_ink"), settings, "tenant")


@query("blank_summary", ["A17"], _BLANK + """
    SELECT doc_id, count(*) AS total_pages, count(*) FILTER (is_blank) AS blank_count,
           round(coalesce(avg(confidence) FILTER (is_blank), 0.95::DOUBLE), 9) AS confidence,
           CASE WHEN count(*) FILTER (is_blank) > 0 THEN format('Skip {} pages', count(*) FILTER (is_blank))
                ELSE 'No blank pages detected' END AS message FROM flags GROUP BY doc_id""")
def blank_summary(q: Inputs):
    return ops.blank_summary(ops.blank_pages(q.view("page_ink")))


_LAYOUT = """
    lay AS (SELECT *, q1 // 10 AS a, q2 // 10 AS b, q3 // 10 AS c, q4 // 10 AS d FROM page_features),
    mov AS (SELECT *, coalesce(abs(a - lag(a) OVER w) + abs(b - lag(b) OVER w) + abs(c - lag(c) OVER w)
                               + abs(d - lag(d) OVER w), 0) AS distance, lag(is_blank) OVER w AS after_blank,
                   page_num = max(page_num) OVER (PARTITION BY doc_id) AS is_last
            FROM lay WINDOW w AS (PARTITION BY doc_id ORDER BY page_num))"""


@query("layout_changes", ["W11"], "WITH " + _LAYOUT + """
    SELECT doc_id, page_num, concat_ws('-', a, b, c, d) AS signature, distance::INT AS distance,
           distance > 10 AS layout_changed FROM mov""")
def layout_changes(q: Inputs):
    return ops.layout_changes(q.view("page_features"))


_BOUNDS = "WITH " + _LAYOUT + """,
    t AS (SELECT *, (NOT is_blank OR is_last) AS tested FROM mov),
    f AS (SELECT *, (tested AND is_page_one)::INT AS f1, (tested AND header_changed)::INT AS f2,
                 (tested AND distance > 10)::INT AS f3 FROM t),
    g AS (SELECT doc_id, page_num, CASE WHEN page_num = 1 THEN 1.0 WHEN after_blank THEN 0.85
                 WHEN f1 + f2 + f3 > 0 THEN least((0.8 * f1 + 0.7 * f2 + 0.6 * f3) / (f1 + f2 + f3), 0.95) END::DOUBLE AS conf,
                 CASE WHEN page_num = 1 THEN 'first_page' WHEN after_blank THEN concat('blank_page_', page_num - 1)
                      WHEN f1 + f2 + f3 > 0 THEN concat_ws(',', CASE f1 WHEN 1 THEN 'page_one_detected' END,
                          CASE f2 WHEN 1 THEN 'header_change' END, CASE f3 WHEN 1 THEN 'layout_change' END) END AS reason
          FROM f),
    bounds AS (SELECT doc_id, page_num, reason IS NOT NULL AS is_split, round(conf, 6) AS confidence, reason,
                      sum((reason IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY page_num)::BIGINT AS document_no
               FROM g)"""


@query("document_boundaries", ["W1"], _BOUNDS + " SELECT * FROM bounds")
def document_boundaries(q: Inputs):
    return ops.document_boundaries(q.view("page_features"))


@query("document_ranges", ["W2"], _BOUNDS + """
    SELECT doc_id, document_no, page_num AS first_page,
           coalesce(lead(page_num) OVER (PARTITION BY doc_id ORDER BY page_num) - 1, total) AS last_page,
           confidence, reason
    FROM bounds JOIN (SELECT doc_id, max(page_num) AS total FROM page_features GROUP BY doc_id) USING (doc_id)
    WHERE is_split""")
def document_ranges(q: Inputs):
    return ops.document_ranges(ops.document_boundaries(q.view("page_features")))


@query("boundary_summary", ["W2"], _BOUNDS + """
    SELECT doc_id, count(*) AS total_pages, count(*) FILTER (is_split) AS documents,
           round(CASE WHEN count(*) FILTER (is_split) > 1 THEN avg(confidence) ELSE 0.9::DOUBLE END, 9) AS confidence
    FROM bounds GROUP BY doc_id""")
def boundary_summary(q: Inputs):
    return ops.boundary_summary(ops.document_boundaries(q.view("page_features")))


@query("pages_to_documents", ["J12"], _BOUNDS + " SELECT doc_id, page_num, document_no FROM bounds")
def pages_to_documents(q: Inputs):
    features = q.view("page_features")
    ranges = ops.document_ranges(ops.document_boundaries(features))
    return ops.pages_to_documents(features.select("doc_id", "page_num"), ranges)


_CARDS = """
    WITH k AS (SELECT *, CASE WHEN abs(aspect_ratio - 1.586) / 1.586 < 0.15 THEN 'credit_card'
                              WHEN abs(aspect_ratio - 1.58) / 1.58 < 0.15 THEN 'driving_license_qc'
                              WHEN abs(aspect_ratio - 1.56) / 1.56 < 0.15 THEN 'health_card_qc' END AS kind,
                      CASE WHEN has_hologram THEN hologram_conf * 0.6::DOUBLE ELSE 0 END + rounded_conf * 0.3::DOUBLE AS r,
                      CASE WHEN has_barcode THEN barcode_conf * 0.7::DOUBLE ELSE 0 END
                      + CASE WHEN has_stripe THEN stripe_conf * 0.5::DOUBLE ELSE 0 END + rounded_conf * 0.3::DOUBLE AS v
               FROM card_scans),
         sides AS (SELECT doc_id, page_num, kind IS NOT NULL AS is_id_card,
                      CASE WHEN kind IS NULL OR greatest(r, v) < 0.3 THEN 'unknown' WHEN r > v THEN 'recto'
                           ELSE 'verso' END AS side, coalesce(kind, 'not_a_card') AS card_type,
                      round(CASE WHEN kind IS NULL THEN 0.1::DOUBLE WHEN greatest(r, v) < 0.3 THEN 0.3::DOUBLE
                                 ELSE least(greatest(r, v), 0.95::DOUBLE) END, 2) AS confidence FROM k)"""


@query("card_sides", ["C8"], _CARDS.replace("sides AS", "seen AS") + " SELECT * FROM seen")
def card_sides(q: Inputs):
    return ops.card_sides(q.view("card_scans"))


_PAIRS = """
    b AS (SELECT *, CASE WHEN side IN ('recto', 'verso') AND lag(side) OVER w IN ('recto', 'verso')
                              AND side <> lag(side) OVER w THEN 0 ELSE 1 END AS brk FROM {cards}
          WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY page_num) AS seg FROM b),
    n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, seg ORDER BY page_num) - 1) // 2 AS pair FROM s),
    pairs AS (SELECT doc_id, min(page_num) AS first_page, max(page_num) AS last_page, count(*) AS sides
              FROM n GROUP BY doc_id, seg, pair)"""


@query("pair_card_sides", ["W4"], "WITH " + _PAIRS.format(cards="card_sides") + " SELECT * FROM pairs")
def pair_card_sides(q: Inputs):
    return ops.pair_card_sides(q.view("card_sides"))


@query("card_summary", ["A27"], _CARDS.replace("sides AS", "seen AS") + ", "
       + _PAIRS.format(cards="(SELECT * FROM seen WHERE is_id_card)") + """
    SELECT f.doc_id, total_pages, cards, coalesce(groupings, 0) AS groupings, coalesce(g.pairs, 0) AS pairs, confidence
    FROM (SELECT doc_id, count(*) AS total_pages, count(*) FILTER (is_id_card) AS cards,
                 round(coalesce(avg(confidence) FILTER (is_id_card), 0.9::DOUBLE), 9) AS confidence
          FROM seen GROUP BY doc_id) f
    LEFT JOIN (SELECT doc_id, count(*) AS groupings, count(*) FILTER (sides = 2) AS pairs
               FROM pairs GROUP BY doc_id) g USING (doc_id)""")
def card_summary(q: Inputs):
    sides = ops.card_sides(q.view("card_scans"))
    return ops.card_summary(sides, ops.pair_card_sides(sides.filter("is_id_card")))


@query("estimated_dpi", ["C7"], """
    SELECT doc_id, page_num, CASE WHEN dpi_x IS NOT NULL THEN (dpi_x + dpi_y) // 2
                                  WHEN height > width THEN height // 11 ELSE width // 11 END::INT AS estimated_dpi
    FROM page_scans""")
def estimated_dpi(q: Inputs):
    return q.view("page_scans").select(
        "doc_id", "page_num", rules.estimated_dpi("width", "height", "dpi_x", "dpi_y").alias("estimated_dpi"))


_QUALITY = """
    WITH s AS (SELECT *, 100::DOUBLE - CASE WHEN dpi < 150 THEN (150 - dpi) / 150::DOUBLE * 40
                             WHEN dpi < 300 THEN (300 - dpi) / 300::DOUBLE * 10 ELSE 0 END
                      - CASE WHEN blur_score < 100 THEN (100 - blur_score) / 100 * 30 ELSE 0 END
                      - ((too_dark OR too_bright)::INT + low_contrast::INT) * 15
                      - CASE WHEN abs(skew_angle) > 3 THEN least(abs(skew_angle) * 5, 20) ELSE 0 END AS raw FROM page_scans),
         t AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, raw)) AS score,
                      list_filter([CASE WHEN dpi < 150 THEN format('increase_dpi_from_{}_to_150', dpi) END,
                       CASE WHEN blur_score < 100 THEN 'image_too_blurry' END, CASE WHEN too_dark THEN 'too_dark' END,
                       CASE WHEN too_bright THEN 'too_bright' END, CASE WHEN low_contrast THEN 'low_contrast' END,
                       CASE WHEN abs(skew_angle) > 3 THEN printf('deskew_%.1f_degrees', abs(skew_angle)) END],
                       lambda x: x IS NOT NULL) AS advice FROM s),
         quality AS (SELECT doc_id, page_num, round(score, 2) AS quality_score,
                      CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50
                           THEN 'acceptable' WHEN score >= 30 THEN 'poor' ELSE 'very_poor' END AS quality_level,
                      advice, len(advice) > 0 AS needs_preprocessing FROM t)"""


@query("page_quality", ["C6"], _QUALITY + """
    SELECT doc_id, page_num, quality_score, quality_level, array_to_string(advice, ',') AS recommendations,
           needs_preprocessing FROM quality""")
def page_quality(q: Inputs):
    return ops.page_quality(q.view("page_scans")).withColumn(
        "recommendations", F.array_join("recommendations", ","))


@query("quality_summary", ["A20"], _QUALITY + """
    SELECT doc_id, count(*) AS total_pages, round(avg(quality_score), 9) AS average_quality_score,
           CASE WHEN avg(quality_score) >= 85 THEN 'excellent' WHEN avg(quality_score) >= 70 THEN 'good'
                WHEN avg(quality_score) >= 50 THEN 'acceptable' ELSE 'poor' END AS overall_quality,
           bool_or(needs_preprocessing) AS needs_preprocessing FROM quality GROUP BY doc_id""")
def quality_summary(q: Inputs):
    return ops.quality_summary(ops.page_quality(q.view("page_scans")))


@query("quality_recommendations", ["A20", "U4", "T3"], _QUALITY + """
    SELECT doc_id, recommendation, count(*) AS pages FROM (
        SELECT doc_id, unnest(advice) AS recommendation FROM quality) GROUP BY doc_id, recommendation""")
def quality_recommendations(q: Inputs):
    return ops.quality_recommendations(ops.page_quality(q.view("page_scans")))
