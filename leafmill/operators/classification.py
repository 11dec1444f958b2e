"""Page classification jobs: pages(doc_id, page_num, text) in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions import classify as rules, zones
from leafmill.functions.common import count_true, let, settle
from leafmill.plans.ranges import first_rows


def words_in_zones(pages: DataFrame, table: dict[str, zones.Zone]) -> DataFrame:
    """(doc_id, page_num, zone, text) for pages with a ``words`` array of
    struct(x, y, text), as a text recogniser gives them."""
    cells = let(F.col("words"), lambda words: F.array(*[
        F.struct(F.lit(name).alias("zone"), zones.zone_text(words, box).alias("text"))
        for name, box in table.items()]))
    return pages.select("doc_id", "page_num", F.explode(cells).alias("z")).select(
        "doc_id", "page_num", "z.zone", "z.text")


def authority_documents(pages: DataFrame) -> DataFrame:
    """Pages issued by the tax authority with type, form number and confidence.
    The cheap issuer test drops other pages before any pattern is run."""
    texts = zones.with_zones(pages, {**zones.AUTHORITY_ZONES, "corner": zones.CORNER_ZONE}, F.lower)
    issued = settle(texts, rules.issuer_flag(F.col("header")).alias("issuer")).filter("issuer.is_issuer")
    body = F.concat_ws(" ", *zones.AUTHORITY_ZONES)
    typed = settle(issued, body.alias("body"))
    typed = settle(typed, rules.authority_type(F.col("body")).alias("best"))
    type_confidence = F.coalesce(F.least(0.5 + F.col("best.score") * 0.15, F.lit(0.95)), F.lit(0.0))
    return typed.select(
        "doc_id", "page_num", F.coalesce("best.name", F.lit(rules.UNKNOWN_AUTHORITY_TYPE)).alias("type"),
        rules.form_number(F.col("corner")).alias("form_number"),
        F.round(F.col("issuer.confidence") * 0.4 + type_confidence * 0.6, 2).alias("confidence"),
        rules.authority_patterns(F.col("body"), F.col("best.name")).alias("matched_patterns"))


def type_counts(hits: DataFrame, kind: str) -> DataFrame:
    """Per document and type: pages, and the page where the type is first seen,
    which gives the order of types in a report."""
    return hits.groupBy("doc_id", kind).agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_num").alias("first_page"))


def confidence_summary(pages: DataFrame, hits: DataFrame, when_none: float) -> DataFrame:
    """Per document: pages, hits, mean confidence or the value for no hits."""
    totals = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"))
    found = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"),
                                       F.round(F.avg("confidence"), 9).alias("mean_confidence"))
    return totals.join(found, "doc_id", "left").select(
        "doc_id", "total_pages", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("mean_confidence", F.lit(when_none)).alias("confidence"))


def tax_forms(pages: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Pages that are tax forms: a code in the corner, else the best content score."""
    texts = zones.with_zones(pages, {"corner": zones.CORNER_ZONE, "content": zones.CONTENT_ZONE,
                                     "strip": zones.YEAR_STRIP_ZONE}, F.lower)
    coded = settle(texts.withColumn("mark", F.upper("corner")), rules.tax_form_code(F.col("mark")).alias("code"))
    scored = settle(coded, F.when(F.col("code").isNull(), rules.tax_form_by_content(
        F.col("content"), word_boundary)).alias("best"))
    found = scored.withColumn("form_type", F.coalesce("code", "best.name")).filter("form_type IS NOT NULL")
    year = rules.tax_year(F.col("corner"), F.col("strip"))
    base = F.when(F.col("code").isNotNull(), 0.90).otherwise(
        F.least(0.3 + F.col("best.score") * 0.15, F.lit(0.92)))
    boosted = F.when(F.col("year").isNotNull(), F.least(F.col("base") + 0.05, F.lit(0.95))).otherwise(F.col("base"))
    return (found.withColumn("year", year).withColumn("base", base)
            .select("doc_id", "page_num", "form_type", "year", F.round(boosted, 2).alias("confidence"),
                    rules.tax_form_issuer(F.col("form_type")).alias("issuer"),
                    F.coalesce("code", rules.tax_form_matches(F.col("content"), F.col("form_type"), word_boundary)).alias("matched")))


def bank_statements(pages: DataFrame) -> DataFrame:
    """Bank named in the head of each document's first page."""
    first = zones.with_zones(pages.filter("page_num = 1"), {"head": zones.BANK_ZONE}, F.upper)
    staged = settle(first, rules.bank(F.col("head")).alias("bank"))
    known = F.col("bank").isNotNull()
    return staged.select("doc_id", "bank", known.alias("is_bank_statement"),
                         F.when(known, 0.90).otherwise(0.0).alias("confidence"),
                         F.substring("head", 1, 200).alias("snippet"))


def fiscal_year_findings(pages: DataFrame) -> DataFrame:
    """One row per year mention and zone it falls in."""
    return _zone_years(pages).select("doc_id", "page_num", F.explode("found").alias("f")).select("doc_id", "page_num", "f.*")


def _zone_years(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, found): all year mentions of a page."""
    found = F.concat(*[rules.year_findings(F.col(name), name, order)
                       for order, name in enumerate(zones.FISCAL_ZONES)])
    return zones.with_zones(pages, zones.FISCAL_ZONES, F.lower).select("doc_id", "page_num", found.alias("found"))


def _year_score(confidence: Column) -> Column:
    """Score of a year on a page: the mean confidence of its mentions, and a little for each of them."""
    return F.round(F.least(F.avg(confidence) + F.least(F.count(F.lit(1)) * 0.05, F.lit(0.15)), F.lit(0.98)), 6)


def page_fiscal_years(findings: DataFrame, as_of_year: int) -> DataFrame:
    """Best year per page; the year seen first wins a tie."""
    valid = findings.filter(F.col("year").between(as_of_year - 10, as_of_year + 2))
    scored = valid.groupBy("doc_id", "page_num", "year").agg(
        _year_score(F.col("confidence")).alias("score"), F.min("seq").alias("seq"))
    best = scored.groupBy("doc_id", "page_num").agg(
        F.max(F.struct("score", (-F.col("seq")).alias("early"), "year")).alias("b"))
    return best.select("doc_id", "page_num", "b.year", F.round("b.score", 2).alias("confidence"))


def fiscal_year_vote(pages: DataFrame, as_of_year: int) -> DataFrame:
    """Most common page year per document, the earliest page winning ties.

    Pages are read once: one without a finding stays as a row without a year, so that pages are counted
    in the same aggregates as their years."""
    rows = _zone_years(pages).select("doc_id", "page_num", F.posexplode_outer("found").alias("at", "f"))
    year = F.when(F.col("f.year").between(as_of_year - 10, as_of_year + 2), F.col("f.year"))
    scored = rows.groupBy("doc_id", "page_num", year.alias("year")).agg(
        _year_score(F.col("f.confidence")).alias("score"), F.min("f.seq").alias("seq"),
        count_true(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("pages"))
    known = F.col("year").isNotNull()
    best = scored.groupBy("doc_id", "page_num").agg(
        F.max(F.when(known, F.struct("score", (-F.col("seq")).alias("early"), "year"))).alias("b"), F.sum("pages").alias("pages"))
    votes = best.groupBy("doc_id", F.col("b.year").alias("year")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("page_num").alias("first_page"),
        F.sum(F.round("b.score", 2)).alias("weight"), F.sum("pages").alias("pages"))
    winner = votes.groupBy("doc_id").agg(
        F.max(F.when(known, F.struct("votes", (-F.col("first_page")).alias("early"), "year"))).alias("w"),
        F.sum(F.when(known, F.col("votes"))).alias("pages_found"), F.sum(F.when(known, F.col("weight"))).alias("weight"), F.sum("pages").alias("total_pages"))
    return winner.select(
        "doc_id", "total_pages", F.col("w.year").alias("most_common_year"),
        F.coalesce("pages_found", F.lit(0)).alias("pages_found"),
        F.round(F.coalesce(F.col("weight") / F.col("pages_found"), F.lit(0.70)), 9).alias("confidence"))


def first_types(counts: DataFrame, kind: str, n: int = 3) -> DataFrame:
    """First ``n`` types of each document in first-seen order."""
    return first_rows(counts, ["doc_id"], ["first_page", kind], n)


def form_totals(forms: DataFrame) -> DataFrame:
    return forms.groupBy("form_type", "issuer").agg(
        F.count(F.lit(1)).alias("pages"), count_true(F.col("year").isNotNull()).alias("with_year"),
        F.round(F.avg("confidence"), 9).alias("mean_confidence"))
