"""Text rules as data: any number of patterns, for all tenants or for one.

Each pattern needs some literal text in whatever it matches. One gram of that literal, one that few rules share, is the
rule's anchor, and the anchors are an index: a text meets, by equality, only rules whose anchor it
holds, and only those patterns are run. So the plan is the same for ten rules and for ten thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Letters of an anchor. A rule whose literal is shorter is tried on every text.
ANCHOR = 4

_CUT = "\u0001"
#: What may be absent from a match, or is no plain letter: groups, classes, escapes, counted and optional letters, marks.
_ABSENT = [r"\((?:[^()\\]|\\.)*\)(?:[?*+]|\{[^}]*\})?[?+]?", r"\[(?:[^\]\\]|\\.)*\](?:[?*+]|\{[^}]*\})?[?+]?", r"\\.(?:[?*+]|\{[^}]*\})?[?+]?", r".\{[^}]*\}[?+]?", r".[?*][?+]?", r"[.^$+]"]


def required_literal(pattern: str | Column) -> Column:
    """The longest text that every match of a lower-cased pattern holds, as far as plain reading tells; empty for
    patterns with alternatives outside a group, or groups within groups."""
    left = F.col(pattern) if isinstance(pattern, str) else pattern
    for part in _ABSENT:
        left = F.regexp_replace(left, part, _CUT)
    pieces = F.split(left, _CUT)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("piece"))))["piece"]
    return F.when(left.rlike(r"[()\[\]{}|\\]"), "").otherwise(longest)


def is_pattern(pattern: str | Column) -> Column:
    """True for a pattern that can be compiled."""
    column = F.col(pattern) if isinstance(pattern, str) else pattern
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), column).isNotNull()


def lowest_ranks(rules: DataFrame) -> DataFrame:
    """Of the rules with one tenant, category and pattern that of the lowest rank: all that ``first_matches`` can name."""
    return rules.groupBy("tenant", "category", "pattern").agg(F.min("rank").alias("rank"))


def compiled(rules: DataFrame) -> DataFrame:
    """(of, pattern, literal, anchor): each pattern of a tenant once, whatever number of rules have it. Patterns that are NULL or
    cannot be compiled are left out. ``of`` NULL is for all."""
    sound = rules.filter(F.col("pattern").isNotNull()).select(F.col("tenant").cast("string").alias("of"), "pattern").distinct()
    sound = sound.filter(is_pattern("pattern")).withColumn("literal", required_literal("pattern"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length("literal") - ANCHOR + 1), lambda at: F.substring("literal", at, F.lit(ANCHOR)))
    spread = sound.withColumn("gram", F.explode(F.when(F.char_length("literal") >= ANCHOR, F.array_distinct(grams)).otherwise(F.array(F.lit("")))))
    # Counted by a window and not by a join, after which Spark would take a small index for a large one.
    counted = spread.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    return counted.groupBy("of", "pattern", "literal").agg(F.min(F.struct("n", "gram"))["gram"].alias("anchor"))


def rule_matches(texts: DataFrame, rules: DataFrame, key: str, text: str = "text", tenant: str | None = None) -> DataFrame:
    """(key, category, rank, pattern, points): every rule that a text, lower-cased, matches.

    ``rules`` have tenant (NULL is for all), category, rank, pattern and perhaps ``points``, which count 1 else. ``key`` is
    unique per text. Rules of a tenant apply to texts whose ``tenant`` column has its name. NULL texts match
    nothing. Only texts are multiplied, by their anchors in the index, which is broadcast below Spark's threshold;
    the texts never are. A pattern is run once per text that holds its anchor, then its rules are looked up.
    """
    low = F.lower(text)
    owner = F.col(tenant).cast("string") if tenant else F.lit(None).cast("string")
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("__key"), owner.alias("__owner"), low.alias("__low"))
    size = F.char_length("__low")
    grams = F.when(size >= ANCHOR, F.transform(F.sequence(F.lit(1), F.greatest(size - ANCHOR + 1, F.lit(1))), lambda at: F.substring("__low", at, F.lit(ANCHOR)))).otherwise(F.array())
    held = rows.withColumn("__gram", F.explode(F.array_distinct(F.array_append(grams, F.lit("")))))
    owners = F.array_distinct(F.array(F.lit(None).cast("string"), F.col("__owner")))
    held = held.withColumn("__of", F.explode(owners) if tenant else F.lit(None).cast("string"))
    # An outer join, for which Spark can broadcast the index only: it knows the size of the texts, not that of all their grams.
    able = (F.col("__gram") == F.col("anchor")) & F.col("__of").eqNullSafe(F.col("of"))
    hit = F.col("__low").contains(F.col("literal")) & F.regexp_like("__low", F.col("pattern"))
    found = held.join(compiled(rules), able, "left_outer").filter(F.coalesce(hit, F.lit(False))).select("__key", F.col("of").alias("__of"), F.col("pattern").alias("__pattern"))
    points = F.coalesce("points", F.lit(1)) if "points" in rules.columns else F.lit(1)
    named = rules.select(F.col("tenant").cast("string").alias("of"), "category", "rank", "pattern", points.alias("points"))
    # Patterns found are not NULL; a plain equality would say so, and Spark would take the outer join for an inner one.
    same = F.col("__pattern").eqNullSafe(F.col("pattern")) & F.col("__of").eqNullSafe(F.col("of"))
    return found.join(named, same).select(F.col("__key").alias(key), "category", "rank", "pattern", "points")


def first_matches(matches: DataFrame, key: str) -> DataFrame:
    """(key, category, pattern): of the rules of a category that a text matches, the one of the lowest rank."""
    return matches.groupBy(key, "category").agg(F.min(F.struct("rank", "pattern"))["pattern"].alias("pattern"))


def best_categories(matches: DataFrame, key: str) -> DataFrame:
    """(key, category, score): the category with the most points; of several the one whose first rule ranks lowest. ``rank``
    must tell the rules of all categories apart, in the order of the categories."""
    scores = matches.groupBy(key, "category").agg(F.sum("points").alias("score"), F.min("rank").alias("first"))
    best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("first")).alias("early"), "category")).alias("b"))
    return best.select(key, "b.category", "b.score")
