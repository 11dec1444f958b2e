"""Rules as data against plain loops, and rows of any rank."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import classify
from leafmill.operators import logs, rule_tables
from leafmill.operators.requests import match_requests_fifo
from leafmill.plans.ranges import first_rows, in_ranges
from leafmill.registry import Inputs, load_all
from leafmill.streaming import sessions

QUERIES = load_all()
RULES = "tenant string, category string, rank int, pattern string, points int"
PATTERNS = ["typeerror", "a(b|c)d", "x?yz+", "foo.*bar", "one|two", r"\bword\b", r"w\.z", "q{0,2}rst", "(a(b)c)?tail", "[abc]lmno", "^start", "end$", "no", "(unclosed", "", r"\d{3}", "caf[ée]s", "(?:opt)?must"]


def test_literals_are_required(spark):
    draw = random.Random(1)
    frame = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    rows = frame.select("pattern", rule_tables.required_literal("pattern").alias("literal"), rule_tables.is_pattern("pattern").alias("sound")).collect()
    texts = ["".join(draw.choice(["a", "b", "c", "d", "x", "yz", "zz", "foo", "bar", "one", "two", " word ", "w.z", "rst", "tail", "clmno", "start", "no", "123", "cafés", "must", "end"]) for _ in range(draw.randrange(6))) for _ in range(400)]
    for r in rows:
        assert r.sound == (r.pattern != "(unclosed")
        if r.sound:
            assert all(r.literal in t for t in texts if re.search(r.pattern, t))
    found = {r.pattern: r.literal for r in rows}
    assert found["foo.*bar"] == "foo" and found["one|two"] == "" and found["typeerror"] == "typeerror" and found["q{0,2}rst"] == "rst" and found["(?:opt)?must"] == "must"


def test_matches_equal_a_plain_loop(spark):
    draw = random.Random(2)
    sound = [p for p in PATTERNS if p != "(unclosed"]
    rules = [(draw.choice([None, "t1", "t2"]), draw.choice("AB"), n, draw.choice(sound), draw.randrange(1, 4)) for n in range(120)]
    rules += [("t1", "A", 500, "(unclosed", 1), ("t1", "A", 501, None, 1)]
    texts = [(i, draw.choice(["t1", "t2", "t3", None]), "".join(draw.choice(["TypeError", "abd", "yz", "foo", "bar", "two", " word", "w.z", "rst", "tail", "blmno", "12", "no", ""]) for _ in range(draw.randrange(5)))) for i in range(150)]
    texts += [(900, "t1", None), (901, "t1", "")]
    frame, table = spark.createDataFrame(texts, "seq long, who string, text string"), spark.createDataFrame(rules, RULES)
    want = {(i, c, n, p) for i, who, t in texts if t is not None for owner, c, n, p, _ in rules
            if p is not None and p != "(unclosed" and owner in (None, who) and re.search(p, t.lower())}
    matches = rule_tables.rule_matches(frame, table, "seq", tenant="who")
    got = [(r.seq, r.category, r["rank"], r.pattern) for r in matches.collect()]
    assert set(got) == want and len(got) == len(want) > 100
    first = {(r.seq, r.category): r.pattern for r in rule_tables.first_matches(matches, "seq").collect()}
    assert first == {(i, c): min((n, p) for j, d, n, p in want if (j, d) == (i, c))[1] for i, c, _, _ in want}
    points = {n: x for _, _, n, _, x in rules}
    scores = {}
    for i, c, n, _ in want:
        total, low = scores.get((i, c), (0, n))
        scores[i, c] = (total + points[n], min(low, n))
    best = {r.seq: (r.category, r.score) for r in rule_tables.best_categories(matches, "seq").collect()}
    for i in {i for i, *_ in want}:
        top = max((s, -low, c) for (j, c), (s, low) in scores.items() if j == i)
        assert best[i] == (top[2], top[0])


def test_rules_as_data_equal_the_constants(spark, data_dir):
    rows = Inputs(spark, data_dir).view("console_logs")
    rules = [(None, c, n, p, 1) for n, (c, p) in enumerate((c, p) for c, ps in logs.ISSUE_PATTERNS.items() for p in ps)]
    got = rule_tables.first_matches(rule_tables.rule_matches(rows, spark.createDataFrame(rules, RULES), "seq"), "seq")
    want = logs.issue_hits(rows).select("seq", "category", "pattern")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0


def test_tax_form_scores_as_rules(spark):
    """Patterns of two points and words of one, as the scored classifiers have them."""
    rules, n = [], 0
    for code, patterns, words, _ in classify.TAX_FORMS:
        for points, group in ((2, patterns), (1, words)):
            for p in group:
                rules.append((None, code, n, p.lower(), points))
                n += 1
    texts = ["statement of investment income interest dividends", "employment insurance benefits paid ei", "relevé 1 revenu emploi quebec", "nothing here at all", "trust capital gains interest"]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    got = {r.seq: (r.category, r.score) for r in rule_tables.best_categories(rule_tables.rule_matches(frame, spark.createDataFrame(rules, RULES), "seq"), "seq").collect()}
    for i, text in enumerate(texts):
        score = [(sum(2 for p in ps if re.search(p, text, re.I)) + sum(1 for w in ws if re.search(w, text, re.I)), code) for code, ps, ws, _ in classify.TAX_FORMS]
        top = max(s for s, _ in score)
        assert got.get(i) == ((next(c for s, c in score if s == top), top) if top else None)


def test_the_plan_does_not_grow_with_the_rules(spark):
    texts = spark.createDataFrame([(1, "a typeerror")], "seq long, text string")

    def plan(n):
        rules = spark.range(n).selectExpr("cast(null AS string) AS tenant", "'c' AS category", "cast(id AS int) AS rank", "concat('typeerror', id) AS pattern")
        return rule_tables.rule_matches(texts, rules, "seq")._jdf.queryExecution().optimizedPlan().toString()

    assert len(plan(5)) + 20 > len(plan(5000)) and "NestedLoop" not in plan(5)


@pytest.mark.parametrize("n", [1, 1500, 9000])
def test_rows_of_any_rank(spark, n):
    """One key has most rows, another is NULL."""
    frame = spark.range(8000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN 'b' ELSE 'a' END AS k", "id * 7919 % 8009 AS v", "id")
    got = first_rows(frame, ["k"], [F.desc("v")], n, ranges=16)
    assert got.columns == ["k", "v", "id", "rank"]
    rows = frame.collect()
    want = set()
    for k in (None, "a", "b"):
        want |= {(r.id, i + 1) for i, r in enumerate(sorted((r for r in rows if r.k == k), key=lambda r: -r.v)[:n])}
    found = [(r.id, r["rank"]) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_a_hot_hour_is_split(spark):
    """Half of all rows are one user's within one hour; no range has more than its share, and results are the same."""
    rows = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id % 50 END AS user_id", "id AS event_id",
                                        "timestamp_millis(1700000000000 + id * 7919 % 3600000) AS ts", "CASE id % 40 WHEN 1 THEN 'start' WHEN 7 THEN 'stop' WHEN 8 THEN 'start' END AS mark")
    sizes = [r["count"] for r in in_ranges(rows, ["user_id"], ["ts", "event_id"], 8).groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 6000 / 8
    for job in (lambda b: sessions.gap_sessions(rows, 2, b), lambda b: sessions.marked_sessions(rows, b)):
        got, want = job("range"), job("minute")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 10
    opened = rows.filter("event_id % 3 < 2").selectExpr("concat('/', user_id) AS url", "ts", "event_id AS seq")
    closed = rows.filter("event_id % 3 = 2").selectExpr("concat('/', user_id) AS url", "ts", "event_id AS seq", "'response' AS kind", "200 AS status")
    got, want = match_requests_fifo(opened, closed, block="range"), match_requests_fifo(opened, closed)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_texts_are_never_broadcast(spark, data_dir):
    """Spark knows the size of the texts but not that of all their grams, so a join that may choose would broadcast those."""
    for name in ("log_issues_by_rules", "tenant_rule_hits"):
        plan = QUERIES[name].build(Inputs(spark, data_dir))._jdf.queryExecution().executedPlan().toString()
        grams = [line for line in plan.splitlines() if "HashJoin" in line and "__gram" in line]
        assert len(grams) == 1 and "LeftOuter, BuildRight" in grams[0] or not grams and "SortMergeJoin [__gram" in plan


def test_rules_with_one_pattern_each_match(spark):
    """A pattern is run once per tenant, and all rules with it are found; the lowest ranks alone give the same first matches."""
    rules = [(t, c, n, "typeerror", n) for n, (t, c) in enumerate([(None, "A"), (None, "A"), ("t1", "A"), ("t1", "B"), ("t2", "B"), ("t1", "B")])]
    frame, table = spark.createDataFrame([(1, "t1", "a TypeError"), (2, None, "typeerror typeerror"), (3, "t2", "type")], "seq long, who string, text string"), spark.createDataFrame(rules, RULES)
    got = sorted((r.seq, r.category, r["rank"], r.points) for r in rule_tables.rule_matches(frame, table, "seq", tenant="who").collect())
    assert got == [(1, "A", 0, 0), (1, "A", 1, 1), (1, "A", 2, 2), (1, "B", 3, 3), (1, "B", 5, 5), (2, "A", 0, 0), (2, "A", 1, 1)]
    first = [rule_tables.first_matches(rule_tables.rule_matches(frame, t, "seq", tenant="who"), "seq") for t in (table, rule_tables.lowest_ranks(table))]
    assert first[0].exceptAll(first[1]).count() == 0 and first[1].exceptAll(first[0]).count() == 0 and first[0].count() == 3
