"""Quality rules as weak supervision.

Each rule votes for a text, votes against it, or abstains. How far a rule can be
trusted is not set by hand: expectation-maximisation over the vote patterns of
the whole corpus estimates, for good and bad texts, how often each rule casts
each vote. A rule that cannot judge a text's script has no vote (NULL): that is
no evidence for either side and counts for no rate, unlike an abstention. A text
stays if its posterior probability of being good is high enough. All of it is
DataFrame functions; the loop handles one row per vote pattern (4 to the number
of rules at most), whatever the size of the corpus.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import let, settle
from leafmill.llm.shared import WORD, saved, whole

WINDOW = 3
#: A word as prose has it: lower case or without case but for its first letter, with one mark after it at most.
PLAIN_WORD = r"(?<![^ \t-\r])\p{L}[\p{Ll}\p{Lo}\p{Lm}\p{M}\x{200C}\x{200D}]*+[.,;:!?]?(?![^ \t-\r])"
#: Rounds at most, and the change of the rates at which they end.
ROUNDS, SETTLED = 25, 1e-5
#: Start of the estimates: share of good texts, and (for, against) votes of a rule on good and on bad texts.
#: Rules speak up against good texts rarely, and one kind of junk rarely breaks more than one rule.
GOOD_SHARE, ON_GOOD, ON_BAD = 0.8, (0.8, 0.005), (0.6, 0.2)
#: Votes that the start counts for, so that a rule without votes keeps it.
PRIOR_VOTES = 5.0


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in ``size``-word windows found twice or more in the text.
    Windows are compared by 64-bit hash, within one text only."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("h"), i.alias("p")))

    def repeats(windows: Column) -> Column:
        def at(j: Column) -> Column:
            same = (F.get(windows, j)["h"] == F.get(windows, j - 1)["h"]) | (F.get(windows, j)["h"] == F.get(windows, j + 1)["h"])
            return F.when(same, F.get(windows, j)["p"])
        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(windows) - 1), at))

    def covered(starts: Column) -> Column:
        fresh = F.transform(starts, lambda p, i: F.least(F.lit(size), p - F.coalesce(F.get(starts, i - 1), p - size)))
        return F.aggregate(fresh, F.lit(0), lambda total, n: total + n)

    found = let(F.sort_array(hashed), lambda windows: let(F.sort_array(repeats(windows)), covered))
    return F.when(F.size(words) >= size, found).otherwise(0).cast("long")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, hash and counts per text; a NULL text has no words and all counts 0. Other columns are not read."""
    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    rows = settle(rows, F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
                  F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    # Texts of one-byte characters have no letters without case, and their letters are not counted.
    wide = lambda pattern: F.when(F.octet_length("t") == F.char_length("t"), 0).otherwise(left(pattern)).cast("long")
    return rows.select(
        F.col("id").alias(key), F.xxhash64("t").alias("text_key"), F.size("words").cast("long").alias("n_words"),
        left(r"[ \t-\r]+").alias("word_chars"), left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), left("[^A-Z]+").alias("n_capitals"), left("[^!?]+").alias("n_shouts"),
        F.regexp_count("t", F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
        wide(r"[^\p{L}]+").alias("n_letters"), wide(r"[^\p{Lo}]+").alias("n_caseless"))


def _vote(against: Column, good: Column) -> Column:
    return F.when(F.col("n_words") == 0, 0).when(against, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes by rule: 1 for the text, -1 against it, 0 abstains. On texts without words all abstain. NULL: the
    rule does not apply, as rules on lower case and on the length of words where most letters have no case."""
    words, chars = F.col("n_words"), F.col("word_chars")
    cased = lambda vote: F.when(F.col("n_caseless") * 2 <= F.col("n_letters"), vote)
    return {
        "plain": cased(_vote(F.col("n_plain") * 10 < words * 6, F.col("n_plain") * 10 >= words * 9)),
        "symbols": _vote(F.col("n_symbols") * 10 >= words, F.col("n_symbols") * 50 <= words),
        "lines": _vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 >= F.col("n_lines") * 3), F.col("n_dup_lines") == 0),
        "repeats": _vote(F.col("n_repeat_words") * 10 >= words * 3, F.col("n_repeat_words") * 10 <= words),
        "word_length": cased(_vote((chars < words * 3) | (chars > words * 12), (chars >= words * 4) & (chars <= words * 9))),
        "capitals": _vote(F.col("n_capitals") * 10 >= chars * 3, F.col("n_capitals") * 10 <= chars),
        "shouting": _vote(F.col("n_shouts") * 10 >= words * 2, F.col("n_shouts") * 50 <= words),
    }


class VoteModel:
    """Share of good texts, and per rule the chance of each vote on good and bad texts."""

    def __init__(self, names: list[str]):
        self.names = names
        self.good_share = GOOD_SHARE
        self.chance = {(name, y): {1: on[0], -1: on[1], 0: 1 - sum(on)} for name in names for y, on in ((1, ON_GOOD), (0, ON_BAD))}

    def posterior(self) -> Column:
        """Probability that a text with these votes is good."""
        def evidence(name: str) -> Column:
            odds = {v: math.log(self.chance[name, 1][v] / self.chance[name, 0][v]) for v in (1, -1, 0)}
            return F.when(F.col(name) == 1, odds[1]).when(F.col(name) == -1, odds[-1]).when(F.col(name) == 0, odds[0]).otherwise(0.0)
        start = F.lit(math.log(self.good_share / (1 - self.good_share)))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, map(evidence, self.names), start)))

    def step(self, patterns: DataFrame) -> float:
        """One round: posteriors of the patterns, then the rates that they imply. Returns the largest change of a rate."""
        before = [self.good_share, *(p for rates in self.chance.values() for p in rates.values())]
        weighed = patterns.select("*", self.posterior().alias("_good"))
        share = {1: F.col("_rows") * F.col("_good"), 0: F.col("_rows") * (1 - F.col("_good"))}
        sums = [F.sum(w).alias(f"all_{y}") for y, w in share.items()]
        sums += [F.sum(F.when(F.col(name) == v, w)).alias(f"{name}_{y}_{v}") for name in self.names for y, w in share.items() for v in (1, -1, 0)]
        total = {k: v or 0.0 for k, v in weighed.agg(*sums).first().asDict().items()}
        self.good_share = (total["all_1"] + PRIOR_VOTES * GOOD_SHARE) / (total["all_1"] + total["all_0"] + PRIOR_VOTES)
        for name in self.names:
            for y, on in ((1, ON_GOOD), (0, ON_BAD)):
                start = {1: on[0], -1: on[1], 0: 1 - sum(on)}
                votes = sum(total[f"{name}_{y}_{v}"] for v in start)  # without the texts that the rule does not apply to
                self.chance[name, y] = {v: (total[f"{name}_{y}_{v}"] + PRIOR_VOTES * start[v]) / (votes + PRIOR_VOTES) for v in start}
        return max(abs(a - b) for a, b in zip(before, [self.good_share, *(p for rates in self.chance.values() for p in rates.values())]))


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over ``votes`` until the rates settle. Rows are first counted per vote pattern."""
    patterns = saved(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).coalesce(1), "patterns")
    model = VoteModel(names)
    for _ in range(rounds):
        if model.step(patterns) < SETTLED:
            break
    return model


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: key, ``text_key``, counts, ``base_failed``, ``probability`` of being good, ``kept``, and the votes.

    ``base_failed``: under 50 words, or over half of the words in repeated
    three-word windows. A text is kept if it does not fail that and its
    probability is at least ``least``. Repeated rows are judged alike. An empty
    table gives no rows.
    """
    names = list(rules())
    votes = saved(measure(docs, key, text).withColumns(rules()), "votes")
    model = fit(votes, names, rounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (votes.withColumn("base_failed", failed).withColumn("probability", model.posterior())
            .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least)))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Rows are written once with their votes
    and go or stay where they are; they are not shuffled to meet their verdicts."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select(F.struct(*names).alias("row"), F.col(names[docs.columns.index(text)]).alias("text"))
    return judge(rows, "row", "text").filter("kept").select(*[F.col("row")[n].alias(n) for n in names]).toDF(*docs.columns)
