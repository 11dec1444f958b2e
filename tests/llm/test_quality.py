import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality

from .conftest import HARD

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    runs = Counter(zip(words, words[1:], words[2:]))
    cover = {p + k for p in range(len(words) - 2) if runs[tuple(words[p:p + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def counts(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in df.collect()]


def test_counts_of_hard_rows(hard):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(counts(quality.measure(hard)), key=key) == sorted([(i, brute(t)) for i, t in HARD], key=key)


def test_counts_of_the_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert dict(counts(quality.measure(docs))) == {i: brute(t) for i, t in texts.items()}


@pytest.mark.parametrize("text", ["a b c a b c", "x x x x", "a b a b a b", "a\na\n b\n a\n", "q w e r q w e t w e r"])
def test_small_texts(docs, text):
    assert counts(quality.measure(docs([(1, text)])))[0][1] == brute(text)


def test_estimates_equal_a_plain_loop(spark, monkeypatch):
    """Expectation-maximisation over rows, in Python, gives the same rates as over counted patterns."""
    monkeypatch.setattr(quality, "SETTLED", 0)
    rows = [(1, 1, 1)] * 60 + [(-1, -1, 0)] * 9 + [(-1, 1, 1)] * 4 + [(0, 1, 0)] * 20 + [(1, -1, -1)] * 3
    names = ["p", "q", "r"]
    model = quality.fit(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), names, rounds=6)
    share, chance = quality.GOOD_SHARE, {(n, y): {1: on[0], -1: on[1], 0: 1 - sum(on)} for n in names for y, on in ((1, quality.ON_GOOD), (0, quality.ON_BAD))}
    start = {k: dict(v) for k, v in chance.items()}
    for _ in range(6):
        post = []
        for row in rows:
            good, bad = share, 1 - share
            for n, v in zip(names, row):
                good, bad = good * chance[n, 1][v], bad * chance[n, 0][v]
            post.append(good / (good + bad))
        total = {1: sum(post), 0: len(rows) - sum(post)}
        share = (total[1] + quality.PRIOR_VOTES * quality.GOOD_SHARE) / (len(rows) + quality.PRIOR_VOTES)
        for k, n in enumerate(names):
            for y in (1, 0):
                chance[n, y] = {v: (sum(p if y else 1 - p for p, row in zip(post, rows) if row[k] == v) + quality.PRIOR_VOTES * start[n, y][v]) / (total[y] + quality.PRIOR_VOTES) for v in (1, -1, 0)}
    assert model.good_share == pytest.approx(share)
    assert all(model.chance[k][v] == pytest.approx(chance[k][v]) for k in chance for v in chance[k])


def test_verdicts_follow_the_labels(spark, data_dir):
    """Good texts stay, junk goes; labels are not an input."""
    judged = quality.judge(spark.read.parquet(f"{data_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    rows = judged.join(labels, "doc_id").filter(~F.col("base_failed")).select("kept", "quality").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in rows)


def test_hard_rows_and_columns(hard, docs):
    judged = quality.judge(hard).collect()
    assert len(judged) == len(HARD) and all(r.kept in (True, False) and 0 <= r.probability <= 1 for r in judged)
    assert quality.judge(docs([])).count() == 0
    left = quality.keep_good(hard)
    assert left.columns == hard.columns


def test_no_python_in_the_plan(hard):
    plan = quality.measure(hard).withColumns(quality.rules())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def _prose(draw, script):
    """90 blank-separated words (or phrases, where a script has no blanks between words) of random letters."""
    first, marks, sizes, stops = {
        "korean": (range(0xAC00, 0xD7A4), [], (1, 5), ".,"), "arabic": ([*range(0x627, 0x63B), *range(0x641, 0x64B)], [0x64E, 0x650], (2, 7), "،."),
        "hebrew": (range(0x5D0, 0x5EB), [], (2, 7), ".,"), "hindi": (range(0x915, 0x93A), [0x93E, 0x93F, 0x940, 0x947, 0x94D], (2, 5), "।,"),
        "thai": (range(0xE01, 0xE2F), [0xE34, 0xE35, 0xE48], (8, 25), " "), "japanese": (range(0x3042, 0x3094), [], (10, 30), "。、"),
        "chinese": (range(0x4E00, 0x9FA0), [], (10, 30), "。，")}[script]
    words = []
    for i in range(90):
        word = "".join(chr(draw.choice(first)) + (chr(draw.choice(marks)) if marks and draw.random() < 0.5 else "") for _ in range(draw.randrange(*sizes)))
        words.append(word + (draw.choice(stops) if i % 7 == 6 else ""))
    return "\n".join(" ".join(words[k:k + 30]) for k in range(0, 90, 30))


def test_scripts_without_case_stay(spark, data_dir):
    """Clean texts without case stay in a corpus of mostly Latin script, and junk among them goes."""
    draw = random.Random(5)
    scripts = ["korean", "arabic", "hebrew", "hindi", "thai", "japanese", "chinese"]
    rows = [(-1 - i, _prose(draw, scripts[i % 7])) for i in range(21)]
    junk = [(-100 - i, "\n".join(" ".join(draw.choice(["$$$!!", "###?", "|||!", "가%%!", "나**!"]) for _ in range(12)) for _ in range(8))) for i in range(5)]
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    judged = {r.doc_id: r for r in quality.judge(docs.union(spark.createDataFrame(rows + junk, docs.schema))).filter("doc_id < 0").collect()}
    assert [(scripts[i % 7], judged[-1 - i].probability) for i in range(21) if not judged[-1 - i].kept] == []
    assert all(judged[-1 - i].plain is None and judged[-1 - i].word_length is None for i in range(21))
    assert not any(judged[k].kept for k, _ in junk)


def test_words_of_any_script_are_plain(docs):
    texts = ["한국어 문장, abc", "हिन्दी भाषा. Abc", "עברית ABC aBc"]
    assert [r.n_plain for r in quality.measure(docs(list(enumerate(texts, 2)))).orderBy("doc_id").collect()] == [3, 3, 1]


def test_good_rows_stay_without_a_shuffle(hard):
    """Rows are not shuffled to meet their verdicts, and those that stay are the ones that are judged so, repeated ones too."""
    twice = hard.union(hard)
    left = quality.keep_good(twice)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    want = [r.doc_id for r in quality.judge(twice).filter("kept").collect()]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in left.collect()) and left.schema == twice.schema
