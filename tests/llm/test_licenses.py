import itertools
import random
import re

import pytest

from leafmill.llm import licenses

from .conftest import HARD


def as_pattern(template):
    """The template as a regular expression over words with a blank after each."""
    out = ""
    for close, mark, low, high, word in licenses._MARK.findall(template):
        out += "".join(re.escape(w.decode()) + " " for w in licenses.words_of(word)) if word else f"(?:[^ ]+ ){{{low},{high}}}" if mark == "var" else ")?" if close else "(?:"
    return re.compile(out)


def test_automaton_equals_patterns():
    draw, names = random.Random(4), licenses.TEMPLATES
    compiled = {label: [as_pattern(t) for t in texts] for label, texts in names.items()}
    automaton = licenses.Automaton(names)
    vocabulary = sorted({w for t in itertools.chain(*names.values()) for w in t.split() if "<" not in w}) + ["foo", "bar"]
    for _ in range(3000):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(4))]
        source = re.sub(r"<<var (\d)-(\d)>>", lambda m: "foo " * draw.randint(0, 4), draw.choice(draw.choice(list(names.values()))))
        inner = re.sub(r"<<optional>>(\w+)<</optional>>", lambda m: m[1] if draw.random() < 0.5 else "", source)
        inner = re.sub(r"<<optional>>([^<]*)<</optional>>", lambda m: m[1] if draw.random() < 0.5 else "", inner)
        words += re.sub("<<[^>]*>>", "", inner).split() + [draw.choice(vocabulary)]
        if draw.random() < 0.3:
            words.pop(draw.randrange(len(words)))
        text = " ".join(words) + " "
        want = {label for label, patterns in compiled.items() if any(re.search("(?:^| )" + p.pattern, text) for p in patterns)}
        assert {automaton.templates[t].label for t, _, _ in automaton.scan([w.encode() for w in words])} == want, text


@pytest.mark.parametrize("text,labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("licensed under the gnu general public license version 2", "gpl"),
    ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("CC-BY cc by", "cc-by"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("licensed under the apache license, version 3.0", "apache"), ("éMIT license", "")])
def test_labels(docs, text, labels):
    assert licenses.scan(docs([(1, text)])).first().labels == labels


def test_places_and_hard_rows(hard, docs):
    row = licenses.scan(docs([(1, "x MIT License; mit license\x7fcc by cc by, 4")])).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.score) == (10, 4, 1, 7, "cc-by,mit", 0.5)
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in licenses.scan(hard).collect()}
    assert got == {(i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else t)), 0, None, "", 0.0) for i, t in HARD}
    assert licenses.scan(docs([])).count() == 0
