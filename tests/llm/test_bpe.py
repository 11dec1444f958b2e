import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from leafmill.llm import bpe

from .conftest import HARD

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_random_texts(library):
    draw = random.Random(5)
    texts = ["".join(draw.choice("aeinrst \n\té中\U0001f600'.,12") for _ in range(draw.randrange(90))) for _ in range(800)]
    texts += ["a" * 3000, " " * 700 + "x", "<|endoftext|>", "é" * 900, "ab" * 1000, "", "\x00", "a  b \n c "]
    model = bpe.Bpe(PATH, public_tokenizers.PATTERN)
    ids = model.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [model.decode(x) for x in ids] == [t.encode() for t in texts]


def test_other_patterns_are_not_cut_at_blanks():
    model, pattern = bpe.Bpe(PATH, r"\S+|\s+"), r"\S+|\s+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=model.ranks, special_tokens={})
    texts = ["it's a test, of  blanks", " x y "]
    assert [x.tolist() for x in model.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    model, texts = bpe.Bpe(PATH, public_tokenizers.PATTERN), [f"some words of text {i} and more" for i in range(40)]
    for k in range(0, 40, 4):
        assert [x.tolist() for x in model.encode(texts[k:k + 4])] == [library.encode_ordinary(t) for t in texts[k:k + 4]]


def expected(rows, library):
    out = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_round_trip(spark, data_dir, hard, docs, library):
    table = spark.read.parquet(f"{data_dir}/documents.parquet")
    for frame, rows in ((table, [(r.doc_id, r.text) for r in table.collect()]), (hard, HARD), (docs([]), [])):
        assert sorted((tuple(r) for r in bpe.round_trip(frame).collect()), key=repr) == expected(rows, library)


def test_ids_of_texts(hard, library):
    assert sorted(((r.doc_id, list(r.ids)) for r in bpe.tokenized(hard).collect()), key=repr) == sorted(((i, library.encode_ordinary(t or "")) for i, t in HARD), key=repr)
