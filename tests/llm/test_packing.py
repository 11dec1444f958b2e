import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import packing

from .conftest import HARD


@pytest.fixture(scope="module")
def model():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_units_give_the_ids_of_whole_texts(model):
    texts = ["", " ", "a", " a", "a b", "a  b", "a \n b", "a\n\nb", "it's, fine. ok.\nNext line", "x y z w", "end ", "a\tb c\r\nd", "1,2 3.4 é. ñ,", "\x00 q", "don't\x1c we",
             "<|endoftext|> here", "中文 字。 。", "a.b, c,.d ,e", "line \nx", "'s 's. 's,", "\n", "\n\na b", "a\u0085b c", "Éa. Ab."]
    ours = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in ours] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts, model, length=1024):
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append(np.array(model.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for key, tokens in ids.items():
        for size in {len(t) for t in tokens}:
            same = [t for t in tokens if len(t) == size]
            parts = sorted(pieces[key, size], key=lambda r: r.start)
            assert sum(r.length for r in parts) == size * len(same)
            for r in parts:
                assert r.ids_crc32 in {zlib.crc32(t[r.start:r.start + r.length].tobytes()) for t in same}
    total = sum(len(t) for x in ids.values() for t in x)
    assert sorted(sequences) == list(range(-(-total // length)))
    for number, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at == min(length, total - number * length)


def test_whole_table(spark, data_dir, model):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], model)
    # No queue strays more than a quantum from its share, however many windows have gone by.
    queues = sorted({r.queue for r in rows})
    got = np.zeros((max(r.sequence_id for r in rows) + 1, len(queues)))
    for r in rows:
        got[r.sequence_id, queues.index(r.queue)] += r.length
    served = got.cumsum(axis=0)
    wanted = np.outer(served.sum(axis=1), got.sum(axis=0) / got.sum())
    assert np.abs(served - wanted).max() <= packing.QUANTUM


def test_hard_rows(hard, docs, model):
    check(packing.pack(hard).collect(), HARD, model)
    assert packing.pack(docs([])).count() == 0


def test_targets_hold_until_a_queue_ends(docs):
    rows = packing.pack(docs([(3 * i + k, "word " * 400) for i in range(1, 41) for k in range(3)]), targets={"s0": 0.5, "s1": 0.25, "s2": 0.25}).collect()
    early = [r for r in rows if r.sequence_id < 20]
    share = {q: sum(r.length for r in early if r.queue == q) / 20 / 1024 for q in {r.queue for r in early}}
    assert sorted(share.values()) == pytest.approx([0.25, 0.25, 0.5], abs=0.02)


def test_more_sources_than_queues(docs, monkeypatch, model):
    monkeypatch.setattr(packing, "QUEUES", 1)
    texts = [(i, f"text {i} " * (i + 1)) for i in range(30)]
    check(packing.pack(docs(texts)).collect(), texts, model)


def test_places_are_a_permutation():
    draw = np.random.default_rng(1)
    for _ in range(20):
        totals = draw.integers(0, 3000, 5).tolist()
        schedule = packing.Schedule(totals, draw.random(5).tolist())
        queue = np.concatenate([np.full(-(-t // packing.QUANTUM), q) for q, t in enumerate(totals)])
        quantum = np.concatenate([np.arange(-(-t // packing.QUANTUM)) for t in totals])
        sizes = np.minimum(packing.QUANTUM, np.array(totals)[queue] - quantum * packing.QUANTUM)
        order = np.argsort(places := schedule.place(queue, quantum), kind="stable")
        assert (places[order] == np.cumsum(sizes[order]) - sizes[order]).all()


def test_added_tokens_have_their_ids(docs):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "no such token"), (4, "one line\nx<|endoftext|>y <|endoftext|"), (5, "a  b <|endoftext|>\n")]
    check(packing.pack(docs(texts)).collect(), texts, plain)


def test_units_of_letters_go_to_the_merges_and_are_forgotten_late(monkeypatch):
    """Words are encoded by the model's merges alone, with marks behind them apart; a full memory keeps what is met again."""
    monkeypatch.setattr(packing, "CACHED", 6)
    texts = ["the plain words, and *** marks... of the words", "l'été don't Straße— x̀ 한국 ½ 12th. the", "the plain! words?! again", "'s 'tis ʼn ǅ the", ""] * 3
    model = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), added=True)
    want, asked = model._encode(texts), []
    whole, model.known.model = model.model, type("Asked", (), {"encode_batch_fast": lambda self, x, **k: asked.extend(x) or whole.encode_batch_fast(x, **k)})()
    assert model.encode(texts) == want
    assert not {" plain", " words", "the"} & set(asked) and " 12th." in asked and " the" in model.known.before.keys() | model.known.keys()
