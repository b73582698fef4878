"""Benchmark decontamination against a plain search for every span."""

import hashlib
import random
import re

import numpy as np
import pytest

from forklore.llm import winnow

DOCS = "doc_id long, text string, t1 long, marks string, spans string, hash long, pos int, size int, item string"
ITEMS = "item_id long, text string, t1 long, digest string, spans string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, span):
    spans = {}
    for item_id, text in items:
        w = split(text)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    found = []
    for doc_id, text in docs:
        w = split(text)
        hit, named = set(), set()
        for size in {len(s) for s in spans}:
            for i in range(len(w) - size + 1):
                owners = spans.get(tuple(w[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    named |= owners
        ids = sorted(str(i) for i in named if i is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        found.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(map(repr, found))


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, "m", "s", 2, 3, 4, "i") for d in docs], DOCS),
        spark.createDataFrame([(*i, 1, "d", "s") for i in items], ITEMS),
    )


def tables(rng, short):
    """Few words, so that runs, ties and partial hits abound; passages between them; odd rows."""
    letters = ["a", "B", "c", "é", "7", "Ö"]
    items = [(i, " ".join(rng.choices(letters, k=rng.randint(10, 60)))) for i in range(20)]
    items += [(3, items[5][1]), (None, " ".join(rng.choices(letters, k=12))), (30, None), (31, " ,;"), (32, items[0][1])]
    if short:
        items += [(40, "Rare, word"), (41, "seven"), (42, " ".join(rng.choices(letters, k=8)))]
    docs = [(None, None), (1, ""), (2, None), (1, "a " * 200), (4, "x" * 10_000), (5, "rare WORD"), (6, "word rare seven")]
    for i in range(60):
        text = rng.choices(letters + ["zz", "seven"], k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            passage = re.split(r" ", rng.choice(items)[1] or "")
            first = rng.randrange(len(passage))
            at = rng.randint(0, len(text))
            text[at:at] = passage[first : first + rng.randint(5, 30)]
        docs.append((100 + i, rng.choice([" ", "\n", "--"]).join(text)))
    return docs + docs[-5:], items


@pytest.mark.parametrize("short,span,gram", [(False, 10, 5), (True, 10, 5), (True, 6, 3)])
def test_equals_plain_search(spark, short, span, gram):
    docs, items = tables(random.Random(span + short), short)
    found = winnow.decontaminate(*frames(spark, docs, items), span=span, gram=gram)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(docs, items, span)


def test_empty_tables(spark):
    docs, items = tables(random.Random(1), False)
    d, i = frames(spark, docs, items)
    assert winnow.decontaminate(d.limit(0), i).collect() == []
    assert not winnow.decontaminate(d, i.limit(0)).where("contaminated or n_hit > 0 or n_items > 0").count()


def test_words_of_long_texts_are_cut_nowhere(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choices("aB é9-.\n中", k=5000)) + "w" * 300
    whole = winnow.words(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(winnow, "PIECE", 64)
    pieces = winnow.words(np.frombuffer(text.encode(), np.uint8))
    assert whole[0].tobytes().decode().split() == split(text)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def test_every_shared_span_shares_a_kept_hash():
    rng = np.random.default_rng(2)
    for _ in range(300):
        span = rng.integers(0, 3, 10).astype(np.uint64)  # ties abound
        texts = [np.concatenate([rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint64), span,
                                 rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2)]
        one, two = (set(winnow.kept(t, 5, 6)[1].tolist()) for t in texts)
        assert one & two
