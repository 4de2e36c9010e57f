"""Subwords against a direct version; rejection of strangers; whole long texts."""

import random
from collections import Counter

import numpy as np
import pytest

from hearth.llm import langid

ALPHABETS = {"de": "aeinrstöü", "en": "aehinotw", "es": "acdeñoslá", "fr": "éèlmpqutu"}


def prose(rng, language, n, follow={}):
    """Words of a made language: every letter allows three others."""
    letters = ALPHABETS[language]
    if language not in follow:
        own = random.Random(language)
        follow[language] = {c: own.choices(letters, k=3) for c in letters}
    words = []
    for _ in range(n):
        word = rng.choice(letters)
        for _ in range(rng.randint(2, 8)):
            word += rng.choice(follow[language][word[-1]])
        words.append(word)
    return " ".join(words)


def row(language, text):
    return (language, *langid.bucket_counts(text), *langid.bucket_counts(langid.shuffled(text)))


def brute_subwords(text):
    """Buckets of n-grams one by one, with the mixing written out in plain integers."""
    letters = [ord(c) if c.isalpha() else 0 for c in f"\0{text.lower()}\0"]
    found = Counter()
    for n in langid.SIZES:
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if not (gram[0] if n == 1 else any(gram) if n == 2 else gram[1]):
                continue
            mixed = n * 0x27D4EB2F & 0xFFFFFFFF
            for k, c in enumerate(gram):
                mixed = (mixed ^ c) * int(langid.PRIMES[k]) & 0xFFFFFFFF
                mixed ^= mixed >> 15
            found[mixed >> (32 - langid.BUCKET_BITS)] += 1
    return found


@pytest.mark.parametrize("text", ["", "a", "ab", " a ", "12 !?", "Straße, naïve 3x!", "İstanbul ΟΔΟΣ", "x" * 40, "語 a\0b"])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_subwords_of_any_slices(text, size, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", size)
    buckets, counts = langid.bucket_counts(text)
    assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == brute_subwords(text)


def test_long_text_is_read_whole(monkeypatch):
    rng = random.Random(1)
    text = "".join(prose(rng, "en", 50) for _ in range(20)).replace(" ", "")
    whole = langid.bucket_counts(text)
    monkeypatch.setattr(langid, "SLICE", 100)
    assert all((a == b).all() for a, b in zip(whole, langid.bucket_counts(text), strict=True))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(x, prose(rng, x, rng.choice([3, 20, 60, 200]))) for _ in range(120) for x in ALPHABETS]


def test_members_stay(corpus):
    model = langid.train([row(*r) for r in corpus])
    rng = random.Random(6)
    fresh = [(x, prose(rng, x, 60)) for _ in range(100) for x in ALPHABETS]
    found = [model.predict(text) for _, text in fresh]
    assert np.mean([f[2] and f[0] == x for f, (x, _) in zip(found, fresh, strict=True)]) >= 0.99
    assert all(0 <= f[1] <= 1 for f in found)


@pytest.mark.parametrize("language", ALPHABETS)
def test_unlearned_language_is_rejected(corpus, language):
    model = langid.train([row(*r) for r in corpus if r[0] != language])
    rng = random.Random(7)
    assert np.mean([model.predict(prose(rng, language, 60))[2] for _ in range(100)]) <= 0.02
    assert np.mean([model.predict(text)[2] for x, text in corpus if x != language]) >= 0.99


def test_noise_is_rejected(corpus):
    model = langid.train([row(*r) for r in corpus])
    rng = random.Random(8)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(100)]
    mixed = [langid.shuffled(prose(rng, "fr", 60)) for _ in range(100)]
    assert np.mean([model.predict(t)[2] for t in noise]) <= 0.02
    assert np.mean([model.predict(t)[2] for t in mixed]) <= 0.05
    assert not model.predict("这是一个用来测试语言识别的句子" * 4)[2]


def test_shuffled_keeps_places_and_letters():
    text = "Ab cd, 12 ef!"
    found = langid.shuffled(text)
    assert sorted(found) == sorted(text) and [c.isalpha() for c in found] == [c.isalpha() for c in text]


def test_one_language_and_one_row():
    model = langid.train([row("en", "hello world")])
    assert model.predict("hello world")[0] == "en" and model.predict("")[:2] == ("und", 0.0)


def test_texts_of_several_learnt_languages_stay(corpus):
    model = langid.train([row(*r) for r in corpus])
    rng = random.Random(9)
    mixed = [f"{prose(rng, a, 60)} {prose(rng, b, 40)}" for a in ALPHABETS for b in ALPHABETS for _ in range(10)]
    assert np.mean([model.predict(t)[2] for t in mixed]) >= 0.99
