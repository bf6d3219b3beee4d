"""Hashes of words, each looked up once."""

import numpy as np
import xxhash

from termloom.llm import leaks


class Counted(leaks.Hashes):
    lookups = 0

    def get(self, *key):
        self.lookups += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.lookups += 1
        return super().__getitem__(key)

    def __setitem__(self, key, value):
        self.lookups += 1
        super().__setitem__(key, value)


def test_a_new_word_is_hashed_once(monkeypatch):
    monkeypatch.setattr(leaks, "_words", Counted())
    words = [f"wörd{i % 7}" for i in range(500)]
    assert np.array_equal(leaks.hashed(" ".join(words).upper()), np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint32))
    assert leaks._words.lookups == 507
    assert len(leaks.hashed(None)) == len(leaks.hashed(" .")) == 0


def test_texts_are_hashed_together(monkeypatch):
    """Words of every length and script have the library's hash without a lookup for each; only a very long text goes word by word."""
    monkeypatch.setattr(leaks, "_words", Counted())
    signs = list("aZ09_é߀Ωß語𝒜٣")
    rng = np.random.default_rng(5)
    texts = [" ,".join("".join(rng.choice(signs, n)) for n in range(1, 70)) for _ in range(20)]
    texts += [None, "", " \n\r\x85!", "İstanbul ΟΔΟΣ ΟΔΟΣ", "ΑΣ\nΣ", "a\x00b\nc", "x" * 1000, "é ퟿", texts[0]]
    want = [np.array([xxhash.xxh32_intdigest(w) for w in leaks.WORD.findall((t or "").lower())], np.uint32) for t in texts]
    for most in (1 << 20, 3000):
        monkeypatch.setattr(leaks, "CHARACTERS", most)
        assert all(map(np.array_equal, leaks.hashed_all(texts), want)) and len(list(leaks.hashed_all(texts))) == len(want)
    assert leaks._words.lookups == 0
    monkeypatch.setattr(leaks, "CHARACTERS", 100)
    assert all(map(np.array_equal, leaks.hashed_all(texts), want)) and leaks._words.lookups > 0
