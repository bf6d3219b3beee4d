"""Chunks of texts are looked up once each."""

import public_tokenizers

from termloom.llm.bpe import Encoder


class Counted(dict):
    lookups = 0

    def get(self, *key):
        self.lookups += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.lookups += 1
        return super().__getitem__(key)


def test_one_lookup_a_chunk():
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.known = Counted(enc.known)
    texts = [" ".join(f"w{chr(97 + i % 26)}rd{chr(97 + i // 26)}é" for i in range(600)), "a  b\n<|endoftext|> c|d ñandú 12", "", " "]
    assert enc.ids(texts) == [enc.whole(t) for t in texts]
    assert enc.known.lookups <= sum(len(enc.chunks(t)) for t in texts)
