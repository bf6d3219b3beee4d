"""Token ids of texts by the tokenizers library, each distinct chunk encoded once.

A byte-level BPE vocabulary never joins characters across the start of a run of white space, so a text can be
cut there, and equal chunks have equal ids. Before that texts are cut at the vocabulary's special tokens, as white space
before one ends a text of its own. Vocabularies built otherwise are encoded text by text.
"""

from __future__ import annotations

import json
import re
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

#: The characters of Unicode's White_Space property.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters (all of them of Unicode category L) that a word may be cut after, where an ASCII sign that is no letter follows:
#: the vocabulary's own pattern ends a run of letters there too.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
CHUNK = re.compile(f" ?[{LETTER}]++(?=[{WHITE}\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Inside a chunk: what Python splits lines at though Unicode has it as no white space, and what starts a special token.
ODD = re.compile("[\x1c-\x1f|]")
KEPT, LONG, AT_ONCE = 800_000, 64, 2_000

#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others in turn for the signs from 256 on.
PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PLAIN)}
BLANK = chr(ALPHABET[32])

_encoders: dict[str, Encoder] = {}


class Encoder:
    """``ids`` gives for each text the little-endian bytes of its ids, of numpy type ``dtype``."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.newline = self.tokenizer.token_to_id("Ċ")
        self.by_chunk = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and self.newline is not None
        added = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)  # of several the longest
        self.by_chunk &= not any(t[c] for t in made["added_tokens"] for c in ("lstrip", "rstrip", "single_word"))
        self.special = re.compile(f"({'|'.join(map(re.escape, added))})") if added else None
        self.known: dict[str, bytes] = {t: self.whole(t) for t in added}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Letters after at most one blank are never split, so the library's model takes them without the split by patterns.

        Other chunks without white space inside go to the library as the lines of one text.
        """
        tokenize, known, plain = self.tokenizer.model.tokenize, self.known, []
        words, made, ends = [], [], [0]
        for c in chunks:
            if len(c) <= LONG and (c[1:] if c[0] == " " else c).isalpha():
                if c.isascii():
                    spelt = BLANK + c[1:] if c[0] == " " else c
                else:
                    spelt = c.encode().decode("latin-1").translate(ALPHABET)
                made += [t.id for t in tokenize(spelt)]
                words.append(c)
                ends.append(len(made))
            elif len(c) > LONG or c.isspace() or ODD.search(c):
                known[c] = self.whole(c)
            else:
                plain.append(c)
        raw, ends = np.array(made, self.dtype).tobytes(), [e * self.dtype.itemsize for e in ends]
        known.update((c, raw[a:b]) for c, a, b in zip(words, ends[:-1], ends[1:], strict=True))
        for at in range(0, len(plain), AT_ONCE):
            part = plain[at : at + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == self.newline)
            raw, width = ids.tobytes(), self.dtype.itemsize
            starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)]
            known.update((c, raw[a:b]) for c, a, b in zip(part, starts, ends, strict=True))

    def trim(self, most: int = KEPT // 4) -> None:
        """Forget chunks where there are more than ``most``; those that were met first are the frequent ones.

        Tasks do so when they end, as other operators use the same workers.
        """
        if len(self.known) > most:
            self.known = dict(islice(self.known.items(), KEPT // 4))

    def chunks(self, text: str) -> list[str]:
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return CHUNK.findall(text)
        return [c for k, part in enumerate(parts) for c in ([part] if k % 2 else CHUNK.findall(part))]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [self.whole(t) for t in texts]
        self.trim(KEPT)
        chunked = [self.chunks(t) for t in texts]
        fresh = set().union(*chunked).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        of = self.known.__getitem__
        return [b"".join(map(of, chunks)) for chunks in chunked]


def encoder(path: str) -> Encoder:
    """One encoder in each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
