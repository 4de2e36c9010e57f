"""Byte-level BPE files of the tokenizers library, run by tiktoken.

The ids are those of the library: the same vocabulary, merge ranks, splitting
pattern and special tokens, which tiktoken runs in a fifth of the time. Texts
with long runs of white space, which its splitting may refuse, and files whose
splitting, normaliser or special tokens differ are left to tokenizers.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers

LONG_SPACE = re.compile(r"\s{4096}")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def is_usual(spec: dict) -> bool:
    """Whether a file splits by the usual pattern and has no tokens but special ones besides its merges."""
    split, core = spec.get("pre_tokenizer") or {}, spec["model"]
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    bare = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return bool(usual and bare and not spec.get("normalizer") and core["type"] == "BPE" and not core.get("dropout") and not core.get("ignore_merges"))


class ByteBpe:
    """Ids of texts. ``plain_specials`` takes the strings of special tokens for plain text; by default they are tokens."""

    def __init__(self, path: str, plain_specials: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.found = set() if plain_specials else set(self.specials)
        self.fast = None
        if is_usual(spec):
            byte = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if self.fast is None or LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        # the search for special tokens costs a quarter of the time
        allowed = {s for s in self.found if s in text}
        return self.fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; special tokens are their own strings."""
        byte = {c: b for b, c in byte_letters().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        found = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            found[i] = token.encode() if token in self.specials else bytes(byte[c] for c in token)
        return found


@lru_cache(maxsize=2)
def byte_bpe_of(path: str, plain_specials: bool = False) -> ByteBpe:
    """The encoder of a worker, kept for its next tasks."""
    return ByteBpe(path, plain_specials)
