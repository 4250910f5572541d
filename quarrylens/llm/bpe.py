"""Token ids of a public byte-level BPE vocabulary, in Python workers."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Texts of these characters alone (Latin letters, marks, general punctuation, currency, arrows) get
#: the same ids from both libraries, and the ranked one is several times as fast.  Any other text
#: goes to the reference tokenizer, whose Unicode tables then decide.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞€←-↓−]")

_made: dict[str, Bpe] = {}


class Bpe:
    def __init__(self, name: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public.path(f"{name}.json"))
        self.slow.encode_special_tokens = True
        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = public.PATTERN

    def ids(self, text: str) -> np.ndarray:
        if _OTHER.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def bpe(name: str = VOCABULARY) -> Bpe:
    """One tokenizer a worker process."""
    if name not in _made:
        _made[name] = Bpe(name)
    return _made[name]
