"""Token ids of whole texts.

The ids are those of ``tokenizers`` with ``byte_bpe_50k.json``. The bulk goes through ``tiktoken`` on the same vocabulary as ranks, measured 5 times
as fast and equal in every id (``tests/llm/test_packing.py``); a text that holds a special string goes through ``tokenizers`` itself, which reads it as that token.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, ranks_path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("same vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, ranks_path: str) -> Encoder:
    """One encoder per Python worker."""
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]


def vocabulary_paths(name: str = VOCABULARY) -> tuple[str, str]:
    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")
