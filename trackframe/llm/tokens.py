"""Byte-pair ids by a public vocabulary, loaded once in each Python worker.

The library that the vocabulary's own file is made for encodes some 1.3 MB a
second; the same vocabulary as ranks gives the same ids about five times as fast
(``tests/llm/test_packing.py`` compares them), so ranks are used. That file also
names added tokens, which are found in a text before it is split; ``added_tokens``
reads them.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import tiktoken


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the added tokens of a vocabulary's json file."""
    with open(path, encoding="utf-8") as f:
        return tuple((x["content"], x["id"]) for x in json.load(f)["added_tokens"])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The encoder of a file of base64 tokens and ranks. Strings that are not in ``added`` are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


def ids_of(text: str | None, path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> np.ndarray:
    """The ids of a text (null: empty) as unsigned 32-bit numbers; each string of ``added`` has its one id."""
    if not text:
        return np.empty(0, np.uint32)
    return encoder(path, pattern, added).encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.uint32)
