"""Token ids of whole texts by a public byte-level BPE vocabulary.

The ids are those of the vocabulary's `tokenizers` file. They are computed by
tiktoken from the same vocabulary written as ranks, several times faster; the tests
hold one against the other. Text that spells a token which the `tokenizers` file adds
to the vocabulary is that token, as there; a vocabulary without such a file has none.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

#: Characters encoded at a time, so that a very long text needs no more memory.
_CHUNK = 1 << 20


class Encoder:
    def __init__(self, ranks_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))
        self._added = {text for text, _ in added}
        self.size = max([len(ranks), *(number + 1 for _, number in added)])
        self.ends_sentence = np.zeros(self.size + 2, bool)
        self.ends_sentence[[number for _, number in added]] = True
        for token, rank in ranks.items():
            self.ends_sentence[rank] = token.rstrip(b" \"')").endswith((b".", b"!", b"?", b"\n"))

    def _ids(self, text: str) -> np.ndarray:
        if any(x in text for x in self._added):
            return np.array(self._encoding.encode(text, allowed_special=self._added), np.uint32)
        return np.array(self._encoding.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids; a long text is cut before single spaces between visible characters, where tokens always end."""
        if len(text) <= _CHUNK:
            return self._ids(text)
        parts, at = [], 0
        while at < len(text):
            to = min(at + _CHUNK, len(text))
            while to < len(text) and not (text[to] == " " and not text[to - 1].isspace() and not text[to + 1 : to + 2].isspace() and to + 1 < len(text)):
                to += 1
            parts.append(self._ids(text[at:to]))
            at = to
        return np.concatenate(parts)


@lru_cache(maxsize=4)
def encoder(ranks_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(ranks_file, pattern, added)


def public(name: str, with_added: str | None = None) -> tuple:
    """(file, pattern, added tokens) of a public vocabulary of ranks; the added ones are those of a `tokenizers` file."""
    import public_tokenizers

    added = ()
    if with_added:
        with open(public_tokenizers.path(with_added), encoding="utf-8") as file:
            added = tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])
    return public_tokenizers.path(name), public_tokenizers.PATTERN, added
