"""Token ids of texts by the public byte-level BPE vocabulary.

The two vocabulary files hold the same tokens: the JSON one is the definition, the rank file feeds the faster
encoder. The definition's splitting pattern looks ahead only inside runs of two or more white-space characters;
texts are cut there first, and the parts go through the same pattern without lookahead, which is quicker.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

#: The id that ends every document.
END = 1
#: Fixed: Unicode white space.
WHITE = "\t-\r \x85\xa0  -     　"
#: Before the last character of a run of white space that text follows.
CUT = re.compile(f"(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")
#: Fixed: how the vocabulary splits text, without the lookahead.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_ENCODERS: dict[tuple, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text as little-endian unsigned numbers; 16 bits hold this vocabulary."""

    def __init__(self, json_path: str, rank_path: str):
        import tiktoken

        self.json_path, self._exact = json_path, None
        with open(json_path, encoding="utf-8") as f:
            defined = json.load(f)
        added = sorted(t["content"] for t in defined.get("added_tokens", ()))
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = 1 + max([*defined["model"]["vocab"].values(), *(t["id"] for t in defined.get("added_tokens", ()))])
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")

    @property
    def exact(self):
        """The defining tokenizer, for texts that hold its special strings."""
        if self._exact is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._exact = Tokenizer.from_file(self.json_path)
        return self._exact

    def plain(self, text: str) -> list[int]:
        """The ids of the text; special strings in it are plain text."""
        cuts = [m.start() for m in CUT.finditer(text)]
        if not cuts:
            return self.encode(text)
        out = []
        for start, end in zip([0, *cuts], [*cuts, len(text)]):
            out += self.encode(text[start:end])
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of the text and the end id."""
        text = text or ""
        if self.special is not None and self.special.search(text):
            out = self.exact.encode(text, add_special_tokens=False).ids
        else:
            out = self.plain(text)
        out.append(END)
        return np.array(out, dtype=self.dtype)


def encoder(json_path: str, rank_path: str) -> Encoder:
    """One encoder per worker process."""
    key = (json_path, rank_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(json_path, rank_path)
    return _ENCODERS[key]
