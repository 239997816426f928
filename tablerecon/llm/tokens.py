"""Token ids of whole texts, fast enough for Arrow batches.

The vocabulary file is a byte-level BPE in the ``tokenizers`` JSON format.  Its
pre-tokenizer looks ahead only to leave the last white space of a run to the word
behind it.  A text is cut at these places, so that a pattern without look-ahead, which
runs as one automaton, takes the same pre-tokens.  Nothing is remembered between texts:
a new word costs as much as a known one.  Results equal encoding the whole text with
the ``tokenizers`` library, which finds the vocabulary's added tokens first: a text
that spells one out holds its id there, unless they are asked to be plain text.
"""

from __future__ import annotations

import json
import re
from array import array

# The pre-tokenizer's pattern without `\s+(?!\S)`, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
FAR_WHITE = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = "\t-\r \x85\xa0" + FAR_WHITE

_RUNS = re.compile(f"[{WHITE}]{{2,}}")


def _byte_of_sign() -> dict[str, int]:
    """The format writes printable bytes as themselves and the others as signs from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str, added_tokens: bool = True) -> None:
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        signs = _byte_of_sign()
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        special = {t["content"] for t in added}
        self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest_first = sorted(map(re.escape, special), key=len, reverse=True)
        self._spelled = re.compile(f"({'|'.join(longest_first)})") if special and added_tokens else None
        ranks = {
            bytes(signs[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in special
        }
        coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids = coder.encode_ordinary

    def _with_added(self, text: str) -> bytes:
        """Added tokens as they stand, what lies between them as texts of their own."""
        pieces = self._spelled.split(text)
        return b"".join(self._added[p] if i % 2 else self._any(p) for i, p in enumerate(pieces))

    def _any(self, text: str) -> bytes:
        out, at = array("I"), 0
        for run in _RUNS.finditer(text):
            if run.end() < len(text):
                # the run but its last sign is a pre-token; the last sign begins the next part
                for end in (run.start(), run.end() - 1):
                    out += array("I", self._ids(text[at:end]))
                    at = end
        out += array("I", self._ids(text[at:]))
        return out.tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(text) for text in texts]

    def encode(self, text: str) -> bytes:
        if self._spelled and any(t in text for t in self._added):
            return self._with_added(text)
        return self._any(text)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: str, added_tokens: bool = True) -> Encoder:
    """One per worker process."""
    key = (vocabulary, added_tokens)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, added_tokens)
    return _ENCODERS[key]
