"""Token ids of a byte-level BPE vocabulary file, fast enough for whole corpora.

For counting, texts are cut where white space begins, which no token crosses; the few hundred thousand pieces
that fill most texts are then looked up, and only new ones are merged. The file is in the format
of the ``tokenizers`` library, and the ids are the ones that library gives; ``load`` also gives
the markers in a text (``added_tokens``) their own ids, as the library does by itself.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

#: Unicode's white space, which the pre-tokenizer's pattern means; Python's own class has four signs more.
WHITE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
SAFE_CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: After a closing sign before white space; after a new line that a piece ends with.
SENTENCE_END = re.compile(f"[.!?\n。](?:(?<!\n)(?=[{WHITE}]|\\Z)|(?<=\n)(?=[{WHITE}]?[^{WHITE}]|\\Z))")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT = 1 << 20
#: Pieces a worker remembers, about 150 bytes each; beyond that it starts anew.
REMEMBERED = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str, markers: bool = False):
        """Without ``markers`` a marker is text like any other, as with the library's ``encode_special_tokens``."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        special = {token["content"] for token in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the order of merges is not the order of ids")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        self._sizes = [0] * (1 + max(vocabulary.values(), default=0))  # bytes of each token
        for raw, i in ranks.items():
            self._sizes[i] = len(raw)
        self._marker_ids: dict[str, bytes] = {}
        for token in spec["added_tokens"] if markers else []:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"the marker {token['content']} takes more than its own letters")
            self._marker_ids[token["content"]] = array("I", [token["id"]]).tobytes()
        longest_first = sorted(self._marker_ids, key=len, reverse=True)
        self._marker = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def _pieces(self, text: str) -> Iterator[tuple[list[str], list[bytes]]]:
        """Pieces and their ids; what lies between two markers is a text of its own."""
        if self._marker is None or not any(m in text for m in self._marker_ids):
            yield from self._plain_pieces(text)
            return
        for i, part in enumerate(self._marker.split(text)):
            if i % 2:
                yield [part], [self._marker_ids[part]]
            elif part:
                yield from self._plain_pieces(part)

    def _plain_pieces(self, text: str) -> Iterator[tuple[list[str], list[bytes]]]:
        known, at = self._known, 0
        while at < len(text):
            cut = None if len(text) - at <= SEGMENT else SAFE_CUT.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            pieces = PIECE.findall(text[at:end] if at or cut else text)
            at = end
            try:
                yield pieces, list(map(known.__getitem__, pieces))
                continue
            except KeyError:
                pass
            if len(known) > REMEMBERED:
                known.clear()
            for piece in set(pieces).difference(known):
                known[piece] = array("I", self._encode(piece)).tobytes()
            yield pieces, list(map(known.__getitem__, pieces))

    def count(self, text: str) -> int:
        return sum(len(b"".join(ids)) for _, ids in self._pieces(text)) // 4

    def ids(self, text: str) -> bytes:
        """All ids as unsigned 32-bit integers, least byte first."""
        return b"".join(b"".join(ids) for _, ids in self._pieces(text))

    def ids_and_sentences(self, text: str):
        """The ids, and the number of ids before the end of each sentence.

        Whole stretches are merged at once: most pieces of a corpus are too rare for looking them up to pay.
        Sentences end at bytes, which the tokens' lengths turn into numbers of tokens.
        """
        import numpy as np

        if not isinstance(self._sizes, np.ndarray):
            self._sizes = np.array(self._sizes)
        parts, ends, before = [], [], 0
        for stretch, marker in self._stretches(text):
            raw = marker or array("I", self._encode(stretch)).tobytes()
            at = [] if marker else [m.end() for m in SENTENCE_END.finditer(stretch)]
            if at:
                if not stretch.isascii():
                    at = list(accumulate(len(stretch[a:b].encode()) for a, b in pairwise([0, *at])))
                ends.append(np.searchsorted(np.cumsum(self._sizes[np.frombuffer(raw, "<u4")]), np.array(at)) + before + 1)
            parts.append(raw)
            before += len(raw) // 4
        return b"".join(parts), np.concatenate(ends) if ends else np.zeros(0, np.int64)

    def _stretches(self, text: str) -> Iterator[tuple[str, bytes]]:
        """Stretches of bounded length, unless nothing can be cut, and markers with their ids."""
        held = self._marker is not None and any(m in text for m in self._marker_ids)
        for i, part in enumerate(self._marker.split(text) if held else [text]):
            if i % 2:
                yield part, self._marker_ids[part]
                continue
            at = 0
            while at < len(part):
                cut = None if len(part) - at <= SEGMENT else SAFE_CUT.search(part, at + SEGMENT)
                end = cut.start() if cut else len(part)
                yield part[at:end], b""
                at = end


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One per worker process, so what it remembers serves all its tasks."""
    return ByteBpe(path, markers=True)
