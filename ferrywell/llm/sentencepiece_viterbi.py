"""SentencePiece ids by a forward search that words with a common beginning share.

The distinct marked words of a batch are sorted; walking them in that order is a depth-first walk of
their trie, so the forward scores of a common prefix are computed once and kept on a stack.

For a unigram model the forward score of a prefix is that of its best segmentation (Viterbi). A BPE
model does not maximise a sum of scores. There the forward state is the last piece of the
prefix's segmentation: a path through the lattice is the BPE segmentation exactly if merging each
pair of neighbouring pieces gives that pair again, because the first merge across a border would
also happen between the two pieces alone. So one piece per prefix fits, and finding it needs only
the state of shorter prefixes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Words a worker remembers, about 200 bytes each; beyond that it starts anew. The same holds for pairs of pieces.
REMEMBERED = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with scores and ids, and the ids of single bytes for characters without a piece."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: dict[int, int], kind: str = "bpe"):
        self.scores, self.ids, self.byte_ids = scores, ids, byte_ids
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.segment = {"bpe": self._segment_bpe, "unigram": self._segment_unigram}[kind]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, bytes] = {}
        # a piece that merging does not give from its own characters never occurs
        self._merges = {p: m for p, (parts, m) in ((p, self._merging(p)) for p in scores) if parts == [p] or kind == "unigram"}
        lengths: dict[str, set[int]] = {}
        for piece in self._merges:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self._lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}

    @classmethod
    def from_file(cls, path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(model.vocab_size())
        special = {i for i in numbers if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        ids = {model.id_to_piece(i): i for i in numbers if i not in special}
        byte_ids = {int(BYTE.fullmatch(model.id_to_piece(i))[1], 16): i for i in numbers if model.is_byte(i)}
        return cls({p: model.get_score(i) for p, i in ids.items()}, ids, byte_ids, kind)

    def _merging(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """BPE as defined: merge the neighbours with the highest score, the leftmost of equals, as long as there are any.

        Returns the parts that remain and, for each merge, its score and the first and last part after it.
        """
        parts, scores, merges = list(text), self.scores, []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            merges.append((best, parts[0], parts[-1]))
        return parts, merges

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces gives just these two."""
        first, second = self._merges.get(left, ()), self._merges.get(right, ())
        x, y, i, j, never = left[-1:] if first else left, right[:1] if second else right, 0, 0, float("-inf")
        while True:
            across = self.scores.get(x + y)
            mine = first[i][0] if i < len(first) else never
            other = second[j][0] if j < len(second) else never
            # of equal scores the leftmost goes first
            if across is not None and across > mine and across >= other:
                return False
            if mine == never and other == never:
                return True
            if mine >= other:
                x, i = first[i][2], i + 1
            else:
                y, j = second[j][1], j + 1

    def _segment_bpe(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each distinct word; lengths of pieces are looked up by their last three characters."""
        merges, pairs, lengths = self._merges, self._pairs, self._lengths
        states, before = [""], ""  # the last piece of each prefix
        for word in sorted(set(words)):
            shared, size = 0, len(word)
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, size + 1):
                # if nothing longer ends here, the character stands alone
                last = word[end - 1]
                found = lengths.get(word[end - 3:end], ()) if end > 2 else ()
                for length in (*found, 2) if end > 1 else ():
                    begin = end - length
                    if begin < 0:
                        continue
                    piece = word[begin:end]
                    if piece not in merges:
                        continue
                    if begin:
                        pair = states[begin], piece
                        apart = pairs.get(pair)
                        if apart is None:
                            if len(pairs) > 4 * REMEMBERED:
                                pairs.clear()
                            apart = pairs[pair] = self._apart(*pair)
                        if not apart:
                            continue
                    last = piece
                    break
                states.append(last)
            pieces, end = [], size
            while end:
                pieces.append(states[end])
                end -= len(pieces[-1])
            before = word
            yield word, pieces[::-1]

    def _step_unigram(self, word: str, end: int, states: list) -> tuple:
        best = None
        for begin in range(max(0, end - self.longest), end):
            piece = word[begin:end]
            score = self.scores.get(piece)
            if score is None and begin == end - 1:
                score = self.unknown
            if score is not None and (best is None or states[begin][1] + score > best[1]):
                best = piece, states[begin][1] + score
        return best

    def _segment_unigram(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each distinct word."""
        states: list[tuple] = [("", 0.0)]
        before = ""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                states.append(self._step_unigram(word, end, states))
            pieces, end = [], len(word)
            while end:
                pieces.append(states[end][0])
                end -= len(pieces[-1])
            before = word
            yield word, pieces[::-1]

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.byte_ids[b] for b in piece.encode()]

    def learn(self, words: set[str]) -> None:
        if len(self._words) > REMEMBERED:
            self._words.clear()
        for word, pieces in self.segment(words):
            try:
                ids = list(map(self.ids.__getitem__, pieces))
            except KeyError:
                ids = [i for p in pieces for i in self.piece_ids(p)]
            self._words[word] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers, least byte first."""
        units = [_units(text) for text in texts]
        new = set().union(*units).difference(self._words)
        if new:
            held = len(self._words)
            self.learn(new)
            if held > REMEMBERED:  # it forgot older words
                self.learn(set().union(*units).difference(self._words))
        ids = self._words.__getitem__
        return [b"".join(map(ids, words)) for words in units]

    @property
    def surfaces(self) -> list[bytes]:
        """What each id stands for when decoding."""
        if not hasattr(self, "_surfaces"):
            self._surfaces = [b""] * (1 + max([*self.ids.values(), *self.byte_ids.values()], default=0))
            for piece, i in self.ids.items():
                self._surfaces[i] = piece.replace(MARK, " ").encode()
            for byte, i in self.byte_ids.items():
                self._surfaces[i] = bytes([byte])
        return self._surfaces

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.surfaces.__getitem__, array("I", ids))).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _units(text: str) -> list[str]:
    """A text's words with their marks, in order; no piece reaches from one to the next."""
    if not text:
        return []
    return UNIT.findall(MARK + text.replace(" ", MARK))


@lru_cache(maxsize=2)
def load(path: str, kind: str) -> Vocabulary:
    """One per worker process, so what it remembers serves all its tasks."""
    return Vocabulary.from_file(path, kind)


def _mapped(docs: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                yield work(batch.slice(begin, 256))

    return docs.selectExpr(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, kind: str = "bpe", keep_ids: bool = True) -> DataFrame:
    """One row per row: doc_id, n_ids, ids_crc32, whether decoding gives the text again, and the ids.

    Null and empty texts have no ids. Characters without a piece become their bytes. A text that
    holds the mark itself comes back with spaces in its place. Repeated rows each get the result;
    an empty table gives none.
    """
    path = path or default_path()
    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean" + ", ids binary" * keep_ids

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = load(path, kind)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = vocabulary.encode(texts)
        columns = [
            batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()),
            pa.array([vocabulary.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)], pa.bool_())]
        names = ["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"][:4 + keep_ids]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names)

    return _mapped(docs, ["cast(doc_id as bigint) as doc_id", "cast(text as string) as text"], schema, work)


def decode(encoded: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    path = path or default_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [load(path, kind).decode(ids or b"") for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _mapped(encoded, ["cast(doc_id as bigint) as doc_id", "ids"], "doc_id bigint, text string", work)
