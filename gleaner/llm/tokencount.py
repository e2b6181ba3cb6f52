"""Token counts by linear greedy longest match.

The vocabulary's pieces form a trie.  Every node has a failure link and the number
of pieces that are popped when it is taken, both worked out once, so a word is
walked once from left to right, never backing up, and its number of greedy
longest-match pieces comes out without building a piece.

A piece that starts with the word mark (sentencepiece's U+2581) matches only at a
word's start, others only after it.  A word that can't be covered counts as one
unknown piece.  Words are runs of anything but the six space characters; no word or
text is cut.  Null or empty text: no word, no token.  Repeated rows are counted each
for itself; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS = 200_000
_automata: dict[int, "Automaton"] = {}


class Automaton:
    def __init__(self, pieces: list[str], mark: str = MARK):
        # Node 0: a word's start; node 1: after at least one piece.
        self.next: list[dict[str, int]] = [{}, {}]
        self.link: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        final = [False, False]
        for piece in pieces:
            at = 0 if piece.startswith(mark) else 1
            body = piece[len(mark) :] if at == 0 else piece
            if not body:
                continue
            for c in body:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.link.append(-1)
                    self.popped.append(0)
                    final.append(False)
                at = self.next[at][c]
            final[at] = True
        #: With the bare mark in the vocabulary a word may start with it alone.
        if mark in pieces:
            self.link[0], self.popped[0] = 1, 1
        queue = [0, 1]
        for at in queue:
            for c, to in self.next[at].items():
                queue.append(to)
                if final[to]:
                    self.link[to], self.popped[to] = 1, 1
                    continue
                z, n = self.link[at], self.popped[at]
                while z >= 0 and c not in self.next[z]:
                    z, n = self.link[z], n + self.popped[z]
                if z >= 0:
                    self.link[to], self.popped[to] = self.next[z][c], n

    def count(self, word: str) -> int:
        """Pieces of the word; 1 for a word that can't be covered."""
        step, link, popped = self.next, self.link, self.popped
        at = n = 0
        for c in word:
            while (to := step[at].get(c)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return n


def greedy_pieces(word: str, vocabulary: set[str], mark: str = MARK) -> list[str] | None:
    """The definition, piece by piece; what count() is tested against."""
    rest, out = mark + word, []
    while rest:
        for n in range(len(rest), 0, -1):
            if rest[:n] in vocabulary and (not out or not rest.startswith(mark)):
                out.append(rest[:n])
                rest = rest[n:]
                break
        else:
            return None
    return out


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model; control, unknown and byte
    pieces match no text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= 100:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, pieces: list[str], mark: str = MARK) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of ``docs`` (doc_id, text).  The
    vocabulary is the only thing sent to the executors; its size is its own."""
    shared = docs.sparkSession.sparkContext.broadcast((hash_of(pieces), pieces, mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, sign = shared.value
        if known not in _automata:
            _automata.clear()
            _automata[known] = Automaton(own, sign)
        counts = _Counts(_automata[known])
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                parts = text.split() if text else ()
                words.append(len(parts))
                tokens.append(sum(map(counts.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def hash_of(pieces: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\0".join(pieces))
