"""Token counts under a unigram model, by dynamic programming over a trie of the different words.

A word's count is the number of pieces of its best segmentation: the one with the highest total score, at equal
scores the one with fewer pieces. A position's forward score needs only the letters before it, so words with a common
beginning share it: the different words of a stretch of documents form a trie, each of its nodes gets its forward
score and count once, from the nodes above it, and the node at a word's end holds the word's terminal count. The trie
is built and scored level by level, all nodes of a depth at once; the pieces that end at a node are found by walking
a trie of reversed pieces upward. Deep down, where few words are left, the rest of their paths is scored depth first by
the same rule, still once per shared letter. Stretches have a bounded size, so memory does too, and nothing is shuffled.

The vocabulary comes from a public tokenizer file. Its pieces are ranked, not weighted, so a piece of rank r has
log-score ``-log(r + 2)``. A character that no piece covers counts as the bytes of its UTF-8 form, each scored below
all pieces.

Defined cases: a null, empty or blank text has no words and no tokens; words are what stands between ASCII white
space, each with the vocabulary's mark for a word's beginning, of any length; further columns are ignored.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import arrow_texts, pieces, split_words

BEGIN = "▁"
STEP = 256
NARROW = 48
PIECE = 12 << 20
_CHAR = 21  # bits of a character's number


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_scores(path: str) -> dict[str, float]:
    """Ordinary pieces of a vocabulary file with their log-scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(i + 2) for i in plain}


def utf8_length(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


class PieceCounter:
    """Terminal counts of words under a vocabulary of scored pieces."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0
        # the trie of reversed pieces: edges as sorted numbers state << _CHAR | character
        edges: dict[int, int] = {}
        ends = {}
        for piece, score in scores.items():
            state = 0
            for c in reversed(piece):
                state = edges.setdefault(state << _CHAR | ord(c), len(edges) + 1)
            ends[state] = score
        self.edge = np.array(sorted(edges), np.int64)
        self.target = np.array([edges[e] for e in sorted(edges)], np.int64)
        self.score = np.full(len(edges) + 1, np.nan)
        self.score[list(ends)] = list(ends.values())

    def counts(self, words: pa.Array) -> np.ndarray:
        """Counts of different words, in their order."""
        out = np.zeros(len(words), np.int64)
        order = np.asarray(pc.sort_indices(words), dtype=np.int64)  # by bytes, so that common beginnings lie together
        if len(words):
            out[order] = self._trie_counts([BEGIN + w for w in words.take(pa.array(order)).to_pylist()])
        return out

    def _trie_counts(self, spelled: list[str]) -> np.ndarray:
        """Build the trie of sorted words level by level and score each level from those above.

        The letters are laid out ``STEP`` levels at a time. Where a level has fewer than ``NARROW`` words left, their
        paths are walked word by word from there, each going on from the letters it shares with the word before.
        """
        length = np.fromiter(map(len, spelled), np.int64, len(spelled))
        node, done, depth, total = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.int64), 0, 1
        parent, char, best, count = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1), np.zeros(1, np.int32)
        live = np.arange(len(spelled))
        while len(live) >= NARROW or depth == 0:
            parts = [spelled[i][depth : depth + STEP] for i in live]
            code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            start = np.zeros(len(spelled), np.int64)
            start[live] = np.cumsum(size) - size
            # no step has more nodes than its words have characters
            parent, char, best, count = (np.concatenate([a[:total], np.zeros(len(code), a.dtype)]) for a in (parent, char, best, count))
            for at in range(int(size.max())):
                key = node[live] << _CHAR | code[start[live] + at]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                node[live] = total + np.cumsum(new) - 1
                level = slice(total, total + int(new.sum()))
                parent[level], char[level] = key[new] >> _CHAR, key[new] & ((1 << _CHAR) - 1)
                self._score_level(level, parent, char, best, count)
                total, depth = level.stop, depth + 1
                more = length[live] > depth
                ended = live[~more]
                done[ended] = count[node[ended]]
                live = live[more]
                if len(live) < NARROW:
                    break
        path, scores, amounts, before = [], [], [], ""
        for i in live.tolist():
            word = spelled[i]
            shared = len(commonprefix((before, word)))
            if shared < depth or not scores:  # another node: its own scores and those of the nodes above it
                path, at = [], int(node[i])
                while len(path) <= self.longest and at:
                    path.append(at)
                    at = int(parent[at])
                if not at:
                    path.append(0)
                path.reverse()
                scores, amounts, shared = best[path].tolist(), count[path].tolist(), depth
            first = depth + 1 - len(path)  # the depth of the first score kept
            del scores[shared + 1 - first :], amounts[shared + 1 - first :]
            self._walk(word, first, scores, amounts)
            done[i], before = amounts[-1], word
        return done

    def _walk(self, word: str, first: int, best: list[float], amounts: list[int]) -> None:
        """Go on with the scores and counts of the beginnings of a word, of which the first has ``first`` letters."""
        for end in range(first + len(best), len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, fewest = best[-1] + n * self.byte, amounts[-1] + n
            for begin in range(max(first, end - self.longest), end):
                score = self.scores.get(word[begin:end])
                if score is not None:
                    total, amount = best[begin - first] + score, amounts[begin - first] + 1
                    if total > top or total == top and amount < fewest:
                        top, fewest = total, amount
            best.append(top)
            amounts.append(fewest)

    def _score_level(self, level: slice, parent, char, best, count) -> None:
        above, own = parent[level], char[level]
        n = utf8_length(own)
        # a character as bytes is always possible
        top, fewest = best[above] + n * self.byte, count[above] + n
        at = np.arange(len(own))
        state, ancestor = np.zeros(len(own), np.int64), np.arange(level.start, level.stop)
        while len(at):
            key = state << _CHAR | char[ancestor]
            place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[place] == key
            at, state, ancestor = at[on], self.target[place[on]], parent[ancestor[on]]
            score = best[ancestor] + self.score[state]
            amount = count[ancestor] + 1
            better = (score > top[at]) | ((score == top[at]) & (amount < fewest[at]))
            top[at[better]], fewest[at[better]] = score[better], amount[better]
            inner = ancestor > 0
            at, state, ancestor = at[inner], state[inner], ancestor[inner]
        best[level], count[level] = top, fewest


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The vocabulary of this worker process."""
    if path not in _counters:
        _counters[path] = PieceCounter(read_scores(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` per document."""
    path = vocabulary or default_path()

    def count(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                words, at = split_words(arrow_texts(piece.column("text")))
                coded = words.dictionary_encode()
                per_word = counter(path).counts(coded.dictionary)[np.asarray(coded.indices, dtype=np.int64)]
                total = np.concatenate([[0], np.cumsum(per_word)])
                columns = [piece.column("doc_id"), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
