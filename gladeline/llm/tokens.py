"""Whole texts to token ids with a public tokenizer file."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gladeline.llm.tables import arrow_texts, byte_table, raw_bytes, split_words, spread

#: Entry of the vocabulary that ends a document in the packed and the binary form.
END_ID = 2
#: Words that a worker remembers at most, beside those of the piece of text at hand.
REMEMBERED = 800_000

_LOWER = byte_table(lambda b: True)
_ACCENTED = "".join(map(chr, range(0xDF, 0x100))).replace("\u00f7", "")  # small letters that nothing composes further
_PLAIN = re.compile("[a-z]+").fullmatch
_SMALL = re.compile(f"[a-z{_ACCENTED}]+").fullmatch
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b'.,!?;:"()[]{}*&%$#@=+-/_~`^')] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parted(texts: pa.Array) -> pa.Array:
    """Texts in lower case with a space wherever a letter meets a mark, which the tokenizer parts anyway.

    Far fewer different words are left. Texts with ``<|``, which may spell a special token, stay as they are.
    """
    raw, at = raw_bytes(texts)
    if b"<|" in raw.tobytes():
        return texts
    raw = _LOWER[raw]
    letter, mark = _LETTER[raw], _MARK[raw]
    # the two-byte Latin letters; 97 and B7 are the signs for times and divided by
    second = (raw[1:] != 0x97) & (raw[1:] != 0xB7) & (raw[:-1] == 0xC3)
    letter[1:] |= second
    first = np.append(second, False)
    cut = (letter[:-1] & mark[1:]) | (mark[:-1] & (letter | first)[1:])
    where = np.flatnonzero(cut) + 1
    data = np.insert(raw, where, np.uint8(32))
    at = at + np.searchsorted(where, at, side="left")
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Only for tokenizers that lower-case, drop white space, part letters from marks and look across neither. A
    text is then the sequence of its words, and each different word is encoded once rather than at every
    occurrence. Remembered words are bounded: beyond ``REMEMBERED`` the half that was not needed lately goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {ord(c): spell(c)[0][0] for c in _ACCENTED}
        self.words = pa.array([], pa.string())
        self.pool = np.zeros(0, np.uint32)
        self.lengths, self.needed = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.calls = 0

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as ``uint32`` and the border of each text among them."""
        # libraries differ over white space beyond ASCII; what is left inside a word the tokenizer splits itself
        words, at = split_words(_parted(texts))
        flat = words.dictionary_encode()
        word = self._places(flat.dictionary)[np.asarray(flat.indices)]
        lengths = self.lengths[word]
        starts = (np.cumsum(self.lengths) - self.lengths)[word]
        ids = self.pool[spread(starts, lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[at]

    def _places(self, spelled: pa.Array) -> np.ndarray:
        """Where each of the different words stands among the remembered ones; new ones are encoded."""
        self.calls += 1
        if len(self.words) > REMEMBERED:
            self._forget()
        found = pc.index_in(spelled, value_set=self.words)
        place = np.asarray(found.fill_null(-1), dtype=np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = spelled.take(pa.array(new))
            coded = self._encoded(fresh.to_pylist())
            place[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, fresh])
            self.lengths = np.append(self.lengths, np.fromiter(map(len, coded), np.int64, len(coded)))
            self.needed = np.append(self.needed, np.zeros(len(new), np.int64))
            self.pool = np.append(self.pool, np.fromiter(chain.from_iterable(coded), np.uint32))
        self.needed[place] = self.calls
        return place

    def _forget(self) -> None:
        keep = np.flatnonzero(self.needed > np.median(self.needed))
        starts = np.cumsum(self.lengths) - self.lengths
        self.pool = self.pool[spread(starts[keep], self.lengths[keep])]
        self.words = self.words.take(pa.array(keep))
        self.lengths, self.needed = self.lengths[keep], self.needed[keep]

    def _encoded(self, words: list[str]) -> list[list[int]]:
        one, spelling, out, rest = self.tokenizer.model.tokenize, self.spelling, [], []
        for i, word in enumerate(words):
            # a word of small letters is one piece, which nothing normalises
            if _PLAIN(word):
                out.append([t.id for t in one(word)])
            elif _SMALL(word):
                out.append([t.id for t in one(word.translate(spelling))])
            else:
                out.append([])
                rest.append(i)
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = got.ids
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; workers are used again, so later tasks find it warm."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def document_ids(path: str, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text followed by ``end_id``, and the border of each text; a null text is empty."""
    ids, at = encoder(path)(arrow_texts(column))
    if end_id is None:
        return ids, at
    return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
