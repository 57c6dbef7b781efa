"""Licence scan with a positional index of rare words.

A template is the wording of a licence notice with key phrases that must not be missing; a phrase template is nothing
but its one phrase. How many documents hold each word of the templates is counted over the whole corpus. The index
holds, for each template, its ``RARE`` rarest words (the rarest one of a phrase) and where they stand in it. Of a file, its
``LOOKED_UP`` rarest licence words, and those of the phrase templates in any case, are looked up. A word at place p of
the file that stands at q in a template speaks for the template beginning at p - q; postings that agree on the
beginning (a template may drift by ``DRIFT`` words: names, years, line numbers) form a candidate. It is accepted when
its words weigh ``SHARE`` of the template's indexed words by rarity and every key phrase stands inside it.

Phrase templates may not drift and are their own key phrase, so every place of them is found and nothing else.

Texts are lower-cased over A-Z; words are digits, letters and everything beyond ASCII. Both passes read a document
where it lies; what is gathered and sent is one number per word of the templates.

Defined cases: a null or empty text has no words and no places; rows are independent, so repeated and null ``doc_id``
are kept; an empty table gives no rows; further columns are left out; without documents that hold a word all words
are equally rare, and equal rarity goes by spelling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.llm.fmindex import words_of
from gladeline.llm.tables import arrow_texts, pieces, spread

RARE, LOOKED_UP, DRIFT, SHARE = 12, 16, 6, 0.6


@dataclass(frozen=True)
class Template:
    """``keys`` are phrases that have to stand in the wording; a template without them is a phrase as a whole."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def phrase(self) -> bool:
        return not self.keys


#: Phrases that name a licence outright. Fixed values.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)

#: Wording of common notices. Fixed values.
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "with or without modification are permitted"),
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS",
        ("except in compliance with the license", "www apache org licenses license 2 0"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ("subject to the terms of the mozilla public license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose",
        ("in no event will the authors be held liable", "permission is granted to anyone to use this software"),
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc0", "cc0 1 0 universal"),
    Template("agpl", "affero general public license"),
    Template("lgpl", "lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsl", "boost software license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
)

TEMPLATES = BASE + NOTICES


def _words(text: str) -> list[str]:
    return words_of(pa.array([text]))[0].to_pylist()


class RareIndex:
    """Postings of the rarest words of each template, weighed by inverse document frequency."""

    def __init__(self, templates: tuple[Template, ...], holding: dict[str, int], n_docs: int):
        self.templates = templates
        spelled = [_words(t.text) for t in templates]
        keys = [[_words(k) for k in (t.keys or (t.text,))] for t in templates]
        vocabulary = sorted({w for words in spelled for w in words} | {w for ks in keys for k in ks for w in k})
        weight = {w: math.log1p(n_docs / (1 + holding.get(w, 0))) or 1.0 for w in vocabulary}
        # numbers ascend with commonness, so a lesser number is a rarer word
        by_rarity = sorted(vocabulary, key=lambda w: (-weight[w], w))
        self.number = {w: i for i, w in enumerate(by_rarity)}
        self.vocabulary = pa.array(by_rarity, pa.string())
        self.weight = np.array([weight[w] for w in by_rarity])
        self.lengths = np.array([len(w) for w in spelled])
        self.keys = [[[self.number[w] for w in k] for k in ks] for ks in keys]
        self.phrase = np.array([t.phrase for t in templates])
        postings = []
        for t, words in enumerate(spelled):
            numbers = [self.number[w] for w in words]
            rare = set(sorted(set(numbers))[: 1 if templates[t].phrase else RARE])
            postings += [(w, t, q) for q, w in enumerate(numbers) if w in rare]
        postings = np.array(sorted(postings), np.int64).reshape(-1, 3)
        self.word, self.template, self.place = postings.T
        self.first = np.searchsorted(self.word, np.arange(len(by_rarity) + 1))
        self.whole = np.bincount(self.template, self.weight[self.word], minlength=len(templates))
        self.always = np.zeros(len(by_rarity), bool)
        self.always[[min(k[0]) for k, p in zip(self.keys, self.phrase) if p]] = True

    def find(self, words: pa.Array, at: np.ndarray) -> np.ndarray:
        """Accepted places in texts that begin at ``at``: columns text, template, first word, end, share in millionths."""
        known = np.asarray(pc.index_in(words, value_set=self.vocabulary).fill_null(-1), dtype=np.int64)
        where = np.flatnonzero(known >= 0)
        word, text = known[where], np.searchsorted(at, where, side="right") - 1
        indexed = self.first[word + 1] > self.first[word]
        where, word, text = where[indexed], word[indexed], text[indexed]
        chosen = self._rarest(text, word) | self.always[word]
        where, word, text = where[chosen], word[chosen], text[chosen]
        n = self.first[word + 1] - self.first[word]
        posting = spread(self.first[word], n)
        found = Votes(np.repeat(text, n), self.template[posting], np.repeat(where, n) - self.place[posting], self.place[posting])
        found.weight = self.weight[self.word[posting]]
        return self._accept(found, known, at)

    def _rarest(self, text: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether the word at each place is among the rarest ``LOOKED_UP`` different ones of its text."""
        size = len(self.vocabulary)
        pairs = np.unique(text * size + word)
        rank = np.arange(len(pairs)) - np.searchsorted(pairs, pairs // size * size)
        return rank[np.searchsorted(pairs, text * size + word)] < LOOKED_UP

    def _accept(self, v: Votes, known: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(v.text):
            return np.zeros((0, 5), np.int64)
        v.sort()
        drift = np.where(self.phrase[v.template], 0, DRIFT)
        new = np.ones(len(v.text), bool)
        new[1:] = (np.diff(v.text) != 0) | (np.diff(v.template) != 0) | (np.diff(v.begin) > drift[1:])
        group = np.cumsum(new) - 1
        # a place of the template counts once per candidate, however often it is met
        once = np.unique(group * (1 + v.place.max()) + v.place, return_index=True)[1]
        share = np.bincount(group[once], v.weight[once], minlength=group[-1] + 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(group)) - 1
        text, template = v.text[starts], v.template[starts]
        share = np.minimum(1.0, share / self.whole[template])
        least = np.where(self.phrase[template], 1 - 1e-9, SHARE)
        first = np.where(self.phrase[template], v.begin[starts], v.begin[starts] - DRIFT)
        end = v.begin[ends] + self.lengths[template] + np.where(self.phrase[template], 0, DRIFT)
        first, end = np.maximum(first, at[text]), np.minimum(end, at[text + 1])
        good = share >= least
        order = np.argsort(known, kind="stable")
        for t in np.unique(template[good]).tolist():
            mine = np.flatnonzero(good & (template == t))
            for key in self.keys[t]:
                places = _occurrences(known, order, key)
                nth = np.searchsorted(places, first[mine])
                next_place = np.append(places, len(known) + 1)[nth]
                good[mine[next_place + len(key) > end[mine]]] = False
        return np.stack([text, template, first - at[text], end - at[text], np.round(share * 1e6).astype(np.int64)], axis=1)[good]


class Votes:
    """Looked-up words: the text, the template, where the template would begin, and the word's place in it."""

    def __init__(self, text, template, begin, place):
        self.text, self.template, self.begin, self.place = text, template, begin, place
        self.weight = np.zeros(len(text))

    def sort(self) -> None:
        order = np.lexsort((self.begin, self.template, self.text))
        for name, x in vars(self).items():
            setattr(self, name, x[order])


def _occurrences(known: np.ndarray, order: np.ndarray, key: list[int]) -> np.ndarray:
    """Where the words of ``key`` stand one after the other, from the places of its rarest; ``order`` sorts ``known``."""
    rarest = min(key)
    low, high = np.searchsorted(known, [rarest, rarest + 1], sorter=order)
    places = np.sort(order[low:high]) - key.index(rarest)
    places = places[(places >= 0) & (places + len(key) <= len(known))]
    for i, w in enumerate(key):
        places = places[known[places + i] == w]
    return places


def count_holders(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[str, int], int]:
    """How many documents hold each word of the templates, and how many documents there are."""
    vocabulary = sorted({w for t in templates for x in (t.text, *t.keys) for w in _words(x)})

    def count(batches):
        words_known, total, n = pa.array(vocabulary, pa.string()), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, at = words_of(arrow_texts(piece.column("text")))
                known = np.asarray(pc.index_in(words, value_set=words_known).fill_null(-1), dtype=np.int64)
                where = np.flatnonzero(known >= 0)
                text = np.searchsorted(at, where, side="right") - 1
                held = np.unique(text * len(vocabulary) + known[where]) % len(vocabulary)
                total += np.bincount(held, minlength=len(vocabulary))
                n += piece.num_rows
        yield pa.RecordBatch.from_pydict({"word": [*vocabulary, None], "n": [*total.tolist(), n]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    # a row per word of the templates and one for all documents
    rows = {r["word"]: r["total"] for r in counted.groupBy("word").agg(F.sum("n").alias("total")).collect()}
    return {w: n for w, n in rows.items() if w is not None}, rows.get(None) or 0


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, places`` per document; a place has ``label, base, first, end, share``.

    ``first`` and ``end`` are words from 0, ``end`` not included; those of a notice leave room for its drift.
    """
    holding, n_docs = count_holders(docs, templates)
    kind = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])

    def scan(batches):
        index = RareIndex(templates, holding, n_docs)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, at = words_of(arrow_texts(piece.column("text")))
                places: list[list[dict]] = [[] for _ in range(piece.num_rows)]
                for text, t, first, end, share in index.find(words, at).tolist():
                    places[text].append({"label": templates[t].label, "base": templates[t].base, "first": first, "end": end, "share": share / 1e6})
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(places, pa.list_(kind))],
                    names=["doc_id", "n_words", "places"],
                )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    place = "struct<label:string,base:boolean,first:bigint,end:bigint,share:double>"
    return columns.mapInArrow(scan, f"doc_id long, n_words long, places array<{place}>")


def license_report(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; the score is the best share."""
    base = F.filter("places", lambda p: p["base"])

    def names(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return find_licenses(docs, templates).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
