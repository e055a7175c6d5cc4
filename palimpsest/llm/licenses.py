"""Licence scans with a positional rare-token index.

Licence words are ranked by their inverse document frequency over the whole
corpus.  Every phrase is found everywhere it stands: it is looked up in the
file's positions by its rarest word and compared at the relative position.  Each
place of a template's mandatory key phrase makes candidate alignments, all those
(file position less template position) whose stretch holds the place; the
template counts if enough of its words agree at the best of them.  However many
notices a file has, each is found.

Defined results: null text counts as empty; a text without words has no places,
null first and last word, empty labels and score zero; repeated files are
scanned one by one; of equally good alignments any gives the same score; texts are read
whole, however long; an empty table gives an empty result; columns other than id and text
are never read and may have any names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import document_frequency, map_batches, plain_words, share, table_batch

# Phrases whose every place is reported, with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Label, clause of the licence or of its notice, mandatory key phrases (any one of them).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("deal in the software without restriction",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3", "gnu general public license v3")),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation either version 3",)),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu general public license version 3 29 june 2007",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2", "gnu general public license v2")),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation either version 2", "gnu general public license as published by the free software foundation version 2")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("lesser general public license version 3",)),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("lesser general public license as published by the free software foundation either version 3",)),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("lesser general public license as published by the free software foundation either version 2 1", "lesser general public license version 2 1")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("affero general public license as published by the free software foundation",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("permission is granted to anyone to use this software for any purpose",)),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    ("artistic-2", "licensed under the artistic license 2 0", ("artistic license 2 0", "artistic license version 2 0")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives", "cc by nd")),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has dedicated all copyright to the public domain cc0 1 0", ("cc0 1 0",)),
    ("ofl-1.1", "licensed under the sil open font license version 1 1", ("sil open font license version 1 1",)),
)


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(plain_words(text.encode()))


class Index:
    """Phrases, found by their rarest words, and templates.

    ``slack`` words may be missing or added between a file and a template;
    ``least_share`` of a template's words must agree.
    """

    def __init__(self, idf: dict[bytes, float], slack: int = 3, least_share: float = 0.7):
        self.slack, self.least_share = slack, least_share
        self.idf = idf
        self.base = [(_words(p), label) for p, label in BASE_PHRASES]
        self.templates = [(label, _words(text), [_words(k) for k in keys]) for label, text, keys in TEMPLATES]
        self.vocabulary = frozenset(vocabulary())

    def rarest(self, phrase: tuple[bytes, ...]) -> int:
        return max(range(len(phrase)), key=lambda k: (self.idf.get(phrase[k], 0.0), -k))

    def places(self, phrase: tuple[bytes, ...], words: list[bytes], where: dict[bytes, list[int]]) -> list[int]:
        if any(w not in where for w in phrase):
            return []
        at = self.rarest(phrase)
        starts = (p - at for p in where[phrase[at]])
        return [s for s in starts if s >= 0 and tuple(words[s : s + len(phrase)]) == phrase]

    def scan(self, text: bytes | None) -> tuple:
        words = plain_words(text or b"")
        where: dict[bytes, list[int]] = defaultdict(list)
        known = self.vocabulary
        for at, word in enumerate(words):
            if word in known:
                where[word].append(at)
        where = dict(where)
        starts, base = [], set()
        for phrase, label in self.base:
            if found := self.places(phrase, words, where):
                starts += found
                base.add(label)
        labels, score = set(base), float(bool(base))
        for label, share in self.aligned(words, where):
            labels.add(label)
            score = max(score, share)
        return (
            len(words),
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            score,
        )

    def aligned(self, words: list[bytes], where: dict[bytes, list[int]]):
        """(label, share of the template's words that agree) of verified candidates."""
        for label, template, keys in self.templates:
            best = 0.0
            for key in keys:
                for at in self.places(key, words, where):
                    if best < 1.0:  # no alignment is better than a whole one
                        best = max(best, self.agreement(template, where, at + len(key) - len(template) - self.slack, at + self.slack))
            if best >= self.least_share:
                yield label, best

    def agreement(self, template: tuple[bytes, ...], where: dict[bytes, list[int]], low: int, high: int) -> float:
        """The largest share of the template's words that agree, over alignments low..high."""
        agree = [0] * (high - low + 1)
        for at, word in enumerate(template):
            found, least = where.get(word, ()), low  # alignments below ``least`` have this word already
            for i in range(bisect_left(found, low + at - self.slack), len(found)):
                first, last = found[i] - at - self.slack, found[i] - at + self.slack
                if first > high:
                    break
                for shift in range(max(first, least), min(last, high) + 1):
                    agree[shift - low] += 1
                least = last + 1
        return max(agree) / len(template)


def vocabulary() -> set[bytes]:
    out = {w for p, _ in BASE_PHRASES for w in _words(p)}
    for _, text, keys in TEMPLATES:
        out.update(_words(text))
        out.update(w for k in keys for w in _words(k))
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
OUT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
    ]
)


def build(docs: DataFrame, text_col: str = "text", **options) -> Index:
    """The index, with document frequencies of licence words over all documents."""
    found = document_frequency(docs, text_col, vocabulary())
    total = docs.count()
    return Index({w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary()}, **options)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document with its base places, labels and best agreement."""
    index = share(docs.sparkSession, build(docs, text_col, **options))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        find = index().scan

        def step(batch):
            out = [find(t) for t in batch.column(1).to_pylist()]
            return table_batch(pa.schema([batch.schema.field(0), *OUT]), batch.column(0), *zip(*out, strict=True))

        return step

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(slim, make, f"doc_id {kind}, {SCHEMA}")
