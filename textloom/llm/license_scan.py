"""Licence scan by a positional rare-token index.

The library holds licence texts, each with the key phrases that a copy of it must have. The
index files each text's words of highest IDF (over the library) under the word, with
their positions in the text. A file is scanned by looking up the words that it has in
the index: each place of such a word, less the word's position in a text, is a place
where the text may begin. The postings of a text's rare words are intersected by these
relative positions: a region counts where at least half of the text's rare words (all of
them, for the exact phrases of the base) agree on the beginning, within ``SLACK`` words for
texts, since holders' names and years stand in the middle of copies. In each such region
the mandatory key phrases are verified word by word; a text's label needs all of them.

A base phrase is a text of its own whose words must all agree exactly, so each of its
places is found, however long the file is.

Score: the largest share of rare words that agree, over all texts, halved where a key
phrase is missing.

Defined results: a null or empty text has no words, no places, null first_word and
last_word, empty label strings and score 0. Repeated rows give repeated results.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import WORD_BYTES, documents, map_batches, read_table, utf8

#: Words of highest IDF that a text is filed under, and words by which their beginnings may differ.
RARE, SLACK = 8, 40


@dataclass(frozen=True)
class Template:
    """A licence text and the key phrases that stand in it; base: a phrase whose places count on their own."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False


# Licence texts, or the notices that stand for them in files, and phrases that identify them.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
    " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
    " notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies."
)
BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
    " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
BSD_3 = BSD_2 + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
    " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
    " applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any"
    " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
    " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
    " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
    " commercial or non-commercial, and by any means."
)
BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
    " accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute,"
    " execute, and transmit the Software, and to prepare derivative works of the Software."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
    " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software"
    " for any purpose, including commercial applications, and to alter it and redistribute it freely."
)

TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit-text", MIT, ("permission is hereby granted free of charge to any person obtaining", "the software is provided as is")),
    Template("isc-text", ISC, ("permission to use copy modify and or distribute this software", "with or without fee")),
    Template("bsd-2-clause-text", BSD_2, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("bsd-3-clause-text", BSD_3, ("redistribution and use in source and binary forms", "to endorse or promote products derived")),
    Template("apache-2.0-notice", APACHE, ("licensed under the apache license version 2 0", "except in compliance with the license")),
    Template("gpl-2.0-notice", GPL.format(2), ("gnu general public license as published by", "either version 2 of the license")),
    Template("gpl-3.0-notice", GPL.format(3), ("gnu general public license as published by", "either version 3 of the license")),
    Template("mpl-2.0-notice", MPL, ("terms of the mozilla public license v 2 0",)),
    Template("unlicense-text", UNLICENSE, ("this is free and unencumbered software released into the public domain",)),
    Template("boost-text", BOOST, ("to any person or organization obtaining", "prepare derivative works of the software")),
    Template("zlib-text", ZLIB, ("be held liable for any damages arising from the use of this software", "alter it and redistribute it freely")),
    Template("apache-2.0", "apache license version 2 0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd"),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long,"
    " base_labels string, labels string, score double"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class RareTokenIndex:
    """The library's texts filed under their rarest words, with positions; a text without key phrases is exact."""

    def __init__(self, templates: Iterable[Template] = TEMPLATES, rare: int = RARE, slack: int = SLACK):
        self.templates, self.slack = tuple(templates), slack
        self.texts = [words_of(t.text.encode()) for t in self.templates]
        self.phrases = [[words_of(p.encode()) for p in t.phrases] for t in self.templates]
        for t, words, phrases in zip(self.templates, self.texts, self.phrases, strict=True):
            if not words or not all(phrases):
                raise ValueError(f"a text or phrase of {t.label} has no words")
        df = Counter(w for words in self.texts for w in set(words))
        self.idf = {w: math.log((1 + len(self.texts)) / n) for w, n in df.items()}
        # word -> (text number, position) of the texts filed under it
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.filed: list[int] = []
        for t, words in enumerate(self.texts):
            order = sorted(range(len(words)), key=lambda i, words=words: (words.count(words[i]), -self.idf[words[i]], i))
            chosen = order[:rare] if self.phrases[t] else order  # an exact text is filed under all its words
            for i in chosen:
                self.postings[words[i]].append((t, i))
            self.filed.append(len(chosen))
        # Rare words that must agree: half of a text's, all of an exact one's.
        self.least = [-(-n // 2) if p else n for n, p in zip(self.filed, self.phrases, strict=True)]

    def begins(self, words: list[bytes]) -> dict[int, tuple[np.ndarray, int]]:
        """By text number: where it begins (for texts with key phrases: about where), and the most rare words that agree there."""
        present = self.postings.keys() & set(words)
        hits = Counter(t for w in present for t, _ in self.postings[w])
        wanted = sorted(t for t, n in hits.items() if n >= self.least[t])
        if not wanted:
            return {}
        ids = {w: i for i, w in enumerate(sorted({w for w in present for t, _ in self.postings[w] if t in set(wanted)}))}
        numbers = np.array([ids.get(w, -1) for w in words], dtype=np.int64)
        where = {w: np.flatnonzero(numbers == i) for w, i in ids.items()}
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for w in sorted(ids, key=lambda w: (-self.idf[w], w)):
            for t, i in self.postings[w]:
                starts[t].append(where[w] - i)
        out = {}
        for t in wanted:
            held, least = starts[t], self.least[t]
            if not self.phrases[t]:
                values, n = np.unique(np.concatenate(held), return_counts=True)
                if len(values := values[n == least]):
                    out[t] = values, least
                continue
            at = np.concatenate(held)
            own = np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(at, kind="stable")
            at, own = at[order], own[order]
            found, most, low, count = [], 0, 0, Counter()
            for high in range(len(at)):
                count[own[high]] += 1
                while at[high] - at[low] > self.slack:
                    count[own[low]] -= 1
                    if not count[own[low]]:
                        del count[own[low]]
                    low += 1
                if len(count) >= least:
                    found.append(at[low])
                    most = max(most, len(count))
            if found:
                out[t] = np.unique(found), most
        return out

    def verified(self, t: int, words: list[bytes], starts: np.ndarray) -> bool:
        """Whether all key phrases of a text stand in one of its regions."""
        n, last = len(self.texts[t]), -1
        for start in starts.tolist():
            if start <= last:  # inside the region before
                continue
            last = start + self.slack
            region = words[max(0, start - self.slack) : max(0, last + n + self.slack)]
            if all(holds(region, p) for p in self.phrases[t]):
                return True
        return False

    def report(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        base_starts: list[int] = []
        base, labels, best = set(), set(), 0.0
        for t, (starts, most) in self.begins(words).items():
            template, share = self.templates[t], most / self.filed[t]
            if self.phrases[t] and not self.verified(t, words, starts):
                best = max(best, share / 2)
                continue
            best = max(best, share)
            labels.add(template.label)
            if template.base:
                base.add(template.label)
                base_starts += starts.tolist()
        return (
            len(words),
            len(base_starts),
            min(base_starts, default=None),
            max(base_starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            round(min(1.0, best), 6),
        )


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    """Whether the phrase's words stand one after the other."""
    at = -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return False
        if words[at : at + len(phrase)] == phrase:
            return True


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document; reads doc_id and text, moves no rows between tasks."""
    index = RareTokenIndex(templates)

    def rows(batch: pa.RecordBatch) -> dict:
        got = list(zip(*[index.report(t) for t in utf8(batch.column(1))], strict=True))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        return {"doc_id": batch.column(0), **dict(zip(names, map(list, got), strict=True))}

    return map_batches(documents(docs), ["doc_id", "text"], rows, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
