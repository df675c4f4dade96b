"""License scans by a positional rare-token index.

The templates' words are indexed with their positions. Over all documents it is counted how many have each of these
words. In each file the template's words that it has are looked up from the highest inverse document frequency
down, until what is left couldn't carry a match. Each place of such a word, less the word's position in the template, is where
the template would start; around it the template's other postings are intersected by relative position, with a small
gap for inserted or lost words, and the mandatory key phrase must stand there word for word. Files whose words can't
make up a match are not looked at.

A base phrase is a template and its own key phrase: its rarest word is looked up, so all its places are found.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.words import LOWER_ALNUM, U, Words, append, pieces, texts_of

#: Least share of a template's weight that must match; a template may be off its place by one word for so many of its words, and by so many at most.
SHARE, PER_GAP, GAP = 0.6, 8, 6
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public license texts and notices, as (label, mandatory key phrase, text). Case and punctuation don't count.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "released under the MIT License"),
    ("isc", "for any purpose with or without fee", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("isc", "for any purpose with or without fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "apache license version 2 0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("apache", "apache license version 2 0", "licensed under the Apache License, Version 2.0"),
    ("gpl", "gnu general public license", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program."""),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl", "mozilla public license", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", "unencumbered software", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("unlicense", "unencumbered software", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "cc by 4 0", "licensed under CC BY 4.0"),
    ("cc-by-sa", "cc by sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "cc by nc", "licensed under CC BY-NC 4.0"),
    ("cc0", "cc0 1 0", "dedicated to the public domain under CC0 1.0 Universal"),
)


def _hashes(text: str) -> np.ndarray:
    return Words([text.encode()], LOWER_ALNUM).hash


def word_frequency(docs: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and the number of documents."""

    def count(batches):
        total, n = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            for part in pieces(batch):
                words = Words(texts_of(part), LOWER_ALNUM)
                rank = np.searchsorted(keys, words.hash).clip(max=len(keys) - 1)
                at = np.flatnonzero(keys[rank] == words.hash)
                total += np.bincount(np.unique(words.text_of()[at] * len(keys) + rank[at]) % len(keys), minlength=len(keys))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(len(keys)), -1]), pa.array(np.r_[total, n])], ["i", "c"])

    rows = dict(docs.select("text").mapInArrow(count, "i long, c long").groupBy("i").agg(F.sum("c")).collect())
    return np.array([rows.get(i, 0) for i in range(len(keys))]), rows.get(-1, 0)


def _places(words: Words, phrase: np.ndarray, anchor: int) -> np.ndarray:
    """Where all words of a phrase stand one after another in one text, from the places of its anchor word."""
    start = np.flatnonzero(words.hash == phrase[anchor]) - anchor
    start = start[(start >= 0) & (start + len(phrase) <= len(words))]
    for i, h in enumerate(phrase):
        start = start[words.hash[start + i] == h]
    owner = words.text_of()
    return start[owner[start] == owner[start + len(phrase) - 1]]


class Template:
    """A license text: hashes and weights (inverse document frequencies) of its words, and where its key phrase stands."""

    def __init__(self, label: str, text: str, key: str, idf: dict[int, float]):
        self.label, self.hash, key_hash = label, _hashes(text), _hashes(key)
        self.weight = np.array([idf[int(h)] for h in self.hash])
        self.whole = max(float(self.weight.sum()), 1e-9)
        self.gap = min(GAP, len(self.hash) // PER_GAP)
        size = len(key_hash)
        at = next(i for i in range(len(self.hash) - size + 1) if (self.hash[i : i + size] == key_hash).all())
        self.key = np.arange(at, at + size)
        self.words, position = np.unique(self.hash, return_inverse=True)
        self.of_word = np.bincount(position, self.weight)

    def share(self, file: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The share of the weight that matches around each start; 0 where the key phrase doesn't stand."""
        k = np.arange(len(self.hash))
        there, key = np.zeros((len(start), len(k)), bool), np.zeros(len(start), bool)
        for shift in range(-self.gap, self.gap + 1):
            place = start[:, None] + k + shift
            same = (file[place.clip(0, len(file) - 1)] == self.hash) & (place >= 0) & (place < len(file))
            there |= same
            key |= same[:, self.key].all(axis=1)
        return np.where(key, (there * self.weight).sum(axis=1) / self.whole, 0.0)

    def best(self, file: np.ndarray, share: float) -> float:
        """The largest share in a file, if it is at least `share`, else 0."""
        rank = np.searchsorted(self.words, file).clip(max=len(self.words) - 1)
        place = np.flatnonzero(self.words[rank] == file)
        has = np.unique(rank[place])
        by_idf = has[np.argsort(-self.of_word[has], kind="stable")]
        left = self.of_word[by_idf].sum() - np.cumsum(self.of_word[by_idf])
        looked_up = by_idf[: 1 + int(np.argmax(left < share * self.whole))] if len(left) else by_idf
        starts = [place[rank[place] == w][:, None] - np.flatnonzero(self.hash == self.words[w]) for w in looked_up]
        if not starts:
            return 0.0
        shifts = np.arange(-self.gap, self.gap + 1)
        start = np.unique(np.unique(np.concatenate([x.ravel() for x in starts]))[:, None] + shifts)
        most = max((float(self.share(file, start[i : i + 256]).max()) for i in range(0, len(start), 256)), default=0.0)
        return most if most >= share else 0.0


def scanned(docs: DataFrame, base: dict = BASE, templates=TEMPLATES, share: float = SHARE) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of base phrases; first_word and last_word are their least and largest start. A template's label is added where,
    at some start in the text, its key phrase and at least `share` of its weight stand within the template's gap of their places; only the text's own
    words count. score is 1 with a base phrase, else the largest such share, else 0. Null and empty texts have no words and no labels; long texts
    are scanned whole; repeated rows are scanned each; columns with these seven names are replaced, others stay; an empty table stays empty.
    """
    phrases = [(label, _hashes(text)) for text, label in sorted(base.items())]
    keys = np.unique(np.concatenate([np.zeros(1, U), *(p for _, p in phrases), *(_hashes(text) for _, _, text in templates)]))
    frequency, n_docs = word_frequency(docs, keys)
    idf = dict(zip(keys.tolist(), (math.log(1 + (n_docs - c + 0.5) / (c + 0.5)) for c in frequency.tolist()), strict=True))
    base_plan = [(label, h, max(range(len(h)), key=lambda i, h=h: (idf[int(h[i])], -i))) for label, h in phrases]
    forms = [Template(label, text, key, idf) for label, key, text in templates]
    #: Of each key, its weight in each template: what a file's words could make up at most.
    weights = np.zeros((len(keys), len(forms)))
    for i, form in enumerate(forms):
        weights[np.searchsorted(keys, form.words), i] = form.of_word / form.whole

    def scan(batch):
        words = Words(texts_of(batch), LOWER_ALNUM)
        owner, n = words.text_of(), batch.num_rows
        n_base, low, high = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
        base_labels, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
        for label, h, anchor in base_plan:
            at = _places(words, h, anchor)
            t = owner[at]
            n_base += np.bincount(t, minlength=n)
            np.minimum.at(low, t, at - words.first[t])
            np.maximum.at(high, t, at - words.first[t])
            for i in np.unique(t).tolist():
                base_labels[i].add(label)
                labels[i].add(label)
                score[i] = 1.0
        seen = np.searchsorted(keys, words.hash).clip(max=len(keys) - 1)
        place = np.flatnonzero(keys[seen] == words.hash)
        pair = np.unique(owner[place] * len(keys) + seen[place])
        could = np.zeros((n, len(forms)))
        np.add.at(could, pair // len(keys), weights[pair % len(keys)])
        for i, f in np.argwhere(could >= share - 1e-9).tolist():
            most = forms[f].best(words.hash[words.first[i] : words.first[i + 1]], share)
            if most:
                labels[i].add(forms[f].label)
                score[i] = max(score[i], most)
        has = n_base > 0
        return [
            pa.array(words.counts, pa.int64()),
            pa.array(n_base, pa.int64()),
            pa.array(low, pa.int64(), mask=~has),
            pa.array(high, pa.int64(), mask=~has),
            pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
            pa.array([",".join(sorted(x)) for x in labels], pa.string()),
            pa.array(np.minimum(score, 1.0)),
        ]

    return append(docs, scan, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
