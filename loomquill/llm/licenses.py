"""License scans by a positional rare-token index.

Templates are whole license texts, where these are short, and the notices by
which works put themselves under a license; they are split into words and indexed
by position.  Each template's words are ranked by inverse document frequency,
counted over all rows of the scanned table; its ``anchors`` rarest words are its
postings.  Only a file's words of highest IDF, those that are some template's
anchors, are looked up in that index, the rarest first; postings whose file
position minus template position agree vote for an alignment, and an alignment
with enough votes is verified: every mandatory key phrase of the template must
stand in the file, word for word, within a few words of its place.

All phrases are matched on exact words: hashes find, bytes decide.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .spark import need

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: tuple[str, ...]


#: Grants, notices and texts of common public licenses.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this program is free software you can redistribute it under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "this library is free software under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright under cc0 1 0", ("cc0 1 0",)),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
        ("to deal in the software without restriction", "the software is provided as is"),
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
        BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""",
        ("redistributions of source code must retain the above copyright notice", "neither the name of the copyright holder"),
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        ("the origin of this software must not be misrepresented",),
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain.""",
        ("free and unencumbered software released into the public domain", "in jurisdictions that recognize copyright laws"),
    ),
    Template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
        ("apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template(
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
        ("gnu general public license as published by the free software foundation", "either version 3 of the license"),
    ),
    Template(
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at""",
        ("mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
)


def _split(text: str) -> list[bytes]:
    buf, off = T.as_bytes(pa.array([text]))
    buf = T.LOWER[buf]
    starts, ends, _ = T.words(buf, off, T.ALNUM)
    return [buf[a:b].tobytes() for a, b in zip(starts, ends)]


def _hashes(words: list[bytes]) -> np.ndarray:
    flat = b" ".join(words)
    size = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(size + 1) - size - 1
    return T.word_hashes(np.frombuffer(flat, np.uint8), starts, starts + size)


class Index:
    """Base phrases and templates over one vocabulary, with postings of each template's rarest words."""

    def __init__(self, phrases: dict[str, str], templates: tuple[Template, ...]):
        self.phrases = [(_split(p), label) for p, label in phrases.items()]
        self.templates = [(t.label, _split(t.text), [_split(k) for k in t.key]) for t in templates]
        self.vocabulary = sorted({w for p, _ in self.phrases for w in p} | {w for _, t, keys in self.templates for w in [*t, *(x for k in keys for x in k)]})
        h = _hashes(self.vocabulary)
        self.order = np.argsort(h)
        self.sorted_hashes = h[self.order]
        self.id = {w: k for k, w in enumerate(self.vocabulary)}
        self.postings: dict[int, list[tuple[int, int]]] = {}

    def rank(self, frequency: np.ndarray, rows: int, anchors: int) -> None:
        """Postings from document frequencies: the ``anchors`` words of highest IDF of each template, ties to the earlier."""
        self.idf = np.log((rows + 1) / (frequency + 1)) + 1
        found = defaultdict(list)
        for k, (_, words, _) in enumerate(self.templates):
            places = sorted(range(len(words)), key=lambda i: (-self.idf[self.id[words[i]]], i))[:anchors]
            for i in places:
                found[self.id[words[i]]].append((k, i))
        self.postings = dict(found)

    def match(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers whose word is in the vocabulary, and its ids there."""
        h = T.word_hashes(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.sorted_hashes, h), len(self.order) - 1)
        hit = np.flatnonzero(self.sorted_hashes[at] == h)
        ids = self.order[at[hit]]
        same = np.array([buf[starts[w] : ends[w]].tobytes() == self.vocabulary[i] for w, i in zip(hit, ids)], dtype=bool)
        return hit[same], ids[same]

    def scan(self, at: np.ndarray, ids: np.ndarray, votes: int, slack: int) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """One file's licence words, at word numbers ``at``: base places, first, last, base labels, further labels, score."""
        word = dict(zip(at.tolist(), ids.tolist()))
        places, base = [], set()
        runs = set(word)
        for words, label in self.phrases:
            want = [self.id[w] for w in words]
            for p in sorted(runs):
                if word[p] == want[0] and all(word.get(p + j) == x for j, x in enumerate(want)):
                    places.append(p)
                    base.add(label)
        more, score = set(), 1.0 if places else 0.0
        aligned = defaultdict(int)
        for p in sorted((p for p in runs if word[p] in self.postings), key=lambda p: (-self.idf[word[p]], p)):
            for k, i in self.postings[word[p]]:
                aligned[k, p - i] += 1
        for (k, shift), n in aligned.items():
            label, words, keys = self.templates[k]
            if n >= min(votes, len(words)) and all(self._near(word, key, shift, words, slack) for key in keys):
                more.add(label)
                score = max(score, sum(word.get(shift + i) == self.id[w] for i, w in enumerate(words)) / len(words))
        return len(places), min(places, default=None), max(places, default=None), base, more, score

    def _near(self, word: dict[int, int], key: list[bytes], shift: int, words: list[bytes], slack: int) -> bool:
        """Whether ``key`` stands, consecutively, within ``slack`` words of its place in the aligned template."""
        place = next((i for i in range(len(words)) if words[i : i + len(key)] == key), 0)
        want = [self.id[w] for w in key]
        return any(all(word.get(shift + place + d + j) == x for j, x in enumerate(want)) for d in range(-slack, slack + 1))


def document_frequency(docs: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """In how many rows each word of the index's vocabulary stands, over all rows, and the number of rows.

    Partial counts, one short array a task, are added on the way; the result is
    as large as the vocabulary of the templates, whatever the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            column = batch.column(0)
            rows += len(column)
            for a, b in T.pieces(column):
                buf, off = T.as_bytes(column.slice(a, b - a))
                buf = T.LOWER[buf]
                starts, ends, of = T.words(buf, off, T.ALNUM)
                hit, ids = index.match(buf, starts, ends)
                row = np.searchsorted(of, hit, side="right") - 1
                pairs = np.unique(row * len(index.vocabulary) + ids)
                count += np.bincount(pairs % len(index.vocabulary), minlength=len(count))
        keep = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1)), pa.array(np.append(count[keep], rows))], names=["word", "n"])

    total = need(docs, text="string").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count, rows = np.zeros(len(index.vocabulary), np.int64), 0
    for word, n in total:
        if word < 0:
            rows = n
        else:
            count[word] = n
    return count, rows


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[Template, ...] | None = None, anchors: int = 4, votes: int = 2, slack: int = 2) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 for a base phrase, else the share of the best verified
    template that stands in its place, else 0.  Null text counts as empty (0
    words, empty labels); repeated rows and null ids pass through; other columns
    are left out.  An empty table gives an empty result.
    """
    index = Index(phrases or PHRASES, templates or TEMPLATES)
    frequency, rows = document_frequency(docs, index)
    index.rank(frequency, rows, anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in T.pieces(column):
                buf, off = T.as_bytes(column.slice(a, b - a))
                buf = T.LOWER[buf]
                starts, ends, of = T.words(buf, off, T.ALNUM)
                hit, word = index.match(buf, starts, ends)
                cut = np.searchsorted(hit, of)
                found = [
                    index.scan(hit[cut[k] : cut[k + 1]] - of[k], word[cut[k] : cut[k + 1]], votes, slack) if cut[k + 1] > cut[k] else (0, None, None, set(), set(), 0.0)
                    for k in range(b - a)
                ]
                n, first, last, base, more, score = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(np.diff(of)),
                        pa.array(n, pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(base, more)]),
                        pa.array(score, pa.float64()),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return need(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
