"""Licence scan by a positional rare-token index.

The words of whole licence texts are indexed with their positions. Spark counts in how many documents
each licence word occurs. A file looks up its own RARE licence words of the highest inverse document
frequency; every posting of such a word proposes the start its position in the file and in the template
point to, and where VOTES different words agree on a start within SLACK words, the mandatory key phrases
are verified: all words of each phrase in order, with at most one word in five put in between, the
phrases in order and each within SLACK words of its place after the first. So words put in or left out
anywhere between key phrases, and single words put in within a long one, hide no place. A word-for-word
first key phrase is always verified, votes or not, so a licence cut down to its key phrases is found too;
the phrases that the contract names count word for word only. The score is the share of the template's
words that stand in order near their places; a file may begin or end within a template.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import chunks, ends, split_words, text_column

# The phrases that the contract names.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Words of public licences and the phrases without which a text is not that licence.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software the software "
        "is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
        ("licensed under the apache license version 2 0",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution",
        ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify",),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
        "more details",
        ("under the terms of the gnu general public license",),
    ),
    ("gpl", "under the gnu general public license", ("under the gnu general public license",)),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license",),
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("licensed under a creative commons attribution",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
        ("this is free and unencumbered software released into the public domain",),
    ),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)

RARE = 8  # licence words that a file looks up, its rarest first
VOTES = 3  # different words that must agree on a start
SLACK = 32  # words by which a start or a key phrase may be off its place
PER_WORD = 5  # words of a key phrase for each one that may be put in
BLOCK = 1 << 18  # words of licences voted on at a time

_TABLE = bytes(
    c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
MATCH = "array<struct<label: string, start: long, length: int, base: boolean, score: double>>"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[int, ...]
    keys: tuple[tuple[int, int], ...]  # stretches that must match word for word
    base: bool


def build_index(phrases=PHRASES, templates=TEMPLATES) -> tuple[list[str], list[Template]]:
    """The licence vocabulary, and the templates as numbers of its words."""
    vocabulary: dict[str, int] = {}

    def numbers(text: str) -> tuple[int, ...]:
        return tuple(vocabulary.setdefault(w, len(vocabulary)) for w in text.split())

    found = []
    for label, text in phrases:
        words = numbers(text)
        found.append(Template(label, words, ((0, len(words)),), True))
    for label, text, keys in templates:
        words = numbers(text)
        stretches = []
        for key in keys:
            at = re.search(rf"(?:^| ){re.escape(key)}(?: |$)", text).start()
            start = len(text[:at].split())
            stretches.append((start, start + len(key.split())))
        found.append(Template(label, words, tuple(stretches), False))
    return list(vocabulary), found


def normal(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased and every ASCII mark a blank, in place of bytes, so lengths stay. No missing values."""
    _, offsets, data = texts.buffers()
    stops = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(data)[stops[0] : stops[-1]]) if data is not None and len(stops) and stops[-1] > stops[0] else b""
    moved = pa.py_buffer((stops - stops[0] if len(stops) else np.zeros(1, np.int32)).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.string(), len(texts), [None, moved, pa.py_buffer(raw.translate(_TABLE))])


def _numbered(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number of each word (-1: none), flat, and how many words each text has."""
    words, counts = split_words(normal(texts))
    numbers = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return numbers.astype(np.int32), counts


def _frequencies(vocabulary: list[str]):
    def run(batches):
        known, seen = pa.array(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in chunks(batch):
                numbers, counts = _numbered(part.column("text"), known)
                hit = numbers >= 0
                doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)[hit]
                pairs = np.unique(doc * len(vocabulary) + numbers[hit])
                seen += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(vocabulary), dtype=np.int32)), pa.array(seen)], names=["word", "n"]
        )

    return run


def find(
    numbers: np.ndarray, counts: np.ndarray, template: Template, frequency: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts where the template's key phrases stand word for word at their places, the starts within the text and the scores.

    A start below 0 is that of a template whose first words the text leaves out.
    """
    words = np.array(template.words)
    at = ends(counts)
    keyed = np.concatenate([np.arange(a, b) for a, b in template.keys])
    anchor, *others = keyed[np.argsort(frequency[words[keyed]], kind="stable")]
    places = np.flatnonzero(numbers == words[anchor])
    doc = np.searchsorted(at, places, "right") - 1

    def same(j: int) -> np.ndarray:
        moved = places + (j - anchor)
        found = (moved >= at[doc]) & (moved < at[doc + 1])
        found[found] = numbers[moved[found]] == words[j]
        return found

    for j in others:
        keep = same(j)
        places, doc = places[keep], doc[keep]
    score = np.zeros(len(places))
    for j in range(len(words)):
        score += same(j)
    return doc, places - anchor - at[doc], score / len(words)


def rarest(doc: np.ndarray, words: np.ndarray, frequency: np.ndarray, most: int = RARE) -> np.ndarray:
    """Which occurrences are of their text's `most` rarest licence words. Of equally rare words the first in the vocabulary go first."""
    order = np.argsort(frequency, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = doc.astype(np.int64) * len(order) + rank[words]
    distinct = np.unique(keys)
    texts = distinct // len(order)
    first = np.searchsorted(texts, texts)
    chosen = distinct[np.arange(len(distinct)) - first < most]
    at = np.minimum(np.searchsorted(chosen, keys), max(0, len(chosen) - 1))
    return chosen[at] == keys if len(chosen) else np.zeros(len(keys), bool)


def agreed(places: np.ndarray, words: np.ndarray, template: Template) -> np.ndarray:
    """Ranges of 2 * SLACK starts, by number, that postings of VOTES different words point into.

    Range r holds the starts from (r - 1) * SLACK up to (r + 1) * SLACK; each start lies in two. `places`
    rise, with gaps between texts that no template bridges.
    """
    at = np.arange(len(template.words))
    by_word = np.argsort(np.array(template.words), kind="stable")
    sorted_words, positions = np.array(template.words)[by_word], at[by_word]
    reach = len(at) + 2 * SLACK
    width = int(max(words.max(initial=0), max(template.words))) + 1
    found = []
    for start in range(0, len(places), BLOCK):
        # a template that begins in this block ends within `reach` words
        p, w = places[start : start + BLOCK + reach], words[start : start + BLOCK + reach]
        low, high = np.searchsorted(sorted_words, w, "left"), np.searchsorted(sorted_words, w, "right")
        n = high - low
        posting = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        starts = (np.repeat(p, n) - positions[posting]) // SLACK
        votes = np.unique(np.concatenate([starts, starts + 1]) * width + np.tile(np.repeat(w, n), 2))
        ranges, counts = np.unique(votes // width, return_counts=True)
        found.append(ranges[counts >= VOTES])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def phrase_end(words: np.ndarray, at: int, phrase: tuple[int, ...]) -> int:
    """Where `phrase` ends that begins at `at`: its words in order, one in PER_WORD put in; -1: it does not stand there."""
    spare, i = len(phrase) // PER_WORD, at
    for k, word in enumerate(phrase):
        while i < len(words) and words[i] != word and spare and k:
            spare, i = spare - 1, i + 1
        if i >= len(words) or words[i] != word:
            return -1
        i += 1
    return i


def later_phrases(words: np.ndarray, first: int, end: int, template: Template) -> int | None:
    """How far the last key phrase is off its place if all stand in order after the first one; None if one is missing."""
    drift = 0
    for a, b in template.keys[1:]:
        place = first + a - template.keys[0][0]
        low, high = max(end, place - SLACK), place + SLACK + 1
        stops = [(int(i), phrase_end(words, int(i), template.words[a:b])) for i in low + np.flatnonzero(words[low:high] == template.words[a])]
        stands = next(((i, stop) for i, stop in stops if stop >= 0), None)
        if stands is None:
            return None
        drift, end = stands[0] - place, stands[1]
    return drift


def in_order(words: np.ndarray, start: int, template: Template) -> float:
    """Share of the template's words in their order, each within SLACK of its place: a longest rising run of places."""
    tails: list[int] = []
    for p, word in enumerate(template.words):
        low = max(0, start + p - SLACK)
        # falling places: a template word takes one place at most
        for i in (low + np.flatnonzero(words[low : max(0, start + p + SLACK + 1)] == word))[::-1].tolist():
            k = bisect.bisect_left(tails, i)
            tails[k : k + 1] = [i]
    return len(tails) / len(template.words)


def licence_places(numbers: np.ndarray, counts: np.ndarray, templates: list[Template], frequency: np.ndarray):
    """(text, template, start, end, score) of each place of a whole-licence template; start may lie before its text, end after it."""
    at = ends(counts)
    places = np.flatnonzero(numbers >= 0)
    doc = np.searchsorted(at, places, "right") - 1
    mine = rarest(doc, numbers[places], frequency)
    gap = max((len(t.words) for t in templates), default=0) + 4 * SLACK
    spread, voters = places[mine] + doc[mine] * gap, numbers[places[mine]].astype(np.int64)
    for template in templates:
        a, b = template.keys[0]
        phrase = template.words[a:b]
        # word for word: always verified, so that no cut-down licence is lost
        key = Template(template.label, phrase, ((0, len(phrase)),), False)
        literal, begin, _ = find(numbers, counts, key, frequency)
        stands = {(int(d), int(s)): int(s) + len(phrase) for d, s in zip(literal, begin)}
        # proposed by the votes: words may be put in
        ranges = agreed(spread, voters, template)
        if len(ranges):
            first = np.flatnonzero(numbers == phrase[0])
            text = np.searchsorted(at, first, "right") - 1
            number = (first + text * gap - a) // SLACK
            near = np.isin(number[:, None] + np.arange(-1, 3), ranges).any(axis=1)
            taken = set(stands) | {(d, stop) for (d, _), stop in stands.items()}
            for i, d in zip(first[near][::-1].tolist(), text[near][::-1].tolist()):  # of two that end alike the shorter
                words, place = numbers[at[d] : at[d + 1]], i - int(at[d])
                stop = phrase_end(words, place, phrase)
                if stop >= 0 and (d, place) not in stands and (d, stop) not in taken:
                    stands[d, place] = stop
                    taken.add((d, stop))
        for (d, place), stop in sorted(stands.items()):
            words = numbers[at[d] : at[d + 1]]
            drift = later_phrases(words, place, stop, template)
            if drift is not None:
                score = 1.0 if len(phrase) == len(template.words) else in_order(words, place - a, template)
                yield d, template, place - a, place - a + drift + len(template.words), score


def _scanned(vocabulary: list[str], templates: list[Template], frequency: np.ndarray):
    def run(batches):
        known = pa.array(vocabulary)
        phrases, licences = [t for t in templates if t.base], [t for t in templates if not t.base]
        for batch in batches:
            for part in chunks(batch):
                numbers, counts = _numbered(part.column("text"), known)
                places: list[list[dict]] = [[] for _ in counts]

                def add(doc, template, start, end, score):
                    first, last = max(0, int(start)), min(int(counts[doc]), int(end))
                    places[doc].append(
                        {"label": template.label, "start": first, "length": last - first, "base": template.base, "score": float(score)}
                    )

                for t in phrases:
                    for doc, start, score in zip(*find(numbers, counts, t, frequency)):
                        add(doc, t, start, start + len(t.words), score)
                for place in licence_places(numbers, counts, licences, frequency):
                    add(*place)
                for p in places:
                    p.sort(key=lambda m: (m["start"], m["label"], not m["base"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(places, _ARROW)],
                    names=["doc_id", "n_words", "matches"],
                )

    return run


_ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, matches) for each row of `docs` (doc_id, text, ...).

    matches: label, start (in words, from 0), length, base (a phrase) and score of each place. Words
    are runs of digits, letters a-z (A-Z lower-cased) and all non-ASCII characters. A missing
    text counts as empty. Other columns are ignored; rows repeat as they do in `docs`.
    """
    vocabulary, index = build_index(phrases, templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    counted = rows.select("text").mapInArrow(_frequencies(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in counted.collect():  # one row for each licence word
        frequency[r["word"]] = r["n"]
    return rows.mapInArrow(_scanned(vocabulary, index, frequency), f"doc_id long, n_words long, matches {MATCH}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, and labels of each row of `scan`."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def labels(found):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")

    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
