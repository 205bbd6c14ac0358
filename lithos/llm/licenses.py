"""License scans with a positional index of rare words.

Document frequencies of the templates' words are counted over all documents. The index
holds for each of these words its places in the templates. Of each template that a file has
words enough of, the file looks up the words with the highest IDF that it holds; postings that
agree on a relative position, but for a few words put in or left out, are an alignment of the
template, which is scored by the template's words found in order and must hold the template's
mandatory key phrases.

Edge cases: a null or empty text has no words and no labels; a row with a null id is scanned as any
other; very long texts are scanned whole; repeated rows are scanned alike; an empty table gives no
rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.arrow import batch_of, id_and_bytes, pairs

#: A-Z to a-z; digits, letters and all bytes of other characters stay; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that an alignment must hold.
    keys: tuple[str, ...] = ()

    @property
    def words(self) -> tuple[bytes, ...]:
        return tuple(words_of(self.text.encode()))


#: Phrases whose every place is reported.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as they stand in files.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org", "license 2 0")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted", "free of charge")),
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
)
#: Words of a template that are looked up for a file, those with the highest IDF that it has; share of the weight that an alignment needs; words by which it may drift, a fourth of the template at most.
RARE_WORDS, MIN_COVERAGE, DRIFT = 4, 0.8, 4


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many rows each word occurs, over all rows. The vocabulary is the templates' and bounds the result."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for _, data in pairs(batch):
                found.update(vocabulary.intersection(words_of(data)))
        yield batch_of(found.items(), schema)

    counted = id_and_bytes(docs.select(F.lit(0).alias("_k"), F.col(text_col).alias("_t")), "_k", "_t").mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """For each word of the templates its postings (template, place), and its weight."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[bytes, int], n_docs: int, rare_words: int = RARE_WORDS):
        self.templates = [(t.label, t.words, [tuple(words_of(k.encode())) for k in t.keys]) for t in templates]
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) + 1 for t in self.templates for w in t[1]}
        self.rare_words = rare_words
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, words, _) in enumerate(self.templates):
            for i, w in enumerate(words):
                self.postings[w][k].append(i)
        self.postings = {w: dict(p) for w, p in self.postings.items()}
        self.total = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]

    def looked_up(self, here: frozenset[bytes]) -> dict[int, list[bytes]]:
        """For each template of which a file has words enough, the file's words of it with the highest IDF."""
        weight: Counter[int] = Counter()
        own: dict[int, list[bytes]] = defaultdict(list)
        for w in sorted(here, key=lambda w: (-self.idf[w], w)):
            for k, at in self.postings[w].items():
                weight[k] += self.idf[w] * len(at)
                own[k].append(w)
        return {k: own[k][: self.rare_words] for k in own if weight[k] >= MIN_COVERAGE * self.total[k] - 1e-9}

    def alignments(self, words: list[bytes], rare: dict[int, list[bytes]], places: dict[bytes, list[int]]) -> Iterator[tuple[str, int, float]]:
        """(label, first word, score) of each verified alignment."""
        for k, chosen in rare.items():
            starts: dict[int, set[bytes]] = defaultdict(set)
            for w in chosen:
                for i in self.postings[w][k]:
                    for p in places.get(w, ()):
                        starts[p - i].add(w)
            label, own, keys = self.templates[k]
            drift = min(DRIFT, len(own) // 4)
            used: set[int] = set()
            for start in sorted(starts, key=lambda x: (-len(starts[x]), x)):
                near = [x for x in range(start - drift, start + drift + 1) if x in starts]
                if start in used or 2 * len(set().union(*(starts[x] for x in near))) < len(chosen):
                    continue
                found, first, last = self._aligned(own, words, start, drift)
                if found >= MIN_COVERAGE * self.total[k] - 1e-9 and all(_holds(words[first : last + 1], key) for key in keys):
                    used.update(near)
                    yield label, first, found / self.total[k]

    def _aligned(self, own: tuple[bytes, ...], words: list[bytes], start: int, drift: int) -> tuple[float, int, int]:
        """(weight, first place, last place) of the heaviest words of a template that are found in order, none further than ``drift`` from its place."""
        low = max(0, start - drift)
        there = words[low : max(0, start + len(own) + drift)]
        best = [(0.0, 0, -1)] * (len(there) + 1)
        for i, w in enumerate(own):
            row = [best[0]]
            for j, x in enumerate(there):
                up = max(best[j + 1], row[j], key=lambda c: (c[0], c[1] - c[2]))
                if w == x and abs(low + j - start - i) <= drift:
                    weight, first, last = best[j]
                    up = max(up, (weight + self.idf[w], first if last >= 0 else low + j, low + j), key=lambda c: (c[0], c[1] - c[2]))
                row.append(up)
            best = row
        return best[-1]


def _holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    n = len(phrase)
    return any(tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists (label, first word, score) of the aligned templates.
    """
    vocabulary = frozenset(w for t in templates for w in t.words)
    index = Index(templates, document_frequencies(docs, vocabulary, text_col), docs.count())
    base = [(tuple(words_of(p.encode())), label) for p, label in phrases.items()]
    heads = frozenset(p[0] for p, _ in base)
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("score", pa.float64())])

    def look(doc_id: object, data: bytes | None) -> tuple:
        words = words_of(data)
        known = set(words)
        rare = index.looked_up(vocabulary & known)
        here = (heads & known).union(*rare.values())
        if not here:
            return doc_id, len(words), 0, None, None, "", "", 0.0, []
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in here:
                places[w].append(i)
        starts: list[int] = []
        labels = set()
        for phrase, label in base:
            n = len(phrase)
            own = [i for i in places.get(phrase[0], ()) if tuple(words[i : i + n]) == phrase]
            if own:
                starts += own
                labels.add(label)
        found = sorted(index.alignments(words, rare, places), key=lambda x: (x[1], x[0]))
        score = max((x[2] for x in found), default=0.0)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        spans = [{"label": a, "first_word": b, "score": c} for a, b, c in found]
        return doc_id, len(words), len(starts), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in found})), min(1.0, score), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([batch.schema.field("doc_id"), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
            yield batch_of([look(*x) for x in pairs(batch)], out)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,score:double>>"
    )
