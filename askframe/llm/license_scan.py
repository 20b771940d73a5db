"""Licence scan with a positional rare-token index.

Templates are word sequences. How many documents have each of their words is counted over the whole corpus; a template is
indexed under its rarest words (highest inverse document frequency), with their positions, and under so many that a copy with
COVER of the words in place keeps one of them. A file's licence words are looked up, rarest first; a hit at file position p for
template position q says that the template starts at p - q, and at each such start the postings are intersected word by word.
Phrases must agree in full; longer templates need COVER of their words and their mandatory key phrase.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_schema, each

# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Words of well-known licence notices (opening, grant or disclaimer), label, mandatory key phrase.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit", "permission is hereby granted free of charge"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution and use in source and binary forms"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "permission is hereby granted free of charge"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit", "fitness for a particular purpose and noninfringement"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "with or without fee is hereby granted"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", "must retain the above copyright notice"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause", "endorse or promote products derived"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2.0", "apache license version 2 0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0", "unless required by applicable law or agreed to in writing"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "gnu general public license"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl", "gnu general public license"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl", "gnu lesser general public license"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl", "gnu affero general public license"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", "mozilla public license"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", "eclipse public license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", "in no event will the authors be held liable"),
    ("distributed under the boost software license version 1 0", "bsl-1.0", "boost software license"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0", "waived all copyright and related or neighboring rights"),
    ("released under the mit license", "mit", "mit license"),
    ("licensed under the apache license", "apache", "apache license"),
    ("spdx license identifier", "spdx", "spdx license identifier"),
)
OUT = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
#: Share of a notice's words that must stand at the agreed offset.
COVER = 0.8
_DELIMITERS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: A-Z become a-z, other bytes outside [0-9a-z] and below 0x80 become blanks.
_TO_WORDS = bytes.maketrans(_DELIMITERS, bytes(0x20 if chr(c) not in UPPER else ord(LOWER[c - 65]) for c in _DELIMITERS))


class RareTokenIndex:
    """word -> [(template number, position)] for the rarest words of each template; df: documents with a word, of n_docs."""

    def __init__(self, base=BASE, notices=NOTICES, df: dict[bytes, int] | None = None, n_docs: int = 0):
        self.templates = [(p.encode().split(), label, None) for p, label in base] + [(p.encode().split(), label, key.encode().split()) for p, label, key in notices]
        self.vocabulary = frozenset(w for words, _, _ in self.templates for w in words)
        if df is None:  # nothing was counted: the templates are the documents
            df, n_docs = Counter(w for words, _, _ in self.templates for w in set(words)), len(self.templates)
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (words, _, key) in enumerate(self.templates):
            may_miss = 0 if key is None else math.floor(len(words) * (1 - COVER) + 1e-9)
            for i in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], i))[: may_miss + 1]:
                self.postings[words[i]].append((t, i))
        self.keys = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, the notices' labels, the best share of a template found."""
        if self.keys.isdisjoint(words):
            return [], set(), set(), 0.0
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in self.keys:
                places[w].append(p)
        starts, base, more, score = [], set(), set(), 0.0
        seen: set[tuple[int, int]] = set()
        for w in sorted(places, key=lambda w: -self.idf[w]):
            for t, q in self.postings[w]:
                words_t, label, key = self.templates[t]
                for at in (p - q for p in places[w]):
                    if (t, at) in seen:
                        continue
                    seen.add((t, at))
                    if key is None:
                        if at >= 0 and words[at : at + len(words_t)] == words_t:
                            starts.append(at)
                            base.add(label)
                            score = 1.0
                        continue
                    found = sum(0 <= at + i < len(words) and words[at + i] == x for i, x in enumerate(words_t)) / len(words_t)
                    if found < COVER - 1e-9:
                        continue
                    near = words[max(0, at) : max(0, at + len(words_t) + len(key))]
                    if any(near[i : i + len(key)] == key for i in range(len(near))):
                        more.add(label)
                        score = max(score, found)
        return starts, base, more, score


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many rows each word of the vocabulary stands, and how many rows there are: a number for each word reaches the driver."""
    schema = "word binary, n long"
    out = arrow_schema(docs.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in each(batch.column(0)):
                n.update(vocabulary.intersection(words_of(text)))
            n[b""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], schema=out)

    got = {bytes(r.word): r.n for r in docs.select("text").mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop(b"", 0)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def scan_licenses(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per document, after a count of the templates' words over all documents. docs: doc_id, text.

    Defined cases: null and empty texts have no words, null first_word and last_word, empty label lists and score 0;
    repeated rows come back once each; texts of any length are scanned whole; two templates at one place both count once;
    further columns are not looked at; an empty table gives an empty one.
    """
    schema = OUT.format(id=docs.schema["doc_id"].dataType.simpleString())
    out = arrow_schema(docs.sparkSession, schema)
    df, n_docs = word_frequencies(docs, RareTokenIndex(base, notices).vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(base, notices, df, n_docs)
        for batch in batches:
            rows = []
            for text in each(batch.column(1)):
                words = words_of(text)
                starts, found, more, score = index.scan(words)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found)), ",".join(sorted(found | more)), score))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], out.field(i + 1).type) for i in range(7))], schema=out)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
