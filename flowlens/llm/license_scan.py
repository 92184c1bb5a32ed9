"""Licence scans over a positional rare-token index.

The templates' words form an index: word -> (phrase, place).  For each phrase
of a file the file's highest-IDF licence word is looked up; its places give
the phrase's possible starts, which are intersected with the places of the
phrase's other words by relative position, rarest first, so every occurrence
is found.  Occurrences of one template are then aligned: its label holds where
all its mandatory key phrases stand at their relative places, give or take
SLACK words.

IDF comes from one counting pass over all texts.  It decides the order of
look-ups only; what is found does not depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import ALNUM, Words, free_name, slices, text_column

#: Words by which key phrases may be nearer or farther than in the template.
SLACK = 16


@dataclass(frozen=True)
class Template:
    """A licence text with the key phrases it must hold; a base template is a
    phrase whose every place counts."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def placed(self) -> list[tuple[int, list[str]]]:
        """(place in the template, words) of every key phrase."""
        words = split(self.text)
        out = []
        for key in self.keys:
            w = split(key)
            at = [p for p in range(len(words) - len(w) + 1) if words[p:p + len(w)] == w]
            out.append((at[0], w))
        return out


def split(text: str) -> list[str]:
    return Words(pa.array([text], pa.string()), ALNUM).words.to_pylist()


def _phrase(label: str, text: str, base: bool = False) -> Template:
    return Template(label, text, (text,), base)


# The base phrases and public licence notices with their key phrases.
TEMPLATES: tuple[Template, ...] = (
    _phrase("gpl", "gnu general public license", True),
    _phrase("apache", "apache license", True),
    _phrase("cc-by", "cc by", True),
    _phrase("mit", "mit license", True),
    _phrase("gpl-2.0", "gnu general public license version 2"),
    _phrase("gpl-3.0", "gnu general public license version 3"),
    _phrase("apache-2.0", "apache license version 2 0"),
    _phrase("cc-by-nc", "cc by nc"),
    _phrase("cc-by-sa", "cc by sa"),
    _phrase("lgpl", "gnu lesser general public license"),
    _phrase("mpl", "mozilla public license"),
    Template("mit",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
             "subject to the following conditions: The above copyright notice and this permission notice shall be "
             "included in all copies or substantial portions of the Software.",
             ("permission is hereby granted free of charge", "to deal in the software without restriction",
              "the above copyright notice and this permission notice shall be included")),
    Template("isc",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
             "copies.",
             ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted",
              "this permission notice appear in all copies")),
    Template("bsd",
             "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met: Redistributions of source code must retain the above "
             "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
             "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
             "in the documentation and/or other materials provided with the distribution.",
             ("redistribution and use in source and binary forms", "redistributions of source code must retain",
              "redistributions in binary form must reproduce")),
    Template("apache-2.0",
             "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
             "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
             "CONDITIONS OF ANY KIND, either express or implied.",
             ("licensed under the apache license version 2 0", "you may not use this file except in compliance",
              "unless required by applicable law or agreed to in writing")),
    Template("gpl",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation, either version 3 of the License, "
             "or (at your option) any later version. This program is distributed in the hope that it will be "
             "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR "
             "A PARTICULAR PURPOSE.",
             ("free software you can redistribute it and or modify it", "as published by the free software foundation",
              "without even the implied warranty of merchantability")),
    Template("unlicense",
             "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
             "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
             "compiled binary, for any purpose",
             ("free and unencumbered software released into the public domain", "anyone is free to copy")),
)


@dataclass
class Phrase:
    template: int
    place: int
    words: list[int]


class LicenseIndex:
    """Vocabulary, phrases and look-up order of a set of templates."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.templates = templates
        self.numbers: dict[str, int] = {}
        self.phrases = [Phrase(t, at, [self.numbers.setdefault(w, len(self.numbers)) for w in words])
                        for t, template in enumerate(templates) for at, words in template.placed()]
        self.labels = sorted({t.label for t in templates})
        if len(self.labels) > 62:
            raise ValueError("at most 62 labels fit the label mask")
        self.idf = [0.0] * len(self.numbers)
        # farther apart than any two aligned starts of one text can be
        self.gap = SLACK + 1 + max(p.place for p in self.phrases)

    def weigh(self, n_docs: int, df: dict[int, int]) -> LicenseIndex:
        self.idf = [math.log((n_docs + 1) / (df.get(w, 0) + 1)) for w in range(len(self.numbers))]
        return self

    @property
    def vocabulary(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.string())

    def mask(self, base: bool | None = None) -> np.ndarray:
        """Bit of every template's label (of base templates, if asked)."""
        return np.array([1 << self.labels.index(t.label) if base is None or t.base == base else 0
                         for t in self.templates], np.int64)


def license_words(words: Words, vocabulary: pa.Array) -> np.ndarray:
    """Every word's number in the vocabulary, -1 for other words."""
    return pc.fill_null(pc.index_in(words.words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: pa.Array) -> tuple[int, dict[int, int]]:
    """(documents, documents with each licence word); one row a word and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            texts = text_column(batch, text_col)
            n += len(texts)
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), ALNUM)
                found = license_words(words, vocabulary)
                at = np.flatnonzero(found >= 0)
                row = np.searchsorted(words.first, at, side="right") - 1
                pairs = np.unique(row * len(vocabulary) + found[at])
                df += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1], pa.int64()),
                                          pa.array([*df.tolist(), n], pa.int64())], names=["word", "n"])

    got = dict(map(tuple, docs.select(text_col).mapInArrow(count, "word long, n long")
                   .groupBy("word").agg(F.sum("n")).collect()))  # the vocabulary's words and a total
    return got.pop(-1, 0), got


def occurrences(index: LicenseIndex, words: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, start) of every occurrence in a slice of texts, by
    phrase and start; starts count from the slice's first word."""
    known = np.flatnonzero(found >= 0)
    by_word = known[np.argsort(found[known], kind="stable")]
    bounds = np.searchsorted(found[by_word], np.arange(len(index.numbers) + 1))
    phrase, start = [], []
    for p, wanted in enumerate(index.phrases):
        rarest_first = sorted(range(len(wanted.words)), key=lambda j: (-index.idf[wanted.words[j]], j))
        w, j = wanted.words[rarest_first[0]], rarest_first[0]
        at = by_word[bounds[w]:bounds[w + 1]] - j
        row = np.searchsorted(words.first, at + j, side="right") - 1
        at = at[(at >= words.first[row]) & (at + len(wanted.words) <= words.first[row + 1])]
        for j in rarest_first[1:]:
            if not len(at):
                break
            at = at[found[at + j] == wanted.words[j]]
        phrase.append(np.full(len(at), p))
        start.append(at)
    return np.concatenate(phrase), np.concatenate(start)


def verify(index: LicenseIndex, row: np.ndarray, phrase: np.ndarray, start: np.ndarray,
           n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mask of the labels whose key phrases all align, and the best
    share of a template's key phrases in one alignment."""
    mask, share = np.zeros(n_rows, np.int64), np.zeros(n_rows)
    bits = index.mask()
    for t in range(len(index.templates)):
        own = [p for p, x in enumerate(index.phrases) if x.template == t]
        # where the template would begin; texts lie farther apart than SLACK
        begins = {p: start[phrase == p] - index.phrases[p].place + row[phrase == p] * index.gap for p in own}
        rows = {p: row[phrase == p] for p in own}
        for p in own:
            if not len(begins[p]):
                continue
            held = sum((np.searchsorted(begins[q], begins[p] + SLACK, "right") >
                        np.searchsorted(begins[q], begins[p], "left")).astype(np.int64) for q in own)
            np.maximum.at(share, rows[p], held / len(own))
            mask[rows[p][held == len(own)]] |= bits[t]
    return mask, share


def _names_of(masks: np.ndarray, labels: list[str]) -> pa.Array:
    distinct, code = np.unique(masks, return_inverse=True)
    named = [[x for b, x in enumerate(labels) if int(m) >> b & 1] for m in distinct]
    return pa.array([named[c] for c in code], pa.list_(pa.string()))


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                  templates: tuple[Template, ...] = TEMPLATES) -> tuple[DataFrame, dict]:
    """Documents with their licences.

    Returns the frame (columns ``keep``, all by default, plus five) and the
    names of the five: ``n_words`` bigint; ``places``, every occurrence of a key
    phrase as (label, base, start, end) in words from 0, by start, end and label;
    ``base_labels`` and ``labels``, the labels of the base phrases found and
    of all templates whose key phrases align, sorted; ``share`` (0 to 1), the
    best share of a template's key phrases in one alignment.

    Null and empty texts have no word and no licence.  Phrases may overlap and
    every place counts.  A text of any length is scanned whole, a text longer
    than a slice alone.  Repeated rows each get a row; an empty table gives an
    empty table; columns of the same names stay, the new ones get underscores.
    """
    keep = docs.columns if keep is None else keep
    names = {k: free_name(docs, k) for k in ("n_words", "places", "base_labels", "labels", "share")}
    index = LicenseIndex(templates)
    index.weigh(*document_frequencies(docs, text_col, index.vocabulary))
    docs = docs.select(*dict.fromkeys([*keep, text_col]))
    fields = [f for f in docs.schema.fields if f.name in keep]
    strings = T.ArrayType(T.StringType())
    place = T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = (T.LongType(), place, strings, strings, T.DoubleType())
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(names.values(), kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, text_col)
            kept = [batch.schema.get_field_index(f.name) for f in fields]
            for lo, hi in slices(texts):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in kept), *_scan(index, texts.slice(lo, hi - lo))],
                    names=schema.fieldNames())

    return docs.mapInArrow(run, schema), names


def _scan(index: LicenseIndex, texts: pa.StringArray) -> list[pa.Array]:
    words = Words(texts, ALNUM)
    phrase, start = occurrences(index, words, license_words(words, index.vocabulary))
    row = np.searchsorted(words.first, start, side="right") - 1
    mask, share = verify(index, row, phrase, start, len(texts))
    template = np.array([p.template for p in index.phrases])[phrase]
    base_bit = index.mask(base=True)[template]
    base_mask = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(base_mask, row, base_bit)
    label = np.array([index.labels.index(t.label) for t in index.templates])[template]
    end = start + np.array([len(p.words) for p in index.phrases])[phrase]
    order = np.lexsort((label, end, start))
    row, start, end, label, is_base = (x[order] for x in (row, start, end, label, base_bit > 0))
    shift = words.first[row]
    places = pa.StructArray.from_arrays(
        [pa.array(np.array(index.labels, dtype=object)[label], pa.string()), pa.array(is_base, pa.bool_()),
         pa.array(start - shift, pa.int64()), pa.array(end - shift, pa.int64())], ["label", "base", "start", "end"])
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    return [pa.array(words.per_text(), pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), places),
            _names_of(base_mask, index.labels), _names_of(mask, index.labels), pa.array(share, pa.float64())]
