"""License scans: an exact set-similarity join of text blocks with license templates.

A block is as many consecutive words as its template has, and a quarter more; blocks slide word by word. It matches if it
holds at least `need` of the template's distinct words, its names among them. Template words are ordered by how many
documents hold them, rarest first: a matching block must hold one of the first |T| - need + 1, so only the surroundings of
such words are looked at, and those with too few words (length filter) or with too few left after the first match
(positional filter) go before blocks are compared. Where templates' blocks overlap and one template's words hold all of
another's, the wider one tells: an Attribution-NonCommercial notice isn't an Attribution one as well.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import map_slices

# Phrases with their labels; public license notices with theirs and the words that no match may lack.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ""),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "",
    ),
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Licensed under the MIT License", "mit"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("bsd", "Released under the BSD License", "bsd"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ""),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "apache 2",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu 3"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", "gnu affero 3"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", "gnu lesser 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons attribution noncommercial 4"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons attribution sharealike 4"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "commons attribution noderivatives 4"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "commons attribution noncommercial sharealike 4"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "commons attribution noncommercial noderivatives 4"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa 4"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd 4"),
)
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased; all else separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def phrase_places(words: list[bytes], phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after another."""
    line = b" %s " % b" ".join(words)
    found = []
    for phrase, label in phrases:
        key = b" %s " % phrase.encode()
        at = line.find(key)
        while at >= 0:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(key, at + 1)
    return found


class Template(NamedTuple):
    label: str
    ranks: tuple[int, ...]  # of its distinct words, rarest first
    need: int
    span: int  # words of a block
    names: frozenset[int]  # ranks that no match may lack


class Match(NamedTuple):
    template: int
    first: int  # word of the block's first template word
    last: int
    share: float


def block_span(n_words: int) -> int:
    """Words of a block for a template of n_words, repeats included."""
    return n_words + n_words // 4


class Index:
    """Templates ready for the join. frequency: documents that hold each word; words without one come first."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...], frequency: dict[bytes, int], containment: float):
        split = [(label, words_of(text), words_of(names)) for label, text, names in templates]
        order = sorted(set().union(*(words for _, words, _ in split)), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.templates = [
            Template(label, tuple(sorted({self.rank[w] for w in words})), max(1, ceil(containment * len(set(words)) - 1e-9)), block_span(len(words)), frozenset(self.rank[w] for w in names))
            for label, words, names in split
            if words
        ]
        #: Prefix word -> (template, place in it) of every template that has it in its prefix.
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        sets = [frozenset(t.ranks) for t in self.templates]
        for t, template in enumerate(self.templates):
            for place in range(len(template.ranks) - template.need + 1):
                self.prefix.setdefault(order[template.ranks[place]], []).append((t, place))
        #: Templates whose words hold all of a template's and more.
        self.wider = [[o for o, other in enumerate(sets) if own < other] for own in sets]
        self.sets = sets

    def blocks(self, t: int, at: list[int], ranks: list[int]) -> list[Match]:
        """The matching blocks that start at a template word; at, ranks: places and ranks of the words in order."""
        template, out = self.templates[t], []
        held: dict[int, int] = {}
        end = 0
        for k, first in enumerate(at):
            while end < len(at) and at[end] < first + template.span:
                held[ranks[end]] = held.get(ranks[end], 0) + 1
                end += 1
            if len(held) >= template.need and template.names <= held.keys():
                out.append(Match(t, first, at[end - 1], len(held) / len(template.ranks)))
            held[ranks[k]] -= 1
            if not held[ranks[k]]:
                del held[ranks[k]]
        return out

    def matches(self, words: list[bytes]) -> list[Match]:
        """Every block that starts at a template word, reaches the threshold and has no wider template's block over it."""
        prefix, rank = self.prefix, self.rank
        near: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(words):
            for t, place in prefix.get(w, ()):
                near.setdefault(t, []).append((k, place))
        found: dict[int, list[Match]] = {}
        for t, hits in near.items():
            template, own = self.templates[t], self.sets[t]
            a = 0
            while a < len(hits):
                # Prefix words whose surroundings overlap are looked at together.
                b = a
                while b + 1 < len(hits) and hits[b + 1][0] - hits[b][0] < 2 * template.span:
                    b += 1
                begin, stop = max(0, hits[a][0] - template.span + 1), hits[b][0] + template.span
                at, ranks = [], []
                for k, w in enumerate(words[begin:stop], begin):
                    r = rank.get(w)
                    if r in own:
                        at.append(k)
                        ranks.append(r)
                distinct = set(ranks)
                least = min(place for _, place in hits[a : b + 1])
                after = sum(r >= template.ranks[least] for r in distinct)
                if len(distinct) >= template.need and min(len(template.ranks) - least, after) >= template.need:
                    found.setdefault(t, []).extend(self.blocks(t, at, ranks))
                a = b + 1
        return [
            m
            for t, blocks in found.items()
            for m in blocks
            if not any(o.first <= m.last and m.first <= o.last for w in self.wider[t] for o in found.get(w, ()))
        ]


def spans_of(found: list[Match], templates: list[Template]) -> list[dict]:
    """Overlapping blocks of a template as one span with its largest share, in order of words."""
    out: list[dict] = []
    for m in sorted(found, key=lambda m: (m.template, m.first)):
        if out and out[-1]["t"] == m.template and m.first <= out[-1]["last_word"]:
            out[-1]["last_word"] = max(out[-1]["last_word"], m.last)
            out[-1]["share"] = max(out[-1]["share"], m.share)
        else:
            out.append({"t": m.template, "label": templates[m.template].label, "first_word": m.first, "last_word": m.last, "share": m.share})
    return sorted(({k: v for k, v in s.items() if k != "t"} for s in out), key=lambda s: (s["first_word"], s["label"], s["last_word"]))


def word_frequency(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each template word; no more rows than template words come to the driver."""
    wanted = sorted(set().union(*(words_of(text) for _, text, _ in templates)))

    def kernel(batch: pa.RecordBatch) -> dict:
        place = {w: k for k, w in enumerate(wanted)}
        known, counts = frozenset(wanted), np.zeros(len(wanted), np.int64)
        for text in batch.column(text_col).to_pylist():
            for w in known.intersection(words_of(text)):
                counts[place[w]] += 1
        held = np.flatnonzero(counts)
        return {"word": pa.array(held), "n": pa.array(counts[held])}

    found = map_slices(docs.select(text_col), kernel, "word long, n long", text_col).groupBy("word").agg(F.sum("n").alias("n"))
    return {wanted[r["word"]]: r["n"] for r in found.collect()}


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word long, base_labels, labels string, score double, spans) of every row.

    Base columns tell of phrases; labels adds those of every template of which a block holds at least `containment` of
    the distinct words and all of its names. score is the largest containment, 1 with a phrase, 0 without any label;
    spans array<struct<label, first_word, last_word, share>> says where, overlapping blocks of a template as one.
    templates: (label, text, names) of any length; a template without words matches nothing.

    Null and empty texts have no words; very long ones are scanned whole. Rows are scanned alone, so repeated ones come
    out as often as they come in, ids don't matter, and columns other than id_col and text_col are ignored."""
    frequency = word_frequency(docs, templates, text_col)
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))

    def kernel(batch: pa.RecordBatch) -> dict:
        index = Index(templates, frequency, containment)
        rows = []
        for text in batch.column(text_col).to_pylist():
            words = words_of(text)
            places = phrase_places(words, phrases)
            matches = index.matches(words)
            base = {label for _, label in places}
            labels = base | {index.templates[m.template].label for m in matches}
            at = [k for k, _ in places]
            score = 1.0 if places else max((m.share for m in matches), default=0.0)
            rows.append((len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans_of(matches, index.templates)))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span)
        return {id_col: batch.column(id_col)} | {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", spans array<struct<label:string,first_word:long,last_word:long,share:double>>"
    return map_slices(docs.select(id_col, text_col), kernel, schema, text_col)
