"""License scans: MinHash bands over overlapping windows of words retrieve templates; shingle containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import hashes, mix, slices, text_batches

#: Notices that files and pages carry, by name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Words of a shingle; share of a template's shingles that a window has to hold; chance to miss such a window, at most.
WIDTH, CONTAINMENT, MISS = 5, 0.8, 1e-6
#: Letters and digits make words; everything else parts them, so that line breaks and comment signs don't matter.
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Templates broadcast with a task, at most.
MAX_TEMPLATES = 10_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.lower().encode()) if text else []


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of width words; of fewer words, one of all."""
    if not len(h):
        return h
    out = h[: max(len(h) - width + 1, 1)].copy()
    for j in range(1, min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return out


@dataclass(frozen=True)
class Scale:
    """Templates of about the same number of shingles, and the windows that find them.

    window: shingles of a window; stride: from one window to the next, so that some window holds any stretch as long as the
    longest template. bands: of one row each, so many that a window with the least similarity that containment
    leaves open is missed in all of them with at most the given chance.
    """

    window: int
    stride: int
    bands: int
    names: tuple[int, ...]


def scales(sizes: list[int], containment: float = CONTAINMENT, miss: float = MISS) -> list[Scale]:
    by: dict[int, list[int]] = {}
    for k, n in enumerate(sizes):
        by.setdefault(max(n - 1, 0).bit_length(), []).append(k)
    out = []
    for _, names in sorted(by.items()):
        longest, shortest = max(sizes[k] for k in names), min(sizes[k] for k in names)
        stride = max(1, longest // 4)
        window = longest + stride - 1
        least = containment * shortest
        similarity = least / (window + shortest - least)
        out.append(Scale(window, stride, math.ceil(math.log(miss) / math.log(1 - similarity)), tuple(names)))
    return out


def _salt(band: int) -> np.uint64:
    return np.uint64((0xD6E8FEB86659FD93 * (2 * band + 1)) % (1 << 64))


class Index:
    """The templates' shingles and bands."""

    def __init__(self, templates: dict[str, str], width: int, containment: float, miss: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"at most {MAX_TEMPLATES} templates go with a task")
        self.names = sorted(templates)
        self.width, self.containment = width, containment
        self.lengths = [len(words_of(templates[k])) for k in self.names]
        self.shingles = [np.unique(shingle_hashes(hashes(words_of(templates[k])), width)) for k in self.names]
        kept = [k for k, n in enumerate(self.lengths) if n]
        self.scales = scales([len(self.shingles[k]) for k in kept], containment, miss)
        self.scales = [Scale(s.window, s.stride, s.bands, tuple(kept[k] for k in s.names)) for s in self.scales]
        self.bands = [self._minima(s) for s in self.scales]

    def _minima(self, scale: Scale) -> dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]]:
        """The band index, by words of a shingle: shingles that are the least of a template in some band, in order, with the bands and templates."""
        by: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k in scale.names:
            table = by.setdefault(min(self.lengths[k], self.width), {})
            for b in range(scale.bands):
                least = self.shingles[k][int(np.argmin(mix(self.shingles[k] ^ _salt(b))))]
                table.setdefault(int(least), []).append((b, k))
        return {own: (np.array(sorted(table), np.uint64), [table[x] for x in sorted(table)]) for own, table in by.items()}

    def scan(self, h: np.ndarray) -> dict[int, tuple[float, int]]:
        """For each template found: containment in the best window, and that window's first word."""
        out: dict[int, tuple[float, int]] = {}
        # A template of fewer words than a shingle is one shingle of all its words.
        for scale, tables in zip(self.scales, self.bands, strict=True):
            for own, (minima, bands) in tables.items():
                if len(h) >= own:
                    self._scan(shingle_hashes(h, own), scale, minima, bands, out)
        return out

    def _scan(self, x: np.ndarray, scale: Scale, minima: np.ndarray, bands: list[list[tuple[int, int]]], out: dict) -> None:
        """Windows whose least shingle in a band is a template's are compared with it in all shingles.

        A window meets a template in a band if it has the template's least shingle there, and nothing that is less. So bands are read off where such
        shingles stand, and a text without any needs no window's minimum.
        """
        at = np.minimum(np.searchsorted(minima, x), len(minima) - 1)
        known: dict[tuple[int, int], int] = {}
        seen: set[tuple[int, int]] = set()
        for p in np.flatnonzero(minima[at] == x).tolist():
            value = x[p]
            for w in range(max(0, -(-(p - scale.window + 1) // scale.stride)) * scale.stride, p + 1, scale.stride):
                part = x[w : w + scale.window]
                for b, k in bands[at[p]]:
                    if (w, k) in seen:
                        continue
                    if (w, b) not in known:
                        known[w, b] = int(mix(part ^ _salt(b)).min())
                    if known[w, b] != int(mix(np.array([value]) ^ _salt(b))[0]):
                        continue
                    seen.add((w, k))
                    share = float(np.isin(self.shingles[k], part).mean())
                    if share >= self.containment and (k not in out or (share, -w) > (out[k][0], -out[k][1])):
                        out[k] = (share, w)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, text: str = "text", id: str = "doc_id", width: int = WIDTH, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """A row per document and template found in it: doc_id, template, containment, first_word.

    containment: the largest share of the template's distinct shingles (of width words; templates of fewer words are one
    shingle) that a window of the text has, at least the given one; first_word: where the first such window begins, in
    words of letters and digits, lower-cased. A window of that containment is missed with at most the chance given. Templates
    without a word match nothing; null and empty texts have no rows. Null ids and repeated rows are kept as they are; other
    columns aren't read; an empty table gives none. Only rows found leave a task; nothing is shuffled. templates: texts by name, whole licenses as well as notices, or a
    table of template and text of at most MAX_TEMPLATES rows, which goes to every task; more are an error. Of repeated names the least text counts.
    """
    templates = TEMPLATES if templates is None else templates
    if isinstance(templates, DataFrame):
        own = templates.where("template is not null").groupBy("template").agg(F.min("text").alias("text"))
        templates = {r["template"]: r["text"] or "" for r in own.limit(MAX_TEMPLATES + 1).collect()}
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates go with a task")
    text_batches(docs.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, width, containment, miss)
        for batch in batches:
            rows, docs = [], batch["doc_id"].to_pylist()
            for doc, value in ((docs[first + k], text) for first, texts in slices(batch["text"]) for k, text in enumerate(texts)):
                if words := words_of(value):
                    found = index.scan(hashes(words))
                    rows += [(doc, index.names[k], share, at) for k, (share, at) in sorted(found.items())]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "template", "containment", "first_word"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(stream, "doc_id long, template string, containment double, first_word long")
