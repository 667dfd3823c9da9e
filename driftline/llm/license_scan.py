"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

One pass over the texts finds the regions that may hold a licence header (lines
around a mark, with its paragraph, and whole texts of licence files) and counts
in how many texts, of all, each term of the templates occurs.  A mark is a line
with a trigger word, or with a part of `SEED` tokens in a row that some template
has too.  A second pass, over the regions alone, compares every window of
adjacent lines with a mark, its paragraph, the region and the whole licence
file with every template (notices, standard headers, full licences, paragraphs
of the short ones) by the cosine of sparse TF-IDF vectors; an SPDX tag that
names a template's licence counts as 1.  Terms that no template has count with
the weight of a term never seen.  The best template over the threshold is the file's own licence.

Directories with a licence file have its licence.  Each directory of files is
joined with its ancestors' paths, and the deepest one with a licence passes it
on to files without their own.  Distinct directories are taken before paths are
exploded, so a directory with a third of all files counts once.

Defined results: a null text counts as empty and has no licence of its own; a
null path is no licence file and inherits nothing; repeated rows are judged
alike; of equal scores the least template name wins; without templates nothing
is found; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import binary_chunks, short_batches, written

#: Lower-case strings one of which a header line has.
TRIGGERS = (b"licen", b"copyright", b"spdx", b"copying")
#: First letters of the names of licence files, lower case.
FILE_NAMES = ("license", "licence", "copying", "unlicense")

#: Lines of the longest window.
BLOCK = 16
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]")
#: A licence's identifier in a tag; of an expression, the first one.
SPDX = re.compile(rb"(?i)SPDX-License-Identifier:[ \t(]*([\w.+-]+)")

#: Common notices: licence, and wording with which texts refer to it.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


#: Tokens in a row that mark a line where a template has them too.
SEED = 5
#: Licences of at most so many words also give their paragraphs as templates, those of `PARAGRAPH_WORDS` at least.
SHORT_WORDS, PARAGRAPH_WORDS = 400, 15


def paragraphs_of(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Paragraphs of short licences, which stand alone in many headers."""
    short = [(name, text) for name, text in texts if len(text.split()) <= SHORT_WORDS]
    return [(name, p) for name, text in short for p in re.split(r"\n\s*\n", text) if len(p.split()) >= PARAGRAPH_WORDS]


def seeds_of(templates: list[tuple[str, str]]) -> tx.HashIndex:
    t = tx.tokens([text.encode() for _, text in templates], tx.NOT_ALNUM, lower=True)
    return tx.HashIndex(np.unique(tx.windows(t, SEED)[0]))


def full_texts() -> list[tuple[str, str]]:
    """Whole licences, by the names of their files."""
    return [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]


def terms(text: bytes) -> Counter:
    """Number of each token (by hash) of a text."""
    return Counter(tx.tokens([text], tx.NOT_ALNUM, lower=True).hashes.tolist())


def _triggers(lines: list[bytes]) -> list[bool]:
    return [any(t in line for t in TRIGGERS) for line in (x.lower() for x in lines)]


def _marked(text: bytes, lines: list[bytes], seeds: tx.HashIndex | None) -> np.ndarray:
    """Whether each line of the text has a trigger word or part of a seed."""
    out = np.array(_triggers(lines), bool)
    if seeds is not None:
        t = tx.tokens([text], tx.NOT_ALNUM, lower=True)
        hashes, at = tx.windows(t, SEED)
        hit = at[seeds.find(hashes) >= 0]
        begins = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
        first, last = (np.searchsorted(begins, x, side="right") - 1 for x in (t.starts[hit], t.starts[hit + SEED - 1]))
        inside = np.zeros(len(lines) + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, last + 1, -1)
        out |= np.cumsum(inside[:-1]) > 0
    return out


def regions(text: bytes, whole: bool, seeds: tx.HashIndex | None = None) -> list[bytes]:
    """Adjacent lines that may hold a header: those less than BLOCK from a marked line, and its paragraph.  Of a licence file the whole text.

    seeds: of the templates; None where the text is known to have none.
    """
    if whole:
        return [text] if text else []
    if seeds is None:
        low = text.lower()
        if not any(t in low for t in TRIGGERS):
            return []
    lines = text.split(b"\n")
    near = np.zeros(len(lines) + 1, np.int64)
    hit = np.flatnonzero(_marked(text, lines, seeds))
    np.add.at(near, np.maximum(hit - BLOCK + 1, 0), 1)
    np.add.at(near, np.minimum(hit + BLOCK, len(lines)), -1)
    for i, j in _paragraphs(lines):
        if np.searchsorted(hit, j) > np.searchsorted(hit, i):
            near[i] += 1
            near[j] -= 1
    inside = np.concatenate([[0], (np.cumsum(near[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    return [b"\n".join(lines[i:j]) for i, j in edges.tolist()]


def _paragraphs(lines: list[bytes]) -> list[tuple[int, int]]:
    """Runs of lines with a letter or digit (so comment marks alone end one)."""
    full = np.array([0, *(bool(WORD.search(x)) for x in lines), 0], np.int8)
    return np.flatnonzero(np.diff(full)).reshape(-1, 2).tolist()


def is_licence_file(path: str | None) -> bool:
    return (path or "").rpartition("/")[2].lower().startswith(FILE_NAMES)


class Matcher:
    """Weighted template vectors."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[int, int], n: int):
        self.unseen = np.log(n + 1.0) + 1
        self.seeds = seeds_of(templates)
        self.idf = {h: np.log((n + 1.0) / (c + 1)) + 1 for h, c in df.items()}
        self.vectors = [(name, self.weighted(terms(text.encode()))) for name, text in sorted(templates)]
        #: of each term, its weight in each template, times that in a passage
        self.columns = {h: self.idf.get(h, self.unseen) * np.array([v.get(h, 0.0) for _, v in self.vectors]) for h in {h for _, v in self.vectors for h in v}}

    def weighted(self, counts: Counter) -> dict[int, float]:
        v = {h: c * self.idf.get(h, self.unseen) for h, c in counts.items()}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1.0
        return {h: x / norm for h, x in v.items()}

    def best(self, found: list[bytes], whole: bool = False) -> tuple[float, str | None]:
        """Best cosine over all windows of at most BLOCK adjacent lines with a mark, paragraphs and regions that have one, and whole files."""
        top, name = 0.0, None
        names = [n for n, _ in self.vectors]
        if not names:
            return top, name

        def offer(score: float, licence: str) -> None:
            nonlocal top, name
            if score > top + 1e-12 or (abs(score - top) <= 1e-12 and name and licence < name):
                top, name = score, licence

        for region in dict.fromkeys(found):
            for tag in SPDX.findall(region):
                known = re.sub(rb"(?i)-(only|or-later)$|\\+$", b"", tag).decode().lower()
                for licence in names:
                    if licence.lower() == known:
                        offer(1.0, licence)
            lines = region.split(b"\n")
            counts = [terms(x) for x in lines]
            marks = np.concatenate([[0], np.cumsum(_marked(region, lines, self.seeds))])
            dots = np.zeros((len(lines) + 1, len(names)))
            for i, c in enumerate(counts):
                dots[i + 1] = dots[i]
                for h, n in c.items():
                    if h in self.columns:
                        dots[i + 1] += n * self.columns[h]
            spans = _paragraphs(lines)
            longer = {i: {j} for i, j in spans if j - i > BLOCK}
            if len(lines) > BLOCK:
                longer.setdefault(0, set()).add(len(lines))
            for i in range(len(lines)):
                ends, last = longer.get(i, set()), min(len(lines), i + BLOCK)
                if not ends and marks[last] == marks[i] and not (whole and i == 0):
                    continue
                seen: Counter = Counter()
                square = 0.0
                for j in range(i, max(ends, default=last)):
                    for h, n in counts[j].items():
                        w, old = self.idf.get(h, self.unseen), seen[h]
                        square += w * w * n * (2 * old + n)
                        seen[h] = old + n
                    all_ = whole and i == 0 and j + 1 == len(lines)
                    if square and (all_ or (marks[j + 1] > marks[i] and (j + 1 - i <= BLOCK or j + 1 in ends))):
                        scores = (dots[j + 1] - dots[i]) / np.sqrt(square)
                        k = int(scores.argmax())
                        k = int(np.flatnonzero(scores >= scores[k] - 1e-12)[0])  # names are in order
                        if scores[k] > 1e-9:
                            offer(float(scores[k]), names[k])
        return min(top, 1.0), name


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.6) -> DataFrame:
    """doc_id, path, licence, origin (own, inherited or none), score, source (the directory inherited from).

    files: doc_id, path, text.
    """
    spark = files.sparkSession
    short_batches(spark)
    templates = TEMPLATES + full_texts() + paragraphs_of(full_texts()) if templates is None else templates
    vocabulary = np.array(sorted({h for _, t in templates for h in terms(t.encode())}), np.uint64)
    kinds = "doc_id long, path string, passages array<binary>, term int, n long"
    names = ["doc_id", "path", "passages", "term", "n"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, df, seeds = tx.HashIndex(vocabulary), np.zeros(len(vocabulary), np.int64), seeds_of(templates)
        for batch in batches:
            paths = batch.column(1).to_pylist()
            for i, j, texts in binary_chunks(batch.column(2)):
                t = tx.tokens(texts, tx.NOT_ALNUM, lower=True)
                at = index.find(t.hashes)
                seen = np.unique(t.owners[at >= 0] * len(vocabulary) + at[at >= 0])
                df += np.bincount(seen % max(len(vocabulary), 1), minlength=len(vocabulary))
                hashes, place = tx.windows(t, SEED)
                seeded = set(t.owners[place[seeds.find(hashes) >= 0]].tolist())
                found = [regions(x, is_licence_file(p), seeds if k in seeded else None) for k, (x, p) in enumerate(zip(texts, paths[i:j], strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(found, pa.list_(pa.binary())), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.int64())], names)
        hit = np.flatnonzero(df)
        none = pa.nulls(len(hit), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(hit), pa.string()), pa.nulls(len(hit), pa.list_(pa.binary())), pa.array(hit.astype(np.int32)), pa.array(df[hit])], names)

    both = written(files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(first, kinds), "passages")
    rows = both.where("term is null").select("doc_id", "path", "passages")
    df = {int(vocabulary[r.term]): r.n for r in both.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each template term
    shared = spark.sparkContext.broadcast(Matcher(templates, df, rows.count()))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(1).to_pylist()
            best = [shared.value.best(x, is_licence_file(p)) if x else (0.0, None) for x, p in zip(batch.column(2).to_pylist(), paths, strict=True)]
            own = [name if score >= threshold else None for score, name in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.rpartition("/")[0] if p is not None else None for p in paths], pa.string()), pa.array([is_licence_file(p) for p in paths]), pa.array(own, pa.string()), pa.array([s for s, _ in best], pa.float64())],
                ["doc_id", "path", "dir", "is_file", "own", "score"],
            )

    judged = written(rows.mapInArrow(second, "doc_id long, path string, dir string, is_file boolean, own string, score double"), "licences")
    best = F.max_by("own", F.struct("score", F.hex("own"))).alias("licence")
    by_dir = judged.where("is_file and own is not null and dir is not null").groupBy("dir").agg(best)
    needed = judged.where("own is null and dir is not null").select("dir").distinct()
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(F.split("dir", "/"))))
    ancestors = needed.select("dir", F.explode(depths).alias("depth")).withColumn("ancestor", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.greatest("depth", F.lit(1))), "/")))
    near = ancestors.join(by_dir.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by(F.struct("licence", F.col("ancestor").alias("source")), "depth").alias("near"))
    with_own = judged.where("own is not null or dir is null").withColumn("near", F.lit(None).cast("struct<licence:string,source:string>"))
    others = judged.where("own is null and dir is not null").join(near, "dir", "left")
    out = with_own.unionByName(others)
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "near.licence").alias("licence"), origin.alias("origin"), "score", F.col("near.source").alias("source"))
