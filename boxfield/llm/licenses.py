"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every sentence, line and paragraph of a file is compared with notice templates
by the cosine of TF-IDF vectors.  Document frequencies of the templates' terms
are counted over all files.  A unit of text can only reach the threshold if it
has one of a template's anchor terms (the rest of the template is too light for
that, by the Cauchy-Schwarz inequality), so units without anchors are not scored.

A file whose whole text reaches the threshold, or that is named like a licence
file and has a licence, speaks for its directory.  Files without a licence of
their own take that of the nearest directory above them: directories are paired
with their ancestors, joined to the directories that have a licence file, and the
deepest wins.  Only distinct directories take part in that join.

A template may state terms that a unit must have, such as a version, or must not
have; so licences of one family are told apart whatever else the unit says.

Null and empty texts have no licence of their own.  Files with a null path have
no directory.  Of several licence files in a directory the one with the highest
score counts, then the smallest path.  Repeated rows keep a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, quoted, text_bytes, with_text_columns

THRESHOLD = 0.6


@dataclass(frozen=True)
class Template:
    """needs: one term of each group must occur; without: none of these may."""

    name: str
    text: str
    needs: tuple[tuple[str, ...], ...] = ()
    without: tuple[str, ...] = ()


# Fixed texts: notices, whole short licences and the heads of long ones, by SPDX identifier.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_WARRANTY = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_CLAUSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the {licence} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_GNU_HEAD = "{licence} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_APACHE_HEAD = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
_FAMILY = (
    ("GPL-2.0", "GNU General Public License", "2", "June 1991", "1989, 1991", ("lesser", "library", "affero")),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007", "2007", ("lesser", "library", "affero")),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999", "1991, 1999", ("affero",)),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007", "2007", ("affero",)),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007", "2007", ("lesser",)),
)
_PLAIN = (
    ("MIT", "Released under the MIT License.", (("mit",),)),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information.", (("mit",),)),
    ("MIT", _GRANT, ()),
    ("MIT", f"{_GRANT}: {_WARRANTY}", ()),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", (("apache",), ("2.0", "2"))),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", (("apache",), ("2.0", "2"))),
    ("Apache-2.0", _APACHE_HEAD, (("apache",), ("2.0", "2"))),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", (("bsd",), ("3", "new", "revised"))),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", (("bsd",), ("2", "simplified"))),
    ("BSD-3-Clause", _BSD_CLAUSE, (("endorse",),)),
    ("BSD-3-Clause", f"{_BSD} {_BSD_CLAUSE} {_BSD_END}", (("endorse",),)),
    ("ISC", "Licensed under the ISC License.", (("isc",),)),
    ("ISC", _ISC, (("fee",),)),
    ("ISC", f"{_ISC} {_ISC_END}", (("fee",),)),
    ("Unlicense", _UNLICENSE, (("unencumbered",),)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", (("mozilla",), ("2.0", "2"))),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", (("eclipse",), ("1.0", "v1.0", "1"))),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", (("eclipse",), ("2.0", "v2.0", "2"))),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", (("4.0",),)),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", (("4.0",),)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", (("sa",), ("4.0",))),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", (("sharealike",), ("4.0",))),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", (("nc",), ("4.0",))),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", (("noncommercial",), ("4.0",))),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal.", (("cc0", "1.0"),)),
)
_ATTRIBUTION_ONLY = ("sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives")


def templates() -> tuple[Template, ...]:
    """All templates: notices and texts as stated, those of the GNU family by version, and a tag line for each identifier."""
    out = [Template(n, t, needs, _ATTRIBUTION_ONLY if n == "CC-BY-4.0" else ()) for n, t, needs in _PLAIN]
    out += [Template("BSD-2-Clause", f"{_BSD} {_BSD_END}", (("redistribution",), ("binary",)), ("endorse",)), Template("BSD-2-Clause", _BSD, (("redistribution",), ("binary",)), ("endorse",))]
    for name, licence, version, date, years, other in _FAMILY:
        own = tuple((x,) for x in ("lesser", "affero") if x in licence.lower())
        needs = (("general",), ("public",), (version, f"{version}.0", f"v{version}"), *own)
        texts = [f"This work is licensed under the {licence}, version {version}.", _GNU_HEAD.format(licence=licence, version=version, date=date, years=years)]
        texts += [_GNU.format(what=w, licence=licence, version=version) for w in ("program", "library")]
        out += [Template(name, t, needs, other) for t in texts]
    for name in dict.fromkeys(t.name for t in out):
        out.append(Template(name, f"SPDX-License-Identifier: {name}", (("spdx",), *((x.decode(),) for x in terms(name.encode()))), _ATTRIBUTION_ONLY if name == "CC-BY-4.0" else ()))
    return tuple(out)


TERM = re.compile(rb"[a-z0-9\x80-\xff]+(?:\.[0-9]+)*")
UNIT = re.compile(rb"(?<=[.!?])[ \t]+|\n")
PARAGRAPH = re.compile(rb"\n[ \t]*\n")
NAMES = re.compile(r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$")


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


class Scanner:
    """Weighted templates and their anchors."""

    def __init__(self, found: tuple[Template, ...], frequency: dict[bytes, int], files: int, threshold: float) -> None:
        self.threshold = threshold
        self.idf = {}
        vectors = [Counter(terms(t.text.encode())) for t in found]
        for v in vectors:
            for x in v:
                self.idf[x] = math.log((1 + files) / (1 + frequency.get(x, 0))) + 1
        self.unknown = math.log(1 + files) + 1
        self.templates = []
        #: Templates that a unit with this term may reach; without any of them it reaches none.
        self.anchors: dict[bytes, set[int]] = {}
        for k, (t, v) in enumerate(zip(found, vectors)):
            weights = {x: n * self.idf[x] for x, n in v.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            needs = [{x.encode() for x in group} for group in t.needs]
            self.templates.append((t.name, {x: w / norm for x, w in weights.items()}, needs, {x.encode() for x in t.without}))
            light, heavy = 0.0, set()
            for x in sorted(weights, key=lambda i: (self.idf[i], i)):
                light += (weights[x] / norm) ** 2
                if light >= threshold**2:  # without this term and the rarer ones the cosine stays below
                    heavy.add(x)
            for x in min([heavy, *needs], key=lambda g: (sum(frequency.get(i, 0) for i in g), sorted(g))):
                self.anchors.setdefault(x, set()).add(k)

    def cosine(self, counts: Counter, among: set[int] | None = None) -> tuple[float, str | None]:
        """The best template that may match (of ``among``, or of all) and its cosine; equal cosines go to the first name."""
        weights = {x: n * self.idf.get(x, self.unknown) for x, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        best = (0.0, None)
        for name, v, needs, without in self.templates if among is None else map(self.templates.__getitem__, sorted(among)):
            if any(counts.keys().isdisjoint(group) for group in needs) or not counts.keys().isdisjoint(without):
                continue
            score = sum(w * weights[x] for x, w in v.items() if x in weights) / norm
            if score > best[0] or (score == best[0] and best[1] and name < best[1]):
                best = (score, name)
        return best

    def near(self, found: list[bytes]) -> set[int]:
        return set().union(*(self.anchors[x] for x in self.anchors.keys() & found))

    def scan(self, text: bytes | None) -> tuple[str | None, float, float]:
        """(licence, its cosine, cosine of the whole text)."""
        if not text or self.anchors.keys().isdisjoint(every := TERM.findall(low := text.lower())):
            return None, 0.0, 0.0
        best: tuple[float, str | None] = (0.0, None)
        for u in {u for p in PARAGRAPH.split(low) for u in (p, *UNIT.split(p))}:
            found = TERM.findall(u)
            if among := self.near(found):
                score, name = self.cosine(Counter(found), among)
                if score > best[0] or (score == best[0] and name and (not best[1] or name < best[1])):
                    best = (score, name)
        whole, name = self.cosine(Counter(every), self.near(every))
        if whole >= self.threshold and whole > best[0]:
            best = (whole, name)
        return (best[1], best[0], whole) if best[0] >= self.threshold else (None, best[0], whole)


def frequencies(files: DataFrame, text: str, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Files that have each term of the templates, and files in all; one row for each term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in text_bytes(b.column("t")):
                counts[b""] += 1
                if t:
                    counts.update(vocabulary.intersection(TERM.findall(t.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    found = files.select(column(files, text).cast("string").alias("t")).mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = {bytes(r.term): r.n for r in found.collect()}
    return out, out.pop(b"", 0)


def scan(files: DataFrame, *, path: str, text: str, keep: list[str], chosen: tuple[Template, ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, own_license, own_score, and speaks (for its directory)."""
    chosen = chosen or templates()
    vocabulary = frozenset(x for t in chosen for x in terms(t.text.encode()))
    frequency, n = frequencies(files, text, vocabulary)
    scanner = Scanner(chosen, frequency, n, threshold)

    def make():
        def work(batch):
            rows = [scanner.scan(t) for t in batch]
            return {"own_license": [r[0] for r in rows], "own_score": [r[1] for r in rows], "__whole": [r[2] for r in rows]}

        return work

    out = with_text_columns(files, text, make, "own_license string, own_score double, `__whole` double", [*dict.fromkeys([*keep, path])])
    named = column(out, path).rlike(NAMES.pattern)
    return out.withColumn("speaks", F.col("own_license").isNotNull() & F.coalesce(named | (F.col("__whole") >= threshold), F.lit(False))).drop("__whole")


def directory(path):
    """All of a path before its last slash; the empty string for a file at the top."""
    return F.when(path.isNotNull(), F.regexp_replace(path, "/?[^/]*$", ""))


def inherited(scanned: DataFrame, *, path: str) -> DataFrame:
    """scanned with license, license_dir and levels up (0: own).  ``scanned`` must be a written table."""
    where = directory(column(scanned, path))
    speaking = scanned.where("speaks").groupBy(where.alias("__up")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), column(scanned, path).alias("p"), F.col("own_license").alias("l")))["l"].alias("__license"))
    dirs = scanned.select(where.alias("__dir")).where("__dir is not null").distinct()
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    pairs = dirs.select("__dir", F.explode(F.array_distinct(above)).alias("__up"))
    depth = F.when(F.col("__up") == "", 0).otherwise(F.size(F.split("__up", "/")))
    nearest = pairs.join(speaking, "__up").groupBy("__dir").agg(F.max(F.struct(depth.alias("d"), F.col("__up").alias("u"), F.col("__license").alias("l"))).alias("__m"))
    out = scanned.withColumn("__dir", where).join(nearest, "__dir", "left")
    own = F.col("own_license").isNotNull()
    deep = F.when(F.col("__dir") == "", 0).otherwise(F.size(F.split("__dir", "/")))
    return out.select(*(F.col(quoted(c)) for c in scanned.columns), F.coalesce("own_license", "__m.l").alias("license"), F.when(~own, F.col("__m.u")).alias("license_dir"), F.when(own, 0).when(F.col("__m").isNotNull(), deep - F.col("__m.d") + 1).alias("levels"))


def licenses(files: DataFrame, *, path="path", text="text", keep: list[str], **options) -> DataFrame:
    """Licence of each file, its own or inherited."""
    scratch = Scratch(files.sparkSession)
    scanned = scratch.write(scan(files, path=path, text=text, keep=keep, **options))
    return inherited(scanned, path=path)


def document_files(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", lang="lang") -> DataFrame:
    """Documents as files of a tree: source/language/block of 256 ids/block of 16 ids/id.txt.

    A document that speaks of a licence is named NOTICE-id.txt and stands in its
    block of 256, like the notice file of a repository; if a licence is found in
    it, it speaks for all below.
    """
    n = column(docs, doc_id)
    notice = F.coalesce(column(docs, text).cast("string").rlike("(?i)licen[cs]e"), F.lit(False))
    top = [F.coalesce(column(docs, c), F.lit("unknown")) for c in (source, lang)] + [F.floor(n / 256).cast("string")]
    path = F.when(notice, F.concat_ws("/", *top, F.concat(F.lit("NOTICE-"), n.cast("string"), F.lit(".txt")))).otherwise(F.concat_ws("/", *top, F.floor(n / 16).cast("string"), F.concat(n.cast("string"), F.lit(".txt"))))
    return docs.select(n.alias("doc_id"), path.alias("path"), column(docs, text).alias("text"))
