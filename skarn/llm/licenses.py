"""License scans: TF-IDF cosine of license-like blocks to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small, written

#: Wording of license notices and of the beginnings of license texts, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "MIT": (
        "Released under the MIT License.",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-3.0-only": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "GPL-2.0-only": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    ),
    "LGPL-3.0-only": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
}
CUE = re.compile(r"licen[sc]e|copyright|permission|redistribut|warrant|public domain|\bspdx\b|\bcc(?:0| by)\b", re.I)
TERM = re.compile(r"\w+(?:[.]\d+)*")
#: Cosine from which a block is of a license; share of a text's words in such blocks from which it is a license file.
LEAST, FILE_SHARE = 0.6, 0.2
#: Start of a comment line; words of a file at most that is also scored as a whole, whatever its name.
COMMENT = re.compile(r"\s*(?://|/\*|\*|#|--|;|%|<!--|@?rem\b)[\s/*#;%-]*", re.I)
NAMED = re.compile(r"(?:un)?licen[sc]e|copying", re.I)
SHORT = 1000


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def _runs(flags: list[bool]) -> list[tuple[int, int]]:
    """(first, last) of each run of lines that are flagged."""
    found: list[tuple[int, int]] = []
    for i, flag in enumerate(flags):
        if flag:
            if found and found[-1][1] == i - 1:
                found[-1] = (found[-1][0], i)
            else:
                found.append((i, i))
    return found


def blocks_of(text: str | None, path: str | None = None) -> list[tuple[int, int, str]]:
    """(first line, last line, words) of what may be a license, anywhere in the whole text, if it holds a cue.

    That is each paragraph, each comment with its empty lines, each run of lines with a cue, and the whole file if it
    has up to ``SHORT`` words or is named like a license. Of those with the same words the widest is told.
    """
    if not text or not CUE.search(text):
        return []
    lines = text.split("\n")
    cues, full, comment, inside = [], [], [], ""
    for line in lines:
        start = COMMENT.match(line)
        comment.append(bool(start or inside))
        rest = line[start.end() :] if start else line
        full.append(any(map(str.isalnum, rest)))
        cues.append(CUE.search(line) is not None)
        if not inside:
            inside = next((end for begin, end in (("/*", "*/"), ("<!--", "-->")) if line.lstrip().startswith(begin) and end not in line), "")
        elif inside in line:
            inside = ""
    spans = {*_runs(full), *_runs(comment), *_runs(cues)}
    if NAMED.match((path or "").rsplit("/", 1)[-1]) or len(terms_of(text)) <= SHORT:
        spans.add((0, len(lines) - 1))
    marked = [0]
    for cue in cues:
        marked.append(marked[-1] + cue)
    found: dict[tuple[int, int], tuple[int, int, str]] = {}
    for low, high in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if marked[high + 1] > marked[low]:
            shown = [i for i in range(low, high + 1) if full[i]]
            if shown:
                found.setdefault((shown[0], shown[-1]), (low, high, " ".join(terms_of("\n".join(lines[low : high + 1])))))
    return sorted(found.values())


def find_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, path, file, n_terms, low, high, block) of each block of each file; files without one are absent.

    ``file`` is a number of the text, ``low`` and ``high`` are the block's lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "path", "file", "n_terms", "low", "high", "block"]
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for doc_id, path, text, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blocks := [b for b in blocks_of(text, path) if b[2]]:
                    n = len(terms_of(text))
                    rows += [(doc_id, path, file, n, *b) for b in blocks]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    text = F.col("text").cast("string")
    found = files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), text, F.xxhash64(text).alias("file"))
    return found.mapInArrow(run, "doc_id long, path string, file long, n_terms long, low long, high long, block string")


def score_blocks(blocks: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, license, score) of each distinct block that is within ``least`` of a template.

    ``blocks`` (key, block, n) are distinct blocks and their counts, so a notice that a third of all files carry is one
    row. A term's weight is its count times log((1 + N) / (1 + its blocks)) + 1 over all blocks and templates. Of equal
    scores the license first in order wins.
    """
    spark = blocks.sparkSession
    told = [(license, k, " ".join(terms_of(t))) for license, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    templates = spark.createDataFrame(told, "license string, k int, block string")
    count = lambda df, *by: df.select(*by, F.explode(F.split("block", " ")).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))
    terms, known = written(count(blocks, "key", "n"), "terms"), count(templates, "license", "k")
    total = len(told) + blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = terms.groupBy("term").agg(F.sum("n").alias("df")).unionByName(known.groupBy("term").agg(F.count("*").alias("df")))
    idf = seen.groupBy("term").agg((F.log(F.lit(1.0 + total) / (1 + F.sum("df"))) + 1).alias("idf"))
    idf = written(idf, "idf")
    raw, near = terms, small(idf)
    terms = terms.join(near, "term").withColumn("w", F.col("tf") * F.col("idf"))
    known = known.join(near, "term").withColumn("w", F.col("tf") * F.col("idf"))
    known = known.withColumn("v", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license", "k"))))
    sizes = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    match = terms.join(F.broadcast(known.select("license", "k", "term", "v")), "term").groupBy("key", "license", "k").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    best = match.join(sizes, "key").withColumn("score", F.round(F.col("dot") / F.col("size"), 9)).filter(F.col("score") >= least)
    top = best.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    top = written(top.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "scores")
    discard(raw, idf)
    return top


def scan(files: DataFrame, least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """(doc_id, path, license, score, origin, inherited_from) of every row of ``files`` (doc_id, path, text).

    ``origin`` is ``own`` where a block of the text is a license, the best-scoring one; a block inside a wider one of
    another license doesn't count, for the wider one says more. Else ``inherited``, with the
    license of the nearest ancestor directory that has a license file; else ``none``. A license file is one named like
    LICENSE, LICENCE, COPYING or UNLICENSE, or one whose license blocks hold ``file_share`` of its words; of several in
    a directory the best score counts, then the first license in order. A null path has no directory; a null or empty
    text has no license of its own; rows of one doc_id and path are one file and come back as often as they were there; further columns are ignored; an empty
    table gives an empty table. Only blocks that hold a cue and directories are shuffled, never other texts. A directory
    that holds a third of all files, and the root above all of them, are the small side of a broadcast, or of a shuffle
    whose large side adaptive execution splits.
    """
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    blocks = find_blocks(rows).withColumns({"key": F.md5("block"), "words": F.size(F.split("block", " "))})
    blocks = written(blocks, "blocks")
    distinct = blocks.groupBy("key").agg(F.min("block").alias("block"), F.count("*").alias("n"))
    hits = blocks.drop("block").join(small(score_blocks(distinct, least)), "key")
    around = F.collect_set(F.struct("low", "high", "license")).over(Window.partitionBy("doc_id", "path", "file"))
    wider = "x -> x.low <= low and x.high >= high and x.high - x.low > high - low"
    hits = hits.withColumn("around", around).withColumn("outer", F.expr(f"not exists(around, {wider})"))
    hits = hits.filter(F.expr(f"not exists(around, {wider} and x.license <> license)")).withColumn("words", F.when(F.col("outer"), F.col("words")).otherwise(0))
    own = hits.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), (F.sum("words") / F.max("n_terms")).alias("share"))
    own = written(own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "share"), "own")
    folder = lambda path: F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike("(?i)^(un)?licen[sc]e|^copying")
    holders = own.filter(named | (F.col("share") >= file_share)).withColumn("dir", folder(F.col("path"))).filter("dir is not null")
    holders = holders.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select(F.col("dir").alias("up"), F.col("b.license").alias("up_license"), (-F.col("b.s")).alias("up_score"))
    holders = written(holders, "holders")
    discard(blocks)
    dirs = rows.select(folder(F.col("path")).alias("dir")).filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    above = dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up")).join(small(holders), "up")
    nearest = above.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "up_license", "up_score")).alias("b"))
    nearest = written(nearest.select("dir", "b.up", "b.up_license", "b.up_score"), "nearest")
    discard(holders)
    ids = written(rows.select("doc_id", "path", folder(F.col("path")).alias("dir")), "files")
    mine = own.select(F.col("doc_id").alias("o_id"), F.col("path").alias("o_path"), "license", "score")
    out = ids.join(mine, ids["doc_id"].eqNullSafe(mine["o_id"]) & ids["path"].eqNullSafe(mine["o_path"]), "left").join(small(nearest), "dir", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "up_license").alias("license"),
        F.coalesce("score", "up_score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("up_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("up")).alias("inherited_from"),
    )
