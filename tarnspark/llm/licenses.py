"""License scan: an exact set-similarity join of text blocks with license templates, by containment."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Phrases whose words must stand in a row, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Wordings of public licenses, and their labels.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "mit"),
    ("The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", "apache-2.0"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This program is free software: you can redistribute it under the terms of the GNU Affero General Public License", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "bsd"),
    ("This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied", "apache-2.0"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
)

#: What tells licenses of like wording apart. Those of a template's wording must stand in a window as they are.
TELLING = (
    "affero general public license",
    "apache license",
    "cc by 4 0",
    "cc by nc 4 0",
    "cc by sa 4 0",
    "creative commons attribution",
    "general public license",
    "international license",
    "lesser general public license",
    "mit license",
    "mozilla public license",
    "sharealike 4 0",
    "version 2",
    "version 3",
)


def words_of(text: str) -> list[bytes]:
    return shared.plain_bytes(text.encode()).split()


class Join:
    """Templates indexed by their prefix tokens. `order` gives each template token its place, the rarest first.

    A template of n distinct tokens is met from ceil(threshold * n) shared ones on; so a block that meets it holds one
    of its first n - ceil(threshold * n) + 1 tokens in that order (prefix filter), and enough template tokens at all
    (length filter), of which enough stand behind the first shared one, in template and block (positional filter).
    """

    def __init__(self, templates: list[tuple[list[bytes], str, float]], order: dict[bytes, int], telling: list[list[bytes]] = ()):
        self.order = order
        self.templates, self.reach, self.telling = [], [], []
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.member = np.zeros((len(templates), len(order) + 1), dtype=bool)  # the last column: words of no template
        self.starts = np.zeros_like(self.member)
        for t, (words, label, threshold) in enumerate(templates):
            tokens = sorted({order[w] for w in words})
            need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            for place, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.index[token].append((t, place))
                self.starts[t, token] = True
            self.member[t, tokens] = True
            self.templates.append((tokens, need, label))
            self.reach.append(max(1, math.ceil(len(words) / threshold - 1e-9)))
            stands = [p for p in telling if any(words[k : k + len(p)] == p for k in range(len(words) - len(p) + 1))]
            self.telling.append([np.array([order[w] for w in p]) for p in stands])
        sets = [set(t) for t, _, _ in self.templates]
        self.rivals = [{u for u in range(len(sets)) if u != t and 2 * len(sets[t] & sets[u]) >= min(len(sets[t]), len(sets[u]))} for t in range(len(sets))]

    def told(self, t: int, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether the window from each of these words holds, as they are, all words that tell the template from others."""
        out = np.ones(len(starts), dtype=bool)
        for phrase in self.telling[t]:
            n = max(0, len(own) - len(phrase) + 1)
            stands = np.ones(n, dtype=bool)
            for k, w in enumerate(phrase):
                stands &= own[k : n + k] == w
            at = np.flatnonzero(stands)
            out &= np.append(at, len(own) + self.reach[t])[np.searchsorted(at, starts)] + len(phrase) <= starts + self.reach[t]
        return out

    def windows(self, own: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of each stretch of a text in which windows meet a template.

        own: the token of each word, -1 where it is of no template. A template of so many words is sought in every window
        of that many over its threshold; the best window of those that meet and overlap speaks for all of them. Only
        windows that hold a prefix token are looked at, and only where enough template tokens are within reach of one.
        """
        out = []
        for t in sorted({t for token in np.unique(own).tolist() for t, _ in self.index.get(token, ())}):
            tokens, need, _ = self.templates[t]
            reach = self.reach[t]
            at = np.flatnonzero(self.member[t][own])
            if len(at) < need:
                continue
            hits = at[self.starts[t][own[at]]]
            k = np.searchsorted(hits, at)
            far = np.minimum(at - np.append(-reach, hits)[k], np.append(hits, at[-1] + reach)[np.minimum(k, len(hits))] - at)
            at = at[far < reach]
            token = own[at]
            if len(np.unique(token)) < need:
                continue
            places, seen = token.tolist(), Counter()
            starts, stops = at.tolist(), np.searchsorted(at, at + reach).tolist()  # of the window from each place on
            told = self.told(t, own, at)
            if not told.any():
                continue
            upto, last, best = 0, None, (0, 0)
            for x, stop in enumerate(stops):
                for y in range(upto, stop):
                    seen[places[y]] += 1
                upto = stop
                if len(seen) >= need and told[x]:
                    if last is not None and starts[x] >= last + reach:
                        out.append((t, -best[1], last + reach, best[0] / len(tokens)))
                        best = (0, 0)
                    last, best = starts[x], max(best, (len(seen), -starts[x]))
                seen[places[x]] -= 1
                if not seen[places[x]]:
                    del seen[places[x]]
            if last is not None:
                out.append((t, -best[1], last + reach, best[0] / len(tokens)))
        return out

    def match(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) for each template that a block meets; block: its distinct template tokens, in order."""
        first: dict[int, tuple[int, int]] = {}
        for at, token in enumerate(block):
            for t, place in self.index.get(token, ()):
                first.setdefault(t, (place, at))
        out = []
        for t, (place, at) in sorted(first.items()):
            tokens, need, _ = self.templates[t]
            if len(block) < need or 1 + min(len(tokens) - place - 1, len(block) - at - 1) < need:
                continue
            both = len(set(tokens).intersection(block))
            if both >= need:
                out.append((t, both / len(tokens)))
        return out

    def best(self, met: list[tuple[int, int, int, float]]) -> set[str]:
        """The labels of what `windows` found, but for those beside which a template of like wording is met better."""
        rank = [(share, len(self.templates[t][0])) for t, _, _, share in met]
        beaten = lambda k, t, a, b: any(u in self.rivals[t] and rank[n] > rank[k] and a < d and c < b for n, (u, c, d, _) in enumerate(met))
        return {self.templates[t][2] for k, (t, a, b, _) in enumerate(met) if not beaten(k, t, a, b)}


def token_counts(docs: DataFrame, tokens: list[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many rows each token stands. One number a token comes to the driver, however many rows there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(tokens)}
        total = np.zeros(len(tokens), dtype=np.int64)
        for batch in batches:
            for part in shared.blocks_of(batch, "text"):
                words = shared.Words(part.column("text"), plain=True)
                token = np.fromiter((place.get(w, -1) for w in words.distinct), dtype=np.int64, count=len(words.distinct))[words.which]
                hit = token >= 0
                pairs = np.unique(words.row[hit] * len(tokens) + token[hit])
                total += np.bincount(pairs % len(tokens), minlength=len(tokens))
        yield pa.record_batch({"token": pa.array(tokens, pa.binary()), "n": pa.array(total)})

    rows = shared.map_arrow(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), count, "token binary, n long")
    return {bytes(r.token): r.n for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, *, threshold: float = 0.8, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, telling=TELLING) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Blocks are all windows of consecutive words, for each template of as many as it has over `threshold`, however lines
    are broken; any window that holds `threshold` of a template's distinct words, and as they are those of `telling` that the
    template has (so that "released under the license" is not "released under the MIT License"), is found, none is missed.
    Where several templates are met alike, each gives its label. No rows: no rows. Phrases join
    with the whole text as a block, at containment 1, and count where their words stand in a row. matches: (label, first
    word, containment) of the best window of each stretch of overlapping ones that meet a template; labels: of those that
    no template of like wording is met better than in the same place; score: the greatest containment, 1 for a phrase, 0
    without any.

    Two passes over the texts, without a shuffle: one counts template tokens for their global order, one joins; the
    templates are a fixed list. A null or empty text: no words, no labels. Repeated rows each get their row. Very long
    texts are read whole; only documents that hold some template's prefix token are looked at word by word.
    """
    wordings = [(words_of(w), label, threshold) for w, label in templates]
    sayings, told = [(words_of(w), label, 1.0) for w, label in phrases], [words_of(p) for p in telling]
    tokens = sorted({w for words, _, _ in [*wordings, *sayings] for w in words})
    seen = token_counts(docs, tokens, text)
    order = {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (seen.get(w, 0), w)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_window, by_text = Join(wordings, order, told), Join(sayings, order)
        sought = [[order[w] for w in words] for words, _, _ in sayings]
        for batch in batches:
            for part in shared.blocks_of(batch, "text"):
                words = shared.Words(part.column("text"), plain=True)
                token = np.fromiter((order.get(w, -1) for w in words.distinct), dtype=np.int64, count=len(words.distinct))[words.which]
                starts = np.isin(token, list({*by_window.index, *by_text.index}))
                n = part.num_rows
                out = [(0, None, None, "", "", 0.0, [])] * n
                for k in np.unique(words.row[starts]).tolist():
                    own = token[words.before[k] : words.before[k + 1]]
                    out[k] = judge(own, by_window, by_text, sought)
                fields = list(zip(*out, strict=True)) if n else [[]] * 7
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(words.counts, pa.int64()),
                        "n_base": pa.array(fields[0], pa.int64()),
                        "first_word": pa.array(fields[1], pa.int64()),
                        "last_word": pa.array(fields[2], pa.int64()),
                        "base_labels": pa.array(fields[3], pa.string()),
                        "labels": pa.array(fields[4], pa.string()),
                        "score": pa.array(fields[5], pa.float64()),
                        "matches": pa.array([[{"label": a, "word": b, "containment": c} for a, b, c in m] for m in fields[6]], pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())]))),
                    }
                )

    def judge(own: np.ndarray, by_window: Join, by_text: Join, sought: list[list[int]]) -> tuple:
        places, base, score = [], set(), 0.0
        for t, _ in by_text.match(np.unique(own[own >= 0]).tolist()):
            phrase = sought[t]
            if len(own) < len(phrase):
                continue
            hit = np.ones(len(own) - len(phrase) + 1, dtype=bool)
            for k, w in enumerate(phrase):
                hit &= own[k : len(own) - len(phrase) + 1 + k] == w
            if hit.any():
                places.extend(np.flatnonzero(hit).tolist())
                base.add(by_text.templates[t][2])
                score = 1.0
        met = by_window.windows(own)
        matches = [(by_window.templates[t][2], first, share) for t, first, _, share in met]
        score = max([score, *(share for *_, share in met)])
        return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | by_window.best(met))), score, matches

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return shared.map_arrow(
        rows,
        run,
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, word: long, containment: double>>",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents")).withColumn("n_matches", F.size("matches").cast("bigint")).drop("matches")
