"""License scans by diagonal voting.

Every rolling word k-gram of a text is joined to the positions where license templates have the same k-gram.
A match at word p of the text and word q of the template votes for the diagonal p - q: an unbroken copy
puts all its votes on one diagonal, a copy with words added or left out on neighbouring ones. Matches that follow each
other on one diagonal are a stretch; stretches on neighbouring diagonals are merged into chains that ascend in the text
and in the template, and a chain is accepted when it covers enough different words of the template without being spread
too thin over the text; a k-gram match means k equal words, and a passage that is only repeated covers its words once.

The templates are literal parameters, so the broadcast side has a fixed size. Only matches are shuffled,
pre-aggregated to one row per (text, template, diagonal); a text has a bounded number of diagonals.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any character beyond ASCII. A NULL or empty text has no words and
gets an empty result row. Repeated rows are told apart by an internal row number and stay separate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regulus.llm.textops import LETTER_OR_DIGIT, LOWER, Piece, chain, pieces, run_hashes, runs
from regulus.session import cut

GRAM = 4
NO_GRAM = -(1 << 63)
MERGE_GAP = 6
LEAST_COVER = 0.6
LEAST_DENSITY = 0.5
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Opening passages of public license notices.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation the "
           "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
              "the license you may obtain a copy of the license at",
    "apache-short": "licensed under the apache license version 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
           "license as published by the free software foundation either version",
    "gpl-short": "this work is licensed under the gnu general public license version",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
            "public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
           "following conditions are met redistributions of source code must retain the above copyright notice",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
           "distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
           "granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-short": "licensed under cc by nc 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
                 "use compile sell or distribute this software",
    "mit-short": "released under the mit license",
}
# Templates of one license that count under one label.
LABEL = {"apache-short": "apache", "gpl-short": "gpl", "cc-by-short": "cc-by", "mit-short": "mit"}


def _words(text: str) -> Piece:
    return next(pieces(pa.array([text])))


def _grams(text: str, k: int) -> np.ndarray:
    p = _words(text)
    low = Piece(p.lo, p.hi, LOWER[p.data], p.at)
    s, e, _ = runs(low, LETTER_OR_DIGIT)
    return chain(run_hashes(low.data, s, e), k).astype(np.int64)


def template_grams(spark, templates: dict[str, str] = TEMPLATES, k: int = GRAM) -> DataFrame:
    rows = [(int(h), name, i, len(text.split())) for name, text in templates.items() for i, h in enumerate(_grams(text, k))]
    return spark.createDataFrame(rows, "gram long, template string, tpos int, twords int")


def _base(low: bytes, starts: np.ndarray, phrases: dict[str, str]) -> tuple[int, int | None, int | None, str]:
    """Places of the phrases in a text of lower-cased bytes whose words begin at ``starts``: count, first and last word, labels."""
    at: list[int] = []
    labels = set()
    sep = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
    for phrase, label in phrases.items():
        words = [w.encode() for w in phrase.split()]
        if words[-1] not in low:
            continue
        body = (sep + b"+").join(map(re.escape, words))
        found = [m.start() for m in re.finditer(rb"(?:^|(?<=" + sep + rb"))(?=" + body + rb"(?:" + sep + rb"|$))", low)]
        if found:
            at += np.searchsorted(starts, found).tolist()
            labels.add(label)
    return len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scan_words(docs: DataFrame, phrases: dict[str, str] = PHRASES, k: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: uid, key, word count, base columns, and the array of its rolling k-gram hashes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            for p in pieces(b.column(1)):
                n = p.hi - p.lo
                low = Piece(p.lo, p.hi, LOWER[p.data], p.at)
                s, e, row = runs(low, LETTER_OR_DIGIT)
                h = chain(run_hashes(low.data, s, e), k).astype(np.int64)
                inside = row[k - 1:] == row[:len(h)] if len(h) else np.zeros(0, bool)
                grams, owner = h[inside], row[:len(h)][inside]
                cut_at = np.searchsorted(row, np.arange(n + 1))
                base = [_base(low.row(i), s[cut_at[i]:cut_at[i + 1]] - p.at[i], phrases) for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + n)), b.column(0).slice(p.lo, n), pa.array(np.bincount(row, minlength=n)),
                    *[pa.array([x[j] for x in base], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                    pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.array(grams))],
                    names=["uid", "k", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"])
                uid += n

    return docs.select(F.col(key), F.col(text)).mapInArrow(
        run, f"uid long, k {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, grams array<long>")


def stretches(diagonals: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Maximal runs of consecutive positions on one diagonal, as rows (text word, template word, matches), by text word."""
    order = np.lexsort((positions, diagonals))
    d, p = diagonals[order], positions[order]
    first = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(p) != 1)])
    out = np.stack([p[first], p[first] - d[first], np.diff(np.r_[first, len(p)])], 1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def verified_share(found: np.ndarray, twords: int, k: int, gap: int, cover: float, density: float) -> float:
    """Largest share of a template that a chain of ``stretches`` covers (0: none accepted).

    In a chain each stretch begins and ends later than the one before in the text and in the template, at most ``gap``
    diagonals off it and at most half a template further on. A chain's worth is the number of template words that it
    covers, less ``density`` / (1 - ``density``) for every word of the text between its stretches; every stretch takes the
    predecessor that makes its chain worth most (ties: the earliest), or none. A chain is accepted when its worth is not
    negative, it covers ``cover`` of the template, and its ends lie at most half a template of diagonals apart.
    """
    thin = density / (1 - density)
    pos, tpos, n = found[:, 0], found[:, 1], found[:, 2] + (k - 1)
    end, tend, diagonal = pos + n, tpos + n, pos - tpos
    worth, words, home = n.astype(float), n.copy(), diagonal.copy()
    reach = twords // 2 + gap
    best = 0.0
    lo = 0
    for b in range(len(pos)):
        while pos[lo] + twords + reach < pos[b]:  # a stretch is no longer than the template
            lo += 1
        if lo < b:
            w = slice(lo, b)
            new = np.minimum(np.minimum(end[b] - end[w], tend[b] - tend[w]), n[b])
            ok = ((pos[w] < pos[b]) & (tpos[w] < tpos[b]) & (new > 0) & (np.abs(diagonal[w] - diagonal[b]) <= gap) & (pos[b] - end[w] <= reach)
                  & (np.abs(home[w] - diagonal[b]) <= twords // 2))
            if ok.any():
                value = np.where(ok, worth[w] + new - thin * np.maximum(pos[b] - end[w], 0), -np.inf)
                a = int(np.argmax(value))
                if value[a] > worth[b]:
                    worth[b], words[b], home[b] = value[a], words[lo + a] + new[a], home[lo + a]
        if worth[b] >= 0 and words[b] >= cover * twords:
            best = max(best, min(1.0, words[b] / twords))
    return best


def _accepted(k: int, gap: int, cover: float, density: float):
    """Rows (uid, template, twords, votes) to those with a verified span."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            share = []
            for r in g.itertuples():
                size = [len(v["positions"]) for v in r.votes]
                found = stretches(np.repeat([v["diagonal"] for v in r.votes], size), np.concatenate([v["positions"] for v in r.votes]))
                share.append(verified_share(found, r.twords, k, gap, cover, density))
            yield g[["uid", "template"]].assign(share=np.array(share, float))
    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = GRAM,
         gap: int = MERGE_GAP, cover: float = LEAST_COVER, density: float = LEAST_DENSITY, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Key, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    ``score`` is 1 where a phrase occurs, else the largest verified share of a template.
    """
    spark = docs.sparkSession
    words = scan_words(docs, phrases, k, key, text)
    lookup = F.broadcast(template_grams(spark, templates, k))
    # one pass over the texts: element 0 stands for the document itself, the others are its k-grams
    own = [c for c in words.columns if c not in ("uid", "grams")]
    rows = (words.select("*", F.posexplode(F.concat(F.array(F.lit(NO_GRAM)), "grams")).alias("pos", "gram")).drop("grams")
            .join(lookup, "gram", "left").where((F.col("pos") == 0) | F.col("template").isNotNull()))
    rows = cut(rows.select("uid", (F.col("pos") - 1).alias("pos"), "template", "tpos", "twords",
                           *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in own]))
    votes = (rows.where("pos >= 0 and template is not null")
             .groupBy("uid", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.collect_set("pos").alias("positions"), F.max("twords").alias("twords")))
    texts = votes.groupBy("uid", "template").agg(F.collect_list(F.struct("diagonal", "positions")).alias("votes"), F.max("twords").alias("twords"))
    spans = texts.select("uid", "template", "twords", "votes").mapInPandas(_accepted(k, gap, cover, density), "uid long, template string, share double")
    names = F.create_map(*[F.lit(x) for kv in LABEL.items() for x in kv])
    found = (spans.where("share > 0").withColumn("label", F.coalesce(names[F.col("template")], F.col("template")))
             .groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")))
    out = rows.where("pos = -1").join(found, "uid", "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col("more"), F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("share"), F.lit(0.0)))
    return out.select(F.col("k").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels",
                      F.array_join(labels, ",").alias("labels"), score.alias("score"))
