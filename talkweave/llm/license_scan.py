"""License scan: an exact set-similarity join of text blocks with licence templates.

A block is a run of consecutive words of a text, STRETCH times as long as the template, wherever lines break. A template
is found in a text when one of its blocks holds at least `threshold` of the template's distinct tokens (containment). The
join finds all such pairs without comparing all: the tokens of a template are put in order of their frequency over all
texts, rarest first; a text that reaches the threshold must hold one of the first |T| - ceil(t |T|) + 1 (prefix filter),
must have at least ceil(t |T|) template tokens (length filter), and from the first shared token on both sides must have
enough left (positional filter). The survivors are verified exactly, over all their blocks; a block that begins with a
token that isn't the template's has no more of its tokens than a later one, so only the others are looked at.

Texts are read once: what later steps need of them, the places of template tokens, goes to a table in the shared folder.
Only native expressions; the templates are a fixed short list, so what the plan broadcasts about them has a fixed size,
whatever the corpus holds.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import read, stored
from talkweave.llm.quality_rules import bound

#: High enough that a notice of seven tokens doesn't stand for its sister that differs in one (BY-NC and BY-SA).
THRESHOLD = 0.87
#: Words of a block for each word of its template: room for a name or a line mark between the words of a notice.
STRETCH = 1.5
#: Word characters of the contract before A-Z are lowered: ASCII letters and digits, and all that isn't ASCII.
W = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public licence notices, and the label each stands for.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]


def _phrase() -> str:
    body = "|".join(GAP.join(p.split()) for p in PHRASES)
    return f"(?i)(?<!{W})(?:{body})(?!{W})"


def _tokens(text: str) -> list[str]:
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(out))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{W}+")).cast("long")


def lowered(text: Column) -> Column:
    """A-Z in small letters, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed_tokens(text: Column) -> Column:
    """struct<n_words, tokens: array of (at, token)>: the words that are tokens of any template, words counted from 0."""
    known = sorted({t for _, template in TEMPLATES for t in _tokens(template)})
    words = F.filter(F.split(lowered(text), GAP), lambda w: w != "")
    placed = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("token"))), lambda y: y["token"].isin(*known))
    return bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), placed(w).alias("tokens")))


def template_table(texts: DataFrame, threshold: float) -> list[tuple[int, str, list[str], int, int, list[str]]]:
    """(number, label, tokens rarest first, least overlap, words of a block, prefix) of each template; frequencies are
    counted over all texts (column tokens), and one row for each template token comes back."""
    held = texts.select(F.explode(F.array_distinct(F.transform("tokens", lambda x: x["token"]))).alias("token"))
    freq = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most one row a vocabulary entry
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        tokens = sorted(_tokens(text), key=lambda t: (freq.get(t, 0), t))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        out.append((i, label, tokens, need, width(text), tokens[: len(tokens) - need + 1]))
    return out


def width(template: str) -> int:
    return math.ceil(STRETCH * len(re.sub(r"[^a-z0-9]+", " ", template.lower()).split()))


def matches(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of texts but tokens, and template (number), label, containment, first_word: every (text, template) with
    containment >= threshold, once, with its first best block. texts has n_words and tokens (see placed_tokens)."""
    table = template_table(texts, threshold)
    templates = texts.sparkSession.createDataFrame(table, "template int, label string, wanted array<string>, need int, width int, prefix array<string>")
    index = templates.select("template", "label", "wanted", "need", "width", "prefix", F.explode("prefix").alias("token"))
    first = F.array(*[F.lit(t) for t in sorted({t for *_, prefix in table for t in prefix})])
    have = F.array_distinct(F.transform("tokens", lambda x: x["token"]))
    probes = texts.withColumn("have", have).withColumn("token", F.explode(F.array_intersect("have", first)))
    pairs = probes.join(F.broadcast(index), "token")  # the index has a row for each prefix token of a fixed list of templates
    found = pairs.where(F.get(F.array_intersect("prefix", "have"), F.lit(0)) == F.col("token"))  # each pair once: at its first shared token
    found = found.where(F.size("have") >= F.col("need"))  # length
    found = found.where(F.size("wanted") - F.array_position("wanted", F.col("token")) + 1 >= F.col("need"))  # position
    found = found.where(F.size(F.array_intersect("wanted", "have")) >= F.col("need"))
    own = F.filter("tokens", lambda x: F.array_contains("wanted", x["token"]))

    def best(all_: Column) -> Column:
        block = lambda x, i: F.size(F.array_distinct(F.transform(F.filter(F.slice(all_, i + 1, F.col("width")), lambda y: y["at"] < x["at"] + F.col("width")), lambda y: y["token"])))
        return F.array_max(F.transform(all_, lambda x, i: F.struct(block(x, i).alias("n"), (-x["at"]).alias("minus"))))

    done = found.withColumn("best", bound(own, best)).where(F.col("best.n") >= F.col("need"))
    rest = [c for c in texts.columns if c != "tokens"]
    return done.select(*rest, "template", "label", (F.col("best.n") / F.size("wanted")).alias("containment"), (-F.col("best.minus")).cast("long").alias("first_word"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, template, label, containment, first_word of every match. Repeated rows give repeated results. Null
    and empty texts and empty tables give none. Columns besides doc_id and text are ignored."""
    texts = docs.select("doc_id", placed_tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("x")).select("doc_id", "x.*")
    return matches(stored(texts, "license-words"), threshold)


def base_places(text: Column, words: Column) -> Column:
    """struct<n_base, first_word, last_word, base_list>: where the phrases of the base stand in a text of so many words."""
    phrase = F.lit(_phrase())

    def label(hit: Column) -> Column:
        kind = F.lower(F.left(hit, F.lit(1)))
        return F.when(kind == "g", "gpl").when(kind == "a", "apache").when(kind == "c", "cc-by").otherwise("mit")

    def placed(parts: Column, hits: Column) -> Column:
        last = F.element_at(hits, -1)
        return F.struct(
            F.size(hits).cast("long").alias("n_base"),
            F.when(F.size(hits) > 0, n_words(F.get(parts, F.lit(0)))).alias("first_word"),
            F.when(F.size(hits) > 0, words - n_words(F.element_at(parts, -1)) - n_words(last)).alias("last_word"),
            F.array_sort(F.array_distinct(F.transform(hits, label))).alias("base_list"),
        )

    none = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base_list"))
    places = bound(F.split(text, _phrase(), -1), lambda parts: bound(F.regexp_extract_all(text, phrase, F.lit(0)), lambda hits: placed(parts, hits)))
    return F.when(text.rlike(_phrase()), places).otherwise(none)


def scan_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: the base columns, all labels, score: the largest containment found, else 0, and
    n_templates. Null texts are empty; null ids and repeated rows have their own rows; an empty table gives none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select("doc_id", text.alias("text"), placed_tokens(text).alias("x"))
    rows = words.select("doc_id", "x.*", base_places(F.col("text"), F.col("x.n_words")).alias("b")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "license-words")  # from here on the row number is data
    found = matches(rows.select("row", "n_words", "tokens"), threshold).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count("*").alias("n"))
    return rows.drop("tokens").join(found, "row", "left").select(
        "doc_id", "n_words", "b.n_base", "b.first_word", "b.last_word",
        F.array_join("b.base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b.base_list", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_templates"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))


_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLACES = " UNION ALL ".join(
    "SELECT doc_id, i - 1 AS place, '{}' AS label FROM w, range(1, len(w) + 1) r(i) WHERE {}".format(label, " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())))
    for phrase, label in PHRASES.items()
)
_TEMPLATES = ", ".join(f"('{label}', {i}, {_tokens(text)!r}, {width(text)})" for i, (label, text) in enumerate(TEMPLATES))
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_WORDS}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM d),
places AS ({_PLACES}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base_list FROM places GROUP BY doc_id),
t(label, template, tokens, width) AS (VALUES {_TEMPLATES}),
pairs AS (SELECT doc_id, w, label, template, tokens, width, ceil({THRESHOLD} * len(tokens) - 1e-9) AS need FROM w, t WHERE len(list_intersect(tokens, list_distinct(w))) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
starts AS (SELECT *, unnest(generate_series(1, len(w))) AS i FROM pairs),
blocks AS (SELECT doc_id, label, template, need, len(tokens) AS n, len(list_intersect(tokens, list_distinct(w[i:i + width - 1]))) AS k FROM starts WHERE list_contains(tokens, w[i])),
hits AS (SELECT doc_id, label, template, max(k) / n AS containment FROM blocks WHERE k >= need GROUP BY doc_id, label, template, n),
m AS (SELECT doc_id, list(DISTINCT label) AS found, max(containment) AS best, count(*) AS n_templates FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base_list), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []::VARCHAR[]), coalesce(found, []::VARCHAR[])))), ','), '') AS labels,
  coalesce(best, 0)::DOUBLE AS score, coalesce(n_templates, 0)::BIGINT AS n_templates
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
