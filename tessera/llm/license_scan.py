"""License scan: base phrases, and an exact set-similarity join of text blocks with notice templates.

DataFrame operations only. Tokens are ordered by their frequency over the whole corpus, rarest first. A template that a
block contains to the threshold shares a token of its prefix with the block's prefix, so blocks and templates meet in an
equality join on prefix tokens; length and positional filters and the exact overlap follow.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, maybe_broadcast

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public licence notices: label, words without which a block isn't that notice, and text.
TEMPLATES = [
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "permission granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission granted sublicense", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "compliance obtain", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "apache", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("gpl", "general public", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "general public", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "general public", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("cc-by-nc", "cc nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "commons sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]
#: Share of a template's distinct tokens that a block must hold, in hundredths.
PERCENT = 80
#: Fewest words from one block to the next.
LEAST_STEP = 8
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A template's distinct tokens, the tokens it can't do without, how many a block must hold, and the step of blocks:
    a power of two that isn't less than its words."""

    label: str
    tokens: list[str]
    must: list[str]
    need: int
    step: int


def _words(text: str) -> list[str]:
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text)
    return "".join(x if "0" <= x <= "9" or "a" <= x <= "z" or x > "\x7f" else " " for x in low).split(" ")


def prepared(templates: list[tuple[str, str, str]], percent: int = PERCENT) -> list[Template]:
    out = []
    for label, must, text in templates:
        words = [w for w in _words(text) if w]
        if words:
            tokens = sorted(set(words))
            out.append(Template(label, tokens, sorted(must.split()), -(-percent * len(tokens) // 100), max(LEAST_STEP, 1 << (len(words) - 1).bit_length())))
    return out


def _normal(text: Column) -> Column:
    """Words of text joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(text), _SEPARATORS, " "))


def _spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, percent: int = PERCENT, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for each row of df.

    Words are runs of ASCII digits, letters and all non-ASCII characters, after A-Z are lower-cased. n_base counts the
    places where a phrase's words stand consecutively, first_word and last_word being the smallest and largest start
    (null without any). A text block is a window of 2 * step words from every step-th word of the whole text on, step
    being the least power of two (8 or more) that isn't less than a template's words: wherever a notice lies, and however its lines are
    wrapped, a block holds it whole. A block matches a template if it holds percent / 100 of the template's distinct
    tokens or more, and all that the template can't do without. blocks lists every match (first word, step, label,
    containment); score is the largest containment among them, or 0. labels adds the matches' labels to base_labels;
    both are distinct, sorted, joined by commas.

    Each text is normalised once and written with its tokens; only texts that as a whole hold enough of a template are
    cut into blocks. The token order comes from document frequencies over all of df, restricted to the templates'
    tokens: their number is bounded by the templates, a parameter, and so are what is collected and broadcast.

    Null and empty texts have no words, labels '' and score 0. Repeated rows and null ids each give a row. An empty df
    gives an empty result. Other columns of df are ignored, whatever their names.
    """
    spark = df.sparkSession
    sets = prepared(templates, percent)
    domain = sorted({t for x in sets for t in x.tokens})
    docs = df.select(F.col(id_col).alias("id"), _normal(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    docs = docs.select("id", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("norm"), F.when(F.col("norm") == "", 0).otherwise(_spaces(F.col("norm")) + 1).cast("long").alias("n_words"), F.array_intersect(F.split("norm", " "), _strings(domain)).alias("toks"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        there = F.col("norm").contains(f" {phrase} ")
        counts.append(F.when(there, F.regexp_count("norm", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(there, _spaces(F.substring_index("norm", f" {phrase} ", 1))))
        lasts.append(F.when(there, F.col("n_words") - _spaces(F.substring_index("norm", f" {phrase} ", -1)) - len(phrase.split(" "))))
        labels.append(F.when(there, F.lit(label)))
    pick = lambda f, cs: f(*cs) if len(cs) > 1 else cs[0]
    may = reduce(Column.__or__, [(F.size("toks") >= x.need) & (F.size(F.array_intersect("toks", _strings(x.tokens))) >= x.need) & (F.size(F.array_intersect("toks", _strings(x.must))) == len(x.must)) for x in sets], F.lit(False))
    docs = docs.select(
        F.monotonically_increasing_id().alias("number"), "id", "n_words", reduce(Column.__add__, counts).alias("n_base"), pick(F.least, firsts).alias("first_word"), pick(F.greatest, lasts).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"), "toks", F.when(may, F.trim("norm")).alias("norm"),
    )
    docs = materialize(docs, "licence-tokens")

    often = {r["token"]: r["count"] for r in docs.select(F.explode("toks").alias("token")).groupBy("token").count().collect()}
    rank = {t: k for k, t in enumerate(sorted(domain, key=lambda t: (often.get(t, 0), t)))}
    index = []
    for k, x in enumerate(sets):
        order = sorted(rank[t] for t in x.tokens)
        index += [(r, x.step, k, x.label, pos, len(order), x.need, order, [rank[t] for t in x.must]) for pos, r in enumerate(order[: len(order) - x.need + 1])]
    index = spark.createDataFrame(index, "rank int, step int, template int, label string, tpos int, tlen int, need int, order array<int>, must array<int>")

    ranks = F.create_map(*[x for t, k in rank.items() for x in (F.lit(t), F.lit(k))]) if rank else F.create_map().cast("map<string,int>")
    steps = sorted({x.step for x in sets})
    least = min((x.need for x in sets), default=0)

    def cut(step: int) -> Column:
        """Blocks of a step. They are cut out within the row, so that a long text isn't copied for each of them."""
        starts = F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - step - 1, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda at: F.struct(F.lit(step).alias("step"), at.alias("at"), F.array_intersect(F.slice("w", at + 1, 2 * step), _strings(domain)).alias("toks")))

    texts = docs.where("norm is not null").select("number", "n_words", F.split("norm", " ").alias("w"))
    none = F.array().cast("array<struct<step:int,at:int,toks:array<string>>>")
    parts = F.filter(F.concat(none, *[cut(k) for k in steps]), lambda x: F.size(x["toks"]) >= least)
    blocks = texts.select("number", F.explode(parts).alias("x")).select("number", "x.step", "x.at", "x.toks")
    blocks = blocks.select("number", "step", "at", F.sort_array(F.transform("toks", lambda t: F.element_at(ranks, t))).alias("toks"))
    held = blocks.select("*", F.size("toks").alias("blen"), F.posexplode("toks").alias("bpos", "rank"))
    near = held.join(F.broadcast(index), ["rank", "step"]).where("blen >= need and bpos <= blen - need and least(tlen - tpos, blen - bpos) >= need")
    near = near.withColumn("both", F.size(F.array_intersect("toks", "order"))).where((F.col("both") >= F.col("need")) & (F.size(F.array_intersect("toks", "must")) == F.size("must")))
    near = near.select("number", "at", "step", "template", "label", (F.col("both") / F.col("tlen")).alias("containment")).distinct()
    near = materialize(near.groupBy("number").agg(F.array_sort(F.collect_set(F.struct("at", "step", "label", "containment"))).alias("blocks")), "licence-blocks")

    out = docs.drop("toks", "norm").join(maybe_broadcast(near, near.count(), 20_000), "number", "left")
    more = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    score = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"), score.alias("score"), "blocks",
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


_MATCH = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _oracle() -> str:
    spots = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        test = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        spots.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    listed = lambda values: "[" + ", ".join(f"'{t}'" for t in values) + "]"
    rows = ", ".join(f"('{x.label}', {listed(x.tokens)}, {listed(x.must)}, {x.need}, {x.step})" for x in prepared(TEMPLATES))
    return f"""
with words as (select row_number() over () as r, doc_id, {_MATCH.format("coalesce(text, '')")} as w from documents),
base as (select r, doc_id, len(w)::bigint as n_words, list_concat(list_concat({spots[0]}, {spots[1]}), {spots[2]}) as s from words),
templates(label, toks, must, need, step) as (values {rows}),
steps as (select distinct step from templates),
places as (select r, w, step, unnest(range(0, greatest(len(w) - step, 1), step)) as pos from words, steps),
blocks as (select r, step, list_distinct(list_slice(w, pos + 1, pos + 2 * step)) as b from places),
hits as (select r, label, len(list_intersect(b, toks)) / len(toks) as c from blocks join templates using (step)
  where len(b) >= need and len(list_intersect(b, toks)) >= need and len(list_intersect(b, must)) = len(must)),
by_doc as (select r, list(distinct label) as l, max(c) as score from hits group by r)
select doc_id, n_words, len(s)::bigint as n_base, list_min(list_transform(s, lambda x: x['at'])) as first_word, list_max(list_transform(s, lambda x: x['at'])) as last_word,
  array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x['label']))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(s, lambda x: x['label']), coalesce(l, [])))), ',') as labels, coalesce(score, 0.0)::double as score
from base left join by_doc using (r)
"""


ORACLE = _oracle()
