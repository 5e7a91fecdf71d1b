"""License scan: exact set-similarity join of text blocks with license templates, DataFrame functions only.

A block is a line of a text, or what stands around a line's end: as many words on either side as the longest template
has but one, over further line ends, so that a wrapped notice is in a block whole. A template is the word set of a
license notice. A block is labelled when it contains CONTAINMENT of a template's words. Words are ordered by their frequency over all blocks, rarest first. A block with
nb template words and a template with nt, of which `need` must be shared, can only match when they share a word among
their first nb - need + 1 and nt - need + 1 (prefix), when nb >= need (length), and when the words behind one shared
word suffice (position). What passes is counted exactly. Templates are a fixed list, so the index of their prefixes
is broadcast with a known size; the frequencies sent to the driver are those of template words only.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, read_table

CONTAINMENT = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively (fixed by the query's contract).
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: Our own templates: label and notice.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
]


def _words(line: Column) -> Column:
    return F.split(line, SEPARATORS)


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _blocks(text: Column, reach: int) -> Column:
    """The words of each line, and of each line end with `reach` words on either side."""
    low = ascii_lower(text)
    # runs of separators become one blank, or one line end between blanks where they hold one
    flat = F.regexp_replace(F.regexp_replace(low, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " "), r" *\n[ \n]*", " \n ")
    word = lambda w: w != "\n"
    # no two line ends are neighbours, so 2 * reach places hold `reach` words where the text has them

    def around(ws, i):
        before = F.filter(F.slice(ws, F.greatest(i - 2 * reach, F.lit(0)) + 1, F.least(i, F.lit(2 * reach))), word)
        after = F.filter(F.slice(ws, i + 2, F.lit(2 * reach)), word)
        return F.concat(F.slice(before, F.greatest(F.size(before) - reach, F.lit(0)) + 1, F.lit(reach)), F.slice(after, F.lit(1), F.lit(reach)))

    def ends(ws):
        at = F.filter(F.transform(ws, lambda w, i: F.when(w == "\n", i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: around(ws, i))

    # as a lambda's variable the words are split once, not for every line end
    return F.concat(F.transform(F.split(low, "\n"), _words), F.flatten(F.transform(F.array(F.split(F.trim(flat), " ")), ends)))


def block_matches(docs: DataFrame, templates=None, containment: float = CONTAINMENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, label, score): each row's matched labels with the best containment of a template of that label.

    Null or empty texts have no blocks. Repeated keys are taken together. Ties: a label's best score counts once.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.split()))) for label, t in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    # a text without enough words of any template has no block that has them
    def enough(own):
        return reduce(Column.__or__, [F.size(F.array_intersect(own, _array(ws))) >= ceil(containment * len(ws) - 1e-9) for _, ws in sets])

    own = F.array(F.array_intersect(_array(vocabulary), _words(ascii_lower(F.col(text)))))
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.exists(own, enough))
    reach = max((len(t.split()) for _, t in templates), default=1) - 1
    blocks = some.select("key", F.explode(_blocks(F.col("text"), reach)).alias("block"))
    counted = (
        blocks.select(F.explode(F.array_intersect(_array(vocabulary), F.col("block"))).alias("w"))
        .groupBy("w")
        .count()
        .collect()
    )  # one row a template word at most
    df = {r["w"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, least = [], min(ceil(containment * len(ws)) for _, ws in sets)
    for t, (label, ws) in enumerate(sets):
        ws = sorted(ws, key=rank.get)
        need = ceil(containment * len(ws) - 1e-9)
        index += [(w, t, label, j, len(ws), need, ws) for j, w in enumerate(ws[: len(ws) - need + 1])]
    index = spark.createDataFrame(index, "w string, t int, label string, j int, nt int, need int, words array<string>")
    nb = F.size("own")
    return (
        blocks.select("key", F.array_intersect(_array(order), F.col("block")).alias("own"))
        .where(nb >= least)
        .select("key", "own", F.posexplode(F.slice("own", F.lit(1), nb - least + 1)).alias("i", "w"))
        .join(F.broadcast(index), "w")
        .where((nb >= F.col("need")) & (F.col("i") <= nb - F.col("need")))
        .where(F.least(nb - F.col("i"), F.col("nt") - F.col("j")) >= F.col("need"))
        .select("key", "label", "need", "nt", F.size(F.array_intersect("own", "words")).alias("shared"))
        .where("shared >= need")
        .groupBy("key", "label")
        .agg(F.max(F.col("shared") / F.col("nt")).alias("score"))
        .withColumnRenamed("key", key)
    )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: word count, places of the phrases, labels of phrases and of template matches, score.

    Null and empty texts: 0 words, no places, empty labels, score 0. An empty table gives an empty result. Rows that
    share a key share their template matches; a row with a null key has those of the phrases only.
    """
    trimmed = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS, " "))
    d = docs.select(F.col(key), trimmed.alias("norm"))
    padded = F.concat(F.lit(" "), "norm", F.lit(" "))
    hits = {label: padded.contains(f" {p} ") for label, p in PHRASES.items()}
    none = F.array().cast("array<int>")

    def places(phrase: str) -> Column:
        ws = phrase.split()
        test = lambda i: sum((F.get("ws", i + k) == F.lit(w)).cast("int") for k, w in enumerate(ws)) == len(ws)
        return F.when(padded.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size("ws") - 1), test)).otherwise(none)

    seen = hits["mit"] | hits["apache-2"] | hits["cc-by-nc"]
    d = d.select(
        key,
        "norm",
        F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(seen, F.split("norm", " ")).alias("ws"),
    )
    d = d.select(
        key,
        "n_words",
        F.concat(*[places(p) for p in PHRASES.values()]).alias("at"),
        F.array_compact(F.array(*[F.when(h, F.lit(label)) for label, h in hits.items()])).alias("base"),
    )
    found = block_matches(docs, text=text, key=key).groupBy(key).agg(F.collect_set("label").alias("own"), F.max("score").alias("best"))
    empty = F.array().cast("array<string>")
    return d.join(found, key, "left").select(
        key,
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", empty))), ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; see scan() for nulls, repeats and empty tables."""
    return scan(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    place = []
    for label, p in PHRASES.items():
        ws = p.split()
        test = " and ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(ws))
        place.append(f"select doc_id, i - 1 as i, '{label}' as label from w, unnest(range(1, len(ws) + 1)) as u(i) where {test}")
    rows = ", ".join(f"({k}, '{label}', [{', '.join(repr(x) for x in sorted(set(t.split())))}])" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
with w as (select doc_id, regexp_extract_all({lower}, '{cls}') as ws from documents),
p as ({' union all '.join(place)}),
pa as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_distinct(list(label)) as base from p group by doc_id),
t(k, label, need) as (values {rows}),
b as (select doc_id, list_distinct(regexp_extract_all(line, '{cls}')) as own
      from (select doc_id, unnest(string_split({lower}, chr(10))) as line from documents)),
m as (select doc_id, label, max(len(list_intersect(own, need)) / len(need)) as score
      from b, t where len(list_intersect(own, need)) >= ceil({CONTAINMENT} * len(need) - 1e-9) group by all),
ma as (select doc_id, list(label) as own, max(score) as best from m group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from w left join pa using (doc_id) left join ma using (doc_id)"""


ORACLE_SQL = _oracle()
