"""License scan: a positional index of rare licence words, in DataFrame functions alone.

1. Every text is split once; kept are the places of the index's words and of the base phrases.
2. Document frequencies of these words over all documents give their IDF.  Each template is posted under
   its own RARE highest-IDF words, and all places of these words in a file are looked up, whatever else the
   file holds; a posting at place t for a word at place p votes for the template to begin at p - t.
3. A template is found where its voting words hold at least SHARE of the IDF of its own indexed words, and
   its key phrases stand there word by word.

The templates are parameters of fixed size.  Their texts are opening words of public licences and notices.

Nulls and ties: a null or empty text has no words, no labels and score 0.  Repeated rows are alike; rows
with a null doc_id are scanned too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions.once import pin
from codewarden.session import cut_lineage

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# (label, opening words, key phrase that must stand in them)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
COMMON = frozenset("a and any are by copy for form in is met of or or provided that the this to under use with v 0 2 3 4".split())
RARE = 6
SHARE = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def places(words: str, phrase: str) -> Column:
    """Starts, from 0, of the words of a phrase standing one after another in the array `words`."""
    parts = phrase.split()
    low = F.col(words)
    every = F.sequence(F.lit(0), F.size(low) - len(parts))

    def here(i: Column) -> Column:
        ok = low[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            ok = ok & (low[i + k] == part)
        return ok

    some = (F.size(low) >= len(parts)) & F.array_contains(low, parts[-1])
    return F.when(some, F.filter(every, here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE, templates: tuple[tuple[str, str, str], ...] = TEMPLATES,
         rare: int = RARE, share: float = SHARE) -> DataFrame:
    """doc_id with counts of words and base phrases, their span, base labels, all labels and a score."""
    spark = docs.sparkSession
    indexed = sorted({w for _, text, _ in templates for w in text.split() if w not in COMMON})
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    split = pin(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), low.alias("low")), {"words": F.regexp_extract_all("low", F.lit(WORD), 0)})
    placed = F.filter(F.transform("words", lambda w, i: F.when(w.isin(indexed), F.struct(w.alias("word"), i.alias("pos")))), lambda x: x.isNotNull())
    phrases = sorted({p for _, _, p in templates})
    columns = {"n_words": F.size("words").cast("long"), "hits": placed}
    columns |= {f"base{k}": places("words", phrase) for k, (phrase, _) in enumerate(base)}
    columns |= {f"key{k}": places("words", phrase) for k, phrase in enumerate(phrases)}
    rows = cut_lineage(split.select("doc_id", "text_hash", *(c.alias(n) for n, c in columns.items())))

    total = rows.count()
    words_in = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    idf = words_in.groupBy("word").agg(F.log((F.lit(float(total)) + 1) / (F.count("*") + 0.5)).alias("idf"))
    known = {r["word"]: r["idf"] for r in idf.collect()}  # one row for each indexed word at most
    weight = {w: max(known.get(w, 0.0), 0.01) for w in indexed}
    posted, needed = [], []
    for number, (label, text, phrase) in enumerate(templates):
        at = text.split()
        own = sorted({w for w in at if w in weight}, key=lambda w: (-weight[w], w))[:rare]
        posted += [(number, w, t, weight[w]) for t, w in enumerate(at) if w in own]
        place = next(i for i in range(len(at)) if at[i:i + len(phrase.split())] == phrase.split())
        needed.append((number, label, sum(weight[w] for w in own), phrases.index(phrase), place))
    postings = spark.createDataFrame(posted, "template int, word string, at int, idf double")
    facts = spark.createDataFrame(needed, "template int, label string, whole double, phrase int, phrase_at int")

    words = rows.where(F.size("hits") > 0).select("doc_id", "text_hash", F.explode("hits").alias("h")).select("doc_id", "text_hash", "h.word", "h.pos").distinct()
    votes = (words.join(F.broadcast(postings), "word").groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("at")).alias("begin"))
             .agg(F.sum("idf").alias("held")))
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("phrase"), F.col(f"key{k}").alias("starts")) for k in range(len(phrases))))).alias("k")
    stands = rows.where(F.size("hits") > 0).select("doc_id", "text_hash", keys).select("doc_id", "text_hash", "k.phrase", F.explode("k.starts").alias("start")).distinct()
    good = votes.join(F.broadcast(facts), "template").where(F.col("held") >= F.lit(share) * F.col("whole"))
    found = (good.alias("g").join(stands.alias("s"), F.col("g.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("g.text_hash") == F.col("s.text_hash"))
                                  & (F.col("g.phrase") == F.col("s.phrase")) & (F.col("g.begin") + F.col("g.phrase_at") == F.col("s.start")))
             .groupBy("g.doc_id", "g.text_hash").agg(F.collect_set("label").alias("more"), F.max(F.least(F.lit(1.0), F.col("held") / F.col("whole"))).alias("share"))
             .select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "more", "share"))

    starts = F.concat(*(F.col(f"base{k}") for k in range(len(base))))
    own = F.filter(F.array(*(F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(base))), lambda x: x.isNotNull())
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    both = F.array_union("own", F.coalesce("more", F.array().cast("array<string>")))
    return (out.withColumn("starts", starts).withColumn("own", F.array_sort(F.array_distinct(own)))
            .select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
                    F.array_max("starts").cast("long").alias("last_word"), F.array_join("own", ",").alias("base_labels"),
                    F.array_join(F.array_sort(both), ",").alias("labels"),
                    F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score")))


def matches(text: str | None, phrase: str) -> list[int]:
    """Plain form of `places` for tests."""
    words = re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWER)))
    parts = phrase.split()
    return [i for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
