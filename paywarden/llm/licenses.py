"""Licence notices by a positional index of rare words.

Templates of notices are cut into words with their positions. The document frequency of every template word is counted over
all files; the two rarest words of each template's mandatory phrases are its anchors. Each file's anchors are looked up,
every posting proposes a place where the template would start, and the template holds there if all words of its mandatory phrases
stand at their relative positions. As a template that holds has its anchors in the file, the lookup loses none. The score of a
place is the share of the template's words, weighted by rarity, that stand where they should.

Cases: null and empty texts have no words, labels and places, and score 0. Repeated rows are judged one by one and may repeat
ids or have null ids. A word's positions count from 0. Texts of any length are read whole; empty in, empty out; extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.shared import ascii_lower, stored

#: Base phrase and its label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, template, mandatory part. Public wordings of notices, lower-cased, as words.
TEMPLATES = [
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
]
ANCHORS = 2


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of anything beyond ASCII, lower-cased."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase among the words, looked for only where the first word is there at all."""
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), lambda i: reduce(
        lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(phrase)]))
    here = reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in dict.fromkeys(phrase)]) & (F.size(words) >= len(phrase))
    return F.when(here, starts).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))


def _index() -> list[tuple[int, str, str, int, bool]]:
    """(template, label, word, position, mandatory) of every template word."""
    rows = []
    for t, (label, text, needed) in enumerate(TEMPLATES):
        words, part = text.split(), needed.split()
        first = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
        rows += [(t, label, w, i, first <= i < first + len(part)) for i, w in enumerate(words)]
    return rows


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base_places (starts), base_labels, method_labels and score of every row; no Python on the executors."""
    spark = docs.sparkSession
    index = spark.createDataFrame(_index(), "template int, label string, word string, at int, needed boolean")
    vocabulary = F.array(*[F.lit(w) for w in sorted({r[2] for r in _index()})])
    words = words_of(F.col("text").cast("string"))
    read = docs.select(F.col("doc_id").cast("bigint"), words.alias("words"))
    base = F.array_sort(F.concat(*[_labelled(_places(F.col("words"), p.split()), label) for p, label in BASE.items()]))
    held = F.array_intersect("words", vocabulary)
    # One pass: which template words a file has, and their positions where all mandatory words of a template are there.
    needs = {t: sorted({r[2] for r in _index() if r[0] == t and r[4]}) for t in range(len(TEMPLATES))}
    possible = reduce(lambda a, b: a | b, [F.size(F.array_intersect(F.col("held"), F.array(*map(F.lit, n)))) == len(n) for n in needs.values()])
    seen = F.when(possible, F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda s: s["word"].isin(
        sorted({r[2] for r in _index()}))))
    facts = stored(read.withColumn("held", held).select("doc_id", F.size("words").cast("bigint").alias("n_words"), base.alias("base"), "held", seen.alias("seen"))
                   .withColumn("row", F.monotonically_increasing_id()), "licence-words")
    files = facts.count()
    frequency = facts.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files_with"))
    rare = index.join(frequency, "word", "left").withColumn("idf", F.log((F.lit(files) + 1.0) / (F.coalesce("files_with", F.lit(0)) + 1.0)) + 1.0)
    rare = stored(rare, "licence-index")  # as many rows as the templates have words
    needed = rare.filter("needed").groupBy("template").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("idf")).alias("order"), "word"))), 1, ANCHORS).word.alias("anchors"))
    templates = rare.groupBy("template").agg(
        F.collect_list(F.struct("word", "at", "needed", "idf")).alias("parts"), F.first("label").alias("label"), F.sum("idf").alias("weight"),
        F.count(F.when(F.col("needed"), 1)).alias("n_needed")).join(needed, "template")
    # Postings of each template's rarest mandatory word; the places around one are all that its template can reach.
    lookups = rare.filter("needed").select("template", "word", "at").join(templates, "template").filter(F.col("word") == F.col("anchors")[0])
    rarest = [r.word for r in needed.select(F.col("anchors")[0].alias("word")).distinct().collect()]  # a word a template at most
    postings = F.filter(F.transform("seen", lambda s, k: F.struct(
        s["word"].alias("word"), s["at"].alias("place"), k.alias("k"))), lambda s: s["word"].isin(rarest))
    reach = max(len(text.split()) for _, text, _ in TEMPLATES)
    near = F.slice("seen", F.greatest(F.col("s.k") - reach + 2, F.lit(1)), 2 * reach)  # k counts from 0, slice from 1
    found = facts.filter(F.arrays_overlap("held", F.array(*[F.lit(w) for w in rarest])) & F.col("seen").isNotNull()).select(
        "row", "seen", F.explode(postings).alias("s")).select("row", F.col("s.word").alias("word"), F.col("s.place").alias("place"), near.alias("near"))
    met = found.join(F.broadcast(lookups), "word").withColumn("start", F.col("place") - F.col("at"))
    stands = lambda p: F.exists("near", lambda x: (x["word"] == p["word"]) & (x["at"] == F.col("start") + p["at"]))
    # The other anchors' postings at the same start, then every word of the mandatory phrases, then the whole template.
    met = met.filter(F.forall("anchors", lambda a: F.exists("parts", lambda p: p["needed"] & (p["word"] == a) & stands(p))))
    held_parts = met.withColumn("got", F.filter("parts", stands))
    holds = held_parts.filter(F.size(F.filter("got", lambda p: p["needed"])) == F.col("n_needed"))
    share = F.aggregate(F.array_sort(F.col("got.idf")), F.lit(0.0), lambda total, x: total + x) / F.col("weight")
    answers = holds.groupBy("row").agg(F.collect_set("label").alias("method"), F.max(F.round(share, 6)).alias("score"))
    out = facts.select("row", "doc_id", "n_words", "base").join(answers, "row", "left")
    return out.select("doc_id", "n_words", F.col("base.at").alias("base_places"), F.array_distinct("base.label").alias("base_labels"),
                      F.coalesce("method", F.array().cast("array<string>")).alias("method_labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
