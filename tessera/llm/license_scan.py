"""License scan: a positional rare-token index, DataFrame functions only.

Templates are licence texts, notices and phrases with their mandatory key phrases. The
words of the key phrases are weighed by IDF over all documents; each template is indexed
by the ``RARE_WORDS`` of them that weigh most, with their places. All files' occurrences
of those words are looked up, and a posting turns an occurrence into the template's start.
Postings are intersected by that relative position: of the hits of one (file, template,
start) there must be one for every indexed word. A start that is left is verified word by
word: all key phrases must stand in their places. The score of a find is the IDF share of
the template's words that stand in place. As the indexed words belong to phrases that
must stand, whichever they are, the intersection loses no licence.

Base phrases are templates whose key phrase is the whole phrase.

Size: templates are a parameter table (``MAX_TEMPLATE_WORDS`` words at most, checked),
so the broadcast index is bounded. The hits of a file are grouped by (file, template,
start), so a text of one word a million times over is many small groups. Defined cases: a
null or empty text has no words and no labels; repeated and null ids are scanned one by
one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .phrase_index import END, WORD, numbered, probe, shingle, stands, words

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Template label, template words, key phrases that must stand in it.
TEMPLATES = (
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("artistic", "the artistic license", ("artistic license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", ("bsd 3 clause license",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc0", "cc0 1 0 universal", ("cc0",)),
    ("epl", "eclipse public license", ("eclipse public license",)),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ("permission to use copy modify and or distribute this software",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ("hereby granted free of charge", "obtaining a copy of this software")),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    ("public-domain", "free and unencumbered software released into the public domain", ("released into the public domain",)),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("deal in the software without restriction", "merge publish distribute sublicense and or sell copies")),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
     ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""", ("this software for any purpose with or without fee is hereby granted", "this permission notice appear in all copies")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
     ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely")),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
     ("you can redistribute it and or modify it under the terms of the gnu general public license",)),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version.""", ("redistribute it and or modify it under the terms of the gnu lesser general public license",)),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""", ("you may not use this file except in compliance with the license",)),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
     ("this source code form is subject to the terms of the mozilla public license",)),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means.""", ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software")),
)
RARE_WORDS = 3
MAX_TEMPLATE_WORDS = 20_000


def phrase(text: str) -> list[str]:
    """Words of a template, as those of a document."""
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))


def template_table(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """``template, label, base, words, keys (back, words)``."""
    rows = []
    for is_base, group in ((True, [(label, text, (text,)) for text, label in base]), (False, templates)):
        for label, text, keys in group:
            w = phrase(text)
            places = []
            for key in keys:
                k = phrase(key)
                places.append((next(i for i in range(len(w)) if w[i:i + len(k)] == k), k))
            rows.append((len(rows), label, is_base, w, places))
    if sum(len(r[3]) for r in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    return spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>, "
                                 "keys array<struct<back:int,words:array<string>>>")


def word_idf(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """``word, idf`` of the templates' words over all documents. Each task counts the
    bounded vocabulary, so only counts are shuffled."""
    vocabulary = templates.select(F.explode("words").alias("word")).distinct()
    every = vocabulary.agg(F.sort_array(F.collect_set("word")).alias("vocabulary"))
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    held = (docs.select(words(F.col("text")).alias("words")).crossJoin(F.broadcast(every))
            .select(F.explode(F.array_intersect("words", "vocabulary")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held")))
    return (vocabulary.join(held, "word", "left").crossJoin(F.broadcast(total))
            .select("word", F.log((F.col("n_docs") + 1) / (F.coalesce("held", F.lit(0)) + 0.5)).alias("idf")))


def weighed(templates: DataFrame, idf: DataFrame) -> DataFrame:
    """``template, label, base, keys, all (back, word, idf)``."""
    placed = templates.select("template", F.posexplode("words").alias("back", "word")).join(F.broadcast(idf), "word")
    return templates.drop("words").join(placed.groupBy("template").agg(F.collect_list(F.struct("back", "word", "idf")).alias("all")), "template")


def rare_index(templates: DataFrame, idf: DataFrame, rare_words: int = RARE_WORDS) -> DataFrame:
    """``token, postings``: for each indexed word the ``(template, back, index, of)`` it
    stands for: its place, its number among the template's ``of`` indexed words. The end
    marker is posted to template ``END``."""
    keys = templates.select("template", F.explode("keys").alias("key")).select(
        "template", F.posexplode("key.words").alias("pos", "word"), F.col("key.back").alias("from"))
    placed = keys.select("template", "word", (F.col("from") + F.col("pos")).alias("back")).distinct().join(F.broadcast(idf), "word")
    ranked = placed.groupBy("template").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("neg"), "back", "word"))), 1, rare_words).alias("rare"))
    one = ranked.select("template", F.size("rare").alias("of"), F.posexplode("rare").alias("index", "r")).select(
        F.array("r.word").alias("words"), F.struct("template", F.col("r.back").alias("back"), "index", "of").alias("posting"))
    index = one.select(shingle(F.lit(0), 1).alias("token"), "posting").groupBy("token").agg(F.collect_list("posting").alias("postings"))
    end = F.struct(F.lit(END).alias("template"), F.lit(0).alias("back"), F.lit(0).alias("index"), F.lit(1).alias("of"))
    return index.unionByName(templates.sparkSession.range(1).select(F.lit(END).cast("long").alias("token"), F.array(end).alias("postings")))


def _key_phrases_stand() -> Column:
    return F.forall("keys", lambda k: stands(F.col("start") + k["back"], k["words"]))


def _share() -> Column:
    total = F.aggregate("all", F.lit(0.0), lambda a, w: a + w["idf"])
    there = F.aggregate("all", F.lit(0.0), lambda a, w: a + F.when(stands(F.col("start") + w["back"], F.array(w["word"])), w["idf"]).otherwise(0.0))
    return F.when(total > 0, F.least(F.lit(1.0), there / total)).otherwise(1.0)


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, rare_words: int = RARE_WORDS) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places``;
    ``places`` lists each verified template with its start."""
    spark = docs.sparkSession
    table = template_table(spark, base, templates)
    idf = word_idf(docs, table)
    reach = max(len(phrase(text)) for text in [b[0] for b in base] + [t[1] for t in templates])
    found = probe(numbered(docs), rare_index(table, idf, rare_words), 1, reach).select("row", "part", "doc_id", "n_words", "at", "low", "near", F.explode("postings").alias("p"))
    # One hit carries the words around it; the others only count.
    around = F.when(F.col("p.index") == 0, F.struct("doc_id", "n_words", "low", F.when(F.col("p.template") != END, F.col("near")).alias("near")))
    hits = found.select("row", "part", F.col("p.template").alias("template"), (F.col("at") - F.col("p.back")).alias("start"), F.col("p.of").alias("of"), around.alias("x"))
    met = hits.groupBy("row", "part", "template", "start", "of").agg(F.count(F.lit(1)).alias("n"), F.first("x", ignorenulls=True).alias("x")).where("n = of")
    starts = met.join(F.broadcast(weighed(table, idf)), "template", "left").select("row", "part", "template", "start", "label", "base", "keys", "all", "x.*")
    place = F.when(F.col("template") != END, F.struct("template", "label", "base", F.col("start").alias("first"), _share().alias("share")))
    verified = starts.where((F.col("template") == END) | _key_phrases_stand()).select("row", "part", F.when(F.col("template") == END, F.struct("doc_id", "n_words")).alias("doc"), place.alias("place"))
    places = verified.groupBy("row", "part").agg(F.max("doc").alias("doc"), F.array_sort(F.collect_list("place")).alias("places")).select("doc.*", "places")
    base_places = F.filter("places", lambda p: p["base"])
    firsts = F.transform(base_places, lambda p: p["first"].cast("long"))

    def labels(of):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))))

    return places.select(
        "doc_id", "n_words", F.size(base_places).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), labels(base_places).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places")
