"""License scans by diagonal voting of word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._text import LOWER, bounds, chunks, column_bytes, mix, ragged, span_hashes
from tidemark.llm._work import saved

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices, whole licenses, the titles of those too long to be whole here, and identifiers, as words.
NOTICES = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license version"),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution"),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc"),
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc"),
    ("mpl-2", "mozilla public license version 2 0 1 definitions"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("mit", "spdx license identifier mit"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("lgpl", "spdx license identifier lgpl"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("isc", "spdx license identifier isc"),
    ("zlib", "spdx license identifier zlib"),
    ("unlicense", "spdx license identifier unlicense"),
    ("cc-by", "spdx license identifier cc by 4 0"),
    ("cc-by-sa", "spdx license identifier cc by sa 4 0"),
    ("cc0", "spdx license identifier cc0 1 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    ),
]
#: Whole licenses are often told by their first words alone, which are templates too.
OPENING = 24
K = 3
MOST_WORDS = 512
#: Votes of so many template positions are one long.
BITS = 62
#: A passage is labelled when so much of its template's k-grams is found around one diagonal, at most
#: 1 / SPREAD of the template's words away on either side.
LEAST_COVER, SPREAD = 0.6, 4
#: Notices of so few words tell licenses apart by a single word, so all their k-grams must be found.
SHORT = 12
#: The gram that each text has besides its own, so that a text without any match keeps a row.
NONE = 0
#: Diagonals of a text and template are looked at in tiles of so many, as are words where passages overlap.
TILE = 1 << 12
#: Diagonals are scaled so that each template's reach is this one frame: with floor(FRAME / reach), no further neighbour falls into it.
FRAME = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def templates() -> list[tuple[str, bool, list[str]]]:
    """(label, whether a base phrase, words) of each template; bounded by the two tables above."""
    out = [(label, True, phrase.split()) for phrase, label in BASE.items()]
    for label, text in NOTICES:
        words = text.split()
        out += [(label, False, words)] + ([(label, False, words[:OPENING])] if len(words) > 2 * OPENING else [])
    assert all(K <= len(w) <= MOST_WORDS for _, _, w in out)
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; the row and hash of each k-gram, in order."""
    part, at = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    starts, ends = bounds(_WORD[part], at)
    words = span_hashes(part, starts, ends)
    n = np.diff(np.searchsorted(starts, at))
    grams = np.zeros(max(0, len(words) - K + 1), np.uint64)
    for j in range(K):
        grams = mix(grams + words[j : j + len(grams)])
    first = np.cumsum(n) - n
    grams[grams == NONE] = 1
    inside = ragged(first, np.maximum(n - K + 1, 0))
    return n, np.repeat(np.arange(len(n)), np.maximum(n - K + 1, 0)), grams[inside]


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, base, t_words, t_grams, t_pos, gram: every k-gram of every template, and nulls for the gram NONE."""
    rows = []
    for t, (label, base, words) in enumerate(templates()):
        text = " ".join(words).encode()
        _, _, grams = _grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        rows += [(t, label, base, len(words), len(grams), i, int(g)) for i, g in enumerate(grams.view(np.int64))]
    rows.append((None, None, None, None, None, 0, NONE))
    return spark.createDataFrame(rows, "template int, label string, base boolean, t_words int, t_grams int, t_pos int, gram long")


def rolling_grams(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words, pos, gram: the hash of every rolling word k-gram of every text, and the gram NONE at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in chunks(offsets):
                n, row, grams = _grams(data, offsets[i : j + 1])
                cut = np.searchsorted(row, np.arange(j - i + 1))
                grams, cut = np.insert(grams, cut[:-1], NONE), (cut + np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(grams.view(np.int64)))], ["row_id", "doc_id", "n_words", "grams"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row_id long, doc_id long, n_words long, grams array<long>").select("row_id", "doc_id", "n_words", F.posexplode("grams").alias("pos", "gram")).withColumn("pos", F.col("pos").cast("long") - 1)


KEYS = ["row_id", "doc_id", "n_words", "template", "label", "base", "t_words", "t_grams"]


def _longs() -> int:
    return -(-max(len(w) for _, _, w in templates()) // BITS)


def diagonals(grams: DataFrame) -> DataFrame:
    """A row per text, template and offset diagonal with votes: the template positions found, as bits of the longs v0, v1, ...

    All k-grams are joined; the templates are broadcast: their number is fixed in this module.
    """
    voted = grams.join(F.broadcast(template_grams(grams.sparkSession)), "gram")
    votes = [F.bit_or(F.when(F.floor(F.col("t_pos") / BITS) == k, F.expr(f"shiftleft(1L, cast(t_pos % {BITS} as int))")).otherwise(F.lit(0).cast("long"))).alias(f"v{k}") for k in range(_longs())]
    return voted.groupBy(*KEYS, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(*votes, F.min("pos").alias("low"), F.max("pos").alias("high"))


def _cover(names: list[Column]) -> Column:
    total = F.lit(0)
    for c in names:
        total = total + F.bit_count(c)
    return total / F.col("t_grams")


def passages(found: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words, template, label, base, start, stop, cover: the verified passages among diagonals.

    A base phrase stands where all its k-grams are on one diagonal. Around each diagonal of a notice, the
    neighbours up to 1 / SPREAD of its words away are merged, each position counted once; a passage stands
    there if they hold LEAST_COVER of the notice's k-grams (a notice of SHORT words: all). So matches
    further off neither add to a passage nor take from it. Diagonals are merged in tiles of TILE with
    their neighbours copied in, so a text that repeats a notice any number of times is dealt over tasks.
    """
    longs = [f"v{k}" for k in range(_longs())]
    whole = _cover([F.col(c) for c in longs])
    result = ["row_id", "doc_id", "n_words", "template", "label", "base", "start", "stop", "cover"]
    base = found.where("base").withColumn("cover", whole).where("cover = 1").select("row_id", "doc_id", "n_words", "template", "label", "base", F.col("low").alias("start"), (F.col("high") + K).alias("stop"), "cover")
    reach = F.ceil(F.col("t_words") / SPREAD)
    tiles = F.array_distinct(F.array(*(F.floor(d / TILE) for d in (F.col("diagonal"), F.col("diagonal") - reach, F.col("diagonal") + reach))))
    placed = found.where("not base").withColumn("tile", F.explode(tiles))
    scale = F.floor(F.lit(FRAME) / reach)
    near = Window.partitionBy("row_id", "template", "tile").orderBy(F.col("diagonal") * scale).rangeBetween(-FRAME, FRAME)
    merged = placed.select("*", *(F.bit_or(c).over(near).alias(f"m{c}") for c in longs), F.min("low").over(near).alias("start"), (F.max("high").over(near) + K).alias("stop"))
    notices = merged.where(F.floor(F.col("diagonal") / TILE) == F.col("tile")).withColumn("cover", _cover([F.col(f"m{c}") for c in longs]))
    verified = saved(notices.where(F.col("cover") >= F.when(F.col("t_words") <= SHORT, 1.0).otherwise(LEAST_COVER)).select("t_words", *result))
    return base.unionByName(best(verified).select(*result))


def best(notices: DataFrame) -> DataFrame:
    """`notices` without those that another license explains better: a passage of another label that takes more than half of its words and has a higher cover, or the same of a longer template.

    Such a passage has the middle word, so passages meet in the tiles of TILE words that they stand in.
    """
    middle = F.floor((F.col("start") + F.col("stop")) / 2)
    others = notices.groupBy("row_id", "label", "start", "stop").agg(F.max(F.struct("cover", "t_words")).alias("m")).select("row_id", F.col("label").alias("o_label"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("m.cover").alias("o_cover"), F.col("m.t_words").alias("o_words"))
    placed = others.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("o_start") / TILE), F.floor((F.col("o_stop") - 1) / TILE))))
    shared = F.least("stop", "o_stop") - F.greatest("start", "o_start")
    better = (F.col("o_label") != F.col("label")) & (2 * shared > F.col("stop") - F.col("start")) & ((F.col("o_cover") > F.col("cover")) | ((F.col("o_cover") == F.col("cover")) & (F.col("o_words") > F.col("t_words"))))
    mine, theirs = notices.withColumn("_tile", F.floor(middle / TILE)), placed
    return mine.join(theirs, (mine["row_id"] == theirs["row_id"]) & (mine["_tile"] == theirs["_tile"]) & better, "left_anti").drop("_tile")


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII characters; null is
    empty. score is the best passage's share of its notice, 1 for a base phrase, 0 without any.
    Repeated rows and null doc_ids give a row each; an empty table gives none; other columns are ignored.
    """
    grams = rolling_grams(docs)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    at = F.when(F.col("base"), F.col("start"))
    found = saved(diagonals(grams))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("template", "int"), ("label", "string"), ("base", "boolean"), ("start", "long"), ("stop", "long"), ("cover", "double"))]
    rows = passages(found).unionByName(found.where("template is null").select("row_id", "doc_id", "n_words", *blank))
    return (
        rows.groupBy("row_id", "doc_id", "n_words")
        .agg(
            F.count(at).alias("n_base"),
            F.min(at).alias("first_word"),
            F.max(at).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("row_id")
    )
