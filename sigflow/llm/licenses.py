"""Licence scans by diagonal voting, DataFrame functions only.

Every text's rolling word ``K``-gram hashes are joined with the hashes at all
template positions. A hit votes for the diagonal (text position - template
position). A template copied without change has all its hits on one diagonal;
an inserted or dropped word moves the rest of the hits to a neighbouring one.
Votes are added up by diagonal as sets of template places, and the diagonals
from one to ``slack`` words on are merged into a band; no band is wider. The
slack is ``SLACK`` words, or a quarter of a short template's grams.

A band is verified place by place: of each place the first hit in the band
counts, if it stands later in the text than the hits of all places before it.
A band is good if at least ``LEAST_SHARE`` of the template's places count, so
neither repeated nor disordered grams make a template. Good bands that start
within the slack of the last one are one span. Base phrases are templates
without slack all of whose grams must count: the phrase stands there word by
word.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigflow.llm.common import lower_ascii, text_of

K = 2                        # words in a gram
SLACK = 4                    # width of a band of diagonals at most, in words
LEAST_SHARE = 0.6            # of a template's places that must count
MASK = 62                    # template places in one mask

# fixed values: phrases and labels that must match
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: public licence texts and notices, with their labels
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                "associated documentation files",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                "associated documentation files the software to deal in the software without restriction including "
                "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                "the following conditions the above copyright notice and this permission notice shall be included in "
                "all copies or substantial portions of the software the software is provided as is without warranty "
                "of any kind express or implied including but not limited to the warranties of merchantability "
                "fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
                "holders be liable for any claim damages or other liability whether in an action of contract tort or "
                "otherwise arising from out of or in connection with the software or the use or other dealings in the "
                "software",
    "isc-full": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                "hereby granted provided that the above copyright notice and this permission notice appear in all "
                "copies the software is provided as is and the author disclaims all warranties with regard to this "
                "software including all implied warranties of merchantability and fitness in no event shall the "
                "author be liable for any special direct indirect or consequential damages or any damages whatsoever "
                "resulting from loss of use data or profits whether in an action of contract negligence or other "
                "tortious action arising out of or in connection with the use or performance of this software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided "
                "that the following conditions are met",
    "bsd-full": "redistribution and use in source and binary forms with or without modification are permitted provided "
                "that the following conditions are met redistributions of source code must retain the above copyright "
                "notice this list of conditions and the following disclaimer redistributions in binary form must "
                "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                "documentation and or other materials provided with the distribution this software is provided by the "
                "copyright holders and contributors as is and any express or implied warranties including but not "
                "limited to the implied warranties of merchantability and fitness for a particular purpose are "
                "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
                "incidental special exemplary or consequential damages including but not limited to procurement of "
                "substitute goods or services loss of use data or profits or business interruption however caused and "
                "on any theory of liability whether in contract strict liability or tort including negligence or "
                "otherwise arising in any way out of the use of this software even if advised of the possibility of "
                "such damage",
    "zlib-full": "this software is provided as is without any express or implied warranty in no event will the authors "
                 "be held liable for any damages arising from the use of this software permission is granted to anyone "
                 "to use this software for any purpose including commercial applications and to alter it and "
                 "redistribute it freely subject to the following restrictions the origin of this software must not be "
                 "misrepresented you must not claim that you wrote the original software if you use this software in a "
                 "product an acknowledgment in the product documentation would be appreciated but is not required "
                 "altered source versions must be plainly marked as such and must not be misrepresented as being the "
                 "original software this notice may not be removed or altered from any source distribution",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in "
                     "compliance with the license you may obtain a copy of the license at http www apache org licenses "
                     "license 2 0 unless required by applicable law or agreed to in writing software distributed under "
                     "the license is distributed on an as is basis without warranties or conditions of any kind either "
                     "express or implied see the license for the specific language governing permissions and "
                     "limitations under the license",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation either version 3 of the license "
                  "or at your option any later version this program is distributed in the hope that it will be useful "
                  "but without any warranty without even the implied warranty of merchantability or fitness for a "
                  "particular purpose see the gnu general public license for more details you should have received a "
                  "copy of the gnu general public license along with this program",
    "mpl-text": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "apache-line": "licensed under the apache license version 2 0",
    "gpl-line": "licensed under the gnu general public license version 3",
    "mit-line": "released under the mit license",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "reserved": "all rights reserved",
}


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased text."""
    return F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def grams(w: Column) -> Column:
    """Hashes of all rolling grams of an array of words."""
    return F.when(F.size(w) >= K, F.transform(
        F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))) \
        .otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(label, place, gram, size, slack) of all template positions: as many rows
    as the templates, which are a parameter, have words."""
    rows = spark.createDataFrame([(k, v.split(" ")) for k, v in templates.items()], "label string, w array<string>")
    if any(len(v.split(" ")) < K for v in templates.values()):
        raise ValueError(f"templates need at least {K} words")
    return (rows.withColumn("grams", grams(F.col("w")))
            .select("label", F.posexplode("grams").alias("place", "gram"), F.size("grams").alias("size"), slack(F.size("grams"))))


def slack(size: Column) -> Column:
    """The width of a template's bands; a base phrase has none."""
    return F.when(F.col("label").startswith("text:"), F.least(F.lit(SLACK), F.floor(size / 4))).otherwise(0).cast("int").alias("slack")


def counted(band: str, start: str, size: str, width: str) -> Column:
    """How many places of a template count in a band, an array of (diagonal,
    masks): of each place the first hit, if it stands after all before."""
    first = (f"array_min(transform(filter({band}, x -> x.diagonal - {start} <= {width} AND "
             f"shiftright(x.masks[CAST(floor(q / {MASK}) AS INT)], pmod(q, {MASK})) & 1 = 1), x -> x.diagonal))")
    return F.expr(f"""aggregate(transform(sequence(0, {size} - 1), q -> q + {first}),
        named_struct('top', CAST(-2147483648 AS BIGINT), 'n', 0),
        (acc, at) -> if(at > acc.top, named_struct('top', CAST(at AS BIGINT), 'n', acc.n + 1), acc), acc -> acc.n)""")


def scan_licenses(df: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base (places of base
    phrases), first_word and last_word (their smallest and largest start, else
    NULL), base_labels, labels (base and template labels; distinct, sorted,
    comma-joined, else empty), score (the largest verified share, 1 with a base
    phrase, 0 with nothing) and n_spans (verified template spans). Words are
    compared through 64-bit hashes of their grams.

    A NULL or empty text has no word. Repeated rows, also with a NULL id, give
    a row each. Other columns are not read; an empty table gives an empty
    result. Hits are spread over tasks by row and diagonal and added up before
    the shuffle, so a very long or very repetitive text makes no large group."""
    spark = df.sparkSession
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    base = template_grams(spark, {f"base:{v}:{k}": k for k, v in phrases.items()})
    places = base.unionByName(template_grams(spark, {f"text:{k}": v for k, v in templates.items()}))
    rows = (df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
            .select("doc_id", F.monotonically_increasing_id().alias("row"), words(lower_ascii(F.col("text"))).alias("w"))
            .select("doc_id", "row", F.size("w").cast("long").alias("n_words"), grams(F.col("w")).alias("grams")))
    # every row also emits one entry that no template has, so that all rows stay
    own = spark.createDataFrame([("", -1, None, 0, 0)], places.schema)
    table = F.broadcast(places.unionByName(own))               # the templates: a parameter
    hits = (rows.select("doc_id", "row", "n_words", F.posexplode(F.concat(
                F.array(F.lit(None).cast("long")), "grams")).alias("at", "gram"))
            .withColumn("own", F.col("at") == 0)
            .join(table.withColumnsRenamed({"gram": "held"}), F.col("gram").eqNullSafe(F.col("held")))
            .withColumn("diagonal", F.when(F.col("own"), F.lit(0)).otherwise(F.col("at") - 1 - F.col("place"))))
    # the distinct places as bit masks, whose number is that of the longest template's words by MASK
    longest = max(len(t.split(" ")) for t in [*phrases.keys(), *templates.values()])
    masks = [f"mask{j}" for j in range(-(-longest // MASK))]
    bit = F.expr(f"shiftleft(1L, pmod(place, {MASK}))")
    votes = hits.groupBy("row", "label", "diagonal", "size", "slack").agg(
        *[F.bit_or(F.when(F.floor(F.col("place") / MASK) == j, bit).otherwise(F.lit(0).cast("long"))).alias(m)
          for j, m in enumerate(masks)],
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    votes = (votes.withColumn("n", reduce(add, [F.bit_count(m) for m in masks]))
             .withColumn("cell", F.struct("diagonal", F.array(*masks).alias("masks"))).drop(*masks))
    # a band: the diagonals from one to SLACK words on; few have votes enough to be looked at place by place
    order = Window.partitionBy("row", "label").orderBy("diagonal")
    ahead = order.rangeBetween(0, SLACK)
    enough = F.when(F.col("label").startswith("base:"), F.col("n") == F.col("size")) \
        .otherwise((F.col("size") > 0) & (F.sum("n").over(ahead) >= LEAST_SHARE * F.col("size")))
    bands = (votes.withColumn("enough", enough).withColumn("band", F.collect_list("cell").over(ahead))
             .withColumn("share", F.when(F.col("enough"), counted("band", "diagonal", "size", "slack") / F.col("size"))
                         .otherwise(F.lit(0.0))).drop("band", "cell"))
    is_text = F.col("label").startswith("text:")
    fine = F.when(F.col("label").startswith("base:"), F.col("share") == 1).otherwise(is_text & (F.col("share") >= LEAST_SHARE))
    # good bands that start within the slack of the last good one belong to its span
    last = F.max(F.when(F.col("good"), F.col("diagonal"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (bands.withColumn("good", fine)
             .withColumn("new", F.col("good") & F.coalesce(F.col("diagonal") - last > F.col("slack"), F.lit(True)))
             .withColumnRenamed("diagonal", "from"))
    is_base = F.col("label").startswith("base:")
    good = F.col("good")
    name = F.when(is_base, F.split_part("label", F.lit(":"), F.lit(2))).otherwise(F.substring("label", 6, 1 << 30))
    at = F.when(good & is_base, F.col("from")).cast("long")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, name))), ",")
    return (spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.count(at).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"),
        labels(good & is_base).alias("base_labels"), labels(good).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("new") & is_text, 1)).alias("n_spans")).drop("row"))
