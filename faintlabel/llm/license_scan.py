"""Licence recognition by sentences: known sentences become identifiers, ordered rules match sequences of identifiers.

Everything is one projection per document: no shuffle, no Python, any length of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences (lower case, runs of other characters than a-z and 0-9 as one space) of public licences.
SENTENCES = {
    "ApacheShort": "licensed under the apache license version 2 0",
    "ApacheGrant": "licensed under the apache license version 2 0 the license",
    "ApacheUse": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at",
    "ApacheBasis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitShort": "released under the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "Gpl3Short": "this work is licensed under the gnu general public license version 3",
    "GplFree": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplDetails": "see the gnu general public license for more details",
    "CcByNc4": "licensed under cc by nc 4 0",
    "CcBy4": "licensed under cc by 4 0",
    "CcBySa4": "licensed under cc by sa 4 0",
    "Bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdNamesHolder": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdNamesOwner": "neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdNamesUniversity": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "IscAsIs": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "Gpl2Free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "Lgpl21Free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "Lgpl3Free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LgplHope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "LgplDetails": "see the gnu lesser general public license for more details",
    "Agpl3Free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AgplDetails": "see the gnu affero general public license for more details",
    "Mpl2Subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "Mpl2Copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "Epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "Cc0": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "BoostGrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "ZlibAsIs": "this software is provided as is without any express or implied warranty",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
#: Identifiers that a tag line may name.
TAGS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT "
    "MPL-2.0 Unlicense Zlib"
).split()
SENTENCES |= {f"Tag:{t}": f"spdx license identifier {t.lower().replace('-', ' ').replace('.', ' ')}" for t in TAGS}
#: Licence rules in the order in which they are tried, the longer ones of a family first; a matched sequence is used up.
RULES = [
    ("BSD-3-Clause", ["Bsd", "BsdSource", "BsdBinary", "BsdNamesHolder"]),
    ("BSD-3-Clause", ["Bsd", "BsdSource", "BsdBinary", "BsdNamesOwner"]),
    ("BSD-3-Clause", ["Bsd", "BsdSource", "BsdBinary", "BsdNamesUniversity"]),
    ("GPL-2.0-or-later", ["Gpl2Free", "GplHope", "GplDetails"]),
    ("LGPL-2.1-or-later", ["Lgpl21Free", "LgplHope", "LgplDetails"]),
    ("LGPL-3.0-or-later", ["Lgpl3Free", "LgplHope", "LgplDetails"]),
    ("AGPL-3.0-or-later", ["Agpl3Free", "GplHope", "AgplDetails"]),
    ("MPL-2.0", ["Mpl2Subject", "Mpl2Copy"]),
    ("ISC", ["IscGrant", "IscAsIs"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("GPL-3.0-or-later", ["GplFree", "GplHope", "GplDetails"]),
    ("BSD-2-Clause", ["Bsd", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["ApacheShort"]),
    ("Apache-2.0", ["ApacheGrant"]),
    ("MIT", ["MitShort"]),
    ("GPL-3.0-only", ["Gpl3Short"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("MPL-2.0", ["Mpl2Subject"]),
    ("EPL-2.0", ["Epl2"]),
    ("CC0-1.0", ["Cc0"]),
    ("Unlicense", ["Unlicense"]),
    ("BSL-1.0", ["BoostGrant"]),
    *((t, [f"Tag:{t}"]) for t in TAGS),
]
#: Fragments end at a line's end, or at one of .!?;: before a blank; a known sentence is one or several fragments in a row.
BREAKS = r"\n|[.!?;:][ \t\r\n]"
#: What may stand before a line's first word besides signs: a list mark such as "1)" or "(b)", or a word that opens a comment.
MARKS = r"(?md)^[^a-z0-9\n]*(?:(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})\)|rem|dnl)[ \t]"
#: Each known sentence has one of these; a text without them needs no look-up.
KEYWORDS = "licens|permission|copyright|warrant|redistribut|unencumbered|of the mpl"


def fragments(text: Column) -> Column:
    """The text's words, lower case, with one blank between two and a newline before, between and after the fragments."""
    broken = F.regexp_replace(F.regexp_replace(F.lower(text), MARKS, ""), BREAKS, "\n")
    words = F.regexp_replace(F.regexp_replace(broken, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    return F.concat(F.lit("\n"), F.btrim(words, F.lit(" \n")), F.lit("\n"))


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order; of two that begin at one place the longer.

    A sentence may be wrapped or broken anywhere between two words, but begins and ends with a fragment.
    """
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, name)])
    longest_first = sorted(SENTENCES.values(), key=len, reverse=True)
    pattern = r"\n(" + "|".join(words.replace(" ", r"[ \n]") for words in longest_first) + r")(?=\n)"
    found = F.regexp_extract_all(fragments(text), F.lit(pattern), F.lit(1))
    found = F.when(F.lower(text).rlike(KEYWORDS), found).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda s: known[F.translate(s, "\n", " ")])


def scan(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, sentences (identifiers joined by commas), licenses (those whose rules match, in the order of the rules,
    each once) and unmatched (how many identifiers no rule has used).

    Null and empty texts have no sentences and no licences; repeated rows are scanned each.
    """
    found = docs.select(*keys, identifiers(F.coalesce("text", F.lit(""))).alias("_ids"))
    # every identifier stands between two commas of its own, so that neighbours don't share one
    left = F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(","))
    found = found.withColumn("sentences", F.array_join("_ids", ",")).withColumn("_left", F.when(F.size("_ids") > 0, left).otherwise(F.lit("")))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(sequence) + ",").alias("wanted")) for name, sequence in RULES])
    none = F.array().cast("array<string>")

    def tried(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["wanted"])
        names = F.when(hit, F.array(rule["name"])).otherwise(none)
        return F.struct(F.replace(state["left"], rule["wanted"], F.lit("|")).alias("left"), F.concat(state["hits"], names).alias("hits"))

    start = F.struct(F.col("_left").alias("left"), none.alias("hits"))
    found = found.withColumn("_end", F.when(F.col("_left") != "", F.aggregate(rules, start, tried)).otherwise(start))
    licences = F.array_join(F.array_distinct("_end.hits"), ",")
    unmatched = F.size(F.filter(F.split("_end.left", "[,|]+"), lambda x: x != "")).cast("long")
    return found.select(*keys, "sentences", licences.alias("licenses"), unmatched.alias("unmatched"))
