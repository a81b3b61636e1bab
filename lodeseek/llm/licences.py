"""Licence scans by sentence rules.

Texts are normalised and searched for known licence sentences, and the sequence of identifiers of
a document, sentences that are not known left out, is matched against rules in order. A rule that matches
takes its identifiers out of the sequence, so that a later and shorter rule can't use them again.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that licences go by after "under", and sentences of their texts, normalised.
NAMES = {
    "apache license version 2.0": "apache-2.0",
    "apache license 2.0": "apache-2.0",
    "apache 2.0 license": "apache-2.0",
    "apache license version 1.1": "apache-1.1",
    "apache license": "apache",
    "mit license": "mit",
    "mit licence": "mit",
    "expat license": "mit",
    "bsd license": "bsd",
    "bsd 2 clause license": "bsd-2",
    "simplified bsd license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "new bsd license": "bsd-3",
    "modified bsd license": "bsd-3",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license version 1.0": "bsl-1.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 2 or later": "gpl-2+",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 3 or later": "gpl-3+",
    "gpl version 2": "gpl-2",
    "gpl version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2.1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2.0": "mpl-2.0",
    "mozilla public license version 1.1": "mpl-1.1",
    "eclipse public license version 1.0": "epl-1.0",
    "eclipse public license version 2.0": "epl-2.0",
    "creative commons attribution 4.0 international license": "cc-by-4.0",
    "creative commons attribution 3.0 license": "cc-by-3.0",
    "creative commons attribution sharealike 4.0 international license": "cc-by-sa-4.0",
    "creative commons attribution sharealike 3.0 license": "cc-by-sa-3.0",
    "creative commons attribution noncommercial 4.0 international license": "cc-by-nc-4.0",
    "cc by 4.0": "cc-by-4.0",
    "cc by 3.0": "cc-by-3.0",
    "cc by sa 4.0": "cc-by-sa-4.0",
    "cc by sa 3.0": "cc-by-sa-3.0",
    "cc by nc 4.0": "cc-by-nc-4.0",
    "cc by nc 3.0": "cc-by-nc-3.0",
    "cc by nc sa 4.0": "cc-by-nc-sa-4.0",
    "cc by nd 4.0": "cc-by-nd-4.0",
    "cc by nc nd 4.0": "cc-by-nc-nd-4.0",
    "creative commons attribution noderivatives 4.0 international license": "cc-by-nd-4.0",
    "creative commons attribution noncommercial sharealike 4.0 international license": "cc-by-nc-sa-4.0",
    "creative commons attribution noncommercial noderivatives 4.0 international license": "cc-by-nc-nd-4.0",
    "cc0 1.0 license": "cc0",
    "unlicense": "unlicense",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license version 2.1 or later": "lgpl-2.1+",
    "gnu lesser general public license version 3 or later": "lgpl-3+",
    "gnu affero general public license version 3 or later": "agpl-3+",
}
SENTENCES = {
    "all rights reserved": "rights",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "you may not use this file except in compliance with the license": "apache-file",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2+-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3+-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2+-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3+-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl-3-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl-2.1+-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3+-grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3+-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this program": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2.0-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl-2.0-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl v10.html": "epl-1.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at http www.eclipse.org legal epl 2.0": "epl-2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": "epl-2.0",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is dedicated to the public domain": "public-domain",
}
# The licence of each statement's name.
STATED = {
    "apache-2.0": "Apache-2.0", "apache-1.1": "Apache-1.1", "apache": "Apache", "mit": "MIT", "bsd": "BSD", "bsd-2": "BSD-2-Clause",
    "bsd-3": "BSD-3-Clause", "isc": "ISC", "zlib": "Zlib", "bsl-1.0": "BSL-1.0", "gpl": "GPL", "gpl-2": "GPL-2.0-only", "gpl-2+": "GPL-2.0-or-later",
    "gpl-3": "GPL-3.0-only", "gpl-3+": "GPL-3.0-or-later", "lgpl": "LGPL", "lgpl-2.1": "LGPL-2.1-only", "lgpl-3": "LGPL-3.0-only",
    "agpl-3": "AGPL-3.0-only", "mpl-2.0": "MPL-2.0", "mpl-1.1": "MPL-1.1", "epl-1.0": "EPL-1.0", "epl-2.0": "EPL-2.0", "cc-by-4.0": "CC-BY-4.0",
    "cc-by-3.0": "CC-BY-3.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-by-sa-3.0": "CC-BY-SA-3.0", "cc-by-nc-4.0": "CC-BY-NC-4.0",
    "cc-by-nc-3.0": "CC-BY-NC-3.0", "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0", "cc-by-nd-4.0": "CC-BY-ND-4.0", "cc-by-nc-nd-4.0": "CC-BY-NC-ND-4.0",
    "cc0": "CC0-1.0", "unlicense": "Unlicense", "agpl": "AGPL", "lgpl-2.1+": "LGPL-2.1-or-later", "lgpl-3+": "LGPL-3.0-or-later", "agpl-3+": "AGPL-3.0-or-later",
}
#: Rules in order: identifiers that follow one another, and the licence they mean.
RULES: list[tuple[list[str], str]] = [
    (["gpl-2+-grant", "gpl-warranty", "gpl-see", "gpl-copy"], "GPL-2.0-or-later"),
    (["gpl-3+-grant", "gpl-warranty", "gpl-see", "gpl-copy"], "GPL-3.0-or-later"),
    (["lgpl-2.1+-grant", "gpl-warranty", "lgpl-see", "lgpl-copy"], "LGPL-2.1-or-later"),
    (["lgpl-3+-grant", "gpl-warranty", "lgpl-see", "lgpl-copy"], "LGPL-3.0-or-later"),
    (["agpl-3+-grant", "gpl-warranty", "agpl-see", "agpl-copy"], "AGPL-3.0-or-later"),
    (["gpl-2-grant", "gpl-warranty", "gpl-see"], "GPL-2.0-only"),
    (["mpl-2.0-form", "mpl-2.0-copy"], "MPL-2.0"),
    (["isc-grant", "isc-warranty"], "ISC"),
    (["apache-2.0", "apache-file", "apache-copy", "apache-basis", "apache-see"], "Apache-2.0"),
    (["apache-2.0", "apache-file", "apache-copy", "apache-basis"], "Apache-2.0"),
    (["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], "BSD-3-Clause"),
    (["bsd-grant", "bsd-source", "bsd-binary"], "BSD-2-Clause"),
    (["mit-grant", "mit-notice", "mit-warranty"], "MIT"),
    (["mit-grant", "mit-notice"], "MIT"),
    (["isc-grant"], "ISC"),
    (["gpl-2+-grant"], "GPL-2.0-or-later"),
    (["gpl-3+-grant"], "GPL-3.0-or-later"),
    (["gpl-2-grant"], "GPL-2.0-only"),
    (["gpl-3-grant"], "GPL-3.0-only"),
    (["lgpl-2.1+-grant"], "LGPL-2.1-or-later"),
    (["lgpl-3+-grant"], "LGPL-3.0-or-later"),
    (["agpl-3+-grant"], "AGPL-3.0-or-later"),
    (["public-domain"], "Public-Domain"),
    *(([name], licence) for name, licence in STATED.items()),
]
#: Every known sentence and every statement matches this; other texts are not cut into sentences.
_GAP = "[^a-z0-9]+"
TRIGGER = (
    f"(?i)licen[sc]e|permi|copyright|redistribut|warrant|mozilla|rights{_GAP}reserved|public{_GAP}domain"
    f"|under{_GAP}(the{_GAP})?(terms{_GAP}of{_GAP})?(the{_GAP})?(gpl|cc)"
)
_SUBJECT = "^(this|the) (work|file|software|program|project|document|material|code|text|library|content|article|page) (is|was) "
_VERB = "^(licensed|released|distributed|available|published|provided|made available) under (the |a )?(terms of )?(the |a )?"
#: What a line of a comment begins with.
COMMENT = r"(?m)^[ \t]*(?://+|#+|/?\*+|--+|;+|%+|<!--|\.\. )[ \t]*"
#: A tag, and one more name of it; a tag with several names is written as a tag for each of them.
SPDX = r"(SPDX-License-Identifier:[ \t]*)\(?([A-Za-z0-9.+-]+)\)?"
SPDX_MORE = r"(SPDX-License-Identifier:[ \t]*)(\(?[A-Za-z0-9.+-]+)[ \t]+(?:OR|AND)[ \t]+"
SPDX_NAMES = 4


def _plain(name: str) -> str:
    return " ".join(re.findall(r"[a-z0-9.+]+", name.lower()))


def _tags() -> dict[str, str]:
    """Identifiers by the normalised tag of each licence."""
    return {f"spdx license identifier {_plain(licence)}": i for i, licence in STATED.items()} | {
        f"spdx license identifier {old}": i for old, i in (("gpl 2.0", "gpl-2"), ("gpl 2.0+", "gpl-2+"), ("gpl 3.0", "gpl-3"), ("gpl 3.0+", "gpl-3+"), ("lgpl 2.1+", "lgpl-2.1+"), ("agpl 3.0", "agpl-3"))
    }


def _known() -> dict[str, str]:
    """Identifiers by normalised sentence; a statement's sentence begins with its marker."""
    return {f"under {name}": i for name, i in NAMES.items()} | _tags() | SENTENCES


#: Marks in a normalised text: an end that a known sentence may run across, one that it may not; and a defined term after a statement.
_SOFT, _HARD, _TERM = "\u0001", "\u0002", " the licen[sc]e"


def normalised(text: Column) -> Column:
    """A text's words, lowered, with marks at both ends and where a sentence may end.

    A full stop or its like before white space and a blank line end a sentence. A semicolon or colon before white
    space and a line end before a capital or a digit may do so, or stand inside one that is wrapped or has clauses.
    Marks of comments at the beginning of lines go; each name of an SPDX tag is a sentence of its own.
    """
    s = F.regexp_replace(text, COMMENT, "")
    for _ in range(SPDX_NAMES - 1):
        s = F.regexp_replace(s, SPDX_MORE, f"$1$2{_HARD}$1")
    s = F.regexp_replace(s, SPDX, f"{_HARD}$1$2{_HARD}")
    s = F.regexp_replace(s, r"([.!?])[ \t\r\n]+", f"$1{_HARD}")
    s = F.regexp_replace(s, r"\n(?=[ \t\r]*\n)", _HARD)
    s = F.regexp_replace(s, r"[;:][ \t\r\n]+|\n(?=[ \t\r]*[A-Z0-9])", _SOFT)
    s = F.regexp_replace(F.lower(s), f"[^a-z0-9.+{_SOFT}{_HARD}]+", " ")
    s = F.regexp_replace(F.concat(F.lit(_HARD), s, F.lit(_HARD)), rf"\.(?=[ {_SOFT}{_HARD}])", "")
    s = F.regexp_replace(s, f"[ {_SOFT}]*{_HARD}[ {_SOFT}]*", _HARD)
    return F.regexp_replace(s, f" *{_SOFT}[ {_SOFT}]*", _SOFT)


def _pattern() -> str:
    """Any known sentence or statement between two marks, the longest first."""
    either = lambda texts: "|".join(sorted(texts, key=len, reverse=True)).replace(".", r"\.").replace("+", r"\+")
    said = f"({_SUBJECT[1:]})?(({either([*SENTENCES, *_tags()])})|({_VERB[1:]}|under )({either(NAMES)})({_TERM})?)"
    return f"(?<=[{_SOFT}{_HARD}])" + said.replace("(", "(?:").replace(" ", f"[ {_SOFT}]") + f"(?=[{_SOFT}{_HARD}])"


def _stated(s: Column) -> Column:
    """A normalised sentence without its subject and a defined term at its end, and with "under" for its verb."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _SUBJECT, ""), _VERB, "under "), f"{_TERM}$", "")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of each text: id, sentence_ids and licences (arrays, in order of the text and of the rules).

    One row per input row; a null or empty text, or one without known sentences, has empty arrays. A rule
    counts once however often it matches. Ids may be null or repeat; other columns are not read.
    """
    known = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    text = F.col("text")
    # The sentence as it stands comes first: some of the known ones have a subject or a verb of their own.
    name = lambda s: F.coalesce(F.element_at(known, s), F.element_at(known, _stated(s)))
    said = F.regexp_extract_all(normalised(text), F.lit(_pattern()), F.lit(0))
    found = F.filter(F.transform(said, lambda s: name(F.translate(s, _SOFT, " "))), lambda i: i.isNotNull())
    ids = F.when(text.rlike(TRIGGER), found).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).select(F.col(id_col), F.coalesce(ids, F.array().cast("array<string>")).alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit("|" + "||".join(seq) + "|").alias("seq"), F.lit(licence).alias("licence")) for seq, licence in RULES])
    begin = F.struct(
        F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|")).alias("seq"), F.array().cast("array<string>").alias("found")
    )
    step = lambda acc, rule: F.when(
        F.contains(acc["seq"], rule["seq"]),
        F.struct(
            F.replace(acc["seq"], rule["seq"], F.lit("||")).alias("seq"), F.array_union(acc["found"], F.array(rule["licence"])).alias("found")
        ),
    ).otherwise(acc)
    matched = F.aggregate(rules, begin, step, lambda acc: acc["found"])
    none = F.array().cast("array<string>")
    return rows.select(id_col, "sentence_ids", F.when(F.size("sentence_ids") > 0, matched).otherwise(none).alias("licences"))
