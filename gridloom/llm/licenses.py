"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences, each is normalised and mapped to the identifier
of a known licence sentence, and the sequence of identifiers is matched against
ordered licence rules: a rule that matches replaces its identifiers by the
licence, so that longer rules, which come first, win over shorter ones.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences in their normalised form (a-z, 0-9, single spaces).
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "licensed under the apache license version 2 0": "apache2-under",
    "licensed under the apache license version 2 0 the license": "apache2-under",
    "this file is licensed under the apache license version 2 0": "apache2-under",
    "this project is licensed under the apache license version 2 0": "apache2-under",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-notice",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-under",
    "licensed under the mit license": "mit-under",
    "this project is licensed under the mit license": "mit-under",
    "this work is licensed under the gnu general public license version 3": "gpl3-under",
    "licensed under the gnu general public license version 3": "gpl3-under",
    "this work is licensed under the gnu general public license version 2": "gpl2-under",
    "licensed under the gnu general public license version 2": "gpl2-under",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-redistribute",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-redistribute",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-redistribute",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-redistribute",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-redistribute",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "see the gnu lesser general public license for more details": "gpl-see",
    "see the gnu affero general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "you should have received a copy of the gnu lesser general public license along with this library": "gpl-received",
    "you should have received a copy of the gnu affero general public license along with this program": "gpl-received",
    "if not see https www gnu org licenses": "gpl-address",
    "if not see http www gnu org licenses": "gpl-address",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-obtain",
    "licensed under the mozilla public license version 2 0": "mpl2-under",
    "licensed under cc by 4 0": "ccby4-under",
    "licensed under cc by sa 4 0": "ccbysa4-under",
    "licensed under cc by nc 4 0": "ccbync4-under",
    "licensed under cc by nc sa 4 0": "ccbyncsa4-under",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-under",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-under",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-under",
    "this is free and unencumbered software released into the public domain": "unlicense-release",
    "all rights reserved": "all-rights",
}

#: Identifiers of the SPDX list that a tag line may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {"spdx license identifier " + " ".join(re.findall("[a-z0-9]+", x.lower())): f"{x}-spdx" for x in SPDX}

#: How the notices of one family of licences begin, and how they may go on, longest first.
NOTICE_HEADS = (
    ("GPL-3.0-or-later", "gpl3-redistribute"),
    ("GPL-2.0-or-later", "gpl2-redistribute"),
    ("LGPL-2.1-or-later", "lgpl21-redistribute"),
    ("LGPL-3.0-or-later", "lgpl3-redistribute"),
    ("AGPL-3.0-or-later", "agpl3-redistribute"),
)
NOTICE_TAILS = (
    ("gpl-warranty", "gpl-see", "gpl-received", "gpl-address"),
    ("gpl-warranty", "gpl-see", "gpl-received"),
    ("gpl-warranty", "gpl-see"),
    (),
)

#: Licence rules in the order in which they are tried.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-notice", "apache2-copy", "apache2-warranty", "apache2-see")),
    ("Apache-2.0", ("apache2-under", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see")),
    ("Apache-2.0", ("apache2-notice", "apache2-copy")),
    ("Apache-2.0", ("apache2-under", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-under", "apache2-comply")),
    *((name, (head, *tail)) for tail in NOTICE_TAILS for name, head in NOTICE_HEADS),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-under",)),
    ("MIT", ("mit-under",)),
    ("GPL-3.0-only", ("gpl3-under",)),
    ("GPL-2.0-only", ("gpl2-under",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-obtain")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("MPL-2.0", ("mpl2-under",)),
    ("CC-BY-4.0", ("ccby4-under",)),
    ("CC-BY-SA-4.0", ("ccbysa4-under",)),
    ("CC-BY-NC-4.0", ("ccbync4-under",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-under",)),
    ("Unlicense", ("unlicense-release",)),
    ("Proprietary", ("all-rights",)),
    *((x, (f"{x}-spdx",)) for x in SPDX),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line break, with the comment mark of the line behind it.
GAP = r"[ \t\r]*\n[ \t\r]*(?:[#*;%>|]+|//+|--+)?[ \t\r]*"
#: A line was wrapped if it ends in a word that needs another, if the next goes on in lower case, or if both are in capitals.
OPEN = r"(^|[^A-Za-z0-9])(a|an|and|any|as|be|by|for|from|in|is|of|on|or|such|that|the|this|to|under|version|with|Affero|Apache|Creative|Free|General|GNU|Lesser|Mozilla|Public)" + GAP + r"([A-Za-z0-9(\"])"
WRAPPED = r"([A-Za-z0-9,;)\"'])" + GAP + "([a-z(])"
CAPITALS = r"([A-Z,;\"])" + GAP + "([A-Z][A-Z])"
#: Then sentences end at a line, or at a mark and a blank before a letter (so not within ``v. 2.0``, and not at ``:`` and ``;``).
ENDED, MARKED = r"([.!?][\"')]*)[ \t\r]+([A-Za-z(\"'])", r"[^a-z0-9]+"
#: A tag is a line of its own.
TAG = r"((?i:SPDX-License-Identifier)[ \t]*:[^\n]*)\n"
STEPS = ((TAG, "{1}\n\n"), (OPEN, "{1}{2} {3}"), (WRAPPED, "{1} {2}"), (CAPITALS, "{1} {2}"), (ENDED, "{1}\n{2}"))


def hint_words(sentences: dict[str, str] = SENTENCES) -> list[str]:
    """Words of which every known sentence has one, so that a text without any has no match.

    A word of a normalised sentence stands in the text as it is, but for case,
    whatever stands between the words.
    """
    open_ = {s: {w for w in s.split(" ") if len(w) > 4} or set(s.split(" ")) for s in sentences}
    chosen = []
    while open_:
        times: dict[str, int] = {}
        for words in open_.values():
            for w in words:
                times[w] = times.get(w, 0) + 1
        best = max(times, key=lambda w: (times[w], len(w), w))
        chosen.append(best)
        open_ = {s: words for s, words in open_.items() if best not in words}
    return sorted(chosen)


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order, unknown ones left out."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(sentences.items()))])
    cut = text
    for pattern, form in STEPS:
        cut = F.regexp_replace(cut, pattern, form.format("", "$1", "$2", "$3"))
    cleaned = F.transform(F.split(cut, "\n"), lambda x: F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), MARKED, " ")))
    return F.filter(F.transform(cleaned, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple = RULES, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses, n_unmatched`` per input row.

    ``sentence_ids`` and ``licenses`` (distinct, sorted) are comma-joined;
    ``n_unmatched`` counts known sentences that no rule used.  Null and empty
    texts have none.  Whole texts, one pass, no shuffle; repeated rows stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ids = F.when(body.rlike("(?i)" + "|".join(hint_words(sentences))), sentence_ids(body, sentences)).otherwise(F.array().cast("array<string>"))
    found = docs.select(F.col(key).alias("doc_id"), ids.alias("ids"))
    seq = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("["), x, F.lit("]"))))
    for name, parts in rules:
        seq = F.replace(seq, F.lit("".join(f"[{p}]" for p in parts)), F.lit(f"<{name}>"))
    return found.withColumn("seq", F.when(F.size("ids") > 0, seq).otherwise("")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("seq", F.lit("<([^>]+)>"), F.lit(1)))), ",").alias("licenses"),
        F.regexp_count("seq", F.lit(r"\[")).cast("long").alias("n_unmatched"),
    )


def oracle(rules: tuple = RULES, sentences: dict[str, str] = SENTENCES) -> str:
    """DuckDB SQL for :func:`scan` over ``documents``."""
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(sentences.items())) + "}"
    seq = "list_aggregate(list_transform(ids, lambda x: '[' || x || ']'), 'string_agg', '')"
    for name, parts in rules:
        seq = f"replace({seq}, '{''.join(f'[{p}]' for p in parts)}', '<{name}>')"
    cut = "coalesce(text, '')"
    for pattern, form in STEPS:
        quoted, into = pattern.replace("'", "''"), form.format("", r"\1", r"\2", r"\3").replace("\n", "' || chr(10) || '")
        cut = f"regexp_replace({cut}, '{quoted}', '{into}', 'g')"
    return rf"""
WITH lines AS (
  SELECT doc_id, string_split({cut}, chr(10)) AS ls
  FROM documents
), norm AS (
  SELECT doc_id, list_transform(ls, lambda x: trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '{MARKED}', ' ', 'g'))) AS ns FROM lines
), mapped AS (
  SELECT doc_id, list_filter(list_transform(ns, lambda x: {known}[x]), lambda x: x IS NOT NULL) AS ids FROM norm
), seqs AS (
  SELECT doc_id, ids, coalesce({seq}, '') AS seq FROM mapped
)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids,
       coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(seq, '<([^>]+)>', 1))), 'string_agg', ','), '') AS licenses,
       (length(seq) - length(replace(seq, '[', '')))::BIGINT AS n_unmatched
FROM seqs
"""
