"""Licence recognition by sentence rules, in DataFrame functions alone.

A text is cut into sentences twice: at line ends and sentence ends, and at sentence ends and
blank lines only (for licence texts that are wrapped). Comment marks at the start of a line are
left out, and a copyright statement's line is cut from its neighbours. Sentences are lower-cased,
version numbers become ``#`` and what else isn't a letter becomes a space. Known sentences
are mapped to identifiers; a rule names a licence by identifiers in order, which must occur
in that order, others between them allowed. Everything stays in the row: no shuffle, no
Python; the tables of sentences and rules are fixed values in the plan.

Defined results: null or empty text has no sentences and no licence; repeated sentences
count each in ``sentence_ids`` and once in ``licenses``; repeated rows give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import unused

# Known sentences in normalised form, and the ordered rules over their identifiers.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "licensed under the apache license version #",
    "apache-notice-long": "licensed under the apache license version # the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-notice": "this work is licensed under the gnu general public license version #",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version",
    "lgpl-notice": "this work is licensed under the gnu lesser general public license version #",
    "agpl-notice": "this work is licensed under the gnu affero general public license version #",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v #",
    "mit-notice-short": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "bsd-notice-short": "released under the bsd license",
    "cc-by": "licensed under cc by #",
    "cc-by-sa": "licensed under cc by sa #",
    "cc-by-nc": "licensed under cc by nc #",
    "cc-by-nd": "licensed under cc by nd #",
    "cc-by-nc-sa": "licensed under cc by nc sa #",
    "cc-by-nc-nd": "licensed under cc by nc nd #",
    "cc0": "this work is dedicated to the public domain under cc0 #",
    "all-rights": "all rights reserved",
}
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-notice-short"]),
    ("MIT", ["mit-notice-licensed"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-notice-short"]),
    ("ISC", ["isc-grant"]),
    ("Apache", ["apache-notice"]),
    ("Apache", ["apache-notice-long", "apache-compliance", "apache-copy"]),
    ("GPL", ["gpl-notice"]),
    ("GPL", ["gpl-program"]),
    ("LGPL", ["lgpl-notice"]),
    ("AGPL", ["agpl-notice"]),
    ("MPL", ["mpl-notice"]),
    ("CC-BY", ["cc-by"]),
    ("CC-BY-SA", ["cc-by-sa"]),
    ("CC-BY-NC", ["cc-by-nc"]),
    ("CC-BY-ND", ["cc-by-nd"]),
    ("CC-BY-NC-SA", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND", ["cc-by-nc-nd"]),
    ("CC0", ["cc0"]),
    ("Proprietary", ["all-rights"]),
]
CUES = "licen[sc]e|permission|redistribution|rights reserved|public domain|without warranty|in no event shall|you may obtain a copy|neither the name"
# Sentences and rules of real notices; the SQL form doesn't have them. Notices are cut where they
# have ';', ':' or 'v. '.
_FSF = "you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation"
_GNU = {"gpl": ["general public license"], "lgpl": ["lesser general public license", "library general public license"], "agpl": ["affero general public license"]}
_EITHER = " either version # of the license or at your option any later version"
_EPL = "this program and the accompanying materials are made available under the terms of the eclipse public license "
MORE_SENTENCES = {
    **{_FSF.format(f"{n}{v}") + e: f"{k}-redistribute" for k, names in _GNU.items() for n in names for v in ("", " version #") for e in ("", _EITHER)},
    "the asf licenses this file to you under the apache license version # the license": "apache-asf",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-notice-v",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version #": "boost-notice",
    "use modification and distribution are subject to the boost software license version #": "boost-use",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    **{_EPL + x: "epl-notice" for x in ("v", "v#", "version #", "#", "v# which accompanies this distribution and is available at", *(f"v# which accompanies this distribution and is available at {h} www eclipse org legal epl v# html" for h in ("http", "https")), "# which is available at", "# which is available at https www eclipse org legal epl #")},
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
}
MORE_RULES = [
    ("GPL", ["gpl-redistribute"]),
    ("LGPL", ["lgpl-redistribute"]),
    ("AGPL", ["agpl-redistribute"]),
    ("Apache", ["apache-asf"]),
    ("MPL", ["mpl-notice-v"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL", ["boost-notice"]),
    ("BSL", ["boost-use"]),
    ("BSL", ["boost-grant"]),
    ("EPL", ["epl-notice"]),
]
CUES = "licen[sc]e|permission|redistribution|rights reserved|public domain|without warranty|in no event shall|you may obtain a copy|neither the name"
BY_LINE = r"[.;:!?][ \t]+|[.;:!?]?[\r\n]+"
BY_SENTENCE = r"[.;:!?][ \t\r\n]+|[\r\n][ \t]*[\r\n]+"

MORE_CUES = CUES + "|free software foundation|express or implied warranties"
MARKS = r"(?m)^[ \t]*(?://+|/?\*+/?|#+|--+|;+|%+|>+|!+|<!--|\"{3}|(?:REM|dnl)\b)[ \t]*"
STATEMENT = r"(?im)^([ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|the [^\r\n]*authors)|\(c\)[ \t]+[^\r\n]*[0-9]{4}|©)[^\r\n]*)"


def uncommented(text: Column) -> Column:
    """Without comment marks; copyright statements stand between blank lines."""
    return F.regexp_replace(F.regexp_replace(text, MARKS, ""), STATEMENT, "\n$1\n")


def normalised(sentence: Column) -> Column:
    versions = F.regexp_replace(F.translate(F.lower(sentence), "#", " "), r"[0-9]+([.][0-9]+)*", "#")
    return F.trim(F.regexp_replace(versions, "[^a-z#]+", " "))


def known_ids(text: Column, separator: str, known: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    maybe = F.filter(F.split(text, separator), lambda s: F.lower(s).rlike(MORE_CUES))
    return F.filter(F.transform(maybe, lambda s: F.try_element_at(known, normalised(s))), lambda i: i.isNotNull())


def matched(ids: Column) -> Column:
    """Licences whose rule's identifiers occur in order."""
    joined = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    return F.array(*[F.when(joined.rlike("," + ",(.*,)?".join(rule) + ","), F.lit(name)) for name, rule in RULES + MORE_RULES])


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (array) and ``licenses`` (sorted array) added; columns of
    those names are replaced."""
    sentences = {s.replace("cc0", "cc#"): k for k, s in SENTENCES.items()} | MORE_SENTENCES
    known = F.create_map(*[F.lit(x) for s, k in sentences.items() for x in (s, k)])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    cue = F.lower(text).rlike(MORE_CUES)
    none = F.array().cast("array<string>")
    by_line, by_sentence = (F.when(cue, known_ids(uncommented(text), s, known)).otherwise(none) for s in (BY_LINE, BY_SENTENCE))
    lines, sentences = unused(docs, "_by_line"), unused(docs, "_by_sentence")
    out = docs.withColumn(lines, by_line).withColumn(sentences, by_sentence)
    some = (F.size(lines) > 0) | (F.size(sentences) > 0)
    names = F.when(some, F.array_sort(F.array_distinct(F.filter(F.concat(matched(F.col(lines)), matched(F.col(sentences))), lambda x: x.isNotNull())))).otherwise(none)
    longer = F.when(F.size(sentences) > F.size(lines), F.col(sentences)).otherwise(F.col(lines))
    return out.withColumn("licenses", names).withColumn("sentence_ids", longer).drop(lines, sentences)
