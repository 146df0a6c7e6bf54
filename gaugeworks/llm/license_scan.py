"""License scans by sentence-rule recognition, in DataFrame functions alone.

A text is normalised (small letters and digits, one space between runs of
them) with its sentence ends and line ends kept as marks. One pattern made of
the known licence sentences, cut by the same rule, finds them wherever they
stand between marks, on one line or wrapped over several. The identifiers found
in a text, in order, are matched against ordered rules, each a sequence of
identifiers between which other known sentences may stand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Known sentences: identifier, and the sentence as it is written.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-you-may-not", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-licensed", "Licensed under the MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "Licensed under CC BY 4.0"),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0"),
    ("cc0-notice", "Released under CC0 1.0 Universal"),
    ("all-rights", "All rights reserved"),
)

#: Rules in order: name, licence, and the identifiers that are found in this order, with or without others between.
RULES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0-header", "Apache-2.0", "apache-you-may-not apache-copy apache-as-is apache-see"),
    ("mit-text", "MIT", "mit-grant mit-condition"),
    ("gpl-3.0-header", "GPL-3.0-or-later", "gpl-free gpl-hope"),
    ("apache-2.0-notice", "Apache-2.0", "apache-notice"),
    ("mit-notice", "MIT", "mit-notice"),
    ("mit-licensed", "MIT", "mit-licensed"),
    ("gpl-3.0-notice", "GPL-3.0-only", "gpl3-notice"),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", "cc-by-nc-notice"),
    ("cc-by-4.0-notice", "CC-BY-4.0", "cc-by-notice"),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", "cc-by-sa-notice"),
    ("cc0-1.0-notice", "CC0-1.0", "cc0-notice"),
    ("all-rights-reserved", "Proprietary", "all-rights"),
)

#: Sentences and rules of further licences. The last of RULES, which many texts of these licences fit as well, stays last.
MORE_SENTENCES: tuple[tuple[str, str], ...] = (
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl2-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl2-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("epl2-made", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl1-made", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    *((f"{name}-{n}", f"{verb} {text}") for name, text in (("bsd2", "the BSD 2-Clause License"), ("bsd3", "the BSD 3-Clause License"), ("isc", "the ISC License"), ("mpl2", "the Mozilla Public License 2.0"), ("cc-by-nd", "CC BY-ND 4.0"), ("cc-by-nc-sa", "CC BY-NC-SA 4.0"), ("cc-by-nc-nd", "CC BY-NC-ND 4.0")) for n, verb in enumerate(("Licensed under", "Released under"))),
)
MORE_RULES: tuple[tuple[str, str, str], ...] = (
    ("bsd-3-text", "BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("bsd-2-text", "BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("isc-text", "ISC", "isc-grant"),
    ("0bsd-text", "0BSD", "0bsd-grant"),
    ("mpl-2.0-header", "MPL-2.0", "mpl2-subject"),
    ("gpl-2.0-header", "GPL-2.0-or-later", "gpl2-free"),
    ("gpl-2.0-only-header", "GPL-2.0-only", "gpl2-only"),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", "lgpl21-free"),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", "lgpl3-free"),
    ("agpl-3.0-header", "AGPL-3.0-or-later", "agpl3-free"),
    ("epl-2.0-header", "EPL-2.0", "epl2-made"),
    ("epl-1.0-header", "EPL-1.0", "epl1-made"),
    ("unlicense-text", "Unlicense", "unlicense"),
    *((f"{key}-notice-{n}", name, f"{key}-{n}") for key, name in (("bsd2", "BSD-2-Clause"), ("bsd3", "BSD-3-Clause"), ("isc", "ISC"), ("mpl2", "MPL-2.0"), ("cc-by-nd", "CC-BY-ND-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"), ("cc-by-nc-nd", "CC-BY-NC-ND-4.0")) for n in (0, 1)),
)
ALL_SENTENCES, ALL_RULES = SENTENCES + MORE_SENTENCES, RULES[:-1] + MORE_RULES + RULES[-1:]

#: Marks of a sentence end (also a blank line) and of a line end inside a paragraph.
_END, _LINE = "\x01", "\x02"


def marked(text: Column) -> Column:
    """The normalised text with its marks, between two sentence ends."""
    plain = F.concat(F.lit("\n"), F.translate(text, _END + _LINE, "  "), F.lit("\n"))
    ends = F.regexp_replace(plain, r"[.!?:]+(?:[ \t]+|(?=[\r\n]))", _END)
    # Comment prefixes of signs vanish with all other signs; those that are words go with the line end.
    lines = F.regexp_replace(ends, r"(?i)(?:\r\n?|\n)(?:[ \t]*(?:dnl|rem)(?=[ \t\r\n]))?", _LINE)
    tight = F.regexp_replace(F.regexp_replace(F.lower(lines), f"[^a-z0-9{_END}{_LINE}]+", " "), f" ?([{_END}{_LINE}]) ?", "$1")
    return F.concat(F.lit(_END), F.regexp_replace(tight, f"{_LINE}*{_END}[{_END}{_LINE}]*|{_LINE}{{2,}}", _END), F.lit(_END))


def _known(sentence: str) -> str:
    """A known sentence as ``marked`` has it, without the outer ends."""
    ends = re.sub(r"[.!?:]+[ \t]+", _END, sentence.rstrip(".!?: "))
    return re.sub(f" ?{_END} ?", _END, re.sub(f"[^a-z0-9{_END}]+", " ", ends.lower())).strip()


def _pattern(known: list[str]) -> str:
    """The longest known sentence from each mark on to a later mark; an address may stand in a paragraph of its own."""
    ways = (re.sub(r" (https?\b)?", lambda m: f"[ {_END}{_LINE}]{m[1]}" if m[1] else f"[ {_LINE}]", k) for k in sorted(set(known), key=len, reverse=True))
    return f"[{_END}{_LINE}]({'|'.join(ways)})(?=[{_END}{_LINE}])"


def _in_order(padded: Column, sequence: str) -> Column:
    """Whether the identifiers of a rule stand in this order, each looked for behind the one before: one pass over those found."""
    def behind(at: Column, name: Column) -> Column:
        found = F.call_function("locate", F.concat(F.lit(" "), name, F.lit(" ")), padded, at)
        return F.when((at > 0) & (found > 0), found + F.length(name) + 1).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, sequence.split(" "))), F.lit(1), behind) > 0


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: tuple[tuple[str, str], ...] = ALL_SENTENCES, rules: tuple[tuple[str, str, str], ...] = ALL_RULES) -> DataFrame:
    """The licence sentences and rules found in each text.

    Sentences start and end at line ends, at blank lines (comment prefixes
    aside), and at . ! ? or : before a blank; the line ends inside one read as
    blanks. Of sentences that start at one place the longest counts, and none
    counts inside another. Returns one
    row per distinct (id, text): ``id_col``, n_sentences (known ones, with
    repeats), sentence_ids (in text order, blank-separated), rules (those whose
    sentences all occur in their order, whatever known sentences stand between; in rule order), licenses (theirs, each once) and license (that of the first
    rule, null without one).

    A null, empty or unlicensed text has 0, empty strings and null. A null id
    passes through. Repeated rows are one. Other columns are left out. An
    empty table gives no rows.
    """
    flat = {_known(s).replace(_END, " "): i for i, s in sentences}
    names = F.create_map(*(F.lit(x) for pair in flat.items() for x in pair))
    hits = F.regexp_extract_all(marked(F.col(text_col)), F.lit(_pattern([_known(s) for _, s in sentences])), F.lit(1))
    ids = F.transform(hits, lambda h: F.element_at(names, F.translate(h, _END + _LINE, "  ")))
    per = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.coalesce(ids, F.array().cast("array<string>")).alias("_ids")).distinct()
    padded = F.concat(F.lit(" "), F.array_join("_ids", " "), F.lit(" "))
    matched = F.filter(F.array(*(F.when(_in_order(padded, seq), F.struct(F.lit(name).alias("rule"), F.lit(lic).alias("license"))) for name, lic, seq in rules)), lambda x: x.isNotNull())
    found = per.select("_id", "_ids", matched.alias("_m"))
    licenses = F.array_distinct(F.transform("_m", lambda x: x["license"]))
    return found.select(
        F.col("_id").alias(id_col),
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", " ").alias("sentence_ids"),
        F.array_join(F.transform("_m", lambda x: x["rule"]), " ").alias("rules"),
        F.array_join(licenses, " ").alias("licenses"),
        F.get(licenses, F.lit(0)).alias("license"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Sentences that stand on one line and have no sentence end inside; the others are tested in tests/llm.
OP7_SQL = rf"""
WITH known AS (SELECT DISTINCT i AS sentence_id, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(s)})" for i, s in ALL_SENTENCES)}) v(i, s)),
rules AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_quoted(n)}, {_quoted(c)}, {_quoted(q)})" for k, (n, c, q) in enumerate(ALL_RULES))}) v(k, rule, license, seq)),
parts AS (SELECT doc_id, regexp_split_to_array(text, '[.!?:]+[ \t]+|[.!?:]*[\r\n]+') AS p FROM documents),
own AS (SELECT doc_id, i, trim(regexp_replace(lower(p[i]), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM parts, UNNEST(range(1, len(p) + 1)) AS r(i)),
ids AS (SELECT doc_id, count(*) AS n, string_agg(sentence_id, ' ' ORDER BY i) AS ids FROM own JOIN known USING (sentence) GROUP BY doc_id),
matched AS (SELECT doc_id, k, rule, license FROM ids JOIN rules ON regexp_matches(' ' || ids || ' ', ' ' || replace(seq, ' ', ' (\S+ )*') || ' ')),
names AS (SELECT doc_id, string_agg(rule, ' ' ORDER BY k) AS rules FROM matched GROUP BY doc_id),
firsts AS (SELECT doc_id, license, min(k) AS k FROM matched GROUP BY doc_id, license),
found AS (SELECT doc_id, string_agg(license, ' ' ORDER BY k) AS licenses, arg_min(license, k) AS license FROM firsts GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses, license
FROM documents d LEFT JOIN ids USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN found USING (doc_id)
"""
