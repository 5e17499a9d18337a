"""Licence scans by sentences: normalised sentences get the identifiers of known licence sentences, and the sequence of
identifiers of a document is matched against ordered rules. Built from SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case, words parted by one blank, no punctuation but the
# dots within versions). A pattern must match a whole sentence.
SENTENCES = [
    ("ApacheRef", r"(this (work|file|project|software|code) is )?licensed under (the )?apache license( version)? 2\.0( the license)?"),
    ("ApacheSpdx", r"spdx license identifier apache 2\.0"),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at.*"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", r"(this (work|file|project|software|code) is )?(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("MitSpdx", r"spdx license identifier mit"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIs", r"the software is provided as is without warranty of any kind.*"),
    ("NoLiability", r"in no event shall the (authors or copyright holders|copyright holder or contributors|copyright owner or contributors|author) be liable.*"),
    ("BsdRef", r"(this (work|file|project|software|code) is )?(released|licensed|distributed) under the (new |simplified |[23] clause )?bsd license.*"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", r"(1\.? )?redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", r"(2\.? )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdEndorse", r"(3\.? )?neither the name of .* may be used to endorse or promote products.*"),
    ("BsdAsIs", r"this software is provided by the (copyright holders|author|regents) .*as is.*"),
    ("LgplRef", r"(this (work|file|project|software|code) is )?licensed under the gnu lesser general public license( version)? ?(2\.1|3)?(\.0)?"),
    ("GplRef3", r"(this (work|file|project|software|code) is )?licensed under the gnu general public license( version)? 3(\.0)?"),
    ("GplRef2", r"(this (work|file|project|software|code) is )?licensed under the gnu general public license( version)? 2(\.0)?"),
    ("GplRef", r"(this (work|file|project|software|code) is )?licensed under the gnu general public license"),
    ("GplFree3", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3.*"),
    ("GplFree2", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2.*"),
    ("GplWarranty", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("GplCopy", r"you should have received a copy of the gnu general public license.*"),
    ("MplRef", r"this source code form is subject to the terms of the mozilla public license v\.? ?2\.0"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("CcByNc", r"(this (work|file|project|text) is )?licensed under (a )?(cc by nc|creative commons attribution noncommercial)( 4\.0)?( international)?( license)?"),
    ("CcBySa", r"(this (work|file|project|text) is )?licensed under (a )?(cc by sa|creative commons attribution sharealike)( 4\.0)?( international)?( license)?"),
    ("CcBy", r"(this (work|file|project|text) is )?licensed under (a )?(cc by|creative commons attribution)( 4\.0)?( international)?( license)?"),
    ("AllRights", r"all rights reserved"),
]
# Rules over identifiers in the order in which they are tried. A matched stretch is used up.
RULES = [
    ("Apache-2.0", r"(ApacheRef )?ApacheUse (ApacheCopy )?ApacheAsIs ApacheSee "),
    ("Apache-2.0", r"ApacheRef |ApacheSpdx "),
    ("BSD-3-Clause", r"(BsdRef )?BsdGrant BsdSource BsdBinary BsdEndorse (BsdAsIs )?(NoLiability )?"),
    ("BSD-2-Clause", r"(BsdRef )?BsdGrant BsdSource BsdBinary (BsdAsIs )?(NoLiability )?"),
    ("BSD", r"BsdRef "),
    ("MIT", r"(MitRef )?MitGrant MitNotice (AsIs )?(NoLiability )?"),
    ("MIT", r"MitRef |MitSpdx "),
    ("LGPL", r"LgplRef "),
    ("GPL-3.0", r"GplFree3 (GplWarranty )?(GplCopy )?|GplRef3 "),
    ("GPL-2.0", r"GplFree2 (GplWarranty )?(GplCopy )?|GplRef2 "),
    ("GPL", r"GplRef "),
    ("MPL-2.0", r"MplRef (MplCopy )?"),
    ("CC-BY-NC-4.0", r"CcByNc "),
    ("CC-BY-SA-4.0", r"CcBySa "),
    ("CC-BY-4.0", r"CcBy "),
]
#: Where `oracle` ends a sentence: at a line end, or at a full stop, question or exclamation mark before white space.
#: `scan` lets a known sentence run over single line ends.
BREAK = r"[\r\n]+|[.!?]+[ \t]+"
#: Words without which `oracle` takes a sentence for none of the above; `scan` leaves none out.
TRIGGER = r"licen[sc]e|permi(ssion|tted)|copyright|copies|warranty|redistribut|endorse|liable|mozilla|mpl |rights reserved|without modification"


def normalised(s: str) -> str:
    """SQL for a sentence in lower case, its words parted by single blanks, without punctuation but dots within words."""
    return f"trim(regexp_replace(regexp_replace(lower({s}), '[^a-z0-9.]+', ' ', 'g'), '[.]+( |$)', ' ', 'g'))"


def marked(text: Column) -> Column:
    """A text normalised like a sentence, with | where a sentence must end (full stop, question or exclamation mark
    before white space, blank line) and a line feed where it may (line end, semicolon). Comment and quote marks at a
    line's beginning become blanks, so that a line of nothing else is a blank line."""
    # The full stop of "v. 2.0" ends no sentence.
    t = F.regexp_replace(F.translate(F.lower(text), "|", " "), r"\bv[.][^a-z0-9.]+(?=[0-9])", "v ")
    t = F.regexp_replace(t, r"[.!?]+(?=[ \t\r\n]|\z)", "|")
    t = F.regexp_replace(t, r"(?<![^\r\n])[ \t]*;+", " ")
    t = F.regexp_replace(t, r";[ \t]+(?=[^ \t\r\n])", "\n")
    t = F.regexp_replace(t, r"[^a-z0-9.|\r\n]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[.]+(?=[ |\r\n]|\z)", " "), "  +", " ")
    t = F.regexp_replace(t, r" *(?:\r\n|\r|\n) *", "\n")
    return F.trim(F.regexp_replace(t, r"[ \n]*\|[ \n|]*|\n{2,}", "|"))


def known_sentence() -> str:
    """A pattern for any known sentence in a marked text, from a line's or sentence's beginning to the first end of either that completes it."""
    any_of = "|".join(f"(?:{p})" for _, p in SENTENCES)
    return rf"(?<![^|\n])(?:{any_of.replace('.*', '[^|]*?').replace(' ', f'[ {chr(92)}n]')})(?![^|\n])"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses (comma-joined, in the rules' order, each once).

    A known sentence may be wrapped over several lines, each with a comment or quote prefix, or be a line by itself.
    Works on whole texts, row by row, without a shuffle. Null and empty texts have none; null and repeated ids are
    carried as they are; what no rule matches is left out of licenses but stays in sentence_ids. Other columns are
    not looked at, and an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def name(s: Column) -> Column:
        out = None
        for ident, pattern in SENTENCES:
            hit = s.rlike(f"^({pattern})$")
            out = F.when(hit, ident) if out is None else out.when(hit, ident)
        return out

    known = F.regexp_extract_all(marked(text), F.lit(known_sentence()), F.lit(0))
    ids = F.filter(F.transform(known, lambda s: name(F.translate(s, "\n", " "))), lambda x: x.isNotNull())
    out = docs.select(F.col("doc_id").cast("long"), ids.alias("ids"))
    out = out.withColumn("sentence_ids", F.array_join("ids", ","))
    left = F.concat(F.array_join("ids", " "), F.lit(" "))
    found = []
    for i, (_, rule) in enumerate(RULES):
        out = out.withColumn(f"left_{i}", left)
        found.append(F.col(f"left_{i}").rlike(f"(^|[ ])({rule})"))
        left = F.regexp_replace(f"left_{i}", f"(^|[ ])({rule})", "$1# ")
    names = list(dict.fromkeys(n for n, _ in RULES))
    any_of = {n: [hit for (m, _), hit in zip(RULES, found, strict=True) if m == n] for n in names}
    licenses = [F.when(hits[0] if len(hits) == 1 else hits[0] | hits[1], n) for n, hits in any_of.items()]
    return out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), "sentence_ids", F.array_join(F.array(*licenses), ",").alias("licenses"))


def oracle() -> str:
    """The scan in DuckDB's SQL, but for sentences that are wrapped, end at a semicolon or hold "v. 2.0" (it ends each at a line end or full stop) or hold no TRIGGER."""
    case = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{n}'" for n, p in SENTENCES)
    parts = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{BREAK}'), lambda s: regexp_matches(lower(s), '{TRIGGER}'))"
    steps, left = [], "array_to_string(ids, ' ') || ' '"
    for i, (_, rule) in enumerate(RULES):
        steps.append(f"r{i} AS (SELECT *, {left} AS left_{i} FROM {f'r{i - 1}' if i else 'i'})")
        left = f"regexp_replace(left_{i}, '(^|[ ])({rule})', '\\1# ', 'g')"
    names = list(dict.fromkeys(n for n, _ in RULES))
    hits = [" OR ".join(f"regexp_matches(left_{i}, '(^|[ ])({rule})')" for i, (m, rule) in enumerate(RULES) if m == n) for n in names]
    array = ", ".join(f"CASE WHEN {h} THEN '{n}' END" for n, h in zip(names, hits, strict=True))
    return f"""
WITH s AS (SELECT doc_id, list_transform({parts}, lambda s: {normalised("s")}) AS n FROM documents),
i AS (SELECT doc_id, list_filter(list_transform(n, lambda s: CASE {case} END), lambda x: x IS NOT NULL) AS ids FROM s),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_filter([{array}], lambda x: x IS NOT NULL), ',') AS licenses
FROM r{len(RULES) - 1}
"""
