"""Licence recognition by sentences and ordered rules, with DataFrame functions only (operator 6).

A text is cut into sentences, each is normalised and looked up among known licence sentences.  The
sequence of identifiers that a text holds is then matched against ordered rules: a rule is a
sequence of identifiers that must follow each other, and the first rule that matches at a place
takes its sentences.

A sentence ends at a stop, exclamation, question mark or colon before white space, at a bar, and at
a line without letters or digits, so it may run over line ends and comment marks.  A line that is a
known sentence by itself (a title, a tag) is always one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Names of licences as SPDX writes them, also those of the GNU licences without "only" or "or later".
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GFDL-1.2-only", "GFDL-1.2-or-later", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
# The GNU licences, their versions and the dates in their titles.
GNU = (
    ("GPL", "gnu general public license", (("1", "february 1989"), ("2", "june 1991"), ("3", "29 june 2007"))), ("LGPL", "gnu library general public license", (("2", "june 1991"),)),
    ("LGPL", "gnu lesser general public license", (("2.1", "february 1999"), ("3", "29 june 2007"))), ("AGPL", "gnu affero general public license", (("3", "19 november 2007"),)),
    ("GFDL", "gnu free documentation license", (("1.1", "march 2000"), ("1.2", "november 2002"), ("1.3", "3 november 2008"))),
)
CREATIVE_COMMONS = (
    ("CC-BY", "attribution", "by"), ("CC-BY-NC", "attribution noncommercial", "by nc"), ("CC-BY-SA", "attribution sharealike", "by sa"), ("CC-BY-NC-SA", "attribution noncommercial sharealike", "by nc sa"),
    ("CC-BY-ND", "attribution noderivatives", "by nd"), ("CC-BY-NC-ND", "attribution noncommercial noderivatives", "by nc nd"),
)

# Well-known licence sentences in normalised form, and their identifiers.
PLAIN = {
    "released under the mit license": "mit-tag",
    "licensed under the mit license": "mit-tag",
    "this project is licensed under the mit license": "mit-tag",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "isc license": "isc-title",
    "licensed under the apache license version 2 0": "apache2-tag",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-header",
    "you may obtain a copy of the license at": "apache2-copy",
    "apache license version 2 0 january 2004": "apache2-title",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-head",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl2-form",
    "eclipse public license v 2 0": "epl2-title",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "boost software license version 1 0": "bsl-title",
    "distributed under the boost software license version 1 0": "bsl-title",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "do what the fuck you want to public license": "wtfpl-title",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "mozilla public license version 1 1": "mpl11-title",
    "the contents of this file are subject to the mozilla public license version 1 1 the license": "mpl11-form",
    "mozilla public license version 2 0": "mpl2-title",
    "the artistic license": "artistic-title",
    "the artistic license 2 0": "artistic2-title",
    "eclipse public license v 1 0": "epl1-title",
    "cc0 1 0 universal": "cc0-title",
    "this work is dedicated to the public domain under cc0 1 0": "cc0-title",
}


def _slug(x: str) -> str:
    return x.lower().replace(".", "").replace(" ", "-")


def _sentences() -> dict[str, str]:
    """The plain sentences, and those of licence families that differ by name and version only."""
    out = dict(PLAIN)
    for name in SPDX:
        out[f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}"] = f"spdx-{name}"
    for short, name, versions in GNU:
        for v, date in versions:
            written, own = v.replace(".", " "), f"{short.lower()}{_slug(v)}"
            out[f"{name} version {written}"] = out[f"{name} version {written} {date}"] = f"{own}-title"
            for head in ("licensed under the ", "this work is licensed under the ", "released under the "):
                out[f"{head}{name} version {written}"] = out[f"{head}{name} v{written}"] = f"{own}-tag"
            if short == "GFDL":
                grant = f"permission is granted to copy distribute and or modify this document under the terms of the {name} version {written}"
                for tail in ("", " with no invariant sections no front cover texts and no back cover texts"):
                    out[f"{grant} or any later version published by the free software foundation{tail}"], out[f"{grant} published by the free software foundation{tail}"] = f"{own}-later", f"{own}-only"
                continue
            out[f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {written} of the license or at your option any later version"] = f"{own}-later"
            out[f"you can redistribute it and or modify it under the terms of the {name} version {written} as published by the free software foundation"] = f"{own}-only"
            out[f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation version {written} of the license"] = f"{own}-only"
    for short, name, code in CREATIVE_COMMONS:
        for v in ("3.0", "4.0"):
            written, own = v.replace(".", " "), f"{short.lower()}-{_slug(v)}-tag"
            for head in ("licensed under ", "this work is licensed under "):
                out[f"{head}cc {code} {written}"] = own
                for kind in ("international license", "unported license", "international public license"):
                    out[f"{head}a creative commons {name} {written} {kind}"] = out[f"{head}the creative commons {name} {written} {kind}"] = own
            out[f"creative commons {name} {written} {'international' if v == '4.0' else 'unported'} public license"] = own
    return out


SENTENCES = _sentences()


def _rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(licence, identifiers that follow each other), in the order in which they are tried."""
    out = [
        ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names")), ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
        ("MIT", ("mit-title", "mit-grant", "mit-notice")), ("MIT", ("mit-grant", "mit-notice")),
        ("Apache-2.0", ("apache2-head", "apache2-compliance", "apache2-copy")), ("Apache-2.0", ("apache2-head", "apache2-compliance")),
        ("Apache-2.0", ("apache2-header", "apache2-copy")), ("Apache-2.0", ("apache2-header",)), ("Apache-2.0", ("apache2-title",)), ("Apache-2.0", ("apache2-tag",)),
        ("ISC", ("isc-title", "isc-grant")), ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant",)),
        ("MPL-2.0", ("mpl2-form", "mpl2-copy")), ("MPL-2.0", ("mpl2-form",)), ("EPL-2.0", ("epl2-form",)), ("EPL-2.0", ("epl2-title",)), ("EPL-1.0", ("epl1-title",)),
        ("MPL-2.0", ("mpl2-title",)), ("MPL-1.1", ("mpl11-title", "mpl11-form")), ("MPL-1.1", ("mpl11-form",)), ("MPL-1.1", ("mpl11-title",)), ("Artistic-2.0", ("artistic2-title",)), ("Artistic-1.0", ("artistic-title",)),
        ("Unlicense", ("unlicense-head", "unlicense-grant")), ("Unlicense", ("unlicense-head",)), ("BSL-1.0", ("bsl-title",)),
        ("Zlib", ("zlib-warranty", "zlib-grant")), ("Zlib", ("zlib-grant",)), ("WTFPL", ("wtfpl-title",)), ("CC0-1.0", ("cc0-title",)), ("MIT", ("mit-tag",)),
    ]
    for short, _, versions in GNU:
        for v, _ in versions:
            own, full = f"{short.lower()}{_slug(v)}", v if "." in v else f"{v}.0"
            # a licence's own text ends with the notice that it proposes, which grants nothing by itself
            out += [(f"{short}-{full}", (f"{own}-title", f"{own}-later", "gnu-warranty")), (f"{short}-{full}", (f"{own}-title", f"{own}-later"))]
            out += [(f"{short}-{full}-or-later", (f"{own}-later", "gnu-warranty")), (f"{short}-{full}-only", (f"{own}-only", "gnu-warranty"))]
            out += [(f"{short}-{full}-or-later", (f"{own}-later",)), (f"{short}-{full}-only", (f"{own}-only",)), (f"{short}-{full}", (f"{own}-tag",)), (f"{short}-{full}", (f"{own}-title",))]
    out += [(f"{short}-{v}", (f"{short.lower()}-{_slug(v)}-tag",)) for short, _, _ in CREATIVE_COMMONS for v in ("3.0", "4.0")]
    return (*out, *((name, (f"spdx-{name}",)) for name in SPDX))


RULES = _rules()
#: Every known sentence holds one of these, so other texts need no closer look.
HINT = r"(?i)licen|permission|copyright|redistribut|hope[^a-z]+that|public[^a-z]+domain|free[^a-z]+to[^a-z]+copy|the[^a-z]+mpl|as[^a-z]+is|cc0"
#: A colon after this doesn't end a sentence.
TAG = r"(?i)(spdx-license-identifier)[ \t]*:"
#: Within a line that holds the tag, what parts its expression into names: (pattern, what stands for it).
EXPRESSION = ((r"\*/|-->", " | "), (r"[()]", " "), (r"([0-9])\+", "\\1-or-later"), (r"(?i)[ \t]+with[ \t]+[^ \t]+", " "), (r"(?i)[ \t]+(?:or|and)[ \t]+", " | spdx-license-identifier "))
#: Where sentences end once lines are joined.
ENDS = r"\||[.!?]+[ \t\f]+|:[ \t\f]+"
#: Wording that differs without another meaning: (pattern, what stands for it).
VARIANTS = (
    (r"^this (?:program|library|file|software) is free software ", ""),
    (r"^neither the name of .{1,120} nor the names of (?:its|any) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^(?:dnl|rem) ", ""),
)


def normalised(sentence: Column) -> Column:
    """Lower case, every run of other characters than ASCII letters and digits a single space, and one wording for all variants."""
    out = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    for pattern, plain in VARIANTS:
        out = F.regexp_replace(out, pattern, plain)
    return out


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def identifiers(text: Column) -> Column:
    """Identifiers of the licence sentences of a text in order (null or other texts: none)."""
    names = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def tagged(line: Column) -> Column:
        out = F.regexp_replace(line, TAG, "$1")
        for pattern, plain in EXPRESSION:
            out = F.regexp_replace(out, pattern, plain.replace("\\1", "$1"))
        return F.concat(out, F.lit(" | "))

    alone = lambda line: _let(normalised(line), lambda n: F.when(n == "", "|").when(F.element_at(names, n).isNotNull(), F.concat(F.lit("|"), n, F.lit("|"))).when(line.rlike(TAG), tagged(line)).otherwise(line))
    joined = F.array_join(F.transform(F.split(text, r"\r\n|\r|\n", -1), alone), " ")
    known = F.filter(F.transform(F.split(joined, ENDS, -1), lambda s: F.element_at(names, normalised(s))), lambda x: x.isNotNull())
    return F.when(text.rlike(HINT), known).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Licences of a sequence of identifiers, each once, in order of name.

    Identifiers that a rule has taken are marked, so later rules don't see them.
    """
    line, out = F.concat(F.lit(";"), F.array_join(ids, ";"), F.lit(";")), []
    zero = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(";" + ";".join(rule) + ";").alias("part")) for licence, rule in RULES])

    def step(done: Column, rule: Column) -> Column:
        # twice, since neighbours share a separator
        rest = F.replace(F.replace(done["line"], rule["part"], F.lit(";-;")), rule["part"], F.lit(";-;"))
        hit = F.instr(done["line"], rule["part"]) > 0
        return F.when(hit, F.struct(rest.alias("line"), F.array_append(done["found"], rule["licence"]).alias("found"))).otherwise(done)

    return F.array_sort(F.array_distinct(F.aggregate(rules, zero, step, lambda d: d["found"])))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with sentence_ids and licences (arrays of strings).

    One pass without a shuffle.  Every row stays, repeated ones too; null and empty texts have
    empty arrays, and texts of any length are read whole.  Columns of these names are replaced,
    other columns are kept.
    """
    rest = [c for c in docs.columns if c not in ("text", "sentence_ids", "licences")]
    ids = docs.select(*rest, identifiers(F.col("text")).alias("sentence_ids"))
    return ids.withColumn("licences", F.when(F.size("sentence_ids") > 0, licences(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))


def duckdb_sql(table: str = "documents") -> str:
    """The same in SQL of DuckDB, arrays joined by commas."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())

    def plain(x: str) -> str:
        out = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, other in VARIANTS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(other)})"
        return out

    tagged = f"regexp_replace(p.s, {quoted(TAG)}, '\\1', 'g')"
    for pattern, other in EXPRESSION:
        tagged = f"regexp_replace({tagged}, {quoted(pattern)}, {quoted(other)}, 'g')"
    # the chain of replacements is long, so it is built step by step
    steps, previous = [], "seq"
    for k, (licence, rule) in enumerate(RULES):
        part = quoted(";" + ";".join(rule) + ";")
        steps.append(f"r{k} AS (SELECT rid, ids, replace(replace(line, {part}, ';-;'), {part}, ';-;') AS line, CASE WHEN instr(line, {part}) > 0 THEN list_append(found, {quoted(licence)}) ELSE found END AS found FROM {previous})")
        previous = f"r{k}"
    return rf"""
WITH known(sentence, id) AS (VALUES {values}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM {table}),
lines AS (
  SELECT rid, unnest(string_split_regex(text, '\r\n|\r|\n')) AS s, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS n
  FROM docs WHERE regexp_matches(text, {quoted(HINT)})),
plain AS MATERIALIZED (SELECT rid, n, s, {plain("s")} AS p FROM lines),
joined AS (
  SELECT p.rid, string_agg(CASE WHEN p.p = '' THEN '|' WHEN k.id IS NOT NULL THEN '|' || p.p || '|' WHEN regexp_matches(p.s, {quoted(TAG)}) THEN {tagged} || ' | ' ELSE p.s END, ' ' ORDER BY p.n) AS text
  FROM plain p LEFT JOIN known k ON k.sentence = p.p GROUP BY p.rid),
parts AS (SELECT rid, unnest(string_split_regex(text, {quoted(ENDS)})) AS s, generate_subscripts(string_split_regex(text, {quoted(ENDS)}), 1) AS n FROM joined),
hits AS (SELECT p.rid, p.n, k.id FROM parts p JOIN known k ON {plain("p.s")} = k.sentence),
lists AS (SELECT rid, list(id ORDER BY n) AS ids FROM hits GROUP BY rid),
seq AS (SELECT rid, ids, ';' || array_to_string(ids, ';') || ';' AS line, []::VARCHAR[] AS found FROM lists),
{", ".join(steps)}
SELECT d.doc_id, coalesce(array_to_string(r.ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct(r.found)), ','), '') AS licences
FROM docs d LEFT JOIN {previous} r ON r.rid = d.rid"""
