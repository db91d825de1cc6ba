"""Licence scans by sentence rules (operator 7), in DataFrame functions only.

A text is cut into pieces at the ends of sentences, at blank lines (lines of comment marks are blank) and after lines that
begin with "copyright". Each piece, with the next one where it isn't known alone (a sentence may go on after a blank line), or
else each of its lines, is normalised and mapped to identifiers: of a known licence sentence, or of the licences that a sentence of the
usual wordings ("this program is licensed under the ..") or an SPDX line names. The sequence of identifiers, with marks for unknown
sentences between them, is then matched against rules, in order: a rule that finds its sentences one after another, with at most GAP
unknown ones before each next, names its licence and uses them up, so that longer rules come first.
Everything happens within a row: no join, no shuffle; the tables of sentences and rules are fixed values below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts with none of these hold no known sentence; between words stands what normalisation makes a space.
HINT = "licen[cs]|copyright|permission|redistribution|warrant|liab|public domain|released under|rights reserved|free software|misrepresented|source distribution|of the mpl".replace(" ", "[^a-z0-9]+")
SENTENCE_END = "[.!?;:]+(?:[ \\t\\r\\n]+|$)|\\r?\\n[ \\t\\r#*/;%|-]*\\n"
#: A line that begins with "copyright", after comment marks; what follows it begins a new piece.
COPYRIGHT_LINE = "(?i)((?:^|\\n)[ \\t#*/;%|-]*(?:copyright|\\(c\\)|©)[^\\n]*\\n)"

# Known licence sentences, as normalised (lower case, other characters than a-z and 0-9 as single spaces).
SENTENCES = (
    ("apache-2-line", "licensed under the apache license version 2 0"),
    ("apache-2-you", "licensed under the apache license version 2 0 the license"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-obtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2-obtain-2", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("apache-2-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-line", "released under the mit license"),
    ("mit-line-2", "licensed under the mit license"),
    ("mit-name", "mit license"),
    ("mit-name-2", "the mit license mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names-2", "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-asis", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-style", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-3-line", "licensed under the bsd 3 clause license"),
    ("bsd-2-line", "licensed under the bsd 2 clause license"),
    ("gpl-3-line", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3-line-2", "licensed under the gnu general public license version 3"),
    ("gpl-2-line", "licensed under the gnu general public license version 2"),
    ("gpl-free", "this program is free software"),
    ("gpl-3-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl-free", "this library is free software"),
    ("lgpl-2-1-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3-line", "licensed under the gnu affero general public license version 3"),
    ("lgpl-3-line", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2-subject", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl-2-subject-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-2-copy-2", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib-asis", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib-origin", "the origin of this software must not be misrepresented"),
    ("zlib-notice", "this notice may not be removed or altered from any source distribution"),
    ("bsl-1-line", "distributed under the boost software license version 1 0"),
    ("mpl-2-line", "licensed under the mozilla public license version 2 0"),
    ("cc-by-nc-4-line", "licensed under cc by nc 4 0"),
    ("cc-by-4-line", "licensed under cc by 4 0"),
    ("cc-by-sa-4-line", "licensed under cc by sa 4 0"),
    ("cc-by-nc-sa-4-line", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd-4-line", "licensed under cc by nd 4 0"),
    ("cc-by-4-long", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4-long", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4-long", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-line", "released under cc0 1 0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)

# Licences and the sentences that stand for them, one after another; earlier rules win.
RULES = (
    ("Apache-2.0", ("apache-2-you", "apache-2-comply", "apache-2-obtain", "apache-2-asis", "apache-2-see")),
    ("Apache-2.0", ("apache-2-you", "apache-2-comply", "apache-2-obtain-2", "apache-2-asis", "apache-2-see")),
    ("Apache-2.0", ("apache-2-you", "apache-2-comply", "apache-2-obtain")),
    ("Apache-2.0", ("apache-2-you", "apache-2-comply")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("BSD-3-Clause", ("bsd-forms", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-forms", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-forms", "bsd-source", "bsd-binary", "bsd-names-2")),
    ("BSD-2-Clause", ("bsd-forms", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-forms", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-later", "gpl-hope", "gpl-merchantability", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-later", "gpl-hope", "gpl-merchantability", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-later", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2-later")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-2-1-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-3-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-3-later")),
    ("Zlib", ("zlib-asis", "zlib-grant", "zlib-origin", "zlib-notice")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-1-line",)),
    ("BSD-3-Clause", ("bsd-style",)),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache-2-line",)),
    ("Apache-2.0", ("apache-2-you",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-2",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-2",)),
    ("BSD-3-Clause", ("bsd-3-line",)),
    ("BSD-2-Clause", ("bsd-2-line",)),
    ("GPL-3.0-only", ("gpl-3-line",)),
    ("GPL-3.0-only", ("gpl-3-line-2",)),
    ("GPL-2.0-only", ("gpl-2-line",)),
    ("AGPL-3.0-only", ("agpl-3-line",)),
    ("LGPL-3.0-only", ("lgpl-3-line",)),
    ("MPL-2.0", ("mpl-2-subject-2", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-subject-2", "mpl-2-copy-2")),
    ("MPL-2.0", ("mpl-2-subject",)),
    ("MPL-2.0", ("mpl-2-subject-2",)),
    ("MPL-2.0", ("mpl-2-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-line",)),
    ("CC-BY-4.0", ("cc-by-4-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-line",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-line",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-line",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("CC0-1.0", ("cc0-line",)),
    ("Unlicense", ("unlicense-free",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)


# What licences are called where a sentence names them, as normalised; versioned ones are made below.
NAMES = {
    "mit": "MIT", "mit license": "MIT", "expat license": "MIT", "x11 license": "X11",
    "bsd 3 clause": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause", "3 clause bsd license": "BSD-3-Clause",
    "bsd 2 clause": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "freebsd license": "BSD-2-Clause", "2 clause bsd license": "BSD-2-Clause",
    "0bsd": "0BSD", "isc": "ISC", "zlib": "Zlib", "boost software license version 1 0": "BSL-1.0", "bsl 1 0": "BSL-1.0",
    "cc0": "CC0-1.0", "cc0 1 0": "CC0-1.0", "cc0 1 0 universal": "CC0-1.0", "unlicense": "Unlicense", "wtfpl": "WTFPL",
    "artistic license 2 0": "Artistic-2.0", "artistic 2 0": "Artistic-2.0", "eclipse public license 2 0": "EPL-2.0", "epl 2 0": "EPL-2.0", "eupl 1 2": "EUPL-1.2",
}
for _n in ("version 2 0", "2 0", "v2", "v2 0", "version 2"):
    NAMES |= {f"apache license {_n}": "Apache-2.0", f"apache {_n}": "Apache-2.0", f"mozilla public license {_n}": "MPL-2.0", f"mpl {_n}": "MPL-2.0"}
for _name, _short, _spdx, _versions in (("gnu general public license", "gpl", "GPL", "23"), ("gnu affero general public license", "agpl", "AGPL", "3"), ("gnu lesser general public license", "lgpl", "LGPL", "3")):
    for _v in _versions:
        for _said in (f"{_name} version {_v}", f"{_name} v{_v}", f"{_short} v{_v}", f"{_short}v{_v}", f"{_short} version {_v}", f"{_short} {_v} 0", f"gnu {_short} version {_v}", f"gnu {_short} v{_v}"):
            NAMES |= {_said: f"{_spdx}-{_v}.0-only", f"{_said} only": f"{_spdx}-{_v}.0-only", f"{_said} or later": f"{_spdx}-{_v}.0-or-later", f"{_said} or any later version": f"{_spdx}-{_v}.0-or-later"}
for _kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    NAMES[f"cc {_kind} 4 0"] = f"CC-{_kind.upper().replace(' ', '-')}-4.0"
NAMES |= {f"{_n} license": _of for _n, _of in list(NAMES.items()) if not _n.endswith(" license")}

#: Sentences that name licences, as normalised; group 1 is what they name.
_THING = "software|program|project|work|code|source code|library|package|file|module|repository|product|document|text|dataset"
UNDER = f"^(?:this (?:{_THING}) is |it is )?(?:dual )?(?:licensed|released|distributed|published|provided|available|made available|offered) under (?:the terms of )?(?:either )?(?:the )?(.+?)(?: terms)?$|^spdx license identifier (.+)$"
NAMED_APART = " (?:and|or)(?: the)? "
#: An SPDX line is a sentence of its own, colon or not.
SPDX_LINE, SPDX_ALONE = "(?i)(spdx-license-identifier):[ \\t]*([^\\r\\n]*)", "$1 $2\n\n"
#: Most unknown sentences between two of a rule's.
GAP = 3


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _map(pairs: Iterable[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def sequence_of(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order, as <id><id>..; a dot for each unknown sentence between, GAP + 1 at most."""
    known, names = _map((sentence, name) for name, sentence in SENTENCES), _map(NAMES.items())

    def under(name: Column) -> Column:
        each = lambda x: F.concat(F.lit("<under:"), names[x], F.lit(">"))
        apart = let(F.transform(F.split(name, NAMED_APART), each), lambda ids: F.when(F.forall(ids, lambda x: x.isNotNull()), F.array_join(ids, "")))
        return F.coalesce(each(name), apart)

    def named(sentence: Column) -> Column:
        """<id>, several of them, or null."""
        def of(n: Column) -> Column:
            said = let(F.concat(F.regexp_extract(n, UNDER, 1), F.regexp_extract(n, UNDER, 2)), lambda name: F.when(name != "", under(name)))
            return F.coalesce(F.concat(F.lit("<"), known[n], F.lit(">")), F.when(n.contains(" under ") | n.startswith("spdx "), said))

        return let(normalised(sentence), of)

    mark = lambda s: F.when(F.lower(s).rlike("[a-z0-9]"), ".").otherwise("")
    lines = lambda s: F.regexp_replace(F.array_join(F.transform(F.split(s, "\n"), lambda line: F.coalesce(named(line), mark(line))), ""), "\\.+", ".")
    alone = F.regexp_replace(F.regexp_replace(text, SPDX_LINE, SPDX_ALONE), COPYRIGHT_LINE, "$1\n")

    def each(pieces: Column) -> Column:
        following = lambda i: F.coalesce(F.get(pieces, i + 1), F.lit(""))
        return F.transform(pieces, lambda s, i: F.coalesce(named(s), named(F.concat(s, F.lit(" "), following(i))), lines(s)))

    return F.regexp_replace(F.array_join(let(F.split(alone, SENTENCE_END), each), ""), f"\\.{{{GAP + 1},}}", "." * (GAP + 1))


#: All rules, those for licences that a sentence names last, as patterns on sequences.
PATTERNS = tuple(
    (name, f"\\.{{0,{GAP}}}".join("<" + i.replace(".", "\\.") + ">" for i in ids))
    for name, ids in (*RULES, *((spdx, (f"under:{spdx}",)) for spdx in sorted(set(NAMES.values()))))
)


def matched(sequence: Column) -> Column:
    """Licences whose rules match a sequence, by rule order."""
    rules = F.array(*(F.struct(F.lit(pattern).alias("ids"), F.lit(name).alias("name")) for name, pattern in PATTERNS))

    def step(so_far: Column, rule: Column) -> Column:
        def with_rest(rest: Column) -> Column:
            hit = rest != so_far["rest"]
            return F.struct(rest.alias("rest"), F.when(hit, F.concat(so_far["names"], F.array(rule["name"]))).otherwise(so_far["names"]).alias("names"))

        return let(F.regexp_replace(so_far["rest"], rule["ids"], F.lit("|")), with_rest)

    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(rules, start, step)["names"]


def license_matches(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentences, licenses: one row for each row of documents.

    sentences: identifiers in order of the text; licenses: names in order of code points, each once, both comma-joined.
    A null or empty text, and one without known sentences, has none (empty strings, 0). Repeated rows give repeated rows,
    null ids are carried, an empty table gives no rows. Very long texts are read whole, in time that grows with their length and
    the sentences found. Of rules that could take the same sentences the earlier one does. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    found = documents.select("doc_id", F.when(text.rlike(f"(?i){HINT}"), sequence_of(text)).otherwise("").alias("sequence"))
    ids = found.select("doc_id", "sequence", F.regexp_extract_all("sequence", F.lit("<([^<>]+)>"), 1).alias("ids"))
    licenses = F.when(F.size("ids") > 0, F.array_sort(F.array_distinct(matched(F.col("sequence"))))).otherwise(F.array().cast("array<string>"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"), F.array_join(licenses, ",").alias("licenses"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(s)}: {q(n)}" for n, s in SENTENCES) + "}"
    names = "MAP {" + ", ".join(f"{q(s)}: {q(n)}" for s, n in NAMES.items()) + "}"
    rules = "[" + ", ".join("{'ids': " + q(pattern) + ", 'name': " + q(name) + "}" for name, pattern in PATTERNS) + "]"
    norm = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"

    def named(n: str) -> str:
        name = f"(regexp_extract({n}, '{UNDER}', 1) || regexp_extract({n}, '{UNDER}', 2))"
        parts = f"string_split_regex({name}, '{NAMED_APART}')"
        apart = f"CASE WHEN len(list_filter({parts}, lambda y: NOT map_contains({names}, y))) = 0 THEN array_to_string(list_transform({parts}, lambda y: '<under:' || {names}[y] || '>'), '') END"
        return f"coalesce('<' || {known}[{n}] || '>', CASE WHEN {name} <> '' THEN coalesce('<under:' || {names}[{name}] || '>', {apart}) END)"

    return f"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '{SPDX_LINE}', '\\1 \\2' || chr(10) || chr(10), 'g'), '{COPYRIGHT_LINE}', '\\1' || chr(10), 'g'), '{SENTENCE_END}') AS parts FROM documents
), part AS (
  SELECT r, generate_subscripts(parts, 1) AS i, unnest(parts) AS s, unnest(list_append(parts[2:], '')) AS next FROM cut
), normal AS (
  SELECT r, i, s, {norm('s')} AS n, {norm("s || ' ' || next")} AS n2 FROM part
), one AS (
  SELECT r, i, s, coalesce({named('n')}, {named('n2')}) AS found FROM normal
), line AS (
  SELECT r, i, generate_subscripts(lines, 1) AS j, {norm('unnest(lines)')} AS n FROM (SELECT r, i, string_split(s, chr(10)) AS lines FROM one WHERE found IS NULL)
), lined AS (
  SELECT r, i, regexp_replace(string_agg(coalesce({named('n')}, CASE WHEN n <> '' THEN '.' ELSE '' END), '' ORDER BY j), '\\.+', '.', 'g') AS found FROM line GROUP BY r, i
), seq AS (
  SELECT r, regexp_replace(string_agg(coalesce(one.found, lined.found), '' ORDER BY i), '\\.{{{GAP + 1},}}', '{"." * (GAP + 1)}', 'g') AS sequence FROM one LEFT JOIN lined USING (r, i) GROUP BY r
), walked AS (
  SELECT r, regexp_extract_all(sequence, '<([^<>]+)>', 1) AS ids, list_reduce([{{'rest': sequence, 'names': []::VARCHAR[], 'ids': '', 'name': ''}}]
      || list_transform({rules}, lambda x: {{'rest': '', 'names': []::VARCHAR[], 'ids': x.ids, 'name': x.name}}),
    lambda a, x: {{'rest': regexp_replace(a.rest, x.ids, '|', 'g'), 'names': CASE WHEN regexp_matches(a.rest, x.ids) THEN list_append(a.names, x.name) ELSE a.names END, 'ids': '', 'name': ''}}) AS w
  FROM seq WHERE contains(sequence, '<')
)
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences,
       coalesce(array_to_string(list_sort(list_distinct(w.names)), ','), '') AS licenses
FROM cut LEFT JOIN walked USING (r)
"""
