"""License scans by sentence rules.

A text is cut into parts at line breaks and punctuation marks, the parts are
normalised (lower case, runs of other characters than letters and digits as one
space), and known licence sentences of one part or several on end are found, from
the left and the longest first: a sentence may be wrapped, or hold a mark as in
'free software: you can' or 'v. 2.0'. The identifiers found, in the text's order,
are matched against ordered licence rules: a rule takes the identifiers it matches, and
those left are matched by later ones. The first names the licence; all are listed.

Every known sentence holds one of a few marker words (`MARKERS`; asserted below),
so texts without a marker have no known sentence and are not cut up. The tables
are literals of the plan: nothing is joined or shuffled, whatever the input's
size. DataFrame functions only.

Defined results: a null or empty text has no sentences and no licence ('');
repeated rows give repeated results; an empty table gives an empty result; only
doc_id and text are read by the query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-asf": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "apache-asf-the": "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache-title": "apache license version 2 0 january 2004",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "lgpl-copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "agpl-see": "see the gnu affero general public license for more details",
    "agpl-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-the": "the mit license",
    "mit-the-mit": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-title": "bsd 2 clause license",
    "bsd3-title": "bsd 3 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-old": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-title": "isc license",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-under": "distributed under the boost software license version 1 0",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-sa-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nd-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc0": "released under the cc0 1 0 license",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-title": "mozilla public license version 2 0",
    "mpl11": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "epl1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cddl": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "artistic2": "the artistic license 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "wtfpl": "do what the fuck you want to public license",
}

# Licence names that stand after SPDX-License-Identifier.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
)
SENTENCES |= {f"spdx-{name.lower()}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for name in SPDX}

# Ordered rules; a rule matches if its identifiers follow each other among those that no earlier rule took.
RULES = (
    ("Apache-2.0", ("apache-asf", "apache-asf-the", "apache-use", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-use", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-the", "apache-use")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-the",)),
    ("Apache-2.0", ("apache-asf-the",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-see", "lgpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "agpl-see", "agpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-the", "mit-grant", "mit-notice")),
    ("MIT", ("mit-the-mit", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-the",)),
    ("MIT", ("mit-the-mit",)),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-neither")),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-author")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("BSD-unclear", ("bsd-redist",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("ISC", ("isc-title", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-old",)),
    ("ISC", ("isc-title",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-under",)),
    ("BSL-1.0", ("boost-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-1.1", ("mpl11",)),
    ("EPL-1.0", ("epl1",)),
    ("EPL-2.0", ("epl2",)),
    ("CDDL", ("cddl",)),
    ("Artistic-2.0", ("artistic2",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    *((name, (f"spdx-{name.lower()}",)) for name in SPDX),
)

MARKERS = "[Ll][Ii][Cc][Ee][Nn][CcSs]|[Pp][Ee][Rr][Mm][Ii][Ss][Ss]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb]|[Uu][Nn][Ee][Nn][Cc][Uu][Mm]"
END = r"\n|[.!?:;]+(?:[ \t-\r]+|$)"
assert all(re.search(MARKERS, s) for s in SENTENCES.values()) and {i for _, ids in RULES for i in ids} <= set(SENTENCES)


#: Stands for the end of a part: any mix of line breaks, punctuation marks and other characters.
CUT = "\x01"
LONGEST_FIRST = sorted(SENTENCES.values(), key=len, reverse=True)
FOUND = f"(?<={CUT})(?:" + "|".join(x.replace(" ", f"[ {CUT}]") for x in LONGEST_FIRST) + f")(?={CUT})"
OUT = ("n_known", "sentence_ids", "n_rules", "license", "licenses")


def sentence_ids(text: Column) -> Column:
    """The identifiers of known sentences in the text, in its order."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    parts = F.lower(F.regexp_replace(F.translate(text, CUT, " "), END, CUT))
    words = F.regexp_replace(F.regexp_replace(parts, f"[^a-z0-9{CUT}]+", " "), f" ?{CUT}[ {CUT}]*", CUT)
    line = F.concat(F.lit(CUT), F.trim(words), F.lit(CUT))
    found = F.transform(F.regexp_extract_all(line, F.lit(FOUND), F.lit(0)), lambda s: F.element_at(known, F.translate(s, CUT, " ")))
    return F.when(text.rlike(MARKERS), found).otherwise(F.array().cast("array<string>"))


def sequence(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def licences(ids: Column) -> Column:
    """Names of the rules that match, in the rules' order; what a rule matches is taken."""
    rules = F.array(*[F.struct(F.lit(sequence(seq)).alias("ids"), F.lit(name).alias("name")) for name, seq in RULES])
    start = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("line"), F.array().cast("array<string>").alias("names"))
    step = lambda acc, r: F.when(acc["line"].contains(r["ids"]), F.struct(F.replace(acc["line"], r["ids"], F.lit("|")).alias("line"), F.concat(acc["names"], F.array(r["name"])).alias("names"))).otherwise(acc)
    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step)["names"]).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with n_known, sentence_ids, n_rules, license and licenses; columns of these names are replaced.

    license: of the first rule that matches. licenses: all different ones, in the rules' order.
    """

    def judged(ids: Column) -> Column:
        return let(
            licences(ids),
            lambda names: F.struct(
                F.size(ids).cast("bigint").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"), F.size(names).cast("bigint").alias("n_rules"),
                F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("license"), F.array_join(F.array_distinct(names), ",").alias("licenses"),
            ),
        )

    judge = let(sentence_ids(F.coalesce(F.col("text"), F.lit(""))), judged)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in OUT], judge.alias("__j")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in OUT], *[F.col("__j")[c].alias(c) for c in OUT]
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *OUT)


def _sql() -> str:
    """The same; each end of a part is doubled, so that sentences that follow each other share none."""
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, s in SENTENCES.items()) + "}"
    any_of = "|".join(x.replace(" ", "(?: |~~)") for x in LONGEST_FIRST)
    chain = "l0"
    for k, (name, seq) in enumerate(RULES):
        chain = f"(SELECT doc_id, ids, replace(line, '{sequence(seq)}', '|') AS line, CASE WHEN contains(line, '{sequence(seq)}') THEN list_append(names, '{name}') ELSE names END AS names FROM {chain})"
    return rf"""
    WITH p AS (SELECT doc_id, lower(regexp_replace(replace(coalesce(text, ''), '~', ' '), '{END}', '~', 'g')) AS t FROM documents WHERE regexp_matches(coalesce(text, ''), '{MARKERS}')),
    w AS (SELECT doc_id, '~~' || replace(trim(regexp_replace(regexp_replace(t, '[^a-z0-9~]+', ' ', 'g'), ' ?~[ ~]*', '~', 'g')), '~', '~~') || '~~' AS t FROM p),
    s AS (SELECT doc_id, list_transform(regexp_extract_all(t, '~({any_of})~', 1), lambda x: ({known})[replace(x, '~~', ' ')]) AS ids FROM w),
    l0 AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS line, []::VARCHAR[] AS names FROM s),
    l AS (SELECT * FROM {chain})
    SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(len(names), 0)::BIGINT AS n_rules, coalesce(names[1], '') AS license,
      coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses FROM (SELECT doc_id FROM documents) d LEFT JOIN l USING (doc_id)"""


ORACLE = _sql()
