"""Licence sentences by their official texts, several licences in one document, and the SQL on wrapped notices."""

import duckdb
import pytest

from kinloom.llm import license_scan

from test_whole import NOTICES

OFFICIAL = {
    "Apache-2.0": """Licensed to the Apache Software Foundation (ASF) under one
or more contributor license agreements.  See the NOTICE file
distributed with this work for additional information
regarding copyright ownership.  The ASF licenses this file
to you under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at

  http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied.  See the License for the
specific language governing permissions and limitations
under the License.""",
    "LGPL-2.1-or-later": """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# This library is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
# Lesser General Public License for more details.
#
# You should have received a copy of the GNU Lesser General Public
# License along with this library; if not, write to the Free Software""",
    "AGPL-3.0-or-later": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Affero General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; version 2.""",
    "BSD-3-Clause": """BSD 3-Clause License

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)",
    "EPL-2.0": """ * This program and the accompanying materials are made
 * available under the terms of the Eclipse Public License 2.0
 * which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "EPL-1.0": """All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html""",
    "MPL-1.1": 'The contents of this file are subject to the Mozilla Public License Version\n1.1 (the "License"); you may not use this file except in compliance with\nthe License.',
    "CDDL": 'The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the "License").',
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
    "GPL-3.0-or-later": "/* SPDX-License-Identifier: GPL-3.0-or-later */",
    "ISC": "ISC License\n\nPermission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


def test_official_texts(spark):
    rows = list(OFFICIAL.items())
    got = license_scan.scan(spark.createDataFrame(rows, "want string, text string")).collect()
    assert {r.want: r.license for r in got} == {k: k for k in OFFICIAL}


def test_every_known_sentence_is_found_by_itself(spark):
    rows = [(i, s.upper()) for i, s in license_scan.SENTENCES.items()] + [(i, "// ...\n// " + "\n# ".join(s.split()) + ".") for i, s in license_scan.SENTENCES.items()]
    got = license_scan.scan(spark.createDataFrame(rows, "want string, text string")).collect()
    assert len(license_scan.SENTENCES) > 60 and all(r.sentence_ids == r.want for r in got)


def test_all_licences_of_a_document(spark):
    text = "\n\n".join([NOTICES["mit-grant,mit-notice"], NOTICES["cc-by"], OFFICIAL["BSD-3-Clause"], NOTICES["mit-short"]])
    (r,) = license_scan.scan(spark.createDataFrame([(text,)], "text string")).collect()
    assert (r.license, r.licenses) == ("MIT", "MIT,BSD-3-Clause,CC-BY-4.0")


@pytest.mark.parametrize("join", ["\n", " "])
def test_sql_on_notices(spark, join):
    texts = [t.replace("\n", join) for t in (*NOTICES.values(), *OFFICIAL.values())] + ["", None, "~ released under the MIT License ~", "released under the MIT License agreement"]
    docs = list(enumerate(texts))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = con.sql(f"SELECT doc_id, {', '.join(license_scan.OUT)} FROM ({license_scan.ORACLE}) ORDER BY doc_id").fetchall()
    assert sorted((r.doc_id, *(r[c] for c in license_scan.OUT)) for r in got) == want
