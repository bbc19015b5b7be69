"""Cases in which an operator once did less than its whole job."""

import re

import numpy as np
import pytest

import corpus_pipeline
from kinloom.llm import license_scan, ngram_jaccard, secret_scan

from test_methods import brute_components


def word_sets(texts, size):
    cut = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()} for w in cut]


def edited(rng, words, times):
    out = list(words)
    for k in rng.choice(len(out), times, replace=False):
        out[k] = f"n{rng.integers(0, 9)}"
    return out


def test_pipeline_drops_near_copies_by_five_words(spark):
    rng, texts = np.random.default_rng(0), []
    for size, times in ((50, 1), (100, 2), (1000, 20)):
        base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        copy = list(base)
        for k in range(times):
            copy[(2 * k + 1) * size // (2 * times)] = "changed"
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 4]


@pytest.mark.parametrize("seed, small_block", [(0, 8), (1, 0)])
def test_jaccard_of_other_limits_against_brute_force(spark, seed, small_block):
    rng, texts = np.random.default_rng(seed), ["", "a", "a b c d", "A b  c d"]
    for size in (6, 7, 9, 12, 13, 30, 47, 60, 148, 300):
        base = [f"w{x}" for x in rng.integers(0, 1000, size)]
        texts += [" ".join(edited(rng, base, rng.integers(0, max(2, size // 20)))[: size - rng.integers(0, 1 + size // 8)]) for _ in range(14)]
    sets = word_sets(texts, 5)
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = ngram_jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ngram_jaccard.Join(5, 4, 5, small_block)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(range(len(texts)), linked)


NOTICES = {
    "apache-the,apache-use,apache-copy": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law""",
    "gpl3-free,gpl-copy": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "gpl2-free,gpl-copy": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program; if not, write to the Free Software""",
    "mit-grant,mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "bsd-redist,bsd-source,bsd-binary": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "mpl2": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this""",
    "gpl3-work": "This work is licensed under the GNU General\nPublic License, version 3.",
    "apache-short": "Licensed under the\nApache License, Version 2.0.", "mit-short": "Released under\nthe MIT License.", "mit-licensed": "Licensed under the MIT\nLicense.",
    "cc-by-nc": "Licensed under\nCC BY-NC 4.0.", "cc-by-sa": "Licensed under\nCC BY-SA 4.0.", "cc-by": "Licensed under\nCC BY 4.0.", "cc0": "Released under the\nCC0 1.0 license.",
}


def test_licences_of_real_notices(spark):
    rules = dict(reversed([(",".join(ids), name) for name, ids in license_scan.RULES]))
    want = {ids: rules.get(ids) or rules[ids.split(",")[0]] for ids in NOTICES}
    rows = [x for ids, t in NOTICES.items() for x in ((ids, t), (ids, "Copyright 2020 A.\n\n" + re.sub(r"(?<!\n)\n(?!\n)", " ", t) + "\n\nmore"), (ids, t.replace("\n", "\r\n")))]
    got = license_scan.scan(spark.createDataFrame(rows, "want string, text string")).collect()
    assert [(r.sentence_ids, r.license) for r in got] == [(ids, want[ids]) for ids, _ in rows]
    inside = spark.createDataFrame([("not released under the MIT License",), ("released under the MIT License agreement",)], "text string")
    assert [r.license for r in license_scan.scan(inside).collect()] == ["", ""]


def test_random_strings_of_one_case_and_beside_words():
    encode = secret_scan.encoding(secret_scan.default_ranks()).encode_ordinary
    found = lambda t: secret_scan.random_spans(t, [], encode)
    rng = np.random.default_rng(0)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        assert sum(bool(found("".join(rng.choice(list(letters), 24)))) for _ in range(200)) > 170
    secret = "IVYw5LSh48X14RmP"
    for before in ("authorization_bearer_credential=", "authorization/bearer/credential/information/"):
        assert found(before + secret) == [(len(before), 3, len(before) + 16)]
    for known in ("a/b/c/d/e/f/g/h/i/j", "------------------------", "hahahahahahahahahaha", "src/main/java/com/example/Application", "TRANSACTION_STATUS_UPDATED"):
        assert not found(known)
