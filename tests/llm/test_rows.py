"""Operators that work row by row: quality rules, licences, HTML, BPE, decontamination."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from netwarden.llm import bpe, decontaminate, html_extract, license_scan, quality_rules

GOOD = " ".join(f"word{i} and" for i in range(40))


def test_quality_edges(docs_of):
    rows = [(1, None), (2, ""), (3, GOOD), (3, GOOD), (4, "a b c " * 40), (None, GOOD), (5, "x\nx\n\nx")]
    got = quality_rules.quality_report(docs_of(rows, {4: None})).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[3].kept and by[None].kept and not by[3].base_failed
    assert by[4].n_repeat_words == 120 and by[4].base_failed
    assert by[5].n_dup_lines == 2
    kept = quality_rules.keep_good(docs_of(rows, {4: None}))
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 3]


def test_quality_rejects_a_bad_host(docs_of):
    rows = [(i, "short" if i < 95 else GOOD) for i in range(100)] + [(i, GOOD) for i in range(100, 200)]
    sources = {i: "bad" if i < 100 else f"h{i % 4}" for i in range(200)}
    kept = {r.doc_id for r in quality_rules.keep_good(docs_of(rows, sources)).collect()}
    assert kept == set(range(100, 200))


def test_empty_tables(docs_of, spark):
    none = docs_of([(1, "x")]).filter("false")
    assert quality_rules.quality_report(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert bpe.encode_digest(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    bench = spark.createDataFrame([(1, "some passage of the benchmark")], "item_id long, text string")
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs_of([(1, "x")]), bench.filter("false")).count() == 0


def test_license_rules(docs_of):
    rows = [(1, "Intro.\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, None),
            (4, "This program is free software: you can. Distributed under the GNU General Public License, version 3; "
                "or at your option any later version."), (5, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (6, "license")]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(rows)).collect()}
    assert got[1].licenses == "Apache-2.0" and got[2].licenses == "MIT" and got[3].licenses == ""
    assert got[4].licenses == "GPL-3.0-or-later" and got[5].licenses == "CC-BY-NC,Proprietary"
    assert got[6].n_sentences == 0


def test_license_notices_in_their_usual_form(docs_of):
    mit = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
    bsd = """ * Copyright (c) 2017, Some Body, Inc.
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer.
%s *
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
 * "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
    third = """ * 3. Neither the name of Some Body, Inc. nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software.
"""
    gnu = """This %s is free software%s you can redistribute it and/or modify
it under the terms of the GNU %sGeneral Public License as published by
the Free Software Foundation%s either version %s of the License, or
(at your option) any later version.

It is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY.  See the GNU General Public License for more details."""
    spdx = "# SPDX-License-Identifier: %s\nimport os"
    cases = [(mit, "MIT"), (mit.replace("\n\n", "\n"), "MIT"), (bsd % third, "BSD-3-Clause"), (bsd % "", "BSD-2-Clause"),
             (gnu % ("program", ":", "", ",", "3"), "GPL-3.0-or-later"), (gnu % ("program", ";", "", ";", "2"), "GPL-2.0-or-later"),
             (gnu % ("library", ";", "Lesser ", ";", "2.1"), "LGPL"), (gnu % ("program", ":", "Affero ", ",", "3"), "AGPL"),
             (spdx % "MIT", "MIT"), (spdx % "Apache-2.0", "Apache-2.0"), (spdx % "BSD-3-Clause", "BSD-3-Clause"),
             (spdx % "BSD-2-Clause", "BSD-2-Clause"), (spdx % "GPL-3.0-only", "GPL-3.0"), (spdx % "GPL-2.0", "GPL-2.0"),
             (spdx % "GPL-2.0-or-later", "GPL-2.0-or-later"), (spdx % "GPL-3.0+", "GPL-3.0-or-later"),
             (spdx % "LGPL-2.1-only", "LGPL"), (spdx % "AGPL-3.0", "AGPL"), (spdx % "MPL-2.0", "MPL-2.0"),
             (spdx % "(MIT OR Apache-2.0)", "Apache-2.0,MIT"),
             ("Released under the MIT License\nLicensed under the Apache License, Version 2.0\n", "Apache-2.0,MIT")]
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs_of([(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class=has-sidebar>
<header><a href=/>Home</a></header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy, now, this.</div><div id=cookie-notice>We use cookies, sure.</div>
<article><h1>Title &amp; more</h1><p><b>One, two,<br>three&nbsp;four<p>Five <i>six</i>.</p><ul><li>item<li>other</ul>
<div class="share-buttons">Share</div><script>var a="</p>";</script></article>
<section class="comments"><article class="comment"><p>A long, long, reader comment, really.</p></article></section>
<aside>Aside</aside><form><p>Form</p></form><footer>&copy; me</footer>"""


def test_html():
    assert html_extract.extract(PAGE) == "Title & more\nOne, two, three four\nFive six.\nitem\nother"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""
    assert html_extract.extract("<div><p>plain, text &lt;b&gt; &am") == "plain, text <b> &am"
    assert html_extract.extract("<div>" * 5000 + "deep") == "deep"
    assert html_extract.extract("a < b") == "a < b"


def test_html_names_of_wrappers():
    paras = [f"Paragraph {i} of the text, with a clause, and some more words to read in it." for i in range(8)]
    body, want = "".join(f"<p>{x}</p>" for x in paras), "\n".join(paras)
    side = '<div class="cookie-notice">We use cookies, sure.</div><div class="sidebar-left"><p>Popular, short, now.</p></div>'
    foot = '<div class="comments-area"><p>A reader comment, rather long, really.</p></div><footer>&copy; me</footer>'
    for name in ("elementor-widget elementor-widget-text-editor", "layout sidebar-right", "site nav-fixed",
                 "post comment-enabled", "entry share-enabled", "widget", "related"):
        inner = f'<div class="{name}">{body}<div class="share-buttons">Share</div></div>'
        assert html_extract.extract(f"<nav>Menu</nav>{side}<div class=page>{inner}</div>{foot}") == want, name
    some = "".join(f'<div class="elementor-widget elementor-widget-text">{x}</div>' for x in paras)
    assert html_extract.extract(f"<div class=page>{some}</div>{foot}") == want
    for name in ("widget", "related", "notice", "notice-text", "alert alert-info"):
        page = f'<article>{body}<p class="{name}">{paras[0]}</p><div class="related-posts"><a href=x>{paras[1]}</a></div></article>{foot}'
        assert html_extract.extract(page) == want + "\n" + paras[0], name
    # the names still count: small boxes go, a long one does not outweigh the text
    assert html_extract.extract(f'<div class=page>{body}</div><div class="comments-area">{body[:260]}</div>') == want
    talk = "".join(f"<p>Comment {i} by a reader, with a view, and more to say about all that.</p>" for i in range(20))
    for name in ("text", "post share-enabled"):
        assert html_extract.extract(f'<div class="{name}">{body}</div><div class="comments-area">{talk}</div>') == want
    assert html_extract.extract(f"<div class=sidebar>{body}</div><article><p>Short, plain text.</article>") == "Short, plain text."


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = html_extract.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got)[0] == 0 and len(got) == 3


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(path)


def test_bpe_equals_the_library(byte_bpe):
    own, lib = byte_bpe
    random.seed(4)
    bits = list(" \n\t\x1c\xa0abcXÉñß中😀é'st0٣½.,<|>_") + ["<|endoftext|>", "  ", "\n\n", " the", "ing"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 500, "", "\n \n  x ", "ab " * 2000]
    own.prepare(texts)
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_bpe_rows(docs_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in bpe.encode_documents(docs_of([(1, None), (2, "hello world")]), path).collect()}
    assert got[1].n_tokens == 0 and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].decoded == "hello world" and len(got[2].ids) == got[2].n_tokens


def _edits(a, b):
    """fewest edits of a against any piece of b"""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(docs_of, spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    items = [" ".join(word() for _ in range(random.randint(8, 25))) for _ in range(12)] + ["abc", "", "!!", None]
    texts = [None, "", "abc"]
    for k in range(60):
        body = list(random.choice(items[:12]))
        for _ in range(random.randint(0, len(body) // 6)):
            i = random.randrange(len(body))
            body[i:i + 1] = random.choice([[], [random.choice("abcdefgh")], [body[i], "z"]])
        texts.append(" ".join(word() for _ in range(k % 30)) + " " + "".join(body).upper() + "! " + word())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs_of(list(enumerate(texts)))
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = decontaminate.normal(x or ""), decontaminate.normal(t or "")
            if a:
                e = _edits(a, b)
                if e <= int(len(a) * decontaminate.MAX_EDITS):
                    want[d, i] = e
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_index_belongs_to_its_block():
    class Block:
        def __init__(self, value):
            self.value = value

    for k in range(50):                          # freed handles, whose addresses are used again
        assert decontaminate._index(decontaminate._Ref(Block([(k, f"item {k} of a benchmark")]))).ids == [k]


def test_short_items_with_edits_equal_brute_force():
    random.seed(7)
    some = lambda n: bytes(random.choice(b"abcdefgh") for _ in range(n))
    items = [some(m) for m in range(8, 41)]
    index = decontaminate.Items([(i, b.decode()) for i, b in enumerate(items)])
    for _ in range(6):
        for b in items:
            body, e = bytearray(b), int(len(b) * decontaminate.MAX_EDITS)
            for x in range(e):                       # spread evenly, so that few 8-grams stay whole
                at = len(b) * (x + 1) // (e + 1)
                body[at:at + 1] = random.choice([b"", b"z", body[at:at + 1] + b"z"])
            text = some(random.randrange(30)) + bytes(body) + some(random.randrange(30))
            want = [(i, n) for i, x in enumerate(items)
                    if (n := _edits(x, text)) <= int(len(x) * decontaminate.MAX_EDITS)]
            assert index.find(text) == want


def test_host_verdict_decides_on_the_given_table(spark):
    # sf0.01: failures of the repeated-line rule cluster on hosts more than sampling explains, so the hosts that
    # stand out lose the documents that fail it
    from netwarden.llm.common import read
    got = quality_rules.quality_report(read(spark, "/root/testdata/sf0.01", "documents"))
    gone = got.filter("kept = base_failed").collect()
    assert gone and all(r.n_dup_lines > 0 and not r.kept for r in gone)


def test_spdx_expression_of_any_length(docs_of):
    many = " OR ".join(["GPL-2.0-or-later", *["LicenseRef-something-quite-long-" + "x" * 40 + str(i) for i in range(30)],
                        "(BSD-3-Clause AND Apache-2.0)", "MIT"])
    rows = [(1, f"SPDX-License-Identifier: {many}"), (2, "// SPDX-License-Identifier: GPL-2.0+ AND MIT\nint x;")]
    got = {r.doc_id: set(r.licenses.split(",")) for r in license_scan.scan(docs_of(rows)).collect()}
    assert got[1] == {"GPL-2.0-or-later", "BSD-3-Clause", "Apache-2.0", "MIT"}
    assert got[2] == {"GPL-2.0-or-later", "MIT"}
