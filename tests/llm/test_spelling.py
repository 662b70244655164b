"""Spelling variants against a comparison of all words."""
import zlib
from collections import Counter

from netwarden.llm import spelling_variants as SV
from netwarden.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute(rows, modulus=199):
    n = Counter()
    for d, t in rows:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                if h % modulus == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                n[run] += 1
                run = ""
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in words:
        some = [x for x in words if one_edit(w, x)]
        near[w] = len(some)
        best = min(some, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), k, near[w], words[form[w]] if w in form else 0) for w, k in words.items())


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0)
                  for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_edits_of_every_kind(spark, docs_of):
    texts = [("colour", 160), ("color", 20), ("colors", 30), ("colours", 6), ("colourss", 5), ("kolour", 5), ("colouur", 25),
             ("Éclairs", 9), ("éclairs", 50), ("aaaaaa", 5), ("aaaaaaa", 25), ("aaaaaaaa", 125), ("abcdef", 5), ("abcdfe", 100),
             ("shorts", 4), ("short", 99), ("überall", 7), ("ÜBERALL", 40)]
    rows = [(k, f"{w}, " * n) for k, (w, n) in enumerate(texts)] + [(90, None), (91, ""), (None, "colour colour"), (0, "colour 12 x" * 3)]
    got = rows_of(SV.variants(docs_of(rows)))
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][1:3] == ("aaaaaaa", "aaaaaaaa")            # a chain of two
    assert by["colouur"][1] == "colour" and by["abcdef"][1] == ""  # two letters swapped are two edits
    assert SV.variants(docs_of([])).count() == 0


def test_dropped_letters_and_small_dictionaries(spark, docs_of, monkeypatch):
    rows = [(d, "Repeated Passage about Dictionaries " * 3) for d in range(60)]
    monkeypatch.setattr(SV, "COUNTED", 10)
    got = rows_of(SV.variants(docs_of(rows), modulus=5))
    assert got == brute(rows, 5)
    assert any(r[1] for r in got)


def test_signatures_join_all_pairs_one_edit_apart():
    words = ["abcdef", "abcdeg", "abcdefg", "bcdefg", "aabbcc", "aabbccc", "zzzzzzzzzzzz", "zzzzzzzzzzzzz", "çabcde", "çabcdé"]
    sig = {w: SV.signatures(w) for w in words}
    for a in words:
        for b in words:
            if one_edit(a, b):
                want = {(0, 0)} if len(a) == len(b) else {(-1, 1)} if len(a) < len(b) else {(1, -1)}
                assert any(x == y and (s, t) in want for x, s in sig[a] for y, t in sig[b])


def test_query_over_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(QUERIES["op11_spelling_variants"](spark, SF))
    assert got == brute(docs) and len(got) > 100
