"""Spelling variants: words one edit apart, found through PartEnum signatures.

A word is read as the set of its (letter, occurrence) pairs, a binary vector. One inserted
or deleted letter changes one element of it, one replaced letter two. The dimensions are
partitioned (by hash) and the vector without some parts enumerated: vectors at distance
k agree in all parts but k at most, so words at distance k share at least one
signature "all parts but these k". Words of equal length are compared at distance two, words whose
lengths differ by one at distance one; the lengths belong to the signature. Signatures are
joined by equality, and the edit is verified inside the join, so that only true
pairs leave it. No pair is missed: the parts are exact, not sampled.

Signatures are hashed to 64 bits; a collision only costs a verification.

Corpus counts: a worker counts the words of its rows in a dictionary of bounded size, and
sends a word once per dictionary, so that a word that is everywhere is one row per
dictionary and not one per occurrence.

Defined cases: null and empty texts hold no words; a null doc_id reads as empty text in
`<doc_id>:<run>`; equal rows count as often as they occur; runs of any length are words; two
near words of equal count may be forms of none (the ratio decides); of forms of equal
count the smaller in code-point order is taken; an empty table gives an empty one; of other columns, also
of such names as `word`, only doc_id and the text are read.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import map_arrow, map_batches, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Every 199th run by its hash loses a letter (fixed by the query contract).
DROP_MODULUS = 199
#: Entries of a worker's dictionary of words.
COUNTED = 500_000
#: Parts of the dimensions for words of equal length (any two may differ), and for lengths one apart (any one).
PARTS_TWO, PARTS_ONE = 7, 5


def lower_runs(text: str) -> list[str]:
    """Maximal runs of letters; A-Z to lower case, other letters untouched."""
    return RUN.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def drop_letter(doc: bytes, run: str, modulus: int) -> str:
    """The run, without one letter where its hash with the document says so. doc: `<doc_id>:`"""
    h = zlib.crc32(run.encode(), zlib.crc32(doc))
    if h % modulus:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, modulus: int = DROP_MODULUS,
                text: str = "text") -> DataFrame:
    """word, n of every word of at least so many letters and occurrences (stored)."""

    def run(batches):
        total: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for d, x in zip(batch.column("doc_id"), batch.column("text")):
                name = "" if d.as_py() is None else d.as_py()
                doc = f"{name}:".encode()
                for w, n in Counter(lower_runs(x.as_py() or "")).items():
                    if len(w) >= min_length:
                        w = drop_letter(doc, w, modulus)
                        if len(w) >= min_length:
                            total[w] = total.get(w, 0) + n
                if len(total) >= COUNTED:
                    yield out()
                    total = {}
        if total:
            yield out()

    rows = map_arrow(docs.selectExpr("doc_id", f"`{text}` AS text"), run, "word string, n bigint")
    return stored(rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "words")


def signatures(word: str) -> list[tuple[int, int]]:
    """(signature, side) of a word: side 0 for partners of equal length, -1 as the shorter and 1 as
    the longer of two words. A signature is a hash of the elements outside the parts left out (the XOR of
    distinct elements' hashes), of those parts, and of the shorter length."""
    seen: Counter = Counter()
    two, one, every = [0] * PARTS_TWO, [0] * PARTS_ONE, 0
    for c in word:
        h = _hash(f"{c}{seen[c]}")
        seen[c] += 1
        every ^= h
        two[h % PARTS_TWO] ^= h
        one[(h >> 32) % PARTS_ONE] ^= h
    n = len(word)
    rows = [(_hash(f"2 {n} {p} {q} {every ^ two[p] ^ two[q]}"), 0) for p, q in combinations(range(PARTS_TWO), 2)]
    for side, shorter in ((-1, n), (1, n - 1)):
        rows += [(_hash(f"1 {shorter} {p} {every ^ one[p]}"), side) for p in range(PARTS_ONE)]
    return rows


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def signed_words(words: DataFrame) -> DataFrame:
    """sig, side, word, n: one row per signature of every word."""

    def run(t: pa.Table) -> pa.Table:
        rows = [signatures(w) for w in t.column("word").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
        flat = [x for r in rows for x in r]
        return pa.table({"sig": pa.array(np.array([s for s, _ in flat], np.uint64).view(np.int64)),
                         "side": pa.array([k for _, k in flat], pa.int32()),
                         "word": t.column("word").take(at), "n": t.column("n").take(at)})

    return map_batches(words.select("word", "n"), run, "sig bigint, side int, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of every two words that differ by one inserted, deleted or
    replaced code point (stored)."""
    rows = stored(signed_words(words), "word-signatures")

    def side(k, name):
        return rows.filter(F.col("side") == k).select("sig", F.col("word").alias(name), F.col("n").alias(f"n_{name}"))

    one_edit = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    equal = side(0, "a").join(side(0, "b"), "sig").filter((F.col("a") < F.col("b")) & one_edit)
    longer = side(-1, "a").join(side(1, "b"), "sig").filter(one_edit)
    found = stored(equal.union(longer).drop("sig").distinct(), "near-words")
    return found.selectExpr("a AS word", "b AS other", "n_b AS other_n").union(
        found.selectExpr("b", "a", "n_a"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the forms followed to the last. Counts grow along a chain by the ratio, so chains are short
    (the logarithm of the counts), and every round doubles the steps."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5,
             modulus: int = DROP_MODULUS, text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word. A word's form is its near word of the largest
    count (ties: the smallest), where that count is at least `ratio` times the word's own."""
    words = word_counts(docs, min_length, min_count, modulus, text)
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    each = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")),
        "word-forms")
    roots = _roots(each.filter("form IS NOT NULL"))
    return each.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
