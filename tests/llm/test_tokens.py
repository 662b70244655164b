"""Byte-level coding by the library, and the alignment of two tokenizers."""
import base64
import hashlib
import json
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest

import public_tokenizers as P
from netwarden.llm import byte_tokens as B
from netwarden.llm import token_alignment as TA
from netwarden.llm.bpe import byte_letters
from netwarden.llm.queries import QUERIES

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "banana bananarama anananan", "  two  blanks \n \n x", "a b\x1cc d", "-----========----",
         "日本語のテキスト、日本語。", "🤷🏽‍♀️🤷🏽‍♀️ café naïve", "<|endoftext|> is text", "x" * 3000, "word " * 5000,
         "ab▁cd", "don't we'll 12345 ¿qué?", "the same row", "the same row"]


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return B.Coder(f.read(), P.PATTERN)


def test_rank_rule_and_library_agree_with_tiktoken(coder, tik):
    rng = np.random.default_rng(5)
    for alphabet in ("ab", "ana b", "-= ", "\n  x", "да é", "あい。", "👍🏽 a"):
        for n in rng.integers(1, 80, 150):
            s = "".join(rng.choice(list(alphabet), n))
            want = tik.encode_ordinary(s)
            assert np.frombuffer(coder.encode(s), "<u4").tolist() == want
            assert [i for w in coder.pattern.findall(s) for i in B.by_ranks(w.encode(), coder.ranks)] == want


def test_spans_cover_the_characters_of_every_token(coder, tik):
    for s in filter(None, TEXTS):
        ids, starts, ends = coder.encode_spans(s)
        assert ids.tolist() == tik.encode_ordinary(s)
        got = coder.spans(s.encode(), ids.tolist())
        assert (starts == got[0]).all() and (ends == got[1]).all()
        for i, a, b in zip(ids.tolist(), starts, ends):
            assert tik.decode_single_token_bytes(i) in s[a:b].encode()


def test_every_text_as_tiktoken(spark, docs_of, tik):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in B.token_digests(docs_of(rows), RANKS, P.PATTERN).collect()}
    full = B.encode_documents(docs_of(rows), RANKS, P.PATTERN)
    ids = {r.doc_id: r.ids for r in full.collect()}
    back = {r.doc_id: r for r in B.decode_documents(full, RANKS, P.PATTERN).collect()}
    assert len(got) == len(ids) == len(TEXTS)
    for i, t in rows:
        want = tik.encode_ordinary(t or "")
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert bytes(back[i].data) == (t or "").encode() and back[i].text == (t or "")
    assert B.token_digests(docs_of([]), RANKS, P.PATTERN).count() == 0


def test_decoding_of_parts_of_characters(spark, tik):
    ids = tik.encode_ordinary("🤷")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r for r in B.decode_documents(df, RANKS, P.PATTERN).collect()}
    assert got[1].text == "🤷" and got[2].text == "�" and got[3].text == "" and bytes(got[4].data) == b""


def test_byte_query_over_the_documents(spark, tik):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_byte_tokens"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = tik.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


# --- alignment --------------------------------------------------------------------
def brute_alignment(rows):
    """The contract, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("byte_bpe_50k.json")) as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    back = {c: k for k, c in enumerate(byte_letters())}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, count = [], Counter()
    for d, t in rows:
        ia = a.encode(" " + (t or ""), add_special_tokens=False).ids
        ib = b.encode(t or "")
        sides = []
        for ids, raw in ((ia, lambda i: bytes(back[c] for c in names[i])), (ib, bytes_b)):
            at, ends = b"", []
            for i in ids:
                at += raw(i)
                ends.append(len(at))
            sides.append((ids, ends, at))
        if not t or any(s[2] != b" " + t.encode() for s in sides):
            out.append((d, 0, 0, [], []))
            continue
        cuts = sorted(set(sides[0][1]) & set(sides[1][1]))
        parts = [[[] for _ in cuts] for _ in sides]
        for part, (ids, ends, _) in zip(parts, sides):
            for i, e in zip(ids, ends):
                part[bisect_left(cuts, e)].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in zip(*parts)]
        at_b = dict(zip(sides[1][1], sides[1][0]))          # every token has bytes, so ends are distinct
        links = [(x, at_b[e]) for x, e in zip(*sides[0][:2]) if e in at_b]
        count.update(links)
        out.append((d, len(ia), len(ib), groups, links))
    top = {}
    for (x, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return sorted((d, na, nb, len(g), len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, k in out)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SMALL = [t for t in TEXTS if t is None or len(t) < 200]


def run_alignment(docs):
    return TA.alignment_report(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def test_alignment_of_odd_texts(spark, docs_of):
    rows = [(i // 2, t) for i, t in enumerate(SMALL)]                   # doc_ids repeat
    got = sorted(tuple(r) for r in run_alignment(docs_of(rows)).select(*COLS).collect())
    assert got == brute_alignment(rows)
    assert any(r[1] for r in got) and any(not r[1] for r in got)
    assert run_alignment(docs_of([])).count() == 0
    only = run_alignment(docs_of([(None, "one text"), (7, None)])).collect()
    assert sorted((r.doc_id is None, r.n_links > 0) for r in only) == [(False, False), (True, True)]


def test_alignment_over_many_chunks(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    monkeypatch.setattr(TA, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(TA, "CALL_BYTES", 6_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in run_alignment(df).select(*COLS).collect())
    assert got == brute_alignment(rows)


def test_alignment_query_covers_the_table(spark):
    got = QUERIES["op12_token_alignment"](spark, SF)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == brute_alignment(docs)


def test_chunks_of_earlier_batches_are_not_encoded_again(monkeypatch):
    from tokenizers import Tokenizer
    from netwarden.llm import token_files as TF
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    first, second = [x or "" for x in TEXTS], ["banana of the row", "", "don't " + "y" * 100 + " the", "y" * 100, "new words"]
    want = [[np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(t, add_special_tokens=False)] for t in (first, second)]
    with open(path, "rb") as f:
        spec = f.read()
    for kept in (0, 3, 1 << 20):
        monkeypatch.setattr(TF, "KEPT", kept)
        chunks, asked = TF.Chunked(spec), []
        plain = chunks._ids
        monkeypatch.setattr(chunks, "_ids", lambda c: asked.append(c.to_pylist()) or plain(c))
        assert [chunks.encode_all(t) for t in (first, second, first)] == [*want, want[0]]
        assert len(chunks.known) <= kept
        long = [x for x in asked[0] if len(x.encode()) > TF.KEPT_BYTES]
        assert kept < 1 << 20 or (asked[2] == long and not {"banana", "row", "the", "don't"} & set(asked[1]))
