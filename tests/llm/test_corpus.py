"""Operators over the whole corpus: joins, suffixes, shards, files, language model, pipeline."""
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from netwarden.llm import jaccard_join, lm_score, reshard, suffix_dedup, token_files
from netwarden.llm.components import components

SMALL = "/root/testdata/sf0.001"


def _jaccard(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = {}
    for i, x in enumerate(ids):
        low[top(i)] = min(x, low.get(top(i), x))
    return {x: (len(sets[i]), low[top(i)]) for i, x in enumerate(ids)}


@pytest.mark.parametrize("block", [16, 1024])
def test_jaccard_equals_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    random.seed(3)
    voc = [f"w{i}" for i in range(300)]
    base = [random.choice(voc) for _ in range(100)]
    texts = [None, "", " ", "a b", "A b", "x"]
    for _ in range(90):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(100)] = random.choice(voc)
        texts.append(" ".join(w))
    texts += [" ".join(random.choice(voc) for _ in range(40)) for _ in range(10)] + [texts[10]] * 5
    ids = list(range(50, 50 + len(texts)))
    docs = docs_of(list(zip(ids, texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    want = _jaccard(ids, texts)
    assert got == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in want.values()})


def test_near_copy_stage_takes_five_words_and_80_percent(docs_of, spark):
    import corpus_pipeline
    base = [f"w{i}" for i in range(100)]
    near = base[:-8] + [f"v{i}" for i in range(8)]           # 88 of 104 five-word n-grams: 0.846
    far = base[:-12] + [f"u{i}" for i in range(12)]          # 84 of 108: 0.778
    docs = docs_of([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], parts=1)
    assert corpus_pipeline.near_copies(spark, docs, SMALL).count() == 2
    assert jaccard_join.near_duplicates(docs).filter("doc_id = component_id").count() == 3


def test_keep_one_when_partitions_change(docs_of, spark, monkeypatch):
    from netwarden.llm.common import stored
    random.seed(3)
    texts = [" ".join(random.choice("abcdefghijkl") for _ in range(30)) for _ in range(40)]
    docs = stored(docs_of(list(enumerate(texts + texts[::2])), parts=8), "t-packed")
    find = jaccard_join.near_duplicates

    def then_repack(*args):
        found = stored(find(*args), "t-found")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return found
    monkeypatch.setattr(jaccard_join, "near_duplicates", then_repack)
    try:
        kept = sorted(r.text for r in jaccard_join.keep_one(docs).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert kept == sorted(texts)


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == got[b] for a, b in edges if a != b)
    assert {got[100 + i] for i in range(31)} == {100}
    assert all(got[c] == c and c <= n for n, c in got.items())


def test_suffix_dedup_equals_brute_force(docs_of, monkeypatch):
    for k, v in {"HOT": 8, "TILE": 1000, "CHUNK_BYTES": 20000, "BUCKET_BYTES": 20000}.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    random.seed(5)
    text = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    shared = [text(260), text(200), text(400), text(199)]
    texts = [text(random.randint(0, 200)) + random.choice(shared) + text(random.randint(0, 200)) for _ in range(60)]
    texts += ["a" * 1500, "ab" * 500, "a" * 199, None, "", text(500)] + [texts[3]] * 3
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    docs = docs_of(list(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_report(docs).collect()}
    for k, b in enumerate(data):
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                mark[i:i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        assert got[k] == (len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
    rest = suffix_dedup.remove_repeats(docs, n_chars="n_chars")
    assert rest.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in rest.collect())


def test_coding_round_trip():
    random.seed(9)
    docs = [np.array([random.choice([0, 3, 255, 256, 70000, 2**32 - 1]) for _ in range(n)], np.uint32) for n in (0, 1, 4, 7, 100)]
    assert [x.tolist() for x in token_files.read_block(token_files.write_block(docs))] == [x.tolist() for x in docs]


def test_token_files_equal_the_library(docs_of):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [(7, "Hello, World\x1cx"), (2, None), (5, "é İ; 'S <|ENDOFTEXT|> <|endoftext|>.")] + [(100 + i, f"Text No {i}") for i in range(40)]
    want, at = {}, 0
    for i, t in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = token_files.file_report(docs_of(rows), path, end_id=2, n_ids=49_408).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_chunks_equal_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        chunks = token_files.Chunked(f.read())
    rng = random.Random(3)
    letters = "abXYZ'.,!?$-|<>&#\"019 \t\n\x85\x1c\u3000\u200b\u180e" + "éÉßİıΣςσǅⅠʼ中文。𝒜\u0301\u0338\u0958\u212b\ufb01"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(4000)]
    texts += [f"ab{chr(i)} {chr(i)}Cd, a{chr(i)}b. {chr(i)}.'" for i in range(0x3100)]
    texts += ["<|endoftext|>", "abc<|endoftext|>,", "Abc<|StartOfText|>.", "ab'S don'T we'LL, I'm. x's'.", "the" * 5000 + ",",
              *(f"Word{a}{b}" for a in "abcdefgh" for b in ("", ",", ".", "?!", "\"", "'"))]
    want = [np.array(e.ids, "<u4").tobytes() for e in chunks.lib.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert chunks.encode_all(texts) == want


def test_lm_base_score_and_gain(docs_of):
    random.seed(8)
    chain = {w: [f"w{random.randrange(30)}" for _ in range(2)] for w in (f"w{i}" for i in range(30))}
    rows = [(0, None), (1, "only UNKNOWN")]
    for i in range(2, 120):
        w = ["w1"]
        for _ in range(40):
            w.append(random.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in lm_score.score_documents(docs_of(rows)).collect()}
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    c = collections.Counter(w for i in tokens if train[i] for w in tokens[i])
    n = sum(c.values())
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w)
        r = got[i]
        assert abs(r.base_score - base) < 1e-9 and r.train_tokens == n and r.held_out == (not train[i])
        assert r.n_tokens == len(w) and r.n_known == sum(x in c for x in w)
    held = [r for r in got.values() if r.held_out and r.n_tokens > 3]
    assert held and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)


def test_flow_moves_the_least():
    have, room = [700, 100, 200], [400, 300, 300]
    flow = reshard.min_cost_flow(have, room, lambda i, j: 0 if i == j else 1)
    assert [sum(r) for r in flow] == have and all(sum(r[j] for r in flow) <= room[j] for j in range(3))
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 300


def test_reshard(docs_of, spark, tmp_path):
    from pyspark.sql import functions as F
    rows = [(i, "x" * random.Random(i).randrange(400)) for i in range(400)] + [(None, None), (1, "dup"), (1, "dup")]
    docs = docs_of(rows)
    got = reshard.shard_report(docs, F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 900
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    source = str(tmp_path / "old")
    docs.filter("doc_id IS NOT NULL").distinct().withColumn("shard", F.when(F.col("doc_id") < 100, 0).otherwise(1)) \
        .write.partitionBy("shard").parquet(source)
    out = reshard.rewrite(source, str(tmp_path / "new"), spark, 4)
    total = sum(spark.read.parquet(*p).count() for p in out.values())
    assert total == spark.read.parquet(source).count() and set(out) == {0, 1, 2, 3}


def test_empty_tables(docs_of):
    none = docs_of([(1, "x")]).filter("false")
    assert jaccard_join.near_duplicates(none).count() == 0
    assert suffix_dedup.dedup_report(none).count() == 0
    assert lm_score.score_documents(none).count() == 0
    assert token_files.file_report(none, public_tokenizers.path("word_bpe_49k.json"), 2, 49_408).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from netwarden.llm.common import read, stored
    docs = read(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), f"t-{name}")
        if name != "bpe":
            assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    assert before > 0


def _near(a, b, size=5, percent=80):
    a, b = (frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) for w in (a.lower().split(), b.lower().split()))
    return 100 * len(a & b) >= percent * len(a | b)


def _good(rows):
    """Rows of (doc_id, text, source) that the base rules and the host verdicts leave."""
    measured = []
    for _, t, host in rows:
        w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        seen = collections.Counter(grams)
        repeat = len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)})
        chars = sum(map(len, w))
        measured.append((host, len(w) < 50, 100 * repeat > 50 * len(w), 2 * sum(c in "#*$%&|<>" for c in t) > len(w),
                         10 * (len(lines) - len(set(lines))) > 3 * len(lines), chars < 2 * len(w) or chars > 14 * len(w)))
    size = collections.Counter(m[0] for m in measured)
    n, hosts, bad, out = len(rows), len(size), set(), set()
    for rule in range(1, 6):
        fails = collections.Counter(m[0] for m in measured if m[rule])
        mean = sum(fails.values()) / n
        within, room = mean * (1 - mean), n - sum(x * x for x in size.values()) / n - (hosts - 1)
        spread = sum(x * (fails[h] / x - mean) ** 2 for h, x in size.items())
        alike = (spread - within * (hosts - 1)) / (within * room) if within > 0 and room > 0 else 0
        k = 1 / min(alike, 1) - 1 if alike > 1e-6 else float("inf")
        for h, x in size.items():
            rate = mean if k == float("inf") else (fails[h] + mean * k) / (x + k)
            if rate > 0.75:
                bad.add(h)
            if alike > 1e-6 and rate > mean + (within * min(alike, 1)) ** 0.5:
                out.add((h, rule))
    return [r for r, m in zip(rows, measured) if not m[1] and not m[2] and m[0] not in bad
            and not any(m[rule] and (m[0], rule) in out for rule in range(3, 6))], bad


def test_quality_equals_brute_force(docs_of):
    # symbols are frequent on host s alone: its documents that fail that rule go, those of other hosts stay
    from netwarden.llm import quality_rules
    good = " ".join(f"word{i} and" for i in range(40))
    rng = random.Random(2)
    rows = [(i, good + (" " + "#" * 100 if i % 6 == 0 and rng.random() < 0.5 or i % 40 == 1 else "")
             + (("\nline" * 60) if i % 35 == 2 else ""), "s" if i % 6 == 0 else f"h{i % 6}") for i in range(600)]
    kept, bad = _good(rows)
    want = {i for i, _, _ in kept}
    got = quality_rules.quality_report(docs_of([r[:2] for r in rows], {i: h for i, _, h in rows})).collect()
    gone = {r.doc_id for r in got if not r.kept and not r.base_failed}
    assert not bad and {r.doc_id for r in got if r.kept} == want
    assert gone and all(i % 6 == 0 for i in gone)
    assert any("#" in t and i % 6 and i in want for i, t, _ in rows)


def test_pipeline_equals_a_plain_chain(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from netwarden.llm import decontaminate
    from test_rows import _edits
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 90)), f"h{i % 4}") for i in range(24)]
    swap = lambda t, n: " ".join(t.split()[:-n] + prose(n).split())
    rows += [(30, rows[0][1], "h0"), (31, swap(rows[1][1], 4), "h1"), (32, swap(rows[2][1], 30), "h2")]    # copy, near, far
    passage = prose(40)
    rows += [(40 + i, f"{prose(55)} {passage} {prose(5)}", "h3") for i in range(3)]
    items = [(1, prose(14)), (2, prose(14)), (3, prose(14))]
    rows += [(50, f"{prose(30)} {items[0][1].upper()}! {prose(30)}", "h0"),
             (51, f"{prose(30)} {items[1][1][:20]}{items[1][1][22:]} {prose(30)}", "h1")]
    rows += [(60, "short", "h0"), (61, "a b c " * 40, "h1")] + [(70 + i, prose(70 if i < 1 else 9), "bad") for i in range(20)]
    spark.createDataFrame([(i, t, "en", h, len(t)) for i, t, h in rows],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want = {}
    kept, bad = _good(rows)
    assert bad == {"bad"}
    want["quality_rules"] = {i: t for i, t, _ in kept}
    first, up = [], {}
    texts = list(want["quality_rules"].items())
    for i, t in texts:
        twin = [up[j] for j, x in texts[:len(up)] if _near(t, x)]
        up[i] = min(twin, default=i)
        if not twin:
            first.append(i)
    want["jaccard_join"] = {i: t for i, t in texts if i in first}
    seen = collections.Counter(t[i:i + 200] for t in want["jaccard_join"].values() for i in range(len(t) - 199))
    rest = {}
    for i, t in want["jaccard_join"].items():
        gone = {k for j in range(len(t) - 199) if seen[t[j:j + 200]] > 1 for k in range(j, j + 200)}
        rest[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    want["suffix_dedup"] = rest
    norm = decontaminate.normal
    want["decontaminate"] = {i: t for i, t in rest.items()
                             if all(_edits(norm(x), norm(t)) > int(len(norm(x)) * 0.1) for _, x in items)}
    assert [len(x) for x in want.values()] == [32, 30, 30, 28] and rest != want["jaccard_join"]

    steps, store = {}, corpus_pipeline.finished

    def spy(make, name):
        steps[name.removeprefix("pipeline-")] = out = store(make, name)
        return out
    monkeypatch.setattr(corpus_pipeline, "finished", spy)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for name, texts in want.items():
        got = steps[name].collect()
        assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((i, t, len(t)) for i, t in texts.items()), name
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in want["decontaminate"].items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(tuple, last)) == sorted((i, len(x), sha(np.array(x, "<u4").tobytes()),
                                               sha(want["decontaminate"][i].encode())) for i, x in ids.items())
