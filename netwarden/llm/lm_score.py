"""Language-model scores by deleted interpolation.

The model mixes the bigram maximum-likelihood estimate with the smoothed unigram
estimate, P(w|h) = a c(h,w)/c(h) + (1 - a) P0(w), where the weight a depends on the
frequency bucket of the context (powers of two of c(h)). The weights are learned by
expectation-maximisation on held-out counts: each training bigram is held out in turn
(its own occurrence is deleted from the counts).

How it runs: documents are tokenized into chunks of about half a million tokens (stored
compactly: distinct word hashes and token indexes). A chunk counts its own words and
bigrams first and sends each distinct key once, packed in arrays, to a hash bucket;
buckets sum the counts over all chunks and send them back to the chunks that hold the
keys. So a very common word or pair is one key per chunk, not one row per occurrence.
Keys are 64-bit hashes. Chunks and counts are stored bucketed by chunk, so that the two
later passes (weights, scores) join them without another shuffle.

Defined cases: a null or empty text is one end token; rows with a null doc_id are held
out and do not train; repeated rows train once each; without training tokens every token
is unknown and both scores come from the smoothed unigrams; an empty table gives an empty
result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import map_arrow
from netwarden.llm.packed import chunked, counts_of, mix, packed_rows, rows_of, tokens_of, with_counts

SMOOTH = 0.1
START, END = np.uint64(0x51A7B3C9D2E4F601), np.uint64(0xE2D1C0B9A8978685)
#: Frequency buckets of contexts, and bins of log2(bigram / unigram estimate) per octave.
LEVELS, OCTAVE, BINS = 40, 32, 4096


class Chunk:
    """The arrays of one stored chunk."""

    def __init__(self, row: dict):
        lens, words, tokens = tokens_of(row)
        ends = np.cumsum(lens + 1) - 1
        n = int(ends[-1]) + 1
        seq = np.full(n, END)
        inner = np.ones(n, bool)
        inner[ends] = False
        seq[inner] = words[tokens]
        prev = np.empty(n, np.uint64)
        prev[1:] = seq[:-1]
        prev[0] = START
        prev[ends[:-1] + 1] = START
        self.lens, self.starts = lens, ends - lens
        self.train = np.array(row["train"], bool)
        #: distinct words with END, and the position of each token in them
        self.words, at = np.unique(np.append(words, END), return_inverse=True)
        self.word = np.full(n, at[-1])
        self.word[inner] = at[tokens]
        self.end = int(at[-1])
        self.pairs, self.first, self.pair = np.unique(mix(prev, seq), return_index=True, return_inverse=True)
        self.weight = np.repeat(self.train, lens + 1)
        #: position of each distinct pair's context in the words; -1: the start
        context = np.empty(n, np.int64)
        context[1:] = self.word[:-1]
        context[self.starts] = -1
        self.context = context[self.first]

    def trained(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at[self.weight], minlength=size)


def _emit(bits: int):
    def run(batches):
        for row in rows_of(batches):
            c = Chunk(row)
            yield packed_rows(row["chunk"], [(0, c.words, c.trained(c.word, len(c.words))),
                                             (1, c.pairs, c.trained(c.pair, len(c.pairs)))], bits)
    return run


def _counted(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk, the corpus counts of its words and of its pairs."""
    c = Chunk(row)
    word, pair = (counts_of(row, k).astype(np.float64) for k in (0, 1))
    if len(word) != len(c.words) or len(pair) != len(c.pairs):
        raise ValueError("counts do not belong to this chunk")
    return c, word, pair


def _level(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), LEVELS - 1)


def _held_out(types: int, tokens: int):
    """Per context bucket: held-out tokens by the ratio of the two deleted estimates (bin 0: bigram unseen)."""
    def run(batches):
        total = np.zeros(LEVELS * (BINS + 1))
        for row in rows_of(batches):
            c, word, pair = _counted(row)
            n = c.trained(c.pair, len(c.pairs))
            use = np.flatnonzero(n)
            context = np.where(c.context < 0, word[c.end], word[c.context])[use]
            f = (pair[use] - 1) / np.maximum(context - 1, 1)
            p0 = (word[c.word[c.first[use]]] - 1 + SMOOTH) / (tokens - 1 + SMOOTH * (types + 1))
            bins = np.clip(np.round(np.log2(np.maximum(f, 1e-300) / p0) * OCTAVE) + BINS // 4, 1, BINS)
            slot = _level(context) * (BINS + 1) + np.where(f > 0, bins, 0).astype(np.int64)
            total += np.bincount(slot, weights=n[use], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["slot", "n"])
    return run


def mixture_weights(slots: dict[int, float], rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation for each context bucket over its held-out counts."""
    hist = np.zeros((LEVELS, BINS + 1))
    for k, n in slots.items():
        hist[divmod(k, BINS + 1)] = n
    ratio = np.append(0.0, 2.0 ** ((np.arange(1, BINS + 1) - BINS // 4) / OCTAVE))
    total = hist.sum(1)
    a = np.where(total > 0, 0.5, 0.0)
    for _ in range(rounds):
        share = a[:, None] * ratio
        new = (hist * (share / np.maximum(share + 1 - a[:, None], 1e-300))).sum(1) / np.maximum(total, 1)
        done = np.abs(new - a).max() < 1e-9
        a = new
        if done:
            break
    return np.minimum(a, 1 - 1e-6)


def _score(types: int, tokens: int, weights: list[float]):
    a = np.array(weights)

    def run(batches):
        for row in rows_of(batches):
            c, word, pair = _counted(row)
            p0 = (word + SMOOTH) / (tokens + SMOOTH * (types + 1))
            context = np.where(c.context < 0, word[c.end], word[c.context])
            f = pair / np.maximum(context, 1)
            w = np.where(context > 0, a[_level(context)], 0.0)
            p = np.log10(w * f + (1 - w) * p0[c.word[c.first]])
            k = len(c.lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(~c.train), pa.array(c.lens + 1),
                 pa.array(np.add.reduceat((word > 0)[c.word].astype(np.int64), c.starts)),
                 pa.array(np.full(k, tokens), pa.int64()),
                 pa.array(np.add.reduceat(np.log10(p0)[c.word], c.starts)),
                 pa.array(np.add.reduceat(p[c.pair], c.starts))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    chunks, files, bits = chunked(docs, "doc_id", text, F.coalesce(fold != 0, F.lit(False)))
    joined, totals = with_counts(chunks, _emit(bits), files)
    total = totals.filter("kind = 0").agg(
        F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    slots = map_arrow(joined, _held_out(total.types, total.tokens), "slot bigint, n double") \
        .groupBy("slot").agg(F.sum("n").alias("n")).collect()                  # at most LEVELS x BINS rows
    weights = mixture_weights({r.slot: r.n for r in slots}).tolist()
    return map_arrow(joined, _score(total.types, total.tokens, weights), SCORES)
