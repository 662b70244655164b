"""Host-level quality rules, as DataFrame expressions only.

Every document is measured; its rule failures are summed by host (the `source`
column), and each host's failure rate is shrunk towards the corpus by a beta prior
fitted to all hosts by moments, with the variance that sampling alone explains taken
out. The verdicts are joined back to the documents:

* a host whose shrunk rate for any rule exceeds ``max_rate`` is rejected as a whole;
* a host whose shrunk rate for a rule lies more than ``STAND_OUT`` prior standard
  deviations above the corpus rate stands out in that rule, and its documents that fail
  the rule go. Where the hosts vary no more than sampling does, none stands out.

Defined cases: a null or blank text has no words and fails the base rules; a
null host forms a group of its own; an empty table gives an empty result;
repeated rows are measured and kept one by one; added columns never clash with
those of the input (the measures live in one struct column under a fresh name).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import BROADCAST_ROWS, SPACE, small, stored, words

MIN_WORDS = 50
#: A host is rejected when a rule's shrunk failure rate is above this.
MAX_RATE = 0.75
#: Prior standard deviations above the corpus rate from which a host stands out in a rule.
STAND_OUT = 1.0
#: Correlation within hosts up to which they count as alike (above the rounding of the sums).
ALIKE = 1e-6

#: Rules whose failures are summed by host: SQL over the measures.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def measure(df: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """Add the struct ``into`` with the measures of each text.

    A repeated 3-word window is found by sorting the window hashes (64 bit) of
    one text; the covered words are counted from the sorted window starts."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in df.columns]
    w, h, s = (fresh(df, f"_{into}_{k}") for k in "whs")
    out = df.select(*keep, words(t).alias(w))
    out = out.select(*keep, w, F.expr(
        f"transform(IF(size({w}) < 3, array(), sequence(1, size({w}) - 2)), "
        f"i -> named_struct('h', xxhash64(get({w}, i - 1), get({w}, i), get({w}, i + 1)), 'i', i))"
    ).alias(h))
    # Only texts with a repeated hash need the sort.
    out = out.select(*keep, w, F.expr(
        f"IF(size(array_distinct({h}.h)) = size({h}), slice({h}, 1, 0), sort_array({h}))").alias(s))
    repeated = F.expr(
        f"array_sort(filter({s}, (x, j) -> (j > 0 AND get({s}, j - 1).h = x.h) OR "
        f"(j + 1 < size({s}) AND get({s}, j + 1).h = x.h)).i)")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.select(*keep, w, repeated.alias(s), lines.alias(h))
    covered = F.expr(
        f"aggregate({s}, named_struct('n', 0, 'last', -2), "
        f"(a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x)).n")
    spaces = " \t\n\x0b\x0c\r"
    # A generator of one row: filters and sums over the measures are then planned above it and
    # not copied into it, where the optimizer would repeat the array functions for every use.
    return out.select(*keep, F.explode(F.array(F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, spaces, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(h) - F.size(F.array_distinct(h))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(h).cast("long").alias("n_lines")))).alias(into))


def base_failed(m: str) -> Column:
    return F.expr(f"{m}.n_words < {MIN_WORDS} OR 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def host_verdicts(measured: DataFrame, host: str, m: str, max_rate: float = MAX_RATE) -> DataFrame:
    """host, host_rejected and, per rule, out_<rule> (the host stands out in it): one row per host,
    from partial sums (a hot host is collapsed before the shuffle)."""
    fails = [F.count_if(_rule(sql, m)).cast("double").alias(f"f_{r}") for r, sql in RULES.items()]
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *fails)
    hosts = stored(hosts, "hosts")
    sums = hosts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("t2"),
                     F.count(F.lit(1)).cast("double").alias("h"),
                     *[x for r in RULES for x in (F.sum(f"f_{r}").alias(f"s_{r}"),
                                                  F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}"))])
    prior = sums.select(*[F.expr(x).alias(name) for r in RULES for name, x in
                          ((f"m_{r}", f"s_{r} / t"), (f"v_{r}", correlation(r)))])
    joined = hosts.join(F.broadcast(prior))          # one row
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.expr(shrunk(r)) > max_rate)
    outs = [F.expr(stands_out(r)).alias(f"out_{r}") for r in RULES]
    return stored(joined.select("host", bad.alias("host_rejected"), *outs), "host_verdicts")


def _rule(sql: str, m: str) -> Column:
    for name in MEASURES:
        sql = sql.replace(name, f"{m}.{name}")
    return F.expr(sql)


def correlation(r: str) -> str:
    """SQL over the sums of all hosts: how alike the documents of one host are in failing a rule (1 / (a + b + 1)
    of the beta prior), by moments; the spread of the host rates that sampling explains is taken out."""
    m = f"(s_{r} / t)"
    within = f"{m} * (1 - {m})"
    return (f"CASE WHEN {within} > 0 AND t - t2 / t - (h - 1) > 0 THEN "
            f"(q_{r} - t * {m} * {m} - {within} * (h - 1)) / ({within} * (t - t2 / t - (h - 1))) ELSE 0 END")


def shrunk(r: str) -> str:
    """SQL: posterior mean of a host's failure rate, (f + a) / (n + a + b); the corpus rate where hosts are alike."""
    k = f"(1 / v_{r} - 1)"
    return (f"CASE WHEN v_{r} >= 1 THEN f_{r} / n WHEN v_{r} > {ALIKE} THEN (f_{r} + m_{r} * {k}) / (n + {k}) ELSE m_{r} END")


def stands_out(r: str) -> str:
    return f"v_{r} > {ALIKE} AND {shrunk(r)} > m_{r} + {STAND_OUT} * sqrt(m_{r} * (1 - m_{r}) * least(1, v_{r}))"


def _with_hosts(df: DataFrame, verdicts: DataFrame, host: str, m: str, into: str) -> DataFrame:
    """Add whether the document goes by its host's verdicts."""
    v = small(verdicts.select(F.col("host").alias(f"{into}_host"), F.struct(
        "host_rejected", *[f"out_{r}" for r in RULES]).alias(f"{into}_verdict")), BROADCAST_ROWS)
    goes = F.col(f"{into}_verdict.host_rejected")
    for r, sql in RULES.items():
        goes = goes | (F.col(f"{into}_verdict.out_{r}") & _rule(sql, m))
    return df.join(v, F.col(f"`{host}`").eqNullSafe(F.col(f"{into}_host")), "left") \
        .withColumn(into, F.coalesce(goes, F.lit(False))).drop(f"{into}_host", f"{into}_verdict")


def quality_report(docs: DataFrame, host: str = "source", text: str = "text",
                   max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every document.

    The measures are taken once and stored (narrow rows); the texts are not shuffled."""
    narrow = docs.select("doc_id", F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    m = stored(measure(narrow).drop("text"), "measures")
    out = _with_hosts(m, host_verdicts(m, "host", "m", max_rate), "host", "m", "goes")
    failed = base_failed("m")
    return out.select("doc_id", *[f"m.{k}" for k in MEASURES[:-1]], failed.alias("base_failed"),
                      (~failed & ~F.col("goes")).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text",
              max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that pass, with their own columns. The texts are measured once and stored with
    their measures (those that fail the base rules without the text); no text is shuffled."""
    m, r = fresh(docs, "_measures"), fresh(docs, "_rejected")
    cols = [F.when(~base_failed(m), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    measured = stored(measure(docs, text, m).select(*cols, m), "measured-documents")
    verdicts = host_verdicts(measured.select(F.col(f"`{host}`").alias("host"), F.col(m).alias("m")),
                             "host", "m", max_rate)
    kept = _with_hosts(measured.filter(~base_failed(m)), verdicts, host, m, r)
    return kept.filter(~F.col(r)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle(tail: str) -> str:
    word = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
    rules = ", ".join(f"count_if({sql})::DOUBLE AS f_{r}" for r, sql in RULES.items())
    sums = ", ".join(f"sum(f_{r}) AS s_{r}, sum(f_{r} * f_{r} / n) AS q_{r}" for r in RULES)
    prior = ", ".join(f"s_{r} / t AS m_{r}, {correlation(r)} AS v_{r}" for r in RULES)
    post = [f"{shrunk(r)} > {MAX_RATE}" for r in RULES]
    outs = ", ".join(f"{stands_out(r)} AS out_{r}" for r in RULES)
    return f"""
WITH w0 AS (SELECT row_number() OVER () AS rid, *, {word} AS w,
              list_filter(string_split(coalesce(text, ''), chr(10)),
                          lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS ls FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w0 WHERE len(w) >= 3),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words
        FROM g2, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY rid),
m AS (SELECT w0.* EXCLUDE (w, ls), len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w0 LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source AS host, count(*)::DOUBLE AS n, {rules} FROM b GROUP BY source),
a AS (SELECT sum(n) AS t, sum(n * n) AS t2, count(*)::DOUBLE AS h, {sums} FROM h),
p AS (SELECT {prior} FROM a),
v AS (SELECT host, {' OR '.join(post)} AS host_rejected, {outs} FROM h, p)
{tail}"""


ORACLE = _oracle("""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_rejected""" + "".join(f" OR (out_{r} AND ({sql}))" for r, sql in RULES.items()) + """, false) AS kept
FROM b LEFT JOIN v ON b.source IS NOT DISTINCT FROM v.host""")
