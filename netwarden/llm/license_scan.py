"""Licence scan by sentence rules, as DataFrame expressions only.

1. A text is cut into sentences at full stops, semicolons and blank lines (wrapped lines
   are joined, an SPDX line stands alone), each sentence is normalised (lower case,
   everything but letters and digits to one blank).
2. Every known licence sentence in it gets its identifier, in the order of the text.
3. The document's identifier sequence is matched against ordered licence rules;
   each rule names a licence, and identifiers that a rule has used are taken out
   before the next rule is tried.

All of it happens inside the row, in array functions: no shuffle, no join.

Defined cases: a null or empty text has no sentences and no licence; a repeated
sentence repeats its identifier; repeated rows give repeated results; an empty
table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identifiers of known licence sentences and the pattern of the
# normalised sentence. The SQL is made of them as they stand, one identifier to a line;
# the scan takes the wider FORMS and READ that follow from them below.
_UNDER = "^.*\\b(licensed|released|distributed|available|provided|covered)( \\w+)? (under|by)( the)?( terms of)?( the)? "
SENTENCES: list[tuple[str, str]] = [
    ("spdx_apache_2", "spdx license identifier apache 2 0"),
    ("spdx_mit", "spdx license identifier mit\\b"),
    ("spdx_bsd_3", "spdx license identifier bsd 3 clause"),
    ("spdx_bsd_2", "spdx license identifier bsd 2 clause"),
    ("spdx_gpl_3", "spdx license identifier gpl 3 0"),
    ("spdx_gpl_2", "spdx license identifier gpl 2 0"),
    ("spdx_lgpl", "spdx license identifier lgpl"),
    ("spdx_agpl", "spdx license identifier agpl"),
    ("spdx_mpl_2", "spdx license identifier mpl 2 0"),
    ("ref_apache_2", _UNDER + "apache( software)? license( version)? 2( 0)?\\b"),
    ("ref_apache_other", _UNDER + "apache( software)? license\\b"),
    ("ref_mit", _UNDER + "mit( x11| expat)? license\\b"),
    ("ref_bsd_3", _UNDER + "(bsd 3 clause|3 clause bsd|new bsd|modified bsd)\\b"),
    ("ref_bsd_2", _UNDER + "(bsd 2 clause|2 clause bsd|simplified bsd)\\b"),
    ("ref_bsd", _UNDER + "bsd\\b"),
    ("ref_agpl", _UNDER + "(gnu )?(affero general public license|agpl)\\b"),
    ("ref_lgpl", _UNDER + "(gnu )?(lesser general public license|library general public license|lgpl)\\b"),
    ("ref_gpl_3", _UNDER + "(gnu )?(general public license|gpl)( as published by the free software foundation)?"
                           "( either)?( version| v)? ?3\\b"),
    ("ref_gpl_2", _UNDER + "(gnu )?(general public license|gpl)( as published by the free software foundation)?"
                           "( either)?( version| v)? ?2\\b"),
    ("ref_gpl", _UNDER + "(gnu )?(general public license|gpl)\\b"),
    ("or_later", "^(or )?(at your option )?any later version\\b.*$|\\bor \\(?at your option any later version\\b"),
    ("ref_mpl_2", _UNDER + "mozilla public license( v| version)? ?2\\b"),
    ("ref_cc0", _UNDER + "(cc0|creative commons zero|creative commons cc0)\\b"),
    ("ref_cc_by_nc_nd", _UNDER + "(a )?(cc by nc nd|creative commons attribution non ?commercial no ?deriv\\w+)\\b"),
    ("ref_cc_by_nc_sa", _UNDER + "(a )?(cc by nc sa|creative commons attribution non ?commercial share ?alike)\\b"),
    ("ref_cc_by_nc", _UNDER + "(a )?(cc by nc|creative commons attribution non ?commercial)\\b"),
    ("ref_cc_by_sa", _UNDER + "(a )?(cc by sa|creative commons attribution share ?alike)\\b"),
    ("ref_cc_by_nd", _UNDER + "(a )?(cc by nd|creative commons attribution no ?deriv\\w+)\\b"),
    ("ref_cc_by", _UNDER + "(a )?(cc by|creative commons attribution)\\b"),
    ("mit_grant", "^permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", "^the above copyright notice and this permission notice shall be included in all copies"),
    ("mit_warranty", "^the software is provided as is without warranty of any kind"),
    ("isc_grant", "^permission to use copy modify and (or )?distribute this software for any purpose"),
    ("bsd_redistribute", "^redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", "neither the name of .* may be used to endorse or promote products"),
    ("bsd_warranty", "^this software is provided by the copyright holders and contributors as is"),
    ("gpl_free", "^this (program|library|file) is free software"),
    ("public_domain", "\\b(is|are|been) (hereby )?(placed|released|dedicated|put) (in|into|to) the public domain\\b"),
    ("all_rights", "\\ball rights reserved\\b"),
    ("copyright", "^(portions )?copyright (c )?[0-9]{4}\\b"),
]

# Ordered rules: licence, and the identifier sequence (a pattern
# over "<id><id>...") that shows it.
RULES: list[tuple[str, str]] = [
    ("MIT", "<mit_grant>(<mit_notice>)?(<mit_warranty>)?"),
    ("ISC", "<isc_grant>(<mit_warranty>)?"),
    ("BSD-3-Clause", "<bsd_redistribute><bsd_source><bsd_binary><bsd_endorse>(<bsd_warranty>)?"),
    ("BSD-2-Clause", "<bsd_redistribute><bsd_source><bsd_binary>(<bsd_warranty>)?"),
    ("GPL-3.0-or-later", "(<gpl_free>)?<ref_gpl_3><or_later>"),
    ("GPL-2.0-or-later", "(<gpl_free>)?<ref_gpl_2><or_later>"),
    ("GPL-3.0", "(<gpl_free>)?<ref_gpl_3>|<spdx_gpl_3>"),
    ("GPL-2.0", "(<gpl_free>)?<ref_gpl_2>|<spdx_gpl_2>"),
    ("AGPL", "<ref_agpl>|<spdx_agpl>"),
    ("LGPL", "(<gpl_free>)?<ref_lgpl>|<spdx_lgpl>"),
    ("GPL", "(<gpl_free>)?<ref_gpl>"),
    ("Apache-2.0", "<ref_apache_2>|<spdx_apache_2>"),
    ("Apache", "<ref_apache_other>"),
    ("MIT", "<ref_mit>|<spdx_mit>"),
    ("BSD-3-Clause", "<ref_bsd_3>|<spdx_bsd_3>"),
    ("BSD-2-Clause", "<ref_bsd_2>|<spdx_bsd_2>"),
    ("BSD", "<ref_bsd>"),
    ("MPL-2.0", "<ref_mpl_2>|<spdx_mpl_2>"),
    ("CC0", "<ref_cc0>"),
    ("CC-BY-NC-ND", "<ref_cc_by_nc_nd>"),
    ("CC-BY-NC-SA", "<ref_cc_by_nc_sa>"),
    ("CC-BY-NC", "<ref_cc_by_nc>"),
    ("CC-BY-SA", "<ref_cc_by_sa>"),
    ("CC-BY-ND", "<ref_cc_by_nd>"),
    ("CC-BY", "<ref_cc_by>"),
    ("Public-Domain", "<public_domain>"),
    ("Proprietary", "<copyright><all_rights>|<all_rights>"),
]

#: Every known sentence holds one of these (tested), so other sentences need no normalising.
MARK = ("licen[sc]|copyright|permission|warranty|redistribut|public domain|all rights|cc.by|cc0|creative commons|"
        "provided|released|distributed|available|covered|free software|later version|neither the name")
#: End of a sentence in the SQL: a stop, semicolon or colon before white space or the end, or a line end.
CUT = "[.;:!?]+[ \\t\\r]+|[.;:!?]*\\s*\\n\\s*|[.;:!?]+$"


#: End of a sentence in the scan: a stop or semicolon before white space or the end, or a line without letters.
ENDS = ("(?<!\\b(?:inc|ltd|corp|co))[.]+\\s+|[;!?]+\\s+|\\n[^a-z0-9\\n]*\\n\\s*|[.;!?]+$")
READS = MARK + "|spdx|version [23]"
_SPDX = "spdx license identifier "
UNDER = ("\\b((licensed|released|distributed|available|provided|covered)( \\w+)?|"
         "redistributed?( it)?( and)?( or)? modif(y|ied)( it)?) (under|by)( the)?( terms of)?( the)? ")


def _form(k: str, p: str) -> str:
    """The pattern of a known sentence anywhere in a longer one."""
    if p.startswith(_SPDX):              # every member of an expression has the prefix of its own by then
        return f"(?<={_SPDX}){p[len(_SPDX):]}"
    if p.startswith(_UNDER):
        return UNDER + p[len(_UNDER):]
    if k == "or_later":
        return "\\b(or |at your option )+any later version\\b|^any later version\\b"
    return p.replace("^", "\\b").replace(".*", "[a-z0-9 ]*")


#: Between two members of an SPDX expression of any length: MIT OR (Apache-2.0 AND BSD-3-Clause).
MEMBER = " (?:or|and) (?!later\\b)"

#: What the scan looks for, in order: a match is taken out of the sentence and leaves its identifier.
FORMS = [(f"spdx_gpl_{v}_later", _form("", f"{_SPDX}gpl {v} 0 or later\\b")) for v in (3, 2)] \
    + [(k, _form(k, p)) for k, p in SENTENCES] \
    + [(f"version_{v}", f"^(either )?version {v}( [0-9])?\\b( of| or| only|$)") for v in (3, 2)]

# The version may be a clause of its own, and a BSD notice starts with its copyright lines.
_BSD = "(<copyright>)*(<all_rights>)?"
_WIDER = {
    "(<gpl_free>)?<ref_gpl_3><or_later>": "(<gpl_free>)?(<ref_gpl_3>|<ref_gpl><version_3>)<or_later>|<spdx_gpl_3_later>",
    "(<gpl_free>)?<ref_gpl_2><or_later>": "(<gpl_free>)?(<ref_gpl_2>|<ref_gpl><version_2>)<or_later>|<spdx_gpl_2_later>",
    "(<gpl_free>)?<ref_gpl_3>|<spdx_gpl_3>": "(<gpl_free>)?(<ref_gpl_3>|<ref_gpl><version_3>)|<spdx_gpl_3>",
    "(<gpl_free>)?<ref_gpl_2>|<spdx_gpl_2>": "(<gpl_free>)?(<ref_gpl_2>|<ref_gpl><version_2>)|<spdx_gpl_2>",
    "<ref_agpl>|<spdx_agpl>": "(<gpl_free>)?<ref_agpl>(<version_[23]>)?(<or_later>)?|<spdx_agpl>",
    "(<gpl_free>)?<ref_lgpl>|<spdx_lgpl>": "(<gpl_free>)?<ref_lgpl>(<version_[23]>)?(<or_later>)?|<spdx_lgpl>",
}
READ = [(k, _BSD + p if p.startswith("<bsd_") else _WIDER.get(p, p)) for k, p in RULES]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_sentences (known licence sentences), sentence_ids and licenses (both
    joined by commas in text / rule order; empty if none)."""
    t = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    t = F.when(t.contains("spdx-license-identifier"),
               F.regexp_replace(t, "(spdx-license-identifier[^\\n]*)", "\n\n$1\n\n")).otherwise(t)
    marked = F.filter(F.split(t, ENDS, -1), lambda s: s.rlike(READS))
    normal = F.transform(marked, lambda s: F.trim(F.regexp_replace(
        F.regexp_replace(s, "(?<=[0-9])\\+", " or later "), "[^a-z0-9]+", " ")))
    df = docs.select("doc_id", normal.alias("s"))

    def tagged(s, forms):
        for k, p in forms:
            s = F.regexp_replace(s, p, f" <{k}> ")
        return s

    rest = [x for x in FORMS if _SPDX not in x[1]]
    df = df.select("doc_id", F.flatten(F.transform("s", lambda s: F.regexp_extract_all(
        F.when(s.contains(_SPDX), tagged(F.regexp_replace(s, MEMBER, " " + _SPDX), FORMS)).otherwise(tagged(s, rest)), F.lit("<(\\w+)>"), F.lit(1)))).alias("ids"))
    # Rules in order: state is (rest of the sequence, licences found).
    seq = F.concat(F.lit(""), F.array_join(F.transform("ids", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), ""))
    df = df.select("doc_id", "ids", F.struct(seq.alias("rest"), F.lit("").alias("found")).alias("z"))
    rules = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("rule")) for k, p in READ])
    # the array is only walked where there is something to match
    z = F.when(F.size("ids") > 0, F.aggregate(rules, F.col("z"), lambda a, r: F.when(
        F.regexp_like(a["rest"], r["rule"]),
        F.struct(F.regexp_replace(a["rest"], r["rule"], "|").alias("rest"),
                 F.concat(a["found"], F.lit(","), r["name"]).alias("found"))).otherwise(a))
    ).otherwise(F.col("z"))
    df = df.select("doc_id", "ids", z["found"].alias("found"))
    return df.select("doc_id", F.size("ids").cast("long").alias("n_sentences"),
                     F.array_join("ids", ",").alias("sentence_ids"),
                     F.array_join(F.array_distinct(F.array_remove(F.split("found", ","), "")), ",").alias("licenses"))


def _oracle() -> str:
    case = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in SENTENCES)
    steps, prev = [], "seq"
    for i, (k, p) in enumerate(RULES):
        steps.append(f"r{i} AS (SELECT rid, regexp_replace(rest, '{p}', '|', 'g') AS rest, "
                     f"CASE WHEN regexp_matches(rest, '{p}') THEN list_append(found, '{k}') ELSE found END AS found FROM {prev})")
        prev = f"r{i}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(string_split_regex(lower(coalesce(text, '')), '{CUT}'), lambda x: regexp_matches(x, '{MARK}')) AS ss FROM documents),
u AS (SELECT rid, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM d),
n AS (SELECT rid, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s FROM u),
c AS (SELECT rid, pos, CASE {case} END AS k FROM n),
ids AS (SELECT rid, list(k ORDER BY pos) AS ids FROM c WHERE k IS NOT NULL GROUP BY rid),
seq AS (SELECT rid, array_to_string(list_transform(ids, lambda k: '<' || k || '>'), '') AS rest, []::VARCHAR[] AS found FROM ids),
{', '.join(steps)},
f AS (SELECT rid, list_distinct(found) AS ld, found FROM {prev})
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses
FROM d LEFT JOIN ids USING (rid) LEFT JOIN f USING (rid)"""


ORACLE = _oracle()
