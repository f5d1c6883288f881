"""SQL fragments shared by the DuckDB oracle queries.

They restate the Column expressions of ``textlens.functions.text`` in
DuckDB SQL over the same character classes, so every oracle checks the
Spark job against an independent evaluation.
"""

from __future__ import annotations

from ..functions import charclass as cc
from ..functions.lexicons import ENGLISH_STOPWORDS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = ", ".join(q(w) for w in sorted(set(ENGLISH_STOPWORDS)))


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(cc.SPACES)}), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def contractions(x: str) -> str:
    """Token-wise contraction expansion (trailing punctuation kept)."""
    from ..functions.lexicons import CONTRACTIONS
    pairs = ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(CONTRACTIONS.items()))
    split_re = r"^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_']*)$"
    head, core, rest = (f"regexp_extract(w, {q(split_re)}, {i})" for i in (1, 2, 3))
    core = f"translate({core}, chr(8217), chr(39))"
    return (f"array_to_string(list_transform(string_split({x}, ' '), lambda w: "
            f"coalesce({head} || MAP {{{pairs}}}[{core}] || {rest}, w)), ' ')")


def clean(x: str, with_contractions: bool = False) -> str:
    t = f"regexp_replace({x}, {q(cc.MENTION)}, '@user', 'g')"
    t = f"replace({t}, '<user>', '@user')"
    t = f"lower({t})"
    t = f"replace({t}, 'rt', '')"
    t = f"regexp_replace({t}, {q(cc.SPACES)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(cc.HTML_ENTITY)}, '', 'g')"
    t = f"regexp_replace({t}, {q(cc.EMOJI + '+')}, '', 'g')"
    if with_contractions:
        t = contractions(t)
    t = f"regexp_replace({t}, {q(cc.PUNCT)}, ' ', 'g')"
    t = (f"array_to_string(list_filter(string_split_regex({t}, {q(cc.SPACES)}), "
         f"lambda w: w <> '' AND lower(w) NOT IN ({STOP_LIST})), ' ')")
    t = f"regexp_replace({t}, {q(cc.LEADING_MENTIONS)}, '', 'g')"
    return t


def upper(x: str) -> str:
    """Full upper-case mapping (sharp s becomes 'SS', as in Java and Python)."""
    return f"replace(upper({x}), 'ẞ', 'SS')"


CORPUS = ("SELECT d.doc_id, d.text, l.toxic AS label FROM documents d "
          "JOIN labels l ON d.doc_id = l.doc_id")

# cleaned, de-duplicated corpus (no length filter)
CLEAN_CORPUS = f"""
SELECT text, min(doc_id) AS doc_id, arg_min(label, doc_id) AS label
FROM (SELECT doc_id, label, {clean('text')} AS text
      FROM ({CORPUS}) c
      WHERE text IS NOT NULL AND label IS NOT NULL
        AND NOT regexp_matches(text, {q(cc.URL)})) x
WHERE text <> ''
GROUP BY text
"""
