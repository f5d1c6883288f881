"""Text scalar functions as native Column expressions.

Nothing here is a Python UDF: every function returns a Column that Spark
evaluates inside whole-stage codegen, so a chain of rewrites collapses into
a single Project over the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as cc
from .lexicons import ENGLISH_STOPWORDS, FUSED_FORMS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- words ---

def words(c) -> Column:
    """Whitespace split with empty pieces dropped (Python ``str.split()``).

    Every whitespace character is first mapped to ' ' by ``translate`` (a
    per-character table lookup), then split on the literal space; both are
    cheaper than a regex split over the Unicode whitespace class.
    ``array_remove`` is a plain (codegen'd) expression, unlike a lambda."""
    ws = cc.OTHER_SPACE_CHARS
    return F.array_remove(F.split(F.translate(_col(c), ws, " " * len(ws)), " "), "")


def space_words(c) -> Column:
    """``words`` for text whose only whitespace is the ASCII space (e.g. after
    ``collapse_spaces``): a literal one-character split, much cheaper than
    the Unicode whitespace class."""
    return F.array_remove(F.split(_col(c), " "), "")


def word_count(c) -> Column:
    return F.size(words(c))


def join_words(arr, sep: str = " ") -> Column:
    return F.array_join(_col(arr), sep)


# ------------------------------------------------------- cleaning steps ---

def anonymize_mentions(c) -> Column:
    """``@name`` -> ``@user`` (also hits the domain part of e-mail addresses)."""
    return F.regexp_replace(_col(c), cc.MENTION, "@user")


def unify_user(c) -> Column:
    return F.replace(_col(c), F.lit("<user>"), F.lit("@user"))


def drop_retweet(c, mode: str = "substring") -> Column:
    """Delete ``rt``.  ``substring`` reproduces the plain substring removal
    (``heart`` -> ``hea``); ``token`` removes only the stand-alone word."""
    if mode == "substring":
        return F.replace(_col(c), F.lit("rt"), F.lit(""))
    if mode == "token":
        return F.regexp_replace(_col(c), f"(?<![{cc.WORD_INNER}])rt(?![{cc.WORD_INNER}])", "")
    raise ValueError(f"unknown retweet mode {mode!r}")


def collapse_spaces(c) -> Column:
    return F.regexp_replace(_col(c), cc.SPACES, " ")


def strip_entities(c) -> Column:
    return F.regexp_replace(_col(c), cc.HTML_ENTITY, "")


# Narrower pictograph set for ``emoji_only=True`` (keeps CJK and other scripts).
_EMOJI_ONLY = (r"[\x{200d}\x{fe0f}\x{231a}\x{23cf}\x{23e9}\x{2600}-\x{27bf}"
               r"\x{1f000}-\x{1faff}]")


def strip_emoji(c, emoji_only: bool = False) -> Column:
    pattern = _EMOJI_ONLY if emoji_only else cc.EMOJI
    return F.regexp_replace(_col(c), pattern + "+", "")


def expand_contractions(c, mapping: Mapping[str, str]) -> Column:
    """Replace whole space-separated tokens found in ``mapping``; punctuation
    around a token (an opening quote, a full stop) is kept around the
    expansion, and a typographic apostrophe counts as a plain one."""
    if not mapping:
        return _col(c)
    lex = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    split_re = r"^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_']*)$"
    # a word without the characters that every form has is none of them; a
    # map is searched from end to end and patterns cost more, so few words get there
    needed = "".join(sorted(set.intersection(*map(set, mapping))))

    def one(w):
        head, core, rest = (F.regexp_extract(w, split_re, i) for i in (1, 2, 3))
        found = F.coalesce(F.concat(head, F.try_element_at(lex, F.translate(core, "\u2019", "'")), rest), w)
        if not needed:
            return found
        held = [w.contains(x) | w.contains("\u2019") if x == "'" else w.contains(x) for x in needed]
        return F.when(reduce(and_, held), found).otherwise(w)

    return F.array_join(F.transform(F.split(_col(c), " "), one), " ")


def replace_punctuation(c) -> Column:
    return F.regexp_replace(_col(c), cc.PUNCT, " ")


def remove_stopwords(c, stopwords: Iterable[str] = ENGLISH_STOPWORDS,
                     ascii_spaces_only: bool = False) -> Column:
    """Drop words whose lower-case form is a stopword; re-join with one space.
    ``isin`` with a long literal list is planned as a hash-set lookup.
    ``ascii_spaces_only`` declares that the text has no other whitespace."""
    stop = sorted(set(stopwords))
    ws = space_words(c) if ascii_spaces_only else words(c)
    return F.array_join(F.filter(ws, lambda w: ~F.lower(w).isin(stop)), " ")


def strip_leading_mentions(c) -> Column:
    """Strip surrounding spaces and leading ``@user``/``@user:`` runs."""
    return F.regexp_replace(_col(c), cc.LEADING_MENTIONS, "")


def clean_text(c, *, stopwords: Iterable[str] = ENGLISH_STOPWORDS,
               contractions: Mapping[str, str] | None = None,
               retweet_mode: str = "substring", emoji_only: bool = False) -> Column:
    """The text rewrites of the cleaning job, in their fixed order."""
    t = anonymize_mentions(c)
    t = unify_user(t)
    t = F.lower(t)
    t = drop_retweet(t, retweet_mode)
    t = collapse_spaces(t)
    t = strip_entities(t)
    t = strip_emoji(t, emoji_only)
    if contractions:
        t = expand_contractions(t, contractions)
    t = replace_punctuation(t)
    # After collapse_spaces every whitespace character is ' ', and the later
    # steps only delete characters or insert ' ': split on the literal space.
    t = remove_stopwords(t, stopwords, ascii_spaces_only=True)
    # The re-joined words have single inner spaces and none at either end,
    # so the leading-mention strip needs no trailing-space alternative.
    return F.regexp_replace(t, r"^(?:@user:? ?)+", "")


def word_tokenize(c, fused: Mapping[str, str] = FUSED_FORMS) -> Column:
    """Regex word tokenizer for already-cleaned text: ``@`` becomes its own
    token and the listed fused forms are split in two."""
    t = F.regexp_replace(_col(c), "@", " @ ")
    toks = words(t)
    if fused:
        lex = F.create_map(*[F.lit(x) for kv in sorted(fused.items()) for x in kv])
        toks = F.transform(toks, lambda w: F.coalesce(F.try_element_at(lex, F.lower(w)), w))
        toks = words(F.array_join(toks, " "))
    return toks


def tfidf_tokens(c) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(cc.TOKEN2), 0)


# ------------------------------------------------ annotation / evaluation --

def case_by_flags(tokens, flags) -> Column:
    """Upper-case a token where its flag is 1, lower-case it otherwise."""
    return F.zip_with(_col(tokens), _col(flags),
                      lambda t, f: F.when(f == 1, F.upper(t)).otherwise(F.lower(t)))


def is_upper(w) -> Column:
    w = _col(w)
    return (F.upper(w) == w) & (F.lower(w) != w)


def is_lower(w) -> Column:
    w = _col(w)
    return (F.lower(w) == w) & (F.upper(w) != w)


def words_match(a, b) -> Column:
    """Equal length, and every character pair equal or one side a non-word
    character (a wildcard).  Case-sensitive.

    Identical words match, and words without any non-word character match
    only if identical, so the per-character walk runs only for the rest."""
    a, b = _col(a), _col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""),
                       lambda x, y: (x == y) | x.rlike(cc.NOT_WORD) | y.rlike(cc.NOT_WORD))
    return (a == b) | ((F.length(a) == F.length(b))
                       & (a.rlike(cc.NOT_WORD) | b.rlike(cc.NOT_WORD))
                       & F.forall(pairs, lambda m: m))


def case_code(w) -> Column:
    """1 = all cased characters upper (and at least one), -1 = all lower,
    0 = neither."""
    w = _col(w)
    # upper(w) != w means a lower-case letter exists, so "all lower" reduces
    # to lower(w) == w: at most one conversion each way per word.
    return F.when(F.upper(w) == w, F.when(F.lower(w) != w, 1).otherwise(0)) \
            .otherwise(F.when(F.lower(w) == w, -1).otherwise(0))


def format_template(template: str, c, slot: str = "{text}") -> Column:
    head, sep, tail = template.partition(slot)
    if not sep:
        raise ValueError(f"template has no {slot} slot")
    return F.concat(F.lit(head), _col(c), F.lit(tail))


def chat_messages(system, user, assistant=None) -> Column:
    msgs = [F.struct(F.lit("system").alias("role"), _col(system).alias("content")),
            F.struct(F.lit("user").alias("role"), _col(user).alias("content"))]
    if assistant is not None:
        msgs.append(F.struct(F.lit("assistant").alias("role"), _col(assistant).alias("content")))
    return F.array(*msgs)


def round_half_up(c, digits: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in plain IEEE arithmetic: the same bits in
    every engine, unlike ``round`` whose half-way rule differs."""
    f = float(10 ** digits)
    return F.floor(_col(c) * f + 0.5) / f
