"""Lexicon jobs: noun lemmatization by exception table and suffix rules,
validated against a table of known words.

For each distinct word (never per occurrence): candidates are the word
itself, its exception lemmas, and each suffix-rule rewrite; the candidates
found in the known-word table are kept and the shortest wins (ties: the
earlier candidate).  Without a valid candidate the word stays as it is.
The resulting (form, lemma) table only lists words that change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import NOUN_SUFFIX_RULES


def rule_candidates(words: DataFrame, rules=NOUN_SUFFIX_RULES) -> DataFrame:
    """``(form, cand, ord)``: ord 0 is the form itself, then rule order."""
    form = F.col("form")
    cands = [F.struct(form.alias("cand"), F.lit(0).alias("ord"))]
    for i, (old, new) in enumerate(rules, start=1):
        rewritten = F.concat(F.expr(f"substring(form, 1, length(form) - {len(old)})"), F.lit(new))
        cands.append(F.struct(F.when(form.endswith(old), rewritten).alias("cand"), F.lit(i).alias("ord")))
    out = words.select("form", F.explode(F.array(*cands)).alias("c"))
    return out.select("form", "c.cand", "c.ord").filter(F.col("cand").isNotNull())


def noun_lemmas(words: DataFrame, known: DataFrame, exceptions: DataFrame | None = None,
                rules=NOUN_SUFFIX_RULES) -> DataFrame:
    """``(form, lemma)`` for the distinct ``form`` values of ``words``.

    ``known`` is ``(word)``; ``exceptions`` is ``(form, lemma)``.  The
    candidate check is a semi-join on the candidate word (AQE broadcasts a
    small known-word table)."""
    forms = words.select("form").distinct()
    cands = rule_candidates(forms, rules)
    if exceptions is not None:
        # an exception entry replaces the rules for that form
        exc = exceptions.select("form", F.col("lemma").alias("cand"), F.lit(0).alias("ord"))
        has_exc = exc.select("form").distinct()
        cands = cands.join(has_exc, "form", "left_anti").unionByName(
            exc.unionByName(forms.join(has_exc, "form").select("form", F.col("form").alias("cand"),
                                                               F.lit(-1).alias("ord"))))
    valid = cands.join(known.select(F.col("word").alias("cand")), "cand", "left_semi")
    best = valid.groupBy("form").agg(
        F.min(F.struct(F.length("cand").alias("len"), F.col("ord"), F.col("cand"))).alias("b"))
    return best.select("form", F.col("b.cand").alias("lemma")).filter(F.col("lemma") != F.col("form"))
