"""Registered queries: corpus cleaning (filters, rewrites, dedupe, funnel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..functions import text as T
from ..functions.lexicons import CONTRACTIONS
from ..operators import clean as C
from ..operators.dedupe import keep_first
from ..sources.tables import labelled_corpus, table
from . import sqlparts as S
from .common import reuse
from .registry import register

# Sequence-model corpora keep texts of at most 64 words (`max_words`).  The
# generated documents are far longer (10th percentile above 64 words), so the
# registered distribution query uses a longer bound; both are parameters.
ENTRY_MAX_WORDS = 512


@register("clean_label_distribution", f"""
SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share_pct
FROM ({S.CLEAN_CORPUS}) c
WHERE {S.word_count('text')} <= {ENTRY_MAX_WORDS}
GROUP BY label
""")
def clean_label_distribution(spark, sf_dir):
    corpus = labelled_corpus(spark, sf_dir)
    cleaned = C.clean_corpus(corpus, C.CleanConfig(max_words=ENTRY_MAX_WORDS))
    return C.class_distribution(cleaned)


@register("clean_corpus", f"SELECT doc_id, label, text FROM ({S.CLEAN_CORPUS}) c")
def clean_corpus_q(spark, sf_dir):
    return C.clean_corpus(labelled_corpus(spark, sf_dir)).select("doc_id", "label", "text")


@register("clean_text", f"SELECT doc_id, {S.clean('text')} AS text FROM documents")
def clean_text_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.clean_text("text").alias("text"))


@register("mention_anonymize", f"""
SELECT doc_id, replace(regexp_replace(text, {S.q(cc.MENTION)}, '@user', 'g'), '<user>', '@user') AS text
FROM documents
""")
def mention_anonymize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.unify_user(T.anonymize_mentions("text")).alias("text"))


@register("strip_entities_symbols", f"""
SELECT page_id,
       regexp_replace(regexp_replace(html, {S.q(cc.HTML_ENTITY)}, '', 'g'), {S.q(cc.EMOJI + '+')}, '', 'g') AS text
FROM pages
""")
def strip_entities_symbols(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.strip_emoji(T.strip_entities("html")).alias("text"))


@register("url_filter", f"""
SELECT page_id, url FROM pages WHERE NOT regexp_matches(url || ' ' || html, {S.q(cc.URL)})
UNION ALL
SELECT doc_id AS page_id, source AS url FROM documents WHERE NOT regexp_matches(text, {S.q(cc.URL)})
""")
def url_filter_q(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url",
                                                 F.concat_ws(" ", "url", "html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"),
                                                    F.col("source").alias("url"), "text")
    return C.url_filter(pages).unionByName(C.url_filter(docs)).select("page_id", "url")


@register("header_row_filter_cast", """
SELECT doc_id, CAST(label AS INTEGER) AS label, has_null
FROM (
  SELECT doc_id, label, bool_or(doc_id IS NULL OR label IS NULL) OVER () AS has_null
  FROM (SELECT doc_id, CAST(toxic AS VARCHAR) AS label FROM labels
        UNION ALL SELECT NULL, 'Label'
        UNION ALL SELECT NULL, NULL) r
  WHERE label IS DISTINCT FROM 'Label'
) t
WHERE doc_id IS NOT NULL AND label IS NOT NULL
""")
def header_row_filter_cast(spark, sf_dir):
    """Labels read as text with a repeated header row and an empty row
    mixed in: drop header rows (keeping NULLs), test for nulls, cast, drop
    nulls."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("toxic").cast("string").alias("label"))
    extra = labels.sparkSession.createDataFrame(
        [(None, "Label"), (None, None)], "doc_id bigint, label string")
    raw = labels.unionByName(extra)
    kept = C.drop_header_rows(raw, "label")
    has_null = kept.agg(F.bool_or(F.col("doc_id").isNull() | F.col("label").isNull())
                        .alias("has_null"))
    typed = kept.select("doc_id", F.col("label").cast("int").alias("label")).dropna()
    # a one-row aggregate attached as a scalar subquery (evaluated once)
    return typed.withColumn("has_null", has_null.scalar())


@register("lenient_cast", """
SELECT doc_id, TRY_CAST(label AS INTEGER) AS label, label IS NOT NULL AND TRY_CAST(label AS INTEGER) IS NULL AS label_rejected
FROM (SELECT d.doc_id, CASE WHEN d.lang = 'de' THEN 'n/a ' || l.toxic WHEN d.lang <> 'fr' THEN CAST(l.toxic AS VARCHAR) END AS label
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) t
""")
def lenient_cast(spark, sf_dir):
    """Labels read as text, some of which are no numbers (German documents)
    or missing (French ones): cast without failing, bad ones marked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("t"))
    raw = F.when(F.col("lang") == "de", F.concat(F.lit("n/a "), "t")).when(F.col("lang") != "fr", F.col("t"))
    rows = docs.join(labels, "doc_id").select("doc_id", raw.alias("label"))
    return C.cast_column(rows, "label", "int", lenient=True)


@register("dedupe_keep_first", """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source,
       count(*) AS copies
FROM documents GROUP BY text
""")
def dedupe_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    first = keep_first(docs, "text", "doc_id", count_col="copies")
    return first.select("doc_id", "lang", "source", "copies")


@register("stage_funnel", f"""
WITH base AS ({S.CORPUS}),
nn AS (SELECT * FROM base WHERE text IS NOT NULL AND label IS NOT NULL),
raw AS (SELECT DISTINCT text FROM nn),
kept AS (SELECT text FROM raw WHERE NOT regexp_matches(text, {S.q(cc.URL)})),
cl AS (SELECT DISTINCT {S.clean('text')} AS c FROM kept)
SELECT 0 AS step, 'input' AS stage, CAST(count(*) AS BIGINT) AS rows FROM base
UNION ALL SELECT 1, 'drop_null', count(*) FROM nn
UNION ALL SELECT 2, 'dedupe_raw', count(*) FROM raw
UNION ALL SELECT 3, 'drop_url', count(*) FROM kept
UNION ALL SELECT 4, 'dedupe_clean', count(*) FROM cl
UNION ALL SELECT 5, 'drop_empty', count(*) FROM cl WHERE c <> ''
""")
def stage_funnel(spark, sf_dir):
    return C.stage_funnel(labelled_corpus(spark, sf_dir))


@register("max_words_filter", f"""
SELECT doc_id, {S.word_count('text')} AS n_words FROM documents
WHERE {S.word_count('text')} <= {ENTRY_MAX_WORDS}
""")
def max_words_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.max_words_filter(docs, ENTRY_MAX_WORDS).select(
        "doc_id", T.word_count("text").cast("long").alias("n_words"))


@register("stopword_removal", f"""
SELECT doc_id,
       array_to_string(list_filter({S.words('text')}, lambda w: lower(w) NOT IN ({S.STOP_LIST})), ' ') AS text,
       {S.word_count('text')} - len(list_filter({S.words('text')}, lambda w: lower(w) NOT IN ({S.STOP_LIST}))) AS n_removed
FROM documents
""")
def stopword_removal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", T.remove_stopwords("text").alias("text"),
                      T.word_count("text").alias("_n"))
    return out.select("doc_id", "text",
                      (F.col("_n") - T.word_count("text")).cast("long").alias("n_removed"))


def _contraction_sql(x: str) -> str:
    pairs = ", ".join(f"{S.q(k)}: {S.q(v)}" for k, v in sorted(CONTRACTIONS.items()))
    split_re = r"^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_']*)$"
    head, core, rest = (f"regexp_extract(w, {S.q(split_re)}, {i})" for i in (1, 2, 3))
    core = f"translate({core}, chr(8217), chr(39))"
    return (f"array_to_string(list_transform(string_split({x}, ' '), lambda w: "
            f"coalesce({head} || MAP {{{pairs}}}[{core}] || {rest}, w)), ' ')")


@register("contraction_expand", f"""
SELECT doc_id, {_contraction_sql("regexp_replace(lower(text), " + S.q(cc.SPACES) + ", ' ', 'g')")} AS text
FROM documents
""")
def contraction_expand(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = T.collapse_spaces(F.lower("text"))
    return docs.select("doc_id", T.expand_contractions(t, CONTRACTIONS).alias("text"))


# ------------------------------------------------- tokenize + lemmatize ---

LEMMA_MIN_COUNT = 5   # known nouns: words seen at least this often in the corpus


def _fused_sql(x: str) -> str:
    from ..functions.lexicons import FUSED_FORMS
    pairs = ", ".join(f"{S.q(k)}: {S.q(v)}" for k, v in sorted(FUSED_FORMS.items()))
    toks = S.words(f"replace({x}, '@', ' @ ')")
    return (f"{S.words(f'array_to_string(list_transform({toks}, lambda w: '
                      f'coalesce(MAP {{{pairs}}}[lower(w)], w)), chr(32))')}")


@register("word_tokenize", f"""
SELECT doc_id, array_to_string({_fused_sql('text')}, ' ') AS text FROM ({S.CLEAN_CORPUS}) c
""")
def word_tokenize_q(spark, sf_dir):
    corpus = C.clean_corpus(labelled_corpus(spark, sf_dir))
    return corpus.select("doc_id", T.join_words(T.word_tokenize("text")).alias("text"))


def _rules_sql() -> str:
    from ..functions.lexicons import NOUN_SUFFIX_RULES
    parts = ["SELECT form, form AS cand, 0 AS ord FROM forms"]
    for i, (old, new) in enumerate(NOUN_SUFFIX_RULES, start=1):
        parts.append(f"SELECT form, substring(form, 1, length(form) - {len(old)}) || {S.q(new)}, {i} "
                     f"FROM forms WHERE suffix(form, {S.q(old)})")
    return " UNION ALL ".join(parts)


LEMMATIZED_SQL = f"""
WITH c AS (SELECT doc_id, {_fused_sql('text')} AS toks FROM ({S.CLEAN_CORPUS}) x),
t AS (SELECT doc_id, unnest(toks) AS form, unnest(range(len(toks))) AS pos FROM c),
forms AS (SELECT DISTINCT form FROM t),
known AS (SELECT form AS word FROM t GROUP BY form HAVING count(*) >= {LEMMA_MIN_COUNT}),
cands AS ({_rules_sql()}),
best AS (SELECT form, cand FROM (
           SELECT form, cand, row_number() OVER (PARTITION BY form ORDER BY length(cand), ord, cand) AS rk
           FROM cands WHERE cand IN (SELECT word FROM known)) r WHERE rk = 1)
SELECT t.doc_id, string_agg(coalesce(best.cand, t.form), ' ' ORDER BY t.pos) AS text
FROM t LEFT JOIN best ON t.form = best.form GROUP BY t.doc_id
"""


@register("lemmatize_lexicon", LEMMATIZED_SQL)
def lemmatize_lexicon(spark, sf_dir):
    """Tokenize the cleaned corpus, then map nouns to their lemma; known
    nouns are the corpus words seen at least five times."""
    from ..operators.lexicon import noun_lemmas
    corpus = C.clean_corpus(labelled_corpus(spark, sf_dir))
    # read three times below: the words, the known ones and the texts themselves
    toks = reuse(corpus.select("doc_id", T.join_words(T.word_tokenize("text")).alias("text")))
    words = toks.select(F.explode(F.split("text", " ")).alias("form"))
    known = words.groupBy("form").count().filter(F.col("count") >= LEMMA_MIN_COUNT) \
                 .select(F.col("form").alias("word"))
    lemmas = noun_lemmas(words, known)
    return C.apply_lemmas(toks, lemmas, "doc_id", "text").select("doc_id", "text")


FULL_BASE_SQL = f"""
SELECT doc_id, label, {_fused_sql(S.clean('text', with_contractions=True))} AS toks
FROM ({S.CORPUS}) c
WHERE text IS NOT NULL AND label IS NOT NULL AND NOT regexp_matches(text, {S.q(cc.URL)})
"""


@register("clean_corpus_full", f"""
WITH c1 AS ({FULL_BASE_SQL}),
d1 AS (SELECT array_to_string(toks, ' ') AS text FROM c1 WHERE len(toks) > 0 GROUP BY 1),
known AS (SELECT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM d1) x
          GROUP BY w HAVING count(*) >= {LEMMA_MIN_COUNT}),
t AS (SELECT doc_id, label, unnest(toks) AS form, unnest(range(len(toks))) AS pos FROM c1),
forms AS (SELECT DISTINCT form FROM t),
cands AS ({_rules_sql()}),
best AS (SELECT form, cand FROM (
           SELECT form, cand, row_number() OVER (PARTITION BY form ORDER BY length(cand), ord, cand) AS rk
           FROM cands WHERE cand IN (SELECT word FROM known)) r WHERE rk = 1 AND cand <> form),
c2 AS (SELECT t.doc_id, any_value(t.label) AS label,
              string_agg(coalesce(best.cand, t.form), ' ' ORDER BY t.pos) AS text
       FROM t LEFT JOIN best ON t.form = best.form GROUP BY t.doc_id)
SELECT min(doc_id) AS doc_id, arg_min(label, doc_id) AS label, text
FROM c2 WHERE text <> '' GROUP BY text
""")
def clean_corpus_full(spark, sf_dir):
    """The whole cleaning chain: rewrites with contraction expansion, word
    tokenization, noun lemmatization (known nouns: words seen at least five
    times in the tokenized corpus), one keep-first dedupe at the end."""
    from ..operators.lexicon import noun_lemmas
    corpus = labelled_corpus(spark, sf_dir)
    tokenized = reuse(C.clean_corpus(corpus, C.CleanConfig(contractions=CONTRACTIONS, tokenize=True)))
    words = tokenized.select(F.explode(F.split("text", " ")).alias("form"))
    known = words.groupBy("form").count().filter(F.col("count") >= LEMMA_MIN_COUNT) \
                 .select(F.col("form").alias("word"))
    lemmas = noun_lemmas(words, known)
    # the tokenized corpus is already de-duplicated: map its distinct texts
    # and collapse those that became equal (no second cleaning pass)
    full = keep_first(C.apply_lemmas(tokenized, lemmas, "doc_id", "text"), "text", "doc_id")
    return full.select("doc_id", "label", "text")


FUNNEL_MAX_WORDS = 64


@register("late_funnel", f"""
WITH l AS ({LEMMATIZED_SQL})
SELECT 6 AS step, 'dedupe_lemmas' AS stage, count(DISTINCT text) AS rows FROM l WHERE text <> ''
UNION ALL SELECT 7, 'max_words', count(DISTINCT text) FROM l WHERE text <> '' AND {S.word_count('text')} <= {FUNNEL_MAX_WORDS}
""")
def late_funnel(spark, sf_dir):
    """Rows left after tokenizing, lemmas and their dedupe, and after the
    length filter: the stages that follow those of ``stage_funnel``."""
    return C.late_stages(lemmatize_lexicon(spark, sf_dir), FUNNEL_MAX_WORDS)
