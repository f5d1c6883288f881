"""Registered queries: naive Bayes and kNN (SQL-checked), and the Spark ML
jobs (model grid, random search, refit, embeddings) checked by row counts
and invariants."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import models as M
from ..operators import neighbors as N
from ..operators import sampling as U
from ..operators import tfidf as TF
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import writers as W
from ..sources.tables import labelled_corpus, table
from . import sqlparts as S
from .common import reuse, stored
from .registry import register
from .sampling import SPLIT_SQL, TRAIN_CORPUS_SQL, train_corpus

SEED = 42
TEST_SIZE = 0.2
K = 5
TFIDF_SIZES = [3000, 5000, 10000]
GRID_MODELS = ["LREG", "LGBM", "XGBoost", "NB", "KNN"]
N_TRIALS = 100
TOP_RUNS = 10
TOP_RUN_TRIALS = 20   # trials of each top run in the registered query (a budget)
# The registered boosted-tree search has a small budget: a trial of the full
# ranges (operators.models, 1,050 iterations on average) takes many minutes.
BOOSTED_TRIALS = 6
BOOSTED_BUDGET = {"maxIter": (20, 100), "maxDepth": (2, 6)}


def split_embeddings(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return reuse(U.train_test_split(emb, "vec_id", TEST_SIZE, SEED))


EMB_SPLIT_SQL = f"""
SELECT vec_id, embedding, label,
       CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', CAST(vec_id AS VARCHAR), '{SEED}')), vec_id)
                 <= ceil({TEST_SIZE} * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM embeddings
"""
EMB_LONG = """SELECT vec_id, label, split, unnest(range(len(embedding))) AS dim,
                     CAST(unnest(embedding) AS DOUBLE) AS x FROM sp"""


@register("gaussian_nb", f"""
WITH sp AS ({EMB_SPLIT_SQL}),
lg AS ({EMB_LONG}),
tr AS (SELECT * FROM lg WHERE split = 'train'),
eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT dim, var_pop(x) AS v FROM tr GROUP BY dim) d),
tot AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
m AS (SELECT label, dim, avg(x) AS mu, var_pop(x) + (SELECT eps FROM eps) AS var,
             count(*) * 1.0 / (SELECT n FROM tot) AS prior FROM tr GROUP BY label, dim),
sc AS (SELECT te.vec_id, m.label AS c,
              ln(any_value(m.prior)) - 0.5 * sum(ln(2 * pi() * m.var)) - 0.5 * sum((te.x - m.mu) ^ 2 / m.var) AS ll
       FROM (SELECT * FROM lg WHERE split = 'test') te JOIN m ON te.dim = m.dim GROUP BY te.vec_id, m.label),
best AS (SELECT vec_id, c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, c) AS rk FROM sc) r
         WHERE rk = 1)
SELECT sp.vec_id, sp.label, CAST(best.c AS INTEGER) AS prediction
FROM sp JOIN best ON sp.vec_id = best.vec_id
""")
def gaussian_nb(spark, sf_dir):
    sp = split_embeddings(spark, sf_dir)
    model = N.fit_gaussian_nb(sp.filter(F.col("split") == "train"))
    test = sp.filter(F.col("split") == "test").select("vec_id", "embedding", "label")
    return N.predict_gaussian_nb(test, model, "vec_id").select("vec_id", "label", "prediction")


@register("knn_classify", f"""
WITH sp AS ({EMB_SPLIT_SQL}),
lg AS ({EMB_LONG}),
d AS (SELECT te.vec_id, tr.vec_id AS tid, any_value(tr.label) AS tl, sum((te.x - tr.x) ^ 2) AS d2
      FROM (SELECT * FROM lg WHERE split = 'test') te
      JOIN (SELECT * FROM lg WHERE split = 'train') tr ON te.dim = tr.dim
      GROUP BY te.vec_id, tr.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, tid) AS rk FROM d) r WHERE rk <= {K}),
votes AS (SELECT vec_id, tl, count(*) AS n FROM nn GROUP BY vec_id, tl),
best AS (SELECT vec_id, tl FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, tl) AS rk FROM votes) v
         WHERE rk = 1)
SELECT sp.vec_id, sp.label, CAST(best.tl AS INTEGER) AS prediction
FROM sp JOIN best ON sp.vec_id = best.vec_id
""")
def knn_classify(spark, sf_dir):
    sp = split_embeddings(spark, sf_dir)
    train = sp.filter(F.col("split") == "train")
    test = sp.filter(F.col("split") == "test").select("vec_id", "embedding", "label")
    return N.knn_predict(test, train, K).select("vec_id", "label", "prediction")


# ------------------------------------------------------------ ML jobs -----

def balanced_split(spark, sf_dir):
    corpus = C.clean_corpus(labelled_corpus(spark, sf_dir)).select("doc_id", "text", "label")
    bal = U.undersample(reuse(corpus), "label", "doc_id", SEED)
    return stored(U.train_test_split(reuse(bal), "doc_id", TEST_SIZE, SEED), "balanced-split")


def tfidf_sets(spark, sf_dir, sizes, fits=1):
    """(train, test) per size; ``fits`` of them run at a time on a training set."""
    sp = balanced_split(spark, sf_dir)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    out = {}
    for n in sizes:
        vocab = TF.fit_vocabulary(train, n)
        tr = TF.transform_vectors(train, vocab).select("doc_id", "features", F.col("label").cast("double"))
        te = TF.transform_vectors(test, vocab).select("doc_id", "features", F.col("label").cast("double"))
        out[("tfidf", n)] = (M.compact(stored(tr, "tfidf-train"), fits), M.compact(stored(te, "tfidf-test")))
    return out


# What SQL can recompute of a trained model: its keys and sizes, and booleans
# that the fits must meet (TRUE in the oracle, computed from real fits here).

N_TEST_EMB = f"(SELECT count(*) FROM ({EMB_SPLIT_SQL}) e WHERE split = 'test')"
N_TEST = f"(SELECT count(*) FROM ({SPLIT_SQL}) s WHERE split = 'test')"


def majority_share(df):
    """Share of the most frequent label."""
    n = df.groupBy("label").count()
    return n.agg(F.max("count") / F.sum("count")).first()[0] or 0.0


@register("logreg", f"""
SELECT 'LREG' AS model, 'embeddings' AS data, {N_TEST_EMB} AS n_test, TRUE AS beats_majority, TRUE AS valid_accuracy
""")
def logreg(spark, sf_dir):
    """Multinomial logistic regression on the embeddings: on the rows it was
    fitted on it beats the majority label."""
    sp = split_embeddings(spark, sf_dir)
    tr = M.as_features(sp.filter(F.col("split") == "train"), "embedding")
    te = M.as_features(sp.filter(F.col("split") == "test"), "embedding")
    model = M.make_model("LREG").fit(tr)
    beats = M.accuracy_of(model.transform(tr)) > majority_share(tr)
    acc = M.accuracy_of(model.transform(te))
    return spark.createDataFrame([("LREG", "embeddings", te.count(), beats, 0.0 <= acc <= 1.0)],
                                 "model string, data string, n_test long, beats_majority boolean, valid_accuracy boolean")


@register("gbt", f"""
SELECT model, {N_TEST} AS n_test, TRUE AS beats_majority, TRUE AS valid_accuracy FROM (VALUES ('LGBM'), ('XGBoost')) m(model)
""")
def gbt(spark, sf_dir):
    """Both boosted-tree presets on TF-IDF features of the balanced corpus."""
    presets = ("LGBM", "XGBoost")
    tr, te = tfidf_sets(spark, sf_dir, [TFIDF_SIZES[0]], len(presets))[("tfidf", TFIDF_SIZES[0])]
    n_test, majority = te.count(), majority_share(tr)

    def one(name):
        model = M.make_model(name).fit(tr)
        beats = M.accuracy_of(model.transform(tr)) > majority
        return (name, n_test, beats, 0.0 <= M.accuracy_of(model.transform(te)) <= 1.0)

    with ThreadPoolExecutor(len(presets)) as pool:
        rows = list(pool.map(one, presets))
    return spark.createDataFrame(rows, "model string, n_test long, beats_majority boolean, valid_accuracy boolean")


def _grid_sql(encoding, sizes):
    runs = ", ".join(f"('{encoding}', {n}, '{m}')" for n in sizes for m in GRID_MODELS)
    return (f"SELECT encoding_type, vector_size, model, 'ok' AS status, TRUE AS valid_accuracy "
            f"FROM (VALUES {runs}) g(encoding_type, vector_size, model)")


def _grid(spark, sets):
    """Every run of the grid, each stored when it is done; the second call
    reads the first one's results and fits the rest."""
    store = M.grid_store(spark, scratch_path(spark, "grid-results"))
    M.run_grid(spark, sets, GRID_MODELS[:1], store)
    done = M.run_grid(spark, sets, GRID_MODELS, store)
    return done.select("encoding_type", "vector_size", "model", "status",
                       F.coalesce(F.col("accuracy").between(0, 1), F.lit(False)).alias("valid_accuracy"))


@register("model_grid", _grid_sql("tfidf", TFIDF_SIZES))
def model_grid(spark, sf_dir):
    """TF-IDF sizes x five models."""
    return _grid(spark, tfidf_sets(spark, sf_dir, TFIDF_SIZES))


DENSE_SIZES = [300, 500, 1000]


def dense_sets(spark, sf_dir, encoding, sizes, encode):
    """(train, test) per size from the feature store: ``encode(split, size)``
    gives ``(doc_id, vec)``; the vectors of all sizes are stored once by
    encoding, size and split, and read back by partition."""
    sp = balanced_split(spark, sf_dir)
    root = scratch_path(spark, "feature-store")
    for n in sizes:
        rows = encode(sp, n).join(sp.select("doc_id", "label", "split"), "doc_id")
        rows = rows.withColumn("encoding", F.lit(encoding)).withColumn("vector_size", F.lit(n))
        W.write_partitioned(rows, root, ["encoding", "vector_size", "split"], mode="append")
    out = {}
    for n in sizes:
        back = spark.read.parquet(root).where((F.col("encoding") == encoding) & (F.col("vector_size") == n))
        side = lambda name: M.compact(reuse(back.where(F.col("split") == name).select(
            "doc_id", array_to_vector("vec").alias("features"), F.col("label").cast("double"))))
        out[(encoding, n)] = (side("train"), side("test"))
    return out


@register("model_grid_word2vec", _grid_sql("word2vec", DENSE_SIZES))
def model_grid_word2vec(spark, sf_dir):
    """Word2Vec document vectors of three sizes x five models."""
    from ..operators import embeddings as EM

    def encode(sp, n):
        train = sp.filter(F.col("split") == "train")
        return EM.encode_docs(sp, reuse(EM.train_word2vec(train, n, W2V_WINDOW, W2V_MIN_COUNT)), n)
    return _grid(spark, dense_sets(spark, sf_dir, "word2vec", DENSE_SIZES, encode))


@register("model_grid_subword", _grid_sql("subword", DENSE_SIZES))
def model_grid_subword(spark, sf_dir):
    """Subword document vectors of three sizes x five models; the information
    table of the training texts is made once."""
    from ..operators import embeddings as EM
    known = []

    def encode(sp, n):
        known[:] = known or [_subword_information(sp)]
        return EM.encode_docs(sp, stored(_subword_vectors(sp, n, known[0]), "subword-vectors"), n)
    return _grid(spark, dense_sets(spark, sf_dir, "subword", DENSE_SIZES, encode))


@register("model_grid_glove", _grid_sql("glove", DENSE_SIZES))
def model_grid_glove(spark, sf_dir):
    """GloVe document vectors of three sizes x five models; the co-occurrences
    of the training texts are counted once."""
    from ..operators import cooccur as CO
    from ..operators import embeddings as EM
    from ..operators import glove as G
    co = reuse(CO.cooccurrence(train_corpus(spark, sf_dir), GLOVE_WINDOW, GLOVE_MIN_COUNT))

    def encode(sp, n):
        vectors = G.train_glove(co, n, GLOVE_GRID_SWEEPS, x_max=GLOVE_X_MAX, tolerance=GLOVE_TOLERANCE)
        return EM.encode_docs(sp, reuse(vectors), n)
    return _grid(spark, dense_sets(spark, sf_dir, "glove", DENSE_SIZES, encode))


def _split_train(tr):
    """Validate on a split of the training part, not on the test set."""
    part = stored(U.train_test_split(tr, "doc_id", TEST_SIZE, SEED), "search-parts")
    return (M.compact(part.filter(F.col("split") == "train").drop("split"), M.SEARCH_FITS),
            M.compact(part.filter(F.col("split") == "test").drop("split")))


def _input_store(spark, sf_dir, make, name):
    """A store that belongs to the labelled corpus as it is now: a table
    rewritten in the same place gets another one."""
    key = W.corpus_fingerprint(labelled_corpus(spark, sf_dir), ["doc_id", "text", "label"])
    return make(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/textlens/{name}-{key}")


def _search(spark, sf_dir):
    """The trials of the logistic-regression search and the data it ran on.
    Trials that an earlier call stored for the same corpus are not fitted again."""
    tr, te = tfidf_sets(spark, sf_dir, [TFIDF_SIZES[0]])[("tfidf", TFIDF_SIZES[0])]
    trials = M.sample_trials(spark, M.LREG_SPACE, N_TRIALS, SEED, study=STUDY)
    return M.run_search(trials, *_split_train(tr), _input_store(spark, sf_dir, M.trial_store, "search")), tr, te


STUDY = "LREG_tfidf_3000"


def _draw_sql(name: str) -> str:
    """The uniform draw of a trial's parameter."""
    return f"('0x' || substr(md5('{SEED}|' || trial || '|{name}'), 1, 7))::BIGINT / {float(1 << 28)}"


def _pick_sql(p) -> str:
    u = _draw_sql(p.name)
    if p.kind == "categorical":
        return f"[{', '.join(repr(c) for c in p.choices)}][CAST(floor({u} * {len(p.choices)}) AS INTEGER) + 1]"
    if p.kind == "int":
        return f"CAST({int(p.low)} + floor({u} * {int(p.high) - int(p.low) + 1}) AS INTEGER)"
    if p.kind == "uniform":
        return f"round({p.low} + {u} * {p.high - p.low}, 6)"
    return f"round(exp(ln({p.low}) + {u} * (ln({p.high}) - ln({p.low}))), 6)"


_LREG = {p.name: p for p in M.LREG_SPACE}


@register("random_search", f"""
SELECT *, CASE WHEN penalty = 'l1' AND solver NOT IN ('liblinear', 'saga') OR penalty = 'elasticnet' AND solver <> 'saga'
                 OR penalty = 'none' AND solver = 'liblinear' THEN 'PRUNED' ELSE 'COMPLETE' END AS state,
       NOT (penalty = 'l1' AND solver NOT IN ('liblinear', 'saga') OR penalty = 'elasticnet' AND solver <> 'saga'
            OR penalty = 'none' AND solver = 'liblinear') AS scored
FROM (SELECT '{STUDY}' AS study, trial, {', '.join(f'{_pick_sql(_LREG[n])} AS {n}' for n in ('penalty', 'solver', 'C', 'max_iter'))}
      FROM (SELECT CAST(range AS INTEGER) AS trial FROM range({N_TRIALS})) r) t
""")
def random_search(spark, sf_dir):
    res, _, _ = _search(spark, sf_dir)
    return res.select("study", "trial", "penalty", "solver", F.round("C", 6).alias("C"), "max_iter", "state",
                      F.coalesce(F.col("value").between(0, 1), F.lit(False)).alias("scored"))


TOP_RUN_COLUMNS = ("penalty", "solver", "max_iter")


@register("top_run_search", f"""
SELECT study, 'tfidf' AS encoding_type, vector_size, 'LREG' AS model, trial, penalty, solver, max_iter,
       CASE WHEN penalty = 'l1' AND solver NOT IN ('liblinear', 'saga') OR penalty = 'elasticnet' AND solver <> 'saga'
              OR penalty = 'none' AND solver = 'liblinear' THEN 'PRUNED' ELSE 'COMPLETE' END AS state
FROM (SELECT 'LREG_tfidf_' || vector_size AS study, vector_size, trial,
             {', '.join(f'{_pick_sql(_LREG[n])} AS {n}' for n in TOP_RUN_COLUMNS)}
      FROM (SELECT CAST(range AS INTEGER) AS trial FROM range({TOP_RUN_TRIALS})) r, (VALUES ({'), ('.join(map(str, TFIDF_SIZES))})) v(vector_size)) t
""")
def top_run_search(spark, sf_dir):
    """A search for each of the ten best stored runs of the logistic-regression
    grid (there are three): the stored run names dataset and estimator, trials
    are stored one by one; a second call finds them all."""
    sets = tfidf_sets(spark, sf_dir, TFIDF_SIZES, len(TFIDF_SIZES))
    grid = M.run_grid(spark, sets, ["LREG"], M.grid_store(spark, scratch_path(spark, "grid-results")))
    store = M.trial_store(spark, scratch_path(spark, "top-run-trials"))
    parts = {}

    def dataset(encoding, size):
        if (encoding, size) not in parts:
            parts[encoding, size] = _split_train(sets[encoding, size][0])
        return parts[encoding, size]
    # a budget first, then the whole number of trials: the stored ones stay
    M.search_top_runs(grid, dataset, store, n_runs=TOP_RUNS, n_trials=TOP_RUN_TRIALS // 4, seed=SEED)
    out = M.search_top_runs(grid, dataset, store, n_runs=TOP_RUNS, n_trials=TOP_RUN_TRIALS, seed=SEED)
    return out.select("study", "encoding_type", "vector_size", "model", "trial", *[
        F.get_json_object("params", f"$.{n}").cast("int" if n == "max_iter" else "string").alias(n) for n in TOP_RUN_COLUMNS], "state")


def _boosted_sql(model, space):
    cols = ", ".join(f"{_pick_sql(p)} AS {p.name}" for p in space if p.name in ("maxIter", "maxDepth", "stepSize"))
    return (f"SELECT '{model}' AS study, trial, {cols}, 'COMPLETE' AS state, TRUE AS scored "
            f"FROM (SELECT CAST(range AS INTEGER) AS trial FROM range({BOOSTED_TRIALS})) r")


BOOSTED = {m: M.limited(M.SPACES[m], **BOOSTED_BUDGET) for m in ("LGBM", "XGBoost")}


@register("boosted_search", " UNION ALL ".join(_boosted_sql(m, space) for m, space in BOOSTED.items()))
def boosted_search(spark, sf_dir):
    """Search spaces of the two boosted-tree presets, within a budget, side by side."""
    tr, _ = tfidf_sets(spark, sf_dir, [TFIDF_SIZES[0]])[("tfidf", TFIDF_SIZES[0])]
    fit, valid = _split_train(tr)
    store = M.trial_store(spark, scratch_path(spark, "boosted-trials"))

    def search(model):
        trials = M.sample_trials(spark, BOOSTED[model], BOOSTED_TRIALS, SEED, study=model)
        return M.run_search(trials, fit, valid, store, M.SEARCH_FITS // len(BOOSTED), make=M.estimator_from_params(model)).select(
            "study", "trial", "maxIter", F.round("stepSize", 6).alias("stepSize"), "maxDepth", "state",
            F.coalesce(F.col("value").between(0, 1), F.lit(False)).alias("scored"))

    with ThreadPoolExecutor(len(BOOSTED)) as pool:
        found = list(pool.map(search, BOOSTED))
    return reduce(DataFrame.unionByName, found)


@register("refit_best", f"SELECT '{STUDY}' AS study, TRUE AS best_of_all, TRUE AS valid_metrics, {N_TEST} AS n_test")
def refit_best(spark, sf_dir):
    """Refit of the best stored trial; no other trial scored higher."""
    res, tr, te = _search(spark, sf_dir)
    m = M.refit_best(res, tr, te)
    top = res.agg(F.max("value").alias("top")).scalar()
    own = res.select("trial", F.col("value").alias("own"))
    valid = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1"):
        valid = valid & F.col(c).between(0, 1)
    return m.join(own, "trial").select("study", (F.col("own") == top).alias("best_of_all"), valid.alias("valid_metrics"),
                                       F.lit(te.count()).cast("long").alias("n_test"))


# ------------------------------------------------------------ embeddings --

W2V_SIZE = 300   # smallest dense size of the feature grid
W2V_WINDOW = 5
W2V_MIN_COUNT = 1


def _doc_vector_summary(vecs, split):
    return vecs.join(split.select("doc_id", "split"), "doc_id").select(
        "doc_id", "split", F.size("vec").alias("n_dims"), F.forall("vec", lambda x: x == 0).alias("is_zero"))


DOC_WORDS = f"""
SELECT s.doc_id, s.split, {S.words('c.text')} AS ws FROM ({SPLIT_SQL}) s JOIN ({S.CLEAN_CORPUS}) c ON c.doc_id = s.doc_id
"""


@register("word2vec_docs", f"""
WITH d AS ({DOC_WORDS}), k AS (SELECT DISTINCT unnest(ws) AS w FROM d WHERE split = 'train')
SELECT doc_id, split, {W2V_SIZE} AS n_dims, doc_id NOT IN (
         SELECT doc_id FROM (SELECT doc_id, unnest(ws) AS w FROM d) u WHERE w IN (SELECT w FROM k)) AS is_zero
FROM d
""")
def word2vec_docs(spark, sf_dir):
    """Word2Vec fitted on the training split, documents of both splits
    encoded as the mean of their known-word vectors."""
    from ..operators import embeddings as EM
    sp = balanced_split(spark, sf_dir)
    wv = reuse(EM.train_word2vec(sp.filter(F.col("split") == "train"), W2V_SIZE, W2V_WINDOW,
                                 W2V_MIN_COUNT))
    return _doc_vector_summary(EM.encode_docs(sp, wv, W2V_SIZE), sp)


def _subword_information(sp):
    from ..operators import subword as SW
    return SW.information_tables(sp.filter(F.col("split") == "train"), W2V_WINDOW, W2V_MIN_COUNT)


def _subword_vectors(sp, size, known):
    """``(word, vec)`` of all words of the split, n-grams trained on its training part."""
    from ..functions import text as T
    from ..operators import embeddings as EM
    grams = reuse(EM.subword_vectors(known, size))
    words = sp.select(F.explode(T.words("text")).alias("word")).distinct()
    return EM.subword_word_vectors(words, grams, size)


# a longer n-gram is known only if its first three characters are
THREE = "SELECT {cols}, unnest([substr('<' || w || '>', i, 3) FOR i IN range(1, length(w) + 1)]) AS g FROM u"


@register("subword_docs", f"""
WITH d AS ({DOC_WORDS}), u AS (SELECT doc_id, split, unnest(ws) AS w FROM d),
g AS ({THREE.format(cols='doc_id, split')}), k AS (SELECT DISTINCT g FROM g WHERE split = 'train')
SELECT doc_id, split, {W2V_SIZE} AS n_dims,
       doc_id NOT IN (SELECT doc_id FROM g WHERE g IN (SELECT g FROM k)) AS is_zero
FROM d
""")
def subword_docs(spark, sf_dir):
    """Character n-gram embeddings: unseen words of the test split still get
    vectors through their n-grams."""
    from ..operators import embeddings as EM
    sp = balanced_split(spark, sf_dir)
    wv = stored(_subword_vectors(sp, W2V_SIZE, _subword_information(sp)), "subword-vectors")
    return _doc_vector_summary(EM.encode_docs(sp, wv, W2V_SIZE), sp)


GLOVE_WINDOW = 10
GLOVE_MIN_COUNT = 5
GLOVE_X_MAX = 10.0
GLOVE_SWEEPS = 50        # at most
GLOVE_GRID_SWEEPS = 15   # at most, for each size of the grid (a budget)
GLOVE_TOLERANCE = 0.01   # two sweeps that lower the loss by less are the last


@register("glove_train", f"""
WITH t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
           FROM (SELECT doc_id, {S.words('text')} AS ws FROM ({TRAIN_CORPUS_SQL}) c) x),
v AS (SELECT word FROM t GROUP BY word HAVING count(*) >= {GLOVE_MIN_COUNT}),
i AS (SELECT doc_id, word, count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE word IN (SELECT word FROM v))
SELECT DISTINCT word, {W2V_SIZE} AS n_dims, TRUE AS loss_fell, TRUE AS is_finite FROM i WHERE n > 1
""")
def glove_train(spark, sf_dir):
    """GloVe vectors from the co-occurrences of the training texts, fitted
    until two sweeps hardly lower the loss (with its ridge term) or for
    GLOVE_SWEEPS.  The loss is recomputed from the tables: it is below a tenth
    of the start's."""
    from ..operators import cooccur as CO
    from ..operators import glove as G
    co = reuse(CO.cooccurrence(train_corpus(spark, sf_dir), GLOVE_WINDOW, GLOVE_MIN_COUNT))
    w, c, _ = G.fit_glove(co, W2V_SIZE, GLOVE_SWEEPS, x_max=GLOVE_X_MAX, tolerance=GLOVE_TOLERANCE)
    words = co.select(F.col("w1").alias("word")).distinct()
    start = G.glove_loss(co, G._init(words, W2V_SIZE, "w1"), G._init(words, W2V_SIZE, "c1"), GLOVE_X_MAX)
    fell = G.glove_loss(co, w, c, GLOVE_X_MAX).scalar() < start.scalar() * 0.1
    return G.word_vectors(w, c).select(
        "word", F.size("vec").alias("n_dims"), fell.alias("loss_fell"),
        F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("is_finite"))
