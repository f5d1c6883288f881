"""Registered queries: trial analytics (trials derived from lineitem) and
training-curve tables (a step log derived from events).

Trials: study = returnflag||linestatus, trial = 1-based position in
(orderkey, linenumber, partkey, suppkey, quantity, price, discount, tax) order,
params quantity/discount/tax/price, value = 1 - 2*discount - tax +
quantity/500, penalty/solver picked from the line number / supplier key.

Log: model = 'model_' || user_id % 4; view -> eval record (eval_loss =
value/100, eval_accuracy = 1 - value/100), click -> train record (loss =
value/100), purchase -> both keys (routes to eval), others -> ignored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curves as CV
from ..operators import trials as TR
from ..operators.ranking import global_rank, range_bucket
from ..sources.tables import table
from .registry import register

PARAMS = ["quantity", "discount", "tax", "price"]
PENALTIES = ["l1", "l2", "elasticnet", "none"]
SOLVERS = ["liblinear", "lbfgs", "newton-cg", "saga"]


TRIAL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax"]


def trials(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    # trial numbers: a global rank, bucketed by order-key range (monotone)
    li = range_bucket(li, "l_orderkey")
    li = global_rank(li, TRIAL_ORDER, "_bk", (), "trial")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("study"),
        "trial",
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"),
        (F.lit(1.0) - F.col("l_discount") * 2 - F.col("l_tax") + F.col("l_quantity") / 500).alias("value"),
        F.element_at(F.array(*[F.lit(p) for p in PENALTIES]),
                     (F.col("l_linenumber") % 4 + 1).cast("int")).alias("penalty"),
        F.element_at(F.array(*[F.lit(s) for s in SOLVERS]),
                     (F.col("l_suppkey") % 4 + 1).cast("int")).alias("solver"))


TRIALS_SQL = f"""
SELECT l_returnflag || l_linestatus AS study,
       row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                          l_extendedprice, l_discount, l_tax) AS trial,
       l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_extendedprice AS price,
       1.0 - l_discount * 2 - l_tax + l_quantity / 500 AS value,
       ['l1','l2','elasticnet','none'][l_linenumber % 4 + 1] AS penalty,
       ['liblinear','lbfgs','newton-cg','saga'][l_suppkey % 4 + 1] AS solver
FROM lineitem
"""
LONG_SQL = " UNION ALL ".join(
    f"SELECT study, value, '{p}' AS param, CAST({p} AS DOUBLE) AS x FROM ({TRIALS_SQL}) t" for p in PARAMS)


def r6(c, name=None):
    return T.round_half_up(c, 6).alias(name or (c if isinstance(c, str) else None))


def r6s(x):
    return f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"


@register("best_trial", f"""
SELECT study, trial, {r6s('value')} AS value FROM (
  SELECT study, trial, value, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS rk
  FROM ({TRIALS_SQL}) t) r WHERE rk = 1
""")
def best_trial(spark, sf_dir):
    b = TR.best_trial(trials(spark, sf_dir))
    return b.select("study", "trial", r6("value"))


@register("running_best", f"""
SELECT study, trial, {r6s('value')} AS value,
       {r6s('max(value) OVER (PARTITION BY study ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS running_best
FROM ({TRIALS_SQL}) t
""")
def running_best(spark, sf_dir):
    rb = TR.running_best(trials(spark, sf_dir))
    return rb.select("study", "trial", r6("value"), r6("running_best"))


@register("param_importance", f"""
SELECT study, param,
       {r6s('abs(covar_pop(x, value) / nullif(sqrt(var_pop(x) * var_pop(value)), 0))')} AS importance
FROM ({LONG_SQL}) l GROUP BY study, param
""")
def param_importance(spark, sf_dir):
    pi = TR.param_importance(trials(spark, sf_dir), PARAMS)
    return pi.select("study", "param", r6("importance"))


RANGE_SQL = f"""
SELECT l.*, r.lo, r.hi, (r.hi - r.lo) / {TR.N_BINS} AS w
FROM ({LONG_SQL}) l JOIN (SELECT study, param, min(x) AS lo, max(x) AS hi FROM ({LONG_SQL}) a GROUP BY study, param) r
  ON l.study = r.study AND l.param = r.param
"""
SPINE_SQL = f"""
SELECT DISTINCT study, param, CAST(b.range AS INTEGER) AS bin FROM ({LONG_SQL}) l, range(1, {TR.N_BINS + 1}) b
"""


@register("binned_score", f"""
WITH c AS (SELECT study, param,
                  CAST(CASE WHEN hi = lo THEN 1 ELSE least({TR.N_BINS}, greatest(1, ceil((x - lo) / w))) END AS INTEGER) AS bin,
                  count(*) AS n, avg(value) AS mean_value
           FROM ({RANGE_SQL}) r GROUP BY ALL)
SELECT s.study, s.param, s.bin, coalesce(c.n, 0) AS n, {r6s('c.mean_value')} AS mean_value
FROM ({SPINE_SQL}) s LEFT JOIN c ON s.study = c.study AND s.param = c.param AND s.bin = c.bin
""")
def binned_score(spark, sf_dir):
    b = TR.binned_score(trials(spark, sf_dir), PARAMS)
    return b.select("study", "param", "bin", "n", r6("mean_value"))


@register("param_histogram", f"""
WITH c AS (SELECT study, param,
                  CAST(CASE WHEN hi = lo THEN 1 ELSE least({TR.N_BINS}, floor((x - lo) / w) + 1) END AS INTEGER) AS bin,
                  count(*) AS n
           FROM ({RANGE_SQL}) r GROUP BY ALL)
SELECT s.study, s.param, s.bin, coalesce(c.n, 0) AS n
FROM ({SPINE_SQL}) s LEFT JOIN c ON s.study = c.study AND s.param = c.param AND s.bin = c.bin
""")
def param_histogram(spark, sf_dir):
    return TR.param_histogram(trials(spark, sf_dir), PARAMS)


@register("trial_validity", f"""
SELECT penalty, solver,
       CASE WHEN penalty = 'l1' THEN solver IN ('liblinear', 'saga')
            WHEN penalty = 'elasticnet' THEN solver = 'saga'
            WHEN penalty = 'none' THEN solver IN ('lbfgs', 'newton-cg', 'sag', 'saga')
            ELSE TRUE END AS valid,
       count(*) AS n
FROM ({TRIALS_SQL}) t GROUP BY penalty, solver
""")
def trial_validity(spark, sf_dir):
    st = TR.trial_states(trials(spark, sf_dir))
    return st.groupBy("penalty", "solver", "valid").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ curves ------

def step_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    v = F.col("value") / 100
    et = F.col("event_type")
    logs = ev.select(
        "event_id", "ts", F.concat(F.lit("model_"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.when(et.isin("click", "purchase"), v).alias("loss"),
        F.when(et.isin("view", "purchase"), v).alias("eval_loss"),
        F.when(et.isin("view", "purchase"), 1 - v).alias("eval_accuracy"))
    return CV.number_steps(CV.route(logs))


LOG_SQL = """
SELECT event_id, ts, 'model_' || CAST(user_id % 4 AS VARCHAR) AS model,
       CASE WHEN event_type IN ('click', 'purchase') THEN value / 100 END AS loss,
       CASE WHEN event_type IN ('view', 'purchase') THEN value / 100 END AS eval_loss,
       CASE WHEN event_type IN ('view', 'purchase') THEN 1 - value / 100 END AS eval_accuracy
FROM events
"""
STEPS_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY model, kind ORDER BY ts, event_id) AS step
FROM (SELECT *, CASE WHEN eval_loss IS NOT NULL THEN 'eval' WHEN loss IS NOT NULL THEN 'train'
                     ELSE 'ignored' END AS kind FROM ({LOG_SQL}) l) r
"""


@register("metric_log_route", f"SELECT model, kind, count(*) AS n FROM ({STEPS_SQL}) s GROUP BY model, kind")
def metric_log_route(spark, sf_dir):
    return step_log(spark, sf_dir).groupBy("model", "kind").agg(F.count(F.lit(1)).alias("n"))


@register("log_every_n", f"""
SELECT model, kind, step, {r6s('coalesce(eval_loss, loss)')} AS loss FROM (
  SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY model, kind) / 10)) AS nth FROM ({STEPS_SQL}) s
  WHERE kind <> 'ignored') t
WHERE step % nth = 0
""")
def log_every_n(spark, sf_dir):
    s = step_log(spark, sf_dir).filter(F.col("kind") != "ignored")
    return CV.every_nth(s).select("model", "kind", "step", r6(F.coalesce("eval_loss", "loss"), "loss"))


@register("best_checkpoint", f"""
SELECT model, step, {r6s('eval_loss')} AS eval_loss FROM (
  SELECT model, step, eval_loss, row_number() OVER (PARTITION BY model ORDER BY eval_loss, step) AS rk
  FROM ({STEPS_SQL}) s WHERE kind = 'eval') r WHERE rk = 1
""")
def best_checkpoint(spark, sf_dir):
    e = step_log(spark, sf_dir).filter(F.col("kind") == "eval")
    return CV.best_checkpoint(e).select("model", "step", r6("eval_loss"))


@register("curve_long", f"""
SELECT coalesce(t.model, e.model) AS model, coalesce(t.step, e.step) AS step,
       {r6s('t.loss')} AS train_loss, {r6s('e.eval_loss')} AS eval_loss
FROM (SELECT * FROM ({STEPS_SQL}) s WHERE kind = 'train') t
FULL OUTER JOIN (SELECT * FROM ({STEPS_SQL}) s WHERE kind = 'eval') e
  ON t.model = e.model AND t.step = e.step
""")
def curve_long(spark, sf_dir):
    s = step_log(spark, sf_dir)
    c = CV.aligned_curves(s.filter(F.col("kind") == "train"), s.filter(F.col("kind") == "eval"))
    return c.select("model", "step", r6("train_loss"), r6("eval_loss"))


# ---------------------------------------------------------- small tables ---

EVAL_METRICS = ["eval_loss", "eval_accuracy", "eval_f1", "eval_precision", "eval_recall"]


def eval_log(spark, sf_dir):
    """Numbered eval records with five metrics and a timing derived from the event value."""
    s = step_log(spark, sf_dir)
    loss = F.col("eval_loss")
    return s.withColumns({"eval_f1": 1 - loss / 2, "eval_precision": 1 - loss / 4, "eval_recall": 1 - loss / 8,
                          "eval_runtime": loss * 100})


EVAL_SQL = f"""SELECT model, step, eval_loss, eval_accuracy, 1 - eval_loss / 2 AS eval_f1, 1 - eval_loss / 4 AS eval_precision,
  1 - eval_loss / 8 AS eval_recall FROM ({STEPS_SQL}) s WHERE kind = 'eval'"""


@register("eval_keys", f"SELECT model, step, {', '.join(f'{r6s(m)} AS {m}' for m in EVAL_METRICS)} FROM ({EVAL_SQL}) e")
def eval_keys(spark, sf_dir):
    """Eval records with their metric keys only (the timing is left out)."""
    e = CV.eval_record(eval_log(spark, sf_dir)).drop("event_id", "ts", "loss", "kind", "n_steps")
    return e.select(*[r6(c) if c.startswith("eval_") else c for c in e.columns])


@register("metric_curves", " UNION ALL ".join(
    f"SELECT model, step, '{m}' AS metric, {r6s(m)} AS value FROM ({EVAL_SQL}) e" for m in EVAL_METRICS))
def metric_curves(spark, sf_dir):
    """Training curves of all eval metrics in long form."""
    long = CV.metric_curves(eval_log(spark, sf_dir).where(F.col("kind") == "eval"), EVAL_METRICS)
    return long.select("model", "step", "metric", r6("value"))


@register("step_interval", """
SELECT source, n_rows,
       CAST(greatest(1, floor(greatest(1, floor(n_rows / 8)) * 3 / 10)) AS BIGINT) AS every_10th,
       CAST(greatest(1, floor(greatest(1, floor(n_rows / 8)) * 3 / 50)) AS BIGINT) AS every_50th
FROM (SELECT source, count(*) AS n_rows FROM documents GROUP BY source) t
""")
def step_interval(spark, sf_dir):
    """Logging interval of a training run over each source: 3 epochs, batches
    of 4, gradients accumulated over 2."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    every = lambda d: CV.step_interval(F.col("n_rows"), F.lit(3), F.lit(4), F.lit(2), d)
    return n.select("source", "n_rows", every(10).alias("every_10th"), every(50).alias("every_50th"))


IMPORTANCE_SQL = f"""SELECT study, param, {r6s('abs(covar_pop(x, value) / nullif(sqrt(var_pop(x) * var_pop(value)), 0))')} AS importance
FROM ({LONG_SQL}) l GROUP BY study, param"""
FIRST_PARAMS = 2


@register("first_params", f"""
SELECT study, param, place, importance FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY study ORDER BY importance DESC NULLS LAST, param) AS INTEGER) AS place
  FROM ({IMPORTANCE_SQL}) i) t WHERE place <= {FIRST_PARAMS}
""")
def first_params(spark, sf_dir):
    """The first parameters of each study by importance."""
    pi = TR.param_importance(trials(spark, sf_dir), PARAMS).withColumn("importance", r6("importance"))
    return TR.first_params(pi, FIRST_PARAMS).select("study", "param", "place", "importance")


DEFAULTS = {"quantity": 1.0, "discount": 0.05}


@register("best_params_lookup", f"""
WITH t AS ({TRIALS_SQL}),
b AS (SELECT study, quantity, discount FROM (
        SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS rk FROM t WHERE penalty <> 'none') r
      WHERE rk = 1 AND study <> 'NF')
SELECT g.study, g.solver, coalesce(b.quantity, {DEFAULTS['quantity']}) AS quantity,
       coalesce(b.discount, {DEFAULTS['discount']}) AS discount, b.study IS NOT NULL AS tuned
FROM (SELECT DISTINCT study, solver FROM t) g LEFT JOIN b ON g.study = b.study
""")
def best_params_lookup(spark, sf_dir):
    """Runs (study, solver) with the stored best parameters of their study;
    the study NF has none and gets the defaults."""
    t = trials(spark, sf_dir)
    tuned = t.where((F.col("penalty") != "none") & (F.col("study") != "NF"))
    best = tuned.join(TR.best_trial(tuned).select("study", "trial"), ["study", "trial"]).select("study", *DEFAULTS)
    return TR.lookup_params(t.select("study", "solver").distinct(), best, "study", DEFAULTS)
