"""Report queries over run metrics and job timings."""

from pyspark.sql import functions as F

from graftwork.functions import columns as C
from graftwork.operators import reports as R
from graftwork.operators import timing as T
from graftwork.plans.bindings import BINDINGS, bind
from graftwork.plans.registry import FUNCTIONS, ORACLES, QUERIES, query

CFG = R.ReportConfig()
TASKS = ["t0", "t1", "t2", "t3"]
EXP_SETUP = ("experiment", "setup")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 8) for c in cols})


def with_setup(df):
    return df.withColumn("setup", R.setup_label("grp"))


# --- SQL building blocks ---------------------------------------------------------
_ROLES = """roles(role, name, ck, ord) AS (VALUES ('base', 'base', NULL, 0), ('from_scratch', 'trained_scratch', 'final', 1),
  ('merged', 'merged', NULL, 2), ('from_merged', 'trained_merged', 'final', 3))"""


def _tasks_cte(src: str) -> str:
    return f"tk AS (SELECT DISTINCT experiment, task FROM {src})"


def _values_cte(src: str) -> str:
    return f"""vals AS (SELECT experiment, role, ord, seed, task, arg_min(accuracy, row_id) * 100 AS value
  FROM {src} JOIN roles USING (name) WHERE ck IS NULL OR ck = checkpoint GROUP BY experiment, role, ord, seed, task)"""


def _table_cte(by: str, cells: str) -> str:
    """Mean/std per task plus the average row, as CTE ``tab`` from ``vals``."""
    on = " AND ".join(f"c.{b} IS NOT DISTINCT FROM v.{b}" for b in by.split(", "))
    pick = ", ".join(f"c.{b}" for b in by.split(", "))
    return f"""cells AS ({cells}),
tab0 AS (SELECT {pick}, c.task, COALESCE(AVG(v.value), 0) AS mean, COALESCE(STDDEV_POP(v.value), 0) AS std, COUNT(v.value) AS n_seeds
  FROM cells c LEFT JOIN vals v ON {on} AND c.task = v.task GROUP BY {pick}, c.task),
whole AS (SELECT {by}, seed, AVG(value) AS v FROM vals GROUP BY {by}, seed
  HAVING COUNT(*) = (SELECT COUNT(*) FROM cells c WHERE {on.replace('v.', 'vals.')})),
spread AS (SELECT {by}, STDDEV_POP(v) AS std, COUNT(*) AS n FROM whole GROUP BY {by}),
tab AS (SELECT * FROM tab0 UNION ALL
  SELECT {pick}, 'Avg.' AS task, AVG(c.mean) AS mean, COALESCE(MAX(v.std), 0) AS std, COALESCE(MAX(v.n), 0) AS n_seeds
  FROM tab0 c LEFT JOIN spread v ON {on} GROUP BY {pick})"""


_BY_ROLE = "experiment, role, ord"
_METHOD_CELLS = "SELECT experiment, role, ord, task FROM tk CROSS JOIN roles"


def _method_sql(src: str) -> str:
    return f"WITH {_ROLES}, {_tasks_cte(src)}, {_values_cte(src)}, {_table_cte(_BY_ROLE, _METHOD_CELLS)}"


_MEANS = "experiment, role, task, ROUND(mean, 8) AS mean, ROUND(std, 8) AS std, n_seeds FROM tab"


# --- projections and filters ---------------------------------------------------------
@query(
    "F4_method_rows",
    "run_metrics",
    sql=f"""WITH {_ROLES} SELECT experiment, seed, role, task, checkpoint, accuracy FROM run_metrics JOIN roles USING (name)
            WHERE ck IS NULL OR ck = checkpoint""",
)
def method_rows(m):
    return R.tag_methods(m, CFG).select("experiment", "seed", "role", "task", "checkpoint", "accuracy")


@query(
    "F5_intermediate",
    "run_metrics",
    sql="SELECT experiment, seed, name, task, lr, checkpoint, step FROM run_metrics WHERE checkpoint IS DISTINCT FROM 'final'",
)
def intermediate(m):
    return m.filter(C.is_intermediate("checkpoint")).select("experiment", "seed", "name", "task", "lr", "checkpoint", "step")


@query(
    "F8_drop_null_lr",
    "run_metrics",
    sql="SELECT experiment, seed, name, task, lr, checkpoint, step FROM run_metrics WHERE lr IS NOT NULL",
)
def with_lr(m):
    return m.filter(F.col("lr").isNotNull()).select("experiment", "seed", "name", "task", "lr", "checkpoint", "step")


@query(
    "P17_task_label",
    "run_metrics",
    sql="""SELECT DISTINCT task, CASE task WHEN 't0' THEN 'Zero' ELSE upper(task) END AS label,
                  'My ' || upper(task) || ' Ta.' AS long_label FROM run_metrics""",
)
def labels(m):
    long_name = F.concat(F.lit("my_"), F.col("task"), F.lit("_task"))
    return m.select(
        "task", C.task_label("task", {"t0": "Zero"}).alias("label"), C.task_label(long_name).alias("long_label")
    ).distinct()


@query(
    "P19_lr_label",
    "run_metrics",
    sql="""SELECT DISTINCT lr, CASE WHEN lr < 0.0001 THEN '5e-5' WHEN lr < 0.0004 THEN '1.6e-4' ELSE '5e-4' END AS label
           FROM run_metrics WHERE lr IS NOT NULL""",
)
def rate_labels(m):
    return m.filter(F.col("lr").isNotNull()).select("lr", C.lr_label("lr").alias("label")).distinct()


@query(
    "P20_percent",
    "run_metrics",
    sql="SELECT experiment, seed, name, task, lr, checkpoint, ROUND(accuracy * 100, 8) AS percent FROM run_metrics",
)
def percents(m):
    return m.select("experiment", "seed", "name", "task", "lr", "checkpoint", F.round(C.pct("accuracy"), 8).alias("percent"))


@query("T5_tasks", "run_metrics", sql="SELECT DISTINCT task FROM run_metrics")
def task_list(m):
    return R.tasks(m)


@query(
    "T5_lrs",
    "run_metrics",
    sql="""SELECT DISTINCT experiment, lr FROM run_metrics
           WHERE name = 'sweep_scratch' AND checkpoint = 'final' AND lr IS NOT NULL""",
)
def lr_list(m):
    return R.lrs(m, CFG, ["experiment"])


@query(
    "A18_seed_counts",
    "run_metrics",
    sql="SELECT experiment, COUNT(DISTINCT seed) AS n_seeds, COUNT(DISTINCT task) AS n_tasks FROM run_metrics GROUP BY experiment",
)
def seed_counts(m):
    return m.groupBy("experiment").agg(
        F.count_distinct("seed").alias("n_seeds"), F.count_distinct("task").alias("n_tasks")
    )


# --- results table ---------------------------------------------------------------------
@query("A6_mean_std", "run_metrics", sql=f"{_method_sql('run_metrics')} SELECT {_MEANS} WHERE task <> 'Avg.'")
def cells(m):
    out = R.mean_std(m, CFG).filter(F.col("task") != R.AVG)
    return rounded(out, "mean", "std").select("experiment", "role", "task", "mean", "std", "n_seeds")


@query("A7_with_avg", "run_metrics", sql=f"{_method_sql('run_metrics')} SELECT {_MEANS}")
def with_avg(m):
    return rounded(R.mean_std(m, CFG), "mean", "std").select("experiment", "role", "task", "mean", "std", "n_seeds")


@query("A7_with_avg_wide", "run_metrics_wide", sql=f"{_method_sql('run_metrics_wide')} SELECT {_MEANS}")
def with_avg_wide(m):
    return rounded(R.mean_std(m, CFG), "mean", "std").select("experiment", "role", "task", "mean", "std", "n_seeds")


@query(
    "W4_flag_best",
    "run_metrics",
    sql=f"""{_method_sql('run_metrics')}
        SELECT experiment, role, task, ROUND(mean, 8) AS mean,
               ROW_NUMBER() OVER (PARTITION BY experiment, task ORDER BY ROUND(mean, 8) DESC, ord) = 1 AS is_best FROM tab""",
)
def flagged(m):
    out = rounded(R.mean_std(m, CFG), "mean")
    return R.flag_best(out, ["experiment", "task"], "method_ord").select("experiment", "role", "task", "mean", "is_best")


@query(
    "U5_pivot_results",
    "run_metrics",
    sql=f"""{_method_sql('run_metrics')}
        SELECT experiment, role, {', '.join(f"ROUND(MAX(CASE WHEN task = '{t}' THEN mean END), 8) AS {t}" for t in TASKS)},
               ROUND(MAX(CASE WHEN task = 'Avg.' THEN mean END), 8) AS avg FROM tab GROUP BY experiment, role""",
)
def matrix(m):
    out = R.pivot_results(rounded(R.mean_std(m, CFG), "mean"), ["experiment", "role"], TASKS)
    return out.withColumnRenamed(R.AVG, "avg")


@query(
    "P18_cells",
    "run_metrics",
    sql=f"""{_method_sql('run_metrics')}
        SELECT experiment, role, task,
               printf('%.1f', mean) || CASE WHEN std > 0 AND n_seeds > 1 THEN ' ± ' || printf('%.1f', std) ELSE '' END AS val,
               CASE WHEN n_seeds = 0 THEN '---' ELSE printf('%.0f', mean) END AS time,
               CASE WHEN n_seeds = 0 THEN '---' ELSE printf('%.0f', mean) || '%' END AS pct,
               CASE WHEN mean = 0 AND std = 0 THEN '0' ELSE printf('%.1f', mean) END
                 || CASE WHEN std > 0 AND n_seeds > 1 THEN ' ± ' || printf('%.1f', std) ELSE '' END AS speedup
        FROM tab""",
)
def formatted(m):
    t = R.mean_std(m, CFG)
    known = F.when(F.col("n_seeds") > 0, F.col("mean"))
    return t.select(
        "experiment", "role", "task",
        C.fmt_val("mean", "std", "n_seeds").alias("val"),
        C.fmt_time(known).alias("time"),
        C.fmt_pct(known / 100).alias("pct"),
        C.fmt_speedup("mean", "std", "n_seeds").alias("speedup"),
    )


# --- learning rates ------------------------------------------------------------------------
_SWEEPS = "sweeps(method, name) AS (VALUES ('from_scratch', 'sweep_scratch'), ('from_merged', 'sweep_merged'))"
_LR_ROWS = """lrr AS (SELECT experiment, method, task, lr, accuracy, seed, row_id FROM run_metrics JOIN sweeps USING (name)
  WHERE checkpoint = 'final' AND lr IS NOT NULL),
rates AS (SELECT DISTINCT experiment, lr AS rate FROM lrr WHERE method = 'from_scratch')"""
_CLOSE = "JOIN rates r ON l.experiment = r.experiment AND ABS(l.lr - r.rate) <= 1e-8 + 1e-5 * ABS(r.rate)"
_LR_SQL = f"WITH {_SWEEPS}, {_tasks_cte('run_metrics')}, {_LR_ROWS}"


@query(
    "A8_lr_sensitivity",
    "run_metrics",
    sql=f"{_LR_SQL} SELECT experiment, method, task AS dataset, lr, accuracy, seed FROM lrr",
)
def sensitivity(m):
    return R.lr_sensitivity(m, CFG).drop("row_id")


_SWEEP_TABLE = f"""{_LR_SQL}, vals AS (SELECT l.experiment, l.method, l.lr, l.seed, l.task, arg_min(l.accuracy, l.row_id) * 100 AS value
  FROM lrr l JOIN rates r ON l.experiment = r.experiment AND l.lr = r.rate GROUP BY l.experiment, l.method, l.lr, l.seed, l.task),
{_table_cte('experiment, method, lr', '''SELECT tk.experiment, s.method, rates.rate AS lr, tk.task
  FROM tk JOIN rates USING (experiment) CROSS JOIN sweeps s''')}"""


@query(
    "A9_lr_sweep",
    "run_metrics",
    sql=f"{_SWEEP_TABLE} SELECT experiment, method, lr, task, ROUND(mean, 8) AS mean, ROUND(std, 8) AS std, n_seeds FROM tab",
)
def sweep_table(m):
    out = rounded(R.lr_sweep(m, CFG), "mean", "std")
    return out.select("experiment", "method", "lr", "task", "mean", "std", "n_seeds")


@query(
    "W4_flag_best_lr",
    "run_metrics",
    sql=f"""{_SWEEP_TABLE} SELECT experiment, method, lr, task, ROUND(mean, 8) AS mean,
            ROW_NUMBER() OVER (PARTITION BY experiment, method, task ORDER BY ROUND(mean, 8) DESC, lr) = 1 AS is_best FROM tab""",
)
def flagged_lr(m):
    out = R.flag_best(rounded(R.lr_sweep(m, CFG), "mean"), ["experiment", "method", "task"], "lr")
    return out.select("experiment", "method", "lr", "task", "mean", "is_best")


@query(
    "U6_pivot_lr",
    "run_metrics",
    sql=f"""{_SWEEP_TABLE}
        SELECT experiment, method, lr, {', '.join(f"ROUND(MAX(CASE WHEN task = '{t}' THEN mean END), 8) AS {t}" for t in TASKS)},
               ROUND(MAX(CASE WHEN task = 'Avg.' THEN mean END), 8) AS avg FROM tab GROUP BY experiment, method, lr""",
)
def lr_matrix(m):
    out = R.pivot_results(rounded(R.lr_sweep(m, CFG), "mean"), ["experiment", "method", "lr"], TASKS)
    return out.withColumnRenamed(R.AVG, "avg")


@query(
    "J8_isclose_join",
    "run_metrics",
    sql=f"""{_LR_SQL}, l AS (SELECT *, lr * (1 + 0.000001 * (row_id % 20)) AS lr2 FROM lrr)
        SELECT l.experiment, l.method, l.task, l.seed, l.row_id, r.rate FROM l
        JOIN rates r ON l.experiment = r.experiment AND ABS(l.lr2 - r.rate) <= 1e-8 + 1e-5 * ABS(r.rate)""",
)
def close_rates(m):
    rows = R.lr_sensitivity(m, CFG).withColumn("lr", F.col("lr") * (1 + F.lit(0.000001) * (F.col("row_id") % 20)))
    out = R.isclose_join(rows, R.lrs(m, CFG, ["experiment"]), ["experiment"])
    return out.select("experiment", "method", F.col("dataset").alias("task"), "seed", "row_id", "rate")


@query(
    "A10_lr_curve",
    "run_metrics",
    sql=f"""{_LR_SQL}, p AS (SELECT l.experiment, l.method, r.rate AS lr, l.seed, AVG(l.accuracy * 100) AS v FROM lrr l {_CLOSE}
              GROUP BY l.experiment, l.method, r.rate, l.seed)
        SELECT experiment, method, lr, ROUND(AVG(v), 8) AS mean FROM p GROUP BY experiment, method, lr""",
)
def curve(m):
    return rounded(R.lr_curve(m, CFG), "mean")


@query(
    "A11_lr_task_curve",
    "run_metrics",
    sql=f"""{_LR_SQL}, p AS (SELECT l.experiment, l.method, l.task, r.rate AS lr, l.accuracy * 100 AS v FROM lrr l {_CLOSE}),
        c AS (SELECT tk.experiment, s.method, tk.task, rates.rate AS lr FROM tk JOIN rates USING (experiment) CROSS JOIN sweeps s)
        SELECT experiment, method, task, lr, ROUND(AVG(v), 8) AS mean, ROUND(COALESCE(STDDEV_POP(v), 0), 8) AS std
        FROM c LEFT JOIN p USING (experiment, method, task, lr) GROUP BY experiment, method, task, lr""",
)
def task_curve(m):
    return rounded(R.lr_task_curve(m, CFG), "mean", "std").select("experiment", "method", "task", "lr", "mean", "std")


_BEST_CTE = """best AS (SELECT experiment, seed, task, method AS role, lr, accuracy FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment, seed, method, task ORDER BY accuracy DESC, row_id) AS rn
  FROM run_metrics JOIN sweeps USING (name) WHERE checkpoint = 'final') q WHERE rn = 1)"""


@query("W6_best_lr", "run_metrics", sql=f"WITH {_SWEEPS}, {_BEST_CTE} SELECT * FROM best")
def best_rates(m):
    return R.best_lr(m, CFG)


# --- parity -------------------------------------------------------------------------------------
def _parity_cte(src: str) -> str:
    return f"""facts AS (SELECT experiment, seed, task,
    arg_min(accuracy, row_id) FILTER (WHERE name = 'trained_scratch' AND checkpoint = 'final') AS baseline,
    arg_min(accuracy, row_id) FILTER (WHERE name = 'merged') AS merged FROM {src} GROUP BY experiment, seed, task),
ck AS (SELECT experiment, seed, task, step, accuracy FROM {src}
  WHERE name = 'trained_merged' AND checkpoint IS DISTINCT FROM 'final' AND step IS NOT NULL),
pts AS (SELECT experiment, seed, task, CAST(0 AS BIGINT) AS step, merged AS accuracy FROM facts
  UNION ALL SELECT * FROM ck),
seq AS (SELECT p.*, f.baseline, LAG(p.step) OVER w AS s0, LAG(p.accuracy) OVER w AS a0
  FROM pts p JOIN facts f USING (experiment, seed, task) WINDOW w AS (PARTITION BY p.experiment, p.seed, p.task ORDER BY p.step)),
hit AS (SELECT experiment, seed, task, arg_min(s0 + (baseline - a0) / (accuracy - a0) * (step - s0), step) AS crossing
  FROM seq WHERE step > 0 AND accuracy >= baseline GROUP BY experiment, seed, task),
lst AS (SELECT experiment, seed, task, MAX(step) AS last_step FROM ck GROUP BY experiment, seed, task),
par AS (SELECT experiment, seed, task, baseline, merged,
    CASE WHEN baseline IS NULL OR merged IS NULL THEN NULL WHEN merged >= baseline THEN 0.0
         WHEN crossing IS NULL THEN 100.0 ELSE crossing / last_step * 100 END AS parity
  FROM facts LEFT JOIN hit USING (experiment, seed, task) LEFT JOIN lst USING (experiment, seed, task))"""


_COMPLETE = """good AS (SELECT experiment, seed FROM par WHERE baseline IS NOT NULL AND merged IS NOT NULL
  GROUP BY experiment, seed HAVING COUNT(*) = (SELECT COUNT(DISTINCT task) FROM par q WHERE q.experiment = par.experiment)),
full_ AS (SELECT par.* FROM par JOIN good USING (experiment, seed))"""
_PARITY = f"WITH {_parity_cte('run_metrics')}, {_COMPLETE}"


@query("J3_parity_inputs", "run_metrics", sql=f"{_PARITY} SELECT experiment, seed, task, baseline, merged FROM par")
def inputs(m):
    return R.parity_inputs(m, CFG).drop("last_step")


def _parity_rows(m):
    return rounded(R.training_to_parity(m, CFG), "parity").select("experiment", "seed", "task", "parity")


@query("W2_training_to_parity", "run_metrics", sql=f"{_PARITY} SELECT experiment, seed, task, ROUND(parity, 8)::DOUBLE AS parity FROM par")
def parity(m):
    return _parity_rows(m)


@query(
    "W2_training_to_parity_wide",
    "run_metrics_wide",
    sql=f"WITH {_parity_cte('run_metrics_wide')} SELECT experiment, seed, task, ROUND(parity, 8)::DOUBLE AS parity FROM par",
)
def parity_wide(m):
    return _parity_rows(m)


@query("J5_complete_seeds", "run_metrics", sql=f"{_PARITY} SELECT DISTINCT experiment, seed FROM full_")
def complete(m):
    return R.complete_seeds(R.training_to_parity(m, CFG)).select("experiment", "seed").distinct()


_SPEED_CELLS = "SELECT DISTINCT experiment, task FROM par"
_SPEED_TABLE = f"""{_PARITY}, vals AS (SELECT experiment, seed, task, parity AS value FROM full_), {_table_cte('experiment', _SPEED_CELLS)}"""
_STRICT = """, sx AS (SELECT experiment, task, AVG(value) AS m, STDDEV_POP(value) AS s, MAX(value) AS top, COUNT(*) AS n FROM vals GROUP BY experiment, task),
sa AS (SELECT experiment, seed, AVG(value) AS v FROM vals JOIN sx USING (experiment, task) WHERE top < 100 GROUP BY experiment, seed),
strict_ AS (SELECT c.experiment, c.task, CASE WHEN top < 100 THEN m END AS mean, CASE WHEN top < 100 THEN s ELSE 0 END AS std, COALESCE(n, 0) AS n_seeds
  FROM cells c LEFT JOIN sx USING (experiment, task)
  UNION ALL SELECT c.experiment, 'Avg.', AVG(v), COALESCE(STDDEV_POP(v), 0), COUNT(v)
  FROM (SELECT DISTINCT experiment FROM cells) c LEFT JOIN sa USING (experiment) GROUP BY c.experiment)"""
_NORMAL_MEAN = "CASE WHEN task = 'Avg.' AND mean = 0 THEN NULL ELSE ROUND(mean, 8) END"


@query(
    "A12_speedup",
    "run_metrics",
    sql=f"{_SPEED_TABLE} SELECT experiment, task, {_NORMAL_MEAN} AS mean, ROUND(std, 8) AS std, n_seeds FROM tab",
)
def speedup(m):
    return rounded(R.speedup_agg(R.training_to_parity(m, CFG)), "mean", "std")


@query(
    "A13_speedup_strict",
    "run_metrics",
    sql=f"""{_SPEED_TABLE} {_STRICT}
        SELECT experiment, task, ROUND(mean, 8)::DOUBLE AS mean, ROUND(std, 8)::DOUBLE AS std, n_seeds FROM strict_""",
)
def speedup_strict(m):
    return rounded(R.speedup_agg(R.training_to_parity(m, CFG), strict=True), "mean", "std")


# --- curves ------------------------------------------------------------------------------------------
_SWEEP_PICK = f"""WITH {_SWEEPS}, ch AS (SELECT experiment, seed, task, CASE name WHEN 'trained_scratch' THEN 'from_scratch' ELSE 'from_merged' END AS role,
    arg_min(accuracy, row_id) AS chosen FROM run_metrics WHERE name IN ('trained_scratch', 'trained_merged') AND checkpoint = 'final' GROUP BY ALL),
fin AS (SELECT m.experiment, m.seed, m.task, s.method AS role, m.lr, ROW_NUMBER() OVER (PARTITION BY m.experiment, m.seed, m.task, s.method
    ORDER BY ABS(m.accuracy - ch.chosen), m.row_id) AS rn
  FROM run_metrics m JOIN sweeps s USING (name) JOIN ch ON ch.experiment = m.experiment AND ch.seed = m.seed AND ch.task = m.task AND ch.role = s.method
  WHERE m.checkpoint = 'final'),
bs AS (SELECT m.experiment, m.seed, m.task, f.role, m.lr, m.step, m.accuracy FROM run_metrics m JOIN sweeps s USING (name)
  JOIN fin f ON f.rn = 1 AND f.experiment = m.experiment AND f.seed = m.seed AND f.task = m.task AND f.role = s.method AND f.lr = m.lr
  WHERE m.checkpoint <> 'final')"""


@query("J9_best_sweep", "run_metrics", sql=f"{_SWEEP_PICK} SELECT * FROM bs")
def nearest_sweep(m):
    return R.best_sweep(m, CFG).drop("row_id")


@query(
    "W7_training_curves",
    "run_metrics",
    sql=f"""{_SWEEP_PICK}, st AS (SELECT experiment, seed, task, CASE name WHEN 'base' THEN 'from_scratch' ELSE 'from_merged' END AS role, accuracy
            FROM run_metrics WHERE name IN ('base', 'merged')),
        pts AS (SELECT experiment, seed, task, role, step, accuracy * 100 AS v FROM bs UNION ALL
            SELECT b.experiment, b.seed, b.task, b.role, 0, COALESCE(st.accuracy, 0) * 100
            FROM (SELECT DISTINCT experiment, seed, task, role FROM bs) b LEFT JOIN st USING (experiment, seed, task, role)),
        o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment, seed, task, role ORDER BY step) - 1 AS ordinal FROM pts)
        SELECT experiment, task, role, ordinal, arg_min(step, seed) AS step, ROUND(AVG(v), 8) AS mean, ROUND(STDDEV_POP(v), 8) AS std, COUNT(*) AS n_seeds
        FROM o GROUP BY experiment, task, role, ordinal""",
)
def curves(m):
    return rounded(R.training_curves(m, CFG), "mean", "std")


@query(
    "W7_converged",
    "run_metrics",
    sql="""WITH v AS (SELECT experiment, seed, task, arg_min(accuracy, row_id) * 100 AS v FROM run_metrics
             WHERE name = 'trained_scratch' AND checkpoint = 'final' GROUP BY experiment, seed, task)
           SELECT experiment, task, ROUND(AVG(v), 8) AS mean, ROUND(STDDEV_POP(v), 8) AS std FROM v GROUP BY experiment, task""",
)
def converged(m):
    return rounded(R.converged(m, CFG), "mean", "std")


# --- timing ---------------------------------------------------------------------------------------------
@query(
    "A16_stage_totals",
    "job_timing",
    sql="SELECT experiment, stage, CAST(SUM(elapsed_s) AS DOUBLE) AS total_s FROM job_timing GROUP BY experiment, stage",
)
def totals(t):
    return T.stage_totals(t, ["experiment"])


@query(
    "F9_uncached_seeds",
    "job_timing",
    sql="SELECT experiment, seed FROM job_timing GROUP BY experiment, seed HAVING NOT bool_or(cached)",
)
def uncached(t):
    return T.uncached_seeds(t, CFG)


_JOBS = """j AS (SELECT *, CASE WHEN job_type = 'train' THEN regexp_replace(substr(job, length(stage) + 2), '_[0-9][0-9.eE+-]*$', '')
    ELSE substr(job, length(stage) + 2) END AS task,
  CASE WHEN job_type = 'train' THEN CAST(regexp_extract(job, '_([0-9][0-9.eE+-]*)$', 1) AS DOUBLE) END AS lr FROM job_timing)"""


@query("S6_parse_jobs", "job_timing", sql=f"WITH {_JOBS} SELECT experiment, seed, stage, job, task, lr, elapsed_s FROM j")
def jobs(t):
    return T.parse_jobs(t).select("experiment", "seed", "stage", "job", "task", "lr", "elapsed_s")


@query(
    "A15_relevance_time",
    "job_timing",
    "run_metrics",
    sql="""WITH tk AS (SELECT DISTINCT experiment, task FROM run_metrics)
           SELECT j.experiment, j.seed, tk.task, MIN(j.elapsed_s) AS relevance_s FROM job_timing j
           JOIN tk ON tk.experiment = j.experiment AND j.stage = 'relevance' AND ends_with(j.job, '_' || tk.task)
           GROUP BY j.experiment, j.seed, tk.task""",
)
def relevance(t, m):
    names = m.select("experiment", "task").distinct()
    return T.relevance_time(t, names, "relevance").select("experiment", "seed", "task", "relevance_s")


_FACTS = f"""WITH {_SWEEPS}, {_BEST_CTE}, {_JOBS}, {_parity_cte('run_metrics')},
ok AS (SELECT experiment, seed FROM job_timing GROUP BY experiment, seed HAVING NOT bool_or(cached)),
tr AS (SELECT b.experiment, b.seed, b.task, b.role, arg_min(j.elapsed_s, j.row_id) AS secs FROM best b JOIN j
  ON j.experiment = b.experiment AND j.seed = b.seed AND j.task = b.task AND j.lr = b.lr
 AND j.stage = CASE b.role WHEN 'from_scratch' THEN 'train' ELSE 'train_merged' END GROUP BY b.experiment, b.seed, b.task, b.role),
rel AS (SELECT p.experiment, p.seed, p.task, MIN(j.elapsed_s) AS secs FROM facts p JOIN j ON j.experiment = p.experiment AND j.seed = p.seed
  AND j.stage = 'relevance' AND ends_with(j.job, '_' || p.task) GROUP BY p.experiment, p.seed, p.task),
mg AS (SELECT experiment, seed, task, arg_min(elapsed_s, row_id) AS secs FROM j WHERE stage = 'merge' GROUP BY experiment, seed, task),
tf0 AS (SELECT p.experiment, p.seed, p.task, COALESCE(p.parity, 100) AS parity, a.secs AS scratch_s, rel.secs AS relevance_s, mg.secs AS merge_s,
    b.secs AS retrain_s
  FROM par p JOIN ok USING (experiment, seed)
  LEFT JOIN tr a ON a.experiment = p.experiment AND a.seed = p.seed AND a.task = p.task AND a.role = 'from_scratch'
  LEFT JOIN tr b ON b.experiment = p.experiment AND b.seed = p.seed AND b.task = p.task AND b.role = 'from_merged'
  LEFT JOIN rel ON rel.experiment = p.experiment AND rel.seed = p.seed AND rel.task = p.task
  LEFT JOIN mg ON mg.experiment = p.experiment AND mg.seed = p.seed AND mg.task = p.task),
tf1 AS (SELECT *, CASE WHEN scratch_s IS NOT NULL THEN relevance_s + merge_s + retrain_s * parity / 100 END AS reuse_s FROM tf0),
tf AS (SELECT *, CASE WHEN scratch_s > 0 THEN reuse_s / scratch_s END AS ratio FROM tf1)"""
_THREE = "ROUND({a}(scratch_s), 8) AS scratch_s, ROUND({a}(reuse_s), 8) AS reuse_s, ROUND({a}(ratio), 8) AS ratio"


@query(
    "J4_timing_facts",
    "run_metrics",
    "job_timing",
    sql=f"""{_FACTS} SELECT experiment, seed, task, ROUND(parity, 8)::DOUBLE AS parity, scratch_s, relevance_s, merge_s, retrain_s,
            ROUND(reuse_s, 8) AS reuse_s, ROUND(ratio, 8) AS ratio FROM tf""",
)
def facts(m, t):
    return rounded(T.timing_facts(m, T.parse_jobs(t), CFG), "parity", "reuse_s", "ratio")


def _timing_agg_sql(by: str) -> str:
    inner = "AVG(scratch_s) AS scratch_s, AVG(reuse_s) AS reuse_s, AVG(ratio) AS ratio"
    return f"""SELECT {by}, task, {_THREE.format(a='AVG')} FROM tf GROUP BY {by}, task UNION ALL
    SELECT {by}, 'Avg.', {_THREE.format(a='AVG')} FROM (SELECT {by}, seed, {inner} FROM tf GROUP BY {by}, seed) q GROUP BY {by}"""


@query("A14_timing", "run_metrics", "job_timing", sql=f"{_FACTS} {_timing_agg_sql('experiment')}")
def timing(m, t):
    return rounded(T.timing_agg(T.timing_facts(m, T.parse_jobs(t), CFG)), *T.MEASURES)


# --- combined tables ---------------------------------------------------------------------------------------
_SETUP = "CASE experiment WHEN 'exp0' THEN 'LoRA' ELSE 'Full FT' END AS setup"
_PAIR = """wide AS (SELECT experiment, task, MAX(CASE WHEN role = 'from_scratch' THEN mean END) AS scratch_mean,
  MAX(CASE WHEN role = 'from_scratch' THEN std END) AS scratch_std, MAX(CASE WHEN role = 'from_merged' THEN mean END) AS merged_mean,
  MAX(CASE WHEN role = 'from_merged' THEN std END) AS merged_std FROM tab GROUP BY experiment, task)
SELECT experiment, {setup} task, ROUND(scratch_mean, 8) AS scratch_mean, ROUND(scratch_std, 8) AS scratch_std,
  ROUND(merged_mean, 8) AS merged_mean, ROUND(merged_std, 8) AS merged_std,
  scratch_mean > merged_mean AS scratch_wins, merged_mean > scratch_mean AS merged_wins FROM wide"""
_FOUR = ("scratch_mean", "scratch_std", "merged_mean", "merged_std")


@query("W5_flag_pair", "run_metrics", sql=f"{_method_sql('run_metrics')}, {_PAIR.format(setup='')}")
def pairs(m):
    return rounded(R.flag_pair(R.mean_std(m, CFG), ["experiment"]), *_FOUR)


@query(
    "A19_combined_results", "run_metrics", sql=f"{_method_sql('run_metrics')}, {_PAIR.format(setup=_SETUP + ',')}"
)
def combined(m):
    return rounded(R.combined_results(with_setup(m), CFG), *_FOUR)


@query(
    "A19_combined_timing",
    "run_metrics",
    "job_timing",
    sql=f"{_FACTS} SELECT *, {_SETUP} FROM ({_timing_agg_sql('experiment')}) q",
)
def combined_times(m, t):
    return rounded(T.combined_timing(with_setup(m), with_setup(T.parse_jobs(t)), CFG), *T.MEASURES)


@query(
    "A19_combined_speedup",
    "run_metrics",
    sql=f"""{_SPEED_TABLE} {_STRICT}
        SELECT experiment, {_SETUP}, task, {_NORMAL_MEAN} AS mean, ROUND(std, 8)::DOUBLE AS std, n_seeds, FALSE AS strict FROM tab UNION ALL
        SELECT experiment, {_SETUP}, task, ROUND(mean, 8), ROUND(std, 8), n_seeds, TRUE FROM strict_""",
)
def combined_speed(m):
    return rounded(R.combined_speedup(with_setup(m), CFG), "mean", "std")


def _ragged(name: str, *others: str) -> None:
    """The same query and SQL over experiments of different shape, and its other tables."""
    fn = FUNCTIONS[name]
    QUERIES[f"{name}_ragged"] = lambda spark, sf_dir: fn(*[bind(spark, sf_dir, b) for b in ("run_metrics_ragged", *others)])
    ORACLES[f"{name}_ragged"] = ORACLES[name].replace(BINDINGS["run_metrics"], BINDINGS["run_metrics_ragged"], 1)


for _name in (
    "A6_mean_std",
    "A7_with_avg",
    "A12_speedup",
    "A13_speedup_strict",
    "J5_complete_seeds",
    "J9_best_sweep",
    "W2_training_to_parity",
    "W6_best_lr",
    "W7_converged",
):
    _ragged(_name)
for _name in ("A14_timing", "A19_combined_timing"):
    _ragged(_name, "job_timing")
_ragged("A19_combined_speedup")
