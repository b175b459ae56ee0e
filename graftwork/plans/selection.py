"""Ranking and selection queries."""

from pyspark.sql import functions as F

from graftwork.functions import columns as C
from graftwork.operators import ranking as R
from graftwork.plans.registry import query
from graftwork.sources.evaluations import SummaryEntry, build_summary

_RANKED = """
WITH r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY target_task ORDER BY {order}, eval_dir) AS rank,
         COUNT(*) OVER (PARTITION BY target_task) AS num_candidates
  FROM {src})
"""
_LOO = "eval_docs WHERE source_task <> target_task"


@query(
    "T1_select_topk",
    "eval_docs",
    sql=_RANKED.format(order="accuracy DESC", src=_LOO)
    + """SELECT target_task, rank, eval_dir, model, accuracy, ROUND(accuracy, 6) AS weight, num_candidates
         FROM r WHERE rank <= 2""",
)
def topk(docs):
    best = R.select_topk(R.leave_one_out(docs), 2, "accuracy", "proportional")
    return best.select("target_task", "rank", "eval_dir", "model", "accuracy", "weight", "num_candidates")


@query(
    "T1_select_topk_wide",
    "eval_docs_wide",
    sql=_RANKED.format(order="accuracy DESC", src="eval_docs_wide")
    + """SELECT target_task, rank, eval_dir, model, accuracy, CAST(1.0 AS DOUBLE) AS weight, num_candidates
         FROM r WHERE rank <= 2""",
)
def topk_wide(docs):
    best = R.select_topk(docs, 2)
    return best.select("target_task", "rank", "eval_dir", "model", "accuracy", "weight", "num_candidates")


@query(
    "T2_select_best",
    "eval_docs",
    sql=_RANKED.format(order="nll ASC", src="eval_docs")
    + """SELECT target_task, eval_dir, model, nll, num_candidates, 'best_' || target_task AS link_name
         FROM r WHERE rank = 1""",
)
def best(docs):
    name = F.concat(F.lit("best_"), F.col("target_task"))
    out = R.select_best(docs, "nll", link_name=name)
    return out.select("target_task", "eval_dir", "model", "nll", "num_candidates", "link_name")


@query(
    "T3_merge_weights",
    "eval_docs",
    sql=_RANKED.format(order="nll ASC", src=_LOO)
    + """, s AS (SELECT *, MAX(nll) OVER (PARTITION BY target_task) AS top FROM r WHERE rank <= 3)
         SELECT target_task, eval_dir, nll, ROUND(CASE WHEN nll > 0 THEN top / nll ELSE 0.0 END, 6) AS weight FROM s""",
)
def weights(docs):
    out = R.select_topk(R.leave_one_out(docs), 3, "nll", "proportional")
    return out.select("target_task", "eval_dir", "nll", "weight")


@query(
    "W3_rank_models",
    "eval_docs",
    sql=_RANKED.format(order="accuracy DESC", src="eval_docs")
    + "SELECT target_task, eval_dir, accuracy, rank FROM r",
)
def ranking(docs):
    return R.rank_models(docs, "accuracy").select("target_task", "eval_dir", "accuracy", "rank")


@query(
    "W3_rank_models_wide",
    "eval_docs_wide",
    sql="""SELECT target_task, eval_dir, accuracy,
                  ROW_NUMBER() OVER (PARTITION BY target_task ORDER BY accuracy DESC, eval_dir) AS rank
           FROM eval_docs_wide""",
)
def ranking_wide(docs):
    return R.rank_models(docs, "accuracy").select("target_task", "eval_dir", "accuracy", "rank")


@query(
    "S1_scan_results",
    "eval_docs",
    sql="""SELECT eval_dir, model, dataset, accuracy, nll FROM eval_docs
           WHERE accuracy IS NOT NULL AND eval_dir GLOB 'eval_*_on_t[0-3]'""",
)
def scan(docs):
    return R.candidates(docs, "accuracy", "eval_*_on_t[0-3]").select("eval_dir", "model", "dataset", "accuracy", "nll")


@query(
    "F2_glob_filter",
    "eval_docs",
    sql="""SELECT eval_dir FROM eval_docs WHERE eval_dir GLOB 'eval_*_on_t?' AND NOT eval_dir GLOB 'eval_t1_on_*'""",
)
def globbed(docs):
    return docs.filter(C.glob_filter("eval_dir", "eval_*_on_t?", "eval_t1_on_*")).select("eval_dir")


@query(
    "F3_self_eval",
    "eval_docs",
    sql="SELECT eval_dir, model, dataset FROM eval_docs WHERE source_task = target_task",
)
def selfs(docs):
    return R.self_eval(docs).select("eval_dir", "model", "dataset")


@query(
    "J2_leave_one_out",
    "eval_docs",
    sql="SELECT eval_dir, source_task, target_task FROM eval_docs WHERE source_task <> target_task",
)
def loo(docs):
    return R.leave_one_out(docs).select("eval_dir", "source_task", "target_task")


@query(
    "J2_relevance_grid",
    "eval_docs_wide",
    sql="""SELECT m.model, t.target_task FROM (SELECT DISTINCT model FROM eval_docs_wide) m
           CROSS JOIN (VALUES ('s1'), ('s2'), ('s3')) AS t(target_task) WHERE m.model <> t.target_task""",
)
def planned(docs):
    return R.relevance_grid(docs.select("model").distinct(), ["s1", "s2", "s3"], "model")


@query(
    "P15_task_of",
    "eval_docs",
    sql="""SELECT eval_dir, REPLACE(dataset, 'data/processed/', '') AS task,
                  string_split(model, '/')[-1] AS model_name FROM eval_docs""",
)
def slugs(docs):
    return docs.select("eval_dir", C.task_of("dataset").alias("task"), C.basename("model").alias("model_name"))


@query(
    "P14_parse_lr",
    "lr_docs",
    sql="""SELECT DISTINCT eval_dir, TRY_CAST(NULLIF(regexp_extract(eval_dir, '_lr([0-9.eE-]+)', 1), '') AS DOUBLE) AS lr
           FROM lr_docs""",
)
def rates(docs):
    return docs.select("eval_dir", C.parse_lr("eval_dir").alias("lr")).distinct()


_SUMMARY_SQL = """
SELECT e.name, d.dataset, TRY_CAST(NULLIF(regexp_extract(d.eval_dir, '_lr([0-9.eE-]+)', 1), '') AS DOUBLE) AS lr,
       d.checkpoint, CAST(d.step AS BIGINT) AS step, d.accuracy, CAST(NULL AS DOUBLE) AS perplexity, d.eval_dir
FROM lr_docs d JOIN (VALUES {entries}) AS e(name, pattern, self_only, ckpts)
  ON d.eval_dir GLOB e.pattern
 AND (NOT e.self_only OR contains(string_split(d.model, '/')[-1], string_split(d.dataset, '/')[-1]))
 AND (e.ckpts OR d.checkpoint_dir IS NULL)
"""


@query(
    "U1_build_summary",
    "lr_docs",
    sql=_SUMMARY_SQL.format(
        entries="('sweep', 'eval_lora_*_lr*', FALSE, TRUE), ('own', 'eval_*', TRUE, TRUE),"
        " ('plain', 'eval_lora_t?', FALSE, FALSE)"
    ),
)
def summary(docs):
    entries = [
        SummaryEntry("sweep", "eval_lora_*_lr*"),
        SummaryEntry("own", "eval_*", self_eval_only=True),
        SummaryEntry("plain", "eval_lora_t?", include_checkpoints=False),
    ]
    return build_summary(docs, entries)


@query(
    "S2_checkpoint_documents",
    "lr_docs",
    sql=_SUMMARY_SQL.format(entries="('all', 'eval_*', FALSE, TRUE), ('top', 'eval_*', FALSE, FALSE)"),
)
def with_checkpoints(docs):
    return build_summary(docs, [SummaryEntry("all", "eval_*"), SummaryEntry("top", "eval_*", include_checkpoints=False)])


@query(
    "A18_counts",
    "eval_docs",
    sql="""SELECT target_task, COUNT(*) AS n_candidates, COUNT(DISTINCT source_task) AS n_sources
           FROM eval_docs WHERE source_task <> target_task GROUP BY target_task""",
)
def counts(docs):
    return (
        R.leave_one_out(docs)
        .groupBy("target_task")
        .agg(F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("source_task").alias("n_sources"))
    )
