"""Grid, resume and retention queries."""

from pyspark.sql import functions as F

from graftwork.functions.columns import template, typed_template
from graftwork.operators import planning as G
from graftwork.plans.registry import query

RATES = ["5e-05", "0.00016", "0.0005"]
_RATES_SQL = "(VALUES ('5e-05'), ('0.00016'), ('0.0005')) AS v(lr)"


def _grid(tasks):
    return G.expand_grid(tasks, {"lr": RATES}).withColumn("job", G.job_name("train", "task", "lr"))


_GRID_SQL = f"g AS (SELECT task, lr, 'train_' || task || '_' || lr AS job FROM grid_tasks CROSS JOIN {_RATES_SQL})"
_DONE_SQL = "d AS (SELECT job FROM grid_parts GROUP BY job HAVING bool_and(done))"


@query("J1_grid", "grid_tasks", sql=f"WITH {_GRID_SQL} SELECT task, lr, job FROM g")
def grid(tasks):
    return _grid(tasks)


@query(
    "J6_pending",
    "grid_tasks",
    "grid_parts",
    sql=f"WITH {_GRID_SQL}, {_DONE_SQL} SELECT task, lr, job FROM g WHERE job NOT IN (SELECT job FROM d)",
)
def pending(tasks, parts):
    return G.pending(_grid(tasks), G.done_jobs(parts))


@query(
    "J6_finished",
    "grid_tasks",
    "grid_parts",
    sql=f"WITH {_GRID_SQL}, {_DONE_SQL} SELECT task, lr, job FROM g WHERE job IN (SELECT job FROM d)",
)
def finished(tasks, parts):
    return G.finished(_grid(tasks), G.done_jobs(parts))


@query(
    "P16_template",
    "grid_tasks",
    sql="""SELECT task, 'lora_' || task || '_lr' || lr AS output_dir, CAST(lr AS DOUBLE) AS learning_rate
           FROM grid_tasks CROSS JOIN (VALUES ('0.25'), ('0.5')) AS v(lr)""",
)
def names(tasks):
    rows = G.expand_grid(tasks, {"lr": [0.25, 0.5]})
    variables = {"task": "task", "lr": "lr"}
    return rows.select(
        "task",
        template("lora_{task}_lr{lr}", variables).alias("output_dir"),
        typed_template("{lr}", variables).alias("learning_rate"),
    )


_KEPT = """WITH held AS (SELECT target FROM links {where}),
p AS (SELECT path, bytes FROM artifacts WHERE is_dir AND (path GLOB 'lora_*_lr[0-2]_*' OR path GLOB 'lora_en_lr3_*')
      AND path NOT IN (SELECT target FROM held))
"""


@query("J7_retention_plan", "artifacts", "links", sql=_KEPT.format(where="") + "SELECT path, bytes FROM p")
def plan(artifacts, links):
    return G.retention_plan(artifacts, links, ["lora_*_lr[0-2]_*", "lora_en_lr3_*"]).select("path", "bytes")


@query(
    "J7_retention_after_unlink",
    "artifacts",
    "links",
    sql=_KEPT.format(where="WHERE NOT name GLOB 'lora_e*'") + "SELECT path, bytes FROM p",
)
def plan_unlinked(artifacts, links):
    out = G.retention_plan(artifacts, links, ["lora_*_lr[0-2]_*", "lora_en_lr3_*"], unlink=["lora_e*"])
    return out.select("path", "bytes")


@query(
    "A17_retention_summary",
    "artifacts",
    "links",
    sql=_KEPT.format(where="")
    + """SELECT COUNT(*) AS removed, CAST(COALESCE(SUM(bytes), 0) AS BIGINT) AS bytes,
                ROUND(COALESCE(SUM(bytes), 0) / 1073741824.0, 9)::DOUBLE AS gib FROM p""",
)
def reclaimed(artifacts, links):
    out = G.retention_summary(G.retention_plan(artifacts, links, ["lora_*_lr[0-2]_*", "lora_en_lr3_*"]))
    return out.withColumn("gib", F.round("gib", 9))
