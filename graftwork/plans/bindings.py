"""Input views over the driver's tables, one SQL text for both engines.

Spark and the SQL checks read the same text, so inputs cannot drift apart.
Rates are integer counts divided last.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

_MONTH_QUARTER = "CAST(CEIL(EXTRACT(MONTH FROM o_orderdate) / 3.0) AS BIGINT)"


def _run_metrics(experiment: str) -> str:
    return f"""
SELECT experiment, CASE WHEN experiment = 'exp0' THEN 'lora' ELSE 'fullft' END AS grp, seed, name, task,
       'data/processed/' || task AS dataset, lr, checkpoint, step,
       ROUND(CAST(SUM(good) AS DOUBLE) / COUNT(*), 6) AS accuracy, MIN(o_orderkey) AS row_id
FROM (
  SELECT experiment, seed, task, name, good, o_orderkey,
         CASE WHEN name IN ('sweep_scratch', 'sweep_merged')
              THEN CASE l WHEN 0 THEN CAST(0.00005 AS DOUBLE) WHEN 1 THEN CAST(0.00016 AS DOUBLE)
                   ELSE CAST(0.0005 AS DOUBLE) END END AS lr,
         CASE WHEN name IN ('base', 'merged') THEN NULL WHEN q = 4 THEN 'final'
              ELSE 'checkpoint-' || CAST(q * 10 AS STRING) END AS checkpoint,
         CASE WHEN name IN ('base', 'merged') OR q = 4 THEN NULL ELSE q * 10 END AS step
  FROM (
    SELECT {experiment} AS experiment, o_orderkey,
           's' || CAST(CAST(FLOOR(o_orderkey / 6) AS BIGINT) % 3 AS STRING) AS seed,
           't' || CAST(CAST(FLOOR(o_custkey / 2) AS BIGINT) % 4 AS STRING) AS task,
           CASE o_orderkey % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'merged' WHEN 2 THEN 'sweep_scratch'
                WHEN 3 THEN 'sweep_merged' WHEN 4 THEN 'trained_scratch' ELSE 'trained_merged' END AS name,
           CAST(FLOOR(o_orderkey / 18) AS BIGINT) % 3 AS l,
           {_MONTH_QUARTER} AS q,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS good
    FROM orders
  ) a
) b
GROUP BY experiment, seed, name, task, lr, checkpoint, step"""


def _docs(sources: int, targets: int) -> str:
    return f"""
SELECT 'eval_t' || CAST(src AS STRING) || '_on_t' || CAST(tgt AS STRING) AS eval_dir,
       't' || CAST(src AS STRING) AS source_task, 't' || CAST(tgt AS STRING) AS target_task,
       'runs/lora_t' || CAST(src AS STRING) AS model, 'data/processed/t' || CAST(tgt AS STRING) AS dataset,
       'm' || CAST(src AS STRING) AS param_model,
       ROUND(CAST(good AS DOUBLE) / n, 6) AS accuracy, ROUND(CAST(cents AS DOUBLE) / n / 10000000, 6) AS nll
FROM (
  SELECT o_custkey % {sources} AS src, o_orderkey % {targets} AS tgt, COUNT(*) AS n,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS good,
         SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents
  FROM orders GROUP BY o_custkey % {sources}, o_orderkey % {targets}
) o"""


BINDINGS = {
    "mcq_arc": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split,
       p_name AS question, p_brand AS c0, p_type AS c1, CAST(p_size AS STRING) AS c2, p_name AS c3,
       CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS answer_key
FROM part""",
    "mcq_piqa": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split,
       p_name AS goal, p_brand AS sol1, p_type AS sol2, CAST(p_partkey % 3 AS INT) - 1 AS label,
       CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1' ELSE '2' END AS answer
FROM part""",
    "mcq_hella": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'test' ELSE 'train' END AS split,
       p_name AS ctx, p_brand AS e0, p_type AS e1, CAST(p_size AS STRING) AS e2, p_name AS e3,
       CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN NULL
            ELSE CAST(p_partkey % 4 AS STRING) END AS label
FROM part""",
    "mcq_three": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split,
       p_name AS context, p_type AS question, p_brand AS answer_a, CAST(p_size AS STRING) AS answer_b,
       p_type AS answer_c, CAST(p_partkey % 3 + 1 AS STRING) AS label,
       'a ) ' || p_brand || ' , b ) ' || p_type AS options,
       CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS correct
FROM part""",
    "chat": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "token_arrays": "SELECT doc_id AS sample_id, n_chars % 7 AS prompt_len, text FROM documents",
    "vocab": """
SELECT DISTINCT user_id % 16 AS id, user_id % 16 = 0 AS is_special, user_id % 16 = 5 AS is_blank FROM events""",
    "tokens": """
SELECT sample_id, pos, model, dataset, checkpoint, is_special, nll_milli, label_id,
       CASE WHEN label_id = -100 THEN 0 WHEN event_type = 'error' THEN (label_id + 1) % 16 ELSE label_id END AS pred_id
FROM (
  SELECT CAST(FLOOR(event_id / 8) AS BIGINT) AS sample_id, event_id % 8 AS pos,
         'm' || CAST(CAST(FLOOR(event_id / 8) AS BIGINT) % 5 AS STRING) AS model,
         't' || CAST(CAST(FLOOR(event_id / 40) AS BIGINT) % 4 AS STRING) AS dataset,
         CASE CAST(FLOOR(event_id / 160) AS BIGINT) % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'checkpoint-10'
              ELSE 'checkpoint-20' END AS checkpoint,
         CASE WHEN event_id % 8 < 3 THEN -100 ELSE user_id % 16 END AS label_id,
         user_id % 16 = 0 AS is_special, event_type,
         CAST(ROUND(value * 1000) AS BIGINT) AS nll_milli
  FROM events
) e""",
    "tokens_big": """
SELECT l_orderkey AS sample_id, 'm' || CAST(l_orderkey % 8 AS STRING) AS model,
       't' || CAST(CAST(FLOOR(l_orderkey / 8) AS BIGINT) % 8 AS STRING) AS dataset,
       l_partkey % 16 AS label_id, l_partkey % 16 = 0 AS is_special,
       CAST(ROUND(l_discount * 1000) AS BIGINT) AS nll_milli,
       CASE WHEN l_returnflag = 'R' THEN (l_partkey + 1) % 16 ELSE l_partkey % 16 END AS pred_id
FROM lineitem""",
    "eval_docs": _docs(8, 8),
    "eval_docs_m": _docs(4, 8),
    # Targets and sources grow with the data: one target per part, one source per supplier.
    "eval_docs_wide": """
SELECT 'eval_s' || CAST(l_suppkey AS STRING) || '_on_p' || CAST(l_partkey AS STRING) AS eval_dir,
       's' || CAST(l_suppkey AS STRING) AS model, 'p' || CAST(l_partkey AS STRING) AS target_task,
       ROUND(CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS accuracy
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "lr_docs": """
SELECT 'eval_lora_t' || CAST(t AS STRING) || CASE l WHEN 0 THEN '_lr5e-05' WHEN 1 THEN '_lr0.00016'
            WHEN 2 THEN '_lr5.0E-4' ELSE '' END AS eval_dir,
       'runs/lora_t' || CAST(t AS STRING) AS model, 'data/processed/t' || CAST(l AS STRING) AS dataset,
       CASE c WHEN 0 THEN 'final' WHEN 1 THEN 'checkpoint-10' ELSE 'checkpoint-20' END AS checkpoint,
       CASE c WHEN 0 THEN NULL ELSE c * 10 END AS step,
       CASE c WHEN 0 THEN NULL WHEN 1 THEN 'checkpoint-10' ELSE 'checkpoint-20' END AS checkpoint_dir,
       ROUND(CAST(good AS DOUBLE) / n, 6) AS accuracy
FROM (
  SELECT o_custkey % 4 AS t, o_orderkey % 4 AS l, CAST(FLOOR(o_orderkey / 4) AS BIGINT) % 3 AS c, COUNT(*) AS n,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS good
  FROM orders GROUP BY o_custkey % 4, o_orderkey % 4, CAST(FLOOR(o_orderkey / 4) AS BIGINT) % 3
) o""",
    "run_metrics": _run_metrics("'exp' || CAST(o_custkey % 2 AS STRING)"),
    # Experiments grow with the data: one per eight neighbouring customers.
    "run_metrics_wide": _run_metrics("'exp' || CAST(CAST(FLOOR(o_custkey / 8) AS BIGINT) AS STRING)"),
    # Experiments of different shape: some lack a task, a merged or a final row, some have rows twice.
    "run_metrics_ragged": f"""
SELECT experiment, grp, seed, name, task, dataset, lr, checkpoint, step, accuracy, 2 * row_id + twice AS row_id
FROM (SELECT *, CAST(SUBSTR(experiment, 4) AS BIGINT) AS e FROM ({_run_metrics("'exp' || CAST(CAST(FLOOR(o_custkey / 8) AS BIGINT) AS STRING)")}) w) m
CROSS JOIN (SELECT 0 AS twice UNION ALL SELECT 1 AS twice) d
WHERE NOT (e % 3 = 1 AND task = 't3') AND NOT (e % 5 = 2 AND name = 'merged' AND seed = 's1')
  AND NOT (e % 5 = 3 AND name = 'trained_scratch' AND task = 't1' AND checkpoint = 'final')
  AND (twice = 0 OR e % 4 = 0)""",
    "job_timing": """
SELECT experiment, CASE WHEN experiment = 'exp0' THEN 'lora' ELSE 'fullft' END AS grp, seed, stage, job,
       CASE WHEN job_type = 'train' THEN job || '_train' END AS subjob, job_type,
       CAST(SUM(secs) AS DOUBLE) AS elapsed_s,
       (experiment = 'exp1' AND seed = 's2' AND stage = 'merge') AS cached, MIN(o_orderkey) AS row_id
FROM (
  SELECT experiment, seed, stage, o_orderkey, secs,
         CASE stage WHEN 'relevance' THEN 'eval' WHEN 'merge' THEN 'merge' ELSE 'train' END AS job_type,
         CASE stage WHEN 'relevance' THEN 'relevance_t' || CAST(l AS STRING) || '_' || task
                    WHEN 'merge' THEN 'merge_' || task
                    ELSE stage || '_' || task || CASE l WHEN 0 THEN '_5e-05' WHEN 1 THEN '_0.00016' ELSE '_5.0E-4' END
         END AS job
  FROM (
    SELECT 'exp' || CAST(o_custkey % 2 AS STRING) AS experiment, o_orderkey,
           's' || CAST(CAST(FLOOR(o_orderkey / 4) AS BIGINT) % 3 AS STRING) AS seed,
           CASE o_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'relevance' WHEN 2 THEN 'merge'
                ELSE 'train_merged' END AS stage,
           't' || CAST(CAST(FLOOR(o_custkey / 2) AS BIGINT) % 4 AS STRING) AS task,
           CAST(FLOOR(o_orderkey / 12) AS BIGINT) % 3 AS l,
           CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS secs
    FROM orders
  ) s
) t
GROUP BY experiment, seed, stage, job, job_type""",
    "param_blocks": """
SELECT CASE WHEN vec_id % 5 = 4 THEN 'base' ELSE 'm' || CAST(vec_id % 5 AS STRING) END AS model,
       CASE CAST(FLOOR(vec_id / 5) AS BIGINT) % 10 WHEN 0 THEN 'embed_tokens.weight' WHEN 1 THEN 'lm_head.lora_A'
            WHEN 2 THEN 'lm_head.weight'
            ELSE 'layers.' || CAST(CAST(FLOOR(vec_id / 5) AS BIGINT) % 10 AS STRING) || '.lora_B' END AS tensor,
       CAST(FLOOR(vec_id / 50) AS BIGINT) AS block_no, embedding AS values_
FROM embeddings""",
    "artifacts": """
SELECT 'lora_' || lang || '_lr' || CAST(doc_id % 5 AS STRING) || '_' || CAST(doc_id AS STRING) AS path,
       doc_id % 13 <> 0 AS is_dir, n_chars AS bytes, lang, doc_id
FROM documents""",
    "links": """
SELECT 'lora_' || d.lang AS name,
       'lora_' || d.lang || '_lr' || CAST(MIN(d.doc_id) % 5 AS STRING) || '_' || CAST(MIN(d.doc_id) AS STRING) AS target
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY d.lang""",
    "checkpoint_dirs": """
SELECT 'runs/lora_' || lang || CASE doc_id % 4 WHEN 0 THEN '/checkpoint-' || CAST(doc_id AS STRING)
            WHEN 1 THEN '/checkpoint-' || CAST(doc_id AS STRING) || '-old'
            WHEN 2 THEN '/xcheckpoint-' || CAST(doc_id AS STRING) ELSE '/final' END AS path
FROM documents""",
    "sample_lines": """
SELECT CASE WHEN l_linenumber = 7 THEN 'rare' ELSE 'hot' END AS flag, l_orderkey AS line_key,
       CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_key, l_suppkey AS supplier_key
FROM lineitem""",
    "grid_tasks": "SELECT c_name AS task FROM customer",
    "grid_parts": """
SELECT 'train_' || c_name || '_' || CASE o_orderkey % 3 WHEN 0 THEN '5e-05' WHEN 1 THEN '0.00016' ELSE '0.0005' END AS job,
       o_orderkey AS part, o_orderstatus = 'F' AS done
FROM orders JOIN customer ON o_custkey = c_custkey""",
}


def tables_of(binding: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z]+)", BINDINGS[binding]))
    return sorted(words & set(TABLES))


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; its footer is read for the schema only once."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding as a lazy DataFrame over the parquet tables in ``sf_dir``."""
    for t in tables_of(name):
        table(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(BINDINGS[name])


def with_bindings(names: list[str], body: str) -> str:
    """Stand-alone SQL: the bindings as common table expressions, then ``body``."""
    ctes = ", ".join(f"{n} AS ({BINDINGS[n]})" for n in names)
    joined = f"WITH {ctes}"
    rest = body.strip()
    return f"{joined}, {rest[5:].lstrip()}" if rest[:5].upper() == "WITH " else f"{joined} {rest}"
