"""Token metric queries."""

from pyspark.sql import functions as F

from graftwork.operators import tokens as K
from graftwork.operators.scale import running_sums
from graftwork.plans.registry import query

KEYS = ("model", "dataset", "checkpoint")
BIG = ("model", "dataset")
BATCH = 8
# Not a decimal fraction, so that no mean falls on a rounding boundary.
NLL_UNIT = 0.0000731058578


def _scored(tokens):
    return tokens.withColumn("nll", F.col("nll_milli") * F.lit(NLL_UNIT))


def _sql(source: str, keys: tuple[str, ...], batch: int = BATCH) -> str:
    k = ", ".join(keys)
    return f"""
WITH s AS (
  SELECT {k}, sample_id, DENSE_RANK() OVER (PARTITION BY {k} ORDER BY sample_id) - 1 AS row_idx,
         SUM(CASE WHEN label_id <> -100 THEN 1 ELSE 0 END) AS n_loss,
         SUM(CASE WHEN label_id <> -100 THEN nll_milli ELSE 0 END) AS nll_sum,
         SUM(CASE WHEN label_id <> -100 AND NOT is_special THEN 1 ELSE 0 END) AS n_answer,
         SUM(CASE WHEN label_id <> -100 AND NOT is_special AND pred_id = label_id THEN 1 ELSE 0 END) AS n_correct
  FROM {source} GROUP BY {k}, sample_id),
b AS (
  SELECT {k}, CAST(FLOOR(row_idx / {batch}.0) AS BIGINT) AS batch_id, SUM(n_answer) AS n_answer,
         SUM(n_correct) AS n_correct, COUNT(*) AS n_samples,
         SUM(CASE WHEN n_answer > 0 AND n_answer = n_correct THEN 1 ELSE 0 END) AS n_exact,
         CASE WHEN SUM(n_loss) > 0 THEN CAST(SUM(nll_sum) AS DOUBLE) / SUM(n_loss) * CAST({NLL_UNIT!r} AS DOUBLE) END AS batch_nll
  FROM s GROUP BY {k}, CAST(FLOOR(row_idx / {batch}.0) AS BIGINT))
"""


_PPL = "ROUND(CAST(CAST(EXP(CAST(COALESCE(AVG(batch_nll), 0) AS FLOAT)) AS FLOAT) AS DOUBLE), 4)"
_METRICS = """ROUND(CASE WHEN SUM(n_answer) > 0 THEN CAST(SUM(n_correct) AS DOUBLE) / SUM(n_answer) ELSE 0.0 END, 6) AS accuracy,
       ROUND(CAST(SUM(n_exact) AS DOUBLE) / {n}, 6) AS exact_match, {ppl} AS perplexity,
       ROUND(COALESCE(AVG(batch_nll), 0), 6) AS nll, CAST({n} AS BIGINT) AS num_samples,
       CAST(SUM(n_answer) AS BIGINT) AS num_answer_tokens"""


@query(
    "F7_answer_tokens",
    "tokens",
    sql="""SELECT sample_id, pos, label_id, pred_id FROM tokens WHERE label_id <> -100
           AND label_id NOT IN (SELECT label_id FROM tokens WHERE is_special AND label_id <> -100)""",
)
def answer_mask(tokens):
    special = tokens.filter("is_special AND label_id <> -100").select("label_id")
    return K.answer_tokens(tokens, special).select("sample_id", "pos", "label_id", "pred_id")


_ACC = """SELECT {k}, CAST(SUM(n_correct) AS BIGINT) AS num_correct, CAST(SUM(n_answer) AS BIGINT) AS num_answer_tokens,
       ROUND(CASE WHEN SUM(n_answer) > 0 THEN CAST(SUM(n_correct) AS DOUBLE) / SUM(n_answer) ELSE 0.0 END, 6) AS accuracy
FROM s GROUP BY {k}"""
_EM = """SELECT {k}, CAST(SUM(CASE WHEN n_answer > 0 AND n_answer = n_correct THEN 1 ELSE 0 END) AS BIGINT) AS num_exact,
       COUNT(*) AS num_samples,
       ROUND(CAST(SUM(CASE WHEN n_answer > 0 AND n_answer = n_correct THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS exact_match
FROM s GROUP BY {k}"""
_K3, _K2 = ", ".join(KEYS), ", ".join(BIG)


@query("A1_token_accuracy", "tokens", sql=_sql("tokens", KEYS) + _ACC.format(k=_K3))
def accuracy(tokens):
    return K.token_accuracy(tokens, KEYS)


@query("A1_token_accuracy_big", "tokens_big", sql=_sql("tokens_big", BIG) + _ACC.format(k=_K2))
def accuracy_big(tokens):
    return K.token_accuracy(tokens, BIG)


@query("A2_exact_match", "tokens", sql=_sql("tokens", KEYS) + _EM.format(k=_K3))
def exact(tokens):
    return K.exact_match(tokens, KEYS)


@query("A2_exact_match_big", "tokens_big", sql=_sql("tokens_big", BIG) + _EM.format(k=_K2))
def exact_big(tokens):
    return K.exact_match(tokens, BIG)


@query(
    "A3_batch_nll",
    "tokens",
    sql=_sql("tokens", KEYS)
    + f"""SELECT {_K3}, COUNT(*) AS num_batches, ROUND(COALESCE(AVG(batch_nll), 0), 6) AS nll, {_PPL} AS perplexity
          FROM b GROUP BY {_K3}""",
)
def nll(tokens):
    return K.batch_nll(_scored(tokens), BATCH, KEYS)


@query(
    "A4_perplexity",
    "tokens",
    sql=_sql("tokens", KEYS, 16) + f"SELECT {_K3}, {_PPL} AS perplexity FROM b GROUP BY {_K3}",
)
def ppl(tokens):
    return K.batch_nll(_scored(tokens), 16, KEYS).select(*KEYS, "perplexity")


@query(
    "A5_evaluate",
    "tokens",
    sql=_sql("tokens", KEYS)
    + f"SELECT {_K3}, {_METRICS.format(n='SUM(n_samples)', ppl=_PPL)} FROM b GROUP BY {_K3}",
)
def metrics(tokens):
    return K.evaluate(_scored(tokens), KEYS, BATCH)


@query(
    "A5_evaluate_big",
    "tokens_big",
    sql=_sql("tokens_big", BIG, 256)
    + f"SELECT {_K2}, {_METRICS.format(n='SUM(n_samples)', ppl=_PPL)} FROM b GROUP BY {_K2}",
)
def metrics_big(tokens):
    return K.evaluate(_scored(tokens), BIG, 256)


_STOP = f"""
, run AS (SELECT *, SUM(n_correct) OVER w AS cc, SUM(n_answer) OVER w AS ca FROM b
     WINDOW w AS (PARTITION BY {_K3} ORDER BY batch_id ROWS UNBOUNDED PRECEDING)),
st AS (SELECT {_K3}, MIN(CASE WHEN ca > 0 AND CAST(cc AS DOUBLE) / ca < 0.8 THEN batch_id END) AS stop,
       SUM(n_samples) AS total FROM run GROUP BY {_K3}),
u AS (SELECT b.*, st.total FROM b JOIN st USING ({_K3}) WHERE st.stop IS NULL OR b.batch_id <= st.stop)
"""


@query(
    "W1_early_stop",
    "tokens",
    sql=_sql("tokens", KEYS)
    + _STOP
    + f"SELECT {_K3}, {_METRICS.format(n='MAX(total)', ppl=_PPL)} FROM u GROUP BY {_K3}",
)
def stopped(tokens):
    return K.evaluate(_scored(tokens), KEYS, BATCH, min_accuracy=0.8)


@query(
    "W1_running_accuracy",
    "tokens",
    sql=_sql("tokens", KEYS)
    + _STOP
    + f"SELECT {_K3}, batch_id, CAST(cc AS BIGINT) AS cum_correct, CAST(ca AS BIGINT) AS cum_answer FROM run",
)
def running(tokens):
    batches = K.batch_totals(K.with_batches(K.sample_stats(_scored(tokens), KEYS), BATCH, KEYS), KEYS)
    out = running_sums(batches, KEYS, "batch_id", {"n_correct": "cum_correct", "n_answer": "cum_answer"})
    return out.select(*KEYS, "batch_id", "cum_correct", "cum_answer")


@query(
    "W8_batch_numbers",
    "tokens",
    sql=_sql("tokens", KEYS)
    + f"SELECT {_K3}, sample_id, row_idx, CAST(FLOOR(row_idx / 8.0) AS BIGINT) AS batch_id FROM s",
)
def batch_numbers(tokens):
    samples = tokens.select(*KEYS, "sample_id").distinct()
    return K.with_batches(samples, BATCH, KEYS).select(*KEYS, "sample_id", "row_idx", "batch_id")


@query(
    "U3_evaluation_targets",
    "tokens",
    sql="""SELECT DISTINCT model, dataset, checkpoint,
                  CASE WHEN checkpoint <> 'final' THEN CAST(regexp_extract(checkpoint, '([0-9]+)$', 1) AS BIGINT) END AS step
           FROM tokens""",
)
def targets(tokens):
    names = tokens.select(*KEYS).distinct()
    steps = K.discover_checkpoints(names, "checkpoint")
    final = names.filter(F.col("checkpoint") == "final").withColumn("step", F.lit(None).cast("bigint"))
    return steps.unionByName(final)


@query(
    "P12_mask_prompt",
    "token_arrays",
    sql="""WITH e AS (SELECT sample_id, prompt_len, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos,
                         UNNEST(string_split(text, ' ')) AS word FROM token_arrays)
           SELECT sample_id, pos, CAST(CASE WHEN pos < prompt_len THEN -100 ELSE length(word) END AS INT) AS label_id FROM e""",
)
def masked(texts):
    ids = F.transform(F.split("text", " "), lambda word: F.length(word))
    labels = texts.select("sample_id", K.mask_prompt(ids, "prompt_len").alias("labels"))
    return labels.select("sample_id", F.posexplode("labels").alias("pos", "label_id")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query(
    "P13_trim_trailing",
    "tokens",
    "vocab",
    sql="""WITH t AS (SELECT *, MAX(CASE WHEN pos >= 3 AND label_id <> -100 AND label_id NOT IN (0, 5) THEN pos END)
                     OVER (PARTITION BY sample_id) AS last FROM tokens)
           SELECT sample_id, pos, CASE WHEN pos < 3 OR last IS NULL OR pos > last THEN -100 ELSE label_id END AS trimmed_label
           FROM t""",
)
def trimmed(tokens, vocab):
    return K.trim_trailing(tokens, vocab, ["sample_id"], F.lit(3)).select("sample_id", "pos", "trimmed_label")


@query(
    "T4_head_samples",
    "chat",
    sql="""SELECT role, conv_id, turn FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM chat) WHERE rn <= 16""",
)
def head(chat):
    return K.head_samples(chat, 16, ["role"], ["conv_id", "turn"]).select("role", "conv_id", "turn")


@query(
    "T4_head_samples_large",
    "sample_lines",
    sql="""SELECT flag, line_key, line_no FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY flag ORDER BY line_key, line_no, part_key, supplier_key) AS rn
             FROM sample_lines) q WHERE rn <= 5000""",
)
def head_large(lines):
    first = K.head_samples(lines, 5000, ["flag"], ["line_key", "line_no", "part_key", "supplier_key"])
    return first.select("flag", "line_key", "line_no")


@query(
    "S3_discover_checkpoints",
    "checkpoint_dirs",
    sql="""SELECT path, CAST(regexp_extract(path, '/checkpoint-([0-9]+)$', 1) AS BIGINT) AS step FROM checkpoint_dirs
           WHERE regexp_matches(path, '/checkpoint-[0-9]+$')""",
)
def checkpoints(listing):
    return K.discover_checkpoints(listing)
