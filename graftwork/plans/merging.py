"""Parameter merging queries."""

from pyspark.sql import functions as F

from graftwork.operators import merging as M
from graftwork.operators import ranking as R
from graftwork.operators.sparsify import trim
from graftwork.plans.registry import query

SEED = 42

_RECIPE = """r AS (SELECT target_task AS target, param_model AS model, rn - 1 AS ord, accuracy AS weight,
             CASE WHEN rn = 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS density FROM (
               SELECT *, ROW_NUMBER() OVER (PARTITION BY target_task ORDER BY accuracy DESC, eval_dir) AS rn
               FROM eval_docs_m WHERE source_task <> target_task) q WHERE rn <= 2)"""
_ELEMENTS = """e AS (SELECT model, tensor, block_no, generate_subscripts(values_, 1) - 1 AS pos,
               CAST(UNNEST(values_) AS DOUBLE) AS v FROM param_blocks)"""
_DELTAS = """d AS (SELECT e.model, e.tensor, e.block_no, e.pos, b.v AS base, CAST(e.v - b.v AS FLOAT) AS delta
             FROM e JOIN e b ON b.model = 'base' AND b.tensor = e.tensor AND b.block_no = e.block_no AND b.pos = e.pos
             WHERE e.model <> 'base')"""
# Adding zero last turns a rounded -0.0 into 0.0.
_ROUND = "ROUND(CAST(CAST({} AS FLOAT) AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def recipe(docs):
    best = R.select_topk(R.leave_one_out(docs), 2, "accuracy", "proportional")
    return R.as_recipe(best, model="param_model")


def with_density(docs):
    return recipe(docs).withColumn("density", F.when(F.col("ord") == 0, 0.5).otherwise(0.3))


def adapters(params):
    return params.filter(F.col("model") != "base")


def base_of(params):
    return params.filter(F.col("model") == "base").drop("model")


def elements(merged):
    """One row per parameter, for comparison."""
    long = merged.select("target", "tensor", "block_no", F.posexplode("values_").alias("pos", "v"))
    return long.select(
        "target", "tensor", "block_no", F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("v").cast("double"), 6).alias("value"),
    )


@query(
    "M1_average_params",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE}, {_ELEMENTS}
            SELECT target, tensor, block_no, pos, {_ROUND.format('AVG(v)')} AS value
            FROM r JOIN e USING (model) GROUP BY target, tensor, block_no, pos""",
)
def average(docs, params):
    return elements(M.average_params(params, recipe(docs), partial=True))


@query(
    "M2_linear_merge",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE}, {_ELEMENTS}
            SELECT target, tensor, block_no, pos, {_ROUND.format('SUM(v * weight) / SUM(weight)')} AS value
            FROM r JOIN e USING (model) GROUP BY target, tensor, block_no, pos""",
)
def linear(docs, params):
    return elements(M.linear_merge(params, recipe(docs), partial=True))


_SIGNED = """
x AS (SELECT target, tensor, block_no, pos, base, weight, t, SUM(t * weight) OVER (PARTITION BY target, tensor, block_no, pos) AS s
      FROM k),
m AS (SELECT target, tensor, block_no, pos, MAX(base) AS base,
             SUM(CASE WHEN SIGN(t) = SIGN(s) THEN t * weight ELSE 0 END) AS num,
             SUM(CASE WHEN SIGN(t) = SIGN(s) AND t <> 0 THEN weight ELSE 0 END) AS den
      FROM x GROUP BY target, tensor, block_no, pos)
SELECT target, tensor, block_no, pos,
       ROUND(CAST(CAST(base + num / CASE WHEN ABS(den) < 1e-8 THEN 1 ELSE den END AS FLOAT) AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS value FROM m
"""


_DROPS = f"""h0 AS (SELECT *, (('0x' || substr(md5('{SEED}|' || model || '|' || tensor || '|' || block_no), 1, 8))::UBIGINT
         + pos::UBIGINT * 2654435769::UBIGINT) % 4294967296::UBIGINT AS h FROM d),
h1 AS (SELECT * REPLACE ((xor(h, h >> 16) * 2246822507::UBIGINT) % 4294967296::UBIGINT AS h) FROM h0),
h2 AS (SELECT * REPLACE ((xor(h, h >> 13) * 3266489909::UBIGINT) % 4294967296::UBIGINT AS h) FROM h1),
h3 AS (SELECT * REPLACE (xor(h, h >> 16) AS h) FROM h2),
k AS (SELECT target, tensor, block_no, pos, base, weight,
             CASE WHEN h < FLOOR(density * 4294967296) THEN CAST(delta AS DOUBLE) / density ELSE 0 END AS t
      FROM r JOIN h3 USING (model)),"""


@query(
    "M3_ties_merge",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE}, {_ELEMENTS}, {_DELTAS},
k AS (SELECT target, tensor, block_no, pos, base, weight,
             CASE WHEN ROW_NUMBER() OVER (PARTITION BY target, model, tensor ORDER BY ABS(delta) DESC, block_no, pos)
                       <= FLOOR(density * COUNT(*) OVER (PARTITION BY target, model, tensor))
                  THEN CAST(delta AS DOUBLE) ELSE 0 END AS t
      FROM r JOIN d USING (model)),
{_SIGNED}""",
)
def ties(docs, params):
    return elements(M.ties_merge(adapters(params), base_of(params), with_density(docs), partial=True))


@query(
    "M3_ties_merge_untrimmed",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE}, {_ELEMENTS}, {_DELTAS},
k AS (SELECT target, tensor, block_no, pos, base, weight, CAST(delta AS DOUBLE) AS t FROM r JOIN d USING (model)),
{_SIGNED}""",
)
def ties_whole(docs, params):
    return elements(M.ties_merge(adapters(params), base_of(params), recipe(docs), partial=True))


@query(
    "M4_dare_ties_merge",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE}, {_ELEMENTS}, {_DELTAS},
{_DROPS}
{_SIGNED}""",
)
def dare_ties(docs, params):
    return elements(M.dare_ties_merge(adapters(params), base_of(params), with_density(docs), SEED, partial=True))


@query(
    "M5_normalize_recipe",
    "eval_docs_m",
    sql="""SELECT target_task AS target, param_model AS model, COALESCE(CASE WHEN accuracy > 0.33 THEN accuracy END, 1.0) AS weight,
                  CAST(1.0 AS DOUBLE) AS density FROM eval_docs_m""",
)
def defaults(docs):
    raw = docs.select(
        F.col("target_task").alias("target"),
        F.col("param_model").alias("model"),
        F.when(F.col("accuracy") > 0.33, F.col("accuracy")).alias("weight"),
    )
    return M.normalize_recipe(raw)


# The same merges through the one entry, which strips full embeddings except for plain averages.
_STRIPPED = """NOT ((contains(tensor, 'embed_tokens') OR contains(tensor, 'lm_head'))
                      AND NOT (contains(tensor, 'lora_A') OR contains(tensor, 'lora_B')))"""


def _entry(name, method, sql, with_density_=False):
    @query(name, "eval_docs_m", "param_blocks", sql=f"SELECT * FROM ({sql}) s WHERE {_STRIPPED}" if method != M.AVERAGE else sql)
    def through_entry(docs, params):
        rows = with_density(docs) if with_density_ else recipe(docs)
        return elements(M.merge(method, adapters(params), rows, base_of(params), seed=SEED, partial=True))


_entry("M1_merge_average", M.AVERAGE, f"""WITH {_RECIPE}, {_ELEMENTS}
            SELECT target, tensor, block_no, pos, {_ROUND.format('AVG(v)')} AS value
            FROM r JOIN e USING (model) GROUP BY target, tensor, block_no, pos""")  # fmt: skip
_entry("M2_merge_linear", M.LINEAR, f"""WITH {_RECIPE}, {_ELEMENTS}
            SELECT target, tensor, block_no, pos, {_ROUND.format('SUM(v * weight) / SUM(weight)')} AS value
            FROM r JOIN e USING (model) GROUP BY target, tensor, block_no, pos""")  # fmt: skip
_entry("M3_merge_ties", M.TIES, f"""WITH {_RECIPE}, {_ELEMENTS}, {_DELTAS},
k AS (SELECT target, tensor, block_no, pos, base, weight, CAST(delta AS DOUBLE) AS t FROM r JOIN d USING (model)),
{_SIGNED}""")  # fmt: skip


@query(
    "M2_merge_full_models",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE}, {_ELEMENTS}
            SELECT target, tensor, block_no, pos, {_ROUND.format('SUM(v * weight) / SUM(weight)')} AS value
            FROM r JOIN e USING (model) WHERE NOT contains(tensor, 'lora_') GROUP BY target, tensor, block_no, pos""",
)
def full_models(docs, params):
    """Models without low-rank factors keep embeddings and head."""
    return elements(M.merge(M.LINEAR, adapters(params).filter(~F.col("tensor").contains("lora_")), recipe(docs), partial=True))


# Layers of 16 x 16 weights out of four blocks; of the models, m3 is a whole one and
# the others are adapters of rank 4 with one block for each factor.
_LAYERED = """
ly AS (SELECT model, regexp_extract(tensor, 'layers.([0-9]+)', 1) || '.' || (block_no // 4) AS layer, block_no % 4 AS part, pos, v
      FROM e WHERE tensor LIKE 'layers.%'),
ly_whole AS (SELECT layer FROM ly GROUP BY layer HAVING COUNT(DISTINCT model || part) = 20),
ly_rows AS (SELECT ly.* FROM ly JOIN ly_whole USING (layer)),
ly_base AS (SELECT layer, (part * 64 + pos) // 16 AS i, (part * 64 + pos) % 16 AS j, v FROM ly_rows WHERE model = 'base'),
ly_product AS (SELECT model, layer, b.pos // 4 AS i, a.pos % 16 AS j, SUM(a.v * b.v) AS p
       FROM ly_rows a JOIN ly_rows b USING (model, layer)
       WHERE model NOT IN ('base', 'm3') AND a.part = 0 AND b.part = 1 AND a.pos // 16 = b.pos % 4 GROUP BY ALL),
ly_models AS (SELECT model, layer, i, j, CAST(ly_base.v + CAST(CAST((CAST(SUBSTR(model, 2) AS INT) + 1) / 4 * p AS FLOAT) AS DOUBLE) AS FLOAT) AS v, ly_base.v AS base
      FROM ly_product JOIN ly_base USING (layer, i, j)
      UNION ALL SELECT model, ly_rows.layer, ly_base.i, ly_base.j, CAST(ly_rows.v AS FLOAT), ly_base.v
      FROM ly_rows JOIN ly_base ON ly_base.layer = ly_rows.layer AND ly_base.i = (part * 64 + pos) // 16 AND ly_base.j = (part * 64 + pos) % 16 WHERE model = 'm3'),
d AS (SELECT model, 'layers.' || layer || '.weight' AS tensor, (i * 16 + j) // 64 AS block_no, (i * 16 + j) % 64 AS pos, base,
             CAST(v AS DOUBLE) AS v, CAST(CAST(v AS DOUBLE) - base AS FLOAT) AS delta FROM ly_models)"""


def layered(params):
    """Adapters and one full model, their base, and the scales of the adapters."""
    rows = params.filter("tensor LIKE 'layers.%'").select(
        "model", F.concat(F.regexp_extract("tensor", r"layers\.(\d+)", 1), F.lit("."), F.floor(F.col("block_no") / 4)).alias("layer"),
        (F.col("block_no") % 4).alias("part"), "values_",
    )
    whole = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).filter("n = 20").select("layer")
    rows = rows.join(whole, "layer")
    shape = lambda a, b: F.array(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")).alias("shape")
    weight = F.concat(F.lit("layers."), F.col("layer"), F.lit(".weight")).alias("tensor")
    factor = F.concat(F.lit("base_model.model.layers."), F.col("layer"), F.lit(".lora_"), F.when(F.col("part") == 0, "A").otherwise("B"), F.lit(".weight"))
    full = rows.select("model", weight, F.col("part").alias("block_no"), "values_", shape(16, 16))
    pairs = rows.filter("model NOT IN ('base', 'm3') AND part < 2").select(
        "model", factor.alias("tensor"), F.lit(0).cast("bigint").alias("block_no"), "values_",
        F.when(F.col("part") == 0, shape(4, 16)).otherwise(shape(16, 4)).alias("shape"),
    )
    models = pairs.unionByName(full.filter("model = 'm3'"))
    scales = pairs.select("model").distinct().withColumn("scale", (F.substring("model", 2, 9).cast("int") + 1) / 4)
    return models, full.filter("model = 'base'").drop("model"), scales


def _adapted(name, method, sql, with_density_=False):
    @query(name, "eval_docs_m", "param_blocks", sql=f"WITH {_RECIPE}, {_ELEMENTS}, {_LAYERED}{sql}")
    def through_products(docs, params):
        models, base, scales = layered(params)
        rows = with_density(docs) if with_density_ else recipe(docs)
        return elements(M.merge_onto_base(method, models, rows, base, scales, seed=SEED))


_adapted("M2_adapters_linear", M.LINEAR, f"""
SELECT target, tensor, block_no, pos, {_ROUND.format('SUM(v * weight) / SUM(weight)')} AS value
FROM r JOIN d USING (model) GROUP BY target, tensor, block_no, pos""")  # fmt: skip
_adapted("M3_adapters_ties", M.TIES, f""",
k AS (SELECT target, tensor, block_no, pos, base, weight,
             CASE WHEN ROW_NUMBER() OVER (PARTITION BY target, model, tensor ORDER BY ABS(delta) DESC, block_no, pos)
                       <= FLOOR(density * COUNT(*) OVER (PARTITION BY target, model, tensor))
                  THEN CAST(delta AS DOUBLE) ELSE 0 END AS t
      FROM r JOIN d USING (model)),
{_SIGNED}""", with_density_=True)  # fmt: skip
_adapted("M4_adapters_dare_ties", M.DARE_TIES, f""",
{_DROPS}
{_SIGNED}""", with_density_=True)  # fmt: skip


_RAGGED = """NOT (model = 'm1' AND block_no = 0) AND NOT (model = 'm2')"""
_NO_BASE = """NOT (contains(tensor, 'lm_head') AND block_no = 1)"""


@query(
    "M0_merge_gaps",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE},
            p AS (SELECT model, tensor, block_no FROM param_blocks WHERE model <> 'base' AND {_RAGGED}),
            b AS (SELECT tensor, block_no FROM param_blocks WHERE model = 'base' AND {_NO_BASE}),
            h AS (SELECT target, model, tensor, block_no FROM r JOIN p USING (model)),
            a AS (SELECT target, model FROM r WHERE model NOT IN (SELECT model FROM p)),
            w AS (SELECT DISTINCT h.target, r.model, h.tensor, h.block_no FROM h JOIN r USING (target))
            SELECT target, model, tensor, block_no, 'no such block' AS problem FROM w
            WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.target = w.target AND h.model = w.model AND h.tensor = w.tensor AND h.block_no = w.block_no)
              AND NOT EXISTS (SELECT 1 FROM a WHERE a.target = w.target AND a.model = w.model)
            UNION ALL SELECT target, model, NULL, NULL, 'no parameters' FROM a
            UNION ALL SELECT DISTINCT target, 'base', tensor, block_no, 'no such block' FROM h
            WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tensor = h.tensor AND b.block_no = h.block_no)""",
)
def gaps(docs, params):
    return M.merge_gaps(recipe(docs), adapters(params).filter(_RAGGED), base_of(params.filter(_NO_BASE)))


_FAULTY = """f AS (SELECT target, CASE WHEN target = 't7' AND ord = 1 THEN 'm9' ELSE model END AS model
             FROM r WHERE NOT (target = 't6' AND ord = 1))"""


@query(
    "M6_recipe_problems",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE}, {_FAULTY}
            SELECT target, CAST(NULL AS VARCHAR) AS model, 'fewer than 2 models' AS problem FROM f GROUP BY target HAVING COUNT(*) < 2
            UNION ALL
            SELECT target, model, 'no parameters' FROM f WHERE model NOT IN (SELECT model FROM param_blocks)""",
)
def problems(docs, params):
    swapped = F.when((F.col("target") == "t7") & (F.col("ord") == 1), "m9").otherwise(F.col("model"))
    faulty = recipe(docs).withColumn("model", swapped).filter("NOT (target = 't6' AND ord = 1)")
    return M.recipe_problems(faulty, params)


@query(
    "F6_strip_embeddings",
    "param_blocks",
    sql="""SELECT model, tensor, block_no FROM param_blocks
           WHERE NOT ((contains(tensor, 'embed_tokens') OR contains(tensor, 'lm_head'))
                      AND NOT (contains(tensor, 'lora_A') OR contains(tensor, 'lora_B')))""",
)
def stripped(params):
    return M.strip_embeddings(params).select("model", "tensor", "block_no")


@query(
    "J10_task_vectors",
    "param_blocks",
    sql=f"""WITH {_ELEMENTS}, {_DELTAS}
            SELECT model, tensor, block_no, pos, ROUND(CAST(delta AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS delta FROM d""",
)
def vectors(params):
    out = M.task_vectors(adapters(params), base_of(params), partial=True)
    long = out.select("model", "tensor", "block_no", F.posexplode("delta").alias("pos", "d"))
    return long.select(
        "model", "tensor", "block_no", F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("d").cast("double"), 6).alias("delta"),
    )


@query(
    "J11_apply_recipe",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {_RECIPE} SELECT target, model, ord, weight, tensor, block_no FROM r JOIN param_blocks USING (model)""",
)
def selected_blocks(docs, params):
    rows = M.apply_recipe(recipe(docs), params)
    return rows.select("target", "model", "ord", "weight", "tensor", "block_no")


@query(
    "W9_magnitude_trim",
    "param_blocks",
    sql=f"""WITH {_ELEMENTS}, {_DELTAS},
            w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model, tensor ORDER BY ABS(delta) DESC, block_no, pos) AS rn,
                         COUNT(*) OVER (PARTITION BY model, tensor) AS n FROM d)
            SELECT model, tensor, block_no, pos, ROUND(CAST(delta AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS delta FROM w WHERE rn <= FLOOR(0.2 * n)""",
)
def trimmed(params):
    vectors_ = M.task_vectors(adapters(params), base_of(params), partial=True).withColumn("density", F.lit(0.2))
    long = trim(vectors_).select("model", "tensor", "block_no", F.posexplode("delta").alias("pos", "d"))
    return long.filter("d <> 0").select(
        "model", "tensor", "block_no", F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("d").cast("double"), 6).alias("delta"),
    )
