"""Plan and model-selection workloads over texts assembled from driver
tables (stand-in inputs: op and model names are picked per row from the
fixed registries; every parsing, validation and selection step runs in the
library)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators.models import CATALOG
from foldwise.plans.compile import parse_plans, validate_plans
from foldwise.plans.selection import parse_candidates, select_models, task_kind_col
from foldwise.plans.spec import REGISTRY
from foldwise.workloads.common import table, workload

OPS = list(REGISTRY) + ["unknown_op"]
MODELS = list(CATALOG) + ["MysteryNet", "LinearSVC"]


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_PLAN_TEXT_SQL = f"""
e AS (SELECT event_id, event_type AS dataset,
             ({_sql_list(OPS)})[(event_id % {len(OPS)}) + 1] AS op,
             CASE WHEN user_id % 2 = 0 THEN '["value"]' ELSE '["value", "user_id"]' END AS cols FROM events),
r AS (SELECT event_id, dataset,
             '{{"operation": "' || op || '", "columns": ' || cols || ', "output_name": "f_' || CAST(event_id AS VARCHAR)
             || '", "params": {{"bins": 5}}}}' AS rec FROM e),
t AS (SELECT event_id, dataset,
             CASE WHEN event_id % 3 = 0 THEN '```json\n' ELSE '' END
             || CASE WHEN event_id % 2 = 0 THEN '{{"operations": [' || rec || ']}}' ELSE '[' || rec || ']' END
             || CASE WHEN event_id % 3 = 0 THEN '\n```' ELSE '' END AS text FROM r)"""


def _plan_texts(spark, d):
    e = table(spark, d, "events")
    ops = F.array(*[F.lit(o) for o in OPS])
    op = F.element_at(ops, (F.col("event_id") % len(OPS) + 1).cast("int"))
    cols = F.when(F.col("user_id") % 2 == 0, F.lit('["value"]')).otherwise(F.lit('["value", "user_id"]'))
    rec = F.concat(F.lit('{"operation": "'), op, F.lit('", "columns": '), cols, F.lit(', "output_name": "f_'),
                   F.col("event_id").cast("string"), F.lit('", "params": {"bins": 5}}'))
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"operations": ['), rec, F.lit("]}"))) \
        .otherwise(F.concat(F.lit("["), rec, F.lit("]")))
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return e.select("event_id", F.col("event_type").alias("dataset"), fenced.alias("text"))


def _registry_sql():
    rows = ", ".join(f"('{k}', {a}, '{kind}', {str(o).lower()})" for k, (a, kind, o) in REGISTRY.items())
    return f"reg(operation, arity, kind, needs_order) AS (VALUES {rows})"


@workload("plan_parse_validate", f"""
WITH {_PLAN_TEXT_SQL},
b AS (SELECT event_id, dataset, trim(regexp_replace(text, '^\\s*```[A-Za-z]*\\s*|\\s*```\\s*$', '', 'g')) AS body FROM t),
p AS (SELECT event_id, dataset, CASE WHEN starts_with(body, '[')
             THEN from_json(body, '[{{"operation": "VARCHAR", "columns": ["VARCHAR"], "output_name": "VARCHAR"}}]')
             ELSE from_json(body, '{{"operations": [{{"operation": "VARCHAR", "columns": ["VARCHAR"], "output_name": "VARCHAR"}}]}}').operations
             END AS ops FROM b),
u AS (SELECT event_id, dataset, generate_subscripts(ops, 1) - 1 AS seq, unnest(ops) AS o FROM p),
v AS (SELECT event_id, dataset, CAST(seq AS INTEGER) AS seq, o.operation AS operation, o.columns AS columns,
             o.output_name AS output_name FROM u),
{_registry_sql()},
ds(dataset, is_time_series, identity_cols) AS (VALUES ('view', true, ['user_id']), ('click', true, []::VARCHAR[]),
    ('error', false, ['value']), ('purchase', false, []::VARCHAR[]), ('signup', false, ['user_id']))
SELECT v.dataset, v.event_id, v.seq, v.operation, CAST(len(v.columns) AS INTEGER) AS n_columns, reg.kind,
       CASE WHEN reg.arity IS NULL THEN 'unknown_operation'
            WHEN len(v.columns) <> reg.arity THEN 'wrong_arity'
            WHEN reg.needs_order AND NOT coalesce(ds.is_time_series, false) THEN 'needs_time_order'
            WHEN v.operation = 'tfidf_svd' AND coalesce(list_has_any(v.columns, ds.identity_cols), false)
              THEN 'identity_unsafe' END AS error
FROM v LEFT JOIN reg ON v.operation = reg.operation LEFT JOIN ds ON v.dataset = ds.dataset
""")
def plan_parse_validate(spark, d):
    """Feature-plan texts (bare arrays, wrapped objects, code fences) parsed
    into op rows, validated against the 19-op registry (arity, time order,
    identity gate) and routed to immediate / deferred."""
    plans = parse_plans(_plan_texts(spark, d), key=["dataset", "event_id"])
    ds = spark.createDataFrame(
        [("view", True, ["user_id"]), ("click", True, []), ("error", False, ["value"]), ("purchase", False, []),
         ("signup", False, ["user_id"])], "dataset string, is_time_series boolean, identity_cols array<string>")
    v = validate_plans(plans, ds)
    return v.select("dataset", "event_id", F.col("seq").cast("int").alias("seq"), "operation",
                    F.size("columns").alias("n_columns"), "kind", "error")


_CAND_SQL = f"""
c AS (SELECT conv_id AS dataset, turn, ({_sql_list(MODELS)})[((conv_id * 7 + turn) % {len(MODELS)}) + 1] AS model,
             role FROM conversations),
tx AS (SELECT dataset, turn, '{{"models": [{{"model": "' || model || '", "priority": ' || CAST(turn AS VARCHAR)
                || '}}]}}' AS text FROM c),
tk AS (SELECT conv_id AS dataset,
              CASE WHEN lower(CASE conv_id % 3 WHEN 0 THEN 'regression' WHEN 1 THEN 'Binary Classification' ELSE '' END)
                        LIKE '%regress%' THEN 'regression'
                   WHEN lower(CASE conv_id % 3 WHEN 0 THEN 'regression' WHEN 1 THEN 'Binary Classification' ELSE '' END)
                        LIKE '%class%' THEN 'classification'
                   WHEN count(DISTINCT role) <= 50 THEN 'classification' ELSE 'regression' END AS task_kind
       FROM conversations GROUP BY conv_id)"""


@workload("select_models", f"""
WITH {_CAND_SQL},
cat(model, kind, family) AS (VALUES {", ".join(f"('{m}', '{k}', '{f}')" for m, (k, f) in CATALOG.items())}),
p AS (SELECT dataset, turn AS seq,
             unnest(from_json(text, '{{"models": [{{"model": "VARCHAR", "priority": "BIGINT"}}]}}').models) AS m FROM tx),
v AS (SELECT p.dataset, p.seq, p.m.model AS model, p.m.priority AS priority, cat.family
      FROM p JOIN tk ON p.dataset = tk.dataset JOIN cat ON p.m.model = cat.model WHERE cat.kind = tk.task_kind),
d AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY priority, seq) = 1),
g AS (SELECT tk.dataset, CAST(4611686018427387904 AS BIGINT) AS seq,
             CASE WHEN tk.task_kind = 'classification' THEN 'LGBMClassifier' ELSE 'LGBMRegressor' END AS model,
             0 AS priority, 'gbm' AS family
      FROM tk WHERE tk.dataset NOT IN (SELECT dataset FROM d WHERE family = 'gbm')),
a AS (SELECT * FROM d UNION ALL SELECT * FROM g)
SELECT dataset, model, CAST(row_number() OVER (PARTITION BY dataset ORDER BY priority, seq) AS INTEGER) AS priority FROM a
""")
def select_models_workload(spark, d):
    """Model-candidate texts (one JSON list per conversation turn) parsed,
    filtered to known models of the dataset's task kind with a search
    space, deduplicated by best priority, a default GBM forced in when
    missing, renumbered."""
    conv = table(spark, d, "conversations")
    models = F.array(*[F.lit(m) for m in MODELS])
    c = conv.select(F.col("conv_id").alias("dataset"), "turn", "role",
                    F.element_at(models, ((F.col("conv_id") * 7 + F.col("turn")) % len(MODELS) + 1).cast("int"))
                    .alias("model"))
    # one candidate text per turn (no per-conversation gathering)
    texts = c.select("dataset", "turn", F.concat(F.lit('{"models": [{"model": "'), F.col("model"),
                                                 F.lit('", "priority": '), F.col("turn").cast("string"),
                                                 F.lit("}]}")).alias("text"))
    pt = F.when(F.col("dataset") % 3 == 0, "regression").when(F.col("dataset") % 3 == 1, "Binary Classification") \
        .otherwise("")
    tasks = conv.groupBy(F.col("conv_id").alias("dataset")).agg(F.count_distinct("role").alias("n_distinct")) \
        .select("dataset", task_kind_col(pt, F.lit(""), F.col("n_distinct")).alias("task_kind"))
    cands = parse_candidates(texts, default_kind=tasks, order="turn")
    sel = select_models(cands, tasks)
    return sel.select("dataset", "model", F.col("priority").cast("int").alias("priority"))




def _imm_plan():
    from foldwise.plans.spec import FeatureOp
    return [FeatureOp.of("log_transform", "o_totalprice", "log_tp"),
            FeatureOp.of("bin_equal_width", "o_totalprice", "bw_tp", bins=10),
            FeatureOp.of("count_encoding", "o_custkey", "ce_cust"),
            FeatureOp.of("datetime_parts", "o_orderdate", "od"),
            FeatureOp.of("target_encode", "o_orderpriority", "te_prio")]


@workload("immediate_features", """
WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
                  CAST(o_orderstatus = 'F' AS INTEGER) AS y,
                  CASE WHEN o_orderkey % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM orders),
s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(epoch_us(o_orderdate)) AS t0 FROM b WHERE split = 'train'),
ce AS (SELECT o_custkey AS k, count(*) AS n FROM b WHERE split = 'train' GROUP BY 1),
f AS (SELECT b.o_orderkey, b.split, CAST(b.o_custkey AS DOUBLE) AS o_custkey, b.o_totalprice, b.o_orderpriority,
             ln(1 + b.o_totalprice) AS log_tp,
             CAST(len(list_filter(list_transform(range(1, 10), lambda i: lo + i * ((hi - lo) / 10)),
                                  lambda e: b.o_totalprice > e)) AS DOUBLE) AS bw_tp,
             CAST(coalesce(ce.n, 0) AS DOUBLE) AS ce_cust,
             CAST(year(o_orderdate) AS DOUBLE) AS od_year, CAST(month(o_orderdate) AS DOUBLE) AS od_month,
             CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS od_dow, CAST(hour(o_orderdate) AS DOUBLE) AS od_hour,
             CAST(floor((epoch_us(o_orderdate) - t0) / 86400000000.0) AS DOUBLE) AS od_days_since_min
      FROM b CROSS JOIN s LEFT JOIN ce ON b.o_custkey = ce.k),
cp AS (SELECT k, row_number() OVER (ORDER BY fst, k) - 1 AS code
       FROM (SELECT o_orderpriority AS k, min(o_orderkey) AS fst FROM b WHERE split = 'train' GROUP BY 1))
SELECT o_orderkey, split, round(o_custkey, 6) AS o_custkey, round(o_totalprice, 6) AS o_totalprice,
       CAST(coalesce(cp.code, -1) AS BIGINT) AS o_orderpriority, round(log_tp, 6) AS log_tp, round(bw_tp, 6) AS bw_tp,
       round(ce_cust, 6) AS ce_cust, round(od_year, 6) AS od_year, round(od_month, 6) AS od_month,
       round(od_dow, 6) AS od_dow, round(od_hour, 6) AS od_hour, round(od_days_since_min, 6) AS od_days_since_min
FROM f LEFT JOIN cp ON f.o_orderpriority = cp.k
""")
def immediate_features(spark, d):
    """A feature plan compiled on orders: immediate ops fitted on the train
    role in one aggregate plus a lookup, applied to both roles in one
    projection, matrix columns selected (datetime and target dropped, the
    deferred op routed away) and prepared (median fill, first-appearance codes)."""
    from foldwise.plans.compile import compile_plan
    from foldwise.workloads.common import is_test, r

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                         "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    train, test = o.filter(~is_test("o_orderkey")), o.filter(is_test("o_orderkey")).drop("y")
    cp = compile_plan(train, test, _imm_plan(), id_column="o_orderkey", targets=["y"], order_by="o_orderkey",
                      datetime_cols=["o_orderdate"])
    tr = cp.train.drop("y").withColumn("split", F.lit("train"))
    te = cp.test.withColumn("split", F.lit("test"))
    out = tr.unionByName(te)
    codes = ["o_orderpriority"]
    return out.select("o_orderkey", "split", *[F.col(c) if c in codes else r(c) for c in cp.features])


_ERROR_COUNTS_SQL = f"""
WITH {_PLAN_TEXT_SQL},
b AS (SELECT event_id, dataset, trim(regexp_replace(text, '^\\s*```[A-Za-z]*\\s*|\\s*```\\s*$', '', 'g')) AS body FROM t),
p AS (SELECT event_id, dataset, CASE WHEN starts_with(body, '[')
             THEN from_json(body, '[{{"operation": "VARCHAR", "columns": ["VARCHAR"], "output_name": "VARCHAR"}}]')
             ELSE from_json(body, '{{"operations": [{{"operation": "VARCHAR", "columns": ["VARCHAR"], "output_name": "VARCHAR"}}]}}').operations
             END AS ops FROM b),
v AS (SELECT event_id, dataset, unnest(ops) AS o FROM p),
{_registry_sql()},
ds(dataset, is_time_series, identity_cols) AS (VALUES ('view', true, ['user_id']), ('click', true, []::VARCHAR[]),
    ('error', false, ['value']), ('purchase', false, []::VARCHAR[]), ('signup', false, ['user_id'])),
errs AS (SELECT CASE WHEN reg.arity IS NULL THEN 'unknown_operation'
                  WHEN len(o.columns) <> reg.arity THEN 'wrong_arity'
                  WHEN reg.needs_order AND NOT coalesce(ds.is_time_series, false) THEN 'needs_time_order'
                  WHEN o.operation = 'tfidf_svd' AND coalesce(list_has_any(o.columns, ds.identity_cols), false)
                    THEN 'identity_unsafe' END AS error_type
      FROM v LEFT JOIN reg ON o.operation = reg.operation LEFT JOIN ds ON v.dataset = ds.dataset)
SELECT 'features' AS phase, error_type, count(*) AS n FROM errs WHERE error_type IS NOT NULL GROUP BY 1, 2
"""


@workload("plan_error_counts", _ERROR_COUNTS_SQL)
def plan_error_counts(spark, d):
    """Skipped-op log: validation errors of the parsed plans appended to an
    errors table and counted per (phase, error type)."""
    from foldwise.operators.history import error_counts

    return error_counts(_plan_errors(spark, d))


@workload("error_log", _ERROR_COUNTS_SQL)
def error_log(spark, d):
    """The same counts from an append-only error log whose phase was written
    twice: a run, phase and plan holds the rows of its last write."""
    from foldwise.operators.history import error_counts
    from foldwise.sources.logs import append_log, read_log
    from foldwise.workloads.io import _scratch

    errors, path = _plan_errors(spark, d), f"{_scratch(spark)}/errors"
    append_log(errors, path)
    append_log(errors, path)
    return error_counts(read_log(spark, path, ["run_id", "phase", "event_id"]))


def _plan_errors(spark, d):
    plans = parse_plans(_plan_texts(spark, d), key=["dataset", "event_id"])
    ds = spark.createDataFrame(
        [("view", True, ["user_id"]), ("click", True, []), ("error", False, ["value"]), ("purchase", False, []),
         ("signup", False, ["user_id"])], "dataset string, is_time_series boolean, identity_cols array<string>")
    v = validate_plans(plans, ds).filter(F.col("error").isNotNull())
    return v.select(F.col("dataset").alias("run_id"), F.lit("features").alias("phase"), "event_id", F.col("error").alias("error_type"),
                    F.col("output_name").alias("message"))


@workload("plan_skips_failing_ops", """
WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM orders),
ce AS (SELECT o_custkey AS k, count(*) AS n FROM b WHERE split = 'train' GROUP BY 1)
SELECT b.o_orderkey, b.split, round(ln(1 + o_totalprice), 6) AS log_tp, round(CAST(coalesce(ce.n, 0) AS DOUBLE), 6) AS ce_cust,
       'log_gone:missing_column,log_text:not_numeric,mult_text:not_numeric,flat:constant or empty column: duplicate bin edges' AS skipped
FROM b LEFT JOIN ce ON b.o_custkey = ce.k
""")
def plan_skips_failing_ops(spark, d):
    """A plan with ops on a missing column, on texts and on a constant column:
    these are logged and skipped, and the others are applied to both roles."""
    from foldwise.plans.compile import compile_plan
    from foldwise.plans.spec import FeatureOp
    from foldwise.workloads.common import is_test, r

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.lit(1.0).alias("one"),
                                         (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    ops = [FeatureOp.of("log_transform", "o_gone", "log_gone"), FeatureOp.of("log_transform", "o_orderpriority", "log_text"),
           FeatureOp.of("interaction_multiply", ["o_totalprice", "o_orderpriority"], "mult_text"), FeatureOp.of("bin_equal_width", "one", "flat"),
           FeatureOp.of("log_transform", "o_totalprice", "log_tp"), FeatureOp.of("count_encoding", "o_custkey", "ce_cust")]
    cp = compile_plan(o.filter(~is_test("o_orderkey")), o.filter(is_test("o_orderkey")).drop("y"), ops, id_column="o_orderkey",
                      targets=["y"], order_by="o_orderkey")
    both = cp.train.drop("y").withColumn("split", F.lit("train")).unionByName(cp.test.withColumn("split", F.lit("test")))
    return both.select("o_orderkey", "split", r("log_tp"), r("ce_cust"), F.lit(",".join(f"{n}:{e}" for n, e in cp.errors)).alias("skipped"))


@workload("registered_op", """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 = 4 AS test, o_totalprice, o_orderpriority, o_custkey FROM orders),
g AS (SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM o WHERE NOT test GROUP BY 1),
q AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM o WHERE NOT test)
SELECT o_orderkey, CASE WHEN test THEN 'test' ELSE 'train' END AS split, round((o_totalprice - m) / s, 6) AS z, round((o_custkey - lo) / (hi - lo), 6) AS span_unit, round(2 * (o_custkey - lo) / (hi - lo) - 1, 6) AS span_signed
FROM o JOIN g USING (o_orderpriority), q
""")
def registered_op(spark, d):
    """Two ops of the user's own, the 20th and 21st, through plan texts,
    validation and the compiled plan: a score within the row's group (a table
    by key) and a rescaling to the range of train (one row, two outputs)."""
    from foldwise.plans.compile import compile_plan
    from foldwise.plans.spec import FeatureOp, registered
    from foldwise.workloads.common import is_test, r

    def fit_z(train, op):
        g, v = op.columns
        return train.groupBy(g).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))

    def fit_span(train, op):
        return train.agg(F.min(op.columns[0]).alias("lo"), F.max(op.columns[0]).alias("hi"))

    def apply_span(op, s):
        share = (F.col(op.columns[0]) - s["lo"]) / (s["hi"] - s["lo"])
        return {f"{op.output_name}_unit": share, f"{op.output_name}_signed": 2 * share - 1}

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey")
    with registered("group_zscore", 2, fit_z, lambda op, s: (F.col(op.columns[1]) - s["mean"]) / s["sd"], keyed=True), registered("rescale", 1, fit_span, apply_span):
        texts = spark.createDataFrame([("o", '[{"operation": "group_zscore", "columns": ["o_orderpriority", "o_totalprice"], "output_name": "z"}, '
                                             '{"operation": "rescale", "columns": ["o_custkey"], "output_name": "span"}, {"operation": "rescale", "columns": [], "output_name": "bad"}]')], "dataset string, text string")
        ops = [FeatureOp.of(x["operation"], list(x["columns"]), x["output_name"]) for x in parse_plans(texts).orderBy("seq").collect()]
        cp = compile_plan(o.filter(~is_test("o_orderkey")), o.filter(is_test("o_orderkey")), ops, id_column="o_orderkey", targets=[], order_by="o_orderkey")
        if cp.errors != [("bad", "wrong_arity")]:
            raise RuntimeError(f"unexpected plan errors: {cp.errors}")
        both = cp.train.withColumn("split", F.lit("train")).unionByName(cp.test.withColumn("split", F.lit("test")))
    return both.select("o_orderkey", "split", r("z"), r("span_unit"), r("span_signed"))
