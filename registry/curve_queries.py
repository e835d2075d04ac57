"""Curves, fits, crossovers, figure data and comparisons on the runs view."""

from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.functions.numeric import power_law
from curvekit.operators import crossover as X
from curvekit.operators import curves as H
from curvekit.operators import fit as L
from curvekit.operators import series as K
from curvekit.operators import stats as Q
from curvekit.operators.config import method_colour, method_label
from curvekit.operators.fit_batch import fit_many_groups
from curvekit.plans.analysis import analyse
from curvekit.session import materialize, scratch_path
from curvekit.sources import readers, writers
from registry import check_sql as S
from registry import views as V
from registry.catalog import query, r, rounded
from registry.run_queries import bucketed_runs


def _analysis(spark, sf):
    return analyse(V.method_runs(spark, sf))


def _fits(spark, sf):
    return _analysis(spark, sf).fits


BASE = f"WITH RECURSIVE {S.METHOD_RUNS}, {S.curve()}"
FITTED = f"{BASE}, {S.fits()}"
CROSSED = f"{FITTED}, {S.crossings()}"
PARAMETERS = f"{r('a', 3)} AS a, {r('b', 3)} AS b, {r('c', 3)} AS c, {r('r2')} AS r2"
PRECISION = {"a": 3, "b": 3, "c": 3, "n_cross": 2}


@query(
    "curve_fit_crossover_summary",
    f"""{CROSSED} SELECT method, 'ok' AS fit_status, {PARAMETERS}, n_points, {r("n_cross", 2)} AS n_cross
    FROM fits LEFT JOIN crossings USING (method)""",
)
def summary(spark, sf):
    return rounded(_analysis(spark, sf).summary, **PRECISION)


@query(
    "h1_learning_curve",
    f"{BASE} SELECT method, n, {r('mean')} AS mean, {r('std')} AS std, cnt, {r('error')} AS error FROM points",
)
def learning_curve(spark, sf):
    return rounded(H.learning_curve(V.method_runs(spark, sf)))


@query(
    "h1_exact_learning_curve",
    f"""WITH {S.METHOD_RUNS}, means AS (
      SELECT method, train_subset_size, favg(primary_metric) AS mean FROM method_runs GROUP BY ALL)
    SELECT method, CAST(train_subset_size AS DOUBLE) AS n, {r("any_value(mean)", 13)} AS mean,
      {r("sqrt(fsum(pow(primary_metric - mean, 2)) / (count(primary_metric) - 1))", 13)} AS std,
      count(primary_metric) AS cnt, {r("1 - any_value(mean)", 13)} AS error
    FROM method_runs JOIN means USING (method, train_subset_size) GROUP BY method, train_subset_size""",
)
def exact_learning_curve(spark, sf):
    """Thirteen digits are compared, as no order of summation takes part."""
    return rounded(H.exact_learning_curve(V.method_runs(spark, sf)), 13)


@query(
    "h1_learning_curve_by_task_model",
    f"""WITH {S.RUNS}, {S.curve("runs", "task_name, model_name, method")}
    SELECT task_name, model_name, method, n, {r("mean")} AS mean, {r("std")} AS std, cnt,
      {r("error")} AS error FROM points""",
)
def learning_curve_by_task(spark, sf):
    return rounded(H.learning_curve(V.runs(spark, sf), ["task_name", "model_name", "method"]))


@query(
    "h2_error_bars", f"{BASE} SELECT method, n, {r('mean')} AS mean, {r('std')} AS std FROM points"
)
def error_bars(spark, sf):
    return rounded(H.error_bars(H.learning_curve(V.method_runs(spark, sf))))


@query(
    "h3_ranked_means",
    f"""{BASE} SELECT method, n, {r("mean")} AS mean, CASE method WHEN 'lora' THEN 1
      WHEN 'bitfit' THEN 2 WHEN 'topheavy_lora' THEN 3 ELSE 4 END AS draw_order FROM points""",
)
def ranked_means(spark, sf):
    return rounded(H.ranked_means(H.learning_curve(V.method_runs(spark, sf))))


@query(
    "h4_performance_and_share",
    f"""WITH {S.METHOD_RUNS} SELECT method, CAST(train_subset_size AS DOUBLE) AS n,
      {r("avg(primary_metric)")} AS perf, {r("avg(trainable_percentage)")} AS params
    FROM method_runs GROUP BY method, train_subset_size""",
)
def performance_and_share(spark, sf):
    return rounded(H.mean_performance_and_share(V.method_runs(spark, sf)))


@query(
    "h5_curves_at_several_levels",
    f"""WITH {S.METHOD_RUNS}
    SELECT CASE WHEN grouping(line_architecture) = 1 THEN 'method' ELSE 'method+architecture' END AS level,
      line_architecture AS architecture, method, CAST(train_subset_size AS DOUBLE) AS n,
      {r("avg(primary_metric)")} AS mean, {r("stddev_samp(primary_metric)")} AS std,
      count(primary_metric) AS cnt, {r("1 - avg(primary_metric)")} AS error
    FROM method_runs
    GROUP BY GROUPING SETS ((method, train_subset_size), (line_architecture, method, train_subset_size))""",
)
def curves_at_levels(spark, sf):
    return rounded(H.learning_curve_levels(V.method_runs(spark, sf)))


@query(
    "p12_error_rate", f"{BASE} SELECT method, n, {r('1 - mean')} AS error FROM points"
)
def error_rate(spark, sf):
    return rounded(H.learning_curve(V.method_runs(spark, sf)).select("method", "n", "error"))


@query(
    "f1_one_method_curve",
    f"{BASE} SELECT method, n, {r('mean')} AS mean, cnt FROM points WHERE method = 'lora'",
)
def one_method(spark, sf):
    runs = V.method_runs(spark, sf).where("method = 'lora'")
    return rounded(H.learning_curve(runs).select("method", "n", "mean", "cnt"))


@query(
    "f3_minimum_points",
    f"""WITH {S.RUNS}, monthly AS (SELECT *, strftime(started, '%Y-%m') AS month FROM runs),
      {S.curve("monthly", "month, model_name, seed, method")}
    SELECT month, model_name, seed, method, count(*) AS n_points FROM points
    GROUP BY ALL HAVING count(*) >= 3""",
)
def minimum_points(spark, sf):
    keys = ["month", "model_name", "seed", "method"]
    monthly = V.runs(spark, sf).withColumn("month", F.date_format("started", "yyyy-MM"))
    fits = L.fit_power_law(materialize(H.learning_curve(monthly, keys), "curve"), keys)
    return fits.where("fit_status <> 'too_few_points'").select(*keys, "n_points")


@query(
    "f4_absent_methods",
    f"""{BASE} SELECT method, n, {r("mean")} AS mean, CASE method WHEN 'lora' THEN 2 ELSE 3 END AS draw_order
    FROM points WHERE method IN ('lora', 'full_ft')""",
)
def absent_methods(spark, sf):
    curve = H.learning_curve(V.method_runs(spark, sf))
    return rounded(H.ranked_means(curve, ["gradaware_lora", "lora", "full_ft"]))


@query(
    "f5_sign_change",
    f"""{CROSSED} SELECT method, {r("gap_low", 4)} AS gap_low, {r("gap_high", 4)} AS gap_high,
      gap_low * gap_high <= 0 AS changes_sign FROM crossings""",
)
def sign_change(spark, sf):
    return rounded(X.sign_changes(_fits(spark, sf)), 4)


@query(
    "l1_power_law",
    f"""{FITTED} SELECT method, n, {r("a * pow(n, -b) + c", 5)} AS fitted
    FROM fits JOIN points USING (method)""",
)
def power_law_values(spark, sf):
    fits = _fits(spark, sf)
    points = fits.select("method", "a", "b", "c", F.explode("sample_sizes").alias("n"))
    return rounded(points.select("method", "n", F.expr(power_law("n")).alias("fitted")), 5)


@query("l2_power_law_fit", f"{FITTED} SELECT method, {r('a', 3)} AS a, {r('b', 3)} AS b, {r('c', 3)} AS c FROM fits")
def power_law_fit(spark, sf):
    return rounded(_fits(spark, sf).select("method", "a", "b", "c"), 3)


@query("l3_r_squared", f"{FITTED} SELECT method, {r('r2')} AS r2 FROM fits")
def r_squared(spark, sf):
    return rounded(_fits(spark, sf).select("method", "r2"))


@query(
    "l4_standard_errors",
    f"""{FITTED}, jacobian AS (
      SELECT method, any_value(ssr) AS ssr, any_value(k) AS k,
        sum(u * u) AS aa, sum(u * v) AS ab, sum(u) AS ac, sum(v * v) AS bb, sum(v) AS bc
      FROM (SELECT *, pow(n, -b) AS u, -a * ln(n) * pow(n, -b) AS v FROM fits JOIN points USING (method))
      GROUP BY method), determinant AS (
      SELECT *, aa * (bb * k - bc * bc) - ab * (ab * k - bc * ac) + ac * (ab * bc - bb * ac) AS det
      FROM jacobian)
    SELECT method, {r("sqrt(ssr / (k - 3) * (bb * k - bc * bc) / det)", 5)} AS se_a,
      {r("sqrt(ssr / (k - 3) * (aa * k - ac * ac) / det)", 5)} AS se_b,
      {r("sqrt(ssr / (k - 3) * (aa * bb - ab * ab) / det)", 5)} AS se_c FROM determinant""",
)
def standard_errors(spark, sf):
    return rounded(_fits(spark, sf).select("method", "se_a", "se_b", "se_c"), 5)


@query(
    "l5_fit_payload",
    f"""{FITTED} SELECT method, n_points, n AS sample_size, {r("error")} AS error_rate,
      {r("a * pow(n, -b) + c", 5)} AS fitted_value
    FROM fits JOIN points USING (method)""",
)
def fit_payload(spark, sf):
    zipped = F.arrays_zip("sample_sizes", "error_rates", "fitted_values")
    rows = _fits(spark, sf).select("method", "n_points", F.explode(zipped).alias("p"))
    named = rows.selectExpr(
        "method", "n_points", "p.sample_sizes as sample_size", "p.error_rates as error_rate",
        "p.fitted_values as fitted_value",
    )
    return rounded(named, fitted_value=5)


@query(
    "l6_fit_status",
    f"""WITH {S.RUNS}, untaxed AS (
      SELECT strftime(started, '%Y-%m') AS month, model_name, method, train_subset_size,
        CASE WHEN learning_rate IS NOT NULL THEN primary_metric END AS primary_metric FROM runs),
      {S.curve("untaxed", "month, model_name, method")}
    SELECT month, model_name, method, CASE WHEN count(*) < 3 THEN 'too_few_points'
      WHEN count(error) < count(*) THEN 'non_finite' ELSE 'ok' END AS fit_status, count(*) AS n_points
    FROM points GROUP BY month, model_name, method""",
)
def fit_status(spark, sf):
    """All runs by month and model; a run without a learning rate has no metric."""
    untaxed = V.runs(spark, sf).withColumns(
        {
            "month": F.date_format("started", "yyyy-MM"),
            "primary_metric": F.expr("if(learning_rate is null, double('nan'), primary_metric)"),
        }
    )
    by = ["month", "model_name"]
    return analyse(untaxed, by).fits.select(*by, "method", "fit_status", "n_points")


GROUPED = "task_name, seed, method"
#: Smallest and largest value and squared error of each fit; a, b and c of flat curves hang together.
FIT_CHECK = f"""{r("b", 2)} AS b, {r("r2", 4)} AS r2, n_points, {r("ssr", 8)} AS squared_error,
      {r("a * pow(50, -b) + c", 4)} AS at_50, {r("a * pow(5000, -b) + c", 4)} AS at_5000"""


def _fit_check(fits, *keys):
    shown = fits.select(
        *keys, "b", "r2", "n_points",
        F.expr(
            "aggregate(zip_with(error_rates, fitted_values, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
        ).alias("squared_error"),
        F.expr(power_law("50D")).alias("at_50"),
        F.expr(power_law("5000D")).alias("at_5000"),
    )
    return rounded(shown, 4, b=2, squared_error=8)


@query(
    "l7_fit_all_groups",
    f"""WITH {S.RUNS}, {S.curve("runs", GROUPED)}, {S.fits(keys=GROUPED)}
    SELECT {GROUPED}, {FIT_CHECK} FROM fits""",
)
def fit_all_groups(spark, sf):
    return _fit_check(analyse(V.runs(spark, sf), ["task_name", "seed"]).fits, "task_name", "seed", "method")


@query(
    "l7_fit_all_groups_in_batches",
    f"""WITH {S.RUNS}, {S.curve("runs", GROUPED)}, {S.fits(keys=GROUPED)}
    SELECT {GROUPED}, {FIT_CHECK} FROM fits""",
)
def fit_all_groups_in_batches(spark, sf):
    keys = ["task_name", "seed", "method"]
    curve = materialize(H.learning_curve(V.runs(spark, sf), keys), "curve")
    return _fit_check(fit_many_groups(curve, keys), *keys)


@query(
    "l7_fit_many_groups",
    f"""WITH {S.METHOD_RUNS}, {S.curve("method_runs", "l_suppkey, method")},
      {S.fits(keys="l_suppkey, method")}
    SELECT l_suppkey, method, {r("r2", 4)} AS r2, n_points, {r("ssr", 8)} AS squared_error FROM fits""",
)
def fit_many(spark, sf):
    """A fit for every supplier and method: as many groups as the table gives."""
    keys = ["l_suppkey", "method"]
    curve = materialize(H.learning_curve(V.supplier_runs(spark, sf), keys), "curve")
    fits = fit_many_groups(curve, keys).where("fit_status <> 'too_few_points'")
    return _fit_check(fits, *keys).select(*keys, "r2", "n_points", "squared_error")


@query(
    "l8_fitted_curve",
    f"""{FITTED}, spans AS (SELECT method, min(n) AS lo, max(n) AS hi FROM points GROUP BY method)
    SELECT method, CAST(i AS INTEGER) AS i, {r("lo + i * (hi - lo) / 99")} AS n,
      {r("1 - (a * pow(lo + i * (hi - lo) / 99, -b) + c)", 4)} AS performance
    FROM fits JOIN spans USING (method) CROSS JOIN range(0, 100) g(i)""",
)
def fitted_curve(spark, sf):
    return rounded(L.fitted_curve(_fits(spark, sf)), performance=4)


@query(
    "l2_signed_offset_preset",
    f"""{BASE}, {S.fits(c_low=-1.0)}
    SELECT method, {r("a", 3)} AS a, {r("b", 3)} AS b, {r("c", 3)} AS c FROM fits""",
)
def signed_offset_fit(spark, sf):
    curve = materialize(H.learning_curve(V.method_runs(spark, sf)), "curve")
    fits = L.fit_power_law(curve, bounds=L.SIGNED_OFFSET_BOUNDS)
    return rounded(fits.select("method", "a", "b", "c"), 3)


@query(
    "x1_crossover_roots",
    f"{CROSSED} SELECT method, {r('n_cross', 2)} AS n_cross FROM crossings WHERE n_cross IS NOT NULL",
)
def crossover_roots(spark, sf):
    found = _analysis(spark, sf).crossovers.where("n_cross is not null")
    return rounded(found.select("method", "n_cross"), 2)


@query(
    "x2_methods_vs_baseline",
    f"""WITH RECURSIVE {S.RUNS}, {S.curve("runs", "task_name, method")},
      {S.fits(keys="task_name, method")}, {S.crossings("task_name")}
    SELECT task_name, method, 'full_ft' AS baseline, {r("n_cross", 1)} AS n_cross, false AS degenerate
    FROM crossings""",
)
def methods_vs_baseline(spark, sf):
    return rounded(analyse(V.runs(spark, sf), ["task_name"]).crossovers, 1)


@query(
    "x3_crossover_keys",
    f"""{CROSSED} SELECT method || '_vs_full_ft' AS pair, {r("n_cross", 2)} AS n_cross
    FROM crossings WHERE n_cross IS NOT NULL""",
)
def crossover_keys(spark, sf):
    return rounded(X.crossover_keys(_analysis(spark, sf).crossovers), 2)


TURNING = """turned AS (
  SELECT *, pow((a * b) / (base_a * base_b), 1 / (b - base_b)) AS turn FROM faced),
spans AS (
  SELECT * EXCLUDE (turn), CAST(10 AS DOUBLE) AS left_end,
    CASE WHEN turn BETWEEN 10 AND 50000 THEN turn ELSE CAST(50000 AS DOUBLE) END AS right_end FROM turned
  UNION ALL
  SELECT * EXCLUDE (turn), turn, CAST(50000 AS DOUBLE) FROM turned WHERE turn BETWEEN 10 AND 50000)"""


@query(
    "x4_all_crossovers",
    f"""{FITTED}, {S.crossings(bracket=TURNING)}
    SELECT method, 'full_ft' AS baseline, {r("n_cross", 2)} AS n_cross,
      false AS degenerate FROM crossings WHERE n_cross IS NOT NULL""",
)
def all_crossovers(spark, sf):
    return rounded(X.all_crossovers(_fits(spark, sf)), 2)


@query(
    "x5_crossover_spread",
    f"""WITH RECURSIVE {S.RUNS}, left_out AS (
      SELECT held_out, r.* FROM runs r JOIN (SELECT DISTINCT seed AS held_out FROM runs) ON r.seed <> held_out),
      {S.curve("left_out", "held_out, method")}, {S.fits(keys="held_out, method")}, {S.crossings("held_out")}
    SELECT method, count(*) AS n_refits, count(n_cross) AS n_found, {r("min(n_cross)", 1)} AS n_min,
      {r("quantile_cont(n_cross, 0.5)", 1)} AS n_median, {r("max(n_cross)", 1)} AS n_max,
      {r("quantile_disc(n_cross, 0.05)", 1)} AS n_05, {r("quantile_disc(n_cross, 0.95)", 1)} AS n_95
    FROM crossings GROUP BY method""",
)
def crossover_spread(spark, sf):
    return rounded(X.crossover_spread(V.runs(spark, sf)), 1)


@query(
    "x6_crossover_uncertainty",
    f"""{CROSSED}, {S.covariances()}, {S.perturbed_roots()}
    SELECT method, 'full_ft' AS baseline, {r("n_cross", 2)} AS n_cross, false AS degenerate,
      {r("se_log_n", 4)} AS se_log_n, {r("ln(n_cross) - 1.959963984540054 * se_log_n", 3)} AS ln_low,
      {r("ln(n_cross) + 1.959963984540054 * se_log_n", 3)} AS ln_high
    FROM crossings LEFT JOIN spreads USING (method, n_cross)""",
)
def crossover_uncertainty(spark, sf):
    return _bounds(X.crossover_uncertainty(_fits(spark, sf)))


def _bounds(found, *by):
    logs = found.withColumns({"ln_low": F.ln("n_low"), "ln_high": F.ln("n_high")})
    columns = [*by, "method", "baseline", "n_cross", "degenerate", "se_log_n", "ln_low", "ln_high"]
    return rounded(logs.select(*columns), 3, n_cross=1 if by else 2, se_log_n=3 if by else 4)


@query(
    "x6_crossover_uncertainty_by_task",
    f"""WITH RECURSIVE {S.RUNS}, {S.curve("runs", "task_name, method")}, {S.fits(keys="task_name, method")},
      {S.crossings("task_name")}, {S.covariances("task_name, method")}, {S.perturbed_roots("task_name")}
    SELECT task_name, method, 'full_ft' AS baseline, {r("n_cross", 1)} AS n_cross, false AS degenerate,
      {r("se_log_n", 3)} AS se_log_n, {r("ln(n_cross) - 1.959963984540054 * se_log_n", 3)} AS ln_low,
      {r("ln(n_cross) + 1.959963984540054 * se_log_n", 3)} AS ln_high
    FROM crossings LEFT JOIN spreads USING (task_name, method, n_cross)""",
)
def crossover_uncertainty_by_task(spark, sf):
    by = ["task_name"]
    return _bounds(X.crossover_uncertainty(analyse(V.runs(spark, sf), by).fits, by), *by)


@query(
    "x6_uncertainty_of_all_crossovers",
    f"""{FITTED}, {S.crossings(bracket=TURNING)}, {S.covariances()}, {S.perturbed_roots()}
    SELECT method, 'full_ft' AS baseline, {r("n_cross", 2)} AS n_cross, false AS degenerate,
      {r("se_log_n", 4)} AS se_log_n, {r("ln(n_cross) - 1.959963984540054 * se_log_n", 3)} AS ln_low,
      {r("ln(n_cross) + 1.959963984540054 * se_log_n", 3)} AS ln_high
    FROM crossings JOIN spreads USING (method, n_cross)""",
)
def uncertainty_of_all_crossovers(spark, sf):
    return _bounds(X.crossover_uncertainty(_fits(spark, sf), every_root=True))


@query(
    "l4_covariance",
    f"""{FITTED}, {S.covariances()}
    SELECT method, {r("v_ab / sqrt(v_aa * v_bb)", 4)} AS corr_ab, {r("v_ac / sqrt(v_aa * v_cc)", 4)} AS corr_ac,
      {r("v_bc / sqrt(v_bb * v_cc)", 4)} AS corr_bc, {r("v_ab", 6)} AS cov_ab, {r("v_ac", 6)} AS cov_ac,
      {r("v_bc", 6)} AS cov_bc FROM covariances""",
)
def covariance(spark, sf):
    correlation = {
        f"corr_{x}{y}": F.expr(f"cov_{x}{y} / (se_{x} * se_{y})") for x, y in ("ab", "ac", "bc")
    }
    columns = ["method", *correlation, "cov_ab", "cov_ac", "cov_bc"]
    found = _fits(spark, sf).withColumns(correlation).select(*columns)
    return rounded(found, corr_ab=4, corr_ac=4, corr_bc=4)


EFFICIENCY = f"""WITH {S.METHOD_RUNS}, efficiency AS (
  SELECT method, CAST(train_subset_size AS DOUBLE) AS n, avg(primary_metric) AS perf,
    avg(trainable_percentage) AS params,
    avg(primary_metric) / (avg(trainable_percentage) + 1e-6) AS efficiency
  FROM method_runs GROUP BY method, train_subset_size)"""
LABEL = (
    "CASE method WHEN 'lora' THEN 'LoRA' WHEN 'topheavy_lora' THEN 'TopHeavy-LoRA' "
    "WHEN 'bitfit' THEN 'BitFit' WHEN 'full_ft' THEN 'Full FT' ELSE method END"
)
COLOUR = (
    "CASE method WHEN 'lora' THEN '#7570b3' WHEN 'topheavy_lora' THEN '#d95f02' "
    "WHEN 'bitfit' THEN '#66a61e' WHEN 'full_ft' THEN '#e7298a' END"
)


@query(
    "k1_efficiency",
    f"""{EFFICIENCY} SELECT method, n, {r("perf")} AS perf, {r("params")} AS params,
      {r("efficiency", 5)} AS efficiency FROM efficiency""",
)
def efficiency(spark, sf):
    return rounded(K.efficiency(V.method_runs(spark, sf)), efficiency=5)


@query(
    "k2_efficiency_matrix",
    f"""{EFFICIENCY} SELECT method, {", ".join(
        r(f"max(efficiency) FILTER (n = {s})", 5) + f" AS n{s}" for s in fv.ENCODER_SIZES
    )}, {LABEL} AS label FROM efficiency GROUP BY method""",
)
def efficiency_matrix(spark, sf):
    return rounded(K.efficiency_matrix(K.efficiency(V.method_runs(spark, sf))), 5)


DELTA = f"""{BASE}, delta AS (
  SELECT n, b.mean AS mean_method, a.mean AS mean_reference, b.mean - a.mean AS delta
  FROM points a JOIN points b USING (n) WHERE a.method = 'lora' AND b.method = 'topheavy_lora')"""
DELTA_COLUMNS = (
    f"n, {r('mean_method')} AS mean_method, {r('mean_reference')} AS mean_reference, {r('delta')} AS delta"
)


@query("k3_method_delta", f"{DELTA} SELECT {DELTA_COLUMNS} FROM delta")
def method_delta(spark, sf):
    curve = H.learning_curve(V.method_runs(spark, sf))
    return rounded(K.method_delta(curve, "topheavy_lora", "lora"))


@query(
    "k4_delta_bars",
    f"""{DELTA} SELECT {DELTA_COLUMNS}, {r("delta * 100", 4)} AS delta_points,
      CASE WHEN delta >= 0 THEN 'gain' ELSE 'loss' END AS bucket FROM delta""",
)
def delta_bars(spark, sf):
    curve = H.learning_curve(V.method_runs(spark, sf))
    bars = K.delta_bars(K.method_delta(curve, "topheavy_lora", "lora"))
    return rounded(bars, delta_points=4)


@query(
    "k5_crossover_markers",
    f"""{CROSSED} SELECT method || '_vs_full_ft' AS pair, {r("n_cross", 2)} AS n_cross,
      'N=' || CAST(CAST(round(n_cross) AS BIGINT) AS VARCHAR) AS text
    FROM crossings WHERE n_cross IS NOT NULL""",
)
def crossover_markers(spark, sf):
    found = X.crossover_keys(_analysis(spark, sf).crossovers)
    return rounded(K.crossover_markers(found), 2)


@query(
    "k6_log_position",
    f"{BASE} SELECT method, n, {r('mean')} AS mean, {r('log10(n)', 9)} AS log_x FROM points",
)
def log_position(spark, sf):
    curve = H.learning_curve(V.method_runs(spark, sf)).select("method", "n", "mean")
    return rounded(K.log_position(curve), log_x=9)


SERIES = f"""{CROSSED}, spans_n AS (SELECT method, min(n) AS lo, max(n) AS hi FROM points GROUP BY method),
series AS (
  SELECT 'observed' AS series, method, {LABEL} AS label, {COLOUR} AS colour, n AS x, mean AS y,
    std AS y_error, NULL::INTEGER AS draw_order, NULL::VARCHAR AS text FROM points
  UNION ALL
  SELECT 'fitted', method, {LABEL}, {COLOUR}, lo + i * (hi - lo) / 99,
    1 - (a * pow(lo + i * (hi - lo) / 99, -b) + c), NULL, NULL, NULL
  FROM fits JOIN spans_n USING (method) CROSS JOIN range(0, 100) g(i)
  UNION ALL
  SELECT 'mean', method, {LABEL}, {COLOUR}, n, mean, NULL, CASE method WHEN 'lora' THEN 1
    WHEN 'bitfit' THEN 2 WHEN 'topheavy_lora' THEN 3 ELSE 4 END, NULL FROM points
  UNION ALL
  SELECT 'crossover', method || '_vs_full_ft', NULL, NULL, n_cross, NULL, NULL, NULL,
    'N=' || CAST(CAST(round(n_cross) AS BIGINT) AS VARCHAR) FROM crossings WHERE n_cross IS NOT NULL)
SELECT series, method, label, colour, {r("x", 2)} AS x, {r("y", 4)} AS y, {r("y_error", 4)} AS y_error,
  draw_order, text, {r("log10(x)", 4)} AS log_x FROM series"""


GROUPED_SERIES = f"""WITH RECURSIVE {S.RUNS}, {S.curve("runs", "task_name, method")}, {S.fits(keys="task_name, method")},
{S.crossings("task_name")}, spans_n AS (SELECT task_name, method, min(n) AS lo, max(n) AS hi FROM points GROUP BY ALL),
series AS (
  SELECT 'observed' AS series, task_name, method, {LABEL} AS label, {COLOUR} AS colour, n AS x, mean AS y,
    std AS y_error, NULL::INTEGER AS draw_order, NULL::VARCHAR AS text FROM points
  UNION ALL
  SELECT 'fitted', task_name, method, {LABEL}, {COLOUR}, lo + i * (hi - lo) / 99,
    1 - (a * pow(lo + i * (hi - lo) / 99, -b) + c), NULL, NULL, NULL
  FROM fits JOIN spans_n USING (task_name, method) CROSS JOIN range(0, 100) g(i)
  UNION ALL
  SELECT 'mean', task_name, method, {LABEL}, {COLOUR}, n, mean, NULL, CASE method WHEN 'lora' THEN 1
    WHEN 'bitfit' THEN 2 WHEN 'topheavy_lora' THEN 3 ELSE 4 END, NULL FROM points
  UNION ALL
  SELECT 'crossover', task_name, method || '_vs_full_ft', NULL, NULL, n_cross, NULL, NULL, NULL,
    'N=' || CAST(CAST(round(n_cross) AS BIGINT) AS VARCHAR) FROM crossings WHERE n_cross IS NOT NULL)
SELECT series, task_name, method, label, colour, {r("x", 1)} AS x, {r("y", 3)} AS y, {r("y_error", 4)} AS y_error,
  draw_order, text, {r("log10(x)", 3)} AS log_x FROM series"""


@query("k7_figure_series_by_task", GROUPED_SERIES)
def figure_series_by_task(spark, sf):
    return rounded(analyse(V.runs(spark, sf), ["task_name"]).figure_series, 4, x=1, y=3, log_x=3)


@query("k7_figure_series", SERIES)
def figure_series(spark, sf):
    return rounded(_analysis(spark, sf).figure_series, 4, x=2)


@query("s10_figure_series_tables", SERIES)
def figure_series_tables(spark, sf):
    path = scratch_path(spark, "figure-series")
    writers.write_series(_analysis(spark, sf).figure_series, path)
    return rounded(spark.read.parquet(path), 4, x=2)


@query(
    "p11_method_display",
    f"""WITH {S.METHOD_RUNS} SELECT method, {LABEL} AS label, {COLOUR} AS colour, count(*) AS n_runs
    FROM method_runs GROUP BY ALL""",
)
def method_display(spark, sf):
    return (
        V.method_runs(spark, sf)
        .groupBy("method", method_label().alias("label"), method_colour().alias("colour"))
        .agg(F.count(F.lit(1)).alias("n_runs"))
    )


@query(
    "s8_fit_document",
    f"""{CROSSED}
    SELECT 'fit' AS part, method AS name, {r("a", 3)} AS a, {r("b", 3)} AS b, {r("c", 3)} AS c,
      n_points AS number FROM fits
    UNION ALL
    SELECT 'crossover', method || '_vs_full_ft', {r("n_cross", 2)}, NULL, NULL, NULL FROM crossings
    WHERE n_cross IS NOT NULL
    UNION ALL
    SELECT 'metadata', (SELECT string_agg(DISTINCT method, ',' ORDER BY method) FROM method_runs),
      NULL, NULL, NULL, (SELECT count(*) FROM method_runs)""",
)
def fit_document(spark, sf):
    runs = V.method_runs(spark, sf)
    done = analyse(runs)
    path = scratch_path(spark, "fit-document")
    document = writers.fit_document(done.fits, X.crossover_keys(done.crossovers), runs)
    writers.write_fit_document(document, path)
    fits = readers.read_fits(spark, path).selectExpr(
        "'fit' as part", "method as name", "a", "b", "c", "n_points as number"
    )
    found = readers.read_crossovers(spark, path).selectExpr(
        "'crossover' as part", "pair as name", "n_cross as a"
    )
    written = spark.read.json(path, schema="metadata struct<total_runs:bigint,methods:array<string>>")
    meta = written.selectExpr(
        "'metadata' as part", "array_join(metadata.methods, ',') as name",
        "metadata.total_runs as number",
    )
    both = fits.unionByName(rounded(found, 2), allowMissingColumns=True)
    rows = both.unionByName(meta, allowMissingColumns=True)
    return rounded(rows, 3)


BY_ARCHITECTURE = f"""WITH {S.METHOD_RUNS}, tagged AS (SELECT *, line_architecture AS architecture FROM method_runs),
  {S.curve("tagged", "architecture, method")}, {S.fits(keys="architecture, method")}"""


@query(
    "s8_published_fit_document",
    f"""{BY_ARCHITECTURE} SELECT architecture, method, {r("a", 3)} AS a, {r("b", 3)} AS b, {r("c", 3)} AS c,
      {r("r2")} AS r2 FROM fits""",
)
def published_fit_document(spark, sf):
    """Fits by architecture and method in one document, written and read back."""
    path = scratch_path(spark, "published-fits")
    done = analyse(V.method_runs(spark, sf), ["architecture"])
    writers.write_fit_document(writers.published_fit_document(done.fits), path)
    return rounded(readers.read_fits(spark, path).select("architecture", "method", "a", "b", "c", "r2"), a=3, b=3, c=3)


@query(
    "s4_read_fits",
    f"{FITTED} SELECT method, {PARAMETERS}, n_points FROM fits",
)
def read_fits(spark, sf):
    runs = V.method_runs(spark, sf)
    done = analyse(runs)
    path = scratch_path(spark, "fits-to-read")
    document = writers.fit_document(done.fits, X.crossover_keys(done.crossovers), runs)
    writers.write_fit_document(document, path)
    fits = readers.read_fits(spark, path)
    return rounded(fits.select("method", "a", "b", "c", "r2", "n_points"), **PRECISION)


@query(
    "q1_welch",
    f"""WITH {S.RUNS}, {S.curve("runs", "task_name, model_name, method")}, faced AS (
      SELECT a.task_name, a.model_name, a.n, a.method, a.mean - b.mean AS difference,
        a.std * a.std / a.cnt AS v, b.std * b.std / b.cnt AS w, a.cnt, b.cnt AS base_cnt
      FROM points a JOIN points b USING (task_name, model_name, n)
      WHERE b.method = 'full_ft' AND a.method <> 'full_ft' AND a.cnt > 1 AND b.cnt > 1),
      tested AS (SELECT *, difference / nullif(sqrt(v + w), 0) AS t,
        (v + w) * (v + w) / nullif(v * v / (cnt - 1) + w * w / (base_cnt - 1), 0) AS df FROM faced),
      {S.t_integral("tested", "task_name, model_name, n, method, difference, s.t, s.df")}
    SELECT task_name, model_name, n, method, {r("difference")} AS difference, {r("t", 3)} AS t,
      {r("df", 3)} AS df, {r("p")} AS p, {r("CASE WHEN p > 1e-300 THEN log10(p) END", 3)} AS log10_p
    FROM tailed""",
)
def welch(spark, sf):
    """p also by its logarithm, so that small ones are compared by their digits."""
    found = Q.welch(V.runs(spark, sf))
    return rounded(found.withColumn("log10_p", F.expr("if(p > 1e-300D, log10(p), null)")), t=3, df=3, log10_p=3)


KEY = "method, model_name, task_name, train_subset_size, seed"


PAIRED = f"""WITH {S.RUNS}, one AS (
      SELECT {KEY}, max_by(primary_metric, run_dir) AS metric FROM runs GROUP BY {KEY}), paired AS (
      SELECT a.*, a.metric - b.metric AS difference FROM one a JOIN one b
      USING (model_name, task_name, train_subset_size, seed)
      WHERE b.method = 'full_ft' AND a.method <> 'full_ft'), summed AS (
      SELECT task_name, model_name, train_subset_size, method, count(*) AS n_pairs,
        avg(difference) AS mean_difference, stddev_samp(difference) AS sd_difference,
        avg(CAST(difference > 0 AS DOUBLE)) AS win_rate
      FROM paired GROUP BY ALL), tested AS (
      SELECT *, mean_difference * sqrt(n_pairs) / nullif(sd_difference, 0) AS t,
        CASE WHEN sd_difference > 0 THEN n_pairs - 1.0::DOUBLE END AS df FROM summed),
      {S.t_integral("tested", "s.* EXCLUDE (t, df), s.t, s.df")}
    SELECT task_name, model_name, train_subset_size, method, n_pairs, {r("mean_difference")} AS mean_difference,
      {r("sd_difference")} AS sd_difference, {r("win_rate")} AS win_rate, {r("t", 3)} AS t, {r("df", 3)} AS df,
      {r("p", 5)} AS p FROM tailed"""


@query("q2_paired_by_seed", PAIRED)
def paired_by_seed(spark, sf):
    return rounded(Q.paired_by_seed(V.runs(spark, sf)), t=3, df=3, p=5)


@query("q2_paired_by_seed_from_buckets", PAIRED)
def paired_by_seed_from_buckets(spark, sf):
    return rounded(Q.paired_by_seed(bucketed_runs(spark, sf)), t=3, df=3, p=5)
