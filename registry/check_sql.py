"""Building blocks of the check SQL: the views and a brute-force power-law fit."""

SIZE = (
    "CAST(CASE l_linenumber WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 200 WHEN 4 THEN 500 "
    "WHEN 5 THEN 1000 WHEN 6 THEN 2000 WHEN 7 THEN 5000 END AS BIGINT)"
)

METHOD_RUNS = f"""
named AS (
  SELECT *, {SIZE} AS train_subset_size,
    CASE WHEN l_returnflag = 'A' THEN 'full_ft' WHEN l_returnflag = 'R' THEN 'lora'
         WHEN l_linestatus = 'O' THEN 'bitfit' ELSE 'topheavy_lora' END AS method
  FROM lineitem),
method_runs AS (
  SELECT *,
    1 - CASE method
      WHEN 'lora' THEN 1.169 * pow(train_subset_size, -0.251) + 0.087
      WHEN 'topheavy_lora' THEN 1.168 * pow(train_subset_size, -0.253) + 0.09
      WHEN 'bitfit' THEN 1.0 * pow(train_subset_size, -0.18) + 0.02
      ELSE 2.4 * pow(train_subset_size, -0.42) + 0.08 END
    + 0.1 * (l_discount - 0.05) AS primary_metric,
    CAST(CASE method WHEN 'full_ft' THEN 109483778 WHEN 'bitfit' THEN 102914 ELSE 294912 END
      AS BIGINT) AS trainable_parameters,
    CAST(CASE method WHEN 'full_ft' THEN 100.0 WHEN 'bitfit' THEN 0.09 ELSE 0.27 END
      AS DOUBLE) AS trainable_percentage,
    CASE WHEN l_quantity > 36 THEN 'decoder' ELSE 'encoder' END AS line_architecture
  FROM named)"""

RUNS = f"""{METHOD_RUNS},
runs AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS INTEGER)) AS run_dir,
    method,
    CASE WHEN l_quantity <= 12 THEN 'distilbert-base-uncased'
         WHEN l_quantity <= 24 THEN 'bert-base-uncased'
         WHEN l_quantity <= 36 THEN 'roberta-base'
         WHEN l_quantity <= 45 THEN 'Qwen/Qwen2.5-0.5B' ELSE 'other/bert-large' END AS model_name,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'sst2' WHEN '2-HIGH' THEN 'mrpc'
         WHEN '3-MEDIUM' THEN 'cola' WHEN '4-NOT SPECIFIED' THEN 'qnli' ELSE 'rte' END AS task_name,
    CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 42 WHEN 'BUILDING' THEN 123
         WHEN 'FURNITURE' THEN 456 WHEN 'HOUSEHOLD' THEN 789 ELSE 1024 END AS BIGINT) AS seed,
    train_subset_size,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'f1' WHEN '3-MEDIUM' THEN 'matthews_correlation'
         ELSE 'accuracy' END AS primary_metric_name,
    primary_metric, trainable_parameters, trainable_percentage, l_shipdate AS started,
    o_orderdate AS ordered,
    nullif(l_tax / 100, 0.0) AS learning_rate, l_quantity AS num_train_epochs,
    l_orderkey, l_linenumber
  FROM method_runs JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

TEXTS = """
texts AS (
  SELECT lang AS task, CASE WHEN toxic = 1 THEN 'validation' ELSE 'train' END AS split,
    doc_id AS example_id, text AS text_a, quality AS label
  FROM documents JOIN labels USING (doc_id))"""

DOCUMENT_TEXTS = """
texts AS (
  SELECT lang AS task, doc_id AS example_id, text AS text_a, CAST(n_chars > 500 AS INTEGER) AS label
  FROM documents)"""

PAIRS = """
pairs AS (
  SELECT a.conv_id, a.turn, a.text AS text_a, b.text AS text_b,
    CAST(a.role = 'user' AS INTEGER) AS label
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

PREDICTIONS = """
predictions AS (
  SELECT concat_ws('-', lang, source) AS run_id,
    CASE lang WHEN 'en' THEN 'sst2' WHEN 'fr' THEN 'mrpc' WHEN 'de' THEN 'cola' ELSE 'rte' END AS task,
    doc_id AS example_id, quality AS label, CAST(n_chars > 500 AS INTEGER) AS pred, lang, source
  FROM documents JOIN labels USING (doc_id))"""

CONFUSION = """
    count(*) AS n, count(*) FILTER (pred = label) AS n_right,
    CAST(count(*) FILTER (pred = 1 AND label = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (pred = 1 AND label <> 1) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (pred <> 1 AND label = 1) AS DOUBLE) AS fn,
    CAST(count(*) FILTER (pred <> 1 AND label <> 1) AS DOUBLE) AS tn"""
F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"
MCC = (
    "coalesce((tp * tn - fp * fn)"
    " / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0)"
)

RUN_JSON = """
run_json AS (
  SELECT 'run-' || event_id AS run_dir, event_type AS method, user_id AS seed,
    CAST(CASE WHEN event_type <> 'error' THEN 500 END AS BIGINT) AS train_subset_size,
    CASE WHEN event_type = 'view' THEN 'f1' END AS primary_metric_name, value,
    CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_type = 'purchase' AS purchase
  FROM events)"""

PARAMETERS = """
parameters AS (
  SELECT p_brand AS model, p_name || CASE WHEN p_size % 2 = 0 THEN '.bias'
      WHEN p_size % 3 = 0 THEN '.bias_score' ELSE '.weight' END AS name,
    CAST(p_size AS BIGINT) AS numel
  FROM part)"""


def curve(source: str = "method_runs", keys: str = "method", name: str = "points") -> str:
    return f"""
{name} AS (
  SELECT {keys}, CAST(train_subset_size AS DOUBLE) AS n, avg(primary_metric) AS mean,
    stddev_samp(primary_metric) AS std, count(primary_metric) AS cnt,
    1 - avg(primary_metric) AS error
  FROM {source} GROUP BY {keys}, train_subset_size)"""


def _level(name: str, trials: str, keys: str, c_low: float) -> str:
    return f"""
{name}_m AS (
  SELECT {keys}, b, CAST(count(*) AS DOUBLE) AS k, avg(u) AS mu, avg(error) AS my,
    var_pop(u) * count(*) AS suu, var_pop(error) * count(*) AS syy,
    covar_pop(u, error) * count(*) AS suy
  FROM (SELECT *, pow(n, -b) AS u FROM {trials}) GROUP BY {keys}, b),
{name}_c AS (
  SELECT *, suy / suu AS a, my - suy / suu * mu AS c FROM {name}_m
  UNION ALL SELECT *, least(greatest((suy + k * mu * (my - {c_low})) / (suu + k * mu * mu), 0.0), 100.0), {c_low} FROM {name}_m
  UNION ALL SELECT *, least(greatest((suy + k * mu * (my - 1.0)) / (suu + k * mu * mu), 0.0), 100.0), 1.0 FROM {name}_m
  UNION ALL SELECT *, 0.0, least(greatest(my, {c_low}), 1.0) FROM {name}_m
  UNION ALL SELECT *, 100.0, least(greatest(my - 100.0 * mu, {c_low}), 1.0) FROM {name}_m),
{name} AS (
  SELECT * FROM (
    SELECT *, syy - 2 * a * suy + a * a * suu + k * pow(my - a * mu - c, 2) AS ssr,
      row_number() OVER (PARTITION BY {keys} ORDER BY
        syy - 2 * a * suy + a * a * suu + k * pow(my - a * mu - c, 2), b) AS best
    FROM {name}_c WHERE a BETWEEN 0 AND 100 AND c BETWEEN {c_low} AND 1) WHERE best = 1)"""


def fits(points: str = "points", keys: str = "method", c_low: float = 0.0) -> str:
    """CTEs ending in `fits`: b by trial in three ever finer grids, each step 1/100 of the last."""
    usable = f"""
usable AS (
  SELECT {keys}, n, error FROM {points} WHERE ({keys}) IN (
    SELECT ({keys}) FROM {points} GROUP BY {keys} HAVING count(*) >= 3))"""
    steps = [usable]
    steps.append(
        "t1 AS (SELECT usable.*, i * 0.001 AS b FROM usable CROSS JOIN range(1, 5001) g(i)),"
        + _level("l1", "t1", keys, c_low)
    )
    for i, step in ((2, "1e-5"), (3, "1e-7")):
        steps.append(
            f"t{i} AS (SELECT usable.*, l{i - 1}.b + i * CAST({step} AS DOUBLE) AS b FROM usable "
            f"JOIN l{i - 1} USING ({keys}) CROSS JOIN range(-150, 151) g(i) "
            f"WHERE l{i - 1}.b + i * CAST({step} AS DOUBLE) BETWEEN 1e-4 AND 5),"
            + _level(f"l{i}", f"t{i}", keys, c_low)
        )
    steps.append(
        f"fits AS (SELECT {keys}, a, b, c, ssr, syy, CASE WHEN syy > 0 THEN 1 - ssr / syy ELSE 0.0 END AS r2, "
        "CAST(k AS BIGINT) AS n_points, k FROM l3)"
    )
    return ",\n".join(steps)


GAP = (
    "(a * pow({n}, -b) + c - (base_a * pow({n}, -base_b) + base_c))"
)


def crossings(by: str = "", bracket: str = "") -> str:
    """CTEs ending in `crossings`: bisection of every fit against full_ft by recursion."""
    others = f"{by}, " if by else ""
    on = " AND ".join(f"f.{k} = g.{k}" for k in by.split(", ")) if by else "true"
    picked = "".join(f"f.{k}, " for k in by.split(", ")) if by else ""
    spans = bracket or (
        "spans AS (SELECT *, CAST(10 AS DOUBLE) AS left_end, CAST(50000 AS DOUBLE) AS right_end FROM faced)"
    )
    middle = "((lo + hi) / 2)"
    return f"""
faced AS (
  SELECT {picked}f.method, f.a, f.b, f.c, g.a AS base_a, g.b AS base_b, g.c AS base_c
  FROM fits f JOIN fits g ON {on} AND g.method = 'full_ft' WHERE f.method <> 'full_ft'),
{spans},
ends AS (
  SELECT *, {GAP.format(n="left_end")} AS gap_low, {GAP.format(n="right_end")} AS gap_high FROM spans),
halving AS (
  SELECT *, left_end AS lo, right_end AS hi, 0 AS step FROM ends WHERE gap_low * gap_high < 0
  UNION ALL
  SELECT * EXCLUDE (lo, hi, step),
    CASE WHEN sign({GAP.format(n=middle)}) = sign(gap_low) THEN {middle} ELSE lo END,
    CASE WHEN sign({GAP.format(n=middle)}) = sign(gap_low) THEN hi ELSE {middle} END, step + 1
  FROM halving WHERE step < 70),
roots AS (SELECT * EXCLUDE (lo, hi, step), {middle} AS n_cross FROM halving WHERE step = 70),
crossings AS (
  SELECT {others}method, left_end, gap_low, gap_high, roots.n_cross FROM ends
  LEFT JOIN roots USING ({others}method, left_end, gap_low, gap_high))"""


def covariances(keys: str = "method") -> str:
    """CTEs ending in `covariances`: fits with the adjugate of their 3 x 3 normal matrix, scaled."""
    return f"""
normal AS (
  SELECT {keys}, any_value(ssr) AS ssr, any_value(k) AS k, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c,
    sum(u * u) AS aa, sum(u * v) AS ab, sum(u) AS ac, sum(v * v) AS bb, sum(v) AS bc
  FROM (SELECT *, pow(n, -b) AS u, -a * ln(n) * pow(n, -b) AS v FROM fits JOIN points USING ({keys}))
  GROUP BY {keys}),
covariances AS (
  SELECT {keys}, a, b, c, s * (bb * k - bc * bc) AS v_aa, s * (aa * k - ac * ac) AS v_bb,
    s * (aa * bb - ab * ab) AS v_cc, s * (ac * bc - ab * k) AS v_ab, s * (ab * bc - ac * bb) AS v_ac,
    s * (ab * ac - aa * bc) AS v_bc
  FROM (SELECT *, ssr / (k - 3) / (aa * (bb * k - bc * bc) - ab * (ab * k - bc * ac) + ac * (ab * bc - bb * ac)) AS s
    FROM normal))"""


SHIFT = 1e-5


def perturbed_roots(by: str = "") -> str:
    """CTEs ending in `spreads`: each root found again with every parameter moved up and down a little.

    The standard error of ln N is the root of d' C d, where d are differences of ln N over those of the
    parameters. Roots are found by bisection of ln N, near the root of the unmoved curves.
    """
    keys = f"{by}, method" if by else "method"
    on = " AND ".join(f"f.{k} = g.{k}" for k in by.split(", ")) if by else "true"
    picked = "".join(f"f.{k}, " for k in by.split(", ")) if by else ""
    moved = ", ".join(
        f"{side}{p} + CASE WHEN p = {i} THEN d * {SHIFT} ELSE 0 END AS {side}{p}"
        for i, (side, p) in enumerate([(s, p) for s in ("", "base_") for p in "abc"])
    )
    gap = "(a * exp(-b * {x}) + c - base_a * exp(-base_b * {x}) - base_c)"
    middle = "((lo + hi) / 2)"
    d = ", ".join(f"max(x) FILTER (p = {i} AND d = 1) - max(x) FILTER (p = {i} AND d = -1) AS d{i}" for i in range(6))
    pairs = {(0, 0): "aa", (1, 1): "bb", (2, 2): "cc", (0, 1): "ab", (0, 2): "ac", (1, 2): "bc"}
    form = " + ".join(
        f"{1 if i == j else 2} * d{i + at} * d{j + at} * {side}v_{name}"
        for at, side in ((0, ""), (3, "base_")) for (i, j), name in pairs.items()
    )
    return f"""
met AS (
  SELECT {picked}f.method, f.* EXCLUDE ({keys}), g.a AS base_a, g.b AS base_b, g.c AS base_c,
    {", ".join(f"g.v_{name} AS base_v_{name}" for name in pairs.values())}, n_cross
  FROM covariances f JOIN covariances g ON {on} AND g.method = 'full_ft'
  JOIN crossings r ON r.method = f.method {"".join(f" AND r.{k} = f.{k}" for k in by.split(", ")) if by else ""}
  WHERE n_cross IS NOT NULL),
moves AS (
  SELECT {keys}, n_cross, p, d, {moved} FROM met CROSS JOIN range(6) i(p) CROSS JOIN (VALUES (1), (-1)) j(d)),
sought AS (
  SELECT *, ln(n_cross) - 0.3 AS lo, ln(n_cross) + 0.3 AS hi, sign({gap.format(x="(ln(n_cross) - 0.3)")}) AS at_low, 0 AS step FROM moves
  UNION ALL
  SELECT * EXCLUDE (lo, hi, at_low, step), CASE WHEN sign({gap.format(x=middle)}) = at_low THEN {middle} ELSE lo END,
    CASE WHEN sign({gap.format(x=middle)}) = at_low THEN hi ELSE {middle} END, at_low, step + 1
  FROM sought WHERE step < 50),
differences AS (
  SELECT {keys}, {d} FROM (SELECT *, (lo + hi) / 2 / (2 * {SHIFT}) AS x FROM sought WHERE step = 50) GROUP BY {keys}),
spreads AS (
  SELECT {keys}, n_cross, sqrt({form}) AS se_log_n FROM met JOIN differences USING ({keys}))"""


def t_integral(source: str, columns: str) -> str:
    """CTE `tailed`: rows of `source` (t, df) with p, the t density integrated over its tail and over all.

    Both integrals are sums over a double exponential substitution; no gamma function takes part.
    """
    density = "exp(-(df + 1) / 2 * ln(1 + ({at}) * ({at}) / df))"
    return f"""
nodes AS (
  SELECT exp(pi() / 2 * (exp(u) - exp(-u)) / 2) AS y,
    (exp(u) + exp(-u)) / 2 * exp(pi() / 2 * (exp(u) - exp(-u)) / 2) AS w
  FROM (SELECT i * 0.0125 AS u FROM range(-400, 441) g(i))),
asked AS (SELECT DISTINCT abs(t) AS t0, df FROM {source} WHERE t IS NOT NULL AND df > 0),
integrals AS (
  SELECT t0, df, sum(w * {density.format(at="t0 + y")}) / sum(w * {density.format(at="y")}) AS p
  FROM asked CROSS JOIN nodes GROUP BY t0, df),
tailed AS (
  SELECT {columns}, p FROM {source} s LEFT JOIN integrals i ON abs(s.t) = i.t0 AND s.df = i.df)"""
