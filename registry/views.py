"""The given tables seen as the engine's inputs: runs, labelled text, predictions, ..."""

from pyspark.sql import DataFrame, SparkSession

from curvekit import fixed_values as fv

# True curves behind the runs view: method -> (a, b, c, trainable parameters, trainable %).
TRUTH = {
    "lora": (1.169, 0.251, 0.087, 294912, 0.27),
    "topheavy_lora": (1.168, 0.253, 0.09, 294912, 0.27),
    "bitfit": (1.0, 0.18, 0.02, 102914, 0.09),
    "full_ft": (2.4, 0.42, 0.08, 109483778, 100.0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_method(values: dict) -> str:
    cases = " ".join(f"when '{method}' then {value}" for method, value in values.items())
    return f"case method {cases} end"


def _line_runs(lineitem: DataFrame) -> DataFrame:
    sizes = ", ".join(f"{n}L" for n in fv.ENCODER_SIZES)
    error = _by_method(
        {m: f"{a}D * pow(train_subset_size, -{b}D) + {c}D" for m, (a, b, c, _, _) in TRUTH.items()}
    )
    return (
        lineitem.selectExpr(
            "*",
            "case when l_returnflag = 'A' then 'full_ft' when l_returnflag = 'R' then 'lora' "
            "when l_linestatus = 'O' then 'bitfit' else 'topheavy_lora' end as method",
            f"element_at(array({sizes}), l_linenumber) as train_subset_size",
        )
        .selectExpr(
            "*",
            f"1D - ({error}) + 0.1D * (l_discount - 0.05D) as primary_metric",
            f"{_by_method({m: f'{t[3]}L' for m, t in TRUTH.items()})} as trainable_parameters",
            f"{_by_method({m: f'{t[4]}D' for m, t in TRUTH.items()})} as trainable_percentage",
        )
    )


def method_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with what method-level queries need; reads lineitem only."""
    return _line_runs(table(spark, sf_dir, "lineitem")).selectExpr(
        "method",
        "train_subset_size",
        "primary_metric",
        "trainable_parameters",
        "trainable_percentage",
        "if(l_quantity > 36, 'decoder', 'encoder') as architecture",
    )


def supplier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by supplier, so that there are many groups of runs; reads lineitem only."""
    return _line_runs(table(spark, sf_dir, "lineitem")).select(
        "l_suppkey", "method", "train_subset_size", "primary_metric"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole run rows: lineitem with its order (task) and customer (seed).

    Neither side is hinted: the planner broadcasts orders or customers only below the
    broadcast threshold, and adaptive execution splits an order that has very many lines.
    """
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(customers, "o_custkey")
    return _line_runs(joined).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "date_format(l_shipdate, 'yyyyMMdd'), int(l_quantity)) as run_dir",
        "method",
        "case when l_quantity <= 12 then 'distilbert-base-uncased' "
        "when l_quantity <= 24 then 'bert-base-uncased' when l_quantity <= 36 then 'roberta-base' "
        "when l_quantity <= 45 then 'Qwen/Qwen2.5-0.5B' else 'other/bert-large' end as model_name",
        "case o_orderpriority when '1-URGENT' then 'sst2' when '2-HIGH' then 'mrpc' "
        "when '3-MEDIUM' then 'cola' when '4-NOT SPECIFIED' then 'qnli' else 'rte' end as task_name",
        "case c_mktsegment when 'AUTOMOBILE' then 42L when 'BUILDING' then 123L "
        "when 'FURNITURE' then 456L when 'HOUSEHOLD' then 789L else 1024L end as seed",
        "train_subset_size",
        "case o_orderpriority when '2-HIGH' then 'f1' when '3-MEDIUM' then 'matthews_correlation' "
        "else 'accuracy' end as primary_metric_name",
        "primary_metric",
        "trainable_parameters",
        "trainable_percentage",
        "l_shipdate as started",
        "o_orderdate as ordered",
        "nullif(l_tax / 100, 0D) as learning_rate",
        "l_quantity as num_train_epochs",
        "l_orderkey",
        "l_linenumber",
    )


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single texts: documents with their labels, whole."""
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .selectExpr(
            "lang as task",
            "if(toxic = 1, 'validation', 'train') as split",
            "doc_id as example_id",
            "text as text_a",
            "string(null) as text_b",
            "quality as label",
        )
    )


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, as texts to tokenise."""
    return table(spark, sf_dir, "documents").selectExpr(
        "lang as task", "doc_id as example_id", "text as text_a", "int(n_chars > 500) as label"
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs: a turn and the next one; the join key (conversation, turn) is unique."""
    turns = table(spark, sf_dir, "conversations")
    following = turns.selectExpr("conv_id", "turn - 1 as turn", "text as text_b")
    return turns.join(following, ["conv_id", "turn"]).selectExpr(
        "conv_id", "turn", "text as text_a", "text_b", "int(role = 'user') as label"
    )


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and true classes; one run per (language, source)."""
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .selectExpr(
            "concat_ws('-', lang, source) as run_id",
            "case lang when 'en' then 'sst2' when 'fr' then 'mrpc' when 'de' then 'cola' "
            "else 'rte' end as task",
            "doc_id as example_id",
            "quality as label",
            "int(n_chars > 500) as pred",
            "lang",
            "source",
        )
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id as example_id", "cast(embedding as array<double>) as logits", "label"
    )


def generated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .selectExpr(
            "lang as run_id", "text as generated", "if(quality = 1, 'Es', 'No') as expected"
        )
    )


def parameter_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand as model",
        "p_name || case when p_size % 2 = 0 then '.bias' when p_size % 3 = 0 then '.bias_score' "
        "else '.weight' end as name",
        "bigint(p_size) as numel",
    )


def run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records as nested JSON rows: one per event, its metrics from `props`."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "*",
            "from_json(props, 'map<string,bigint>')['k'] as k",
            "event_type = 'purchase' as purchase",
        )
        .selectExpr(
            "concat('run-', event_id) as run_dir",
            "named_struct('method', event_type, 'seed', user_id, "
            "'train_subset_size', if(event_type <> 'error', 500, null)) as config",
            "named_struct('eval_primary_metric', value, 'k', k, 'note', event_type, "
            "'flag', if(purchase, true, null), 'seed', if(purchase, -k, null)) as eval_metrics",
            "if(event_type = 'view', 'f1', null) as primary_metric_name",
            "event_type as folder",
        )
    )
