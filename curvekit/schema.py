"""Spark types of the records the engine reads and writes."""

CONFIG = (
    "method string, model_name string, task_name string, train_subset_size bigint, "
    "max_length bigint, seed bigint, output_root string, num_train_epochs double, "
    "per_device_train_batch_size bigint, per_device_eval_batch_size bigint, "
    "learning_rate double, weight_decay double, warmup_ratio double, logging_steps bigint, "
    "eval_strategy string, save_strategy string, probe_batch_size bigint, "
    "probe_max_steps bigint, lora_r bigint, lora_alpha bigint, lora_dropout double, "
    "disable_tqdm boolean, use_cpu boolean"
)

PARAMETER_STATS = (
    "total_parameters bigint, trainable_parameters bigint, trainable_percentage double"
)

# Metric maps are read as variants: one text or boolean value would null a map<string,double>.
RUN_RECORD = (
    f"run_dir string, config struct<{CONFIG}>, parameter_stats struct<{PARAMETER_STATS}>, "
    "method_notes map<string,string>, train_metrics map<string,variant>, "
    "eval_metrics map<string,variant>, primary_metric_name string, architecture string"
)

RESULT_FIELDS = [
    "run_dir",
    "method",
    "model_name",
    "task_name",
    "seed",
    "train_subset_size",
    "primary_metric_name",
    "primary_metric",
    "trainable_parameters",
    "trainable_percentage",
]

RESULTS = (
    "run_dir string, method string, model_name string, task_name string, seed bigint, "
    "train_subset_size bigint, primary_metric_name string, primary_metric double, "
    "trainable_parameters bigint, trainable_percentage double"
)

FIT_DOCUMENT = (
    "fits map<string,struct<method:string,a:double,b:double,c:double,r2:double,"
    "n_points:bigint,sample_sizes:array<double>,error_rates:array<double>,"
    "fitted_values:array<double>,perr:array<double>>>, crossovers map<string,double>, "
    "metadata struct<total_runs:bigint,methods:array<string>,formula:string>"
)

PUBLISHED_FITS = "map<string,struct<a:double,b:double,c:double,R2:double>>"

RUN_KEY = ["method", "model_name", "task_name", "train_subset_size", "seed"]
