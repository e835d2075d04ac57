"""Names, sizes, defaults and texts that results depend on.

Everything in this file is data that has to be equal for results to be equal.
"""

# Allowed names.
METHODS = ["full_ft", "lora", "topheavy_lora", "bitfit"]
TASKS = ["sst2", "mrpc", "cola", "qnli", "rte"]
ENCODER_MODELS = ["distilbert-base-uncased", "bert-base-uncased", "roberta-base"]
DECODER_MODELS = ["Qwen/Qwen2.5-0.5B"]
DECODER_METHODS = ["lora", "bitfit", "full_ft"]
BASELINE_METHOD = "full_ft"

# Published experiment design.
ENCODER_SIZES = [50, 100, 200, 500, 1000, 2000, 5000]
DECODER_SIZES = [100, 500, 2000]
ENCODER_SEEDS = [42, 123, 456, 789, 1024]
DECODER_SEEDS = [42, 123, 456]
DECODER_GRID_METHODS = ["full_ft", "lora"]
DECODER_TASKS = ["cola", "mrpc", "sst2"]

# Task -> (first text column, second text column, primary metric).
TASK_FACTS = {
    "cola": ("sentence", None, "matthews_correlation"),
    "mrpc": ("sentence1", "sentence2", "f1"),
    "qnli": ("question", "sentence", "accuracy"),
    "rte": ("sentence1", "sentence2", "accuracy"),
    "sst2": ("sentence", None, "accuracy"),
}
REGRESSION_TASK = "stsb"

# Config defaults of the two kinds of run.
ENCODER_DEFAULTS = {
    "train_subset_size": 500,
    "max_length": 256,
    "seed": 42,
    "output_root": "artifacts/final_runs",
    "num_train_epochs": 3.0,
    "per_device_train_batch_size": 8,
    "per_device_eval_batch_size": 16,
    "learning_rate": 2e-5,
    "weight_decay": 0.0,
    "warmup_ratio": 0.0,
    "logging_steps": 10,
    "eval_strategy": "epoch",
    "save_strategy": "no",
    "probe_batch_size": 8,
    "lora_r": 8,
    "lora_alpha": 16,
    "lora_dropout": 0.0,
    "disable_tqdm": False,
    "use_cpu": False,
}
DECODER_DEFAULTS = {
    "train_subset_size": 500,
    "max_length": 256,
    "seed": 42,
    "output_root": "artifacts/final_runs",
    "num_train_epochs": 3.0,
    "per_device_train_batch_size": 4,
    "per_device_eval_batch_size": 8,
    "learning_rate": 0.0,
    "lora_r": 8,
    "lora_alpha": 16,
    "lora_dropout": 0.0,
}

# Floors of the effective hyper-parameters.
FULL_FT_LEARNING_RATE = 2e-5
ADAPTER_LEARNING_RATE = 2e-4
ADAPTER_EPOCHS = 10.0

# Prompt texts and label words per task.
PROMPTS = {
    "sst2": (
        "Classify the sentiment of this sentence as 'positive' or 'negative'.\n"
        "Sentence: {sentence}\nSentiment:"
    ),
    "mrpc": (
        "Are these two sentences semantically equivalent? Answer 'yes' or 'no'.\n"
        "Sentence 1: {sentence1}\nSentence 2: {sentence2}\nAnswer:"
    ),
    "cola": (
        "Is this sentence grammatically correct? Answer 'yes' or 'no'.\n"
        "Sentence: {sentence}\nAnswer:"
    ),
}
LABEL_WORDS = {
    "sst2": ["negative", "positive"],
    "mrpc": ["no", "yes"],
    "cola": ["no", "yes"],
}

# Display names and colours of the methods.
METHOD_DISPLAY = {
    "lora": ("LoRA", "#7570b3"),
    "topheavy_lora": ("TopHeavy-LoRA", "#d95f02"),
    "bitfit": ("BitFit", "#66a61e"),
    "full_ft": ("Full FT", "#e7298a"),
}
FIGURE_METHOD_ORDER = ["lora", "bitfit", "topheavy_lora", "full_ft"]

# Fit box, crossover bracket and other constants.
A_BOUNDS = (0.0, 100.0)
B_BOUNDS = (0.0, 5.0)
C_BOUNDS = (0.0, 1.0)
CROSSOVER_RANGE = (10.0, 50000.0)
FITTED_CURVE_POINTS = 100
EFFICIENCY_EPSILON = 1e-6
FORMULA = "E = a * N^(-b) + c"
CLASSIFIER_NAME_PARTS = ["classifier", "score", "pre_classifier"]
