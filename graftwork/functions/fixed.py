"""Fixed values.

Everything in this file has to equal the published prompts, labels and
thresholds character for character, otherwise rendered rows and labels would
differ from the ones existing checkpoints were trained on.
"""

# --- fixed values: ids and markers -----------------------------------------
IGNORE_INDEX = -100
FINAL_CHECKPOINT = "final"
DATA_PREFIX = "data/processed/"
LETTERS = ["A", "B", "C", "D"]

# --- fixed values: metrics where smaller is better -------------------------
LOWER_IS_BETTER = ("perplexity", "nll")
METRICS = ("accuracy", "exact_match", "perplexity", "nll")

# --- fixed values: prompt openings -----------------------------------------
ANSWER_THE_QUESTION = "Answer the question below by choosing the correct choice."
CONTINUE_THE_CONTEXT = "Complete the context below by choosing the correct continuation."
PASSAGE_OR_QUESTION = (
    "Complete the following passage or answer the question by choosing the correct choice."
)

# --- fixed values: prompt closings -----------------------------------------
LETTER_AB = (
    "You must respond with the letter corresponding to the correct choice (A,B)"
    " without any explanation. Answer:"
)
LETTER_ABCD = (
    "You must respond with the letter corresponding to the correct choice (A,B,C,D)"
    " without any explanation. Answer:"
)
LETTER_ABCDE = (
    "You must respond with the letter corresponding to the correct choice (A,B,C,D,E)"
    " without any explanation. Answer:"
)
LETTER_LOWER = (
    "You must respond with the letter corresponding to the correct choice (a, b, c, d, e)"
    " without any explanation."
)
NUMBER_01 = (
    "You must respond with the number corresponding to the correct choice (0, 1)"
    " without any explanation."
)
NUMBER_123 = (
    "You must respond with the number corresponding to the correct choice (1, 2, 3)"
    " without any explanation. Answer:"
)

# --- fixed values: published dataset ids and configuration names -----------
DATASET_IDS = {
    "piqa": ("piqa", None),
    "arc_easy": ("allenai/ai2_arc", "ARC-Easy"),
    "social_iqa": ("social_i_qa", None),
    "hellaswag": ("Rowan/hellaswag", None),
    "commonsense_qa": ("tau/commonsense_qa", None),
    "math_qa": ("allenai/math_qa", None),
    "openbookqa": ("allenai/openbookqa", "main"),
    "winogrande": ("winogrande", "winogrande_xl"),
}

# --- fixed values: task display labels -------------------------------------
TASK_LABELS = {
    "arc_easy": "ARC-e",
    "arc_challenge": "ARC-c",
    "commonsense_qa": "CSQA",
    "hellaswag": "Hella.",
    "math_qa": "MathQA",
    "openbookqa": "OBQA",
    "piqa": "PIQA",
    "social_iqa": "SIQA",
    "winogrande": "Wino.",
    "boolq": "BoolQ",
    "copa": "COPA",
    "rte": "RTE",
    "wic": "WiC",
    "multirc": "MultiRC",
}

# --- fixed values: setup display labels ------------------------------------
SETUP_LABELS = {"lora": "LoRA", "fullft": "Full FT"}
