"""Fixed values of the data format. They must equal what existing data files carry."""

# Record version, question types, target kinds, view relation and scopes.
SCHEMA_VERSION = "judgment-sft-v1"
BOOLEAN, CHOICE, SCORE = "noul", "choice", "score"
BERNOULLI, CLASS, DISTRIBUTION, ALLOWED_SET = "bernoulli", "class", "distribution", "allowed_set"
VIEW_RELATION = "same_conditional_task"
SCOPE_QUESTION, SCOPE_ALL = "question_only", "all_readouts"
SPLITS = ("train", "dev", "calibration", "test")

# Limits of the format.
MAX_OPTIONS = 255
MIN_LEVELS, MAX_LEVELS = 2, 10
SUM_TOLERANCE = 1e-6
MAX_BODY_BYTES = 16 * 1024 * 1024
COSINE_EPS = 1e-8
KL_EPS = 1e-12
LOGIT_LIMIT = 1e6
HEAD_WIDTH = 256
BINS = 10
LENGTH_LIMITS = (128, 256, 512, 1024, 2048, 4096, 32768)

# Allowed field names per object.
RECORD_FIELDS = (
    "schema_version", "id", "task_id", "request", "targets",
    "views", "metadata", "weight", "question_weights",
)
REQUEST_FIELDS = ("model", "state", "questions", "images")
QUESTION_FIELDS = ("type", "instructions", "criteria")
VIEW_FIELDS = ("view_id", "request", "equivalence")
TARGET_FIELDS = {
    BERNOULLI: ("kind", "p_true"),
    CLASS: ("kind", "value"),
    DISTRIBUTION: ("kind", "values"),
    ALLOWED_SET: ("kind", "values"),
}
TOKEN_COLUMNS = ("_tokenized", "_token_costs", "_split_group", "_group_inferred")

# Fixed pattern: an embedded picture.
IMAGE_URL = r"^data:image/(?:png|jpeg|webp);base64,[A-Za-z0-9+/]+={0,2}$"
