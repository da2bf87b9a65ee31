"""Fixed values that decide results, kept together so that they are easy to compare."""

# --- fixed values: split, folds and model selection ---------------------------------------
SEED = 42
HOLDOUT_SHARE = (15, 100)  # a ratio of integers, so that quotas are exact
N_FOLDS = 5
QUALITY_FLOOR = 0.55
DEFAULT_MODEL = "naive_bayes"
CHALLENGER_MODEL = "logistic_regression"

# --- fixed values: candidate models and their grids ---------------------------------------
NB_NGRAM, NB_MIN_DF, NB_ALPHA = 2, 1, 0.1
LR_NGRAM, LR_MIN_DF, LR_C = 1, 1, 10.0
HEAD_C = 1.0
LR_MAX_ITER = 1000
LR_TOLERANCE = 1e-4
GRID_NGRAM = (1, 2)
GRID_MIN_DF = (1, 2, 3)
GRID_ALPHA = (0.1, 0.5, 1.0)
GRID_C = (0.1, 1.0, 10.0)

# --- fixed values: scoring, thresholds and reports ----------------------------------------
CONFIDENCE_THRESHOLD = 0.61
PRECISION_TARGET = 0.95
SWEEP_POINTS = 100
TOP_K = 3
MAX_TEXT_CHARS = 5000
N_CONFUSED_PAIRS = 10
N_WORST_ERRORS = 30
N_MEASURED = 100
ENCODE_BATCH = 64
REVIEW_LABEL = "needs_review"

# --- fixed values: patterns ---------------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
STRIP_PATTERN = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
KEPT_CHARACTER = r"(?U)[^\s\x1C-\x1F]"

# --- fixed values: cell texts that a CSV reader takes as "no value" -------------------------
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: the words of Spark's default English stop list that can be tokens ---------
STOP_WORDS = tuple(
    """
    me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very can will just don should now cannot could ought would
    """.split()
)

# --- limits on what may be held in one place (raise, never drop) ----------------------------
MAX_CLASSES = 10_000
MAX_VOCABULARY_ON_DRIVER = 5_000_000
