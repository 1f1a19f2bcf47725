"""Names, bounds and defaults that results have to agree on."""

# Tags a model may write into its raw output, and the state each one switches to.
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
CALL_OPEN = "<tool_call>"
CALL_CLOSE = "</tool_call>"
TAGS = (THINK_OPEN, THINK_CLOSE, CALL_OPEN, CALL_CLOSE)

# Enumerations of the request and response records.
FINISH_REASONS = ("stop", "length", "tool_calls", "function_call")
MESSAGE_ROLES = ("assistant", "function")
DELTA_ROLES = ("system", "user", "assistant", "tool")
REQUEST_ROLES = ("system", "user", "assistant", "tool", "function")
TOOL_CHOICE_MODES = ("none", "auto", "required")
FUNCTION_CALL_MODES = ("none", "auto")
RESPONSE_FORMATS = ("text", "json_object")
IMAGE_DETAILS = ("auto", "low", "high")
CONTENT_PARTS = ("text", "image_url")
CHUNK_OBJECT = "chat.completion.chunk"

# Defaults of the sampling parameters of a chat request.
SAMPLING_DEFAULTS = {
    "temperature": 0.2,
    "top_p": 0.95,
    "top_k": 40,
    "min_p": 0.05,
    "typical_p": 1.0,
    "stream": False,
    "presence_penalty": 0.0,
    "frequency_penalty": 0.0,
    "repeat_penalty": 1.0,
    "tfs_z": 1.0,
    "mirostat_mode": 0,
    "mirostat_tau": 5.0,
    "mirostat_eta": 0.1,
}

# Limits of the embedding operators.
MAX_EMBEDDING_INPUTS = 2048
MAX_TOKENS_PER_TEXT = 256
NORM_FLOOR = 1e-9

# Names of spans, events and models in the telemetry tables.
SPAN_PREFIX = "slm"
SPAN_CHAT = "slm.chat_completion"
SPAN_EMBEDDING = "slm.embedding"
EVENT_CHUNK = "slm.chunk_generated"
UNKNOWN_MODEL = "unknown"

# Telemetry defaults.
SAMPLE_RATE = 0.1
EXCLUDED_URLS = ("/metrics", "/health")

# Message templates of the span log.
LOG_STARTING = "[SLM] starting {}: {}"
LOG_COMPLETED = "[SLM] completed {}: {}"
LOG_FAILED = "[SLM] failed: {}"

# Bucket bounds of the histograms.
SECONDS_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
TOKEN_BOUNDS = (10.0, 50.0, 100.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0)
RATE_BOUNDS = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)
DELAY_BOUNDS = (10.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0)

# Metric names with their help text.
M_DURATION = "slm_completion_duration_seconds"
M_TOKENS = "slm_tokens_total"
M_COMPLETION_RATE = "slm_completion_tokens_per_second"
M_TOTAL_RATE = "slm_total_tokens_per_second"
M_FIRST_TOKEN = "slm_first_token_delay_ms"
M_CHUNK_DELAY = "slm_chunk_delay_ms"
M_CHUNK_DURATION = "slm_chunk_duration_ms"
M_ERRORS = "slm_errors_total"
M_CHUNKS = "slm_chunks_total"
M_EMBED_RATE = "slm_embeddings_per_second"
METRIC_HELP = {
    M_DURATION: "Seconds that a completion took",
    M_TOKENS: "Tokens by kind",
    M_COMPLETION_RATE: "Generated tokens for each second",
    M_TOTAL_RATE: "All tokens, prompt included, for each second",
    M_FIRST_TOKEN: "Milliseconds until the first chunk",
    M_CHUNK_DELAY: "Milliseconds for each chunk on average",
    M_CHUNK_DURATION: "Milliseconds between chunks",
    M_ERRORS: "Failed spans",
    M_CHUNKS: "Chunks of a stream",
    M_EMBED_RATE: "Vectors for each second",
}
