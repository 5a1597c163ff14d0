"""Fixed values.  They must stay as they are for results to be right."""

# --- Fixed values: names looked for in source text (whole-word match). ---
LEXICAL_API_NAMES = (
    # memory and buffers
    "memcpy", "memmove", "memset", "memcmp", "bcopy", "memccpy",
    "strcpy", "strncpy", "strcat", "strncat", "strlen",
    "stpcpy", "stpncpy", "wcscpy", "wcsncpy", "wcscat", "wcsncat",
    "sprintf", "vsprintf", "swprintf", "vswprintf", "snprintf", "vsnprintf", "vasprintf",
    "bzero", "explicit_bzero",
    # heap
    "malloc", "calloc", "realloc", "alloca", "free",
    "valloc", "pvalloc", "aligned_alloc",
    "strdup", "strndup", "memdup", "wcsdup",
    "av_malloc", "av_realloc", "av_free", "g_malloc", "g_malloc0", "g_free",
    "kmalloc", "kzalloc", "kfree", "vmalloc", "kvfree", "devm_kzalloc",
    "kmem_cache_alloc", "kmem_cache_zalloc", "kmem_cache_free", "kmemdup",
    "kfree_skb", "dev_kfree_skb", "consume_skb",
    # numbers and ids
    "atoi", "atol", "atoll", "atof",
    "strtol", "strtoul", "strtoll", "strtoull",
    "strtod", "strtof", "strtold", "strtoimax", "strtoumax",
    "simple_strtoul", "simple_strtol", "idr_find", "idr_remove",
    # input and process start
    "gets", "gets_s", "scanf", "fscanf", "sscanf", "vscanf", "vfscanf", "vsscanf",
    "system", "popen", "pclose",
    "exec", "execl", "execlp", "execle", "execv", "execvp", "execvpe",
    "WinExec", "ShellExecute", "CreateProcess", "CreateProcessAsUser",
    "dlopen", "dlsym", "LoadLibrary", "GetProcAddress",
    # files
    "open", "fopen", "freopen", "openat", "fdopen",
    "read", "fread", "pread", "write", "fwrite", "pwrite",
    "unlink", "remove", "rename", "mkdir", "rmdir", "chdir",
    "realpath", "getcwd", "access", "chmod", "chown",
    "tmpfile", "tmpnam", "mkstemp", "mktemp",
    # kernel copies
    "copy_from_user", "copy_to_user", "_copy_from_user", "_copy_to_user",
    "__copy_from_user", "__copy_to_user",
    "get_user", "put_user", "__get_user", "__put_user",
    "sock_recvmsg", "sock_sendmsg",
    # locking, queues, block devices
    "atomic_read", "atomic_set", "atomic_inc", "atomic_dec",
    "spin_lock", "spin_unlock", "mutex_lock", "mutex_unlock",
    "skb_dequeue", "skb_queue_tail", "skb_queue_head", "skb_peek", "skb_unlink",
    "blk_execute_rq", "__blk_send_generic", "blk_execute_rq_nowait",
    "sg_io", "bsg_read", "bsg_write",
    # display server
    "dixLookupDevice", "dixLookup", "AttachDevice", "RemoveDevice", "GetMaster",
    # crypto and environment
    "MD4", "MD5", "SHA1", "crypt", "rand", "srand", "getenv", "setenv", "putenv",
    "rc4_hmac_md5", "EVP_EncryptInit",
)

# --- Fixed values: the sink list of the data-flow tool (substring match).  It is the list above
# without five names and with six socket calls. ---
TOOL_ONLY_SINKS = ("recv", "recvfrom", "recvmsg", "send", "sendto", "sendmsg")
LEXICAL_ONLY_APIS = ("vswprintf", "idr_find", "idr_remove", "rc4_hmac_md5", "EVP_EncryptInit")
TOOL_SINK_NAMES = tuple(n for n in LEXICAL_API_NAMES if n not in LEXICAL_ONLY_APIS) + TOOL_ONLY_SINKS

# --- Fixed values: tokens counted by the lexical complexity. ---
COMPLEXITY_TOKENS = ("if", "else", "for", "while", "switch", "case", "&&", "||", "?", "catch")
COMPLEXITY_CAP = 1000

# --- Fixed values: the feature vector, in model order. ---
FEATURE_NAMES = (
    "llm_native_conf", "static_has_flow", "static_complexity", "static_apis_count",
    "static_risk_density", "static_graph_density", "source_type", "code_len_log",
    "is_compressed", "rag_sim_avg", "rag_top1_sim", "rag_var",
    "conflict_disagree_weighted", "conflict_special", "llm_entropy",
)

# --- Fixed values: limits and defaults. ---
LONG_CODE_CHARS = 12_000
EMBEDDING_TEXT_CHARS = 8_000
RETRIEVED_TEXT_CHARS = 2_000
PROMPT_CODE_CHARS = int(int((14_480 - 2_048 - 250) * 2.8) * 0.5)
MIN_SIMILARITY = 0.60
DEFAULT_SIMILARITY = 0.5
RRF_K = 60
TOP_K = 5
DEFAULT_THRESHOLD = 0.5
RELIABLE_CONFIDENCE = 0.3
MIN_TRAINING_ROWS = 100
MANY_EVIDENCE_KEYS = 5

# --- Fixed values: provenance of static facts. ---
SOURCE_NONE, SOURCE_LEXICAL, SOURCE_DATAFLOW = 0, 1, 2

# --- Fixed values: decisions and static-review verdicts a response may hold. ---
DECISIONS = ("VULNERABLE", "BENIGN")
REVIEWS = ("AGREE", "DISAGREE_LOGIC_FOUND", "DISAGREE_FALSE_POSITIVE", "UNCERTAIN")

# --- Fixed values: the characters stripped and split on as white space (Unicode White_Space
# plus the four information separators). ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# --- Fixed values: prompt wording. ---
NO_HITS_TEXT = "No similar vulnerable samples retrieved."
TRUNCATION_MARK = "\n/* ...TRUNCATED... */"
RULE_NO_FLOW = ("- [STRONG CONSTRAINT] Static says **NO FLOW**. Ignore taint bugs. "
                "Focus ONLY on Logic/Race.")
RULE_LOW_DENSITY = "- [HEURISTIC] Low Density. Likely Benign Logic/Wrapper."
RULE_NO_GRAPH = "- [WARN] No Static Graph. Manually trace ALL vars."
RULE_DEFAULT = "- Standard Audit."
RULE_SEPARATOR = "\n    "
SOFT_CUT_MARK = "\n/* ... TRUNCATED ... */\n"
HARD_CUT_MARK = "\n/* ... FORCE TRUNCATED ... */\n"
CUT_ALLOWANCE = 500
EVIDENCE_CONFIRMED = "CONFIRMED RISK (Traced by Joern)"
EVIDENCE_CLEARED = "CLEARED (No Flow Detected by Joern)"
EVIDENCE_HINT = "POTENTIAL HINT (Regex Only)"
EVIDENCE_UNKNOWN = "UNKNOWN"
