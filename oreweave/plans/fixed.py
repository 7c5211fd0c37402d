"""Fixed values that results depend on, and the schemas of the tables operators exchange."""

from __future__ import annotations

# Names of library functions that count as junk.
JUNK_FUNCTIONS = [
    "printf", "malloc", "free", "scanf", "puts", "gets", "exit", "socket", "sendto", "close", "setuid", "setsockopt",
    "strlen", "perror", "getpid", "inet_aton", "gethostbyname", "strtol",
]

# Entry points of the C runtime.
RUNTIME_ENTRY_FUNCTIONS = ["_start", "start", "__libc_start_main", "__libc_csu_init", "__libc_csu_fini"]

# Which header declares which symbols; headers in this order.
HEADER_MAP = {
    "<stdio.h>": ["printf", "fprintf", "sprintf", "snprintf", "puts", "putchar", "perror", "scanf", "fscanf", "sscanf", "fgets", "fputs", "fopen", "fclose", "fread", "fwrite"],
    "<stdlib.h>": ["malloc", "calloc", "realloc", "free", "exit", "abort", "atoi", "atof", "strtol", "strtoul", "qsort", "rand", "srand", "abs", "labs"],
    "<string.h>": ["strcpy", "strncpy", "strcat", "strncat", "strcmp", "strncmp", "strlen", "strstr", "memcpy", "memmove", "memcmp", "memset", "strerror", "strtok", "strpbrk", "strrchr"],
    "<math.h>": ["sin", "cos", "tan", "sqrt", "pow", "log", "exp", "log10", "ceil", "floor"],
    "<unistd.h>": ["read", "write", "close", "sleep", "usleep", "fork", "execve", "pipe", "dup", "dup2", "getpid"],
    "<pthread.h>": ["pthread_create", "pthread_join", "pthread_mutex_lock", "pthread_mutex_unlock", "pthread_cond_wait", "pthread_cond_signal", "pthread_rwlock_init", "pthread_rwlock_destroy", "pthread_rwlock_rdlock", "pthread_rwlock_wrlock"],
    "<netinet/in.h>": ["socket", "bind", "listen", "accept", "inet_addr", "htons", "htonl", "ntohs", "ntohl"],
    "<sys/types.h>": ["open", "close", "read", "write", "lseek", "stat", "fstat", "unlink", "rename"],
    "<time.h>": ["clock", "time", "ctime", "difftime", "strftime", "localtime", "mktime", "gmtime", "asctime"],
    "<fcntl.h>": ["open", "close", "read", "write", "fcntl", "ioctl", "pipe2", "dup2", "select"],
}

# What makes a literal a shell command, and what a format string.
COMMAND_WORDS = ["iptables", "chmod", "chown", "wget", "curl", "rm ", "ifconfig", ";", "&&", "||"]
FORMAT_PATTERN = "%[0-9]*[duxspcf]"

# Parameters of scoring and selection.
BASE_SCORE, CALLS_TARGET_BONUS, CALLEE_COST, DEGREE_COST, TOKENS_PER_POINT = 100, 30, 5, 10, 100.0
BUDGET, DEGREES, IMPORTANT, LARGE_SHARE = 2048, 2, 5, 0.5
LEVEL_SHARES = (0.25, 0.6)
TINY_BLOCKS, TINY_INSNS = 2, 8
LOWEST_CONSTANT = 0x1000
MAX_TYPE_DEPTH = 10
NO_LABEL = "/* NO_GROUND_TRUTH_AVAILABLE */"

# How a function's head looks in C text, and the spellings of a literal that are looked for, in this order:
# as it is, line feeds escaped, escapes as line feeds, without white space at its ends, without line feeds.
FUNCTION_HEAD = r"[A-Za-z0-9_*\s]+?\b{name}\s*\([^;]*\)\s*\{{"
LITERAL_SPELLINGS = [("", ""), ("\n", "\\n"), ("\\n", "\n"), "strip", ("\n", "")]

# Defaults of the compile step.
COMPILER, OPTIMISATION, TIMEOUT_S, FILE_BLOCKS, ARG_MAX = "gcc", 1, 60, 5242880, 2097152

#: Schemas, as Spark DDL.
REPO_DUMP = "repo_name string, file_array array<struct<file_path: string, file_content: string>>"
REPO_FILES = "repo string, path string, content string, src_file string, line_no bigint, file_idx int"
OBJECT_SYMBOLS = "repo string, o_path string, pos int, sym_type string, name string"
FUNCTIONS = "binary_id string, addr bigint, name string, is_plt boolean, n_blocks int, n_insns int, cfg_nodes int, cfg_edges int"
CALL_EDGES = "binary_id string, src bigint, dst bigint"
INSN = "struct<address: bigint, size: int, text: string, operands: array<struct<type: string, imm: bigint, base: string, disp: bigint>>>"
BLOCKS = f"binary_id string, func_addr bigint, block_ord int, block_addr bigint, insns array<{INSN}>"
READELF_LINES = "binary_id string, line_no int, line string"
SEGMENTS = "binary_id string, vaddr bigint, bytes binary"
DIES = "o_path string, die_off bigint, parent_off bigint, ord int, tag string, name string, type_off bigint"
CONST_POOL = "binary_id string, func_addr bigint, ord int, addr bigint, bytes binary, text string, kind string, placeholder string"
SAMPLES = "binary_path string, target_function_name string, model_input string, label_c_code string, context_role string"
