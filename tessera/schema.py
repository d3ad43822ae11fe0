"""Fixed values and table schemas of the corpus model."""

from __future__ import annotations

# --- Fixed values: they must be just these for right results. ---

LANG_BY_EXT = {
    "py": "python", "pyi": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "lua": "lua",
    "sh": "bash", "bash": "bash",
}

SKIP_DIRS = (
    ".git", ".hg", ".svn", ".tessera", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "dist", "build", "target", ".next", ".nuxt", "vendor", ".idea", ".vscode",
    "coverage", ".cache", "eggs", ".eggs",
)

STOPWORDS = tuple(sorted(set("""
abstract and as assert async await base bool boolean break byte case catch chan
char class const continue crate def default defer del delegate do double dyn
elif else enum except export extends extern false final finally float fn for
foreach from func function get global go goto if impl implements import in
init instanceof int interface internal is lambda let long loop map match mod
module mut namespace new nil none nonlocal not null object of operator or
override package pass print private protected pub public raise range readonly
ref return sealed select self set short sizeof static str strict string struct
super switch sync this throw throws trait true try type typedef typeof uint
undefined union unsafe unsigned use using var vec void volatile where while
with yield
args callable classmethod cls console dict document enumerate exports getattr
hasattr isinstance iter kwargs len list module next open property repr require
setattr sorted staticmethod tuple window zip
add append clear copy count decode discard encode endswith extend filter
format index insert items join keys lower pop popitem push remove replace
reverse setdefault shift slice sort splice split startswith strip title
update upper values write
""".split())))  # fmt: skip

IDENT = r"[A-Za-z_][A-Za-z0-9_]{2,63}"
SUBTOKEN = r"[A-Z]+(?=[A-Z][a-z0-9])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+"

#: Definitions in text without a parser, by priority: pattern (one group, the name) and kind.
FALLBACK = (
    (r"^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)", "function"),
    (r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?function[ \t]*\*?[ \t]*([A-Za-z_]\w*)", "function"),
    (r"^[ \t]*(?:export[ \t]+)?(?:abstract[ \t]+)?class[ \t]+([A-Za-z_]\w*)", "class"),
    (r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?fn[ \t]+([A-Za-z_]\w*)", "function"),
    (r"^[ \t]*func[ \t]+(?:\([^)]*\)[ \t]*)?([A-Za-z_]\w*)", "function"),
    (r"^[ \t]*(?:public|private|protected)[ \t]+(?:static[ \t]+)?[\w<>\[\]]+[ \t]+([A-Za-z_]\w*)[ \t]*\(", "method"),
)

MAX_FILE_SIZE, SAMPLED_BYTES, LONGEST_LINE = 1_000_000, 65_536, 1_000
SIGNATURE, IDENTS_PER_FILE = 120, 2_000
K1, B, NAME_BOOST, RRF_K, POOL, TEST_DEMOTION = 1.5, 0.75, 2.0, 60, 50, 0.6
DAMPING, MAX_ITER, TOL, AMBIENT, AMBIENT_FILES = 0.85, 60, 1e-8, 0.25, 20
MAP_BUDGET, IMPACT_BUDGET, SINCE_HOURS, ROWS_PER_IDENT = 2_048, 1_500, 24.0, 3

# --- Tables ---

FILES = "path string, sha string, mtime double, size long, lang string"
SYMBOLS = "path string, name string, kind string, line int, end_line int, signature string, seq int"
IDENTS = "path string, name string, count long"
VECTORS = "path string, line int, name string, vector array<float>"
QUERY_LOG = "ts double, cmd string, args string, size long, empty boolean"
