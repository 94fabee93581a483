"""Symbol rules: one row per language and kind of declaration.

A rule finds a declaration on one line. Languages are data here: adding one
means adding rows. Patterns use ``(?d)`` so that only ``\\n`` ends a line for
``.``, ``^`` and ``$``.
"""

from __future__ import annotations

from dataclasses import dataclass

# File extensions that are read, and the language of each.
SOURCE_EXTENSIONS = (
    ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs",
    ".vue", ".ipynb", ".go", ".java", ".php", ".rs", ".cs", ".csx", ".rb",
    ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp",
    ".clj", ".cljs", ".cljc", ".edn",
    ".kt", ".kts", ".swift", ".scala", ".dart",
    ".sh", ".bash", ".zsh", ".lua", ".r",
    ".pl", ".pm", ".ex", ".exs", ".erl", ".hs",
    ".jl", ".zig",
)
LANGUAGE_EXTENSIONS = {
    "python": ("py", "pyi"),
    "ts": ("ts", "tsx", "js", "jsx", "mjs", "cjs"),
    "go": ("go",),
    "java": ("java",),
    "php": ("php",),
    "rust": ("rs",),
    "csharp": ("cs", "csx"),
    "ruby": ("rb",),
    "c": ("c", "cpp", "cc", "cxx", "h", "hpp"),
    "clojure": ("clj", "cljs", "cljc", "edn"),
    "vue": ("vue",),
    "notebook": ("ipynb",),
}

# Folders that are never read, and those skipped on request.
IGNORED_DIRS = (
    ".venv", "venv", "node_modules", "__pycache__",
    ".git", "dist", "build", "target", "bin", "obj", ".gradle",
    ".idea", ".vscode", "coverage", ".next", ".nuxt", ".turbo",
)
EXTRA_IGNORED_DIRS = (
    "third_party", "deps", "docs", "documentation", "website", "site",
    "tests", "test", "fixtures", "mocks", "examples", "benchmark", "benchmarks",
)
IGNORED_DIR_PARTS = ("node_modules", ".venv", "__pycache__")
EXTRA_IGNORED_DIR_PARTS = ("node_modules", "vendor", "test", "docs")


@dataclass(frozen=True)
class Rule:
    lang: str
    role: str            # type, func or route: which contract rules apply
    kind: str            # symbol type before endpoint detection
    pattern: str
    end: str = "block"   # block, plus5, or window20 / window25: see the extractor
    group: int = 1       # group of the name; for a route, of the path
    verb: int = 0        # group of the verb of a route
    not_names: tuple[str, ...] = ()
    pick: str = ""       # rules of one pick on a line: only the first match counts
    fold_names: bool = False


# Names that look like declarations but are statements.
TS_KEYWORDS = ("if", "for", "while", "switch", "catch", "class", "interface", "constructor")
C_TYPE_KEYWORDS = ("if", "for", "while", "switch", "return")
C_FUNC_KEYWORDS = ("if", "for", "while", "switch", "catch", "return")
GENERIC_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "var", "let", "const")

# The declaration patterns of each language.
RULES = (
    Rule("broken_python", "type", "function", r"(?d)^\s*(?:async\s+)?def\s+([a-zA-Z0-9_]+)\s*\((.*?)\)"),
    Rule("broken_python", "type", "class", r"(?d)^\s*class\s+([a-zA-Z0-9_]+)"),
    Rule("ts", "type", "interface", r"(?d)(?:export\s+)?(?:interface|type)\s+([a-zA-Z0-9_]+)"),
    Rule("ts", "func", "function", r"(?d)(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_]+)\s*\((.*?)\)",
         not_names=TS_KEYWORDS, pick="ts"),
    Rule("ts", "func", "function", r"(?d)(?:export\s+)?const\s+([a-zA-Z0-9_]+)\s*=\s*(?:async\s*)?\((.*?)\)\s*(?::\s*[^=]+)?=>",
         not_names=TS_KEYWORDS, pick="ts"),
    Rule("ts", "func", "function", r"(?d)^\s*(?:public|private|protected|async)?\s*(?:async\s+)?([a-zA-Z0-9_]+)\s*\((.*?)\)\s*(?::\s*[^{]+)?\s*\{",
         not_names=TS_KEYWORDS, pick="ts"),
    Rule("go", "func", "function", r"(?d)^func\s+(?:\(([^)]+)\)\s+)?([a-zA-Z0-9_]+)\s*\(([^)]*)\)", group=2),
    Rule("go", "struct", "class", r"(?d)^type\s+([a-zA-Z0-9_]+)\s+struct\s*\{"),
    Rule("java", "type", "class", r"(?d)public\s+(?:class|interface)\s+([a-zA-Z0-9_]+)"),
    Rule("java", "func", "method", r"(?d)public\s+(?:[a-zA-Z0-9_<>,\[\]]+\s+)+([a-zA-Z0-9_]+)\s*\((.*?)\)"),
    Rule("php", "route", "endpoint", r"""(?d)Route::(get|post|put|delete|patch|options)\s*\(\s*["']([^"']+)["']""", end="plus5", group=2, verb=1),
    Rule("php", "type", "class", r"(?d)(?:final\s+|abstract\s+)?(?:class|interface|trait)\s+([a-zA-Z0-9_]+)"),
    Rule("php", "func", "method", r"(?d)(?:public|protected|private)?\s*(?:static\s+)?function\s+([a-zA-Z0-9_]+)\s*\((.*?)\)"),
    Rule("rust", "type", "class", r"(?d)(?:pub(?:\([^\)]+\))?\s+)?(?:struct|enum|trait|union)\s+([a-zA-Z0-9_]+)"),
    Rule("rust", "func", "function", r"(?d)(?:pub(?:\([^\)]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([a-zA-Z0-9_]+)\s*(?:<[^>]+>)?\s*\((.*?)\)"),
    Rule("csharp", "type", "class", r"(?d)(?:public|internal|private)?\s*(?:static\s+|abstract\s+|partial\s+)?(?:class|interface|struct|record)\s+([a-zA-Z0-9_]+)"),
    Rule("csharp", "func", "method", r"(?d)(?:public|internal|protected|private)?\s*(?:static\s+|async\s+|virtual\s+|override\s+)*(?:Task(?:<[^>]+>)?|[a-zA-Z0-9_<>,\[\]]+)\s+([a-zA-Z0-9_]+)\s*\((.*?)\)"),
    Rule("ruby", "type", "class", r"(?d)^\s*(?:class|module)\s+([a-zA-Z0-9_:]+)"),
    Rule("ruby", "func", "method", r"(?d)^\s*def\s+([a-zA-Z0-9_!?=]+)"),
    Rule("ruby", "route", "endpoint", r"""(?d)^\s*(get|post|put|delete|patch)\s+["']([^"']+)["']""", end="plus5", group=2, verb=1),
    Rule("c", "type", "class", r"(?d)^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?:alignas\([^)]*\)\s+)?([A-Za-z_][A-Za-z0-9_]*)(?:\s*:\s*[^;{]+)?\s*(?:\{|$)",
         not_names=C_TYPE_KEYWORDS, pick="c"),
    Rule("c", "func", "function", r"(?d)^\s*(?:(?:inline|static|constexpr|virtual|explicit|friend|auto)\s+)*(?:(?:const\s+)?[A-Za-z_][A-Za-z0-9_:*&<>\s]+?\s+)?([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)?)\s*\(([^;]*)\)\s*(?:const)?\s*(?:noexcept(?:\([^)]*\))?)?\s*(?:override|final)?\s*(?:->\s*[^;{]+)?\s*(?:\{|$)",
         not_names=C_FUNC_KEYWORDS, pick="c"),
    Rule("clojure", "func", "function", r"(?d)\(\s*(?:defn|defn-|def|defmacro)\s+([a-zA-Z0-9_\-\.\*\+\!\?]+)"),
    Rule("clojure", "route", "endpoint", r"""(?d)\(\s*(GET|POST|PUT|DELETE|PATCH)\s+["']([^"']+)["']""", group=2, verb=1),
    Rule("generic", "type", "class", r"(?d)^\s*(?:class|struct|interface|type|module|trait|enum)\s+([a-zA-Z0-9_]+)", end="window20"),
    Rule("generic", "func", "function", r"(?di)^\s*(?:def|func|fn|function|fun|sub|proc|task|void|int|string|bool)\s+([a-zA-Z0-9_]+)\s*(?:\(|$)",
         end="window25", not_names=GENERIC_KEYWORDS, pick="generic", fold_names=True),
    Rule("generic", "func", "function", r"(?di)^\s*(?:let|const|var|val)\s+([a-zA-Z0-9_]+)\s*=\s*(?:function|\([^)]*\)\s*=>)",
         end="window25", not_names=GENERIC_KEYWORDS, pick="generic", fold_names=True),
)

# Import patterns, by line (group 1) or over the whole text.
LINE_IMPORTS = {
    "php": r"(?d)^\s*use\s+([a-zA-Z0-9_\\]+)",
    "rust": r"(?d)^\s*use\s+([a-zA-Z0-9_:]+)",
    "csharp": r"(?d)^\s*using\s+([a-zA-Z0-9_.]+);",
    "ruby": r"""(?d)^\s*require(?:_relative)?\s+["']([^"']+)["']""",
    "clojure": r"(?d)\(\s*ns\s+([a-zA-Z0-9_\-\.]+)",
    "generic": r"(?d)^\s*(?:import|use|require|include|open|from)\s+([a-zA-Z0-9_\.\-\/]+)",
}
TEXT_IMPORTS = {
    "ts": r"""(?d)import\s+.*?\s+from\s+['"]([^'"]+)['"]""",
    "c": r"""(?d)#\s*include\s*["<]([^">]+)[">]""",
}
GO_IMPORT = r'import\s*\(\s*([\s\S]*?)\)|import\s+"([^"]+)"'

# Endpoint patterns.
PY_VERB_ROUTE = r"""(?di)@?(?:app|router|api|bp)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
PY_PLAIN_ROUTE = r"""(?di)@?(?:app|router|api|bp)\.route\s*\(\s*['"]([^'"]+)['"](?:.*methods\s*=\s*\[([^\]]+)\])?"""
TS_EXPRESS = r"""(?di)(?:app|router|server|api)\.(get|post|put|delete|patch)\s*\(\s*['"`]([^'"`]+)['"`]"""
TS_NEST = r"""(?di)@(Get|Post|Put|Delete|Patch)\s*\(\s*['"`]([^'"`]+)['"`]"""
GO_ROUTER = r'(?di)(?:r|router|api|v1|group|e|app|rg)\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*"([^"]+)"'
GO_HANDLE = r'(?d)http\.HandleFunc\s*\(\s*"([^"]+)"'
GO_SWAGGER = r"(?d)//\s*@Router\s+([^\s]+)\s+\[([a-zA-Z]+)\]"
SPRING_METHOD = r"""(?d)@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']"""
SPRING_CLASS = r"""(?d)@RequestMapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']"""
ACTIX = r"""(?d)#\[(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']\s*\)\]"""
ASPNET = r"""(?d)\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\s*(?:\(\s*["']([^"']+)["']\s*\))?\]"""
GENERIC_ROUTE = r"""(?di)(?:@Route|@Get|@Post|@Put|@Delete|router\.(?:get|post|put|delete)|app\.(?:get|post|put|delete))\s*\(\s*["']([^"']+)["']"""
ANY_VERB = r"(?i)(get|post|put|delete|patch)"

# Client-call patterns.
PY_CLIENT = (
    r"""(?di)(?:requests|httpx|aiohttp)\.(get|post|put|delete|patch)\s*\(\s*f?['"`]([^'"`]+)['"`]|"""
    r"""(?:requests|httpx)\.request\s*\(\s*['"`](GET|POST|PUT|DELETE|PATCH)['"`]\s*,\s*f?['"`]([^'"`]+)['"`]|"""
    r"""(?:session|client)\.(get|post|put|delete|patch)\s*\(\s*f?['"`](https?://[^'"`]+|/(?:api/|v[0-9]+/)[^'"`]+)['"`]"""
)
TS_CLIENT = (
    r"""(?di)(?:fetch|axios\.(get|post|put|delete|patch)|axios|ky\.(get|post|put|delete|patch)|ky|"""
    r"""apiClient\.(get|post|put|delete|patch)|httpClient\.(get|post|put|delete|patch))\s*\(\s*[`'"]([^`'"]+)[`'"]"""
)
GO_GET_POST = r'(?d)http\.(?:Get|Post)\s*\(\s*"([^"]+)"'
GO_REQUEST = r'(?di)http\.NewRequest(?:WithContext)?\s*\(\s*"(GET|POST|PUT|DELETE|PATCH)"\s*,\s*"([^"]+)"'
GO_CLIENT = r'(?di)(?:client|req|c)\.(Get|Post|Put|Delete)\s*\(\s*"([^"]+)"'
PLAIN_CLIENTS = {
    "php": r"""(?di)(?:Http::|\$client->|\$this->http->)(get|post|put|delete|patch|request)\s*\(\s*["']([^"']+)["']""",
    "rust": r"""(?d)(?:reqwest::|client\.)(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""",
    "csharp": r"""(?d)(?:\.|\b)(GetAsync|PostAsync|PutAsync|DeleteAsync)\s*\(\s*["']([^"']+)["']""",
    "ruby": r"""(?d)(?:Faraday|Net::HTTP|HTTParty)\.(get|post|put|delete)\s*\(?\s*["']([^"']+)["']""",
    "clojure": r"""(?d)\(\s*(?:client/|http/)(get|post|put|delete)\s+["']([^"']+)["']""",
    "generic": r"""(?di)(fetch|\.get|\.post|\.put|\.delete)\s*\(\s*["']([^"']+)["']""",
}

# URL endings that are files, not endpoints.
PY_ASSETS = (".py", ".ts", ".js", ".json", ".html", ".css", ".png", ".jpg")
TS_ASSETS = (".ts", ".js", ".tsx", ".jsx", ".json", ".html", ".css", ".png", ".jpg")
PLAIN_ASSETS = (".png", ".jpg", ".css", ".svg", ".json", ".js")

# How many lines a block takes when its end is not found.
BRACE_FALLBACK, OTHER_FALLBACK = 30, 40
