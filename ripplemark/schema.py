"""Schemas and fixed values of the impact graph."""

from __future__ import annotations

METADATA = "struct<receiver:string,arg_count:int,kw_names:array<string>,full_call:string,bases:array<string>,is_async:boolean,is_method:boolean,parent_scope:string>"
FILES = "seq int, path string, content string"
NODE_COLUMNS = (
    f"node_id string, file string, line int, name string, type string, category string, end_line int, start_col int, end_col int, "
    f"qualified_name string, signature string, docstring string, parent_scope string, snippet string, metadata {METADATA}"
)
NODES = f"node_seq long, {NODE_COLUMNS}"
EDGES = "edge_seq long, src string, dst string, key string, edge_type string, confidence double, resolution_method string, evidence string, symbol string, alias string, module string, call_site_line int, receiver string, is_recursive boolean, is_candidate boolean"
COMMITS = "ord int, hash string, file string"

CONTAIN, INVOKE, CANDIDATE, IMPORT = "E_contain", "E_invoke", "E_invoke_candidate", "E_import"
INHERIT, IMPLEMENT, OVERRIDE = "E_inherit", "E_implement", "E_override"
EDGE_TYPES = (CONTAIN, INVOKE, CANDIDATE, IMPORT, INHERIT, IMPLEMENT, OVERRIDE)
NODE_TYPES = ("def", "ref")
CATEGORIES = ("file", "class", "struct", "interface", "function", "method", "call", "import", "variable", "field")

#: Base weight of each edge type.
BASE_WEIGHTS = {INVOKE: 1.00, OVERRIDE: 0.95, INHERIT: 0.85, IMPLEMENT: 0.85, IMPORT: 0.60, CONTAIN: 0.50, CANDIDATE: 0.25}
OTHER_WEIGHT = 0.40
PATH_OTHER_WEIGHT = 0.50

#: How call sites resolve, in order of trial, and how sure each is.
RESOLUTION = (
    ("intra_class", 1.00),
    ("import_exact", 0.95),
    ("import_fallback", 0.90),
    ("module_attr", 0.90),
    ("lexical_scope_exact", 0.95),
    ("local_exact", 0.95),
    ("sibling_module", 0.70),
    ("repo_unique", 0.50),
    ("repo_ambiguous", 0.35),
)

#: File extensions that are read, by language.
EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "javascript",
    ".tsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".java": "java",
    ".kt": "java",
    ".c": "cpp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "cpp",
    ".hpp": "cpp",
    ".go": "golang",
    ".rs": "rust",
    ".cs": "csharp",
}
SKIPPED_DIRS = ("__pycache__", "node_modules", "target", "vendor")

#: Symbols that are never linked, by language (a symbol of any language is skipped in all).
BUILTINS = {
    "python": {
        "print", "len", "range", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "enumerate", "zip",
        "map", "filter", "min", "max", "sum", "abs", "open", "isinstance", "issubclass", "getattr", "setattr",
        "hasattr", "delattr", "super", "type", "id", "hash", "repr", "iter", "next", "any", "all", "if", "else",
        "elif", "for", "while", "return", "def", "class", "import", "from", "as", "try", "except", "finally",
        "raise", "with", "yield", "async", "await", "os", "sys", "re", "math", "json", "time", "datetime",
        "logging",
    },
    "javascript": {
        "console", "log", "warn", "error", "info", "require", "import", "export", "default", "return", "if", "else",
        "for", "while", "const", "let", "var", "function", "class", "async", "await", "new", "this", "super", "try",
        "catch", "finally", "throw", "document", "window", "Promise", "setTimeout", "setInterval", "clearTimeout",
        "Array", "Object", "String", "Number", "Boolean", "JSON", "Math", "Date",
    },
    "java": {
        "System", "out", "println", "print", "main", "String", "Integer", "Double", "Boolean", "List", "Map", "Set",
        "ArrayList", "HashMap", "HashSet", "Arrays", "Collections", "Math", "public", "private", "protected",
        "static", "final", "void", "class", "interface", "new", "return", "if", "else", "for", "while", "try",
        "catch", "throw",
    },
    "cpp": {
        "printf", "scanf", "cout", "cin", "endl", "std", "string", "vector", "map", "set", "malloc", "free",
        "sizeof", "new", "delete", "nullptr", "NULL", "void", "int", "char", "class", "struct", "template",
        "namespace", "using", "include", "return", "if", "else",
    },
    "golang": {
        "fmt", "Println", "Printf", "Print", "Sprintf", "make", "new", "len", "cap", "append", "copy", "panic",
        "recover", "close", "func", "type", "struct", "interface", "package", "import", "return", "if", "else",
        "for", "range", "go", "select", "chan",
    },
    "rust": {
        "println", "print", "format", "vec", "panic", "Some", "None", "Ok", "Err", "String", "Vec", "Option",
        "Result", "fn", "struct", "enum", "impl", "trait", "pub", "mut", "let", "use", "mod", "return", "match",
        "if", "else", "for", "while",
    },
    "csharp": {
        "Console", "WriteLine", "Write", "string", "int", "var", "public", "private", "protected", "static", "void",
        "class", "interface", "namespace", "using", "return", "new", "if", "else",
    },
}
ALL_BUILTINS = frozenset().union(*BUILTINS.values())

#: Fixed values of the commands.
DEFAULT_K = 2
CONTEXT_CHARS = 8000
TRUNCATED = "\n... [context truncated]"
