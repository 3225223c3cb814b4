"""Language tags from file names, and per-language function and import extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revsieve.functions.text import CLOSE, OPEN, all_groups, unmarked

# Extension to language, short list.
CORE_EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "jsx", ".tsx": "tsx",
    ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".c": "c", ".cs": "csharp",
    ".rb": "ruby", ".php": "php", ".sql": "sql", ".html": "html", ".css": "css",
    ".sh": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
}
# Further extensions known when a diff is read from the host.
MORE_EXTENSIONS = {
    ".pyi": "python", ".pyx": "python", ".mjs": "javascript", ".kt": "kotlin",
    ".scala": "scala", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp",
    ".rake": "ruby", ".phtml": "php", ".htm": "html", ".scss": "css", ".sass": "css",
    ".bash": "shell", ".zsh": "shell", ".xml": "xml", ".swift": "swift", ".dart": "dart",
    ".r": "r", ".R": "r", ".m": "objective-c", ".mm": "objective-cpp",
}
ALL_EXTENSIONS = {**CORE_EXTENSIONS, **MORE_EXTENSIONS}

# Function definitions per language (pattern, number of groups).
# What they match is given; how is written so that long texts stay linear: where words
# may precede the name, an attempt starts only where an earlier one could not have.
_START = r"(?:(?<!\s)(?=\s)|(?<![\w\s]))"
_TYPED = r"(?:(?:public|private|protected)|" + _START + r")\s*+(?:static\s*+)?\w+\s+(\w+)\s*\("
FUNCTION_PATTERNS = {
    "python": (r"def\s+(\w+)\s*\([^)]*\)", 1),
    "javascript": (r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:\([^)]*\)\s*=>|function))", 2),
    "typescript": (
        r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:\([^)]*\)\s*=>|function)|(?<!\w)(\w+)\s*\([^)]*\)\s*:)", 3),
    "java": (_TYPED, 1),
    "go": (r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", 1),
    "rust": (r"fn\s+(\w+)\s*\(", 1),
    "cpp": (r"(?:\w[\w\s]*\s)?(\w+)\s*\([^)]*\)\s*(?:const)?\s*\{", 1),
    "c": (r"(?:\w[\w\s]*\s)?(\w+)\s*\([^)]*\)\s*\{", 1),
    "csharp": (_TYPED, 1),
    "ruby": (r"def\s+(\w+)", 1),
    "php": (r"function\s+(\w+)\s*\(", 1),
}
# The run of words before a name is tried from its first word only; the blanks before
# that word are set aside, since the reported line is the one of the word.
RUN_START = r"(?<![\w\s])(\s*+)"
RUN_LANGUAGES = ("cpp", "c")
UNICODE = "(?U)"  # words and blanks of all scripts
# Import statements per language (pattern, number of groups).
IMPORT_PATTERNS = {
    "python": (r"(?:from\s+(\S+)\s+import|import\s+(\S+))", 2),
    "javascript": (r"""(?d)(?:import\s+(?:.*\s+from\s+)?['"](\S+)['"]|require\(['"](\S+)['"]\))""", 2),
    "typescript": (r"""(?d)(?:import\s+(?:.*\s+from\s+)?['"](\S+)['"]|require\(['"](\S+)['"]\))""", 2),
    "java": (r"import\s+(?:static\s+)?([\w.]+)", 1),
    "go": (r"""import\s+(?:\([^)]*\)|['"](\S+)['"]|(\S+))""", 2),
    "rust": (r"use\s+([\w:]+)", 1),
    "cpp": (r"""#include\s*[<"]([\w/]+)[>"]""", 1),
    "c": (r"""#include\s*[<"]([\w/]+)[>"]""", 1),
    "csharp": (r"using\s+([\w.]+)", 1),
    "ruby": (r"""require\s+['"](\S+)['"]""", 1),
    "php": (r"""(?:require|include)(?:_once)?\s*['"](\S+)['"]""", 1),
}
MAX_DEPENDENCIES = 10  # Fixed value: dependencies kept per file.


def detect_language(path: Column, extensions: dict[str, str] = ALL_EXTENSIONS) -> Column:
    pairs = [F.lit(x) for kv in extensions.items() for x in kv]
    ext = F.regexp_extract(path, r"(\.[^.]*)$", 1)
    return F.element_at(F.create_map(*pairs), ext)


def _by_language(language: Column, build: dict) -> Column | None:
    out = None
    for lang, expr in build.items():
        out = F.when(language == lang, expr) if out is None else out.when(language == lang, expr)
    return out


def extract_imports(diff: Column, language: Column) -> Column:
    cases = {l: all_groups(diff, UNICODE + rx, n) for l, (rx, n) in IMPORT_PATTERNS.items()}
    return _by_language(language, cases).otherwise(F.array().cast("array<string>"))


def _functions(diff: Column, lang: str) -> Column:
    """``array<struct<name,line>>``: bracket matches, then count newlines before each."""
    pattern, groups = FUNCTION_PATTERNS[lang]
    diff, pattern = unmarked(diff), UNICODE + pattern
    lead = lang in RUN_LANGUAGES
    if lead:
        pattern = f"{UNICODE}{RUN_START}({pattern})"
    marked = F.regexp_replace(diff, pattern, f"$1{OPEN}$2{CLOSE}" if lead else f"{OPEN}$0{CLOSE}")
    pieces = F.split(marked, OPEN, -1)
    breaks = F.transform(
        pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    )
    first = 3 if lead else 1
    names = [
        F.regexp_extract_all(diff, F.lit(pattern), F.lit(g)) for g in range(first, first + groups)
    ]

    def build(piece: Column, i: Column) -> Column:
        name = F.coalesce(*[F.nullif(F.get(n, i - 1), F.lit("")) for n in names])
        line = F.aggregate(F.slice(breaks, 1, i), F.lit(1), lambda a, n: a + n)
        return F.struct(name.alias("name"), line.cast("int").alias("line"))

    built = F.transform(pieces, build)
    return F.filter(
        F.slice(built, 2, F.greatest(F.lit(0), F.size(pieces) - 1)),
        lambda s: s["name"].isNotNull(),
    )


def extract_functions(diff: Column, language: Column) -> Column:
    return _by_language(language, {l: _functions(diff, l) for l in FUNCTION_PATTERNS}).otherwise(
        F.array().cast("array<struct<name:string,line:int>>")
    )


def file_dependencies(diff: Column, language: Column) -> Column:
    """Imported python modules as candidate file paths, relative imports left out."""
    rx, n = IMPORT_PATTERNS["python"]
    modules = F.filter(all_groups(diff, UNICODE + rx, n), lambda m: ~m.startswith("."))
    paths = F.transform(
        modules, lambda m: F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(".py"))
    )
    return F.when(language == "python", F.slice(paths, 1, MAX_DEPENDENCIES)).otherwise(
        F.array().cast("array<string>")
    )
