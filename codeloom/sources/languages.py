"""Rules of the languages that sources.parsers reads, as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

# Languages by file extension.
EXTENSIONS = {
    "rust": "rs", "python": "py pyi", "java": "java", "csharp": "cs", "javascript_typescript": "js jsx mjs cjs ts mts cts tsx", "cpp": "cpp cc cxx hpp hh h", "go": "go", "lua": "lua",
    "kotlin": "kt kts", "php": "php", "powershell": "ps1 psm1", "bash": "sh bash", "html": "html htm", "css": "css", "xml": "xml", "xaml": "xaml", "markdown": "md",
}
#: Known extensions without a parser: files of theirs are reported.
PENDING = ("swift", "rb")
LANGUAGE_OF = {e: name for name, many in EXTENSIONS.items() for e in many.split()}


@dataclass(frozen=True)
class Rules:
    """How a language of blocks writes what the index wants to know.

    comments: starts of line comments; block: of block comments; quotes: string delimiters.
    types: keyword -> kind; functions: keywords before a function's name. bare: functions and
    methods may come without a keyword. ends: blocks end with a word, opened by one of opens.
    colon: supertypes follow a colon. imports: patterns over a line, group 1 the name.
    """

    comments: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    types: dict[str, str] = field(default_factory=dict)
    functions: tuple[str, ...] = ()
    bare: bool = False
    ends: str | None = None
    opens: tuple[str, ...] = ()
    colon: bool = False
    imports: tuple[str, ...] = ()
    constants: tuple[str, ...] = ()
    ignore_case: bool = False


_CLASSES = {"class": "class", "interface": "interface", "enum": "enum"}
#: Words before a bracket that call nothing.
NO_CALL = set("if for foreach while switch catch return new sizeof typeof elif else elseif do try function fn fun func match when in and or not assert await yield throw lock using with until unless case defer super this self".split())

RULES = {
    "rust": Rules(types={"struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "type_alias", "union": "struct"}, functions=("fn",), quotes='"', imports=(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(.+?);",), constants=("const", "static")),
    "java": Rules(types={**_CLASSES, "record": "class"}, bare=True, imports=(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",)),
    "csharp": Rules(types={**_CLASSES, "struct": "struct", "record": "class", "namespace": "module"}, bare=True, colon=True, imports=(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",), constants=("const",)),
    "javascript_typescript": Rules(types={**_CLASSES, "namespace": "module", "type": "type_alias"}, functions=("function",), bare=True, quotes="\"'`", imports=(r"^\s*(?:import|export)\b[^'\"]*?from\s*['\"]([^'\"]+)['\"]", r"^\s*import\s*['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"), constants=("const",)),
    "cpp": Rules(types={"class": "class", "struct": "struct", "enum": "enum", "namespace": "module", "union": "struct"}, bare=True, colon=True, imports=(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",)),
    "go": Rules(types={}, functions=("func",), quotes="\"'`", imports=(r"^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"",), constants=("const",)),
    "lua": Rules(comments=("--",), block=("--[[", "]]"), functions=("function",), ends="end", opens=("function", "if", "for", "while", "do"), imports=(r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]",)),
    "kotlin": Rules(types={**_CLASSES, "object": "class"}, functions=("fun",), colon=True, imports=(r"^\s*import\s+([\w.]+(?:\.\*)?)",), constants=("val",)),
    "php": Rules(comments=("//", "#"), types={**_CLASSES, "trait": "trait", "namespace": "module"}, functions=("function",), imports=(r"^\s*use\s+([\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"), constants=("const",)),
    "powershell": Rules(comments=("#",), block=("<#", "#>"), types={"class": "class", "enum": "enum"}, functions=("function", "filter"), colon=True, bare=True, imports=(r"^\s*Import-Module\s+['\"]?([\w./\\-]+)", r"^\s*using\s+module\s+([\w./\\-]+)"), ignore_case=True),
    "bash": Rules(comments=("#",), block=None, functions=("function",), bare=True, imports=(r"^\s*(?:source|\.)\s+['\"]?([^\s'\"]+)",)),
}
