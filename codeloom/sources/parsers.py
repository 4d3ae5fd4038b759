"""Source files as symbols, relations and literals: a parser for each language, in Arrow batches.

Parsers read only; they never run what they read and never fail on it: a file that can't be
parsed gives what was found and an issue. Languages of blocks share one scanner over tokens
with the tables of sources.languages; Python uses its own grammar, markup its own readers.
"""

from __future__ import annotations

import ast
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import prepare
from codeloom.sources.languages import LANGUAGE_OF, NO_CALL, PENDING, RULES, Rules

#: Literals of a file at most, and nested blocks that are followed.
MAX_LITERALS, MAX_DEPTH = 500, 256
SYMBOL = "name string, kind string, parent string, line int, col int, byte_len int, end_line int, level int"
RELATION = "from_index int, kind string, to_name string, line int, col int, qualifier string, member boolean"
TOKEN = "kind string, text string, line int"
PARSED = f"relative_path string, language string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, relations array<struct<{RELATION.replace(' ', ':').replace(',:', ',')}>>, literals array<struct<line:int,text:string,from_index:int>>, issue string, issue_line int"


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    literals: list[dict] = field(default_factory=list)
    issue: str | None = None
    issue_line: int | None = None

    def symbol(self, name: str, kind: str, line: int, col: int = 1, end_line: int | None = None, parent: str | None = None, level: int | None = None) -> int:
        self.symbols.append({"name": name, "kind": kind, "parent": parent, "line": line, "col": col, "byte_len": len(name.encode()), "end_line": end_line, "level": level})
        return len(self.symbols) - 1

    def relation(self, source: int, kind: str, name: str, line: int, col: int = 1, qualifier: str | None = None, member: bool = False) -> None:
        self.relations.append({"from_index": source, "kind": kind, "to_name": name, "line": line, "col": col, "qualifier": qualifier, "member": member})

    def literal(self, line: int, text: str, source: int) -> None:
        if len(self.literals) < MAX_LITERALS and is_prose(text) and not any(x["text"] == text and x["line"] == line for x in self.literals[-8:]):
            self.literals.append({"line": line, "text": " ".join(text.split()), "from_index": source})


def entropy(text: str) -> float:
    """Bits a character by the text's own frequencies."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def looks_secret(text: str) -> bool:
    """Twenty characters without a space, a digit among them, and an entropy as random ones have."""
    return len(text) >= 20 and not re.search(r"\s", text) and any(c.isdigit() for c in text) and entropy(text) >= 3.5


def is_prose(text: str) -> bool:
    """Several words, or one with letters that is no key."""
    text = text.strip()
    return 3 <= len(text) <= 512 and any(c.isalpha() for c in text) and not looks_secret(text)


def language_of(path: str) -> str | None:
    return LANGUAGE_OF.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def module_name(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


# ---- tokens -----------------------------------------------------------------------------------


@dataclass
class Token:
    kind: str  # word, string, number or punctuation
    text: str
    line: int
    col: int


_patterns: dict[str, re.Pattern] = {}


def _pattern(rules: Rules, name: str) -> re.Pattern:
    if name not in _patterns:
        quotes = "|".join(rf"{q}(?:\\.|[^{q}\\])*{q}" if q == "`" else rf"{q}(?:\\.|[^{q}\\\n])*{q}" for q in rules.quotes)
        block = [rf"{re.escape(rules.block[0])}.*?(?:{re.escape(rules.block[1])}|\Z)"] if rules.block else []
        line = [rf"(?<!\$){re.escape(c)}[^\n]*" if c == "#" else rf"{re.escape(c)}[^\n]*" for c in rules.comments]
        word = r"[^\W\d][\w-]*" if name in ("powershell", "bash") else r"[^\W\d]\w*"
        _patterns[name] = re.compile(rf"(?P<skip>{'|'.join(block + line)})|(?P<string>{quotes})|(?P<number>\d[\w.]*)|(?P<word>{word})|(?P<punctuation>::|->|=>|\S)", re.DOTALL)
    return _patterns[name]


def tokens(text: str, language: str) -> list[Token]:
    """Words, strings, numbers and punctuation with their places; comments are left out."""
    out, line, start, last = [], 1, 0, 0
    for m in _pattern(RULES.get(language, Rules(comments=("#",), block=None)), language).finditer(text):
        breaks = text.count("\n", last, m.start())
        if breaks:
            line += breaks
            start = text.rindex("\n", last, m.start()) + 1
        last = m.start()
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line, m.start() - start + 1))
    return out


# ---- languages of blocks ----------------------------------------------------------------------


def _imports(text: str, rules: Rules, out: Parsed, source: int) -> None:
    for i, row in enumerate(text.split("\n"), 1):
        for pattern in rules.imports:
            for m in re.finditer(pattern, row, re.IGNORECASE if rules.ignore_case else 0):
                name = re.sub(r"\s", "", m[1])
                head, _, many = name.partition("{")
                for one in many.rstrip("}").split(",") if many else [name]:
                    leaf = _last_name(one.split("as ")[0] or head.rstrip(":"))
                    if leaf:
                        out.relation(source, "imports", leaf, i, m.start(1) + 1, head.rstrip(":") or None)


def _last_name(path: str) -> str:
    """'./lib/util.js' -> util, 'a::b::C' -> C, 'java.util.*' -> util."""
    path = path.rstrip("*;:./\\")
    if "/" in path or re.search(r"\.(?:sh|bash|ps1|psm1|php|h|hpp|hh|js|ts|lua)$", path):
        return re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1])
    return re.split(r"::|[.\\]", path)[-1]


def parse_blocks(text: str, language: str, path: str) -> Parsed:
    """Symbols, calls, supertypes and literals of a language of blocks, by one pass over its tokens."""
    rules, out = RULES[language], Parsed()
    module = out.symbol(module_name(path), "module", 1)
    _imports(text, rules, out, module)
    toks = tokens(text, language)
    n = len(toks)
    stack: list[tuple[int, int | None, str]] = []  # depth of the block, symbol, kind of what it holds
    depth, pending = 0, None  # a symbol that waits for its block
    fold = str.lower if rules.ignore_case else str
    at = lambda i: toks[i].text if 0 <= i < n else ""

    def owner() -> int:
        return next((s for _, s, _ in reversed(stack) if s is not None), module)

    def holder() -> tuple[str | None, str]:
        found = next(((s, k) for _, s, k in reversed(stack) if s is not None), None)
        return (out.symbols[found[0]]["name"], found[1]) if found else (None, "module")

    def closing(i: int) -> int:
        """Place behind the bracket that closes the one at i."""
        level = 0
        for j in range(i, min(n, i + 4_000)):
            level += {"(": 1, ")": -1}.get(toks[j].text, 0) if toks[j].kind == "punctuation" else 0
            if not level:
                return j + 1
        return n

    def supertypes(i: int, symbol: int, kind: str) -> None:
        how, j = ("extends" if rules.colon else None), i
        seen_colon = False
        while j < n and toks[j].text not in ("{", ";", "=>") and j < i + 60:
            word = fold(toks[j].text)
            if word in ("extends", "implements"):
                how, seen_colon = word, True
            elif word == ":" and rules.colon:
                seen_colon = True
            elif word in ("where", "permits"):
                break
            elif word == "(":
                j = closing(j)
                continue
            elif word == "<":
                level = 0
                while j < n:
                    level += {"<": 1, ">": -1}.get(toks[j].text, 0)
                    j += 1
                    if not level:
                        break
                continue
            elif seen_colon and toks[j].kind == "word" and word not in ("public", "private", "protected", "virtual") and at(j + 1) not in (".", "::"):
                out.relation(symbol, how or "extends", toks[j].text, toks[j].line, toks[j].col)
            j += 1

    i = 0
    while i < n:
        t = toks[i]
        word = fold(t.text)
        if t.kind == "string":
            out.literal(t.line, t.text[1:-1], owner())
        elif t.kind == "punctuation" or (rules.ends and word in (rules.ends, *rules.opens, "until", "repeat")):
            opens = t.text == "{" or (rules.ends and word in rules.opens and not (word == "do" and any(fold(at(k)) in ("for", "while") for k in range(max(0, i - 40), i) if toks[k].line == t.line)))
            closes = t.text == "}" or (rules.ends and word == rules.ends)
            if rules.ends and word == "function":
                opens = False
            if opens:
                depth += 1
                if pending is not None and len(stack) < MAX_DEPTH:
                    stack.append((depth, *pending))
                pending = None
            elif closes:
                while stack and stack[-1][0] >= depth:
                    _, symbol, _ = stack.pop()
                    if symbol is not None and out.symbols[symbol]["end_line"] is None:
                        out.symbols[symbol]["end_line"] = t.line
                depth = max(0, depth - 1)
            elif t.text == ";" and pending is not None:
                if pending[0] is not None:
                    out.symbols[pending[0]]["end_line"] = t.line
                pending = None
        if t.kind == "word":
            before, after = at(i - 1), at(i + 1)
            parent, inside = holder()
            in_type = inside in ("class", "struct", "interface", "enum", "trait")
            nxt = toks[i + 1] if i + 1 < n else None
            if language == "rust" and word == "impl" and before not in ("->", ":", "&", "(", "<", ","):
                names, j, level = [], i + 1, 0
                while j < n and toks[j].text not in ("{", ";", "where"):
                    level += {"<": 1, ">": -1}.get(toks[j].text, 0)
                    if toks[j].kind == "word" and not level:
                        names.append(toks[j])
                    j += 1
                for_ = next((k for k, x in enumerate(names) if x.text == "for"), None)
                target = names[-1] if names else None
                known = next((k for k, s in enumerate(out.symbols) if target and s["name"] == target.text and s["kind"] != "module"), None)
                if target and for_ and known is not None:
                    out.relation(known, "implements", names[for_ - 1].text, names[for_ - 1].line, names[for_ - 1].col)
                if target:
                    # a block that makes functions methods of a type; the type itself began elsewhere
                    pending = (known, "trait") if known is not None else (out.symbol(target.text, "struct", target.line, target.col), "trait")
                i = j
                continue
            if language == "go" and word == "type" and nxt and nxt.kind == "word":
                kind = {"struct": "struct", "interface": "interface"}.get(at(i + 2), "type_alias")
                symbol = out.symbol(nxt.text, kind, nxt.line, nxt.col, None if kind != "type_alias" else nxt.line)
                pending = (symbol, kind) if kind != "type_alias" else pending
                i += 2
                continue
            if word in rules.types and nxt and nxt.kind == "word" and before not in (".", "::") and not (word == "type" and at(i + 2) not in ("=", "<")) and nxt.text not in ("class", "struct"):
                kind = rules.types[word]
                symbol = out.symbol(nxt.text, kind, nxt.line, nxt.col, nxt.line if kind == "type_alias" else None, parent if inside != "module" else None)
                pending = (symbol, kind) if kind != "type_alias" else pending
                if kind not in ("module", "type_alias"):
                    supertypes(i + 2, symbol, kind)
                    if at(i + 2) == "(":  # a primary constructor
                        i = closing(i + 2)
                        continue
                i += 2
                continue
            if word in rules.functions and before != ".":
                j, receiver = i + 1, None
                if language == "go" and at(j) == "(":
                    words = [x.text for x in toks[j : closing(j)] if x.kind == "word"]
                    receiver, j = (words[-1] if words else None), closing(j)
                name = None
                while j < n and toks[j].kind == "word":
                    name = toks[j]
                    if at(j + 1) in (".", ":", "::") and j + 2 < n and toks[j + 2].kind == "word":
                        receiver, j = toks[j].text, j + 2
                        continue
                    break
                if rules.ends:
                    depth += 1
                if name is not None and name.text not in ("use",):
                    kind = "method" if receiver or in_type else "function"
                    symbol = out.symbol(name.text, kind, name.line, name.col, None, receiver or (parent if in_type or inside in ("function", "method") else None))
                    if rules.ends:
                        stack.append((depth, symbol, kind))
                    else:
                        pending = (symbol, kind)
                    i = closing(j + 1) if at(j + 1) == "(" else j + 1
                    continue
                if rules.ends:
                    stack.append((depth, None, "block"))
                i += 1
                continue
            if word in rules.constants and nxt and nxt.kind == "word" and before != ".":
                names = [x for x in toks[i + 1 : i + 6] if x.kind == "word"]
                eq = next((k for k in range(i + 1, min(n, i + 8)) if toks[k].text in ("=", ":")), None)
                name = toks[eq - 1] if eq and toks[eq - 1].kind == "word" else names[0]
                function = eq is not None and at(eq) == "=" and any(toks[k].text == "=>" for k in range(eq, min(n, eq + 30)) if toks[k].line == name.line)
                symbol = out.symbol(name.text, "function" if function else "constant", name.line, name.col, name.line, parent if in_type else None)
                if function:
                    out.symbols[symbol]["end_line"] = None
                    pending = (symbol, "function")
                    arrow = next(k for k in range(eq, min(n, eq + 30)) if toks[k].text == "=>")
                    if at(arrow + 1) != "{":
                        out.symbols[symbol]["end_line"], pending = name.line, None
                    i = arrow + 1
                    continue
                i = toks.index(name, i) + 1
                continue
            if after == "(" and word not in NO_CALL:
                end = closing(i + 1)
                j = end
                while rules.bare and j < n and (fold(at(j)) in ("const", "override", "noexcept", "final", "throws", "async") or (at(j - 1) == "throws" or (at(j) == "," and "throws" in (at(k) for k in range(end, j))))):
                    j += 1
                if rules.bare and language == "javascript_typescript" and at(j) == ":" and in_type:
                    while j < n and toks[j].text not in ("{", ";", "="):
                        j += 1
                typed = language in ("java", "csharp", "cpp") and (toks[i - 1].kind == "word" and before not in NO_CALL | {"new"} or before in (">", "]", "*", "&", "~")) if i else False
                plain = language in ("javascript_typescript", "powershell") and in_type or language == "bash" and at(i + 2) == ")"
                constructor = in_type and parent == t.text
                qualified_ = language == "cpp" and before == "::" and i >= 2 and inside == "module"
                if rules.bare and at(j) == "{" and inside not in ("function", "method") and (typed or plain or constructor or qualified_):
                    receiver = at(i - 2) if qualified_ else parent if in_type else None
                    kind = "method" if receiver else "function"
                    symbol = out.symbol(t.text, kind, t.line, t.col, None, receiver)
                    pending = (symbol, kind)
                    i = j
                    continue
                if in_type and at(j) == ";" and typed and inside == "interface":
                    out.symbol(t.text, "method", t.line, t.col, t.line, parent)
                    i = j
                    continue
                member = before in (".", "->", ":") and language != "cpp" or before in (".", "->")
                qualifier = at(i - 2) if before in ("::", ".") and i >= 2 and toks[i - 2].kind == "word" and at(i - 2)[:1].isupper() else None
                out.relation(owner(), "calls", t.text, t.line, t.col, qualifier, member and qualifier is None)
            elif language in ("bash", "powershell") and inside and before not in ("$", "-", ".") and any(s["name"] == t.text and s["kind"] == "function" for s in out.symbols) and (i == 0 or toks[i - 1].line != t.line or before in (";", "|", "&", "{", "(", "then", "do", "else")):
                out.relation(owner(), "calls", t.text, t.line, t.col)
        i += 1
    last = text.count("\n") + 1
    for s in out.symbols[1:]:
        if s["end_line"] is None:
            s["end_line"] = last
    if depth:
        out.issue, out.issue_line = "syntax_error", last
    return out


# ---- Python -----------------------------------------------------------------------------------


def parse_python(text: str, path: str) -> Parsed:
    out = Parsed()
    module = out.symbol(module_name(path), "module", 1)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.issue, out.issue_line = "syntax_error", getattr(e, "lineno", None)
        return out
    name_of = lambda e: e.id if isinstance(e, ast.Name) else e.attr if isinstance(e, ast.Attribute) else None

    def uses(node: ast.AST, source: int) -> None:
        """Calls and literals in node, but not in the definitions in it."""
        todo = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, ast.Call) and (name := name_of(x.func)):
                of = name_of(x.func.value) if isinstance(x.func, ast.Attribute) else None
                qualifier = of if of and of[:1].isupper() else None
                out.relation(source, "calls", name, x.lineno, x.col_offset + 1, qualifier, isinstance(x.func, ast.Attribute) and qualifier is None)
            elif isinstance(x, ast.Constant) and isinstance(x.value, str):
                out.literal(x.lineno, x.value, source)
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                for a in x.names:
                    parts = a.name.split(".")
                    whole = ".".join(filter(None, (getattr(x, "module", None), ".".join(parts[:-1])))) or None
                    out.relation(source, "imports", parts[-1] if a.name != "*" else (x.module or "").split(".")[-1], x.lineno, x.col_offset + 1, whole)
            todo += [c for c in ast.iter_child_nodes(x) if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]

    todo: list[tuple[ast.AST, int, str | None, bool]] = [(tree, module, None, False)]
    while todo:
        node, source, parent, in_class = todo.pop(0)
        uses(node, source)
        stack = list(ast.iter_child_nodes(node))
        while stack:
            c = stack.pop(0)
            if isinstance(c, ast.ClassDef):
                s = out.symbol(c.name, "class", c.lineno, c.col_offset + 7, c.end_lineno, parent)
                for b in c.bases:
                    if name_of(b):
                        out.relation(s, "extends", name_of(b), b.lineno, b.col_offset + 1)
                todo.append((c, s, c.name, True))
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                s = out.symbol(c.name, "method" if in_class else "function", c.lineno, c.col_offset + 5, c.end_lineno, parent)
                todo.append((c, s, c.name, False))
            else:
                if isinstance(c, ast.Assign) and node is tree:
                    for t in c.targets:
                        if isinstance(t, ast.Name):
                            out.symbol(t.id, "constant" if t.id.isupper() else "variable", c.lineno, c.col_offset + 1, c.end_lineno)
                stack = list(ast.iter_child_nodes(c)) + stack
    return out


# ---- markup -----------------------------------------------------------------------------------


class _Markup(HTMLParser):
    """Elements with an id or a name, scripts and styles, links and event handlers."""

    def __init__(self, path: str, xaml: bool = False):
        super().__init__(convert_charrefs=True)
        self.out, self.xaml = Parsed(), xaml
        self.module = self.out.symbol(module_name(path), "module", 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line, col = self.getpos()
        own = {k: v or "" for k, v in attrs}
        at = self.module
        if self.xaml:
            if "x:class" in own:
                at = self.module = self.out.symbol(own["x:class"].rsplit(".", 1)[-1], "class", line, col + 1)
            elif name := own.get("x:name") or own.get("name"):
                at = self.out.symbol(name, "element", line, col + 1, parent=tag)
            for k, v in own.items():
                if k.startswith("xmlns") and "clr-namespace:" in v:
                    self.out.relation(self.module, "imports", v.split("clr-namespace:")[1].split(";")[0].rsplit(".", 1)[-1], line, col + 1)
                elif m := re.fullmatch(r"\{(?:StaticResource|DynamicResource|Binding)\s+(\w+)\}", v):
                    self.out.relation(at, "references", m[1], line, col + 1)
                elif re.fullmatch(r"[A-Za-z_]\w*_\w+", v) and not k.startswith("x:"):
                    self.out.relation(at, "references", v, line, col + 1)
            return
        if own.get("id"):
            at = self.out.symbol(own["id"], "element", line, col + 1, parent=tag)
        link = own.get("src") if tag in ("script", "img", "iframe") else own.get("href")
        if link and not re.match(r"(?:[a-z]+:|//|#)", link):
            self.out.relation(at, "imports" if tag in ("script", "link") else "references", link.split("?")[0].split("#")[0].rsplit("/", 1)[-1] or link, line, col + 1, link)
        for k, v in own.items():
            if k.startswith("on"):
                for name in re.findall(r"(?<![.\w])([A-Za-z_$][\w$]*)\s*\(", v):
                    self.out.relation(at, "calls", name, line, col + 1)
            elif k == "class":
                for name in v.split():
                    self.out.relation(at, "references", name, line, col + 1)

    handle_startendtag = handle_starttag

    def handle_data(self, data: str) -> None:
        if self.lasttag not in ("script", "style"):
            self.out.literal(self.getpos()[0], data, self.module)


def parse_markup(text: str, path: str, xaml: bool = False) -> Parsed:
    reader = _Markup(path, xaml)
    reader.feed(text)
    reader.close()
    return reader.out


def parse_xml(text: str, path: str) -> Parsed:
    """Elements down to the second level, with names from their id or name; no relations."""
    out, depth = Parsed(), 0
    out.symbol(module_name(path), "module", 1)
    for m in re.finditer(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([/?!]?)([\w:.-]+)((?:\"[^\"]*\"|'[^']*'|[^>])*?)(/?)>", text, re.DOTALL):
        if not m[2] or m[1] in ("?", "!"):
            continue
        if m[1] == "/":
            depth = max(0, depth - 1)
            continue
        if depth < 2:
            named = re.search(r"\b(?:id|name)\s*=\s*[\"']([^\"']+)", m[3], re.IGNORECASE)
            start = text.rfind("\n", 0, m.start()) + 1
            out.symbol(named[1] if named else m[2], "element", text.count("\n", 0, m.start()) + 1, m.start() - start + 1, level=depth + 1)
        depth += m[4] != "/"
    return out


def parse_css(text: str, path: str) -> Parsed:
    """Classes, ids and custom properties of rules; imports and uses of properties."""
    out = Parsed()
    module = out.symbol(module_name(path), "module", 1)
    bare = re.sub(r"/\*.*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)
    place = lambda i: (bare.count("\n", 0, i) + 1, i - bare.rfind("\n", 0, i))
    for m in re.finditer(r"@import\s+(?:url\()?\s*[\"']?([^\"')\s;]+)", bare):
        out.relation(module, "imports", m[1].rsplit("/", 1)[-1], *place(m.start(1)), m[1])
    for m in re.finditer(r"([^{};]+)\{([^{}]*)\}", bare):
        end = place(m.end())[0]
        rule = module
        for s in re.finditer(r"[.#](-?[A-Za-z_][\w-]*)", re.sub(r"\[[^\]]*\]", "", m[1])):
            rule = out.symbol(s[1], "rule", *place(m.start(1) + s.start()), end)
        for d in re.finditer(r"(--[\w-]+)\s*:", m[2]):
            out.symbol(d[1], "variable", *place(m.start(2) + d.start()), parent=out.symbols[rule]["name"] if rule else None)
        for d in re.finditer(r"var\(\s*(--[\w-]+)", m[2]):
            out.relation(rule, "references", d[1], *place(m.start(2) + d.start(1)))
        for d in re.finditer(r"@apply\s+([^;]+)", m[2]):
            for name in d[1].split():
                out.relation(rule, "references", name, *place(m.start(2) + d.start()))
    return out


def parse_markdown(text: str, path: str) -> Parsed:
    """Headings with their level, links to files as references; fenced code is passed over."""
    out, fence, above = Parsed(), None, []
    module = out.symbol(module_name(path), "module", 1)
    at, lines = module, text.split("\n")
    for i, row in enumerate(lines, 1):
        mark = re.match(r"\s{0,3}(```+|~~~+)", row)
        if mark and (fence is None or mark[1].startswith(fence)):
            fence = mark[1][:3] if fence is None else None
            continue
        if fence:
            continue
        if m := re.match(r"\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$", row):
            level = len(m[1])
            above = [x for x in above if x[0] < level]
            at = out.symbol(m[2], "element", i, m.start(2) + 1, None, above[-1][1] if above else None, level)
            above.append((level, m[2]))
        for m in re.finditer(r"(!?)\[[^\]]*\]\(\s*<?([^)\s>]+)", row):
            if not re.match(r"(?:[a-z]+:|#|//)", m[2]):
                target = m[2].split("#")[0]
                out.relation(at, "imports" if target.endswith(".md") else "references", target.rsplit("/", 1)[-1], i, m.start(2) + 1, target)
        if row.strip() and not row.lstrip().startswith(("#", "|")):
            out.literal(i, row, at)
    return out


def parse(path: str, text: str) -> tuple[str | None, Parsed]:
    """(language, what the file holds); languages without a parser give an issue."""
    language = language_of(path)
    if language is None:
        known = path.rsplit(".", 1)[-1].lower() in PENDING
        return None, Parsed(issue="unsupported_language" if known else None)
    if language in RULES:
        return language, parse_blocks(text, language, path)
    readers = {"python": parse_python, "html": parse_markup, "css": parse_css, "xml": parse_xml, "markdown": parse_markdown, "xaml": lambda t, p: parse_markup(t, p, True)}
    return language, readers[language](text, path)


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each of files(relative_path, text) that has a language or an issue, by PARSED."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["relative_path"], b["text"], strict=True):
                language, found = parse(path, text or "")
                if language or found.issue:
                    rows.append((path, language, found.symbols, found.relations, found.literals, found.issue, found.issue_line))
            out = pd.DataFrame(rows, columns=["relative_path", "language", "symbols", "relations", "literals", "issue", "issue_line"], dtype=object)
            out["issue_line"] = out["issue_line"].astype("Int32")
            yield out

    return files.where(F.col("text").isNotNull()).select("relative_path", "text").mapInPandas(run, PARSED)


def symbol_key(path: Column, symbol: Column) -> Column:
    """An id that stays while a definition keeps its place: from path, kind, parent, name, line and column."""
    return F.xxhash64(path, *[F.coalesce(symbol.getField(c).cast("string"), F.lit("")) for c in ("kind", "parent", "name", "line", "col")])


@dataclass
class Tables:
    files: DataFrame
    symbols: DataFrame
    relations: DataFrame
    literals: DataFrame
    issues: DataFrame


def graph_tables(parsed: DataFrame) -> Tables:
    """files, symbols, relations and literals as the operators take them, and issues, of parse_files' rows."""
    path = F.col("relative_path")
    own = parsed.where(F.col("language").isNotNull()).withColumn("file_id", F.xxhash64(path))
    keys = F.transform("symbols", lambda s: symbol_key(path, s))
    own = own.withColumn("keys", keys)
    symbols = own.select("file_id", F.explode("symbols").alias("s"), "relative_path").select(symbol_key(path, F.col("s")).alias("symbol_id"), "file_id", "s.*")
    relations = own.select("file_id", "keys", F.posexplode("relations").alias("i", "r"))
    relations = relations.select(F.xxhash64("file_id", "i").alias("relation_id"), F.get("keys", F.col("r.from_index")).alias("from_symbol_id"), "r.kind", "r.to_name", "r.line", "r.col", F.lit(None).cast("string").alias("qualifier"), F.col("r.qualifier").alias("written_qualifier"), "r.member")
    literals = own.select("file_id", "keys", F.posexplode("literals").alias("i", "l")).select(F.xxhash64("file_id", "i", F.lit("literal")).alias("literal_id"), "file_id", F.get("keys", F.col("l.from_index")).alias("symbol_id"), "l.line", "l.text")
    issues = parsed.where(F.col("issue").isNotNull()).select("relative_path", F.col("issue").alias("issue_kind"), F.concat(F.lit("line "), F.col("issue_line").cast("string")).alias("detail"))
    return Tables(own.select("file_id", "relative_path", "language"), symbols, relations, literals, issues)


def callable_tokens(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, language, relative_path, name, line, end_line, tokens, context) of functions and methods.

    tokens are those between a callable's lines; context is its parent. Languages without a
    token source give nothing.
    """
    prepare(files.sparkSession)
    bodies = symbols.where(F.col("kind").isin("function", "method") & F.col("end_line").isNotNull()).select("symbol_id", "file_id", "name", "line", "end_line", "parent")
    held = bodies.groupBy("file_id").agg(F.collect_list(F.struct("symbol_id", "name", "line", "end_line", "parent")).alias("own"))
    src = files.select("file_id", "relative_path", "language", "text").where(F.col("language").isin(*RULES, "python")).join(held, "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, text, own in zip(b["relative_path"], b["language"], b["text"], b["own"], strict=True):
                every = tokens(text, language)
                for s in own:
                    part = [{"kind": t.kind, "text": t.text, "line": t.line} for t in every if s["line"] <= t.line <= s["end_line"]]
                    rows.append((s["symbol_id"], language, path, s["name"], s["line"], s["end_line"], part, s["parent"] or ""))
            yield pd.DataFrame(rows, columns=["symbol_id", "language", "relative_path", "name", "line", "end_line", "tokens", "context"])

    return src.mapInPandas(run, f"symbol_id long, language string, relative_path string, name string, line int, end_line int, tokens array<struct<{TOKEN.replace(' ', ':').replace(',:', ',')}>>, context string")
