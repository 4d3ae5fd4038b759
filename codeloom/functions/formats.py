"""Tables and graphs as text, and token counts of text, for responses the driver builds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}


def count_tokens(text: str) -> int:
    """functions.text.estimate_tokens for a string."""
    runs = re.findall(r"[A-Za-z0-9]+", text)
    return sum((len(r) + 3) // 4 for r in runs) + len(re.sub(r"[A-Za-z0-9\s]+", "", text))


def encode_table(name: str, headers: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """name[rows]{headers}: and a line of values for each row; values with a comma, quote,
    backslash or line break are quoted. Missing cells are empty."""
    lines = []
    for row in rows:
        cells = ["" if v is None else str(v) for v in row[: len(headers)]]
        cells += [""] * (len(headers) - len(cells))
        lines.append("  " + ",".join(f'"{"".join(_ESCAPES.get(c, c) for c in v)}"' if re.search(r'[,"\\\n\r]', v) else v for v in cells))
    return "\n".join([f"{name}[{len(lines)}]{{{','.join(headers)}}}:", *lines, ""])


def decode_table(text: str) -> tuple[str, list[str], list[list[str]]] | None:
    """What encode_table wrote; None for anything else."""
    lines = text.split("\n")
    head = re.fullmatch(r"([^\[\]{}]*)\[(\d+)\]\{([^{}]*)\}:", lines[0])
    body = lines[1:-1] if lines[-1] == "" else lines[1:]
    if not head or len(body) != int(head[2]):
        return None
    headers, rows = head[3].split(",") if head[3] else [], []
    for line in body:
        if not line.startswith("  "):
            return None
        cells, at, line = [], 0, line[2:]
        while True:
            if line[at : at + 1] == '"':
                m = re.compile(r'"((?:\\.|[^"\\])*)"').match(line, at)
                if not m or re.search(r'\\[^\\"nr]', re.sub(r"\\\\", "", m[1])):
                    return None
                cells.append(re.sub(r"\\(.)", lambda x: _BACK[x[1]], m[1]))
                at = m.end()
            else:
                end = line.find(",", at)
                end = len(line) if end < 0 else end
                cells.append(line[at:end])
                at = end
            if at >= len(line):
                break
            if line[at] != ",":
                return None
            at += 1
        if len(cells) != max(1, len(headers)):
            return None
        rows.append(cells)
    return head[1], headers, rows


def dot(edges: Iterable[tuple[str, str]], cyclic: set[tuple[str, str]] = frozenset()) -> str:
    """A directed graph in the DOT language; edges of cycles are red."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    lines = [f"  {quote(a)} -> {quote(b)}{' [color=red]' if (a, b) in cyclic else ''};" for a, b in sorted(set(edges))]
    return "\n".join(["digraph dependencies {", *lines, "}", ""])


def mermaid(edges: Iterable[tuple[str, str]], cyclic: set[tuple[str, str]] = frozenset()) -> str:
    """The same as a Mermaid flowchart; edges of cycles are dotted and say so."""
    edges = sorted(set(edges))
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for e in edges for x in e}))}
    label = lambda s: '"' + "".join(c if c.isalnum() or c in " /._-" else f"#{ord(c)};" for c in s) + '"'
    lines = [f"  {i}[{label(n)}]" for n, i in ids.items()] + [f"  {ids[a]} {'-.->|cycle|' if (a, b) in cyclic else '-->'} {ids[b]}" for a, b in edges]
    return "\n".join(["flowchart LR", *lines, ""])
