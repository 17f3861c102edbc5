"""Symbols, imports and summaries of source files, by suffix.

Python needs its own grammar, so files are parsed in Arrow batches; a file that
does not parse keeps its row with an error and no symbols.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL = "struct<name: string, symbol_type: string, line_start: int, line_end: int, signature: string, docstring: string, qualified_name: string, parent_name: string, summary: string>"
SCHEMA = f"file_id long, language string, imports array<string>, summary string, symbols array<{SYMBOL}>, error string"
# Forms of top-level symbols in TypeScript and JavaScript, in this order, and of imports.
TS_FORMS = (
    ("function", "function", re.compile(r"^\s*(?:export\s+)?function\s+([A-Za-z0-9_]+)\s*\((.*?)\)", re.M)),
    ("class", "class", re.compile(r"^\s*(?:export\s+)?class\s+([A-Za-z0-9_]+)", re.M)),
    ("exported_constant", "const", re.compile(r"^\s*export\s+const\s+([A-Za-z0-9_]+)", re.M)),
)
TS_IMPORT = re.compile(r"^\s*import\s+.*?from\s+['\"]([^'\"]+)['\"]", re.M)
# Language of a suffix.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def _mentioned(node: ast.AST, most: int = 5) -> list[str]:
    """First distinct identifiers below a node, in walk order."""
    out: dict[str, None] = {}
    for n in ast.walk(node):
        word = n.attr if isinstance(n, ast.Attribute) else n.id if isinstance(n, ast.Name) else n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else ""
        word = word.strip().lower().replace(" ", "_")
        if len(word) >= 3 and re.fullmatch(r"[a-z0-9_]+", word):
            out.setdefault(word)
        if len(out) == most:
            break
    return list(out)


def parse_python(text: str) -> dict:
    """Top-level classes, their direct methods and top-level functions; imports of the whole file."""
    tree = ast.parse(text)
    symbols, imports = [], set()

    def callable_(node, parent=None):
        args = ", ".join(a.arg for a in node.args.args)
        words = _mentioned(node)
        return {
            "name": node.name, "symbol_type": "method" if parent else "function", "line_start": node.lineno, "line_end": node.end_lineno,
            "signature": f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({args})", "docstring": ast.get_docstring(node),
            "qualified_name": f"{parent}.{node.name}" if parent else node.name, "parent_name": parent, "summary": f"Python callable {node.name}" + (f" using {', '.join(words)}" if words else ""),
        }

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.add(node.module)
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            symbols.append({"name": node.name, "symbol_type": "class", "line_start": node.lineno, "line_end": node.end_lineno, "signature": None, "docstring": ast.get_docstring(node), "qualified_name": node.name, "parent_name": None, "summary": f"Python class {node.name}"})
            symbols += [callable_(x, node.name) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append(callable_(node))
    return {"imports": sorted(imports), "symbols": symbols}


def parse_script(text: str, language: str) -> dict:
    """Functions, classes and exported constants of TypeScript or JavaScript, form by form; a symbol spans at most four lines."""
    lines = len(text.splitlines())
    symbols = []
    for kind, word, form in TS_FORMS:
        for m in form.finditer(text):
            first = text.count("\n", 0, m.start()) + 1
            signature = f"{word} {m[1]}({m[2]})" if kind == "function" else f"{word} {m[1]}"
            symbols.append({"name": m[1], "symbol_type": kind, "line_start": first, "line_end": min(lines, first + 3), "signature": signature, "docstring": None, "qualified_name": m[1], "parent_name": None, "summary": f"{language.title()} {kind} {m[1]}"})
    return {"imports": sorted(set(TS_IMPORT.findall(text))), "symbols": symbols}


def module_summary(name: str, parsed: dict, language: str) -> str:
    """One sentence on a module; for Python with its first symbols and the first words of their summaries."""
    symbols = parsed["symbols"]
    if language != "python":
        return f"{language.title()} module {name} with {len(symbols)} exported symbols."
    words = dict.fromkeys(w for s in symbols for w in re.split(r"[_\W]+", s["summary"].lower()) if len(w) >= 4)
    out = f"Python module {name} with {len(symbols)} top-level symbols and {len(parsed['imports'])} imports."
    if symbols:
        out += f" Key symbols: {', '.join(s['name'] for s in symbols[:3])}."
    return out + (f" Keywords: {', '.join(list(words)[:6])}." if words else "")


def parse_one(path: str, text: str) -> tuple:
    """(language, imports, summary, symbols, error) of one file."""
    name = path.rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    language = LANGUAGES.get(suffix, "unknown")
    if language in ("python", "typescript", "javascript"):
        try:
            parsed = parse_python(text) if language == "python" else parse_script(text, language)
        except (SyntaxError, ValueError, RecursionError) as e:
            return language, [], module_summary(name, {"symbols": [], "imports": []}, language), [], f"{type(e).__name__}: {e}"
        return language, parsed["imports"], module_summary(name, parsed, language), parsed["symbols"], None
    first = next((x.strip("# ").strip() for x in text.splitlines() if x.strip()), name)
    return language, [], f"{language.title()} document {name}: {first[:120]}", [], None


def parse_files(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, path, text, keep...) -> SCHEMA and the kept columns. Null texts count as empty; documents keep a summary only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *parse_one(p or "", t or "")) for f, p, t in zip(b["file_id"], b["path"], b["text"])]
            out = pd.DataFrame(rows, columns=["file_id", "language", "imports", "summary", "symbols", "error"])
            yield out.assign(**{c: b[c].to_numpy() for c in keep})

    kinds = dict(files.dtypes)
    return files.select("file_id", "path", "text", *(c for c in keep if c != "path")).mapInPandas(run, SCHEMA + "".join(f", {c} {kinds[c]}" for c in keep))


def path_tags(path: Column | str) -> Column:
    """Tags that a repository-relative path gives: test, config, docs, architecture."""
    p = F.lower(path)
    name = F.substring_index(path, "/", -1)
    script = p.rlike(r"\.(ts|tsx|js|jsx)$")
    test = F.when(script, p.rlike(r"\.(test|spec)\.")).otherwise(p.endswith(".py") & F.contains(p, F.lit("test")))
    config = p.endswith(".py") & (F.contains(p, F.lit("config")) | name.startswith("settings"))
    doc = ~script & ~p.endswith(".py")
    return F.array_compact(F.array(F.when(test, "test"), F.when(config, "config"), F.when(doc & p.rlike("adr|decision"), "architecture"), F.when(doc & F.contains(p, F.lit("readme")), "docs")))
