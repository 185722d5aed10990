"""Chunks at definitions.  Python is parsed exactly; other languages by a scan for declarations, which is approximate."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..model import LANGUAGES
from . import chunk

SHORTEST, DEEPEST = 30, 2
_OUT = "array<struct<chunk_type:string,chunk:string,metadata:string>>"
_EXPORT = r"^(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(?:async\s+)?"
#: Annotations and modifiers before a declaration.
_JAVA = r"^(?:(?:@[\w.]+(?:\([^)\n]*\))?|[a-z]+)\s+)*"
#: What begins a declaration, by language and chunk type; the first that fits counts.
_STARTS = {
    "javascript": {"function_declaration": _EXPORT + r"function\b\s*\*?\s*(?P<name>\w+)", "class_declaration": _EXPORT + r"class\b\s*(?P<name>\w+)", "arrow_function": r"^export\s+default\s+(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>(?P<name>)"},
    "typescript": {
        "function_declaration": _EXPORT + r"function\b\s*\*?\s*(?P<name>\w+)", "class_declaration": _EXPORT + r"class\b\s*(?P<name>\w+)",
        "interface_declaration": _EXPORT + r"interface\b\s*(?P<name>\w+)", "type_alias_declaration": _EXPORT + r"type\b\s*(?P<name>\w+)",
    },
    "tsx": {"function_declaration": _EXPORT + r"function\b\s*\*?\s*(?P<name>\w+)", "class_declaration": _EXPORT + r"class\b\s*(?P<name>\w+)"},
    "go": {"method_declaration": r"^func\s*\([^)]*\)\s*(?P<name>\w+)", "function_declaration": r"^func\s+(?P<name>\w+)", "type_declaration": r"^type\b\s*(?P<name>\w+)?"},
    "java": {"class_declaration": _JAVA + r"class\s+(?P<name>\w+)", "interface_declaration": _JAVA + r"interface\s+(?P<name>\w+)"},
}
#: Strings and comments, whose braces do not count.
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|//[^\n]*|/\*.*?\*/", re.S)


def python_chunks(source: str) -> list[tuple[str, str | None, int, int]]:
    """(type, name, first line, last line) of definitions at most ``DEEPEST`` levels down that are not inside another."""
    found = []

    def visit(node: ast.AST, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                first, name = child.lineno, child.name
                if child.decorator_list:
                    kind, first, name = "decorated_definition", child.decorator_list[0].lineno, None
                found.append((kind, name, first - 1, (child.end_lineno or child.lineno) - 1))
            elif depth + 2 <= DEEPEST and not isinstance(child, ast.If | ast.Try | ast.TryStar | ast.With | ast.AsyncWith | ast.For | ast.AsyncFor | ast.While):
                visit(child, depth + 1)

    visit(ast.parse(source), 0)
    return found


def declared_chunks(source: str, language: str) -> list[tuple[str, str | None, int, int]]:
    """Declarations at the margin, each up to the line where its braces close."""
    lines, found, k = source.split("\n"), [], 0
    bare = _QUOTED.sub(lambda m: "\n" * m[0].count("\n"), source).split("\n")
    patterns = {kind: re.compile(pattern) for kind, pattern in _STARTS[language].items()}
    while k < len(lines):
        kind, m = next(((kind, m) for kind, p in patterns.items() if (m := p.match(lines[k]))), (None, None))
        if not m:
            k += 1
            continue
        depth, end, opened = 0, k, False
        for end in range(k, len(lines)):
            depth += bare[end].count("{") - bare[end].count("}")
            opened = opened or "{" in bare[end]
            if depth <= 0 and (opened or bare[end].rstrip().endswith(";")):
                break
        found.append((kind, m["name"] or None, k, end))
        k = end + 1
    return found


def syntax_chunks(source: str, language: str) -> list[tuple[str, str | None, int, str]]:
    """(type, name, first line, whole lines) of definitions of 30 characters or more; none where the source does not parse."""
    try:
        spans = python_chunks(source) if language == "python" else declared_chunks(source, language)
    except (KeyError, SyntaxError, ValueError, RecursionError):
        return []
    lines = source.split("\n")
    texts = [(kind, name, first, "\n".join(lines[first : last + 1])) for kind, name, first, last in spans]
    return [t for t in texts if len(t[3].strip()) >= SHORTEST]


def _definitions(content: pd.Series, language: pd.Series) -> pd.Series:
    def one(source: str | None, lang: str | None) -> list[dict]:
        found = syntax_chunks(source, lang) if source and lang else []
        return [{"chunk_type": kind, "chunk": text, "metadata": json.dumps({"name": name, "start_line": first})} for kind, name, first, text in found]

    return pd.Series([one(c, k) for c, k in zip(content, language, strict=True)])


def chunk_files(files: DataFrame, chunk_size: int = 400, overlap: int = 50) -> DataFrame:
    """Definitions of files in a parsed language; files without any, and all others, in sliding windows.

    Every file is parsed once, and nothing is shuffled: a file's rows are its definitions or its windows.
    """
    window, step = 4 * chunk_size, 4 * (chunk_size - overlap)
    parsed = paths.suffix(F.col("file_path")).isin(*LANGUAGES)
    language = paths.detect_language(F.col("file_path"), F.col("language") if "language" in files.columns else None)
    found = files.select("repo_name", "file_path", "content", F.pandas_udf(_definitions, _OUT)(F.when(parsed, F.col("content")), F.when(parsed, language)).alias("_found"))
    count = F.when(F.size("_found") > 0, F.size("_found")).otherwise(F.ceil(F.length("content") / step).cast("int"))
    rows = found.select("*", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("chunk_index"))
    rows = chunk.cut_windows(rows.withColumn("start", F.col("chunk_index") * step).withColumn("_own", F.get("_found", F.col("chunk_index"))), window)
    own = F.size("_found") > 0
    return rows.select(
        "repo_name", "file_path", "chunk_index", F.when(own, F.col("_own.chunk_type")).otherwise("text").alias("chunk_type"),
        F.when(own, F.col("_own.chunk")).otherwise(F.col("chunk")).alias("chunk"), F.when(own, F.col("_own.metadata")).otherwise(chunk.text_metadata()).alias("metadata"),
    )
