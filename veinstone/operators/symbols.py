"""Symbols of source code, by a table function: Python through ``ast``, Rust through a scanner."""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.address import cid

Symbol = tuple[str, str, int, int, str | None]

SKIPPED_DIRS = ("target", "node_modules", "__pycache__")


def detect_language(path: str) -> str | None:
    return {"rs": "rust", "py": "python"}.get(path.rpartition(".")[2])


#: What goes on with the statement before it.
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")


def _statements(lines: list[str]) -> list[tuple[int, int]]:
    """Where the statements of the least indented level start and end; decorators belong to what they decorate."""
    indents = [len(x) - len(x.lstrip()) if x.strip() and not x.lstrip().startswith("#") else None for x in lines]
    level = min((i for i in indents if i is not None), default=0)
    starts, decorated = [], False
    for at, (x, i) in enumerate(zip(lines, indents, strict=True)):
        if i == level and not (starts and _GOES_ON.match(x.lstrip())):
            if not decorated:
                starts.append(at)
            decorated = x.lstrip().startswith("@")
    return list(zip(starts, [*starts[1:], len(lines)], strict=True))


def _parsed(lines: list[str]) -> ast.Module | None:
    try:
        return ast.parse(textwrap.dedent("\n".join(lines)))
    except (SyntaxError, ValueError, RecursionError):
        return None


def _named(node: ast.AST, text: str, parent: str | None) -> tuple[str, str] | None:
    if isinstance(node, ast.Import | ast.ImportFrom):
        return (ast.get_source_segment(text, node) or ast.unparse(node)), "import"
    if isinstance(node, ast.ClassDef):
        return node.name, "class"
    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
        return node.name, "method" if parent is not None else "function"
    return None


def language_of(path: Column) -> Column:
    tail = F.regexp_extract(path, r"\.([^.]+)$", 1)
    return F.when(tail == "py", "python").when(tail == "rs", "rust")


def python_symbols(source: str) -> Iterator[Symbol]:
    """Imports by their text, classes, functions; a function inside any symbol is a method.

    What doesn't parse is taken apart: into its statements, a statement into its head and body, and
    where the head is what is damaged, its first line is left out.  So only damaged lines are lost.
    """
    todo = [(source.replace("\0", " ").split("\n"), 0, None)]
    while todo:
        lines, offset, parent = todo.pop()
        if not any(x.strip() for x in lines):
            continue
        if (tree := _parsed(lines)) is not None:
            yield from _visited(tree, textwrap.dedent("\n".join(lines)), offset, parent)
            continue
        parts = _statements(lines)
        if len(parts) > 1:
            todo += [(lines[a:b], offset + a, parent) for a, b in reversed(parts)]
            continue
        head = next((i for i, x in enumerate(lines) if x.split("#")[0].rstrip().endswith(":")), None)
        opened = None if head is None or head + 1 == len(lines) else _parsed([*lines[:head], lines[head].split("#")[0].rstrip() + " pass"])
        if opened is None or len(opened.body) != 1:
            first = parts[0][0] if parts else 0
            todo.append((lines[first + 1 :], offset + first + 1, parent))
            continue
        if named := _named(opened.body[0], "", parent):
            end = max(i for i, x in enumerate(lines, 1) if x.strip())
            yield (*named, offset + opened.body[0].lineno, offset + end, parent)
            parent = named[0]
        todo.append((lines[head + 1 :], offset + head + 1, parent))


def _visited(tree: ast.AST, text: str, offset: int, parent: str | None) -> Iterator[Symbol]:
    """Symbols of a tree, each before what is inside it."""
    todo = [(child, parent) for child in reversed(list(ast.iter_child_nodes(tree)))]
    while todo:
        node, around = todo.pop()
        if named := _named(node, text, around):
            yield (*named, offset + node.lineno, offset + node.end_lineno, around)
            around = named[0]
        todo += [(child, around) for child in reversed(list(ast.iter_child_nodes(node)))]


_RUST_NOISE = re.compile(r'//[^\n]*|/\*|"(?:\\.|[^"\\])*"|r(#*)"|b?\'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\\'\n])\'', re.S)
_RUST_ITEM = re.compile(r"\b(?:(fn|struct|enum|trait|mod|const|static)\s+(?:mut\s+)?(r#\w+|\w+)|(impl)\b)")
_RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "constant", "static": "constant"}


def _blanked(source: str) -> str:
    """The source with comments and literals as spaces, lines kept."""
    out, at = [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while m := _RUST_NOISE.search(source, at):
        out.append(source[at : m.start()])
        end = m.end()
        if m.group() == "/*":
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(source, end)):
                depth += 1 if n.group() == "/*" else -1
                end = n.end()
            if depth:
                end = len(source)
        elif m.group(1) is not None:
            close = source.find('"' + m.group(1), end)
            end = len(source) if close < 0 else close + 1 + len(m.group(1))
        out.append(blank(source[m.start() : end]))
        at = end
    return "".join(out) + source[at:]


def _close(code: str, at: int) -> tuple[int, bool]:
    """End of the item that goes on at ``at``: after its braces or semicolon; whether it has braces."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{":
            if c == "{" and depth == 0:
                level = 0
                for j in range(i, len(code)):
                    level += (code[j] == "{") - (code[j] == "}")
                    if not level:
                        return j + 1, True
                return len(code), True
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ";" and depth == 0:
            return i + 1, False
    return len(code), False


def rust_symbols(source: str) -> Iterator[Symbol]:
    """Functions (methods too), structs, enums, traits, impls by their type, modules, constants and
    statics; signatures without a body are left out."""
    code, inside = _blanked(source), []
    line = lambda i: code.count("\n", 0, i) + 1
    at = 0
    while m := _RUST_ITEM.search(code, at):
        at = m.end()
        word, name = m.group(1), m.group(2)
        if word == "const" and name in ("fn", "unsafe", "async", "extern"):
            at = m.start(2)
            continue
        if m.group(3):
            head = code[m.end() : (brace := code.find("{", m.end()))] if code.find("{", m.end()) >= 0 else ""
            if not head or ";" in head:
                continue
            if head.lstrip().startswith("<"):  # its own parameters
                level, k = 0, head.index("<")
                while k < len(head):
                    level += (head[k] == "<") - (head[k] == ">" and head[k - 1] != "-")
                    k += 1
                    if not level:
                        break
                head = head[k:]
            head = re.split(r"\bwhere\b", head)[0]
            name, kind, end = re.split(r"\bfor\b(?!\s*<)", head)[-1].strip(), "impl", _close(code, brace)[0]
        else:
            kind = _RUST_KINDS[word]
            if word == "const" and name == "_" or (word == "fn" and not re.match(r"\s*[<(]", code[m.end() :])):
                continue
            end, body = _close(code, m.end())
            if word in ("const", "static"):
                end = _semicolon(code, m.end())
            elif word == "fn" and not body:
                continue
        while inside and inside[-1][1] <= m.start():
            inside.pop()
        start = m.start()
        before = re.search(r"(?:\b(?:pub(?:\s*\([^)]*\))?|unsafe|async|const|extern(?:\s+\"[^\"]*\")?|default)\s+)+$", code[max(0, start - 80) : start])
        first = start - len(before.group()) if before else start
        yield (name, kind, line(first), line(max(first, end - 1)), inside[-1][0] if inside else None)
        inside.append((name, end))
        if word in ("const", "static"):
            inside.pop()
            at = max(at, end)


def _semicolon(code: str, at: int) -> int:
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] in "([{") - (code[i] in ")]}")
        if code[i] == ";" and depth == 0:
            return i + 1
    return len(code)


def symbols(source: str | None, language: str | None) -> Iterator[Symbol]:
    if source is not None:
        yield from {"python": python_symbols, "rust": rust_symbols}.get(language or "", lambda _: iter(()))(source)


@udtf(returnType=T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("parent", T.StringType())]), useArrow=True)
class Symbols:
    """``LATERAL symbols(source, language)``."""

    def eval(self, source: str, language: str):
        yield from symbols(source, language)


def extract(files: DataFrame) -> DataFrame:
    """``file_path, file_cid, name, kind, start_line, end_line, parent_symbol`` of
    files(file_path, file_cid, source); the language comes from the path."""
    spark = files.sparkSession
    spark.udtf.register("veinstone_symbols", Symbols)
    files.withColumn("language", language_of(F.col("file_path"))).where("language IS NOT NULL").createOrReplaceTempView("veinstone_files")
    return spark.sql("SELECT f.file_path, f.file_cid, s.name, s.kind, s.start_line, s.end_line, s.parent AS parent_symbol FROM veinstone_files f, LATERAL veinstone_symbols(f.source, f.language) s")


def query(found: DataFrame, text: str) -> DataFrame:
    """Symbols whose name contains ``text`` in any case."""
    return found.where(F.contains(F.lower("name"), F.lower(F.lit(text))))


def scan_dir(spark, path: str, method: str = "sha256") -> DataFrame:
    """Source files at or under a path, as ``file_path, file_cid, source``; hidden, build and package
    folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,rs}").load(path)
    inner = F.replace("path", F.lit(path), F.lit(""))
    skipped = F.lit(False)
    for d in SKIPPED_DIRS:
        skipped = skipped | F.contains(inner, F.lit(f"/{d}/"))
    return files.where(~skipped & ~inner.rlike(r"/\.[^/]+/")).select(F.col("path").alias("file_path"), cid(F.col("content"), method).alias("file_cid"), F.col("content").cast("string").alias("source"))
