"""Rules for generated code: a static scan of its syntax tree and text, and the custody rule."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Modules that code may import, modules that no import line may name, and what no line may hold.
ALLOWED_MODULES = """
csv json xml re io collections itertools functools datetime time math statistics decimal hashlib hmac base64 binascii textwrap string
difflib unicodedata struct zipfile gzip bz2 lzma tarfile pathlib fnmatch glob tempfile dataclasses enum typing copy pprint heapq bisect
array queue uuid random secrets logging warnings contextlib abc operator sqlite3 pandas numpy openpyxl docx bs4 lxml PIL pytesseract
pdfplumber pypdf chardet chardet2 python_dateutil dateutil
""".split()
NO_IMPORT = "os subprocess socket requests urllib httpx ctypes pickle marshal multiprocessing threading sys".split()
NO_FROM = "os subprocess socket requests urllib httpx sys ctypes".split()
BLOCKED_CALLS = "eval exec compile __import__ globals locals getattr setattr delattr input breakpoint".split()
BLOCKED_DOTTED = """
shutil.rmtree shutil.move shutil.chown pty.spawn pty.fork signal.signal signal.alarm builtins.eval builtins.exec code.InteractiveConsole
code.InteractiveInterpreter pickle.loads pickle.load marshal.loads marshal.load webbrowser.open
""".split()
BLOCKED_ROOTS = """
os subprocess socket requests urllib httpx ftplib telnetlib smtplib poplib imaplib paramiko fabric invoke ctypes cffi mmap multiprocessing threading sys
""".split()
READ_MODES = ("r", "rb", "rt")
BLOCKED_METHODS = "write_text write_bytes mkdir unlink rename replace touch rmdir symlink_to hardlink_to chmod chown".split()
DANGEROUS = {
    "write_mode": r"""open\s*\([^)]*['"][wax]\+?b?['"]""",
    "environment": r"os\.environ",
    "system_path": r"""['"](?:/etc|/proc|/sys|/root|/dev)/""",
    "path_traversal": r"""['"]\.\.""",
    "home_credentials": r"""['"~].*?\.(ssh|gnupg|aws|kube|docker)/""",
    "private_key": r"""(?:id_rsa|id_dsa|id_ecdsa|id_ed25519|\.pem['"])""",
    "dotenv": r"""['"][^'"]*/?\.env['"]""",
    "dict_mutation": r"__dict__\s*\[",
}
EVIDENCE = r"(?i)bukti|evidence|parse|ekstrak|extract|analisis|analyze|log|dump|file|dokumen|scan|baca"
#: Names of the functions that a scaffold defines.
SCAFFOLD_MARKS = ("def _sha256(", "def _custody_open(")


def _mode(call: ast.Call) -> str | None:
    """What is wrong with the mode of an ``open``: another than for reading, or one that is not written out."""
    given = call.args[1] if len(call.args) > 1 else next((k.value for k in call.keywords if k.arg == "mode"), None)
    if given is None:
        return None
    written_out = isinstance(given, ast.Constant) and isinstance(given.value, str)
    return None if written_out and given.value in READ_MODES else f"mode:{given.value if written_out else '?'}"


def _labels(node: ast.AST) -> list[str | None]:
    match node:
        case ast.Import(names=names):
            roots = [n.name.split(".")[0] for n in names]
            return [f"module:{r}" for r in roots if r not in ALLOWED_MODULES]
        case ast.ImportFrom(module=module):
            root = (module or "").split(".")[0]
            return [] if root in ALLOWED_MODULES else [f"module:{root}"]
        case ast.Call(func=ast.Name(id="open")):
            return [_mode(node)]
        case ast.Call(func=ast.Name(id=name)) if name in BLOCKED_CALLS:
            return [f"call:{name}"]
        case ast.Call(func=ast.Attribute(attr=method) as f):
            whole = ast.unparse(f)
            return [f"call:{whole}"] if whole in BLOCKED_DOTTED else [f"method:{method}"] if method in BLOCKED_METHODS else []
        case ast.Attribute(value=ast.Name(id=root), attr=name) if root in BLOCKED_ROOTS:
            return [f"attribute:{root}.{name}"]
    return []


def of_tree(code: str | None) -> list[str]:
    """What the syntax tree of a piece of code violates; ``syntax`` alone if it has none."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ["syntax"]
    return sorted({label for node in ast.walk(tree) for label in _labels(node) if label})


@F.pandas_udf(ArrayType(StringType()))
def tree_violations(code: pd.Series) -> pd.Series:
    return code.map(of_tree, na_action=None)


def _barred(words: list[str], after: str, code: Column) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(code, F.lit(rf"(?i){after}\s+({'|'.join(words)})\b"), 1)), lambda m: F.concat(F.lit("import:"), F.lower(m)))


def violations(code: Column) -> Column:
    """Sorted names of what a piece of code violates; an empty one is ``empty``, one that does not parse ``syntax``.

    By the syntax tree: modules outside the allowed ones (``module:x``), barred calls
    (``call:x``), methods (``method:x``) and attributes of modules (``attribute:m.x``), and files opened for
    more than reading (``mode:x``, ``mode:?`` if that can't be told). By the text, as a second layer: import lines that name a
    barred module (``import:x``), and dangerous texts, wherever they stand.
    """
    body = F.coalesce(code, F.lit(""))
    texts = F.array_compact(F.array(*[F.when(body.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in DANGEROUS.items()]))
    tree = tree_violations(body)
    found = F.array_sort(F.array_distinct(F.concat(tree, _barred(NO_IMPORT, "import", body), _barred(NO_FROM, "from", body), texts)))
    return F.when(F.trim(F.regexp_replace(body, r"\s+", " ")) == "", F.array(F.lit("empty"))).when(F.array_contains(tree, "syntax"), F.array(F.lit("syntax"))).otherwise(found)


def unhashed_open(code: Column) -> Column:
    """A warning: files are opened and no SHA-256 is taken."""
    return F.coalesce(code.rlike(r"open\s*\(") & ~F.contains(code, F.lit("sha256")), F.lit(False))


def needs_custody(code: Column, description: Column) -> Column:
    """Whether code or its description speaks of evidence."""
    return F.concat_ws("\n", description, code).rlike(EVIDENCE)


def with_custody(code: Column, description: Column, scaffold: Column) -> Column:
    """Code led by the scaffold, where evidence is touched and the scaffold is not there yet."""
    there = F.contains(code, F.lit(SCAFFOLD_MARKS[0])) | F.contains(code, F.lit(SCAFFOLD_MARKS[1]))
    return F.when(needs_custody(code, description) & ~there, F.concat(scaffold, F.lit("\n\n"), code)).otherwise(code)
