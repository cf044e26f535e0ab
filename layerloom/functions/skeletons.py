"""API skeletons of source files: what a file declares, without bodies.

Python is parsed by its own grammar. The brace languages go through a tolerant scanner that knows strings, comments
and nesting and yields statements, going from one sign that matters to the next; a language then decides what of a
statement is shown. Files go through ``mapInArrow`` one by one and are given back by the megabyte.
"""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_ENUM = 4000
#: Files up to so many characters are looked up first, since trees hold many equal ones; so many are remembered by a worker.
SMALL, REMEMBERED = 2000, 4096
#: Characters after which rows are given back.
PART = 1 << 20

_STOPS = {q: re.compile(rf"[{q}\\\n]") for q in "\"'"} | {"`": re.compile(r"[`\\]")}
_VERBATIM = {q: re.compile(f"{q}{q}?") for q in "\"'`"}
_CHARACTER = re.compile(r"'(\\.|[^'\\\n])[^'\n]*'")
_BRACES = re.compile(r"""[{}/"'`]""")
#: What a statement's end, nesting or a comment may begin with: with ';' only, and with line ends.
_SIGNS = (re.compile(r"""[/"'`#(\[)\]{;]"""), re.compile(r"""[/"'`(\[)\]{;\n]"""))
_OPEN = ("=", "from", "import", "export", ":", "|", "&", "<")
_MODULE, _FROM, _TAIL = re.compile(r"(import|export)\b[^{]*$"), re.compile(r"\s*from\b"), re.compile(r"\s*(=[^;]*;|;)")
_UNENDED, _GOES_ON = ("=", ",", "|", "&", "+", ":", "?", ".", "<", "(", "=>"), re.compile(r"\s*([|&?:.]|=>|\{)")


@dataclass
class Statement:
    head: str
    body: str | None
    docs: list[str] = field(default_factory=list)
    tail: str = ""


def _string_end(src: str, i: int, verbatim: bool = False) -> int:
    quote, i = src[i], i + 1
    stop = (_VERBATIM if verbatim else _STOPS)[quote]
    while m := stop.search(src, i):
        if m[0] == quote:
            return m.end()
        if m[0] == "\n":
            return m.start()
        i = m.start() + 2
    return max(i, len(src))


def _skip(src: str, i: int) -> int:
    """Where a comment or string that starts at i ends; i if none does."""
    if src[i] == "/":
        if src.startswith("//", i):
            return (src.find("\n", i) + 1 or len(src) + 1) - 1
        if src.startswith("/*", i):
            return (src.find("*/", i + 2) + 2) if src.find("*/", i + 2) >= 0 else len(src)
    elif src[i] in "\"`" or src[i] == "'" and _CHARACTER.match(src, i, i + 200):
        return _string_end(src, i, src[max(0, i - 2) : i] in ("@", "$@", "@$") or src[max(0, i - 1) : i] == "@")
    return i


def _close(src: str, i: int) -> int:
    """The position after the brace that closes the one at i."""
    depth = 0
    while m := _BRACES.search(src, i):
        i = m.start()
        if (j := _skip(src, i)) > i:
            i = j
            continue
        depth += (src[i] == "{") - (src[i] == "}")
        i += 1
        if not depth:
            return i
    return max(i, len(src))


def statements(src: str, line_ends: bool = False) -> list[Statement]:
    """The statements of one nesting level. line_ends: a line end may end a statement too (for languages without ';')."""
    out: list[Statement] = []
    head, docs, i, depth, n = [], [], 0, 0, len(src)
    last, gap, signs = "", False, _SIGNS[line_ends]  # last: of the head, the last two characters that are not white space at its end

    def add(part: str) -> None:
        nonlocal last, gap
        head.append(part)
        if bare := part[-80:].rstrip() or part.rstrip():
            last = (last + " " * gap + bare)[-2:]
            gap = part[-1].isspace()
        else:
            gap = True

    def end(body: str | None, tail: str = "") -> None:
        nonlocal head, docs, last, gap
        text = "".join(head).strip()
        if text or body is not None:
            out.append(Statement(text, body, docs, tail))
        head, docs, last, gap = [], [], "", False

    while i < n:
        m = signs.search(src, i)
        j = m.start() if m else n
        if j > i:
            add(src[i:j])
            if (i := j) == n:
                break
        c = src[i]
        if c in "/\"'`" and (j := _skip(src, i)) > i:
            part = src[i:j]
            if part.startswith("///") and not last:
                docs.append(part.strip())
            elif part[0] in "\"'`":
                add(part)
            i = j
            continue
        if c == "#" and not last:
            j = src.find("\n", i)
            j = n if j < 0 else j
            add(src[i:j])
            i = j
            end(None)
            continue
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if depth <= 0 and c == "{":
            text = "".join(head).strip()
            j = _close(src, i)
            if line_ends and text.endswith(_OPEN) or _MODULE.match(text) and _FROM.match(src, j):
                add(src[i:j])
                i = j
                continue
            body, i = src[i + 1 : j - 1], j
            rest = _TAIL.match(src, i)
            i = rest.end() if rest else i
            end(body, rest[1] if rest else "")
            depth = 0
            continue
        if depth <= 0 and (c == ";" or c == "\n" and last and not last.endswith(_UNENDED) and not _GOES_ON.match(src, i)):
            end(None)
            i += 1
            depth = 0
            continue
        add(c)
        i += 1
    end(None)
    return out


def _flat(text: str) -> str:
    return " ".join(text.split())


def _indent(lines: list[str]) -> list[str]:
    return ["    " + x for x in lines]


# Python

_LINES = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\Z")


def python_skeleton(src: str) -> str:
    """Imports, __all__, annotated constants, and public classes and functions with decorators and first doc lines."""
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError):
        return ""

    lines = [x.encode() for x in _LINES.findall(src)]

    def text(node: ast.AST) -> str:
        """What ast.get_source_segment gives, with lines that are split once for all nodes."""
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return lines[a][node.col_offset : node.end_col_offset].decode()
        return b"".join([lines[a][node.col_offset :], *lines[a + 1 : b], lines[b][: node.end_col_offset]]).decode()

    def plain(node: ast.AST) -> str:
        return node.id if isinstance(node, ast.Name) else ast.unparse(node)

    def private(name: str) -> bool:
        return name.startswith("_") and not (name.startswith("__") and name.endswith("__"))

    def doc(node) -> list[str]:
        line = (ast.get_docstring(node) or "").strip().split("\n")[0]
        return [f'    """{line}"""'] if line else []

    def function(node) -> list[str]:
        returns = f" -> {plain(node.returns)}" if node.returns else ""
        word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        return [f"@{text(d)}" for d in node.decorator_list] + [f"{word} {node.name}({ast.unparse(node.args)}){returns}: ..."]

    out: list[str] = []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out.append(text(node))
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            out.append(text(node))
        elif isinstance(node, ast.AnnAssign) and node.value is not None and isinstance(node.target, ast.Name) and not private(node.target.id):
            out.append(text(node))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not private(node.name):
            out += function(node) + doc(node)
        elif isinstance(node, ast.ClassDef) and not private(node.name):
            bases = ", ".join(map(plain, [*node.bases, *node.keywords]))
            out += [f"@{text(d)}" for d in node.decorator_list] + [f"class {node.name}({bases}):" if bases else f"class {node.name}:"] + doc(node)
            inner: list[str] = []
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and not private(x.name):
                    inner += function(x)
                elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and not private(x.target.id):
                    inner.append(text(x))
            out += _indent(inner or ([] if doc(node) else ["..."]))
    return "\n".join(out)


# C#

_MODIFIERS = "public|private|protected|internal|static|abstract|sealed|partial|readonly|virtual|override|async|extern|unsafe|new|const|volatile|ref|required"
_LEADING = re.compile(rf"(?:(?:{_MODIFIERS}|delegate|event)\s+)*")
_TYPE = re.compile(rf"^(?:(?:{_MODIFIERS})\s+)*(class|struct|interface|enum|record(?:\s+(?:class|struct))?)\b")


def _attributes(head: str) -> tuple[list[str], str]:
    found = []
    while head.startswith("["):
        depth = 0
        for i, c in enumerate(head):
            depth += (c == "[") - (c == "]")
            if not depth:
                break
        found.append(_flat(head[: i + 1]))
        head = head[i + 1 :].lstrip()
    return found, head


def visible(modifiers: set[str], in_type: bool, in_interface: bool = False) -> bool:
    """Members need public, protected or internal (private protected too); types of a namespace need not be private."""
    if in_interface:
        return True
    shown = bool(modifiers & {"public", "protected", "internal"})
    return shown or not in_type and "private" not in modifiers


def csharp_skeleton(src: str) -> str:
    return "\n".join(_csharp(src, False, False))


def _csharp(src: str, in_type: bool, in_interface: bool) -> list[str]:
    out: list[str] = []
    for s in statements(src):
        if s.head.startswith("#"):
            continue
        attributes, head = _attributes(s.head)
        head = _flat(head)
        if re.match(r"(global\s+)?using\b", head) and s.body is None and not in_type:
            out.append(head + ";")
            continue
        if m := re.match(r"namespace\s+[\w.]+", head):
            out += [m[0] + ";"] if s.body is None else [m[0] + " {", *_indent(_csharp(s.body, False, False)), "}"]
            continue
        words = set(re.findall(r"\w+", re.split(r"[({=:<]", head)[0]))
        kind = _TYPE.match(head)
        if not visible(words & {"public", "private", "protected", "internal"}, in_type, in_interface) or not in_type and not kind and "delegate" not in words:
            continue
        shown: list[str]
        if kind and kind[1] == "enum":
            text = f"{head} {{{s.body or ''}}}"
            shown = [text if len(text) <= MAX_ENUM else text[:MAX_ENUM] + " /* ... */ }"]
        elif kind:
            shown = [head + ";"] if s.body is None else [head + " {", *_indent(_csharp(s.body, True, kind[1] == "interface")), "}"]
        else:
            shown = [_csharp_member(head, s.body)]
        out += s.docs + attributes + shown
    return out


def _csharp_member(head: str, body: str | None) -> str:
    arrow = re.split(r"\s*=>\s*", head, maxsplit=1)
    call = re.search(r"\(", arrow[0])
    words = _LEADING.match(head)[0].split()
    if "event" in words:
        return arrow[0] + ";"
    if call and not re.search(r"=", arrow[0][: call.start()]) or "delegate" in words or "operator" in arrow[0]:
        return re.sub(r"\)\s*:\s*(?:base|this)\s*\(.*$", ")", arrow[0]) + ";"
    if body is not None:
        kept = [_flat(re.sub(r"=>.*$", "", x.head)) for x in statements(body)]
        kept = [x for x in kept if re.search(r"\b(get|set|init|add|remove)$", x)]
        return f"{head} {{ {' '.join(x + ';' for x in kept)} }}"
    if len(arrow) == 2 and "=" not in arrow[0]:
        return arrow[0] + " { get; }"
    return re.sub(r"\s*=(?!=|>).*$", "", head) + ";"


# C++


def cpp_skeleton(src: str) -> str:
    """Headers: quoted includes, namespaces, public parts of types, enums, declarations, signatures, aliases."""
    return "\n".join(_cpp(src, True))


def _cpp(src: str, shown: bool, in_class: bool = False) -> list[str]:
    out: list[str] = []
    for s in statements(src):
        head = s.head
        while in_class and (m := re.match(r"(public|protected|private)\s*:\s*", head)):
            shown = m[1] == "public"
            if m[1] != "private":
                out.append(m[1] + ":")
            head = head[m.end() :]
        head = _flat(head)
        if head.startswith("#"):
            if re.match(r'#\s*include\s*"', head):
                out.append(head)
            continue
        if not shown or not head:
            continue
        bare = re.sub(r"^template\s*<.*?>\s*(?=\w)", "", head)
        if m := re.match(r"(?:inline\s+)?namespace\b[\w:\s]*$", head):
            out += [head + " {", *_cpp(s.body or "", True), "}"]
        elif re.match(r"enum\b", bare):
            text = f"{head} {{{_flat(s.body or '')}}};" if s.body is not None else head + ";"
            out.append(text if len(text) <= MAX_ENUM else text[:MAX_ENUM] + " /* ... */ };")
        elif (m := re.match(r"(class|struct|union)\b", bare)) and s.body is not None:
            out += [head + " {", *_indent(_cpp(s.body, m[1] != "class", True)), "};"]
        elif re.match(r"(class|struct|union)\b", bare) or re.match(r"(typedef|using)\b", bare):
            out.append(head + ";")
        elif "(" in head:
            sig = re.split(r"\)\s*:\s*(?!:)", head)[0]
            sig = sig if sig == head else sig + ")"
            if s.body is None or re.match(r"[\w:<>,&*\s\[\]~]+[\s*&][\w:~]+\s*\(", bare):
                out.append(sig + ";")
    return out


def cpp_supplement(src: str) -> str:
    """Implementation files beside a header: quoted includes, free functions, contents of namespaces, types, templates."""
    includes, rest = [], []
    for s in statements(src):
        head = _flat(s.head)
        if head.startswith("#"):
            if re.match(r'#\s*include\s*"', head):
                includes.append(head)
        elif re.match(r"(?:inline\s+)?namespace\b", head):
            inner = cpp_supplement(s.body or "").split("\n")
            inner = [x for x in inner if x]
            rest += inner if re.match(r"(?:inline\s+)?namespace\s*$", head) else ([head + " {", *inner, "}"] if inner else [])
        elif s.body is not None and "(" in head and "::" in head.split("(", 1)[0]:
            continue  # a member function; its declaration is in the header
        else:
            rest += _cpp(s.head + (" {" + s.body + "}" if s.body is not None else "") + ";", True)
    return "\n".join(includes + rest)


# TypeScript and JavaScript


def ts_skeleton(src: str) -> str:
    return "\n".join(_ts(src))


def _ts(src: str) -> list[str]:
    out: list[str] = []
    for s in statements(src, line_ends=True):
        head = _flat(s.head)
        bare = re.sub(r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?", "", head)
        prefix = head[: len(head) - len(bare)]
        if head.startswith("import") or re.match(r"export\s*(\*|\{|type\s*\{)", head):
            out.append(head.rstrip(";") + ";")
        elif re.match(r"(abstract\s+)?class\b", bare):
            out += [head + " {", *_indent(_ts_members(s.body or "")), "}"]
        elif re.match(r"(interface|(const\s+)?enum|namespace|module)\b", bare):
            out.append(f"{head} {{{_flat(s.body or '')}}}")
        elif re.match(r"type\b", bare):
            out.append(head.rstrip(";") + (f" {{{_flat(s.body)}}}" if s.body is not None else "") + ";")
        elif re.match(r"(async\s+)?function\b", bare):
            out.append(head.rstrip(";") + ";")
        elif m := re.match(r"(const|let|var)\s+(\w+)", bare):
            if "=>" in head:
                out.append(head[: head.index("=>")] + "=> ...;")
            elif re.match(r"(?:const|let|var)\s+\w+\s*:", bare):
                out.append(re.sub(r"\s*=(?!>).*$", "", head) + ";")
            elif prefix:
                out.append(f"{prefix}{m[1]} {m[2]};")
    return out


def _ts_members(body: str) -> list[str]:
    out = []
    for s in statements(body, line_ends=True):
        head = _flat(s.head).rstrip(";,")
        name = re.sub(r"^(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set)\s+|@\w+(?:\([^)]*\))?\s*)*", "", head)
        if re.search(r"(^|\s)private\s", head) or name.startswith(("_", "#")) or not re.match(r"[\w\[]", name):
            continue
        out.append(re.sub(r"\s*=(?!>).*$", "", head) + ";" if "(" not in head else head.split("=>")[0].strip() + ";")
    return out


#: Suffix to extractor and language; further languages are added here.
EXTRACTORS: dict[str, tuple[Callable[[str], str], str]] = {
    **{e: (python_skeleton, "python") for e in (".py", ".pyi")},
    ".cs": (csharp_skeleton, "csharp"),
    **{e: (cpp_skeleton, "cpp") for e in (".h", ".hpp", ".hxx", ".cpp", ".cc", ".cxx", ".c")},
    **{e: (ts_skeleton, "typescript") for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")},
}


@functools.lru_cache(REMEMBERED)
def _remembered(extractor: Callable[[str], str], src: str) -> str:
    return extractor(src)


def extract(files: DataFrame, supplementary: str | None = None) -> DataFrame:
    """(component, rel, language, skeleton, tokens, is_supplementary) of files (component, rel, content); empty ones are left out.

    supplementary: a boolean column that marks implementation files whose header is in the component. Files are read in
    as many tasks as they come in."""
    columns = ["component", "rel", "content"] + ([supplementary] if supplementary else [])
    schema = pa.schema([(x, pa.string()) for x in ("component", "rel", "language", "skeleton")] + [("tokens", pa.int64()), ("is_supplementary", pa.bool_())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            marks = batch.column(3).to_pylist() if supplementary else [False] * batch.num_rows
            for component, rel, content, mark in zip(*(batch.column(k).to_pylist() for k in range(3)), marks):
                found = EXTRACTORS.get("." + rel.rsplit(".", 1)[-1].lower()) if rel and "." in rel else None
                if found is None:
                    continue
                beside, src = bool(mark), content or ""
                extractor = cpp_supplement if beside and found[1] == "cpp" else found[0]
                text = _remembered(extractor, src) if len(src) <= SMALL else extractor(src)
                tokens = max(1, len(text) // 4)
                if text.strip() and (not beside or tokens > 50):
                    rows.append((component, rel, found[1], text, tokens, beside))
                    held += len(text)
                if held > PART:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return files.select(*columns).mapInArrow(part, "component string, rel string, language string, skeleton string, tokens long, is_supplementary boolean")
