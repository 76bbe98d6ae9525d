"""Rust sources: tokens and functions, by a lexer and a walk over token trees.

The only operator on sources that has no built-in counterpart: one Arrow pass reads each
file once and returns its tokens and functions; all else is DataFrame code on these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_OPS = set("~!@#$%^&*-=+|;:,<.>/?'")
_IDENT = re.compile(r"(?:r#)?[^\W\d]\w*")
_NUMBER = re.compile(r"0[xob][0-9A-Fa-f_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*")
_RAW = re.compile(r'(?:br|cr|r)(#*)"')
_STRING = re.compile(r'(?:b|c)?"(?:[^"\\]|\\.)*"\w*', re.S)
_CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:u\{[0-9A-Fa-f_]+\}|x[0-9A-Fa-f]{2}|.))'\w*")
#: Words that can stand before ``!`` without naming a macro (fixed values).
_NOT_MACROS = {"if", "while", "match", "return", "in", "else", "let", "mut", "ref", "move", "break", "as", "for", "loop", "await"}


class Invalid(Exception):
    """Not a Rust source."""


class Token:
    """kind: ident, punct, literal, or the opening bracket of a group; text: of a punct
    its character; joint: the next character is a punct too; inside: of a group."""

    __slots__ = ("inside", "joint", "kind", "last", "line", "text")

    def __init__(self, kind: str, text: str, line: int, joint: bool = False) -> None:
        self.kind, self.text, self.line, self.last, self.joint = kind, text, line, line, joint
        self.inside: list[Token] = []

    def named(self, *names: str) -> bool:
        return self.kind == "ident" and self.text in names

    def is_punct(self, c: str) -> bool:
        return self.kind == "punct" and self.text == c


def _comment(src: str, at: int) -> int:
    """The end of the comment at a place; block comments nest."""
    if src.startswith("//", at):
        end = src.find("\n", at)
        return len(src) if end < 0 else end
    depth, i = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(src, i):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    raise Invalid("comment")


def _doc(text: str, line: int) -> list[Token] | None:
    """A doc comment as the attribute that it stands for, or None."""
    inner = text[:3] in ("//!", "/*!")
    outer = (text.startswith("///") and not text.startswith("////")) or (text.startswith("/**") and not text.startswith("/***") and len(text) > 4)
    if not inner and not outer:
        return None
    said = text[3:-2] if text.startswith("/*") else text[3:].removesuffix("\r")
    group = Token("[", "[", line)
    quoted = '"' + "".join({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(c, c) for c in said) + '"'
    group.inside = [Token("ident", "doc", line), Token("punct", "=", line), Token("literal", quoted, line)]
    return [Token("punct", "#", line), *([Token("punct", "!", line)] if inner else []), group]


def token_tree(src: str) -> list[Token]:
    """The tokens of a source, groups nested. Raises Invalid."""
    top: list[Token] = []
    stack: list[tuple[Token | None, list[Token]]] = [(None, top)]
    i, line, n = (1 if src.startswith("﻿") else 0), 1, len(src)
    if src.startswith("#!", i) and not re.match(r"#!\s*\[", src[i:]):
        i = max(src.find("\n", i), 0) or n
    while i < n:
        c = src[i]
        if c.isspace():
            line += c == "\n"
            i += 1
            continue
        out = stack[-1][1]
        if src.startswith(("//", "/*"), i):
            end = _comment(src, i)
            out.extend(_doc(src[i:end], line) or [])
        elif c in _OPEN:
            group = Token(c, c, line)
            out.append(group)
            stack.append((group, group.inside))
            end = i + 1
        elif c in _CLOSE:
            group = stack.pop()[0]
            if group is None or _OPEN[group.text] != c:
                raise Invalid("bracket")
            group.last = line
            end = i + 1
        elif (m := _RAW.match(src, i)) and not src.startswith("r#", i) or (m and src.startswith(('r#"', "r##"), i)):
            end = src.find('"' + m[1], m.end())
            if end < 0:
                raise Invalid("string")
            end += 1 + len(m[1])
            out.append(Token("literal", src[i:end], line))
        elif (m := _STRING.match(src, i)) or (m := _CHAR.match(src, i)):
            end = m.end()
            out.append(Token("literal", m[0], line))
        elif c == '"':
            raise Invalid("string")
        elif m := _IDENT.match(src, i):
            end = m.end()
            out.append(Token("ident", m[0], line))
        elif c.isdigit() and (m := _NUMBER.match(src, i)):
            end = m.end()
            out.append(Token("literal", m[0], line))
        elif c in _OPS:
            end = i + 1
            follows = src[end : end + 1]
            joint = follows in _OPS and follows != "" and not src.startswith(("//", "/*"), end)
            out.append(Token("punct", c, line, joint or (c == "'" and bool(_IDENT.match(src, end)))))
        else:
            raise Invalid(c)
        line += src.count("\n", i, end)
        if out and out[-1].kind == "literal":
            out[-1].last = line
        i = end
    if len(stack) != 1:
        raise Invalid("bracket")
    return top


def flat(tree: list[Token]) -> Iterator[tuple[str, int]]:
    """Normalised text and line of each token, depth first."""
    for t in tree:
        if t.kind in _OPEN:
            yield t.text, t.line
            yield from flat(t.inside)
            yield _OPEN[t.text], t.last
        elif t.kind == "punct":
            yield f"punct:{t.text}:{'Joint' if t.joint else 'Alone'}", t.line
        else:
            yield f"{t.kind}:{t.text}", t.line


class _Walk:
    """Cyclomatic complexity and nesting depth of a function's body."""

    def __init__(self, *, bool_ops: bool = False) -> None:
        self.complexity, self.depth, self.deepest, self.bool_ops = 1, 0, 0, bool_ops

    def nested(self, step: int) -> None:
        self.depth += step
        self.deepest = max(self.deepest, self.depth)

    def block(self, t: list[Token], i: int = 0) -> None:
        while i < len(t):
            i = self.one(t, i)

    def one(self, t: list[Token], i: int) -> int:
        """Walk the construct at i; where the next one is."""
        x = t[i]
        after = t[i + 1] if i + 1 < len(t) else None
        if x.named("if"):
            return self.branch(t, i)
        if x.named("while"):
            return self.looped(t, i + 1, None)
        if x.named("for") and after and not after.is_punct("<"):
            return self.looped(t, i + 1, "in")
        if x.named("loop") and after and after.kind == "{":
            return self.looped(t, i + 1, None)
        if x.named("match"):
            return self.match(t, i)
        if (x.named("fn") and after and after.kind == "ident") or x.named("impl", "trait", "mod", "macro_rules"):
            return self.skipped(t, i)
        if x.is_punct("#") and after and after.kind == "[":
            return i + 2
        if x.kind == "ident" and x.text not in _NOT_MACROS and after and after.is_punct("!") and i + 2 < len(t) and t[i + 2].kind in _OPEN and not after.joint:
            return i + 3
        if x.is_punct("?") and i and (t[i - 1].kind in ("ident", "literal", *_OPEN) or t[i - 1].is_punct("?")):
            self.complexity += 1
        if self.bool_ops and i and x.text in "&|" and x.is_punct(x.text) and t[i - 1].is_punct(x.text) and t[i - 1].joint:
            self.complexity += 1
        if x.kind in _OPEN:
            self.block(x.inside)
        return i + 1

    def head(self, t: list[Token], i: int) -> int:
        """Walk a condition up to the brace group that is the body; its place."""
        while i < len(t) and t[i].kind != "{":
            if t[i].named("let"):
                while i < len(t) and not (t[i].is_punct("=") and not (t[i - 1].kind == "punct" and t[i - 1].joint)):
                    i += 1
            elif t[i].named("unsafe", "async") and i + 1 < len(t) and t[i + 1].kind == "{":
                self.block(t[i + 1].inside)
                i += 2
            else:
                i = self.one(t, i)
        if i >= len(t):
            raise Invalid("body")
        return i

    def branch(self, t: list[Token], i: int) -> int:
        self.complexity += 1
        self.nested(1)
        i = self.head(t, i + 1)
        self.block(t[i].inside)
        i += 1
        if i + 1 < len(t) and t[i].named("else"):
            if t[i + 1].named("if"):
                i = self.branch(t, i + 1)
            elif t[i + 1].kind == "{":
                self.block(t[i + 1].inside)
                i += 2
        self.nested(-1)
        return i

    def looped(self, t: list[Token], i: int, until: str | None) -> int:
        self.complexity += 1
        self.nested(1)
        while until and i < len(t) and not t[i].named(until):
            i += 1
        i = self.head(t, i + 1 if until else i)
        self.block(t[i].inside)
        self.nested(-1)
        return i + 1

    def match(self, t: list[Token], i: int) -> int:
        self.complexity += 1
        i = _Walk().head(t, i + 1)  # what is matched is not counted
        arms, k = t[i].inside, 0
        while k < len(arms):
            if arms[k].is_punct(","):
                k += 1
                continue
            while k < len(arms) and not (arms[k].is_punct("=") and arms[k].joint and k + 1 < len(arms) and arms[k + 1].is_punct(">")):
                k += 1  # the pattern and its guard are not counted
            if k >= len(arms):
                raise Invalid("arm")
            self.complexity += 1
            k = self.arm(arms, k + 2)
        return i + 1

    def arm(self, t: list[Token], k: int) -> int:
        """Walk the body of an arm; the end of it."""
        whole = k < len(t) and (t[k].kind == "{" or t[k].named("if", "match", "while", "for", "loop", "unsafe", "async"))
        if whole:
            k = self.one(t, k)
            if t[k - 1].kind == "ident" and k < len(t) and t[k].kind == "{":
                k = self.one(t, k)
            if k >= len(t) or not (t[k].is_punct(".") or t[k].is_punct("?")):
                return k
        while k < len(t) and not t[k].is_punct(","):
            if t[k].is_punct("|") and (t[k - 1].kind == "punct" or t[k - 1].named("move")) and not t[k].joint:
                k += 1  # parameters of a closure
                while k < len(t) and not t[k].is_punct("|"):
                    k += 1
                k += 1
            elif t[k].is_punct("<") and t[k - 1].is_punct(":"):
                k = _angles(t, k)
            else:
                k = self.one(t, k)
        return k

    def skipped(self, t: list[Token], i: int) -> int:
        while i < len(t) and t[i].kind != "{" and not t[i].is_punct(";"):
            i += 1
        return i + 1


def _angles(t: list[Token], i: int) -> int:
    """After the angle brackets that open at i."""
    depth = 0
    while i < len(t):
        if t[i].is_punct("<"):
            depth += 1
        elif t[i].is_punct(">") and not (t[i - 1].kind == "punct" and t[i - 1].text in "-=" and t[i - 1].joint):
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise Invalid("angle")


def _parameters(t: list[Token]) -> int:
    count, i, some = 0, 0, False
    while i < len(t):
        if t[i].is_punct("<"):
            i = _angles(t, i)
            some = True
            continue
        if t[i].is_punct(","):
            count, some = count + some, False
        elif not (t[i].is_punct("#") or (i and t[i - 1].is_punct("#"))):
            some = True
        i += 1
    return count + some


def _items(t: list[Token], found: dict[str, list[dict]], where: str, bool_ops: bool) -> None:
    """Functions among the items of a file or of an impl block."""
    i = 0
    while i < len(t):
        start = t[i]
        while i + 1 < len(t) and t[i].is_punct("#"):  # attributes are part of the item
            inner = t[i + 1].is_punct("!")
            i += 3 if inner else 2
            if inner and i < len(t):
                start = t[i]
        if i >= len(t):
            break
        if t[i].is_punct(";"):
            i += 1
            continue
        if t[i].named("pub", "crate"):
            i += 1
            if i < len(t) and t[i].kind == "(":
                i += 1
        k = i
        while k < len(t) and (t[k].named("const", "async", "unsafe", "extern", "default", "safe") or (t[k].kind == "literal" and t[k - 1].named("extern"))):
            k += 1
        if k + 1 < len(t) and t[k].named("fn") and t[k + 1].kind == "ident":
            name, k = t[k + 1].text, k + 2
            if k < len(t) and t[k].is_punct("<"):
                k = _angles(t, k)
            if k >= len(t) or t[k].kind != "(":
                raise Invalid("fn")
            many = _parameters(t[k].inside)
            while k < len(t) and t[k].kind != "{" and not t[k].is_punct(";"):
                k += 1
            if k >= len(t) or t[k].kind != "{":
                raise Invalid("fn")
            walk = _Walk(bool_ops=bool_ops)
            walk.block(t[k].inside)
            found[where].append({"kind": where, "name": name, "start_line": start.line, "total_lines": t[k].last - start.line + 1, "params": many, "cyclomatic": walk.complexity, "nesting": walk.deepest})
            i = k + 1
        elif k < len(t) and t[k].named("impl") and where == "function":
            while k < len(t) and t[k].kind != "{":
                k += 1
            if k >= len(t):
                raise Invalid("impl")
            _items(t[k].inside, found, "method", bool_ops)
            i = k + 1
        elif k < len(t) and t[k].named("mod", "struct", "enum", "union", "trait", "auto", "macro_rules") or (k > i and k < len(t) and t[k].kind == "{"):
            while k < len(t) and t[k].kind != "{" and not t[k].is_punct(";"):
                k += 1
            if k >= len(t):
                raise Invalid("item")
            i = k + 1
        elif t[i].named("use", "static", "type", "const", "extern", "let") or (t[i].kind == "ident" and i + 1 < len(t) and (t[i + 1].is_punct("!") or t[i + 1].is_punct(":"))):
            if t[i].named("let"):
                raise Invalid("let")
            while i < len(t) and not t[i].is_punct(";") and not (t[i].kind == "{" and t[i - 1].is_punct("!")):
                i += 1
            if i >= len(t):
                raise Invalid("item")
            i += 1
        else:
            raise Invalid("item")


def functions_of(tree: list[Token], *, bool_ops: bool = False) -> list[dict]:
    """Top-level functions, then those of top-level impl blocks. Raises Invalid."""
    found: dict[str, list[dict]] = {"function": [], "method": []}
    _items(tree, found, "function", bool_ops)
    return found["function"] + found["method"]


_TOKENS = pa.list_(pa.struct([("t", pa.string()), ("line", pa.int32())]))
_FUNCTIONS = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), *[(k, pa.int64()) for k in ("start_line", "total_lines", "params", "cyclomatic", "nesting")]]))


def _parse(bool_ops: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                tokens, functions = [], []
                for src in part.column(1).to_pylist():
                    try:
                        tree = token_tree(src or "")
                        tokens.append([{"t": t, "line": n} for t, n in flat(tree)])
                    except (Invalid, RecursionError):
                        tokens.append([])
                        functions.append([])
                        continue
                    try:
                        functions.append(functions_of(tree, bool_ops=bool_ops))
                    except (Invalid, RecursionError):
                        functions.append([])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, _TOKENS), pa.array(functions, _FUNCTIONS)], ["path", "tokens", "functions"])

    return run


def syntax(files: DataFrame, *, bool_ops: bool = False) -> DataFrame:
    """From files (path, content): path, tokens (t, line) and functions, one row a file.

    A source that can't be read as Rust has no tokens, or no functions. Null content is
    an empty source. ``bool_ops`` also counts && and ||.
    """
    schema = "path string, tokens array<struct<t:string,line:int>>, functions array<struct<kind:string,name:string,start_line:bigint,total_lines:bigint,params:bigint,cyclomatic:bigint,nesting:bigint>>"
    return files.select("path", "content").mapInArrow(_parse(bool_ops), schema)


def tokens(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("tokens").alias("pos", "x")).select("path", F.col("pos").cast("long").alias("pos"), F.col("x.t").alias("tok"), F.col("x.line").cast("long").alias("line"))


def functions(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("functions").alias("seq", "f")).select("path", F.col("seq").cast("long").alias("seq"), "f.*")


#: Limits on functions: rule, column, what the message says (fixed values).
RULES = {
    "size:max-lines-per-function": ("total_lines", "Function `%s` has %d lines; maximum allowed is %d"),
    "size:max-parameters-per-function": ("params", "Function `%s` has %d parameters; maximum allowed is %d"),
    "complexity:max-cyclomatic-per-function": ("cyclomatic", "Function `%s` has cyclomatic complexity %d; maximum allowed is %d"),
    "complexity:max-nesting-depth": ("nesting", "Function `%s` has nesting depth %d; maximum allowed is %d"),
}


def violations(found: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row for each function and limit that it goes over (limits by rule; no limit,
    no rows): rule_id, path, line, function, message, actual, threshold, severity."""
    asked = [(r, limits[r]) for r in RULES if limits.get(r) is not None]
    rule = lambda r, most: F.struct(F.lit(r).alias("rule_id"), F.col(RULES[r][0]).alias("actual"), F.lit(most).cast("long").alias("threshold"), F.format_string(RULES[r][1], "name", F.col(RULES[r][0]), F.lit(most)).alias("message"))
    each = found.select("path", "start_line", "name", F.explode(F.array(*[rule(r, m) for r, m in asked])).alias("v")) if asked else found.select("path", "start_line", "name", F.struct(F.lit("").alias("rule_id"), F.lit(0).cast("long").alias("actual"), F.lit(0).cast("long").alias("threshold"), F.lit("").alias("message")).alias("v")).limit(0)
    return each.where("v.actual > v.threshold").select("v.rule_id", "path", F.col("start_line").alias("line"), F.col("name").alias("function"), "v.message", "v.actual", "v.threshold", F.lit("major").alias("severity"))


def summary(found: DataFrame, *, max_cyclomatic: int | None = None) -> DataFrame:
    most = lambda k, name: F.coalesce(F.max(k), F.lit(0)).cast("long").alias(name)
    complex_ = F.count_if(F.col("cyclomatic") > max_cyclomatic) if max_cyclomatic is not None else F.lit(0).cast("long")
    return found.agg(F.count(F.lit(1)).alias("functions"), most("total_lines", "max_lines_per_function"), most("params", "max_parameters_per_function"), most("cyclomatic", "max_cyclomatic_complexity"), most("nesting", "max_nesting_depth"), complex_.alias("complex_functions"))
