"""Dockerfile facts: a small helper reads a file's instructions, stages and references are told apart by joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions.identity import normalized_image
from lodegraph.operators.parsing import fact, failures, per_file
from lodegraph.plans.lineage import cut

#: Build arguments that are there without being declared, empty here.
PLATFORM_ARGS = ("TARGETPLATFORM", "TARGETOS", "TARGETARCH", "TARGETVARIANT", "BUILDPLATFORM", "BUILDOS", "BUILDARCH", "BUILDVARIANT")
#: The instructions that there are, and those that here-documents may follow.
VERBS = ("ADD", "ARG", "CMD", "COPY", "ENTRYPOINT", "ENV", "EXPOSE", "FROM", "HEALTHCHECK", "LABEL", "MAINTAINER", "ONBUILD", "RUN", "SHELL", "STOPSIGNAL", "USER", "VOLUME", "WORKDIR")
HERE_DOCUMENTS = ("ADD", "COPY", "RUN")
FILE_NAME = r"^(Dockerfile|Containerfile|Dockerfile\..*|.*\.Dockerfile)$"

_DIRECTIVE = re.compile(r"^#\s*([A-Za-z][A-Za-z0-9]*)\s*=\s*(.+?)\s*$")
_HERE = re.compile(r"""(?:^|\s)\d*<<(-?)(["']?)([A-Za-z0-9_.]+)\2(?=\s|$)""")
_ARG = re.compile(r"""([A-Za-z_][A-Za-z0-9_]*)(=("[^"]*"|'[^']*'|[^\s"']*))?""")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9@*#?]")


def instructions(content: str) -> list[tuple[int, str, str]]:
    """(line, verb in upper case, rest) of each instruction, its continued lines joined, here-documents left out."""
    lines = [x.rstrip("\r") for x in content.split("\n")]
    escape = "\\"
    for text in lines:
        found = _DIRECTIVE.match(text)
        if not found:
            break
        if found[1].lower() == "escape":
            if found[2] not in ("\\", "`"):
                raise ValueError(f"escape is neither \\ nor `: {found[2]}")
            escape = found[2]
    more = re.compile(rf"(?<!{re.escape(escape)}){re.escape(escape)}[ \t]*$")
    out: list[tuple[int, str, str]] = []
    held, start, at = "", 0, 0
    while at < len(lines):
        text = lines[at]
        at += 1
        last = not any(x.strip() for x in lines[at:]) if more.search(text) else False
        if re.match(r"\s*(#|$)", text):
            continue
        start = start or at
        held += more.sub("", text)
        if more.search(text) and not last:
            continue
        verb, rest = re.match(r"(\S*)\s*(.*)$", held.strip(), re.S).groups()
        out.append((start, verb.upper(), rest))
        held, start = "", 0
        for dash, _, name in _HERE.findall(rest) if verb.upper() in HERE_DOCUMENTS else ():
            while at < len(lines) and (lines[at].lstrip("\t") if dash else lines[at]) != name:
                at += 1
            if at == len(lines):
                raise ValueError(f"unterminated here-document {name}")
            at += 1
    return out


class _Unreadable(ValueError):
    pass


def expand(word: str, args: dict[str, str]) -> str:
    """`word` with $NAME, ${NAME} and the forms :-, -, :+, +, :? and ?, #, ##, %, %%, / and // filled in from `args`, nested ones too, and quotes removed.

    What no argument names is empty. A word that can't be read, or whose ? form fails, stays as it is.
    """
    if "$" not in word:
        return word
    try:
        return _filled(word, 0, "", args)[0]
    except _Unreadable:
        return word


def _filled(word: str, at: int, end: str, args: dict[str, str], pattern: bool = False) -> tuple[str, int]:
    """What stands from `at` up to `end`, filled in, and the place after it; a `pattern` keeps its backslashes."""
    out, quoted = "", False
    while at < len(word):
        c = word[at]
        if c == end and not quoted:
            return out, at + 1
        at += 1
        if c == '"':
            quoted = not quoted
        elif c == "'" and not quoted:
            close = word.find("'", at)
            if close < 0:
                raise _Unreadable
            out, at = out + word[at:close], close + 1
        elif c == "\\" and at < len(word) and pattern:
            out, at = out + c + word[at], at + 1
        elif c == "\\" and at < len(word):
            out, at = out + ("\\" if quoted and word[at] not in '"$\\' else "") + word[at], at + 1
        elif c == "$":
            value, at = _variable(word, at, args)
            out += value
        else:
            out += c
    if end or quoted:
        raise _Unreadable
    return out, at


def _variable(word: str, at: int, args: dict[str, str]) -> tuple[str, int]:
    """The value of what follows a dollar sign, and the place after it."""
    braced = word[at : at + 1] == "{"
    name = _NAME.match(word, at + braced)
    if not name:
        if braced:
            raise _Unreadable
        return "$", at
    value, at = args.get(name[0]), name.end()
    if not braced:
        return value or "", at
    if word[at : at + 1] == "}":
        return value or "", at + 1
    if word[at : at + 1] and word[at] in "#%/":
        return _by_pattern(word, at, value or "", args)
    colon = word[at : at + 1] == ":"
    mark = word[at + colon : at + colon + 1]
    if not mark or mark not in "-+?":
        raise _Unreadable
    other, at = _filled(word, at + colon + 1, "}", args)
    there = bool(value) if colon else value is not None
    if mark == "?" and not there:
        raise _Unreadable
    return (other if there else "") if mark == "+" else value or "" if there else other, at


def _by_pattern(word: str, at: int, value: str, args: dict[str, str]) -> tuple[str, int]:
    """`value` as #, ##, %, %%, / or // at this place makes it, and the place after the closing brace: the shortest or longest beginning or end cut off, or the first or all matches replaced."""
    mark = word[at]
    twice = word[at + 1 : at + 2] == mark
    pattern, at = _filled(word, at + 1 + twice, "/" if mark == "/" else "}", args, pattern=True)
    glob = re.compile("".join(".*" if x == "*" else "." if x == "?" else re.escape(x[-1]) for x in re.findall(r"\\.|.", pattern, re.S)), re.S)
    n = len(value)
    if mark == "/":
        other, at = _filled(word, at, "}", args)
        return glob.sub(lambda m: other, value, count=0 if twice else 1), at
    if mark == "#":
        ends = range(n, -1, -1) if twice else range(n + 1)
        return next((value[k:] for k in ends if glob.fullmatch(value, 0, k)), value), at
    starts = range(n + 1) if twice else range(n, -1, -1)
    return next((value[:k] for k in starts if glob.fullmatch(value, k)), value), at


def references(content: str) -> list[tuple[int, str, str, str]]:
    """(line, what, image, alias) in order: `from` with the stage's name in lower case or empty, `copy` with what it copies from."""
    said = instructions(content)
    if not said:
        raise ValueError("no instructions")
    args = dict.fromkeys(PLATFORM_ARGS, "")
    out: list[tuple[int, str, str, str]] = []
    for line, verb, rest in said:
        if verb not in VERBS:
            raise ValueError(f"line {line}: unknown instruction {verb}")
        if verb == "ARG" and not out:
            for name, given, value in _ARG.findall(rest):
                args[name] = value.strip("\"'") if given else args.get(name, "")
        elif verb == "FROM":
            words = re.sub(r"^(--\S+\s+)+", "", rest).split()
            if not (len(words) == 1 or (len(words) == 3 and words[1].lower() == "as")):
                raise ValueError(f"line {line}: FROM needs an image, or an image AS a name")
            out.append((line, "from", expand(words[0], args), words[2].lower() if len(words) == 3 else ""))
        elif not out and verb != "ARG":
            raise ValueError(f"line {line}: {verb} before FROM")
        elif verb == "COPY":
            flag = re.match(r"(?:--\S+\s+)*?--from=(\S+)", rest)
            if flag:
                out.append((line, "copy", expand(flag[1], args), ""))
    return out


def facts(files: DataFrame) -> DataFrame:
    """Facts of Dockerfiles (root, rel, content), which name the targets, and failures of those that can't be read.

    External base images and copy sources are consumed, named stages and the last one produced.
    """
    rows = cut(per_file(files, references, "line int, what string, image string, alias string"))
    stages = rows.filter("what = 'from'")
    aliases = stages.filter("alias <> ''").select("root", "file", F.col("alias").alias("local")).distinct()
    refs = rows.filter("image <> '' and not image rlike '^[0-9]+$'").withColumn("local", F.lower("image"))
    used = refs.join(aliases, ["root", "file", "local"], "left_anti").select(*fact(schema.CONSUMER, schema.IMAGE, normalized_image(F.col("image"))))
    named = stages.filter("alias <> ''").select(*fact(schema.PRODUCER, schema.IMAGE, F.concat_ws("#", "file", "alias")))
    final = stages.groupBy("root", "file").agg(F.max("line").alias("line")).select(*fact(schema.PRODUCER, schema.IMAGE, "file"))
    return used.unionByName(named).unionByName(final).unionByName(failures(rows, "dockerfile"))
