"""Functions paired with their documentation.

A state machine of one pattern per language family walks each text once and tells strings, comments, regular expressions
and code apart. In what is left, braces are matched (``end`` words in Ruby, indentation in Python and GDScript) to find
where each function begins and ends, and the comment right above it (or the first string inside it) is attached. Names and
signatures come from the rows of ``symbols`` that begin on the same line; functions whose attached comment says nothing
are dropped. Where the attached comment and the index's doc_comment differ in their words, both have to say something.

Defined results: a function without documentation, or whose documentation consists of its own name, bare parameters,
tags, tool directives, section lines, licence notes, code or stand-ins, gives no pair; what the lexer doesn't delimit in a
readable text gives no pair either; for files whose text is null or absent there is nothing to lex, so their pairs rest
on the index alone and are marked (readable false, code and comment null); twice-delivered rows count once; line ends may
be LF or CR LF; unknown languages are lexed like C.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("function", "method", "constructor")

# Words that say nothing of what a function does.
EMPTY_WORDS = set(
    """a an the this that these it its of to for in on and or with from by as is are be does do did will which function functions method methods
    constructor ctor class func procedure routine helper helpers utility util utils implementation implements impl called call used use
    simple simply just get gets set sets return returns given new object""".split()
)
STAND_INS = re.compile(
    r"^(?:(?:auto-?generated )?(?:method |function |constructor )?stub|(?:same )?(?:as|see) (?:above|below|base class|parent|super(?: ?class)?|interface|overridden method)|see (?:also )?\S+|ditto|idem|"
    r"self[- ]explanatory|obvious|internal(?: use(?: only)?)?|private|public|protected|deprecated|override[sn]?|summary|description|short description|long description|"
    r"(?:no|missing) (?:documentation|description|docs?|comment)(?: available| yet)?|(?:documentation|description|text|comment|docs?) (?:goes|comes) here|"
    r"(?:add|write|insert|put|enter|fill in) (?:a |the |your )?(?:short |brief )?(?:description|documentation|comment|comments|docs?|text|summary)(?: here)?|describe (?:me|this)(?: \w+)?|document (?:me|this)|"
    r"foo|bar|baz|asdf|qwerty|test|none|null|nil|n/?a|tbd|tba|wip|todo|fixme|xxx|hack|blah|helper|utility|(?:utility |helper |internal |private )?(?:function|method|constructor|routine)|"
    r"\{?@?inheritdoc\}?|placeholder|to be (?:done|written|documented|defined)|coming soon|under construction|empty|nothing(?: to see here)?|yes|no|ok)$", re.I,
)
MARKER = re.compile(r"^(?:@\w+\s+)?(?:todo|fixme|xxx|hack|tbd|wip)\b", re.I)
DIRECTIVE = re.compile(
    r"^(?:#?\s*(?:pragma|region|endregion|noqa|nolint|nosec|nosonar)\b|(?:end)?region\b|eslint[- ]|tslint:|jshint|jslint|prettier-ignore|stylelint|biome-ignore|@?ts-(?:ignore|expect-error|nocheck|check)|"
    r"istanbul ignore|c8 ignore|v8 ignore|pylint:|flake8[:=]|mypy:|type:\s*ignore|pyright:|fmt:\s*(?:on|off|skip)|isort:|yapf:|black:|ruff:|rubocop:|steep:|sorbet:|typed:|clang-format|clang-tidy|NOLINT\w*|cppcheck|"
    r"go:\w+|\+build|nolint:|rustfmt|clippy|allow\(|deny\(|checkstyle|suppress|suppresswarnings|spotless|resharper|stylecop|gdlint|warning-ignore|codespell|cspell|spell-?checker|coding[:=]|vim?:|-\*-)", re.I,
)
LICENCE = re.compile(r"(?:^|\b)(?:copyright\b|\(c\)\s*\d{4}|©|spdx-license|licen[sc]ed under|licen[sc]e:|all rights reserved|permission is hereby granted|this file is part of)", re.I)
SECTION = re.compile(r"^(?:[-=*#~_+/.\s]{2,}.{0,40}?[-=*#~_+/\s]{2,}|[-=*#~_+/.]{2,}.{0,30}|section\s*:.*|mark\s*:.*|\w+ (?:helpers|section|utilities|methods|functions|accessors|getters|setters))$", re.I)
CODE_LINE = re.compile(r"^(?:[\w.\[\]>-]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?|(?:var|let|const|return|if|for|while|int|auto|self|this)\b.*[;{})]|[\w.\[\]]+\s*(?:[-+*/|&]?=|:=)\s*\S.*|[{}()\[\];,]+|.*;\s*|import \S+|from \S+ import .*|raise \w+.*|throw new .*)$")
TAG = re.compile(
    r"^\s*(?:\{@\w+\s*([^}]*)\}|[@\\](?:param|arg|argument|tparam|typeparam|template)\b(?:\s*\{[^}]*\})?(?:\s*\[?[\w.$*&]+\]?)?|:(?:param|parameter|arg|key|keyword|type|raises|var)\b[^:]*:|:(?:returns?|rtype|yields?):|[@\\]\w+(?:\s*\{[^}]*\})?|</?\w+(?:\s[^>]*)?/?>)\s*[-:–]?\s*"
)
BARE_ARGUMENT = re.compile(r"^[-*]?\s*`?\w+`?\s*(?:\([^)]*\))?\s*:?\s*$")
WORD = re.compile(r"[^\W\d_]+")
HEAD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def stem(word: str) -> str:
    cut = True
    while cut:
        cut = next((e for e in ("ies", "ing", "ers", "ed", "es", "er", "s", "e", "y", "i") if word.endswith(e) and len(word) - len(e) >= 3), "")
        word = word[: len(word) - len(cut)]
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def name_words(name: str) -> set[str]:
    return {stem(w.lower()) for w in HEAD.findall(name)} | {stem(w.lower()) for w in WORD.findall(name)}


def informative(doc: str | None, name: str | None, signature: str | None = None) -> bool:
    """Whether a documentation comment says something that the name and the marks around it don't."""
    if doc is None or not doc.strip():
        return False
    own = name_words(name or "")
    inside = re.search(r"\((.*)\)", signature or "", re.S)
    parameters = {w.lower() for w in re.findall(r"[^\W\d]\w*", inside[1])} if inside else set()
    for line in doc.replace("\r", "\n").split("\n"):
        line = re.sub(r"^[\s*/#!]+|[\s*/]+$", "", line) if not line.lstrip().startswith("#pragma") else line.strip()
        if not line or LICENCE.search(line) or DIRECTIVE.match(line) or SECTION.match(line):
            continue
        tagged = False
        while (m := TAG.match(line)) and m.end():
            line, tagged = (m[1] or "") + line[m.end() :], True
        if CODE_LINE.match(line) or (not tagged and BARE_ARGUMENT.match(line) and line.strip(" :-*`").lower() in parameters):
            continue
        for s in re.split(r"(?<=[.!?。])\s+|;\s+", line):
            s = s.strip(" .!?:;-*\"'`()[]")
            if not s or MARKER.match(s) or STAND_INS.match(s) or DIRECTIVE.match(s) or CODE_LINE.match(s):
                continue
            if re.match(r"^(?:(?:[Tt]he|[Tt]his)\s+)?[a-z]+[A-Z]\w*(?:\s+(?:function|method|helper|constructor|class))?$", s):
                continue  # an identifier is no description
            left = [w.lower() for w in WORD.findall(re.sub(r"\b\w*[a-z0-9][A-Z_]\w*\b", lambda m: " ".join(HEAD.findall(m[0])), s))]
            left = [w for w in left if w not in EMPTY_WORDS and w not in parameters and stem(w) not in own]
            if left or (re.search(r"[^\x00-\x7f]", s) and not WORD.search(s) is None and stem(s.lower()) not in own):
                return True
    return False


_MARKS = re.compile(r"^[ \t]*(?:/\*+[!*]?|\*+/|//+[!/<]*|\*(?!/)|#+(?![!:\w])|#+(?=\w)|=begin\b|=end\b)?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_QUOTES = re.compile(r"(?s)\A[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')(.*?)(?:\1)?\Z")


def without_marks(comment: str | None) -> str | None:
    """The text of a comment or of a documentation string."""
    if comment is None:
        return None
    m = _QUOTES.match(comment.strip())
    return m[2] if m else _MARKS.sub("", comment)


def same_words(a: str | None, b: str | None) -> bool:
    return re.findall(r"[^\W_]+", a or "") == re.findall(r"[^\W_]+", b or "")


def documented(comment: str | None, doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether the attached comment says something; the index's wording is asked too where it is another."""
    text = without_marks(comment)
    return informative(text, name, signature) and (same_words(text, doc) or informative(doc, name, signature))


# --- the lexer -----------------------------------------------------------------------------------------------------

_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_HASH = r"#[^\n]*"
_DQ, _SQ = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)'
_TEMPLATE = r"`(?:\\.|[^`\\])*(?:`|\Z)"
_REGEX = r"(?<=[=(,:\[!&|?{};+])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
FAMILIES = {
    "python": ("indent", f"(?P<s>{_TRIPLE}|{_DQ}|{_SQ})|(?P<c>{_HASH})"),
    "gdscript": ("indent", f"(?P<s>{_TRIPLE}|{_DQ}|{_SQ})|(?P<c>{_HASH})"),
    "ruby": ("end", f"(?P<s>{_DQ}|{_SQ})|(?P<c>{_HASH}|^=begin.*?^=end[^\\n]*)"),
    "go": ("brace", f"(?P<s>`[^`]*(?:`|\\Z)|{_DQ}|{_SQ})|(?P<c>{_C_COMMENT})"),
    "rust": ("brace", rf"(?P<s>b?r(#*)\".*?\"\2|b?{_DQ}|b?'(?:\\[^\n]{{1,10}}|[^'\\\n])')|(?P<c>{_C_COMMENT})"),
    "c_sharp": ("brace", f'(?P<s>\\$?@"(?:""|[^"])*"?|{_DQ}|{_SQ})|(?P<c>{_C_COMMENT}|^\\s*#[^\\n]*)'),
    "java": ("brace", f'(?P<s>"""(?:\\\\.|[^\\\\])*?(?:"""|\\Z)|{_DQ}|{_SQ})|(?P<c>{_C_COMMENT})'),
    "cpp": ("brace", f'(?P<s>R"(\\w*)\\(.*?\\)\\2"|{_DQ}|{_SQ})|(?P<c>{_C_COMMENT})'),
    "javascript": ("brace", f"(?P<s>{_TEMPLATE}|{_DQ}|{_SQ}|{_REGEX})|(?P<c>{_C_COMMENT})"),
}
FAMILIES["typescript"] = FAMILIES["javascript"]
NOT_A_FUNCTION = re.compile(
    r"^(?:else\b|if\b|for\b|foreach\b|while\b|switch\b|catch\b|try\b|do\b|using\b|lock\b|match\b|select\b|loop\b|unsafe\b|return\b|throw\b|new\b|await\b|yield\b|defer\b|go\b|with\b|case\b|}|class\b|struct\b|enum\b|interface\b|namespace\b|impl\b|trait\b|mod\b)"
)
OWNER = re.compile(r"(?:^|[\s(])(?:class|struct|enum|interface|namespace|impl|trait|record)\s+\w*[^()]*$")
BLOCK_WORDS = re.compile(r"(?m)^[ \t]*(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$|=[ \t]*(?:if|case|begin|unless)\b|\bend\b")


@lru_cache(maxsize=32)
def _lexer(lang: str):
    kind, pattern = FAMILIES.get(lang, FAMILIES["cpp"])
    return kind, re.compile(pattern, re.S | re.M)


def lex(lang: str, text: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text with strings and comments blanked out, and where those are."""
    _, pattern = _lexer(lang)
    strings: list[tuple[int, int]] = []
    comments: list[tuple[int, int]] = []
    parts, at = [], 0
    for m in pattern.finditer(text):
        (comments if m["c"] is not None else strings).append(m.span())
        parts += [text[at : m.start()], re.sub(r"[^\n]", " ", m[0]) if m["c"] is not None else "_" + re.sub(r"[^\n]", " ", m[0][1:])]
        at = m.end()
    parts.append(text[at:])
    return "".join(parts), strings, comments


def _statement(head: str) -> str:
    """The last statement of what stands before a brace: whole lines, back to where its brackets are even."""
    lines = head.split("\n")
    even = 0
    for i in range(len(lines) - 1, -1, -1):
        even += sum(lines[i].count(c) for c in ")]") - sum(lines[i].count(c) for c in "([")
        line = lines[i].strip()
        if line and even <= 0 and "(" in "".join(lines[i:]) and line[0] not in ").,:&|?+" and not line.startswith(("where", "throws", "->", "=>")):
            return "\n".join(lines[i:])
    return head


def _brace_spans(code: str) -> list[tuple[int, int]]:
    spans, stack, begin, depth = [], [], 0, 0
    for m in re.finditer(r"[{};()]", code):
        c = m[0]
        if c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c == ";":
            if not depth:
                begin = m.end()
        elif c == "{":
            head = _statement(code[begin : m.start()])
            lead = head.lstrip()
            function = "(" in head and not NOT_A_FUNCTION.match(lead) and not OWNER.search(head) and not (depth and "=>" not in head)
            function = function and (re.search(r"\)\s*(?:[:\-=>\w\s<>,&|.?*!\[\]()]|->)*$", head) is not None)
            stack.append((m.start() - len(lead), function, depth))
            begin, depth = m.end(), 0
        else:
            if stack:
                start, function, depth = stack.pop()
                if function:
                    spans.append((start, m.end()))
            begin = m.end()
    return spans


def _indent_spans(code: str) -> list[tuple[int, int]]:
    spans = []
    for m in re.finditer(r"(?m)^([ \t]*)(?:static[ \t]+)?(?:async[ \t]+)?(?:def|func)[ \t]+\w+", code):
        width = len(m[1].expandtabs(8))
        depth, end = 0, len(code)
        at = m.start()
        last = at
        for line in re.finditer(r"[^\n]*(?:\n|\Z)", code[at:]):
            text = line[0]
            if not text:
                break
            if line.start() and depth <= 0 and text.strip() and len(re.match(r"[ \t]*", text)[0].expandtabs(8)) <= width:
                break
            depth += sum(text.count(c) for c in "([{") - sum(text.count(c) for c in ")]}")
            if text.strip():
                last = at + line.end()
        end = last
        spans.append((m.start() + len(m[1]), end))
    return spans


def _end_spans(code: str) -> list[tuple[int, int]]:
    spans, stack = [], []
    for m in BLOCK_WORDS.finditer(code):
        word = m[0].strip()
        if word == "end":
            if stack:
                start, function = stack.pop()
                if function:
                    spans.append((start, m.end()))
        else:
            stack.append((m.start() + len(m[0]) - len(m[0].lstrip()), word.startswith("def")))
    return spans


def functions(lang: str, text: str) -> list[tuple[int, int, str, str | None]]:
    """(first line, last line, code, comment right above or first string inside) of every function of a text."""
    text = text.replace("\r\n", "\n").lstrip("﻿")
    kind, _ = _lexer(lang)
    code, strings, comments = lex(lang, text)
    spans = {"brace": _brace_spans, "indent": _indent_spans, "end": _end_spans}[kind](code)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    from bisect import bisect_right

    line_of = lambda p: bisect_right(starts, p)
    ends = {line_of(e - 1): (s, e) for s, e in comments}
    out = []
    for s, e in spans:
        first, last = line_of(s), line_of(max(s, e - 1))
        doc: list[str] = []
        above = first - 1
        while above in ends:
            a, z = ends[above]
            if text[starts[line_of(a) - 1] : a].strip():
                break  # the comment ends a line of code
            doc.insert(0, text[a:z])
            above = line_of(a) - 1
        if kind == "indent":
            inner = next(((a, z) for a, z in strings if s < a < e), None)
            if inner and re.match(r"^.*:\s*$", code[s : inner[0]], re.S) and code[s : inner[0]].count("\n") <= 12 and not re.search(r":[ \t]*\n\s*\S", code[s : inner[0]]):
                doc.append(text[inner[0] : inner[1]])
        out.append((first, last, text[starts[first - 1] : e].rstrip("\n"), "\n".join(doc) or None))
    return out


def extract_functions(files: DataFrame, with_code: bool = True) -> DataFrame:
    """file_id, first_line, last_line, code, comment from (file_id, lang, content); code is null if it isn't wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, first, last, code if with_code else None, comment)
                for i, lang, text in zip(pdf["file_id"], pdf["lang"], pdf["content"])
                if text
                for first, last, code, comment in functions(lang or "", text)
            ]
            yield pd.DataFrame(rows, columns=["file_id", "first_line", "last_line", "code", "comment"])

    schema = "file_id long, first_line int, last_line int, code string, comment string"
    return files.select("file_id", "lang", "content").where("content is not null").mapInPandas(run, schema)


def judged(rule: Callable[..., bool], *columns: str) -> Column:
    """A rule on the values of some columns as a boolean column."""

    @F.pandas_udf("boolean")
    def check(*values: pd.Series) -> pd.Series:
        return pd.Series([rule(*x) for x in zip(*values)], dtype=bool)

    return check(*columns)


def doc_pairs(symbols: DataFrame, files: DataFrame, sources: DataFrame, with_code: bool = True) -> DataFrame:
    """symbol_id, file_id, lang, readable, code, doc, comment (as lexed) of every documented function, method and constructor.

    files: file_id, path, lang (one row each).
    """
    files = files.select("file_id", "path", "lang")
    wanted = symbols.where(F.col("kind").isin(*KINDS) & F.col("doc_comment").isNotNull() & F.col("symbol_id").isNotNull())
    wanted = wanted.select("symbol_id", "file_id", "name", "start_line", "signature", F.col("doc_comment").alias("doc")).dropDuplicates(["symbol_id"])
    texts = sources.where("content is not null").select(F.col("path").alias("p"), "content").dropDuplicates(["p"])
    texts = files.join(texts, F.col("path") == F.col("p")).select("file_id", "lang", "content")
    lexed = extract_functions(texts, with_code).select(F.col("file_id").alias("fid"), "first_line", "last_line", "code", "comment").where("comment is not null")
    # of functions that begin on one line the longest is meant
    lexed = lexed.groupBy("fid", "first_line").agg(F.max_by(F.struct("code", "comment"), "last_line").alias("f"))
    langs = files.select(F.col("file_id").alias("lid"), "lang")
    paired = (
        lexed.join(wanted, (F.col("fid") == F.col("file_id")) & (F.col("first_line") == F.col("start_line")))
        .select("symbol_id", "file_id", "name", "signature", F.col("f.code").alias("code"), "doc", F.col("f.comment").alias("comment"))
        .where(judged(documented, "comment", "doc", "name", "signature"))
        .select("symbol_id", "file_id", F.lit(True).alias("readable"), "code", "doc", "comment")
    )
    readable = sources.where("content is not null").select(F.col("path").alias("p")).distinct()
    readable = files.join(readable, F.col("path") == F.col("p"), "left_semi").select(F.col("file_id").alias("rid"))
    unread = wanted.join(readable, F.col("file_id") == F.col("rid"), "left_anti").where(judged(informative, "doc", "name", "signature"))
    none = F.lit(None).cast("string")
    unread = unread.select("symbol_id", "file_id", F.lit(False).alias("readable"), none.alias("code"), "doc", none.alias("comment"))
    both = paired.unionByName(unread)
    return both.join(langs, F.col("file_id") == F.col("lid"), "left").select("symbol_id", "file_id", "lang", "readable", "code", "doc", "comment")
