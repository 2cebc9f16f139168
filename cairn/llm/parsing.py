"""Files that are not valid text of their language: lexing to token streams, table-driven parsing, first error.

Each line becomes a tuple of tokens (remembered by line and lexer state, as lines and their shapes come again and again),
and the tables of the language's grammar read all of them to the end. The first token with no place, or an end of file
inside a construct, is the file's first unrecoverable error.

Defined results: null content gives no verdict (null); empty and comment-only files are valid; a byte-order mark, CR LF
and a missing last line end are no errors; a language without a grammar gives no verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.grammar import Grammar, Tables
from cairn.llm.grammars import GRAMMARS, KEYWORDS, OWN

SCRIPTS = ("javascript", "typescript")
INDENTED = ("python", "gdscript")
NEWLINE_ENDS = ("python", "gdscript", "ruby")
LINE_COMMENT = {"python": "#", "gdscript": "#", "ruby": "#"}
OPENERS = {"c_sharp": "$@", "go": "`", "javascript": "`", "typescript": "`", "ruby": "`/:%"}
OPERATOR = re.compile(
    r">>>=|<<=|>>=|\*\*=|//=|\?\?=|&&=|\|\|=|===|!==|<=>|\.\.\.|\.\.=|->|=>|<-|:=|::|\?\.|\?\?|\+\+|--|\*\*|\|\||&&|==|!=|<=|>=|=~|!~|<<|//|&\^|\.\.|[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.@#$()\[\]{}\\]"
)
ASSIGNMENTS = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "//=", "??=", "&&=", "||=", "@="}
PREFIX = {"!", "~", "not"}
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+[uUlLn]*|0[bB][01_]+[uUlLn]*|0[oO][0-7_]+n?|(?:\d[\d_]*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[uif](?:8|16|32|64|128|size)|[a-zA-Z]{1,3})?|\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmMjJ]?")
BARE_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?")
SUFFIX = re.compile(r"^(?:[uUlLfFdDmMjJn]|[uU][lL]{1,2}|[lL]{1,2}[uU]?|[uif](?:8|16|32|64|128|size)|ul|UL)?$")
NAME = re.compile(r"[^\W\d]\w*")
NAME_S = re.compile(r"[$\w]+")
OPERAND_END = {"NAME", "CONST", "IVAR", "NUM", "STR", "TPL", "REGEX", "SYM", ")", "]", "}", "end", "nil", "true", "false", "self", "this", "super", "null", "None", "True", "False", "KEY", "OPNAME", "++", "--"}
RUBY_END = OPERAND_END | {"next", "break", "return", "redo", "retry", "yield"}
# what may begin the argument of a Ruby call without brackets
ARGUMENT = re.compile(r"[ \t]+(?!(?:if|unless|while|until|and|or|do|then|rescue|end|in|else|elsif|when)\b)(?:[A-Za-z_\"'@\d`]|:[\w\"']|::[A-Z]|\[|->|[*&!~-](?=[\w(:\[@\"'])|\{(?=\s*\}))")

DIGITS = re.compile(r"\d+")
PY_STRING = re.compile(r"(?:[rRbBuUfFtT]{0,2})(\"\"\"|'''|\"|')")
RUST_RAW = re.compile(r"b?r(#*)\"")
RUST_CHAR = re.compile(r"b?'(?:\\[^']{1,10}|\\'|[^'\\])'")
LIFETIME = re.compile(r"'[A-Za-z_]\w*")
RUST_STRING = re.compile(r'b?"')
SHARP_STRING = re.compile(r"(?:\$@|@\$|@)\"|\$*\"\"\"|\$?\"")
CPP_RAW = re.compile(r"(?:u8|[uUL])?R\"([^()\\ ]{0,16})\(")
CPP_PREFIX = re.compile(r"(?:u8|[uUL])(?=[\"'])")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])+/[a-z]*")
RUBY_SYMBOL = re.compile(r":(?:[A-Za-z_]\w*[?!=]?|\"(?:\\.|[^\"\\])*\")")
RUBY_LIST = re.compile(r"%[wWiIqQ]?([\[({<|!])")
RUBY_VARIABLE = re.compile(r"@{1,2}[A-Za-z_]\w*|\$(?:[A-Za-z_]\w*|\d|[!@&~_.,;/<>:\"'?*$])")
RUBY_OPERATOR = re.compile(r"\[\]=?|<=>|===?|=~|![=~]?|[-+~]@?|\*\*?|<<|>>|<=?|>=?|[/%&|^]")
# a word that isn't part of a number and no prefix of a string
PLAIN_WORD = re.compile(r"(?<!\w)([^\W\d]\w*)(?![\w\"'#`])")
# Words besides the keywords whose wording matters to some lexer.
TOLD_APART = set("match case non record yield sealed default final where await global partial async new not and or when with nameof void int string bool object class static virtual begin end".split())
DEPTHS = {"(": 1, "[": 1, "{": 1, "HASH": 1, "FUNBRACE": 1, ")": -1, "]": -1, "}": -1}


class Shapes(dict):
    """Words to what stands for them: themselves if a lexer knows them, else one of four words by first letter and length."""

    def __init__(self, words: set[str]):
        super().__init__((w, w) for w in words)

    def __missing__(self, word: str) -> str:
        shape = ("X" if word[0].isupper() else "x") * min(len(word), 2)
        if len(self) < 500_000:
            self[word] = shape
        return shape


class Lexer:
    """Lines to tokens. A state is (kind of open string or comment, what closes it), () in plain code."""

    LIMIT = 200_000

    def __init__(self, lang: str):
        self.lang, self.words, self.own = lang, KEYWORDS[lang], set(OWN[lang].split())
        self.seen: dict[tuple, tuple] = {}
        self.shapes = Shapes(set(self.words) | TOLD_APART)
        # characters at which a comment, string or regular expression may begin; letters only before a quote
        self.openers = {"\"", "'", "#" if lang in LINE_COMMENT else "/"} | set(OPENERS.get(lang, ""))

    def shape(self, text: str) -> str:
        """The line with its own words replaced; lines of one shape have the same tokens."""
        parts = PLAIN_WORD.split(text)
        shapes = self.shapes
        parts[1::2] = [shapes[w] for w in parts[1::2]]
        return "".join(parts)

    def line(self, state: tuple, text: str) -> tuple[tuple[str, ...], tuple, int]:
        """tokens, state after the line, change of bracket depth."""
        key = (state, text)
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) >= self.LIMIT:
                self.seen.clear()
            if state or 'R"' in text:  # what closes a raw string is told by its wording
                found = self._line(state, text)
            else:
                shape = self.shape(text)
                found = self.seen.get((None, shape))
                if found is None:
                    found = self.seen[(None, shape)] = self._line(state, shape)
            self.seen[key] = found
        return found

    def _line(self, state: tuple, text: str) -> tuple[tuple[str, ...], tuple, int]:
        lang, out, at, n = self.lang, [], 0, len(text)
        if lang in ("cpp", "c_sharp") and not state and text.lstrip().startswith("#"):
            return (), (("pre", "") if text.rstrip().endswith("\\") else ()), 0
        if state and state[0] == "pre":
            return (), (state if text.rstrip().endswith("\\") else ()), 0
        if lang == "ruby" and not state and text.startswith("=begin"):
            return (), ("comment", "=end"), 0
        quoted = '"' in text or "'" in text
        while at < n:
            if state:
                kind, close = state
                end = self._close(text, at, kind, close)
                if end < 0:
                    return tuple(out), state, self._depth(out)
                at, state = end, ()
                continue
            c = text[at]
            if c in " \t\r\f\v ":
                at += 1
                continue
            if c == "\\" and not text[at + 1 :].strip():
                out.append("\\")
                break
            opened = self._open(text, at, out) if c in self.openers or (quoted and c.isalpha()) else None
            if opened is not None:
                at, token, state = opened
                if token:
                    out.append(token)
                if token == "ERR":
                    break
                continue
            if c.isdigit() or (c == "." and at + 1 < n and text[at + 1].isdigit() and not (out and out[-1] in OPERAND_END)):
                m = BARE_NUMBER.match(text, at) if c != "." else NUMBER.match(text, at)
                if lang == "rust" and out and out[-1] == "." and "." in m[0]:
                    m = DIGITS.match(text, at)
                rest = NAME_S.match(text, m.end())
                tail = rest[0] if rest else ""
                if not SUFFIX.match(tail) or (lang == "python" and re.fullmatch(r"0\d*[1-9]\d*", m[0])):
                    out.append("ERR")
                    break
                out.append("NUM")
                at = m.end() + len(tail)
                continue
            m = (NAME_S if lang in SCRIPTS else NAME).match(text, at)
            if m:
                at = self._word(m[0], text, m.end(), out)
                continue
            m = OPERATOR.match(text, at)
            if not m:
                out.append("ERR")
                break
            at = self._operator(m[0], text, at, out)
        return tuple(out), state, self._depth(out)

    @staticmethod
    def _depth(out: list[str]) -> int:
        return sum([DEPTHS[t] for t in out if t in DEPTHS])

    def _close(self, text: str, at: int, kind: str, close: str) -> int:
        if kind in ("comment", "raw"):
            end = text.find(close, at)
            if kind == "raw" and close == '"':  # a doubled quote stands for one
                while end >= 0 and text[end : end + 2] == '""':
                    end = text.find(close, end + 2)
            return -1 if end < 0 else end + len(close)
        i, n = at, len(text)
        while i < n:
            if text[i] == "\\":
                i += 2
            elif kind == "tpl" and text.startswith("${", i):
                depth, i = 1, i + 2
                while i < n and depth:
                    depth += (text[i] == "{") - (text[i] == "}")
                    i += 1
            elif text.startswith(close, i):
                return i + len(close)
            else:
                i += 1
        return -1

    def _open(self, text: str, at: int, out: list[str]) -> tuple[int, str, tuple] | None:
        """A comment, string or regular expression at this place: where it ends, its token, the state if it goes on."""
        lang, c, two, n = self.lang, text[at], text[at : at + 2], len(text)
        if lang in LINE_COMMENT:
            if c == "#":
                return n, "", ()
        elif two == "//":
            return n, "", ()
        elif two == "/*":
            end = text.find("*/", at + 2)
            return (end + 2, "", ()) if end >= 0 else (n, "", ("comment", "*/"))
        if lang in INDENTED:
            m = PY_STRING.match(text, at)
            if m and (m.start(1) == at or lang == "python"):
                return self._string(text, m.end(), m[1], "str" if len(m[1]) == 3 else "")
            return None
        if lang == "rust":
            m = RUST_RAW.match(text, at)
            if m:
                return self._string(text, m.end(), '"' + m[1], "raw")
            m = RUST_CHAR.match(text, at)
            if m:
                return m.end(), "STR", ()
            m = LIFETIME.match(text, at)
            if m:
                return m.end(), "LIFE", ()
            m = RUST_STRING.match(text, at)
            return self._string(text, m.end(), '"', "str") if m else None
        if lang == "c_sharp":
            m = SHARP_STRING.match(text, at)
            if m:
                if m[0].endswith('"""'):
                    return self._string(text, m.end(), '"""', "rawx")
                return self._string(text, m.end(), '"', "raw" if "@" in m[0] else "")
        if lang == "java" and text.startswith('"""', at):
            return self._string(text, at + 3, '"""', "str")
        if lang == "cpp":
            m = CPP_RAW.match(text, at)
            if m:
                return self._string(text, m.end(), ")" + m[1] + '"', "raw")
            m = CPP_PREFIX.match(text, at)
            if m:
                at, c = m.end(), text[m.end()]
        if lang == "go" and c == "`":
            return self._string(text, at + 1, "`", "raw")
        if lang in SCRIPTS:
            if c == "`":
                return self._string(text, at + 1, "`", "tpl")
            if c == "/" and not (out and (out[-1] in OPERAND_END)):
                m = REGEX.match(text, at)
                return (m.end(), "REGEX", ()) if m else (n, "ERR", ())
        if lang == "ruby":
            if c == "`":
                return self._string(text, at + 1, "`", "str")
            if c == "/" and not (out and out[-1] in OPERAND_END):
                m = REGEX.match(text, at)
                return (m.end(), "REGEX", ()) if m else (n, "ERR", ())
            m = RUBY_SYMBOL.match(text, at)
            if m and not (at and text[at - 1] == ":") and text[at + 1 : at + 2] != ":":
                return m.end(), "SYM", ()
            m = RUBY_LIST.match(text, at)
            if m and not (out and out[-1] in OPERAND_END):
                close = {"[": "]", "(": ")", "{": "}", "<": ">"}.get(m[1], m[1])
                return self._string(text, m.end(), close, "str")
            if c in "\"'":
                return self._string(text, at + 1, c, "str")
            return None
        if c in "\"'":
            return self._string(text, at + 1, c, "")
        return None

    def _string(self, text: str, at: int, close: str, kind: str) -> tuple[int, str, tuple]:
        end = self._close(text, at, {"": "str", "rawx": "comment"}.get(kind, kind), close)
        if end >= 0:
            return end, "TPL" if kind == "tpl" else "STR", ()
        if kind:
            return len(text), "TPL" if kind == "tpl" else "STR", ({"rawx": "comment"}.get(kind, kind), close)
        if text.endswith("\\") and self.lang in ("python", "javascript", "typescript", "cpp", "gdscript"):
            return len(text), "STR", ("str", close)
        return len(text), "ERR", ()

    def _word(self, word: str, text: str, end: int, out: list[str]) -> int:
        lang, prev = self.lang, out[-1] if out else ""
        if lang == "ruby":
            if text[end : end + 1] in ("?", "!") and text[end + 1 : end + 2] != "=" and text[end : end + 2] not in ("? ",):
                word, end = word + text[end], end + 1
            if text[end : end + 1] == ":" and text[end + 1 : end + 2] != ":" and prev not in ("?",):
                out.append("LABEL")
                return end + 1
            if prev == "." or prev == "def":
                out.append("CONST" if word[0].isupper() else "NAME" if word not in self.words or prev == "." else "self" if word == "self" else "KEY")
                if prev == "." and ARGUMENT.match(text, end):
                    out.append("CMD")
                return end
            token = self.words.get(word)
            if token in ("if", "unless", "while", "until", "rescue") and prev in RUBY_END:
                token += "_mod"
            if token is None:
                token = "CONST" if word[0].isupper() else "NAME"
            out.append(token)
            if token in ("NAME", "super", "yield") and ARGUMENT.match(text, end):
                out.append("CMD")
            return end
        token = self.words.get(word)
        if lang == "python" and not out and word in ("match", "case") and re.match(r"^\s*[\w\"'(\[{*-].*:\s*(?:#.*|\S.*)?$", text[end:]) and not re.match(r"^\s*[=.,)]", text[end:]) and not re.match(r"^\s*\(.*\)\s*$", text[end:]):
            token = word
        if lang in SCRIPTS:
            if prev in (".", "?."):
                token = None
            elif token and re.match(r"^\s*\??:(?!:)", text[end:]) and prev in ("{", ",", "(", "FUNBRACE", ";", "") and word not in ("default", "case") and not (prev in ("", ";") and word in ("this", "null", "true", "false")):
                token = None
            elif token in ("get", "set") and not re.match(r"^\s+(?:[\w$\[\"']|#)", text[end:]):
                token = None
            elif token in ("get", "set"):
                return end  # an accessor's mark; what follows is the member
            elif token in ("type", "declare", "namespace", "abstract", "interface", "enum", "MOD", "readonly", "is", "asserts", "infer", "unique", "keyof", "satisfies", "implements", "async", "static") and re.match(r"^\s*(?:[=.,;)\]}]|$)" if token == "async" else r"^\s*(?:[=.,;)(\]}+*/?|&!]|$)", text[end:]):
                token = None
        if lang == "java" and word in ("record", "yield", "sealed", "default") and not re.match(r"^\s+[A-Za-z_]", text[end:]) and word != "default":
            token = None
        if lang == "java" and word == "non" and text.startswith("-sealed", end):
            out.append("MOD")
            return end + 7
        if lang == "java" and word == "default" and re.match(r"^\s+(?!->)[\w<]", text[end:]):
            token = "MOD"
        if lang == "java" and word == "final":
            token = "MOD" if prev in ("", ";", "{", "}", "MOD", ",", "(", ")") else token
        if lang == "c_sharp":
            if word in ("record", "yield", "where", "await", "global", "partial", "async") and not re.match(r"^\s+[\w(@]|^::", text[end:]):
                token = None
            elif word == "new" and prev in ("MOD", "") and re.match(r"^\s+(?:void|int|string|bool|object|class|static|virtual|[A-Z]\w*\s+\w)", text[end:]) and prev == "MOD":
                token = "MOD"
            elif word in ("not", "and", "or", "when", "with", "nameof"):
                token = word if (word == "not" and prev == "is") or (word in ("and", "or") and prev in OPERAND_END and re.match(r"^\s+[\w\"'<>]", text[end:])) or (word == "when" and prev in OPERAND_END) or (word == "with" and re.match(r"^\s*\{", text[end:])) or word == "nameof" else None
        out.append(token or "NAME")
        return end

    def _operator(self, op: str, text: str, at: int, out: list[str]) -> int:
        lang, prev = self.lang, out[-1] if out else ""
        operand = prev in OPERAND_END or (lang == "rust" and prev in ("?", "Self", "crate"))
        if lang in SCRIPTS and op == "#" and NAME_S.match(text, at + 1):
            out.append("PRIVATE")
            return NAME_S.match(text, at + 1).end()
        if lang == "ruby" and op in ("@", "$"):
            m = RUBY_VARIABLE.match(text, at)
            out.append("IVAR" if m else "ERR")
            return m.end() if m else len(text)
        if lang == "ruby" and prev in ("def", ".") and op not in ("(", "["):
            m = RUBY_OPERATOR.match(text, at)
            if m and prev == "def":
                out.append("OPNAME")
                return m.end()
        if lang == "gdscript" and op in ("$", "%", "&", "^") and not operand and re.match(r"[\"'\w]", text[at + 1 : at + 2]):
            out.append("PRE2")
            return at + 1
        if lang == "ruby" and op == "{":
            out.append("{" if prev in OPERAND_END and prev not in ("STR", "NUM", "return", "CONST") or prev == "CONST" else "HASH")
            return at + 1
        if lang in SCRIPTS and op == "{":
            out.append("FUNBRACE" if prev == "=>" else "{")
            return at + 1
        if lang in SCRIPTS and op == "?" and re.match(r"\?\s*(?::|[,)=](?!=))", text[at:]):
            if re.match(r"\?\s*:", text[at:]):
                out.append("?:")
                return at + re.match(r"\?\s*:", text[at:]).end()
        if lang == "c_sharp" and op in ("?.", "?") and text.startswith("?[", at) and operand:
            out.append("?.")
            out.append("NAME")
            return at + 1
        # an operator may be longer than the language's own
        if op in self.own:
            pass
        elif op not in ASSIGNMENTS and len(op) > 1 and lang in ("rust", "java", "cpp", "c_sharp", "javascript", "typescript") and op[0] in "<>" and op not in ("<=", ">=", "<=>"):
            op = op[0]
        elif op == "//" and lang not in INDENTED:
            op = "/"
        elif op == "--" and lang == "rust":
            op = "-"
        elif op == "::" and lang in INDENTED:
            out += [":", ":"]
            return at + 2
        elif op == ">" and text.startswith(">>", at):
            out.append("ASSIGN" if text.startswith(">>=", at) else "BIN")
            return at + 2
        size = len(op)
        if lang not in SCRIPTS + ("ruby",) and op in ("===", "!=="):
            out.append("ERR")
            return len(text)
        if op in self.own:
            out.append(op)
        elif op == "*":
            out.append("STAR")
        elif op in ASSIGNMENTS or (op == ":=" and lang == "gdscript"):
            out.append("ASSIGN")
        elif op in ("+", "-"):
            out.append("SIGN")
        elif op in PREFIX and not (op == "~" and operand):
            out.append("PRE")
        elif op in ("++", "--"):
            out += ["SIGN", "SIGN"]
        elif op in ("#", "$", "\\", "@", "?", "=>", "->", "<-", "::", ":="):
            out.append("ERR")
            return len(text)
        else:
            out.append("BIN")
        return at + size


@lru_cache(maxsize=32)
def _tools(lang: str) -> tuple[Lexer, Tables]:
    return Lexer(lang), Tables(Grammar(GRAMMARS[lang], "file"))


GO_ENDS = {"NAME", "NUM", "STR", ")", "]", "}", "return", "break", "continue", "fallthrough", "++", "--"}
GOES_ON = {"BIN", "SIGN", "ASSIGN", ",", ".", "and", "or", "not", "STAR", "**", "&", "<<", "=>", "::", "\\", "?", "PRE", "/", "<"}


def first_error(lang: str, text: str) -> tuple[int, str] | None:
    """(line, token) of the first unrecoverable error, or None for a valid text."""
    lexer, tables = _tools(lang)
    if len(tables.cells) > tables.LIMIT or len(tables.lines) > tables.LIMIT:
        tables.clear()
    text = text.removeprefix("﻿")
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    stack, state, depth, indents = tables.begin, (), 0, [0]
    nesting: list[str] = []
    joined, last = False, ""
    for number, line in enumerate(lines, 1):
        was = state
        if number == 1 and line.startswith("#!"):
            continue
        if lang == "ruby" and not state and line.rstrip() == "__END__":
            break
        tokens, state, change = lexer.line(state, line)
        closed = bool(was) and was[0] not in ("comment", "pre") and not state
        if not tokens and not closed:
            continue
        if lang in INDENTED and not was and depth == 0 and not joined:
            width = len(line[: len(line) - len(line.lstrip())].expandtabs(8))
            marks: list[str] = []
            if width > indents[-1]:
                indents.append(width)
                marks.append("IND")
            while width < indents[-1]:
                indents.pop()
                marks.append("DED")
            if width != indents[-1]:
                return number, "indent"
            if marks:
                stack = tables.line(stack, tuple(marks))
                if stack < 0:
                    return number, "indent"
        joined = bool(tokens) and tokens[-1] == "\\"
        if joined:
            tokens = tokens[:-1]
        last = tokens[-1] if tokens else last
        depth = depth + change
        if depth < 0:
            return number, last
        ends = not state and not joined
        if lang in INDENTED:
            if ends and depth == 0:
                tokens = (*tokens, "NL")
        elif lang == "go":
            if ends and last in GO_ENDS:
                tokens = (*tokens, ";")
        elif lang == "ruby":
            for t in tokens:
                if t in ("(", "[", "{", "HASH"):
                    nesting.append(t)
                elif t in (")", "]", "}") and nesting:
                    nesting.pop()
            inside = bool(nesting) and nesting[-1] != "{"
            if ends and not inside and last not in GOES_ON and not _dotted(lines, number):
                tokens = (*tokens, "NL")
        stack = tables.script_line(stack, tokens) if lang in SCRIPTS else tables.line(stack, tokens)
        if stack < 0:
            k = -1 - stack
            return number, tokens[min(k, len(tokens) - 1)]
    if state and state[0] != "pre":
        return len(lines), "end of file"
    tail = ["DED"] * (len(indents) - 1) + ["EOF"]
    if lang == "ruby":
        tail = ["NL", "EOF"]
    stack = tables.script_line(stack, tuple(tail)) if lang in SCRIPTS else tables.line(stack, tuple(tail))
    return None if stack >= 0 and tables.complete(stack) else (len(lines), "end of file")


def _dotted(lines: list[str], number: int) -> bool:
    """Whether the next line that isn't blank goes on with a call."""
    for line in lines[number:]:
        s = line.strip()
        if s and not s.startswith("#"):
            return re.match(r"&?\.[A-Za-z_]", s) is not None
    return False


def check_texts(texts: DataFrame) -> DataFrame:
    """lang, sha, valid, error_line, error_token from (lang, sha, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, lang, text in zip(pdf["sha"], pdf["lang"], pdf["content"]):
                found = first_error(lang, text) if lang in GRAMMARS else None
                rows.append((lang, sha, found is None if lang in GRAMMARS else None, *(found or (None, None))))
            out = pd.DataFrame(rows, columns=["lang", "sha", "valid", "error_line", "error_token"])
            out["error_line"] = out["error_line"].astype("Int32")
            yield out

    return texts.select("lang", "sha", "content").mapInPandas(run, "lang string, sha string, valid boolean, error_line int, error_token string")


def check_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """file_id, valid, error_line, error_token of every file with a text.

    files: file_id, path, lang. sources: path, content. A text that comes again, under whatever path, is parsed once a
    language: files meet hashes, and only one copy of each text is shuffled to where it is parsed.
    """
    sha = F.sha2("content", 256).alias("sha")
    files = files.select("file_id", "path", "lang")
    texts = sources.select("path", "content").where("content is not null and path is not null")
    hashed = files.join(texts.select(F.col("path").alias("p"), sha).distinct(), F.col("path") == F.col("p")).select("file_id", "lang", "sha")
    wanted = hashed.select("sha", "lang").distinct()
    once = texts.select(sha, "content").dropDuplicates(["sha"])
    verdict = check_texts(once.join(wanted, "sha")).withColumnRenamed("lang", "as_lang")
    known = hashed.join(verdict, (hashed["sha"] == verdict["sha"]) & F.col("lang").eqNullSafe(F.col("as_lang")))
    return known.select("file_id", "valid", "error_line", "error_token").distinct()


def error_rates(checked: DataFrame) -> DataFrame:
    """repo, lang, n_files, n_invalid, rate, n_hinted from (repo, lang, valid, hinted)."""
    return (
        checked.groupBy("repo", "lang")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if("hinted").alias("n_hinted"))
        .withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
