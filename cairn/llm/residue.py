"""Template residue, filler and error pages among texts.

Every text is cut into units (lines and sentences, code left out), and records of the same template are aligned by them.

*Slots.* Whatever stands between two marks (``{{x}}``, ``%(x)s``, ``<% x %>``, ``__x__``, ``____``: any marks, none are
listed) is a candidate. Units that are the same but for their candidates are aligned; those under which several fillings
come (none at all is one) are templates, and their candidates' marks are a slot form if what they hold, over all records,
is mostly variable names, defaults or blanks. A name is a variable's if it is written with underscores or comes between
three kinds of marks. Every variable name or blank in a form so induced is an open slot.

*Error pages.* Each unit of a record that speaks of failures or scripts in a good part of its units is counted as it is
and with every run of up to three words masked, so units of the same template meet under one key and the words that differ
under it are its slot. A page is an error page if all its units are templates' and half of them speak of failures.

Beside what is aligned, the wording of single units counts: listed slot forms, filler phrases, notices of errors that are
seen once. A form label seen in several records makes its line a form line; a phrase that repeats within some record makes
the same phrase filler where it stands alone. A text is residue if it has an open slot or filler paragraph anywhere, or if
nothing in it is real content.

Defined results: null and blank texts are no residue; code blocks, inline code and quoted passages are never evidence;
repeated rows get the same verdict; texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import Scratch

SUPPORT = 3  # records a template, label or phrase must be seen in
FAILING = 0.25  # of a record's units, those that must speak of failures or scripts for it to be aligned as an error page
FORMS = 3  # kinds of marks a name must come between to be a variable's

# Words of the classic filler text.
LATIN = set(
    """lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore
    magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
    irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident
    sunt culpa qui officia deserunt mollit anim id est laborum vitae urna porta augue morbi lectus massa tempus mauris nunc
    vestibulum pellentesque habitant tristique senectus netus malesuada fames ac turpis egestas donec sapien vel faucibus
    scelerisque viverra justo tellus cursus mattis molestie iaculis at erat quam nec dui ornare arcu odio aenean euismod""".split()
)
NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+)*"
VARIABLE = r"[A-Za-z][A-Za-z0-9]*(?:[_.\-][A-Za-z0-9]+)*"
# How template languages and people write a slot to be filled.
SLOTS = [
    rf"\{{\{{-?\s*{VARIABLE}(?:\s*\|\s*\w+)?\s*-?\}}\}}", rf"\$\{{\s*{VARIABLE}\s*\}}", rf"#\{{\s*{VARIABLE}\s*\}}", rf"<%=?\s*{VARIABLE}\s*%>",
    rf"\{{%\s*{VARIABLE}\s*%\}}", rf"%\({VARIABLE}\)[sd]", r"%[A-Za-z][A-Za-z_]*%", rf"@@{VARIABLE}@@", rf"«{VARIABLE}»",
    rf"\[\[\s*{VARIABLE}\s*\]\](?!\()", r"(?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)", rf"(?<![\w$#{{/])\{{{VARIABLE}\}}(?![\w}}])",
    rf"\[(?:your|insert|enter|add|type|todo:?|tbd:?|fill in|replace)\s+{NAME}\](?!\()", rf"\[{NAME} (?:goes )?here\](?!\()",
    rf"<(?:your|insert|enter|add)\s+{NAME}>", rf"<{NAME} (?:goes )?here>", r"(?<!\w)_{4,}(?!\w)", r"\[(?:TODO|TBD|FIXME|XXX)\](?!\()",
]
SLOT_MARKS = "{<%@«[_"  # every slot holds one of these
SLOT = re.compile("|".join(f"(?:{s})" for s in SLOTS), re.I)
# Anything between marks: up to five words, or a blank to be written on.
MARK = r"[^\w\s.,;:!?'’\"“”„\-]"
DELIMITED = re.compile(
    rf"(?<!\w)(?:(?P<open>{MARK}{{1,3}}|__)[ ]?(?P<name>[A-Za-z](?:[\w.\-]*[A-Za-z0-9])?(?: [A-Za-z0-9][\w.\-]*){{0,4}}?)[ ]?(?P<close>(?<!_){MARK}{{1,3}}[a-z]?|__)|(?P<blank>_{{4,}}))(?!\w)"
)
FORM_SHARE = 0.8  # of the records with a form, those in which it holds a variable name or blank
CODE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|``.+?``|`[^`\n]*`")
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|« [^»\n]* »")
COMMENT = re.compile(r"(?s)<!--.*?-->")
EMPTY_VALUE = re.compile(r"^[\W_]*(?:none yet|n/?a|tbd|todo|tba|\?+|-+|_+|\.{3,}|xxx+|none|aucun|keine|ninguno|noch nichts|à compléter|pendiente)?[\W_]*$", re.I)
# Lines that ask for a number or name still to be given.
ASKED = re.compile(r"^(?:fixes|closes|refs?|resolves|see|related to)?\s*#?\((?:ticket|issue|number|id|name|link)\)$", re.I)
LABEL = re.compile(r"^\s*(?:[-*]\s+)?(?:\*\*)?([A-Z][\w /'-]{0,30}?)(?:\*\*)?\s*:\s*(?:\*\*)?\s*(.*)$")
# Phrases that stand in for a text still to come.
STAND_INS = re.compile(
    r"^(?:(?:your |the )?(?:content|text|copy|description|title) (?:goes |comes )?here|(?:content|more|text|page) coming soon|coming soon|"
    r"sample (?:text|content|paragraph)|dummy (?:text|content|paragraph)|placeholder(?: text| content)?|text goes here|insert text here|"
    r"beispieltext|mustertext|blindtext|platzhalter(?:text)?|texte d'exemple|texte factice|texto de ejemplo|texto de relleno|"
    r"asdf|jkl|qwer|qwerty|hjkl|foo|bar|baz|bla|blah|test|xxx|tbd|todo|tba)$", re.I,
)



# Every stand-in begins with one of these words.
STAND_IN_WORDS = set(
    """your the content text copy description title more page coming sample dummy placeholder insert beispieltext mustertext blindtext
    platzhalter platzhaltertext texte texto asdf jkl qwer qwerty hjkl foo bar baz bla blah test xxx tbd todo tba""".split()
)


def stands_in(phrase: str) -> bool:
    """Whether a phrase, numbers aside, is nothing but stand-ins, said once or more, or one phrase over and over."""
    first = phrase.split(None, 1)[0] if phrase.strip() else ""
    if not first or not (first.lower() in STAND_IN_WORDS or first.isdigit() or phrase.count(first) > 1):
        return False
    words = phrase.split()
    if words[0].lower() in STAND_IN_WORDS or words[0].isdigit():
        words = [w for w in words if not w.isdigit()]
        if words and words[0].lower() in STAND_IN_WORDS and all(STAND_INS.match(" ".join(p)) for p in _pieces(words)):
            return True
    # the first word of a phrase said again comes again
    return words[1:].count(words[0]) > 0 and says_again([w for w in words if not w.isdigit()]) if words else False


def says_again(words: list[str]) -> bool:
    """Whether four or more words are one phrase said at least twice."""
    n = len(words)
    return n >= 4 and any(n % k == 0 and words == words[:k] * (n // k) for k in range(1, n // 2 + 1))


def _pieces(words: list[str]) -> list[list[str]]:
    """The phrase cut into its repeated period, or into words if it has none."""
    for n in range(1, len(words) + 1):
        if len(words) % n == 0 and words == words[:n] * (len(words) // n) and STAND_INS.match(" ".join(words[:n])):
            return [words[:n]]
    return [[w] for w in words]


STATUS = (
    r"(?:bad request|unauthori[sz]ed|forbidden|(?:page |file |document )?not found|method not allowed|request timeout|gone|too many requests|"
    r"internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
)
# What error pages and script notices say, by language.
ERROR = re.compile(
    rf"^(?:http )?(?:error |code )?[45]\d\d\s*[-:–|]?\s*{STATUS}|^(?:error|fehler|erreur)\s+[45]\d\d\b|^{STATUS}$|^(?:the )?page not found|^this (?:page|site|document|content) (?:isn't|is not|is no longer) available|"
    r"^(?:the )?link may be broken|^access (?:to \S+ )?(?:is |was )?denied|^you (?:do not|don't) have (?:the )?permission|^oops\b|^something went wrong|"
    r"^your session (?:has |was )?(?:ended|expired|timed out)|^you have sent too many requests|^(?:too many|rate limit)|^the requested (?:url|page|resource)\b|^(?:an )?(?:unexpected|internal) error (?:has )?occurred|"
    r"^we couldn't find|^please (?:reload|try again|come back) (?:in|later)|^we have been told about it|^wait \d+ seconds|^sign in again|^go back to the (?:start|home)|^try again (?:in|later)|"
    r"^(?:seite|page|página) (?:nicht gefunden|introuvable|no encontrada)|^(?:das dokument|le document|el documento) .{1,40}(?:verschoben|gelöscht|déplacé|supprimé|movido|borrado)|"
    r"^(?:zugriff verweigert|accès (?:refusé|interdit)|acceso denegado)|^(?:ihre sitzung|votre session|su sesión)\b|"
    r"^(?:you need to |please |you must )?(?:enable|turn on|activate|allow|switch on) (?:java ?script|scripts|cookies|active content)|^(?:you need to|please|you must) (?:enable|turn on|activate|allow) .{0,20}(?:java ?script|scripts|cookies)|"
    r"^(?:sorry, ?)?.{1,40} (?:can't|cannot) be (?:shown|displayed) because (?:java ?script|scripts)|^.{1,40} works best with (?:scripts|java ?script)|^(?:java ?script|scripts?) (?:is|are|must be) (?:disabled|required|turned off|enabled)|"
    r"^if nothing happens, allow|^checking your browser|^your browser is too old|^update it or allow active content|^switch them on in your browser|^this takes a few seconds; scripts|^loading .{1,40}\.\.\.$|"
    r"^(?:bitte|veuillez|por favor,?) .{0,30}(?:java ?script|skripte|scripts?)|^(?:active|habilite|permita|activez|autorisez) .{0,20}(?:java ?script|scripts?)|^.{1,40} (?:a besoin d|necesita |benötigt |braucht |nécessite |requiere ).{0,20}(?:scripts?|skripte|java ?script)|"
    r"^(?:<!doctype html>|<html).*(?:[45]\d\d|error|not found|denied|unavailable)|^\{\s*\"?error\"?\s*:|^<error>|^<\?xml.*<error>", re.I,
)
FURNITURE = re.compile(
    r"^(?:\(c\)|©|copyright)\s*\d{4}\b.{0,40}$|^(?:\w+ \| ){1,6}\w+(?: \w+)?$|^(?:menu|home|search|sign in|log in)$|^#\s?\d+$|^(?:request|ref(?:erence)?|trace|incident)(?: id)?:?\s*\(?[0-9a-f-]{4,}\)?$|"
    r"^server at \S+(?: port \d+)?$|^\(?ref \w+\)?$|^\d+$|^[-*_=]{3,}$|^https?://\S+$", re.I,
)
WEAK = r"(?i)\b(?:java ?script|scripts?|skripte|cookies|browser|error|fehler|erreur|denied|forbidden|not found|unavailable|available|permission|session|reload|refresh|expired|introuvable|gefunden|encontrada|gateway|requests)\b"

WEAK_WORDS = re.compile(WEAK)
# Every such word holds one of these.
WEAK_STEMS = "script skripte cookie browser error fehler erreur denied forbidden found available permission session reload refresh expired introuvable gefunden encontrada gateway requests".split()


def without_slots(text: str) -> str:
    return SLOT.sub("", text) if any(c in text for c in SLOT_MARKS) else text


DIGIT, NUMBER = re.compile(r"\d"), re.compile(r"[0-9a-f]*\d[0-9a-f]*")
HAS_MARK = re.compile(rf"{MARK}|__")
SENTENCE_END, BLANK_LINE = re.compile(r"(?<=[.!?。])\s+"), re.compile(r"\n\s*\n")
HEADING, BOX, RULE, BULLET = re.compile(r"^#{1,6}\s"), re.compile(r"^[-*]\s+\[ \]"), re.compile(r"^\|[\s:|-]+\|?$"), re.compile(r"^[-*]\s+\w+$")
LETTERS, SEPARATORS, PUNCTUATION = re.compile(r"[^\W\d_]+"), re.compile(r"[\W_]+"), re.compile(r"\W+")


def normal(unit: str) -> str:
    low = unit.lower()
    return " ".join((NUMBER.sub("0", low) if DIGIT.search(low) else low).split())


def candidates(unit: str) -> tuple[str, str, list[tuple[str, str]]]:
    """The unit without what stands between marks, that filling, and (form, name) of each piece of it."""
    found = [m for m in DELIMITED.finditer(unit)] if HAS_MARK.search(unit) else []
    if not found:
        return normal(unit), "", []
    bare = normal(DELIMITED.sub(" ", unit))
    forms = [("____", "") if m["blank"] else (f"{m['open']}…{m['close']}", m["name"]) for m in found]
    return bare, normal(" ".join(m[0] for m in found)), forms


def alignable(text: str) -> tuple[list[tuple[str, str]], list[dict]]:
    """The distinct units of a text as (bare, filling), and (bare, form, name, snake) of every candidate."""
    units: dict[tuple[str, str], None] = {}
    slots = {}
    for line in text.splitlines():
        for s in sentences(line):
            bare, filling, forms = candidates(s)
            units[bare, filling] = None
            for form, name in forms:
                plain = SEPARATORS.sub(" ", name).strip().lower()
                slots[bare, form, plain] = {"bare": bare, "form": form, "name": plain, "snake": "_" in name.strip("_")}
    return list(units), list(slots.values())


def sentences(line: str) -> list[str]:
    return [s for s in SENTENCE_END.split(line.strip()) if s]


def without_quotes(text: str) -> str:
    if any(q in text for q in '"“„«'):
        return QUOTED.sub(lambda m: m[0] if m[0].startswith('"') and SLOT.fullmatch(m[0][1:-1]) else " \x00 ", text)
    return text


def without_code(text: str) -> str:
    if "<!--" in text:
        text = COMMENT.sub(" ", text)
    return CODE.sub(" \x00 ", text) if "`" in text or "~~~" in text else text


def unit_kinds(text: str | None) -> list[tuple[str, str]]:
    """(kind, unit) of every unit of a text, in order."""
    if text is None or not text.strip():
        return []
    out: list[tuple[str, str]] = []
    comments = len(COMMENT.findall(text)) if "<!--" in text else 0
    plain = without_code(text)
    loose = without_quotes(plain)
    if any(c in loose for c in SLOT_MARKS) and (slot := SLOT.search(loose)):
        out.append(("slot", slot[0]))
    out += [("blank", "<!-- -->")] * comments
    for block in BLANK_LINE.split(plain):
        words = LETTERS.findall(block.lower())
        if len(words) >= 5 and sum(w in LATIN for w in words) >= 0.8 * len(words) and sum(w in LATIN for w in set(words)) >= 4:
            out.append(("latin", block[:40]))
            continue
        for line in block.splitlines():
            line = line.strip()
            if not line or line in ("---", "\x00"):
                if line == "\x00":
                    out.append(("text", "code"))
                continue
            if HEADING.match(line):
                out.append(("heading", line.lower()))
            elif BOX.match(line):
                out.append(("blank", line.lower()))
            elif RULE.match(line):
                continue
            elif line.startswith("|") and line.endswith("|"):
                cells = [c.strip() for c in line.strip("|").split("|")]
                values = cells[1:]
                empty = values and all(EMPTY_VALUE.match(without_slots(v)) for v in values)
                out.append(("blank" if empty else "heading" if cells[-1].lower() in ("value", "wert", "valeur", "valor") else "text", line.lower()))
            elif stands_in(line.lower().strip(" .!?-*_")):
                out.append(("filler", line))
            elif EMPTY_VALUE.match(without_slots(line)) or ASKED.match(line):
                out.append(("blank", line.lower()))
            elif ":" in line and (m := LABEL.match(line)) and EMPTY_VALUE.match(without_slots(m[2])):
                out.append(("label", m[1].lower()))
            elif ERROR.match(line) and "\x00" not in line:
                rest = sentences(line)
                out += [("error" if ERROR.match(s) else "furniture" if FURNITURE.match(s.strip(".")) else "text", s) for s in rest]
            else:
                for s in sentences(line):
                    bare = s.strip(" .!?-*\"'").strip()
                    kind = "text"
                    if "\x00" in s:
                        kind = "text"
                    elif stands_in(bare.lower()):
                        kind = "filler"
                    elif ERROR.match(s):
                        kind = "error"
                    elif FURNITURE.match(s.strip(" .")) or BULLET.match(line):
                        kind = "furniture"
                    out.append((kind, s))
    return out


def _record(text: str | None) -> tuple:
    kinds = unit_kinds(text)
    units, slots = alignable(without_quotes(without_code(text))) if text else ([], [])
    names = [k for k, _ in kinds]
    solid = [u for k, u in kinds if k == "text"]
    whole = "\x00" not in " ".join(solid) and "code" not in solid
    # a page of failures has no code or quotes, and a good part of its units say so
    talk = [(k, u) for k, u in kinds if k in ("text", "error")]
    low = (text or "").lower()
    weak = any(w in low for w in WEAK_STEMS)
    n_failing = sum(k == "error" or (weak and WEAK_WORDS.search(u) is not None) for k, u in talk)
    page = bool(talk) and whole and n_failing >= FAILING * len(talk)
    # a phrase said three times or more is on trial as filler
    said: dict[str, int] = {}
    for u in solid:
        key = PUNCTUATION.sub(" ", u.lower()).strip()
        if DIGIT.search(key):
            key = " ".join(w for w in key.split() if not w.isdigit())
        said[key] = said.get(key, 0) + 1
    echo = [k for k, n in said.items() if n >= 3 and k and 3 * n * 10 >= 8 * 3 * len(solid)]
    return (
        "slot" in names, "latin" in names, len(solid), names.count("error"), names.count("filler"), names.count("blank"),
        names.count("heading"), [u for k, u in kinds if k == "label"], [{"unit": u, "n": n, "notice": k == "error"} for (k, u), n in Counter(talk).items()] if page else [],
        [k for k in said if k], [n for k, n in said.items() if k], echo, slots, [u[0] for u in units], [u[1] for u in units],
    )


RECORD = (
    "slot boolean, latin boolean, n_text int, n_error int, n_filler int, n_blank int, n_heading int, labels array<string>, open array<struct<unit:string,n:int,notice:boolean>>, phrases array<string>, times array<int>, echo array<string>, "
    "slots array<struct<bare:string,form:string,name:string,snake:boolean>>, bares array<string>, fillings array<string>"
)
COLUMNS = "slot latin n_text n_error n_filler n_blank n_heading labels open phrases times echo slots bares fillings".split()


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = COLUMNS
    for pdf in batches:
        rows = [_record(t) for t in pdf["text"]]
        out = pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({c: [] for c in names})
        out.insert(0, "key", pdf["key"].to_numpy())
        yield out


def open_slots(seen: DataFrame, counted: DataFrame, scratch: Scratch) -> DataFrame:
    """key of every record with a variable name or blank in a slot form that the alignment of all units induces."""
    found = scratch.save(seen.where(F.size("slots") > 0).select("key", F.explode("slots").alias("s")).select("key", "s.*").join(counted, "key"), "slots")
    # names of variables: those written with underscores, and those between several kinds of marks
    by_form = found.where("name <> ''").groupBy("name", "form").agg(F.max("snake").alias("snake"))
    names = by_form.groupBy("name").agg(F.max("snake").alias("snake"), F.count(F.lit(1)).alias("n")).where(F.col("snake") | (F.col("n") >= FORMS)).select("name")
    names = scratch.save(names, "names")
    # a default may say more than the name ("your title here"), so every run of its words is looked up
    w = F.split("name", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.concat_ws(" ", F.slice(w, i, k)))))
    whole = found.select("name").where("name <> ''").distinct().select(F.col("name").alias("whole"), F.explode(runs).alias("name"))
    variables = whole.join(names, "name", "left_semi").select(F.col("whole").alias("name"), F.lit(True).alias("known")).distinct()
    found = found.join(variables, "name", "left").withColumn("variable", F.coalesce("known", F.lit(False)) | (F.col("name") == "")).drop("known")

    # alignment: units of all records that are the same but for what stands between marks
    bares = found.where("variable and bare <> ''").select("bare").distinct()
    units = seen.select("key", F.explode(F.arrays_zip("bares", "fillings")).alias("u")).select("key", F.col("u.bares").alias("bare"), F.col("u.fillings").alias("filling")).join(bares, "bare", "left_semi").join(counted, "key")
    per_record = units.groupBy("bare", "key").agg(F.first("copies").alias("copies"), F.min("filling").alias("a"), F.max("filling").alias("z"))
    templates = per_record.groupBy("bare").agg(F.sum("copies").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))
    templates = templates.where((F.col("n") >= SUPPORT) & (F.col("a") != F.col("z"))).select("bare", F.lit(True).alias("aligned"))

    held = found.join(templates, "bare", "left").groupBy("form", "key").agg(
        F.first("copies").alias("copies"), F.max("variable").alias("variable"), F.max(F.col("variable") & F.col("aligned").isNotNull()).alias("aligned")
    )
    forms = held.groupBy("form").agg(
        F.sum(F.when(F.col("aligned"), F.col("copies"))).alias("n"), F.sum(F.when(F.col("variable"), F.col("copies"))).alias("n_variable"), F.sum("copies").alias("n_all")
    )
    forms = forms.where((F.col("n") >= SUPPORT) & (F.col("n_variable") >= FORM_SHARE * F.col("n_all"))).select("form")
    return found.where("variable").join(forms, "form", "left_semi").select("key").distinct()


def error_pages(seen: DataFrame, counted: DataFrame, scratch: Scratch) -> DataFrame:
    """key, n_aligned, n_failing: how many units of a page are templates', and how many of those speak of failures."""
    units = seen.select("key", F.posexplode("open").alias("at", "u")).select(
        "key", "at", F.col("u.n").alias("times"), "u.notice", F.trim(F.regexp_replace(F.regexp_replace(F.lower("u.unit"), r"[0-9a-f]*\d[0-9a-f]*", "0"), r"\s+", " ")).alias("unit")
    )
    w = F.split("unit", " ")
    n = F.size(w)
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(n - 1, F.lit(3))),
            lambda k: F.transform(
                F.sequence(F.lit(1), n - k + 1),
                lambda i: F.struct(
                    F.concat_ws(" ", F.slice(w, 1, i - 1), F.lit("…"), F.slice(w, i + k, n)).alias("frame"),
                    F.concat_ws(" ", F.slice(w, i, k)).alias("filling"),
                ),
            ),
        )
    )
    itself = F.array(F.struct(F.col("unit").alias("frame"), F.lit("").alias("filling")))
    every = F.when(n >= 3, F.concat(itself, spans)).otherwise(itself)
    framed = units.where("unit <> ''").select("key", "at", "times", "notice", F.explode(every).alias("s")).select("key", "at", "times", "notice", "s.frame", "s.filling")
    framed = scratch.save(framed, "frames")
    # a unit as it is has to come in several texts, not only in copies of one
    masked = F.col("frame").contains("…") & (F.col("a") != F.col("z"))
    templates = (
        framed.join(counted, "key")
        .groupBy("frame", "key")
        .agg(F.first("copies").alias("copies"), F.min("filling").alias("a"), F.max("filling").alias("z"))
        .groupBy("frame")
        .agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("n_texts"), F.min("a").alias("a"), F.max("z").alias("z"))
        .where(((F.col("n") >= SUPPORT) & masked) | ((F.col("n_texts") >= SUPPORT) & ~F.col("frame").contains("…")))
        .select("frame", F.col("frame").rlike(WEAK).alias("failing"))
    )
    aligned = framed.join(templates, "frame").groupBy("key", "at").agg(F.first("times").alias("times"), F.max(F.col("failing") | F.col("notice")).alias("failing"))
    return aligned.groupBy("key").agg(F.sum("times").alias("n_aligned"), F.sum(F.when(F.col("failing"), F.col("times")).otherwise(0)).alias("n_failing"))


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, why: the records that are residue, once each. why: open slot, filler, unfilled form, error page."""
    scratch = Scratch(df.sparkSession, "residue")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    rows = rows.withColumn("key", F.sha2("text", 256))
    scratch_ids = rows.select("id", "key")
    # copies of a text are read once
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.countDistinct("id").alias("copies"))
    seen = scratch.save(texts.select("key", "text").mapInPandas(_records, f"key string, {RECORD}"), "records")
    counted = texts.select("key", "copies")

    # labels: a form line if the label is a form's in several records
    labels = seen.select("key", F.explode("labels").alias("label")).distinct()
    forms = labels.join(counted, "key").groupBy("label").agg(F.sum("copies").alias("n")).where(F.col("n") >= SUPPORT).select("label")
    form_lines = labels.join(forms, "label").groupBy("key").agg(F.count(F.lit(1)).alias("n_form"))
    n_labels = seen.select("key", F.size(F.array_distinct("labels")).alias("n_labels"))

    # phrases that echo within records
    echoes = seen.select(F.explode("echo").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("phrase")

    aligned = error_pages(seen, counted, scratch)
    said = seen.select("key", F.explode(F.arrays_zip("phrases", "times")).alias("s")).select("key", F.col("s.phrases").alias("phrase"), F.col("s.times").alias("n"))
    repeated = said.join(echoes, "phrase", "left_semi").groupBy("key").agg(F.sum("n").alias("n_echoed"))

    induced = open_slots(seen, counted, scratch).withColumn("induced", F.lit(True))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (
        seen.join(form_lines, "key", "left").join(n_labels, "key", "left").join(aligned, "key", "left").join(repeated, "key", "left").join(induced, "key", "left")
        .withColumn(
            "why",
            F.when(F.col("slot") | F.col("induced"), F.lit("open slot"))
            .when(F.col("latin") | ((F.col("n_filler") > 0) & (F.col("n_text") == zero("n_echoed"))), F.lit("filler"))
            .when((F.size("echo") > 0) & (F.col("n_text") == zero("n_echoed")), F.lit("filler"))
            .when((zero("n_echoed") > 0) & (zero("n_echoed") == F.col("n_text")) & (F.col("n_error") == 0), F.lit("filler"))
            .when((F.col("n_text") == 0) & (zero("n_form") + F.col("n_blank") >= 2) & (zero("n_form") == F.col("n_labels")) & (F.col("n_error") == 0), F.lit("unfilled form"))
            .when((F.size("open") > 0) & (zero("n_aligned") == F.col("n_text") + F.col("n_error")) & (zero("n_failing") * 2 >= zero("n_aligned")), F.lit("error page"))
            .when((F.col("n_error") > 0) & (F.col("n_text") == 0), F.lit("error page")),
        )
        .where("why is not null")
        .select("key", "why")
    )
    return scratch_ids.distinct().join(verdict, "key").select("id", "why").groupBy("id").agg(F.min("why").alias("why"))
