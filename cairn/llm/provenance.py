"""Files that were not written by hand where they lie: generated, minified, vendored, bulk data.

Four linear support-vector classifiers work on hashed character n-grams of the text and on path components. Their labels
come from giveaways (a tool's notice in a comment, a known library's hash, a shipping name, a table of literals); notices
and telling names and folders are masked before the features are taken, so that a classifier learns what such files look
like without them. Repositories are split by hash: the classifiers are fitted on three fifths, their two thresholds are
chosen on another fifth and their precision and recall are reported on the last. The fitting rows come from a bounded
sample of the files (SAMPLE_FILES, FIT_ROWS); then every file is read once for its margins and its giveaways.

Only a classifier names a file: above its upper threshold its word is enough, between the two thresholds an exact giveaway
must bear it out. The lower one lets all labelled files of the repositories it is chosen on pass. Where a file comes from
can't be told by its looks for certain (BY_LOOKS), so third-party files always need a giveaway besides.

Defined results: null content, empty and comment-only files are no cases; CR LF counts as LF; a text of any length is
read whole; copies get the same n-grams and may differ by path only; twice-delivered rows count once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import Scratch

HEADS = ["generated", "minified", "vendored", "data"]
TEXT_BINS, PATH_BINS = 1 << 15, 1 << 12
SAMPLE_FILES = 20_000  # bound (in expectation) of the files that fitting rows are taken from
FIT_ROWS = 1000  # bound of the positive rows of each classifier, and of its negative rows per 1
NEGATIVES = 3  # negative rows for each allowed positive one
GRAM = 5
COST = 0.5
EPOCHS = 12
UNSURE = -0.6  # margin from which an unlabelled row isn't used as a negative
BY_LOOKS = ["generated", "minified", "data"]  # heads whose classifier needs no giveaway above its upper threshold
SLACK = 0.5  # how far the lower threshold lies below the lowest margin of a labelled file there
# The notices of tools, in a comment, by language.
NOTICE = re.compile(
    r"(?im)^[ \t]*(?://+|#+|/\*+!?|\*+|--|;+|<!--)[ \t]*(?!.*\b(?:not|no longer|isn't|never)\b.{0,20}generated)(?!.*\bmethod stub\b)(?:.*@generated\b|.*\bdo not (?:edit|modify)\b|(?:this (?:file|code) (?:is|was|has been) )?(?:auto-?generated|automatically generated|machine[- ](?:made|generated))\b|"
    r"(?:code |file |source )?generated (?:by|with|from|using) \S+|end of generated (?:section|code|file)|<auto-?generated|</auto-?generated|.*\bproduced (?:automatically|by the (?:protocol buffer )?compiler)\b|.*\boverwritten (?:by|on|at|with) (?:every|each|the next) build\b|built from \S+\.(?:idl|proto|thrift|xsd|wsdl|y|g4)\b|"
    r".*\b(?:généré|auto-généré)e? (?:par|avec|automatiquement)\b|.*\bne pas (?:modifier|éditer)\b|.*\b(?:generiert|erzeugt) (?:von|mit|aus|durch)\b|.*\bnicht (?:ändern|bearbeiten|editieren)\b|.*\bgenerado (?:por|con|automáticamente)\b|.*\bno (?:editar|modificar)\b).*$"
)
GENERATED_PLACE = re.compile(r"(?i)/(?:__generated__|generated|autogen|auto-?generated|gen)/")
UPSTREAM = re.compile(
    r"(?im)^[ \t]*(?://+|#+|/\*+!?|\*+)[ \t]*(?:.*\bupstream\s*:\s*\S+.*|[\w.-]+ v?\d+\.\d+(?:\.\d+)*,? (?:\(c\)|©|copyright) .*|(?:bundled|vendored|third[- ]party|verbatim|unmodified|local) copy of \S+.*|(?:vendored|copied|imported|taken) (?:in )?(?:from|by) (?:https?://|the )?\S+.*(?:\d+\.\d+|upstream|https?://).*|.*\bsee upstream for changes.*|.*originally (?:from|part of) \S+ (?:v?\d+\.\d+).*)$"
)
SHIPPED = re.compile(r"(?im)^[ \t]*(?:/\*!.*|//[#@] sourceMappingURL=.*|/\*[#@] sourceMappingURL=.*)$")
SHIPPED_NAME = re.compile(r"(?i)(?:[._-]min|\.bundle|\.chunk|-bundle)\.(?:js|mjs|cjs|css)$|\.[0-9a-f]{6,}\.(?:js|mjs|css)$")
GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?|\.pb|\.g|\.designer|\.generated|_generated|\.gen)\.\w+$")
FOREIGN_PLACE = re.compile(r"(?i)/(?:third[_-]?party|node_modules|bower_components|vendored|pods|externals?|extern|deps|libs/ext|(?<=/)vendors?)/[^/]+/(?:.*/)?[^/]+$")
COMMENT = re.compile(r"(?s)/\*.*?\*/|//[^\n]*|(?m:^\s*#[^\n]*)|\"\"\".*?\"\"\"|'''.*?'''|<!--.*?-->")
TOP = re.compile(r"\A﻿?(?:[ \t]*(?://|#(?!include|!)|--)[^\n]*\n|[ \t]*/\*(?:[^*]|\*(?!/))*+\*/[ \t]*\n|\s*\n)+")
BLOB = re.compile(r"[\"'`][A-Za-z0-9+/=_-]{200,}[\"'`]")
LITERALS = re.compile(r"^\s*(?:[\[({]\s*)?(?:(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')\s*(?:[,;:]\s*|=>\s*|$|(?=[\])}])))+(?:[\])}]\s*[,;]?\s*)*$")


# A notice holds at least one of these words, so texts without any needn't be searched line by line.
NOTICE_WORDS = ("generat", "do not edit", "do not modify", "machine-made", "machine made", "produced", "overwritten", "built from", "généré", "modifier", "éditer", "generier", "erzeugt", "ändern", "bearbeiten", "editieren", "generado", "editar", "modificar")
UPSTREAM_WORDS = ("upstream", "copy of", "vendored", "copied", "imported", "taken", "originally", "(c)", "©", "copyright")
SHIPPED_WORDS = ("/*!", "sourcemappingurl")


def _holds(low: str, words: tuple[str, ...]) -> bool:
    return any(w in low for w in words)


def first_party_vendor(path: str) -> bool:
    return re.search(r"(?i)^[^/]+/(?:src|source|main|java|org)/(?:.*/)?vendors?/[^/]+$", path) is not None


def content_hashes(text: str) -> list[str]:
    """sha1 of the text with LF line ends, and of what lies below the notices and licence notes on top."""
    lf = text.replace("\r\n", "\n")
    topless = TOP.sub("", lf, count=1)
    return sorted({hashlib.sha1(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (lf, topless, topless.lstrip())})


LITERAL_BEGINS = set("[({\"'+-0123456789")


def notices(lf: str) -> list[re.Pattern]:
    """The patterns of notices that the text holds the words of."""
    low = lf.lower()
    return [p for p, words in ((NOTICE, NOTICE_WORDS), (UPSTREAM, UPSTREAM_WORDS), (SHIPPED, SHIPPED_WORDS)) if _holds(low, words) and p.search(lf)]


def evidence(path: str, text: str, found: list[re.Pattern] | None = None) -> tuple[bool, list[bool]]:
    """Whether there is code at all, and the giveaways of each kind. found: the text's notices, if known."""
    lf = text.replace("\r\n", "\n")
    bare = COMMENT.sub(" ", lf)
    code = bool(bare.strip(" \n\t﻿"))
    lines = [x for x in bare.split("\n") if x.strip()]
    size = sum(map(len, lines)) or 1
    rows = [x for x in lines if x.lstrip()[0] in LITERAL_BEGINS and LITERALS.match(x)]
    literal = sum(map(len, rows))
    literal += sum(len(m) for x in lines if len(x) > 200 and not LITERALS.match(x) for m in BLOB.findall(x))
    found = notices(lf) if found is None else found
    notice, upstream, shipped = NOTICE in found, UPSTREAM in found, SHIPPED in found
    place = FOREIGN_PLACE.search(path) is not None and not first_party_vendor(path)
    return code, [
        notice or GENERATED_NAME.search(path) is not None or GENERATED_PLACE.search(path) is not None,
        SHIPPED_NAME.search(path) is not None or (shipped and max(map(len, lines), default=0) > 500),
        place or upstream,
        size >= 1500 and literal >= 0.9 * size,
    ]


def masked(text: str, found: list[re.Pattern] | None = None) -> str:
    """The text without the notices that the labels were taken from."""
    lf = text.replace("\r\n", "\n")
    for pattern in notices(lf) if found is None else found:
        lf = pattern.sub(" ", lf)
    return lf


def masked_path(path: str) -> str:
    """The path without the names and folders that the labels were taken from."""
    path = GENERATED_PLACE.sub("/", path)
    m = FOREIGN_PLACE.search(path)
    if m and not first_party_vendor(path):
        path = path[: m.start()] + path[path.index("/", m.start() + 1) :]
    name = SHIPPED_NAME.search(path) or GENERATED_NAME.search(path)
    return path[: name.start()] + path[path.rindex(".") :] if name else path


def _path_words(path: str) -> list[str]:
    parts = masked_path(path).lower().split("/")[1:]  # the repository's own name is no evidence
    if not parts:
        return []
    folders, name = parts[:-1], parts[-1]
    words = [f"d:{p}" for p in folders] + [f"^{p}" for p in folders[:1]] + [f"{a}/{b}" for a, b in zip(folders, folders[1:])]
    pieces = re.split(r"[._-]+", name)
    return words + [f"n:{'.'.join(pieces[-k:])}" for k in (1, 2) if len(pieces) > k] + [f"depth:{len(folders)}"]


_FOLD = bytes.maketrans(b"123456789\t", b"000000000 ")


def features(path: str, text: str, found: list[re.Pattern] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the hashed features; the text's part and the path's part have length one each."""
    b = np.frombuffer(masked(text, found).encode("utf-8", "replace").translate(_FOLD), np.uint8)
    if len(b):
        blank = b == 32
        b = b[~(blank & np.concatenate([[False], blank[:-1]]))]  # runs of blanks count as one
    b = b.astype(np.uint32)
    if len(b) >= GRAM:
        h = np.zeros(len(b) - GRAM + 1, np.uint32)
        for k in range(GRAM):
            h = (h ^ b[k : len(b) - GRAM + 1 + k]) * np.uint32(16777619)
        h = np.sort(((h ^ (h >> np.uint32(15))) & np.uint32(TEXT_BINS - 1)).astype(np.uint16))
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]), len(h) - 1)
        at = h[ends].astype(np.int64)
        values = np.log1p(np.diff(ends, prepend=-1))
        values = values / (np.linalg.norm(values) or 1)
    else:
        at, values = np.empty(0, np.int64), np.empty(0)
    words = sorted({TEXT_BINS + zlib.crc32(w.encode()) % PATH_BINS for w in _path_words(path)})
    weight = 1 / np.sqrt(len(words)) if words else 0.0
    return np.concatenate([at, np.asarray(words, np.int64)]), np.concatenate([values, np.full(len(words), weight)])


def linear_svc(at: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, bins: int, cost: float, rounds: int = EPOCHS) -> np.ndarray:
    """Weights and bias of a linear support-vector classifier (squared hinge), by dual coordinate descent."""
    w, alpha = np.zeros(bins + 1), np.zeros(len(y))
    diagonal = 1 / (2 * cost * np.where(y > 0, max(1.0, (y < 0).sum() / max(1, (y > 0).sum())), 1.0))
    norm = np.asarray([v @ v + 1 for v in values]) + diagonal
    order = np.random.default_rng(5)
    active = np.arange(len(y))
    for turn in range(rounds):
        for i in order.permutation(active):
            a, v = at[i], values[i]
            gradient = y[i] * (w[a] @ v + w[bins]) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[a] += step * v
                w[bins] += step
        # rows that are no support vectors now are asked again every fourth turn only
        active = np.flatnonzero(alpha > 0) if turn % 4 else np.arange(len(y))
    return w


def _margins(w: np.ndarray, at: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    return np.asarray([w[a] @ v + w[-1] for a, v in zip(at, values)])


def _scores(said: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """F1, precision, recall."""
    hit = (said & y).sum()
    p, r = hit / max(1, said.sum()), hit / max(1, y.sum())
    return 2 * p * r / max(1e-9, p + r), float(p), float(r)


def _fit_head(rows: pd.DataFrame) -> pd.DataFrame:
    """One classifier on its bounded sample: fit, drop unlabelled rows that look like cases, fit again, choose thresholds."""
    bins = TEXT_BINS + PATH_BINS
    rows = rows.sort_values("path")
    at = [np.frombuffer(b, np.uint16).astype(np.int64) for b in rows["at"]]
    values = [np.frombuffer(b, np.float16).astype(np.float64) for b in rows["val"]]
    label, part = rows["label"].to_numpy(bool), rows["part"].to_numpy()
    out = {"head": rows["head"].iloc[0], "w": None, "lower": None, "upper": None, "precision": 0.0, "recall": 0.0, "n": int((part == 1).sum())}
    use = np.flatnonzero(part > 1)
    if label[use].any() and not label[use].all():
        pick = lambda idx: ([at[i] for i in idx], [values[i] for i in idx], np.where(label[idx], 1.0, -1.0))
        w = linear_svc(*pick(use), bins, COST)
        margin = _margins(w, at, values)
        use = use[label[use] | (margin[use] < UNSURE)]
        w = linear_svc(*pick(use), bins, COST)
        margin = _margins(w, at, values)
        chosen, told = part == 0, part == 1
        m, y = margin[chosen], label[chosen]
        upper, best = 0.0, (-1.0, 0.0, 0.0)
        for cut in (0.0, -0.1, 0.1, -0.2, 0.2, 0.3):
            got = _scores(m > cut, y)
            if got[0] > best[0] + 1e-9:
                upper, best = cut, got
        _, precision, recall = _scores(margin[told] > upper, label[told])
        lower = float(m[y].min()) - SLACK if y.any() else -np.inf
        out |= {"w": w.astype(np.float32).tobytes(), "lower": min(lower, upper), "upper": upper, "precision": precision, "recall": recall}
    return pd.DataFrame([out])


def _read(pdf: pd.DataFrame) -> tuple[list[tuple], list[tuple[np.ndarray, np.ndarray]]]:
    """The giveaways and the features of every file of a batch."""
    told, made = [], []
    for p, t in zip(pdf["path"], pdf["content"]):
        found = notices(t.replace("\r\n", "\n"))
        code, kinds = evidence(p, t, found)
        told.append((p, content_hashes(t), code, *kinds))
        made.append(features(p, t, found))
    return told, made


TOLD = ["path", "shas", "code", *HEADS]
TOLD_SCHEMA = "path string, shas array<string>, code boolean, " + ", ".join(f"{h} boolean" for h in HEADS)


def _sample_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        told, made = _read(pdf)
        out = pd.DataFrame(told, columns=TOLD)
        out["at"] = [a.astype(np.uint16).tobytes() for a, _ in made]
        out["val"] = [v.astype(np.float16).tobytes() for _, v in made]
        yield out


def with_copies(told: DataFrame, libraries: DataFrame) -> DataFrame:
    """A file with the hash of a known library's is vendored."""
    hashes = libraries.select(F.lower("file_hash").alias("sha")).where("sha is not null").distinct()
    known = told.select("path", F.explode("shas").alias("sha")).join(hashes, "sha", "left_semi").select(F.col("path").alias("kp")).distinct()
    return told.drop("shas").join(known, F.col("path") == F.col("kp"), "left").withColumn("vendored", F.col("vendored") | F.col("kp").isNotNull()).drop("kp")


def fit(texts: DataFrame, libraries: DataFrame, scratch: Scratch) -> dict[str, dict]:
    """Each head's weights and thresholds, and its precision and recall on repositories that had no part in either."""
    spread = 1_000_000
    share = min(1.0, SAMPLE_FILES / max(1, texts.count()))
    sampled = texts.where(F.pmod(F.xxhash64("path"), F.lit(spread)) < int(share * spread))
    sample = scratch.save(sampled.mapInPandas(_sample_rows, f"{TOLD_SCHEMA}, at binary, val binary").dropDuplicates(["path"]), "sample")
    seen = scratch.save(with_copies(sample.drop("at", "val"), libraries), "labels")
    order = F.xxhash64("path", F.lit(1))
    any_head = F.greatest(*[F.col(h).cast("int") for h in HEADS]) == 1
    picks = [seen.where(F.col(h)).orderBy(order).limit(FIT_ROWS) for h in HEADS]
    picks.append(seen.where(~any_head & F.col("code")).orderBy(order).limit(FIT_ROWS * NEGATIVES))
    picked = picks[0]
    for more in picks[1:]:
        picked = picked.unionByName(more)
    # at most FIT_ROWS * (NEGATIVES + 4) rows of a path and five flags
    rows = sample.select("path", "at", "val").join(F.broadcast(picked.distinct()), "path")
    part = F.pmod(F.xxhash64(F.substring_index("path", "/", 1)), F.lit(5)).cast("int")
    heads = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("label")) for h in HEADS]))
    long = rows.select("path", "at", "val", part.alias("part"), heads.alias("h")).select("path", "at", "val", "part", "h.head", "h.label")
    schema = "head string, w binary, lower double, upper double, precision double, recall double, n long"
    made = {r["head"]: r.asDict() for r in long.groupBy("head").applyInPandas(_fit_head, schema).collect()}  # four rows
    # with too few labelled repositories to learn from, a head goes by the giveaways
    unfit = {"w": None, "lower": -np.inf, "upper": np.inf, "precision": 0.0, "recall": 0.0, "n": 0}
    return {h: made[h] if h in made and made[h]["w"] is not None else unfit for h in HEADS}


def judge(sources: DataFrame, libraries: DataFrame) -> tuple[DataFrame, dict[str, dict]]:
    """path, kinds (array of the heads that say so) of every file, and the validation report."""
    scratch = Scratch(sources.sparkSession, "provenance")
    texts = sources.select("path", "content").where("content is not null and path is not null")
    heads = fit(texts, libraries, scratch)
    blank = np.zeros(TEXT_BINS + PATH_BINS + 1, np.float32)
    weights = np.stack([np.frombuffer(heads[h]["w"], np.float32) if heads[h]["w"] is not None else blank for h in HEADS])
    flat, bias = weights[:, :-1].T.copy(), weights[:, -1]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told, made = _read(pdf)
            out = pd.DataFrame(told, columns=TOLD)
            margin = np.asarray([values @ flat[at] + bias for at, values in made]).reshape(len(made), len(HEADS))
            for k, h in enumerate(HEADS):
                out[f"margin_{h}"] = margin[:, k]
            yield out

    margins = ", ".join(f"margin_{h} double" for h in HEADS)
    read = scratch.save(texts.mapInPandas(score, f"{TOLD_SCHEMA}, {margins}").dropDuplicates(["path"]), "read")
    seen = with_copies(read, libraries)

    def named(h: str) -> F.Column:
        margin = F.col(f"margin_{h}")
        enough = margin > F.lit(float(heads[h]["upper"])) if h in BY_LOOKS else F.lit(False)
        return enough | ((margin > F.lit(float(heads[h]["lower"]))) & F.col(h))

    kinds = F.filter(F.array(*[F.when(named(h), F.lit(h)) for h in HEADS]), lambda x: x.isNotNull())
    return seen.where("code").select("path", kinds.alias("kinds"), *HEADS, *[f"margin_{h}" for h in HEADS]), heads
