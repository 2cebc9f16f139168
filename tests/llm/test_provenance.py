import hashlib
import random

import pytest

from cairn.llm import provenance as pv

HAND = "import log\n\n\ndef {v}_{n}(items, limit=None):\n    # keep the order of items\n    seen = sorted(items)\n    while len(seen) > limit:\n        seen.pop()\n    return seen\n\n\ndef report(rows):\n    for row in rows:\n        log.info(row)\n"


def generated(rng):
    return "".join(f"def get_{a}_{b}(self):\n    return self._{a}_{b}\n\n\ndef set_{a}_{b}(self, value):\n    self._{a}_{b} = value\n\n\n" for a, b in [(rng.choice("abcdef") * 3, rng.choice("uvwxyz") * 4) for _ in range(8)])


@pytest.mark.parametrize(
    "path, text, kind",
    [
        ("r/a.py", "# Code generated by tool 1.2. DO NOT EDIT.\nx = 1\n", "generated"), ("r/a.js", "// @generated by tool\nf();\n", "generated"), ("r/x_pb2.py", "x = 1\n", "generated"),
        ("r/a.min.js", "f();\n", "minified"), ("r/third_party/lib/a.py", "x = 1\n", "vendored"), ("r/a.go", "// This file is part of lib. Upstream: https://x.invalid/lib @ 1.2\npackage a\n", "vendored"),
        ("r/t.py", "t = [\n" + "    1, 2, 0x3f, -4.5,\n" * 120 + "]\n", "data"), ("r/b.ts", "export const b = '" + "Ab9+" * 600 + "';\n", "data"),
    ],
)
def test_evidence(path, text, kind):
    code, kinds = pv.evidence(path, text)
    assert code and [h for h, k in zip(pv.HEADS, kinds) if k] == [kind]


@pytest.mark.parametrize(
    "path, text",
    [("r/src/vendor/a.py", "x = 1\n"), ("r/gen.py", "BANNER = 'Code generated by tool. DO NOT EDIT.'\n"), ("r/a.ts", "// NOTE: this one is not generated any more, edit freely.\nx();\n"), ("r/a.rb", "# Auto-generated method stub\ndef a\nend\n"), ("r/a.py", "# Copyright 2026 the r authors.\nx = 1\n")],
)
def test_no_evidence(path, text):
    assert pv.evidence(path, text) == (True, [False] * 4)


def test_hashes_and_masks():
    body = "x = 1\ny = 2\n"
    sha = hashlib.sha1(body.encode()).hexdigest()
    for text in (body, body.replace("\n", "\r\n"), "# a note\n\n" + body):
        assert sha in pv.content_hashes(text)
    assert "generated" not in pv.masked("# Code generated by tool. DO NOT EDIT.\nx = 1\n")
    assert pv.evidence("r/a.py", "# only a comment\n")[0] is False


def test_learned_without_notices(spark):
    rng = random.Random(4)
    rows = []
    for i in range(360):
        repo = f"repo{rng.randrange(24)}"
        if i % 6 == 0:
            notice = "# Code generated by tool. DO NOT EDIT.\n" if rng.random() < 0.7 else ""
            rows.append((f"{repo}/src/m{i}.py", notice + generated(rng)))
        else:
            rows.append((f"{repo}/src/h{i}.py", HAND.format(v=rng.choice(["rank", "load", "sweep"]), n=i)))
    rows += [("repo0/e.py", ""), ("repo0/n.py", None), ("repo0/c.py", "# nothing here\n"), rows[0], ("repo1/copy.py", "z = 26\n")]
    sources = spark.createDataFrame([(p, t, "k") for p, t in rows], "path string, content string, kinds string")
    libraries = spark.createDataFrame([(hashlib.sha1(b"z = 26\n").hexdigest(),), (None,)], "file_hash string")
    judged, report = pv.judge(sources, libraries)
    got = {r["path"]: r["kinds"] for r in judged.where("size(kinds) > 0").collect()}
    want = {p for p, t in rows if t and "/m" in p}
    assert {p for p, k in got.items() if "generated" in k} == want
    assert got["repo1/copy.py"] == ["vendored"]
    assert report["generated"]["recall"] > 0.9


def test_empty(spark):
    judged, _ = pv.judge(spark.createDataFrame([], "path string, content string"), spark.createDataFrame([], "file_hash string"))
    assert judged.count() == 0


def test_notices_and_tops_of_any_length():
    from cairn.llm.provenance import content_hashes, evidence

    body = "int f(int a) { return a; }\n" * 200
    licence = "/*\n" + " * Permission is hereby granted to any person who has a copy of this text.\n" * 80 + " */\n"
    assert set(content_hashes(licence + body)) & set(content_hashes(body))
    assert evidence("r/src/a.c", body + "// upstream: https://example.invalid/a 1.2\n" + body)[1][2]
    assert evidence("r/src/a.c", licence + "// Code generated by protoc. DO NOT EDIT.\n" + body)[1][0]
    assert not any(evidence("r/src/a.c", licence + body)[1])
