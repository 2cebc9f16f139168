import ast
from pathlib import Path

import pytest

from cairn.llm import parsing
from cairn.llm.grammar import Grammar, Tables

VALID = {
    "python": "import a.b as c\nfrom . import (d, e as f,)\n\n@g(1)\nasync def h(x: int = 1, *y, z=None, **k) -> str:\n    '''Doc\n  text'''\n    with a as b, c:\n        return [i for i in x if i and not y] or {**k, 'a': 1} if x else (yield)\n\nmatch x:\n    case [1, 2] if y:\n        pass\n    case _:\n        x[1:2, ::3] += lambda q=1: q ** 2\n",
    "javascript": "import x, {y as z} from './a'\nexport default class A extends B {\n  static #p = 1\n  get q() { return this.#p }\n  async *r({a, b = 2}, ...c) { for await (const d of e) yield* d }\n}\nconst f = async (a) => ({b: a?.c ?? 1})\nlabel: for (;;) { if (a) continue label; else break }\nlet s = `t${f({a: 1})}`, u = a ? (b) : c, v = /[/}]+/g.test(s)\n",
    "typescript": "export interface A<T extends B = C> { readonly a?: string; [k: string]: any; m(x: number): void }\ntype U = 'a' | keyof T | { x: () => void }[]\nabstract class D<T> implements A { constructor(private readonly a: T, b?: string) { super() }\n  private m<T>(x: Record<string, unknown>): x is T { return x as any }\n}\nconst f = (x: any, y?: string): any => { return x! }\nenum E { A = 1, B }\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n\tm \"x/y\"\n)\n\ntype T struct {\n\tA, b int `json:\"a\"`\n\tm.B\n}\n\nfunc (t *T) F(a map[string]any, b ...int) (x any, err error) {\n\tfor i, v := range a {\n\t\tif v, ok := v.(int); ok && i != \"{\" {\n\t\t\tgo func() { fmt.Println(v) }()\n\t\t}\n\t}\n\tswitch {\n\tcase b[1:] == nil:\n\t\treturn []int{1, 2}, nil\n\tdefault:\n\t}\n\treturn &T{A: 1}, nil\n}\n",
    "java": "package a.b;\nimport static c.D.*;\n@A(x = 1)\npublic final class E<T extends F & G> extends H<T> implements I {\n  private static final Map<String, List<int[]>> J = new HashMap<>();\n  enum K { L(1) { void m() {} }, N; }\n  public <U> U m(final T t, String... s) throws X {\n    for (Map.Entry<String, T> e : t.entrySet()) { if (e instanceof Y) continue; }\n    try (R r = new R()) { return (U) s[0]; } catch (A | B e) { throw e; } finally { }\n  }\n  Runnable r = () -> { int x = 1, y[] = {1, 2}; x++; };\n}\n",
    "c_sharp": "using System;\nnamespace A.B\n{\n    [Serializable]\n    public class C<T> : D, IE<T> where T : class, new()\n    {\n        private readonly Dictionary<string, int> f = new() { [\"a\"] = 1 };\n        public int P { get; private set; } = 1;\n        public async Task<int> M(IDictionary<string, object> a, out int b, string c = null)\n        {\n            foreach (var x in a) { if (x.Key == null) continue; }\n            var q = a is null ? 1 : a?.Count ?? 2;\n            return await N($\"{q}\", @\"\"\"x\"\"\");\n        }\n    }\n}\n",
    "cpp": "#include <map>\n#define X(a) \\\n  a\nnamespace a::b {\ntemplate <typename T, int N = 3>\nclass C : public D<T> {\npublic:\n    explicit C(int x) : x_(x), y_{1} {}\n    virtual ~C() = default;\n    int f(const std::map<std::string, std::vector<int>>& m) const override {\n        for (const auto& [k, v] : m) { if (v.empty()) continue; }\n        auto g = [&](int q) -> int { return q * 2; };\n        std::vector<int> w = {1, 2};\n        return static_cast<int>(g(1)) + w[0];\n    }\nprivate:\n    int x_ = 0;\n};\n}\n",
    "rust": "use std::{fmt, io::*};\n#[derive(Debug)]\npub struct A<'a, T: Clone> { pub b: &'a T, c: Vec<(u8, i32)> }\nimpl<'a, T> A<'a, T> where T: Clone {\n    pub fn d(&self, x: &mut [u8]) -> Option<String> {\n        let y: Vec<usize> = (0..10).filter(|i| i % 2 == 0).collect();\n        if let Some(z) = y.get(0) { return None; }\n        match x { [] => {}, _ if true => println!(\"{}\", 'a'), _ => () }\n        Some(format!(\"{}\", self.c[0].1))\n    }\n}\n",
    "ruby": "require 'a'\nmodule A\n  class B < C::D\n    attr_reader :x, :y\n    def e(f, g = nil, *h, k: 1)\n      raise ArgumentError, 'bad' if f.nil?\n      f.each do |i, j|\n        next unless i\n        puts \"#{i}\" , j\n      end\n      x = f.select { |q| q.z > 1 }.map(&:a)\n      @w ||= { a: 1, 'b' => [2] }\n      begin\n        y\n      rescue E => e\n        nil\n      ensure\n        z\n      end\n    end\n  end\nend\n",
    "gdscript": "extends Node\nclass_name A\nsignal s(a, b)\nexport var x = 1\nonready var y = $Path/To\nconst Z = {\n\t'a': 1,\n}\n\nfunc f(a, b = null) -> void:\n\tfor i in a:\n\t\tif i == null and not b:\n\t\t\tcontinue\n\tmatch a:\n\t\t1, 2:\n\t\t\tpass\n\twhile a.size() > 1:\n\t\ta.pop_back()\n\treturn a if a else b\n",
}
BREAKS = {
    "conflict": lambda t: t.replace("\n", "\n<<<<<<< HEAD\n", 2),
    "diff": lambda t: "@@ -1,9 +1,9 @@\n" + t,
    "quote": lambda t: t + "\nx = “a”\n",
    "stray": lambda t: t + "\n)\n",
    "page": lambda t: "<!DOCTYPE html>\n<html><body>it's gone</body></html>\n",
    "binary": lambda t: "PK\x03\x04\x00" + t,
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_text_of_each_language(lang):
    for text in (VALID[lang], VALID[lang].replace("\n", "\r\n"), "\ufeff" + VALID[lang], VALID[lang].rstrip("\n"), "", "\n\n"):
        assert parsing.first_error(lang, text) is None, (lang, parsing.first_error(lang, text))


@pytest.mark.parametrize("lang", sorted(VALID))
@pytest.mark.parametrize("kind", sorted(BREAKS))
def test_broken_text_of_each_language(lang, kind):
    assert parsing.first_error(lang, BREAKS[kind](VALID[lang])) is not None


@pytest.mark.parametrize("lang", ["python", "javascript", "java", "go", "rust", "c_sharp", "cpp", "ruby", "gdscript"])
def test_other_languages_do_not_pass(lang):
    passed = [other for other, text in VALID.items() if other not in (lang, "javascript" if lang == "typescript" else "") and parsing.first_error(lang, text) is None]
    assert passed == []


def test_python_agrees_with_its_own_parser():
    for path in sorted(Path(ast.__file__).parent.glob("*.py"))[:60]:
        text = path.read_text(errors="replace")
        if any(w in text for w in ("type ", "print(f", 'f"', "f'")):
            continue  # nested quotes and newer statements
        assert parsing.first_error("python", text) is None, path


def test_engine():
    g = Grammar("file: ( item )* EOF\nitem: 'a' [ 'b' ] | '(' ( item )* ')'", "file")
    t = Tables(g)
    run = lambda s: t.line(t.begin, tuple(s) + ("EOF",))
    assert run("aab(a(ab))") >= 0 and t.complete(run("a")) and run("ba") == -1 and run("(a") == -3


def test_table(spark):
    rows = [("r/1", 1, "python", "x = 1\n"), ("r/2", 2, "python", "x = (\n"), ("r/3", 3, "python", None), ("r/4", 4, "cobol", "x"), ("r/5", 5, None, "x"), ("r/6", 6, "go", ""), ("r/7", 7, "go", "x = (\n"), ("r/8", 8, "python", "x = (\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, file_id long, lang string, content string, valid int")
    files, sources = df.drop("content"), df.drop("lang", "file_id")
    out = {r["file_id"]: r for r in parsing.check_files(files.select("file_id", "path", "lang"), sources.unionByName(sources)).collect()}
    assert set(out) == {1, 2, 4, 5, 6, 7, 8}
    assert out[1]["valid"] and out[2]["valid"] is False and out[2]["error_token"] == "end of file" and out[4]["valid"] is None and out[5]["valid"] is None
    assert out[7]["valid"] is False and out[8]["valid"] is False and out[6]["valid"]
    assert parsing.check_files(files.limit(0), sources).count() == 0
    clash = files.selectExpr("*", "1 AS sha", "2 AS p", "3 AS as_lang", "'x' AS content")
    assert parsing.check_files(clash, sources.selectExpr("*", "1 AS sha", "'go' AS lang")).count() == 7


@pytest.mark.parametrize("lang", sorted(VALID))
def test_lines_of_one_shape_have_the_same_tokens(lang):
    lexer = parsing.Lexer(lang)
    for text in (VALID[lang], BREAKS["cut"](VALID[lang]) if "cut" in BREAKS else "x = 'a"):
        state = ()
        for line in text.split("\n"):
            tokens, after, depth = lexer.line(state, line)
            assert (tokens, after, depth) == lexer._line(state, line)
            state = after
