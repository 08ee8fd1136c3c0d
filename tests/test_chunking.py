from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.operators.chunking import chunk_text, gap_chunks, line_chunks, line_windows, symbol_chunks

#: A long function between short declarations and a statement.
SOURCE = "\n".join(
    ["// orders of the day", "import * as shop from 'shop';", "let total = 0;"]
    + ["export async function collect(day: string) {", *(f"  total += shop.count({k}, day);" for k in range(40)), "  return total;", "}"]
    + ["interface Order { id: number }", "class Till { close() { return total; } }", "collect('monday');"]
)


def uncovered(text, chunks):
    covered = {n for c in chunks for n in range(c["startLine"], c["endLine"] + 1)}
    return [i for i, line in enumerate(text.split("\n"), 1) if line.strip() and i not in covered]


def test_windows():
    assert line_windows(1, 26, 12, 5) == [(1, 12), (8, 19), (15, 26)]
    assert line_windows(3, 40, 12, 12)[-1][1] == 40
    assert line_windows(1, 1) == [(1, 1)]


@given(st.integers(1, 300), st.integers(10, 60), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_windows_cover_all_lines(n, most, overlap):
    found = line_windows(1, n, most, overlap)
    assert {x for a, b in found for x in range(a, b + 1)} == set(range(1, n + 1))
    assert all(b - a < most for a, b in found) and found[-1][1] == n and (len(found) == 1 or found[-2][1] < n)


def test_typescript_symbols():
    chunks = chunk_text("src/main.ts", SOURCE, "typescript", 20, 5)
    assert uncovered(SOURCE, chunks) == []
    parts = [c for c in chunks if c["symbolName"] == "collect"]
    assert len(parts) > 1 and {c["symbolType"] for c in parts} == {"function"}
    assert min(c["startLine"] for c in parts) == 4 and max(c["endLine"] for c in parts) == 46
    assert [c["symbolName"] for c in chunks if c["startLine"] == 47] == ["Order"]
    assert sorted(c["symbolName"] for c in chunks if c["startLine"] == 48) == ["Till", "close"]
    assert len({c["id"] for c in chunks}) == len(chunks)


def test_python_symbols():
    text = "import os\n\n@deco\nclass A:\n    def f(self): pass\n\nclass B:\n    def g(self):\n        return 1\n\nif True:\n    def h(): pass\nx = 1\n"
    chunks = chunk_text("a.py", text, "python")
    found = [(c["symbolType"], c["symbolName"], c["startLine"], c["endLine"], c["parentSymbol"]) for c in chunks if c["symbolType"]]
    assert found == [("import", "", 1, 1, ""), ("function", "A", 3, 5, ""), ("class", "B", 7, 9, ""), ("function", "g", 8, 9, "B"), ("function", "h", 12, 12, "")]
    assert uncovered(text, chunks) == []
    assert all(c["symbolType"] == "" for c in chunk_text("a.py", "def broken(:\n", "python"))


def found_in(path, text):
    chunks = chunk_text(path, text, "x")
    assert uncovered(text, chunks) == []
    return [(c["symbolType"], c["symbolName"], c["startLine"], c["endLine"], c["parentSymbol"]) for c in chunks if c["symbolType"]]


def test_python_with_errors():
    """One broken function among ten, in a module and in a class: the others are found as before."""
    function = lambda k, pad="": f"{pad}def f{k}(a,\n{pad}        b=\'\'\'x\ny {k}\'\'\'):\n{pad}    return a\n\n"
    whole = "import os\n\n" + "".join(function(k) for k in range(10))
    good = found_in("a.py", whole)
    for k in range(10):
        broken = found_in("a.py", whole.replace(f"y {k}\'\'\'):\n    return a", f"y {k}\'\'\'):\n    return (a"))
        assert [x[:2] for x in broken] == [x[:2] for x in good] and [x for x in broken if x[1] != f"f{k}"] == [x for x in good if x[1] != f"f{k}"]
    methods = "class C(object):\n    x = 1\n" + "".join(f"    @deco\n    def m{k}(self):\n        return {k}\n" for k in range(10)) + "\nclass D: pass\n\nif x:\n    def late(): pass\n"
    good = found_in("a.py", methods)
    assert len(good) == 13
    for wrong in ("return 4 +", "return [4", "retur n 4", "if 4 return", "x = = 4"):
        assert found_in("a.py", methods.replace("return 4", wrong)) == good
    cut = found_in("a.py", methods.replace("def m4(self):", "def m4(self:"))  # a head that doesn't parse is no definition
    assert cut == [x for x in good if x[1] != "m4"]
    assert found_in("a.py", "def ok():\n    pass\n}}\nprint 'old'\ndef also():\n\tpass\n") == [("function", "ok", 1, 3, ""), ("function", "also", 5, 6, "")]
    assert found_in("a.py", "x = (\n" * 5 + "def f(): pass") == [("function", "f", 6, 6, "")]


def test_java_records_are_seen_through():
    java = "record R(int x, String y) implements I {\n  R { check(x); }\n  int twice() { return 2 * x; }\n}\npublic record Empty() {}\nclass A {\n  record P<T>(T t) { T get() { return t; } }\n  void m() {}\n}\n"
    assert [x[:2] + x[4:] for x in found_in("A.java", java)] == [("method", "twice", ""), ("class", "A", ""), ("method", "get", "A"), ("method", "m", "A")]


def test_slashes_quotes_and_templates_hide_nothing():
    js = "class Dec {\n  cut(s) { return s.split(/[{]/).length / 2; }\n}\nconst q = `a ${f({x: `}`})} {`;\nclass After {}\nfunction last() { return a / b; }\n"
    assert found_in("a.js", js) == [("class", "Dec", 1, 3, ""), ("method", "cut", 2, 2, "Dec"), ("variable", "q", 4, 4, ""), ("class", "After", 5, 5, ""), ("function", "last", 6, 6, "")]
    rust = "struct P<'a> { x: &'a str }\nimpl<'a> P<'a> {\n    fn get(&self) -> char { '{' }\n}\nfn raw() -> &'static str { r#\"}\"#  }\nfn end() {}\n"
    assert [x[:2] for x in found_in("a.rs", rust)] == [("type", "P"), ("class", ""), ("function", "get"), ("function", "raw"), ("function", "end")]
    java = 'class A {\n  String s = """\n  { " """;\n  char c = \'{\';\n  void m() { }\n}\n'
    assert [x[:2] for x in found_in("A.java", java)] == [("class", "A"), ("method", "m")]


def test_declarations_in_blocks_and_callbacks():
    js = "if (a) {\n  function g() {}\n}\ndescribe('x', () => {\n  it('y', async (t) => t.ok());\n});\ntry { class K { m() {} } } catch (e) {}\nlist.map(x => x + 1);\n"
    assert found_in("a.ts", js) == [("function", "g", 2, 2, ""), ("function", "", 4, 6, ""), ("class", "K", 7, 7, ""), ("method", "m", 7, 7, "K"), ("function", "", 8, 8, "")]


def test_more_languages():
    c = "#include <x.h>\n#define M(a) { a\nstatic int *table;\nint main(void) {\n  return '{';\n}\nchar *dup(const char *s)\n{\n  return 0;\n}\nstruct s { int a; };\n"
    assert found_in("a.c", c) == [("function", "main(void)", 4, 6, ""), ("function", "*dup(const char *s)", 7, 10, "")]
    cpp = "namespace n {\ntemplate <typename T> T top(T a) { return a; }\nclass B : public A {\npublic:\n  B(int x) : a(x) {}\n  int run() const { return R\"({)\"[0]; }\n  int a = 0;\n};\nint B::other(int y) { return y; }\n}\n"
    assert [x[1:3] for x in found_in("a.cpp", cpp)] == [("top(T a)", 2), ("B(int x)", 5), ("run() const", 6), ("B::other(int y)", 9)]
    php = "<?php\nnamespace A;\n# {\nfinal class C extends D {\n  public static function make(): self { return new self(); }\n}\nfunction top($a) {\n  return \"{$a}\";\n}\ninterface I { function f(); }\n"
    assert [x[:3] for x in found_in("a.php", php)] == [("class", "C", 4), ("method", "make", 5), ("function", "top", 7), ("interface", "I", 10)]
    kotlin = "import a.b\ndata class P(val x: Int)\nclass Q {\n  fun one() = 1\n  fun two(): Int {\n    return 2\n  }\n}\nfun top(a: String): Int = a.length\n"
    assert [x[:4] for x in found_in("a.kt", kotlin)] == [("import", "", 1, 1), ("class", "P", 2, 2), ("class", "Q", 3, 8), ("function", "one", 4, 4), ("function", "two", 5, 7), ("function", "top", 9, 9)]
    swift = "public struct S {\n  mutating func go(x: Int) -> Int { return x }\n}\nextension S {\n  static func make() {}\n}\nfunc top() {}\n"
    assert [x[:3] for x in found_in("a.swift", swift)] == [("class", "S", 1), ("function", "go", 2), ("class", "S", 4), ("function", "make", 5), ("function", "top", 7)]
    scala = "class A(x: Int) {\n  def f: Int = x\n}\nobject O {\n  def g(y: Int) = { y }\n}\n"
    assert [x[:3] for x in found_in("a.scala", scala)] == [("class", "A", 1), ("function", "f", 2), ("function", "g", 5)]
    lua = "local x = 1 -- function\nlocal function f(a)\n  if a then return 'end' end\nend\nfunction M.g() for i = 1, 2 do x = i end end\nM.h = function() end\n"
    assert [x[:4] for x in found_in("a.lua", lua)] == [("function", "f", 2, 4), ("function", "M.g", 5, 5), ("function", "", 6, 6)]
    bash = "#!/bin/bash\nset -e # {\ngo() {\n  echo \"}\"\n}\nfunction stop {\n  exit\n}\n"
    assert [x[:4] for x in found_in("a.sh", bash)] == [("function", "go", 3, 5), ("function", "stop", 6, 8)]


def test_oversized_class_keeps_a_header():
    text = "class Big {\n" + "".join(f"  m{i}() {{\n    return {i};\n  }}\n" for i in range(20)) + "}\n"
    chunks = chunk_text("b.ts", text, "typescript", 20, 5)
    assert [(c["startLine"], c["endLine"]) for c in chunks if c["symbolType"] == "class"] == [(1, 6)]
    assert sum(c["symbolType"] == "method" for c in chunks) == 20 and uncovered(text, chunks) == []


@given(st.text(alphabet="ab{}();\n \"'`/*class functiox=>", max_size=300))
@settings(max_examples=300, deadline=None)
def test_any_text_is_covered(text):
    for path in ("a.ts", "a.rs", "a.go", "a.java", "a.py", "a.cpp", "a.php", "a.kt", "a.swift", "a.lua", "a.sh"):
        chunks = chunk_text(path, text, "x", 10, 2)
        assert chunks and uncovered(text, chunks) == []


def test_native_line_chunks_equal_the_python_ones(spark):
    texts = ["", "a", "a\n", "\n\n  \nx\ty\n", "\n".join(f"l{i}" for i in range(57)), None]
    files = spark.createDataFrame([(f"f{i}.md", "markdown", t) for i, t in enumerate(texts)], "filePath string, language string, content string")
    rows = line_chunks(files, 20, 5).select("filePath", "startLine", "endLine", "id", "content", "summary").collect()
    want = [(f"f{i}.md", c["startLine"], c["endLine"], c["id"], c["content"], c["summary"]) for i, t in enumerate(texts) for c in chunk_text(f"f{i}.md", t or "", "markdown", 20, 5)]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_symbol_chunks_in_batches(spark):
    files = spark.createDataFrame([("a.py", "python", "def f():\n  pass\n", "h1"), ("b.md", "markdown", None, "h2")], "filePath string, language string, content string, fileHash string")
    rows = {r.filePath: r for r in symbol_chunks(files).collect()}
    assert rows["a.py"].symbolName == "f" and rows["a.py"].fileHash == "h1" and rows["b.md"].content == "" and rows["b.md"].error is None


def test_gaps_are_those_of_the_chunker(spark):
    """What symbols leave of files, as relations and as chunk_text cuts it."""
    blank = "\n\n  \n\t\n"
    texts = {"a.ts": SOURCE, "b.py": blank + "import os\n" + blank + "x = 1\n" * 30 + blank + "def f(): pass\n" + blank + "y = 2\n" + blank, "c.py": "def f(): pass", "d.go": "func f() {}\n// end\n\n// more\nfunc g() {}\n" + blank, "e.py": "class A:\n" + "    x = 1\n\n" * 40 + "    def f(self): pass\n" + "    y = 2\n" * 50}
    files = spark.createDataFrame([(p, "x", t) for p, t in texts.items()], "filePath string, language string, content string")
    every = {p: chunk_text(p, t, "x", 12, 3) for p, t in texts.items()}
    symbols = spark.createDataFrame([(p, c["startLine"], c["endLine"]) for p, cs in every.items() for c in cs if c["symbolType"]], "filePath string, startLine int, endLine int")
    fields = ("id", "filePath", "startLine", "endLine", "content", "symbolName", "language", "summary")
    got = sorted(tuple(r[f] for f in fields) for r in gap_chunks(files, symbols, 12, 3).collect())
    assert got == sorted(tuple(c[f] for f in fields) for cs in every.values() for c in cs if not c["symbolType"]) and len(got) > 12
    whole = gap_chunks(files, symbols.limit(0), 12, 3)  # with nothing covered, blanks at the ends are left out
    assert {(r.filePath, r.startLine) for r in whole.collect() if r.filePath == "c.py"} == {("c.py", 1)} and gap_chunks(files.limit(0), symbols, 12, 3).collect() == []
