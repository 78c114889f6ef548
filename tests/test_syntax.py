"""Definitions and metrics of small sources, counted by hand."""

import pytest

from corpusmill.functions.code_metrics import compute_metrics, syntax_tree, tree_features
from corpusmill.functions.definitions import clean_indentation, comment_before, find_definitions, python_docstring
from corpusmill.functions.lexer import lex


def names(source, language):
    _, found = find_definitions(source, language)
    return [d.name for d in found if d.kind == "function"], [d.name for d in found if d.kind == "class"]


WALKS = [
    ("Python", "@cache\ndef outer():\n    def inner():\n        pass\n    class Box:\n        def size(self): return 1\n", (["outer", "inner", "size"], ["Box"])),
    ("Python", "square = lambda v: v * v\n", ([], [])),
    ("Python", "if ready:\n    async def go(a, b=(1, 2)):\n        '''doc'''\n", (["go"], [])),
    ("Python", "class A: x = 1\nclass B(A):\n    # note\n    def m(self):\n        return '''\ndef no(): pass\n'''\n", (["m"], ["A", "B"])),
    ("Java", "public class Tree { void grow() { Object leaf = new Object() { public void fall() {} }; } }", (["grow"], ["Tree"])),
    ("Java", "class Tree { void grow() { class Local { void in() {} } } }", (["grow"], ["Tree"])),
    ("Java", "class Tree { Object leaf = new Object() { public void fall() {} }; void grow() {} }", (["fall", "grow"], ["Tree"])),
    ("Java", "class A { A(int n) { this.n = n; } <T> List<T> get(Map<String, T> m, int... r) throws E { return f(m); } static class B { void b() {} } int[] c()[] ; }", (["A", "get", "b", "c"], ["A", "B"])),
    ("Java", "interface Shape { double area(); default int sides() { return 0; } }\nenum Kind { ROUND(1) { int id() { return 1; } }, FLAT(2); Kind(int n) {} }\nrecord P(int x) { P { check(x); } int twice() { return 2 * x; } }", (["area", "sides", "id", "Kind", "twice"], [])),
    ("Java", "class A { static { run(); } @Test(expected = X.class) public void t() { assertTrue(a > b(1)); } int v = compute(3); }", (["t"], ["A"])),
    ("JavaScript", "function plain() { const inside = () => 1; }\nasync function later() {}\nexport function out() {}\nfunction* gen() {}\n", (["plain", "later", "out"], [])),
    ("JavaScript", "const one = x => x + 1, two = async (a, b) => { return a; };\nlet old = function () {};\nitems.map(i => i);\n", (["one", "two"], [])),
    ("JavaScript", "const box = { size() { return 1; } };\nconst K = class { m() {} };\nexport default () => 3;\n", ([], [])),
    ("JavaScript", "class Dog extends Animal {\n  constructor(n) { super(n); }\n  static make() { return new Dog('x'); }\n  get tag() { return `${this.n}`; }\n  bark = () => 1;\n  async load() { return [1].map(v => v); }\n}\nif (dog) { function late() {} }\n", (["constructor", "make", "tag", "load", "late"], ["Dog"])),
    ("JavaScript", "class A { m( { }\nconst ok = () => 1;\n", ([], [])),
    ("JavaScript", "const a = /[/'\"]/.test(s) ? 1 : 2\nconst f = (q) => q / 2\nfunction g() {}\n", (["f", "g"], [])),
    ("C++", "class Later;\nvoid use(class Later* p) {}\n", (["use"], [])),
    ("C++", "void run() { class Local { void l() {} }; auto f = [](int x) { return x; }; }", (["run"], [])),
    ("C++", "struct S { int g() { return 1; } };\nextern \"C\" { int api() { return 0; } }\nint later(int);\n", (["g", "api"], [])),
    ("C++", "namespace n { class A : public B, C { public: A() : v(1), w{2} {} ~A() {} A& operator=(const A& o) { return *this; } operator int() const { return v; } bool operator==(const A&) const = default; class In { public: void deep() {} }; private: int v; }; }", (["A", "~A", "operator=", "operator int", "operator==", "deep"], ["A", "In"])),
    ("C++", "template <typename T, class U>\nclass Pair { public: T first() const noexcept { return a; } };\ntemplate <typename T> T twice(T x) { return x + x; }\nint Pair<int, int>::second() { return 0; }\nvoid Log::Line::put() {}\n", (["first", "twice", "second", "put"], ["Pair"])),
]


@pytest.mark.parametrize("language,source,want", WALKS, ids=range(len(WALKS)))
def test_definitions(language, source, want):
    assert names(source, language) == want


def test_deep_python_stops_at_the_guard():
    source = "".join("  " * k + f"def f{k}():\n" for k in range(250)) + "  " * 250 + "pass\n"
    assert len(names(source, "Python")[0]) == 100


def test_parents_and_comments():
    src, found = find_definitions("/** Holds.\n * Much. */\nclass A {\n  // no\n  void m() {}\n  /* yes */\n  int n() { return 1; }\n}\n", "Java")
    assert [(d.name, d.parent, comment_before(src, d)) for d in found] == [("A", None, "Holds.\nMuch."), ("m", "A", None), ("n", "A", "yes")]
    src, found = find_definitions("void Log::Line::put() {}\n", "C++")
    assert found[0].parent == "Line"


def test_python_docstrings():
    for body, want in (('    r"""Deep.\n    text"""\n', "Deep.\n    text"), ("    x = 1\n    'late'\n", "late"), ("    if a:\n        'inner'\n", None), ("    'a' 'b'\n", None)):
        src, found = find_definitions(f"def f():\n{body}", "Python")
        assert python_docstring(src, found[0]) == want


BRANCHES = [
    ("Java", "class Q { void r(int k) { while (k > 0) { k--; } do { k++; } while (k < 9); } }", 3),
    ("Java", "class Q { int r(List<? extends T> l) { for (T t : l) { if (t.a() && !t.b() || t == null) return 1; else if (t.c()) return 2; } return l.size() > 3 ? 1 : 0; } }", 7),
    ("Java", "class Q { int r(Object o) { return switch (o) { case null, default -> 0; case String s -> 1; case Integer i -> 2; }; } }", 3),
    ("Java", "class Q { void r() { try { a(); } catch (A e) { } catch (B e) { } finally { } } }", 3),
    ("JavaScript", "function r(p, q) { p ||= q; p &&= q; return (p ?? q) & 1 || p?.x; }", 2),
    ("JavaScript", "async function r(p) { for (const a in p) {} for await (const b of p) {} switch (p) { case 1: case 2: break; default: } await p.catch(f); }", 5),
    ("C++", "bool r(int a, Thing&& b) { for (auto x : v) { if (a and b or x) return true; } return a ? 1 : 0; }", 6),
    ("C++", "void r() { try { } catch (const E& e) { } catch (...) { } }", 3),
    ("Python", "def r(a, b):\n    if a and not b or a:\n        pass\n    elif b:\n        pass\n    return [x for x in a if x] if a else {k: 1 for k in b}\n", 8),
    ("Python", "def r(p):\n    with p: assert p\n    try:\n        pass\n    except E:\n        pass\n    finally:\n        pass\n    while p: p = f(x for x in p)\n    else: pass\n", 6),
]


@pytest.mark.parametrize("language,source,want", BRANCHES, ids=range(len(BRANCHES)))
def test_complexity(language, source, want):
    assert compute_metrics(source, language)["cyclomatic_complexity"] == want


NESTING = [
    ("Python", "def f(x):\n    return x\n", 0),
    ("Python", "for a in b:\n    if a:\n        for c in a:\n            if c:\n                go()\n", 4),
    ("Python", "try:\n    pass\nexcept E:\n    if x:\n        pass\n", 3),
    ("Java", "class A { void f() { if (a) { } else if (b) { } else if (c) { } } }", 3),
    ("Java", "class A { void f() { for (X x : xs) { while (x.go()) x.run(); } } }", 1),
    ("JavaScript", "for (const a of b) if (a) while (a) go();", 3),
    ("C++", "void f() { do { switch (a) { case 1: if (b) c(); } } while (d); }", 3),
]


@pytest.mark.parametrize("language,source,want", NESTING, ids=range(len(NESTING)))
def test_nesting(language, source, want):
    assert compute_metrics(source, language)["max_nesting_depth"] == want


def test_measures_hold_together():
    m = compute_metrics("# note\nimport os\n\ndef f(a):\n    '''doc'''\n    b = a + 1\n    return b\n", "Python")
    assert (m["loc"], m["blank"], m["comments"], m["multi"], m["sloc"], m["lloc"]) == (7, 1, 1, 0, 5, 5)
    assert m["vocabulary"] == m["h1"] + m["h2"] and m["halstead_length"] == m["N1"] + m["N2"]
    assert m["comment_ratio"] == round(1 / 7, 4)
    m = compute_metrics("int f(int a) {\n  /* two\n lines */\n  int b = a + 1; // end\n  for (int i = 0; i < 3; i++) b += i;\n  return b;\n}\n", "C++")
    assert (m["loc"], m["multi"], m["comments"], m["lloc"]) == (7, 2, 1, 4)
    assert compute_metrics("", "Python")["maintainability_index"] == 100.0
    assert compute_metrics("x", "Cobol") == {}


def test_trees_and_lexing():
    deepest, n, kinds = tree_features("f(a, [b])", "Python")
    assert (deepest, n, kinds["name"]) == (3, 9, 3)
    assert [c["type"] for c in syntax_tree("f(a, b);", "Java", 6, 40, signs=False)["children"]] == ["name", "parenthesized"]
    assert syntax_tree("x = '" + "y" * 100 + "'", "Python")["children"][2]["text"].endswith("...")
    assert [t.kind for t in lex("`a ${b + `c`} d` + 1", "JavaScript").tokens] == ["template", "sign", "number"]
    assert [t.kind for t in lex('auto s = R"x(")")x"; #', "C++").tokens] == ["name", "name", "sign", "string", "sign", "sign"]
    assert not lex("f(]", "Java").balanced
    assert clean_indentation("def f():\n        a\n          b\n\n") == "def f():\n    a\n      b\n\n"
