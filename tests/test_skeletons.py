"""What extractors show and hide."""

import time

import pytest

from layerloom.functions.skeletons import cpp_skeleton, cpp_supplement, csharp_skeleton, extract, python_skeleton, ts_skeleton

CASES = [
    (csharp_skeleton, "using System;\nusing A.B;\nclass X { }", ["using System;", "using A.B;", "class X {"], []),
    (csharp_skeleton, "namespace My.App { public class Foo { } }", ["namespace My.App {", "public class Foo {"], []),
    (csharp_skeleton, "namespace My.App;\npublic class Foo : Bar, IBaz { public int A { get; set; } }", ["namespace My.App;", "public class Foo : Bar, IBaz {", "get;", "set;"], []),
    (csharp_skeleton, "public class P { private int _x; public int A; protected void B() { } internal int C; void D() { } private void E() { } }", ["public int A;", "protected void B();", "internal int C;"], ["_x", "D()", "E()"]),
    (csharp_skeleton, "public class P { public async Task<int> Save(User u) { await SaveNow(u); return 1; } public int Twice(int x) => x * 2; }", ["Save(User u);", "Twice(int x);"], ["SaveNow", "x * 2"]),
    (csharp_skeleton, "public interface IRepo<T> where T : class { T Get(int id); void Put(T x); }", ["where T : class", "T Get(int id);", "void Put(T x);"], []),
    (csharp_skeleton, "public enum E { One, Two = 2, Three }", ["One", "Two = 2", "Three"], []),
    (csharp_skeleton, "public record Person(string Name, int Age);", ["public record Person(string Name, int Age);"], []),
    (csharp_skeleton, "public record struct Point(double X);\npublic delegate void Done(int x);", ["double X", "delegate void Done(int x);"], []),
    (csharp_skeleton, "/// <summary>Doc</summary>\n[Serializable]\npublic class X {\n  /// <summary>M</summary>\n  [Obsolete(\"a;b\")]\n  public void M() { } }", ["/// <summary>Doc</summary>", "[Serializable]", "/// <summary>M</summary>", "[Obsolete(\"a;b\")]", "public class X {"], []),
    (csharp_skeleton, "public class X { public string Full => First + Last; public int this[int i] { get { return a[i]; } } public event Action Went; public int Y { get; init; } = 3; }", ["Full { get; }", "this[int i] { get; }", "event Action Went;", "Y { get; init; }"], ["First + Last", "a[i]", "= 3"]),
    (csharp_skeleton, "public class U { public U(string n) : base(n) { Name = n; } public static int operator +(U a, U b) { return 1; } }", ["U(string n);", "operator +(U a, U b);"], ["Name = n", "base(n)", "return"]),
    (csharp_skeleton, "public class O { public class I { public int A; } private class S { public int Z; } }", ["public class I {"], ["class S"]),
    (csharp_skeleton, "public class C { protected internal void Sh() { } private protected void De() { } private void Hi() { } }", ["Sh();", "De();"], ["Hi"]),
    (csharp_skeleton, "namespace N { class ByDefault { } }\nvar x = 1;", ["class ByDefault {"], ["var x"]),
    (csharp_skeleton, 'public class T { public string A() { return "}{;"; } public char B() { return \'}\'; } /* } */ public int Z; }', ["string A();", "char B();", "int Z;"], ["return"]),
    (cpp_skeleton, '#include "a.h"\n#include <b>\nnamespace n {\nclass K : public B {\n  int hid;\npublic:\n  int f(int x) const { return x; }\n  virtual void g() = 0;\nprotected:\n  int p();\nprivate:\n  int q();\n};\n}', ['#include "a.h"', "namespace n {", "class K : public B {", "int f(int x) const;", "virtual void g() = 0;"], ["<b>", "hid", "q()", "return", "p()"]),
    (cpp_skeleton, "enum class E { A, B };\ntypedef int I;\nusing V = int;\ntemplate <class T> T max(T a, T b) { return a; }\nstruct S { int m(); };\nint x = 3;", ["enum class E {A, B};", "typedef int I;", "using V = int;", "T max(T a, T b);", "int m();"], ["return", "x = 3"]),
    (cpp_supplement, '#include "k.h"\nint K::f(int x) { return x; }\nint free(int y) { return y; }\nnamespace { int inner() { return 1; } }', ['#include "k.h"', "int free(int y);", "int inner();"], ["K::f", "return", "namespace"]),
    (python_skeleton, "import os\n__all__ = ['A']\nX: int = 3\n_y: int = 4\n@deco\nclass A(B, metaclass=M):\n    '''Doc line.\n    more'''\n    size: int\n    def run(self, x: int = 2) -> str:\n        return 'x'\n    def _no(self): pass\n    def __init__(self): pass\nasync def go(a, *, b): ...\ndef _hidden(): ...", ["import os", "__all__ = ['A']", "X: int = 3", "@deco", "class A(B, metaclass=M):", "Doc line.", "size: int", "def run(self, x: int=2) -> str: ...", "def __init__(self): ...", "async def go(a, *, b): ..."], ["_no", "_hidden", "return", "_y", "more"]),
    (ts_skeleton, "import {a} from './a'\nexport * from './b';\nexport interface I { x: number; f(): void }\nexport type T = 'a' | 'b';\nexport enum E { A, B }\nexport default class K extends L {\n  private x = 1;\n  _y = 2;\n  size: number = 3;\n  run(a: string): number { return 1; }\n}\nexport function go(x: number): void { hide(); }\nexport const f = (x: number) => x * 2;\nconst k: Map<string, number> = new Map();", ["import {a} from './a';", "export * from './b';", "interface I", "export type T = 'a' | 'b';", "export enum E", "export default class K extends L {", "size: number;", "run(a: string): number;", "export function go(x: number): void;", "export const f = (x: number) => ...;", "const k: Map<string, number>;"], ["private", "_y", "hide", "x * 2", "new Map"]),
]


@pytest.mark.parametrize("extract, source, shown, hidden", CASES)
def test_skeleton(extract, source, shown, hidden):
    got = extract(source)
    for x in shown:
        assert x in got, got
    for x in hidden:
        assert x not in got, got


@pytest.mark.parametrize("extract", [csharp_skeleton, cpp_skeleton, ts_skeleton, python_skeleton, cpp_supplement])
@pytest.mark.parametrize("source", ["", "}", "{{{", "\"", "/*", "(", "a" * 10000, "'", "#", "[", "class"])
def test_broken(extract, source):
    assert isinstance(extract(source), str)


def test_enum_is_cut():
    text = csharp_skeleton("public enum E { " + ", ".join(f"V{i}" for i in range(3000)) + " }")
    assert text.endswith("/* ... */ }") and len(text) < 4100


def test_work_is_spread(spark, tmp_path):
    """A small file of many parts is parsed in several tasks, each part once."""
    from pyspark.sql import functions as F

    from layerloom.plans.catalogue import QUERIES

    parts = spark.range(6000).selectExpr("id AS p_partkey", "concat('part n', id) AS p_name", "'Brand#1' AS p_brand")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = QUERIES["code_skeletons"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in made}) >= 3
    assert {r.rel for r in made} == {f"f{i}{e}" for i in range(6000) for e in (".py", ".cs", ".h", ".ts")} and len(made) == 24000


def test_extract_odd_files(spark):
    """Small files are looked up by text and extractor; large, null and nameless ones go their own ways."""
    long = "".join(f"def go_{i}(x: int) -> int:\n    return x\n" for i in range(200))
    both = "class A { };\nvoid A::hidden();\n" + "".join(f"int free_{i}(int x);\n" for i in range(20))
    rows = [("c", "a.py", "def f(): pass", False), ("d", "b.PY", "def f(): pass", False), ("c", "a.ts", "def f(): pass", False), ("c", "l.py", long, False),
            ("c", "n.py", None, False), ("c", None, "def f(): pass", False), ("c", "Makefile", "x", False), ("c", "h.cpp", both, None), ("c", "i.cpp", both, True)]
    files = spark.createDataFrame(rows, "component string, rel string, content string, beside boolean").coalesce(1)
    got = {(r.component, r.rel): r for r in extract(files, "beside").collect()}
    assert set(got) == {("c", "a.py"), ("d", "b.PY"), ("c", "l.py"), ("c", "h.cpp"), ("c", "i.cpp")}
    assert got["c", "a.py"].skeleton == got["d", "b.PY"].skeleton == "def f(): ..."
    assert got["c", "l.py"].skeleton == python_skeleton(long) and got["c", "l.py"].tokens == len(python_skeleton(long)) // 4
    assert got["c", "h.cpp"].skeleton == cpp_skeleton(both) and got["c", "i.cpp"].skeleton == cpp_supplement(both) and got["c", "i.cpp"].is_supplementary


@pytest.mark.parametrize("skeleton, line", [(ts_skeleton, "export const k%d: number = 1;\n"), (cpp_skeleton, "int go_%d(int x);\n"), (python_skeleton, "import m%d\n")])
def test_time_grows_with_the_file(skeleton, line):
    """Four times the lines take about four times as long, not sixteen."""

    def took(n):
        text = "".join(line % i for i in range(n))
        began = time.process_time()
        assert len(skeleton(text).split("\n")) == n
        return time.process_time() - began

    took(100)
    assert took(20000) < 9 * min(took(5000) for _ in range(3))
