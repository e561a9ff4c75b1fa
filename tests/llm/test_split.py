import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import split as S


def starts(text, strategy, language):
    return [text[at:].split("\n")[0] for at, _ in S.sections(text, strategy, language)]


def test_markdown():
    t = """---
title: x
# not
---

# First
text
# Two #
   ### Three
    # code
#hash
####### seven
\\# no
####
```sh
# in a fence
````
~~~
````
~~~
Setext
two
===
- item
---
Foo
- - -
Bar
---
<!--
# comment
--> # tail
<div>
# html

#\tTab
> # quoted
- # listed

      # deep code

  # in item
| a |
| --- |
~~~
# open fence
"""
    assert starts(t, "heading", "md") == ["# Two #", "   ### Three", "####", "Setext", "Bar", "#\tTab", "> # quoted", "- # listed", "  # in item"]


def test_line_ends_and_offsets():
    t = "a\r\n# b\r\rc\r\n===\n\n# d"
    assert [at for at, _ in S.sections(t, "heading", "md")] == [t.index("# b"), t.index("c\r\n="), t.index("# d")]
    assert S.sections("\ufeff\n\n# only", "heading", "md") == []


BLOCKS = [
    ("x\n> ```\n# out\n", ["# out"]),  # a fence ends with its quote
    ("x\n> <!--\n# out\n\n## more\n", ["# out", "## more"]),
    ("x\n> Foo\n---\n# y\n", ["# y"]),  # no underline of a lazy line
    ("x\n\n> a\nb\n===\n", []),
    ("x\n\n[foo]: /url\n===\nz\n", []),  # a link definition is no heading
    ("x\n\n[foo]: /url 'a title'\nreal\n===\n", ["real"]),
    ("x\n- ```\n  # in\n# out\n", ["# out"]),
    ("x\n> > # deep\n1. # item\n   ~~~\n   # code\n   ~~~\n   sub\n   ---\n", ["> > # deep", "1. # item", "   sub"]),
    ("x\n-\n\n  # none of the item\n", ["  # none of the item"]),
    ("x\n#\tTab\n\tcode\n\n\t# code\n", ["#\tTab"]),
    ("x\n\n> <div>\n> # no\n>\n> # yes\n", ["> # yes"]),
]


@pytest.mark.parametrize("text,want", BLOCKS)
def test_blocks(text, want):
    assert starts(text, "heading", "md") == want


SCANS = [
    ("js", "x;\nconst re = /`/;\nfunction a() {}\nlet q = b / c; let r = d / e;\nfunction f() {}\n", ["function a() {}", "function f() {}"]),
    ("js", "x;\nmodule.exports = function g() {\n}\nexports.h = async (a) => 1;\nexport default (a) => 2;\na.b = 3;\n", ["module.exports = function g() {", "exports.h = async (a) => 1;", "export default (a) => 2;"]),
    ("js", "x;\nconst t = `a ${ `\nfunction no() {}\n` + '}' } b\nfunction no() {}\n`;\nfunction f() {}\n", ["function f() {}"]),
    ("sh", "x\necho it\\'s\nf() {\n}\necho \\\"\ng() {\n}\n", ["f() {", "g() {"]),
    ("rs", "use x;\n/* a /* b */\nfn no() {}\n*/\nfn yes() {}\nmod m {\nfn inner() {}\nstruct S { a: u8 }\n}\nfn last() { '{'; \"{\" }\nstruct T;\n", ["/* a /* b */", "fn last() { '{'; \"{\" }", "struct T;"]),
    ("ts", "x;\nnamespace N {\nfunction inner() {}\n}\nclass C {\n  m() { return /}/; }\n}\n", ["namespace N {", "class C {"]),
]


@pytest.mark.parametrize("language,text,want", SCANS)
def test_scans(language, text, want):
    assert starts(text, "function", language) == want


CODE = {
    "py": ('import os\n\n# why\n@deco(\n    1,\n)\nasync def f(a):\n    def g(): pass\n    """\ndef no():\n"""\n\nS = \'\'\'\nclass No:\n\'\'\'\n# apart\n\nclass C(B):\n    pass\nx = "#"\ndef h(): pass\n', ["# why", "class C(B):", "def h(): pass"]),
    "js": ("let a = 1;\n/**\n * doc\n */\nexport default async function f() {\n  function g() {}\n}\n/*\nfunction no() {}\n*/\n\nconst k = (a) => {\n}\nconst n = 5;\nconst s = `\nclass No {\n`;\nclass A extends B {}\n", ["/**", "const k = (a) => {", "class A extends B {}"]),
    "ts": ("x;\nexport interface I {}\ntype T = string;\nabstract class Q {}\n", ["export interface I {}", "type T = string;", "abstract class Q {}"]),
    "go": ("package x\n\n// Doc\nfunc (s *S) M() {}\nconst u = `\nfunc No() {\n`\ntype T struct {\n}\nvar v = 1\n", ["// Doc", "type T struct {"]),
    "rs": ("use x;\n/// doc\n#[derive(Debug,\n  Clone)]\npub(crate) struct S {}\n/*\nfn no() {}\n*/\n\npub async fn f<'a>(x: &'a str) {}\nconst C: u32 = 1;\nimpl S {\n    fn m() {}\n}\n", ["/// doc", "pub async fn f<'a>(x: &'a str) {}", "impl S {"]),
    "sh": ("#!/bin/sh\nset -e\n\n# doc\nfunction f {\n  x\n}\ncat <<'END'\ng() {\nEND\nh() {\n  echo '#'\n}\nA=1 # function no {\n", ["# doc", "h() {"]),
}


@pytest.mark.parametrize("language", CODE)
def test_code(language):
    text, want = CODE[language]
    assert starts(text, "function", language) == want
    crlf = text.replace("\n", "\r\n")
    assert [crlf[at:].split("\r\n")[0] for at, _ in S.sections(crlf, "function", language)] == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#é", max_size=400), st.integers(1, 60), st.integers(0, 40), st.sampled_from(["heading", "paragraph", "fixed"]))
def test_pieces_cover_the_text(text, size, overlap, strategy):
    p = S.pieces(text, strategy, "md", size, overlap)
    shared = min(overlap, max(0, size - 1) // 2)
    assert p[0][3] == 0 and p[-1][4] == len(text)
    for position, cut, _, start, end, _, content in p:
        assert content == text[start:end] and len(content) <= size
        assert start == (max(0, cut - shared) if cut else 0)
    assert all(a[4] == b[1] for a, b in zip(p, p[1:]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#é€😀", max_size=300), st.integers(12, 60), st.integers(0, 40))
def test_pieces_in_bytes(text, size, overlap):
    p = S.pieces(text, "heading", "md", size, overlap, unit="bytes")
    shared = min(overlap, (size - 1) // 2)
    own = [text[cut:end] for _, cut, _, _, end, _, _ in p]
    assert "".join(own) == text and all(len(c.encode()) <= size for *_, c in p)
    assert all(shared - 3 <= len(text[x[3] : x[1]].encode()) <= shared or x[3] == 0 for x in p[1:])


def test_check(spark):
    rows = [("a.md", "one two three\n# four\nfive six seven eight " * 4), ("b.txt", "x" * 90)]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("strategy", S.F.lit(None).cast("string"))
    made = S.split_sources(df, 20, 5)
    got = {r.path: (r.rebuilt == r.text_hash, r.over, r.unshared) for r in S.split_check(made, 20, 5).collect()}
    assert got == {"a.md": (True, 0, 0), "b.txt": (True, 0, 0)}
    bad = made.where("position <> 2").withColumn("content", S.F.concat("content", S.F.lit("y" * 9)))
    assert all(r.rebuilt != r.text_hash and r.over and r.unshared for r in S.split_check(bad, 20, 5).collect())


def test_nulls_repeats_and_long_texts(spark):
    long = ("word " * 300 + "\n\n# head\n") * 400
    rows = [("a.md", long, None, "x"), ("a.md", long, None, "x"), ("b.txt", None, None, "x"), ("c.md", "", "heading", "x"), ("d.md", "# x\n" * 3, None, "x"), (None, "y" * 30, None, "x"), ("e.py", "z" * 30, "none such", "x")]
    df = spark.createDataFrame(rows, "path string, content string, strategy string, start string")
    got = S.split_sources(df, 20, 5).toPandas()
    assert set(got["path"].dropna()) == {"a.md", "e.py"} and got["content"].str.len().max() <= 20
    a = got[got["path"] == "a.md"]
    assert (a["cut_kind"] == "section").sum() == 400 and a["position"].is_unique
    assert S.split_sources(df.limit(0), 20, 5).count() == 0
