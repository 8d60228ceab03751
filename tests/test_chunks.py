"""Chunk boundaries, names and texts, file by file."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import declarations
from corpusloom.operators.chunk import chunk_files
from corpusloom.sources.index_table import with_ids

MEMBERS = "".join(f"    fn m{j}() {{\n        x\n    }}\n" for j in range(33))

# header of an impl block, its name
HEADERS = [
    ("impl Tr for <A as B>::C", "<A as B>::C<Tr>"),
    ("impl Tr /* x for y */ for S", "S<Tr>"),
    ("impl<T: A<B<C<D<E<F<G<H<I>>>>>>>>> Tr<T> for S<T>", "S<T><Tr<T>>"),
    ("impl <A as B>::C", "<A as B>::C"),
    ("impl<T> <T as B>::C where T: for<'a> Q<'a>", "<T as B>::C"),
    ("unsafe impl<F: Fn(u8) -> u8> !Tr<{ 1 > 0 }> for /* c */ [F; 3] /* d */", "[F; 3]<Tr<{ 1 > 0 }>>"),
    ("impl dyn for<'a> Tr<'a>", "dyn for<'a> Tr<'a>"),
    ("impl Tr for for<'a> fn(&'a u8) -> u8", "for<'a> fn(&'a u8) -> u8<Tr>"),
    ("impl<'a, const N: usize> const Tr for &'a mut [u8; N]", "&'a mut [u8; N]<Tr>"),
    ("default impl Form for Wherever", "Wherever<Form>"),
]

# path, source, expected (name, start, end, text or None) in order
CASES = [
    # one file of each kind
    (
        "orders.rs",
        "enum Side { Buy, Sell }\n\nextern crate ledger;\npub fn settle(side: Side) -> u64 {\n    ledger::post(side)\n}\n",
        [
            ("preamble", 3, 3, "extern crate ledger;"),
            ("Side", 1, 1, "enum Side { Buy, Sell }"),
            ("settle", 4, 6, "pub fn settle(side: Side) -> u64 {\n    ledger::post(side)\n}"),
        ],
    ),
    (
        "harvest.md",
        "written in spring\n### Wheat\nsown late\nreaped early\n# Barley\n## Oats\n",
        [
            ("harvest.md", 1, 1, "written in spring"),
            ("Wheat", 2, 4, "### Wheat\nsown late\nreaped early"),
            ("Barley", 5, 5, "# Barley"),
            ("Oats", 6, 6, "## Oats"),
        ],
    ),
    ("tides.md", "high at six\n\nlow at noon", [("tides.md", 1, 3, "high at six\n\nlow at noon")]),
    # Markdown
    ("m1.md", "", []),
    ("m2.md", "\n\n# A\nx\n", [("A", 3, 4, "# A\nx")]),
    ("m3.md", "intro\n# A", [("m3.md", 1, 1, "intro"), ("A", 2, 2, "# A")]),
    ("m4.md", "  ## B\ny", [("## B", 1, 2, "  ## B\ny")]),
    ("m5.md", "#### no\n", [("m5.md", 1, 1, None)]),
    ("m6.md", "#\tx\n#y\n#\n", [("m6.md", 1, 3, None)]),
    ("m7.md", "#  \nz", [("m7.md", 1, 2, None)]),
    ("m8.md", "# # x", [("# x", 1, 1, None)]),
    ("m9.md", "# A #\r\nb\r\n", [("A #", 1, 2, "# A #\nb")]),
    ("m10.md", "# T\n```\n# c\n```\n", [("T", 1, 2, None), ("c", 3, 4, None)]),
    ("m11.md", "a\rb\r\n\n", [("m11.md", 1, 2, "a\rb\n")]),
    ("m12.md", " # N\n　\n", [("# N", 1, 2, None)]),
    # other text
    ("t1.txt", "", []),
    ("t2.txt", "a\r\nb\n", [("t2.txt", 1, 2, "a\r\nb\n")]),
    ("README.MD", "# A\n", [("README.MD", 1, 1, "# A\n")]),
    ("t4.txt", "x" * 48_001, [("t4.txt", 1, 1, "x" * 48_000)]),
    ("t5.txt", " " * 48_000 + "x", []),
    ("t6.txt", "x" * 47_999 + "é", [("t6.txt", 1, 1, "x" * 47_999)]),
    ("t6b.txt", "x" * 47_998 + "é", [("t6b.txt", 1, 1, "x" * 47_998 + "é")]),
    ("t7.txt", " ", []),
    ("t8.txt", "\n\n\nx", [("t8.txt", 1, 4, None)]),
    # declarations
    ("r0.rs", "", []),
    ("r1.rs", "struct A; // n", [("preamble", 1, 1, "struct A; // n"), ("A", 1, 1, "struct A;")]),
    (
        "r2.rs",
        "const A:u8=1; const B:u8=2;",
        [("preamble", 1, 1, None), ("A", 1, 1, "const A:u8=1;"), ("B", 1, 1, "const B:u8=2;")],
    ),
    (
        "r3.rs",
        "#[derive(Debug)]\npub struct B(u8);",
        [("preamble", 1, 1, "#[derive(Debug)]"), ("B", 2, 2, "pub struct B(u8);")],
    ),
    ("r4.rs", "mod tests;", [("tests", 1, 1, None)]),
    ("r5.rs", "impl Foo {\n    fn a() {}\n}", [("impl Foo {", 1, 3, None)]),
    ("r9.rs", "macro_rules! m { () => {} }", [("m", 1, 1, None)]),
    ("r10.rs", "  fn x() {}", [("preamble", 1, 1, "  fn x() {}"), ("x", 1, 1, "fn x() {}")]),
    ("r11.rs", "// a\n\n// b\n", [("preamble", 1, 3, "// a\n// b")]),
    ("r12.rs", "const fn c() {}", [("c", 1, 1, None)]),
    ("r13.rs", """fn a() { let s = "}"; let c = '{'; /* } */ }""", [("a", 1, 1, None)]),
    ("r14.rs", "use a::{b, c};\nfn d() {}", [("preamble", 1, 1, "use a::{b, c};"), ("d", 2, 2, None)]),
    # signatures, unions, extern blocks and calls are no declarations
    (
        "r15.rs",
        'extern "C" {\n    fn e();\n}\nunion U { a: u8 }\nfoo! { fn x() {} }\nextern crate a;\nfn sig();\n',
        [("preamble", 1, 7, None)],
    ),
    (
        "r16.rs",
        'pub(in a::b) unsafe extern "C" fn f<T: Into<[u8; 2]>>(x: [u8; 3]) -> [u8; 4] where T: X {\n}\n',
        [("f", 1, 2, None)],
    ),
    (
        "r17.rs",
        "const X: S = S { a: { 1; 2 } };\nstatic mut Y: [u8; 2] = [1, 2];\ntype Z<T> = Vec<T>;\ntrait Q { fn q(); }\nenum E { A, B(u8) }\n",
        [("X", 1, 1, None), ("Y", 2, 2, None), ("Z", 3, 3, None), ("Q", 4, 4, None), ("E", 5, 5, None)],
    ),
    (
        "r18.rs",
        'fn r() { let a = r#"}"# ; let b = br"\\"; let c = b\'\\\'\'; let l: &\'static str = "\\"}"; }\nfn s<\'a>(x: &\'a u8) {}\n',
        [("r", 1, 1, None), ("s", 2, 2, None)],
    ),
    ("r19.rs", "/* a /* { */ b } */\nfn n() {}\n", [("preamble", 1, 1, None), ("n", 2, 2, None)]),
    ("r20.rs", "#!/usr/bin/env run\n#![allow(x)]\nfn n() {}\n", [("preamble", 1, 2, None), ("n", 3, 3, None)]),
    ("r21.rs", "impl Foo<{ N }> for [u8; 3] {\n    fn a() {}\n}\nfn b() {}", [("impl Foo<{ N }> for [u8; 3] {", 1, 3, None), ("b", 4, 4, None)]),
    ("r22.rs", "fn a() {}\r\n\r\nstruct B;\r\n", [("a", 1, 1, "fn a() {}"), ("B", 3, 3, "struct B;")]),
    ("r23.rs", "pub /* { */ fn c() {}\n", [("c", 1, 1, None)]),
    ("r24.rs", "fn a() {}   \n", [("preamble", 1, 1, "fn a() {}   "), ("a", 1, 1, "fn a() {}")]),
    ("r25.rs", "impl " + "A" * 70 + " {}\n", [("impl " + "A" * 55, 1, 1, None)]),
    ("r26.rs", "/// d\npub async fn r#type() {}", [("preamble", 1, 1, "/// d"), ("r#type", 2, 2, None)]),
    ("r27.rs", "mod m {\n    fn inner() {}\n}\n", [("m", 1, 3, None)]),
    ("r28.rs", "macro_rules! a ( () => {}; );\nmacro_rules! b [ () => {} ];\n", [("a", 1, 1, None), ("b", 2, 2, None)]),
    ("r29.rs", "#[a(b = \"]\")] #[c] fn d() {}\n", [("preamble", 1, 1, None), ("d", 1, 1, "fn d() {}")]),
    # an impl block of exactly 100 lines stays whole, one of 101 is split
    ("i100.rs", "impl Foo {\n" + "    // c\n" * 95 + "    fn a() {\n    }\n\n}", [("impl Foo {", 1, 100, None)]),
    (
        "i101.rs",
        "impl Foo {\n" + "\n" * 96 + "    fn a() {\n    }\n\n}",
        [("preamble", 1, 101, "impl Foo {\n}"), ("Foo::a", 98, 99, "fn a() {\n    }")],
    ),
    ("i102.rs", "impl Foo {\n" + "    // c\n" * 100 + "}\n", [("Foo", 1, 102, None)]),
    (
        "i103.rs",
        "unsafe impl<'a, T: Fn(A) -> B, const N: usize> Tr<X<T>> for Ty<'a, T>\nwhere\n    T: for<'b> Q<'b>,\n{\n"
        + "    const K: usize = { 3 };\n    type O = Vec<u8>;\n    /// doc\n    #[inline]\n    pub fn go(&self) { a; }\n    fn sig();\n    mac! {}\n"
        + "\n" * 100
        + "}\n",
        [
            ("preamble", 1, 112, None),
            ("Ty<'a, T><Tr<X<T>>>::K", 5, 5, "const K: usize = { 3 };"),
            ("Ty<'a, T><Tr<X<T>>>::O", 6, 6, "type O = Vec<u8>;"),
            ("Ty<'a, T><Tr<X<T>>>::go", 9, 9, "pub fn go(&self) { a; }"),
        ],
    ),
    (
        "i104.rs",
        "impl T for S {\n" + MEMBERS + "}\n",
        [("preamble", 1, 101, "impl T for S {\n}")]
        + [(f"S<T>::m{j}", 2 + 3 * j, 4 + 3 * j, "fn m%d() {\n        x\n    }" % j) for j in range(33)],
    ),
    # comments inside comments, to any depth
    ("c1.rs", "/* 1 " * 6 + "*/ " * 6 + "\nfn n() {}\n", [("preamble", 1, 1, "/* 1 " * 6 + "*/ " * 6), ("n", 2, 2, "fn n() {}")]),
    ("c2.rs", "/*" * 300 + " fn no() {} " + "*/" * 300 + "fn n() {}\n", [("preamble", 1, 1, None), ("n", 1, 1, "fn n() {}")]),
    ("c3.rs", "fn a() { /* } /* } \" */ } ' */ b; }\nstruct S; /*/ /**/ */ fn c() {}", [
        ("preamble", 2, 2, None), ("a", 1, 1, "fn a() { /* } /* } \" */ } ' */ b; }"), ("S", 2, 2, None), ("c", 2, 2, None)]),
    ("c4.rs", "fn a() { x(\"/* /* /*\", r#\"/*\"/*\"#, '\"', b'\\\\', '\\\"'); } // /* /*\nfn b() { 1 */* c /* d */ */ 2; }\nfn c() {}", [
        ("preamble", 1, 1, None), ("a", 1, 1, None), ("b", 2, 2, None), ("c", 3, 3, None)]),
    ("c5.rs", "fn a() { /* /*\ufdd0*/ */ }", [("a", 1, 1, "fn a() { /* /*\ufdd0*/ */ }")]),
    ("c6.rs", "impl X /* /* " + "y" * 70 + " */ */ {}", [("impl X /* /* " + "y" * 47, 1, 1, None)]),
    # generic arguments in braces, however far from their signs
    ("g1.rs", "impl Foo<" + " " * 50 + "{ N }> for X {\n    fn a() {}\n}\nfn b() {}", [
        ("impl Foo<" + " " * 50 + "{", 1, 3, None), ("b", 4, 4, None)]),
    ("g2.rs", "struct A<const N: usize = /* n */ { 1 + 2 } // last\n>(u8);\nfn b<T>() where T: Q<u8, { 3 }> {}", [("A", 1, 2, None), ("b", 3, 3, None)]),
    # headers of large impl blocks
    *[
        (f"h{i}.rs", f"{header} {{\n{MEMBERS}}}\n", [("preamble", 1, 101, None)] + [(f"{name}::m{j}", 2 + 3 * j, 4 + 3 * j, None) for j in range(33)])
        for i, (header, name) in enumerate(HEADERS)
    ],
    # nesting beyond what one token may hold
    ("d1.rs", "fn deep() { " + "{" * 40 + "a;" + "}" * 40 + " }\nfn after() {}\n", [("deep", 1, 1, None), ("after", 2, 2, None)]),
    ("d2.rs", "const D: u8 = " + "(" * 30 + "1" + ")" * 30 + ";\n#[a(" + "[" * 30 + "]" * 30 + ")]\nfn after() {}\n",
     [("preamble", 2, 2, None), ("D", 1, 1, None), ("after", 3, 3, None)]),
]


@pytest.fixture(scope="module")
def chunked(spark):
    files = spark.createDataFrame([(p, s) for p, s, _ in CASES], "file_path string, source string")
    found: dict[str, list] = {}
    for row in chunk_files(files).collect():
        found.setdefault(row["file_path"], []).append(row)
    return {p: sorted(rows, key=lambda r: r["chunk_ord"]) for p, rows in found.items()}


@pytest.mark.parametrize("path,source,expected", CASES, ids=[c[0] for c in CASES])
def test_chunks(chunked, path, source, expected):
    rows = chunked.get(path, [])
    assert [(r["item_name"], r["start_line"], r["end_line"]) for r in rows] == [e[:3] for e in expected]
    assert [r["chunk_ord"] for r in rows] == list(range(len(rows)))
    for row, (_, _, _, text) in zip(rows, expected):
        assert text is None or row["text"] == text
    language = {"rs": "rust", "md": "markdown"}.get(path.rsplit(".", 1)[1], "text")
    assert {r["language"] for r in rows} <= {language}


def test_split_impl_keeps_docs_in_preamble(chunked):
    assert "/// doc\n    #[inline]\n    fn sig();\n    mac! {}" in chunked["i103.rs"][0]["text"]


def test_truncation_is_flagged(chunked):
    assert chunked["t4.txt"][0]["was_truncated"] and not chunked["t2.txt"][0]["was_truncated"]


def test_tokens_join_to_the_source(spark):
    files = spark.createDataFrame([(s,) for _, s, _ in CASES], "source string")
    joined = files.select("source", F.array_join(declarations.tokens(F.col("source")), "").alias("j"))
    assert joined.where("j <> concat(source, '\n')").isEmpty()


def test_same_path_twice_stays_two_files(spark):
    files = spark.createDataFrame([("a.rs", "fn a() {}\n"), ("a.rs", "fn b() {}\n")], "file_path string, source string")
    assert sorted(r["item_name"] for r in chunk_files(files).collect()) == ["a", "b"]


def test_unique_keeps_the_last_chunk_per_id(spark):
    rows = [
        ("a.rs", "const A: u8 = 1; const B: u8 = 2;\n"),
        ("b.rs", "// x\nstruct C; struct D;\nfn e() {}\n// y\n"),
        ("c.rs", "\n  fn f() {}\n"),
        ("d.md", "# a\nb\n# c\n"),
    ]
    files = spark.createDataFrame(rows, "file_path string, source string")
    names = [(r["file_path"], r["item_name"]) for r in chunk_files(files, unique=True).collect()]
    assert sorted(names) == [
        ("a.rs", "B"), ("b.rs", "D"), ("b.rs", "e"), ("b.rs", "preamble"),
        ("c.rs", "f"), ("d.md", "a"), ("d.md", "c"),
    ]


def test_chunking_needs_no_shuffle(spark):
    files = spark.createDataFrame([("a.rs", "fn a() {}")], "file_path string, source string")
    plan = chunk_files(files, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_bad_cap_is_rejected(spark):
    files = spark.createDataFrame([("a", "b")], "file_path string, source string")
    with pytest.raises(ValueError):
        chunk_files(files, max_bytes=0)


@pytest.mark.parametrize("lead", ["", "use a;\n"])
def test_many_items_across_fold_blocks(spark, lead):
    """Two tokens per constant, so with and without a lead some block cuts one in half."""
    source = lead + "".join(f"const C{i}: S = S {{ a: {i} }};\n" for i in range(700))
    files = spark.createDataFrame([("a.rs", source)], "file_path string, source string")
    at = 1 + bool(lead)
    items = [r for r in chunk_files(files).orderBy("chunk_ord").collect() if r["item_name"] != "preamble"]
    assert [(r["item_name"], r["start_line"], r["end_line"]) for r in items] == [
        (f"C{i}", i + at, i + at) for i in range(700)
    ]
    assert items[699]["text"] == "const C699: S = S { a: 699 };"


@pytest.mark.parametrize("cap", [4, 9, 40, 1000])
def test_split_loses_nothing(spark, cap):
    """Pieces hold whole lines up to the cap, longer lines are cut between characters."""
    texts = {
        "a.txt": "ab\ncdé\r\n\n\nlonger than the others ü𝄞 by far\nx" + "\n" * 9 + "end",
        "b.md": "# one\n" + "word " * 30 + "\n## two\n\nz\n",
        "c.rs": "use a;\n\nfn f() {\n    b();\n}\nuse c;\n// " + "é" * 50 + "\n",
        "d.rs": "const A: u8 = " + "1" * 60 + "; const B: u8 = " + "2" * 60 + ";\n",
    }
    files = spark.createDataFrame(list(texts.items()), "file_path string, source string")
    whole = {(r.file_path, r.chunk_ord): r for r in chunk_files(files, None).collect()}
    found = chunk_files(files, cap, oversize="split").orderBy("file_path", "chunk_ord").collect()
    by_file: dict[str, str] = {}
    for r in found:
        by_file[r.file_path] = by_file.get(r.file_path, "") + r.text
        assert len(r.text.encode()) <= cap
        if r.file_path == "a.txt":
            lines = [x + "\n" for x in texts["a.txt"].split("\n")]
            assert r.text.rstrip("\n") in "".join(lines[r.start_line - 1 : r.end_line])
    assert by_file == {p: "".join(r.text for k, r in sorted(whole.items()) if k[0] == p) for p in texts}
    ids = with_ids(chunk_files(files, cap, oversize="split", unique=True)).select("external_id").collect()
    assert len(set(ids)) == len(ids)
    last = [r for r in chunk_files(files, cap, oversize="split", unique=True).orderBy("chunk_ord").collect() if r.file_path == "d.rs"]
    assert "".join(r.text for r in last if r.item_name == "B") == "const B: u8 = " + "2" * 60 + ";"


def test_pieces_are_as_long_as_whole_lines_allow(spark):
    files = spark.createDataFrame([("a.txt", "aa\nbb\ncc\n" + "d" * 9 + "\ne")], "file_path string, source string")
    rows = chunk_files(files, 8, oversize="split").orderBy("chunk_ord").collect()
    assert [(r.text, r.start_line, r.end_line, r.piece) for r in rows] == [
        ("aa\nbb\n", 1, 2, 0), ("cc\n", 3, 3, 1), *[(t, 4, 4, 2 + i) for i, t in enumerate(["dd", "dd", "dd", "dd", "d\n"])], ("e", 5, 5, 7),
    ]


def test_bad_split_is_rejected(spark):
    files = spark.createDataFrame([("a", "b")], "file_path string, source string")
    for cap, how in ((3, "split"), (9, "drop")):
        with pytest.raises(ValueError):
            chunk_files(files, cap, oversize=how)
