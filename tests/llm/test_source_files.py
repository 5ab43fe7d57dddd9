import random

import pytest
from pyspark.sql import functions as F

from heliodor.llm import source_files
from heliodor.llm.source_files import judge_files, judge_path, judge_text

OWN = "import AppKit\n\nstruct Window{i}: View {{\n    /// Shows the rows of model {i}.\n    func update{i}() -> Int {{\n        return rows{i}.count + {i}\n    }}\n    var title{i}: String = \"Window {i}\"\n}}\n"
LIB = "\n".join(f"static int quad_node_{i}(int depth, int limit) {{ return depth * {i} + limit; }}" for i in range(20))


@pytest.mark.parametrize(
    ("path", "body", "reason"),
    [
        ("A/x.swift", "// Code generated by tool 1.2. DO NOT EDIT.\nlet a = 1", "generated"), ("A/x.swift", "/* Automatically generated by t from a.idl;\n   your changes will be lost. */\nlet a = 1", "generated"), ("A/x.swift", "// <auto-generated />\n", "generated"),
        ("A/x.swift", "let a = 1\n" * 60 + "// tool output, 99 bytes from x.idl. Do not modify by hand.\n", "generated"), ("A/x.swift", "//\n// Text.\n//\n// @generated by tool\n", "generated"), ("A/x.c", "/*\n * x.c -- part of quadlib 3.1\n * Copyright (c) the quadlib contributors\n */\nint x;", "third-party"),
        ("A/x.c", "// Upstream: quadlib 3.1, copied without changes.\nint x;", "third-party"), ("A/x.h", "const unsigned char a[] = {\n" + "  0x1f, 0x2a, 0x00, 0xff, 0x3c,\n" * 30 + "};", "data"), ("A/x.swift", 'let a = """\n' + ("Ab9+" * 19 + "\n") * 20 + '"""', "data"),
        ("A/x.json", '{"values":[' + ",".join(f"0.{i:06d}" for i in range(200)) + "]}", "data"), ("A/x.js", "function a(b,c){return b.d(c*9)||a[19]}" * 40, "minified"),
        ("A/x.swift", "// Do not edit the row while it moves.\nlet a = 1", None), ("A/x.swift", 'let banner = "// Code generated. DO NOT EDIT."\n', None), ("A/x.swift", "// Draws generated art: a tool.\nlet a = 1", None), ("A/x.swift", "// Minified previews: " + "words of a long comment " * 40 + "\nlet a = 1", None),
        ("A/x.json", '{\n  "a": {\n    "title": "A sentence of words.",\n    "limit": 3\n  }\n}', None), ("A/x.c", "", None), ("A/x.c", None, None), ("A/x.c", "x" * 5_000_000, "data"),
    ],
)
def test_text(path, body, reason):
    assert judge_text(path, body) == reason


@pytest.mark.parametrize(
    ("path", "reason"),
    [("A/Vendor/q/x.c", "third-party"), ("node_modules/q/x.js", "third-party"), ("Libraries/quad-1.2/x.c", "third-party"), ("A/Vendors/List.swift", None), ("GeneratedArt/x.swift", None), ("A/Generated/x.swift", "generated"), ("a/x.pb.swift", "generated"), ("a/R.generated.swift", "generated"), ("a/x.min.js", "minified"), ("a/CodeGenerator.swift", None)],
)
def test_path(path, reason):
    assert judge_path(path) == reason


def test_edited_copies_are_found_by_their_lines(spark):
    edited = LIB.replace("quad_node_3(", "quad_node_three(").replace("quad_node_9(", "quad_node_nine(")
    own = OWN.format(i=1)
    rows = [("lib", "http://h/a.zip#Vendor/q/node.c", LIB), ("copy", "http://h/b.zip#Sources/node2.c", edited), ("own1", "http://h/a.zip#W.swift", own), ("own2", "http://h/b.zip#W.swift", own), ("own2", "http://h/b.zip#W.swift", own)]
    rows += [(f"o{i}", f"http://h/c.zip#W{i}.swift", OWN.format(i=i)) for i in range(2, 12)] + [("mixed", "http://h/d.zip#M.c", "\n".join(LIB.split("\n")[:4]) + "\n" + OWN.format(i=50) + OWN.format(i=51)), (None, "x#Vendor/a.c", "x"), ("nobody", "y#a.c", None), ("nourl", None, "int x;")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "id string, url string, body string, local_path string, reason int")
    assert sorted(tuple(r) for r in judge_files(df).collect()) == [("copy", "third-party copy"), ("lib", "third-party")]
    assert judge_files(df.where(F.lit(False))).count() == 0


def test_notes_anywhere_in_a_file():
    code = [f"let value{i} = compute(input: {i}, scale: other{i})" for i in range(60)]
    licence = ["/*", *(f" * Licence text, line {i}." for i in range(50)), " */"]
    at = lambda line: "\n".join([*code, line, *code])
    assert judge_text("A/a.swift", "\n".join([*licence, "// This file was generated by tool 3", *code])) == "generated"
    assert judge_text("A/a.swift", at("// @generated")) == "generated"
    assert judge_text("A/a.swift", at("// Copied from libfoo 2.1")) == "third-party"
    assert judge_text("A/a.swift", at("/* This file is part of foo v1.2 */")) == "third-party"
    for mention in ("    // copied from the cell above", "// The keys are those that were copied from the cell", "// We skip files marked @generated", 'let note = "// @generated"', "x // @generated"):
        assert judge_text("A/a.swift", at(mention)) is None, mention


def test_notes_of_scripts():
    note = "#pragma once\n/* This header was written by a script (bindtool) out of rows.csv. Please change rows.csv and run the script again. */\n" + "#define ROW_A 1\n" * 9
    assert judge_text("A/rows.h", note) == "generated"
    assert judge_text("A/rows.h", "\n".join(["// Licence."] * 60 + ["// This file was produced by the build tool."] + ["int a = 1;"] * 140)) == "generated"
    assert judge_text("A/rows.h", "// The generator below writes source text for rows.\nint a = 1;\n" * 9) is None
    assert judge_text("A/rows.h", "// Rows written by people.\nint a = 1;\n" * 9) is None


def _plain(texts, share, least):
    """Brute force of third_party_copies: every text against every third-party text."""
    return sorted(t[0] for t in texts if t[2] and len(t[5]) >= least and any(s[1] and len(set(t[5]) & set(s[5])) >= -(-len(t[5]) * share // 1) for s in texts))


@pytest.mark.parametrize(("listed", "hot"), [(8, 50_000), (1, 50_000), (1, 4)])
def test_copies_equal_brute_force(spark, monkeypatch, listed, hot):
    monkeypatch.setattr(source_files, "HOT", hot)
    rng = random.Random(5)
    libraries = [[rng.getrandbits(50) for _ in range(40)] for _ in range(3)]
    rows = []
    for i in range(120):
        lines = [x if rng.random() > 0.25 + 0.15 * (i % 3) else rng.getrandbits(50) for x in libraries[i % 3]] + [7] * (i % 2)  # 7 is in many files
        foreign = i % 4 == 0
        rows.append((bytes([i]), foreign, not foreign or i % 8 == 0, "a" if foreign else None, "b" if foreign else None, sorted(set(lines))))
    df = spark.createDataFrame([(bytearray(r[0]), *r[1:]) for r in rows], "same binary, foreign boolean, seeks boolean, low string, high string, lines array<bigint>")
    found = sorted(bytes(r["same"]) for r in source_files.third_party_copies(df, 0.6, 4, listed).collect())
    assert found == _plain(rows, 0.6, 4) and 0 < len(found) < 120
