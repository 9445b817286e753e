import pytest

from corvine.llm import handwritten as H

BODY = "import os\n\ndef f(a):\n    return os.path.join(a, 'b')\n"


def test_frames(spark):
    notice = "# Code generated by schemac 1.2. DO NOT EDIT.\n"
    data = "var t = []int{\n" + "1, 2, 3, 4, 5, 6, 7, 8,\n" * 20 + "}\n"
    mini = "!function(e,t){" + "".join(f"var a{i}=t[{i}]||{{x:{i},y:e}};if(a{i}&&a{i}.x)a{i}.x(function(n){{return n.q||{{}}}});" for i in range(20)) + "}(this,window);\n"
    rows = [
        (1, "s/a/x.py", "r:a", notice + BODY + "x1 = 1\n"), (2, "s/vendor/y/x.py", "r:a", BODY + "x2 = 1\n"), (3, "s/vendors/x.py", "r:vendor-portal", BODY + "x3 = 1\n"), (4, "s/x_pb2.py", "r:a", "x4 = (\n"),
        (5, "s/x5.py", "r:a", '"""Writes the DO NOT EDIT banner."""\n# The generated report is mailed.\nB = "Code generated by x. DO NOT EDIT."\n'), (6, "s/t.go", "r:a", "package d\n\n" + data), (7, "s/m.js", "r:a", mini), (8, "s/e.py", "r:a", ""),
        (9, "s/c.py", "r:a", BODY), (10, "s/d.py", "r:b", "# other head\n" + BODY.replace("\n", "\r\n")), (11, "s/e1.py", "r:c", BODY.rstrip()), (12, "s/f.py", None, BODY), (13, "s/n.py", "x:third-party-mirror", "x13 = 1\n"),
        (14, "s/b.js", "r:a", mini[:-8]), (15, None, "r:a", notice), (16, "s/z.py", "r:a", None), (17, "s/o.yml", "r:a", notice), (18, "s/w.py", "r:a", "x18 = 1\n\n# <auto-generated> t 1.0 </auto-generated>\n"),
        (19, "s/u1.py", "r:a", "y = (\n"), (20, "s/u2.py", "r:b", "y = (\n"), (21, "s/u3.py", "r:c", "y = (\n"), (22, "s/e2.py", "r:b", "# a\n"), (23, "s/e3.py", "r:c", "\n"),
    ]
    df = spark.createDataFrame([(*r, "no") for r in rows], "file_id bigint, file_path string, namespace string, code string, reason string")
    got = {r.file_id: r.reason for r in H.not_handwritten(df).collect()}
    assert got == {1: "notice", 2: "place", 4: "place", 6: "made", 7: "made", 9: "copied", 10: "copied", 11: "copied", 12: "copied", 13: "place", 18: "notice"}
    assert H.not_handwritten(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [
    "// GENERATED CODE -- DO NOT EDIT!", "# DO NOT EDIT THIS FILE", "/* AUTO GENERATED FILE, DO NOT EDIT */", "// This file was generated by Prisma", "/*! jQuery v3.6.0 | (c) OpenJS Foundation and other contributors | jquery.org/license */",
    "/**\n * @license\n * Copyright 2017 Some Body\n */", "// SPDX-License-Identifier: MIT\n// Copyright (c) 2014 Jane Doe", "# Copyright 2012 Other Project Authors\n# Licensed under the Apache License, Version 2.0", "// Code generated by protogen 1.2. DO NOT EDIT.",
    "// Generated by the schemac compiler.  DO NOT EDIT!", "# Autogenerated by x v1, do not modify by hand", "// <auto-generated> a 1.0 </auto-generated>", "// This file was automatically generated by bindgen-x; changes will be lost.", "// Ce fichier est produit par protogen, ne pas le modifier.",
    "# Dieser Quelltext wurde von tmpl2src erzeugt und wird beim nächsten Lauf überschrieben.", "// @generated", "// This source file is machine generated.\n// Do not edit this file.", "// Generated from order.proto", "# Generated on 2024-01-02 by tool",
])
def test_notices(text):
    assert H.notice(text, "shopmesh:gateway")


@pytest.mark.parametrize("text", [
    "# Ids are automatically generated by the store on insert", "# machine-generated ids are rejected below", "// the receipts are automatically generated by the worker", "// This file is not generated; edit it freely.", "// The generated report is mailed to the warehouse every Friday.",
    "// Finds vendored copies so that the audit can skip them.", "// Internal use only, see LICENCE in the root folder.", "// Copyright 2021 The Shopmesh Authors\n// SPDX-License-Identifier: MIT", "# Generated by the nightly job are only the totals.", '"""Writes the DO NOT EDIT banner."""', "# Reads this file and the generated report.",
    "// Owned by the item team.", "# Generates the client code from the schema.", "",
])
def test_no_notices(text):
    assert not H.notice(text, "shopmesh:gateway")


def test_long_feet_and_lockfiles():
    long = "/* " + "words of a licence\n" * 300
    assert H.notice(H.header("js", "x = 1\n" + long + "copied verbatim from elsewhere */\n")[0]) and H.notice(H.header("go", "package a\n// @generated\n" + "// more\n" * 900)[0])
    assert H.header("py", "x = 1\n# a\n# b\n")[0].split() == ["#", "b", "#", "a"] and H.header("py", "# a\n")[0] == "# a\n"
    assert H.place("web/package-lock.json", None) and H.place("go.sum", None) and not H.place("src/lockfile.py", None)
