"""License notices in texts, against plain search."""

from __future__ import annotations

import __spark_entry__ as entry_points
from ordina.llm import license_scan as ls

SF_DIR = "/root/testdata/sf0.01"


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, exact string, licenses array<int>")
    return {r.doc_id: r for r in ls.scan(docs).collect()}


def test_notices(spark):
    texts = [
        "Some text.\nReleased under the MIT License.\nMore text.",
        "this WORK is licensed under the GNU general public license,\n version 3!",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.",
        "You need a license to drive, and a permission slip.",
        None,
        "",
        "word " * 300_000 + "\nLicensed under the Apache License, Version 2.0.",
        "Long block with a license " + "of many other words " * 400 + "Released under the MIT License. and more license words",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in this Software without restriction',
    ]
    got = scanned(spark, texts)
    want = [["MIT"], ["GPL-3.0"], ["GPL-2.0"], ["CC-BY-4.0", "CC-BY-NC-4.0"], [], [], [], ["Apache-2.0"], ["MIT"], ["MIT"]]
    assert [got[i].licenses for i in range(len(texts))] == want
    assert [got[i].exact for i in range(len(texts))] == [True, True, True, True, False, False, False, True, True, False]
    assert got[0].offsets == [11] and got[4].n_blocks == 1


def test_templates_name_themselves():
    scanner = ls.Scanner()
    for name, text in ls.TEMPLATES:
        found = scanner.judge(text.encode())
        assert [f[0] for f in found] == [name] and found[0][2] == 0


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT License.")] * 2 + [(1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(len(r.licenses) for r in ls.scan(docs).collect()) == [0, 0, 1, 1]
    assert ls.scan(docs.limit(0)).count() == 0


def test_given_documents(spark):
    """Every notice with a template's exact words is found, and nothing else."""
    got = {r.doc_id: r.licenses for r in entry_points.queries()["op9_license_scan"](spark, SF_DIR).collect()}
    some = 0
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        want = {name for line in r.text.split("\n") for name, text in ls.TEMPLATES if ls.words_of(line) == ls.words_of(text)}
        assert set(got[r.doc_id]) >= want
        assert not got[r.doc_id] or any(" ".join(ls.words_of(t))[:20] in " ".join(ls.words_of(r.text)) for _, t in ls.TEMPLATES)
        some += bool(want)
    assert some > 0
