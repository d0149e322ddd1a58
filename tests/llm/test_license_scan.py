import re

from sitelens.llm import license_scan
from sitelens.llm.queries import op8_licenses

LINES = {
    r"Licensed under the Apache License, Version 2\.0": "apache-2.0", r"Released under the MIT License": "mit",
    r"GNU General Public License, version 3": "gpl-3.0", r"Licensed under CC BY-NC 4\.0": "cc-by-nc-4.0",
    r"All rights reserved": "proprietary",
}


def plain(text):
    return ",".join(sorted({f for p, f in LINES.items() if re.search(p, text or "")}))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r.families for r in op8_licenses(spark, sf).collect()}
    want = {d: plain(t) for d, t in texts.items()}
    wrong = {d: (rows[d], want[d]) for d in want if rows[d] != want[d]}
    assert len(rows) == len(want) and sum(map(bool, want.values())) > 20
    assert not wrong, wrong


def test_odd_and_unknown(spark, documents, odd_rows):
    rows = [*odd_rows, (70, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose."),
            (71, "This work is licensed under the Frobnicate Public License, version 3"), (72, "the license of the work"),
            (None, "Released under the MIT License.")]
    got = license_scan.per_document(documents(rows)).collect()
    named = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert named[70].families == "apache-2.0" and named[70].n_licenses == 1
    assert named[71].families == "" and named[72].families == ""
    assert sorted(r.families for r in got if r.doc_id is None) == ["", "", "mit"]
    assert license_scan.per_document(documents([])).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction"""
GPL = """This program is free software: you can redistribute it
and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version."""
NC = """This work is licensed under a Creative
Commons Attribution-NonCommercial 4.0
International License"""


def test_wrapped_notices(spark, documents):
    marked = lambda text, mark: "\n".join(mark + line for line in text.split("\n"))
    rows = [(1, f"Title\n\n{MIT}\n\nProse follows."), (2, f"int x;\n{marked(GPL, ' * ')}\nint y;"), (3, marked(NC, "# ")),
            (4, f"{marked(MIT, '// ')}\n{marked(GPL, '// ')}"), (None, MIT), (5, MIT.replace("\n", "\n\n")),
            (6, f"{'some words before the notice ' * 60}{GPL}")]
    got = {r.doc_id: (r.families, r.n_licenses, r.n_unknown) for r in license_scan.per_document(documents(rows)).collect()}
    assert got[1] == got[None] == ("mit", 1, 0) and got[2] == got[6] == ("gpl-3.0", 1, 0) and got[3] == ("cc-by-nc-4.0", 1, 0)
    assert got[4] == ("gpl-3.0,mit", 2, 0)
    assert got[5][0] == ""
