"""Entire licence texts in wrapped layouts."""

import textwrap

from lotwise.llm import licenses


def test_entire_texts_in_wrapped_layouts(spark):
    rows, want = [], {}
    for name, text in licenses.all_known():
        if len(text) < 400:
            continue
        layouts = [text]
        if len(text) < 3000:
            layouts += ["\n\n".join(textwrap.fill(p, w) for p in text.split("\n")) for w in range(50, 101)]
        for t in layouts:
            for head in ("", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n", "Copyright Jane Doe\n", "© 2021 J. Doe\n"):
                want[len(rows)] = name
                rows.append((len(rows), head + t))
    assert {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(want.values())
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == want


def test_body_lines_stay(spark):
    lines = ["copyright notice and this", "copyright holders and contributors", "copyright owner that is", "copyright", "copyright c 2020 x", "copyright jane doe", "c 2020 x"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r.x for r in df.where(licenses._is_text(df.x)).collect()] == lines[:4]
