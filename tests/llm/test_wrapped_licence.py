"""Licence sentences wrapped over lines."""

import textwrap

from sparloom.llm import license_scan


def test_wrapped_headers_are_found(spark):
    rows = []
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        for n, width in enumerate((20, 40, 72)):
            rows.append((10 * k + n, "some code here\n\n" + "\n".join(" * " + x for x in textwrap.wrap(text, width)) + "\n\nmore code"))
    rows.append((1000, "All rights\n \nreserved"))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in rows[:-1]:
        assert license_scan.TEMPLATES[i // 10][0] in got[i].labels.split(","), i
    assert got[1000].labels == ""
