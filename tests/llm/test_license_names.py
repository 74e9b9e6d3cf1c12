"""Short templates, which name a license, count only as a whole."""

import pytest

from quillrank.llm import licenses

CASES = [
    ("it is released under the GNU General Public License today", "gpl", 1.0),
    ("it is released under the Apache License today", "", None),
    ("steam was released under the pressure of the valve", "", 0.0),
    ("code licensed under the Apache License, Version 1.1", "", None),
    ("Licensed under the Apache License, Version 1.1 and not the Apache License, Version 2.0", "", None),
    ("it is released under the MIT License today", "mit", 1.0),
    ("code licensed under the Apache License, Version 2.0", "apache-2.0", 1.0),
    ("code licensed under the Apache License, Version 2.0 the text of which is here", "apache-2.0", 1.0),
]


def test_license_names_are_covered_whole(spark):
    table = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    for i, (text, labels, score) in enumerate(CASES):
        assert found[i]["labels"] == labels, text
        if score is None:
            assert found[i]["score"] < 0.6, text
        else:
            assert found[i]["score"] == pytest.approx(score), text
