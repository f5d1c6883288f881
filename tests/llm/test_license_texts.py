"""License texts longer than a passage are scanned for; too short ones raise."""

import pytest

from textlens.llm import licenses


def test_long_templates_are_found_and_short_ones_raise(documents):
    text = " ".join(f"clause{i} of the license" for i in range(60))  # 240 words
    words = text.split()
    docs = documents([(1, "before " * 333 + text + " after" * 50), (2, " ".join(words[:100])), (3, " ".join(words[:200])), (4, None)])
    got = {r.doc_id: (r.license, r.shared, r.template_shingles) for r in licenses.license_matches(docs, [("Long", text)]).collect()}
    assert set(got) == {1, 3} and got[1] == ("Long", 236, 236) and got[3] == ("Long", 196, 236)
    assert licenses.length_classes(licenses.TEMPLATES) == licenses.CLASSES
    with pytest.raises(ValueError, match="under 5 words"):
        licenses.license_matches(docs, [("Short", "mit license")])
