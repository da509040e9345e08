"""Entities directly behind letters are entities."""

import re

from icx.llm import pii

GLUED = {
    1: ("Tel+49 30 123456", "49 30 123456", "phone"), 2: ("Tel555-123-4567.", "555-123-4567", "phone"), 3: ("IP10.20.30.40", "10.20.30.40", "ip"),
    4: ("card4111111111111111", "4111111111111111", "card"), 5: ("No078-05-1120", "078-05-1120", "ssn"), 6: ("1Mr. John Smith", "John Smith", "person"),
    7: ("Tel(555) 123-4567", "(555) 123-4567", "phone"),
}


def test_entities_behind_letters(spark):
    rows = [(i, t) for i, (t, _, _) in GLUED.items()] + [(8, "v1.2.3 of abc123 in x1999, A4 and B+2")]
    got = {r.doc_id: r for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, entity, kind) in GLUED.items():
        assert (got[i].n_entities, got[i].kinds) == (1, [kind]) and entity not in got[i].text, text
        assert re.match(r"\w[A-Za-z]*", got[i].text).group() == re.match(r"\w[A-Za-z]*", text).group()
    assert got[8].n_entities == 0 and got[8].text == rows[-1][1]
