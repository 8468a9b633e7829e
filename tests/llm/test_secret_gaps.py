"""Parts of secrets are linked by the gap between their spans, however long they are."""

from __future__ import annotations

import re

from chronosweep.llm import secrets
from tests.llm.fixtures import odd_documents
from tests.llm.test_text_operators import base_spans, told


def gap_spans(text: str):
    """All spans, with parts linked by the gap between spans."""
    base = base_spans(text)
    weak = [(m.start(), rank, m.end()) for rank, pattern in ((3, secrets.IDENT), (4, secrets.OPAQUE), (5, secrets.ENDPOINT)) for m in re.finditer(pattern, text, re.ASCII)]
    parts = base + [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    near = lambda w, ranks: any(p[1] in ranks and max(p[0] - w[2], w[0] - p[2]) <= secrets.REACH for p in parts)
    ids, values = (1, 3), (0, 2, 4)
    ok = {3: lambda w: near(w, values), 4: lambda w: near(w, ids), 5: lambda w: near(w, ids) and near(w, values)}
    return sorted(base + [p for p in parts if p[1] >= 3 and ok[p[1]](p)])


def test_long_parts_are_linked_by_gaps(spark):
    word = "Zm9vYmFy+"
    rows = [
        (1, f"password={word * 50} user=alice https://db.example"),
        (2, f"{word * 56} key_id=K123"),
        (3, f"user=bob {'x ' * 195} {word * 300} {'y ' * 190} https://far.example"),
        (4, f"https://one.example/{'p' * 2000} user=carol"),
        (5, f"user=dave https://two.example/{'p' * 3000} token=abcdef99"),
        *((10 + k, f"user=erin{' ' * (395 + k)}{word * 40} {'z' * 20}{' ' * (390 + k)}https://three.example") for k in range(12)),
    ]
    want = {i: told(gap_spans(t)) for i, t in rows}
    assert "endpoint" in want[1] and "opaque" in want[2] and "ident" in want[2] and "endpoint" in want[5]
    assert {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(odd_documents(spark, rows)).collect()} == want
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(odd_documents(spark, rows)).collect()}
    assert masked[2] == "[SECRET] [SECRET]" and "db.example" not in masked[1]
