"""Personal data in sentences that neither grammar writes."""

import pytest

from nearspan.llm import pii

FOUND = {
    "address": ["address: 12 Main Street", "I live at 12 Main Street, near the park", "home address is 12 Oak Avenue", "She moved to 221 Baker Street last year", "visit us at 7 Long Lane"],
    "phone": ["Tel. 030 1234567", "mobile 0171 2345678", "tel 5551234567", "call 555 123 4567", "phone: 4930123456", "call me on 0171-2345678 tomorrow", "fax (212) 555-0123"],
    "ssn": ["ssn 123-45-6789", "My social security number is 123-45-6789."],
    "iban": ["IBAN DE89370400440532013000", "transfer to DE89370400440532013000 today"],
    "birth": ["born 1980-02-03", "date of birth 3/2/1980"],
    "email": ["write to jo dot smith at mail dot com", "mail jo.smith [at] example [dot] org"],
}
CLEAN = [
    "id 123-45-6789", "order 5551234567 shipped", "on page 1234567", "the total was 12345678", "look at this. Now", "meet at noon dot then", "table 12 Main Court",
    "in the year 2001 2002 2003", "version 10.20.30", "Invoice 2024-11-12", "chapter 4 Green Road", "serial 123 456 7890", "DE00370400440532013000", "12 drummers and 11 pipers",
]


@pytest.mark.parametrize("kind", FOUND)
def test_personal_data_is_found(kind):
    for text in FOUND[kind]:
        assert [k for k, _, _ in pii.all_spans(text, pii.model())[1]] == [kind], text


def test_other_numbers_are_left_alone():
    assert [t for t in CLEAN if pii.all_spans(t, pii.model())[1]] == []


def test_recall_and_precision_by_kind():
    trees, least = pii.model()
    for other in (False, True):
        spans, marks = pii.examples(3000, 21 + other, other)
        p = trees.probability(pii.np.array([pii._features(*s) for s in spans]))
        for kind in least:
            own = [(q >= least[kind], m) for q, m, s in zip(p, marks, spans, strict=True) if s[1] == kind]
            hits, true = sum(h for h, _ in own), sum(m for _, m in own)
            both = sum(h and m for h, m in own)
            assert both >= 0.95 * true and both >= 0.98 * hits, kind
    assert all(0.05 < c < 0.95 for c in least.values())
