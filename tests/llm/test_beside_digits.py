"""Cards and IBANs beside other digits and words."""

import pytest
from test_edges import table

from passbook.llm import pii

CARDS = ("4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "4111-1111-1111-1111")
IBANS = ("GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES9121000418450200051332")


@pytest.mark.parametrize("key", ["key"])
def test_valid_numbers_beside_digits(spark, key):
    texts = []
    for number in CARDS:
        texts += [(number, f.format(number)) for f in ("{} 12/25", "{} 123", "item 2 {}", "x 7 {} 12/25", "{0} {0}", "1 2 3 4 5 {} 6 7")]
    for number in IBANS:
        texts += [(number, f.format(number)) for f in ("{} PAID", "{} 2024", "{} A", "ref AB12 CODE {}", "{}", "{} 4111 1111 1111 1111")]
    rows = [(i, t, "", "") for i, (_, t) in enumerate(texts)]
    found = {r.doc_id: r.text for r in pii.pseudonymise(table(spark, rows), key).collect()}
    for i, (number, text) in enumerate(texts):
        assert number not in found[i] and len(found[i]) == len(text), (text, found[i])
        assert "4111 1111 1111 1111" not in found[i]
    # Equal numbers stay equal wherever they stand, and what is beside them stays.
    assert found[0].removesuffix(" 12/25") == found[1].removesuffix(" 123") == found[2].removeprefix("item 2 ")
