"""Usual forms of national phone numbers and IPv6 addresses."""

import pytest
from sediment.llm import pii as P

PHONES = ["5551234567", "030 1234567", "0171 2345678", "(555)123-4567", "01712345678", "(030) 1234567", "(555) 123-4567"]
ADDRESSES = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3::8a2e:370:7334", "::1", "fe80::", "2001:db8:85a3:0:0:8a2e:370:7334"]


@pytest.mark.parametrize("kind,item", [("phone_local", x) for x in PHONES] + [("ipv6", x) for x in [*ADDRESSES, "dead::beef"]])
def test_every_form_is_proposed_whole(kind, item):
    for text in (item, f"see {item}, or not", f"at {item}."):
        a = text.index(item)
        assert (kind, a, a + len(item)) in P.candidates(text)


def test_trees_take_them_in_context_and_leave_others():
    trees, limits = P.model()
    said = lambda t: [(k, t[a:b]) for k, a, b, _ in P.find_spans([t], trees, limits)[0]]
    for item in PHONES:
        assert said(f"please call us, tel: {item} any day") == [("phone_local", item)]
    for item in ADDRESSES:
        assert said(f"the server with address {item} is down") == [("ipv6", item)]
    for text in ("order 5551234567 was sent", "the time was 1700000000 then", "see class add::bad for it", "words :: more", "at 12:34:56 on", "volume 12 (2004)123-145"):
        assert said(text) == []


def test_long_runs_stay_linear():
    for t in ("1:" * 100_000, "::" * 100_000, "a::" * 100_000, "(12)" * 100_000, "12 " * 100_000, "123456789 " * 50_000):
        P.candidates(t)
