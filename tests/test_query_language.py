from hypothesis import given, settings
from hypothesis import strategies as st

from colophon.operators.query_language import match_groups, normal_topic, page_of, parse_query, query_date, with_operator


def test_operators_phrases_and_free_text():
    q = parse_query('Trust "seeing like a state" after:2023 before:2024-02-30 year:2023abc issue:12 topic:"Loose-Coupling!" section:BOOK colour:red')
    assert q.phrases == ["seeing like a state"]
    assert q.filters.given() == {"after": "2023-01-01", "year": 2023, "issue_number": 12, "topic": "loose coupling", "section": "book"}
    assert q.free_text == "Trust colour:red"
    assert not q.filter_only


def test_values_that_cannot_be_used():
    q = parse_query("section:nowhere year:1999 issue:0 topic:\"unclosed")
    assert q.filters.given() == {}
    assert "section:nowhere" in q.free_text and "section:nowhere" in q.operators
    assert parse_query("year:2020").filter_only
    assert not parse_query("").filter_only
    assert [query_date(x) for x in ("2024", "2024-13", "2024-02-29", "2023-02-29", "x")] == ["2024-01-01", None, "2024-02-29", None, None]


def test_groups_pages_and_rewriting():
    assert match_groups(parse_query('"a B" café-au lait')) == [["a", "b"], ["café", "au"], ["lait"]]
    assert page_of("2", "500") == (50, 50) and page_of(None, None) == (0, 20) and page_of("-3", "0") == (0, 20)
    assert with_operator("a topic:x b", "topic", "y z") == 'a b topic:"y z"'
    assert with_operator("a topic:x b", "topic", None) == "a b"
    assert normal_topic("A–B_c") == "a b c"


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text(max_size=600))
def test_any_text_can_be_parsed(raw):
    q = parse_query(raw)
    assert len(q.free_text) <= 500
    assert all('"' not in p for p in q.phrases)
    assert q.filters.section is None or q.filters.section == q.filters.section.lower()
    match_groups(q)
