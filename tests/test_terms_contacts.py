from collections import Counter

import pytest
from helpers import postings
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postflow.operators import contacts, extras, terms

WORDS = st.text(alphabet="abAB é.", max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), WORDS), min_size=1, max_size=12), st.lists(st.one_of(st.none(), WORDS), min_size=1, max_size=12))
def test_held_terms_against_a_scan(spark, texts, wanted):
    got = terms.held_terms(spark.createDataFrame([(t,) for t in texts], "title string"), "title",
                           spark.createDataFrame([(t,) for t in wanted], "term string")).collect()
    low = lambda xs: {x.lower() for x in xs if x is not None}
    assert Counter((r.text, r.term) for r in got) == Counter((x, t) for x in low(texts) for t in low(wanted) if t in x)


ROWS = [(1, "Data Analyst", "Remote - EU"), (2, "Data Analyst", "Paris"), (3, "Chef", "Adelaide"), (4, "metadata analyst", "ADELAIDE"),
        (5, None, "Adelaide"), (6, "", ""), (7, "Data Analyst", None), (2, "Data Analyst", "Paris"), (8, "Ünï data", "x" * 50_000 + " paris")]


@pytest.mark.parametrize("titles, places", [(["ANALYST", "data"], ["adelaide"]), ([], ["paris"]), (["da"], []), (["zzz"], ["paris"]), ([], []),
                                            (["", "q"], ["é", "adelaide"]), (["a\\E.*", "data "], [".*", "paris"])])
def test_matching_is_the_regex_filter(spark, titles, places):
    rows = spark.createDataFrame(ROWS, "id int, title string, location string")
    table = spark.createDataFrame([("title", t) for t in titles] + [("location", p) for p in places] + [("other", "Data"), ("title", None)],
                                  "field string, term string")
    got = sorted(r.id for r in terms.matching(rows, table).collect())
    assert got == sorted(r.id for r in rows.filter(extras.matches_filters("title", "location", titles, places)).collect())


def test_matching_with_clashing_columns_and_no_rows(spark):
    rows = spark.createDataFrame([("Data", "Rome", "x", "y", 3)], "title string, location string, term string, piece string, count int")
    table = spark.createDataFrame([("title", "data")], "field string, term string")
    assert [tuple(r) for r in terms.matching(rows, table).collect()] == [("Data", "Rome", "x", "y", 3)]
    assert terms.matching(rows.limit(0), table).collect() == []


def test_thousands_of_terms(spark):
    rows = spark.createDataFrame([(i, f"word{i} of many", "remote") for i in range(300)], "id int, title string, location string")
    table = spark.createDataFrame([("title", f"WORD{i * 3} ") for i in range(4000)], "field string, term string")
    assert sorted(r.id for r in terms.matching(rows, table).collect()) == list(range(0, 300, 3))


def _contacts(spark, texts, **kw):
    rows = postings(spark, [{"job_board_id": f"k-{i}", **(t if isinstance(t, dict) else {"description": t})} for i, t in enumerate(texts)])
    got = contacts.guess_contacts(rows, **kw).collect()
    return {r.job_board_id: (r.contact_name, r.contact_email, r.contact_confidence) for r in got}


def test_three_confidences(spark):
    got = _contacts(spark, [
        "Recruiter: Ann O'Brien, aobrien@acme.example",
        "Contact: Bob Ray, BRAY@acme.example",
        "Hiring manager: Cy Dow, cy.dow@acme.example",
        "Contact: Eve Mills-Fox, see https://www.Acme.example/jobs",
        "Contact: Eve Mills at www.other.example.",
        "see https://acme.example and ask for Eve Mills",
        "Contact: Eve Mills", None, "", "Contact: eve mills www.acme.example",
    ])
    assert got["k-0"] == ("Ann O'Brien", "aobrien@acme.example", "published")
    assert got["k-1"] == ("Bob Ray", "BRAY@acme.example", "published")
    assert got["k-3"] == ("Eve Mills-Fox", "emillsfox@acme.example", "pattern-guess")  # two votes against one
    assert got["k-4"] == ("Eve Mills", "eve.mills@other.example", "pattern-guess")  # no vote: the default
    assert got["k-6"] == ("Eve Mills", None, "none")
    assert {got[k] for k in ("k-5", "k-7", "k-8", "k-9")} == {(None, None, "none")}


def test_votes_count_addresses_and_rows_looked_up_vote(spark):
    ann = "Contact: Ann Lee, ann.lee@acme.example"
    texts = [ann, ann, ann, {"description": "Contact: Bo Po, bpo@acme.example", "contact_confidence": "published"},
             "Contact: Di Roe, droe@acme.example", "Contact: Ed Foe, careers@acme.example", "Contact: Jo Doe https://acme.example"]
    got = _contacts(spark, texts)
    assert "k-3" not in got and len(got) == 6
    assert got["k-6"] == ("Jo Doe", "jdoe@acme.example", "pattern-guess")  # repeats of one address are one vote


def test_no_guess_without_votes_if_so_asked(spark):
    assert _contacts(spark, ["Contact: Jo Doe https://acme.example"], default_pattern=None)["k-0"] == ("Jo Doe", None, "none")
    with pytest.raises(ValueError):
        _contacts(spark, ["x"], default_pattern="initials")
    assert contacts.guess_contacts(postings(spark, [{}]).limit(0)).collect() == []
