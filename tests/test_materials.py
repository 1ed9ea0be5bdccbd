import hashlib

import pytest
from helpers import AS_OF, postings

from postflow import schema
from postflow.operators import materials as M


def test_prompt_holes_filled_once(spark):
    rows = postings(spark, [{"title": "Analyst", "company": "Acme",
                             "description": "Use {resume_summary} and {title} literally"}])
    p = M.prompts(rows, "my {background}").collect()[0]
    expected = schema.COVER_LETTER_TEMPLATE.format(
        title="Analyst", company="Acme", description="Use {resume_summary} and {title} literally",
        resume_summary="my {background}")
    assert p.cover_prompt == expected
    assert p.email_prompt == schema.COLD_EMAIL_TEMPLATE.format(
        title="Analyst", company="Acme", description="Use {resume_summary} and {title} literally",
        resume_summary="my {background}")


def test_prompt_null_and_long(spark):
    long = "x" * 200_000
    rows = postings(spark, [{"description": None}, {"description": long}])
    p = sorted(M.prompts(rows, "").collect(), key=lambda r: len(r.cover_prompt))
    assert "Job description:\n\n" in p[0].cover_prompt
    assert long in p[1].cover_prompt  # whole text, never cut


def test_pending_is_null_only(spark):
    view = postings(spark, [{"generated_cover_letter": None}, {"generated_cover_letter": ""},
                            {"generated_cover_letter": "text"}])
    assert M.pending(view).count() == 1


def _failing_on(word):
    def factory():
        def run(prompts):
            if any(word in p for p in prompts):
                raise RuntimeError("boom")
            return ["" if "EMPTY" in p else "ok:" + hashlib.md5(p.encode()).hexdigest()[:6] for p in prompts]
        return run
    return factory


def test_generate_isolates_failures(spark):
    view = postings(spark, [{"title": "fine"}, {"title": "FAIL here"}, {"title": "EMPTY one"}])
    out = {r.job_board_id: r for r in M.run_generation(view, "cv", _failing_on("FAIL"), AS_OF).collect()}
    ok, bad, empty = out["seek-0000000000"], out["seek-0000000001"], out["seek-0000000002"]
    assert ok.cover_letter.startswith("ok:") and ok.error is None
    assert bad.cover_letter is None and bad.cold_email is None and bad.error == "RuntimeError"
    assert empty.cover_letter == "" and empty.error is None
    s = M.run_summary(view, M.run_generation(view, "cv", _failing_on("FAIL"), AS_OF)).collect()[0]
    assert (s.generated, s.empty, s.failed, s.remaining) == (1, 1, 1, 1)


def test_generator_registry(spark):
    with pytest.raises(ValueError):
        M.generator_for("no-such-backend")
    M.register_generator("upper", lambda: (lambda ps: [p.upper() for p in ps]))
    view = postings(spark, [{"title": "a"}])
    r = M.run_generation(view, "", "upper", AS_OF).collect()[0]
    assert r.generator == "upper" and r.cover_letter.startswith("YOU ARE HELPING")


def test_bounded_run(spark):
    view = postings(spark, [{"id": i} for i in range(1, 11)])
    got = sorted(r.job_board_id for r in M.run_generation(view, "", "echo", AS_OF, limit=3).collect())
    assert got == ["seek-0000000000", "seek-0000000001", "seek-0000000002"]


def test_no_text_is_an_error_and_stays_pending(spark):
    view = postings(spark, [{"title": "NONE"}, {"title": "fine"}])
    made = M.run_generation(view, "cv", lambda: lambda ps: [None if "NONE" in p else "ok" for p in ps], AS_OF)
    rows = {r.job_board_id: r for r in made.collect()}
    assert rows["seek-0000000000"].error and rows["seek-0000000000"].cover_letter is None
    left = M.pending_from(view, made).collect()
    s = M.run_summary(view, made).collect()[0]
    assert [r.title for r in left] == ["NONE"] and (s.generated, s.failed, s.remaining) == (1, 1, 1)


def test_failing_prompt_does_not_repeat_the_others():
    calls = []

    def fn(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise RuntimeError("boom")
        return [p.upper() for p in prompts]

    items = [f"p{i}" for i in range(64)]
    items[17] = "bad"
    texts, errors = M._call(fn, items)
    assert [t for t in texts if t] == [p.upper() for p in items if p != "bad"]
    assert errors[17] == "RuntimeError" and sum(e is not None for e in errors) == 1
    assert len(calls) == 13 and sum(calls) < 3 * 64  # halves, not 64 single calls


def test_both_prompts_of_a_call_are_done_before_the_next_are_read(spark):
    def factory():
        calls = []

        def run(prompts):
            calls.append(len(prompts))
            return [f"{len(calls)} {len(prompts)} {len(p)}" for p in prompts]
        return run

    view = postings(spark, [{}]).drop("job_board_id", "description").crossJoin(spark.range(0, 100, 1, 1).selectExpr(
        "concat('k-', id) AS job_board_id", "repeat('x', 1000 * int(id)) AS description"))
    made = M.generate(M.prompts(view, "cv"), factory, AS_OF, call_size=8).collect()
    assert len({r.job_board_id for r in made}) == 100 and not any(r.error for r in made)
    covers, emails = ([tuple(map(int, r[c].split())) for r in made] for c in ("cover_letter", "cold_email"))
    # not all letters of an Arrow batch first, which would hold all its prompts as Python strings
    assert all(e[0] == c[0] + 1 and e[1] == c[1] <= 8 for c, e in zip(covers, emails))
    assert len({c[0] for c in covers}) == 13
    assert [c[2] - covers[0][2] for c in covers] == [e[2] - emails[0][2] for e in emails] == [1000 * i for i in range(100)]
