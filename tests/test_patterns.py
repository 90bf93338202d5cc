"""Expressions that stand in for patterns, or keep them from being tried, against the plain patterns."""

from pyspark.sql import functions as F

from dealsift import rules
from dealsift.functions import address, times, url
from dealsift.functions.text import capture, squeeze
from dealsift.operators import classify
from dealsift.sources import details, pages

_URLS = [None, "", "https://", "http://a.com", "https://www.A.com/x;p=1/y;q/?a=1", "http://a.com?x=/1", "https://a.com/p?x=1?y=2", "https://u@www.www.b.com:80/p//", "HTTP://A.com/x",
         "//a.com/x?y", "a.com/x", "https://a.com/x#f?q", "https://a.com/x?q#f/g", "https://a.com/é中?é=1", "manual://x", "https:///p", "https://?q", "https://a.com/x\n?y\n", "mailto:a@b"]


def test_cut_urls_are_as_split_by_the_pattern(spark):
    links = spark.createDataFrame([(u,) for u in _URLS], "u string")
    u = F.col("u")
    part = [F.regexp_extract(u, url._SPLIT, i) for i in range(5)]
    for fast, slow in [(url.scheme(u), F.lower(part[1])), (url.host(u), part[2]), (url.query(u), part[4]), (url.path(u), F.regexp_replace(part[3], r";[^/]*$", "")),
                       (url.domain(u), F.regexp_replace(F.lower(part[2]), r"^www\.", ""))]:
        assert links.filter(~fast.eqNullSafe(slow)).collect() == []
    # a web address is cut, the pattern is left for the others
    assert "substring_index" in links.select(url.host(u))._jdf.queryExecution().optimizedPlan().toString()


def test_times_are_tried_where_their_words_occur(spark):
    texts = ["Auction ends: June 2, 2001 5:30 PM CDT", "CLOSING DATE 06/01/2001 11:15 pm EST", "(may 3, 2001 1:00 pm XYZ)", "(MAR 31, 2001 1:00 PM PDT)", "Sale end : sept 1, 2001 2:00 AM UTC", "Time left: 2 d 3 h",
             "TIME REMAINING", "2 days 3 hours", "4 HOURS 5 min left", "Ends in  7 hours", "day hour left ( / )", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    assert rows.filter(~times.absolute_end_raw(t).eqNullSafe(F.trim(F.coalesce(*[capture(t, p) for p in rules.END_TIME_PATTERNS])))).collect() == []
    parsed = [str(r[0]) for r in rows.select(times.parse_zoned(times.absolute_end_raw(t))).collect()]
    assert parsed[:5] == ["2001-06-02 22:30:00", "2001-06-02 04:15:00", "None", "2001-03-31 20:00:00", "None"]
    tried = [F.trim(capture(t, p)) for p in rules.COUNTDOWN_PATTERNS]
    assert rows.filter(~times.countdown_raw(t).eqNullSafe(F.coalesce(*[F.when(times.countdown_minutes(x) > 0, x) for x in tried]))).collect() == []
    assert rows.filter(times.countdown_raw(t).isNotNull()).count() > 1
    assert "contains" in rows.select(times.countdown_raw(t))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r[0] for r in spark.createDataFrame([("in texas or OH",), ("Ohioan",), ("new york, NY",)], "t string").select(address.hardware_state(t)).collect()] == ["TX", None, "NY"]


def test_white_space_and_rare_blocks_are_as_by_the_plain_patterns(spark):
    texts = ["a b", "a  b", "a\tb", " a\n\n b ", "a\u00a0 b\r", "", "  ", None, "x\x0b\x0cy"]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    assert rows.filter(~squeeze(t).eqNullSafe(F.trim(F.regexp_replace(t, r"\s+", " ")))).collect() == []
    html = ["<p>a</p><script>x</script>b", "<!-- c --><p>d</p>", "<STYLE a>s</STYLE >e", "<p>f<Template>g</template>h", "<script>var a = '<style>';</script>i<style>j</style>", None, "plain"]
    shown = spark.createDataFrame([(x,) for x in html], "t string").select(pages.visible_text(t)).collect()
    assert [r[0] for r in shown] == ["a b", "d", "e", "f h", "i", None, "plain"]


def test_outcome_follows_from_the_parse_status(spark):
    rows = [(200, "ok", False, None), (404, "captcha", False, None), (503, None, None, None), (None, "Robot Check", None, None), (200, "CAPTCHA", None, None), (None, None, True, None),
            (404, None, None, "broken"), (None, None, None, None), (200, None, True, "e")]
    c = F.col
    got = spark.createDataFrame(rows, "s int, b string, t boolean, e string").select(classify.http_outcome(c("s"), c("b"), c("t"), c("e")).alias("o")).select("o.*").collect()
    assert [tuple(r) for r in got] == [
        (None, None, False, "checked"), ("removed", "HTTP 404", False, "http_unavailable"), ("unavailable", "HTTP 503", False, "http_unavailable"),
        ("needs_manual_review", "captcha_or_access_challenge", False, "blocked_or_challenged"), ("needs_manual_review", "captcha_or_access_challenge", True, "blocked_or_challenged"),
        ("needs_manual_review", "detail_page_timeout", True, "timeout"), ("needs_manual_review", "broken", True, "parse_error"), (None, None, False, "checked"),
        ("needs_manual_review", "detail_page_timeout", True, "timeout")]


def test_unread_columns_of_a_hit_do_not_pass_the_detail_steps(spark):
    hits = spark.createDataFrame([("t", None, "https://www.publicsurplus.com/x?auc=1", 200, "<p>Time Left: 2 d 3 h</p>", False, None, None, "u")],
                                 "original_title string, original_description string, source_url string, http_status int, body string, timed_out boolean, error string, captured_at timestamp, unread string")
    read = details.with_details(hits)
    assert read.first().unread == "u" and read.first().detail.countdown_raw_text == "Time Left: 2 d 3 h".split(": ")[1]
    plan = read.select("original_title", "detail")._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Project" in line and "unread" in line] == []
