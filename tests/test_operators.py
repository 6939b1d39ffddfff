"""Hand-computed rows for the operators."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import distributions as D
from docloom.functions import mask, text, urls
from docloom.operators import chunk, curate, joins, logs, prep, stats, vectors
from docloom.sources import pages, readers, sinks


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_normal_form(spark):
    same = {one(spark, text.normalize_text(F.col("t")), t=t) for t in ("\u00e9 \ud55c", "e\u0301 \u1112\u1161\u11ab")}
    assert same == {"\u00e9 \ud55c"}


def test_normalize_text(spark):
    raw = "﻿ é​ \r\n\t a   b \x07\r\r\r\rc  "
    assert one(spark, text.normalize_text(F.col("t")), t=raw) == "\u00e9\na b\n\nc"  # composed
    assert one(spark, text.normalize_text(F.lit(None)), t="") == ""
    assert one(spark, text.normalize_review(F.col("t")), t="<p>a &amp; b</p><br/>　c é") == "a & b\nc é"


def test_keys_and_parsers(spark):
    assert one(spark, text.letters_key(F.col("t")), t=" A_b-C 1!") == "abc1"
    assert one(spark, text.nfkc_folded(F.col("t")), t="ＡＢ c　ß") == "abcss"
    dates = {"2024년 2월 9일": "2024-02-09", "20240230 2024-1-5": "2024-01-05", "on 20231231.": "2023-12-31", "2023-02-30": None, "none": None}
    for t, want in dates.items():
        assert one(spark, text.parse_date(F.col("t")).cast("string"), t=t) == want, t
    said = ["true", '"4"', "-1", '"NaN"', "5.0", "5.1", "3.5", "4", "[4]", "null", "1e400"]
    assert [one(spark, text.rating(F.parse_json(F.lit(x))), t="") for x in said[:-1]] == [None, None, None, None, 5.0, None, 3.5, 4.0, None, None]
    assert [one(spark, text.whole_number(F.parse_json(F.lit(x))), t="") for x in said[:-1]] == [None, None, None, None, 5, None, None, 4, None, None]
    assert [one(spark, text.votes(F.lit(x)), t="") for x in ("1,234", "12", "", "1,23")] == [1234, 12, 0, None]
    asked = [("quiz", None, 5), ("exam", None, 3), ("quiz", "7", 7), ("quiz", "50", 20), ("exam", "0", 1), ("summary", "4", None)]
    assert all(one(spark, text.item_count(F.lit(t), F.lit(n).cast("string")), t="") == want for t, n, want in asked)


def test_masking_goes_in_order_and_counts_what_it_finds(spark):
    t = "a.b@c.example 900101-1234567 010-1234-5678 tel 02 123 4567"
    masked, counts = mask.mask_personal_data(F.col("t"))
    assert one(spark, masked, t=t) == "[EMAIL] [RESIDENT_ID] [PHONE] tel [PHONE]"
    assert one(spark, counts, t=t) == {"email": 1, "resident_id": 1, "phone": 2}
    assert one(spark, counts, t="nothing") == {}


def test_urls(spark):
    u = "http://h.example/p;x?b=2&a=1&page=3&nonce=z&a=0#top"
    assert one(spark, urls.stable_url(F.col("u")), u=u) == "http://h.example/p;x?a=0&a=1&b=2"
    assert one(spark, urls.post_id(F.col("u")), u="http://h/?wr_id=&no=17&page=1") == "17"
    a, b = (one(spark, urls.post_id(F.col("u")), u=f"http://h/x?page={i}") for i in (1, 2))
    assert a == b and len(a) == 16


def test_dedupe_rules(spark):
    df = spark.createDataFrame([("A", 1, "five5"), ("B", 2, "b"), ("A", 3, "ninechars"), ("A", 4, "sevench"), ("A", 5, "ninecharz")], "k string, n int, t string")
    assert {r.k: (r.t, r.copies, r.first_seen.n) for r in prep.last_wins(df, ["k"], ["n"]).collect()} == {"A": ("ninecharz", 4, 1), "B": ("b", 1, 2)}
    assert {r.k: r.t for r in prep.longest_wins(df.where("n < 5"), ["k"], "t", ["n"]).collect()}["A"] == "ninechars"
    assert {r.k: r.t for r in prep.longest_wins(df, ["k"], "t", ["n"]).collect()}["A"] == "ninecharz"
    assert {r.k: r.t for r in prep.first_wins(df, ["k"], ["n"]).collect()}["A"] == "five5"
    assert prep.conflicts(df, ["k"], "t", ["n"]).count() == 3


def test_flags(spark):
    lines = lambda short, n: "\n".join(["abc"] * short + ["long line"] * (n - short))
    flags = prep.quality_flags(F.col("t"), F.lit(False))
    assert [one(spark, flags, t=t) for t in (lines(9, 9), lines(3, 10), lines(4, 10), "x�")] == [[], [], ["fragmented_lines"], ["replacement_character"]]
    fields = prep.field_flags({"rating": F.lit(None), "name": F.lit("x")}, F.lit(False))
    assert one(spark, fields, t="") == ["missing_or_invalid_rating", "content_based_identity"]


def test_boundary_chunks(spark):
    with pytest.raises(ValueError):
        chunk.boundary_chunks(spark.range(1).withColumn("text", F.lit("x")), size=100)
    df = spark.createDataFrame([(1, "short text."), (2, "x" * 2000), (3, "A sentence here. " * 100), (4, "")], "doc_id int, text string")
    got = chunk.boundary_chunks(df, size=300, overlap=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.chunk_text)
        assert len(r.chunk_text) <= 300
    assert by[1] == ["short text."] and "".join(by[2]).count("x") >= 2000 and 4 not in by and len(by[3]) > 1
    with pytest.raises(Exception, match="fewer than 100"):
        chunk.boundary_chunks(df, header=F.lit("h" * 250), size=300).collect()


@given(st.text("ab .!?\n”\u3000\x1c", max_size=400), st.integers(32, 90), st.integers(0, 15))
@settings(max_examples=200, deadline=None)
def test_spans_cover_the_text_and_progress(t, size, overlap):
    got = chunk.spans_of(t, size, overlap)
    assert (got == []) == (t == "")
    for (a, b), (c, d) in zip(got, got[1:], strict=False):
        assert a < c <= b < d
    assert not got or (got[0][0] == 0 and got[-1][1] == len(t))
    assert all(0 < b - a <= size for a, b in got)


@given(st.text("ab .!?\n”\u3000\x1c", max_size=400), st.integers(32, 90), st.integers(0, 15))
@settings(max_examples=200, deadline=None)
def test_spans_end_where_a_search_of_each_window_ends(t, size, overlap):
    """The rule, window by window, with regular expressions."""
    start = 0
    for first, last in chunk.spans_of(t, size, overlap):
        assert first == start
        end = min(start + size, len(t))
        if end < len(t):
            low = start + size // 2
            for p in (r"\n\n+", r"[.!?。！？][\"”’]?\s+|\n", r"\s+"):
                hits = [m.end() for m in re.finditer(p, t[low:end])]
                if hits:
                    end = low + hits[-1]
                    break
        assert last == end
        nxt = end - overlap
        gap = re.search(r"\s+", t[nxt:end]) if overlap else None
        start = max(start + 1, nxt + gap.end() if gap else nxt)


@given(st.lists(st.text("abc ", min_size=1, max_size=60).map(str.strip).filter(bool), max_size=12), st.integers(10, 60), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_packed_chunks_keep_every_word_and_the_limit(parts, limit, overlap):
    got = chunk.chunked(["\n".join(parts)], [limit], overlap)[0]
    assert all(len(c) <= limit for c in got)
    if parts:
        joined = "".join(got)
        assert all(ch in joined for ch in set("".join(parts)) - {" "})


def test_golden_question_groups(spark):
    q = spark.createDataFrame([(i, f"q{i}", f"2024-01-0{9 - i}") for i in (1, 2, 3, 4)], "id int, question string, created_at string")
    g = spark.createDataFrame([(0, "pipeline", [3]), (1, "cache", [1, 2, 99]), (2, "again", [1])], "position int, label string, question_ids array<int>")
    got = logs.question_groups(g, q).collect()
    assert [(r.label, r.questions, r.examples) for r in got] == [("cache", 2, ["q1", "q2"]), ("pipeline", 1, ["q3"])]


def test_majority_and_fleiss(spark):
    v = spark.createDataFrame([("a", x) for x in (1, 1, 2, 2)] + [("b", x) for x in (1, 1, 1, 2)] + [("c", x) for x in (1, 2, 3)], "unit string, v int")
    assert {r.unit: r.majority for r in stats.majority(v, ["unit"], "v").collect()} == {"a": "no_majority", "b": "1", "c": "no_majority"}
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 1)], "unit string, v int")
    assert stats.fleiss_kappa(same, ["unit"], "v").first()["kappa"] is None
    got = stats.fleiss_kappa(v, ["unit"], "v").first()
    assert (got.n_raters, got.n_units) == (4, 2)


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.04), (4, 0.03)], "i int, p double").withColumn("f", F.lit(0))
    got = {r.i: r.p_holm for r in stats.holm(df, ["f"], "p", ["i"]).collect()}
    assert got[2] is None and [round(got[i], 9) for i in (1, 4, 3)] == [0.03, 0.06, 0.06]


def test_paired_contrasts(spark):
    w = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 3.5)], "u int, a double, b double")
    r = stats.contrasts(w, {"b-a": {"b": 1.0, "a": -1.0}}, tests=True).first()
    assert r.n == 3 and math.isclose(r.mean_diff, 3.5 / 3) and math.isclose(r.t, r.dz * math.sqrt(3)) and 0 < r.p_t < 1 and math.isclose(r.p_wilcoxon, 0.25)
    lone = stats.contrasts(w.limit(1), {"b-a": {"b": 1.0, "a": -1.0}}, tests=True).first()
    assert lone.n == 1 and all(lone[c] is None for c in ("mean_diff", "sd", "t", "dz", "ci_low", "p_t", "p_wilcoxon"))
    flat = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 3.0)], "u int, a double, b double")
    assert stats.contrasts(flat, {"b-a": {"b": 1.0, "a": -1.0}}).first().dz is None
    d = stats.discordance(spark.createDataFrame([(1, 0), (1, 0), (0, 1), (1, 1)], "a int, b int"), [("a", "b")]).first()
    assert (d.only_a, d.only_b, d.diff_pp) == (2, 1, 25.0) and math.isclose(d.p, 1.0)


def test_distributions_against_known_values():
    assert math.isclose(D.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-9)
    assert math.isclose(D.t_tail(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(D.t_quantile(0.975, 1), 12.706204736432095, rel_tol=1e-9)
    assert math.isclose(D.sign_test(2, 10), 0.109375)
    assert D.sign_test(5, 10) == 1.0 and D.sign_test(0, 0) == 1.0
    assert math.isclose(D.signed_rank(5, 0, 0, True), 0.0625)
    assert math.isclose(D.sign_test(480, 1001), min(1, 2 * sum(math.comb(1001, i) for i in range(481)) / 2**1001), rel_tol=1e-9)


def test_distributions_against_integration():
    """Student's t by adding up its density."""
    for df in (1, 2, 7, 40):
        c = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
        for t in (0.3, 1.7, 4.0):
            steps = 20_000
            inside = sum((1 + (t * (i + 0.5) / steps) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps)) * t / steps * c
            assert math.isclose(D.t_tail(t, df), 1 - 2 * inside, abs_tol=1e-8)
            assert math.isclose(D.t_quantile(0.5 + inside, df), t, rel_tol=1e-6)


@given(st.lists(st.integers(-9, 9), min_size=2, max_size=40))
@settings(max_examples=12, deadline=None)
def test_wilcoxon_by_counting_ranks(spark, xs):
    from docloom.operators import stats

    rows = spark.createDataFrame([(float(x), 0.0) for x in xs], "a double, b double")
    got = stats.contrasts(rows, {"d": {"a": 1.0, "b": -1.0}}, tests=True).first()
    d = [x for x in xs if x]
    if not d:
        assert got.p_wilcoxon is None
        return
    rank = {v: sum(abs(x) < v for x in d) + (sum(abs(x) == v for x in d) + 1) / 2 for v in map(abs, d)}
    low = min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
    ties = sum(n**3 - n for n in (sum(abs(x) == v for x in d) for v in set(map(abs, d))))
    n = len(d)
    if ties == 0 and n == len(xs):
        signs = [sum(r for r, s in zip(sorted(rank.values()), format(i, f"0{n}b"), strict=True) if s == "1") for i in range(2**n)]
        want = min(1.0, 2 * sum(s <= low for s in signs) / 2**n)
    else:
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        want = math.erfc(abs(low - n * (n + 1) / 4) / sd / math.sqrt(2))
    assert math.isclose(got.p_wilcoxon, want, rel_tol=1e-9)
    mean, sd = sum(xs) / len(xs), math.sqrt(sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / (len(xs) - 1))
    half = D.t_quantile(0.975, len(xs) - 1) * sd / math.sqrt(len(xs))
    assert math.isclose(got.ci_low, mean - half, abs_tol=1e-9) and math.isclose(got.ci_high, mean + half, abs_tol=1e-9)


def test_curation(spark):
    df = spark.createDataFrame([(1, "What is it?", "x" * 40), (2, "what  IS it?", "y" * 40), (3, "Hm", "z" * 40), (4, "A question", "scanned_ things that were never read"), (5, None, "q" * 40)], "i int, q string, a string")
    assert {r.i: r.drop_reason for r in curate.drop_reasons(df, "q", "a", ["i"]).collect()} == {1: "kept", 2: "duplicate", 3: "too_short", 4: "crawl_status", 5: "malformed"}
    assert one(spark, curate.good_pair(F.lit("a question"), F.lit("가나다라" * 6)), t="") and not one(spark, curate.good_pair(F.lit("a question"), F.lit("abcd" * 6)), t="")
    record = curate.valid_record(F.col("t"), F.lit("notices"))
    assert one(spark, record, t="Home > News > Item that has quite some letters. And ends. Well.") is False
    assert one(spark, record, t="A notice that has quite some letters. And it ends well. Yes.") is True


def test_joins(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.lookup(left, spark.createDataFrame([(1, 5), (2, 6)], "k int, w int"), ["k"]).count() == 2
    with pytest.raises(Exception, match="no match"):
        joins.lookup(left, spark.createDataFrame([(1, 5)], "k int, w int"), ["k"]).collect()
    with pytest.raises(Exception, match="several"):
        joins.lookup(left, spark.createDataFrame([(1, 5), (1, 7), (2, 6)], "k int, w int"), ["k"]).collect()


def test_index_maintenance_is_idempotent_and_encodes_the_delta_only(spark):
    encode = vectors.hashing_embedder(4)
    df = spark.createDataFrame([("a", "one two", "h1", "m"), ("b", "two", "h2", "m")], "chunk_id string, chunk_text string, content_hash string, metadata string")
    stored = encode(df).withColumn("active", F.lit(True))
    seen = []

    def counting(delta):
        seen.append(delta.count())
        return encode(delta)

    again = vectors.maintain(stored, df, counting)
    assert seen == [0] and again.where("active").count() == 2
    nxt = vectors.maintain(stored, df.where("chunk_id = 'a'").withColumn("content_hash", F.lit("h9")), counting)
    assert seen[-1] == 1 and {r.chunk_id: r.active for r in nxt.collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError):
        vectors.check_ready({"state": "indexing", "active": 2}, "m", 4)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "1", "t": "x"}\n\n{bad\n[1]\n{"id": "", "t": "y"}\n{"id": "2", "t": 5}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.StringType())])
    rules = [("empty_id", F.trim(F.coalesce(F.col("row.id"), F.lit(""))) == "")]
    done = readers.checked(readers.numbered_lines(spark, str(tmp_path)), schema, rules)
    good, counts, examples = readers.quarantine(done)
    assert sorted(r.line for r in good.collect()) == [1, 6]
    assert {r.reject_reason: r.rows for r in counts.collect()} == {"invalid_json": 1, "not_object": 1, "empty_id": 1}
    assert [r.line for r in examples.collect()] == [3, 4, 5]
    with pytest.raises(Exception, match="bad row"):
        readers.strict(done).collect()
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "R1.csv").write_text("question_id,blind_label,rater_id,accuracy,response_type,notes\nq1,A,,5,1,\nq1,B,me,6,1,\nq2,A,,4.0,2,x\n")
    ok, bad = readers.ratings(spark, str(tmp_path / "r"))
    assert sorted((r.question_id, r.rater_id, r.accuracy) for r in ok.collect()) == [("q1", "R1", 5), ("q2", "R1", 4)] and bad.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = str(tmp_path / "out")
    sinks.write_new(df, path)
    with pytest.raises(Exception, match="exists"):
        sinks.write_new(df, path)
    with pytest.raises(ValueError):
        sinks.write_new(df.limit(0), path, overwrite=True)
    with pytest.raises(ValueError):
        sinks.check_paths("a", "a/")


def test_pages(spark):
    h = "<html><style>s</style><p>One</p><a href='/x'>X <b>y</b></a><a href='/x'>again</a><img src='i.png'><script>no</script>"
    r = spark.createDataFrame([(h, "http://h/p/q")], "h string, u string").select(pages.html_text("h").alias("t"), pages.html_links("h", "u").alias("l"), pages.html_images("h", "u").alias("i"), pages.signature(F.col("h").cast("binary")).alias("s")).first()
    assert (r.t, r.l[0].url, r.l[0].name, len(r.l), r.i, r.s) == ("One\nX\ny\nagain", "http://h/x", "X y", 1, ["http://h/p/i.png"], "html")
    kinds = {b"PK\x03\x04..": "zip", b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff\xe0": "jpeg", b"..%PDF-1.7": "pdf", b"what": "unknown"}
    for data, kind in kinds.items():
        assert one(spark, pages.signature(F.lit(bytearray(data))), t="") == kind
    assert one(spark, pages.decoded(F.lit(bytearray("한글".encode("cp949")))), t="") == "한글"


def test_rouge(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat down"), ("", "x"), ("b a", "a b")], "a string, b string")
    words, score = stats.rouge_l("a", "b")
    assert [round(r.r, 6) for r in df.withColumns(words).where("a <> ''").select(score.alias("r")).collect()] == [0.857143, 0.5]
    assert df.withColumns(words).where("a = ''").select(score.alias("r")).first().r is None


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, "a"), (2, None, "b")], "k int, x double, status string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r.x or "" for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["", "0.1235"]
    sinks.write_report(df.agg(F.count("*").alias("rows"), F.lit(None).cast("string").alias("none")), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == '{"rows":2,"none":null}'
    assert sinks.copy_legacy(df.limit(0), df).select("status").distinct().collect()[0][0] == "legacy"
    assert sinks.copy_legacy(df, df).where("status = 'legacy'").count() == 0
    same = sinks.unchanged_input(spark, str(tmp_path / "report"))
    assert same()
    sinks.write_report(df.agg(F.count("*").alias("rows")), str(tmp_path / "report"))
    assert not same()


def test_courses_and_repair(spark):
    c = spark.createDataFrame([("A", True), ("A", True), ("B", False)], "course_code string, is_major boolean")
    assert prep.select_courses(c).count() == 1 and prep.select_courses(c, include_other=True).count() == 2
    assert prep.select_courses(c, ["A"]).count() == 1
    with pytest.raises(Exception, match="not among"):
        prep.select_courses(c, ["B"]).collect()
    kind = "id int, att array<struct<name:string,text:string>>"
    items = spark.createDataFrame([(1, [("a.pdf", ""), ("b.txt", "")]), (2, [("c.pdf", "has")])], kind)
    r = prep.repair(items, "att", lambda a: F.concat(F.lit("text of "), a["name"]), lambda x: F.md5(F.to_json(x))).collect()
    assert [(x.id, x.repaired, x.att[0].text, x.att[1].text) for x in r] == [(1, 1, "text of a.pdf", "")]


def test_hooks(spark):
    from docloom.operators import hooks

    waits = []
    calls = []

    def provider(rows):
        calls.append(len(rows))
        if len(calls) == 1:
            raise hooks.Overloaded
        return [r.upper() for r in rows]

    assert hooks.with_retries(provider, sleep=waits.append)(["a", "b"]) == ["A", "B"] and waits == [5.0]
    assert hooks.with_retries(lambda rows: ["x"])(["a", "b"]) == [None, None]
    with pytest.raises(hooks.Exhausted):
        hooks.with_retries(lambda rows: (_ for _ in ()).throw(hooks.Exhausted()))(["a"])
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, t string")
    got = hooks.ask_once(df.where("t IS NOT NULL"), "t", "out", lambda rows: [r * 2 for r in rows]).collect()
    assert {r.k: r.out for r in got} == {1: "aa", 2: "aa"}


def test_record_fields(spark):
    from docloom.functions import records as r

    semesters = {"24년 1학기 수강자": "2024-1학기", "2023-2학기": "2023-2학기", "2024 fall": "2024-2학기", "none": None}
    assert {t: one(spark, r.semester_of(F.col("t")), t=t) for t in semesters} == semesters
    assert one(spark, r.disposition_name(F.col("t")), t="attachment; filename*=UTF-8''a%20b.pdf") == "a b.pdf"
    assert one(spark, r.disposition_name(F.col("t")), t='attachment; filename="x.hwp"') == "x.hwp"
    assert one(spark, r.extension(F.lit("n"), F.lit("http://h/a.PDF?x=1"), F.lit("text/html"), {"text/html": ".html"}), t="") == ".pdf"
    assert one(spark, r.extension(F.lit("n"), F.lit("http://h/a"), F.lit("text/html; charset=x"), {"text/html": ".html"}), t="") == ".html"
    assert one(spark, r.labelled(F.col("t"), "Room", "강의실"), t="x\n강의실: B 12 \n") == "B 12"
    assert one(spark, r.credit_hours(F.col("t"))["lecture"], t="credit 3-2-1") == 2
    assert one(spark, r.text_body([F.col("t")], F.create_map(F.lit("k"), F.lit("a value that is longer than twenty"))), t=" ") == "a value that is longer than twenty"


def test_ordered_windows_in_ranges_and_in_one(spark):
    import random

    from docloom.operators import ordered

    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.choice([None, *range(40)]), i, rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, i int, v int")
    got = {}
    for each in (7, 10**6):
        n = ordered.numbered(df, ["k"], ["at", "i"], "n", each)
        n = ordered.previous(ordered.running(n, ["k"], ["at", "i"], "v", "before", each), ["k"], ["at", "i"], "v", "last", each)
        got[each] = {r.i: (r.n, r.before, r.last) for r in n.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for j, r in enumerate(own):
            want[r[2]] = (j + 1, sum(x[3] for x in own[:j]), own[j - 1][3] if j else None)
    assert got[7] == got[10**6] == want
    assert ordered.numbered(df.limit(0), [], ["at"], "n", 3).count() == 0
    assert sorted(r.n for r in ordered.numbered(df, [], ["i"], "n", 10).collect()) == list(range(1, 301))


def test_describe_by_ranks(spark, monkeypatch):
    import numpy as np

    from docloom.operators import ordered

    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["a", "b"])), None if i % 17 == 0 else float(rng.integers(0, 30)) / 2) for i in range(400)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for each in (20, 10**6):
        monkeypatch.setattr(ordered, "SMALL", -1)
        monkeypatch.setattr(ordered, "ROWS_EACH", each)
        got = {r.g: r for r in stats.describe(df, [[], ["g"]], "v").collect()}
        for g in ("ALL", "a", "b"):
            x = [v for k, v in rows if v is not None and g in ("ALL", k)]
            want = np.quantile(x, [0.5, 0.25, 0.75, 0.95])
            assert got[g].n == len(x) and np.allclose([got[g].median, got[g].q1, got[g].q3, got[g].p95], want) and np.isclose(got[g].sd, np.std(x, ddof=1))
        assert got["none"].n == 0 and got["none"].median is None


def test_nearest_in_blocks_and_slices(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[7] = x[8]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(df, df.where("vec_id < 20"), 4, block=6, slice_rows=11).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(20):
        d = np.round(1 - unit @ unit[q], 12)
        assert [i for _, i in sorted(got[q])] == sorted(range(60), key=lambda i: (d[i], i))[:4]
    assert vectors.nearest(df, df.limit(0), 4).count() == 0
    signed = vectors.hashing_embedder(16)(spark.createDataFrame([("some words of a text that hash to signs",)], "chunk_text string")).first().embedding
    assert min(signed) < 0 < max(signed) and math.isclose(sum(v * v for v in signed), 1, rel_tol=1e-5)


def test_contracts(spark):
    from docloom.operators import checks

    good = ("lecture:1", "1", "lecture_review", "text")
    rows = [good, ("x:1", "1", "lecture_review", "text"), ("lecture:1", "a1", "lecture_review", "text"), ("lecture:1", "1", None, "text"), ("lecture:1", "1", "lecture_review", " ")]
    df = spark.createDataFrame(rows, "chunk_id string, lecture_id string, source_type string, chunk_text string").withColumn("content_hash", F.sha2("chunk_text", 256))
    assert {r.reason: r.rows for r in checks.violations(df, checks.review_chunk_rules()).collect()} == {"chunk_id": 1, "lecture_id": 1, "source_type": 1, "chunk_text": 1}
    assert checks.require(df.limit(1), checks.review_chunk_rules(), "chunk_id").count() == 1
    stale = df.limit(1).withColumn("chunk_text", F.lit("other"))
    with pytest.raises(Exception, match="contract broken by lecture:1 content_hash"):
        checks.require(stale, [checks.hash_rule()], "chunk_id").collect()
    with pytest.raises(Exception, match="content_hash"):
        chunk.span_chunks(checks.require(stale, [checks.hash_rule()], "chunk_id"), text="chunk_text", key="chunk_id").collect()
    assert [one(spark, checks.answered(F.lit(x).cast("string")), t="") for x in ("yes", " ", "[ERROR] x", None)] == [True, False, False, False]
    b = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "c string, k int")
    assert {r.c: r.ok for r in checks.balance(b, "c", "k", 2, ["a", "b", "d"]).collect()} == {"a": True, "b": False, "d": False}
    status = checks.scan_status(F.lit(3), F.lit(None).cast("int"), F.lit(False))
    assert one(spark, status, t="") == "scanned_completeness_unverified"
    hits = spark.createDataFrame([(1, "q1", 7), (1, "q2", 7), (2, "q1", 8), (2, "q1", 9)], "course int, query string, lecture int")
    runs = spark.createDataFrame([(1, "q1", None), (2, "q1", None), (3, "q1", None), (4, "q1", "late")], "course int, query string, error string")
    before = spark.createDataFrame([(4, [(5, ["q0"])])], "course int, candidates array<struct<lecture:int,found_by:array<string>>>")
    got = {r.course: r for r in checks.search_states(hits, runs, before).collect()}
    assert {c: r.status for c, r in got.items()} == {1: "candidates_found", 2: "needs_check", 3: "no_results", 4: "error"}
    assert got[1].candidates[0].found_by == ["q1", "q2"] and got[4].candidates[0].lecture == 5


def test_replacing_appending_and_locking(spark, tmp_path):
    import os

    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = str(tmp_path / "out")
    sinks.write_new(df, path, overwrite=True)
    sinks.write_new(df.withColumn("v", F.lit("b")), path, overwrite=True)
    assert [r.v for r in spark.read.json(path).collect()] == ["b"] and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception):
        sinks.write_new(df.withColumn("v", F.raise_error(F.lit("broken"))), path, overwrite=True)
    assert [r.v for r in spark.read.json(path).collect()] == ["b"]
    sinks.append(df, path)
    assert spark.read.json(path).count() == 2
    sinks.truncate(spark, path)
    assert os.listdir(path) == []
    with sinks.single_writer(spark, path):
        with pytest.raises(RuntimeError, match="another writer"), sinks.single_writer(spark, path):
            pass
    with sinks.single_writer(spark, path):
        pass
    sinks.write_csv(df, str(tmp_path / "csv"))
    part = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfk,v")


def test_readers_by_name_and_lenient(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "notices_1.jsonl").write_text('{"a": 1}\n{bad\n{"b": "x"}\n')
    (tmp_path / "in" / "other.jsonl").write_text('{"a": 2}\n')
    rows = readers.by_file_name(spark, str(tmp_path / "in"), {"notices": "notice"}).collect()
    assert len(rows) == 3 and {r.category for r in rows} == {"notice"}
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    got = readers.lenient(spark, str(tmp_path / "in" / "notices_1.jsonl"), schema, {"b": F.lit("none")}).collect()
    assert sorted((r.a or 0, r.b) for r in got) == [(0, "x"), (1, "none")]


def plain_chunks(text, size=700, overlap=100, head=""):
    """The boundary chunker once more, a text at a time: pieces by lines and sentences, packed with a tail."""
    t = re.sub(r"\n{3,}", "\n\n", re.sub("\r\n?", "\n", text).strip())
    limit = size - len(head) - 2 if head else size
    pieces = [s.strip() for line in re.split("[\n\x0b\f\x1c-\x1e\x85\u2028\u2029]+", t) for s in re.split(r"(?<=[.!?。！？])\s+", line.strip()) if s.strip()]

    def fit(p):
        if len(p) <= limit:
            return [p] if p else []
        words = p.split()
        if len(words[0]) > limit:
            return [words[0][i : i + limit] for i in range(0, len(words[0]), limit)] + fit(" ".join(words[1:]))
        n = max(k for k in range(1, len(words) + 1) if len(" ".join(words[:k])) <= limit)
        return [" ".join(words[:n]), *fit(" ".join(words[n:]))]

    parts = [x for p in pieces for x in fit(p)]
    out = []
    for p in parts:
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] += "\n" + p
            continue
        tail = out[-1][-min(overlap, limit - 1) :] if out else ""
        if out and len(tail) < len(out[-1]):
            gap = re.search(r"\s+", tail)
            tail = tail[gap.end() :] if gap and gap.end() < len(tail) else tail
        out.append(f"{tail}\n{p}" if tail and len(tail) + 1 + len(p) <= limit else p)
    return [f"{head}\n\n{c}" if head else c for c in out]


@given(st.lists(st.tuples(st.text("abcd .!?\n\n。\u3000\x1c\u2028\t", max_size=300), st.integers(10, 90)), max_size=6), st.integers(0, 40))
@settings(max_examples=400, deadline=None)
def test_blocks_of_odd_texts_are_packed_as_one_by_one(rows, overlap):
    texts = [re.sub(r"\n{3,}", "\n\n", t.strip()) for t, _ in rows]
    want = [plain_chunks(t, n, overlap) for t, (_, n) in zip(texts, rows, strict=True)]
    assert chunk.chunked(texts, [n for _, n in rows], overlap) == want
    few, chunk.BLOCK = chunk.BLOCK, 100
    try:
        assert chunk.chunked(texts, [n for _, n in rows], overlap) == want
    finally:
        chunk.BLOCK = few


def test_boundary_chunks_of_a_table_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in chunk.boundary_chunks(d, header=F.concat(F.lit("source: "), F.col("source"))).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk_text
        assert r.chunk_count > r.chunk_index
    for r in d.collect():
        assert [c for _, c in sorted(got.get(r.doc_id, {}).items())] == plain_chunks(r.text, head=f"source: {r.source}")


def test_links_and_texts_of_a_table_by_patterns(spark):
    from html import unescape
    from urllib.parse import urljoin

    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = p.select("html", "url", pages.html_text("html").alias("t"), pages.html_links("html", "url").alias("l")).collect()
    for r in got:
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", r.html)
        links = list(dict.fromkeys(urljoin(r.url, unescape(h)) for h in re.findall(r"""(?i)<a\s[^>]*?href=["']?([^"'>]+)""", bare)))
        assert [x.url for x in r.l] == links
        words = [w for run in re.split(r"<[^>]*>", bare) for w in unescape(run).split()]
        assert r.t.split() == words


@given(st.lists(st.text("ab-", min_size=1, max_size=30), min_size=1, max_size=30), st.integers(5, 25))
@settings(max_examples=200, deadline=None)
def test_long_pieces_are_fitted(words, limit):
    got = [line for c in chunk.chunked([" ".join(words)], [limit], 0)[0] for line in c.split("\n")]
    assert all(0 < len(p) <= limit for p in got) and "".join(got).replace(" ", "") == "".join(words)
    want, line = [], []
    if sum(map(len, words)) + len(words) - 1 <= limit:
        want = [" ".join(words)]
    else:
        for w in [*words, None]:
            if line and (w is None or len(w) > limit or len(" ".join([*line, w])) > limit):
                want.append(" ".join(line))
                line = []
            if w is not None and len(w) > limit:
                want += [w[i : i + limit] for i in range(0, len(w), limit)]
            elif w is not None:
                line.append(w)
    assert got == want


def test_rows_kinds_and_keys(spark):
    from docloom.operators import checks, hooks

    h = "<ul><li><a href='/a'>One <b>x</b></a></li><li>two</li></ul><table><tr><th>h</th></tr><tr><td>c <a href='d'>e</a></td><td> f </td></tr></table>"
    r = spark.createDataFrame([(h, "http://s/p/")], "h string, u string").select(pages.html_rows("h", "u").alias("r")).first().r
    assert [(x.cells, x.url) for x in r] == [(["One x"], "http://s/a"), (["two"], None), (["h"], None), (["c e", "f"], "http://s/p/d")]
    kinds = [(b"%PDF-1.7", "x"), (b"PK\x03\x04", "a.hwpx"), (b"PK\x03\x04", "a.zip"), (b"plain", "a.txt"), (b"plain", None), (b"\xff\xd8\xff", "i")]
    df = spark.createDataFrame([(bytearray(b), n) for b, n in kinds], "b binary, n string").select(pages.attachment_text(F.col("b"), F.col("n")).alias("a"))
    assert [(x.a.kind, x.a.method, x.a.text) for x in df.collect()] == [("pdf", "provider", None), ("hwpx", "native", None), ("other", "none", None), ("text", "native", "plain"), ("other", "none", None), ("image", "provider", None)]
    rows = spark.createDataFrame([("s1", "pdf", "x"), ("s1", "hwp", "x"), ("s1", "pdf", "x"), ("s2", "pdf", "y")], "sha string, kind string, data string")
    known = spark.createDataFrame([("s2", "pdf", "old")], "sha string, kind string, out string")
    got = hooks.ask_once(rows, "data", "out", lambda xs: [x * 2 for x in xs], known, ["sha", "kind"]).collect()
    assert sorted((x.sha, x.kind, x.out) for x in got) == [("s1", "hwp", "xx"), ("s1", "pdf", "xx"), ("s1", "pdf", "xx"), ("s2", "pdf", "old")]
    assert [one(spark, text.scalar_text(F.parse_json(F.lit(j))), t="") for j in ('"a  b"', "12", "true", "null", "[1]", '{"a":1}')] == ["a b", "12", "true", "", "", ""]
    assert checks.require_unique(rows, ["sha", "kind", "data"]).limit(0).count() == 0
    with pytest.raises(Exception, match="not unique: s1 pdf"):
        checks.require_unique(rows, ["sha", "kind"]).collect()


@pytest.mark.parametrize("kind", ["string", "date", "decimal(12,2)", "timestamp", "long"])
def test_ordered_windows_by_any_type_with_ties_and_clashing_names(spark, monkeypatch, kind):
    import random

    from docloom.operators import curate, logs, ordered, prep
    from docloom.streaming import incremental

    rng = random.Random(kind)
    at = lambda i: {"string": f"k{i:03}", "date": f"2024-01-{i % 28 + 1:02}", "timestamp": f"2024-01-{i % 28 + 1:02} 05:00:00"}.get(kind, str(i))
    rows = [(rng.choice("aaab"), None if i % 19 == 0 else at(rng.randint(0, 25)), i, rng.randint(0, 3), 1, 2, 3, 4) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o string, i int, v int, _range int, _before int, _n int, turn int").withColumn("o", F.col("o").cast(kind))
    results = []
    for small, each in ((-1, 3), (1 << 40, 3)):
        monkeypatch.setattr(ordered, "SMALL", small)
        monkeypatch.setattr(ordered, "ROWS_EACH", each)
        order = ["o", "i"]
        made = [
            ordered.numbered(df, ["k"], order, "number"),
            ordered.running(df, ["k"], order, "v", "sum", total="all"),
            ordered.previous(df, ["k"], order, "v", "last"),
            prep.conflicts(df, ["k"], "v", order),
            curate.batches(df.withColumn("t", F.col("i").cast("string")), ["k"], order, "t", 4),
            curate.interleaved(df, "k", order, {"b": 3, "a": 9}),
            incremental.until_quota(df, "k", F.col("v") > 1, order, 4),
            incremental.until_empty(df, "k", F.col("v") - 1, order, 2),
            logs.evenly_spread(df, order, F.lit("2024-02-01 00:00:00").cast("timestamp")),
        ]
        results.append([sorted(map(str, d.collect())) for d in made])
        assert [r for r in made[1].select("_range", "_before").distinct().collect()] == [(1, 2)]
    assert results[0] == results[1]


def test_complete_arms_and_contrasts_leave_out_infinities(spark):
    from docloom.operators import joins

    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", float("inf")), (2, "b", 1.0), (3, "a", float("nan")), (3, "b", 1.0), (4, "a", None), (4, "b", 1.0), (5, "a", 3.0), (5, "b", 5.0)]
    wide = joins.complete_arms(spark.createDataFrame(rows, "u int, arm string, v double"), "u", "arm", "v", ["a", "b"])
    assert sorted(r.u for r in wide.collect()) == [1, 5]
    every = spark.createDataFrame([(1.0, 2.0), (float("-inf"), 1.0), (3.0, 5.0)], "a double, b double")
    r = stats.contrasts(every, {"b - a": {"b": 1, "a": -1}}).first()
    assert (r.n, r.mean_diff) == (2, 1.5)


def test_dates_before_a_floor_go_and_unknown_ones_stay(spark):
    from docloom.operators import curate

    df = spark.createDataFrame([("2024-01-01",), ("2023-12-31",), (None,), (" ",), ("",)], "d string")
    assert [r.d for r in df.where(curate.not_before(F.col("d"), "2024-01-01")).collect()] == ["2024-01-01", None, " ", ""]


def test_rouge_of_long_and_empty_texts(spark):
    import random

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    texts = [([rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcd") for _ in range(rng.randint(0, 90))]) for _ in range(200)]
    texts.append(([str(rng.randint(0, 300)) for _ in range(2500)], [str(rng.randint(0, 300)) for _ in range(2000)]))
    big = [str(rng.randint(0, 5000)) for _ in range(20000)]
    texts.append((big, big[:10000] + big[10001:]))
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(texts)], "i int, a string, b string")
    words, score = stats.rouge_l("a", "b")
    got = {r.i: r.s for r in df.withColumns(words).select("i", score.alias("s")).collect()}
    for i, (a, b) in enumerate(texts[:-1]):
        assert got[i] == (None if not a or not b else pytest.approx(2 * length(a, b) / (len(a) + len(b))))
    assert got[len(texts) - 1] == pytest.approx(2 * 19999 / 39999)
    odd = spark.createDataFrame([(None, "x"), ("", "x"), ("?!", "x"), ("x", "y")], "a string, b string").withColumns(words)
    assert [r.s for r in odd.select(score.alias("s")).collect()] == [None, None, 0.0, 0.0]


def test_updates_with_repeated_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "k int, v string, at int")
    for f in (lambda o: sinks.upsert(base, twice, ["k"], o), lambda o: sinks.refresh(base, twice, ["k"], "v", o)):
        with pytest.raises(Exception, match="more than once"):
            f(None).collect()
    assert sorted((r.k, r.v) for r in sinks.upsert(base, twice, ["k"], ["at"]).collect()) == [(1, "x"), (2, "b"), (3, "z")]
    assert sorted((r.k, r.v, r.changed) for r in sinks.refresh(base, twice, ["k"], "v", ["at"]).collect()) == [(1, "x", True), (2, "b", False)]


def test_bootstrap_against_plain_resampling(spark):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(f"c{i % 7}", float(rng.integers(0, 9)), None if i == 5 else float(rng.integers(0, 9) + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    got = stats.bootstrap_interval(df, "c", "x", "y", reps=60, seed=3).first()
    names, pearson, spearman = [f"c{i}" for i in range(7)], [], []
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for rep in range(1, 61):
        drawn = [names[int(hashlib.md5(f"3:{rep}:{d}".encode()).hexdigest()[:15], 16) % 7] for d in range(7)]
        x, y = (np.array([r[k] for c in drawn for r in rows if r[0] == c and r[2] is not None]) for k in (1, 2))
        pearson.append(np.corrcoef(x, y)[0, 1])
        spearman.append(np.corrcoef(rank(x), rank(y))[0, 1])
    want = [*np.percentile(pearson, [2.5, 97.5]), *np.percentile(spearman, [2.5, 97.5])]
    assert got.repetitions == 60 and np.allclose([got.pearson_low, got.pearson_high, got.spearman_low, got.spearman_high], want)
    few = stats.bootstrap_interval(df.where("c IN ('c1', 'c2')"), "c", "x", "y", reps=5).first()
    assert few.repetitions == 0 and few.pearson_low is None and few.spearman_high is None
    same = stats.bootstrap_interval(df.withColumn("x", F.lit(1.0)), "c", "x", "y", reps=5).first()
    assert same.repetitions == 0 and same.pearson_low is None


def test_damaged_documents_arrays_digests_and_models(spark, tmp_path):
    import hashlib
    import io
    import zipfile

    from docloom.operators import checks

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Contents/section0.xml", "<s xmlns:h='x'><h:p><h:t>one</h:t><h:t> two</h:t></h:p><h:p/></s>" + " " * 500)
    whole = data.getvalue()
    assert pages.hwpx_paragraphs(whole) == "one two"
    for at in range(30, len(whole), 3):  # read or refused, whatever is damaged
        found = pages.hwpx_paragraphs(whole[:at] + b"\xff\x00" + whole[at + 2 :])
        assert found is None or isinstance(found, str)
    left, pages.UNPACKED = pages.UNPACKED, 50
    assert pages.hwpx_paragraphs(whole) is None
    pages.UNPACKED = left
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text('[\n {"k": 1},\n {"k": 2, "t": "x"}]')
    assert sorted((r.k, r.t) for r in readers.json_array(spark, str(tmp_path / "a"), "k long, t string").collect()) == [(1, None), (2, "x")]
    (tmp_path / "a" / "two.json").write_text("[{")
    with pytest.raises(Exception, match="no JSON array"):
        readers.json_array(spark, str(tmp_path / "a"), "k long, t string").collect()
    (tmp_path / "b").mkdir()
    files = {"small": b"abc", "large": b"z" * 5000}
    for name, content in files.items():
        (tmp_path / "b" / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in sinks.file_digests(spark, str(tmp_path / "b"), whole=100).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    served = spark.createDataFrame([(" Base ",), ("rag",)], "model string")
    assert [tuple(r) for r in checks.missing_models(served, ["base", "base_rag", "lora"]).collect()] == [("lora", "lora")]
    checks.require_models(served, ["base", "base_rag"])
    with pytest.raises(ValueError, match="not served: lora"):
        checks.require_models(served, ["lora"])
    with pytest.raises(ValueError, match="no serving mode"):
        checks.missing_models(served, ["other"])


def test_a_lost_replacement_is_put_back(spark, tmp_path):
    import os

    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = str(tmp_path / "out")
    sinks.write_new(df, path)
    os.rename(path, path + ".old-1")  # a job was lost between its renames
    (tmp_path / "out.new-2").mkdir()
    assert sinks.recovered(spark, path) and not sinks.recovered(spark, path)
    assert [r.v for r in spark.read.json(path).collect()] == ["a"] and os.listdir(tmp_path) == ["out"]
    os.rename(path, path + ".old-3")
    sinks.write_new(df.withColumn("v", F.lit("b")), path, overwrite=True)
    assert [r.v for r in spark.read.json(path).collect()] == ["b"] and os.listdir(tmp_path) == ["out"]
