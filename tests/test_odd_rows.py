"""Queries over rows that the given tables do not hold: empty and blank texts, references that are cut off, halves in the last place."""

import duckdb
import numpy as np
import pytest
from compare import compare

from docloom.operators import prep
from docloom.plans import catalog

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def differences(spark, tmp_path):
    """What differs between a query and its SQL over a table of these rows."""

    def compared(name, table, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        return compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))

    return compared


def test_empty_texts_have_no_share_of_spaces_and_are_counted(spark, tmp_path):
    texts = ["a b c", "", "dd ee", "f", "g h", None, ""]
    rows = [(i, t, "en", "src1", 3 * i % 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["correlation_tests"](spark, str(tmp_path)).collect()
    shares = [(n, t.count(" ") / len(t) if t else 0.0) for _, t, _, _, n in rows if t is not None]
    assert [(r.lang, r.n, r.pearson) for r in got] == [("en", 6, round(float(np.corrcoef(*zip(*shares))[0, 1]), 6))]


PAGES = "page_id long, url string, html string"
CUT = ["fish &amp; chips &am", "fish &amp", "a&b &copy; &quot", "&quot;q&quot; & &quo", "R&amp;D &amp;amp; &ampx &copyright &a1", "&"]


def test_references_that_are_cut_off_stay_in_attachments(differences):
    page = "<!DOCTYPE html><html><head><title>{0}</title><script>if (a &amp b) c();</script></head><body class='{0}'><p>{0}</p>{0}<br>"
    assert differences("attachment_contents", "pages", [(2 * i, f"https://h/{i}", page.format(t)) for i, t in enumerate(CUT)] + [(1, "https://h/&am", "x")], PAGES) == ""


TEXTS = ["", " ", "\n", " \t\n a", "a\n", "a\r\n", "a\n\n조회수 5\nb", "목록", "작성자: x\n 이전글 y", "\u00a0a\u2028조회수\u0085", "\ue000a\n\ue000\ue000b\r\ue000", "조회수", None, "a 목록 b"]


def test_lines_of_texts_are_no_boilerplate(differences):
    assert differences("boilerplate_lines", "documents", [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)] + [(99, "a", "en", None, 1)], DOCUMENTS) == ""


def test_vectors_show_halves_as_the_even_digit(differences):
    counts = [(31, 7, 3, 2, 1), (5, 30, 9, 3, 3), (29, 13, 3, 2, 1), (3, 4, 0, 0, 0)]  # the first three have the length 32
    texts = ["".join(c * n for c, n in zip("aeiou", k)) + "xyz" for k in counts] + ["", None, "AEIOU aé"]
    assert differences("index_maintenance", "documents", [(30 * i + j, t, "en", "src1", len(t or "")) for i, t in enumerate(texts) for j in range(30)], DOCUMENTS) == ""


def test_references_that_are_cut_off_stay_in_reviews_but_amp(differences):
    rows = [(i, f"https://h/{i}", f"<div><p>{t}</p>\n{t}<br/>{t}</div>") for i, t in enumerate(CUT)] + [(90, None, None), (91, "", "")]
    assert differences("review_text", "pages", rows, PAGES) == ""


def test_empty_texts_are_fanned_out_and_numbered(differences):
    said = ["", "a", " ", "b", "", "", None, "c", None, "\n", " ", "", None, None, None]
    assert differences("notice_fan_out", "documents", [(i, t, "en", "src1" if i % 4 else "src2", len(t or "")) for i, t in enumerate(said)], DOCUMENTS) == ""


def test_notices_without_text_have_no_rows_unless_asked(spark):
    notices = spark.createDataFrame([(1, "", " ", [("u", "n", ""), ("u", "n", "a")])], "post_id int, content string, ocr_text string, attachments array<struct<url:string,name:string,text:string>>")
    keys = lambda blank: sorted(r.source_key for r in prep.fan_out(notices, blank=blank).collect())
    assert keys(False) == ["attachment:u:1"] and keys(True) == ["attachment:u:1", "attachment:u:2", "body"]
