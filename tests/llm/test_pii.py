import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from docloom.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


VALID = {
    "email": lambda m: True,
    "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
    "card": lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
    "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
}


def base(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if VALID[k](m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def texts():
    rng = random.Random(7)
    bits = ["a@b.c", "x_y.z@d-e.f.g", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "é😀", " ", ".", "-", "9", "12 34", "word", "+", "\n", "a@b", "_", "%", "00000000000000", "+49.30.123456789"]
    out = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(1500)]
    return out + ["", None, "a@b.c_d@e.f", "x" * 60_000 + "@", "9" * 60_000, "1 " * 30_000, ("a." * 20_000) + "@b.c", "1.2.3.4 " * 3000, "+1" + "(" * 30_000, "@" * 20_000]


def test_base_spans_against_plain_patterns(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(t)], "doc_id long, text string, n_email int")
    got = {r.doc_id: r for r in P.find_pii(df).collect()}
    assert len(got) == len(t)
    for i, x in enumerate(t):
        want = base(x)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (x, text, got[i].spans)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert set(text.split(",")) - {""} <= set(got[i].spans.split(","))


def corpus():
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    # the name stands far from the address: greeting above, address below
    rows = [f"Zanzibarovich {say(60)} reach zan@corp.example today {say(12)}" for _ in range(6)]
    rows += [f"{say(8)} Halfknown {say(2)} call +1 555 010 2020 {say(9)}" for _ in range(5)] + [f"{say(9)} Halfknown {say(9)}", f"Halo {say(4)}", f"Hall {say(4)}", f"Halt {say(4)}", f"Halm {say(4)}"]
    rows += [f"{say(5)} Onlycopies write cop@corp.example {say(5)}"] * 5
    # different addresses of one domain and different numbers of one issuer
    rows += [f"{say(20)} Nightdesk {say(20)} u{i}@night.example" for i in range(4)] + [f"7quux 李 {say(9)} 4111 1111 1111 1111 {say(3)} +1 555 010 2{i}20" for i in range(4)]
    rows += ["Once Zanzibarovich left", "Nightdesk without an address", "overlap +4111 1111 1111 1111 Zanzibarovich"] + [say(30) for _ in range(200)]
    return rows


def entities(text):
    """(level, name) of each entity."""
    out = set()
    for k, a, b in base(text):
        m = text[a:b]
        own = re.sub("[^0-9]", "", m) if k in ("card", "phone") else m.lower()
        group = {"email": own.split("@")[-1], "ip": ".".join(own.split(".")[:2]), "card": own[:6], "phone": own[:4]}[k]
        out |= {(P.KIND, k + ":"), (P.GROUP, f"{k}:{group}"), (P.ITSELF, f"{k}:{own}")}
    return out


def blanked(text):
    out = list(text)
    for _, a, b in base(text):
        out[a:b] = " " * (b - a)
    return "".join(out)


def formed(text):
    words = set(re.findall(r"[^\W_]+", blanked(text)))
    return words | {w[:3] + "*" for w in words}


def brute_terms(rows):
    """{(entity, term): remove} by the counts over whole texts."""
    rows = [t or "" for t in rows]
    held, stands = [entities(t) for t in rows], [formed(t) for t in rows]
    sure = set()
    for e in set().union(*held):
        at = [i for i, h in enumerate(held) if e in h]
        if len({rows[i] for i in at}) < P.SUPPORT:
            continue
        prior = len(at) / len(rows)
        for w in set().union(*(stands[i] for i in at)):
            both = [i for i in at if w in stands[i]]
            q = (len(both) + P.PRIOR_DOCS * prior) / (sum(w in s for s in stands) + P.PRIOR_DOCS)
            if len({rows[i] for i in both}) >= P.SUPPORT and q >= P.LIKELY and q >= 2**P.BITS * prior:
                sure.add((e, w))
    return {(e, w): (e, w[:3] + "*") in sure for e, w in sure if not w.endswith("*")}


def brute_spans(rows):
    want = brute_terms(rows)
    out = []
    for t in rows:
        held, marks = entities(t or ""), {}
        for (e, w), gone in want.items():
            if e in held or e[0] == P.ITSELF:
                marks[w] = marks.get(w, False) or gone
        terms = [(m.start(), m.end(), "removed" if marks[m[0]] else "term") for m in re.finditer(r"[^\W_]+", blanked(t or "")) if m[0] in marks]
        out.append(sorted([(a, i, b, k) for k, a, b in base(t) for i, x in enumerate(PLAIN) if x == k] + [(a, 4, b, k) for a, b, k in terms]))
    return [",".join(f"{k}:{a}:{b}" for a, _, b, k in spans) for spans in out]


def test_disclosing_terms_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute_terms(rows)
    by_word = {}
    for (e, w), gone in want.items():
        by_word.setdefault(w, {})[e] = gone
    assert by_word["Zanzibarovich"][P.ITSELF, "email:zan@corp.example"] and (P.GROUP, "email:night.example") in by_word["Nightdesk"]
    assert by_word["Halfknown"][P.ITSELF, "phone:15550102020"] is False and "Onlycopies" not in by_word and {"7quux", "李"} <= set(by_word)
    got = {r.doc_id: r.spans for r in P.find_pii(df).collect()}
    assert got[rows.index("Once Zanzibarovich left")] == "removed:5:18"  # it names one address, wherever it stands
    assert got[rows.index("Nightdesk without an address")] == ""  # it tells a group, which is not there
    assert [got[i] for i in range(len(rows))] == brute_spans(rows)
    # the way for more terms than may be broadcast gives the same
    few, P.BROADCAST_TERMS = P.BROADCAST_TERMS, 0
    try:
        assert {r.doc_id: r.spans for r in P.find_pii(df).collect()} == got
    finally:
        P.BROADCAST_TERMS = few


def test_the_method_finds_terms_in_the_given_tables(spark):
    rows = P.op9_pii(spark, "/root/testdata/sf0.01").select("doc_id", "spans", "n_terms").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = sorted(texts)
    assert dict(zip(ids, brute_spans([texts[i] for i in ids]), strict=True)) == {r.doc_id: r.spans for r in rows}
    assert sum(r.n_terms for r in rows) > 0


def test_long_texts_with_many_spans(spark):
    text = "né 1.2.3.4 a@b.c +15550102020 or 4111111111111111 " * 4000
    r = P.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.text == "né <IP> <EMAIL> <PHONE> or <CARD> " * 4000


def test_sql_finds_the_same_spans(spark, tmp_path):
    import duckdb

    rows = corpus() + [t for t in texts() if t is None or len(t) < 1000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    df.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(P.OP9_SQL)
    got = P.find_pii(df)
    assert sorted(rel.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(map(tuple, rel.fetchall()))


def test_sanitise(spark):
    rows = corpus() + ["mail a@b.c, then +1 555 010 2020 and 1.2.3.4", None, "", "clean é😀 text", "é +4111 1111 1111 1111 é"]
    names = ["copy", "term", "spans", "doc", "new", "base", "level"]  # columns may have any names
    df = spark.createDataFrame([(i, t, "en", len(t or ""), *range(7)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    got = P.sanitise(df)
    assert got.columns == df.columns
    by = {r.doc_id: r for r in got.collect()}
    n = len(corpus())
    assert by[n].text == "mail <EMAIL>, then <PHONE> and <IP>" and by[n].n_chars == len(by[n].text)
    assert by[n + 1].text is None and by[n + 2].text == "" and by[n + 3].text == rows[n + 3]
    assert by[n + 4].text in ("é <PHONE> é", "é +<CARD> é", "é <PHONE>é")
    assert "Zanzibarovich" not in by[0].text and "zan@corp" not in by[0].text and "<EMAIL>" in by[0].text
    assert "Halfknown" not in by[6].text and " Hal* " in by[6].text and all([r[n] for n in names] == list(range(7)) for r in by.values())
    again = {r.doc_id: r for r in P.find_pii(got.where(F.col("text").isNotNull())).collect()}
    assert all(r.n_email + r.n_ip + r.n_phone == 0 for r in again.values())
    assert P.sanitise(df.limit(0)).collect() == [] and P.find_pii(df.limit(0)).collect() == []
