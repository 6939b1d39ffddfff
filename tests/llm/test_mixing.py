import random

from docloom.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, size string, target int, _size int, doc string, copies string"


def rows_of(seed, n=600):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "z", "B"]
    return [(i, rng.choices(names, [50, 1, 5, 10, 2, 30])[0], " ".join(["w"] * rng.randint(0, 30)) + rng.choice(["", "\n", " x"]), "s", 1, 2, "d", "c") for i in range(n)]


def water(sizes):
    """Shares by weight, the excess of capped sources shared again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_mix(spark):
    rows = rows_of(1)
    got = M.plan_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    size = {i: len(t.split()) for i, _, t, *_ in rows}
    sizes = {}
    for i, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = water(sizes)
    taken = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = M.plan_mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_copies_become_rows_and_odd_rows_have_a_place(spark):
    rows = rows_of(2, 200) + [(7, "b", "equal row", "s", 1, 2, "d", "c")] * 2 + [(None, "b", None, "s", 1, 2, "d", "c"), (901, None, "", "s", 1, 2, "d", "c"), (902, "lone", None, "s", 1, 2, "d", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    every = M.plan_mix(df).collect()
    plan = {(r.doc_id, r.source, r.size): r for r in every}
    assert sorted(r.copy for r in every if (r.doc_id, r.size) == (7, 2)) == [1, 2] and len(every) == len(rows) and plan[(902, "lone", 0)].copies == 1 and plan[(902, "lone", 0)].target == 0
    out = M.mix_documents(df)
    assert out.columns == df.columns and {(r["_size"], r.doc, r.copies) for r in out.collect()} == {(2, "d", "c")}
    assert out.count() == sum(r.copies for r in every)
    assert M.mix_documents(df.limit(0)).collect() == [] and M.plan_mix(df.limit(0)).collect() == []


def test_repeated_rows_are_taken_singly(spark):
    words = lambda n: " ".join(["w"] * n)
    fifty, hundred = [(1, "s1", words(200))] * 50, [(100 + i, "s2", words(100)) for i in range(100)]
    # one row fifty times and sources of short texts; then a text that is half of its source
    for third in ([(300 + i, "s3", words(50)) for i in range(200)], [(7, "s3", words(5000))] + [(300 + i, "s3", words(50)) for i in range(100)]):
        rows = fifty + hundred + third
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        plan = M.plan_mix(df).collect()
        taken, target = {}, {}
        for r in plan:
            taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
            target[r.source] = r.target
            assert r.copies <= 3
        assert target == {"s1": 5000, "s2": 10000, "s3": 15000} and len(plan) == len(rows)
        # what the longest text leaves of the budget may go to any source
        assert all(abs(taken[s] - target[s]) <= max(r.size for r in plan) for s in target)
        mixed = {}
        for r in M.mix_documents(df).collect():
            mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
        assert mixed == taken


def test_mix_has_the_rows_of_the_plan_whatever_is_sent(spark, monkeypatch):
    from collections import Counter

    rows = rows_of(9, 300)
    rows += [r for r in rows if r[0] % 7 == 0] * 2 + [rows[5]] * 80 + [(None, None, "x y z", "s", 1, 2, "d", "c")] * 5 + [(4, "b", "other text", "s", 1, 2, "d", "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = Counter()
    for r in M.plan_mix(df).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    for most in (20_000, 2):
        monkeypatch.setattr(M, "BROADCAST_SOURCES", most)
        got = Counter((r.doc_id, r.source, len(r.text.split()) if r.text else 0) for r in M.mix_documents(df).collect())
        assert got == +want


def test_sql_over_a_table_with_repeats(spark, tmp_path, monkeypatch):
    from compare import compare

    rows = rows_of(5, 400)
    rows += [r for r in rows if r[0] % 5 == 0] * 3 + [rows[7]] * 200 + [(None, "a", "x y", "s", 1, 2, "d", "c")] * 3
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", "text").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    monkeypatch.setattr(M, "BUCKET_ROWS", 16)
    assert compare(spark, con, M.op6_mixing, M.OP6_SQL, str(tmp_path)) == ""
