import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from compare import SF

from docloom.llm import alignment
from docloom.llm.alignment import BYTE_LEVEL, PIECES, ByteLevel, Pieces, align, coalesce, op11_alignment, read_file, scored

A, B = ByteLevel(read_file(BYTE_LEVEL)), Pieces(read_file(PIECES))


def plain_groups(text):
    """Groups of (A ids, B ids) of a whole text, cut at the byte offsets where tokens of both end."""
    if not text:
        return []
    a, b = A.encode([" " + text])[0], B.encode([" " + text])[0]
    raw = (" " + text).encode()
    words = [[bytes(s.data[s.at[i] : s.at[i + 1]]) for i in ids] for s, ids in ((A, a), (B, b))]
    if any(b"".join(w) != raw for w in words):
        return []
    ends = [np.cumsum([len(x) for x in w]).tolist() for w in words]
    out, lo = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        hi = [e.index(cut) + 1 for e in ends]
        out.append((a[lo[0] : hi[0]], b[lo[1] : hi[1]]))
        lo = hi
    return out


def expected(docs):
    groups = [plain_groups(t) for _, t in docs]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for (i, _), g, own in zip(docs, groups, links, strict=True):
        whole = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sha = hashlib.sha256(whole.encode()).hexdigest() if g else ""
        best = sum(n for p, n in own.items() if count[p] == most[p[0]])
        rows.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * count[p] for p, n in own.items()), sha))
    return sorted(rows, key=str)


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_alignment(spark, SF)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)


def odd_texts():
    rng = random.Random(1)
    letters = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "中文", " ", "　", " ", "'s", "123", "<0x41>", "<s>", "<|endoftext|>", "🙂", "\x00", "=", "ﬁ", "é", "\r\n", "0000000", "\u0085"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return [None, "", " ", "   ", "a", "▁", "x ▁ y", "a▁ b", "a" * 5000, " " * 3000, "=" * 777 + " 0" * 500, "word " * 4000, *made]


def test_odd_texts_with_few_often_met_pairs(spark):
    docs = [(None if i == 3 else i // 2, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, pairs int, row string")
    for often in (1, 3, 1 << 18):
        got = scored(df, read_file(BYTE_LEVEL), read_file(PIECES), often=often)
        assert sorted(map(tuple, got.collect()), key=str) == expected(docs)
    assert scored(df.limit(0), read_file(BYTE_LEVEL), read_file(PIECES)).count() == 0


def test_groups_of_small_blocks(spark, monkeypatch):
    docs = list(enumerate(odd_texts()[:60]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: plain_groups(t) for i, t in docs}
    for r in align(df, read_file(BYTE_LEVEL), read_file(PIECES)).collect():
        g = want[r["doc_id"]]
        assert r["groups"] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        own = Counter(x * len(B.size) + y for a, b in g for x in a for y in b)
        assert dict(zip(r["pairs"], r["times"], strict=True)) == own and r["pairs"] == sorted(r["pairs"])


def test_pairs_are_expanded_in_parts(monkeypatch):
    import pyarrow as pa

    texts = pa.array([t for t in {" " + t for t in odd_texts() if t}], pa.large_string())
    whole = alignment.Aligned(A, B, texts)
    monkeypatch.setattr(alignment, "EXPANDED", 5)
    parts = alignment.Aligned(A, B, texts)
    assert all(np.array_equal(getattr(whole, c), getattr(parts, c)) for c in ("pair", "times", "pair_at", "n_links"))


def test_coalesce_of_random_intervals():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        start = rng.integers(0, 60, n)
        end = start + rng.integers(1, 8, n)
        group = coalesce(start, end, rng.integers(0, 2, n))
        covered = np.zeros(80, bool)
        for s, e in zip(start, end, strict=True):
            covered[s : e - 1] = True  # places after which an interval goes on
        for i in range(n):
            for j in range(n):
                lo, hi = min(start[i], start[j]), max(start[i], start[j])
                assert (group[i] == group[j]) == bool(covered[lo:hi].all())


def test_pieces_met_in_earlier_blocks_are_not_encoded_again(spark, monkeypatch):
    import pyarrow as pa

    seen = []

    class Noting(ByteLevel):
        def encode(self, texts):
            seen.extend(texts)
            return super().encode(texts)

    memory = alignment.Memory(Noting(read_file(BYTE_LEVEL)), B)
    texts = [" " + t for t in odd_texts() if t]
    for i in range(0, len(texts), 40):
        words = pa.array(sorted({*texts[i : i + 40], *texts[: i // 2]}), pa.large_string())
        got, place = memory.look_up(words)
        want = alignment.picked(got, place)
        plain = alignment.Aligned(A, B, words)
        assert all(np.array_equal(getattr(want, c), getattr(plain, c)) for c in ("good", "n_a", "n_b", "n_groups", "n_links", "text", "pair", "times", "pair_at"))
    short = [t for t in seen if len(t.encode()) <= alignment.REMEMBERED_BYTES]
    assert short and len(short) == len(set(short))
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    few = alignment.Memory(A, B)
    for words in (texts[:5], texts[2:9], texts[:9]):
        words = pa.array(sorted(set(words)), pa.large_string())
        got, place = few.look_up(words)
        assert alignment.picked(got, place).text == alignment.Aligned(A, B, words).text and len(few.words) <= 3
