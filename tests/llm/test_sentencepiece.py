import random

import pytest
import sentencepiece

from docloom.llm import sentencepiece as P


@pytest.fixture(scope="module")
def v():
    return P.Vocabulary(P.read_vocabulary())


def unigram_model():
    """The library's own best-score search over the same pieces: the model file with its type set to unigram and no dummy prefix."""
    raw = open(P.MODEL, "rb").read()

    def varint(at):
        x = shift = 0
        while True:
            b = raw[at]
            x |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return x, at

    out, at = bytearray(raw), 0
    while at < len(raw):
        tag, at = varint(at)
        size, at = varint(at)
        if tag >> 3 in (2, 3):
            end, i = at + size, at
            while i < end:
                t, i = varint(i)
                if (t & 7) == 0:
                    if (tag >> 3, t >> 3) == (2, 3):
                        assert out[i] == 2
                        out[i] = 1
                    if (tag >> 3, t >> 3) == (3, 3):
                        out[i] = 0
                    _, i = varint(i)
                elif (t & 7) == 5:
                    i += 4
                else:
                    n, i = varint(i)
                    i += n
        at += size
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


def test_words_score_as_the_library_scores_them():
    v = P.Vocabulary(P.read_vocabulary(ranks=False))
    m, rng = unigram_model(), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéüß.,!0123456789"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(3000)] + "the worthless Tokenisation of internationalisation überhaupt".split()
    for w in words:
        ids = v.best(P.SPACE + w)[1]
        other = m.nbest_encode_as_ids(P.SPACE + w, 2)[0]  # the lattice's best
        assert sum(m.get_score(i) for i in ids) == sum(m.get_score(i) for i in other), w


def test_many_words_at_once_get_what_one_word_gets(v):
    rng = random.Random(6)
    letters = "abcdeilnorstuvyABCÉéüß.,!0123\n☃😀"
    words = [P.SPACE + "".join(rng.choices(letters, k=rng.choice([0, 1, 3, 8, 15, 40, 63, 64, 90]))) for _ in range(3000)] + [P.SPACE, P.SPACE + "z" * 63]
    ids, at, scores = v.segment(words)
    for i, w in enumerate(words):
        assert (scores[i], ids[at[i] : at[i + 1]].tolist()) == v.best(w), w
    assert v.segment([])[0].tolist() == []


def brute(v, text):
    """Word by word, having checked that a search over the whole string finds nothing better."""
    if not text:
        return []
    whole = P.SPACE + text.replace(P.SPACE, P.LITERAL).replace(" ", P.SPACE)
    words = [v.best(P.SPACE + w) for w in whole[1:].split(P.SPACE)]
    assert abs(sum(s for s, _ in words) - v.best(whole)[0]) >> 48 == 0
    return [i for _, ids in words for i in ids]


def test_chunked_and_whole_agree_and_decode(spark):
    v, rng = P.Vocabulary(P.read_vocabulary()), random.Random(2)
    alphabet = "etaoinshrdlu \né☃▁\U0001f600Z"
    texts = ["", None, " ", "  two  spaces ", "tab\tand\r\nline", "▁literal▁", "a"]
    texts += ["".join(rng.choices(alphabet, k=rng.choice([30, 64, 65, 66, 200, 700, 5000]))) for _ in range(30)]
    texts += ["internationalisation" * 60, "z" * 1000, " " * 300, "the " * 400, texts[-1], texts[-1]]
    df = spark.createDataFrame([(i, t, [1], *range(7)) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, key int, chunk int, part int, doc int, digest int, found int, decoded int")
    got = {r.doc_id: r for r in P.decode(P.encode(df, chunk=32)).collect()}
    assert len(got) == len(texts) and all([r.key, r.chunk, r.part, r.doc, r.digest, r.found] == list(range(6)) for r in got.values())
    for i, t in enumerate(texts):
        assert got[i].decoded == (t or "")
        assert got[i].ids == brute(v, t or ""), t
    assert P.encode(df.limit(0)).count() == 0


def test_matrices_multiply_associatively_and_agree_with_one_chunk(v):
    s = P.SPACE + ("internationalisation" * 6 + P.SPACE + "ofwords") * 3
    place = lambda a: a if v.by_word is False or s.rfind(P.SPACE, 0, a + 1) < 0 else a - s.rfind(P.SPACE, 0, a + 1)
    cut = lambda a, b: v.matrix(s[a : b + v.states - 1], b - a, place(a))
    a, b, c = cut(0, 50), cut(50, 100), cut(100, 150)
    assert (P.times(P.times(a, b), c) == P.times(a, P.times(b, c))).all()
    assert (P.times(P.times(a, b), c)[:1] == v.matrix(s[: 150 + v.states - 1], 150, 0)[:1]).all()
    assert (P.from_text(P.as_text(a)).reshape(a.shape) == a).all()
