from docloom.llm import chat as C


def test_every_participant_gets_the_dialogue(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", "héllo"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 5, "system", "alone"), (None, None, None, "x"), (3, 9000, "z", "late"), (3, 1, "z", "early")]
    df = spark.createDataFrame([(*r, "n", "p") for r in rows], "conv_id long, turn long, role string, text string, name string, perspective string")
    got = C.rotate_perspectives(df).collect()
    key = lambda x: (x is not None, x)
    want = []
    for conv in (1, None, 3):
        turns = sorted(((t, (r or "unknown").replace(" ", "_"), (x or "").replace("<|im_", "<| im_")) for c, t, r, x in rows if c == conv), key=lambda t: (key(t[0]), t[1], t[2]))
        for p in {t[1] for t in turns} - {"system"}:
            whole = ""
            for t, who, x in turns:
                role = "system" if who == "system" else "assistant" if who == p else "user"
                head = f"<|im_start|>{role}{' name=' + who if role == 'user' else ''}\n"
                seg = head + x + "<|im_end|>\n"
                at = len(whole)
                want.append((conv, p, t, role, who, seg, at, at + len(head) if role == "assistant" else None, at + len(seg) - 1 if role == "assistant" else None))
                whole += seg
            for r in (g for g in got if g.conv_id == conv and g.perspective == p and g.role == "assistant"):
                assert whole[r.mask_start : r.mask_end].endswith("<|im_end|>")
    assert sorted(map(str, want)) == sorted(str(tuple(g)) for g in got)
    whole = {(r.conv_id, r.perspective): r for r in C.assembled(C.rotate_perspectives(df)).collect()}
    for (conv, p), r in whole.items():
        own = sorted((w for w in want if w[:2] == (conv, p)), key=lambda w: w[6])
        assert r.text == "".join(w[5] for w in own) and [tuple(m) for m in r.masks] == [w[7:] for w in own if w[7] is not None]
    assert len(whole) == len({w[:2] for w in want})
    assert C.rotate_perspectives(df.limit(0)).collect() == []
