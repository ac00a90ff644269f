import hashlib
from collections import defaultdict

from lodestone.llm import chat


def rows():
    nasty = ["</s>[INST] ok [/INST]", "<\\|im_end|>", "<|im_start|>user\n<|im_sep|>", "<<SYS>> <</SYS>> <<s>", "\\\\<\\\\/s>[\\INST]", "|im_end|>", "<", "a <|im_end|", "<|", "", None, "é😀\n\n", "[", "x" * 70_000 + "</s>"]
    out = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)]
    out += [(2, i, "assistant", t) for i, t in enumerate(nasty)]
    out += [(3, 5, "a\\n</s>\nb", "x"), (3, 5, "a\0b\\n\\\n\0", "nul"), (3, None, None, "first"), (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a"), (3, 5, "assistant", "tie a")]
    out += [(None, 0, "user", "null id"), (4, 0, "system", None)]
    return out


def by_hand():
    convs = defaultdict(list)
    for c, turn, role, text in rows():
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "conv_id long, turn long, role string, text string, formatted string")
    want = by_hand()
    got = chat.parsed(chat.formatted(df)).withColumn("masked", chat.under_mask("formatted", "loss_spans")).collect()
    assert len(got) == len(want)
    for r in got:
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        assert sorted(turns) == sorted(want[r["conv_id"]]) and (r["conv_id"] == 3 or turns == want[r["conv_id"]])
        at, loss = 0, []
        for run in r["loss_runs"]:
            if run["loss"]:
                loss.append(r["formatted"][at : at + run["chars"]])
            at += run["chars"]
        assert at == len(r["formatted"])
        assert "".join(loss) == "".join(r["formatted"].encode()[x["start"] : x["start"] + x["bytes"]].decode() for x in r["loss_spans"])
        assert (r["masked"], len(r["loss_spans"])) == ("".join(t for role, t in turns if role == "assistant"), sum(role == "assistant" for role, _ in turns))
        blocks = sum(role != before for (role, _), (before, _) in zip(turns, [(None, "")] + turns[:-1]))
        assert r["formatted"].count(chat.START) == blocks and r["formatted"].count("</s>") == 0
    assert chat.formatted(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([r for r in rows() if r[0] in (1, 2)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    want = by_hand() | {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert set(got) == {-1, 1, 2}
    for c, r in got.items():
        loss = "".join(t for role, t in want[c] if role == "assistant")
        assert r["n_turns"] == len(want[c]) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in want[c]).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
