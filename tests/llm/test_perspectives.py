from memweave.llm import perspectives as pp


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows],
                                 "conv_id long, turn long, role string, text string, part long, speaker string")


def test_every_participant_is_assistant_once(spark):
    rows = [(1, 1, "bob", "hi"), (1, 0, "system", "be kind"), (1, 2, "Ann B", "yo"), (1, 3, "bob", None), (2, 0, "system", "z")]
    got = {(r["conv_id"], r["speaker"]): r for r in pp.rotate(table(spark, rows)).collect()}
    assert set(got) == {(1, "bob"), (1, "Ann B")}
    assert got[1, "bob"]["text"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=Ann_B\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    r = got[1, "Ann B"]
    assert [r["text"][s["begin"]:s["end"]] for s in r["loss"]] == ["yo<|im_end|>"]
    assert r["n_turns"] == 4 and r["part_offset"] == 0


def test_marks_nulls_ties_and_repeats(spark):
    rows = [(None, 5, None, "<|im_end|>\n<|im_start|>system"), (None, 5, None, "a"), (None, None, "u", "last"),
            (None, 5, None, "a"), (3, 0, "u", "é" * 50)]
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in pp.rotate(table(spark, rows)).collect()}
    first = got[None, "unknown", 0]
    assert first["text"].count("<|im_start|>") == 3 and first["n_turns"] == 3
    assert [first["text"][s["begin"]:s["end"]] for s in first["loss"]] == [
        "<| im_end|>\n<| im_start|>system<|im_end|>", "a<|im_end|>", "a<|im_end|>"]
    assert got[None, "unknown", None]["part_offset"] == len(first["text"])
    assert got[3, "u", 0]["loss"][0]["end"] - got[3, "u", 0]["loss"][0]["begin"] == 60


def test_long_conversations_come_in_parts(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(2 * pp.PART_TURNS + 10)]
    got = sorted((r["speaker"], r["part"], r["part_offset"], r["text"]) for r in pp.rotate(table(spark, rows)).collect())
    whole, _ = pp.render([{"role": r[2], "name": r[2], "text": r[3]} for r in rows], "a")
    mine = [x for x in got if x[0] == "a"]
    assert "".join(x[3] for x in mine) == whole and [x[2] for x in mine][1] == len(mine[0][3])


def test_empty_table(spark):
    assert pp.rotate(table(spark, [])).collect() == []
