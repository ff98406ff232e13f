import random
import tracemalloc

import numpy as np

from memweave.llm import line_dedup as ld

from .helpers import CLASHES, ODD, docs, words


def rows_of(spark, rows, **kw):
    return {r["doc_id"]: r for r in ld.clean(docs(spark, rows), **kw).collect()}


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_whole_lines_stay_once(spark):
    rng = random.Random(3)
    line, other, own = sentence(rng, 12), "short but long enough", [sentence(rng, 30) for _ in range(4)]
    rows = [(2, f"{own[0]}\n  {line.upper()}\n{other}"), (1, f"{line}\n{own[1]}"), (3, f"{other}\n{own[2]}\n{line}\t\n"),
            (4, own[3]), (5, "a b c\nx y z"), (6, "a b c\nx y z")]
    got = rows_of(spark, rows)
    assert got[1]["text"] == rows[1][1] and got[4]["text"] == own[3] and got[6]["text"] == "a b c\nx y z"
    assert got[2]["text"].split("\n")[0] == own[0] and "W" not in got[2]["text"] and other in got[2]["text"]
    assert words(got[3]["text"]) == words(own[2])


def test_offsets_are_those_of_the_original(spark):
    rng = random.Random(4)
    shared = [sentence(rng, 25) for _ in range(5)]
    rows = [(i, "\n".join(rng.sample(shared, 2) + [sentence(rng, 20), "é " + sentence(rng, 9)])) for i in range(40)]
    for (d, text), r in zip(rows, [rows_of(spark, rows)[i] for i in range(40)]):
        left, at = "", 0
        for s in r["removed"]:
            assert at <= s["begin"] < s["end"] <= len(text)
            left, at = left + text[at:s["begin"]], s["end"]
        assert left + text[at:] == r["text"]
    kept = "\n".join(r["text"] for r in rows_of(spark, rows).values())
    assert all(kept.count(s) == 1 for s in shared)


def test_passages_inside_lines(spark):
    rng = random.Random(5)
    passages = [sentence(rng, 55) for _ in range(30)]
    rows = [(i, f"{sentence(rng, rng.randint(5, 40))} {p} {sentence(rng, 30)}") for i, p in enumerate(passages)]
    rows += [(100 + i, f"{sentence(rng, rng.randint(5, 40))} {p} {sentence(rng, 3)}") for i, p in enumerate(passages)]
    rows += [(200 + i, sentence(rng, 200)) for i in range(30)]
    got = rows_of(spark, rows)
    assert all(got[d]["text"] == t for d, t in rows if not 100 <= d < 200)      # first ones and clean ones stay
    for i, p in enumerate(passages):
        assert p not in got[100 + i]["text"]
        assert len(words(got[100 + i]["text"])) < len(words(rows[30 + i][1])) - 25


def test_same_result_for_any_blocks(spark):
    rng = random.Random(6)
    shared = [sentence(rng, 14) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(shared) for _ in range(4)) + "\n" + sentence(rng, 12)) for i in range(60)]
    one, many = rows_of(spark, rows), rows_of(spark, rows, block_bytes=700)
    assert {d: r["text"] for d, r in one.items()} == {d: r["text"] for d, r in many.items()}


def test_odd_texts_clashing_columns_and_repeated_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    df = docs(spark, rows + [(None, "one two three four five"), (7_000, "one two three four five"),
                             (7_000, "one two three four five")])
    out = ld.clean(df)
    assert out.columns == [*df.columns, "removed"]
    got = out.collect()
    assert len(got) == len(rows) + 3 and all(r["row"] == "7" and r["block"] == 7 for r in got)
    assert sorted(r["text"] for r in got if r["doc_id"] in (7_000, None)) == ["", "", "one two three four five"]
    assert [r["text"] for r in got if r["doc_id"] == 0] == [None]
    assert {r["text"] for r in got if r["doc_id"] == 11} == {"x " * 3000}
    assert ld.clean(docs(spark, [])).collect() == [] and CLASHES


def test_passages_inside_lines_go_to_their_last_word(spark):
    rng = random.Random(8)
    passages = [sentence(rng, 51) for _ in range(40)]
    rows = [(i, f"a{i} {sentence(rng, 20)} b{i} {p} c{i} {sentence(rng, 30)}") for i, p in enumerate(passages)]
    rows += [(100 + i, f"d{i} {p} e{i} {sentence(rng, 25)}") for i, p in enumerate(passages)]
    for blocks in ({}, {"block_bytes": 900}):
        got = rows_of(spark, rows, **blocks)
        assert all(got[i]["text"] == t for i, t in rows[:40])
        for i in range(40):
            assert words(got[100 + i]["text"]) == words(rows[40 + i][1].replace(passages[i], ""))


def test_passages_of_few_distinct_words(spark):
    rng = random.Random(9)
    passages = [" ".join(f"v{i}x{rng.randrange(12)}" for _ in range(60)) for i in range(40)]
    rows = [(i, f"a{i} {sentence(rng, 20)} {p} c{i} {sentence(rng, 30)}") for i, p in enumerate(passages)]
    rows += [(100 + i, f"{sentence(rng, 9)} d{i} {p} e{i} {sentence(rng, 25)}") for i, p in enumerate(passages)]
    got = rows_of(spark, rows)
    assert all(got[i]["text"] == t for i, t in rows[:40])
    assert all(words(got[100 + i]["text"]) == words(rows[40 + i][1].replace(p, "")) for i, p in enumerate(passages))


def test_short_lines_inside_a_repeated_passage_go_with_it(spark):
    rng = random.Random(10)
    passage = f"{sentence(rng, 12)}\nof.\nand ornd.\n{sentence(rng, 14)}\nend it"
    rows = [(1, f"first own\n{passage}\n{sentence(rng, 20)}"), (2, f"second other\n{passage}\n{sentence(rng, 9)}")]
    got = rows_of(spark, rows)
    assert got[1]["text"] == rows[0][1]
    assert words(got[2]["text"]) == words(rows[1][1].replace(passage, ""))


def test_a_block_holds_a_step_of_words_at_a_time(monkeypatch):
    rng = random.Random(8)
    texts = ["\n".join(sentence(rng, rng.randint(0, 40)) for _ in range(60)) for _ in range(400)] + [None, "", "a b\n\nc d e f"]
    whole = ld.Block(texts, ld.WordHashes())
    monkeypatch.setattr(ld, "STEP_WORDS", 5000)
    tracemalloc.start()
    steps = ld.Block(texts, ld.WordHashes())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(getattr(whole, k), getattr(steps, k)) for k in "doc_start line_start word begin end digest row".split())
    assert len(whole.word) > 400_000 and most < 40 * len(whole.word)      # 100 bytes a word and more, were all held at once
