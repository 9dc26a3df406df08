from loomframe.llm import quotes as Q
from tests.llm.conftest import SF

A = "Hello there, could you send me the final report?\nIt is due on Friday afternoon."
B = "On Monday, Ann wrote:\n> Hello there, could you send me the final report?\n\nYes, I will send it later this week."
C = "> Yes, I will send it later THIS week!\n>> hello there, could you send me the final report?\nThanks a lot for the quick answer."
D = "> It is due on Friday afternoon.\nWhich Friday do you mean exactly?"


def rows(spark, data, schema="conv_id long, turn long, role string, text string"):
    return {(r.conv, r.turn): r for r in Q.conversations(spark.createDataFrame(data, schema)).collect()}


def test_links_and_order(spark):
    got = rows(spark, [(1, 0, "u", A), (1, 1, "a", B), (1, 2, "u", C), (1, 3, "u", D), (2, 0, "u", "> Hello there, could you send me the final report?\nNew here.")])
    assert [got[1, t].reply_to for t in range(4)] == [None, 0, 1, 0]
    assert [got[1, t].depth for t in range(4)] == [0, 1, 2, 1] and {got[1, t].root for t in range(4)} == {0}
    assert [got[1, t].place for t in range(4)] == [0, 1, 2, 3]
    assert got[1, 1].text == "Yes, I will send it later this week." and got[1, 2].text == "Thanks a lot for the quick answer." and got[1, 2].levels == 2
    assert got[1, 2].quoted == 2 and got[1, 2].linked == 2
    assert got[2, 0].reply_to is None and got[2, 0].quoted == 1 and got[2, 0].linked == 0


def test_threads_stand_together(spark):
    got = rows(spark, [(1, 0, "u", "The first question of the day"), (1, 1, "u", "Another question, about lunch"), (1, 2, "a", "> The first question of the day\nAn answer to the first one"), (1, 3, "a", "> Another question, about lunch\nAt noon, as on every day")])
    assert sorted(range(4), key=lambda t: got[1, t].place) == [0, 2, 1, 3]


def test_a_long_chain(spark):
    data = [(1, 0, "u", "message number zero of all")] + [(1, i, "u", f"> message number {i - 1 or 'zero'} of all\nmessage number {i} of all") for i in range(1, 40)]
    got = rows(spark, data)
    assert [got[1, t].depth for t in range(40)] == list(range(40))


def test_common_passages_and_a_hot_conversation(spark):
    line = "This line is in every single message"
    data = [(1, i, "u", f"> {line}\n{line}") for i in range(3000)] + [(i, 0, "u", line) for i in range(2, 2000)]
    got = rows(spark, data)
    assert len(got) == len(data) and sorted(got[1, t].place for t in range(3000)) == list(range(3000))
    assert all(got[1, t].reply_to == (0 if t else None) for t in range(3000))


def test_query(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet")
    got = Q.op2_quotation_linking(spark, SF).collect()
    assert len(got) == t.count()
    want = {(r.conv_id, r.turn): Q.parse(r.text) for r in t.collect()}
    assert all(want[r.conv_id, r.turn][0] == r.text for r in got)


def test_edges(spark):
    got = Q.conversations(spark.createDataFrame([(None, 0, None, None), (None, 0, None, None), (1, None, "u", "> quoted words of nobody"), (1, 2, "u", "")], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 and all(r.reply_to is None for r in got) and sorted(r.place for r in got if r.conv is None) == [0, 1]
    assert Q.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, depth int")).count() == 0


def planted(seed, convs=40, turns=9):
    """Conversations whose replies quote lines of one earlier message, at times with that message's own quotes nested: rows, and what is to be found."""
    import random

    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ra", "te", "mi", "so", "lu") for b in ("bor", "den", "kal", "vis", "tum", "pok")]
    rows, want = [], {}
    for c in range(convs):
        own = []
        for t in range(turns):
            lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + f" {c} {t} {k}." for k in range(rng.randint(1, 4))]
            parent = rng.randrange(t) if t and rng.random() < 0.8 else None
            quoted = []
            if parent is not None:
                picked = rng.sample(own[parent], rng.randint(1, len(own[parent])))
                quoted = ["> " + (x.upper() if rng.random() < 0.3 else x) for x in picked]
                far = want[c, parent][0]
                if far is not None and rng.random() < 0.5:
                    quoted = [">> " + x for x in own[far]] + quoted
                if rng.random() < 0.3:
                    quoted = ["On Monday, somebody wrote:", *quoted]
            own.append(lines)
            rows.append((c, t, "u", "\n".join([*quoted, "", *lines]) if quoted else "\n".join(lines)))
            root, depth = (t, 0) if parent is None else (want[c, parent][1], want[c, parent][2] + 1)
            want[c, t] = (parent, root, depth, "\n".join(lines))
    return rows, want


def test_the_query_finds_planted_quotes(spark, tmp_path):
    rows_, want = planted(11)
    spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r for r in Q.op2_quotation_linking(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and sum(w[0] is not None for w in want.values()) > 200
    for k, (parent, root, depth, text) in want.items():
        r = got[k]
        assert (r.reply_to, r.root, r.depth, r.text) == (parent, root, depth, text) and r.linked >= (parent is not None)
    for c in {c for c, _ in want}:
        order = sorted((w[1], t) for (cc, t), w in want.items() if cc == c)
        assert [got[c, t].place for _, t in order] == list(range(len(order)))


def test_long_messages_and_clashing_names(spark):
    long = "\n".join(f"line number {i} of a very long message" for i in range(20_000))
    df = spark.createDataFrame([(1, 0, "u", long, 1, 1), (1, 1, "a", "> line number 19999 of a very long message\nindeed", 2, 2)], "conv_id long, turn long, role string, text string, place int, own int")
    got = {r.turn: r for r in Q.conversations(df).collect()}
    assert got[1].reply_to == 0 and got[0].text == long
