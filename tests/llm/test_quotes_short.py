from tests.llm.test_quotes import rows


def test_short_quotes_link(spark):
    got = rows(spark, [(1, 0, "u", "Sounds good."), (1, 1, "a", "Another message that starts a thread"), (1, 2, "u", "> Sounds good.\nFine"), (1, 3, "a", "> Fine\nOk"), (1, 4, "u", "我同意这个计划"), (1, 5, "a", "> 我同意这个计划\n好")])
    assert [got[1, t].reply_to for t in range(6)] == [None, None, 0, 2, None, 4]
    assert [got[1, t].linked for t in range(6)] == [0, 0, 1, 1, 0, 1] and got[1, 3].root == 0 and got[1, 3].depth == 2


def test_length_decides_between_parents(spark):
    got = rows(spark, [(1, 0, "u", "A longer line that is quoted in full"), (1, 1, "a", "Ok"), (1, 2, "u", "> A longer line that is quoted in full\n> Ok\nBoth")])
    assert got[1, 2].reply_to == 0 and got[1, 2].linked == 2
