"""Text and file forms of one source read the same rows; number formats of CSV."""

import pytest

import loomframe as lf
from loomframe import col, errors

RAGGED = 'a,b,c\n1,2\n3,4,5,6\n"",x,\n,"",7\n'


def test_ragged_rows_and_empty_cells_are_one_rule(spark, tmp_path):
    """Short rows end in nulls, long ones are cut, and an empty cell is null, quoted or not: in text and in files."""
    (tmp_path / "t.csv").write_text(RAGGED)
    want = [{"a": "1", "b": "2", "c": None}, {"a": "3", "b": "4", "c": "5"}, {"a": None, "b": "x", "c": None}, {"a": None, "b": None, "c": "7"}]
    assert lf.read_csv(RAGGED, infer_schema=False).to_dicts() == want
    assert lf.scan_csv(str(tmp_path / "t.csv"), infer_schema=False).to_dicts() == want


@pytest.mark.parametrize(
    "style,want",
    [
        ({"decimals": 2, "grouping": True}, "1,234,567.50 -1,234.00 0.13"),
        ({"max_decimals": 2}, "1234567.5 -1234 0.13"),
        ({"min_decimals": 1, "max_decimals": 4, "grouping": True, "locale": "de-DE"}, "1.234.567,5 -1.234,0 0,125"),
        ({"decimals": 0, "percent": True}, "123456750% -123400% 13%"),
        ({"decimals": 2, "currency": "$", "grouping": True}, "$1,234,567.50 -$1,234.00 $0.13"),
        ({"decimals": 2, "currency": "$", "accounting": True}, "$1234567.50 ($1234.00) $0.13"),
    ],
)
def test_number_formats(spark, style, want):
    f = lf.data({"x": [1234567.5, -1234.0, 0.125]})
    got = f.write_csv(include_header=False, separator="\t", number_format=style)
    assert got.split("\n")[:3] == want.split(" ")


def test_number_formats_of_integers_and_nan(spark):
    f = lf.data({"n": [1234567, -5], "x": [float("nan"), 2.0]})
    assert f.write_csv(include_header=False, separator=";", number_format={"grouping": True, "fallback": "-"}) == "1,234,567;-\n-5;2\n"
    with pytest.raises(errors.InvalidArgumentError):
        f.write_csv(number_format={"colour": 1})


def test_n_unique_by_key(spark):
    f = lf.data({"g": [1, 1, 2], "w": [["a", "A", "b"], ["x"], []]})
    assert f.select("g", n=col("w").arr.n_unique(key=lambda e: e.str.lower())).to_dicts() == [{"g": 1, "n": 2}, {"g": 1, "n": 1}, {"g": 2, "n": 0}]


def test_pivot_and_explode_limits(spark, monkeypatch):
    from loomframe.operators import reshape

    monkeypatch.setattr(reshape, "MAX_PIVOT", 2)
    f = lf.data({"i": [1, 1, 1], "k": ["a", "b", "c"], "v": [1, 2, 3]})
    with pytest.raises(errors.ShapeError):
        f.pivot(on="k", index="i", values="v")
    assert f.pivot(on="k", index="i", values="v", columns=["a", "b", "c"]).to_dicts() == [{"i": 1, "a": 1, "b": 2, "c": 3}]
    g = lf.data({"i": [1, 2], "w": [["a", "b"], []]}).explode("w", position="p")
    assert g.to_dicts() == [{"i": 1, "w": "a", "p": 0}, {"i": 1, "w": "b", "p": 1}, {"i": 2, "w": None, "p": None}]
    with pytest.raises(errors.SchemaError):
        lf.data({"i": [1], "w": [["a"]]}).explode("w", position="i")


@pytest.mark.parametrize("by", [None, "s"])
def test_asof_in_buckets_is_asof(spark, by):
    """However many ranges the sort is cut into, each left row has the same partner."""
    import random

    rng = random.Random(1)
    left = lf.data([{"i": i, "t": rng.randrange(300), "s": "hot" if i % 3 else "cold"} for i in range(400)])
    right = lf.data([{"j": j, "t": rng.randrange(300), "s": "hot" if j % 2 else "cold"} for j in range(120)])
    partners = right.to_dicts()
    options = {"on": "t"} | ({"by": by} if by else {})
    for strategy in ("backward", "forward", "nearest"):
        for exact in (True, False):
            one, many = (left.join_asof(right, strategy=strategy, allow_exact_matches=exact, buckets=n, **options).to_dicts() for n in (1, 16))
            assert sorted(map(str, one)) == sorted(map(str, many))
            for r in one[:60]:
                fit = [x for x in partners if by is None or x["s"] == r["s"]]
                near = [r["t"] - x["t"] for x in fit if strategy != "forward" and (x["t"] < r["t"] or exact and x["t"] == r["t"])]
                near += [x["t"] - r["t"] for x in fit if strategy != "backward" and (x["t"] > r["t"] or exact and x["t"] == r["t"])]
                got = [abs(x["t"] - r["t"]) for x in partners if x["j"] == r["j"]]
                assert got == ([min(near)] if near else [])
