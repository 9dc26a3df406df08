"""More registered queries: operators that the headline catalogue does not use, several of a family in each."""

from __future__ import annotations

import re

import loomframe as lf
from loomframe import col, element, errors, lit, when
from loomframe.plans.register import query

NAN, INF = float("nan"), float("inf")

# ---- arithmetic, predicates, logic


@query("""SELECT event_id, abs(value - 50) AS ab, round(acosh(value + 1), 8) AS ach, CASE WHEN abs(value / 100) <= 1 THEN round(asin(value / 100), 8) END AS asn, round(asinh(value), 8) AS ash, round(atan(value), 8) AS at,
CASE WHEN abs(value / 100) < 1 THEN round(atanh(value / 100), 7) END AS ath, round(cosh(value / 100), 8) AS ch, round(exp(value / 100) - 1, 8) AS em, round(ln(1 + value / 100), 8) AS lp, round(radians(value), 8) AS rd,
round(sinh(value / 100), 8) AS sh, round(tan(value / 100), 6) AS tn FROM events""")
def math_more(t):
    v = col("value")
    h = v.div(100)
    return t("events").select("event_id", ab=v.sub(50).abs(), ach=v.add(1).acosh().round(8), asn=h.asin().round(8), ash=v.asinh().round(8), at=v.atan().round(8), ath=h.atanh().round(7), ch=h.cosh().round(8), em=h.expm1().round(8), lp=h.log1p().round(8), rd=v.radians().round(8), sh=h.sinh().round(8), tn=h.tan().round(6))


@query("""SELECT event_id, ceil(value)::BIGINT AS ce, trunc(value - 50)::BIGINT AS tr, -value AS ng, round(pow(value, 2), 4) AS pw, round(sqrt(value * value + 9), 8) AS hy, value * CASE WHEN user_id >= 75 THEN 1.0 ELSE -1.0 END AS cp,
round(floor(value * pow(10, 2 - floor(log10(value))) + 0.5) / pow(10, 2 - floor(log10(value))), 6) AS sf FROM events WHERE value > 0""")
def math_rounding(t):
    v = col("value")
    return t("events").filter(v.gt(0)).select("event_id", ce=v.ceil(), tr=v.sub(50).trunc(), ng=v.negate(), pw=v.pow(2).round(4), hy=v.hypot(3).round(8), cp=v.copysign(col("user_id").sub(75)), sf=v.round_sig_figs(3).round(6))


@query("SELECT event_id, true AS unit, true AS die, true AS spread FROM events")
def math_rand(t):
    f = t("events").order_by("event_id").with_columns(u=lit(0).rand(7), d=lit(0).rand(7, min=1, max=6, integer=True))
    mean = col("u").mean()
    return f.select("event_id", unit=col("u").between(0, 1, "left"), die=col("d").is_in([1, 2, 3, 4, 5, 6]), spread=mean.between(0.4, 0.6))


@query("""WITH e AS (SELECT event_id, value, CASE WHEN value > 90 THEN 'nan'::DOUBLE WHEN value < 10 THEN 'infinity'::DOUBLE WHEN value < 20 THEN NULL ELSE value END AS x FROM events)
SELECT event_id, isnan(x) AS n, NOT isnan(x) AS nn, isfinite(x) AS f, isinf(x) AS i, x IS NOT NULL AS k, abs(value - (value + 0.000000001)) <= greatest(1e-8 * greatest(abs(value), abs(value + 0.000000001)), 1e-8) AS c, abs(value - 50) <= greatest(0.1 * greatest(value, 50.0), 1e-8) AS r FROM e""")
def predicates_float(t):
    v = col("value")
    f = t("events").with_columns(x=when(v.gt(90)).then(lit(NAN)).when(v.lt(10)).then(lit(INF)).when(v.ge(20)).then(v))
    x = col("x")
    return f.select("event_id", n=x.is_nan(), nn=x.is_not_nan(), f=x.is_finite(), i=x.is_infinite(), k=x.is_not_null(), c=v.is_close(v.add(1e-9)), r=v.is_close(50, rel_tol=0.1))


@query("SELECT event_id, (value > 50) <> (user_id % 2 = 0) AS x, NOT (value > 50) AS n, CASE WHEN value > 50 THEN '' ELSE event_type END = '' AS e, regexp_extract(event_type, '^[aeiou]*') = '' AS l FROM events")
def logic_and_empty(t):
    a, b = col("value").gt(50), col("user_id").mod(2).eq(0)
    return t("events").select("event_id", x=a.xor(b), n=a.not_(), e=when(a).then(lit("")).otherwise(col("event_type")).is_empty(), l=col("event_type").str.explode().arr.slice(0, 1).arr.filter(element().is_in(["a", "e", "i", "o", "u"])).is_empty())


@query("SELECT event_id, r FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i FROM events) JOIN (SELECT value AS r, row_number() OVER (ORDER BY event_id DESC) AS i FROM events) USING (i)")
def column_reverse(t):
    return t("events").order_by("event_id").select("event_id", r=col("value").reverse())


# ---- aggregates and windows


@query("""SELECT event_type, bool_and(x IS NULL) AS al, bool_or(x IS NULL) AS an, round(avg(x), 6) AS m, max(x) AS hi, min(x) AS lo, bool_or(value > 99) AS hn, bool_or(value > 99) AS ln, count(DISTINCT user_id // 10) AS k
FROM (SELECT *, CASE WHEN value >= 10 THEN value END AS x FROM events) GROUP BY 1""")
def agg_missing(t):
    v = col("value")
    f = t("events").with_columns(x=when(v.ge(10)).then(v), y=when(v.gt(99)).then(lit(NAN)).otherwise(v))
    x, y = col("x"), col("y")
    return f.groupby("event_type").agg(al=x.all_null(), an=x.any_null(), m=x.avg().round(6), hi=x.nan_max(), lo=x.nan_min(), hn=y.nan_max().is_nan(), ln=y.nan_min().is_nan(), k=col("user_id").n_unique(key=lambda e: e.floordiv(10)))


@query("SELECT event_id, round(product(1 + value / 1e6) OVER (PARTITION BY user_id ORDER BY event_id), 8) AS p FROM events")
def win_cum_prod(t):
    return t("events").order_by("event_id").select("event_id", p=col("value").div(1e6).add(1).cum_prod().over("user_id").round(8))


@query("SELECT string_agg(n_name, '|' ORDER BY n_nationkey) AS names, count(*) AS n FROM nation")
def implode_all(t):
    return t("nation").order_by("n_nationkey").select(names=lf.implode("n_name").arr.join("|"), n=col("n_name").len())


# ---- text


@query("""SELECT p_partkey, lower(p_type) AS lo, upper(p_type) AS up, ends_with(p_name, 'e') AS e, contains(p_name, 'a') OR contains(p_name, 'z') AS a, length(p_name)::INT AS n, lpad(p_name, 40, '*') AS l, lpad(p_name, 40, ' ') AS s, rpad(p_name, 40, '-') AS r,
string_split(p_name, '')[2] AS c FROM part""")
def str_more(t):
    p = col("p_name").str
    return t("part").select("p_partkey", lo=col("p_type").str.to_lowercase(), up=col("p_type").str.to_uppercase(), e=p.ends_with("e"), a=p.contains_any(["a", re.compile("z")]), n=p.len_chars(), l=p.lpad(40, "*"), s=p.pad_start(40), r=p.pad_end(40, "-"), c=p.explode().arr.get(1))


@query("""SELECT p_partkey, nullif(trim(p_name, 'aeiou'), '') AS b, nullif(ltrim(p_name, 'bcdfg'), '') AS s, nullif(rtrim(p_name, 'rst'), '') AS e, p_name AS ts, p_name AS te, CASE WHEN ends_with(p_name, 'e') THEN left(p_name, length(p_name) - 1) ELSE p_name END AS x,
p_name || ' & é%' AS d FROM part""")
def str_strip_more(t):
    p = col("p_name").str
    return t("part").select("p_partkey", b=p.strip_chars("aeiou"), s=p.strip_chars_start("bcdfg"), e=p.strip_chars_end("rst"), ts=lit(" \t").str.concat(col("p_name")).str.trim_start(), te=p.concat(" \n").str.trim_end(), x=p.strip_suffix("e"), d=p.concat(" & é%").str.encode_uri_component().str.decode_uri_component())


@query("""WITH w AS (SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS w FROM part)
SELECT p_partkey, array_to_string(w, ' ') AS t, array_to_string(w, '') AS p, lower(w[1]) || array_to_string(w[2:], '') AS c, lower(array_to_string(w, '_')) || '_2_urls' AS s FROM w""")
def str_case_more(t):
    p = col("p_type").str
    return t("part").select("p_partkey", t=p.to_titlecase(), p=p.to_pascalcase(), c=p.to_camelcase(), s=p.to_pascalcase().str.concat("2URLs").str.to_snakecase())


@query("SELECT event_id, ts::DATE AS d, strftime(ts, '%H:%M:%S') AS c, strftime(ts, '%H:%M:%S') < '12:00:00' AS am FROM events")
def str_dates(t):
    clock = col("ts").dt.strftime("%H:%M:%S")
    return t("events").select("event_id", d=col("ts").dt.strftime("%F").str.to_date(), c=clock.str.to_time().cast(lf.types.Utf8).str.head(8), am=clock.str.to_time().cast(lf.types.Utf8).lt("12:00:00"))


@query("SELECT p_partkey, regexp_replace(p_name, '^.', upper(left(p_name, 1))) AS f, round(p_retailprice, 2) AS price, (p_size * 1000)::DOUBLE AS big FROM part")
def str_callbacks_and_numbers(t):
    p = col("p_name").str
    money = col("p_retailprice").round(2).cast(lf.types.Utf8)
    return t("part").select("p_partkey", f=p.replace(re.compile("^."), lambda m: m.upper()), price=lit(" +").str.concat(money).str.concat(" ").cast(lf.types.Float64), big=col("p_size").cast(lf.types.Utf8).str.concat("e3").cast(lf.types.Float64))


# ---- time


@query("""SELECT event_id, (((epoch_us(ts) // 1000) % 1000) * 1000)::INT AS us, (((epoch_us(ts) // 1000) % 1000) * 1000000)::INT AS ns, ((year(ts) - 1) // 1000 + 1)::INT AS mil, weekofyear(ts)::INT AS w, strftime(ts, '%H:%M:%S.%g') AS t, epoch_us(ts) AS e, ts AS same,
hour(ts + INTERVAL 9 HOUR)::INT AS h, strftime(ts + INTERVAL 9 HOUR, '%d %H') AS z FROM events""")
def dt_more(t):
    d = col("ts").dt
    tokyo = d.convert_time_zone("Asia/Tokyo").dt
    return t("events").select("event_id", us=d.microsecond(), ns=d.nanosecond(), mil=d.millennium(), w=d.week(), t=d.time(), e=d.timestamp("us"), same=d.cast_time_unit("us"), h=tokyo.hour(), z=tokyo.strftime("%d %H"))


@query("SELECT o_orderkey, make_timestamp(2001, 2, day(o_orderdate), hour(o_orderdate), minute(o_orderdate), 7.0) AS r, make_timestamp(year(o_orderdate), 12, 31, 0, 0, 0.0) AS e FROM orders WHERE day(o_orderdate) <= 28")
def dt_replace(t):
    d = col("o_orderdate").dt
    return t("orders").filter(d.day().le(28)).select("o_orderkey", r=d.replace(year=2001, month=2, second=7, millisecond=0), e=d.replace(month=12, day=31, hour=0, minute=0, second=0, millisecond=0))


@query("""SELECT event_id, round(user_id * 1.0 + 0.5, 8) AS h, round((user_id * 3600 + 1800) * 1.0, 4) AS s, ((user_id * 3600 + 1800) * 1000)::DOUBLE AS ms, ((user_id * 3600 + 1800) * 1000000)::DOUBLE AS us, ((user_id * 3600 + 1800) * 1000000000)::DOUBLE AS ns FROM events""")
def dt_totals(t):
    d = lf.duration(hours=col("user_id"), minutes=30).dt
    f64 = lf.types.Float64
    return t("events").select("event_id", h=d.total_hours().round(8), s=d.total_seconds().round(4), ms=d.total_milliseconds().cast(f64), us=d.total_microseconds().cast(f64), ns=d.total_nanoseconds().cast(f64))


# ---- lists


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(embedding, lambda x: floor(x * 4)::INT) AS k FROM embeddings)
SELECT vec_id, len(list_filter(v, lambda x: x = 0)) = 0 AS al, len(list_filter(k, lambda x: x <> 0)) > 0 AS an, (list_position(v, list_min(v)) - 1)::INT AS am, len(v)::INT AS n, round(list_median(v), 6) AS md, round(list_stddev_samp(v), 6) AS sd, round(list_var_samp(v), 6) AS va,
round(list_sum(v), 4) AS s, len(list_distinct(list_transform(k, lambda x: abs(x))))::INT AS u FROM e""")
def arr_numbers(t):
    f = t("embeddings").with_columns(k=col("embedding").arr.eval(element().mul(4).floor().cast(lf.types.Int32)))
    a, k = col("embedding").arr, col("k").arr
    return f.select("vec_id", al=a.all(), an=k.any(), am=a.arg_min(), n=a.len(), md=a.median().round(6), sd=a.std().round(6), va=a.variance().round(6), s=a.agg(element().sum()).round(4), u=k.n_unique(key=lambda e: e.abs()))


@query("""WITH d AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)
SELECT doc_id, list_has_all(w, ['the', 'of']) AS ca, list_has_any(w, ['the', 'und', 'les']) AS cy, len(list_filter(w, lambda x: x = 'the'))::INT AS cm, coalesce(w[1], '') || '|' || coalesce(w[3], '') || '|' || coalesce(w[-1], '') AS g,
array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ') AS ev, array_to_string(w[1:-2], ' ') AS sh FROM d""")
def arr_words(t):
    w = col("text").str.lower().str.split(" ").arr
    return t("documents").select("doc_id", ca=w.contains_all(["the", "of"]), cy=w.contains_any(["the", "und", "les"]), cm=w.count_matches("the"), g=w.gather([0, 2, -1]).arr.join("|"), ev=w.gather_every(2).arr.join(" "), sh=w.shift(1).arr.join(" ", ignore_nulls=True))


@query("""WITH d AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), c AS (SELECT doc_id, u, count(*) AS n FROM (SELECT doc_id, unnest(w) AS u FROM d) GROUP BY ALL), m AS (SELECT doc_id, string_agg(u, ',' ORDER BY u) AS mo FROM c JOIN (SELECT doc_id, max(n) AS n FROM c GROUP BY 1) USING (doc_id, n) GROUP BY 1)
SELECT doc_id, mo, array_to_string(w[1:1] || ['X', 'Y'] || w[4:], ' ') AS sp, w[1] AS field_0, w[2] AS field_1 FROM d JOIN m USING (doc_id)""")
def arr_mode_splice_struct(t):
    w = col("text").str.lower().str.split(" ").arr
    return t("documents").select("doc_id", mo=w.mode().arr.join(","), sp=w.splice(1, 2, "X", "Y").arr.join(" "), s=w.to_struct(upper_bound=2)).unnest("s")


@query("SELECT conv_id, turn, unnest(string_split(text, '\n')) AS line FROM conversations")
def arr_explode(t):
    return t("conversations").select("conv_id", "turn", col("text").str.split("\n").arr.explode().alias("line"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, 'A'), lambda x, i: (i - 1) || ':' || lower(x)), '/') AS j FROM nation")
def arr_join_callback(t):
    return t("nation").select("n_nationkey", j=col("n_name").str.split("A").arr.join("/", value_formatter=lambda v, i: f"{i}:{v.lower()}"))


# ---- frames


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, length(text)::INT AS n, lang FROM documents")
def row_index_documents(t):
    return t("documents").order_by("doc_id").with_row_index("i").select("doc_id", "i", "lang", n=col("text").str.len())


@query("SELECT l.event_id AS event_id, r.event_id AS other, l.i AS i FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS i FROM events) l JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) r USING (i)")
def frame_reverse_hstack(t):
    e = t("events").select("event_id").order_by("event_id")
    return e.reverse().hstack(e.rename({"event_id": "other"})).with_row_index("i").select("event_id", "other", "i")


@query("(SELECT event_id, 'a' AS part FROM events ORDER BY event_id LIMIT 20 OFFSET 5) UNION ALL (SELECT event_id, 'b' FROM events ORDER BY event_id DESC LIMIT 10) UNION ALL (SELECT event_id, 'c' FROM events ORDER BY event_id LIMIT 3)")
def frame_limit(t):
    e = t("events").select("event_id").order_by("event_id")
    marked = lambda f, x: f.with_columns(part=lit(x))
    return marked(e.limit(20, offset=5), "a").concat(marked(e.limit(10, from_="end"), "b"), marked(e.head(3), "c"))


@query("SELECT n_nationkey, n_name || '!' AS loud, coalesce(CASE WHEN n_regionkey > 1 THEN n_regionkey END, -1)::INT AS n_regionkey, n_name FROM nation")
def frame_insert_fill(t):
    f = t("nation").select("n_nationkey", "n_name", n_regionkey=when(col("n_regionkey").gt(1)).then(col("n_regionkey")))
    return f.fill_null(-1).insert_column(1, "loud", col("n_name").str.concat("!")).select("n_nationkey", "loud", "n_regionkey", "n_name")


@query("SELECT count(*)::INT AS height, 3::INT AS width, 'n_nationkey,n_name,n_regionkey' AS columns, 'n_nationkey,n_name,n_regionkey' AS fields, max(CASE WHEN n_nationkey = 3 THEN n_name END) AS item, 3::INT AS kinds FROM nation")
def frame_shape_item(t):
    f = t("nation").order_by("n_nationkey")
    return lf.data([{"height": f.height, "width": f.shape[1], "columns": ",".join(f.columns), "fields": ",".join(f.schema), "item": f.item(3, "n_name"), "kinds": len(f.dtypes)}])


@query("SELECT n_nationkey, n_name, 'abcde'[k:k] AS way FROM nation, (SELECT unnest(range(1, 6)) AS k)")
def frame_results_on_driver(t):
    f = t("nation").select("n_nationkey", "n_name").order_by("n_nationkey")
    columns = dict(zip(f.columns, f.iter_columns()))
    ways = [lf.data(f.to_dicts()), lf.data(f.to_dict()), lf.data(list(f.iter_rows(named=True))), lf.data(columns), lf.data({"n_nationkey": f.to_array("n_nationkey"), "n_name": f.clone().to_array("n_name")})]
    return lf.concat([w.with_columns(way=lit(c)) for w, c in zip(ways, "abcde")])


@query("SELECT 'r_name' AS field, " + ", ".join(f"max(CASE WHEN r_regionkey = {i} THEN r_name END) AS column_{i}" for i in range(5)) + " FROM region")
def frame_transpose(t):
    return t("region").order_by("r_regionkey").select("r_name").transpose(include_header=True, header_name="field")


@query("SELECT p_partkey, row_number() OVER (ORDER BY abs(p_size - 25), p_partkey) - 1 AS i FROM part")
def sort_custom_key(t):
    return t("part").sort(["p_size", "p_partkey"], custom={"p_size": lambda v: abs(v - 25)}).with_row_index("i").select("p_partkey", "i")


@query("SELECT n_nationkey, n_regionkey, n_name || '' AS n_name FROM nation WHERE n_regionkey = 1 OR n_name LIKE 'C%'")
def filter_callback_selectors(t):
    f = t("nation").filter(lambda r: r["n_regionkey"] == 1 or r["n_name"].startswith("C"))
    return f.select(lf.exclude("n_name"), col("n_name").debug()).select(lf.all())


@query("SELECT event_id, 10 + 3 * (row_number() OVER (ORDER BY event_id) - 1) AS s, 7 AS c FROM events")
def seq_range_columns(t):
    return t("events").order_by("event_id").with_columns(s=lf.seq_range(10, step=3), c=lf.seq_range(7, mode="constant")).select("event_id", "s", "c")


# ---- joins


@query("SELECT n_name, r_name, row_number() OVER (ORDER BY n_name DESC) - 1 AS i FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def join_maintain_order(t):
    n, r = t("nation").order_by("n_name").reverse(), t("region").filter(col("r_regionkey").ne(2))
    return n.join(r, left_on="n_regionkey", right_on="r_regionkey", how="left", maintain_order="left").with_row_index("i").select("n_name", "r_name", "i")


@query("""WITH l AS (SELECT event_id, CASE WHEN value < 20 THEN NULL ELSE ts END AS k FROM events WHERE event_id % 3 = 0), r AS (SELECT event_id AS other, CASE WHEN value < 30 THEN NULL ELSE ts END AS k FROM events WHERE event_id % 3 = 1)
SELECT event_id, other FROM l ASOF LEFT JOIN r ON l.k >= r.k""")
def join_asof_null_keys(t):
    e = t("events")
    key = lambda least: when(col("value").ge(least)).then(col("ts"))
    left = e.filter(col("event_id").mod(3).eq(0)).select("event_id", k=key(20))
    right = e.filter(col("event_id").mod(3).eq(1)).select(other=col("event_id"), k=key(30))
    return left.join_asof(right, on="k").select("event_id", "other")


@query("SELECT unnest(['SchemaError', 'InvalidArgumentError', 'ColumnNotFoundError', 'ShapeError', 'InvalidArgumentError']) AS error, unnest(range(5))::INT AS n")
def error_kinds(t):
    n, e = t("nation"), t("events").select("event_id", "ts").order_by("event_id")
    calls = [
        lambda: n.join(n, left_on="n_name", right_on="n_nationkey"),
        lambda: e.reverse().join_asof(e, on="ts", check_sorted=True),
        lambda: n.join(n, on="not there"),
        lambda: n.hstack(n.head(3).rename({c: f"{c}2" for c in n.columns})),
        lambda: n.join(n, how="inner"),
    ]
    found = []
    for i, call in enumerate(calls):
        try:
            call()
        except errors.FrameError as x:
            found.append({"error": type(x).__name__, "n": i})
    return lf.data(found)


# ---- rows and text at hand


@query("SELECT n_nationkey, n_name, label FROM nation JOIN (VALUES (0, 'a'), (1, 'b'), (3, NULL)) v(k, label) ON n_regionkey = k")
def memory_rows_and_columns(t):
    rows, columns = lf.data([{"k": 0, "label": "a"}, {"k": 1, "label": "b"}, {"k": 3}]), lf.data({"k": [0, 1, 3]})
    return t("nation").join(rows.join(columns, on="k"), left_on="n_regionkey", right_on="k").select("n_nationkey", "n_name", "label")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, kind FROM nation, (VALUES ('csv'), ('json'), ('ndjson')) v(kind)")
def text_sources(t):
    n = t("nation")
    k = lf.types
    schema = {"n_nationkey": k.Int64, "n_name": k.Utf8, "n_regionkey": k.Int64}
    ways = {"csv": lf.read_csv(n.write_csv(), schema=schema), "json": lf.read_json(n.write_json(), schema=schema), "ndjson": lf.read_json(n.write_json(format="ndjson"), format="ndjson", schema=schema)}
    return lf.concat([f.with_columns(kind=lit(w)) for w, f in ways.items()])


@query("""SELECT c_custkey::VARCHAR AS c_custkey, format('{:,.2f}', c_acctbal) AS grouped, CASE WHEN c_acctbal < 0 THEN '(' || format('{:.2f}', -c_acctbal) || ')' ELSE format('{:.2f}', c_acctbal) END AS accounts,
replace(replace(replace(format('{:,.2f}', c_acctbal), ',', '_'), '.', ','), '_', '.') AS german, format('{:.1f}', round(c_acctbal)) AS whole FROM customer""")
def csv_number_formats(t):
    f = t("customer").select(c_custkey=col("c_custkey").cast(lf.types.Utf8), x=col("c_acctbal"))
    text = lambda g, **options: lf.read_csv(g.write_csv(separator=";", **options), separator=";", infer_schema=False)
    out = text(f.select("c_custkey", whole=col("x").round()), float_decimals=1)
    for name, style in {"grouped": {"decimals": 2, "grouping": True}, "accounts": {"decimals": 2, "accounting": True}, "german": {"decimals": 2, "grouping": True, "locale": "de-DE"}}.items():
        out = out.join(text(f.rename({"x": name}), number_format=style), on="c_custkey")
    return out
