"""Registered queries of the engine's own operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

import loomframe as lf
from loomframe import col, element, lit, when
from loomframe.plans.register import ORACLES, QUERIES, query
from loomframe.sources.scratch import scratch
from loomframe.streaming import windows

__all__ = ["ORACLES", "QUERIES"]


# ---- filter, project


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    e = col("l_extendedprice")
    g = t("lineitem").filter(col("l_shipdate").le(lit("1998-09-02").str.to_datetime())).groupby("l_returnflag", "l_linestatus")
    return g.agg(col("l_quantity").sum().round(2).alias("sum_qty"), e.sum().round(2).alias("sum_base"), e.mul(lit(1).sub(col("l_discount"))).sum().round(2).alias("sum_disc"), col("l_quantity").mean().round(4).alias("avg_qty"), col("l_discount").mean().round(4).alias("avg_disc"), e.count(include_nulls=True).alias("n"))


@query("SELECT event_id, user_id, round(value * 2, 4) AS doubled FROM events WHERE value > 50 AND event_type = 'click'")
def filter_and_project(t):
    return t("events").filter(col("value").gt(50), col("event_type").eq("click")).select("event_id", "user_id", col("value").mul(2).round(4).alias("doubled"))


@query("""SELECT o_orderkey, round(o_totalprice / 3 + 1, 4) AS a, round(sqrt(o_totalprice), 4) AS b, floor(o_totalprice / 100)::BIGINT AS c, o_orderkey % 7 AS d,
round(ln(o_totalprice), 6) AS e, o_totalprice - floor(o_totalprice) > 0.5 AS f FROM orders""")
def with_columns_arith(t):
    p = col("o_totalprice")
    return t("orders").with_columns(a=p.div(3).add(1).round(4), b=p.sqrt().round(4), c=p.floordiv(100), d=col("o_orderkey").mod(7), e=p.log().round(6), f=p.sub(p.floor()).gt(0.5)).select("o_orderkey", "a", "b", "c", "d", "e", "f")


@query("""SELECT event_id, round(sin(value), 8) AS sn, round(cos(value), 8) AS cs, round(tanh(value / 100), 8) AS th, round(exp(value / 100), 6) AS ex, round(atan2(value, 2.0), 8) AS at2,
round(degrees(value), 4) AS dg, sign(value - 50)::DOUBLE AS sg, CASE WHEN abs(value / 100) <= 1 THEN round(acos(value / 100), 8) END AS ac, round(cbrt(value), 8) AS cb, least(greatest(value, 20.0), 80.0) AS cl FROM events""")
def math_functions(t):
    v = col("value")
    h = v.div(100)
    return t("events").select("event_id", sn=v.sin().round(8), cs=v.cos().round(8), th=h.tanh().round(8), ex=h.exp().round(6), at2=v.atan2(2.0).round(8), dg=v.degrees().round(4), sg=v.sub(50).sign(), ac=h.acos().round(8), cb=v.cbrt().round(8), cl=v.clip(20.0, 80.0))


@query("SELECT event_id, CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'mid' ELSE event_type END AS band FROM events")
def case_when(t):
    return t("events").select("event_id", when(col("value").ge(75)).then("high").when(col("value").ge(25)).then("mid").otherwise("event_type").alias("band"))


@query("SELECT event_id, coalesce(CASE WHEN value >= 10 THEN value END, user_id::DOUBLE, -1) AS v, coalesce(CASE WHEN value >= 10 THEN value END, 0) AS filled FROM events")
def coalesce_lit(t):
    some = when(col("value").ge(10)).then(col("value")).otherwise(None)
    return t("events").select("event_id", lf.coalesce(some, col("user_id").cast(lf.types.Float64), lit(-1.0)).alias("v"), some.fill_null(0.0).alias("filled"))


@query("SELECT event_id, value BETWEEN 20 AND 40 AS b, value > 20 AND value < 40 AS o, event_type IN ('click', 'view') AS i, user_id NOT IN (1, 2, 3) AS n FROM events")
def between_isin(t):
    return t("events").select("event_id", b=col("value").between(20, 40), o=col("value").between(20, 40, "none"), i=col("event_type").is_in(["click", "view"]), n=col("user_id").not_in([1, 2, 3]))


@query("""WITH e AS (SELECT event_id, CASE WHEN value < 30 THEN NULL ELSE user_id END AS a, CASE WHEN value > 70 THEN NULL ELSE user_id END AS b FROM events)
SELECT event_id, a = b AS eq, a IS NOT DISTINCT FROM b AS same, a IS DISTINCT FROM b AS differ, a IS NULL AS an, (a > 50 AND b > 50) AS k, (a > 50 OR b > 50) AS o FROM e""")
def null_safe_eq(t):
    f = t("events").select("event_id", a=when(col("value").ge(30)).then(col("user_id")), b=when(col("value").le(70)).then(col("user_id")))
    a, b = col("a"), col("b")
    return f.select("event_id", eq=a.eq(b), same=a.eq_missing(b), differ=a.ne_missing(b), an=a.is_null(), k=a.gt(50).and_(b.gt(50)), o=a.gt(50).or_(b.gt(50)))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_name) > 1 AS dup, count(*) OVER (PARTITION BY p_name) = 1 AS uni FROM part")
def duplicated_unique(t):
    return t("part").select("p_partkey", dup=col("p_name").is_duplicated(), uni=col("p_name").is_unique())


@query("SELECT p_partkey, p_size::DOUBLE AS x FROM part")
def casts_and_selectors(t):
    return t("part").select(lf.col(lf.types.Int64), col("p_size").cast(lf.types.Float64).alias("x"))


# ---- aggregates


@query("""SELECT event_type, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 4) AS m, min(value) AS lo, max(value) AS hi, round(stddev_samp(value), 4) AS sd, round(var_samp(value), 4) AS v,
count(DISTINCT user_id) AS u, round(product(1 + value / 1e6), 6) AS p, bool_and(value > 0) AS a, bool_or(value > 99) AS o FROM events GROUP BY 1""")
def agg_stats(t):
    v = col("value")
    return t("events").groupby("event_type").agg(n=v.len(), s=v.sum().round(2), m=v.mean().round(4), lo=v.min(), hi=v.max(), sd=v.std().round(4), v=v.variance().round(4), u=col("user_id").n_unique(), p=v.div(1e6).add(1).product().round(6), a=v.gt(0).all(), o=v.gt(99).any())


@query("SELECT event_type, quantile_cont(value, 0.5) AS med, round(quantile_cont(value, 0.1), 6) AS q1, round(quantile_cont(value, 0.95), 6) AS q9 FROM events GROUP BY 1")
def agg_quantile_median(t):
    v = col("value")
    return t("events").groupby("event_type").agg(med=v.median(), q1=v.quantile(0.1).round(6), q9=v.quantile(0.95).round(6))


@query("""WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY 1), d AS (SELECT e.event_type, value - mu AS d FROM events e JOIN m USING (event_type))
SELECT event_type, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 4) AS skew, round(avg(d ** 4) / avg(d ** 2) ** 2 - 3, 4) AS kurt,
round(sqrt(count(*) * (count(*) - 1)) / (count(*) - 2) * avg(d ** 3) / avg(d ** 2) ** 1.5, 4) AS skew_u FROM d GROUP BY 1""")
def agg_skew_kurt(t):
    v = col("value")
    return t("events").groupby("event_type").agg(skew=v.skew().round(4), kurt=v.kurtosis().round(4), skew_u=v.skew(bias=False).round(4))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS c, round(covar_samp(l_quantity, l_discount), 4) AS cv, round(sum(l_quantity * l_discount), 2) AS dt,
round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS wa FROM lineitem GROUP BY 1""")
def agg_corr_cov_dot_wavg(t):
    q = col("l_quantity")
    return t("lineitem").groupby("l_returnflag").agg(c=q.corr(col("l_extendedprice")).round(4), cv=q.cov(col("l_discount")).round(4), dt=q.dot(col("l_discount")).round(2), wa=col("l_extendedprice").w_avg(q).round(2))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events)
SELECT event_type, round(corr(a, b), 4) AS sp FROM r GROUP BY 1""")
def agg_spearman(t):
    return t("events").groupby("event_type").agg(sp=col("value").spearman_corr(col("user_id")).round(4))


@query("""WITH n AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, max(n) AS m FROM n GROUP BY 1)
SELECT p_brand, string_agg(p_size::VARCHAR, ',' ORDER BY p_size) AS modes FROM n JOIN m USING (p_brand) WHERE n = m GROUP BY 1""")
def agg_mode_all(t):
    return t("part").groupby("p_brand").agg(col("p_size").mode().arr.join(",").alias("modes"))


@query("""WITH n AS (SELECT event_type, user_id, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM n)
SELECT event_type, round(-sum(p * ln(p)), 6) AS e, round(-sum(p * log2(p)), 6) AS b FROM p GROUP BY 1""")
def agg_entropy(t):
    u = col("user_id")
    return t("events").groupby("event_type").agg(e=u.entropy().round(6), b=u.entropy(base=2).round(6))


@query("SELECT user_id, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l FROM events GROUP BY 1")
def agg_first_last(t):
    v = col("value")
    return t("events").order_by("event_id").groupby("user_id").agg(f=v.first(), l=v.last())


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events)
SELECT user_id, max(CASE WHEN a = 1 THEN event_id END) AS lo, max(CASE WHEN b = 1 THEN event_id END) AS hi, max(CASE WHEN a = 1 THEN p END) AS ilo, max(CASE WHEN b = 1 THEN p END) AS ihi FROM r GROUP BY 1""")
def agg_minby_maxby_arg(t):
    v, e = col("value"), col("event_id")
    return t("events").order_by("event_id").groupby("user_id").agg(lo=e.min_by(v), hi=e.max_by(v), ilo=v.arg_min(), ihi=v.arg_max())


@query("SELECT o_orderpriority, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x FROM orders GROUP BY 1")
def agg_bitwise(t):
    k = col("o_orderkey")
    return t("orders").groupby("o_orderpriority").agg(a=k.bitwise_and(), o=k.bitwise_or(), x=k.bitwise_xor())


@query("SELECT count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 4) AS m, count(DISTINCT event_type) AS k, quantile_cont(value, 0.5) AS med FROM events")
def global_agg(t):
    v = col("value")
    return t("events").select(n=v.len(), s=v.sum().round(2), m=v.mean().round(4), k=col("event_type").n_unique(), med=v.median())


@query("""SELECT event_type, user_id % 3 AS k, count(CASE WHEN value >= 10 THEN 1 END) AS n, count(*) - count(CASE WHEN value >= 10 THEN 1 END) AS z, round(avg(CASE WHEN value >= 10 THEN value END), 4) AS m,
bool_or(value < 10) AS h FROM events GROUP BY 1, 2""")
def agg_nulls(t):
    v = when(col("value").ge(10)).then(col("value"))
    return t("events").groupby("event_type", col("user_id").mod(3).alias("k")).agg(n=v.count(), z=v.null_count(), m=v.mean().round(4), h=v.has_nulls())


@query("SELECT DISTINCT event_type, user_id FROM events")
def group_keys(t):
    return t("events").groupby("event_type", "user_id").to_dataframe()


# ---- windows


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 4) AS m, max(value) OVER (PARTITION BY user_id) AS hi, count(*) OVER (PARTITION BY user_id) AS n,
round(value - avg(value) OVER (PARTITION BY event_type), 4) AS d, round(stddev_samp(value) OVER (PARTITION BY event_type), 4) AS sd FROM events""")
def win_partition_agg(t):
    v = col("value")
    return t("events").select("event_id", m=v.mean().over("user_id").round(4), hi=v.max().over("user_id"), n=v.len().over("user_id"), d=v.sub(v.mean().over("event_type")).round(4), sd=v.std().over("event_type").round(4))


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS r, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS d FROM events")
def win_rank_family(t):
    u = col("user_id")
    return t("events").select("event_id", r=u.rank().over("event_type"), d=u.dense_rank().over("event_type"))


@query("SELECT event_id, lag(value) OVER w AS a, lead(value, 2) OVER w AS b, lag(value, 1, -1) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win_lag_lead(t):
    v = col("value")
    return t("events").order_by("event_id").select("event_id", a=v.lag().over("user_id"), b=v.lead(2).over("user_id"), c=v.lag(1, -1.0).over("user_id"))


@query("""SELECT event_id, round(sum(value) OVER w, 2) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi, count(value) OVER w AS n,
round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS r FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def win_cumulative(t):
    v = col("value")
    return t("events").order_by("event_id").select("event_id", s=v.cum_sum().over("user_id").round(2), lo=v.cum_min().over("user_id"), hi=v.cum_max().over("user_id"), n=v.cum_count().over("user_id"), r=v.cum_sum(reverse=True).over("user_id").round(2))


@query("""SELECT event_id, round(avg(value) OVER w, 4) AS m, round(sum(value) OVER w, 2) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi, round(coalesce(stddev_samp(value) OVER w, 0), 4) AS sd FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def win_rolling_stats(t):
    v = col("value")
    return t("events").order_by("event_id").select("event_id", m=v.rolling_mean(5).over("user_id").round(4), s=v.rolling_sum(5).over("user_id").round(2), lo=v.rolling_min(5).over("user_id"), hi=v.rolling_max(5).over("user_id"), sd=v.rolling_std(5).over("user_id").round(4))


@query("""SELECT event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS md, round(quantile_cont(value, 0.25) OVER w, 6) AS q FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def win_rolling_quantile(t):
    v = col("value")
    return t("events").order_by("event_id").select("event_id", md=v.rolling_median(5).over("user_id").round(6), q=v.rolling_quantile(0.25, 5).over("user_id").round(6))


@query("""WITH l AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w FROM events)
SELECT event_id, len(list_filter(w, lambda x: x < value)) + 1 AS r FROM l""")
def win_rolling_rank(t):
    return t("events").order_by("event_id").select("event_id", r=col("value").rolling_rank(4).over("user_id"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS row_number FROM events")
def win_row_number(t):
    return t("events").order_by("event_id").select("event_id", col("value").row_number().over("event_type"))


@query("SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE value > m")
def win_in_filter(t):
    return t("events").filter(col("value").gt(col("value").mean().over("user_id"))).select("event_id")


@query("""SELECT event_id, last_value(CASE WHEN value >= 30 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f,
first_value(CASE WHEN value >= 30 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
coalesce(CASE WHEN value >= 30 THEN value END, (SELECT max(value) FROM events)) AS m FROM events""")
def fill_null_strategies(t):
    f = t("events").order_by("event_id").with_columns(x=when(col("value").ge(30)).then(col("value")))
    x = col("x")
    return f.select("event_id", f=x.fill_null(strategy="forward").over("user_id"), b=x.fill_null(strategy="backward").over("user_id"), m=x.fill_null(strategy="max"))


# ---- joins


@query("""SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 AND o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def join_star(t):
    f = t("region").filter(col("r_regionkey").eq(1)).join(t("nation"), left_on="r_regionkey", right_on="n_regionkey")
    f = f.join(t("customer"), left_on="n_nationkey", right_on="c_nationkey").join(t("orders").filter(col("o_orderdate").ge(lit("1995-01-01").str.to_datetime())), left_on="c_custkey", right_on="o_custkey")
    f = f.join(t("lineitem"), left_on="o_orderkey", right_on="l_orderkey")
    return f.groupby("n_name").agg(n=col("l_tax").len(), revenue=col("l_extendedprice").mul(lit(1).sub(col("l_discount"))).sum().round(2))


def _sides(t):
    return t("customer").select("c_custkey", "c_name", "c_nationkey"), t("orders").filter(col("o_totalprice").gt(300000)).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def join_inner(t):
    c, o = _sides(t)
    return c.join(o, left_on="c_custkey", right_on="o_custkey").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def join_left(t):
    c, o = _sides(t)
    return c.join(o, left_on="c_custkey", right_on="o_custkey", how="left").select("c_custkey", "o_orderkey")


@query("SELECT o_custkey AS c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def join_right(t):
    c, o = _sides(t)
    return c.filter(col("c_nationkey").lt(5)).join(o, left_on="c_custkey", right_on="o_custkey", how="right").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def join_outer(t):
    c, o = _sides(t)
    return c.filter(col("c_nationkey").lt(5)).join(o, left_on="c_custkey", right_on="o_custkey", how="outer").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(t):
    c, o = _sides(t)
    return c.join(o, left_on="c_custkey", right_on="o_custkey", how="semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), on="doc_id", how="anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t("region").select("r_name").join(t("nation").select("n_name"), how="cross")


@query("SELECT a.event_id, b.event_id AS event_id_right FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def join_multi_key_suffix(t):
    e = t("events").select("event_id", "user_id", "event_type")
    return e.join(e, on=["user_id", "event_type"]).select("event_id", "event_id_right")


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN value < 1 THEN NULL ELSE user_id END AS k FROM events)
SELECT l.event_id AS a, r.event_id AS b FROM e l JOIN e r ON l.k IS NOT DISTINCT FROM r.k WHERE l.event_type = 'click' AND r.event_type = 'view'""")
def join_nulls(t):
    k = when(col("value").ge(1)).then(col("user_id"))
    l = t("events").filter(col("event_type").eq("click")).select(a=col("event_id"), k=k)
    r = t("events").filter(col("event_type").eq("view")).select(b=col("event_id"), k=k)
    return l.join(r, on="k", join_nulls=True).select("a", "b")


def _asof(t):
    trades = t("events").filter(col("event_type").eq("click")).select("event_id", "ts", "user_id")
    quotes = t("events").filter(col("event_type").ne("click")).select("ts", "user_id", qid=col("event_id"))
    return trades, quotes


@query("""SELECT l.event_id, r.event_id AS qid FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_asof_backward(t):
    a, b = _asof(t)
    return a.join_asof(b, on="ts", by="user_id").select("event_id", "qid")


@query("""SELECT l.event_id, r.event_id AS qid FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'click') r ON l.user_id = r.user_id AND l.ts <= r.ts""")
def join_asof_forward(t):
    a, b = _asof(t)
    return a.join_asof(b, on="ts", by="user_id", strategy="forward").select("event_id", "qid")


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'click'), q AS (SELECT * FROM events WHERE event_type <> 'click'),
b AS (SELECT l.event_id, l.ts, r.event_id AS i, r.ts AS rt FROM l ASOF LEFT JOIN q r ON l.user_id = r.user_id AND l.ts >= r.ts),
f AS (SELECT l.event_id, r.event_id AS i, r.ts AS rt FROM l ASOF LEFT JOIN q r ON l.user_id = r.user_id AND l.ts <= r.ts)
SELECT b.event_id, CASE WHEN f.rt IS NULL OR epoch_us(b.ts) // 1000 - epoch_us(b.rt) // 1000 <= epoch_us(f.rt) // 1000 - epoch_us(b.ts) // 1000 THEN b.i ELSE f.i END AS qid FROM b JOIN f USING (event_id)""")
def join_asof_nearest(t):
    a, b = _asof(t)
    return a.join_asof(b, on="ts", by="user_id", strategy="nearest").select("event_id", "qid")


@query("""SELECT l.event_id, CASE WHEN epoch_us(l.ts) // 1000 - epoch_us(r.ts) // 1000 <= 7200000 THEN r.event_id END AS qid FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_asof_tolerance(t):
    a, b = _asof(t)
    return a.join_asof(b, on="ts", by="user_id", tolerance="2h").select("event_id", "qid")


# ---- shape, order, sets


@query("""SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1""")
def pivot_last(t):
    return t("events").order_by("event_id").pivot(on="event_type", index="user_id", values="value", columns=["click", "view"])


@query("SELECT s_suppkey, 'nation' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'acctbal', s_acctbal FROM supplier")
def unpivot(t):
    f = t("supplier").select("s_suppkey", nation=col("s_nationkey"), acctbal=col("s_acctbal"))
    return f.unpivot(index="s_suppkey", on=["nation", "acctbal"])


@query("SELECT event_id, value FROM events WHERE value > 90 UNION ALL SELECT event_id, value FROM events WHERE value < 10")
def concat_vertical(t):
    e = t("events").select("event_id", "value")
    return e.filter(col("value").gt(90)).vstack(e.filter(col("value").lt(10)))


@query("SELECT event_id, value, NULL::BIGINT AS user_id FROM events WHERE value > 90 UNION ALL SELECT event_id, NULL, user_id FROM events WHERE value < 10")
def concat_diagonal(t):
    e = t("events")
    return lf.concat([e.filter(col("value").gt(90)).select("event_id", "value"), e.filter(col("value").lt(10)).select("event_id", "user_id")], how="diagonal")


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) FULL JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) USING (i)")
def concat_horizontal(t):
    return t("customer").order_by("c_custkey").select("c_custkey").hstack(t("orders").order_by("o_orderkey").select("o_orderkey"), strict=False)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def unique_subset(t):
    return t("events").order_by("event_id").unique(["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id, pos - 1 AS pos, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents)")
def explode_words(t):
    return t("documents").select("doc_id", w=col("text").str.split(" ")).explode("w", position="pos").select("doc_id", "pos", "w")


@query("SELECT conv_id, string_agg(role || ':' || length(text)::VARCHAR, '|' ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY 1")
def implode_group(t):
    f = t("conversations").order_by("conv_id", "turn").with_columns(x=col("role").str.concat(":").str.concat(col("text").str.len().cast(lf.types.Utf8)))
    return f.groupby("conv_id").agg(turns=col("x").implode().arr.join("|"), n=col("x").len())


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def topk_sort(t):
    return t("orders").select("o_orderkey", "o_totalprice").top_k(25, ["o_totalprice", "o_orderkey"])


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS i FROM orders""")
def sort_multi_key(t):
    f = t("orders").sort(["o_orderpriority", "o_totalprice", "o_orderkey"], descending=[False, True, False])
    return f.with_row_index("i").select("o_orderkey", "i")


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts) - 1 AS i FROM events) WHERE i >= 100 AND i < 250")
def slice_rows(t):
    return t("events").order_by("ts").slice(100, 250).select("event_id", "value")


@query("SELECT event_id FROM events ORDER BY ts DESC LIMIT 17")
def tail_rows(t):
    return t("events").order_by("ts").tail(17).select("event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts) + 4 AS index FROM events")
def row_index(t):
    return t("events").order_by("ts").with_row_index(offset=5).select("event_id", "index")


@query("SELECT event_id, user_id FROM events WHERE CASE WHEN value >= 40 THEN user_id END IS NOT NULL")
def drop_nulls(t):
    return t("events").with_columns(x=when(col("value").ge(40)).then(col("user_id"))).drop_nulls("x").select("event_id", "user_id")


@query("SELECT n_nationkey AS id, n_name AS title FROM nation")
def rename_drop(t):
    return t("nation").rename({"n_nationkey": "id", "n_name": "title"}).drop("n_regionkey", "not there")


# ---- text


@query("""SELECT p_partkey, upper(p_name) AS u, length(p_name)::INT AS n, left(p_name, 3) AS h, right(p_name, 2) AS t, reverse(p_name) AS r, starts_with(p_name, 'a') AS s, p_name || '/' || p_brand AS c,
contains(p_name, 'e') AS k, replace(p_name, 'e', 'E') AS x, strlen(p_name)::INT AS b FROM part""")
def str_basic(t):
    p = col("p_name").str
    return t("part").select("p_partkey", u=p.upper(), n=p.len(), h=p.head(3), t=p.tail(2), r=p.reverse(), s=p.starts_with("a"), c=p.concat("/").str.concat(col("p_brand")), k=p.contains("e"), x=p.replace_all("e", "E"), b=p.len_bytes())


@query(r"""SELECT page_id, nullif(regexp_extract(url, '//([^/]+)/', 1), '') AS host, len(regexp_extract_all(url, '[0-9]'))::INT AS digits, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_replace(url, '[0-9]+', '#') AS once,
regexp_matches(url, '^https') AS tls FROM pages""")
def str_regex(t):
    import re

    u = col("url").str
    return t("pages").select("page_id", host=u.extract(re.compile("//([^/]+)/"), 1), digits=u.count_matches(re.compile("[0-9]")), masked=u.replace_all(re.compile("[0-9]+"), "#"), once=u.replace(re.compile("[0-9]+"), "#"), tls=u.contains(re.compile("^https")))


@query("""SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 6 THEN lpad(c_custkey::VARCHAR, 6, '0') ELSE c_custkey::VARCHAR END AS z, CASE WHEN length(c_mktsegment) < 12 THEN rpad(c_mktsegment, 12, '.') ELSE c_mktsegment END AS p,
nullif(trim('  ' || c_name || ' '), '') AS t, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS s, substr(c_name, 3, 4) AS m FROM customer""")
def str_pad_strip(t):
    n = col("c_name").str
    return t("customer").select("c_custkey", z=col("c_custkey").cast(lf.types.Utf8).str.zfill(6), p=col("c_mktsegment").str.rpad(12, "."), t=lit("  ").str.concat(col("c_name")).str.concat(" ").str.trim(), s=n.strip_prefix("Customer#"), m=n.slice(2, 4))


@query("SELECT p_partkey, replace(lower(p_type), ' ', '_') AS snake, replace(lower(p_type), ' ', '-') AS kebab FROM part")
def str_case(t):
    p = col("p_type").str
    return t("part").select("p_partkey", snake=p.to_snakecase(), kebab=p.to_kebabcase())


@query("SELECT p_partkey, lower(hex(p_name)) AS h, to_base64(p_name::BLOB) AS b, p_name AS back, url_encode(p_name || ' &') AS u FROM part")
def str_encode(t):
    p = col("p_name").str
    return t("part").select("p_partkey", h=p.encode("hex"), b=p.encode("base64"), back=p.encode("base64").str.decode("base64"), u=p.concat(" &").str.encode_uri_component())


@query("SELECT event_id, regexp_extract(props, '[0-9]+')::INT AS k, round(regexp_extract(props, '[0-9]+')::DOUBLE / 8, 4) AS d FROM events")
def str_to_number(t):
    import re

    k = col("props").str.extract(re.compile("[0-9]+"))
    return t("events").select("event_id", k=k.str.to_integer(), d=k.str.to_decimal().div(8).round(4))


# ---- time


@query("""SELECT event_id, year(ts)::INT AS y, quarter(ts)::INT AS q, month(ts)::INT AS m, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, isodow(ts)::INT AS w, dayofyear(ts)::INT AS j,
((epoch_us(ts) // 1000) % 1000)::INT AS ms, epoch_us(ts) // 1000 AS e FROM events""")
def dt_parts(t):
    d = col("ts").dt
    return t("events").select("event_id", y=d.year(), q=d.quarter(), m=d.month(), d=d.day(), h=d.hour(), mi=d.minute(), s=d.second(), w=d.weekday(), j=d.ordinal_day(), ms=d.millisecond(), e=d.epoch())


@query("""SELECT o_orderkey, isoyear(o_orderdate)::INT AS iy, weekofyear(o_orderdate)::INT AS iw, ((year(o_orderdate) - 1) // 100 + 1)::INT AS c, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap FROM orders""")
def dt_iso(t):
    d = col("o_orderdate").dt
    return t("orders").select("o_orderkey", iy=d.iso_year(), iw=d.iso_week(), c=d.century(), leap=d.is_leap_year())


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS s, last_day(o_orderdate)::TIMESTAMP AS e, day(last_day(o_orderdate))::INT AS n, o_orderdate::DATE AS d, (o_orderdate::DATE + 30) AS p FROM orders""")
def dt_month_bounds(t):
    d = col("o_orderdate").dt
    return t("orders").select("o_orderkey", s=d.month_start(), e=d.month_end(), n=d.days_in_month(), d=d.date(), p=d.date().dt.offset_day(30))


@query("""SELECT event_id, hour(ts + INTERVAL 9 HOUR)::INT AS h, day(ts + INTERVAL 9 HOUR)::INT AS d, 32400000::BIGINT AS o, '+09:00' AS iso FROM events""")
def dt_tz(t):
    d = col("ts").dt
    return t("events").select("event_id", h=d.hour("Asia/Tokyo"), d=d.day("Asia/Tokyo"), o=d.utc_offset("Asia/Tokyo"), iso=d.utc_offset("Asia/Tokyo", format="iso"))


@query("""SELECT l.event_id, round((epoch_us(l.ts) // 1000 - 1577836800000) / 86400000.0, 6) AS days, round((epoch_us(l.ts) // 1000 - 1577836800000) / 60000.0, 8) AS minutes FROM events l""")
def dt_duration(t):
    ms = col("ts").sub(lit("2020-01-01").str.to_datetime())
    return t("events").select("event_id", days=ms.dt.total_days().round(6), minutes=ms.dt.total_minutes().round(8))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS a, strftime(ts, '%Y-%m-%d') AS b, strptime(strftime(ts, '%d.%m.%Y %H:%M:%S'), '%d.%m.%Y %H:%M:%S') AS c FROM events")
def dt_strftime(t):
    d = col("ts").dt
    return t("events").select("event_id", a=d.strftime("%Y/%m/%d %H:%M:%S"), b=d.strftime("%F"), c=d.strftime("%d.%m.%Y %H:%M:%S").str.strptime("%d.%m.%Y %H:%M:%S"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, isodow(o_orderdate) AS w FROM orders), r AS (SELECT *, d + (CASE w WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::INT AS s, CASE WHEN w >= 6 THEN 1 ELSE w END AS sw FROM o)
SELECT o_orderkey, w < 6 AS b, s + (5 // 5 * 7)::INT AS five, s + (CASE WHEN sw + 2 > 5 THEN 4 ELSE 2 END)::INT AS two FROM r""")
def dt_business_day(t):
    d = col("o_orderdate").dt
    day = d.date().dt
    return t("orders").select("o_orderkey", b=d.is_business_day(), five=day.offset_day(5, exclude_weekdays=[0, 6], roll="forward"), two=day.offset_day(2, exclude_weekdays=[0, 6], roll="forward"))


# ---- lists and structs


@query("""SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS m, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi,
(list_position(embedding, list_max(embedding)) - 1)::INT AS am, embedding[1]::DOUBLE AS f, embedding[-1]::DOUBLE AS l FROM embeddings""")
def arr_stats(t):
    a = col("embedding").arr
    f64 = lf.types.Float64
    return t("embeddings").select("vec_id", n=a.lengths(), s=a.sum().round(4), m=a.mean().round(6), lo=a.min().cast(f64), hi=a.max().cast(f64), am=a.arg_max(), f=a.first().cast(f64), l=a.last().cast(f64))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS sq, len(list_filter(embedding, lambda x: x > 0))::INT AS pos FROM embeddings""")
def arr_eval_filter(t):
    a = col("embedding").arr
    return t("embeddings").select("vec_id", sq=a.eval(element().mul(element())).arr.sum().round(4), pos=a.filter(element().gt(0)).arr.lengths())


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ') AS w, len(list_distinct(string_split(lower(text), ' ')))::INT AS n, list_contains(string_split(lower(text), ' '), 'the') AS c FROM documents""")
def arr_sort_unique(t):
    w = col("text").str.lower().str.split(" ").arr
    return t("documents").select("doc_id", w=w.unique().arr.sort().arr.join(" "), n=w.n_unique(), c=w.contains("the"))


@query("""SELECT doc_id, array_to_string(string_split(text, ' ')[2:4], ' ') AS s, string_split(text, ' ')[-2] AS g, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS r FROM documents""")
def arr_slice_reverse(t):
    w = col("text").str.split(" ").arr
    return t("documents").select("doc_id", s=w.slice(1, 4).arr.join(" "), g=w.get(-2), r=w.reverse().arr.join(" "))


@query("SELECT c_custkey, c_name || '!' AS label, c_nationkey + 1 AS k FROM customer")
def struct_fields(t):
    f = t("customer").select("c_custkey", s=lf.struct({"name": "c_name", "nation": "c_nationkey"}))
    f = f.with_columns(s=col("s").struct.with_fields({"label": col("s").struct.field("name").str.concat("!"), "nation": col("s").struct.field("nation").add(1)}))
    return f.select("c_custkey", col("s").struct.rename_fields({"nation": "k"}).alias("s")).unnest("s").select("c_custkey", "label", "k")


# ---- sources, sinks, streams


@query("SELECT event_id, user_id, event_type, value FROM events")
def csv_roundtrip(t):
    f = t("events").select("event_id", "user_id", "event_type", "value")
    f.write_csv(path := scratch(f.df.sparkSession, "csv"))
    return lf.scan_csv(path)


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_roundtrip(t):
    f = t("events").select("event_id", "user_id", "event_type", "value")
    f.write_json(path := scratch(f.df.sparkSession, "json"))
    k = lf.types
    return lf.scan_json(path, schema={"event_id": k.Int64, "user_id": k.Int64, "event_type": k.Utf8, "value": k.Float64})


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY ALL")
def stream_tumbling(t):
    return windows.tumbling(t("events").df, "ts", "1 day", ["event_type"], {"n": F.count(F.lit(1)), "s": F.round(F.sum("value"), 2)})


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    return windows.sessions(t("events").df, "ts", "12 hours", ["user_id"], {"n": F.count(F.lit(1))})


from loomframe.plans import wider  # noqa: E402, F401 (registers its queries)
