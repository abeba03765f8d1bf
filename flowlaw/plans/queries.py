"""The registered queries of the engine. plans/oracles.py has the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, coupled, metrics, splines
from ..functions.laws import laws, named
from ..functions.terms import Term, describe, dictionary, theta
from ..operators import noise, plateau, recovery, robust, sampling, search, smoothing, sparse, spectral, summary
from ..sources.results import pending, store
from ..sources.tables import event_hour, event_snapshots, table, temporary, trajectory_grid
from ..streaming.refit import slope, windowed_moments
from . import discovery, sweeps

N = 64
#: A small law for fields: diffusion and transport.
SMALL = dictionary(2, 2, True, 2)
SMALL_LAW = {Term(r=2, q=1): 0.05, Term(1, 1, 1): -1.0}


def _r(column, digits: int = 4):
    return F.round(column, digits)


def _unsigned_zero(value):
    """A rounded value, with one zero only."""
    return F.when(value == 0, 0.0).otherwise(value)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {k: F.col(v).cast("double").alias(k) for k, v in discovery.ITEM.items()}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names.values())


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of like size: quantity over 50, price over 100,000, discount and tax times 10."""
    i = _items(spark, sf_dir)
    return i.select("l_orderkey", "l_linenumber", (F.col("q") / 50).alias("q"), (F.col("p") / 100000).alias("p"), (F.col("d") * 10).alias("d"), (F.col("t") * 10).alias("t"))


def _item_id():
    """Order, line, part and supplier of an item in one number; order and line alone repeat."""
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")


def q_poly_terms(spark, sf_dir):
    """Powers and waves of a field's values."""
    terms = [t for t in dictionary(3, 0, waves=True)]
    rows = theta(table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("u")), terms)
    return rows.select("event_id", *[_r(F.col("theta")[i], 6).alias(n) for i, n in enumerate(("one", "u1", "u2", "u3", "sin_u", "cos_u"))])


def q_cross_terms(spark, sf_dir):
    """Products of columns up to the second degree, summed by return flag."""
    i = table(spark, sf_dir, "lineitem").withColumns({k: F.col(v).cast("double") for k, v in discovery.ITEM.items()})
    return i.groupBy("l_returnflag").agg(_r(F.sum(F.col("q") * F.col("p")) / 1e6).alias("q_p"), _r(F.sum(F.col("p") * F.col("d")) / 1e6).alias("p_d"), _r(F.sum(F.col("d") * F.col("t"))).alias("d_t"), _r(F.sum(F.col("q") * F.col("q")) / 1e6).alias("q_2"))


def q_field_terms(spark, sf_dir):
    """The mean of each dictionary term over all grid points of the events' fields, and its line in the dictionary's listing."""
    orders = (1, 2)
    rows = discovery.field_points(event_snapshots(spark, sf_dir), SMALL, orders)
    one = rows.select("series", F.posexplode("theta").alias("pos", "v"))
    names, lines = F.array(*[F.lit(t.name) for t in SMALL]), F.array(*map(F.lit, describe(SMALL).splitlines()))
    return one.groupBy("series", "pos").agg(_unsigned_zero(_r(F.avg("v"), 3)).alias("mean"), F.count("*").alias("n")).select("series", names[F.col("pos")].alias("term"), lines[F.col("pos")].alias("line"), "mean", "n")


def q_col_norms(spark, sf_dir):
    return summary.norms(_scaled(spark, sf_dir), ("q", "p", "d", "t")).select(*[_r(F.col(c), 6).alias(c) for c in ("q", "p", "d", "t")])


def q_normalise(spark, sf_dir):
    found = summary.normalised(_scaled(spark, sf_dir), ("q", "p"), mean=True)
    return found.select("l_orderkey", "l_linenumber", _r(F.col("q"), 6).alias("q"), _r(F.col("p"), 6).alias("p"))


def q_gram(spark, sf_dir):
    return summary.gram(_scaled(spark, sf_dir), ("q", "p", "d", "t")).select("a", "b", _r(F.col("value")).alias("value"))


def q_corr_abs(spark, sf_dir):
    """Likeness of unit columns, without that of a column with itself."""
    g = summary.gram(_scaled(spark, sf_dir), ("q", "p", "d", "t"))
    own = g.filter("a = b").select(F.col("a").alias("k"), F.sqrt("value").alias("len"))
    pairs = g.filter("a <> b").join(own.select(F.col("k").alias("a"), F.col("len").alias("la")), "a").join(own.select(F.col("k").alias("b"), F.col("len").alias("lb")), "b")
    return pairs.select("a", "b", _r(F.abs(F.col("value") / (F.col("la") * F.col("lb"))), 6).alias("likeness"))


def q_ols_1(spark, sf_dir):
    """A line through price over quantity, by return flag."""
    i = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return i.groupBy("l_returnflag").agg(_r(F.regr_slope("y", "x"), 3).alias("slope"), _r(F.regr_intercept("y", "x"), 2).alias("intercept"))


def q_ols_2(spark, sf_dir):
    """The charge on price and price times discount, from the factor of the whole dictionary's rows."""
    s = discovery.charge_summary(spark, sf_dir)
    support = [s.names.index("p"), s.names.index("p d")]
    c, _ = s.fit(support)
    found = recovery.Recovery("ols", tuple(support), ("p", "p d"), tuple(map(float, c)), 0.0)
    return discovery.found_terms(spark, found).select("term", _r(F.col("coefficient"), 6).alias("coefficient"))


def _five(spark, sf_dir, target):
    """The summary of one and the scaled columns of a line item, with a target made of these."""
    rows = _scaled(spark, sf_dir).select(F.array(F.lit(1.0), "q", "p", "d", "t").alias("theta"), target.alias("y"))
    return summary.summarize(rows, ("1", "q", "p", "d", "t"))


def q_omp_first_pick(spark, sf_dir):
    """The term that matching pursuit takes first, and how much its unit column has in common with the target."""
    s = _five(spark, sf_dir, F.col("p") * (1 - F.col("d") / 10))
    first = recovery.pursuit(s, 1)[0]
    gain = abs(float(s.terms[:, first] @ s.target)) / float(s.norms[first])
    return spark.createDataFrame([(s.names[first], gain)], "term string, gain double").withColumn("gain", _r(F.col("gain")))


def q_lasso_1d(spark, sf_dir):
    """The penalised coefficient of one unit column, by return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(F.col("l_quantity") / 50).alias("theta"), (F.col("l_extendedprice") / 100000).alias("y"))
    found = sweeps.of_groups(rows, ["l_returnflag"], ["x"], lambda s: (float(recovery.lasso_weights(s, 0.005)[0]),), "weight double")
    return found.select("l_returnflag", _r(F.col("weight"), 6).alias("weight"))


def q_residual(spark, sf_dir):
    i = _scaled(spark, sf_dir).withColumn("y", F.col("p") * (1 - F.col("d") / 10))
    return summary.residual(i, {"p": 0.95, "q": 0.01}, "y").select(_r(F.col("l2"), 6).alias("l2"), _r(F.col("l1"), 4).alias("l1"))


def q_relative_error(spark, sf_dir):
    """How far order totals are from what their items add up to, by status."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    both = table(spark, sf_dir, "orders").join(items, "o_orderkey")
    return both.groupBy("o_orderstatus").agg(_r(metrics.relative_error(F.col("s"), F.col("o_totalprice")), 6).alias("error"), F.count("*").alias("n"))


def q_add_noise(spark, sf_dir):
    noisy = noise.add_noise(_scaled(spark, sf_dir), ("q", "p"), ("l_orderkey", "l_linenumber"), 0.01, 3)
    return noisy.select("l_orderkey", "l_linenumber", _r(F.col("q"), 6).alias("q"), _r(F.col("p"), 6).alias("p"))


def q_hourly_grid(spark, sf_dir):
    grid = trajectory_grid(table(spark, sf_dir, "events"), "event_type", event_hour(), F.col("value") / 100, N)
    return grid.select("series", "j", "i", _r(F.col("u"), 4).alias("u"))


def q_snapshots(spark, sf_dir):
    """Length, sum and extremes of each snapshot's array."""
    s = event_snapshots(spark, sf_dir)
    return s.select("series", "j", F.size("u").cast("long").alias("n"), _r(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), _r(F.array_max("u"), 4).alias("most"), _r(F.array_min("u"), 4).alias("least"))


def q_dft(spark, sf_dir):
    grid = spectral.points(event_snapshots(spark, sf_dir), ["u"], ["series", "j"])
    return spectral.fourier(grid, ["series", "j"], N, 4).select("series", "j", F.col("k").cast("int").alias("k"), _r(F.col("a"), 4).alias("a"), _r(F.col("b"), 4).alias("b"))


def _derivative(spark, sf_dir, order):
    wide = spectral.with_derivatives(event_snapshots(spark, sf_dir), [order])
    return spectral.points(wide, [f"d{order}"], ["series", "j"]).select("series", "j", "i", _r(F.col(f"d{order}"), 3).alias("d"))


def q_spectral_ux(spark, sf_dir):
    return _derivative(spark, sf_dir, 1)


def q_spectral_uxx(spark, sf_dir):
    return _derivative(spark, sf_dir, 2)


def q_low_pass(spark, sf_dir):
    """Fields put together from their first four waves."""
    grid = spectral.points(event_snapshots(spark, sf_dir), ["u"], ["series", "j"])
    waves = spectral.fourier(grid, ["series", "j"], N, 4)
    return spectral.synthesis(waves, ["series", "j"], N).select("series", "j", "i", _unsigned_zero(_r(F.col("u"))).alias("u"))


def q_minmax_rescale(spark, sf_dir):
    """Each field of the events moved to the range from 0 to 1."""
    moved = event_snapshots(spark, sf_dir).withColumn("u", arrays.rescaled(F.col("u")))
    return spectral.points(moved, ["u"], ["series", "j"]).select("series", "j", "i", _r(F.col("u"), 6).alias("u"))


def q_time_derivative(spark, sf_dir):
    grid = spectral.points(event_snapshots(spark, sf_dir), ["u"], ["series", "j"])
    return spectral.rates(grid, ["series", "i"], 0.5).select("series", "j", "i", _r(F.col("u_t")).alias("u_t"))


def q_diffuse(spark, sf_dir):
    moved = spectral.diffuse(event_snapshots(spark, sf_dir), 0.2, 2)
    return spectral.points(moved, ["u"], ["series", "j"]).select("series", "j", "i", _r(F.col("u"), 4).alias("u"))


def q_topk_norm(spark, sf_dir):
    i = _scaled(spark, sf_dir)
    size = sampling.row_norm([F.col(c) for c in ("q", "p", "d", "t")])
    return sampling.largest(i, 100, size, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", _r(size, 6).alias("size"))


def q_head_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("row_id", F.col("o_orderkey"))
    return sampling.head(o, 1000).groupBy("o_orderstatus").agg(F.count("*").alias("n"), _r(F.sum("o_totalprice"), 2).alias("total"))


def q_fraction_rows(spark, sf_dir):
    """Sums over a tenth of the rows, chosen by their ids."""
    some = sampling.fraction(_items(spark, sf_dir), 0.1, "l_orderkey", "l_linenumber", seed=5)
    return some.groupBy(F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"), _r(F.sum("p"), 2).alias("total"))


def q_uniform_rows(spark, sf_dir):
    return sampling.uniform(_items(spark, sf_dir), 500, "l_orderkey", "l_linenumber", seed=1).select("l_orderkey", "l_linenumber")


def q_semi_rows(spark, sf_dir):
    """All items of the orders that a sample chose."""
    chosen = sampling.fraction(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), 0.05, "l_orderkey", seed=2)
    return sampling.matching(_items(spark, sf_dir), chosen, "l_orderkey").select("l_orderkey", "l_linenumber", _r(F.col("p"), 2).alias("p"))


def q_jaccard(spark, sf_dir):
    """Of each user: how alike the kinds of events of even and odd hours of the day are, and whether the odd ones have all of the even ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.hour("ts") % 2 == 0).alias("even"))
    g = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("even"), F.col("event_type"))).alias("a"), F.collect_set(F.when(~F.col("even"), F.col("event_type"))).alias("b"))
    return g.select("user_id", _r(metrics.jaccard(F.col("a"), F.col("b")), 6).alias("score"), metrics.covers(F.col("b"), F.col("a")).alias("covered"))


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return plateau.plateau_runs(e, ["user_id"], "event_id", F.when(F.col("event_type") != "click", F.col("event_type")))


def q_plateau_runs(spark, sf_dir):
    """Runs of one kind of event in each user's history; clicks stand for nothing."""
    return _runs(spark, sf_dir).select("user_id", "value", "start", "stop", "length")


def q_select_plateau(spark, sf_dir):
    long = _runs(spark, sf_dir).filter("length >= 2")
    return plateau.first_plateau(long, ["user_id"]).select("user_id", "value", "start", "stop", "length")


def q_group_pairs(spark, sf_dir):
    """Pairs of nations of a region, with the customers of both."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").join(c, "n_nationkey").select("n_nationkey", "n_regionkey", "n")
    a, b = n.alias("a"), n.alias("b")
    both = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return both.select(F.col("a.n_nationkey").alias("first"), F.col("b.n_nationkey").alias("second"), (F.col("a.n") + F.col("b.n")).alias("customers"))


def q_experiment_grid(spark, sf_dir):
    """All combinations of kind of event and hour of the day, with the number of events of each."""
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"))
    seen = e.groupBy("event_type", "hour").agg(F.count("*").alias("n"))
    all_ = sweeps.grid(e.select("event_type").distinct(), e.select("hour").distinct())
    return all_.join(seen, ["event_type", "hour"], "left").select("event_type", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def q_resume_anti(spark, sf_dir):
    """Customers and order priorities that have no order yet."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"))
    specs = sweeps.grid(table(spark, sf_dir, "customer").select("c_custkey"), o.select("priority").distinct())
    return pending(specs, o, ["c_custkey", "priority"])


def _votes(spark, sf_dir):
    s = _five(spark, sf_dir, F.col("p"))
    each = [np.array([k]) for k in range(5)]
    return s, recovery.votes(s, each, np.arange(5))


def q_votes(spark, sf_dir):
    """In how many fits of two terms the coefficient of each matters; the target is the price."""
    s, votes = _votes(spark, sf_dir)
    return spark.createDataFrame(list(zip(s.names, map(int, votes))), "term string, votes long")


def q_survivors(spark, sf_dir):
    """The terms that these votes leave."""
    s, votes = _votes(spark, sf_dir)
    return spark.createDataFrame([(n, int(v)) for n, v, stay in zip(s.names, votes, recovery.survivors(votes, 5)) if stay], "term string, votes long")


def q_laplacian(spark, sf_dir):
    """How alike each term is to all others together: the diagonal of the terms' graph, times the rows."""
    s = _five(spark, sf_dir, F.col("p"))
    degree = np.diag(recovery.laplacian(recovery.likeness(s))) * s.n
    return spark.createDataFrame(list(zip(s.names, map(float, degree))), "term string, degree double").withColumn("degree", _r(F.col("degree"), 6))


def q_success_pivot(spark, sf_dir):
    """Users and hours whose events of a kind are all above the mean, counted by kind and part of the day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.hour("ts") / 12).cast("int").alias("half"), "value")
    runs = e.groupBy("user_id", "event_type", "half").agg(F.avg((F.col("value") > 40).cast("double")).alias("score"))
    found = sweeps.success(runs, "event_type", "half", [0, 1])
    return found.select("event_type", F.coalesce("0", F.lit(0)).alias("first_half"), F.coalesce("1", F.lit(0)).alias("second_half"))


def q_mean_time(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return sweeps.mean_time(o, ["o_orderpriority"], "price").select("o_orderpriority", _r(F.col("seconds"), 2).alias("price"))


def q_threshold_support(spark, sf_dir):
    """Of a fit with a term too many, those whose coefficient is over a ten-thousandth of the largest, fitted again."""
    s = discovery.charge_summary(spark, sf_dir)
    support = recovery.truncated(s, [s.names.index(n) for n in ("q", "p", "p d")], 1e-4)
    found = recovery.Recovery("ols", tuple(support), tuple(s.names[i] for i in support), tuple(map(float, s.fit(support)[0])), 0.0)
    return _charge_result(spark, found)


def q_bspline_linear(spark, sf_dir):
    return _spline(spark, sf_dir, 1, 0)


def q_bspline_cubic(spark, sf_dir):
    return _spline(spark, sf_dir, 3, 0)


def q_bspline_slope(spark, sf_dir):
    return _spline(spark, sf_dir, 2, 1)


def _spline(spark, sf_dir, degree, derivative):
    """Sums of the design matrix by column: each event is a point of the day."""
    e = table(spark, sf_dir, "events").select("event_id", (F.hour("ts") / 24 + F.minute("ts") / 1440).alias("x"))
    return splines.design(e, "event_id", F.col("x"), 8, degree, derivative).groupBy("col").agg(_r(F.sum("val"), 4).alias("total"), _r(F.sum(F.col("val") * F.col("val")), 4).alias("squares"))


def q_kron(spark, sf_dir):
    """Design matrices over the hour and over the value, multiplied event by event, summed by column."""
    e = table(spark, sf_dir, "events").select("event_id", (F.hour("ts") / 24).alias("x"), (F.col("value") / 500).alias("z"))
    a, b = splines.design(e, "event_id", F.col("x"), 4, 1), splines.design(e, "event_id", F.col("z"), 3, 1)
    both = splines.kronecker(a, b, 0, 3, F.col("a.row") == F.col("b.row"))
    return both.groupBy("col").agg(_r(F.sum("val"), 4).alias("total"))


def q_smooth(spark, sf_dir):
    """Each field and the nearest cubic spline on sixteen intervals."""
    both = smoothing.smoothed(event_snapshots(spark, sf_dir).withColumn("s", F.col("u")), N, 16, 3, "s")
    return spectral.points(both, ["u", "s"], ["series", "j"]).select("series", "j", "i", _r(F.col("u")).alias("u"), _r(F.col("s")).alias("s"))


def q_truth_flags(spark, sf_dir):
    """The found terms as lines to print, with a mark for the true ones; only the price is taken for one here."""
    one = recovery.as_frame(spark, [recovery.omp(discovery.charge_summary(spark, sf_dir), 4, 1e-3)])
    found = one.select(F.explode(metrics.flagged(F.col("names"), F.col("coefficients"), F.array(F.lit("p")))).alias("x"), metrics.significant(F.col("coefficients")).alias("big"))
    return found.select("x.term", "x.right", "x.line", F.size("big").cast("long").alias("significant"))


def q_window_slope(spark, sf_dir):
    """By hour and kind of event, the slope of value over the minute: the batch form of the stream's windows."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = slope(windowed_moments(e, "at", "1 hour", "6 hours", ["event_type"], F.minute("at").cast("double"), F.col("value")))
    return found.select(F.floor(F.unix_timestamp(F.col("window.start")) / 3600).alias("hour"), "event_type", "n", _r(F.col("slope"), 4).alias("slope"))


def _charge_result(spark, found):
    return discovery.found_terms(spark, found).select("term", _r(F.col("coefficient"), 6).alias("coefficient"))


def q_ccp(spark, sf_dir):
    return _charge_result(spark, recovery.ccp(discovery.charge_summary(spark, sf_dir)))


def q_omp(spark, sf_dir):
    """Four picks, then those that matter."""
    s = discovery.charge_summary(spark, sf_dir)
    return _charge_result(spark, recovery.omp(s, 4, 1e-3))


def q_best_subset(spark, sf_dir):
    return _charge_result(spark, recovery.best_subset(spark, discovery.charge_summary(spark, sf_dir), most=3))


def q_lasso(spark, sf_dir):
    """The terms that a penalty leaves, refitted; those that come to nothing are not shown."""
    return _charge_result(spark, recovery.lasso(discovery.charge_summary(spark, sf_dir), alpha=0.5, mean=True)).filter(F.abs("coefficient") > 1e-6)


def q_field_law(spark, sf_dir):
    """The law behind the fields' rates, found again from their dictionary."""
    rows = discovery.field_rows(event_snapshots(spark, sf_dir), SMALL, SMALL_LAW, (1, 2))
    s = summary.summarize(rows, [t.name for t in SMALL])
    return _charge_result(spark, recovery.best_subset(spark, s, most=3))


def q_group_laws(spark, sf_dir):
    """The charge found anew for each return flag."""
    columns = {k: F.col(v).cast("double") for k, v in discovery.ITEM.items()}
    terms = discovery.products(columns)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(*terms.values()).alias("theta"), (columns["p"] * (1 - columns["d"])).alias("y"))
    found = sweeps.scored(sweeps.identify_groups(rows, ["l_returnflag"], list(terms), "ccp"), ["p", "p d"])
    return found.select("l_returnflag", F.array_join(F.array_sort("names"), ",").alias("terms"), _r(F.col("score"), 4).alias("score"))


def q_signal_rows(spark, sf_dir):
    """The three rows that span most, out of the six with the largest terms."""
    scaled = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10]
    wide = table(spark, sf_dir, "lineitem").select(_item_id().alias("row_id"), F.array(*scaled).alias("theta"))
    found = sampling.signal_rows(wide, 3, "row_id")
    return found.select("row_id", _r(arrays.length(F.col("theta")), 6).alias("size")).distinct()  # a row may stand there twice


def q_identify(spark, sf_dir):
    """The charge, from terms chosen on a sample by each sampler, checked and fitted on all rows."""
    columns = {k: F.col(v).cast("double") for k, v in discovery.ITEM.items()}
    terms = discovery.products(columns)
    rows = table(spark, sf_dir, "lineitem").select(_item_id().alias("row_id"), F.array(*terms.values()).alias("theta"), (columns["p"] * (1 - columns["d"])).alias("y"))
    out, full = None, summary.summarize(rows, list(terms))
    for sampler, method in (("random", "ccp"), ("signal_qr", "omp"), ("qr", "nearest"), ("full", "lasso")):
        how = {"omp": {"k": 4, "threshold": 1e-3}, "lasso": {"alpha": 0.5, "mean": True}, "nearest": {"most": 2}}.get(method, {})
        found = _charge_result(spark, discovery.identify(rows, list(terms), method, sampler, 2000, full=full, **how)).filter(F.abs("coefficient") > 1e-6)
        one = found.select(F.lit(sampler).alias("sampler"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def q_sensor_noise(spark, sf_dir):
    """The events' fields with noise in all but each series' first one."""
    noisy = noise.sensor_noise(event_snapshots(spark, sf_dir), ["series"], "j", 0.01, 7)
    return spectral.points(noisy, ["u"], ["series", "j"]).select("series", "j", "i", _r(F.col("u"), 6).alias("u"))


def q_snapshot_store(spark, sf_dir):
    """The events' fields, written once as a table by series and read again."""
    path = temporary(spark)
    store(event_snapshots(spark, sf_dir), path, "series")
    found = store(event_snapshots(spark, sf_dir), path, "series")
    return found.select("series", "j", F.size("u").cast("long").alias("n"), _r(arrays.total(F.col("u"))).alias("total"))


#: Knots of the day at uneven hours, with those at its ends as often as straight lines need it.
HOURS = (0.0, 6.0, 9.0, 18.0, 24.0)


def _times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.hour("ts") + F.minute("ts") / 60).alias("x"), "value")


def q_bspline_uneven(spark, sf_dir):
    """Sums of the columns of the design matrix on uneven knots, and of its derivative's."""
    knots, events = (0.0, *HOURS, 24.0), _times(spark, sf_dir)
    flat, steep = (splines.on_knots(events, "event_id", F.col("x"), knots, 1, d).groupBy("col").agg(_r(F.sum("val")).alias(n)) for d, n in ((0, "total"), (1, "slope")))
    return flat.join(steep, "col")


def q_spline_fit(spark, sf_dir):
    """The steps that are nearest to all values over the day."""
    found = smoothing.spline_fit(_times(spark, sf_dir), "event_id", "x", "value", HOURS, 0)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(found)], "step int, level double").withColumn("level", _r(F.col("level")))


def q_trajectories(spark, sf_dir):
    """Lengths of the fields and of their rates, by differences in time."""
    grid = spectral.points(event_snapshots(spark, sf_dir), ["u"], ["series", "j"])
    moved = spectral.rates(grid, ["series", "i"], 0.5)
    return moved.groupBy("series", "j").agg(_r(F.sqrt(F.sum(F.col("u") * F.col("u")))).alias("length"), _r(F.sqrt(F.sum(F.col("u_t") * F.col("u_t")))).alias("rate"))


def q_step_error(spark, sf_dir):
    """How far rates over doubled steps are from those over single ones, and whether that is settled."""
    grid = spectral.points(event_snapshots(spark, sf_dir), ["u"], ["series", "j"])
    return spectral.step_error(grid, ["series"], "i", 0.5).select("series", _r(F.col("error")).alias("error"), (F.col("error") < 0.5).alias("settled"))


def _products(spark, sf_dir):
    """All products of up to two scaled columns of a line item, with its ids and a normal number of its own."""
    columns = {k: F.col(k) for k in ("q", "p", "d", "t")}
    terms = discovery.products(columns)
    scaled = _scaled(spark, sf_dir)
    return scaled.withColumn("z", noise.gauss(F.col("l_orderkey"), F.col("l_linenumber"), seed=13)).withColumn("theta", F.array(*terms.values())), list(terms)


def q_exact_search(spark, sf_dir):
    """The best choice of each number of terms out of 15, for a noisy target of four: by branch and bound."""
    rows, names = _products(spark, sf_dir)
    y = F.col("q") + 2 * F.col("q") * F.col("p") - 1.5 * F.col("d") + 0.7 * F.col("t") * F.col("t") + 0.05 * F.col("z")
    found = search.frontier(spark, summary.summarize(rows.withColumn("y", y), names), 5)
    return spark.createDataFrame([(k, ", ".join(names[i] for i in sorted(support)), left) for k, support, left in found], "k int, terms string, residual double").withColumn("residual", _r(F.col("residual"), 3))


def q_capped_terms(spark, sf_dir):
    """Of 15 terms that all survive, the six that pursuit takes first, fitted again; the target is noisy."""
    rows, names = _products(spark, sf_dir)
    y = F.col("q") + 2 * F.col("q") * F.col("p") - 1.5 * F.col("d") + 0.7 * F.col("t") * F.col("t") + 0.05 * F.col("z")
    found = recovery.ccp(summary.summarize(rows.withColumn("y", y), names), cluster=len(names), threshold=0.0)
    return discovery.found_terms(spark, found).select("term", _r(F.col("coefficient")).alias("coefficient"))


def q_absolute_law(spark, sf_dir):
    """The charge of nine of ten items, found although the charges of the others are grossly wrong: by absolute residuals."""
    one = _scaled(spark, sf_dir).select(F.array(F.lit(1.0), "q", "p", "d", "t", F.col("p") * F.col("d")).alias("theta"), "q", "p", "d", sampling.mark(F.col("l_orderkey"), F.col("l_linenumber"), seed=17).alias("mark"))
    y = F.col("p") - 0.1 * F.col("p") * F.col("d") + F.when(F.col("mark") < 0.1, 5 + 3 * F.col("q")).otherwise(0.0)
    found = robust.best_subset(spark, one.select("theta", y.alias("y")), ("1", "q", "p", "d", "t", "p d"))
    return discovery.found_terms(spark, found).select("term", _r(F.col("coefficient"), 3).alias("coefficient"))


#: The laws that are looked for, and the terms among which.
WATCHED = ("kdv", "burgers", "allen_cahn", "ks", "fisher_kpp", "kdv_burgers", "fitzhugh_nagumo")
CHOICE = dictionary(3, 4, True, 2)


def law_recovery(spark, sf_dir, method: str = "nearest", level: float = 0.01, **how):
    """law, series, names, residual, score: rates of each law at the smooth fields of the events, measured with noise, and the terms found for each kind of event."""
    known = {name: laws()[name] for name in WATCHED}
    rows = discovery.law_rows(discovery.smooth_fields(spark, sf_dir), known, CHOICE, (1, 2, 3, 4), level, 11)
    found = sweeps.identify_groups(rows, ["series"], [t.name for t in CHOICE], method, targets=tuple(known), label="law", **how)
    true = F.create_map(*[F.lit(name) if i == 0 else F.array(*map(F.lit, named(law))) for name, law in known.items() for i in (0, 1)])
    return found.withColumn("score", metrics.jaccard(F.col("names"), true[F.col("law")]))


def q_law_recovery(spark, sf_dir):
    """score 1: exactly the law's terms, out of 16."""
    found = law_recovery(spark, sf_dir)
    return found.select("law", "series", F.array_join("names", ", ").alias("terms"), _r(F.col("residual"), 3).alias("residual"), _r(F.col("score"), 4).alias("score"))


def q_wide_terms(spark, sf_dir):
    """How long each of 196 terms is over all smooth fields, from one triangle; as powers of ten."""
    terms, orders = dictionary(6, 7, True, 7), tuple(range(1, 8))
    rows = discovery.field_points(discovery.smooth_fields(spark, sf_dir), terms, orders).withColumn("y", F.lit(0.0))
    s = summary.summarize(rows, [t.name for t in terms])
    return spark.createDataFrame([(n, float(x)) for n, x in zip(s.names, s.norms)], "term string, size double").withColumn("size", _r(F.log10("size"), 6))


#: The terms over two fields among which coupled laws are looked for.
PAIR = coupled.joint_terms(("u", "v"), 3, 2)


def q_coupled_laws(spark, sf_dir):
    """Both rates of the cubic wave equation at each two kinds of events' smooth fields, measured with noise, and the terms found for them."""
    wide = spectral.with_derivatives(discovery.smooth_fields(spark, sf_dir), (1, 2))
    grid = spectral.points(wide, ["u", "d1", "d2"], ["series", "j"])
    one = grid.select(F.col("series").alias("first"), "j", "i", "u", F.col("d1").alias("d1_u"), F.col("d2").alias("d2_u"))
    two = grid.select(F.col("series").alias("second"), "j", "i", F.col("u").alias("v"), F.col("d1").alias("d1_v"), F.col("d2").alias("d2_v"))
    both = one.join(two, ["j", "i"]).filter(F.col("first") < F.col("second")).withColumn("pair", F.concat_ws("-", "first", "second"))
    law = coupled.waves()
    drawn = lambda name: noise.gauss(F.lit(name), F.col("pair"), F.col("j"), F.col("i"), seed=19)
    rows = coupled.joint_theta(both, PAIR).select("pair", "theta", *[(coupled.rate_of(law[f]) * (1 + 0.01 * drawn(f))).alias(f"{f}_t") for f in ("u", "v")])
    found = sweeps.identify_groups(rows, ["pair"], [t.name for t in PAIR], "nearest", targets=("u_t", "v_t"), label="rate")
    return found.select("pair", "rate", F.array_join("names", ", ").alias("terms"), _r(F.col("residual"), 3).alias("residual"))


def q_sparse_spline(spark, sf_dir):
    """The piecewise linear curve over the day that is nearest to all values: a sparse matrix and products with it."""
    events = _times(spark, sf_dir)
    entries = splines.design(events, "event_id", F.col("x") / 24, 8, 1)
    found = sparse.spline_solve(events, entries, "event_id", "value")
    return found.select("col", _r(F.col("x")).alias("level"))


def q_surface(spark, sf_dir):
    """The piecewise bilinear surface that is nearest to the numbers of events by hour and by value."""
    e = table(spark, sf_dir, "events").select(F.hour("ts").alias("i"), F.least(F.floor(F.col("value") / 25), F.lit(11)).cast("int").alias("j"))
    core = e.groupBy("i", "j").agg(F.count("*").cast("double").alias("val"))
    found = sparse.tensor_fit(core, smoothing.design_matrix(spark, 24, 4, 1), smoothing.design_matrix(spark, 12, 3, 1))
    return found.select("k", "l", _r(F.col("c")).alias("level"))


def q_long_derivative(spark, sf_dir):
    """The derivative of each kind's whole history, taken as one field whose blocks are the snapshots."""
    s = event_snapshots(spark, sf_dir)
    first = s.groupBy("series").agg(F.min("j").alias("first"), (F.max("j") - F.min("j") + 1).alias("n"))
    blocks = s.join(first, "series").select("series", (F.col("j") - F.col("first")).alias("block"), "n", "u")
    found = spectral.long_derivative(blocks.select("series", "block", "u"), ["series"], "block", 1)
    scaled = spectral.points(found, ["u"], ["series", "block"]).join(first, "series")
    return scaled.select("series", "block", "i", _unsigned_zero(_r(F.col("u") / (N * F.col("n")))).alias("slope"))


def q_isolated_sweep(spark, sf_dir):
    """The mean balance of each nation's customers; a nation with few of them is an error of its own."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.array(F.lit(1.0)).alias("theta"), F.col("c_acctbal").cast("double").alias("y"))

    def mean(s):
        if s.n < 60:
            raise ValueError(f"{s.n} customers")
        return (float(s.fit([0])[0][0]),)

    found = sweeps.of_groups(rows, ["c_nationkey"], ["1"], mean, "mean double", isolated=True)
    return found.select("c_nationkey", _r(F.col("mean"), 2).alias("mean"), "error")


def q_method_recovery(spark, sf_dir):
    """By law, size of the dictionary and method: in how many of the events' kinds exactly the law's terms were found, with 1 % noise, and how far coefficients are off."""
    known = {name: laws()[name] for name in WATCHED}
    fields, out = discovery.smooth_fields(spark, sf_dir), None
    for size, terms in (("S", dictionary(2, 3, True, 2)), ("M", dictionary(2, 4, True, 3))):
        names = [t.name for t in terms]
        rows = discovery.law_rows(fields, known, terms, (1, 2, 3, 4), 0.01, 23)

        def every(s):
            return ([(m, list(r.names), list(r.coefficients)) for m, how in (("ccp", {}), ("omp", {"k": 3, "threshold": 0.01}), ("lasso", {"alpha": 0.01})) for r in [recovery.identify(s, m, **how)]],)

        found = sweeps.of_groups(rows, ["series"], names, every, "found array<struct<method:string,names:array<string>,coefficients:array<double>>>", targets=tuple(known), label="law")
        one = found.select(F.lit(size).alias("size"), "law", "series", F.explode("found").alias("f")).select("size", "law", "series", "f.*")
        out = one if out is None else out.unionByName(one)
    truth = spark.createDataFrame([(n, named(law), [float(c) for c in law.values()]) for n, law in known.items()], "law string, true array<string>, values array<double>")
    both = out.join(F.broadcast(truth), "law")  # a row a law
    right = metrics.jaccard(F.col("names"), F.col("true")) == 1.0
    got = F.map_from_arrays("names", "coefficients")
    off = F.array_max(F.transform(F.arrays_zip("true", "values"), lambda x: F.abs(F.coalesce(F.try_element_at(got, x["true"]), F.lit(0.0)) / x["values"] - 1)))
    return both.groupBy("law", "size", "method").agg(F.count_if(right).alias("recovered"), F.count("*").alias("series"), _r(F.avg(F.when(right, off))).alias("error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q_")}


