"""Models and recommenders over whole tables."""

from functools import reduce

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Window, functions as F

from sparkloom.functions.text import words
from sparkloom.operators import models as mdl
from sparkloom.operators.features import assemble_xy, label_encode
from sparkloom.operators.metrics import macro_auroc, regression_metrics
from sparkloom.operators.sampling import block_kfold, random_split, user_holdout
from sparkloom.plans.joins import RATINGS, ratings
from sparkloom.plans.registry import query, rnd, rnd_sql, table
from sparkloom.runtime import cut_lineage, scratch_path

X = ["l_quantity", "l_discount", "l_tax"]
Y = "l_extendedprice"
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE, *X, Y, "l_returnflag")


def split_lines(spark, sf):
    both = random_split(lines(spark, sf), {"train": 0.7, "test": 0.3}, LINE, 7)
    return both.filter("split = 'train'").drop("split"), both.filter("split = 'test'").drop("split")


def against_mean(pred):
    """Rows scored, the error of always saying their mean, and whether the model's error is below it."""
    error = F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))
    return pred.agg(F.count("*").alias("n"), rnd(F.stddev_pop("label"), 3).alias("mean_error"), (error < F.stddev_pop("label")).alias("better"))


def against_majority(pred):
    """Rows of every class, and whether more rows are told right than are in the largest class."""
    counts = pred.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("int")).alias("hit"))
    every = Window.partitionBy(F.lit(0))  # over the classes
    return counts.select(F.col("label").cast("int").alias("label"), "n", (F.sum("hit").over(every) > F.max("n").over(every)).alias("better"))


def mean_sql(y, source):
    return f"select count(*) as n, {rnd_sql(f'stddev_pop({y})', 3)} as mean_error, stddev_pop({y}) > 0 as better from {source}"


def majority_sql(y, source):
    """A model that learnt something is better wherever there is more than one class."""
    return f"select label, n, count(*) over () > 1 as better from (select ({y})::int as label, count(*) as n from {source} group by 1)"


LINE_TEST = """(select * from lineitem where ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 7)), 1, 8))::bigint
  / 4294967296.0::double >= 0.7)"""


NET, NET_X = "net_price", ["l_extendedprice", "l_discount", "l_tax"]


def net_lines(spark, sf):
    train, test = split_lines(spark, sf)
    return [d.withColumn(NET, F.col(Y) * (1 - F.col("l_discount"))) for d in (train, test)]


def scored(model, test, features=NET_X, target=NET):
    return against_mean(model.transform(assemble_xy(test, features, target)))


def embeddings_xy(spark, sf):
    from pyspark.ml.functions import array_to_vector
    df = table(spark, sf, "embeddings")
    return df.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                     F.col("label").cast("double").alias("label"))


def report(model, xy):
    return against_majority(mdl.predict_classes(model, xy))


@query("L01_elastic_net", mean_sql("l_extendedprice * (1 - l_discount)", LINE_TEST))
def l01(spark, sf):
    train, test = net_lines(spark, sf)
    return scored(mdl.fit_elastic_net(train, NET_X, NET, alpha=0.5, l1_ratio=0.5), test)


@query("L02_ols", f"""select {rnd_sql('regr_intercept(l_extendedprice, l_quantity)', 2)} as intercept,
  {rnd_sql('regr_slope(l_extendedprice, l_quantity)', 4)} as slope, {rnd_sql('regr_r2(l_extendedprice, l_quantity)', 5)} as r2 from lineitem""")
def l02(spark, sf):
    m = mdl.fit_ols(lines(spark, sf), ["l_quantity"], Y)
    one = spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]), float(m.summary.r2))], "intercept double, slope double, r2 double")
    return one.select(rnd("intercept", 2).alias("intercept"), rnd("slope", 4).alias("slope"), rnd("r2", 5).alias("r2"))


@query("L03_rf_regressor", mean_sql("l_extendedprice * (1 - l_discount)", LINE_TEST))
def l03(spark, sf):
    train, test = net_lines(spark, sf)
    return scored(mdl.fit_rf_regressor(train, NET_X, NET, trees=100, depth=8), test)


def _search(spark, sf):
    rf = RandomForestRegressor(seed=7)
    space = {rf.numTrees: [4, 8, 12], rf.maxDepth: [3, 5], rf.minInstancesPerNode: [1, 5, 10]}
    xy = assemble_xy(lines(spark, sf), X, Y, LINE)
    return mdl.random_search(rf, space, RegressionEvaluator(metricName="mse"), xy, LINE, n_iter=10, folds=5)


@query("L04_random_search")
def l04(spark, sf):
    return _search(spark, sf)[1]


@query("L05_feature_importance")
def l05(spark, sf):
    return mdl.feature_importance(lines(spark, sf), X, Y, top=7, trees=20)


@query("L06_rf_classifier", majority_sql("label", "embeddings"))
def l06(spark, sf):
    xy = embeddings_xy(spark, sf)
    return report(mdl.fit_rf_classifier(xy, trees=60, depth=8), xy)


@query("L07_boosted_trees", majority_sql("floor((l_quantity - 1) / 10)", "lineitem"))
def l07(spark, sf):
    df = lines(spark, sf).withColumn("size_class", F.floor((F.col("l_quantity") - 1) / 10).cast("double"))
    xy = assemble_xy(df, X + [Y], "size_class")
    return report(mdl.fit_boosted_trees(xy, 5, depth=2, rounds=10), xy)


NB = """
with c as (select l_returnflag, sum(l_quantity) as q, sum(l_discount) as d, sum(l_tax) as t, count(*) as n from lineitem group by 1),
 z as (select *, q + d + t + 3 as total, (select count(*) from lineitem) as rows, dense_rank() over (order by l_returnflag) - 1 as class from c)"""


@query("L08_naive_bayes", f"""{NB}
select class::int as class, {rnd_sql('ln((n + 1) / (rows + 3))', 5)} as log_prior, {rnd_sql('ln((q + 1) / total)', 5)} as quantity,
  {rnd_sql('ln((d + 1) / total)', 5)} as discount, {rnd_sql('ln((t + 1) / total)', 5)} as tax from z""")
def l08(spark, sf):
    coded, _ = label_encode(lines(spark, sf), ["l_returnflag"])
    m = mdl.fit_naive_bayes(assemble_xy(coded, X, "l_returnflag"))
    rows = [(i, float(m.pi[i]), *[float(v) for v in m.theta.toArray()[i]]) for i in range(3)]
    df = spark.createDataFrame(rows, "class int, log_prior double, quantity double, discount double, tax double")
    return df.select("class", *[rnd(c, 5).alias(c) for c in ("log_prior", "quantity", "discount", "tax")])


@query("L09_mlp", majority_sql("label", "embeddings"))
def l09(spark, sf):
    xy = embeddings_xy(spark, sf)
    return report(mdl.fit_mlp(xy, [64, 10, 10], 100), xy)


@query("L10_text_classifier", majority_sql("quality", "(select quality from documents join labels using (doc_id))"))
def l10(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", words("text").alias("tokens")).join(
        table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("target")), "doc_id")
    both = random_split(df, {"train": 0.8, "test": 0.2}, "doc_id", 3)
    model = mdl.fit_text_classifier(both.filter("split = 'train'"), "tokens", "target")
    return against_majority(model.transform(both))


@query("L11_mixed_regressor", mean_sql("p_retailprice", "part"))
def l11(spark, sf):
    model, xy = mdl.fit_mixed_regressor(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_size"], "p_retailprice", rounds=20, depth=5)
    return against_mean(model.transform(xy))


@query("L12_multilabel", """
select flag, count(*) filter (is_on) as rows_on, count(*) as n, count(*) filter (is_on) between 1 and count(*) - 1 as better
from (select unnest(['label_low', 'label_even', 'label_zero']) as flag, unnest([label < 5, label % 2 = 0, label = 0]) as is_on from embeddings) group by 1""")
def l12(spark, sf):
    flags = {"label_low": F.col("label") < 5, "label_even": F.col("label") % 2 == 0, "label_zero": F.col("label") == 0}
    df = embeddings_xy(spark, sf).withColumns({k: v.cast("double") for k, v in flags.items()})
    out = mdl.predict_multilabel(df.select("vec_id", "features", *flags), mdl.fit_multilabel(df, "features", list(flags)))
    seen = F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("y"), F.col(f"pred_{k}").alias("p")) for k in flags])
    on = F.sum(F.col("y").cast("int"))
    hit = F.sum((F.col("y") == F.col("p")).cast("int"))
    return out.select(F.inline(seen)).groupBy("flag").agg(on.alias("rows_on"), F.count("*").alias("n"), (hit > F.greatest(on, F.count("*") - on)).alias("better"))


@query("L13_save_load", "select count(*) as n, count(*)::bigint as equal from embeddings")
def l13(spark, sf):
    xy = embeddings_xy(spark, sf)
    path = scratch_path(spark, "model")
    first = mdl.load_or_fit(path, LogisticRegressionModel.load, lambda: mdl.fit_logistic(xy))
    again = mdl.load_or_fit(path, LogisticRegressionModel.load, lambda: mdl.fit_logistic(xy))
    a = first.transform(xy).select("vec_id", F.col("prediction").alias("fitted"))
    return a.join(again.transform(xy).select("vec_id", F.col("prediction").alias("loaded")), "vec_id") \
        .agg(F.count("*").alias("n"), F.sum((F.col("fitted") == F.col("loaded")).cast("int")).alias("equal"))


@query("L14_best_of")
def l14(spark, sf):
    return mdl.best_of(_search(spark, sf)[1], "metric", "min")


# ---- recommenders -----------------------------------------------------------

@query("C01_training_table", f"""
select l_orderkey, l_linenumber, movie_id, rating - 1 as rating_class,
  'My age is ' || c_nationkey || ' . My gender is ' || case when c_mktsegment = 'MACHINERY' then 'Male' else 'Female' end || ' . My occupation is ' || c_mktsegment as user_text,
  'The movie title is ' || p_name || ' . The genre of the movie is ' || concat_ws(', ', case when p_type = 'ECONOMY' then 'economy' end,
    case when p_size > 25 then 'large' end, case when p_retailprice > 1000 then 'dear' end) || ' . I have given the movie-rating to ' || (rating - 1) as item_text
from {RATINGS} join customer on user_id = c_custkey join part on movie_id = p_partkey""")
def c01(spark, sf):
    from sparkloom.operators import relational as rel
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("age"),
                                                F.when(F.col("c_mktsegment") == "MACHINERY", "M").otherwise("F").alias("gender"),
                                                F.col("c_mktsegment").alias("occupation"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"),
                                            (F.col("p_type") == "ECONOMY").cast("int").alias("economy"),
                                            (F.col("p_size") > 25).cast("int").alias("large"),
                                            (F.col("p_retailprice") > 1000).cast("int").alias("dear"))
    star = rel.rating_user_item(ratings(spark, sf), users, items).withColumn("genres", rel.active_flags(["economy", "large", "dear"]))
    out = rel.build_prompts(star, "age", "gender", "occupation", "title", "genres", "rating")
    return out.select("l_orderkey", "l_linenumber", "movie_id", "rating_class", "user_text", "item_text")


@query("C02_als", mean_sql("rating", RATINGS))
def c02(spark, sf):
    r = ratings(spark, sf)
    return against_mean(mdl.predict_ratings(mdl.fit_als(r), r).withColumn("label", F.col("rating").cast("double")))


@query("C03_recommend")
def c03(spark, sf):
    return mdl.recommend(mdl.fit_als(ratings(spark, sf)), 10)


@query("C04_evaluate")
def c04(spark, sf):
    order = ["l_orderkey", "l_linenumber", "movie_id", "rating"]
    r = cut_lineage(ratings(spark, sf))
    blocks = cut_lineage(block_kfold(r, order, 5))
    held = cut_lineage(user_holdout(r, "user_id", order, 1, 10))
    out = []
    for name, base, test in (("block", blocks.filter("fold != 1"), blocks.filter("fold = 1")),
                             ("holdout", held.filter("split = 'base'"), held.filter("split = 'test'"))):
        pred = cut_lineage(mdl.predict_ratings(mdl.fit_als(base), test))
        near = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda c: -F.abs(F.col("prediction") - c).cast("double"))
        auc = macro_auroc(pred.select((F.col("rating") - 1).alias("y"), near.alias("s")), "s", "y")
        err = regression_metrics(pred, "rating", "prediction")
        named = F.array(*[F.struct(F.lit(name).alias("split"), F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "mae")])
        out += [err.select(F.inline(named)), auc.select(F.lit(name), F.lit("auroc"), "auroc")]
    return reduce(lambda a, b: a.unionAll(b), out)
