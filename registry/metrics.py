"""Queries over metrics, curves, deltas and rankings."""

from pyspark.sql import functions as F

from mlframes.functions import arrays
from mlframes.operators import curves, deltas, metrics, stats
from mlframes.plans.ranks import with_share
from registry.base import cte, fixture, query, rd, rounded, table

COSTS = [[0.0, -2.0], [-1.0, 5.0]]


def _confusion_sql(pred: str, share: str | None, body: str = "select truth, pred as predicted from classes") -> str:
    div = {"recall": "truth", "precision": "predicted"}.get(share)
    col = "" if div is None else f", {rd(f'n * 1.0::double / nullif(sum(n) over (partition by {div}), 0)')} as share"
    return f"""{cte('classes')}, pairs as (select truth, {pred} as predicted, count(*) as n from classes group by 1,2),
    names as (select truth as c from pairs union select predicted from pairs),
    full_m as (select a.c as truth, b.c as predicted, coalesce(p.n,0)::bigint as n from names a cross join names b
      left join pairs p on p.truth=a.c and p.predicted=b.c)
    select truth, predicted, n{col} from full_m"""


@query("a02_confusion_matrix", _confusion_sql("pred2", "recall"))
def a02(spark, sf):
    return rounded(metrics.confusion_matrix(fixture(spark, sf, "classes"), "truth", "pred2", "recall"))


@query("a02_confusion_precision", _confusion_sql("pred", "precision"))
def a02p(spark, sf):
    return rounded(metrics.confusion_matrix(fixture(spark, sf, "classes"), "truth", "pred", "precision"))


@query("a03_binary_matrix", f"""{cte('scored')} select count(*) filter (y=0 and p<=0.5) as tn,
    count(*) filter (y=0 and p>0.5) as fp, count(*) filter (y=1 and p<=0.5) as fn, count(*) filter (y=1 and p>0.5) as tp
    from scored""")
def a03(spark, sf):
    df = fixture(spark, sf, "scored").withColumn("hard", (F.col("p") > 0.5).cast("int"))
    return metrics.binary_matrix(df, "y", "hard")


def _scores_sql(source: str, keys: str = "") -> str:
    """Per-class scores from (keys, truth, predicted) rows."""
    k = keys + ", " if keys else ""
    on = " and ".join(f"a.{x.strip()}=b.{x.strip()}" for x in keys.split(",") if x.strip())
    on = f" and {on}" if on else ""
    return f"""pairs as ({source}),
    names as (select {k}truth as class from pairs union select {k}predicted from pairs),
    scores as (select {', '.join('a.' + x.strip() for x in keys.split(',')) + ',' if keys else ''} a.class,
      count(*) filter (b.truth=a.class) as support, count(*) filter (b.predicted=a.class) as shown,
      count(*) filter (b.truth=a.class and b.predicted=a.class) as hit
      from names a join pairs b on (b.truth=a.class or b.predicted=a.class){on}
      group by all),
    rated as (select *, coalesce(hit::double/nullif(support,0),0) as recall, coalesce(hit::double/nullif(shown,0),0) as "precision",
      coalesce(2.0::double*hit/nullif(support+shown,0),0) as f1 from scores)"""


@query("a04_class_report", f"""{cte('classes')}, {_scores_sql('select truth, pred2 as predicted from classes')}
    select class, {rd('"precision"')} as "precision", {rd('recall')} as recall, {rd('f1')} as f1, support::bigint as support from rated
    union all select 'avg / total', {rd('sum("precision"*support)/sum(support)')}, {rd('sum(recall*support)/sum(support)')},
      {rd('sum(f1*support)/sum(support)')}, sum(support)::bigint from rated""")
def a04(spark, sf):
    return rounded(metrics.class_report(fixture(spark, sf, "classes"), "truth", "pred2"))


@query("a05_roc_curve", f"""{cte('scored')}, r as (select i, i * 0.01::double as threshold,
      count(*) filter (p >= i * 0.01::double and y = 1)::double / count(*) filter (y = 1) as tpr,
      count(*) filter (p >= i * 0.01::double and y = 0)::double / count(*) filter (y = 0) as fpr
      from scored, range(101) t(i) group by i)
    select {rd('threshold')} as threshold, {rd('tpr')} as tpr, {rd('fpr')} as fpr from r""")
def a05(spark, sf):
    return rounded(curves.roc_curve(fixture(spark, sf, "scored"), "y", "p"))


_PROFIT = """select {by}i, i * 0.01::double as threshold,
      (count(*) filter (p <= i * 0.01::double and y = 0) * 0.0::double
       + count(*) filter (p > i * 0.01::double and y = 0) * -2.0::double
       + count(*) filter (p <= i * 0.01::double and y = 1) * -1.0::double
       + count(*) filter (p > i * 0.01::double and y = 1) * 5.0::double) / count(*) as profit
      from {source}, range(101) t(i) group by {by}i"""


@query("a06_profit_curve", f"""{cte('scored')}, c as ({_PROFIT.format(by='', source='scored')})
    select {rd('threshold')} as threshold, {rd('profit')} as profit from c""")
def a06(spark, sf):
    return rounded(curves.profit_curve(fixture(spark, sf, "scored"), "y", "p", COSTS))


@query("o05_best_threshold", f"""{cte('scored')}, c as ({_PROFIT.format(by='', source='scored')})
    select {rd('threshold')} as threshold, {rd('profit')} as profit from c order by c.profit desc, c.threshold limit 1""")
def o05(spark, sf):
    curve = curves.profit_curve(fixture(spark, sf, "scored"), "y", "p", COSTS)
    return rounded(curves.best_threshold(curve))


_AUC = """select {by}round(sum(pos*(before + neg/2.0::double))/(sum(pos)*sum(neg)::double),3) as auc,
      round((sum(pos) filter (s>=0.5)/sum(pos)::double + 1 - sum(neg) filter (s>=0.5)/sum(neg)::double)/2,3) as auc_hard
      from (select *, coalesce(sum(neg) over (partition by m order by s rows between unbounded preceding and 1 preceding),0) as before
        from (select {m} as m, p as s, count(*) filter (y=1) as pos, count(*) filter (y<>1) as neg from {source} group by 1,2)) {group}"""


@query("a07_auc", f"""{cte('scored')} {_AUC.format(by='', m='1', source='scored', group='')}""")
def a07(spark, sf):
    return curves.auc(fixture(spark, sf, "scored"), "y", "p")


@query("a08_recall_precision", f"""{cte('classes')},
    {_scores_sql("select truth, pred2 as predicted from classes where pred2 in (select truth from classes)")}
    select class, {rd('recall')} as recall, {rd('"precision"')} as "precision", support::bigint as support
    from rated where support>0""")
def a08(spark, sf):
    return rounded(metrics.recall_precision(fixture(spark, sf, "classes"), "truth", "pred2"))


_REG = """select split, avg(abs(y-yhat)) as mae, sqrt(avg((y-yhat)*(y-yhat))) as rmse,
    avg(abs((y-yhat)/nullif(y,0)))*100 as mape, 1-var_pop(y-yhat)/var_pop(y) as explained_variance from regression group by 1"""


@query("a10_regression_metrics", f"""{cte('regression')}, w as ({_REG})
    select split as "set", metric, {rd('value')} as value from (unpivot w on mae, rmse, mape, explained_variance into name metric value value)""")
def a10(spark, sf):
    return rounded(metrics.regression_metrics(fixture(spark, sf, "regression"), "y", "yhat"))


@query("a11_mape", f"""{cte('regression')} select {rd('avg(abs((y-yhat)/nullif(y,0)))*100')} as mape,
    count(*) filter (y=0) as n_zero from regression""")
def a11(spark, sf):
    return rounded(metrics.mape(fixture(spark, sf, "regression"), "y", "yhat"))


@query("a12_classification_metrics", f"""{cte('classes')},
    {_scores_sql('select split, truth, pred2 as predicted from classes', 'split')},
    w as (select split, sum("precision"*support)/sum(support) as "precision", sum(recall*support)/sum(support) as recall,
      sum(f1*support)/sum(support) as f1, sum(hit)::double/sum(support) as accuracy from rated group by 1)
    select split as "set", metric, {rd('value')} as value
    from (unpivot w on "precision", recall, f1, accuracy into name metric value value)""")
def a12(spark, sf):
    return rounded(metrics.classification_metrics(fixture(spark, sf, "classes"), "truth", "pred2"))


@query("a13_fuzzy_accuracy", f"""{cte('regression')} select
    {rd('avg(case when yhat>y-std and yhat<y+std then 1.0::double else 0.0::double end)')} as accuracy from regression""")
def a13(spark, sf):
    return rounded(metrics.fuzzy_accuracy(fixture(spark, sf, "regression"), "y", "yhat", "std"))


@query("x01_fuzzy_bands", f"""{cte('regression')}, b as (select *, yhat>y-std and yhat<y+std as w1,
      yhat>(y-std)*2 and yhat<(y+std)*2 as w2 from regression)
    select split, case when w1 then 0 when w2 then 1 else 2 end as which_std, count(*) as n from b group by 1,2""")
def x01(spark, sf):
    bands = metrics.fuzzy_bands(fixture(spark, sf, "regression"), "y", "yhat", "std")
    return bands.groupBy("split", "which_std").agg(F.count("*").alias("n"))


def ranking_lists(spark, sf):
    """(user_id, predicted, actual): types of half 1 by falling count; types of half 2 above the user's mean."""
    n = fixture(spark, sf, "rank_events")
    # five event types at most per user and half
    first = n.where("half = 1").groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))),
                    lambda s: s["event_type"]).alias("predicted"))
    second = n.where("half = 2").groupBy("user_id").agg(
        F.collect_list(F.struct("event_type", "n")).alias("h"), F.avg("n").alias("mean"))
    second = second.select("user_id", F.transform(F.filter("h", lambda s: s["n"] > F.col("mean")),
                                                  lambda s: s["event_type"]).alias("actual"))
    empty = F.array().cast("array<string>")
    return first.join(second, "user_id", "full_outer").select(
        "user_id", F.coalesce("predicted", empty).alias("predicted"), F.coalesce("actual", empty).alias("actual"))


_APK = f"""{cte('rank_events')}, users as (select distinct user_id from rank_events),
    pred as (select user_id, event_type, row_number() over (partition by user_id order by n desc, event_type) as i
      from rank_events where half=1),
    act as (select user_id, event_type from (select *, avg(n) over (partition by user_id) as m from rank_events where half=2)
      where n>m),
    hits as (select p.user_id, p.i, row_number() over (partition by p.user_id order by p.i) as h from pred p
      join act a on a.user_id=p.user_id and a.event_type=p.event_type where p.i<=3),
    per as (select u.user_id, coalesce((select sum(h.h::double/h.i) from hits h where h.user_id=u.user_id),0)
      / least(greatest((select count(*) from act a where a.user_id=u.user_id),1),3) as apk from users u)"""


@query("f06_average_precision", f"{_APK} select user_id, {rd('apk')} as apk from per")
def f06(spark, sf):
    lists = ranking_lists(spark, sf)
    return rounded(lists.select("user_id", arrays.average_precision("actual", "predicted", 3).alias("apk")))


@query("a14_map_at_k", f"{_APK} select {rd('avg(apk)')} as map_at_k from per")
def a14(spark, sf):
    return rounded(metrics.mean_average_precision(ranking_lists(spark, sf), "actual", "predicted", 3))


@query("a16_shared_histogram", f"""{cte('regression')},
    v as (select 'a' as s, y/20 as x from regression union all select 'p', yhat/20 from regression),
    b as (select s, least(floor(x*30/9000.0::double),29)::int as bin from v where x between 0 and 9000)
    select t.i::int as bin, {rd('t.i*300.0::double')} as from_edge, {rd('(t.i+1)*300.0::double')} as to_edge,
      count(*) filter (s='a') as n_actual, count(*) filter (s='p') as n_predicted
    from range(30) t(i) left join b on b.bin=t.i group by t.i""")
def a16(spark, sf):
    df = fixture(spark, sf, "regression").select((F.col("y") / 20).alias("actual"), (F.col("yhat") / 20).alias("predicted"))
    return rounded(stats.shared_histogram(df, ["actual", "predicted"], 31))


@query("a17_histogram_2d", f"""{cte('scored')}, e as (select min(p) a, max(p) b, min(p2) c, max(p2) d from scored),
    b as (select least(floor((p-a)*10/(b-a)),9)::int as bx, least(floor((p2-c)*10/(d-c)),9)::int as "by" from scored, e)
    select x.i::int as bx, z.i::int as "by", count(b.bx) as n from range(10) x(i) cross join range(10) z(i)
    left join b on b.bx=x.i and b."by"=z.i group by 1,2""")
def a17(spark, sf):
    return stats.histogram2d(fixture(spark, sf, "scored"), "p", "p2")


_SHARES = """(select label as category, count(*)::double / (select count(*) from regression where split='{s}') as s
    from regression where split='{s}' group by 1)"""


@query("a18_category_shares", f"""{cte('regression')} select category, {rd('a.s')} as share_first, {rd('b.s')} as share_second
    from {_SHARES.format(s='Train')} a full join {_SHARES.format(s='Test')} b using (category)""")
def a18(spark, sf):
    return rounded(stats.category_shares(fixture(spark, sf, "regression"), "label"))


@query("j09_compare_shares", f"""{cte('regression')} select category, {rd('a.s')} as share_first, {rd('b.s')} as share_second
    from {_SHARES.format(s='Train')} a full join {_SHARES.format(s='Validation')} b using (category)""")
def j09(spark, sf):
    df = fixture(spark, sf, "regression")
    return rounded(stats.compare_category_shares(df.where("split = 'Train'"), df.where("split = 'Validation'"), "label"))


@query("a23_accuracy_table", f"""{cte('classes')} select 'first' as "Classifier", {rd('avg((truth=pred)::int)')} as "Test Accuracies"
    from classes union all select 'second', {rd('avg((truth=pred2)::int)')} from classes""")
def a23(spark, sf):
    return rounded(metrics.accuracy_table(fixture(spark, sf, "classes"), "truth", {"first": "pred", "second": "pred2"}))


@query("a26_class_codes", f"""{cte('classes')} select pred2 as class, (dense_rank() over (order by pred2) - 1)::bigint as code
    from (select distinct pred2 from classes)""")
def a26(spark, sf):
    return metrics.class_codes(fixture(spark, sf, "classes"), "pred2")


@query("w04_share_of_total", f"""select o_custkey, count(*) as n, {rd('count(*)::double / sum(count(*)) over ()', 9)} as share
    from orders group by 1""")
def w04(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rounded(with_share(counts, "n", "share"), 9)


def _delta_sql(rows: str) -> str:
    return f"""{cte('classes')}, pairs as ({rows}), counts as (select m, truth, predicted, count(*) as n from pairs group by 1,2,3),
    names as (select truth as c from counts union select predicted from counts), models as (select unnest([1,2]) as m),
    full_m as (select k.m, a.c as truth, b.c as predicted, coalesce(p.n,0) as n from models k cross join names a cross join names b
      left join counts p on p.m=k.m and p.truth=a.c and p.predicted=b.c),
    shares as (select *, n::double/nullif(sum(n) over (partition by m, truth),0) as s from full_m)
    select truth, predicted, {rd('coalesce(max(s) filter (m=2),0)-coalesce(max(s) filter (m=1),0)')} as delta
    from shares group by 1,2"""


@query("w07_delta_matrix", _delta_sql("""select 1 as m, truth, pred as predicted from classes
    union all select 2, truth, case when pred2='X' then 'P' else pred2 end from classes"""))
def w07(spark, sf):
    return rounded(deltas.delta_matrix(fixture(spark, sf, "classes"), "truth", "pred", "pred2", unknown_to="P"))


@query("w08_delta_matrix_known", _delta_sql("""select 1 as m, truth, pred as predicted from classes
    union all select 2, truth, pred2 from classes where pred2<>'X'"""))
def w08(spark, sf):
    return rounded(deltas.delta_matrix(fixture(spark, sf, "classes"), "truth", "pred", "pred2", unknown="drop"))


@query("w09_delta_recall_precision", f"""{cte('classes')},
    {_scores_sql('''select 1 as m, truth, pred as predicted from classes
      union all select 2, truth, pred2 from classes where pred2<>'X' ''', 'm')},
    p as (select class, max(recall) filter (m=1) r1, max(recall) filter (m=2) r2, max("precision") filter (m=1) p1,
      max("precision") filter (m=2) p2 from rated where support>0 group by 1)
    select class, {rd('r2-r1')} as delta_recall, {rd('p2-p1')} as delta_precision, {rd('r1')} as recall_1, {rd('r2')} as recall_2 from p""")
def w09(spark, sf):
    return rounded(deltas.delta_recall_precision(fixture(spark, sf, "classes"), "truth", "pred", "pred2"))


@query("o01_top_n_classes", f"""{cte('probs')}, l as (select k, unnest([0,1,2]) as i,
      unnest([round(w0/(w0+w1+w2),9), round(w1/(w0+w1+w2),9), round(w2/(w0+w1+w2),9)]) as p from probs),
    r as (select k, i, row_number() over (partition by k order by p desc, i desc) as n from l)
    select k, max(i) filter (n=1) as first, max(i) filter (n=2) as second, max(['low','mid','high'][i+1]) filter (n=1) as name
    from r group by 1""")
def o01(spark, sf):
    total = F.col("w0") + F.col("w1") + F.col("w2")
    df = fixture(spark, sf, "probs").withColumn("probs", F.array(*[F.round(F.col(c) / total, 9) for c in ("w0", "w1", "w2")]))
    df = df.withColumn("top", arrays.top_n_classes("probs", 2))
    return df.select("k", F.get("top", F.lit(0)).alias("first"), F.get("top", F.lit(1)).alias("second"),
                     F.get(arrays.class_names("top", ["low", "mid", "high"]), F.lit(0)).alias("name"))


@query("f07_argmax_column", f"""{cte('probs')} select k, case when w0>=w1 and w0>=w2 then 'w0' when w1>=w2 then 'w1' else 'w2' end as label
    from probs""")
def f07(spark, sf):
    return fixture(spark, sf, "probs").select("k", arrays.argmax_column(["w0", "w1", "w2"]).alias("label"))


@query("j08_actual_std_predicted", f"""{cte('regression')} select k, {rd('y')} as y, {rd('std')} as std, {rd('yhat')} as yhat from regression""")
def j08(spark, sf):
    df = fixture(spark, sf, "regression")
    return rounded(metrics.actual_std_predicted(df.select("k", "y", "std"), df.select("k", "yhat"), "k"))


@query("m13_model_curves", f"""{cte('scored')}, long as (select 'discount' as model, y, p from scored
      union all select 'quantity', y, p2 from scored),
    r as (select model, i, i * 0.01::double as threshold,
      count(*) filter (p >= i * 0.01::double and y = 1)::double / count(*) filter (y = 1) as tpr,
      count(*) filter (p >= i * 0.01::double and y = 0)::double / count(*) filter (y = 0) as fpr
      from long, range(101) t(i) group by model, i),
    c as ({_PROFIT.format(by='model, ', source='long')})
    select model, {rd('r.threshold')} as threshold, {rd('tpr')} as tpr, {rd('fpr')} as fpr, {rd('profit')} as profit
    from r join c using (model, i)""")
def m13(spark, sf):
    long = curves.model_scores(fixture(spark, sf, "scored"), "y", {"discount": "p", "quantity": "p2"})
    roc = curves.roc_curve(long, "label", "score", ["model"])
    profit = curves.profit_curve(long, "label", "score", COSTS, ["model"])
    return rounded(roc.join(profit, ["model", "threshold"]))


@query("m13_model_auc", f"""{cte('scored')}, long as (select 'discount' as model, y, p from scored
      union all select 'quantity', y, p2 from scored)
    {_AUC.format(by='m as model, ', m='model', source='long', group='group by m')}""")
def m13_auc(spark, sf):
    long = curves.model_scores(fixture(spark, sf, "scored"), "y", {"discount": "p", "quantity": "p2"})
    return curves.auc(long, "label", "score", ["model"])
