"""Evaluation queries. Scores are embeddings' author scores; a positive is a pair whose ids agree modulo ten."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import embedding
from kinfold.operators import evaluation as E
from kinfold.operators import sampling as S
from kinfold.plans.arithmetic import DIGITS, permuted, scrambled
from kinfold.plans.registry import query
from kinfold.plans.scores import _MAX, _TWO, _two, reviewer_scores

_ROWS = f"{_MAX}, rows as (select sub q, rev item, s, case when (sub // 10) % 4 = rev % 4 then 1 else 0 end label from sc)"
_RK = _ROWS + ", rk as (select *, row_number() over (partition by q order by s desc, item) r, sum(label) over (partition by q) p from rows)"


def rows(spark, sf_dir):
    s = reviewer_scores(spark, sf_dir)
    return s.select(F.col("sub").alias("q"), F.col("rev").alias("item"), "s", F.when(F.floor(F.col("sub") / 10) % 4 == F.col("rev") % 4, 1).otherwise(0).alias("label"))


@query(f"{_ROWS}, st as (select *, sum(label) over (partition by q order by s desc) cp, count(*) over (partition by q order by s desc) cn from rows) select q, round(sum(case when label = 1 then cp / cn else 0 end) / sum(label), 6) ap from st group by q having sum(label) > 0")
def mean_avg_precision(spark, sf_dir):
    return E.average_precision(rows(spark, sf_dir)).select("q", F.round("ap", 6).alias("ap"))


@query(f"{_RK} select q, round(sum(case when r <= 3 then label else 0 end) / least(3, max(p)), 6) hits from rk group by q having max(p) > 0")
def hits_at_k(spark, sf_dir):
    return E.hits_at(rows(spark, sf_dir), 3).select("q", F.round("hits", 6).alias("hits"))


@query(f"{_RK}, e as (select q, m, max(p) p, sum(case when r <= m then label else 0 end) h from rk cross join range(0, 50) mm(m) group by 1, 2) select m, round(avg(case when p = 0 then 1.0 else h / p end), 6) recall from e group by 1")
def recall_at_m(spark, sf_dir):
    return E.recall_at(rows(spark, sf_dir), 50).select(F.col("m").cast("long").alias("m"), F.round("recall", 6).alias("recall"))


@query(f"{_ROWS}, ti as (select *, q * 1000 + item tie from rows), r as (select *, row_number() over (order by s desc, tie) m from ti) select m, round(sum(label) over (order by m) / m, 6) \"precision\" from r where m <= 20")
def precision_at_m(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("tie", F.col("q") * 1000 + F.col("item"))
    return E.precision_at(r, 20, tie="tie").select(F.col("m").cast("long").alias("m"), F.round("precision", 6).alias("precision"))


@query(f"{_ROWS} select q, item, (select count(*) from rows b where b.q = a.q and b.s > a.s) + ((select count(*) from rows b where b.q = a.q and b.s = a.s) + 1) / 2.0::double avg_rank from rows a")
def avg_rank(spark, sf_dir):
    return E.average_rank(rows(spark, sf_dir), "q", "s").select("q", "item", "avg_rank")


_GOLD = f"{_MAX}, g as (select rev who, sub item, ((sub * 7 + rev * 3) % 9) / 2.0::double + 1 gold, s from sc)"
_PAIR = _GOLD + ", pr as (select a.gold x, b.gold y, a.s - b.s e from g a join g b on a.who = b.who and a.item < b.item)"


def gold(spark, sf_dir):
    s = reviewer_scores(spark, sf_dir)
    return s.select(F.col("rev").alias("who"), F.col("sub").alias("item"), (((F.col("sub") * 7 + F.col("rev") * 3) % 9) / 2.0 + 1).alias("gold"), "s")


@query(f"{_PAIR} select round(sum(case when e = 0 then abs(x - y) / 2 when sign(x - y) <> sign(e) then abs(x - y) else 0 end) / sum(abs(x - y)), 6) loss from pr where x <> y")
def pairwise_loss(spark, sf_dir):
    return E.pairwise_loss(gold(spark, sf_dir)).select(F.round("loss", 6).alias("loss"))


@query(f"{_PAIR}, k as (select case when greatest(x, y) >= 4 and least(x, y) <= 2 then 'easy' when least(x, y) >= 4 then 'hard' end kind, case when sign(x - y) = sign(e) then 1 else 0 end r from pr where x <> y) select kind, round(avg(r), 6) accuracy, count(*) n from k where kind is not null group by 1")
def easy_hard_accuracy(spark, sf_dir):
    return E.easy_hard(gold(spark, sf_dir)).select("kind", F.round("accuracy", 6).alias("accuracy"), "n")


@query("select c_custkey participant, 'Paper1' name, c_nationkey::varchar val from customer union all select c_custkey, 'Paper2', c_mktsegment from customer")
def unpivot_refs(spark, sf_dir):
    wide = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("participant"), F.col("c_nationkey").cast("string").alias("Paper1"), F.col("c_mktsegment").alias("Paper2"))
    return wide.unpivot(["participant"], ["Paper1", "Paper2"], "name", "val")


@query(f"""{_RK}, tt as (select *, sum(label) over (partition by q order by r) tp from rk where p > 0), e as (select q, sum(case when label = 1 then tp / r else 0 end) / max(p) ap, sum(case when label = 1 then 1 / log2(r + 1) else 0 end) / sum(case when r <= p then 1 / log2(r + 1) else 0 end) nd, max(2 * tp / (r + p)) f1, sum(case when r <= 5 then label else 0 end) / max(p) r5 from tt group by q)
select round(avg(ap), 6) map, round(avg(nd), 6) ndcg, round(avg(f1), 6) best_f1, round(avg(r5), 6) recall_5 from e""")
def ranking_metrics(spark, sf_dir):
    m = E.ranking_metrics(rows(spark, sf_dir), [5])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"""{_ROWS}, a as (select q, (select count(*) from rows b where b.q = a.q and b.s > a.s) + ((select count(*) from rows b where b.q = a.q and b.s = a.s) + 1) / 2.0 x, (select count(*) from rows b where b.q = a.q and b.label > a.label) + ((select count(*) from rows b where b.q = a.q and b.label = a.label) + 1) / 2.0 y from rows a)
select q, round(corr(x, y), 6) rho from a group by 1 having count(distinct y) > 1""")
def spearman_bids(spark, sf_dir):
    r = E.average_rank(rows(spark, sf_dir), "q", "s").withColumnRenamed("avg_rank", "x")
    r = E.average_rank(r, "q", "label").withColumnRenamed("avg_rank", "y")
    return r.groupBy("q").agg(F.corr("x", "y").alias("rho"), F.min("y").alias("a"), F.max("y").alias("b")).filter("a < b").select("q", F.round("rho", 6).alias("rho"))


@query("with c as (select source, lang, count(*) n from documents group by 1, 2), p as (select source, n / sum(n) over (partition by source) p from c) select source, round(-sum(p * ln(p)), 6) entropy, count(*) kinds from p group by 1")
def diversity_entropy(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source", "lang").agg(F.count("*").alias("n"))
    t = c.groupBy("source").agg(F.sum("n").alias("t"))
    p = c.join(t, "source").withColumn("p", F.col("n") / F.col("t"))
    return p.groupBy("source").agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"), F.count("*").alias("kinds"))


@query(f"{_RK}, l as (select item, count(*) n from rk where r = 1 group by 1) select max(n) most, round(avg(n), 6) mean, count(*) used from l")
def load_imbalance(spark, sf_dir):
    top = E.ranked(rows(spark, sf_dir), "q", "s", "item").filter("rk = 1").groupBy("item").agg(F.count("*").alias("n"))
    return top.agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("used"))


_PARTS = _PAIR.replace("select a.gold x", "select a.who, a.gold x") + """, pp as (select who, sum(case when e = 0 then abs(x - y) / 2 when sign(x - y) <> sign(e) then abs(x - y) else 0 end) loss_n, sum(abs(x - y)) loss_d,
sum(case when greatest(x, y) >= 4 and least(x, y) <= 2 then case when sign(x - y) = sign(e) then 1 else 0 end else 0 end) easy_n, count(*) filter (greatest(x, y) >= 4 and least(x, y) <= 2) easy_d,
sum(case when least(x, y) >= 4 then case when sign(x - y) = sign(e) then 1 else 0 end else 0 end) hard_n, count(*) filter (least(x, y) >= 4) hard_d from pr where x <> y group by 1),""" + f"""
pe as (select *, row_number() over (order by who) - 1 at_, (select count(*) from pp) n from pp), nn as (select count(*) n from pp), pk as (select id // n draw, ({scrambled('id * 7 + 3', 1_000_000_007)} // 64) % n at_ from nn, range(0, 1000 * (select count(*) from pp)) r(id)),
dr as (select draw, sum(loss_n) / sum(loss_d) loss, sum(easy_n) / nullif(sum(easy_d), 0) easy, sum(hard_n) / nullif(sum(hard_d), 0) hard from pk join pe using (at_) group by 1)"""


@query(f"{_PARTS} select 'loss' as name, round(quantile_cont(loss, 0.025), 6) low, round(quantile_cont(loss, 0.975), 6) high from dr union all select 'easy', round(quantile_cont(easy, 0.025), 6), round(quantile_cont(easy, 0.975), 6) from dr union all select 'hard', round(quantile_cont(hard, 0.025), 6), round(quantile_cont(hard, 0.975), 6) from dr")
def bootstrap_ci(spark, sf_dir):
    got = E.bootstrap(E.gold_parts(gold(spark, sf_dir)), "who", ["loss", "easy", "hard"])
    return got.select("name", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_CUTS = (5, 20, 50, 200, 1000)


@query(f"""{_RK}, cu as (select *, count(*) over (partition by q) n, sum(label) over (partition by q order by r) - 1 i, 1.0::double + item % 3 w from rk)
select q, round(avg((n - r - (p - i - 1)) / (n - p + 1)), 6) auc, {', '.join(f'round(count(*) filter (r <= {k}) / max(p), 6) recall_{k}, round(coalesce(sum(w) filter (r <= {k}), 0) / sum(w), 6) weighted_{k}' for k in _CUTS)} from cu where label = 1 group by 1""")
def ranking_cutoffs(spark, sf_dir):
    r = E.cutoffs(rows(spark, sf_dir).withColumn("w", 1.0 + F.col("item") % 3), list(_CUTS), weight="w")
    return r.select("q", *[F.round(c, 6).alias(c) for c in r.columns if c != "q"])


@query(f"""{_RK}, e as (select q, sum(case when r <= 3 then label else 0 end) / least(3, max(p)) hits, sum(case when r <= 5 then label else 0 end) / max(p) recall from rk group by q having max(p) > 0), f as (select {scrambled('q', 5045)} % 5 fold, avg(hits) hits, avg(recall) recall from e group by 1) select round(avg(hits), 6) hits, round(avg(recall), 6) recall from f""")
def fold_means(spark, sf_dir):
    r = rows(spark, sf_dir)
    each = E.hits_at(r, 3).join(E.cutoffs(r, [5]).select("q", F.col("recall_5").alias("recall")), "q")
    per = S.folds(each, "q", 5).groupBy("fold").agg(F.avg("hits").alias("hits"), F.avg("recall").alias("recall"))
    return E.fold_means(per, ["hits", "recall"]).select(F.round("hits", 6).alias("hits"), F.round("recall", 6).alias("recall"))


@query(f"{_ROWS}, e as (select item, avg(label) l, avg(s) m from rows group by 1) select round(corr(l, m), 6) pearson, round(avg(abs(l - m)), 6) deviation from e")
def popularity_pearson(spark, sf_dir):
    return E.with_popularity(rows(spark, sf_dir)).select(F.round("pearson", 6).alias("pearson"), F.round("deviation", 6).alias("deviation"))


_BIDS = "bids as (select distinct event_id % 40 forum, user_id who, event_type tag from events), pos as (select unnest([min(event_type), max(event_type)]) tag from events)"


def bids(spark, sf_dir):
    """forum, who, tag; tags in ``positive`` are the first and last event types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = e.agg(F.min("event_type"), F.max("event_type")).first()
    return e.select((F.col("event_id") % 40).alias("forum"), F.col("user_id").alias("who"), F.col("event_type").alias("tag")).distinct(), list(ends)


@query(f"""with {_BIDS} select forum, string_agg(distinct who::varchar, ',' order by who::varchar) filter (tag in (select tag from pos)) positives, string_agg(distinct who::varchar, ',' order by who::varchar) filter (tag not in (select tag from pos)) negatives from bids group by 1""")
def bid_sets(spark, sf_dir):
    b, positive = bids(spark, sf_dir)
    s = S.bid_sets(b.withColumn("who", F.col("who").cast("string")), positive)
    return s.select("forum", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("positives", "negatives")])


@query(f"with {_BIDS} select distinct forum, who, case when tag in (select tag from pos) then 1 else 0 end label from bids")
def bid_labels(spark, sf_dir):
    return S.bid_labels(*bids(spark, sf_dir))


@query(f"""with {_BIDS}, l as (select distinct forum, who, case when tag in (select tag from pos) then 1 else 0 end label from bids where who in (select user_id from events where json_extract_string(props, '$.k') = '1'))
select a.forum, a.who pos, b.who neg from l a join l b on a.forum = b.forum and a.label = 1 and b.label = 0 and a.who <> b.who""")
def bpr_triples(spark, sf_dir):
    b, positive = bids(spark, sf_dir)
    having = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.get_json_object("props", "$.k") == "1").select(F.col("user_id").alias("who")).distinct()
    return S.bpr_triples(b, positive, having)


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) r from orders) select a.o_custkey, a.o_orderkey held, b.o_orderkey other from r a join r b on a.o_custkey = b.o_custkey and a.r = 1 and b.o_orderkey <> a.o_orderkey")
def heldout_pairs(spark, sf_dir):
    return S.heldout_pairs(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderkey")


@query(f"{_MAX} select l.doc_id, l.quality, coalesce(m.s, 0) s from labels l join (select distinct vec_id::bigint doc_id from embeddings) p using (doc_id) left join (select sub doc_id, max(s) s from sc group by 1) m using (doc_id)")
def labels_scores_join(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    present = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("doc_id")).distinct()
    best = reviewer_scores(spark, sf_dir).groupBy(F.col("sub").alias("doc_id")).agg(F.max("s").alias("s"))
    return l.join(present, "doc_id").join(best, "doc_id", "left").select("doc_id", "quality", F.coalesce("s", F.lit(0.0)).alias("s"))


@query(f"with g as ({DIGITS.format('documents')}) select doc_id, {permuted('at_')} % 5 fold from (select doc_id, row_number() over (order by doc_id) - 1 at_ from documents), g")
def kfold(spark, sf_dir):
    return S.even_folds(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", 5)


@query(f"""with p as (select a.o_custkey, a.o_orderkey held, b.o_orderkey other, a.o_orderkey * 7919 + b.o_orderkey k from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey),
g as (select o_custkey, row_number() over (order by o_custkey) - 1 at_, count(*) over () n from (select distinct o_custkey from orders)), w as (select p.*, at_, n, {scrambled('k', 1_000_000_007)} % nullif(n - 1, 0) x from p join g using (o_custkey))
select w.o_custkey, held, other, g.o_custkey neg from w left join g on g.at_ = (w.at_ + w.x + 1) % w.n""")
def heldout_triples(spark, sf_dir):
    return S.heldout_triples(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


_SHARES = [c["merge"] for c in embedding.sampled({"merge": (0.0, 1.0)}, 10, seed=5)]


@query(f"""with {_TWO}, ca as (select * from (values {', '.join(f'({i}, {x!r}::double)' for i, x in enumerate(_SHARES))}) v(candidate, x)),
g as (select candidate, a1.rev who, a1.sub item, ((a1.sub * 7 + a1.rev * 3) % 9) / 2.0::double + 1 gold, x * a1.s + (1.0::double - x) * a2.s s from a1 join a2 using (sub, rev) cross join ca),
pr as (select a.candidate, a.who, a.gold x, b.gold y, a.s - b.s e from g a join g b on a.candidate = b.candidate and a.who = b.who and a.item < b.item),
pf as (select candidate, {scrambled('who', 5045)} % 5 fold, sum(case when e = 0 then abs(x - y) / 2 when sign(x - y) <> sign(e) then abs(x - y) else 0 end) n, sum(abs(x - y)) d from pr where x <> y group by 1, 2),
lo as (select fold, candidate, (sum(n) over (partition by candidate) - n) / nullif(sum(d) over (partition by candidate) - d, 0) train, n / nullif(d, 0) test from pf),
rk as (select *, row_number() over (partition by fold order by train nulls last, candidate) r from lo) select fold, candidate, round(train, 6) train, round(test, 6) test from rk where r = 1""")
def cross_validation(spark, sf_dir):
    """Shares of two models, drawn at random, and the best of them for each fold's people by the others'."""
    a, b = _two(spark, sf_dir)
    both = a.withColumnRenamed("s", "s1").join(b.withColumnRenamed("s", "s2"), ["sub", "rev"])
    gold_ = ((F.col("sub") * 7 + F.col("rev") * 3) % 9) / 2.0 + 1
    base = both.select(F.col("rev").alias("who"), F.col("sub").alias("item"), gold_.alias("gold"), "s1", "s2")
    parts = [E.gold_parts(base.withColumn("s", F.lit(x) * F.col("s1") + (F.lit(1.0) - F.lit(x)) * F.col("s2")), bounds=[0.0, 0.25, 0.5, 0.75]) for x in _SHARES]
    best = E.cross_validated(parts, 5)
    return best.select("fold", "candidate", F.round("train", 6).alias("train"), F.round("test", 6).alias("test"))
