"""Smaller operators of the inventory as queries: baselines, sweeps, runs, chunks, look-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinfold import functions as K
from kinfold.operators import embedding
from kinfold.operators import evaluation as E
from kinfold.operators import graph as G
from kinfold.operators import retrieval as R
from kinfold.operators import sampling as S
from kinfold.operators import scoring
from kinfold.plans.arithmetic import scrambled
from kinfold.plans.rankings import _ROWS, rows
from kinfold.plans.registry import query
from kinfold.plans.scores import _P2P, vectors

@query(f"{_ROWS}, pp as (select item, avg(label) pop from rows group by 1) select q, item, round(pop, 6) s from rows join pp using (item)")
def popularity_baseline(spark, sf_dir):
    r = rows(spark, sf_dir)
    return r.join(r.groupBy("item").agg(F.avg("label").alias("p")), "item").select("q", "item", F.round("p", 6).alias("s"))


@query(f"{_ROWS} select q, item, {scrambled('q * 100 + item')} / 1000.0::double s from rows")
def random_baseline(spark, sf_dir):
    return rows(spark, sf_dir).select("q", "item", (S.scrambled(F.col("q") * 100 + F.col("item")) / 1000.0).alias("s"))


@query(f"""{_ROWS}, g as (select s, sum(label) l, count(*) n from rows group by 1), th as (select s t, sum(l) over (order by s desc) tp, sum(n) over (order by s desc) k, (select sum(label) from rows) p, (select count(*) from rows) n from g)
select round(max(2 * tp / (k + p)), 6) best_f1, round(max((tp + (n - p) - (k - tp)) / n), 6) best_accuracy from th""")
def threshold_sweep(spark, sf_dir):
    t = E.thresholds(rows(spark, sf_dir))  # as many rows as there are scores of four digits
    return t.agg(F.round(F.max(2 * F.col("tp") / (F.col("k") + F.col("p"))), 6).alias("best_f1"), F.round(F.max((F.col("tp") + F.col("all") - F.col("p") - F.col("k") + F.col("tp")) / F.col("all")), 6).alias("best_accuracy"))


@query(f"select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by year(o_orderdate) desc, {scrambled('o_orderkey')}, o_orderkey) r from orders) where r <= 2")
def recent_k_random_ties(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.year("o_orderdate")), S.scrambled(F.col("o_orderkey")), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey")


@query("select p_size best, round(avg(p_retailprice), 4) score from part group by 1 order by avg(p_retailprice) desc, 1 limit 1")
def best_parameter(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_size").agg(F.avg("p_retailprice").alias("a"))
    return p.orderBy(F.desc("a"), "p_size").limit(1).select(F.col("p_size").alias("best"), F.round("a", 4).alias("score"))


@query("""with t as (select user_id, event_id, event_type, event_type is distinct from lag(event_type) over (partition by user_id order by event_id) n from events), r as (select *, sum(n::int) over (partition by user_id order by event_id) run from t)
select user_id, event_type, string_agg(event_id::varchar, '_' order by event_id) phrase from r group by user_id, run, event_type""")
def tag_runs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("word", F.col("event_id").cast("string"))
    return G.chunk_runs(e, "user_id", "event_id", "event_type", "word")


@query("with t as (select item_id, string_split(lower(text), ' ') w from benchmark), s as (select item_id, w, unnest(range(0, greatest(len(w), 1), 10)) a from t) select item_id, array_to_string(w[a + 1 : a + 10], ' ') part from s")
def chunk_items(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", K.space_tokens(F.col("text")).alias("w"))
    return S.chunked(b, "w", 10).select("item_id", F.array_join("w", " ").alias("part"))


@query("""with c as (select item, count(*) cnt from (select unnest(string_split(lower(text), ' ')) item from benchmark) group by 1 having count(*) >= 2), v as (select item, row_number() over (order by cnt desc, item) + 1 idx from c),
t as (select doc_id, unnest(string_split(lower(text), ' ')) item from documents) select doc_id, count(*) tokens, count(*) filter (idx is null) oov from t left join v using (item) group by 1""")
def vocabulary_lookup(spark, sf_dir):
    v = R.vocabulary(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text", K.space_tokens(F.col("text")), 2)
    counts = R.terms(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumnRenamed("term", "item")
    found = counts.join(v, "item", "left")
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.sum("tf").alias("tokens"), F.sum(F.when(F.col("idx").isNull(), F.col("tf")).otherwise(0)).alias("oov"))


@query("select l_suppkey, l_partkey, min_by(l_quantity, (l_orderkey, l_linenumber)) score from lineitem group by 1, 2")
def first_score_per_pair(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return l.groupBy("l_suppkey", "l_partkey").agg(F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber")).alias("score"))


@query(f"""with {_P2P}, a as (select rev, i, avg(e[i]) v from p, range(1, 65) r(i) group by 1, 2) select sub, rev, round(sum(t.e[i] * v), 4) s from t cross join a group by 1, 2""")
def centroid_scores(spark, sf_dir):
    subs, pubs, a = vectors(spark, sf_dir)
    c = scoring.centroids(pubs.join(a, "pub"), "rev", "e")
    whole = c.groupBy("rev").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("e")).withColumnRenamed("rev", "pub")
    return scoring.pairwise(subs, whole.withColumn("pub", F.col("pub").cast("long"))).select("sub", F.col("pub").cast("int").alias("rev"), F.round("s", 4).alias("s"))


@query(f"""with g as (select source, row_number() over (order by source) - 1 at_, count(*) over () n, c, sum(c) over (order by source) - c f, sum(c) over () t from (select source, count(*) c from documents where source is not null group by 1)),
d as (select d.doc_id, d.source, g.at_, n, f, c, ({scrambled('d.doc_id', 1_000_000_007)} % nullif(n - 1, 0) + at_ + 1) % n u, case when n > 1 then (at_ + 1) % n end r, {scrambled('d.doc_id', 1_000_000_007)} % nullif(t - c, 0) k from documents d left join g using (source))
select d.doc_id, d.source, u.source uniform, r.source rotate, p.source paper from d left join g u on u.at_ = d.u left join g r on r.at_ = d.r left join g p on d.k + case when d.k >= d.f then d.c else 0 end >= p.f and d.k + case when d.k >= d.f then d.c else 0 end < p.f + p.c""")
def negative_sampling(spark, sf_dir):
    """Another source for every document, three ways."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    for how, name in (("uniform", "uniform"), ("rotate", "rotate"), ("paper_uniform", "paper")):
        d = S.negatives(d, "doc_id", "source", how).withColumnRenamed("neg", name)
    return d


@query(f"""with k as (select source, {scrambled("('0x' || substr(md5(source), 1, 15))::bigint", 1 << 61)} x from (select distinct source from documents where source is not null)), g as (select source, row_number() over (order by x, source) - 1 at_, count(*) over () n from k)
select d.doc_id, d.source, case when g.n > 1 then h.source end neg from documents d left join g using (source) left join g h on h.at_ = (g.at_ + 1) % g.n""")
def negatives_shuffled(spark, sf_dir):
    """Another source for every document: the next in an order without a pattern."""
    return S.negatives(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id", "source", "shuffle")


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') began, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def rating_windows(spark, sf_dir):
    from kinfold.streaming import rating_windows as windows

    return windows(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("began"), "event_type", "n", F.round("total", 4).alias("total"))


def _facets(spark, sf_dir):
    subs, pubs, a = vectors(spark, sf_dir)
    owned = pubs.join(a, "pub").withColumn("facet", F.col("pub") % 3)
    return subs, owned.groupBy("rev", "facet").agg(F.min_by("e", "pub").alias("b")).groupBy("rev").agg(F.transform(F.array_sort(F.collect_list(F.struct("facet", "b"))), lambda x: x["b"]).alias("facets"))


@query()
def facet_mixture(spark, sf_dir):
    """Gradient-fitted mixtures of three facets an author; checked against least squares in the tests."""
    subs, facets = _facets(spark, sf_dir)
    return embedding.facet_distances(facets, subs).withColumn("d", F.round("d", 6))


@query(f"""with {_P2P}, f as (select rev, pub % 3 facet, min(pub) pub from p group by 1, 2), g as (select p.rev, f.facet, p.e from f join p using (pub)), gg as (select a.rev, a.facet fa, b.facet fb, list_dot_product(a.e, b.e) q from g a join g b using (rev)),
x as (select sub, g.rev, facet, list_dot_product(g.e, t.e) p, list_dot_product(g.e, g.e) n, list_dot_product(t.e, t.e) tt from t cross join g),
w as (select *, exp(p / sqrt(n)) / sum(exp(p / sqrt(n))) over (partition by sub, rev) w, row_number() over (partition by sub, rev order by p / n desc, facet) r from x),
sm as (select a.sub, a.rev, sum(a.w * b.w * q) q from w a join w b using (sub, rev) join gg on gg.rev = a.rev and fa = a.facet and fb = b.facet group by 1, 2),
sp as (select sub, rev, max(tt) - 2 * sum(w * p) s from w group by 1, 2), one as (select sub, rev, facet i, p / n k, greatest(p / n, 0) v, p, n, tt from w where r = 1),
two as (select x.sub, x.rev, x.facet j, one.i, one.k, one.v, one.p, one.n, x.tt, x.p pj, x.n nj, gg.q, (x.p - one.v * gg.q) / x.n u, row_number() over (partition by x.sub, x.rev order by (x.p - one.v * gg.q) / x.n desc, x.facet) r from x join one using (sub, rev) join gg on gg.rev = x.rev and gg.fa = x.facet and gg.fb = one.i),
it as (select sub, rev, tt - 2 * k * p + k * k * n mc, tt - 2 * (v * p + greatest(u, 0) * pj) + v * v * n + greatest(u, 0) * greatest(u, 0) * nj + 2 * v * greatest(u, 0) * q mi from two where r = 1)
select sub, rev, round(mc, 6) max_cos, round(mi, 6) max_iter, round(s + q, 6) softmax from it join sm using (sub, rev) join sp using (sub, rev)""")
def facet_methods(spark, sf_dir):
    subs, facets = _facets(spark, sf_dir)
    out = None
    for how in ("max_cos", "max_iter", "softmax"):
        d = embedding.facet_distances(facets, subs, method=how).withColumn("d", F.round("d", 6)).withColumnRenamed("d", how)
        out = d if out is None else out.join(d, ["sub", "rev"])
    return out
