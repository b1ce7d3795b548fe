"""Scoring, sparsifying and cache queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import functions as K
from kinfold.operators import cache, scoring, topk
from kinfold.plans.registry import query

# The embeddings stand in: every tenth vector is a submission, the others are publications of the author in ``label``.
_P2P = """
t as (select vec_id::bigint sub, embedding::double[] e from embeddings where vec_id % 10 = 0),
p as (select vec_id::bigint pub, label rev, embedding::double[] e from embeddings where vec_id % 10 <> 0),
c as (select sub, pub, rev, list_dot_product(t.e, p.e) s from t cross join p)"""
_MM = _P2P + """,
mm as (select min(s) mn, max(s) mx from c),
n as (select sub, pub, rev, (s - mn) / (mx - mn) s from c cross join mm)"""


def vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions (sub, e), publications (pub, e), authorship (pub, rev)."""
    e = F.slice("embedding", 1, dims) if dims else F.col("embedding")
    all_ = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), K.as_doubles(e).alias("e"), F.col("label").alias("rev"))
    subs, pubs = all_.filter("id % 10 = 0"), all_.filter("id % 10 <> 0")
    return subs.select(F.col("id").alias("sub"), "e"), pubs.select(F.col("id").alias("pub"), "e"), pubs.select(F.col("id").alias("pub"), "rev")


def cells(spark: SparkSession, sf_dir: str, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    subs, pubs, authorship = vectors(spark, sf_dir, dims)
    return scoring.pairwise(subs, pubs), authorship


def reviewer_scores(spark: SparkSession, sf_dir: str, how: str = "max") -> DataFrame:
    if how in ("max", "mean"):
        return scoring.author_scores(*vectors(spark, sf_dir), how)
    return scoring.percentile_scores(*vectors(spark, sf_dir), float(how.split(":")[1]) / 100)


@query(f"with {_P2P} select sub, pub, round_even(s, 4) s from c")
def p2p_cosine(spark, sf_dir):
    return scoring.pairwise(*vectors(spark, sf_dir)[:2], digits=4)


@query(f"with {_P2P} select sub, rev, round_even(max(s), 4) s from c group by 1, 2")
def reviewer_max(spark, sf_dir):
    return reviewer_scores(spark, sf_dir)


@query(f"with {_P2P} select sub, rev, round_even(avg(s), 4) s from c group by 1, 2")
def reviewer_mean(spark, sf_dir):
    return reviewer_scores(spark, sf_dir, "mean")


@query(f"with {_P2P} select sub, rev, round_even(quantile_cont(s, 0.5), 4) s from c group by 1, 2")
def reviewer_percentile(spark, sf_dir):
    return reviewer_scores(spark, sf_dir, "percentile:50")


@query(f"with {_MM} select sub, rev, round_even(max(s), 4) s from n group by 1, 2")
def minmax_normalize(spark, sf_dir):
    subs, pubs, a = vectors(spark, sf_dir)
    return scoring.author_scores(subs, pubs, a, ends=scoring.extremes(subs, pubs))


@query(f"""with {_MM}, w as (select *, greatest(1.0::double + (pub % 5) * 0.5, 1e-8) w, least(greatest(s, 1e-8), 1 - 1e-8) k from n)
select sub, rev, round_even(max(w * k / (1 - k + w * k)), 4) s from w group by 1, 2""")
def weighted_scores(spark, sf_dir):
    subs, pubs, a = vectors(spark, sf_dir)
    weighted = pubs.withColumn("w", 1.0 + (F.col("pub") % 5) * 0.5)
    return scoring.author_scores(subs, weighted, a, ends=scoring.extremes(subs, pubs), weight="w")


_TWO = _P2P + """,
c2 as (select sub, pub, rev, list_dot_product(t.e[1:32], p.e[1:32]) s from t cross join p),
a1 as (select sub, rev, round_even(max(s), 4) s from c group by 1, 2), a2 as (select sub, rev, round_even(max(s), 4) s from c2 group by 1, 2)"""


def _two(spark, sf_dir):
    return reviewer_scores(spark, sf_dir), scoring.author_scores(*vectors(spark, sf_dir, 32))


@query(f"with {_TWO} select sub, rev, round_even(0.8::double * a1.s + 0.2::double * a2.s, 4) s from a1 join a2 using (sub, rev)")
def ensemble_blend(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return scoring.blended(a, b, 0.8)


# In ten-thousandths, where a half is exact.
@query(f"""with {_TWO}, h as (select sub, rev, least(greatest(round(a1.s * 10000)::bigint + round(a2.s * 10000)::bigint, 0), 20000) n from a1 join a2 using (sub, rev))
select sub, rev, (n // 2 + case when n % 2 = 1 then (n // 2) % 2 else 0 end) / 10000.0::double s from h""")
def ensemble_clamped(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return scoring.blended(a, b, 0.5, clamped=True)


@query(f"with {_MM} select sub, pub, round_even(s, 4) s from n")
def paper_paper(spark, sf_dir):
    subs, pubs, _ = vectors(spark, sf_dir)
    return scoring.pairwise(subs, pubs, ends=scoring.extremes(subs, pubs), digits=4)


@query(f"""with {_P2P}, b as (select sub, pub, rev, case when pub % 7 = 3 then 0.0 else s end s, pub % 7 = 3 bad from c), mm as (select min(s) mn, max(s) mx from b)
select sub, rev, round_even(max((s - mn) / (mx - mn)), 4) s from b cross join mm where not bad group by 1, 2""")
def bad_embedding_skip(spark, sf_dir):
    subs, pubs, authorship = vectors(spark, sf_dir)
    bad = F.col("pub") % 7 == 3
    marked = pubs.select("pub", F.when(~bad, F.col("e")).alias("e"))
    filled = marked.select("pub", K.zero_filled(F.col("e"), 64).alias("e"))
    good = authorship.join(marked.filter("e is not null"), "pub", "left_semi")
    return scoring.author_scores(subs, filled, good, ends=scoring.extremes(subs, filled))


@query("""select label rev, i - 1 pos, round(avg(embedding[i]::double), 6) v from embeddings, range(1, 65) r(i) where vec_id % 10 <> 0 group by 1, 2""")
def author_centroid(spark, sf_dir):
    _, pubs, a = vectors(spark, sf_dir)
    return scoring.centroids(pubs.join(a, "pub"), "rev", "e").select("rev", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query(f"""with {_P2P}, f as (select rev, pub % 3 facet, min(pub) pub from p group by 1, 2), g as (select p.rev, f.facet, p.e from f join p using (pub)),
x as (select sub, g.rev, facet, t.e t, g.e b, least(greatest(list_dot_product(g.e, t.e) / list_dot_product(g.e, g.e), 0), 1) k, list_dot_product(g.e, t.e) / (sqrt(list_dot_product(g.e, g.e)) * sqrt(list_dot_product(t.e, t.e))) cs from t cross join g),
r as (select *, row_number() over (partition by sub, rev order by cs desc, facet) rn from x)
select sub, rev, round(k * k * list_dot_product(b, b) - 2 * k * list_dot_product(b, t) + list_dot_product(t, t), 6) d from r where rn = 1""")
def facet_distance(spark, sf_dir):
    subs, pubs, a = vectors(spark, sf_dir)
    owned = pubs.join(a, "pub").withColumn("facet", F.col("pub") % 3)
    facets = owned.groupBy("rev", "facet").agg(F.min_by("e", "pub").alias("b"))
    joined = subs.crossJoin(facets)  # every submission with every facet is what is asked for
    cos, d = K.facet_fit(F.col("b"), F.col("e"))
    best = F.max(F.struct(cos.alias("c"), (-F.col("facet")).alias("f"), d.alias("d")))
    return joined.groupBy("sub", "rev").agg(best.alias("x")).select("sub", "rev", F.round("x.d", 6).alias("d"))


_MAX = f"with {_P2P}, sc as (select sub, rev, round_even(max(s), 4) s from c group by 1, 2)"


@query(f"""{_MAX} select sub, rev, s from (select *, row_number() over (partition by sub order by s desc, rev) a, row_number() over (partition by rev order by s desc, sub) b from sc) where a <= 3 or b <= 3""")
def sparse_topk(spark, sf_dir):
    return scoring.best_pairs(*vectors(spark, sf_dir), 3)


@query(f"""{_MAX} select sub, string_agg(rev::varchar || ';' || printf('%.4f', s), ',' order by s desc, rev) ranks from sc group by 1""")
def ranklists(spark, sf_dir):
    return topk.rank_lists(reviewer_scores(spark, sf_dir))


@query(f"""{_MAX} select rev "entityA", sub "entityB", s score from sc where sub <> 20""")
def result_role_mapping(spark, sf_dir):
    s = reviewer_scores(spark, sf_dir)
    named = s.withColumn("sub", F.when(F.col("sub") == 20, "dummy").otherwise(F.col("sub").cast("string")))
    return topk.roles(named, symmetric=False).withColumn("entityB", F.col("entityB").cast("long"))


@query(f"""{_MAX} select count(*) n, round(avg(s), 6) mean, round(stddev_samp(s), 6) std, min(s) "min", round(quantile_cont(s, 0.25), 6) q1, round(quantile_cont(s, 0.5), 6) median, round(quantile_cont(s, 0.75), 6) q3, max(s) "max" from sc""")
def score_stats(spark, sf_dir):
    got = topk.statistics(reviewer_scores(spark, sf_dir))
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "max")


@query(f"""with {_P2P}, r as (select sub, pub, round_even(s, 4) s from c) select sub, pub, s from (select *, row_number() over (partition by sub order by s desc, pub) n from r) where n = 1""")
def closest_match(spark, sf_dir):
    subs, pubs, _ = vectors(spark, sf_dir)
    return topk.closest(scoring.closest_pairs(subs, pubs))


@query(f"""{_MAX}, g as (select distinct label::int + 100 b, vec_id::bigint sub from embeddings where vec_id % 10 = 0 union all select 999, 7) select rev a, b, round_even(avg(s), 2) s from g join sc using (sub) group by 1, 2""")
def group_group_mean(spark, sf_dir):
    scores = reviewer_scores(spark, sf_dir).select(F.col("sub").alias("paper"), F.col("rev").alias("a"), "s")
    groups = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 10 = 0").select((F.col("label").cast("int") + 100).alias("b"), F.col("vec_id").cast("long").alias("paper")).distinct()
    unknown = spark.sql("select 999 as b, 7L as paper")  # a paper without scores: left out
    return scoring.group_mean(scores, groups.union(unknown))


@query(f"""with {_P2P} select sub, rev, round(avg(s), 6) s from (select *, row_number() over (partition by sub, rev order by s desc, pub) n from c) where n <= 3 group by 1, 2""")
def topm_mean(spark, sf_dir):
    return scoring.best_means(*vectors(spark, sf_dir), 3).withColumn("s", F.round("s", 6))


# Whole jobs by options: rules weigh publications by their venue (the type of the part of their number), papers without a vector are bad.
_RULES = [{"prefix": "STANDARD", "weight": 2.5}, {"prefix": "PROMO BR", "weight": 0}, {"value": "SMALL PLATED TIN", "weight": 0.5}, {"submitted": True, "weight": 4}]
_VENUES = """v as (select p_partkey::bigint pub, p_type venue, p_size % 4 = 0 submitted from part),
wr as (select pub, case when venue like 'STANDARD%' then 2.5::double when venue like 'PROMO BR%' then 0 when venue = 'SMALL PLATED TIN' then 0.5 when submitted then 4 else 1 end w from v),
kc as (select sub, c.pub, rev, s, coalesce(w, 1) w, c.pub % 11 = 5 bad from (select sub, pub, rev, case when pub % 11 = 5 then 0 else s end s from c) c left join wr using (pub) where coalesce(w, 1) <> 0),
ke as (select min(s) lo, max(s) hi from kc),
kn as (select sub, rev, w, least(greatest((s - lo) / (hi - lo), 1e-8::double), 1 - 1e-8::double) k from kc cross join ke where not bad),
ks as (select sub, rev, w * k / (1 - k + w * k) s from kn)"""


def _job(spark, sf_dir, request):
    """A vector job over the embeddings, with venues."""
    from kinfold.plans import jobs

    subs, pubs, authorship = vectors(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("pub"), F.col("p_type").alias("venue"), (F.col("p_size") % 4 == 0).alias("submitted"))
    bad = F.col("pub") % 11 == 5
    pubs = pubs.select("pub", K.zero_filled(F.when(~bad, F.col("e")), 64).alias("e"), bad.alias("is_bad")).join(part, "pub", "left")
    return jobs.run(jobs.JobOptions.from_request(request), subs, pubs, authorship)


@query(f"""with {_P2P}, {_VENUES}, sc as (select sub, rev, round_even(max(s), 4) s from ks group by 1, 2)
select sub, rev, s from (select *, row_number() over (partition by sub order by s desc, rev) a, row_number() over (partition by rev order by s desc, sub) b from sc) where a <= 2 or b <= 2""")
def vector_job(spark, sf_dir):
    return _job(spark, sf_dir, {"model": "vectors", "normalize": True, "sparse": 2, "weights": _RULES})


@query(f"with {_P2P}, {_VENUES} select sub, rev, round_even(avg(s), 4) s from ks group by 1, 2")
def vector_job_mean(spark, sf_dir):
    return _job(spark, sf_dir, {"model": "vectors", "average": True, "normalize": True, "sparse": None, "weights": _RULES})


@query(f"with {_P2P}, {_VENUES} select sub, rev, round_even(quantile_cont(s, 0.3), 4) s from ks group by 1, 2")
def vector_job_percentile(spark, sf_dir):
    return _job(spark, sf_dir, {"model": "vectors", "percentile": 30, "normalize": True, "sparse": None, "weights": _RULES})


# The cache: orders stand in, an order's customer is the paper, its date the embedding's.
_CACHE = "cache as (select case when o_orderkey % 2 = 0 then 'm1' else 'm2' end model, o_custkey paper_id, o_orderdate embedding_date, o_orderkey oid from orders)"
_PAPERS = "papers as (select c_custkey paper_id, case when c_custkey % 5 = 0 then null else epoch_ms(timestamp '1995-06-01') end mdate from customer)"


def _cache(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.when(F.col("o_orderkey") % 2 == 0, "m1").otherwise("m2").alias("model"), F.col("o_custkey").alias("paper_id"), F.col("o_orderdate").alias("embedding_date"), F.col("o_orderkey").alias("oid"))


def _papers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("paper_id"), F.when(F.col("c_custkey") % 5 != 0, F.unix_millis(F.lit("1995-06-01 00:00:00").cast("timestamp"))).alias("mdate"))


_FRESH = f"{_CACHE}, {_PAPERS}, fresh as (select model, paper_id, embedding_date from cache join papers using (paper_id) where mdate is null or epoch_ms(embedding_date) >= mdate)"


@query(f"with {_FRESH} select model, paper_id, strftime(max(embedding_date), '%Y-%m-%d') on_day from fresh where model = 'm1' group by 1, 2")
def embedding_cache_lookup(spark, sf_dir):
    found = cache.lookup(_cache(spark, sf_dir), _papers(spark, sf_dir), ["m1"])
    return found.select("model", "paper_id", F.date_format("embedding_date", "yyyy-MM-dd").alias("on_day"))


@query(f"with {_FRESH} select paper_id, mdate from papers where paper_id not in (select paper_id from fresh where model = 'm2')")
def embedding_cache_missing(spark, sf_dir):
    return cache.missing(_cache(spark, sf_dir), _papers(spark, sf_dir), "m2").select("paper_id", "mdate")


@query(f"""with {_CACHE}, old as (select model, paper_id, max(embedding_date) d from cache where oid % 4 < 2 group by 1, 2)
select c.model, c.paper_id, c.oid, strftime(embedding_date, '%Y-%m') year_month from cache c left join old using (model, paper_id) where c.oid % 4 >= 2 and (old.d is null or embedding_date > old.d)""")
def cache_append_delta(spark, sf_dir):
    all_ = _cache(spark, sf_dir)
    return cache.delta(all_.filter("oid % 4 < 2"), all_.filter("oid % 4 >= 2")).select("model", "paper_id", "oid", F.date_format("embedding_date", "yyyy-MM").alias("year_month"))


@query(f"with {_CACHE} select model, paper_id, strftime(max(embedding_date), '%Y-%m-%d') on_day from cache group by 1, 2")
def cache_latest(spark, sf_dir):
    return cache.latest(_cache(spark, sf_dir)).select("model", "paper_id", F.date_format("embedding_date", "yyyy-MM-dd").alias("on_day"))
