"""Lexical queries: benchmark texts are submissions, documents publications, sources their authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold import functions as K
from kinfold.operators import graph as G
from kinfold.operators import postings as P
from kinfold.operators import retrieval as R
from kinfold.operators import sampling as S
from kinfold.plans.arithmetic import DIGITS, permuted
from kinfold.plans.registry import query

_BM25 = """
dt as (select doc_id, unnest(string_split(lower(text), ' ')) term from documents), tf as (select doc_id, term, count(*) tf from dt group by 1, 2),
dl as (select doc_id, sum(tf) dl from tf group by 1), st as (select count(*)::double n, avg(dl) a from dl),
i0 as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from tf cross join st group by term, n), i1 as (select term, case when raw < 0 then 0.25::double * (select avg(raw) from i0) else raw end idf from i0),
q as (select item_id q, term, count(*) qtf from (select item_id, unnest(string_split(lower(text), ' ')) term from benchmark) group by 1, 2),
bm as (select q.q, tf.doc_id doc, sum(qtf * idf * tf.tf * 2.5::double / (tf.tf + 1.5::double * (0.25::double + 0.75::double * dl.dl / a))) s from q join tf using (term) join i1 using (term) join dl using (doc_id) cross join st group by 1, 2)"""


def _tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text", "source", "lang", "n_chars")
    return docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("q"), "text")


@query(f"with {_BM25} select q, doc, round(s, 4) s from bm")
def bm25_scores(spark, sf_dir):
    docs, subs = _tables(spark, sf_dir)
    return P.all_scores(docs, subs).withColumn("s", F.round("s", 4))


# every query beside every document, those without a common term at 0; then the rule as it is written: least and greatest over all
_FULL = f"""{_BM25}, nd as (select count(*) n from documents), ends as (select q, case when count(*) < n then least(min(s), 0) else min(s) end lo, case when count(*) < n then greatest(max(s), 0) else max(s) end hi from bm cross join nd group by q, n),
full_ as (select b.item_id q, d.doc_id doc, d.source, coalesce(bm.s, 0) s, coalesce(lo, 0) lo, coalesce(hi, 0) hi from (select distinct item_id from benchmark) b cross join documents d left join bm on bm.q = b.item_id and bm.doc = d.doc_id left join ends on ends.q = b.item_id),
drawn as (select q, doc, source, case when hi = lo then case when s <> 0 then 1 else 0 end else (s - lo) / (hi - lo) end s from full_)"""


def _owned(spark, sf_dir, how):
    docs, subs = _tables(spark, sf_dir)
    if not how.startswith("percentile:"):
        return P.by_owner(docs, subs, None, how, owner="source").withColumn("s", F.round("s", 4))
    scores = R.normalized_by_query(P.all_scores(docs, subs), docs.count())
    return R.by_owner(scores, subs, docs.select("doc", "source"), how, owner="source").withColumn("s", F.round("s", 4))


@query(f"with {_FULL} select q, source, round(max(s), 4) s from drawn group by 1, 2")
def bm25_reviewer(spark, sf_dir):
    return _owned(spark, sf_dir, "max")


@query(f"with {_FULL} select q, source, round(avg(s), 4) s from drawn group by 1, 2")
def bm25_mean(spark, sf_dir):
    return _owned(spark, sf_dir, "mean")


@query(f"with {_FULL} select q, source, round(quantile_cont(s, 0.75), 4) s from drawn group by 1, 2")
def bm25_percentile(spark, sf_dir):
    return _owned(spark, sf_dir, "percentile:75")


def _papers(spark, sf_dir):
    """Submissions and publications of both kinds: benchmark items and documents in English have an abstract, the others a title alone; sources are authors."""
    docs, subs = _tables(spark, sf_dir)
    first = F.array_join(F.slice(F.split("text", " "), 1, 12), " ")
    pubs = docs.select(F.col("doc").alias("pub"), first.alias("title"), F.when(F.col("lang") == "en", F.col("text")).alias("abstract"), F.col("source").alias("rev"))
    return subs.select(F.col("q").alias("sub"), first.alias("title"), F.when(F.length("text") % 2 == 0, F.col("text")).alias("abstract")), pubs.drop("rev"), pubs.select("pub", "rev")


def _corpus_sql(n: int, docs: str, subs: str) -> str:
    """The same plain BM25 over one kind of papers, as common table expressions with numbered names."""
    return f"""d{n} as ({docs}), s{n} as ({subs}), tf{n} as (select doc, term, count(*) tf from (select doc, unnest(string_split(lower(text), ' ')) term from d{n}) group by 1, 2), dl{n} as (select doc, sum(tf) dl from tf{n} group by 1), st{n} as (select count(*)::double n, avg(dl) a from dl{n}),
i{n} as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from tf{n} cross join st{n} group by term, n), j{n} as (select term, case when raw < 0 then 0.25::double * (select avg(raw) from i{n}) else raw end idf from i{n}), q{n} as (select q, term, count(*) qtf from (select q, unnest(string_split(lower(text), ' ')) term from s{n}) group by 1, 2),
b{n} as (select q, doc, sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / a))) s from q{n} join tf{n} using (term) join j{n} using (term) join dl{n} using (doc) cross join st{n} group by 1, 2),
f{n} as (select s.q, d.doc, d.rev, coalesce(b.s, 0) s from s{n} s cross join d{n} d left join b{n} b on b.q = s.q and b.doc = d.doc), e{n} as (select q, min(s) lo, max(s) hi from f{n} group by 1),
n{n} as (select q, rev, case when hi = lo then case when s <> 0 then 1 else 0 end else (s - lo) / (hi - lo) end s from f{n} join e{n} using (q)),
o{n} as (select s.q sub, r.rev, coalesce((select avg(x.s) from n{n} x where x.q = s.q and x.rev = r.rev), 0) s from s{n} s cross join (select distinct source rev from documents) r)"""


_FIRST = "array_to_string(string_split(text, ' ')[1:12], ' ')"
_BOTH = ", ".join((
    _corpus_sql(1, "select doc_id doc, source rev, text from documents where lang = 'en' and length(text) > 0", "select item_id q, text from benchmark where length(text) % 2 = 0 and length(text) > 0"),
    _corpus_sql(2, f"select doc_id doc, source rev, {_FIRST} as text from documents where (lang is distinct from 'en' or coalesce(length(text), 0) = 0) and length({_FIRST}) > 0", f"select item_id q, {_FIRST} as text from benchmark where (length(text) % 2 = 1 or length(text) = 0) and length({_FIRST}) > 0"),
))


@query(f"with {_BOTH} select sub, rev, round_even(s, 4) s from (select * from o1 union all select * from o2)")
def bm25_job(spark, sf_dir):
    """A whole job by options: titles and abstracts apart, the mean of an author's papers."""
    from kinfold.plans import jobs

    return jobs.run(jobs.JobOptions.from_request({"model": "bm25", "average": True, "sparse": None}), *_papers(spark, sf_dir))


_BEST = _BOTH.replace("avg(x.s)", "max(x.s)") + ", sc as (select sub, rev, round_even(s, 4) s from (select * from o1 union all select * from o2))"


@query(f"""with {_BEST} select sub, rev, s from (select *, row_number() over (partition by sub order by s desc, rev) a, row_number() over (partition by rev order by s desc, sub) b from sc) where a <= 3 or b <= 3""")
def bm25_sparse(spark, sf_dir):
    """A whole job by options: the best three of each submission and author, from blocks of postings."""
    from kinfold.plans import jobs

    return jobs.run(jobs.JobOptions.from_request({"model": "bm25", "sparse": 3}), *_papers(spark, sf_dir))


@query(f"with {_FULL}, r as (select q, doc, round_even(s, 6) s from full_) select q, doc, s from (select *, row_number() over (partition by q order by s desc, doc) n from r) where n <= 10")
def bm25_best(spark, sf_dir):
    return P.best_documents(*_tables(spark, sf_dir), 10)


@query("select distinct source rev from documents where source not in (select source from documents where lang = 'en' and length(text) > 0 and source is not null)")
def no_expertise(spark, sf_dir):
    from kinfold.plans import jobs

    _, pubs, authorship = _papers(spark, sf_dir)
    return jobs.no_expertise(jobs.JobOptions(model="bm25", use_title=False), pubs, authorship)


_TFIDF = """
dt as (select doc_id id, unnest(string_split(lower(text), ' ')) term from documents), tf as (select id, term, count(*) tf from dt group by 1, 2),
idf as (select term, log2((select count(*)::double from documents) / count(*)) idf from tf group by 1), r as (select id, term, tf * idf w from tf join idf using (term)), u as (select id, term, w / nullif(sqrt(sum(w * w) over (partition by id)), 0) w from r),
qt as (select item_id id, unnest(string_split(lower(text), ' ')) term from benchmark), qf as (select id, term, count(*) tf from qt group by 1, 2), qr as (select id, term, tf * idf w from qf join idf using (term)), qu as (select id, term, w / nullif(sqrt(sum(w * w) over (partition by id)), 0) w from qr),
cs as (select qu.id q, u.id doc, sum(qu.w * u.w) s from qu join u using (term) group by 1, 2)"""


@query(f"with {_TFIDF} select q, doc, round(s, 4) s from cs")
def tfidf_cosine(spark, sf_dir):
    return P.tfidf_scores(*_tables(spark, sf_dir)).withColumn("s", F.round("s", 4))


@query(f"with {_TFIDF}, m as (select q, source, max(s) s from cs join documents d on d.doc_id = cs.doc group by 1, 2) select q, source, round(s / (select max(s) from m), 3) s from m")
def tfidf_reviewer(spark, sf_dir):
    best = P.tfidf_of_owners(*_tables(spark, sf_dir))
    top = best.agg(F.max("s").alias("m"))  # one row
    return best.join(F.broadcast(top)).select("q", "source", F.round(F.col("s") / F.col("m"), 3).alias("s"))


@query("""with t as (select unnest(string_split(lower(text), ' ')) item from benchmark), c as (select item, count(*) cnt from t group by 1 having count(*) >= 2)
select item, cnt, row_number() over (order by cnt desc, item) + 1 idx from c""")
def vocab_counts(spark, sf_dir):
    return R.vocabulary(_tables(spark, sf_dir)[1], "text", K.space_tokens(F.col("text")), 2)


@query("select item_id, regexp_replace(lower(text), '[^a-z ]', '', 'g') t from benchmark")
def strip_nonalpha(spark, sf_dir):
    return _tables(spark, sf_dir)[1].select(F.col("q").alias("item_id"), K.strip_nonalpha(F.col("text")).alias("t"))


@query("select doc_id doc, coalesce(lang, '') || ' ' || coalesce(case when doc_id % 2 = 0 then source end, '') t from documents")
def content_to_text(spark, sf_dir):
    return _tables(spark, sf_dir)[0].select("doc", K.content_to_text(F.col("lang"), F.when(F.col("doc") % 2 == 0, F.col("source"))).alias("t"))


# Held-out publications: documents with an id divisible by 50 are ranked against all others by terms.
_LOO = """
dt as (select doc_id, unnest(string_split(lower(text), ' ')) term from documents), tf as (select doc_id, term, count(*) tf from dt group by 1, 2),
dl as (select doc_id, sum(tf) dl from tf group by 1), st as (select count(*)::double n, avg(dl) a from dl),
i0 as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from tf cross join st group by term, n), i1 as (select term, case when raw < 0 then 0.25::double * (select avg(raw) from i0) else raw end idf from i0),
q as (select doc_id q, term, tf qtf from tf where doc_id % 50 = 0),
bm as (select q.q, tf.doc_id doc, sum(qtf * idf * tf.tf * 2.5::double / (tf.tf + 1.5::double * (0.25::double + 0.75::double * dl.dl / a))) s from q join tf using (term) join i1 using (term) join dl using (doc_id) cross join st group by 1, 2),
au as (select q, source, round(max(s), 4) s from bm join documents d on d.doc_id = bm.doc where bm.doc <> bm.q group by 1, 2), rk as (select *, row_number() over (partition by q order by s desc, source) r from au)"""


@query(f"with {_LOO} select q, min(r) hit_rank from rk join documents d on d.doc_id = rk.q and d.source = rk.source group by 1")
def leave_one_out_rank(spark, sf_dir):
    docs, _ = _tables(spark, sf_dir)
    held = docs.filter("doc % 50 = 0").select(F.col("doc").alias("q"), "text", F.col("source").alias("own"))  # the held-out set is the feature
    s = P.best_of_owners(docs, held).withColumn("s", F.round("s", 4))
    from kinfold.operators.evaluation import ranked

    return ranked(s, "q", "s", "source").join(held.select("q", "own"), "q").filter("source = own").groupBy("q").agg(F.min("rk").cast("long").alias("hit_rank"))


_WORDS = "w as (select item_id id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 2 and x not in ({})) words from benchmark)".format(", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS))


@query(f"""with {_WORDS}, p as (select id, words, unnest(range(1, len(words) + 1)) i from w), n as (select id, words[i] a, unnest(words[i + 1 : i + 3]) b from p)
select distinct id, least(a, b) w1, greatest(a, b) w2 from n where a <> b""")
def cooccur_pairs(spark, sf_dir):
    return G.cooccurrences(G.words(_tables(spark, sf_dir)[1], "q", "text"))


@query()
def textrank_top(spark, sf_dir):
    return G.textrank(cooccur_pairs(spark, sf_dir), 5)


@query(f"""with {_WORDS}, p as (select id, words, unnest(range(1, len(words) + 1)) i from w), n as (select id, words[i] a, unnest(words[i + 1 : i + 9]) b from p)
select id, least(a, b) w1, greatest(a, b) w2, count(*) n from n where a <> b group by 1, 2, 3""")
def cooccur_weights(spark, sf_dir):
    return G.weighted_cooccurrences(G.words(_tables(spark, sf_dir)[1], "q", "text"))


@query()
def singlerank_top(spark, sf_dir):
    return G.singlerank(cooccur_weights(spark, sf_dir))


@query(f"with g as ({DIGITS.format('documents')}), p as (select doc_id, n, {permuted('at_')} x from (select doc_id, row_number() over (order by doc_id) - 1 at_ from documents), g) select doc_id, case when x < floor(0.6 * n) then 'train' when x < floor(0.7 * n) then 'dev' else 'test' end part from p")
def split_60_10_30(spark, sf_dir):
    d = _tables(spark, sf_dir)[0].select(F.col("doc").alias("doc_id"))
    return S.split(d, "doc_id", {"train": 0.6, "dev": 0.1, "test": 0.3})


@query("select doc_id, place from (select doc_id, row_number() over (order by doc_id) - 1 place from documents) where place % 4 = 1")
def modulo_partition(spark, sf_dir):
    return S.modulo_partition(_tables(spark, sf_dir)[0].select(F.col("doc").alias("doc_id")), "doc_id", 4, 1)


@query("""select n_chars % 10 size, lang, string_agg(distinct source, ',' order by source) labels from documents group by 1, 2""")
def dedup_union_labels(spark, sf_dir):
    d = _tables(spark, sf_dir)[0].withColumn("size", F.col("n_chars") % 10)
    return S.union_labels(d, ["size", "lang"], "source").select("size", "lang", F.array_join("labels", ",").alias("labels"))


@query("select source, greatest(0, least(1, count(*) filter (lang = 'en') / count(*)))::double share, count(distinct lang) / count(*)::double diversity from documents group by 1")
def diversity_share(spark, sf_dir):
    d = _tables(spark, sf_dir)[0]
    return d.groupBy("source").agg((F.count_if(F.col("lang") == "en") / F.count("*")).alias("share"), (F.countDistinct("lang") / F.count("*")).alias("diversity"))


@query("""with l as (select source, list_sort(list_distinct(list(lang))) a from documents group by 1)
select x.source a, y.source b, len(list_intersect(x.a, y.a))::double / len(x.a) recall from l x join l y on x.source < y.source""")
def subject_overlap(spark, sf_dir):
    l = _tables(spark, sf_dir)[0].groupBy("source").agg(F.collect_set("lang").alias("a"))
    x, y = l.select(F.col("source").alias("a"), F.col("a").alias("s")), l.select(F.col("source").alias("b"), F.col("a").alias("t"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", (F.size(F.array_intersect("s", "t")) / F.size("s").cast("double")).alias("recall"))


@query("select item_id, array_to_string(list_slice(list_concat(string_split(lower(text), ' '), ['_', '_', '_', '_', '_', '_', '_', '_']), 1, 8), ',') t from benchmark")
def fixed_width_tokens(spark, sf_dir):
    q = _tables(spark, sf_dir)[1]
    return q.select(F.col("q").alias("item_id"), F.array_join(K.fixed_width(K.space_tokens(F.col("text")), 8, F.lit("_")), ",").alias("t"))


