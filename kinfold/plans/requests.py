"""Requests' entities, archives' papers, results and other smaller items as queries. Orders stand in for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold import functions as K
from kinfold import sources
from kinfold.operators import dataset as D
from kinfold.operators import embedding
from kinfold.operators import graph as G
from kinfold.operators import requests as Q
from kinfold.operators import retrieval as R
from kinfold.operators import topk as T
from kinfold.plans.rankings import _MAX, _ROWS, rows
from kinfold.plans.registry import query
from kinfold.plans.scores import _P2P, reviewer_scores, vectors


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entities(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 12)
    when = lambda ks, v: F.when(F.col("k").isin(*ks), v)
    cust = F.col("o_custkey").cast("string")
    made = {
        "type": F.when(F.col("k") < 10, F.when(F.col("k") % 2 == 0, "Group").otherwise("Note")).when(F.col("k") == 10, "Edge"),
        "memberOf": when((0, 2, 5), F.concat(F.lit("g"), cust)), "reviewerIds": when((2, 4), F.array(cust, F.lit("x"))), "expertise": when((0, 6), F.lit("inv")),
        "id": when((1, 3), F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))), "invitation": when((3, 7), F.lit("v/-/s")), "withVenueid": when((7, 9), F.concat(F.lit("ven"), (F.col("o_custkey") % 5).cast("string"))),
        "submissions": when((5,), F.array(cust)), "withContent": F.when((F.col("o_custkey") % 3 == 0) & (F.col("k") % 2 == 1), F.create_map(F.lit("track"), F.col("o_orderstatus"))), "submissionIds": F.lit(None),
    }
    return o.select("o_orderkey", F.struct(*[v.cast(Q.FIELDS.get(n, "string")).alias(n) for n, v in made.items()]).alias("entity"))


_E = """with e as (select o_orderkey, o_orderkey % 12 k, o_custkey c, o_custkey % 3 = 0 and o_orderkey % 2 = 1 wc, o_orderstatus st from orders)"""


@query(f"""{_E} select o_orderkey, case k when 11 then 'type is missing' when 10 then 'no such type: Edge' when 2 then 'unexpected: reviewerIds' when 3 then 'id beside invitation or venue' when 5 then 'unexpected: memberOf'
when 6 then 'nothing to name it by' when 7 then 'unexpected: withVenueid' when 8 then 'nothing to name it by' end fault from e""")
def entity_rules(spark, sf_dir):
    return _entities(spark, sf_dir).select("o_orderkey", Q.fault(F.col("entity")).alias("fault"))


@query(f"""{_E}, n as (select *, case when k in (0, 2) then 'g' || c when k = 4 then 'reviewers:2' when k in (6, 8) then 'unknownGroup' when k in (1, 3) then 'n' || o_orderkey when k = 7 then 'v/-/s' when k = 9 then 'ven' || c % 5 when k = 5 then 'submissions:1' end one from e)
select o_orderkey, one, case when k in (1, 3) then 'pid-' || one when k = 7 then 'inv' when k = 9 then 'venueid' else one end kind,
array_to_string(list_filter([case when k = 5 then null else one end, case when k = 2 then 'reviewers:2' when k = 3 then 'v/-/s' when k = 7 then 'ven' || c % 5 end, case when wc and k < 10 then 'track:' || st end, case when k = 5 then one end], lambda x: x is not null), ' ') every from n""")
def entity_names(spark, sf_dir):
    e = F.col("entity")
    every = F.array_join(F.coalesce(Q.names(e), F.array().cast("array<string>")), " ")
    return _entities(spark, sf_dir).select("o_orderkey", Q.name(e).alias("one"), Q.name(e, prefix=True).alias("kind"), every.alias("every"))


@query("select page_id, coalesce(nullif(case when page_id % 4 = 0 then '' when page_id % 2 = 0 then 'V/' || page_id end, ''), string_split(url || '/-/Submission', '/-/')[1]) venue from pages")
def venue_ids(spark, sf_dir):
    given = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 2 == 0, F.concat(F.lit("V/"), F.col("page_id").cast("string")))
    return _table(spark, sf_dir, "pages").select("page_id", Q.venue_id(given, F.concat("url", F.lit("/-/Submission"))).alias("venue"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_custkey is not null)")
def no_publications(spark, sf_dir):
    archives = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return D.without_publications(_table(spark, sf_dir, "customer"), archives, "c_custkey")


# Copies of one text are one paper of several authors; every third source has no titles.
@query("""with a as (select md5(text) pub, source, trim(case when doc_id % 3 > 0 then lang else '' end) t, trim(case when doc_id % 5 > 0 then text else '' end) x, n_chars, doc_id from documents where source is not null),
k as (select * from a where t <> '' or x <> ''), f as (select pub, min({'a': source, 'b': t, 'c': x}) m, max(n_chars) mdate, string_agg(distinct source, ',' order by source) authors from k group by 1)
select pub, case when m.b = '' then '.' else m.b end title, md5(case when m.c = '' then '.' else m.c end) abstract, mdate, authors from f""")
def archive_papers(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").filter("source is not null")
    a = d.select(F.col("source").alias("author"), F.md5("text").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("title"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("abstract"), F.col("n_chars").alias("mdate"))
    papers, _ = D.archive_papers(a)
    return papers.select("pub", "title", F.md5("abstract").alias("abstract"), "mdate", F.array_join("authors", ",").alias("authors"))


@query("""with v as (select vec_id, vec_id % 9 = 4 bad, case when vec_id % 9 = 4 then list_transform(embedding, lambda x: 0.0::double) else embedding::double[] end e from embeddings)
select vec_id, bad is_bad, case when vec_id % 4 = 0 then vec_id % 7 / 2.0::double else 1.0 end w, round(e[1] / (sqrt(list_dot_product(e, e)) + 1e-12::double), 6) x, round(sqrt(list_dot_product(e, e)) / (sqrt(list_dot_product(e, e)) + 1e-12::double), 6) length from v""")
def embedding_load(spark, sf_dir):
    """Vectors at unit length with weights; those that are empty are bad."""
    v = _table(spark, sf_dir, "embeddings")
    rows_ = v.select(F.col("vec_id").cast("string").alias("paper_id"), F.when(F.col("vec_id") % 9 == 4, F.array().cast("array<double>")).otherwise(K.as_doubles(F.col("embedding"))).alias("embedding"))
    weights = v.filter("vec_id % 4 = 0").select(F.col("vec_id").cast("string").alias("paper_id"), (F.col("vec_id") % 7 / 2.0).alias("w"))
    folder = sources.scratch(spark, "embeddings")
    sources.write_embeddings(rows_, folder)
    made = sources.embeddings(spark, folder, 64, normalize=True, weights=weights)
    return made.select(F.col("paper_id").cast("long").alias("vec_id"), "is_bad", "w", F.round(F.get("e", F.lit(0)), 6).alias("x"), F.round(K.norm(F.col("e")), 6).alias("length"))


@query(f"""{_MAX} select rev::varchar "entityA", sub::varchar "entityB", s score from sc""")
def results_read(spark, sf_dir):
    """Scores written as a job's result, read with their roles."""
    folder = sources.scratch(spark, "results")
    sources.write_scores(reviewer_scores(spark, sf_dir).select("sub", "rev", "s"), folder, 4, "s")
    return sources.results(spark, folder, symmetric=False)


@query(f"""{_ROWS} select q, item, s, n place from (select *, row_number() over (partition by q order by s desc, item) n from rows) where n <= 5""")
def top_predictions(spark, sf_dir):
    return T.predictions(rows(spark, sf_dir), 5)


_WORDS = "w as (select doc_id id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 2 and x not in ({})) l from documents)".format(", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS))


@query(f"with {_WORDS}, p as (select id, unnest(l) word, generate_subscripts(l, 1) - 1 i from w) select id, word, min(i) \"first\", count(*) n from p group by 1, 2")
def first_places(spark, sf_dir):
    made = G.first_places(G.words(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    return made.select("id", "word", F.col("first").cast("long").alias("first"), "n")


@query("""with t as (select doc_id, string_split(lower(text), ' ') l, (row_number() over (order by doc_id) - 1) // 32 batch from documents), v as (select w item from (select unnest(l) w from t) group by 1 having count(*) >= 20),
u as (select doc_id, count(*) filter (item is null) un from (select doc_id, unnest(l) w from t) left join v on v.item = w group by 1)
select batch, count(*) "rows", sum(len(l))::bigint tokens, sum(coalesce(un, 0))::bigint unknown, max(len(l)) longest from t left join u using (doc_id) group by 1""")
def token_batches(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    made = R.batches(d, "doc_id", K.space_tokens(F.col("text")), R.vocabulary(d, "text", K.space_tokens(F.col("text")), 20), 32)
    return made.withColumn("longest", F.col("longest").cast("long"))


# Subjects of a submission and of an author by their numbers; how well scores go with what they have in common.
@query(f"""{_ROWS}, m as (select min(s) lo, max(s) hi from rows), f as (select (s - lo) / (hi - lo) s, list_distinct([q % 4, q // 10 % 4, 7]) a, list_distinct([item % 4, item % 3, 7]) b from rows cross join m),
o as (select s, len(list_intersect(a, b))::double c, len(a) p, len(b) r from f), g as (select s, c / p recall, c / r "precision", 2 * c / (p + r) f1 from o)
select round(corr(s, recall), 6) recall, round(corr(s, "precision"), 6) "precision", round(corr(s, f1), 6) f1, count(*) n from g""")
def overlap_correlation(spark, sf_dir):
    from kinfold.operators.evaluation import overlap_correlation as study

    r = rows(spark, sf_dir)
    have = lambda *xs: F.array_distinct(F.array(*[x.cast("long") for x in xs], F.lit(7).cast("long")))
    pairs = r.select("s", have(F.col("q") % 4, F.floor(F.col("q") / 10) % 4).alias("found"), have(F.col("item") % 4, F.col("item") % 3).alias("held"))
    made = study(pairs, wanted="found", found="held")
    return made.select(*[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")], "n")


_FACETS = f"""with {_P2P}, f as (select rev, pub % 3 facet, min(pub) pub from p group by 1, 2), g as (select p.rev, f.facet, p.e from f join p using (pub))"""


@query(f"""{_FACETS}, gg as (select a.rev, a.facet fa, b.facet fb, list_dot_product(a.e, b.e) q from g a join g b using (rev)),
x as (select sub, g.rev, facet, greatest(list_dot_product(g.e, t.e), 0) c, list_dot_product(g.e, t.e) p, list_dot_product(t.e, t.e) tt from t cross join g),
w as (select *, c / greatest(sum(c) over (partition by sub, rev), 1e-300) w from x), o as (select sub, rev, max(tt) - 2 * sum(w * p) d from w group by 1, 2),
i as (select a.sub, a.rev, sum(a.w * b.w * q) q from w a join w b using (sub, rev) join gg on gg.rev = a.rev and fa = a.facet and fb = b.facet group by 1, 2)
select sub, rev, round(greatest(d + q, 0), 6) d from o join i using (sub, rev)""")
def facet_products(spark, sf_dir):
    from kinfold.plans.extras import _facets

    subs, facets = _facets(spark, sf_dir)
    return embedding.facet_distances(facets, subs, method="prod").withColumn("d", F.round("d", 6))


@query(f"""{_FACETS}, x as (select sub, g.rev, facet, t.e t, g.e b, least(greatest(list_dot_product(g.e, t.e) / list_dot_product(g.e, g.e), 0), 1) k, list_dot_product(g.e, t.e) / (sqrt(list_dot_product(g.e, g.e)) * sqrt(list_dot_product(t.e, t.e))) cs from t cross join g),
r as (select *, row_number() over (partition by sub, rev order by cs desc, facet) rn from x)
select sub, 'r' || rev rev, round(1 - (k * k * list_dot_product(b, b) - 2 * k * list_dot_product(b, t) + list_dot_product(t, t)), 6) s from r where rn = 1 and rev >= 3""")
def facet_scores(spark, sf_dir):
    """The model's scores: 1 less the distance, under names without what follows a bar, special places left out."""
    from kinfold.plans.extras import _facets

    subs, facets = _facets(spark, sf_dir)
    d = embedding.facet_distances(facets, subs, method="max")
    named = d.select("sub", F.concat(F.lit("r"), F.col("rev").cast("string"), F.lit("|f")).alias("rev"), F.col("rev").alias("idx"), "d")
    return embedding.facet_scores(named, special=3).withColumn("s", F.round("s", 6))


@query("with c as (select source, count(*) n from documents group by 1) select source, round((0.01::double + n / sum(n) over ()) / 0.01::double, 6) w from c")
def smoothed_weights(spark, sf_dir):
    c = _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    whole = c.agg(F.sum("n").alias("all"))
    return c.join(F.broadcast(whole)).select("source", F.round(K.smoothed_weight(F.col("n") / F.col("all"), 0.01), 6).alias("w"))  # one row


# Words' vectors are made of their letters; stop words don't count, nor do phrases of nothing else.
@query("""with p as (select distinct phrase from (select doc_id, array_to_string(string_split(lower(text), ' ')[1:3], '_') phrase from documents)), s as (select phrase, string_split(phrase, '_') w from p), k as (select phrase, list_filter(w, lambda x: x not in ({})) w from s),
u as (select phrase, unnest(w) x, len(w) n from k), c as (select phrase, n, j - 1 pos, sum(length(replace(x, chr(96 + j::int), '')) - length(x)) t from u, range(1, 5) r(j) where x <> '' group by 1, 2, 3)
select phrase, pos, round(-t / n::double, 6) v from c""".format(", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS)))
def phrase_vectors_without_stop_words(spark, sf_dir):
    first = F.array_join(F.slice(F.split(F.lower("text"), " ", -1), 1, 3), "_")
    phrases = _table(spark, sf_dir, "documents").select(first.alias("phrase"))
    words = phrases.distinct().select(F.explode(F.split("phrase", "_", -1)).alias("word")).filter("word <> ''").distinct()
    count = lambda c: (F.length("word") - F.length(F.replace("word", F.lit(c), F.lit("")))).cast("double")
    made = embedding.phrase_vectors(phrases, words.select("word", F.array(*[count(c) for c in "abcd"]).alias("e")), skip=K.STOP_WORDS)
    return made.select("phrase", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))
