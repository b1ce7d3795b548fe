"""Dataset and job queries. Orders stand in for dated publications of a customer, parts for venues, events for edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold import functions as K
from kinfold.operators import dataset as D
from kinfold.plans.registry import query


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _papers(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate")


@query("select event_id, user_id from events where user_id % 2 = 0")
def public_filter(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    readers = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("everyone"))).otherwise(F.array(F.lit("everyone"), F.lit("~A1")))
    return D.public_only(e.select("event_id", "user_id", readers.alias("readers"))).drop("readers")


_DATES = "case when o_orderkey % 3 = 0 then null else epoch_ms(o_orderdate) end pdate, case when o_orderkey % 5 = 0 then null else epoch_ms(o_orderdate) + 1 end cdate, case when o_orderkey % 7 = 0 then null else epoch_ms(o_orderdate) + 2 end tcdate"


@query(f"select o_orderkey, coalesce(pdate, cdate, tcdate, 0) d from (select o_orderkey, {_DATES} from orders)")
def effective_cdate(spark, sf_dir):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    some = lambda n, plus: F.when(F.col("o_orderkey") % n != 0, ms + plus)
    return _orders(spark, sf_dir).select("o_orderkey", D.effective_cdate(some(3, 0), some(5, 1), some(7, 2)).alias("d"))


_RANKED = "r as (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn, count(*) over (partition by o_custkey) n from orders)"
_SINCE = "timestamp '1996-01-01'"


@query(f"with {_RANKED} select o_custkey, o_orderkey from r where rn <= 3")
def recent_topn(spark, sf_dir):
    return D.recent(_papers(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey", top=3).drop("o_orderdate")


@query(f"with {_RANKED} select o_custkey, o_orderkey from r where rn <= ceil(10.0 / 100 * n)")
def recent_percent(spark, sf_dir):
    return D.recent(_papers(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey", top="10%").drop("o_orderdate")


@query(f"with {_RANKED} select o_custkey, o_orderkey from r where rn <= 3 and o_orderdate >= {_SINCE}")
def recent_and_date(spark, sf_dir):
    return D.recent(_papers(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey", top=3, since=F.lit("1996-01-01").cast("timestamp")).drop("o_orderdate")


@query(f"with {_RANKED} select o_custkey, o_orderkey from r where rn <= 3 or o_orderdate >= {_SINCE}")
def recent_or_date(spark, sf_dir):
    return D.recent(_papers(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey", top=3, since=F.lit("1996-01-01").cast("timestamp"), either=True).drop("o_orderdate")


@query("""with d as (select *, split_part(text, chr(10), 1) title, substr(text, length(split_part(text, chr(10), 1)) + 2) abstract from documents),
h as (select *, row_number() over (partition by source, lower(title) order by (length(trim(abstract)) > 0) desc, n_chars desc, doc_id) rn from d)
select doc_id, source, lower(title) title from h where rn = 1""")
def dedup_best_paper(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars", F.substring_index("text", "\n", 1).alias("first"), "text")
    d = d.select("doc_id", "source", "n_chars", F.lower("first").alias("title"), F.expr("substr(text, length(first) + 2)").alias("abstract"))
    return D.best_paper(d, ["source", "title"], abstract=F.col("abstract"), date=F.col("n_chars"), order="doc_id").select("doc_id", "source", "title")


@query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') h from part")
def paperhash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", K.paperhash(F.col("p_name")).alias("h"))


@query("select o_orderkey id from orders where o_orderkey not in (select o_orderkey + 1 from orders where o_orderkey % 4 = 0)")
def original_antijoin(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") + 1).alias("original"))
    return D.without_originals(o).select("id")


_EDGES = "e as (select distinct user_id, event_id % 50 paper from events where event_type = (select min(event_type) from events)), p as (select user_id, event_id % 50 paper, min(event_id) first from events group by 1, 2)"


def _edges(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("paper", F.col("event_id") % 50)
    least = ev.agg(F.min("event_type").alias("event_type"))
    papers = ev.groupBy("user_id", "paper").agg(F.min("event_id").alias("first"))
    return papers, ev.join(F.broadcast(least), "event_type").select("user_id", "paper", "props")


@query(f"with {_EDGES} select p.* from p where not exists (select 1 from e where e.user_id = p.user_id and e.paper = p.paper)")
def exclude_antijoin(spark, sf_dir):
    papers, edges = _edges(spark, sf_dir)
    return D.excluded(papers, edges, ["user_id", "paper"]).select("user_id", "paper", "first")


@query(f"""with {_EDGES}, e2 as (select distinct user_id, event_id % 50 paper from events where event_type = (select min(event_type) from events) and json_extract_string(props, '$.k') = '1'), m as (select p.*, e2.paper is not null hit from p left join e2 on p.user_id = e2.user_id and p.paper = e2.paper)
select user_id, paper, first from (select *, count(*) filter (hit) over (partition by user_id) n from m) where hit or n = 0""")
def include_semijoin(spark, sf_dir):
    papers, edges = _edges(spark, sf_dir)
    chosen = edges.filter(F.get_json_object("props", "$.k") == "1").select("user_id", "paper")  # many people have none
    return D.included(papers, chosen, ["user_id", "paper"], "user_id").select("user_id", "paper", "first")


def _tilde(c: str):
    return F.concat(F.lit("~"), F.col(c).cast("string"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def no_profile_antijoin(spark, sf_dir):
    having = _orders(spark, sf_dir).filter("o_orderpriority = '1-URGENT'").select(_tilde("o_custkey").alias("profile"), F.array().cast("array<string>").alias("emails")).distinct()
    members = spark.read.parquet(f"{sf_dir}/customer.parquet").select(_tilde("c_custkey").alias("member"))
    return D.profiles_of(members, having)[1].select(F.substring("member", 2, 20).cast("int").alias("c_custkey"))


@query("""select p_partkey, case when p_type like (select left(min(p_type), 4) from part) || '%' then 0.5 when p_brand = 'Brand#11' then 2.0 when p_brand = 'Brand#12' then 3.0 when p_size % 2 = 0 then 1.5 else 1.0 end::double w from part""")
def venue_weights(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    prefix = part.agg(F.lit("prefix").alias("kind"), F.substring(F.min("p_type"), 1, 4).alias("key"), F.lit(0.5).alias("weight"), F.lit(9).cast("long").alias("place"))
    rules = [D.WeightRule(1.5, submitted=True), D.WeightRule(2.0, value="Brand#11"), D.WeightRule(3.0, value="Brand#12"), D.WeightRule(7.0, value="Brand#11")]
    table = D.rule_table(spark, rules).union(prefix)
    return D.with_venue_weight(part, table, prefix=F.col("p_type"), value=F.col("p_brand"), submitted=F.col("p_size") % 2 == 0).select("p_partkey", "w")


# Every brand's own rule, from the table itself; prefixes of several lengths, the first by place before the longer.
@query("""with r as (select 'prefix' kind, left(p_type, 6 + p_size % 5) key, p_size * 0.25::double weight, p_partkey place from part where p_size % 3 = 0),
b as (select p_partkey, case when p_size % 2 = 0 then p_type else p_brand end v from part),
p as (select b.p_partkey, min_by(r.weight, r.place) w from b join r on starts_with(b.v, r.key) group by 1),
vr as (select p_brand key, min_by(p_retailprice, p_partkey) weight from part group by 1)
select b.p_partkey, coalesce(p.w, vr.weight, 1.0) w from b left join p using (p_partkey) left join vr on vr.key = b.v""")
def venue_rules(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    place = F.col("p_partkey").alias("place")
    prefixes = part.filter("p_size % 3 = 0").select(F.lit("prefix").alias("kind"), F.expr("left(p_type, 6 + p_size % 5)").alias("key"), (F.col("p_size") * 0.25).alias("weight"), place)
    values = part.select(F.lit("value").alias("kind"), F.col("p_brand").alias("key"), F.col("p_retailprice").alias("weight"), place)
    venue = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    return D.with_venue_weight(part, prefixes.union(values), prefix=venue, value=venue, submitted=F.lit(None).cast("boolean")).select("p_partkey", "w")


# Archives written a file an author and read back, by the data source and by name.
@query("select source author, doc_id::varchar id, lang title, length(text) n, md5(text) digest from documents where source is not null")
def archive_round_trip(spark, sf_dir):
    from kinfold import sources

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("source is not null")
    folder = sources.scratch(spark, "archives")
    content = F.struct(F.col("lang").alias("title"), F.col("text").alias("abstract"))
    sources.write_archives(docs.select(F.col("source").alias("author"), F.col("doc_id").cast("string").alias("id"), content.alias("content")), folder)
    return sources.archive_lines(spark, folder).select("author", "id", "content.title", F.length("content.abstract").cast("long").alias("n"), F.md5("content.abstract").alias("digest"))


@query("select '~' || c_name \"member\" from customer union select lower(s_name) || '@x.org' from supplier")
def member_union(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    name = F.concat(F.lit("~"), "c_name").alias("m")
    return D.members(c.select(name), s.select(F.concat(F.upper("s_name"), F.lit("@X.org")).alias("m")), c.select(name), s.select(F.lit("neither").alias("m")))


@query("""with u as (select item_id id, text, 0 p from benchmark union all select doc_id, lang, 1 from documents union all select r_regionkey::bigint, r_name, 2 from region)
select id, text from (select *, row_number() over (partition by id order by p desc) r from u) where r = 1""")
def submission_upsert(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return D.upsert([read("benchmark").select(F.col("item_id").alias("id"), "text"), read("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("text")), read("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("text"))], "id")


@query("select (select count(*) from benchmark) submission_count, (select count(*) from orders) archives_count, (select count(*) from customer where c_custkey not in (select o_custkey from orders)) no_publications_count")
def dataset_metadata(spark, sf_dir):
    orders = _orders(spark, sf_dir).withColumnRenamed("o_custkey", "author")
    return D.metadata(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), orders, spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("author")), "author")


@query("select doc_id id from documents union select item_id from benchmark")
def note_ids_union(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return d.select(F.col("doc_id").alias("id")).union(b.select("item_id")).distinct()


@query("select event_id, json_extract_string(props, '$.k') k from events")
def unwrap_values(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", K.unwrap(F.col("props"), "k").alias("k"))


@query("select event_id from events where json_extract_string(props, '$.k') = '1'")
def content_match(spark, sf_dir):
    return D.matching_content(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", {"k": "1"}).select("event_id")


@query("select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') on_day from orders where lower(o_orderstatus) = 'o' and starts_with(lower(o_orderpriority), '1-') and o_custkey % 2 = 0 order by o_orderdate desc, o_orderkey")
def job_search(spark, sf_dir):
    jobs = _orders(spark, sf_dir).withColumn("owner", F.when(F.col("o_custkey") % 2 == 0, "me").otherwise("other"))
    found = D.search_jobs(jobs, {"o_orderstatus": "O", "o_orderpriority": "1-"}, owner="me")
    return found.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("on_day"))


@query("""with j as (select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then '' else o_orderpriority end a, o_orderstatus || '-x' b from orders)
select 'either' kind, o_orderkey from j where starts_with(lower(coalesce(nullif(a, ''), b)), 'o-') union all select 'first', o_orderkey from j where starts_with(lower(a), '1-') and o_custkey % 2 = 0""")
def job_search_entities(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    jobs = _orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "me").otherwise("other").alias("owner"), F.struct(first.alias("memberOf")).alias("entityA"), F.struct(F.concat("o_orderstatus", F.lit("-x")).alias("memberOf")).alias("entityB"))
    either = D.search_jobs(jobs, {"memberOf": "O-"}, owner="root", superuser="root").select(F.lit("either").alias("kind"), "o_orderkey")
    return either.union(D.search_jobs(jobs, {"entityA.memberOf": "1-"}, owner="me", superuser="root").select(F.lit("first"), "o_orderkey"))


@query("select page_id, regexp_replace(url, '/[^/]*$', '') k, split_part(url, '/-/', 1) i from pages")
def venue_key(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", K.venue_key(F.col("url")).alias("k"), K.invitation_prefix(F.col("url")).alias("i"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then o_orderkey * 1000 end ts from orders")
def cloud_id_ts(spark, sf_dir):
    id_ = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("-", F.lit("job"), (F.col("o_orderkey") * 1000).cast("string"))).otherwise(F.lit("job-x1"))
    return _orders(spark, sf_dir).select("o_orderkey", K.trailing_timestamp(id_).alias("ts"))


@query("select user_id, count(*) n, case when count(*) < 60 then 'small' when count(*) < 70 then 'medium' else 'large' end tier from events group by 1")
def machine_tier(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.withColumn("tier", D.machine_tier(F.col("n"), 60, 70))


@query("select p_partkey, lower(translate(p_brand, '/:_.', '----')) s from part")
def sanitized_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", K.sanitized(F.col("p_brand")).alias("s"))


@query("select o_orderkey from orders where (o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'O') or o_orderkey in (1, 2, 3)")
def notes_by_invitation(spark, sf_dir):
    notes = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("invitation"), F.col("o_orderstatus").alias("venueid"))
    return D.notes_of(notes, invitations=["1-URGENT", "2-HIGH"], venueid="O", ids=[1, 2, 3]).select("o_orderkey")


@query("""with p as (select '~' || c_name profile, lower(c_name) || '@x.org' mail from customer where c_acctbal > 1000), m as (select '~' || c_name "member" from customer union select lower(c_name) || '@x.org' from customer)
select "member", coalesce(a.profile, b.profile) profile from m left join p a on a.profile = m."member" left join p b on b.mail = m."member" """)
def profiles_split(spark, sf_dir):
    """Members by id and by e-mail, with their profile; those without have none."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.concat(F.lit("~"), "c_name")
    profiles = c.filter("c_acctbal > 1000").select(name.alias("profile"), F.array(F.concat("c_name", F.lit("@X.org")), F.lit("shared@y.org")).alias("emails"))
    members = D.members(c.select(name.alias("m")), c.select(F.concat("c_name", F.lit("@x.ORG")).alias("m")))
    valid, invalid = D.profiles_of(members, profiles)
    return valid.union(invalid.select("member", F.lit(None).cast("string").alias("profile")))


_BID_PAPERS = "select distinct user_id who, event_id % (select max(doc_id) + 1 from documents) doc_id from events where event_type in (select unnest([min(event_type), max(event_type)]) from events)"


@query(f"select b.who, d.doc_id, d.lang from ({_BID_PAPERS}) b join documents d using (doc_id)")
def bid_expertise(spark, sf_dir):
    """Bids of the wanted labels stand for publications."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = list(e.agg(F.min("event_type"), F.max("event_type")).first())
    notes = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    n = notes.agg(F.max("doc_id") + 1).first()[0]
    bids = e.select(F.col("user_id").alias("who"), (F.col("event_id") % n).alias("doc_id"), F.col("event_type").alias("label"))
    return D.bid_publications(notes, bids, ends, paper="doc_id", author="who").select("who", "doc_id", "lang")


@query(f"with {_EDGES} select user_id, string_agg(paper::varchar, ',' order by paper) papers from e group by 1")
def exclusion_sets(spark, sf_dir):
    _, edges = _edges(spark, sf_dir)
    return D.edge_sets(edges, "user_id", "paper").select("user_id", F.array_join(F.transform("papers", lambda x: x.cast("string")), ",").alias("papers"))


@query("""select p_partkey, case when p_brand = 'Brand#12' then 3.0 else 1.0 end::double w from part where p_brand <> 'Brand#11' and p_size > 10""")
def kept_publications(spark, sf_dir):
    """Publications of weight 0, and those whose title leaves no hash, go."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rules = [D.WeightRule(0, value="Brand#11"), D.WeightRule(3, value="Brand#12")]
    w = part.withColumn("w", D.venue_weight(F.col("p_brand"), F.lit(False), rules))
    title = F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(F.lit(" --- "))
    return D.with_hash(D.without_zero_weight(w, "w"), K.paperhash(title)).select("p_partkey", "w")


@query("select page_id, coalesce(case when page_id % 3 = 0 then 'own' end, case when page_id % 2 = 0 then split_part(url, '/-/', 1) end, split_part(url, '/-/', 1)) d from pages")
def note_domain(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    own, one = F.when(F.col("page_id") % 3 == 0, F.lit("own")), F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return p.select("page_id", D.note_domain(own, one, F.array("url")).alias("d"))
