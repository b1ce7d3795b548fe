"""Tokens, vocabularies, samples and keys as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold import functions as K
from kinfold.operators import dataset as D
from kinfold.operators import embedding
from kinfold.operators import evaluation as E
from kinfold.operators import graph as G
from kinfold.operators import retrieval as R
from kinfold.operators import sampling as S
from kinfold.operators import topk as T
from kinfold.plans.arithmetic import DIGITS, permuted, scrambled
from kinfold.plans.rankings import _ROWS, rows
from kinfold.plans.registry import query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(table: str, text: str, least: int) -> str:
    return f"c as (select item, count(*) cnt from (select unnest(string_split(lower({text}), ' ')) item from {table}) group by 1), v as (select item, cnt, row_number() over (order by cnt desc, item) + 1 idx from c where cnt >= {least})"


def _ids(words: str, width: int) -> str:
    """The list of indices of a list of words in SQL, by the map m of the vocabulary."""
    return f"list_slice(list_concat(list_transform(list_slice({words}, 1, {width}), lambda w: coalesce(m[w], 1)), list_transform(range({width}), lambda z: 0::bigint)), 1, {width})"


_MAP = "mm as (select map_from_entries(list((item, idx))) m from v)"


@query(f"with {_vocabulary('benchmark', 'text', 2)} select * from v union all select '<unk>', coalesce(sum(cnt), 0)::bigint, 1 from c where cnt < 2")
def vocabulary_with_unknown(spark, sf_dir):
    return R.vocabulary_with_unknown(_table(spark, sf_dir, "benchmark"), "text", K.space_tokens(F.col("text")), 2)


@query(f"with {_vocabulary('benchmark', 'text', 2)}, {_MAP} select doc_id, array_to_string({_ids("string_split(lower(coalesce(text, '')), ' ')", 16)}, ',') ids from documents, mm")
def encoded_tokens(spark, sf_dir):
    v = R.vocabulary(_table(spark, sf_dir, "benchmark"), "text", K.space_tokens(F.col("text")), 2)
    d = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return R.encoded(d, "doc_id", {"ids": K.space_tokens(F.col("text"))}, v, 16).select("doc_id", F.array_join("ids", ",").alias("ids"))


@query(f"""with {_vocabulary('part', 'p_name', 1)}, {_MAP} select p_partkey, array_to_string({_ids("string_split(lower(p_name), ' ')", 4)}, ',') source, array_to_string({_ids("string_split(lower(p_type), ' ')", 4)}, ',') positive, array_to_string({_ids("string_split(lower(p_brand || ' ' || p_name), ' ')", 4)}, ',') negative, 4 length from part, mm""")
def encoded_triples(spark, sf_dir):
    """Source, positive and negative of a training sample; each is as long as it is filled up to."""
    p = _table(spark, sf_dir, "part")
    v = R.vocabulary(p, "p_name", K.space_tokens(F.col("p_name")), 1)
    lists = {"source": K.space_tokens(F.col("p_name")), "positive": K.space_tokens(F.col("p_type")), "negative": K.space_tokens(F.concat_ws(" ", "p_brand", "p_name"))}
    made = R.encoded(p, "p_partkey", lists, v, 4)
    return made.select("p_partkey", *[F.array_join(c, ",").alias(c) for c in lists], F.size("source").alias("length"))


@query("""with t as (select doc_id, list_concat(string_split(lower(coalesce(source, '')), '_'), ['<SEP>']) a, list_concat(string_split(lower(coalesce(text, '')), ' '), ['<SEP>']) b from documents),
u as (select doc_id, list_concat(a, b) t, list_concat(list_transform(a, lambda x: 0), list_transform(b, lambda x: 1)) y from t)
select doc_id, case when len(t) <= 512 then array_to_string(t, ' ') else array_to_string(list_concat(t[1:511], t[-1:]), ' ') end tokens, case when len(t) <= 512 then list_sum(y) else list_sum(y[1:511]) + y[-1] end::bigint abstracts from u""")
def typed_tokens(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    tokens, types = K.typed_tokens(F.split(F.lower(F.coalesce("source", F.lit(""))), "_"), K.space_tokens(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.aggregate(types, F.lit(0), lambda s, x: s + x).cast("long").alias("abstracts"))


@query("""with e as (select user_id, json_extract_string(props, '$.k') phrase, max(value) score from events group by 1, 2) select * from (select *, row_number() over (partition by user_id order by score desc, phrase) place from e) where place <= 5""")
def first_phrases(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("phrase"), F.col("value").alias("score"))
    return G.first_phrases(e, "user_id", "phrase", "score", 5)


@query("""with v as (select item, row_number() over (order by count(*) desc, item) + 1 idx from (select unnest(string_split(lower(p_name), ' ')) item from part) group by 1),
p as (select distinct replace(p_name, ' ', '_') phrase from part), w as (select phrase, len(string_split(lower(phrase), '_')) n, unnest(string_split(lower(phrase), '_')) item from p),
x as (select phrase, n, generate_subscripts(embedding, 1) - 1 pos, unnest(embedding)::double x from w join v using (item) join embeddings on vec_id = idx)
select phrase, pos::int pos, round(sum(x) / n, 6) v from x group by phrase, n, pos""")
def phrase_vectors(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    v = R.vocabulary(p, "p_name", K.space_tokens(F.col("p_name")), 1)
    words = v.join(_table(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("idx")).select(F.col("item").alias("word"), K.as_doubles(F.col("embedding")).alias("e"))
    return embedding.phrase_vectors(p.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("phrase")), words).withColumn("v", F.round("v", 6))


@query("""with s as (select vec_id, unnest(embedding)::double x from embeddings), e as (select vec_id, x, exp(x - max(x) over (partition by vec_id)) e from s), p as (select vec_id, e / sum(e) over (partition by vec_id) p from e)
select vec_id, round(max(p), 6) top, round(-sum(p * ln(p)), 6) entropy from p group by 1""")
def softmax_entropy(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", K.softmax(K.as_doubles(F.col("embedding"))).alias("p"))
    return e.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(K.entropy(F.col("p")), 6).alias("entropy"))


@query("""with s as (select user_id, list_distinct(list(event_type) filter (event_id % 2 = 0)) f, list_distinct(list(event_type) filter (event_id % 2 = 1)) w from events group by 1), n as (select user_id, coalesce(len(f), 0) f, coalesce(len(w), 0) w, coalesce(len(list_intersect(f, w)), 0)::double b from s)
select user_id, coalesce(b / nullif(w, 0), 0) recall, coalesce(b / nullif(f, 0), 0) precision_, coalesce(2 * b / nullif(f + w, 0), 0) f1 from n""")
def overlap_f1(spark, sf_dir):
    even = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    odd = F.when(F.col("event_id") % 2 == 1, F.col("event_type"))
    s = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(even).alias("f"), F.collect_set(odd).alias("w"))
    recall, precision, f1 = K.overlap(F.col("f"), F.col("w"))
    return s.select("user_id", recall.alias("recall"), precision.alias("precision_"), f1.alias("f1"))


@query("with e as (select min(o_totalprice) l, max(o_totalprice) h from orders) select least(floor((o_totalprice - l) / (h - l) * 20), 19)::int bin, count(*) n from orders, e group by 1")
def score_histogram(spark, sf_dir):
    return T.histogram(_table(spark, sf_dir, "orders"), 20, "o_totalprice")


@query(f"{_ROWS}, g as (select s, sum(label) l, count(*) n from rows group by 1), th as (select l, sum(l) over (order by s desc) tp, sum(n) over (order by s desc) k, (select sum(label) from rows) p from g) select round(sum(l / p * tp / k), 6) ap from th")
def pooled_precision(spark, sf_dir):
    return E.pooled_precision(rows(spark, sf_dir)).select(F.round("ap", 6).alias("ap"))


@query(f"with g as ({DIGITS.format('orders')}), p as (select o_orderkey, {permuted('at_')} x from (select o_orderkey, row_number() over (order by o_orderkey) - 1 at_ from orders), g) select o_orderkey, x % 16 pile, x // 16 + 1 place from p")
def pile_shuffle(spark, sf_dir):
    return S.shuffled(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 16)


@query(f"select o_orderkey from orders where {scrambled('o_orderkey')} < 100")
def subsample(spark, sf_dir):
    """A tenth; the sample is the feature."""
    return S.subsample(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("with c as (select user_id, count(*) n from events group by 1) select user_id, n, round(1.0::double / n / (select avg(1.0::double / n) from c), 6) w from c")
def inverse_frequency(spark, sf_dir):
    c = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return S.inverse_frequency(c, "n").withColumn("w", F.round("w", 6))


@query("select o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey) r from orders) where r <= 7")
def newest_jobs(spark, sf_dir):
    return D.newest(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", 7).select("o_orderpriority", "o_orderkey")


_LETTERS = "".join(c for c in K.ID_ALPHABET if c.isalpha())
_SIGNS = " || ".join(f"'{x}'[('0x' || substr(h, {2 * i + 1}, 2))::int % {len(x)} + 1]" for i, x in enumerate([_LETTERS] + [K.ID_ALPHABET] * 9))


@query(f"select p_partkey, concat_ws(':', p_brand, p_type, p_partkey::varchar) key, {_SIGNS} id from (select *, sha256(p_partkey::varchar) h from part)")
def job_keys(spark, sf_dir):
    key = K.request_key(F.col("p_brand"), F.col("p_type"), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), K.job_id(F.col("p_partkey")).alias("id"))


@query("select page_id from pages where length(trim(coalesce(url, ''))) > 0 and length(trim(coalesce(case when page_id % 3 <> 0 then html else '  ' end, ''))) > 0")
def with_content(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").withColumn("abstract", F.when(F.col("page_id") % 3 != 0, F.col("html")).otherwise("  "))
    return D.with_content(p, title="url", abstract="abstract").select("page_id")


@query("select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then 1 end, case when o_orderkey % 3 = 0 then 2 end, case when o_orderkey % 5 = 0 then 3 end, 0) d from orders")
def paper_date(spark, sf_dir):
    some = lambda n, v: F.when(F.col("o_orderkey") % n == 0, F.lit(v))
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.paper_date(some(2, 1), some(3, 2), some(5, 3)).alias("d"))


@query("select c_custkey, case when c_custkey % 2 = 0 then c_name || '@x.org' else '~' || c_custkey end author from customer")
def author_key(spark, sf_dir):
    mails = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat("c_name", F.lit("@x.org")), F.lit("other@y.org"))).otherwise(F.array().cast("array<string>"))
    return _table(spark, sf_dir, "customer").select("c_custkey", D.author_key(F.concat(F.lit("~"), F.col("c_custkey").cast("string")), mails, True).alias("author"))


@query("select to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: n_regionkey})::varchar j from nation")
def scalar_json(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").withColumn("list", F.array("n_name"))
    return n.select(D.scalar_json(n).alias("j"))


# Tags are an input; here they follow from the words: lengths 4, 7 and 10 are nouns, 2, 5 and 6 adjectives.
_TAG = "case when length({0}) in (4, 7, 10) then 'NN' when length({0}) in (2, 5, 6) then 'JJ' else 'DT' end"
_PUNCTUATION = r"[!-/:-@\[-`{{-~]*".replace("{{", "{")
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS)


def _tagged(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return words.select("doc_id", "words", F.transform("words", lambda w: F.when(F.length(w).isin(4, 7, 10), "NN").when(F.length(w).isin(2, 5, 6), "JJ").otherwise("DT")).alias("tags"))


@query(f"""with w as (select doc_id, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) i from documents), t as (select *, {_TAG.format('w')} t from w),
n as (select *, min(case when t <> 'JJ' then i * 2 + case when t = 'NN' then 1 else 0 end end) over (partition by doc_id order by i rows between current row and unbounded following) after from t),
c as (select *, coalesce(after % 2 = 1, false) inside from n), r as (select *, i - row_number() over (partition by doc_id, inside order by i) run from c),
p as (select doc_id, run, lower(string_agg(w, '_' order by i)) phrase, min(i) i from r where inside group by 1, 2)
select doc_id, row_number() over (partition by doc_id order by i) at_, phrase from p where phrase not in ({_STOPS}) and not regexp_full_match(phrase, '{_PUNCTUATION}')""")
def noun_chunks(spark, sf_dir):
    chunks = _tagged(spark, sf_dir).select("doc_id", F.posexplode(G.noun_chunks(F.col("words"), F.col("tags"))).alias("at", "phrase"))
    return chunks.select("doc_id", (F.col("at") + 1).cast("long").alias("at_"), "phrase")


@query(f"""with w as (select doc_id, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) i from documents), t as (select *, {_TAG.format('w')} t from w)
select doc_id, lower(w) word, count(*) n from t where t in ('JJ', 'NN') and lower(w) not in ({_STOPS}) and not regexp_full_match(w, '{_PUNCTUATION}') group by 1, 2""")
def tagged_words(spark, sf_dir):
    words = _tagged(spark, sf_dir).select("doc_id", F.explode(G.tagged_words(F.col("words"), F.col("tags"), ["JJ", "NN"])).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


_SHORT = r"""t as (select doc_id, unnest(string_split_regex(text, '\s+')) t from documents), c as (select lower(regexp_replace(t, '\.$', '')) word, count(*)::double n, count(*) filter (suffix(t, '.'))::double a from t where t <> '' group by 1),
a0 as (select sum(n) al, sum(a) en from c), s0 as (select word, n, a, n - a b, en / al p, length(regexp_replace(word, '[^.]', '', 'g')) ins, length(word) - length(regexp_replace(word, '[^.]', '', 'g')) lo from c, a0 where a > 0 and regexp_matches(word, '^[^\d\s]*[\pL][^\d\s]*$')),
short as (select word, -2 * (a * ln(p) + case when b > 0 then b * ln(greatest(1 - p, 1e-12)) else 0 end - (a * ln(0.99::double) + b * ln((1 - 0.99::double)))) * exp(-lo::double) * (ins + 1) * pow(lo::double, -b) score from s0)"""


@query(f"with {_SHORT} select word, round(score, 6) score from short where score >= 0.3")
def abbreviations(spark, sf_dir):
    return G.abbreviations(_table(spark, sf_dir, "documents"), "text").select("word", F.round("score", 6).alias("score"))


@query(rf"""with {_SHORT}, x as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '\n\s*\n', ' ' || chr(57348) || ' ', 'g'), '\s+'), lambda q: q <> '') l from documents),
k as (select doc_id, unnest(l) t, generate_subscripts(l, 1) i from x), nx as (select *, lead(t) over (partition by doc_id order by i) nt from k),
e as (select *, (regexp_matches(t, '[.!?][''"\x{{201d}}\x{{2019}})\]]*$') and not coalesce(regexp_matches(nt, '^\p{{Ll}}'), false) and not regexp_matches(t, '^\pL\.$') and not (suffix(t, '.') and lower(regexp_replace(t, '\.$', '')) in (select word from short where score >= 0.3))) or t = chr(57348) en from nx),
o as (select *, coalesce(sum(en::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) of_ from e),
s as (select doc_id, of_, string_agg(t, ' ' order by i) s from o where t <> chr(57348) group by 1, 2)
select doc_id, row_number() over (partition by doc_id order by of_) at_, md5(s) digest, length(s) n from s""")
def sentences(spark, sf_dir):
    made = G.sentences(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select(F.col("id").alias("doc_id"), F.col("at").alias("at_"), F.md5("sentence").alias("digest"), F.length("sentence").cast("long").alias("n"))
