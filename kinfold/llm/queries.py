"""The queries of the operators, registered in __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, hardneg, jaccard, language, packing, quality, secrets, tiff, tokens, treebpe, trie, warc, wrapper
from .common import documents, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, language, confidence, kept of every document; declared language: lang, host: source."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs)
    rows = docs.select("doc_id", "text", F.lower("lang").alias("declared"), language.host_of(F.col("source")).alias("host"))
    scored = written(language.scored(rows, model, keep=["doc_id", "declared", "host"]), "scores")
    return language.fuse(scored, model, language.gather(scored, model)).select("doc_id", "language", "confidence", "kept")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text (without markup, scripts and styles), declared (the markup's language) and host of pages."""
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")
    return pages.select("page_id", text.alias("text"), language.markup_language(F.col("html")).alias("declared"), language.host_of(F.col("url")).alias("host"))


@_query
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, language, confidence, kept of every page: the text model of the documents, with markup, suffix and hosts of the pages as evidence."""
    model = language.fit(documents(spark, sf_dir))
    scored = written(language.scored(page_evidence(documents(spark, sf_dir, "pages")), model, keep=["page_id", "declared", "host"]), "scores")
    return language.fuse(scored, model, language.gather(scored, model)).select("page_id", "language", "confidence", "kept")


@_query
def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and the verdict of the list learnt from labels.quality."""
    docs = documents(spark, sf_dir)
    rules = quality.learn_from(docs, documents(spark, sf_dir, "labels"))
    judged = quality.judged(quality.with_statistics(docs, keep=["doc_id"]), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "rule")


@_query
def op4_rank_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@_query
def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")
    text = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("secrets", lambda s: s["base"])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


@_query
def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), keep=["doc_id"])


@_query
def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


@_query
def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.with_media(documents(spark, sf_dir), keep=["doc_id"])
    read = tiff.digests(stored, keep=["doc_id", "n_bytes"])
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages", "error")


@_query
def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(documents(spark, sf_dir, "pages"), keep=["page_id", "url"])


@_query
def op6_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, documents(spark, sf_dir, "pages"))


@_query
def op8_count_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


@_query
def op11_blocked_gemm_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hardneg.hard_negatives(rows, F.col("id") % 50 == 0)


@_query
def op12_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(documents(spark, sf_dir), all_digests=True).withColumnRenamed("sha256", "text_sha256")


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    made = trie.trie(trie.grafted(documents(spark, sf_dir, "conversations"), 100, lead, 5))
    return made.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# Base 32 of a digest: every five hexadecimal digits make four characters.
ORACLES["op6_capture_index"] = """
with p as (select page_id, coalesce(html, '') html from pages), h as (select page_id, html, sha1(html) s, min(page_id) over (partition by html) f from p)
select page_id, strlen(html) payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (i * 5 + 1)::int, 5))::bigint >> k) & 31) + 1)::int, 1)), '')), '') payload_digest,
  case when f = page_id then 'response' else 'revisit' end record_type, case when f <> page_id then f end refers_to
from h"""

ORACLES["op8_count_tree_jaccard"] = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.c)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id from d left join n using (doc_id) join (select doc_id, min(c) c from r group by 1) m using (doc_id)"""

ORACLES["op11_blocked_gemm_negatives"] = """
with v as (select vec_id::bigint id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint label, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id a, b.id b, a.label = b.label same, list_dot_product(a.v, b.v)::bigint s from v a join v b on a.id <> b.id where a.id % 50 = 0),
p as (select a, b, s from (select *, row_number() over (partition by a order by s desc, b) r from s where same) where r <= 5),
n as (select p.a, p.b, p.s, s.b nb, s.s ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) r from p join s on s.a = p.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a anchor_id, b positive_id, r::int "rank", nb negative_id, s positive_score, ns negative_score from n where r <= 3"""

ORACLES["op12_progressive_dedup"] = r"""
with d as (select doc_id, length(coalesce(text, '')) c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by t) group_size, row_number() over w = 1 kept, sha256(t) text_sha256
from d window w as (partition by t order by c desc, doc_id nulls last rows between unbounded preceding and unbounded following)"""

# crc32 byte by byte, from its table of 256, which is worked out bit by bit
ORACLES["op13_prefix_trie"] = """
with recursive bits(i, v, s) as (select i, i, 0 from range(256) r(i) union all select i, xor(v >> 1, 3988292384 * (v & 1)), s + 1 from bits where s < 8),
crc as (select list(v order by i) t from bits where s = 8),
own as (select conv_id c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) l from conversations where conv_id is not null group by 1),
lead_ as (select c, l, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 h from own cross join crc),
made as (select x.c, list_concat(coalesce(b.l, [])[1:x.h], x.l[x.h + 1:]) l from lead_ x left join own b on b.c = x.c - x.c % 100),
pre as (select c, d, l[1:d] p, d = len(l) whole, case when d > 0 then length(l[d].text) else 0 end n from (select c, l, unnest(range(0, len(l) + 1)) d from made)),
node as (select d, p, min(c) c, count(*) k, any_value(n) n, coalesce(string_agg(c::varchar, ',' order by c) filter (whole), '') e from pre group by 1, 2),
kids as (select x.d, x.p, count(y.c) kids from node x left join node y on y.d = x.d + 1 and y.p[1:x.d] = x.p group by 1, 2),
sub as (select x.d, x.p, count(*) filter (z.kids = 0) leaves, sum((y.k - 1) * y.n) saved from node x join node y on y.d >= x.d and y.p[1:x.d] = x.p join kids z on z.d = y.d and z.p = y.p group by 1, 2)
select x.c conv_id, x.d depth, u.c parent_conv_id, x.k n_convs, kids n_children, leaves n_leaves, saved::bigint saved_tokens, sha256(x.e) ends_sha256
from node x join kids using (d, p) join sub using (d, p) left join node u on u.d = x.d - 1 and u.p = x.p[1:x.d - 1]"""
