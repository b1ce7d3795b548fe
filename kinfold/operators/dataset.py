"""Building datasets: cleaning, one paper per title, selections, recency, weights, members."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def effective_cdate(pdate: Column, cdate: Column, tcdate: Column) -> Column:
    return F.coalesce(pdate, cdate, tcdate, F.lit(0))


def paper_date(pdate: Column, odate: Column, cdate: Column) -> Column:
    return F.coalesce(pdate, odate, cdate, F.lit(0))


def public_only(notes: DataFrame, readers: str = "readers") -> DataFrame:
    """Notes that everyone, and nobody by name, may read."""
    return notes.filter(F.col(readers) == F.array(F.lit("everyone")))


def with_content(notes: DataFrame, *, title: str | None = None, abstract: str | None = None) -> DataFrame:
    for c in (title, abstract):
        if c:
            notes = notes.filter(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    return notes


def matching_content(notes: DataFrame, json: str, wanted: dict[str, str]) -> DataFrame:
    """Notes whose content has every wanted value; values may be wrapped."""
    from kinfold.functions import unwrap

    for k, v in wanted.items():
        notes = notes.filter(unwrap(F.col(json), k) == F.lit(v))
    return notes


def best_paper(papers: DataFrame, keys: list[str], *, abstract: Column, date: Column, order: str) -> DataFrame:
    """One paper a key: one with an abstract before one without, then the later, then the first in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.length(F.trim(F.coalesce(abstract, F.lit("")))) > 0), F.desc(date), order)
    return papers.withColumn("r__", F.row_number().over(w)).filter("r__ = 1").drop("r__")


def without_originals(papers: DataFrame, id_: str = "id", original: str = "original") -> DataFrame:
    """Papers that no other names as its original."""
    return papers.join(papers.select(F.col(original).alias(id_)).filter(F.col(id_).isNotNull()).distinct(), id_, "left_anti")


def excluded(papers: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    return papers.join(edges.select(*keys).distinct(), keys, "left_anti")


def included(papers: DataFrame, edges: DataFrame, keys: list[str], author: str, fallback: bool = True) -> DataFrame:
    """Papers chosen by their author's edges; an author without edges keeps all, and so does one (with ``fallback``) whose edges hit nothing."""
    e = edges.select(*keys).distinct()
    marked = papers.join(e.withColumn("hit__", F.lit(1)), keys, "left")
    hits = marked.groupBy(author).agg(F.count("hit__").alias("hits__"))
    if fallback:
        return marked.join(hits, author).filter(F.col("hit__").isNotNull() | (F.col("hits__") == 0)).drop("hit__", "hits__")
    having = e.select(author).distinct().withColumn("has__", F.lit(1))
    return marked.join(having, author, "left").filter(F.col("hit__").isNotNull() | F.col("has__").isNull()).drop("hit__", "has__")


def recent(papers: DataFrame, author: str, date: str, id_: str, *, top: int | str | None = None, since: int | Column | None = None, either: bool = False) -> DataFrame:
    """The newest papers of each author: ``top`` many (or "10%" of them, rounded up), and/or those not before ``since``; ``either`` takes the longer of both lists."""
    w = Window.partitionBy(author)
    rn = F.row_number().over(w.orderBy(F.desc(date), id_))
    tests = []
    out = papers
    if top is not None:
        out = out.withColumn("r__", rn)
        if isinstance(top, str):
            out = out.withColumn("n__", F.count("*").over(w))
            tests.append(F.col("r__") <= F.ceil(F.lit(float(top.rstrip("%"))) / 100 * F.col("n__")))
        else:
            tests.append(F.col("r__") <= top)
    if since is not None:
        tests.append(F.col(date) >= since)
    if not tests:
        return papers
    keep = tests[0] if len(tests) == 1 else (tests[0] | tests[1]) if either else (tests[0] & tests[1])
    return out.filter(keep).drop("r__", "n__")


@dataclass(frozen=True)
class WeightRule:
    """Exactly one of prefix, value and submitted; weight is not negative."""

    weight: float
    prefix: str | None = None
    value: str | None = None
    submitted: bool | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.prefix, self.value, self.submitted)) != 1:
            raise ValueError("a weight rule needs exactly one of prefix, value and submitted")
        if isinstance(self.weight, bool) or not isinstance(self.weight, int | float) or self.weight < 0:
            raise ValueError("a weight must be a number that isn't negative")


def venue_weight(venue: Column, submitted: Column, rules: list[WeightRule]) -> Column:
    """The first matching rule of the strongest kind: prefix, then value, then submitted; 1 where none matches."""
    made = None
    for kind in ("prefix", "value", "submitted"):
        for r in rules:
            x = getattr(r, kind)
            if x is None:
                continue
            test = venue.startswith(x) if kind == "prefix" else venue == x if kind == "value" else submitted == F.lit(x)
            made = F.when(test, F.lit(float(r.weight))) if made is None else made.when(test, F.lit(float(r.weight)))
    return F.lit(1.0) if made is None else made.otherwise(F.lit(1.0))


def rule_table(spark: SparkSession, rules: list[WeightRule]) -> DataFrame:
    """kind, key, weight, place of rules, as ``with_venue_weight`` takes them."""
    kinds = ("prefix", "value", "submitted")
    made = [(k, str(getattr(r, k)).lower() if k == "submitted" else getattr(r, k), float(r.weight), i) for i, r in enumerate(rules) for k in kinds if getattr(r, k) is not None]
    return spark.createDataFrame(made, "kind string, key string, weight double, place long")


def with_venue_weight(rows: DataFrame, rules: DataFrame, *, prefix: Column, value: Column, submitted: Column, name: str = "w") -> DataFrame:
    """Adds the weight of the first rule (by ``place``) of the strongest kind that a row meets: ``prefix`` begins with the
    rule's key, ``value`` is its key, or it is about ``submitted``; 1 where none does.

    Rules are a table of any length. Different venues, not rows, meet it, and by equality alone: a venue stands once for
    each length that prefixes have. Of equal rules the first stands.
    """
    rank = {"prefix": 0, "value": 1, "submitted": 2}
    order = F.struct(F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)])[F.col("kind")].alias("kind"), F.col("place"))
    first = rules.groupBy("kind", "key").agg(F.min(F.struct(order.alias("order"), F.col("weight"))).alias("rule"))
    lengths = rules.filter("kind = 'prefix'").agg(F.coalesce(F.collect_set(F.length("key")), F.array().cast("array<int>")).alias("lengths__"))  # one row: as many as there are lengths
    marked = rows.withColumns({"p__": prefix, "v__": value, "s__": submitted})
    venues = marked.select("p__", "v__", "s__").distinct().crossJoin(F.broadcast(lengths))
    at = F.filter("lengths__", lambda n: F.length("p__") >= n)
    keys = F.concat(
        F.transform(at, lambda n: F.struct(F.lit("prefix").alias("kind"), F.substring(F.col("p__"), F.lit(1), n).alias("key"))),
        F.array(F.struct(F.lit("value").alias("kind"), F.col("v__").alias("key")), F.struct(F.lit("submitted").alias("kind"), F.col("s__").cast("string").alias("key"))),
    )
    met = venues.select("p__", "v__", "s__", F.explode(keys).alias("k")).select("p__", "v__", "s__", "k.*").join(first, ["kind", "key"])
    best = met.groupBy("p__", "v__", "s__").agg(F.min("rule").alias("rule")).select(*[F.col(c).alias(f"{c}of") for c in ("p__", "v__", "s__")], F.col("rule.weight").alias("weight__"))
    same = F.lit(True)
    for c in ("p__", "v__", "s__"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}of"))
    return marked.join(best, same, "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("weight__", F.lit(1.0)).alias(name))


def member_kind(member: Column) -> Column:
    """profile for ids with a tilde, email (to be lower-cased) for those with an at sign, else null."""
    return F.when(member.startswith("~"), F.lit("profile")).when(member.contains("@"), F.lit("email"))


def members(*sources: DataFrame) -> DataFrame:
    """Distinct members of several sources, e-mails in lower case."""
    out = sources[0]
    for s in sources[1:]:
        out = out.union(s)
    m = F.col(out.columns[0])
    return out.filter(member_kind(m).isNotNull()).select(F.when(member_kind(m) == "email", F.lower(m)).otherwise(m).alias("member")).distinct()


def upsert(sources: list[DataFrame], id_: str) -> DataFrame:
    """Union of sources; for an id the last source that has it stands."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("p__", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    w = Window.partitionBy(id_).orderBy(F.desc("p__"))
    return tagged.withColumn("r__", F.row_number().over(w)).filter("r__ = 1").drop("r__", "p__")


def metadata(submissions: DataFrame, archives: DataFrame, members_: DataFrame, author: str) -> DataFrame:
    """One row: submission_count, archives_count, no_publications_count."""
    have = archives.select(author).distinct()
    none = members_.join(have, author, "left_anti").agg(F.count("*").alias("no_publications_count"))
    return submissions.agg(F.count("*").alias("submission_count")).join(archives.agg(F.count("*").alias("archives_count"))).join(none)


def without_publications(members_: DataFrame, archives: DataFrame, author: str) -> DataFrame:
    """Members of whom the archives have nothing."""
    return members_.select(author).distinct().join(archives.select(author), author, "left_anti")


def archive_papers(archives: DataFrame, *, author: str = "author", id_: str = "id", title: str = "title", abstract: str = "abstract", mdate: str = "mdate", weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, authorship) of archives, a row an author and publication. Publications with neither a title nor an abstract
    go; a paper stands once, with its authors in order, what is blank as a full stop, as the first of its authors has it,
    at its latest date. Its weight is the last author's, 1 where they have none."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    dot = lambda x: F.when(x == "", F.lit(".")).otherwise(x)
    some = archives.withColumns({"t__": text(title), "a__": text(abstract)}).filter("t__ <> '' or a__ <> ''")
    authorship = some.select(F.col(id_).alias("pub"), F.col(author).alias("rev")).distinct()
    value = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    first = F.min(F.struct(F.col(author).alias("who"), "t__", "a__"))
    papers = some.groupBy(F.col(id_).alias("pub")).agg(first.alias("x__"), F.max(mdate).alias("mdate"), F.max_by(value, F.col(author)).alias("w"), F.array_sort(F.collect_set(author)).alias("authors"))
    return papers.select("pub", dot(F.col("x__.t__")).alias("title"), dot(F.col("x__.a__")).alias("abstract"), "mdate", "authors", "w"), authorship


def machine_tier(notes: Column, small: int = 10_000, medium: int = 200_000) -> Column:
    return F.when(notes < small, F.lit("small")).when(notes < medium, F.lit("medium")).otherwise(F.lit("large"))


def search_jobs(jobs: DataFrame, prefixes: dict[str, str], owner: str | None = None, owner_column: str = "owner", superuser: str | None = None) -> DataFrame:
    """Jobs whose columns begin with the given text, whatever the case; all conditions hold, and an empty one always does.

    A dotted name is a field of an entity. A name that only the entities (structs entityA and entityB) have is looked for
    in the first where it isn't empty. ``owner`` sees only theirs; ``superuser``, and None, see all.
    """
    for c, p in prefixes.items():
        fields = [f"{e}.{c}" for e in ("entityA", "entityB") if c not in jobs.columns and e in jobs.columns and c in jobs.schema[e].dataType.names]
        value = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields or [c]], F.lit(""))
        jobs = jobs.filter(F.lower(value).startswith(p.lower()))
    return jobs if owner is None or owner == superuser else jobs.filter(F.col(owner_column) == owner)


class ExpectedDataError(ValueError):
    """Data that a job can't do without isn't there: the fault is in what was asked for."""


def required(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ExpectedDataError(f"no {what} found")
    return df


def notes_of(notes: DataFrame, *, invitations: list[str] | None = None, venueid: str | None = None, ids: list | None = None, id_: str = "id") -> DataFrame:
    """Notes of some invitations (and of the venue, if one is named too), or else of the venue; and besides those of the given ids. Columns: invitation, venueid."""
    if not invitations and venueid is None and not ids:
        raise ValueError("notes are asked for by invitation, venueid or id")
    test = F.lit(False)
    if invitations:
        test = F.col("invitation").isin(invitations) & (F.lit(True) if venueid is None else F.col("venueid") == venueid)
    elif venueid is not None:
        test = F.col("venueid") == venueid
    return notes.filter(F.coalesce(test, F.lit(False)) | (F.col(id_).isin(ids) if ids else F.lit(False)))


def profiles_of(members_: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, profile) of members that have a profile, by its id or by one of its e-mails in lower case, and (member) of
    those that have none. Of several profiles with one e-mail the least stands. profiles: profile, emails."""
    mails = profiles.select("profile", F.explode("emails").alias("member")).groupBy(F.lower("member").alias("member")).agg(F.min("profile").alias("profile"))
    names = profiles.select(F.col("profile").alias("member"), "profile").distinct()
    kind = member_kind(F.col("member"))
    key = F.when(kind == "email", F.lower("member")).otherwise(F.col("member"))
    every = members_.select(key.alias("member")).distinct().join(names.union(mails), "member", "left")
    return every.filter("profile is not null").select("member", "profile"), every.filter("profile is null").select("member")


def bid_publications(notes: DataFrame, bids: DataFrame, labels: list[str], *, paper: str = "id", author: str = "author", label: str = "label") -> DataFrame:
    """Notes as publications of those who bid one of the labels for them, each once."""
    chosen = bids.filter(F.col(label).isin(labels)).select(author, paper).distinct()
    return chosen.join(notes, paper)


def edge_sets(edges: DataFrame, tail: str, head: str) -> DataFrame:
    """tail, papers: the different heads of each tail's edges, in order."""
    return edges.groupBy(tail).agg(F.array_sort(F.collect_set(head)).alias("papers"))


def without_zero_weight(papers: DataFrame, weight: str) -> DataFrame:
    return papers.filter(F.coalesce(F.col(weight), F.lit(1.0)) != 0)


def with_hash(papers: DataFrame, hash_: Column) -> DataFrame:
    """Papers whose title leaves something to tell them by."""
    return papers.filter(F.coalesce(hash_, F.lit("")) != "")


def note_domain(domain: Column, invitation: Column, invitations: Column) -> Column:
    """The note's own domain, else the prefix of its invitation, else that of the first of its invitations."""
    prefix = lambda c: F.split(c, "/-/", 2)[0]
    return F.coalesce(domain, prefix(invitation), prefix(F.get(invitations, F.lit(0))))


def author_key(profile: Column, emails: Column, use_email: bool) -> Column:
    """The preferred (first) e-mail where e-mails name authors and there is one, else the profile."""
    return F.coalesce(F.get(emails, F.lit(0)), profile) if use_email else profile


def scalar_json(df: DataFrame) -> Column:
    """A row's plain values as JSON: text, numbers and truth values; lists, maps and records are left out."""
    from pyspark.sql.types import BooleanType, NumericType, StringType

    return F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, NumericType | StringType | BooleanType)]))


def newest(jobs: DataFrame, venue: str, date: str, id_: str, n: int) -> DataFrame:
    """The n latest jobs of each venue; the lesser id among equals."""
    w = Window.partitionBy(venue).orderBy(F.desc(date), id_)
    return jobs.withColumn("r__", F.row_number().over(w)).filter(F.col("r__") <= n).drop("r__")
