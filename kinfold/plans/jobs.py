"""Scoring jobs: typed options, and the plan from archives and submissions to sparse scores."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import ID_ALPHABET
from kinfold.operators import postings, retrieval, scoring, topk
from kinfold.operators.blocks import ranked
from kinfold.operators.dataset import WeightRule, venue_weight

MODELS = ("bm25", "vectors", "vectors+vectors")
Scorer = Callable[["JobOptions", DataFrame, DataFrame, DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {}


@dataclass(frozen=True)
class JobOptions:
    """Options of a job; what can't hold raises ValueError."""

    model: str = "vectors"
    average: bool = False
    percentile: float | None = None
    normalize: bool = False
    sparse: int | None = 400
    blend: float = 0.5
    use_title: bool = True
    use_abstract: bool = True
    weights: tuple[WeightRule, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.model not in MODELS and self.model not in SCORERS:
            raise ValueError(f"no model {self.model!r}")
        if self.percentile is not None and not isinstance(self.percentile, int | float):
            raise ValueError("percentile must be a number")
        if self.sparse is not None and self.sparse < 1:
            raise ValueError("sparse must be positive")
        if not 0 <= self.blend <= 1:
            raise ValueError("blend must lie between 0 and 1")
        if not self.use_title and not self.use_abstract:
            raise ValueError("use_title and use_abstract can't both be off")
        if self.weights and self.model == "bm25":
            raise ValueError("bm25 takes no weights")

    @classmethod
    def from_request(cls, request: dict) -> JobOptions:
        """Options of a request: unknown names, and values of another kind than the default's, raise ValueError; weights are given as records."""
        made = dict(request)
        known = {f.name: f for f in fields(cls)}
        for name, value in made.items():
            if name not in known:
                raise ValueError(f"no option {name!r}")
            if name in ("average", "normalize", "use_title", "use_abstract") and not isinstance(value, bool):
                raise ValueError(f"{name} must be true or false")
            if name in ("blend", "percentile", "sparse") and (isinstance(value, bool) or not isinstance(value, int | float | None)):
                raise ValueError(f"{name} must be a number")
        if "weights" in made:
            if not isinstance(made["weights"], list):
                raise ValueError("weights must be a list")
            try:
                made["weights"] = tuple(WeightRule(**w) for w in made["weights"])
            except TypeError as e:
                raise ValueError(f"a weight rule can't be read: {e}") from None
        return cls(**made)

    @property
    def how(self) -> str:
        return f"percentile:{self.percentile}" if self.percentile is not None else "mean" if self.average else "max"


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a way to score; it takes (options, submissions, publications, authorship) and gives sub, rev, s."""

    def keep(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return keep


def _publications(o: JobOptions, pubs: DataFrame) -> DataFrame:
    """Publications with the weight that the rules give them by venue and submitted; of weight 0 they go."""
    if o.weights:
        pubs = pubs.withColumn("w", venue_weight(F.col("venue"), F.col("submitted"), list(o.weights)))
    return pubs.filter(F.coalesce("w", F.lit(1.0)) != 0) if "w" in pubs.columns else pubs


@scorer("vectors")
def by_vectors(o: JobOptions, subs: DataFrame, pubs: DataFrame, authorship: DataFrame, vector: str = "e", sparse: int | None = None) -> DataFrame:
    """subs (sub, e), pubs (pub, e, is_bad, w or venue and submitted): normalised vectors. Extremes are those of all cells, bad ones too; then bad publications go. With ``sparse`` the best so many of each side may be all that comes."""
    pubs = _publications(o, pubs)
    good = authorship.join(pubs.filter("is_bad").select("pub"), "pub", "left_anti") if "is_bad" in pubs.columns else authorship
    ends = scoring.extremes(subs, pubs, vector=vector) if o.normalize else None
    options = {"vector": vector, "ends": ends, "weight": "w" if "w" in pubs.columns else None}
    if o.percentile is not None:
        return scoring.percentile_scores(subs, pubs, good, o.percentile / 100, **options)
    if sparse and o.how == "max":
        return scoring.best_pairs(subs, pubs, good, sparse, **options)
    return scoring.author_scores(subs, pubs, good, o.how, **options)


@scorer("vectors+vectors")
def by_two_vectors(o: JobOptions, subs: DataFrame, pubs: DataFrame, authorship: DataFrame) -> DataFrame:
    """As by vectors, with a second model's in e2: ``blend`` of the first's scores and the rest of the second's, clamped to [0, 1]."""
    first, second = (by_vectors(o, subs, pubs, authorship, v) for v in ("e", "e2"))
    return scoring.blended(first, second, o.blend, clamped=True)


def corpora(o: JobOptions, papers: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """(doc, text) of papers with an abstract, and of others with a title: each kind is a corpus of its own."""
    has = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    abstract = has("abstract") if o.use_abstract else F.lit(False)
    title = (has("title") if o.use_title else F.lit(False)) & ~abstract
    return tuple(papers.filter(test).select(F.col(id_).alias("doc"), F.col(c).alias("text")) for test, c in ((abstract, "abstract"), (title, "title")))


@scorer("bm25")
def by_terms(o: JobOptions, subs: DataFrame, pubs: DataFrame, authorship: DataFrame) -> DataFrame:
    """subs (sub, title, abstract), pubs (pub, title, abstract). A submission with an abstract is held against the
    publications that have one, another by its title against those that have only a title. Every author has a score; 0
    where the corpus has nothing of theirs. A null publication makes an author known who has none."""
    out = None
    for corpus, asked in zip(corpora(o, pubs, "pub"), corpora(o, subs, "sub"), strict=True):
        asked = asked.withColumnRenamed("doc", "q")
        own = authorship.select(F.col("pub").alias("doc"), "rev").join(corpus.select("doc", F.lit(1).alias("in__")), "doc", "left")
        own = own.select("rev", F.when(F.col("in__").isNotNull() & F.col("rev").isNotNull(), F.col("doc")).alias("doc"))
        if o.percentile is None:
            part = postings.by_owner(corpus, asked, own, o.how)
        else:
            scores = retrieval.normalized_by_query(postings.all_scores(corpus, asked), corpus.count())
            part = retrieval.by_owner(scores, asked, own, o.how)
        out = part if out is None else out.union(part)
    return out.select(F.col("q").alias("sub"), "rev", scoring.rounded(F.col("s"), 4).alias("s"))


def best_by_terms(o: JobOptions, subs: DataFrame, pubs: DataFrame, authorship: DataFrame, sparse: int) -> DataFrame:
    """The same scores, of the greatest publication, where they are among the best so many of their submission or author: postings are read in blocks, and no pair that isn't leaves them."""
    found = None
    for corpus, asked in zip(corpora(o, pubs, "pub"), corpora(o, subs, "sub"), strict=True):
        asked = asked.withColumnRenamed("doc", "q")
        weights, cut, avgdl = postings.weighted_queries(corpus, asked)
        ends = postings.score_ends(weights, cut, avgdl)
        own = authorship.select(F.col("pub").alias("doc"), "rev").filter("rev is not null")
        none = own.select("rev").distinct().join(own.join(cut.select("doc"), "doc", "left_semi").select("rev"), "rev", "left_anti")
        part = postings.best_candidates(weights, ends, cut, avgdl, own, sparse).union(postings.without_any(asked, none, sparse))
        found = part if found is None else found.union(part)
    return ranked(found, sparse).select("sub", F.col("who").alias("rev"), "s")


def no_expertise(o: JobOptions, pubs: DataFrame, authorship: DataFrame) -> DataFrame:
    """Authors without a publication that can be scored."""
    a, b = corpora(o, pubs, "pub")
    return retrieval.without_documents(authorship.select(F.col("pub").alias("doc"), "rev"), a.union(b))


def run(o: JobOptions, subs: DataFrame, pubs: DataFrame, authorship: DataFrame) -> DataFrame:
    """Scores of a job, made sparse where asked for: inside the products of blocks where the model can."""
    if o.model == "vectors" and o.sparse:
        s = by_vectors(o, subs, pubs, authorship, sparse=o.sparse)
        return s if o.how == "max" else topk.sparse_topk(s, o.sparse)
    if o.model == "bm25" and o.sparse and o.how == "max":
        return best_by_terms(o, subs, pubs, authorship, o.sparse)
    s = SCORERS[o.model](o, subs, pubs, authorship)
    return topk.sparse_topk(s, o.sparse) if o.sparse else s


def job_id() -> str:
    """A letter and nine more signs, drawn at random."""
    letters = [c for c in ID_ALPHABET if c.isalpha()]
    return secrets.choice(letters) + "".join(secrets.choice(ID_ALPHABET) for _ in range(9))


def request_key(*parts) -> str:
    """Parts of a request that name it, joined by colons; those that are missing are left out, lists in order."""
    flat = [",".join(sorted(map(str, p))) if isinstance(p, list | tuple | set | frozenset) else str(p) for p in parts if p not in (None, "", [], ())]
    return ":".join(flat)
