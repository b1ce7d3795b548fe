"""Vectors from an injected model, with the cache in front; facet coefficients in six ways; sampled options."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import cache as C


def embed(papers: DataFrame, infer: Callable[[list[str]], np.ndarray], *, id_: str = "paper_id", text: str = "text", batch: int = 16) -> DataFrame:
    """paper_id, embedding: ``infer`` gets ``batch`` texts at a time and returns a row for each; a null text gives no vector (an empty array)."""
    frame = papers.select(F.col(id_).cast("string").alias("paper_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            out: list[list[float]] = [[] for _ in texts]
            some = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                for i, v in zip(part, np.asarray(infer([texts[i] for i in part]), np.float64), strict=True):
                    out[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float64()))], names=["paper_id", "embedding"])

    return frame.mapInArrow(run, "paper_id string, embedding array<double>")


def embed_missing(papers: DataFrame, cache: DataFrame, model: str, infer: Callable[[list[str]], np.ndarray], **options) -> tuple[DataFrame, DataFrame]:
    """Vectors of all papers (paper_id, mdate, text), cached ones where fresh; and by themselves those that are new."""
    new = embed(C.missing(cache, papers, model), infer, **options)
    held = C.lookup(cache, papers, [model]).select("paper_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return held.unionByName(new), new


def coefficients(p: np.ndarray, g: np.ndarray, method: str = "lc", *, rounds: int = 60, l1: float = 0.0, most: float = 1.0) -> np.ndarray:
    """A row of facets' coefficients for each target, from the targets' products with the facets (p) and the facets' with one another (g).

    lc, sgd_bmm: least squares with weights in [0, most] and an l1 penalty, by projected gradient. prod: the greatest
    product less the penalty, scaled to a sum of 1, at the place where gradient steps with that scaling come to rest.
    max: the facet of greatest cosine, its factor in [0, 1]. max_cos: the facet of greatest factor, which has no bound.
    max_iter: twice the facet of greatest factor for what is left, not below 0. softmax: by the product with the unit facet.
    """
    own = np.maximum(np.diag(g), 1e-300)
    made, rows = np.zeros_like(p), np.arange(len(p))
    if method in ("lc", "sgd_bmm"):
        step = 1.0 / max(float(np.linalg.eigvalsh(g)[-1]), 1e-12)
        made += 0.5 * most / max(len(g), 1)
        for _ in range(rounds):
            made = np.clip(made - step * (made @ g - p + l1), 0.0, most)
    elif method == "prod":
        pull = np.maximum(p - l1, 0.0)
        made = pull / np.maximum(pull.sum(1, keepdims=True), 1e-300)
    elif method == "max":
        at = (p / np.sqrt(own)).argmax(1)
        made[rows, at] = np.clip((p / own)[rows, at], 0.0, 1.0)
    elif method == "max_cos":
        at = (p / own).argmax(1)
        made[rows, at] = (p / own)[rows, at]
    elif method == "max_iter":
        for _ in range(2):
            factor = (p - made @ g) / own
            at = factor.argmax(1)
            made[rows, at] += np.maximum(factor[rows, at], 0.0)
    elif method == "softmax":
        x = p / np.sqrt(own)
        made = np.exp(x - x.max(1, keepdims=True))
        made /= made.sum(1, keepdims=True)
    else:
        raise ValueError(f"no way to fit facets is called {method}")
    return made


def gradient_fit(bases: np.ndarray, target: np.ndarray, rounds: int = 60, most: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients in [0, most] of the facets (rows of ``bases``) nearest to the target, by projected gradient, and the squared distance."""
    c = coefficients((bases @ target)[None], bases @ bases.T, "lc", rounds=rounds, most=most)[0]
    return c, float(((c @ bases - target) ** 2).sum())


def _packed(df: DataFrame, id_: str, value: Column, name: str, rows: int) -> DataFrame:
    """Rows of at most ``rows`` ids each, with their vectors in one matrix and how many vectors each id has; ``value`` is an array of vectors."""
    kind = dict(df.dtypes)[id_]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                held = part.column(1)
                flat = held.flatten().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                sizes = pa.array([[len(x) for x in held]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), sizes, pa.array([flat.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_sizes", f"{name}_matrix"])

    return df.select(F.col(id_), value.alias("v")).mapInArrow(pack, f"{name}_ids array<{kind}>, {name}_sizes array<int>, {name}_matrix binary")


def facet_distances(facets: DataFrame, targets: DataFrame, *, method: str = "lc", rounds: int = 60, l1: float = 0.0, block: int = 256) -> DataFrame:
    """sub, rev, d for targets (sub, e) and authors' facets (rev, facets: array of vectors): the squared distance of each
    target from the author's facets, mixed as ``coefficients`` says. Every author is scored for every target, which is
    what is asked for; only blocks meet blocks, and what is fitted are their products."""
    both = _packed(targets, "sub", F.array("e"), "a", block).crossJoin(_packed(facets, "rev", F.col("facets"), "b", block))
    kind_a, kind_b = dict(targets.dtypes)["sub"], dict(facets.dtypes)["rev"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids_a, ids_b = (b.column(b.schema.get_field_index(n)) for n in ("a_ids", "b_ids"))
            for i, row in enumerate(b.select(["b_sizes", "a_matrix", "b_matrix"]).to_pylist()):
                subs, revs, total = ids_a[i].values, ids_b[i].values, sum(row["b_sizes"])
                if not total:
                    continue
                x = np.frombuffer(row["a_matrix"]).reshape(len(subs), -1)
                y = np.frombuffer(row["b_matrix"]).reshape(total, -1)
                products, length, end = x @ y.T, (x * x).sum(1), 0
                for j, size in enumerate(row["b_sizes"]):
                    at, end = end, end + size
                    if not size:
                        continue
                    p, g = products[:, at:end], y[at:end] @ y[at:end].T
                    c = coefficients(p, g, method, rounds=rounds, l1=l1)
                    d = np.maximum(length - 2 * (c * p).sum(1) + ((c @ g) * c).sum(1), 0.0)
                    yield pa.RecordBatch.from_arrays([subs, revs.take(pa.array([j] * len(subs))), pa.array(d)], names=["sub", "rev", "d"])

    return both.mapInArrow(run, f"sub {kind_a}, rev {kind_b}, d double")


def facet_scores(distances: DataFrame, special: int = 0) -> DataFrame:
    """sub, rev, s of facets' distances (sub, rev, d): 1 - d, under an author's name up to a bar (what follows tells its
    facets or roles apart). Authors of the first ``special`` places of a vocabulary (``idx``) stand for no one and are left out."""
    some = distances.filter(F.col("idx") >= special) if special else distances
    return some.select("sub", F.substring_index(F.col("rev").cast("string"), "|", 1).alias("rev"), (1.0 - F.col("d")).alias("s"))


def sampled(space: dict[str, object], n: int, seed: int = 0) -> list[dict]:
    """n candidates drawn from the space: a pair of floats is a range, a pair of whole numbers one without its end, a list a choice; anything else is taken as it is."""
    draw, made = random.Random(seed), []
    for _ in range(n):
        one = {}
        for name, v in space.items():
            if isinstance(v, tuple) and all(isinstance(x, int) for x in v):
                one[name] = draw.randrange(*v)
            elif isinstance(v, tuple):
                one[name] = draw.uniform(*v)
            else:
                one[name] = draw.choice(v) if isinstance(v, list) else v
        made.append(one)
    return made


def best_options(candidates: list[dict], evaluate: Callable[[dict], DataFrame]) -> DataFrame:
    """The candidates with their figures, best first: ``evaluate`` gives a frame whose only row and column is the loss. All are evaluated in one plan."""
    out = None
    for i, c in enumerate(candidates):
        one = evaluate(c).toDF("loss").select(F.lit(i).alias("candidate"), F.lit(str(c)).alias("options"), "loss")
        out = one if out is None else out.union(one)
    return out.orderBy("loss", "candidate")


def phrase_vectors(phrases: DataFrame, vectors: DataFrame, phrase: str = "phrase", word: str = "word", vector: str = "e", skip: list[str] | None = None) -> DataFrame:
    """phrase, pos, v: by phrase, its words' vectors (words are joined by _) over the number of its words; ``skip`` are words that don't count. Phrases without any known word aren't listed."""
    words = F.filter(F.split(F.lower(phrase), "_"), lambda w: ~w.isin(skip)) if skip else F.split(F.lower(phrase), "_")
    each = phrases.select(phrase).distinct().select(phrase, F.size(words).alias("n__"), F.explode(words).alias(word))
    cells = each.join(vectors.select(word, vector), word).select(phrase, "n__", F.posexplode(vector).alias("pos", "x__"))
    return cells.groupBy(phrase, "n__", "pos").agg(F.sum("x__").alias("sum__")).select(phrase, "pos", (F.col("sum__") / F.col("n__")).alias("v"))
