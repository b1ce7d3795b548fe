"""Scalar functions as Column builders: text, vectors, scores. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- text

#: Words that carry no topic.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these
those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def content_to_text(*fields: Column) -> Column:
    """Fields joined by a space; a missing one counts as empty."""
    return F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])


def strip_nonalpha(text: Column) -> Column:
    """Lower case, letters a-z and single spaces as they stand."""
    return F.regexp_replace(F.lower(text), "[^a-z ]", "")


def space_tokens(text: Column) -> Column:
    """Lower case, split at every single space; empty tokens stay."""
    return F.split(F.lower(text), " ", -1)


def paperhash(title: Column) -> Column:
    """Letters and digits of the title in lower case; words joined by an underscore."""
    words = F.filter(F.split(F.lower(title), "[^a-z0-9]+", -1), lambda w: w != "")
    return F.array_join(words, "_")


def model_text(title: Column, abstract: Column, use_title: bool = True) -> Column:
    """The abstract where it has text, else the title if titles count, else null."""
    full = F.length(F.trim(F.coalesce(abstract, F.lit("")))) > 0
    return F.when(full, F.trim(abstract)).when(F.lit(use_title) & (F.length(F.trim(F.coalesce(title, F.lit("")))) > 0), F.trim(title))


def title_sep_abstract(title: Column, abstract: Column, sep: str = "[SEP]") -> Column:
    """Model input of two fields; a blank field becomes a full stop, and null if both are blank."""
    t, a = (F.trim(F.coalesce(x, F.lit(""))) for x in (title, abstract))
    dot = lambda x: F.when(x == "", F.lit(".")).otherwise(x)
    return F.when((t != "") | (a != ""), F.concat(dot(t), F.lit(sep), dot(a)))


def unwrap(json: Column, field: str) -> Column:
    """A field that may be wrapped as {"value": x}."""
    return F.coalesce(F.get_json_object(json, f"$.{field}.value"), F.get_json_object(json, f"$.{field}"))


def venue_key(name: Column) -> Column:
    """A group's name up to its last slash."""
    return F.regexp_replace(name, "/[^/]*$", "")


def invitation_prefix(invitation: Column) -> Column:
    return F.split(invitation, "/-/", 2)[0]


def trailing_timestamp(job_id: Column) -> Column:
    """The digits after the last hyphen, else null."""
    return F.nullif(F.regexp_extract(job_id, "-([0-9]+)$", 1), F.lit("")).try_cast("bigint")


def sanitized(name: Column) -> Column:
    return F.lower(F.translate(name, "/:_.", "----"))


def fixed_width(items: Column, n: int, pad: Column) -> Column:
    """An array cut or filled up to n items."""
    return F.slice(F.concat(items, F.array_repeat(pad, n)), 1, n)


def snake_case(name: str) -> str:
    import re

    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def typed_tokens(title: Column, abstract: Column, mark: str = "<SEP>", most: int = 512) -> tuple[Column, Column]:
    """Tokens of title and abstract, each ended by the mark, and their types (0 title, 1 abstract); beyond ``most`` the last token takes the last place."""
    end = F.array(F.lit(mark))
    none = F.array().cast("array<string>")
    first, second = F.concat(F.coalesce(title, none), end), F.concat(F.coalesce(abstract, none), end)

    def cut(a: Column) -> Column:
        return F.when(F.size(a) <= most, a).otherwise(F.concat(F.slice(a, 1, most - 1), F.slice(a, -1, 1)))

    return cut(F.concat(first, second)), cut(F.concat(F.array_repeat(F.lit(0), F.size(first)), F.array_repeat(F.lit(1), F.size(second))))


def request_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


#: The signs of a job's id, without those that look alike.
ID_ALPHABET = "123456789abcdefghijkmnopqrstuvwxyz"


def job_id(seed: Column) -> Column:
    """Ten signs that the seed settles: a letter, then nine of the whole alphabet."""
    digest = F.sha2(seed.cast("string"), 256)
    letters = "".join(c for c in ID_ALPHABET if c.isalpha())

    def sign(i: int, among: str) -> Column:
        n = F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
        return F.substring(F.lit(among), n % len(among) + 1, F.lit(1))

    return F.concat(sign(0, letters), *[sign(i, ID_ALPHABET) for i in range(1, 10)])


# ---- vectors


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def l2_normalized(a: Column) -> Column:
    return F.transform(a, lambda x: x / (norm(a) + F.lit(1e-12)))


def zero_filled(a: Column, dimensions: int) -> Column:
    """A vector of zeros where there is none (null or empty)."""
    return F.when(F.size(F.coalesce(a, F.array())) == 0, F.array_repeat(F.lit(0.0), dimensions)).otherwise(a)


def facet_fit(base: Column, target: Column) -> tuple[Column, Column]:
    """Cosine of base and target, and the squared distance after the base is scaled by its best factor in [0, 1]."""
    xx = F.aggregate(base, F.lit(0.0), lambda s, x: s + x * x)
    c = F.least(F.greatest(F.coalesce(dot(base, target) / F.nullif(xx, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return cosine(base, target), F.aggregate(F.zip_with(base, target, lambda x, y: (c * x - y) * (c * x - y)), F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(a: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    raised = _once(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return _once(raised, lambda v: _once(total(v), lambda t: F.transform(v, lambda x: x / t)))


def smoothed_weight(share: Column, alpha: float) -> Column:
    """How much more than a uniform draw an item counts: (alpha + share) / alpha; 1 where alpha is 0."""
    return F.lit(1.0) if not alpha else (F.lit(float(alpha)) + share) / F.lit(float(alpha))


def entropy(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def overlap(found: Column, wanted: Column) -> tuple[Column, Column, Column]:
    """Recall, precision and F1 of one set against another; 0 where there is nothing to divide by."""
    both = F.size(F.array_intersect(found, wanted)).cast("double")
    share = lambda n: F.coalesce(both / F.nullif(n, F.lit(0)), F.lit(0.0))
    return share(F.size(wanted)), share(F.size(found)), F.coalesce(2 * both / F.nullif(F.size(found) + F.size(wanted), F.lit(0)), F.lit(0.0))


# ---- scores


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit_weighted(score: Column, weight: Column, eps: float = 1e-8) -> Column:
    """sigmoid(logit(s) + ln w), as w s / (1 - s + w s)."""
    s, w = clamp(score, eps, 1 - eps), F.greatest(weight, F.lit(eps))
    return w * s / (F.lit(1.0) - s + w * s)


def rounded(x: Column, digits: int = 4) -> Column:
    """Half-even."""
    return F.bround(x, digits)
