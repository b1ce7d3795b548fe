"""Requests' entities as columns: what is wrong with one, and how it is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of an entity beside its type.
FIELDS = {
    "memberOf": "string", "reviewerIds": "array<string>", "expertise": "string", "id": "string", "invitation": "string", "withVenueid": "string",
    "submissions": "array<string>", "withContent": "map<string,string>", "submissionIds": "array<string>",
}
ENTITY = "struct<type:string," + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
#: By type, the fields of which one names the entity, the first that is there; and those that may come with it.
NAMING = {"Group": ("memberOf", "reviewerIds"), "Note": ("invitation", "withVenueid", "id", "submissions")}
BESIDE = {"Group": ("expertise",), "Note": ("withContent", "submissionIds")}


def _has(entity: Column, field: str) -> Column:
    return entity[field].isNotNull()


def fault(entity: Column) -> Column:
    """Null for an entity that can be used, else what is wrong: no type, a type of no kind, an id beside an invitation or venue, nothing to name it by, or fields that its kind doesn't take, in order."""
    kind = entity["type"]
    made = F.when(kind.isNull(), F.lit("type is missing")).when(~kind.isin(*NAMING), F.concat(F.lit("no such type: "), kind))
    made = made.when((kind == "Note") & _has(entity, "id") & (_has(entity, "invitation") | _has(entity, "withVenueid")), F.lit("id beside invitation or venue"))
    for name, naming in NAMING.items():
        some = F.lit(False)
        for f in naming:
            some = some | _has(entity, f)
        made = made.when((kind == name) & ~some, F.lit("nothing to name it by"))
        taken = None
        for f in naming:
            taken = F.when(_has(entity, f), F.lit(f)) if taken is None else taken.when(_has(entity, f), F.lit(f))
        present = F.array_compact(F.array(*[F.when(_has(entity, f), F.lit(f)) for f in sorted(FIELDS)]))
        extra = F.filter(present, lambda f: (f != taken) & ~f.isin(*BESIDE[name]))  # noqa: B023
        made = made.when((kind == name) & (F.size(extra) > 0), F.concat(F.lit("unexpected: "), F.array_join(extra, ",")))
    return made


def names(entity: Column, prefix: bool = False, separator: str = ":") -> Column:
    """All that an entity is named by, as an array: a group by what it is of or how many people it lists, a note by its id,
    invitation, venue, content and how many submissions it lists. ``prefix`` gives the kinds of a note's names instead.
    Null for an entity without a type."""
    count = lambda word, field: F.when(_has(entity, field), F.concat(F.lit(word + separator), F.size(entity[field]).cast("string")))
    any_ = lambda fields: [_has(entity, f) for f in fields]

    def none(kind: str, fields: tuple[str, ...]) -> Column:
        some = any_(fields)[0]
        for x in any_(fields)[1:]:
            some = some | x
        return F.when(~some, F.lit(f"unknown{kind}"))

    group = F.array_compact(F.array(entity["memberOf"], count("reviewers", "reviewerIds"), none("Group", NAMING["Group"])))
    if prefix:
        first = [F.concat(F.lit("pid-"), entity["id"]), F.when(_has(entity, "invitation"), F.lit("inv")), F.when(_has(entity, "withVenueid"), F.lit("venueid"))]
        content = F.when(F.size(F.coalesce(entity["withContent"], F.create_map().cast("map<string,string>"))) > 0, F.array(F.lit("withContent")))
    else:
        first = [entity["id"], entity["invitation"], entity["withVenueid"]]
        content = F.transform(F.map_entries(entity["withContent"]), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    nothing = F.array().cast("array<string>")
    note = F.concat(F.array_compact(F.array(*first)), F.coalesce(content, nothing), F.array_compact(F.array(count("submissions", "submissions"), none("Note", NAMING["Note"]))))
    return F.when(entity["type"] == "Group", group).when(entity["type"] == "Note", note).when(entity["type"].isNotNull(), nothing)


def name(entity: Column, prefix: bool = False, separator: str = ":") -> Column:
    """The first of its names that isn't content, or null where there is none."""
    bare = entity.withField("withContent", F.lit(None).cast(FIELDS["withContent"]))
    return F.get(names(bare, prefix, separator), F.lit(0))


def venue_id(venueid: Column, invitation: Column) -> Column:
    """A note's venue: what its content says, else the part of its invitation before its type."""
    return F.coalesce(F.nullif(venueid, F.lit("")), F.split(invitation, "/-/", 2)[0])
