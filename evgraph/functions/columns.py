"""Scalar functions: identity, paths, names, routes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evgraph.schema import EDGE, NODE

__all__ = [
    "basename", "edge_id", "edge_line", "edge_record", "evidence", "is_within", "json_for_html", "namespace_of", "node_id",
    "node_record", "normalize_id", "posix_path", "qualify", "quoted", "relativize_path", "resolve_relative",
    "route_from_parts", "simple_name", "slugify",
]


def posix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_id(name: Column) -> Column:
    """Trimmed, each run of white space as one space."""
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def node_id(kind: Column, qualified_name: Column) -> Column:
    """A node is its kind and qualified name, never its file."""
    return F.concat(kind, F.lit(":"), normalize_id(qualified_name))


def edge_id(src: Column, dst: Column, kind: Column, file: Column, line: Column, rule: Column | None = None) -> Column:
    """An edge is its ends, kind and place of evidence; ``?`` stands for a missing place."""
    place = F.concat(F.coalesce(file, F.lit("?")), F.lit(":"), F.coalesce(line.cast("string"), F.lit("?")))
    base = F.concat(src, F.lit("->"), dst, F.lit(":"), kind, F.lit("@"), place)
    return base if rule is None else F.concat(base, F.coalesce(F.concat(F.lit("#"), rule), F.lit("")))


def evidence(file: Column, line: Column, rev: Column, line_end: Column | None = None) -> Column:
    end = F.lit(None) if line_end is None else line_end
    return F.struct(
        posix_path(file).alias("file"), line.cast("long").alias("line_start"), end.cast("long").alias("line_end"), rev.alias("rev")
    )


def simple_name(name: Column) -> Column:
    """The last segment of a type's name, without type arguments."""
    return F.trim(F.element_at(F.split(F.regexp_replace(name, r"<.*$", ""), r"\."), -1))


def qualify(*parts: Column) -> Column:
    """Parts joined by dots, empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ".")


def namespace_of(qualified_name: Column) -> Column:
    return F.regexp_replace(qualified_name, r"\.?[^.]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relativize_path(path: Column, root: Column) -> Column:
    """``.`` for the root, the rest for what lies below it, else the path itself."""
    below = F.concat(root, F.lit("/"))
    return F.when(path == root, ".").when(F.startswith(path, below), F.substr(path, F.length(below) + 1)).otherwise(path)


def is_within(root: Column, path: Column) -> Column:
    """Whether a path is the root or lies below it, after ``.`` and ``..`` are folded; links are not followed."""
    inside = relativize_path(_folded(path), _folded(root))
    return (inside == ".") | ~(F.startswith(inside, F.lit("/")) | F.startswith(inside, F.lit("..")))


def _folded(path: Column) -> Column:
    absolute = F.startswith(path, F.lit("/"))
    return F.concat(F.when(absolute, "/").otherwise(""), resolve_relative(F.lit(""), path))


def resolve_relative(file: Column, spec: Column) -> Column:
    """A relative import of ``file``: ``.`` and ``..`` are folded, no extension is added."""
    segments = F.split(spec, "/")
    start = F.when(F.contains(file, F.lit("/")), F.split(F.regexp_replace(file, r"/[^/]*$", ""), "/")).otherwise(
        F.array().cast("array<string>")
    )

    def fold(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when((part == ".") | (part == ""), done)
            .when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.array_append(done, part))
        )

    return F.array_join(F.aggregate(segments, start, fold), "/")


def route_from_parts(parts: Column, constants: Column) -> Column:
    """A route from a template's parts ``array<struct<text, name>>``.

    A part with text stands for itself; a name that is a key of the map ``constants`` for its
    value, another name for ``{name}``; a part without both makes the route null.
    """
    shown = F.transform(
        parts,
        lambda p: F.coalesce(p["text"], F.try_element_at(constants, p["name"]), F.concat(F.lit("{"), p["name"], F.lit("}"))),
    )
    return F.when(~F.exists(shown, lambda x: x.isNull()), F.array_join(shown, ""))


def slugify(route: Column, method: Column | None = None) -> Column:
    """Lower case, other characters than letters and digits as single dashes; ``route`` if nothing is left.

    With ``method`` in front, two methods of one route get two names.
    """
    text = route if method is None else F.concat_ws(" ", method, route)
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("route")).otherwise(slug)


def quoted(value: Column) -> Column:
    """The JSON text of a string, quotes included; canonical order compares these."""
    array = F.to_json(F.array(value))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def json_for_html(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))


def edge_line(edge: str = "") -> Column:
    """An edge as a line of text with its evidence."""
    c = lambda name: F.col(f"{edge}{name}")
    rule = F.coalesce(F.concat(F.lit(" rule="), c("rule_id")), F.lit(""))
    place = F.concat(
        F.coalesce(c("evidence.file"), F.lit("?")), F.lit(":"), F.coalesce(c("evidence.line_start").cast("string"), F.lit("?"))
    )
    head = F.concat(c("src"), F.lit(" --["), c("kind"), F.lit(" "), c("nature"), F.lit("]--> "), c("dst"))
    return F.concat(head, F.lit("  @ "), place, rule)


def node_record(**given: Column) -> list[Column]:
    """All columns of a node. Id, revisions and evidence follow from the others where they are not given.

    ``rev`` stands for both revisions; a file and line without evidence become its only piece.
    """
    null = F.lit(None)
    rev = given.pop("rev", null)
    given.setdefault("id", node_id(given["kind"], given["qualified_name"]))
    given.setdefault("first_seen_rev", rev)
    given.setdefault("last_seen_rev", F.coalesce(rev, given["first_seen_rev"]))
    if "evidence" not in given and "file" in given:
        piece = evidence(given["file"], given["line_start"], given["first_seen_rev"], given.get("line_end"))
        given["evidence"] = F.when(given["file"].isNotNull() & given["line_start"].isNotNull(), F.array(piece))
    return [given.get(f.name, null).cast(f.dataType).alias(f.name) for f in NODE]


def edge_record(**given: Column) -> list[Column]:
    """All columns of an edge. Id and revisions follow from the others where they are not given."""
    null = F.lit(None)
    rev = given.pop("rev", null)
    file, line = given.pop("file", None), given.pop("line_start", None)
    if "evidence" not in given:
        given["evidence"] = evidence(file, line, given.get("observed_in_rev", rev))
    place = given["evidence"]
    given.setdefault(
        "id",
        edge_id(given["src"], given["dst"], given["kind"], place["file"], place["line_start"], given.get("rule_id")),
    )
    given.setdefault("observed_in_rev", rev)
    given.setdefault("first_seen_rev", given["observed_in_rev"])
    given.setdefault("last_seen_rev", given["observed_in_rev"])
    return [given.get(f.name, null).cast(f.dataType).alias(f.name) for f in EDGE]
