"""Include edges: extraction, resolution by joins, transitive closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import normalize_path
from pairloom.session import materialize

# Comments and literals are consumed first, so an include inside them is not seen; group 1 is the delimited target.
_INCLUDE = (
    r"""(?md)/\*(?s:.*?)\*/|//[^\n]*|^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|"[^"\n]+")"""
    r"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
)


def extract_includes(files_text: DataFrame) -> DataFrame:
    """(path, pos, target, is_system) per include line, without the delimiters."""
    found = F.filter(F.regexp_extract_all("text", F.lit(_INCLUDE), F.lit(1)), lambda t: t != "")
    return (
        files_text.select("path", F.posexplode(found).alias("pos", "_t"))
        .select(
            "path", "pos",
            F.substr("_t", F.lit(2), F.length("_t") - 2).alias("target"),
            F.startswith("_t", F.lit("<")).alias("is_system"),
        )
    )


def _directory(path: str) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def _ancestors(directory: Column) -> Column:
    """Directories from ``directory`` upwards as structs (rank, dir), the file system's root excluded."""
    parts = F.split(directory, "/")
    # "/a/b" and "file:/a/b" have one leading part that stands for the root.
    top = F.when((parts[0] == "") | F.endswith(parts[0], F.lit(":")), 2).otherwise(1)
    levels = F.when(F.size(parts) >= top, F.sequence(F.size(parts), top, F.lit(-1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.when(directory == "", F.array().cast("array<struct<rank:int,dir:string>>")).otherwise(
        F.transform(
            levels,
            lambda n: F.struct(
                (F.size(parts) - n).cast("int").alias("rank"),
                F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"),
            ),
        )
    )


def resolve_includes(includes: DataFrame, files: DataFrame, library_dirs: Sequence[str] = (),
                     child_depth: int = 0) -> DataFrame:
    """Add ``resolved_path``: the first existing candidate, or null.

    Candidates in order: ancestors of the including file, nearest first (local includes only); then, to
    ``child_depth`` levels, directories below those ancestors; then the library directories as given. Existence is an
    equi-join with the file list; nothing is probed row by row. Resolution depends on (directory, target, kind) only,
    so it is done once per such triple however many files share it.
    """
    requests = materialize(
        includes.select(_directory("path").alias("dir"), "target", "is_system").distinct()
    )
    key = ["dir", "target", "is_system"]
    known = files.select(F.col("path").alias("candidate")).distinct()
    no_detail = F.array().cast("array<string>")
    absolute = F.startswith("target", F.lit("/"))

    def place(base: Column) -> Column:
        return F.when(absolute, normalize_path("target")).otherwise(
            normalize_path(F.concat(base, F.lit("/"), "target"))
        )

    def rank(tier: int, position: Column, detail: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), position.cast("int").alias("n"), detail.alias("detail"))

    local = requests.where(~F.col("is_system")).select(*key, F.explode(_ancestors(F.col("dir"))).alias("_a"))
    candidates = local.select(*key, place(F.col("_a.dir")).alias("candidate"),
                              rank(0, F.col("_a.rank"), no_detail).alias("priority"))
    if library_dirs:
        libraries = F.array(*[
            F.struct(F.lit(i).alias("rank"), F.lit(d.rstrip("/")).alias("dir")) for i, d in enumerate(library_dirs)
        ])
        candidates = candidates.unionByName(
            requests.select(*key, F.explode(libraries).alias("_l"))
            .select(*key, place(F.col("_l.dir")).alias("candidate"),
                    rank(2, F.col("_l.rank"), no_detail).alias("priority"))
        )
    # A header everybody includes makes its candidate path hot on this side only; the runtime splits such a key.
    hits = candidates.join(known, "candidate")
    if child_depth > 0:
        hits = hits.unionByName(_below_ancestors(local, known, key, child_depth, rank))
    best = hits.groupBy(*key).agg(F.min_by("candidate", "priority").alias("resolved_path"))
    answered = requests.join(best, key, "left")
    return (
        includes.withColumn("dir", _directory("path"))
        .join(answered, key, "left")
        .select("path", "pos", "target", "is_system", "resolved_path")
    )


def _below_ancestors(local: DataFrame, known: DataFrame, key: list[str], depth: int, rank) -> DataFrame:
    """Matches in directories 1..depth levels below an ancestor, visited parents first, in name order.

    Targets that lead upwards ("../x.h") are looked up from ancestors only. Instead of listing directories per include,
    each file states under which (ancestor, remaining path) it can be found. Of all files with one such statement only
    the first can ever be the answer, so the others are dropped before requests meet them: one row per request.
    """
    parts = F.split("candidate", "/")
    offers = (
        known.select("candidate", parts.alias("_p"))
        .withColumn("_cut", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)))
        .withColumn("_down", F.explode(F.sequence(F.lit(1), F.lit(depth))))
        .where((F.size("_p") > 1) & (F.col("_cut") > F.col("_down")))
        .select(
            "candidate",
            F.array_join(F.slice("_p", F.lit(1), F.col("_cut") - F.col("_down")), "/").alias("_anc"),
            F.array_join(F.slice("_p", F.col("_cut") + 1, F.size("_p")), "/").alias("_rest"),
            F.slice("_p", F.lit(1), F.col("_cut")).alias("_dir"),
        )
        .groupBy("_anc", "_rest").agg(F.min(F.struct("_dir", "candidate")).alias("_best"))
    )
    wanted = local.select(*key, F.col("_a.dir").alias("_anc"), F.col("_a.rank").alias("_rank"),
                          normalize_path("target").alias("_rest"))
    return wanted.join(offers, ["_anc", "_rest"]).select(
        *key, F.col("_best.candidate").alias("candidate"),
        rank(1, F.col("_rank"), F.col("_best._dir")).alias("priority")
    )


def _doubled(edges: DataFrame, most: int | None) -> DataFrame:
    """(root, path, hops): every node of ``edges`` with all it reaches, itself included, and the least number of hops.

    After round k all pairs up to ``2 ** k`` hops apart are known. A pair farther away, up to twice as far, has a node in
    between that is exactly ``2 ** k`` hops from its start: so only the pairs at that distance are extended, by all known
    ones. The rounds grow with the logarithm of the depth; cycles end, as no pair is farther apart than it needs to be.
    """
    nodes = edges.select("path").unionByName(edges.select(F.col("resolved_path").alias("path"))).distinct()
    own = nodes.select(F.col("path").alias("root"), "path", F.lit(0).alias("hops"))
    once = edges.where(F.col("path") != F.col("resolved_path")).select(
        F.col("path").alias("root"), F.col("resolved_path").alias("path"), F.lit(1).alias("hops"))
    known = materialize(own.unionByName(once))
    reach = 1
    while most is None or reach < most:
        far = known.where(F.col("hops") == reach)
        if far.isEmpty():
            break
        on = known.where(F.col("hops") > 0).select(F.col("root").alias("path"), F.col("path").alias("_to"), F.col("hops").alias("_on"))
        step = far.join(on, "path").select("root", F.col("_to").alias("path"), (F.col("hops") + F.col("_on")).alias("hops"))
        known = materialize(known.unionByName(step).groupBy("root", "path").agg(F.min("hops").alias("hops")))
        reach *= 2
    return known


def include_closure(includes: DataFrame, roots: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(root, path) for every file reachable from each root over resolved includes; a root reaches itself.

    The files that are included by others reach each other in a number of rounds that grows with the logarithm of the
    depth (``_doubled``); each round is written to reliable storage, which cuts the lineage. What a root reaches is then
    one join away: its own includes, and what these reach. Cost follows the closure of all included files: give the
    includes of the part of a tree that the roots belong to. ``max_hops`` leaves out what is farther away.
    """
    edges = materialize(
        includes.where(F.col("resolved_path").isNotNull()).select("path", "resolved_path").distinct()
    )
    start = materialize(roots.select("path").distinct())
    alone = start.select(F.col("path").alias("root"), "path")
    if max_hops == 0:
        return alone
    included = edges.select(F.col("resolved_path").alias("path")).distinct()
    inner = _doubled(edges.join(included, "path", "left_semi"), None if max_hops is None else max_hops)
    if max_hops is not None:
        inner = inner.where(F.col("hops") < max_hops)
    # An included file without includes of its own is no node of an edge between included files; it reaches itself.
    reached = inner.select(F.col("root").alias("resolved_path"), F.col("path").alias("_to"))
    first = start.join(edges, "path").join(reached, "resolved_path", "left")
    return alone.unionByName(
        first.select(F.col("path").alias("root"), F.coalesce("_to", "resolved_path").alias("path"))).distinct()


def functions_with_imports(functions: DataFrame, closure: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Functions of each root and of everything it includes, under the root's path; ``def_path`` is where they stand.

    Every file is parsed once however many roots include it. ``wanted``, if given, says which names a root can use: it has
    ``name``, ``path`` (the root) or further columns of ``closure`` that tell kinds of roots, and code_type if the functions
    have one. What a root reaches is met with the names defined there before it is met with the wanted ones, and texts come
    last: so the work follows what is reached and defined, not the names that all roots want.
    """
    defined = functions.withColumnRenamed("path", "def_path")
    reached = closure.withColumnRenamed("path", "def_path")
    if wanted is None:
        joined = reached.select("root", "def_path").join(defined, "def_path")
    else:
        place = ["def_path", "name", *[c for c in ("code_type",) if c in functions.columns and c in wanted.columns]]
        asked = wanted.withColumnRenamed("path", "root")
        asked = asked.select(*[c for c in asked.columns if c in reached.columns or c in place]).distinct()
        there = reached.join(defined.select(*place).distinct(), [c for c in place if c in reached.columns])
        hits = there.join(asked, asked.columns, "left_semi").select("root", *place).distinct()
        joined = hits.join(defined, place)
    joined = joined.withColumnRenamed("root", "path")
    return joined.withColumn("imported", F.col("path") != F.col("def_path"))
