"""From query trees to DataFrames of matching doc_ids, in three ways that give the same rows.

`predicate` (the default) is a Column over the table of versions: one scan, no shuffle. `by_sets` joins sets of doc_ids of
postings; `by_flags` reads the postings once, for all leaves together, and groups by document: for rare terms over
postings that are sorted by term. `by_frequency` looks how many postings the leaves have and takes one or the other.
"""

from __future__ import annotations

from functools import reduce, singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postora.operators.snapshot import live
from postora.plans import ast
from postora.sources.ingest import INTEGER, Field, Index


@singledispatch
def predicate(node: ast.Node, fields: dict[str, Field]) -> Column:
    """Whether a version matches. Unknown fields match nothing."""
    raise TypeError(f"no such query: {node!r}")


@predicate.register
def _(node: ast.Term, fields: dict[str, Field]) -> Column:
    if node.field not in fields:
        return F.lit(False)
    own = fields[node.field]
    return F.col(own.value).isNotNull() & (F.col(own.value) == node.term) if own.value else F.array_contains(own.values, node.term)


@predicate.register
def _(node: ast.Range, fields: dict[str, Field]) -> Column:
    if node.field not in fields:
        return F.lit(False)
    own = fields[node.field]
    if own.number:
        return F.col(own.number).isNotNull() & F.col(own.number).between(node.start, node.end)
    return F.exists(own.numbers, lambda n: n.between(node.start, node.end))


@predicate.register
def _(node: ast.MatchAll, fields: dict[str, Field]) -> Column:
    return F.lit(True)


@predicate.register
def _(node: ast.Phrase, fields: dict[str, Field]) -> Column:
    if node.field not in fields:
        return F.lit(False)
    own = fields[node.field]
    placed = F.arrays_zip(F.col(own.values).alias("t"), F.col(own.positions).alias("i"))

    def bases_of(term: str, position: int) -> Column:
        return F.transform(F.filter(placed, lambda z: z["t"] == term), lambda z: z["i"] - position)

    bases = [bases_of(t, p) for t, p in zip(node.terms, node.positions)]
    # the cheap test of all terms goes first
    every = reduce(Column.__and__, [F.array_contains(own.values, t) for t in dict.fromkeys(node.terms)])
    return every & (F.size(reduce(F.array_intersect, bases)) > 0)


@predicate.register
def _(node: ast.And, fields: dict[str, Field]) -> Column:
    return reduce(Column.__and__, [predicate(c, fields) for c in node.nodes])


@predicate.register
def _(node: ast.Or, fields: dict[str, Field]) -> Column:
    return reduce(Column.__or__, [predicate(c, fields) for c in node.nodes], F.lit(False))


@predicate.register
def _(node: ast.Difference, fields: dict[str, Field]) -> Column:
    return predicate(node.left, fields) & ~predicate(node.right, fields)


def by_predicate(node: ast.Node, index: Index, at: int | None = None) -> DataFrame:
    return live(index.docs, at).where(predicate(ast.normalised(node), index.fields)).select("doc_id")


def _is(node: ast.Term | ast.Range) -> Column:
    """Whether a posting is one of the leaf's."""
    if isinstance(node, ast.Term):
        return (F.col("field") == node.field) & (F.col("term") == node.term)
    number = F.when(F.col("term").rlike(INTEGER), F.col("term").try_cast("int"))
    return (F.col("field") == node.field) & F.coalesce(number.between(node.start, node.end), F.lit(False))


def phrase_matches(node: ast.Phrase, postings: DataFrame) -> DataFrame:
    """doc_id and base of each place of a phrase."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(t).alias("t"), F.lit(p).alias("p")) for i, (t, p) in enumerate(zip(node.terms, node.positions))])
    rows = postings.where((F.col("field") == node.field) & F.col("term").isin(*dict.fromkeys(node.terms))).withColumn("s", F.explode(slots)).where(F.col("s.t") == F.col("term"))
    return rows.groupBy("doc_id", (F.col("position") - F.col("s.p")).alias("base")).agg(F.count_distinct("s.slot").alias("n")).where(F.col("n") == len(node.terms)).select("doc_id", "base")


def by_sets(node: ast.Node, index: Index, at: int | None = None) -> DataFrame:
    alive = live(index.docs, at).select("doc_id")

    def ids(n: ast.Node) -> DataFrame:
        if isinstance(n, ast.MatchAll):
            return alive
        if isinstance(n, ast.Phrase):
            return phrase_matches(n, index.postings).select("doc_id").distinct()
        if isinstance(n, ast.And):
            return reduce(lambda x, y: x.join(y, "doc_id", "left_semi"), map(ids, n.nodes))
        if isinstance(n, ast.Or):
            return reduce(DataFrame.union, map(ids, n.nodes)).distinct() if n.nodes else alive.where(F.lit(False))
        if isinstance(n, ast.Difference):
            return ids(n.left).join(ids(n.right), "doc_id", "left_anti")
        return index.postings.where(_is(n)).select("doc_id").distinct()

    return ids(ast.normalised(node)).join(alive, "doc_id", "left_semi")


def by_flags(node: ast.Node, index: Index, at: int | None = None) -> DataFrame:
    node = ast.normalised(node)
    alive = live(index.docs, at).select("doc_id")
    plain = [x for x in node.leaves() if isinstance(x, (ast.Term, ast.Range))]
    phrases = [x for x in node.leaves() if isinstance(x, ast.Phrase)]
    flags = {x: f"m{i}" for i, x in enumerate([*plain, *phrases])}
    never = lambda own: [F.lit(False).alias(c) for x, c in flags.items() if x != own]
    rows = []
    if plain:
        any_of = reduce(Column.__or__, map(_is, plain))
        rows.append(index.postings.where(any_of).select("doc_id", *[_is(x).alias(flags[x]) for x in plain], *[F.lit(False).alias(flags[x]) for x in phrases]))
    rows += [phrase_matches(x, index.postings).select("doc_id", F.lit(True).alias(flags[x]), *never(x)) for x in phrases]
    if rows:
        found = reduce(DataFrame.unionByName, rows).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in flags.values()])
    else:
        found = alive.where(F.lit(False))

    def value(n: ast.Node) -> Column:
        if n in flags:
            return F.coalesce(flags[n], F.lit(False))
        if isinstance(n, ast.MatchAll):
            return F.lit(True)
        if isinstance(n, ast.Difference):
            return value(n.left) & ~value(n.right)
        return reduce(Column.__and__ if isinstance(n, ast.And) else Column.__or__, map(value, n.children()), F.lit(isinstance(n, ast.And)))

    # a document without any leaf has no row of flags: only a match-all can want it
    if any(isinstance(x, ast.MatchAll) for x in node.leaves()):
        return alive.join(found, "doc_id", "left").where(value(node)).select("doc_id")
    return found.where(value(node)).select("doc_id").join(alive, "doc_id", "left_semi")


#: The share of versions up to which the postings of a tree's leaves count as few, and how many always do.
FEW_POSTINGS, ALWAYS_FEW = 0.01, 100


def is_rare(node: ast.Node, index: Index) -> bool:
    """Whether the postings of all leaves together are few. Only those of the leaves' terms are read, and not more than
    it takes to know; versions are counted from the footers of files. Trees with a range or a match-all are not rare."""
    leaves = ast.normalised(node).leaves()
    if not leaves or any(isinstance(x, (ast.Range, ast.MatchAll)) for x in leaves):
        return False
    wanted = [(F.col("field") == x.field) & F.col("term").isin(*(x.terms if isinstance(x, ast.Phrase) else [x.term])) for x in leaves]
    most = max(ALWAYS_FEW, int(FEW_POSTINGS * index.docs.count()))
    return index.postings.where(reduce(Column.__or__, wanted)).limit(most + 1).count() <= most


def by_frequency(node: ast.Node, index: Index, at: int | None = None) -> DataFrame:
    return (by_flags if is_rare(node, index) else by_predicate)(node, index, at)


STRATEGIES = {"predicate": by_predicate, "sets": by_sets, "flags": by_flags, "frequency": by_frequency}


def counted(index: Index, wanted: dict[str, tuple[ast.Node, Column | None]], at: int | None = None) -> DataFrame:
    """One row: for each name the number of matches of its tree, of those that fulfil its condition if it has one; all in
    one pass over the versions."""
    columns = []
    for name, (node, only) in wanted.items():
        own = predicate(ast.normalised(node), index.fields)
        columns.append(F.count_if(own if only is None else own & only).alias(name))
    return live(index.docs, at).agg(*columns)


def count_matches(node: ast.Node, index: Index, at: int | None = None, only: Column | None = None) -> DataFrame:
    """n, the number of matches, of those whose doc_id fulfils `only` if given."""
    found = by_predicate(node, index, at)
    return (found if only is None else found.where(only)).agg(F.count("*").alias("n"))


def navigated(node: ast.Node, index: Index, before: int, after: int, at: int | None = None) -> DataFrame:
    """One row: newest_before and oldest_after, as of advance() and forward(), in one pass."""
    own, doc = predicate(ast.normalised(node), index.fields), F.col("doc_id")
    return live(index.docs, at).where(own).agg(F.max(F.when(doc <= before, doc)).alias("newest_before"), F.min(F.when(doc >= after, doc)).alias("oldest_after"))


def advance(node: ast.Node, index: Index, target: int, at: int | None = None) -> DataFrame:
    """doc_id of the newest match at or before the target; null without one."""
    return by_predicate(node, index, at).where(F.col("doc_id") <= target).agg(F.max("doc_id").alias("doc_id"))


def forward(node: ast.Node, index: Index, target: int, at: int | None = None) -> DataFrame:
    """doc_id of the oldest match at or after the target; null without one."""
    return by_predicate(node, index, at).where(F.col("doc_id") >= target).agg(F.min("doc_id").alias("doc_id"))
