"""From documents to an index: versions with their token arrays, postings and stored fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postora.schema import NO_POSITION
from postora.sources.tables import numbered, scratch, stored

#: Terms that count as numbers, where they fit 32 bits.
INTEGER = "^-?[0-9]+$"
WORDS = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Field:
    """Columns of a field in the table of versions: arrays, and where documents have one token at most, that token and
    its number as they are, which scans can skip rows by."""

    values: str
    positions: str
    numbers: str
    value: str | None = None
    number: str | None = None


@dataclass(frozen=True)
class Index:
    """docs: doc_id (order of arrival), uid, superseded_by (the next doc_id of the uid) and three arrays for each field;
    postings: field, term, doc_id, position, a row for each occurrence; stored: uid and fields, a map."""

    docs: DataFrame
    fields: dict[str, Field]
    postings: DataFrame
    stored: DataFrame | None = None

    def kept(self, folder: str | None = None) -> Index:
        """The index written as Parquet: versions as they come, postings in folders by field and sorted by term, so
        that a term's scan skips the row groups of others."""
        folder = folder or scratch(self.docs.sparkSession)
        docs = stored(self.docs, f"{folder}/docs")
        by_term = self.postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
        by_term.write.mode("overwrite").partitionBy("field").parquet(f"{folder}/postings")
        postings = docs.sparkSession.read.schema(self.postings.schema).parquet(f"{folder}/postings")
        return replace(self, docs=docs, postings=postings)


def as_numbers(tokens: Column) -> Column:
    """The integers among tokens."""
    return F.filter(F.transform(F.filter(tokens, lambda t: t.rlike(INTEGER)), lambda t: t.try_cast("int")), lambda n: n.isNotNull())


def superseded(docs: DataFrame, uid: str = "uid", doc_id: str = "doc_id") -> DataFrame:
    """docs with superseded_by: the doc_id with which the same uid came again, null for the newest."""
    return docs.withColumn("superseded_by", F.lead(doc_id).over(Window.partitionBy(uid).orderBy(doc_id)))


def postings_of(docs: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """A row for each occurrence of a term."""

    def rows(name: str, f: Field) -> Column:
        placed = F.arrays_zip(F.col(f.values).alias("term"), F.col(f.positions).alias("position"))
        return F.transform(placed, lambda z: F.struct(F.lit(name).alias("field"), z["term"].alias("term"), z["position"].alias("position")))

    none = F.array().cast("array<struct<field:string,term:string,position:int>>")
    each = [none, *(rows(name, f) for name, f in fields.items())]
    return docs.select("doc_id", F.explode(F.concat(*each)).alias("p")).select("p.field", "p.term", "doc_id", "p.position")


def _named(fields: Sequence[str], single: Sequence[str] = ()) -> dict[str, Field]:
    return {name: Field(f"f{i}_values", f"f{i}_positions", f"f{i}_numbers", *([f"f{i}_value", f"f{i}_number"] if name in single else [])) for i, name in enumerate(fields)}


def from_documents(documents: DataFrame, order: Sequence[str] = (), start: int = 1, fields: Sequence[str] | None = None) -> Index:
    """An index of sent documents (schema.DOCUMENT). They are numbered from `start` in the given order, or have a
    doc_id. Fields come into being with the first document that names them; pass `fields` to spare the look for them.
    A position that isn't sent is 255. A field named twice in a document has all its tokens. Null keys are refused."""
    if "doc_id" not in documents.columns:
        documents = numbered(documents, list(order) or ["object_id"], start=start)
    if fields is None:
        fields = [r[0] for r in documents.select(F.explode("fields.name").alias("n")).distinct().orderBy("n").collect()]  # a row for each field name
    named = _named(fields)
    columns, none = [], F.array().cast("array<struct<value:string,position:int,weight:int>>")

    def tokens(name: str) -> Column:
        return F.coalesce(F.flatten(F.transform(F.filter("fields", lambda x: x["name"] == name), lambda x: F.coalesce(x["tokens"], none))), none)

    for name, f in named.items():
        own = tokens(name)
        columns += [own["value"].alias(f.values), F.transform(own, lambda t: F.coalesce(t["position"], F.lit(NO_POSITION))).alias(f.positions), as_numbers(own["value"]).alias(f.numbers)]
    docs = superseded(documents.select("doc_id", F.col("object_id").cast("long").alias("uid"), *columns))
    kept = documents.where("doc is not null").select("doc_id", "doc.uid", "doc.fields")
    newest = kept.groupBy("uid").agg(F.max_by("fields", "doc_id").alias("fields"))
    return Index(docs, named, postings_of(docs, named), newest)


def from_table(table: DataFrame, uid: str, doc_id: str, text: Sequence[str] = (), keywords: Sequence[str] = ()) -> Index:
    """An index of a plain table: columns of prose are lower-cased and cut at what is no letter or digit, the place in
    that cut is the position; a column of keywords or numbers is one token at position 255. Null cells have none."""
    named = _named([*text, *keywords], keywords)
    columns = []
    for name in text:
        f, pieces = named[name], F.split(F.lower(F.coalesce(F.col(name), F.lit(""))), WORDS)
        placed = F.filter(F.transform(pieces, lambda t, i: F.struct(t.alias("t"), i.cast("int").alias("i"))), lambda z: z["t"] != "")
        columns.append((name, placed, f))
    base = table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(uid).cast("long").alias("uid"), *[p.alias(f"p{i}") for i, (_, p, _) in enumerate(columns)], *[F.when(F.col(k).isNotNull(), F.array(F.col(k).cast("string"))).otherwise(F.array().cast("array<string>")).alias(named[k].values) for k in keywords])
    arrays = []
    for i, (_, _, f) in enumerate(columns):
        arrays += [F.col(f"p{i}.t").alias(f.values), F.col(f"p{i}.i").alias(f.positions), as_numbers(F.col(f"p{i}.t")).alias(f.numbers)]
    for k in keywords:
        f = named[k]
        arrays += [F.col(f.values), F.transform(F.col(f.values), lambda _: F.lit(NO_POSITION)).alias(f.positions), as_numbers(F.col(f.values)).alias(f.numbers)]
        token = F.get(f.values, F.lit(0))
        arrays += [token.alias(f.value), F.when(token.rlike(INTEGER), token.try_cast("int")).alias(f.number)]
    docs = superseded(base.select("doc_id", "uid", *arrays))
    return Index(docs, named, postings_of(docs, named))
