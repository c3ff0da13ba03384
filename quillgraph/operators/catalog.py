"""Lists, counts, ownership, and changes of the tables as new versions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.sources.store import stored


class NotFound(LookupError):
    """There is no such row for this user."""


def with_counts(rows: DataFrame, details: DataFrame, key: str, detail_key: str, name: str) -> DataFrame:
    """Rows with how many details each has, 0 for none. Details are counted before they are joined."""
    counts = details.groupBy(F.col(detail_key).alias(key)).agg(F.count("*").alias(name))
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0, most: int | None = None) -> DataFrame:
    """A page in an order that ends with the key."""
    if offset < 0 or limit < 1:
        raise ValueError("offset from 0 and limit from 1")
    limit = min(limit, most) if most else limit
    ordered = rows.orderBy(*order)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def list_concepts(concepts: DataFrame, limit: int = 50, offset: int = 0, is_gap: bool | None = None) -> DataFrame:
    found = concepts if is_gap is None else concepts.where(F.coalesce(F.col("is_gap"), F.lit(False)) == is_gap)
    return page(found, [F.desc_nulls_last("coverage_score"), "id"], limit, offset)


def list_relationships(relationships: DataFrame, concepts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Relationships whose source is one of ``concepts``, the strongest first, 1000 at most."""
    own = relationships.join(concepts.select(F.col("id").alias("source_concept_id")), "source_concept_id", "left_semi")
    return page(own, [F.desc_nulls_last("strength"), "id"], limit, offset, 1000)


def list_documents(documents: DataFrame, chunks: DataFrame, limit: int = 50, offset: int = 0, newest: str = "created_at") -> DataFrame:
    """A page of documents, the newest first, with their chunks counted. Only chunks of the page are counted."""
    some = page(documents, [F.desc(newest), "id"], limit, offset)
    own = chunks.join(F.broadcast(some.select(F.col("id").alias("document_id"))), "document_id", "left_semi")
    return with_counts(some, own, "id", "document_id", "chunk_count")


def document_claims(claims: DataFrame, document_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(claims.where(F.col("document_id") == document_id), ["id"], limit, offset)


def document_concepts(concepts: DataFrame, claims: DataFrame, document_id: int) -> DataFrame:
    """Concepts that a document makes a claim on."""
    named = claims.where(F.col("document_id") == document_id).select(F.col("concept_id").alias("id"))
    return concepts.join(named, "id", "left_semi")


def documents_of_concept(documents: DataFrame, claims: DataFrame, concept_id: int) -> DataFrame:
    cited = claims.where(F.col("concept_id") == concept_id).select(F.col("document_id").alias("id"))
    return documents.join(cited, "id", "left_semi")


def owned(rooms: DataFrame, room_id: int, user_id: str) -> DataFrame:
    """The room if it is this user's; raises ``NotFound`` otherwise."""
    found = rooms.where((F.col("id") == room_id) & (F.col("user_id") == user_id))
    if found.isEmpty():
        raise NotFound(f"room {room_id}")
    return found


def rooms_with_counts(rooms: DataFrame, documents: DataFrame, user_id: str | None = None) -> DataFrame:
    """A user's rooms with their papers counted, the last changed first."""
    own = rooms if user_id is None else rooms.where(F.col("user_id") == user_id)
    return with_counts(own, documents, "id", "project_id", "paper_count").orderBy(F.desc("updated_at"), "id")


def next_id(rows: DataFrame) -> int:
    """One more than the greatest id."""
    return (rows.agg(F.max("id")).first()[0] or 0) + 1


def create_room(rooms: DataFrame, name: str, user_id: str, description: str | None = None, color_index: int = 0) -> DataFrame:
    """The rooms and a new one."""
    if not name or len(name) > 255 or not 0 <= color_index <= 4:
        raise ValueError("a name of 1 to 255 characters and a colour from 0 to 4")
    spark = rooms.sparkSession
    made = spark.range(1).select(
        F.lit(next_id(rooms)).alias("id"), F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"), F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"), F.lit(user_id).alias("user_id"), F.lit(color_index).alias("color_index"),
    )
    return rooms.unionByName(made.select(*[F.col(c).cast(rooms.schema[c].dataType) for c in rooms.columns]))


def ensure_user(users: DataFrame, user_id: str, email: str | None = None, name: str | None = None) -> DataFrame:
    """The users, with this one if they are new."""
    spark = users.sparkSession
    one = spark.range(1).select(F.lit(user_id).alias("id"), F.lit(email or f"{user_id}@local").alias("email"), F.lit(name).cast("string").alias("name"), F.current_timestamp().alias("created_at"))
    return users.unionByName(one.select(*users.columns).join(users.select("id"), "id", "left_anti").select(*users.columns))


def numbered(rows: DataFrame, start: int, *order: str) -> DataFrame:
    """Rows with ids from ``start``. Ids are dealt by ranges, so that no task orders all rows. The ranges are stored once, as they are read twice."""
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    base = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = base.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A row for each task.
    return ranged.join(F.broadcast(before), "_p").withColumn("id", F.lit(start) + F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_n", "_first", "_before")


def append_new(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and those of ``fresh`` whose keys aren't there, numbered on."""
    new = numbered(fresh.drop("id").join(rows.select(*keys), keys, "left_anti"), next_id(rows), *keys)
    return rows.unionByName(new.withColumn("id", F.col("id").cast(rows.schema["id"].dataType)).select(*rows.columns))


Tables = dict[str, DataFrame]


def delete_documents(tables: Tables, gone: DataFrame) -> Tables:
    """Tables without these documents (``id``), their chunks and claims."""
    out = dict(tables)
    out["documents"] = tables["documents"].join(gone.select("id"), "id", "left_anti")
    ids = gone.select(F.col("id").alias("document_id"))
    for name in ("chunks", "claims"):
        out[name] = tables[name].join(ids, "document_id", "left_anti")
    return out


def delete_concepts(tables: Tables, gone: DataFrame) -> Tables:
    """Tables without these concepts (``id``), their claims and relationships; their children lose the parent."""
    out, ids = dict(tables), gone.select("id")
    left = tables["concepts"].join(ids, "id", "left_anti")
    parents = ids.select(F.col("id").alias("parent_concept_id"), F.lit(True).alias("_gone"))
    kept = left.join(parents, "parent_concept_id", "left")
    out["concepts"] = kept.withColumn("parent_concept_id", F.when(F.col("_gone").isNull(), F.col("parent_concept_id"))).select(*tables["concepts"].columns)
    out["claims"] = tables["claims"].join(ids.withColumnRenamed("id", "concept_id"), "concept_id", "left_anti")
    edges = tables["relationships"].join(ids.withColumnRenamed("id", "source_concept_id"), "source_concept_id", "left_anti")
    out["relationships"] = edges.join(ids.withColumnRenamed("id", "target_concept_id"), "target_concept_id", "left_anti")
    return out


def delete_project(tables: Tables, project_id: int) -> Tables:
    """Tables without a project and all that hangs on it."""
    out = delete_documents(tables, tables["documents"].where(F.col("project_id") == project_id))
    out = delete_concepts(out, tables["concepts"].where(F.col("project_id") == project_id))
    for name, key in (("projects", "id"), ("brain_state", "project_id")):
        if name in out:
            out[name] = out[name].where(F.col(key) != project_id)
    return out


def project_statistics(concepts: DataFrame) -> DataFrame:
    """``project_id, gap_type, coverage_tenth, n``: concepts by gap type and tenth of coverage."""
    tenth = F.least(F.floor(F.coalesce("coverage_score", F.lit(0.0)) * 10), F.lit(9))
    return concepts.groupBy("project_id", "gap_type", tenth.alias("coverage_tenth")).agg(F.count("*").alias("n"))
