"""The engine's surface: rooms, documents, the knowledge pipeline, the map, search and chat.

Each method reads current versions of tables, composes operators, and writes new versions
where something changes. Models are interfaces with offline stand-ins.
"""

from __future__ import annotations

import time
import uuid
from threading import Thread

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import clean_name, section_chunks, word_count
from quillgraph.functions.vectors import mean_vectors
from quillgraph.operators import catalog, cluster, consensus, gaps, graphmap, relate, resolve, search
from quillgraph.operators.catalog import numbered
from quillgraph.params import DEFAULTS, Params
from quillgraph.plans.models import GENERALITY, Classifier, Embedder, Extractor, HashedWords, KeywordExtractor, NoSuggestions, NoWriter, RuleClassifier, Suggester, Writer, template_answer
from quillgraph.sources.parsers import PARSERS, parse_files
from quillgraph.sources.store import Store


class Engine:
    def __init__(
        self, store: Store, embedder: Embedder | None = None, params: Params = DEFAULTS, extractor: Extractor | None = None, classifier: Classifier | None = None, suggester: Suggester | None = None,
        writer: Writer | None = None,
    ):
        self.store, self.embedder, self.p = store, embedder or HashedWords(), params
        self.extractor, self.classifier = extractor or KeywordExtractor(), classifier or RuleClassifier()
        self.suggester, self.writer = suggester or NoSuggestions(), writer or NoWriter()
        self.spark = store.spark
        self._runs: dict[int | None, dict] = {}

    # rooms

    def health(self) -> dict:
        """Whether Spark and the embedder answer."""
        database = self.spark.range(1).count() == 1
        probe = self.embedder.embed(self.spark.createDataFrame([("probe",)], "content string"), "content", "v").first()["v"]
        return {"status": "healthy" if database and probe is not None else "degraded", "database": database, "embedding": probe is not None}

    def create_room(self, name: str, user_id: str, description: str | None = None, color_index: int = 0) -> int:
        self.store.write("users", catalog.ensure_user(self.store.read("users"), user_id))
        rooms = self.store.read("projects")
        new = catalog.next_id(rooms)
        self.store.write("projects", catalog.create_room(rooms, name, user_id, description, color_index))
        return new

    def rooms(self, user_id: str) -> DataFrame:
        return catalog.rooms_with_counts(self.store.read("projects"), self.store.read("documents"), user_id)

    def room(self, room_id: int, user_id: str) -> DataFrame:
        return catalog.with_counts(catalog.owned(self.store.read("projects"), room_id, user_id), self.store.read("documents"), "id", "project_id", "paper_count")

    def delete_room(self, room_id: int, user_id: str) -> None:
        catalog.owned(self.store.read("projects"), room_id, user_id)
        self.store.update(catalog.delete_project(self.store.tables(), room_id))

    # documents

    def upload(self, files: DataFrame, project_id: int, types: tuple[str, ...] = tuple(PARSERS)) -> DataFrame:
        """Stores the files that parse, with their chunks, and returns every file's status."""
        parsed = self._kept(parse_files(files, self.p, types))
        docs = self.store.read("documents")
        good = numbered(parsed.where("status = 200"), catalog.next_id(docs), "filename").withColumn("project_id", F.lit(project_id)).withColumn("created_at", F.current_timestamp())
        good = self._kept(good)
        self.store.append("documents", good)
        chunks = self.store.read("chunks")
        large = section_chunks(good.where("not is_small"), self.p.chunk_words, self.p.overlap_words)
        small = good.where("is_small").select("id", F.lit(0).cast("long").alias("chunk_index"), F.col("content_text").alias("content"), F.lit("").alias("section_title"), F.lit(1).alias("section_level"), F.lit(None).cast("int").alias("page_num"), word_count(F.col("content_text")).cast("long").alias("n_words"))
        new = numbered(large.unionByName(small).withColumnRenamed("id", "document_id"), catalog.next_id(chunks), "document_id", "chunk_index")
        self.store.append("chunks", new)
        return parsed.select("filename", "status", "reason")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Written once beside the tables and reread, so that parsing isn't repeated."""
        path = f"{self.store.path}/work/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def documents(self, project_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
        own = self.store.read("documents").where(F.col("project_id") == project_id).drop("content_text", "embedding")
        return catalog.list_documents(own, self.store.read("chunks"), limit, offset)

    def delete_document(self, document_id: int) -> None:
        gone = self.store.read("documents").where(F.col("id") == document_id)
        if gone.isEmpty():
            raise catalog.NotFound(f"document {document_id}")
        changed = catalog.delete_documents(self.store.tables(), gone)
        self.store.update({t: changed[t] for t in ("documents", "chunks", "claims")})

    def embed(self, document_ids: DataFrame | None = None) -> DataFrame:
        """Vectors for chunks of large documents, and for documents; ``document_id, status, embedded, total``."""
        docs, chunks = self.store.read("documents"), self.store.read("chunks")
        todo = docs if document_ids is None else docs.join(document_ids.select("id"), "id", "left_semi")
        own = chunks.join(todo.where("not is_small").select(F.col("id").alias("document_id")), "document_id", "left_semi")
        fresh = self.embedder.embed(own.where("embedding is null").drop("embedding"), "content", "embedding").select(*chunks.columns)
        chunks = self.store.write("chunks", chunks.join(own.where("embedding is null").select("id"), "id", "left_anti").unionByName(fresh))
        small = self.embedder.embed(todo.where("is_small and embedding is null").drop("embedding"), "content_text", "embedding").select("id", F.col("embedding").alias("_e"))
        means = mean_vectors(chunks.where("embedding is not null"), ["document_id"], normalize=True, dim=self.embedder.dim).select(F.col("document_id").alias("id"), F.col("centroid").alias("_e"))
        vectors = small.unionByName(means)
        docs = self.store.write("documents", docs.join(vectors, "id", "left").withColumn("embedding", F.coalesce("embedding", "_e")).drop("_e"))
        counts = chunks.groupBy("document_id").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
        joined = docs.select(F.col("id").alias("document_id"), "is_small").join(counts, "document_id", "left")
        status = F.when(F.col("total").isNull(), "no_chunks").when(F.col("is_small") | (F.col("embedded") == F.col("total")), "completed").otherwise("partial")
        return joined.select("document_id", status.alias("status"), F.coalesce("embedded", F.lit(0)).alias("embedded"), F.coalesce("total", F.lit(0)).alias("total"))

    # knowledge

    def extract(self, project_id: int, document_ids: DataFrame | None = None) -> dict:
        """Concepts and claims of what has none yet: a small document whole, a large one by chunks, of which short ones are skipped.

        A piece that fails stays open and is counted; the others go on.
        """
        docs, chunks = self.store.read("documents").where(F.col("project_id") == project_id), self.store.read("chunks")
        todo = docs if document_ids is None else docs.join(document_ids.select("id"), "id", "left_semi")
        about = todo.select(F.col("id").alias("document_id"), F.col("filename").alias("title"), F.coalesce("is_small", F.lit(False)).alias("whole"), "content_text")
        open_chunks = chunks.where("extraction_status is null").join(about, "document_id")
        content = F.when(F.col("whole"), F.coalesce("content_text", "content")).otherwise(F.col("content"))
        short = ~F.col("whole") & (word_count(F.col("content")) < self.p.min_chunk_words)
        pieces = self._kept(open_chunks.select(F.col("id").alias("piece"), "document_id", "chunk_index", "title", content.alias("content"), "whole", short.alias("short")))
        found = self._kept(self.extractor.extract(pieces.where("not short").select("piece", "title", "content", "whole")))
        placed = found.join(pieces.select("piece", "document_id", "chunk_index"), "piece")
        failed = self._kept(placed.where("error is not null").join(todo.select(F.col("id").alias("document_id"), "filename"), "document_id").select("document_id", "filename", "piece", "error"))

        # The first of a name in each document, in order; known ones by name or likeness, the others are new.
        each = placed.select("document_id", "chunk_index", F.posexplode("concepts").alias("at", "c")).select("document_id", F.struct("chunk_index", "at").alias("position"), "c.*")
        sure = each.where(F.coalesce("confidence", F.lit(self.p.missing_confidence)) >= self.p.min_confidence)
        first = resolve.first_names(sure, "document_id").select("document_id", "position.*", "name", "description", "specificity_level")
        concepts, claims = self.store.read("concepts"), self.store.read("claims")
        rows = numbered(first, catalog.next_id(concepts), "document_id", "chunk_index", "at").withColumn("project_id", F.lit(project_id).cast("long"))
        rows = self._kept(self.embedder.embed(rows.withColumn("_text", F.trim(F.concat_ws(" ", "name", "description"))), "_text", "embedding").drop("_text"))
        known = concepts.where(F.col("project_id") == project_id)
        matched = self._kept(resolve.match_concepts(rows, known, self.p.merge_similarity))
        general = F.create_map(*[F.lit(x) for kv in GENERALITY.items() for x in kv])[F.col("specificity_level")]
        new = rows.join(matched.where("is_new").select("id"), "id", "left_semi").select("id", "project_id", "name", "description", F.coalesce(general, F.lit(GENERALITY["medium"])).alias("generality_score"), F.lit(0.5).alias("coverage_score"), F.lit(1.0).alias("consensus_score"), "embedding", F.lit(False).alias("is_gap"))
        new = self._kept(new)
        self.store.append("concepts", new)

        said = placed.select("document_id", "chunk_index", F.posexplode("claims").alias("at", "k")).select("document_id", "chunk_index", "at", "k.*")
        said = self._kept(numbered(said, catalog.next_id(claims), "document_id", "chunk_index", "at"))
        owners = rows.join(matched.select("id", "concept_id"), "id").select(F.col("concept_id").alias("id"), F.col("document_id").alias("batch"), "name", F.struct("chunk_index", "at").alias("position"))
        targets = resolve.claim_targets(said.select(F.col("id").alias("claim_id"), F.col("document_id").alias("batch"), "related_concept"), owners)
        fresh = self._kept(said.join(targets.withColumnRenamed("claim_id", "id"), "id").select("id", "document_id", "concept_id", "claim_text", "claim_type", "confidence"))
        self.store.append("claims", fresh)
        status = pieces.join(found.where("error is not null").select("piece"), "piece", "left_anti").select(F.col("piece").alias("id"), F.when(F.col("short"), "skipped").otherwise("extracted").alias("_s"))
        self.store.write("chunks", chunks.join(status, "id", "left").withColumn("extraction_status", F.coalesce("extraction_status", "_s")).drop("_s"))
        bad = failed.select("document_id").distinct().count()
        counts = pieces.agg(F.count_distinct("document_id"), F.count(F.when(~F.col("short"), 1)), F.count(F.when(F.col("short"), 1))).first()
        errors = [f"{r['filename']}: chunk {r['piece']}: {r['error'][:120]}" for r in failed.orderBy("document_id", "piece").limit(20).collect()]
        return {"documents": counts[0] - bad, "documents_failed": bad, "chunks": counts[1], "chunks_skipped": counts[2], "chunks_failed": failed.count(), "concepts": new.count(), "claims": fresh.count(), "errors": errors}

    def extract_merged(self, project_id: int) -> int:
        """Concepts of all documents, extracted whole, merged among themselves in order and added; returns how many. The one-step way of older clients."""
        docs = self.store.read("documents").where(F.col("project_id") == project_id)
        found = self._kept(self.extractor.extract(docs.select(F.col("id").alias("piece"), F.col("filename").alias("title"), F.col("content_text").alias("content"), F.lit(True).alias("whole"))))
        each = found.select(F.col("piece").alias("document_id"), F.posexplode("concepts").alias("at", "c")).select("document_id", "at", "c.*")
        concepts = self.store.read("concepts")
        rows = numbered(each, catalog.next_id(concepts), "document_id", "at").withColumn("project_id", F.lit(project_id).cast("long"))
        general = F.create_map(*[F.lit(x) for kv in GENERALITY.items() for x in kv])[F.col("specificity_level")]
        rows = rows.withColumn("generality_score", F.coalesce(general, F.lit(0.5))).withColumn("coverage_score", F.lit(0.5)).withColumn("consensus_score", F.lit(1.0))
        rows = self._kept(self.embedder.embed(rows.withColumn("_text", F.trim(F.concat_ws(" ", "name", "description"))), "_text", "embedding").drop("_text"))
        groups = resolve.greedy_merge(rows, self.p.merge_similarity).select("id", "group_id")
        merged = resolve.merge_records(rows.join(groups, "id")).drop("group_id").join(rows.select("id", "embedding"), "id")
        new = self._kept(merged.withColumn("project_id", F.lit(project_id).cast("long")).withColumn("is_gap", F.lit(False)))
        self.store.append("concepts", new)
        return new.count()

    def _of(self, project_id: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame], int]:
        """A project's rows, all rows, and its number of documents."""
        every = self.store.tables()
        own = dict(every)
        own["concepts"] = every["concepts"].where(F.col("project_id") == project_id)
        ids = own["concepts"].select(F.col("id").alias("concept_id"))
        own["claims"] = every["claims"].join(ids, "concept_id", "left_semi")
        own["relationships"] = every["relationships"].join(ids.withColumnRenamed("concept_id", "source_concept_id"), "source_concept_id", "left_semi")
        own["documents"] = every["documents"].where(F.col("project_id") == project_id)
        own["chunks"] = every["chunks"].join(own["documents"].select(F.col("id").alias("document_id")), "document_id", "left_semi")
        return own, every, own["documents"].count()

    def _put_concepts(self, project_id: int, rows: DataFrame) -> None:
        self.store.replace("concepts", project_id, rows)

    def normalize(self, project_id: int) -> DataFrame:
        """Merges concepts that are one; returns the alias table."""
        own, every, n = self._of(project_id)
        own["concepts"] = gaps.clear_gaps(own["concepts"]).drop("aliases", "merged_from_ids")
        out = resolve.normalize(own, n, p=self.p)
        aliases = self._kept(out["aliases"])
        claims, edges = resolve.remap(every["claims"], aliases, "concept_id"), resolve.remap(every["relationships"], aliases, "source_concept_id", "target_concept_id")
        self._put_concepts(project_id, out["concepts"])
        self.store.update({"claims": claims, "relationships": edges})
        return aliases

    def cluster(self, project_id: int, method: str = "density") -> DataFrame:
        """Labels, generality and parents; returns the clusters."""
        own, _, n = self._of(project_id)
        concepts = own["concepts"].drop("cluster_label")
        labels = self._kept(cluster.cluster_concepts(concepts, method, self.p).select("id", "cluster_label"))
        labelled = cluster.reassign_noise(concepts.join(labels, "id", "left"), dim=self.embedder.dim)
        scores = cluster.generality(labelled, consensus.frequencies(own["claims"]), n, dim=self.embedder.dim).select("id", F.col("generality").alias("_g"))
        fresh = labelled.join(scores, "id", "left").withColumn("generality_score", F.coalesce("_g", "generality_score")).drop("_g")
        parents = cluster.hierarchy(fresh.where("cluster_label is not null")).select("id", F.col("parent_concept_id").alias("_p"))
        self._put_concepts(project_id, fresh.drop("parent_concept_id").join(parents, "id", "left").withColumnRenamed("_p", "parent_concept_id"))
        return cluster.cluster_summary(self._of(project_id)[0]["concepts"].where("cluster_label is not null"), dim=self.embedder.dim)

    def relate(self, project_id: int) -> DataFrame:
        """Finds and stores new relationships; returns how many there are of each type."""
        own, every, _ = self._of(project_id)
        found = relate.detect(own["concepts"], own["chunks"], own["claims"], every["relationships"], self.classifier.classify, self.p)
        stored = F.create_map(*[F.lit(x) for k, v in relate.STORED_TYPE.items() if v for x in (k, v)])
        found = found.withColumn("relationship_type", stored[F.col("type")])
        edges = every["relationships"]
        new = numbered(found.select("source_concept_id", "target_concept_id", "relationship_type", "strength", "confidence"), catalog.next_id(edges), "source_concept_id", "target_concept_id")
        return relate.type_counts(self.store.append("relationships", new))

    def detect_gaps(self, project_id: int, suggested: DataFrame | None = None) -> DataFrame:
        """Clears former gaps and finds new ones; ``suggested`` are expected topics in place of the suggester's."""
        own, every, n = self._of(project_id)
        clean = self._kept(gaps.clear_gaps(own["concepts"]))
        if suggested is None:
            listed = gaps.representatives(clean, self.p).groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("concepts"))
            suggested = self._kept(self.suggester.suggest(listed.join(gaps.domain(clean, self.p), "project_id")))
        bridges = gaps.bridging_gaps(gaps.bridge_candidates(clean, own["relationships"], self.p.gap_similarity, self.p.max_bridging, dim=self.embedder.dim))
        new = bridges.unionByName(gaps.expected_topics(suggested, clean, self.p), allowMissingColumns=True)
        new = numbered(new, catalog.next_id(every["concepts"]), "name")
        flagged = gaps.flag_weak(clean, n, self.p)
        self._put_concepts(project_id, flagged.unionByName(new, allowMissingColumns=True).select(*clean.columns))
        return self.gaps(project_id)

    def build_brain(self, project_id: int) -> DataFrame:
        """Scores consensus, and stores the project's state."""
        own, every, _ = self._of(project_id)
        self._put_concepts(project_id, consensus.rebuild(own["concepts"], own["claims"]))
        scored = self._of(project_id)[0]["concepts"].where("not coalesce(is_gap, false)")
        state = consensus.summary_text(consensus.brain_state(scored))
        facts = state.first()
        written = self.writer.write(f"Summarise what this collection agrees on and disputes. {facts['summary_text']} Agreed: {facts['strong_consensus']}. Disputed: {facts['contested']}. Contradicted: {facts['contradictions']}.") if facts else ""
        state = state.withColumn("summary_text", F.lit(written) if written else F.col("summary_text")).withColumn("last_updated", F.current_timestamp()).withColumn("id", F.col("project_id"))
        return self.store.write("brain_state", consensus.upsert_state(every["brain_state"], state))

    def build(self, project_id: int) -> dict:
        """All steps of knowledge; one that fails is reported and the next goes on."""
        began, done = time.time(), {}
        steps = {"normalize": self.normalize, "cluster": self.cluster, "relate": self.relate, "gaps": self.detect_gaps, "brain": self.build_brain}
        for name, step in steps.items():
            try:
                done[name] = step(project_id).count()
            except Exception as error:
                done[name] = 0
                done[f"{name}_error"] = str(error)[:500]
        return done | {"project_id": project_id, "processing_time_seconds": round(time.time() - began, 2)}

    # reading

    def concept_map(self, project_id: int) -> dict[str, DataFrame]:
        own, _, _ = self._of(project_id)
        shown = graphmap.map_concepts(own["concepts"], self.p)
        edges = graphmap.map_edges(shown, own["relationships"])
        return {"nodes": graphmap.map_nodes(shown, own["claims"]), "edges": edges, "gaps": graphmap.map_gaps(shown), "metadata": graphmap.map_metadata(shown, edges)}

    def concepts(self, project_id: int, limit: int = 50, offset: int = 0, is_gap: bool | None = None) -> DataFrame:
        return catalog.list_concepts(self.store.read("concepts").where(F.col("project_id") == project_id), limit, offset, is_gap)

    def concept(self, concept_id: int) -> DataFrame:
        return graphmap.concept_detail(self.store.read("concepts"), self.store.read("claims"), self.store.read("documents"), concept_id)

    def relationships(self, project_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
        return catalog.list_relationships(self.store.read("relationships"), self.store.read("concepts").where(F.col("project_id") == project_id), limit, offset)

    def gaps(self, project_id: int, subtype: str | None = None) -> DataFrame:
        return graphmap.gap_list(self.store.read("concepts").where(F.col("project_id") == project_id), subtype)

    def status(self, project_id: int) -> DataFrame:
        own, every, _ = self._of(project_id)
        return consensus.project_health(own["documents"], own["concepts"]).join(consensus.latest_state(every["brain_state"]).select("project_id", "last_updated", "summary_text"), "project_id", "left")

    def _vector(self, text: str) -> list[float]:
        got = self.embedder.embed(self.spark.createDataFrame([(text,)], "content string"), "content", "v").first()["v"]
        if got is None:
            raise ValueError("the query has no words")
        return got

    def search(self, query: str, top_k: int = 5, threshold: float = 0.0, document_id: int | None = None) -> DataFrame:
        return search.search_chunks(self.store.read("chunks"), self.store.read("documents"), self._vector(query), top_k, threshold, document_id)

    def chat(self, project_id: int, question: str, top_k: int = 5, prefilter: bool = True) -> dict:
        """An answer with its sources: chunks and small documents near the question."""
        vector, docs = self._vector(question), self.store.read("documents")
        own = docs.where(F.col("project_id") == project_id)
        near = search.retrieve(self.store.read("chunks"), docs, project_id, vector, top_k, prefilter).join(docs.select(F.col("id").alias("document_id"), "filename"), "document_id")
        small = search.rank_small_documents(own, vector, 5).select("id", F.col("id").alias("document_id"), F.col("content_text").alias("content"), "similarity", "filename")
        near, small = self._kept(near.select("id", "document_id", "content", "similarity", "filename")), self._kept(small)
        own_concepts = self.store.read("concepts").where(F.col("project_id") == project_id)
        concepts = self._kept(search.concept_top_k(own_concepts, vector, 5))
        claims = self.store.read("claims").join(F.broadcast(concepts.select(F.col("id").alias("concept_id"))), "concept_id", "left_semi")  # five at most
        parts = {
            "context": search.prompt_context(near).first()[0], "documents": search.document_context(small).first()[0], "concepts": search.concept_lines(concepts).first()[0],
            "claims": search.claim_lines(claims).first()[0], "gaps": search.gap_lines(own_concepts).first()[0],
        }
        prompt = f"Answer from what follows, and say so where it doesn't tell.\nQuestion: {question}\nPassages:\n{parts['context']}\nDocuments:\n{parts['documents']}\nConcepts:\n{parts['concepts']}\nClaims:\n{parts['claims']}\nGaps:\n{parts['gaps']}"
        answer = self.writer.write(prompt) or template_answer(near.unionByName(small)).first()[0]
        return {"answer": answer, "prompt": prompt, "context": parts["context"], "confidence": search.chat_confidence(near).first()[0], "sources": search.source_list(near, small).first()[0], "concepts": concepts.select("name")}

    # runs

    def process_document(self, document_id: int) -> dict:
        """Embeds one document and extracts from it."""
        return self._process(self._document(document_id))

    def add_document_and_update(self, document_id: int) -> dict:
        """Embeds one document, extracts from it, and builds its project's knowledge anew."""
        rows = self._document(document_id)
        return self._process(rows) | self.build(rows.first()["project_id"])

    def _document(self, document_id: int) -> DataFrame:
        rows = self.store.read("documents").where(F.col("id") == document_id).select("id", "project_id")
        if rows.isEmpty():
            raise catalog.NotFound(f"document {document_id}")
        return rows

    def _process(self, documents: DataFrame) -> dict:
        embedded = self._kept(self.embed(documents.select("id")))
        open_ = embedded.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").where("status = 'partial'").count()
        done = self.extract(documents.first()["project_id"], documents.select("id"))
        errors = [*([f"{open_} document(s) with chunks that have no vector"] if open_ else []), *done.pop("errors")]
        return {"documents_processed": done.pop("documents"), "documents_partly_embedded": open_, **done, "errors": errors}

    def process_all(self, project_id: int, document_ids: DataFrame | None = None, clear: bool = False) -> dict:
        """Embeds, extracts and builds; what is done already is passed over unless it is cleared first.

        A document that fails is counted and named; the others and the build go on.
        """
        began = time.time()
        docs = self.store.read("documents").where(F.col("project_id") == project_id)
        if docs.isEmpty():
            return {"documents_processed": 0, "documents_failed": 0, "errors": [], "message": "No documents to process"}
        if clear:
            self._clear(docs)
        some = docs if document_ids is None else docs.join(document_ids.select("id"), "id", "left_semi")
        done = self._process(some.select("id", "project_id")) if not some.isEmpty() else {"documents_processed": 0, "documents_failed": 0, "errors": []}
        built = self.build(project_id)
        message = f"Processed {done['documents_processed']} document(s), {done['documents_failed']} failed"
        return done | built | {"errors": done["errors"] + [f"{k}: {v}" for k, v in built.items() if k.endswith("_error")], "message": message, "processing_time_seconds": round(time.time() - began, 2)}

    def _clear(self, docs: DataFrame) -> None:
        """Vectors, extractions, concepts, claims, relationships and the state of these documents' project go."""
        project_id = docs.first()["project_id"]
        ids = docs.select(F.col("id").alias("document_id"))
        own = ids.withColumn("_own", F.lit(True))
        chunks = self.store.read("chunks").join(own, "document_id", "left")
        for c in ("embedding", "extraction_status"):
            chunks = chunks.withColumn(c, F.when(F.col("_own").isNull(), F.col(c)))
        tables = self.store.tables()
        left = catalog.delete_concepts(tables, tables["concepts"].where(F.col("project_id") == project_id))
        self.store.write("chunks", chunks)
        self.store.write("claims", left["claims"].join(ids, "document_id", "left_anti"))
        self.store.write("relationships", left["relationships"])
        self.store.replace("documents", project_id, docs.withColumn("embedding", F.lit(None).cast("array<double>")))
        self.store.replace("concepts", project_id, tables["concepts"].limit(0))
        self.store.replace("brain_state", project_id, tables["brain_state"].limit(0))

    def start(self, project_id: int, **options) -> dict:
        """Begins a run in the background; one at a time for each project."""
        run = self._runs.get(project_id)
        if run and run["phase"] == "running":
            return self.run_status(project_id)
        tag = f"run-{uuid.uuid4().hex[:8]}"
        run = self._runs[project_id] = {"phase": "running", "tag": tag, "started": time.time(), "result": None}

        def work() -> None:
            self.spark.addTag(tag)
            try:
                run["result"] = self.process_all(project_id, **options)
                run["phase"] = "completed" if run["phase"] == "running" else run["phase"]
            except Exception as error:
                run["phase"] = "failed" if run["phase"] == "running" else run["phase"]
                run["result"] = {"error": str(error)[:500]}

        run["thread"] = Thread(target=work, daemon=True)
        run["thread"].start()
        return self.run_status(project_id)

    def run_status(self, project_id: int) -> dict:
        run = self._runs.get(project_id)
        return {"phase": "idle"} if run is None else {"phase": run["phase"], "seconds": round(time.time() - run["started"], 2), "result": run["result"]}

    def cancel(self, project_id: int) -> dict:
        run = self._runs.get(project_id)
        if run and run["phase"] == "running":
            run["phase"] = "cancelled"
            self.spark.interruptTag(run["tag"])
        return self.run_status(project_id)
