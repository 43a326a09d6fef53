"""The engine: keeps an index in step with a folder and answers questions from it alone."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import prompts as P
from .functions import text as T
from .functions import vectors as V
from .operators import chunking, search, sync
from .operators.lists import VectorLists
from .providers import Offline
from .sources import files
from .sources.embeddings import Embeddings
from .sources.index import KEPT, ORDER, Conflict, Index
from .storage import is_uri, joined

RETRIES = 4  # of a sync that others overlap
SETTLED = 2.0  # seconds after which a file's time of change tells its contents apart


class Engine:
    def __init__(self, spark: SparkSession, folder: str | Path, index_root: str | Path, provider=None, settings: Settings | None = None) -> None:
        self.spark = spark
        self.folder = str(folder) if is_uri(str(folder)) else Path(folder).resolve()
        self.settings = settings or Settings()
        self.provider = provider or Offline(self.settings.dim)
        # each folder has its own index, so that another folder's sync cannot empty it
        self.index = Index(spark, joined(index_root, hashlib.sha256(str(self.folder).encode()).hexdigest()[:16]))
        self.embeddings = Embeddings(spark, joined(index_root, "embeddings"))  # of all folders

    @property
    def config(self) -> str:
        """A change of chunking or provider makes every source changed."""
        s = self.settings
        return f"{s.chunk_size}/{s.overlap}/{self.provider.name}/{getattr(self.provider, 'dim', '')}"

    def embedded(self, chunked: DataFrame, seq: int) -> DataFrame:
        """Index records of (source, chunk_index, text), made by sync number ``seq``."""
        named = chunked.select(
            T.chunk_id("source", F.col("chunk_index").cast("string")).alias("id"), "text", "source", F.col("chunk_index").cast("int")
        )
        # an embedder that costs next to nothing is asked again
        if self.provider.name == "offline":
            made = named.withColumn("embedding", self.provider.embed("text"))
        else:
            made = self.embeddings.embedded(named, self.provider.embed, f"{self.provider.name}/{getattr(self.provider, 'dim', '')}")
        return made.select("*", V.norm(F.col("embedding")).alias("norm"), F.lit(seq).cast("long").alias("seq"))

    def sync(self, force: bool = False, say: Callable[[str], None] | None = None) -> dict:
        """Bring the index in step with the folder; returns the summary.

        A file whose size and time of change are those of the last sync is not opened; of any other the content is hashed.
        Unchanged files are neither parsed nor embedded again.  A file that cannot be parsed is reported, keeps
        no records and is tried again by the next sync; the others are committed.  If another sync commits some of the
        same files meanwhile, this one begins again from there.
        """
        if isinstance(self.folder, Path) and not self.folder.is_dir():
            raise FileNotFoundError(f"{self.folder} is not a folder")
        for _ in range(RETRIES - 1):
            try:
                return self._synced(force, say)
            except Conflict:
                continue
        return self._synced(force, say)

    def current(self, manifest: DataFrame) -> DataFrame:
        """The folder's files with ``digest`` and ``stamp``, which stands for a content that is known.

        A file has its stamp from size and time of change; one that changed just now has none, as it can change again
        within the clock's step.  Files with the manifest's stamp take its digest, and only the others are opened.
        """
        settled = F.col("modified") < int((time.time() - SETTLED) * 1e9)
        found = files.discover(self.spark, self.folder)
        found = found.withColumn("stamp", F.when(settled, F.concat_ws(":", "size", "modified")))
        known = manifest.where("stamp is not null").select("source", "stamp", F.col("digest").alias("before"))
        both = found.join(known, ["source", "stamp"], "left").select(*found.columns, "before")
        same = both.where("before is not null").withColumnRenamed("before", "digest")
        return same.unionByName(both.where("before is null").drop("before").withColumn("digest", files.digest_of("path")))

    def _synced(self, force: bool, say: Callable[[str], None] | None) -> dict:
        state = self.index.state()
        manifest = self.index.manifest(state)
        if force:
            manifest = manifest.limit(0)
        # a listing holds one short row a file
        current = self.current(manifest).cache()
        known = manifest.select("source", F.when(F.col("config") == self.config, F.col("digest")).alias("digest"))
        diff = sync.changes(current, known).cache()
        fresh = diff.where(F.col("status").isin("added", "updated")).select("source")
        parsed = files.read(current.join(fresh, "source", "left_semi").select("path", "source", "ext", "digest", "stamp")).cache()
        s = self.settings
        new = self.embedded(chunking.chunks(parsed.where("error is null"), s.chunk_size, s.overlap), state["seq"] + 1)
        failed = parsed.where("error is not null").select("source", "error")
        good = parsed.where("error is null").select("source", "digest", "stamp").withColumn("config", F.lit(self.config))
        try:
            if force:
                self.index.commit(new, good)
            else:
                gone = diff.where("status = 'removed'").select("source").unionByName(failed.select("source"))
                if not (fresh.isEmpty() and gone.isEmpty()):
                    self.index.append(new, good, gone, state["number"])
        except Conflict:
            for df in (parsed, diff, current):
                df.unpersist()
            raise
        self.index.vacuum(KEPT)
        stored = self.index.manifest()
        out = sync.summary(diff, stored.agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]).first().asDict()
        if say:
            for r in sync.log_lines(diff, stored.select("source", "n_chunks")).orderBy("source").toLocalIterator():
                say(r.line)
            for r in failed.toLocalIterator():
                say(f"[sync] Warning: failed to process '{r.source}': {r.error}")
            say(f"[sync] Done. Added={out['added']} Updated={out['updated']} Unchanged={out['unchanged']} Removed={out['removed']} TotalChunks={out['total_chunks']}")
        for df in (parsed, diff, current):
            df.unpersist()
        return out

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Hits of each question (qid, question): qid, rank, score, source, chunk_index, text.

        Scoring reads ids and vectors.  A block of questions (``search.QUESTIONS`` at most) has ``top_k`` hits each at
        most; these come to the driver and are sent to a scan of the row groups that can hold their texts, so no text is shuffled.
        """
        s, state = self.settings, self.index.state()
        asked = questions.select("qid", self.provider.embed("question", "RETRIEVAL_QUERY").alias("query"))
        vectors = self.index.records(state).select("id", *ORDER, "embedding", "norm")
        out = None
        for block in search.blocks(asked, "qid"):
            hits = search.batch_top(vectors, self.spark.createDataFrame(block), s.top_k, s.min_score, order=ORDER)
            found = hits.select("id", "qid", "rank", "score", "chunk_index").toArrow()
            texts = self.index.texts(found["id"].unique().to_pylist(), state)
            part = texts.join(F.broadcast(self.spark.createDataFrame(found)), "id").select("qid", "rank", "score", "source", "chunk_index", "text")
            out = part if out is None else out.unionByName(part)
        return out

    def answers(self, questions: DataFrame) -> DataFrame:
        """(qid, answer, sources) of every question."""
        if self.index.is_empty():
            nothing = F.array().cast("array<struct<source: string, chunk_index: int, score: double>>")
            return questions.select("qid", F.lit(P.EMPTY).alias("answer"), nothing.alias("sources"))
        return answered(questions, self.retrieve(questions), self.provider)

    def answer(self, question: str) -> dict:
        row = self.answers(self.spark.createDataFrame([(0, question)], "qid long, question string")).first()
        return {"answer": row.answer, "sources": [x.asDict() for x in row.sources]}


def contexts(hits: DataFrame) -> DataFrame:
    """(qid, context, sources): a question's blocks and citations in order of rank."""
    cited = F.struct("source", "chunk_index", F.round("score", 3).alias("score"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", cited.alias("c"))))
    return hits.groupBy("qid").agg(
        P.joined_in_order("rank", P.block("source", F.col("chunk_index").cast("string"), "text")).alias("context"),
        F.transform(ordered, lambda x: x["c"]).alias("sources"),
    )


def answered(questions: DataFrame, hits: DataFrame, provider) -> DataFrame:
    """No hit: the not-found message.  Sources are shown only with an answer that says something else."""
    joined = questions.join(contexts(hits), "qid", "left")
    asked = joined.withColumn("prompt", P.prompt("context", "question"))
    found = asked.where("context is not null").withColumn("generated", F.coalesce(provider.generate("prompt"), F.lit("")))
    none = F.array().cast("array<struct<source: string, chunk_index: int, score: double>>")
    said = found.select(
        "qid",
        F.when(F.col("generated") == "", P.NOT_FOUND).otherwise(F.col("generated")).alias("answer"),
        F.when((F.col("generated") == "") | P.hides_sources("generated"), none).otherwise(F.col("sources")).alias("sources"),
    )
    return said.unionByName(asked.where("context is null").select("qid", F.lit(P.NOT_FOUND).alias("answer"), none.alias("sources")))


FLAT_TEMPLATE = (
    "Passages from the Knowledge Base:\n\n{context}\n\nReply to this from the passages and nothing else: {question}\n"
    f"Where they leave it open, the reply is this sentence alone: {P.NOT_FOUND_FLAT}"
)


class FlatEngine:
    """The full-rebuild mode: flat folder, recursive splitter, nearest four without a threshold, file names as citations."""

    def __init__(self, spark: SparkSession, folder: str | Path, index_dir: str | Path, provider=None, settings: Settings | None = None) -> None:
        from .config import flat_settings

        self.spark, self.folder, self.index = spark, str(folder), Index(spark, index_dir)
        self.settings = settings or flat_settings()
        self.provider = provider or Offline(self.settings.dim)

    def load(self) -> tuple[DataFrame, DataFrame]:
        """(loaded, skipped): documents with their file name, and files that failed."""
        read = files.read(files.discover(self.spark, self.folder, recursive=False))
        named = read.withColumn("source_file", T.base_name("path"))
        return named.where("error is null"), named.where("error is not null")

    def build(self, say: Callable[[str], None] | None = None) -> int:
        """Rebuild the index from nothing; returns its number of chunks.  Files that fail are told and left out."""
        loaded, skipped = self.load()
        loaded, skipped = loaded.cache(), skipped.select("source_file", "error").cache()
        if say:
            for r in skipped.toLocalIterator():
                say(f"[flat] Skipped '{r.source_file}': {r.error}")
            if loaded.isEmpty():
                say(f"[flat] Nothing to load in '{self.folder}': add PDF, DOCX, TXT, MD or CSV files and run again.")
        cut = chunking.recursive_chunks(loaded.withColumn("source", F.col("source_file")), self.settings.chunk_size, self.settings.overlap)
        made = cut.select(
            F.expr("uuid()").alias("id"), "text", "source", F.col("chunk_index").cast("int"), self.provider.embed("text").alias("embedding"),
            F.lit(None).cast("double").alias("norm"), F.xxhash64("source", "chunk_index").alias("seq"),
        )
        self.index.commit(made, loaded.select(F.col("source_file").alias("source"), F.lit(None).cast("string").alias("digest"), F.lit("flat").alias("config")))
        n = self.index.manifest().agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]
        if n:
            self.lists().build(self.index.records().select("text", "source", "seq", "embedding"), "l2")
        loaded.unpersist()
        skipped.unpersist()
        if say:
            say(f"[flat] Indexed {n} chunk(s).")
        return n

    def lists(self) -> VectorLists:
        """The records in inverted lists by squared distance, which lie beside the index's version."""
        return VectorLists(self.spark, joined(self.index.folder, self.index.version(), "lists"))

    def answer(self, question: str) -> tuple[str, list[str]]:
        if self.index.is_empty():
            return P.NOT_FOUND_FLAT, []
        asked = self.spark.createDataFrame([(0, question)], "qid long, question string").select("qid", self.provider.embed("question").alias("query"))
        found, _ = self.lists().exact(asked, self.settings.top_k)
        hits = found.select("text", "source", F.col("score").alias("distance"), "seq")
        one = hits.agg(P.joined_in_order(F.struct("distance", "seq"), "text").alias("context"), P.distinct_sources("source").alias("sources"), F.count("*").alias("n"))
        if not (got := one.first()).n:
            return P.NOT_FOUND_FLAT, []
        filled = P.flat_prompt(FLAT_TEMPLATE, F.lit(got.context), F.lit(question))
        said = one.select(filled.alias("flat"), P.prompt("context", F.lit(question)).alias("prompt"))
        said = said.select(self.provider.generate("prompt" if self.provider.name == "offline" else "flat").alias("answer"))
        return said.first().answer, list(got.sources)
