"""One query for each operator of the engine, over the whole tables, with the DuckDB query that says the same.

A *file* is a row of ``documents``: its path is its source, ``/doc_``, its doc_id and a suffix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FLAT_SUFFIXES, SUFFIXES
from ..engine import answered, contexts
from ..functions import prompts as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, search, sync
from ..operators.lists import VectorLists
from ..providers import Offline, in_batches
from ..sources import files
from ..sources.files import READERS, csv_text, docx_text, parse_binary, pdf_text, text_of
from ..sources.index import Index
from ..sources.ranges import csv_lines
from ..storage import joined, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIZE, OVERLAP, DIM = 1000, 150, 64


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sources ------------------------------------------------------------------------------------------------

_NAMES = [".txt", ".MD", ".markdown", ".csv", ".pdf", ".docx", ".unsupported", ""]
_EXT_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_NAMES)) + " END"
_PATH_SQL = f"source || '/' || CASE WHEN doc_id % 8 = 7 THEN '.txt' ELSE 'doc_' || doc_id || {_EXT_SQL} END"


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with paths of all suffixes, upper case, unsupported and dot-only names."""
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("path", F.expr(_PATH_SQL)).withColumn("ext", T.suffix("path"))


def _in(suffixes: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{s}'" for s in suffixes) + ")"


_SUFFIX_SQL = "CASE WHEN doc_id % 8 = 7 THEN '' ELSE lower(" + _EXT_SQL + ") END"


def written_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder in the shared storage with a file for each row of documents, written by the executors."""
    folder = joined(shared_dir(spark), f"quill/files-{uuid.uuid4().hex}")

    def write(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                store.create_dir(f"{top}/{path.rpartition('/')[0]}")
                with store.open_output_stream(f"{top}/{path}") as out:
                    out.write((text or "").encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"n": [len(batch)]})

    # names that hold no doc_id are those of several rows: one of them is enough
    named_files(spark, sf_dir).groupBy("path").agg(F.min("text").alias("text")).mapInPandas(write, "n long").agg(F.sum("n")).first()
    return folder


def _doc_id():
    return F.regexp_extract("source", r"doc_(\d+)", 1).cast("long").alias("doc_id")


@query(f"SELECT doc_id, {_PATH_SQL} AS path, {_SUFFIX_SQL} AS ext FROM documents WHERE {_SUFFIX_SQL} IN {_in(SUFFIXES)}")
def discover_files(spark, sf_dir):
    return files.discover(spark, written_files(spark, sf_dir)).select(_doc_id(), F.col("source").alias("path"), "ext")


@query(f"SELECT doc_id, {_PATH_SQL} AS path FROM documents WHERE source = 'src0' AND {_SUFFIX_SQL} IN {_in(FLAT_SUFFIXES)}")
def discover_files_flat(spark, sf_dir):
    found = files.discover(spark, joined(written_files(spark, sf_dir), "src0"), recursive=False)
    return found.select(_doc_id(), F.concat(F.lit("src0/"), "source").alias("path"))


@query(f"SELECT doc_id, regexp_extract({_PATH_SQL}, '[^/]+$') AS source_file FROM documents")
def source_file_name(spark, sf_dir):
    return named_files(spark, sf_dir).select("doc_id", T.base_name("path").alias("source_file"))


@query("SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents")
def read_text(spark, sf_dir):
    given = table(spark, sf_dir, "documents").select("doc_id", F.lit(".txt").alias("ext"), F.encode("text", "UTF-8").alias("content"))
    read = parse_binary(given)
    return read.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"SELECT {_SUFFIX_SQL} AS ext, CASE WHEN {_SUFFIX_SQL} IN ('.txt', '.md', '.markdown') THEN 'text' WHEN {_SUFFIX_SQL} = '.csv' THEN 'csv' "
       f"WHEN {_SUFFIX_SQL} IN ('.pdf', '.docx') THEN 'package' ELSE 'unsupported' END AS reader, count(*) AS n FROM documents GROUP BY ALL")  # fmt: skip
def reader_dispatch(spark, sf_dir):
    kinds = {text_of: "text", csv_text: "csv", pdf_text: "package", docx_text: "package"}
    known = F.create_map(*[F.lit(x) for ext, reader in READERS.items() for x in (ext, kinds[reader])])
    reader = F.coalesce(F.try_element_at(known, "ext"), F.lit("unsupported"))
    return named_files(spark, sf_dir).groupBy("ext", reader.alias("reader")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_SUFFIX_SQL} IN ('.txt', '.md', '.markdown', '.csv') AS loaded FROM documents")
def load_partition_ok_bad(spark, sf_dir):
    # a text under the name of a package is a file that cannot be read
    given = named_files(spark, sf_dir).select("doc_id", "ext", F.encode("text", "UTF-8").alias("content"))
    return parse_binary(given).select("doc_id", F.col("error").isNull().alias("loaded"))


def _flattened(df: DataFrame, key: str) -> DataFrame:
    """A table's rows as CSV text of a file, parsed by the CSV reader."""
    row = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns])
    content = F.encode(F.concat(F.lit(",".join(df.columns) + "\n"), row), "UTF-8")
    return parse_binary(df.select(key, F.lit(".csv").alias("ext"), content.alias("content"))).select(key, "text")


@query("SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS text FROM nation")
def csv_flatten_nation(spark, sf_dir):
    return _flattened(table(spark, sf_dir, "nation"), "n_nationkey")


@query("SELECT c_custkey, 'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_acctbal: ' || c_acctbal || ', c_mktsegment: ' || c_mktsegment AS text FROM customer")
def csv_flatten_customer(spark, sf_dir):
    # the same flattening for rows that are columns already: no Python
    customers = table(spark, sf_dir, "customer")
    names = customers.columns
    rows = customers.select("c_custkey", F.array(*[F.lit(n) for n in names]).alias("h"), F.array(*[F.col(n).cast("string") for n in names]).alias("v"))
    n = F.least(F.size("h"), F.size("v"))
    pairs = F.zip_with(F.slice("h", 1, n), F.slice("v", 1, n), lambda h, v: F.concat(T.strip(h), F.lit(": "), T.strip(v)))
    return rows.select("c_custkey", F.array_join(pairs, ", ").alias("text"))


@query("SELECT c_custkey, 'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_acctbal: ' || c_acctbal || ', c_mktsegment: ' || c_mktsegment AS text FROM customer")
def csv_ranges_customer(spark, sf_dir):
    """The table written as CSV files, which many tasks read by ranges of bytes."""
    folder = joined(shared_dir(spark), f"quill/csv-{uuid.uuid4().hex}")
    table(spark, sf_dir, "customer").write.option("header", True).csv(folder)
    found = csv_lines(files.listed(spark, folder).where("source like '%.csv'").select("path", "size"), size=32 << 10)
    return found.select(F.regexp_extract("line", r"^c_custkey: (\d+)", 1).cast("long").alias("c_custkey"), F.col("line").alias("text"))


# ---- chunks -------------------------------------------------------------------------------------------------

_WS_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"


def chunk_sql(table: str = "documents", key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> str:
    """Common table expressions: ps (paragraphs), raw (pieces), chunks (key, chunk_index, text)."""
    none = "[]::varchar[]"
    return f"""
ps AS (SELECT {key}, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, {_WS_SQL})), lambda p: p <> '') AS ps FROM {table}),
pre AS (SELECT {key}, list_transform(ps, lambda p: {{'c': CASE WHEN length(p) > {size} THEN
  list_transform(range(0, length(p), {size - overlap}), lambda i: substring(p, (i + 1)::bigint, {size})) ELSE {none} END, 'u': p}}) AS qs FROM ps),
packed AS (SELECT {key}, list_reduce(qs, lambda a, x: CASE
  WHEN length(a.u) + length(x.u) + 1 <= {size} THEN {{'c': a.c, 'u': CASE WHEN a.u = '' THEN x.u ELSE a.u || chr(10) || x.u END}}
  WHEN length(x.u) > {size} THEN {{'c': a.c || CASE WHEN a.u = '' THEN {none} ELSE [a.u] END || x.c, 'u': ''}}
  ELSE {{'c': a.c || CASE WHEN a.u = '' THEN {none} ELSE [a.u] END, 'u': x.u}} END, {{'c': {none}, 'u': ''}}) AS a FROM pre),
raw AS (SELECT {key}, a.c || CASE WHEN a.u = '' THEN {none} ELSE [a.u] END AS cs FROM packed),
chunks AS (SELECT {key}, (i - 1)::int AS chunk_index, CASE WHEN i = 1 THEN cs[i] ELSE right(cs[i - 1], {overlap}) || chr(10) || cs[i] END AS text
  FROM raw, unnest(range(1, len(cs) + 1)) u(i))"""


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), SIZE, OVERLAP, source="doc_id")


@query(f"WITH {chunk_sql()} SELECT doc_id, i AS n, ps[i] AS paragraph FROM ps, unnest(range(1, len(ps) + 1)) u(i)")
def paragraphs(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs("text")).alias("n", "paragraph"))
    return each.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "paragraph")


@query(f"WITH {chunk_sql()} SELECT doc_id, i AS n, j - 1 AS slice, qs[i].c[j] AS piece FROM pre, unnest(range(1, len(qs) + 1)) u(i), unnest(range(1, len(qs[i].c) + 1)) v(j)")
def hard_split(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs("text")).alias("n", "p")).where(F.length("p") > SIZE)
    return each.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.posexplode(T.hard_split(F.col("p"), SIZE, OVERLAP)).alias("slice", "piece")).withColumn("slice", F.col("slice").cast("long"))


@query(f"WITH {chunk_sql()} SELECT doc_id, chunk_index, text FROM chunks")
def chunk_documents(spark, sf_dir):
    return doc_chunks(spark, sf_dir)


@query(f"WITH {chunk_sql()} SELECT doc_id, chunk_index, text FROM chunks")
def overlap_lag(spark, sf_dir):
    return chunking.chunks_by_lag(table(spark, sf_dir, "documents"), SIZE, OVERLAP, source="doc_id")


@query(f"WITH p AS (SELECT page_id, html AS text FROM pages), {chunk_sql('p', 'page_id')} SELECT page_id, chunk_index, text FROM chunks")
def chunk_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return chunking.chunks(pages, SIZE, OVERLAP, source="page_id")


@query(f"WITH {chunk_sql()} SELECT source || '/doc_' || doc_id || '::chunk_' || chunk_index AS id FROM chunks JOIN documents USING (doc_id)")
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string")))
    return chunking.chunks(docs, SIZE, OVERLAP, source="path").select(T.chunk_id("path", F.col("chunk_index").cast("string")).alias("id"))


@query(f"WITH {chunk_sql()} SELECT doc_id, len(cs) AS n_chunks FROM raw")
def chunks_per_source(spark, sf_dir):
    return chunking.raw_chunks(table(spark, sf_dir, "documents"), SIZE, OVERLAP).select("doc_id", F.size("pieces").cast("long").alias("n_chunks"))


@query(f"WITH {chunk_sql()} SELECT count(*) AS n, sum(length(text))::bigint AS chars, max(length(text)) AS longest FROM chunks")
def chunk_stats(spark, sf_dir):
    n = F.length("text").cast("long")
    return doc_chunks(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.max(n).alias("longest"))


@query()
def recursive_split(spark, sf_dir):
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"), SIZE, OVERLAP, source="doc_id")


# ---- vectors and search -------------------------------------------------------------------------------------

_Q = "(SELECT embedding::double[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = "list_cosine_similarity(e.embedding::double[], q)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), V.doubles("embedding").alias("embedding"), "label")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(vectors(spark, sf_dir).where("seq = 0").first().embedding)


def _literal(values: list[float]):
    return F.array(*[F.lit(float(v)) for v in values])


@query(f"SELECT vec_id, round(list_inner_product(e.embedding::double[], q), 6) AS d FROM embeddings e, {_Q}")
def dot_product(spark, sf_dir):
    q = _literal(first_vector(spark, sf_dir))
    return vectors(spark, sf_dir).select(F.col("seq").alias("vec_id"), F.round(V.dot(F.col("embedding"), q), 6).alias("d"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) AS n FROM embeddings")
def vector_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("seq").alias("vec_id"), F.round(V.norm(F.col("embedding")), 6).alias("n"))


@query(f"SELECT e.vec_id, label, round({_COS}, 6) AS score FROM embeddings e, {_Q}")
def cosine_pairs(spark, sf_dir):
    found = search.scored(vectors(spark, sf_dir), first_vector(spark, sf_dir))
    return found.select(F.col("seq").alias("vec_id"), "label", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, CASE WHEN e.vec_id % 5 = 0 THEN 0.0::double ELSE round({_COS}, 6) END AS score FROM embeddings e, {_Q}")
def cosine_zero_norm(spark, sf_dir):
    some = vectors(spark, sf_dir)
    zeroed = some.withColumn("embedding", F.when(F.col("seq") % 5 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.col("embedding")))
    return search.scored(zeroed, first_vector(spark, sf_dir)).select(F.col("seq").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"""SELECT e.vec_id, round(list_inner_product(e.embedding[1:48]::double[], q[1:48]) / (sqrt(list_sum(list_transform(e.embedding[1:48]::double[], lambda x: x * x)))
  * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6) AS score FROM embeddings e, {_Q}""")
def cosine_dim_mismatch(spark, sf_dir):
    short = vectors(spark, sf_dir).withColumn("embedding", F.slice("embedding", 1, 48))
    return search.scored(short, first_vector(spark, sf_dir)).select(F.col("seq").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} ORDER BY score DESC, vec_id LIMIT 5")
def search_topk(spark, sf_dir):
    return search.top(vectors(spark, sf_dir), first_vector(spark, sf_dir), 5).select(F.col("seq").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} WHERE {_COS} >= 0.3")
def search_threshold(spark, sf_dir):
    found = search.scored(vectors(spark, sf_dir), first_vector(spark, sf_dir)).where(search.passes("score", 0.3))
    return found.select(F.col("seq").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} WHERE {_COS} >= 0.55 ORDER BY score DESC, vec_id LIMIT 5")
def search_default_threshold(spark, sf_dir):
    return search.top(vectors(spark, sf_dir), first_vector(spark, sf_dir), 5, 0.55).select(F.col("seq").alias("vec_id"), F.round("score", 6).alias("score"))


_BATCH_SQL = """WITH p AS (SELECT q.vec_id AS qid, e.vec_id AS vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::int AS rank FROM p WHERE score >= 0.3
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 5"""


def _vector_questions(all_vectors: DataFrame) -> DataFrame:
    return all_vectors.where("seq % 20 = 0").select(F.col("seq").alias("qid"), F.col("embedding").alias("query"))


@query(_BATCH_SQL)
def batch_retrieve(spark, sf_dir):
    all_vectors = vectors(spark, sf_dir)
    hits = search.batch_top(all_vectors, _vector_questions(all_vectors), 5, 0.3, digits=6)
    return hits.select("qid", F.col("seq").alias("vec_id"), "score", "rank")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[VectorLists, DataFrame]:
    all_vectors = vectors(spark, sf_dir)
    lists = VectorLists(spark, joined(shared_dir(spark), f"quill/lists-{uuid.uuid4().hex}"))
    lists.build(all_vectors)
    return lists, _vector_questions(all_vectors)


@query(_BATCH_SQL)
def bounded_retrieve(spark, sf_dir):
    """The same hits from inverted lists, of which those are skipped that cannot hold a better one."""
    lists, asked = _lists(spark, sf_dir)
    return lists.exact(asked, 5, 0.3, digits=6)[0].select("qid", F.col("seq").alias("vec_id"), "score", "rank")


@query()
def probe_retrieve(spark, sf_dir):
    """The hits in the nearest lists of each question; a test holds them against those of all vectors."""
    lists, asked = _lists(spark, sf_dir)
    return lists.probe(asked, 5, 0.3, digits=6).select("qid", F.col("seq").alias("vec_id"), "score", "rank")


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(e.embedding::double[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM embeddings e, {_Q} ORDER BY distance, vec_id LIMIT 4")
def l2_topk(spark, sf_dir):
    return search.nearest(vectors(spark, sf_dir), first_vector(spark, sf_dir), 4).select(F.col("seq").alias("vec_id"), F.round("distance", 6).alias("distance"))


def _embed_sql(text: str) -> str:
    buckets = f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda t: (('0x' || substr(md5(t), 1, 8))::ubigint % {DIM})::bigint)"
    return f"list_transform(range({DIM}), lambda i: len(list_filter({buckets}, lambda b: b = i))::double)"


@query(f"WITH {chunk_sql()} SELECT doc_id, chunk_index, array_to_string(list_transform({_embed_sql('text')}, lambda x: x::bigint), ' ') AS embedding FROM chunks")
def embed_chunks(spark, sf_dir):
    v = F.transform(Offline(DIM).embed("text"), lambda x: x.cast("long").cast("string"))
    return doc_chunks(spark, sf_dir).select("doc_id", "chunk_index", F.array_join(v, " ").alias("embedding"))


@query(f"WITH {chunk_sql()} SELECT doc_id, chunk_index // 32 AS batch, count(*) AS n FROM chunks GROUP BY ALL")
def embed_batches(spark, sf_dir):
    """Requests that the embedding of each changed file takes, as the provider's batching makes them."""

    @F.pandas_udf("array<long>")
    def sizes(counts: pd.Series) -> pd.Series:
        def of(n: int) -> list[int]:
            asked: list[int] = []
            in_batches([""] * n, lambda part: asked.append(len(part)) or [[]] * len(part))
            return asked

        return counts.map(of)

    pieces = chunking.raw_chunks(table(spark, sf_dir, "documents"), SIZE, OVERLAP)
    return pieces.select("doc_id", F.posexplode(sizes(F.size("pieces"))).alias("batch", "n"))


_RETRIEVE_SQL = f"""
qs AS (SELECT item_id AS qid, text AS question FROM benchmark),
ce AS (SELECT doc_id, chunk_index, text, {_embed_sql('text')} AS e FROM chunks),
qe AS (SELECT qid, {_embed_sql('question')} AS e FROM qs),
sc AS (SELECT qid, doc_id, chunk_index, round(CASE WHEN list_sum(c.e) = 0 OR list_sum(q.e) = 0 THEN 0.0 ELSE list_cosine_similarity(c.e, q.e) END, 6) AS score FROM ce c, qe q),
hits AS (SELECT qid, doc_id, chunk_index, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_index))::int AS rank FROM sc WHERE score >= 0.7
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_index) <= 5)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = doc_chunks(spark, sf_dir).select("doc_id", "chunk_index", Offline(DIM).embed("text").alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), Offline(DIM).embed("text").alias("query"))
    return search.batch_top(own, asked, 5, 0.7, order=("doc_id", "chunk_index"), digits=6).select("qid", "doc_id", "chunk_index", "score", "rank")


@query(f"WITH {chunk_sql()}, {_RETRIEVE_SQL} SELECT * FROM hits")
def retrieve_documents(spark, sf_dir):
    return hits(spark, sf_dir)


# ---- sync ---------------------------------------------------------------------------------------------------

_CURRENT_SQL = "cur AS (SELECT source || '/doc_' || doc_id || '.txt' AS source, sha256(text) AS digest, doc_id, text FROM documents WHERE doc_id % 11 <> 0)"
_OLD_SQL = "old AS (SELECT source || '/doc_' || doc_id || '.txt' AS source, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS digest, doc_id, text FROM documents WHERE doc_id % 10 <> 0)"
_DIFF_SQL = f"""{_CURRENT_SQL}, {_OLD_SQL},
diff AS (SELECT coalesce(c.source, o.source) AS source, c.digest, CASE WHEN c.source IS NULL THEN 'removed' WHEN o.source IS NULL THEN 'added'
  WHEN c.digest = o.digest THEN 'unchanged' ELSE 'updated' END AS status FROM cur c FULL OUTER JOIN old o ON c.source = o.source)"""


def snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, old) files: the table without every eleventh, and without every tenth and some altered."""
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select(path.alias("source"), "doc_id", "text")
    current = docs.where("doc_id % 11 <> 0").withColumn("digest", T.fingerprint("text"))
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return current, docs.where("doc_id % 10 <> 0").withColumn("digest", T.fingerprint(altered))


def _diff(spark, sf_dir):
    return sync.changes(*(x.select("source", "digest") for x in snapshot(spark, sf_dir)))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint("text").alias("digest"))


@query(f"WITH {_DIFF_SQL} SELECT source, digest, status FROM diff")
def sync_changes(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"WITH {_DIFF_SQL} SELECT source FROM diff WHERE status = 'updated'")
def sync_updated(spark, sf_dir):
    current, old = snapshot(spark, sf_dir)
    known = current.select("source", "digest").join(old.select("source"), "source", "left_semi")
    return known.join(old.select("source", "digest"), ["source", "digest"], "left_anti").select("source")


@query(f"WITH {_DIFF_SQL} SELECT source FROM diff WHERE status = 'removed'")
def sync_removed(spark, sf_dir):
    current, old = snapshot(spark, sf_dir)
    return old.select("source").join(current.select("source"), "source", "left_anti")


def _records(files: DataFrame) -> DataFrame:
    return chunking.chunks(files, SIZE, OVERLAP)


@query(f"""WITH {_DIFF_SQL}, {chunk_sql('cur', 'source')} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated,
  count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed, (SELECT count(*) FROM chunks) AS total_chunks FROM diff""")
def sync_summary(spark, sf_dir):
    return sync.summary(_diff(spark, sf_dir), _records(snapshot(spark, sf_dir)[0]))


@query(f"WITH {_CURRENT_SQL} SELECT count(*) AS added, 0::bigint AS updated, 0::bigint AS unchanged, 0::bigint AS removed FROM cur")
def sync_force(spark, sf_dir):
    current, old = snapshot(spark, sf_dir)
    diff = sync.changes(current, old.where("false"))
    return sync.summary(diff, 0).drop("total_chunks")


@query(f"WITH {_DIFF_SQL}, {chunk_sql('old', 'source')} SELECT source, chunk_index FROM chunks WHERE source NOT IN (SELECT source FROM diff WHERE status IN ('updated', 'removed'))")
def remove_sources(spark, sf_dir):
    return sync.retained(_records(snapshot(spark, sf_dir)[1]), _diff(spark, sf_dir)).select("source", "chunk_index")


@query(f"WITH {_CURRENT_SQL}, {chunk_sql('cur', 'source')} SELECT source, chunk_index, md5(text) AS digest FROM chunks")
def upsert_index(spark, sf_dir):
    current, old = snapshot(spark, sf_dir)
    diff = _diff(spark, sf_dir)
    fresh = current.join(diff.where("status in ('added', 'updated')").select("source"), "source", "left_semi")
    both = sync.retained(_records(old), diff).unionByName(_records(fresh))
    return both.select("source", "chunk_index", F.md5("text").alias("digest"))


@query(f"WITH {_DIFF_SQL}, {chunk_sql('cur', 'source')}, n AS (SELECT source, count(*) AS n FROM chunks GROUP BY source) SELECT source, CASE status WHEN 'removed' THEN '[sync] Removed (deleted from disk): ' || source "
       "WHEN 'added' THEN '[sync] Added: ' || source || ' (' || coalesce(n, 0) || ' chunks)' ELSE '[sync] Updated: ' || source || ' (' || coalesce(n, 0) || ' chunks)' END AS line FROM diff LEFT JOIN n USING (source) WHERE status <> 'unchanged'")  # fmt: skip
def sync_log(spark, sf_dir):
    per = _records(snapshot(spark, sf_dir)[0]).groupBy("source").agg(F.count("*").alias("n_chunks"))
    return sync.log_lines(_diff(spark, sf_dir), per)


@query(f"WITH {chunk_sql()} SELECT doc_id, chunk_index, length(text) AS n FROM chunks")
def index_roundtrip(spark, sf_dir):
    """Records written to an index, read from it, and taken through its JSON form."""
    made = doc_chunks(spark, sf_dir).withColumn("source", F.col("doc_id").cast("string"))
    vector = Offline(DIM).embed("text")
    records = made.select(
        T.chunk_id("source", F.col("chunk_index").cast("string")).alias("id"), "text", "source", F.col("chunk_index").cast("int"),
        vector.alias("embedding"), V.norm(vector).alias("norm"), F.lit(0).cast("long").alias("seq"),
    )
    index = Index(spark, joined(shared_dir(spark), f"quill/index-{uuid.uuid4().hex}"))
    digests = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), T.fingerprint("text").alias("digest"), F.lit("").alias("config"))
    index.commit(records, digests)
    schema = "id string, text string, source string, chunk_index int, embedding array<double>"
    back = index.records().select("embedding", F.from_json(F.to_json(F.struct("id", "text", "source", "chunk_index", "embedding")), schema, {"mode": "FAILFAST"}).alias("r"))
    return back.where("r.embedding = embedding and r.id = r.source || '::chunk_' || r.chunk_index").select(
        F.col("r.source").cast("long").alias("doc_id"), "r.chunk_index", F.length("r.text").cast("long").alias("n")
    )


# ---- answers ------------------------------------------------------------------------------------------------

_BLOCK_SQL = "'[Source: ' || doc_id || ' | chunk ' || chunk_index || ']' || chr(10) || text"
_SEP_SQL = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_CONTEXT_SQL = f"ctx AS (SELECT qid, array_to_string(list({_BLOCK_SQL} ORDER BY rank), {_SEP_SQL}) AS context FROM hits JOIN chunks USING (doc_id, chunk_index) GROUP BY qid)"
_ALL_SQL = f"WITH {chunk_sql()}, {_RETRIEVE_SQL}, {_CONTEXT_SQL}"
_PROMPT_SQL = f"'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || '{P.CLOSING}'"


def hit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir)
    return found.join(doc_chunks(spark, sf_dir), ["doc_id", "chunk_index"]).withColumn("source", F.col("doc_id").cast("string"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query(f"{_ALL_SQL} SELECT qid, context FROM ctx")
def build_context(spark, sf_dir):
    return contexts(hit_texts(spark, sf_dir)).select("qid", "context")


@query(f"{_ALL_SQL} SELECT qid, md5({_PROMPT_SQL}) AS digest FROM ctx JOIN qs USING (qid)")
def build_prompt(spark, sf_dir):
    joined = contexts(hit_texts(spark, sf_dir)).join(asked(spark, sf_dir), "qid")
    return joined.select("qid", F.md5(P.prompt("context", "question")).alias("digest"))


@query(f"{_ALL_SQL} SELECT qid, doc_id::varchar AS source, chunk_index, round(score, 3) AS score FROM hits")
def citations(spark, sf_dir):
    cited = contexts(hit_texts(spark, sf_dir)).select("qid", F.explode("sources").alias("s"))
    return cited.select("qid", "s.source", "s.chunk_index", "s.score")


@query(f"{_ALL_SQL} SELECT qid, array_to_string(list_sort(list(DISTINCT CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE doc_id::varchar END)), ', ') AS sources FROM hits GROUP BY qid")
def distinct_sources(spark, sf_dir):
    named = hits(spark, sf_dir).withColumn("f", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id").cast("string")))
    return named.groupBy("qid").agg(F.array_join(P.distinct_sources("f"), ", ").alias("sources"))


@query(f"{_ALL_SQL} SELECT qs.qid, CASE WHEN context IS NULL THEN '{P.NOT_FOUND.replace(chr(39), chr(39) * 2)}' ELSE trim(string_split(context, {_SEP_SQL})[1], {_WS_SQL}) END AS answer, (context IS NULL)::int AS hidden FROM qs LEFT JOIN ctx USING (qid)")
def answer_gate(spark, sf_dir):
    out = answered(asked(spark, sf_dir), hit_texts(spark, sf_dir), Offline(DIM))
    return out.select("qid", T.strip("answer").alias("answer"), (F.size("sources") == 0).cast("int").alias("hidden"))


_SAID_SQL = f"CASE conv_id % 3 WHEN 0 THEN upper('{P.NOT_FOUND.replace(chr(39), chr(39) * 2)}') || text WHEN 1 THEN text || lower('{P.NOT_FOUND.replace(chr(39), chr(39) * 2)}') ELSE text END"


@query(f"SELECT conv_id, turn, contains(lower({_SAID_SQL}), lower('{P.NOT_FOUND.replace(chr(39), chr(39) * 2)}')) AS hidden FROM conversations")
def suppress_sources(spark, sf_dir):
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(P.NOT_FOUND.upper()), F.col("text"))).when(F.col("conv_id") % 3 == 1, F.concat("text", F.lit(P.NOT_FOUND.lower()))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.hides_sources(said).alias("hidden"))


@query("SELECT conv_id, turn, trim(text) AS question FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT lower(trim(text)) IN ('exit', 'quit')")
def chat_questions(spark, sf_dir):
    q = T.strip("text")
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", q.alias("question"))
    return users.where((F.col("question") != "") & ~F.lower("question").isin("exit", "quit"))
