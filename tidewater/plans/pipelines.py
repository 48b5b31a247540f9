"""Composed plans: a folder of files to audited chunks, and questions to context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators import chunksets as cs
from tidewater.operators import segments as sg
from tidewater.sources import files as fs


def build_chunks(files: DataFrame, max_words: int = sg.CHUNK_WORDS) -> DataFrame:
    """(path, position, title, body) of the readable files of ``files.discover``.

    DOCX paragraphs are gathered under their headings, text files are cut at their
    clauses (whole if they have none), and bodies beyond the word budget are split.
    """
    under = fs.heading_paths(fs.read_docx(files))
    docx = under.groupBy("path", F.array_join("headings", " / ").alias("title")).agg(F.min("position").alias("at"), F.sort_array(F.collect_list(F.struct("position", "text"))).alias("_t"))
    docx = docx.select("path", "at", "title", F.array_join(F.transform("_t", lambda t: t["text"]), "\n").alias("body"))
    texts = fs.read_texts(files)
    clauses = sg.clause_chunks(texts, "path", "text").select("path", F.col("position").alias("at"), "title", "body")
    whole = texts.join(clauses.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).alias("at"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    rows = docx.unionByName(clauses).unionByName(whole).where("trim(body) <> ''").withColumn("_key", F.struct("path", "at"))
    parts = sg.word_chunks(rows, "_key", "title", "body", max_words).select("_key.path", "_key.at", "part", "title", "body")
    return sg.renumber(parts, ["path"], ["at", "part"]).select("path", "position", "title", "body")


def audit_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Coverage of each file: words and headings of the source against its chunks."""
    d = fs.read_docx(files)
    source = d.select("path", tx.word_count(F.col("text")).alias("n")).unionByName(fs.read_texts(files).select("path", F.col("words").alias("n"))).groupBy(F.col("path").alias("doc_id")).agg(F.sum("n").alias("words"))
    heads = d.where("kind = 'heading'").select(F.col("path").alias("doc_id"), F.col("text").alias("heading"))
    c = chunks.withColumnRenamed("path", "doc_id")
    return cs.coverage(c, c, source, heads)


def answer_context(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, wanted: str | None = None) -> DataFrame:
    """(query_id, context): the ``k`` nearest chunks of each question as one numbered text.

    ``questions``: query_id, embedding (and the filter column ``wanted``);
    ``vectors``: vec_id, embedding, label; ``chunks``: vec_id, title, body.
    """
    hits = cs.top_matches(questions, vectors, k, wanted)
    m = hits.join(chunks, "vec_id").select("query_id", "rank", F.col("title").alias("header"), F.col("body").alias("content"), "score")
    return cs.context_blocks(m)
