"""Batch question answering: retrieve -> context block -> prompt -> template answer.

Questions are a table; answers are a table. Nothing is routed through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators.embed import embed_to_search, tfidf_index
from leadlens.operators.ordering import with_global_row_number
from leadlens.operators.retrieve import nearest_sparse

# ---------------------------------------------------------------------------
# Texts of the assistant that must equal the surveyed application's.
# ---------------------------------------------------------------------------
NO_CONTEXT = "No relevant context found."
NO_DATA = "No data available. Please upload and process lead data first."
# White space that a question is stripped of (the characters Python's strip removes).
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTEXT_HEADER = "Relevant Information:\n\n"
PROMPT_TEMPLATE = (
    "You are an AI assistant for a B2B Lead Scoring and Account-Based Marketing (ABM) system.\n"
    "You help users understand their lead data, predictions, and provide insights.\n"
    "\n"
    "Use the following context to answer the user's question. Be concise, accurate, and helpful.\n"
    "If the context doesn't contain enough information, say so politely.\n"
    "\n"
    "Context:\n"
    "{context}\n"
    "\n"
    "User Question: {query}\n"
    "\n"
    "Provide a helpful, professional response:"
)
ANSWER_HIGH = ("Based on the data, high-quality leads typically have higher engagement scores, larger company "
               "sizes, and higher annual revenue. Focus on leads with 'High' predicted scores and high confidence levels.")
ANSWER_HIGH_FALLBACK = ("I found some relevant information, but please check the 'High Quality' metric in the "
                        "dashboard for the most accurate count.")
HEADING_INDUSTRY = "Based on the data:\n"
FALLBACK_INDUSTRY = "Please check the 'Top Industries' chart in the dashboard for industry breakdown."
HEADING_REVENUE = "Revenue information:\n"
FALLBACK_REVENUE = "Please check the 'Annual Revenue' column in the results table for revenue details."
HEADING_ENGAGEMENT = "Engagement metrics:\n"
FALLBACK_ENGAGEMENT = "Please check the 'Engagement Score' column in the results table for engagement details."
DEFAULT_PREFIX = "Based on the available data: "
DEFAULT_SUFFIX = "...\n\nFor more detailed information, please check the dashboard metrics and tables."
HIGH_WORDS = ("high", "best", "top")
CONTEXT_PREFIX_CHARS = 200
LINES_PER_TOPIC = 3


_EMPTY_VEC = "array<struct<term:string,w:double>>"


def chunk_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(chunk_id, vec) for every chunk (a chunk without weighted terms gets the zero
    vector, an empty array), the corpus' document frequencies and its size."""
    return tfidf_index(chunks)


def retrieve(chunks: DataFrame, questions: DataFrame, qkey: list[str], k: int = S.DEFAULT_TOP_K,
             text: str = "text", index: tuple | None = None) -> DataFrame:
    """(qkey..., chunk_id, distance, rank) over the chunk table's TF-IDF space. ``index``
    is ``chunk_index(chunks)``; without it the index is computed in the query. The number of chunks
    and entries is taken from the document frequencies, so the vectors are read once."""
    all_vecs, dfreq, n_docs = index if index is not None else chunk_index(chunks)
    empty = F.array().cast(_EMPTY_VEC)
    qvecs = embed_to_search(questions, qkey, dfreq, n_docs, text)
    # questions without any weighted term are zero vectors: still answered
    qall = (questions.select(*qkey).join(qvecs, qkey, "left")
            .select(*qkey, F.coalesce("vec", empty).alias("vec"), F.coalesce("norm2", F.lit(0.0)).alias("norm2")))
    n, entries = dfreq.agg(n_docs, F.coalesce(F.sum("df"), F.lit(0))).first()
    return nearest_sparse(all_vecs, qall, qkey, k, size_of=(n, entries))


METADATA = ["type", "index", "industry", "company_size", "lead_score"]


def hits_with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the chunk's text and its metadata as one struct."""
    return hits.join(chunks.select("chunk_id", "text", F.struct(*[c for c in METADATA if c in chunks.columns] or ["chunk_id"])
                                   .alias("metadata")), "chunk_id")


def context_blocks(hits: DataFrame, chunks: DataFrame, questions: DataFrame, qkey: list[str]) -> DataFrame:
    """(qkey..., context, contexts_used, source_ids, sources): numbered block of the retrieved
    texts, and the metadata of its chunks in the same order. Per question the hits are at most k
    rows, so the collect is bounded."""
    per_q = hits_with_text(hits, chunks).groupBy(*qkey).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "chunk_id", "metadata")),
                     lambda x, y: x["rank"] - y["rank"]).alias("hits"))
    block = F.concat(F.lit(CONTEXT_HEADER), F.array_join(F.transform(
        "hits", lambda h: F.concat(h["rank"].cast("string"), F.lit(". "), h["text"], F.lit("\n\n"))), ""))
    out = questions.select(*qkey).join(per_q, qkey, "left")
    return out.select(
        *qkey,
        F.when(F.size(F.coalesce("hits", F.array())) > 0, block).otherwise(F.lit(NO_CONTEXT)).alias("context"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("int").alias("contexts_used"),
        F.coalesce(F.array_join(F.transform("hits", lambda h: h["chunk_id"]), ","), F.lit("")).alias("source_ids"),
        F.transform("hits", lambda h: h["metadata"]).alias("sources"))


def prompt_text(context: Column, query: Column) -> Column:
    head, rest = PROMPT_TEMPLATE.split("{context}")
    mid, tail = rest.split("{query}")
    return F.concat(F.lit(head), context, F.lit(mid), query, F.lit(tail))


def _lines_with(context: Column, word: str) -> Column:
    lines = F.filter(F.split(context, "\n"), lambda ln: F.lower(ln).contains(word))
    return F.array_join(F.slice(lines, 1, LINES_PER_TOPIC), "\n")


def template_answer(query: Column, context: Column) -> Column:
    """Keyword routing on the lower-cased question; first match wins; substring match."""
    q, ctx = F.lower(query), F.lower(context)
    hit_high = q.contains(HIGH_WORDS[0]) | q.contains(HIGH_WORDS[1]) | q.contains(HIGH_WORDS[2])
    return (F.when(hit_high, F.when(ctx.contains("lead") | ctx.contains("high"), F.lit(ANSWER_HIGH))
                   .otherwise(F.lit(ANSWER_HIGH_FALLBACK)))
            .when(q.contains("industry"), F.when(ctx.contains("industry"),
                  F.concat(F.lit(HEADING_INDUSTRY), _lines_with(context, "industry"))).otherwise(F.lit(FALLBACK_INDUSTRY)))
            .when(q.contains("revenue"), F.when(ctx.contains("revenue"),
                  F.concat(F.lit(HEADING_REVENUE), _lines_with(context, "revenue"))).otherwise(F.lit(FALLBACK_REVENUE)))
            .when(q.contains("engagement"), F.when(ctx.contains("engagement"),
                  F.concat(F.lit(HEADING_ENGAGEMENT), _lines_with(context, "engagement")))
                  .otherwise(F.lit(FALLBACK_ENGAGEMENT)))
            .otherwise(F.concat(F.lit(DEFAULT_PREFIX), F.substring(context, 1, CONTEXT_PREFIX_CHARS),
                                F.lit(DEFAULT_SUFFIX))))


def answer_questions(chunks: DataFrame, questions: DataFrame, qkey: list[str], k: int = S.DEFAULT_TOP_K,
                     text: str = "text", index: tuple | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(qkey..., question, response, contexts_used, source_ids, sources, context). ``hits``:
    written hits of these questions; without them they are retrieved."""
    if hits is None:
        hits = retrieve(chunks, questions, qkey, k, text, index)
    blocks = context_blocks(hits, chunks, questions, qkey)
    out = questions.select(*qkey, F.col(text).alias("question")).join(blocks, qkey)
    return out.select(*qkey, "question", template_answer(F.col("question"), F.col("context")).alias("response"),
                      "contexts_used", "source_ids", "sources", "context")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def user_questions(conversations: DataFrame) -> DataFrame:
    """User turns as questions: (conv_id, turn, text), stripped; blank ones are not asked."""
    asked = conversations.where(F.col("role") == "user").select("conv_id", "turn", strip(F.col("text")).alias("text"))
    return asked.where(F.col("text") != "")


def append_answers(conversations: DataFrame, answers: DataFrame) -> DataFrame:
    """Chat log with one assistant turn per answered question at the conversation's end, in the
    order of the questions: (conv_id, turn, role, text, contexts_used).

    New turns are numbered by one distributed numbering in (conv_id, turn) order less the
    conversation's first number, so a long conversation is never in one task whole."""
    last = conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    placed = with_global_row_number(answers.select("conv_id", "turn", "response", "contexts_used"),
                                    [F.col("conv_id").asc(), F.col("turn").asc()], "__n")
    first = placed.groupBy("conv_id").agg(F.min("__n").alias("__first"))
    new = (placed.join(first.join(last, "conv_id"), "conv_id")
           .select("conv_id", (F.col("last_turn") + F.col("__n") - F.col("__first") + 1).alias("turn"),
                   F.lit("assistant").alias("role"), F.col("response").alias("text"), F.col("contexts_used")))
    old = conversations.select("conv_id", "turn", "role", "text", F.lit(None).cast("int").alias("contexts_used"))
    return old.unionByName(new)


def last_messages(log: DataFrame) -> DataFrame:
    """Latest message per conversation (max_by on turn: a partially aggregated group-by)."""
    m = F.max_by(F.struct("turn", "role", "text", "contexts_used"), F.col("turn"))
    return log.groupBy("conv_id").agg(m.alias("m"), F.count(F.lit(1)).alias("n_messages")).select(
        "conv_id", "m.turn", "m.role", "m.text", "m.contexts_used", "n_messages")
