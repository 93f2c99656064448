"""The retrievers by name, over one corpus whose shared parts are computed once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators import fusion, lexical, vectors

Retriever = Callable[[DataFrame, int], DataFrame]


class Corpus:
    """Chunks (chunk_id, paper_id, section, page, text, and maybe embedding, embedding_header) with the titles of their papers.

    Questions are (qid, question, and embedding for the vector retrievers); a retriever takes them and k and returns
    (qid, chunk_id, score, rank).
    """

    def __init__(self, chunks: DataFrame, titles: DataFrame | None = None):
        self.chunks, self.titles = chunks, titles

    @cached_property
    def headed(self) -> DataFrame:
        """Chunks whose text begins with title and section; without a title, with the paper's id."""
        named = self.chunks if self.titles is None else self.chunks.join(self.titles.select("paper_id", "title"), "paper_id", "left")
        title = F.lit(None).cast("string") if self.titles is None else F.col("title")
        return named.select("chunk_id", T.with_header(title, F.col("paper_id"), F.col("section"), F.col("text")).alias("text"))

    @cached_property
    def store(self) -> lexical.Store:
        """The plain texts' words and index, for BM25."""
        return lexical.Store(self.chunks)

    @cached_property
    def headed_store(self) -> lexical.Store:
        return lexical.Store(self.headed)

    @cached_property
    def lexeme_store(self) -> lexical.Store:
        """The plain texts' stems, for full text."""
        return lexical.lexeme_store(self.chunks)

    def _lexical(self, header: bool) -> Retriever:
        return lambda q, k: lexical.bm25(q, self.headed_store if header else self.store, k)

    def _vector(self, header: bool) -> Retriever:
        column = "embedding_header" if header else "embedding"
        return lambda q, k: vectors.vector_topk(q, self.chunks.select("chunk_id", F.col(column).alias("embedding")), k)

    def _hybrid(self, header: bool) -> Retriever:
        def run(q: DataFrame, k: int) -> DataFrame:
            pool = max(k, fusion.POOL)
            return fusion.reciprocal_rank_fusion([self._lexical(header)(q, pool), self._vector(header)(q, pool)], k)

        return run

    def _reranked(self, base: Retriever, scorer) -> Retriever:
        return lambda q, k: fusion.rerank(q, self.chunks, base(q, max(k, fusion.RERANK_POOL)), k, scorer)

    def retrievers(self, names: list[str] | None = None, scorer=T.overlap_score) -> dict[str, Retriever]:
        """All nine, or those named; reranking scores the plain text even of the header variants."""
        found: dict[str, Retriever] = {
            "fts": lambda q, k: lexical.full_text(q, self.lexeme_store, k),
            "bm25": self._lexical(False),
            "bm25_header": self._lexical(True),
            "vector": self._vector(False),
            "vector_header": self._vector(True),
            "hybrid": self._hybrid(False),
            "hybrid_header": self._hybrid(True),
            "hybrid_rerank": self._reranked(self._hybrid(False), scorer),
            "hybrid_header_rerank": self._reranked(self._hybrid(True), scorer),
        }
        unknown = [n for n in names or [] if n not in found]
        if unknown:
            raise ValueError(f"unknown retriever: {', '.join(unknown)}; known: {', '.join(found)}")
        return {n: found[n] for n in names} if names else found
