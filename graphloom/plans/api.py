"""The query surface: one function for each question a client can ask.

A :class:`Landscape` holds the tables (DataFrames) and the reference date; its
methods return DataFrames, or a dict of them, and run nothing by themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dates, text
from graphloom.operators import curation, digest, extract, graph, quality, resolve, temporal
from graphloom.sources import corpus, records


class NotFound(LookupError):
    """A name or id that the graph does not hold."""


@dataclass
class Landscape:
    """documents, mentions, nodes, aliases, edges, node_documents; optional runs, subfields, corrections, tours."""

    tables: Mapping[str, DataFrame]
    as_of: str
    generic: Sequence[str] = field(default=graph.GENERIC)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None

    # graph

    def graph(self, **options) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a sub-graph; options as in :func:`graphloom.operators.graph.subgraph`."""
        return graph.subgraph(self.nodes, self.edges, generic=self.generic, **options)

    def path(self, a: str, b: str) -> DataFrame:
        """Shortest path between two names."""
        ends = []
        for name in (a, b):
            row = graph.resolve_name(self.nodes, name).select("id").first()
            if row is None:
                raise NotFound(name)
            ends.append(row["id"])
        steps = graph.shortest_path(self.edges, *ends)
        name = self.nodes.select("id", "canonical_name")
        return steps.join(name.select(F.col("id").alias("from_id"), F.col("canonical_name").alias("from_name")), "from_id").join(name.select(F.col("id").alias("to_id"), F.col("canonical_name").alias("to_name")), "to_id").orderBy("step")

    def _known(self, node_id: int) -> None:
        if self.nodes.where(F.col("id") == node_id).isEmpty():
            raise NotFound(node_id)

    def node(self, node_id: int) -> dict[str, DataFrame]:
        self._known(node_id)
        return {"node": self.nodes.where(F.col("id") == node_id), "neighbours": graph.neighbours(self.nodes, self.edges, node_id), "aliases": self.aliases.where(F.col("node_id") == node_id).select("alias")}

    def node_documents(self, node_id: int, limit: int = 50) -> dict[str, DataFrame]:
        self._known(node_id)
        link = self.tables["node_documents"].where(F.col("node_id") == node_id)
        return {"documents": digest.node_documents(self.documents, link, node_id, limit), "volume": temporal.node_monthly(self.documents, link, node_id), "momentum": temporal.momentum(self.documents, link, self.as_of)}

    def adjacent(self, node_id: int, limit: int = 6) -> DataFrame:
        self._known(node_id)
        return graph.adjacent(self.nodes, self.edges, node_id, limit)

    def tours(self) -> DataFrame:
        return graph.tour(self.tables["tours"], self.nodes)

    def types(self) -> dict[str, DataFrame]:
        return {"types": quality.share(self.nodes, "type"), "relations": quality.share(self.edges, "relation")}

    # search and reading

    def search(self, q: str, limit: int = 20, since: str | None = None, relation: str | None = None) -> dict[str, DataFrame]:
        return {"entities": digest.search_entities(self.nodes, self.aliases, self.edges, q, limit, since, relation), "documents": digest.search_documents(self.documents, q, limit, since)}

    def document(self, content_hash: str) -> DataFrame:
        return self.documents.where(F.col("content_hash") == content_hash)

    def mark_read(self, hashes: DataFrame, at: str) -> DataFrame:
        return curation.mark_read(self.documents, hashes, at)

    # overview and time

    def overview(self) -> dict[str, DataFrame]:
        return {
            "figures": quality.overview(self.documents, self.mentions, self.nodes, self.edges), "distributions": quality.distributions(self.nodes, self.edges), "partial": quality.partial_duplicates(self.nodes), "dates": quality.date_quality(self.documents), "signal": quality.signal_coverage(self.documents, self.mentions),
            "top": graph.top_nodes(self.nodes, 10), "connected": graph.most_connected(self.nodes, self.edges), "reading": quality.reading(self.documents), **self.types(),
            **({"sources": quality.source_health(self.documents, self.runs, self.as_of), "diff": quality.run_diff(self.runs)} if "runs" in self.tables else {}),
        }

    def history(self, limit: int = 60) -> dict[str, DataFrame]:
        return {"runs": records.tail(self.runs, limit), "broken": quality.broken_sources(self.runs, limit)}

    def trends(self) -> dict[str, DataFrame]:
        return {"document_volume": temporal.monthly_volume(self.documents), "new_entities": temporal.newest(self.nodes), "recent_entities": temporal.active(self.nodes)}

    def recent(self, since: str | None = None, days: int = 7) -> dict[str, DataFrame]:
        return temporal.recent(self.documents, self.nodes, self.as_of, days, since)

    def spikes(self, limit: int = 20) -> DataFrame:
        return temporal.spikes(self.documents, self.nodes, self.tables["node_documents"], self.as_of, limit=limit)

    def trajectory(self, months: int = 12) -> DataFrame:
        if not 2 <= months <= 36:
            raise ValueError("months: 2 to 36")
        return temporal.trajectory(self.documents, self.nodes, self.edges, self.as_of, months)

    def pulse(self, days: int = 7) -> DataFrame:
        return digest.pulse(self.nodes, self.spikes(), self.documents, self.as_of, days)

    # digests

    def capabilities(self) -> dict[str, DataFrame]:
        return digest.capability_cards(self.subfields, self.nodes, self.edges)

    def briefing(self, days: int = 7, subfield: str | None = None) -> dict[str, DataFrame]:
        return digest.briefing(self.nodes, self.edges, self.documents, self.as_of, days, self.tables.get("subfields"), subfield)

    def narrative_inputs(self) -> dict[str, DataFrame]:
        """What a written briefing would be made from: latest documents, awards and the last daily text."""
        out = {"documents": temporal.recent_with_fallback(self.documents, self.as_of), "funding": digest.funding(self.documents, "awards")}
        if "daily" in self.tables:
            out["daily"] = records.latest_daily(self.daily).withColumn("stale", dates.is_stale(F.col("generated_at"), F.lit(self.as_of)))
        return out

    # curation

    def review(self, trusted: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
        return {"merges": curation.duplicate_suggestions(self.nodes), "noise": curation.noise_suggestions(self.nodes, trusted), "candidates": curation.candidates(self.nodes, known), "acronyms": extract.acronyms(self.documents.select("doc_ord", F.col("raw_text").alias("text")))}

    def correct(self, action: str, surface: str, canonical: str | None = None) -> DataFrame:
        """The corrections table with one more merge or ignore; :meth:`resolved` makes the graph anew from it."""
        if action not in ("merge", "ignore") or (action == "merge" and not canonical):
            raise ValueError(action)
        row = self.nodes.sparkSession.createDataFrame([(action, surface, canonical, 0)], "kind string, surface string, canonical string, ord bigint")
        return curation.upsert_corrections(self.corrections, row)

    def resolved(self, corrections: DataFrame, trusted: DataFrame | None = None) -> Landscape:
        """The same mentions under other corrections: resolution alone runs again, not extraction."""
        body = self.documents.select("content_hash", "doc_ord", text.document_text(F.col("title"), F.col("raw_text")).alias("text"))
        keyed = resolve.keyed_mentions(self.mentions, corrections, trusted)
        dated = self.documents.withColumn("doc_date", dates.effective_date(F.col("published"), F.col("fetched_at"))).select("content_hash", "doc_ord", "doc_date")
        made = resolve.graph(keyed, extract.relations(body, self.mentions), dated, trusted)
        return Landscape({**self.tables, **made, "corrections": corrections}, self.as_of, self.generic)

    def audit(self, phrases: Sequence[str], acronyms: Sequence[str], at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(kept, archived, dropped by source) of the topic gate, protected rows kept."""
        keep = text.is_relevant(F.concat_ws(" ", "title", "raw_text"), phrases, acronyms) | curation.protected(F.col("metadata"))
        return (*curation.prune(self.documents, keep, at), quality.drop_counts(self.documents, keep))


def rebuild(documents: DataFrame, gazetteer: DataFrame, as_of: str, backend: str = "rule", corrections: DataFrame | None = None, **tables: DataFrame) -> Landscape:
    """From a corpus to a queryable graph. documents: (content_hash, doc_ord, title, raw_text, published, fetched_at, ...)."""
    from graphloom.session import cut

    dated = corpus.first_of_each(documents).withColumn("doc_date", dates.effective_date(F.col("published"), F.col("fetched_at")))
    # Texts are read several times: by both ways of finding mentions and by relations.
    body = cut(dated.select("content_hash", "doc_ord", text.document_text(F.col("title"), F.col("raw_text")).alias("text")))
    mentions = cut(extract.mentions(body, gazetteer, backend))
    trusted = gazetteer.select("canonical").distinct()
    keyed = resolve.keyed_mentions(mentions, corrections, trusted)
    made = resolve.graph(keyed, extract.relations(body, mentions), dated.select("content_hash", "doc_ord", "doc_date"), trusted)
    extra = {"corrections": corrections} if corrections is not None else {}
    return Landscape({"documents": dated, "mentions": mentions, **made, **extra, **tables}, as_of)
