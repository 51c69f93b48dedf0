"""Change events: CREATE, UPDATE and DELETE of resources of notifying classes.

A snapshot diff is one full outer join on a digest of each resource's quads.
For an append-only change log the same events come as a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..vocab import RDF


def _digests(data: Dataset, touched: DataFrame | None) -> DataFrame:
    """(g, s, digest) of the resources of classes that notify; order-free digest."""
    watched = [c.iri for c in data.ontology.classes.values() if c.notify]
    below = sorted(set().union(*(data.ontology.subclasses(c) for c in watched))) if watched else []
    quads = data.quads() if touched is None else data.about(touched)
    subjects = quads.where((F.col("p") == RDF + "type") & F.col("o.lex").isin(*below)).select("g", "s").distinct()
    each = F.xxhash64("p", "o.kind", "o.lex", "o.lang")
    return quads.join(subjects, ["g", "s"], "left_semi").groupBy("g", "s").agg(F.count("*").alias("n"), F.bit_xor(each).alias("digest"))


def changes(before: Dataset, after: Dataset) -> DataFrame:
    """(event, graph, resource) between two snapshots; one that follows the other by
    deltas is compared on their subjects alone."""
    had, have = [d.paths for d in before.deltas], [d.paths for d in after.deltas]
    moved, touched = after.moved[len(before.moved) :], None
    news = [*(d.touched for d in after.deltas[len(had) :]), *(t for _, t in moved)]
    if before.base is after.base and have[: len(had)] == had and news and all(t is not None for t in news) and [p for p, _ in after.moved[: len(before.moved)]] == [p for p, _ in before.moved]:
        touched = reduce(DataFrame.union, news).distinct()
    a, b = _digests(before, touched), _digests(after, touched)
    both = a.alias("a").join(b.alias("b"), ["g", "s"], "full_outer")
    event = F.when(F.col("a.n").isNull(), "CREATE").when(F.col("b.n").isNull(), "DELETE").when((F.col("a.n") != F.col("b.n")) | (F.col("a.digest") != F.col("b.digest")), "UPDATE")
    return both.select(event.alias("event"), F.col("g").alias("graph"), F.col("s").alias("resource")).where("event is not null")


class Notifier:
    """Calls ``handler`` with the events of each published snapshot; a failed update publishes none."""

    def __init__(self, session, handler: Callable[[DataFrame], None]):
        self.session, self.handler = session, handler
        session.listeners.append(self._published)

    def _published(self, before: Dataset, after: Dataset) -> None:
        self.handler(changes(before, after))

    def close(self) -> None:
        self.session.listeners.remove(self._published)


def stream(log: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Events of a streaming change log (event, graph, resource, at), one batch at a time."""
    events = log.select("event", "graph", "resource", "at").where(F.col("event").isin("CREATE", "UPDATE", "DELETE"))
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
