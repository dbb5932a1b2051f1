"""Who sends and who receives what, and what of it was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canlake.operators.aggregate import broadcast_if_small


def node_tx(nodes: DataFrame, messages: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Each node's messages with the frames seen (0 if none)."""
    sent = nodes.join(messages.select("channel", "id", "name", F.col("transmitter").alias("node")), ["channel", "node"])
    seen = aggregated.groupBy("channel", "id").agg(F.sum("count").alias("count"))
    return sent.join(seen, ["channel", "id"], "left").select("channel", "node", "id", "name", F.coalesce("count", F.lit(0)).alias("count"))


def node_rx(nodes: DataFrame, messages: DataFrame, signals: DataFrame) -> DataFrame:
    """Each node's received signals with message and sender."""
    to = signals.select("channel", "id", "signal", F.explode("receivers").alias("node"))
    sender = messages.select("channel", "id", "name", F.col("transmitter").alias("sender"))
    return nodes.select("channel", "node").join(to, ["channel", "node"]).join(sender, ["channel", "id"]).select("channel", "node", "id", "name", "signal", "sender")


def node_activity(nodes: DataFrame, messages: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Whether any frame of a node's messages was seen."""
    tx = node_tx(nodes, messages, aggregated).groupBy("channel", "node").agg(F.max("count").alias("most"))
    return nodes.select("channel", "node").join(tx, ["channel", "node"], "left").select("channel", "node", (F.coalesce("most", F.lit(0)) > 0).alias("active"))


def node_summary(nodes: DataFrame, messages: DataFrame, signals: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Messages sent, frames seen of them, and signals received, per node."""
    tx = node_tx(nodes, messages, aggregated).groupBy("channel", "node").agg(F.count("*").alias("sent"), F.sum("count").alias("frames"))
    rx = node_rx(nodes, messages, signals).groupBy("channel", "node").agg(F.count("*").alias("received"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("channel", "node").join(tx, ["channel", "node"], "left").join(rx, ["channel", "node"], "left").select("channel", "node", zero("sent"), zero("frames"), zero("received"))


def unknown_ids(aggregated: DataFrame, messages: DataFrame) -> DataFrame:
    return aggregated.join(broadcast_if_small(messages), ["channel", "id"], "left_anti")


def active_signals(selection: DataFrame) -> DataFrame:
    """Signals that any view names: a subscription lives as long as one does."""
    return selection.select("channel", "id", "signal").distinct()


def selection_update(selected: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The keys selected or added, once each, without those removed."""
    keys = selected.columns
    return selected.unionByName(added.select(keys)).distinct().join(removed.select(keys), keys, "left_anti")
