"""Property clusters with a bound on their size, merged in a fixed order into stored clusters.

An event names a listing and its matches, which become one cluster, unless it would have more than ``most`` members: then the event is
dropped as a whole. The outcome hangs on the order of events, but only within what events and stored clusters connect, so they are
grouped by connected components, and each component is settled in order by a task of its own.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.components import connected_components
from tidewell.session import Scratch

#: Fixed value: one property isn't advertised more often.
MOST_MEMBERS = 30
CLUSTERS = "node string, cluster string"


def proposed(nodes: list[str]) -> str:
    """The id of a cluster that has none yet: a hash of its members' keys in order."""
    return "property:" + hashlib.sha256("|".join(sorted(set(nodes))).encode()).hexdigest()[:20]


def merge_in_order(events: list[tuple[int, list[str]]], stored: dict[str, str], most: int = MOST_MEMBERS) -> dict[str, str]:
    """The clusters after all events, in the order of their numbers; of stored clusters that meet, the least id stays."""
    cluster = dict(stored)
    members: dict[str, set[str]] = {}
    for node, own in cluster.items():
        members.setdefault(own, set()).add(node)
    for _, nodes in sorted(events, key=lambda e: e[0]):
        known = sorted({cluster[n] for n in nodes if n in cluster})
        fresh = {n for n in nodes if n not in cluster}
        if len(set(nodes)) < 2 or sum(len(members[c]) for c in known) + len(fresh) > most:
            continue
        name = known[0] if known else proposed(nodes)
        joined = set(fresh).union(*[members.pop(c) for c in known])
        members[name] = joined
        for n in joined:
            cluster[n] = name
    return cluster


def merged(events: DataFrame, stored: DataFrame, scratch: Scratch, most: int = MOST_MEMBERS) -> DataFrame:
    """(node, cluster) of every clustered node after all ``events`` (number, node: a row a member; numbers are unique to an event) on top of
    ``stored`` (node, cluster). Nodes of no event keep their cluster, and events of one member do nothing. Repeated rows count
    once; null nodes and numbers are left out.

    A component's events meet in one task; what crosses the network is keys. A component glued together by something all
    its members share is one task's work, and its memory grows with its members; the rest of them are as small as properties are."""
    rows = scratch.put(events.where("number IS NOT NULL AND node IS NOT NULL").select("number", "node").distinct(), "events")
    kept = scratch.put(stored.where("node IS NOT NULL AND cluster IS NOT NULL").groupBy("node").agg(F.min("cluster").alias("cluster")), "stored")
    # An event ties its members to itself, a stored cluster its own: two sides of a graph.
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    ties = rows.select(name("n:", "node").alias("a"), name("e:", "number").alias("b")).union(kept.select(name("n:", "node"), name("c:", "cluster")))
    groups = connected_components(ties, scratch=scratch)
    of = groups.where("node LIKE 'n:%'").select(F.expr("substr(node, 3)").alias("node"), "component")
    touched = scratch.put(rows.join(of, "node").select("component").distinct(), "touched")
    still = kept.join(of, "node", "left").join(touched, "component", "left_anti").select("node", "cluster")
    facts = rows.join(of, "node").select("component", "number", "node", F.lit(None).cast("string").alias("cluster"))
    facts = facts.unionByName(kept.join(of, "node").join(touched, "component", "left_semi").select("component", F.lit(None).cast(rows.schema["number"].dataType).alias("number"), "node", "cluster"))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["cluster"].notna()]
        by_event = frame[frame["cluster"].isna()].groupby("number")["node"].agg(list)
        result = merge_in_order(list(zip(by_event.index, by_event)), dict(zip(own["node"], own["cluster"])), most)
        return pd.DataFrame(sorted(result.items()), columns=["node", "cluster"])

    return still.unionByName(facts.groupBy("component").applyInPandas(settle, CLUSTERS))


def weak_pairs(clusters: DataFrame, evidence: DataFrame) -> DataFrame:
    """(cluster) of exactly two members all of whose matches are weak: one photo, alike but not the same, facts known to disagree, and
    places that conflict highly. ``clusters``: node, cluster; ``evidence``: cluster, matched, exact, perceptual (numbers of photos), consistent, location, a row a match.
    Larger clusters, unknown facts and clusters without evidence are left alone."""
    two = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 2").select("cluster")
    photos = (F.col("matched") == 1) & (F.col("exact") == 0) & (F.col("perceptual") == 1)
    weak = photos & (F.col("consistent") == F.lit(False)) & F.col("location").isin("high", "very_high")
    told = evidence.groupBy("cluster").agg(F.bool_and(F.coalesce(weak, F.lit(False))).alias("weak")).where("weak").select("cluster")
    return two.join(told, "cluster", "left_semi")
