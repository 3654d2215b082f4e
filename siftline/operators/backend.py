"""What state a backend is in after a series of requests: each request is a map from states to states, and maps compose, so stretches of requests are folded apart and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("cold", "loading", "resident", "failed")
#: What can happen: a request and how it ended; a transport failure is one to start, write, read, wait for or match a response.
EVENTS = ("load-resident", "ok-untold", "refused", "transport-failed", "unload-cold", "unload-refused", "child-exited", "stopped", "memory-refused")


def after(event: str, state: str, alive: bool) -> tuple[str, bool]:
    """State and whether the child runs after an event. A request to a backend that isn't resident makes it loading; what the response tells counts, a refusal without a told state fails it."""
    loading = state if state == "resident" else "loading"
    match event:
        case "load-resident":
            return "resident", True
        case "ok-untold":
            return loading, True
        case "refused":
            return "failed", True
        case "transport-failed":
            return "failed", False
        case "unload-cold" | "unload-refused":
            if not alive:
                return "cold", False
            return (state if state == "cold" else "cold" if event == "unload-cold" else "failed"), True
        case "child-exited":
            return ("failed", False) if alive else (state, False)
        case "stopped":
            return "cold", False
        case "memory-refused":  # asked only before a child is started
            return ("resident", True) if alive else ("failed", False)
    raise ValueError(event)


#: For each event, where each state (its number twice, and one more if the child runs) leads.
MAPS = [[STATES.index(s) * 2 + on for s, on in (after(e, STATES[k // 2], k % 2 == 1) for k in range(2 * len(STATES)))] for e in EVENTS]
_SAME = list(range(2 * len(STATES)))


def composed(maps: Column) -> Column:
    """One map of an array of maps, the first taken first."""
    return F.aggregate(maps, F.lit(_SAME), lambda f, g: F.transform(f, lambda s: F.get(g, s)))


def fold(events: DataFrame, keys: list[str], block: str, order: list[str], event: str = "event") -> DataFrame:
    """keys, block, events, state, alive: after each block (any stretches in order, as days) of a backend's events (names of EVENTS; others change nothing), from cold on.

    A block is folded to one map where its rows meet, then the maps of a backend's blocks are composed: a row a block, so a backend with very many events is no hot key as long as its blocks aren't.
    """
    code = F.coalesce(*[F.when(F.col(event) == e, F.lit(m)) for e, m in zip(EVENTS, MAPS, strict=True)], F.lit(_SAME))
    in_order = F.array_sort(F.collect_list(F.struct(*order, code.alias("_map"))))
    blocks = events.groupBy(*keys, block).agg(F.count("*").alias("events"), composed(F.transform(in_order, lambda x: x["_map"])).alias("_map"))
    so_far = F.collect_list("_map").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, 0))
    out = blocks.select(*keys, block, "events", F.get(composed(so_far), F.lit(0)).alias("_s"))
    return out.select(*keys, block, "events", F.element_at(F.lit(list(STATES)), (F.floor(F.col("_s") / 2) + 1).cast("int")).alias("state"), (F.col("_s") % 2 == 1).alias("alive"))
