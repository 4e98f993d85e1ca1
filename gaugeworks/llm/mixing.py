"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of target sources
form a pattern, and only the patterns' sizes reach the driver. A flow routes their tokens
to the sources' quotas; every repetition of a pattern is an arc that costs more than the
one before. The flows of a pattern then lie end to end on a tape of its documents in
seeded order, lap after lap, so no document is used more often than its laps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.plans import broadcast_if_small
from gaugeworks.llm.sampling import uniform
from gaugeworks.session import cut_lineage

#: Target sources that the driver accepts.
MAX_SOURCES = 1_000
#: Patterns routed by their whole set of sources, the largest; smaller ones count for their scarcest source only.
MAX_PATTERNS = 4_096
#: Slices of the hash range in which the tokens of a pattern are summed.
SLICES = 4096


def min_cost_flow(arcs: list[tuple], source, sink) -> dict[int, float]:
    """Flow by arc number for arcs (tail, head, capacity, cost); sends all that can be sent, cheapest first.

    Each round finds the cheapest way and then fills all ways of that cost at once, so the
    rounds are as many as there are different costs.
    """
    nodes = {n: i for i, n in enumerate(dict.fromkeys([source, sink, *(x for a in arcs for x in a[:2])]))}
    graph: list[list[int]] = [[] for _ in nodes]
    head, left, cost = [], [], []
    for tail, to, capacity, price in arcs:
        for a, b, c, p in ((tail, to, float(capacity), price), (to, tail, 0.0, -price)):
            graph[nodes[a]].append(len(head))
            head.append(nodes[b])
            left.append(c)
            cost.append(p)
    s, t = nodes[source], nodes[sink]
    least = 1e-9 * max([1.0, *left])

    def distances() -> list[float]:
        far = [float("inf")] * len(nodes)
        far[s] = 0
        waiting, queued = deque([s]), {s}
        while waiting:
            at = waiting.popleft()
            queued.discard(at)
            for e in graph[at]:
                if left[e] > least and far[at] + cost[e] < far[head[e]]:
                    far[head[e]] = far[at] + cost[e]
                    if head[e] not in queued:
                        queued.add(head[e])
                        waiting.append(head[e])
        return far

    def levels(far) -> list[int]:
        level = [-1] * len(nodes)
        level[s] = 0
        waiting = deque([s])
        while waiting:
            at = waiting.popleft()
            for e in graph[at]:
                if level[head[e]] < 0 and left[e] > least and far[at] + cost[e] == far[head[e]]:
                    level[head[e]] = level[at] + 1
                    waiting.append(head[e])
        return level

    while True:
        far = distances()
        if far[t] == float("inf"):
            return {i: left[2 * i + 1] for i in range(len(arcs))}
        while (level := levels(far))[t] >= 0:
            following = [0] * len(nodes)
            path: list[int] = []
            at = s
            while True:
                if at == t:
                    sent = min(left[e] for e in path)
                    for e in path:
                        left[e] -= sent
                        left[e ^ 1] += sent
                    path, at = [], s
                    continue
                while following[at] < len(graph[at]):
                    e = graph[at][following[at]]
                    if left[e] > least and level[head[e]] == level[at] + 1 and far[at] + cost[e] == far[head[e]]:
                        break
                    following[at] += 1
                if following[at] < len(graph[at]):
                    path.append(graph[at][following[at]])
                    at = head[path[-1]]
                elif path:
                    at = head[path.pop() ^ 1]
                    following[at] += 1
                else:
                    break


def route(patterns: Mapping[tuple, int], targets: Mapping[str, tuple[float, int]], budget: float) -> dict[tuple, float]:
    """{(pattern, source): tokens} for patterns {sources: tokens} and targets {source: (share, max_repeats)}.

    A pattern's tokens can be used as often as the largest max_repeats of its sources, and
    by one source as often as that source's own; the r-th use costs r - 1 a token.
    """
    arcs, routed = [], []
    for p, tokens in sorted(patterns.items()):
        inside = [s for s in p if s in targets]
        for r in range(max([targets[s][1] for s in inside], default=0)):
            arcs.append(("start", ("pattern", p), tokens, r))
        for s in inside:
            routed.append((len(arcs), p, s))
            arcs.append((("pattern", p), ("source", s), tokens * targets[s][1], 0))
    for s, (share, _) in sorted(targets.items()):
        arcs.append((("source", s), "end", share * budget, 0))
    flow = min_cost_flow(arcs, "start", "end") if arcs else {}
    return {(p, s): flow[i] for i, p, s in routed}


class Mix:
    """A routed mix: the plan (rows for the driver) and, on demand, the chosen documents."""

    def __init__(self, docs: DataFrame, targets: DataFrame, budget_share: float = 0.5, seed: int = 42):
        """docs: (doc_id, sources array<string>, tokens); targets: (source, target_share, max_repeats).

        The budget is ``budget_share`` of the tokens of all documents. Null documents,
        sources, shares and repeats count as none. A source named twice takes its largest
        share and repeats. Documents outside all targets count in the budget only. Where
        there are more than MAX_PATTERNS patterns, documents of the smaller ones are offered
        to the source with the fewest tokens of theirs only: still no document is left out
        or used too often, but the flow may then cost more than the least. More than
        MAX_SOURCES targets raise ValueError.
        """
        self.spark, self.seed = docs.sparkSession, seed
        wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
        if len(wanted) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} target sources")
        self.targets = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in wanted}
        named = sorted(self.targets)
        pattern = F.array_sort(F.array_distinct(F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isin(named)))) if named else F.array().cast("array<string>")
        self.docs = docs.select("doc_id", pattern.alias("pattern"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        per = self.docs.groupBy("pattern").agg(F.sum("tokens").alias("tokens"))
        if per.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
            per = self._fold(cut_lineage(per))
        self.sizes = {tuple(r["pattern"]): r["tokens"] for r in per.collect()}
        self.budget = budget_share * sum(self.sizes.values())
        self.flow = route(self.sizes, self.targets, self.budget)

    def _fold(self, per: DataFrame) -> DataFrame:
        """Leaves the MAX_PATTERNS largest patterns as they are and replaces others by their scarcest source."""
        size = {r["s"]: r["n"] for r in per.select(F.explode("pattern").alias("s"), "tokens").groupBy("s").agg(F.sum("tokens").alias("n")).collect()}
        rank = F.array(*[F.lit(s) for s in sorted(size, key=lambda s: (size[s], s))])
        kept = per.orderBy(F.desc("tokens"), "pattern").limit(MAX_PATTERNS).select("pattern", F.lit(True).alias("_kept"))
        kept = cut_lineage(kept)

        def folded(df: DataFrame) -> DataFrame:
            scarcest = F.slice(F.array_intersect(rank, F.col("pattern")), 1, 1)
            return df.join(F.broadcast(kept), "pattern", "left").withColumn("pattern", F.when(F.col("_kept"), F.col("pattern")).otherwise(scarcest)).drop("_kept")  # at most MAX_PATTERNS rows

        self.docs = folded(self.docs)
        return folded(per).groupBy("pattern").agg(F.sum("tokens").alias("tokens"))

    def plan(self) -> DataFrame:
        """(source, target_share, max_repeats, size_tokens, quota_tokens, planned_tokens, mean_repeats, deficit_tokens, parts) of each target; parts are the patterns it takes from."""
        rows = []
        for s, (share, repeats) in sorted(self.targets.items()):
            size = sum(t for p, t in self.sizes.items() if s in p)
            planned, quota = float(sum(f for (_, x), f in self.flow.items() if x == s)), share * self.budget
            missing = quota - planned
            rows.append((s, share, repeats, size, quota, planned, planned / size if size else None, missing if missing > 1e-9 * max(1.0, quota) else 0.0, sum(x == s and f > 0 for (_, x), f in self.flow.items())))
        return self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, size_tokens long, quota_tokens double, planned_tokens double, mean_repeats double, deficit_tokens double, parts int")

    def report(self) -> DataFrame:
        """``plan`` with selected_tokens, selected_share (of the budget) and most_repeats of the documents chosen by ``select``."""
        tokens = F.col("tokens") * F.col("repeats")
        chosen = self.select().groupBy("source").agg(F.sum(tokens).alias("selected_tokens"), F.max("repeats").alias("most_repeats"))
        both = self.plan().join(chosen, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0))).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))
        return both.withColumn("selected_share", F.try_divide("selected_tokens", F.lit(float(self.budget))))

    def _tape(self) -> DataFrame:
        """(pattern, pid, size, segments): where the sources lie on the tape of each pattern, in whole tokens."""
        rows = []
        for pid, (p, size) in enumerate(sorted(self.sizes.items())):
            at, segments = 0.0, []
            for s in p:
                flow = self.flow.get((p, s), 0.0)
                if round(at + flow) > round(at):
                    segments.append((s, round(at), round(at + flow)))
                at += flow
            if segments:
                rows.append((list(p), pid, size, segments))
        return self.spark.createDataFrame(rows, "pattern array<string>, pid int, size long, segments array<struct<source:string,lo:long,hi:long>>")

    def select(self) -> DataFrame:
        """(doc_id, source, repeats, tokens): documents with how often each source takes them.

        A source takes a document in every lap in which the document ends inside the
        source's part of the tape. So a source has its planned tokens up to one document at
        either end of each part, takes no document more often than its max_repeats, and all sources
        together none more often than the largest max_repeats of its sources. Documents of
        no tokens go with the place where they lie. Repeated ids are separate documents.
        """
        # at most MAX_PATTERNS + MAX_SOURCES rows of at most as many segments as the pattern has sources
        rows = self.docs.join(F.broadcast(self._tape()), "pattern").withColumn("u", uniform("doc_id", self.seed)).withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))
        sums = rows.groupBy("pid", "slice").agg(F.sum("tokens").alias("_t"), F.first("size").alias("size"), F.first("segments").alias("segments"))
        run = Window.partitionBy("pid").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("_end", F.sum("_t").over(run)).withColumn("_begin", F.col("_end") - F.col("_t"))

        # only where a part of some source begins or ends does the order within a slice matter
        def within(x):
            return (x > F.col("_begin")) & (x < F.col("_end"))

        edge = F.exists("segments", lambda s: within(F.pmod(s.lo, F.col("size"))) | within(F.pmod(s.hi, F.col("size"))))
        sums = cut_lineage(sums.select("pid", "slice", "_begin", "_end", edge.alias("_edge")))
        placed = rows.select("doc_id", "tokens", "pid", "size", "segments", "u", "slice").join(broadcast_if_small(sums), ["pid", "slice"])
        order = Window.partitionBy("pid", "slice").orderBy("u", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
        exact = placed.where("_edge").withColumn("_end", F.col("_begin") + F.sum("tokens").over(order))
        whole = placed.where(~F.col("_edge")).unionByName(exact)
        taken = whole.select("doc_id", "tokens", "_end", "size", F.explode("segments").alias("_s")).select("doc_id", "tokens", "_end", "size", "_s.*")
        # laps in which the document ends in (lo, hi]
        repeats = F.expr("(hi - _end + size) div size - (lo - _end + size) div size")
        return taken.withColumn("repeats", repeats).where(F.col("repeats") > 0).select("doc_id", "source", "repeats", "tokens")
