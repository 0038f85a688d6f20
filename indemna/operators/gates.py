"""What each path of a search shows to whom, with its gate and without: leaks are counted on what was found, not on what a gate promises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.operators.access import permitted, refuse
from indemna.operators.retrieval import for_principals, lexical_forms, lexical_hits, nearest

#: The paths that a scenario puts a gate on, and the state of each path's result that it shows: o open, g gated. A hybrid path
#: has no gate of its own but those of its two legs.
SCENARIOS = {
    "none": frozenset(),
    "agent": frozenset({"agent"}),
    "vector": frozenset({"vector"}),
    "search": frozenset({"vector", "lexical", "graph"}),
    "all": frozenset({"vector", "lexical", "graph", "agent"}),
}
PATHS = ("vector", "lexical", "graph", "hybrid", "agent")


def state_of(path: str, gated: frozenset[str]) -> str:
    """The state in which a path runs when the legs ``gated`` have their gate."""
    legs = ("vector", "graph") if path == "hybrid" else (path,)
    return "".join("g" if leg in gated else "o" for leg in legs)


class Search:
    """The sources of all paths.

    ``chunks`` (uid, product, v), ``postings`` (uid, product, term, tf), ``queries`` (query_id, qv), ``query_terms`` (query_id, term),
    ``query_products`` (query_id, product), ``exclusions`` (uid, product) in force, ``principals`` (principal, unrestricted).
    ``allowed`` (principal, product) is what the gates let through.
    """

    def __init__(self, chunks: DataFrame, postings: DataFrame, queries: DataFrame, query_terms: DataFrame, query_products: DataFrame, exclusions: DataFrame, principals: DataFrame, allowed: DataFrame, k: int = 10):
        self.chunks, self.queries, self.query_products, self.exclusions, self.k = chunks, queries, query_products, exclusions, k
        self.who, self.allowed = principals.select("principal"), allowed.select("principal", "product").distinct()
        self.seen = F.broadcast(self.allowed.select("product").distinct())
        forms = lexical_forms(query_terms, strategies=("lexical",))
        self.lexical_of = lambda rows, within: lexical_hits(forms, rows, k, within)
        self.postings = postings
        self.found: dict[bool, DataFrame] = {}

    def _shown(self, rows: DataFrame) -> DataFrame:
        """The same rows to everyone."""
        return rows.select("query_id", "uid", "product").join(F.broadcast(self.who))

    def vector(self, gated: bool) -> DataFrame:
        """One search for each state, which the hybrid path shares."""
        if gated not in self.found:
            self.found[gated] = self._vector(gated)
        return self.found[gated]

    def _vector(self, gated: bool) -> DataFrame:
        if gated:
            best = nearest(self.queries, self.chunks.join(self.seen, "product", "left_semi"), self.k, within=["product"])
            return for_principals(best, self.allowed, self.k)
        found = nearest(self.queries, self.chunks.select("uid", "v"), self.k)
        return self._shown(found.join(self.chunks.select("uid", "product"), "uid"))

    def lexical(self, gated: bool) -> DataFrame:
        if gated:
            return for_principals(self.lexical_of(self.postings.join(self.seen, "product", "left_semi"), ["product"]), self.allowed, self.k)
        found = self.lexical_of(self.postings, [])
        return self._shown(found.join(self.chunks.select("uid", "product"), "uid"))

    def enumerated(self, asked: DataFrame, gated: bool) -> DataFrame:
        """All exclusions of the products that are asked for (principal, query_id, product), or of those that the principal may see."""
        if gated:
            asked = asked.join(self.allowed, ["principal", "product"], "left_semi")
        return self.exclusions.join(F.broadcast(asked), "product").select("principal", "query_id", "uid", "product")

    def graph(self, gated: bool) -> DataFrame:
        return self.enumerated(self.query_products.join(F.broadcast(self.who)), gated)

    def hybrid(self, vector_gated: bool, graph_gated: bool) -> DataFrame:
        """The hits of the vector leg, and the exclusions of their products by the graph leg, each once."""
        seeds = self.vector(vector_gated).select("principal", "query_id", "uid", "product")
        more = self.enumerated(seeds.select("principal", "query_id", "product").distinct(), graph_gated)
        return seeds.unionByName(more).distinct()

    def agent(self, requests: DataFrame, gated: bool, principals: DataFrame) -> DataFrame:
        """All exclusions of a product that is asked for by name (principal, product); with the gate a product outside the scope is
        refused: one row without uid."""
        if not gated:
            return requests.join(self.exclusions, "product").select("principal", "uid", "product")
        told = refuse(requests, principals.where("false"), self.allowed, "principal", "product")
        shown = told.where("access = 'GRANTED'").join(self.exclusions, "product").select("principal", "uid", "product")
        return shown.unionByName(told.where("access <> 'GRANTED'").select("principal", F.lit(None).cast(self.exclusions.schema["uid"].dataType).alias("uid"), "product"))


def reached(search: Search, principals: DataFrame, requests: DataFrame) -> DataFrame:
    """(path, state, principal, product, rows, denied): how many rows each path shows to each principal, and requests refused."""
    parts = []
    for path, run in (("vector", search.vector), ("lexical", search.lexical), ("graph", search.graph)):
        parts += [run(s == "g").select(F.lit(path).alias("path"), F.lit(s).alias("state"), "principal", "product", "uid") for s in "og"]
    for s in ("oo", "go", "gg"):
        parts.append(search.hybrid(s[0] == "g", s[1] == "g").select(F.lit("hybrid").alias("path"), F.lit(s).alias("state"), "principal", "product", "uid"))
    parts += [search.agent(requests, s == "g", principals).select(F.lit("agent").alias("path"), F.lit(s).alias("state"), "principal", "product", "uid") for s in "og"]
    parts = [p.groupBy("path", "state", "principal", "product").agg(F.count("uid").alias("rows"), F.count_if(F.col("uid").isNull()).alias("denied")) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def outside(rows: DataFrame, principals: DataFrame, scopes: DataFrame) -> DataFrame:
    """Adds ``outside``: whether a product is none of the principal's scope, by the scopes themselves and not by any gate."""
    own = permitted(principals, scopes, rows.select("product")).withColumn("own", F.lit(True))
    return rows.join(own, ["principal", "product"], "left").withColumn("outside", F.col("own").isNull()).drop("own")


def leaks(rows: DataFrame) -> DataFrame:
    """(principal, path, before, after, shown, denied, products): rows outside the scope without any gate and with all, what all gates
    let through, requests refused, and the products that leak without."""
    state = lambda gated: reduce(lambda a, b: a | b, [(F.col("path") == p) & (F.col("state") == state_of(p, gated)) for p in PATHS])
    is_open, is_gated = state(frozenset()), state(SCENARIOS["all"])
    total = lambda when, n="rows": F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0)).cast("long")
    return rows.groupBy("principal", "path").agg(
        total(is_open & F.col("outside")).alias("before"),
        total(is_gated & F.col("outside")).alias("after"),
        total(is_gated).alias("shown"),
        total(is_gated, "denied").alias("denied"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_open & F.col("outside"), F.col("product")))), ",").alias("products"),
    )


def scenario_leaks(rows: DataFrame) -> DataFrame:
    """(scenario, one column a path, total): rows outside the scope, by where the gates stand."""
    stands = [(name, p, state_of(p, gated)) for name, gated in SCENARIOS.items() for p in PATHS]
    stands = F.broadcast(rows.sparkSession.createDataFrame(stands, "scenario string, path string, state string"))
    counts = rows.groupBy("path", "state").agg(F.coalesce(F.sum(F.when(F.col("outside"), F.col("rows"))), F.lit(0)).cast("long").alias("n"))
    table = stands.join(counts, ["path", "state"], "left").groupBy("scenario").pivot("path", list(PATHS)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long"))
    return table.withColumn("total", sum((F.col(p) for p in PATHS[1:]), F.col(PATHS[0])))
