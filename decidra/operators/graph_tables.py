"""Decision graphs as data: a graph comes with each request, and tables of nodes and edges are checked and walked by joins.

graph.py compiles one graph, known on the driver, into a column. Here graphs are rows, as many and as different as the requests:

    graphs  graph, start
    nodes   graph, node, qtype, instructions, keys, outcome, default, fallback, min_probability, min_evidence, require_act
    edges   graph, node, option, target

`read` makes them from JSON bodies, `refused` says which graphs can't be walked and why, `walk` follows the answers. Equal
bodies should be one graph (`read` names a graph by the hash of its body), so that its nodes stand in the tables once.

The walk is a loop of joins, one for each step of the longest path that a request takes. Rows that have ended are written and
take no further part, so a step costs what is still under way. The tables that are joined are written ones behind plain
exchanges, so Spark can split a graph that very many requests use. A walk ends by itself, as refused graphs, which alone could have
a cycle, are not walked; the loop has LIMITS["nodes"] steps at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.operators.graph import BELOW_ACT, CYCLE, EMPTY_NODE, LOST_OPTION, LOST_TARGET, NO_QUESTION, NO_START, NO_THRESHOLDS, STEP, TOO_MANY
from decidra.schema import LIMITS, MOST_LEVELS, MOST_OPTIONS
from decidra.sources.files import written
from decidra.sources.records import QUESTION, option_keys

UNREADABLE, UNSOUND, TOO_MANY_QUESTIONS = "the graph can't be read", "a question is unsound", "too many questions"
#: Reasons for refusal, first things first: a graph is refused for the first that holds.
REASONS = [UNREADABLE, TOO_MANY, NO_START, EMPTY_NODE, UNSOUND, LOST_TARGET, LOST_OPTION, CYCLE, NO_QUESTION, TOO_MANY_QUESTIONS]

NODE = "question string, edges map<string, string>, default string, fallback string, min_probability double, min_evidence double, require_act boolean, outcome string"


class Graphs:
    """The three tables of a set of graphs."""

    def __init__(self, graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        self.graphs, self.nodes, self.edges = graphs, nodes, edges


def graph_key(body: Column) -> Column:
    """The name of the graph that a body holds: equal bodies are one graph."""
    return F.sha2(F.coalesce(body, F.lit("")), 256)


def read(bodies: DataFrame) -> Graphs:
    """The tables of all distinct bodies (column body, JSON). A body that can't be parsed is a graph without start and
    nodes. The tables are written, since each is read several times."""
    one = bodies.select(graph_key(F.col("body")).alias("graph"), "body").dropDuplicates(["graph"])
    parsed = written(one.select("graph", F.from_json("body", f"start string, nodes map<string, struct<{NODE}>>").alias("g")))
    each = parsed.select("graph", F.explode("g.nodes").alias("node", "n"))
    asked = each.withColumn("q", F.from_json("n.question", QUESTION))
    kind = F.when(F.col("q.type") == "noul", "bool").otherwise(F.col("q.type"))
    has = F.col("n.question").isNotNull()
    plain = [F.col(f"n.{c}").alias(c) for c in ("outcome", "default", "fallback", "min_probability", "min_evidence")]
    nodes = asked.select(
        "graph", "node", F.when(has, F.coalesce(kind, F.lit(""))).alias("qtype"), F.col("q.instructions").alias("instructions"),
        F.when(has, option_keys(F.col("q"))).alias("keys"), *plain, F.coalesce("n.require_act", F.lit(False)).alias("require_act"),
    )
    edges = each.where(has).select("graph", "node", F.explode("n.edges").alias("option", "target"))
    return Graphs(parsed.select("graph", F.col("g.start").alias("start")), written(nodes), written(edges))


def targets(g: Graphs) -> DataFrame:
    """graph, node and target of all ways out of question nodes: edges, defaults and fallbacks."""
    ways = g.nodes.where("qtype IS NOT NULL").select("graph", "node", F.explode(F.array("default", "fallback")).alias("target"))
    return g.edges.select("graph", "node", "target").unionByName(ways).where("target IS NOT NULL").distinct()


def leading_to_cycles(ways: DataFrame) -> DataFrame:
    """graph and node of all nodes from which a cycle can be reached: ways (graph, node, target) whose target has none left
    are taken away until nothing changes, one join for each step of the longest path."""
    left = written(ways)
    n = left.count()
    while n:
        inner = left.select("graph", F.col("node").alias("target")).distinct()
        left = written(left.join(inner, ["graph", "target"], "left_semi").select("graph", "node", "target"))
        before, n = n, left.count()
        if n == before:
            break
    return left.select("graph", "node").distinct()


def faults(g: Graphs) -> DataFrame:
    """graph and reason of everything that is wrong."""
    n = F.size("keys")
    kinds = F.coalesce(F.col("qtype").isin("bool", "choice", "score"), F.lit(False))
    enough = F.when(F.col("qtype") == "choice", n.between(2, MOST_OPTIONS)).when(F.col("qtype") == "score", n.between(2, MOST_LEVELS)).otherwise(True)
    sound = kinds & F.coalesce(enough, F.lit(False)) & (F.trim(F.coalesce("instructions", F.lit(""))) != "")
    questions = g.nodes.where("qtype IS NOT NULL")
    sizes = g.nodes.groupBy("graph").agg(F.count("*").alias("n"), F.count("qtype").alias("asks"))
    names = g.nodes.select("graph", F.col("node").alias("target"))
    ways = written(targets(g))
    options = questions.select("graph", "node", F.explode("keys").alias("option"))
    started = g.graphs.where("start IS NOT NULL")
    found = {
        UNREADABLE: g.graphs.where("start IS NULL").join(sizes, "graph", "left_anti"),
        TOO_MANY: sizes.where(F.col("n") > LIMITS["nodes"]),
        NO_START: g.graphs.join(g.nodes.select("graph", F.col("node").alias("start")), ["graph", "start"], "left_anti"),
        EMPTY_NODE: g.nodes.where("qtype IS NULL AND outcome IS NULL"),
        UNSOUND: questions.where(~sound),
        LOST_TARGET: ways.join(names, ["graph", "target"], "left_anti"),
        LOST_OPTION: g.edges.join(options, ["graph", "node", "option"], "left_anti"),
        CYCLE: started.select("graph", F.col("start").alias("node")).join(leading_to_cycles(ways), ["graph", "node"], "left_semi"),
        NO_QUESTION: g.graphs.join(sizes.where("asks > 0"), "graph", "left_anti"),
        TOO_MANY_QUESTIONS: sizes.where(F.col("asks") > LIMITS["questions"]),
    }
    return reduce(DataFrame.unionByName, [found[r].select("graph", F.lit(r).alias("reason")) for r in REASONS])


def refused(g: Graphs) -> DataFrame:
    """graph and reason (the first of REASONS that holds) of the graphs that can't be walked. Null names of options or targets
    count as none. No graphs give no rows."""
    place = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    first = faults(g).groupBy("graph").agg(F.min(place).cast("int").alias("place"))
    return first.select("graph", F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("place") - 1).alias("reason"))


def _guard(act: dict[str, float] | None) -> Column:
    """Why a row's normal route is barred, null if it isn't, from top and evidence of its answer and its node's limits."""
    limits = F.create_map(*[F.lit(x) for pair in sorted(act.items()) for x in pair]) if act else None
    cleared = F.coalesce(F.col("top") >= F.try_element_at(limits, F.col("qtype")), F.lit(False)) if act else F.lit(False)
    said = lambda what, at, limit: F.concat(F.lit(f"{what} "), F.format_string("%.2f", at), F.lit(" below "), F.format_string("%.2f", limit))
    return (
        F.when(F.col("top") < F.col("min_probability"), said("probability", F.col("top"), F.col("min_probability")))
        .when(F.col("evidence") < F.col("min_evidence"), said("evidence", F.col("evidence"), F.col("min_evidence")))
        .when(F.col("require_act") & ~cleared, F.lit(NO_THRESHOLDS if act is None else BELOW_ACT))
    )


ENDED = ["request", "node", "outcome", "path", "path_probability", "complete", "stopped"]


def walk(requests: DataFrame, g: Graphs, answers: DataFrame, act: dict[str, float] | None = None) -> DataFrame:
    """request, node (where it ended), outcome, path (STEP), path_probability, complete and stopped.

    requests: request and graph, of graphs that are not refused; ids are taken to be distinct. answers: request, node, probs and
    evidence of the questions; an answer that is missing, or whose size is not the question's, ends the walk with a reason.
    act: type to act threshold, None if none are fitted. Guarded steps don't multiply the path probability; a target that is
    missing ends the walk incomplete. The first of several largest probabilities is chosen. No requests give no rows.
    """
    nodes = g.nodes.withColumnRenamed("graph", "_g").withColumnRenamed("node", "_n")
    edges = g.edges.groupBy("graph", "node").agg(F.map_from_entries(F.collect_set(F.struct("option", "target"))).alias("edges"))
    ways = written(nodes.join(edges, (F.col("_g") == F.col("graph")) & (F.col("_n") == F.col("node")), "left").drop("graph", "node"))
    said = written(answers.select(F.col("request").alias("_r"), F.col("node").alias("_a"), "probs", "evidence"))
    live = requests.join(g.graphs, "graph").select("request", "graph", F.col("start").alias("node"), F.lit(None).cast(f"array<{STEP}>").alias("path"), F.lit(1.0).alias("path_probability"))
    live, done = written(live.withColumn("path", F.coalesce("path", F.array().cast(f"array<{STEP}>")))), []
    for _ in range(LIMITS["nodes"]):
        at = live.join(ways, (F.col("graph") == F.col("_g")) & (F.col("node") == F.col("_n")))
        at = at.join(said, (F.col("request") == F.col("_r")) & (F.col("node") == F.col("_a")), "left")
        answered = F.coalesce(F.size("probs") == F.size("keys"), F.lit(False))
        asks = F.col("qtype").isNotNull()
        at = at.withColumn("top", F.array_max("probs")).withColumn("chosen", F.get("keys", A.first_argmax(F.col("probs"))))
        at = at.withColumn("guard", F.when(asks & answered, _guard(act)))
        target = F.when(F.col("guard").isNotNull(), F.col("fallback")).otherwise(F.coalesce(F.try_element_at("edges", F.col("chosen")), F.col("default")))
        step = F.struct(
            F.col("node").alias("node"), "chosen", F.round("top", 4).alias("probability"), F.round(A.confidence(F.col("probs")), 4).alias("confidence"),
            F.round("evidence", 4).alias("evidence"), "guard",
        ).cast(STEP)
        lost = F.when(~answered, "no answer that fits the question").when(F.col("guard").isNotNull(), F.col("guard")).otherwise(F.concat(F.lit("no edge for option '"), "chosen", F.lit("'")))
        went = at.select(
            "request", "graph", "node", F.when(asks & answered, target).alias("next"), F.when(~asks, F.col("outcome")).alias("outcome"),
            F.when(asks & answered, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"),
            (F.col("path_probability") * F.when(asks & answered & F.col("guard").isNull(), F.col("top")).otherwise(1.0)).alias("path_probability"),
            (~asks).alias("complete"), F.when(asks & (~answered | target.isNull()), lost).alias("stopped"),
        )
        went = written(went)
        done.append(went.where("next IS NULL").select(*ENDED[:4], F.round("path_probability", 6).alias("path_probability"), *ENDED[5:]))
        live = went.where("next IS NOT NULL").select("request", "graph", F.col("next").alias("node"), "path", "path_probability")
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def decide(requests: DataFrame, answers: DataFrame, act: dict[str, float] | None = None) -> DataFrame:
    """A row for each of requests (request, body): the walk, or status 422 and the reason of refusal. A null body can't be
    read. Ids are taken to be distinct; answers to refused graphs are passed over."""
    g = read(requests)
    named = written(requests.select("request", graph_key(F.col("body")).alias("graph")))
    why = written(refused(g))
    bad = named.join(why, "graph").select("request", F.lit(422).alias("status"), F.col("reason").alias("detail"), *[F.lit(None).cast(t).alias(c) for c, t in zip(ENDED[1:], ("string", "string", f"array<{STEP}>", "double", "boolean", "string"))])
    good = walk(named.join(why, "graph", "left_anti"), g, answers, act).select("request", F.lit(200).alias("status"), F.lit(None).cast("string").alias("detail"), *ENDED[1:])
    return good.unionByName(bad)
