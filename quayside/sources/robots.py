"""Robots files as rules in a table, and the decision for many addresses as a join.

A file is a list of groups: agents, then rules in order. Rules become rows (host, agent group, place, allow, prefix). A prefix is cut at its last slash: the part
before it is a node of the host's tree of segments, the rest must begin what follows. An address meets the rules of its own nodes only, level by level, and the first rule
of its group that begins it decides. An address on a host without a file, or of a group without a matching rule, is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the fold below carries: the agents of the open group, whether its rules have begun, the number of the group, and the rows so far.
_STATE = "struct<agents:array<string>,closed:boolean,grp:int,rows:array<struct<agents:array<string>,grp:int,kind:string,v:string>>>"


def statements(text: Column) -> Column:
    """(name in lower case, value) of each line that has a colon, comments taken off."""
    lines = F.transform(F.split(text, "\\r\\n|\\r|\\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v"))
    return F.transform(F.filter(lines, lambda x: x.contains(":")), pair)


def _step(state: Column, s: Column) -> Column:
    agent = s["k"] == "user-agent"
    rule = s["k"].isin("allow", "disallow", "crawl-delay") & (F.size(state["agents"]) > 0)
    name = F.array(F.lower(s["v"]))
    opened = agent & state["closed"]
    row = F.array(F.struct(state["agents"].alias("agents"), state["grp"].alias("grp"), s["k"].alias("kind"), s["v"].alias("v")))
    return F.struct(
        F.when(opened, name).when(agent, F.concat(state["agents"], name)).otherwise(state["agents"]).alias("agents"),
        F.when(agent, False).when(rule, True).otherwise(state["closed"]).alias("closed"),
        F.when(opened, state["grp"] + 1).otherwise(state["grp"]).alias("grp"),
        F.when(rule, F.concat(state["rows"], row)).otherwise(state["rows"]).alias("rows"),
    )


def rules(files: DataFrame, agent: str) -> DataFrame:
    """host, text to the rules that hold for an agent: host, nth, allow, prefix, and delay, the same on all rows of a host. The first group that names the agent counts, else
    the first that names all. A host whose group has a delay only has one row without prefix."""
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("closed"), F.lit(0).alias("grp"), F.array().cast("array<struct<agents:array<string>,grp:int,kind:string,v:string>>").alias("rows"))
    parsed = F.aggregate(statements(F.col("text")), start.cast(_STATE), lambda s, x: _step(s, x).cast(_STATE), lambda s: s["rows"])
    lower = F.lit(agent.lower().split("/")[0])
    named = F.filter("r", lambda r: F.exists(r["agents"], lambda a: (a != "*") & (a != "") & lower.contains(a)))
    any_ = F.filter("r", lambda r: F.array_contains(r["agents"], "*"))
    mine = F.when(F.size(named) > 0, named).otherwise(any_)
    own = files.select("host", parsed.alias("r")).select("host", mine.alias("r")).select("host", F.filter("r", lambda x: x["grp"] == F.array_min(F.transform("r", lambda y: y["grp"]))).alias("r"))
    delay = F.try_element_at(F.filter(F.transform("r", lambda x: F.when(x["kind"] == "crawl-delay", x["v"].try_cast("double"))), lambda x: x.isNotNull()), F.lit(1))
    kept = F.filter("r", lambda x: x["kind"] != "crawl-delay")
    rows = own.select("host", delay.alias("delay"), F.posexplode_outer(kept).alias("nth", "x"))
    # A rule that forbids nothing allows everything that the rules before it left open.
    empty = (F.col("x.kind") == "disallow") & (F.col("x.v") == "")
    return rows.select("host", "delay", "nth", (empty | (F.col("x.kind") == "allow")).alias("allow"), F.col("x.v").alias("prefix"))


def decisions(pages: DataFrame, host: str, path: str, of: DataFrame, own_delay: float = 1.0) -> DataFrame:
    """Adds allowed and delay to each page. Distinct (host, path) pairs meet the rules of their nodes; the verdicts go back by equality."""
    node = lambda p: F.regexp_replace(p, "[^/]*$", "")
    asked = pages.select(F.col(host).alias("_h"), F.col(path).alias("_p")).distinct()
    parts = F.split("_p", "/")
    # The nodes of a path: what stands before each of its slashes and that slash; the empty node for rules without one.
    nodes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    level = asked.select("_h", "_p", F.explode(F.array_distinct(nodes)).alias("_node"))
    keyed = of.filter("prefix IS NOT NULL").select(F.col("host").alias("_rh"), node(F.col("prefix")).alias("_rn"), "nth", "allow", "prefix")
    hit = level.join(keyed, (F.col("_h") == F.col("_rh")) & (F.col("_node") == F.col("_rn"))).filter(F.col("_p").startswith(F.col("prefix")))
    first = hit.groupBy("_h", "_p").agg(F.min_by("allow", "nth").alias("_a"))
    delays = of.groupBy(F.col("host").alias("_dh")).agg(F.first("delay", ignorenulls=True).alias("_d"))
    out = pages.join(first, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").join(delays, F.col(host) == F.col("_dh"), "left")
    return out.select(*pages.columns, F.coalesce("_a", F.lit(True)).alias("allowed"), F.greatest(F.coalesce("_d", F.lit(own_delay)), F.lit(own_delay)).alias("delay"))
