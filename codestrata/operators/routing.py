"""Routing by string keys across files: which calls reach which routing table, what they send, and what is registered at run time.

A file's own tables, routers and writers come with its facts. Here calls are matched to routers by name, the receiver deciding which of several is
meant, and functions that pass a parameter on become routers themselves. Everything is an equi-join on (repo, name) or (repo, path); no pair of
definitions of the same name is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

# Fixed: methods of the language that are never taken for a project's routers.
BUILTIN = (
    "get set has erase append push_back emit connect call call_deferred new size keys values duplicate clear find insert remove_at pop_back sort sort_custom map filter reduce any all "
    "print str int float len range format join split"
).split()


def table_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def reached(calls: DataFrame, routers: DataFrame, defined: DataFrame, globals_: DataFrame, parents: DataFrame) -> DataFrame:
    """Calls (repo, path, fn, recv, ...) with the ``router`` file they reach, for routers (repo, func, file).

    A bare or self call reaches the own file; a receiver that starts with a global (repo, name, path) that global's file; any other receiver every
    router of the name, unless a file that isn't related to one of them by inheritance defines (repo, name, path) the same function: then the name
    says nothing. ``parents``: (repo, path, ancestor).
    """
    c = calls.filter(~F.col("fn").isin(BUILTIN)).join(routers.select("repo", F.col("func").alias("fn")).distinct(), ["repo", "fn"], "left_semi")
    head = F.regexp_extract("recv", r"^([^.\[]*)", 1)
    own = F.col("recv").isNull() | (F.col("recv") == "self")
    c = c.withColumn("__head", F.when(~own, head)).join(globals_.select("repo", F.col("name").alias("__head"), F.col("path").alias("__known")), ["repo", "__head"], "left")
    c = c.withColumn("__to", F.when(own, F.col("path")).otherwise(F.col("__known"))).drop("__head", "__known")
    r = routers.select("repo", F.col("func").alias("fn"), F.col("file").alias("router")).distinct()
    sure = c.filter(F.col("__to").isNotNull()).join(r.withColumn("__to", F.col("router")), ["repo", "fn", "__to"])
    names = r.select("repo", "fn").distinct()
    d = defined.select("repo", F.col("name").alias("fn"), "path").distinct().join(names, ["repo", "fn"], "left_semi")
    files = r.select("repo", "fn", F.col("router").alias("path"))
    others = d.join(files, ["repo", "fn", "path"], "left_anti")
    above = parents.select("repo", "path", "ancestor")
    below_a_router = others.join(above, ["repo", "path"]).join(files.withColumnRenamed("path", "ancestor"), ["repo", "fn", "ancestor"], "left_semi").select("repo", "fn", "path")
    above_a_router = files.join(above, ["repo", "path"]).select("repo", "fn", F.col("ancestor").alias("path"))
    unclear = others.join(below_a_router.union(above_a_router).distinct(), ["repo", "fn", "path"], "left_anti").select("repo", "fn").distinct()
    free = c.filter(F.col("__to").isNull()).join(unclear, ["repo", "fn"], "left_anti").join(r, ["repo", "fn"])
    return sure.drop("__to").unionByName(free.drop("__to"))


def route_table(routes: DataFrame, calls: DataFrame, funcs: DataFrame, globals_: DataFrame, parents: DataFrame, rounds: int = 3) -> DataFrame:
    """(repo, file, func, idx, table_id): parameters that reach a table, directly (repo, path, func, idx, name) or through up to ``rounds`` functions
    that pass a parameter on. calls (repo, path, fn, recv, func, args); funcs (repo, path, name, params)."""
    known = cut(routes.select("repo", F.col("path").alias("file"), "func", "idx", table_id(F.col("path"), F.col("name")).alias("table_id")).distinct())
    passed = calls.filter(F.col("func").isNotNull()).select("repo", "path", "fn", "recv", "func", F.posexplode("args").alias("to_idx", "a")).filter("a.k = 'name'")
    inner = funcs.select("repo", "path", F.col("name").alias("func"), F.posexplode("params").alias("idx", "p"))
    inner = inner.groupBy("repo", "path", "func", "p").agg(F.min("idx").alias("idx"))
    passed = cut(passed.withColumn("p", F.col("a.s")).join(inner, ["repo", "path", "func", "p"]).select("repo", "path", "fn", "recv", "func", "to_idx", "idx").distinct())
    n = known.count()
    for _ in range(rounds):
        routers = known.select("repo", "func", "file").distinct()
        hit = reached(passed, routers, funcs, globals_, parents)
        to = known.select("repo", F.col("file").alias("router"), F.col("func").alias("fn"), F.col("idx").alias("to_idx"), "table_id")
        more = hit.join(to, ["repo", "router", "fn", "to_idx"]).select("repo", F.col("path").alias("file"), "func", "idx", "table_id")
        known, before = cut(known.union(more).distinct()), n
        n = known.count()
        if n == before:
            break
    return known


def sends(routes: DataFrame, calls: DataFrame, dicts: DataFrame, funcs: DataFrame, globals_: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo, table_id, key, file, line, fn, payload): every call with a literal where a route expects a key; ``payload``: the keys of the last
    dictionary (repo, path, id, keys) among its arguments, null without one. A router doesn't send to itself."""
    routers = routes.select("repo", "func", "file").distinct()
    keyed = F.exists("args", lambda a: a["k"] == "str")
    c = calls.filter(keyed).select("repo", "path", "fn", "recv", F.coalesce("func", F.lit("")).alias("func"), "line", "args")
    hit = reached(c, routers, funcs, globals_, parents).join(routes.select("repo", F.col("file").alias("router"), F.col("func").alias("fn"), "idx", "table_id"), ["repo", "router", "fn"])
    arg = F.get("args", F.col("idx"))
    hit = hit.filter((arg["k"] == "str") & ~((F.col("path") == F.col("router")) & (F.col("func") == F.col("fn"))))
    last = F.element_at(F.filter("args", lambda a: (a["k"] == "dict") & a["d"].isNotNull()), -1)
    hit = hit.select("repo", "table_id", arg["s"].alias("key"), "path", "line", "fn", F.when(F.exists("args", lambda a: (a["k"] == "dict") & a["d"].isNotNull()), last["d"]).alias("id"))
    d = dicts.select("repo", "path", "id", F.transform("keys", lambda k: k["key"]).alias("payload"))
    return hit.join(d, ["repo", "path", "id"], "left").select("repo", "table_id", "key", F.col("path").alias("file"), "line", "fn", "payload").distinct()


def registered(writers: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, table_id, key): keys that calls hand to functions which write them into a table (repo, path, func, idx, name)."""
    w = writers.select("repo", F.col("func").alias("fn"), "idx", table_id(F.col("path"), F.col("name")).alias("table_id")).distinct()
    j = calls.select("repo", "fn", "args").join(w, ["repo", "fn"]).withColumn("a", F.get("args", F.col("idx"))).filter("a.k = 'str'")
    return j.select("repo", "table_id", F.col("a.s").alias("key")).distinct()
