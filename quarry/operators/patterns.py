"""A read-only subset of the graph query language over node and edge tables, planned as joins.

``MATCH`` chains of nodes and relations (types, direction, ``*m..n``), several chains that
share variables, ``WHERE`` over ``id``, ``ticker`` and ``label``, ``RETURN [DISTINCT]`` with
aliases, ``LIMIT``.  One relation of the graph serves at most one place of a match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quarry.core.runtime import cut
from quarry.operators.graph import k_hop

NODE = r"\(\s*(?P<var>\w*)\s*(?::\s*(?P<label>\w+))?\s*(?:\{\s*(?P<key>\w+)\s*:\s*(?P<val>'[^']*'|\"[^\"]*\"|\$\w+)\s*\})?\s*\)"
RELATION = r"(?P<left><)?-\s*\[\s*(?P<rvar>\w*)\s*(?::\s*(?P<types>[\w|]+))?\s*(?P<star>\*\s*(?P<lo>\d+)?\s*(?:\.\.\s*(?P<hi>\d+)?)?)?\s*(?:\{[^}]*\})?\]\s*-(?P<right>>)?"
WRITES = r"\b(CREATE|MERGE|SET|DELETE|DETACH|REMOVE|DROP)\b"
LITERAL = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\""
HOPS, MOST_HOPS = 3, 5


@dataclass(frozen=True)
class Subgraph:
    """What a statement asks of the offline store: a walk from a root under filters."""

    read_only: bool
    has_match: bool
    root: str | None = None
    relations: tuple[str, ...] | None = None
    hops: int = HOPS
    as_of: str | None = None
    status: str | None = "ACTIVE_CURRENT"


def subgraph(statement: str | None, params: dict | None = None) -> Subgraph:
    """The walk of a statement; one that writes is not read-only, one without ``MATCH`` asks for nothing."""
    s, params = (statement or "").strip(), params or {}
    bare = re.sub(LITERAL, " ", s)
    if not s or re.search(WRITES, bare, re.I):
        return Subgraph(False, False)
    if not re.search(r"\bMATCH\b", bare, re.I):
        return Subgraph(True, False)

    def value(text: str | None) -> str | None:
        v = None if text is None else params.get(text[1:]) if text.startswith("$") else text[1:-1]
        return str(v) if v not in (None, "") else None

    node = next((m for m in re.finditer(NODE, s) if (m["key"] or "").lower() == "ticker"), None)
    where = re.search(rf"\bs\.ticker\s*=\s*({LITERAL}|\$\w+)", s, re.I)
    root = value(node["val"]) if node else value(where[1]) if where else None
    rel = re.search(RELATION, s)
    types = tuple(t.strip().upper() for t in rel["types"].split("|") if t.strip()) if rel and rel["types"] else None
    hops = 1
    if rel and rel["star"]:
        top = rel["hi"] or (rel["lo"] if ".." not in rel["star"] else None)
        hops = max(1, min(int(top) if top else HOPS, MOST_HOPS))
    day = str(params["as_of_date"]).strip()[:10] if params.get("as_of_date") else None
    if day is None and (m := re.search(r"valid_(?:from|to)\s*(?:<=|>=|<|>)\s*['\"](\d{4}-\d{2}-\d{2})['\"]", s, re.I)):
        day = m[1]
    status = re.search(r"(?:coalesce\s*\([^)]*\)|\w+\.status)\s*=\s*['\"](\w+)['\"]", s, re.I)
    return Subgraph(True, True, root.strip().upper() if root else None, types, hops, day, status[1].upper() if status else "ACTIVE_CURRENT" if day else None)


def dispatched(edges: DataFrame, statement: str, params: dict | None = None) -> DataFrame:
    """Edges ``(source, target, rel_type, status, valid_from, valid_to, ...)`` that a statement asks for, with ``hop``.

    Without a root all edges under the filters come with hop 1; what writes or does not match gives none.
    """
    q = subgraph(statement, params)
    x = edges
    if not q.read_only or not q.has_match:
        return x.limit(0).withColumn("hop", F.lit(1))
    if q.relations:
        x = x.where(F.col("rel_type").isin(*q.relations))
    if q.status:
        x = x.where(F.upper("status") == q.status)
    if q.as_of:
        x = x.where(F.coalesce(F.col("valid_from") <= q.as_of, F.lit(True)) & F.coalesce(F.col("valid_to") >= q.as_of, F.lit(True)))
    if q.root is None:
        return x.withColumn("hop", F.lit(1))
    root = x.sparkSession.createDataFrame([(q.root,)], "node string")
    up = x.withColumns({"_s": F.col("source"), "_t": F.col("target"), "source": F.upper("source"), "target": F.upper("target")})
    return k_hop(cut(up), root, q.hops).withColumns({"source": F.col("_s"), "target": F.col("_t")}).select(*edges.columns, "hop")


def _chains(text: str) -> list[tuple[list, list]]:
    """Nodes and relations of each chain of a ``MATCH``."""
    out, at = [], 0
    node, relation = re.compile(NODE), re.compile(RELATION)
    while m := node.match(text, at):
        nodes, relations = [m], []
        at = m.end()
        while r := relation.match(text, re.compile(r"\s*").match(text, at).end()):
            m = node.match(text, re.compile(r"\s*").match(text, r.end()).end())
            if m is None:
                raise ValueError(f"a relation without a node: {text[at:at + 40]}")
            relations.append(r)
            nodes.append(m)
            at = m.end()
        out.append((nodes, relations))
        comma = re.compile(r"\s*,\s*").match(text, at)
        at = comma.end() if comma else at
        if not comma:
            break
    if not out or text[at:].strip():
        raise ValueError(f"not understood: {text[at:at + 40]}")
    return out


def _condition(text: str, variables: set[str]) -> str:
    """``WHERE`` as an SQL expression over the columns ``<variable>_<property>``."""
    t = re.sub(r"\b(\w+)\.(id|ticker|label)\b", lambda m: f"{m[1]}_{m[2]}", text)
    t = re.sub(r"\b(\w+)\s*<>\s*(\w+)\b", lambda m: f"{m[1]}_id <> {m[2]}_id" if {m[1], m[2]} <= variables else m[0], t)
    return re.sub(rf"(\w+)\s*=~\s*({LITERAL})", lambda m: f"rlike({m[1]}, r'^(?:{m[2][1:-1]})$')", t)


def _hops(edges: DataFrame, types: str | None, left: bool, right: bool, lo: int, hi: int) -> DataFrame:
    """``(x, y, used)``: ends of paths of ``lo`` to ``hi`` relations with the numbers of those."""
    e = edges if types is None else edges.where(F.col("rel_type").isin(*types.split("|")))
    one = e.select(F.col("source").alias("x"), F.col("target").alias("y"), F.array("edge").alias("used"))
    back = e.select(F.col("target").alias("x"), F.col("source").alias("y"), F.array("edge").alias("used"))
    one = back if left and not right else one if right and not left else one.unionByName(back)
    ends = one.select("x").union(one.select("y")).distinct()
    out = ends.select("x", F.col("x").alias("y"), F.array().cast("array<bigint>").alias("used")) if lo == 0 else None
    path = one
    for n in range(1, hi + 1):
        if n >= lo:
            out = path if out is None else out.unionByName(path)
        if n < hi:
            step = one.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("used").alias("more"))
            path = path.join(step, "y").where(~F.arrays_overlap("used", "more")).select("x", F.col("z").alias("y"), F.concat("used", "more").alias("used"))
    return out


def run(statement: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of a statement over ``nodes (id, label, ticker)`` and ``edges (edge, source, target, rel_type)``.

    Rows of ``RETURN`` are strings; a bare variable stands for its id.
    """
    s = statement.strip()
    if re.search(WRITES, re.sub(LITERAL, " ", s), re.I):
        raise PermissionError("the statement writes")
    m = re.fullmatch(r"(?is)MATCH\s+(?P<match>.*?)(?:\s+WHERE\s+(?P<where>.*?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<ret>.*?)(?:\s+LIMIT\s+(?P<limit>\d+))?\s*", s)
    if not m:
        raise ValueError("neither MATCH nor RETURN")
    bound, row, names = set(), None, iter(f"_v{i}" for i in range(1000))
    for chain, relations in _chains(m["match"]):
        variables = [n["var"] or next(names) for n in chain]
        first = variables[0]
        for i, (v, n) in enumerate(zip(variables, chain)):
            side = nodes.select(*[F.col(c).alias(f"{v}_{c}") for c in ("id", "label", "ticker")])
            if n["label"]:
                side = side.where(F.col(f"{v}_label") == n["label"])
            if n["key"]:
                side = side.where(F.col(f"{v}_{n['key']}") == n["val"][1:-1])
            if i == 0:
                row = side if row is None else _bound(row, first, bound)
            else:
                r = relations[i - 1]
                lo, hi = (1, 1) if not r["star"] else (int(r["lo"] or 1), int(r["hi"] or r["lo"] or HOPS))
                hop = _hops(edges, r["types"], bool(r["left"]), bool(r["right"]), lo, min(hi, MOST_HOPS))
                row = row.join(hop.select(F.col("x").alias(f"{variables[i - 1]}_id"), F.col("y").alias("_y"), F.col("used").alias("_u")), f"{variables[i - 1]}_id")
                row = row.where(F.col(f"{v}_id") == F.col("_y")) if v in bound else row.join(side, F.col("_y") == F.col(f"{v}_id"))
                if "_used" in row.columns:
                    row = row.where(~F.arrays_overlap("_used", "_u")).withColumn("_used", F.concat("_used", "_u")).drop("_y", "_u")
                else:
                    row = row.withColumnRenamed("_u", "_used").drop("_y")
            bound.add(v)
    if m["where"]:
        row = row.where(_condition(m["where"], bound))
    cols = []
    for part in m["ret"].split(","):
        p = re.fullmatch(r"\s*(\w+)(?:\.(\w+))?(?:\s+AS\s+(\w+))?\s*", part, re.I)
        if not p:
            raise ValueError(f"not understood: {part}")
        cols.append(F.col(f"{p[1]}_{p[2] or 'id'}").alias(p[3] or p[2] or p[1]))
    row = row.select(cols)
    row = row.distinct() if m["distinct"] else row
    return row.limit(int(m["limit"])) if m["limit"] else row


def _bound(row: DataFrame, first: str, bound: set[str]) -> DataFrame:
    if first not in bound:
        raise ValueError("chains of one MATCH must share a variable, in the first node of the later one")
    return row
