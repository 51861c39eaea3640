"""Infrastructure pivots and bounded neighbourhoods over the edge table (J23-J29), for all entities at once."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import attach, written


def _rel(edges: DataFrame, rels: tuple[str, ...], src: str, dst: str) -> DataFrame:
    return edges.filter(F.col("rel").isin(*rels)).select(F.col("src_key").alias(src), F.col("dst_key").alias(dst))


def _sets(pairs: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def _with(base: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    for part in parts:
        name = [c for c in part.columns if c != key][0]
        base = base.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return base


def _mails_of_domains(edges: DataFrame) -> DataFrame:
    return _rel(edges, ("SENT_FROM", "CONTAINS_DOMAIN"), "email", "domain").distinct()


def _through(pairs: DataFrame, key: str, links: DataFrame, to: str) -> DataFrame:
    """``pairs`` whose ``key`` is replaced by what it is linked with in ``links(key, to)``; a key that holds most pairs, such as a mail provider, is salted."""
    sizes = pairs.groupBy(key).agg(F.count("*").alias("size"))
    lists = links.groupBy(key).agg(F.collect_set(to).alias("list")).join(sizes, key)
    rest = [c for c in pairs.columns if c != key]
    return attach(pairs, lists, key, "size", F.struct(*rest)).select(F.explode("list").alias(to), *rest)


def _members(entity: str, **parts: DataFrame) -> DataFrame:
    """Distinct ``(entity, kind, value)`` of tables that hold the entity and one other column."""
    each = [p.select(F.col(entity), F.lit(kind).alias("kind"), F.col([c for c in p.columns if c != entity][0]).alias("value")) for kind, p in parts.items()]
    return reduce(DataFrame.unionByName, each).distinct()


def ip_members(edges: DataFrame) -> DataFrame:
    """``(ip, kind, value)``: the domains, emails, campaigns and ASNs of each address."""
    resolve = _rel(edges, ("RESOLVES_TO",), "domain", "ip").distinct()
    return _members("ip", domain=resolve, email=_through(_mails_of_domains(edges), "domain", resolve, "ip"), campaign=_rel(edges, ("USES_IP",), "campaign", "ip"), asn=_rel(edges, ("BELONGS_TO_ASN",), "ip", "asn"))


def domain_members(edges: DataFrame) -> DataFrame:
    """``(domain, kind, value)``: addresses, URLs, emails and campaigns."""
    return _members("domain", ip=_rel(edges, ("RESOLVES_TO",), "domain", "ip"), url=_rel(edges, ("HOSTED_ON_DOMAIN",), "url", "domain"), email=_mails_of_domains(edges), campaign=_rel(edges, ("USES_DOMAIN",), "campaign", "domain"))


def hash_members(edges: DataFrame) -> DataFrame:
    """``(hash, kind, value)``: emails and campaigns."""
    return _members("hash", email=_rel(edges, ("CONTAINS_HASH",), "email", "hash"), campaign=_rel(edges, ("USES_HASH",), "campaign", "hash"))


def asn_members(edges: DataFrame) -> DataFrame:
    """``(asn, kind, value)``: addresses, domains and emails."""
    owned = _rel(edges, ("BELONGS_TO_ASN",), "ip", "asn").distinct()
    resolve = _rel(edges, ("RESOLVES_TO",), "domain", "ip").distinct()
    domains = _through(resolve, "ip", owned, "asn").distinct()
    return _members("asn", ip=owned, domain=domains, email=_through(_mails_of_domains(edges), "domain", domains, "asn"))


def _counted(base: DataFrame, entity: str, members: DataFrame, *kinds: str) -> DataFrame:
    """Per entity of ``base`` the number of its distinct members of each kind, added up where they are before anything is shuffled."""
    counts = members.groupBy(entity).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in kinds))
    return base.select(entity).distinct().join(counts, entity, "left").fillna(0, [f"n_{k}s" for k in kinds])


def _strength(**steps: float) -> Column:
    return F.least(F.lit(1.0), sum((F.col(f"n_{c}") * w for c, w in steps.items()), F.lit(0.0)))


def listed(counted: DataFrame, entity: str, members: DataFrame, *kinds: str) -> DataFrame:
    """``counted``, a pivot, with its members themselves, sorted, in place of the number of each of the ``kinds``."""
    lists = members.groupBy(entity).agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(f"{k}s") for k in kinds))
    out = counted.drop(*(f"n_{k}s" for k in kinds)).join(lists, entity, "left")
    return out.withColumns({f"{k}s": F.coalesce(f"{k}s", F.array().cast("array<string>")) for k in kinds})


def ip_lists(edges: DataFrame) -> DataFrame:
    """Per address its domains, emails, campaigns and ASNs, and strength."""
    return listed(ip_pivot(edges), "ip", ip_members(edges), "domain", "email", "campaign", "asn")


def domain_lists(edges: DataFrame) -> DataFrame:
    """Per domain its addresses, URLs, emails and campaigns, and strength."""
    return listed(domain_pivot(edges), "domain", domain_members(edges), "ip", "url", "email", "campaign")


def hash_lists(edges: DataFrame) -> DataFrame:
    """Per hash its emails and campaigns, and strength."""
    return listed(hash_pivot(edges), "hash", hash_members(edges), "email", "campaign")


def asn_lists(edges: DataFrame) -> DataFrame:
    """Per ASN its addresses, domains and emails."""
    return listed(asn_pivot(edges), "asn", asn_members(edges), "ip", "domain", "email")


def cluster_lists(edges: DataFrame, limit: int = 20) -> DataFrame:
    """``clusters`` with their campaigns."""
    first = clusters(edges, limit).withColumns({c: F.col(c).cast("int") for c in ("n_domains", "n_emails")})
    return listed(first, "ip", ip_members(edges).filter("kind = 'campaign'"), "campaign")


def ip_pivot(edges: DataFrame) -> DataFrame:
    """Per address its number of domains, emails, campaigns and ASNs, and strength (at least 0.2); ``ip_members`` lists them."""
    out = _counted(_rel(edges, ("RESOLVES_TO",), "domain", "ip"), "ip", ip_members(edges), "domain", "email", "campaign", "asn")
    return out.withColumn("strength", F.greatest(F.lit(0.2), _strength(domains=0.25, emails=0.1, campaigns=0.35)))


def domain_pivot(edges: DataFrame) -> DataFrame:
    """J24."""
    base = edges.filter("dst_label = 'Domain'").select(F.col("dst_key").alias("domain")).unionByName(edges.filter("src_label = 'Domain'").select(F.col("src_key").alias("domain")))
    return _counted(base, "domain", domain_members(edges), "ip", "url", "email", "campaign").withColumn("strength", F.greatest(F.lit(0.2), _strength(ips=0.3, emails=0.15, campaigns=0.35)))


def hash_pivot(edges: DataFrame) -> DataFrame:
    """J25."""
    return _counted(_rel(edges, ("CONTAINS_HASH",), "email", "hash"), "hash", hash_members(edges), "email", "campaign").withColumn("strength", _strength(emails=0.3, campaigns=0.4))


def asn_pivot(edges: DataFrame) -> DataFrame:
    """Per ASN its number of addresses, domains and emails."""
    return _counted(_rel(edges, ("BELONGS_TO_ASN",), "ip", "asn"), "asn", asn_members(edges), "ip", "domain", "email")


def clusters(edges: DataFrame, limit: int = 20) -> DataFrame:
    """Addresses with two domains or emails or more, the largest first."""
    out = ip_pivot(edges).filter((F.col("n_domains") >= 2) | (F.col("n_emails") >= 2))
    out = out.select("ip", "n_domains", "n_emails", "n_campaigns", _strength(domains=0.3, emails=0.15, campaigns=0.35).alias("strength"))
    return out.orderBy(F.desc("n_domains"), F.desc("n_emails"), "ip").limit(limit)


def email_paths(edges: DataFrame) -> DataFrame:
    """Per email its sender domain and addresses, embedded domains and theirs, links, payloads, campaigns."""
    resolve = _rel(edges, ("RESOLVES_TO",), "domain", "ip")
    sent, held = _rel(edges, ("SENT_FROM",), "email", "domain"), _rel(edges, ("CONTAINS_DOMAIN",), "email", "domain")
    parts = [
        _sets(sent.join(resolve, "domain"), "email", "ip", "sender_ips"), _sets(held, "email", "domain", "domains"), _sets(held.join(resolve, "domain"), "email", "ip", "resolved_ips"),
        _sets(_rel(edges, ("CONTAINS_URL",), "email", "url"), "email", "url", "urls"), _sets(_rel(edges, ("CONTAINS_HASH",), "email", "hash"), "email", "hash", "hashes"), _sets(_rel(edges, ("MEMBER_OF",), "email", "campaign"), "email", "campaign", "campaigns"),
    ]
    base = edges.filter("src_label = 'Email'").select(F.col("src_key").alias("email")).distinct()
    sender = sent.groupBy("email").agg(F.min("domain").alias("sender_domain"))
    return _with(base.join(sender, "email", "left"), "email", *parts)


def adjacency(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Each node's ``limit`` first neighbours (node, to, rank_degree), those with the fewest neighbours first; and (node, degree).

    Nodes are structs of label and key.  A node with very many neighbours ranks them
    in parts first, so no task sorts a hub's whole list.
    """
    there = edges.select(F.struct(F.col("src_label").alias("label"), F.col("src_key").alias("key")).alias("node"), F.struct(F.col("dst_label").alias("label"), F.col("dst_key").alias("key")).alias("to"))
    both = there.unionByName(there.select(F.col("to").alias("node"), F.col("node").alias("to"))).filter("node <> to").distinct()
    both = written(both, "both-ways")
    degrees = written(both.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    ranked = attach(both, degrees.select(F.col("node").alias("to"), F.col("degree"), F.col("degree").alias("size")), "to", "size", F.col("node"))
    part = F.pmod(F.xxhash64("to"), F.lit(64))
    for by in ([F.col("node"), part], [F.col("node")]):
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("degree", "to"))).filter(F.col("place") <= limit)
    return ranked.select("node", "to", "degree"), degrees


#: Bounds of a neighbourhood: depth and nodes, the usual and the most.
DEPTH, MOST_DEPTH, NODES, MOST_NODES = 2, 4, 50, 100
#: Neighbours of a node that one task joins with the centres that reach it, on average.
CHUNK = 2048
#: Nodes up to which a list stands in a row: a node's neighbours, and what a centre has found before the last level.
LISTED = 32


def _mark(numbers: str) -> Column:
    """A bit of 64 for each number of a list: two lists without a common bit have no number in common."""
    return F.expr(f"aggregate({numbers}, 0L, (a, x) -> a | shiftleft(1L, cast(pmod(x, 64L) AS INT)))")


def _named(edges: DataFrame, centres: DataFrame) -> tuple[DataFrame, Callable[[str, str], Column]]:
    """Nodes (node, label, key) as a written table, and the expression for ``node``: a hash under a seed for which no two of these nodes share one."""
    ends = edges.select(F.col("src_label").alias("label"), F.col("src_key").alias("key")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key")))
    each = ends.unionByName(centres.select("label", "key")).distinct()
    for seed in itertools.count():
        number = lambda label, key, seed=seed: F.xxhash64(F.lit(seed), F.col(label).isNull(), F.col(label), F.col(key))
        names = written(each.select(number("label", "key").alias("node"), "label", "key"), "names")
        if names.groupBy("node").count().filter("count > 1").isEmpty():
            return names, number


def _near(edges: DataFrame, names: DataFrame, number: Callable[[str, str], Column]) -> tuple[DataFrame, DataFrame]:
    """Each node's neighbours, dealt over chunks, and (node, n_chunks), as written tables.

    A row has node, chunk, to, the label and key of ``to``, the links between them (``>`` or ``<`` and the name), and ``around``, the neighbours of ``to`` if there are
    at most ``LISTED``, else null, and their mark.
    """
    src, dst = number("src_label", "src_key"), number("dst_label", "dst_key")
    there = edges.select(src.alias("node"), dst.alias("to"), F.concat(F.lit(">"), "rel").alias("link"))
    back = edges.select(dst.alias("node"), src.alias("to"), F.concat(F.lit("<"), "rel").alias("link"))
    near = written(there.unionByName(back.filter("node <> to")).groupBy("node", "to").agg(F.collect_set("link").alias("links")), "near")
    sizes = written(near.groupBy("node").agg(F.count("*").alias("size")).withColumn("n_chunks", F.ceil(F.col("size") / CHUNK).cast("int")), "degrees")
    dealt = attach(near, sizes.withColumn("degree", F.col("size")), "node", "size", F.col("to")).withColumn("chunk", F.pmod(F.xxhash64("to"), F.col("n_chunks")).cast("int")).drop("n_chunks")
    lists = dealt.filter(F.col("degree") <= LISTED).groupBy("node").agg(F.collect_list("to").alias("around")).withColumn("around_mark", _mark("around"))
    told = names.join(sizes.select("node", "size"), "node").join(lists, "node", "left").withColumnRenamed("node", "to")
    return written(attach(dealt.drop("degree"), told, "to", "size", F.col("node")), "dealt"), sizes


def whole_neighbourhood(edges: DataFrame, centres: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """All nodes (centre, label, key, distance) within ``depth`` of each row of ``centres(label, key)``, and the edges between them but those between two nodes of the last level.

    A breadth-first search of all centres at once, of which only the levels before the
    last are written.  A node of the last level comes through the least of the nodes
    that lead to it, and an edge through the lesser of its ends, which is told from
    the short lists that a centre and a neighbour bring along; so the rows returned,
    as many as centres times neighbours of the hubs they share, are neither shuffled
    nor written.  Only rows of a centre or of a neighbour without such a list are
    shuffled, to be told apart.  A hub's neighbours are dealt over chunks, so no task
    holds them all.  Every edge of a node that isn't of the last level lies inside,
    so edges are found without a look at their other end.
    """
    depth = max(1, min(depth, MOST_DEPTH))
    names, number = _named(edges, centres)
    dealt, sizes = _near(edges, names, number)

    def around(nodes: DataFrame, near: DataFrame, when: Column | None = None) -> DataFrame:
        """``nodes(centre, node, ...)`` with each of their neighbours ``near``."""
        times = nodes.groupBy("node").agg(F.count("*").alias("size"))
        asked = attach(nodes, times.join(sizes.select("node", "n_chunks"), "node"), "node", "size", F.col("centre"))
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).drop("n_chunks").alias("x")
        met = (F.col("x.node") == F.col("y.node")) & (F.col("x.chunk") == F.col("y.chunk"))
        return asked.join(near.alias("y"), met if when is None else met & when)

    found_node = [F.col("x.centre").alias("centre"), F.col("y.to").alias("node"), F.col("y.label").alias("label"), F.col("y.key").alias("key")]
    start = centres.select("label", "key").distinct()
    seen = written(start.select(F.concat_ws(":", "label", "key").alias("centre"), number("label", "key").alias("node"), "label", "key", F.lit(0).alias("distance")), "seen")
    for step in range(1, depth):
        found = around(seen.filter(F.col("distance") == step - 1).select("centre", "node"), dealt).select(*found_node).distinct()
        seen = written(seen.unionByName(found.join(seen.select("centre", "node"), ["centre", "node"], "left_anti").withColumn("distance", F.lit(step))), "seen")

    held = seen.groupBy("centre").agg(F.count("*").alias("size")).withColumn("held", F.col("size"))
    counted = attach(seen, held, "centre", "size", F.col("node"))
    lists = counted.filter(F.col("held") <= LISTED).groupBy("centre").agg(F.collect_list(F.struct("node", "label", "key", "distance")).alias("list"))
    few = lists.select("centre", F.explode("list").alias("x"), F.transform("list", lambda x: x["node"]).alias("inside")).select("centre", "x.*", "inside", F.filter("inside", lambda i: i < F.col("x.node")).alias("lesser")).withColumn("lesser_mark", _mark("lesser"))
    few, many = written(few, "few"), written(counted.filter(F.col("held") > LISTED).drop("held"), "many")
    some = not many.isEmpty()

    last = F.col("distance") == depth - 1
    new = ~F.array_contains("x.inside", F.col("y.to"))
    once = (F.col("x.lesser_mark").bitwiseAND(F.col("y.around_mark")) == 0) | ~F.arrays_overlap("x.lesser", "y.around")
    asked = few.filter(last).select("centre", "node", "inside", "lesser", "lesser_mark")
    direct = around(asked, dealt.filter("around IS NOT NULL"), new & once).select(*found_node)
    rest = around(asked, dealt.filter("around IS NULL"), new).select(*found_node)
    if some:
        rest = rest.unionByName(around(many.filter(last).select("centre", "node"), dealt).select(*found_node))
    rest = rest.distinct().join(seen.select("centre", "node"), ["centre", "node"], "left_anti")
    nodes = seen.unionByName(direct.unionByName(rest).withColumn("distance", F.lit(depth))).select("centre", "label", "key", "distance")

    def whole(rows: DataFrame) -> DataFrame:
        """The edges of rows of ``around``."""
        each = rows.select("x.centre", "x.label", "x.key", F.col("y.label").alias("to_label"), F.col("y.key").alias("to_key"), F.explode("y.links").alias("link"))
        there = F.col("link").startswith(">")
        end = lambda own, other: F.when(there, F.col(own)).otherwise(F.col(other))
        return each.select("centre", end("label", "to_label").alias("src_label"), end("key", "to_key").alias("src_key"), F.substring("link", 2, 1 << 30).alias("rel"), end("to_label", "label").alias("dst_label"), end("to_key", "key").alias("dst_key"))

    inside = whole(around(few.select("centre", "node", "label", "key", "inside"), dealt, new | (F.col("x.node") <= F.col("y.to"))))
    if some:
        inside = inside.unionByName(whole(around(many.select("centre", "node", "label", "key"), dealt)).distinct())
    return nodes, inside


def neighbourhood(edges: DataFrame, centres: DataFrame, depth: int = DEPTH, limit: int = NODES) -> tuple[DataFrame, DataFrame]:
    """At most ``limit`` nodes (centre, label, key, distance), itself included, within ``depth`` of each row of ``centres(label, key)``, and the edges between them.

    A breadth-first search of all centres at once.  Of a level that doesn't fit, the
    nodes with the fewest neighbours stay, hubs go first; ties by label and key.
    A node's first ``limit`` neighbours in that order hold all that any centre can
    still take from it, so a step joins at most ``limit`` rows a node, and a hub's
    list is never copied for each centre that reaches it.  An edge is found through
    that of its ends which has fewer neighbours.  Edges between two nodes of the last
    level are left out.
    """
    depth, limit = max(1, min(depth, MOST_DEPTH)), max(1, min(limit, MOST_NODES))
    near, degrees = adjacency(edges, limit)
    near = written(near, "near")
    lists = near.groupBy("node").agg(F.collect_list(F.struct("degree", "to")).alias("list"))  # at most ``limit`` entries each
    start = centres.select(F.struct("label", "key").alias("node")).distinct()
    seen = written(start.select(F.concat_ws(":", "node.label", "node.key").alias("centre"), "node", F.lit(0).alias("distance")), "seen")
    for step in range(1, depth + 1):
        last = seen.filter(F.col("distance") == step - 1)
        reached = last.groupBy("node").agg(F.count("*").alias("size"))
        reached = attach(last.select("centre", "node"), reached.join(lists, "node"), "node", "size", F.col("centre"))
        found = reached.select("centre", F.explode("list").alias("x")).select("centre", F.col("x.to").alias("node"), F.col("x.degree").alias("degree")).distinct()
        found = found.join(seen.select("centre", "node"), ["centre", "node"], "left_anti")
        room = seen.groupBy("centre").agg((F.lit(limit) - F.count("*")).alias("room"))
        order = Window.partitionBy("centre").orderBy("degree", "node")
        found = found.withColumn("place", F.row_number().over(order)).join(room, "centre").filter("place <= room")
        seen = written(seen.unionByName(found.select("centre", "node", F.lit(step).alias("distance"))), "seen")
    ends = edges.select("*", F.struct(F.col("src_label").alias("label"), F.col("src_key").alias("key")).alias("src"), F.struct(F.col("dst_label").alias("label"), F.col("dst_key").alias("key")).alias("dst"))
    of = lambda side: degrees.select(F.col("node").alias(side), F.col("degree").alias(f"{side}_degree"), F.col("degree").alias("size"))
    both = attach(attach(ends, of("src"), "src", "size", F.col("dst")), of("dst"), "dst", "size", F.col("src"))
    low = F.struct(F.col("src_degree"), F.col("src")) <= F.struct(F.col("dst_degree").alias("src_degree"), F.col("dst").alias("src"))
    held = both.select("src_label", "src_key", "rel", "dst_label", "dst_key", F.when(low, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("other"))
    held = held.groupBy("node").agg(F.collect_list(F.struct("other", "src_label", "src_key", "rel", "dst_label", "dst_key")).alias("held"))
    times = seen.groupBy("node").agg(F.count("*").alias("size"))
    mine = attach(seen, times.join(held, "node"), "node", "size", F.col("centre")).select("centre", F.col("distance").alias("d"), F.explode("held").alias("e")).select("centre", "d", "e.*")
    inside = mine.join(seen.select("centre", F.col("node").alias("other"), F.col("distance").alias("e")), ["centre", "other"]).filter(F.least("d", "e") <= depth - 1)
    return seen.select("centre", "node.label", "node.key", "distance"), inside.select("centre", "src_label", "src_key", "rel", "dst_label", "dst_key")
